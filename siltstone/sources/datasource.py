"""Spark data sources: ``siltstone_mft`` for volume images and ``siltstone_usn`` for journal captures.

    spark.dataSource.register(MftSource)
    spark.read.format("siltstone_mft").option("path", "/images/*.img").load()

Paths may be URIs, see ``storage``.  ``siltstone_mft`` plans record ranges on the driver from the boot
sector and the first record only, of many images at a time; tasks read the byte extents of their range.
Records in holes of the table are zeros and no records: they are passed over unless ``holes`` is
``read``.  The options ``first`` and ``last`` bound the record number and skip partitions.  They are
options and not pushed filters because a pushed filter stays with the table in this Spark version, so
that another query over the same DataFrame would miss rows.

``siltstone_usn`` reads folders, one for each journal, with one file per read buffer, named
``<seq>.usn``, in batch and as a stream.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from siltstone.errors import SiltstoneError
from siltstone.sources import records, storage, usn
from siltstone.sources.volume import Bootstrap, Extent, read_extents, spans

RAW = "image string, record_number bigint, raw binary, allocated boolean"


def _paths(options: dict) -> list[str]:
    if not options.get("path"):
        raise SiltstoneError("INVALID_OPTION", details="path is missing")
    return sorted(p for pattern in options["path"].split(",") for p in (storage.expand(pattern) or [pattern]))


def _within(extents: list[Extent], low: int, high: int) -> list[Extent]:
    """The extents that have a part of the bytes low..high."""
    return [e for e in extents if e[0] < high and e[0] + e[2] > low]


@dataclass
class MftRange(InputPartition):
    path: str
    record_size: int
    first: int
    last: int  # exclusive
    extents: list[Extent]
    bitmap_size: int
    bitmap: list[Extent]


class MftReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = _paths(options)
        self.raw = options.get("output", "decoded").lower() == "raw"
        self.fail_fast = options.get("mode", "FAILFAST").upper() == "FAILFAST"
        self.per_partition = int(options.get("bytesperpartition", 64 << 20))
        self.holes = options.get("holes", "skip").lower() == "read"
        self.low, self.high = int(options.get("first", 0)), int(options["last"]) + 1 if "last" in options else None

    def _ranges(self, path: str) -> list[InputPartition]:
        boot = Bootstrap(path)
        size = boot.geometry.record_size
        step = max(8, self.per_partition // size // 8 * 8)
        end = boot.n_records if self.high is None else min(boot.n_records, self.high)
        out: list[InputPartition] = []
        for begin, until in [(0, boot.n_records)] if self.holes else spans(boot.extents, size, boot.n_records):
            until = min(until, end)
            for first in range(max(begin, self.low), until, step):
                last = min(first + step, until)
                bits = _within(boot.bitmap_extents, first // 8, (last + 7) // 8)
                out.append(MftRange(path, size, first, last, _within(boot.extents, first * size, last * size), boot.bitmap_size, bits))
        return out

    def partitions(self) -> Sequence[InputPartition]:
        with ThreadPoolExecutor(16) as pool:  # waiting for files, not computing
            out = [r for ranges in pool.map(self._ranges, self.paths) for r in ranges]
        return out or [MftRange("", 1024, 0, 0, [], 0, [])]

    def read(self, partition: MftRange) -> Iterator[pa.RecordBatch]:
        per_batch = max(1, (4 << 20) // partition.record_size)
        if partition.last <= partition.first:
            return
        with storage.open_file(partition.path) as file:
            begin = partition.first // 8
            n_bytes = max(0, min((partition.last + 7) // 8, partition.bitmap_size) - begin)
            bits = np.unpackbits(np.frombuffer(read_extents(file, partition.bitmap, begin, n_bytes), np.uint8), bitorder="little")
            for first in range(partition.first, partition.last, per_batch):
                last = min(first + per_batch, partition.last)
                numbers = np.arange(first, last)
                data = read_extents(file, partition.extents, first * partition.record_size, (last - first) * partition.record_size)
                table = np.frombuffer(data, np.uint8).reshape(-1, partition.record_size)
                at = numbers - 8 * begin
                allocated = pa.array(np.where(at < len(bits), bits[np.minimum(at, len(bits) - 1)], 0).astype(bool) if len(bits) else np.zeros(len(at), bool))
                images = [partition.path] * len(numbers)
                if self.raw:
                    yield pa.RecordBatch.from_arrays([pa.array(images), pa.array(numbers), pa.array([r.tobytes() for r in table], pa.binary()), allocated], ["image", "record_number", "raw", "allocated"])
                else:
                    yield records.decode_table(images, numbers, allocated, table, self.fail_fast)


class MftSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "siltstone_mft"

    def schema(self) -> str:
        return RAW if self.options.get("output", "decoded").lower() == "raw" else records.DECODED

    def reader(self, schema) -> MftReader:
        return MftReader(dict(self.options))


@dataclass
class Captures(InputPartition):
    files: list[tuple[str, int, str]]  # (journal, seq, path)


def _captures(folder: str, after: int = -1) -> list[tuple[int, str, int]]:
    """(seq, path, bytes) of the captured buffers of a folder with a number beyond ``after``, in order."""
    found = []
    for name, size, is_folder in storage.entries(folder):
        stem, dot, end = name.rpartition(".")
        if not is_folder and dot and end == "usn" and stem.isdigit() and int(stem) > after:
            found.append((int(stem), f"{folder.rstrip('/')}/{name}", size))
    return sorted(found)


def _journal(folder: str) -> str:
    return folder.rstrip("/").rpartition("/")[2]


def _grouped(files: list[tuple[str, int, str, int]], per_partition: int) -> list[InputPartition]:
    """Partitions of (journal, seq, path, bytes)."""
    groups, size = [[]], 0
    for journal, seq, path, n in files:
        size += n
        groups[-1].append((journal, seq, path))
        if size >= per_partition:
            groups.append([])
            size = 0
    return [Captures(g) for g in groups if g] or [Captures([])]


def _read(partition: Captures) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(partition.files), 64):
        part = partition.files[start : start + 64]
        buffers = [storage.read_file(path) for _, _, path in part]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part]), pa.array([p[1] for p in part], pa.int64()), pa.array(buffers, pa.binary())], ["journal", "seq", "buffer"])


class UsnReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folders = _paths(options)
        self.per_partition = int(options.get("bytesperpartition", 64 << 20))

    def partitions(self) -> Sequence[InputPartition]:
        with ThreadPoolExecutor(16) as pool:
            listed = list(pool.map(_captures, self.folders))
        return _grouped([(_journal(f), *c) for f, found in zip(self.folders, listed) for c in found], self.per_partition)

    def read(self, partition: Captures) -> Iterator[pa.RecordBatch]:
        return _read(partition)


class UsnStreamReader(DataSourceStreamReader):
    """A stream of buffers, each journal in the order of its numbers.

    The offset has, for each journal folder, the number of the last buffer taken or passed over and the
    next usn.  A journal moves on by itself: what arrives late for one is not skipped because another is
    ahead.  Within a journal buffers must arrive in order.  The rules of a reader hold: a buffer whose
    next usn is 0 or lies before the current one is passed over; for the others it is the new current one.

    Options: ``startingUsn`` is 'first' (default), 'next' or a usn; from a usn on, buffers that end before
    it are passed over, and ``decode_stream`` drops the records before it.  ``maxBuffersPerTrigger``
    (default 1,000) and ``maxBytesPerTrigger`` (64 MiB) bound a batch, 0 for no bound.  Spark does not tell a source in
    Python where a restarted query stands when it asks for the newest offset, so the bounds need
    ``progress``, a folder of the query in which the source notes what was planned; without it the first
    batch of a start takes all there is and the bounds hold from the second on.
    """

    def __init__(self, options: dict):
        self.folders = [f.rstrip("/") for f in _paths(options)]
        self.per_partition = int(options.get("bytesperpartition", 64 << 20))
        self.start = options.get("startingusn", "first")
        self.most, self.most_bytes = (int(options.get(f"max{what}pertrigger", default)) or 1 << 62 for what, default in (("buffers", 1000), ("bytes", 64 << 20)))
        self.progress = options.get("progress", "").rstrip("/")
        self.first: dict | None = None
        self.at: dict | None = self._noted()

    def _noted(self) -> dict | None:
        """What was planned last, as noted; no note is a first start."""
        if not self.progress:
            return None
        notes = sorted(int(n) for n, _, _ in storage.entries(self.progress) if n.isdigit())
        return json.loads(storage.read_file(f"{self.progress}/{notes[-1]}")) if notes else self.initialOffset()

    def _note(self) -> None:
        notes = sorted(int(n) for n, _, _ in storage.entries(self.progress) if n.isdigit())
        storage.write_file(f"{self.progress}/{notes[-1] + 1 if notes else 0}", json.dumps(self.at).encode())

    def initialOffset(self) -> dict:
        if self.first is None:
            begin = {f: {"seq": -1, "usn": 0 if self.start in ("first", "next") else int(self.start)} for f in self.folders}
            self.first = self._step(begin, None)[0] if self.start == "next" else begin
        return self.first

    def _step(self, begin: dict, bound: tuple[int, int] | None, until: dict | None = None) -> tuple[dict, list[tuple[str, int, str, int]]]:
        """The offset after at most so many buffers and bytes, and the buffers that are taken up to there."""
        out, taken = {}, []
        if bound:  # each journal has its share, so that none waits for another
            bound = tuple(-(-b // len(self.folders)) for b in bound)
        for folder in self.folders:
            count, size = 0, 0
            at = begin.get(folder, {"seq": -1, "usn": 0 if self.start in ("first", "next") else int(self.start)})
            seq, current = at["seq"], at["usn"]
            last = until.get(folder, at)["seq"] if until is not None else None
            for number, path, n in _captures(folder, seq):
                if last is not None and number > last or bound and count and (count >= bound[0] or size + n > bound[1]):
                    break
                count, size, seq = count + 1, size + n, number
                with storage.open_file(path) as file:
                    head = file.read(8)
                following = int.from_bytes(head, "little", signed=True) if len(head) == 8 else 0
                if following != 0 and following >= current:
                    current = following
                    taken.append((_journal(folder), number, path, n))
            out[folder] = {"seq": seq, "usn": current}
        return out, taken

    def latestOffset(self) -> dict:
        # Spark passes no limit, so the reader steps on from the batch that it planned last.
        begin = self.initialOffset() if self.at is None else self.at
        return self._step(begin, (self.most, self.most_bytes) if self.at is not None else None)[0]

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.at = end
        if self.progress:
            self._note()
        return _grouped(self._step(start, None, end)[1], self.per_partition)

    def read(self, partition: Captures) -> Iterator[pa.RecordBatch]:
        return _read(partition)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class UsnSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "siltstone_usn"

    def schema(self) -> str:
        return "journal string, seq bigint, buffer binary"

    def reader(self, schema) -> UsnReader:
        return UsnReader(dict(self.options))

    def streamReader(self, schema) -> UsnStreamReader:
        return UsnStreamReader(dict(self.options))


def register(spark) -> None:
    """Make both formats known to a session."""
    spark.dataSource.register(MftSource)
    spark.dataSource.register(UsnSource)


def decode_stream(buffers, reason_mask: int = 0xFFFFFFFF, start: str | int = "first"):
    """The records of a streamed (or batch) table of buffers with a reason in the mask, from a usn on."""
    return usn.filtered(usn.decode_buffers(buffers), reason_mask, start)
