"""Binary records, volume images and journal captures made from the test tables, for the sources to read.

Only the queries and the tests use this module.  Images and captures are written once for an application
and a folder of tables, below the shared folder, by all tasks: each writes its records to their place
in a file that is as long as the image already.  That takes a shared folder that can be mounted.
"""

from __future__ import annotations

import os
import struct
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import layout
from siltstone.operators.prefix import before
from siltstone.session import shared_dir, shuffle_partitions

MASK64 = (1 << 64) - 1


def attribute(type_id: int, value: bytes, number: int = 0, stream: str = "") -> bytes:
    """A resident attribute."""
    name = stream.encode("utf-16-le")
    at = (24 + len(name) + 7) // 8 * 8
    length = (at + len(value) + 7) // 8 * 8
    head = struct.pack("<IIBBHHHIHBB", type_id, length, 0, len(name) // 2, 24, 0, number, len(value), at, 0, 0)
    return (head + name).ljust(at, b"\0") + value.ljust(length - at, b"\0")


def stream_attribute(type_id: int, size: int, runs: bytes, number: int = 0, lowest: int = 0, stream: str = "") -> bytes:
    """A non-resident attribute with an encoded run list."""
    name = stream.encode("utf-16-le")
    at = (64 + len(name) + 7) // 8 * 8
    length = (at + len(runs) + 7) // 8 * 8
    head = struct.pack("<IIBBHHHqqHB5xQQQ", type_id, length, 1, len(name) // 2, 64, 0, number, lowest, 0, at, 0, size & MASK64, size & MASK64, size & MASK64)
    return (head + name).ljust(at, b"\0") + runs.ljust(length - at, b"\0")


def run_list(runs: list[tuple[int | None, int]]) -> bytes:
    """(cluster delta or None for a hole, cluster count) -> run list with its end mark."""
    out = b""
    for delta, count in runs:
        n = max(1, (count.bit_length() + 7) // 8)
        d = b"" if delta is None else delta.to_bytes(delta.bit_length() // 8 + 1, "little", signed=True)
        out += bytes([n | len(d) << 4]) + count.to_bytes(n, "little") + d
    return out + b"\0"


def standard_information(creation: int, modification: int, access: int, attributes: int = 0) -> bytes:
    return struct.pack("<QQQQI12x", creation & MASK64, modification & MASK64, modification & MASK64, access & MASK64, attributes)


def name_value(parent: int, name: str, namespace: int, attributes: int = 0, size: int = 0) -> bytes:
    units = name.encode("utf-16-le", "surrogatepass")[:510]
    return struct.pack("<Q32xQQIIBB", parent & MASK64, size & MASK64, size & MASK64, attributes & 0xFFFFFFFF, 0, len(units) // 2, namespace) + units


def list_value(entries: list[tuple[int, int]]) -> bytes:
    """(type, record reference) -> value of an attribute list."""
    return b"".join(struct.pack("<IHBBQQH", t, 32, 0, 26, 0, r & MASK64, 0).ljust(32, b"\0") for t, r in entries)


def _first(size: int) -> int:
    """Where the attributes of a record begin, behind the update sequence."""
    return (48 + 2 * (size // layout.SECTOR + 1) + 7) // 8 * 8


def record(sequence: int, flags: int, attributes: list[bytes], base: int = 0, size: int = 1024) -> bytes:
    """A whole record with sector ends replaced by the update sequence; it grows by 1024 where needed."""
    body = b"".join(attributes) + struct.pack("<II", layout.END, 0)
    while (first := _first(size)) + len(body) > size:
        size += 1024
    words = size // layout.SECTOR + 1
    head = struct.pack("<4sHHQHHHHIIQHHI", b"FILE", 48, words, 0, sequence, 1, first, flags, first + len(body), size, base & MASK64, len(attributes), 0, 0)
    out = bytearray((head.ljust(first, b"\0") + body).ljust(size, b"\0"))
    mark = b"\x01\x02"
    out[48:50] = mark
    for s in range(words - 1):
        end = (s + 1) * layout.SECTOR - 2
        out[50 + 2 * s : 52 + 2 * s] = out[end : end + 2]
        out[end : end + 2] = mark
    return bytes(out)


def boot_sector(sector: int, per_cluster: int, total: int, mft_lcn: int, info: int) -> bytes:
    out = bytearray(512)
    struct.pack_into("<HB", out, 11, sector, per_cluster)
    struct.pack_into("<QQQb", out, 40, total, mft_lcn, 0, info)
    return bytes(out)


def usn_record(major: int, usn: int, ticks: int, file_id: bytes, parent_id: bytes, reason: int, name: str) -> bytes:
    text = name.encode("utf-16-le", "surrogatepass")
    start = {2: 60, 3: 76}.get(major, 60)
    length = (start + len(text) + 7) // 8 * 8
    head = struct.pack("<IHH", length, major, 0) + file_id + parent_id + struct.pack("<qqIIIIHH", usn, ticks, reason, 0, 0, 0, len(text), start)
    return (head[:start].ljust(start, b"\0") + text).ljust(length, b"\0")


def _ticks(at: pa.Array) -> list[int]:
    return [0 if v is None else v * 10 + layout.EPOCH_TICKS for v in at.cast(pa.int64()).to_pylist()]


def _spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores: small tables come in one partition, and encoding and decoding are work for Python."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, shuffle_partitions(spark)))


#: Records of a page: what one group of tasks writes.  Pages without records are holes in the table.
PAGE = 8192
#: Where the bitmap begins, and the table unless the bitmap is longer than what is between them.
BITMAP_AT, TABLE_AT = 1 << 20, 16 << 20


def input_folder(spark, sf_dir: str, kind: str) -> str:
    """The folder of the binary input made from the tables in ``sf_dir``, as a local path."""
    base = shared_dir(spark)
    if "://" in base and not base.startswith("file://"):
        raise ValueError(f"binary test input needs a shared folder with a path, not {base}")
    return f"{base.removeprefix('file://')}/siltstone-input/{spark.sparkContext.applicationId}/{sf_dir.strip('/').replace('/', '-')}/{kind}"


def _once(folder: str, make) -> str:
    """Make the files of a folder unless that was done before."""
    if not os.path.exists(f"{folder}/done"):
        os.makedirs(folder, exist_ok=True)
        make()
        open(f"{folder}/done", "w").close()
    return folder


def _named_records(spark, sf_dir: str) -> DataFrame:
    """The records of all volumes with their names.

    A missing time becomes 0, a missing parent a record that does not exist, a missing name ''.
    """

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    times = ["created", "modified", "accessed"]
    normal = table("mft_record").select("volume_id", "record_number", "sequence", "flags", "allocated", "base_reference", *times)
    system = table("system_record")
    fixed = system.select("volume_id", "record_number", "sequence", "flags", F.lit(True).alias("allocated"), F.lit(0).cast("bigint").alias("base_reference"), *[F.lit(None).cast(normal.schema[t].dataType).alias(t) for t in times])
    none = F.lit((1 << 48) - 1)
    columns = ["volume_id", "record_number", "attr_id", F.coalesce("parent_reference", none).alias("parent"), "namespace", F.coalesce("file_attributes", F.lit(0)).alias("attributes"), F.coalesce("real_size", F.lit(0)).alias("size"), F.coalesce("name", F.lit("")).alias("name")]
    names = table("file_name").select(*columns).distinct()
    own = system.select("volume_id", "record_number", F.lit(0).alias("attr_id"), F.col("parent_reference").alias("parent"), "namespace", F.lit(6).cast("bigint").alias("attributes"), F.lit(0).cast("bigint").alias("size"), "name")
    listed = names.unionByName(own).groupBy("volume_id", "record_number").agg(F.array_sort(F.collect_list(F.struct("attr_id", "parent", "namespace", "attributes", "size", "name"))).alias("names"))
    return normal.unionByName(fixed).join(listed, ["volume_id", "record_number"], "left")


def mft_image_files(spark, sf_dir: str) -> str:
    """The folder of one image per volume, ``volume-<id>.img``.

    A record with names has a data stream of the largest size that they give.  The table of a volume is
    fragmented, see ``_table_layout``: as far as record 0 has room to tell.
    """
    folder = input_folder(spark, sf_dir, "images")

    def make() -> None:
        rows = _named_records(spark, sf_dir).withColumn("page", F.floor(F.col("record_number") / PAGE))
        pages: dict[int, list[int]] = {}
        for r in rows.select("volume_id", "page").distinct().collect():  # a few pages a volume
            pages.setdefault(r["volume_id"], []).append(r["page"])
        own = {r["volume_id"]: r["names"] for r in rows.where("record_number = 0").select("volume_id", "names").collect()}
        volumes = {}
        for v in spark.read.parquet(f"{sf_dir}/volumes.parquet").collect():
            cluster = v["sector_size"] * v["sectors_per_cluster"]
            info = v["file_record_size_info"]
            size = info * cluster if info > 0 else 1 << -info
            if 0 not in pages.get(v["volume_id"], []):
                continue
            following = max(pages[v["volume_id"]]) + 1
            bits = following * PAGE // 8
            begin = -(-max(TABLE_AT, BITMAP_AT + bits) // cluster) * cluster
            bitmap = stream_attribute(layout.BITMAP, bits, run_list([(BITMAP_AT // cluster, -(-bits // cluster))]))
            others = [attribute(layout.STANDARD_INFORMATION, standard_information(0, 0, 0)), *_name_attributes(own.get(v["volume_id"])), stream_attribute(layout.DATA, 0, b""), bitmap]
            at, runs = _table_layout(pages[v["volume_id"]], PAGE * size, cluster, begin, size - _first(size) - sum(map(len, others)) - 8)
            data = stream_attribute(layout.DATA, following * PAGE * size, runs)
            volumes[v["volume_id"]] = (size, at, data, bitmap)
            with open(f"{folder}/volume-{v['volume_id']}.img", "wb") as file:
                file.truncate(max(at.values()) + PAGE * size + cluster)
                file.write(boot_sector(v["sector_size"], v["sectors_per_cluster"], v["total_sectors"], at[0] // cluster, info))

        def write(key: tuple, group: pa.Table) -> pa.Table:
            volume, page = key[0].as_py(), key[1].as_py()
            size, at, data, bitmap = volumes[volume]
            bits = bytearray(PAGE // 8)
            with open(f"{folder}/volume-{volume}.img", "r+b") as file:
                for number, allocated, raw in zip(group["record_number"].to_pylist(), group["allocated"].to_pylist(), _raws(group, size, data, bitmap)):
                    nth = number - page * PAGE
                    if allocated:
                        bits[nth // 8] |= 1 << nth % 8
                    file.seek(at[page] + nth * size)
                    file.write(raw)
                file.seek(BITMAP_AT + page * PAGE // 8)
                file.write(bits)
            return pa.table({"n": pa.array([group.num_rows], pa.int64())})

        rows.groupBy("volume_id", "page").applyInArrow(write, "n bigint").agg(F.sum("n")).collect()

    return _once(folder, make)


def _table_layout(pages: list[int], page_size: int, cluster: int, begin: int, room: int) -> tuple[dict[int, int], bytes]:
    """The position of each page in the image and the run list of the table, which is no longer than ``room``.

    Extents lie in falling order with a gap between them, and pages without records are holes.  An extent
    is one page; where the list would be too long it is more of them, and where it would be even then,
    the shortest holes are filled: their pages are zeros in the image, as records that do not exist are.
    """
    pages = sorted(pages)
    holes = sorted((i for i in range(1, len(pages)) if pages[i] - pages[i - 1] > 1), key=lambda i: pages[i] - pages[i - 1])

    def laid(most: int, n_filled: int) -> tuple[dict[int, int], bytes]:
        filled, extents, of = set(holes[:n_filled]), [], []
        for i, page in enumerate(pages):
            if i and (page == pages[i - 1] + 1 or i in filled) and page < extents[-1][0] + most:
                extents[-1][1] = page + 1
            else:
                extents.append([page, page + 1])
            of.append(len(extents) - 1)
        sizes = [(end - first) * page_size for first, end in extents]
        after = [x + cluster for x in reversed(sizes[1:])]
        places = list(accumulate(after, initial=begin))[::-1]
        runs, following, where = [], 0, 0
        for (first, end), size, place in zip(extents, sizes, places):
            if first > following:
                runs.append((None, (first - following) * page_size // cluster))
            runs.append((place // cluster - where, size // cluster))
            where, following = place // cluster, end
        return {page: places[k] + (page - extents[k][0]) * page_size for page, k in zip(pages, of)}, run_list(runs)

    whole = pages[-1] + 1
    most = next((1 << k for k in range(whole.bit_length()) if len(laid(1 << k, 0)[1]) <= room), whole)
    at, runs = laid(most, bisect_left(range(len(holes)), True, key=lambda n: len(laid(most, n)[1]) <= room))
    if len(runs) > room:
        raise ValueError(f"a run list of {len(runs)} bytes does not fit into {room}")
    return at, runs


def _name_attributes(named: list | None) -> list[bytes]:
    return [attribute(layout.FILE_NAME, name_value(n["parent"], n["name"], n["namespace"], n["attributes"], n["size"]), n["attr_id"]) for n in named or []]


def _raws(group: pa.Table, record_size: int, data: bytes, bitmap: bytes) -> Iterator[bytes]:
    """The records of rows of ``_named_records``; record 0 describes the table itself."""
    created, modified, accessed = (_ticks(group[t]) for t in ("created", "modified", "accessed"))
    for i, (number, sequence, flags, base, named) in enumerate(zip(*(group[c].to_pylist() for c in ("record_number", "sequence", "flags", "base_reference", "names")))):
        parts = [attribute(layout.STANDARD_INFORMATION, standard_information(created[i], modified[i], accessed[i])), *_name_attributes(named)]
        if number == 0:
            parts += [data, bitmap]
        elif named:
            size = max(n["size"] for n in named)
            parts.append(stream_attribute(layout.DATA, size, run_list([(1000 + i, -(-size // 4096))] if size else [])))
        raw = record(sequence, flags, parts, base or 0, record_size)
        if len(raw) > record_size:
            raise ValueError(f"record {number} does not fit into {record_size} bytes")
        yield raw


def listed_name_images(spark, sf_dir: str) -> DataFrame:
    """(image, record_number, raw, allocated): all names of a record in extension records, one in each, told by its attribute list."""
    rows = _named_records(spark, sf_dir).where("names IS NOT NULL").select("volume_id", "record_number", "names")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images, numbers, raws = [], [], []
            for volume, number, named in zip(*(batch[c].to_pylist() for c in ("volume_id", "record_number", "names"))):
                others = [(1 << 40) + number * 4096 + n["attr_id"] for n in named]
                images += [str(volume)] * (1 + len(named))
                numbers += [number, *others]
                raws.append(record(1, 1, [attribute(layout.ATTRIBUTE_LIST, list_value([(layout.FILE_NAME, o) for o in others]))]))
                raws += [record(1, 1, [attribute(layout.FILE_NAME, name_value(n["parent"], n["name"], n["namespace"], n["attributes"], n["size"]), n["attr_id"])], number) for n in named]
            yield pa.RecordBatch.from_arrays([pa.array(images, pa.string()), pa.array(numbers, pa.int64()), pa.array(raws, pa.binary()), pa.array([True] * len(raws))], ["image", "record_number", "raw", "allocated"])

    return _spread(rows).mapInArrow(build, "image string, record_number bigint, raw binary, allocated boolean")


def chain_images(spark, sf_dir: str, length: int) -> DataFrame:
    """(image, record_number, raw, allocated): for each volume a chain of directories d24, d25, ... below the root, and a circle of two."""
    volumes = spark.read.parquet(f"{sf_dir}/volumes.parquet").select("volume_id")
    rows = volumes.select("volume_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(length + 2).cast("bigint"))).alias("n"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, raws = [], []
            for n in batch["n"].to_pylist():
                number, parent, name = 23 + n, 22 + n, f"d{23 + n}"
                if n == 0:
                    number, parent, name = layout.ROOT_RECORD, layout.ROOT_RECORD, "."
                elif n == 1:
                    parent = layout.ROOT_RECORD
                elif n > length:  # the last two name each other
                    parent = 23 + (2 * length + 3 - n)
                numbers.append(number)
                raws.append(record(1, 3, [attribute(layout.FILE_NAME, name_value(parent, name, layout.POSIX))]))
            yield pa.RecordBatch.from_arrays([batch["volume_id"].cast(pa.string()), pa.array(numbers, pa.int64()), pa.array(raws, pa.binary()), pa.array([True] * len(raws))], ["image", "record_number", "raw", "allocated"])

    return rows.mapInArrow(build, "image string, record_number bigint, raw binary, allocated boolean")


def document_image_file(spark, sf_dir: str, most_resident: int = 512) -> str:
    """The path of an image with a record per document, ``doc_id`` beyond the fixed records: the text as its data.

    Texts of up to ``most_resident`` bytes are in the record; a longer one lies in two runs, the later part
    first, with a hole of one cluster between them where a cluster of it is zeros.
    """
    folder = input_folder(spark, sf_dir, "documents")
    cluster, size = 512, 1024

    def make() -> None:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
        n = (docs.agg(F.max("doc_id")).first()[0] or 0) + layout.FIRST_NORMAL_RECORD + 1
        table = -(-n * size // cluster)
        sized = docs.withColumn("clusters", F.when(F.length("data") > most_resident, F.ceil(F.length("data") / cluster)).otherwise(0).cast("bigint")).withColumn("all", F.lit(0))
        placed = before(sized, ["all"], "doc_id", "clusters", "at", "document-clusters")
        total = sized.agg(F.sum("clusters")).first()[0] or 0
        bitmap = 8 + table
        begin = bitmap + -(-n // 8 // cluster) + 1
        with open(f"{folder}/documents.img", "wb") as file:
            file.truncate((begin + total + 1) * cluster)
            file.write(boot_sector(cluster, 1, begin + total + 1, 8, -10))
            file.seek(8 * cluster)
            own = [stream_attribute(layout.DATA, n * size, run_list([(8, table)])), stream_attribute(layout.BITMAP, -(-n // 8), run_list([(bitmap, -(-n // 8 // cluster) + 1)]))]
            file.write(record(1, 1, own))
            file.seek(bitmap * cluster)
            file.write(b"\xff" * -(-n // 8))

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with open(f"{folder}/documents.img", "r+b") as file:
                for batch in batches:
                    for doc, data, clusters, at in zip(*(batch[c].to_pylist() for c in ("doc_id", "data", "clusters", "at"))):
                        first = clusters // 2
                        if not clusters:
                            part = attribute(layout.DATA, data)
                        else:  # the second half lies before the first
                            lcn = begin + at
                            part = stream_attribute(layout.DATA, len(data), run_list([(lcn + clusters - first, first), (first - clusters, clusters - first)]))
                            file.seek(lcn * cluster)
                            file.write(data[first * cluster :].ljust((clusters - first) * cluster, b"x") + data[: first * cluster])
                        file.seek(8 * cluster + (doc + layout.FIRST_NORMAL_RECORD) * size)
                        file.write(record(1, 1, [part]))
                    yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

        placed.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()

    return _once(folder, make) + "/documents.img"


def document_images(spark, sf_dir: str, most_resident: int = 512) -> DataFrame:
    """A record per document: the text as its data, resident up to ``most_resident`` bytes.

    Longer texts are only described: a fragmented run list with a hole.  Titles are a second, named
    data stream.
    """
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "title")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = []
            for doc, text, title in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "title"))):
                data = (text or "").encode()
                if len(data) <= most_resident:
                    parts = [attribute(layout.DATA, data)]
                else:
                    clusters = -(-len(data) // 4096)
                    parts = [stream_attribute(layout.DATA, len(data), run_list([(doc + 1000, clusters), (None, 2), (-500, 1)]))]
                if title is not None:
                    parts.append(attribute(layout.DATA, title.encode(), stream="title"))
                raws.append(record(1, 1, parts))
            yield pa.RecordBatch.from_arrays([pa.array(["documents"] * len(raws)), batch["doc_id"], pa.array(raws, pa.binary()), pa.array([True] * len(raws))], ["image", "record_number", "raw", "allocated"])

    return _spread(rows).mapInArrow(build, "image string, record_number bigint, raw binary, allocated boolean")


def usn_buffers(rows: DataFrame, per_buffer: int = 256) -> DataFrame:
    """(journal, seq, buffer) of usn_record rows; a version other than 2 and 3 is written as it is.

    Buffers are filled from what a task has at hand, so their order means nothing.
    """
    taken = _journal_rows(rows)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        for batch in batches:
            open_buffers: dict[str, list[tuple[int, bytes]]] = {}
            done: list[tuple[str, list[tuple[int, bytes]]]] = []
            for journal, major, usn, ticks, file_id, parent_id, reason, name in zip(*(c.to_pylist() for c in batch.columns)):
                wide = b"\0" * 8 if major == 3 else b""
                ids = [struct.pack("<q", x) + wide for x in (file_id, parent_id)]
                part = open_buffers.setdefault(journal, [])
                part.append((usn, usn_record(major, usn, ticks, *ids, reason, name)))
                if len(part) == per_buffer:
                    done.append((journal, open_buffers.pop(journal)))
            done += open_buffers.items()
            buffers = [struct.pack("<q", max(u for u, _ in part) + 1) + b"".join(r for _, r in part) for _, part in done]
            yield pa.RecordBatch.from_arrays([pa.array([j for j, _ in done], pa.string()), pa.array(np.arange(n, n + len(done)), pa.int64()), pa.array(buffers, pa.binary())], ["journal", "seq", "buffer"])
            n += len(done)

    return _spread(taken).mapInArrow(build, "journal string, seq bigint, buffer binary")


def journal_captures(spark, sf_dir: str, per_buffer: int = 256) -> str:
    """The pattern of the folders of all journals, with one file per read buffer, in the order of usn."""
    folder = input_folder(spark, sf_dir, "captures")

    def make() -> None:
        rows = _journal_rows(spark.read.parquet(f"{sf_dir}/usn_record.parquet")).withColumn("one", F.lit(1).cast("bigint"))
        ordered = rows.withColumn("place", F.struct("usn", F.monotonically_increasing_id().alias("row")))
        numbered = before(ordered, ["journal"], "place", "one", "nth", "capture-rows").drop("place")

        def write(key: tuple, group: pa.Table) -> pa.Table:
            os.makedirs(f"{folder}/{key[0].as_py()}", exist_ok=True)
            path = f"{folder}/{key[0].as_py()}/{key[1].as_py()}.usn"
            with open(f"{path}.tmp", "wb") as file:
                file.write(struct.pack("<q", max(group["usn"].to_pylist()) + 1) + b"".join(_encoded(group.sort_by("nth"))))
            os.replace(f"{path}.tmp", path)
            return pa.table({"n": pa.array([group.num_rows], pa.int64())})

        numbered.groupBy("journal", F.floor(F.col("nth") / per_buffer).alias("seq")).applyInArrow(write, "n bigint").agg(F.sum("n")).collect()

    return _once(folder, make) + "/*[0-9]"


def _journal_rows(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("journal_id").cast("string").alias("journal"), "major", "usn", "ticks", F.coalesce("file_id", F.lit(0)).alias("file_id"), F.coalesce("parent_id", F.lit(0)).alias("parent_id"), "reason", F.coalesce("name", F.lit("")).alias("name"))


def _encoded(group: pa.Table) -> Iterator[bytes]:
    for major, usn, ticks, file_id, parent_id, reason, name in zip(*(group[c].to_pylist() for c in ("major", "usn", "ticks", "file_id", "parent_id", "reason", "name"))):
        wide = b"\0" * 8 if major == 3 else b""
        yield usn_record(major, usn, ticks, struct.pack("<q", file_id) + wide, struct.pack("<q", parent_id) + wide, reason, name)


def batch_buffers(spark, sf_dir: str) -> DataFrame:
    """(journal, seq, buffer) of the lines of usn_batch: buffers without records, with the next offset only."""
    lines = spark.read.parquet(f"{sf_dir}/usn_batch.parquet").where("next_usn IS NOT NULL").select(F.col("journal_id").cast("string").alias("journal"), F.col("log_no").alias("seq"), "next_usn").distinct()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buffers = [struct.pack("<q", n) for n in batch["next_usn"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["journal"], batch["seq"], pa.array(buffers, pa.binary())], ["journal", "seq", "buffer"])

    return lines.mapInArrow(build, "journal string, seq bigint, buffer binary")
