"""Journal read buffers: 8 bytes with the next offset, then records of versions 2 and 3.

A buffer is what one read of a journal returned.  Records of other versions are skipped, but the
offset advances over them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import layout
from siltstone.functions.arrow_types import arrow_type
from siltstone.functions.columns import has_reason
from siltstone.operators.prefix import before
from siltstone.sources.records import utf16

FILE_ID = "struct<kind:string,id:binary>"
DECODED = f"journal string, seq bigint, next_usn bigint, major int, usn bigint, ticks bigint, file_id {FILE_ID}, parent_id {FILE_ID}, reason bigint, source_info bigint, security_id bigint, file_attributes bigint, name string"
_HEAD = np.dtype([("length", "<u4"), ("major", "<u2"), ("minor", "<u2")])
_COMMON = _HEAD.itemsize
_NUMBERS = ("usn", "ticks", "reason", "source_info", "security_id", "file_attributes", "name_length")


def _walk(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, position, major version) of the records of all buffers, which take their k-th step together.

    The walk of a buffer ends at a length of 0 or beyond its end.
    """
    at = starts + 8
    live, buffers, places, majors = np.flatnonzero(ends - at >= _COMMON), [], [], []
    while len(live):
        head = np.ascontiguousarray(data[at[live][:, None] + np.arange(_COMMON)]).view(_HEAD)[:, 0]
        length = head["length"].astype(np.int64)
        good = (length != 0) & (length <= ends[live] - at[live])
        live, length = live[good], length[good]
        buffers.append(live)
        places.append(at[live])
        majors.append(head["major"][good].astype(np.int64))
        at[live] += length
        live = live[ends[live] - at[live] >= _COMMON]
    if not buffers:
        return (np.empty(0, np.int64),) * 3
    buffer, place, major = (np.concatenate(x) for x in (buffers, places, majors))
    order = np.argsort(place, kind="stable")
    return buffer[order], place[order], major[order]


def _names(whole: bytes, begin: np.ndarray, size: np.ndarray) -> list[str]:
    """The UTF-16 names at byte positions of ``whole``: decoded in one go, with a unit 0 between them."""
    parts = [whole[a:b] for a, b in zip(begin.tolist(), (begin + size // 2 * 2).tolist())]
    texts = utf16(b"\0\0".join(parts)).split("\0") if parts else []
    # A name that holds a unit 0 itself would count twice.
    return texts if len(texts) == len(parts) else [utf16(p) for p in parts]


def _decode(journals: list, seqs: list, buffers: list[bytes | None]) -> pa.RecordBatch:
    whole = b"".join(b or b"" for b in buffers)
    data = np.frombuffer(whole + b"\0" * layout.USN_V3.itemsize, np.uint8)
    sizes = np.array([len(b or b"") for b in buffers], np.int64)
    starts = np.cumsum(sizes) - sizes
    first = np.ascontiguousarray(data[np.where(sizes >= 8, starts, 0)[:, None] + np.arange(8)]).view("<i8")[:, 0]
    next_usn = np.where(sizes >= 8, first, 0)
    owner, at, major = _walk(data, starts, starts + sizes)
    known = (major == 2) | (major == 3)
    owner, at, major = owner[known], at[known], major[known]
    wide = major == 3
    numbers = {f: np.zeros(len(at), np.int64) for f in _NUMBERS}
    ids = {f: np.zeros((len(at), 16), np.uint8) for f in ("file_id", "parent_id")}
    for kind, of in ((layout.USN_V2, ~wide), (layout.USN_V3, wide)):
        head = np.ascontiguousarray(data[at[of][:, None] + np.arange(kind.itemsize)]).view(kind)[:, 0]
        for f in _NUMBERS:
            numbers[f][of] = head[f]
        for f, out in ids.items():
            raw = np.ascontiguousarray(head[f])
            out[of, : raw.dtype.itemsize] = raw.view(np.uint8).reshape(len(raw), raw.dtype.itemsize)
    length = np.where(wide, 16, 8)
    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    filled = np.arange(16) < length[:, None]
    kinds = pa.DictionaryArray.from_arrays(pa.array(wide.astype(np.int8)), pa.array(["normal", "extended"])).cast(pa.string())
    columns = {f: pa.array(x) for f, x in numbers.items()}
    for f, raw in ids.items():
        value = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw[filled].tobytes())])
        columns[f] = pa.StructArray.from_arrays([kinds, value], fields=list(arrow_type(FILE_ID)))
    columns["major"] = pa.array(major.astype(np.int32))
    columns["name"] = pa.array(_names(whole, at + np.where(wide, layout.USN_V3.itemsize, layout.USN_V2.itemsize), numbers["name_length"]), pa.string())
    taken = pa.array(owner)
    columns |= {"journal": pa.array(journals, pa.string()).take(taken), "seq": pa.array(seqs, pa.int64()).take(taken), "next_usn": pa.array(next_usn).take(taken)}
    order = [part.split()[0] for part in DECODED.split(", ")]
    return pa.RecordBatch.from_arrays([columns[f] for f in order], order)


def decode_buffers(buffers: DataFrame) -> DataFrame:
    """The records of (journal STRING, seq BIGINT, buffer BINARY); a null or short buffer has none."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield _decode(part["journal"].to_pylist(), part["seq"].to_pylist(), part["buffer"].to_pylist())

    return buffers.select("journal", "seq", "buffer").mapInArrow(decode, DECODED)


def buffer_offset(buffer: Column) -> Column:
    """The next offset in the first 8 bytes of a buffer, 0 where it is shorter."""
    turned = F.concat(*[F.hex(F.substring(buffer, n, 1)) for n in range(8, 0, -1)])
    high, low = F.conv(F.substring(turned, 1, 8), 16, 10).cast("bigint"), F.conv(F.substring(turned, 9, 8), 16, 10).cast("bigint")
    return F.when(F.length(buffer) >= 8, F.shiftleft(high, 32).bitwiseOR(low)).otherwise(F.lit(0).cast("bigint"))


def accepted_buffers(buffers: DataFrame, start: Column | int = 0) -> DataFrame:
    """The buffers that a reader starting at ``start`` takes, with the column ``next_usn``.

    A buffer whose next offset is 0 or lies before the cursor is taken as empty and leaves the cursor
    where it is; the cursor is thus the highest next offset so far.  The highest is found from the
    offsets alone, over range partitions of a journal; the buffers themselves are only joined with what
    is refused, of which there is little.  A buffer is told by its journal and number.
    """
    start = F.lit(start) if isinstance(start, int) else start
    seen = buffers.withColumn("next_usn", buffer_offset(F.col("buffer")))
    heads = before(seen.select("journal", "seq", "next_usn", start.cast("bigint").alias("start")), ["journal"], "seq", "next_usn", "highest", "cursor", "max")
    refused = heads.where((F.col("next_usn") == 0) | (F.col("next_usn") < F.greatest("highest", "start")))
    return seen.join(refused.select("journal", "seq"), ["journal", "seq"], "left_anti").select(*seen.columns)


def read_records(buffers: DataFrame, reason_mask: int = 0xFFFFFFFF, start: str | int = "first") -> DataFrame:
    """The records of a journal: ``start`` is 'first', 'next' (nothing of what is there) or an offset."""
    if start == "next":
        return decode_buffers(buffers.limit(0))
    return filtered(decode_buffers(accepted_buffers(buffers, 0 if start == "first" else int(start))), reason_mask, start)


def filtered(records: DataFrame, reason_mask: int = 0xFFFFFFFF, start: str | int = "first") -> DataFrame:
    """The records with a reason in the mask, from an offset on."""
    if start not in ("first", "next"):
        records = records.where(F.col("usn") >= int(start))
    return records.where(has_reason(F.col("reason"), reason_mask))
