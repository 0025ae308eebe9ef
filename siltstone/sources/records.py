"""Decoding of file records with numpy: all records of a batch at once.

A batch is a two-dimensional array of bytes, one row per record.  Only the step from bytes to typed
columns is done here; all that follows is expressed with DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.errors import SiltstoneError
from siltstone.functions import layout
from siltstone.functions.arrow_types import arrow_type

STANDARD_TYPE = "struct<creation:bigint,modification:bigint,mft_modification:bigint,access:bigint,file_attributes:bigint>"
NAME_TYPE = "struct<parent_reference:bigint,allocated_size:bigint,real_size:bigint,file_attributes:bigint,reparse_tag:bigint,namespace:int,name:string>"
ENTRY_TYPE = "struct<type_id:bigint,reference:bigint,starting_vcn:bigint,id:int>"
ATTRIBUTE_TYPE = (
    "struct<ordinal:int,type_id:bigint,length:bigint,non_resident:boolean,name_length:int,flags:int,id:int,value_length:bigint,value:binary,"
    "lowest_vcn:bigint,highest_vcn:bigint,compression_unit:int,allocated_size:bigint,data_size:bigint,initialized_size:bigint,runs:binary,"
    f"standard:{STANDARD_TYPE},name:{NAME_TYPE},entries:array<{ENTRY_TYPE}>>"
)
HEADER = "sequence int, link_count int, flags int, used_size bigint, allocated_size bigint, base_reference bigint, lsn bigint, next_attribute_id int"
DECODED = f"image string, record_number bigint, allocated boolean, corrupt boolean, is_valid boolean, {HEADER}, attributes array<{ATTRIBUTE_TYPE}>"


def _header(table: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(table[:, : layout.RECORD_HEADER.itemsize]).view(layout.RECORD_HEADER)[:, 0]


def fix_up(table: np.ndarray) -> np.ndarray:
    """Put the last two bytes of each sector back, in place; true for the rows where they do not match."""
    n, size = table.shape
    if size < layout.RECORD_HEADER.itemsize:
        return np.ones(n, bool)
    head = _header(table)
    at, words = head["usa_offset"].astype(np.int64), head["usa_length"].astype(np.int64)
    bad = (at + 2 > size) | (at + 2 * words > size)
    for sector in range(min(int(words[~bad].max(initial=0)) - 1, size // layout.SECTOR)):
        end = (sector + 1) * layout.SECTOR - 2
        rows = np.flatnonzero(~bad & (words > sector + 1))
        for byte in (0, 1):
            bad[rows] |= table[rows, end + byte] != table[rows, at[rows] + byte]
        rows = rows[~bad[rows]]
        for byte in (0, 1):
            table[rows, end + byte] = table[rows, at[rows] + 2 * (sector + 1) + byte]
    return bad


def valid(table: np.ndarray) -> np.ndarray:
    """Whether each row is a record: signature, sizes and offsets."""
    n, size = table.shape
    if size < layout.RECORD_HEADER.itemsize:
        return np.zeros(n, bool)
    head = _header(table)
    words, used = head["usa_length"].astype(np.int64), head["used_size"].astype(np.int64)
    inside = head["usa_offset"].astype(np.int64) + 2 * words <= size
    return (head["signature"] == layout.SIGNATURE) & (words != 0) & (used <= size) & inside & (words - 1 <= size // layout.SECTOR) & (head["attributes_offset"] < used)


def _gather(flat: np.ndarray, at: np.ndarray, kind: np.dtype, enough: np.ndarray) -> np.ndarray:
    """The structures of ``kind`` at the byte positions ``at``; zeros where there is not enough room."""
    where = np.where(enough, at, 0)[:, None] + np.arange(kind.itemsize)
    where[~enough] = 0
    out = np.ascontiguousarray(flat[np.minimum(where, len(flat) - 1)])
    out[~enough] = 0
    return out.view(kind)[:, 0]


def _walk(table: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, ordinal, offset) of the attributes of the rows that are ok; all rows take their k-th step together."""
    size = table.shape[1]
    head = _header(table)
    flat = table.reshape(-1)
    offset = head["attributes_offset"].astype(np.int64)
    used = np.minimum(head["used_size"].astype(np.int64), size)
    live = np.flatnonzero(ok)
    rows, ordinals, offsets = [], [], []
    step = 0
    while len(live):
        live = live[used[live] - offset[live] >= layout.ATTRIBUTE_HEADER.itemsize]
        found = _gather(flat, live * size + offset[live], layout.ATTRIBUTE_HEADER, np.ones(len(live), bool))
        length = found["length"].astype(np.int64)
        good = (length != 0) & (length <= used[live] - offset[live]) & (found["type_id"] != layout.END)
        live, length = live[good], length[good]
        rows.append(live)
        ordinals.append(np.full(len(live), step))
        offsets.append(offset[live])
        offset[live] += length
        step += 1
    if not rows:
        return (np.empty(0, np.int64),) * 3
    row, ordinal, at = (np.concatenate(x).astype(np.int64) for x in (rows, ordinals, offsets))
    order = np.lexsort((ordinal, row))
    return row[order], ordinal[order], at[order]


def list_entries(value: bytes) -> list[dict[str, int]]:
    """The entries of an attribute list; each begins at a multiple of 8."""
    out, at = [], 0
    while at + layout.LIST_ENTRY.itemsize <= len(value):
        entry = np.frombuffer(value, layout.LIST_ENTRY, 1, at)[0]
        length = int(entry["length"])
        if length < layout.LIST_ENTRY.itemsize or at + length > len(value):
            break
        out.append({"type_id": int(entry["type_id"]), "reference": _signed(int(entry["base_reference"])), "starting_vcn": _signed(int(entry["starting_vcn"])), "id": int(entry["id"])})
        at = (at + length + 7) // 8 * 8
    return out


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def utf16(data: bytes) -> str:
    """UTF-16 text; each unit that has no partner becomes U+FFFD."""
    return data.decode("utf-16-le", "replace")


def _struct(kind: str, columns: dict[str, Any], missing: np.ndarray) -> pa.StructArray:
    """A struct column of the type ``kind`` from numpy or Arrow columns; null where ``missing``."""
    fields = list(arrow_type(kind))
    arrays = []
    for f in fields:
        values = columns[f.name]
        if isinstance(values, np.ndarray):
            values = pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))
        arrays.append(values if values.type == f.type else values.cast(f.type))
    return pa.StructArray.from_arrays(arrays, fields=fields, mask=pa.array(missing))


def _attributes(table: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, pa.StructArray]:
    """(row, attribute) of all attributes of the rows that are ok, in order."""
    size = table.shape[1]
    row, ordinal, offset = _walk(table, ok)
    flat = table.reshape(-1)
    base = row * size + offset
    head = _gather(flat, base, layout.ATTRIBUTE_HEADER, np.ones(len(base), bool))
    length, kind = head["length"].astype(np.int64), head["type_id"]
    resident = head["non_resident"] == 0
    small, large = resident & (length >= layout.RESIDENT_HEADER.itemsize), ~resident & (length >= layout.NON_RESIDENT_HEADER.itemsize)
    inner = _gather(flat, base, layout.RESIDENT_HEADER, small)
    outer = _gather(flat, base, layout.NON_RESIDENT_HEADER, large)
    data = flat.tobytes()

    def slices(at: np.ndarray, end: np.ndarray, where: np.ndarray) -> list[bytes | None]:
        return [data[a:b] if w else None for a, b, w in zip(at.tolist(), end.tolist(), where.tolist())]

    value_at, value_length = base + inner["value_offset"], inner["value_length"].astype(np.int64)
    has_value = small & (inner["value_offset"] + value_length <= length)
    value = slices(value_at, value_at + value_length, has_value)
    runs_at = base + outer["runs_offset"]
    runs = slices(runs_at, base + length, large & (outer["runs_offset"] <= length))

    is_name = has_value & (kind == layout.FILE_NAME) & (value_length >= layout.NAME_HEADER.itemsize)
    names = _gather(flat, value_at, layout.NAME_HEADER, is_name)
    text_at = value_at + layout.NAME_HEADER.itemsize
    text_end = text_at + 2 * names["name_length"].astype(np.int64)
    is_name &= text_end <= value_at + value_length
    texts = pa.array([utf16(t) if t is not None else None for t in slices(text_at, text_end, is_name)], pa.string())
    is_standard = has_value & (kind == layout.STANDARD_INFORMATION) & (value_length >= layout.STANDARD.itemsize)
    standard = _gather(flat, value_at, layout.STANDARD, is_standard)
    listed = np.flatnonzero(has_value & (kind == layout.ATTRIBUTE_LIST))
    entries: list[list | None] = [None] * len(base)
    for i in listed:
        entries[i] = list_entries(value[i])

    columns: dict[str, Any] = {f: head[f] for f in ("type_id", "length", "name_length", "flags", "id")}
    columns |= {"ordinal": ordinal, "non_resident": pa.array(~resident), "value": pa.array(value, pa.binary()), "runs": pa.array(runs, pa.binary()), "value_length": pa.array(value_length, mask=~small)}
    for f in ("lowest_vcn", "highest_vcn", "compression_unit", "allocated_size", "data_size", "initialized_size"):
        columns[f] = pa.array(outer[f].view(np.int64) if outer[f].itemsize == 8 else outer[f].astype(np.int64), mask=~large)
    columns["standard"] = _struct(STANDARD_TYPE, {f: standard[f] for f in layout.STANDARD.names}, ~is_standard)
    columns["name"] = _struct(NAME_TYPE, {f: names[f] for f in layout.NAME_HEADER.names} | {"name": texts}, ~is_name)
    columns["entries"] = pa.array(entries, arrow_type(f"array<{ENTRY_TYPE}>"))
    return row, _struct(ATTRIBUTE_TYPE, columns, np.zeros(len(base), bool))


def attributes_of(table: np.ndarray) -> list[dict[str, Any]]:
    """The attributes of a single record."""
    return _attributes(table, np.ones(1, bool))[1].to_pylist()


def decode_table(image: list[str | None], numbers: np.ndarray, allocated: pa.Array, table: np.ndarray, fail_fast: bool) -> pa.RecordBatch:
    """A decoded batch; with ``fail_fast`` a record whose sectors do not match ends the job."""
    table = table.copy()
    corrupt = fix_up(table)
    if fail_fast and corrupt.any():
        raise SiltstoneError("CORRUPT_RECORD", number=int(numbers[np.flatnonzero(corrupt)[0]]))
    is_valid = valid(table) & ~corrupt
    row, attributes = _attributes(table, is_valid) if is_valid.any() else (np.empty(0, np.int64), pa.array([], arrow_type(ATTRIBUTE_TYPE)))
    # Rows without attributes have empty lists.
    offsets = np.searchsorted(row, np.arange(len(table) + 1)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), attributes)
    columns = [pa.array(image, pa.string()), pa.array(numbers, pa.int64()), allocated, pa.array(corrupt), pa.array(is_valid)]
    names = ["image", "record_number", "allocated", "corrupt", "is_valid"]
    whole = table.shape[1] >= layout.RECORD_HEADER.itemsize
    head = _header(table) if whole else np.zeros(len(table), layout.RECORD_HEADER)
    for part in HEADER.split(", "):
        name, kind = part.split()
        values = head[name]
        columns.append(pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64), pa.int64()).cast(pa.int32() if kind == "int" else pa.int64()))
        names.append(name)
    return pa.RecordBatch.from_arrays([*columns, lists], [*names, "attributes"])


def decode_records(raw: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """Decode (image STRING, record_number BIGINT, raw BINARY, allocated BOOLEAN).

    ``mode`` is FAILFAST, where one torn sector fails the job, or PERMISSIVE, where the record is
    flagged as corrupt and not valid.  A null or short ``raw`` is torn.
    """
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise SiltstoneError("INVALID_OPTION", details=f"mode {mode}")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch["raw"].to_pylist()
            sizes = np.array([len(r) if r else 0 for r in raws], np.int64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                table = np.frombuffer(b"".join(raws[i] or b"" for i in at), np.uint8).reshape(len(at), int(size))
                part = batch.select(["image", "record_number", "allocated"]).take(pa.array(at))
                yield decode_table(part["image"].to_pylist(), np.asarray(part["record_number"].fill_null(-1)), part["allocated"], table, mode == "FAILFAST")

    return raw.select("image", "record_number", "raw", "allocated").mapInArrow(decode, DECODED)


def data_runs(runs: bytes | None, cluster_size: int, data_size: int, check_total: bool = True) -> tuple[str | None, list[tuple[str, int | None, int]]]:
    """(error, runs) of a run list: each run is (kind, first byte or None, bytes), kind 'data' or 'sparse'.

    ``data_size`` is unsigned; a size of 0 has no runs.  The texts of the errors are fixed values.
    """
    if data_size == 0:
        return None, []
    if runs is None:
        return "data runs offset outside attribute", []
    out: list[tuple[str, int | None, int]] = []
    position = start = total = 0
    limit = 1 << 64
    while True:
        if position >= len(runs):
            return "unterminated data run sequence", []
        n_length, n_offset = runs[position] & 15, runs[position] >> 4
        if runs[position] == 0:
            break
        if not 1 <= n_length <= 8:
            return "invalid cluster count field", []
        if n_offset > 8:
            return "invalid cluster offset field", []
        a, b = position + 1, position + 1 + n_length
        position = b + n_offset
        if b > len(runs):
            return "unexpected end of run-length data", []
        length = int.from_bytes(runs[a:b], "little") * cluster_size
        if length == 0:
            return "cluster count is zero", []
        if length >= limit:
            return "run length overflow", []
        total += length
        if total >= limit:
            return "total run length overflow", []
        if position > len(runs):
            return "unexpected end of run-offset data", []
        if n_offset:
            start += int.from_bytes(runs[b:position], "little", signed=True) * cluster_size
            if not -(1 << 127) <= start < 1 << 127:
                return "relative offset overflow", []
            if start < 0:
                return "relative offset underflow", []
        out.append(("data", _signed(start % limit), length) if n_offset else ("sparse", None, length))
    if not out:
        return "attribute has size but no runs", []
    if check_total and total < data_size:
        return "data runs shorter than declared size", []
    return None, out


RUNS_TYPE = "array<struct<kind:string,lcn:bigint,length:bigint>>"


def run_lists(runs: pa.Array, cluster_size: np.ndarray, data_size: pa.Array, non_resident: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The errors and runs of a column of run lists; all lists take their k-th step together.

    Lists of whole and small numbers are decoded with numpy.  Those with an error, or with numbers that
    do not fit 61 bits, are left to ``data_runs``, which knows the texts and the order of the checks.
    A length of 63 bits and more stands as its bit pattern.
    """
    n = len(runs)
    sizes = np.asarray(data_size.fill_null(0)).astype(np.int64)
    outside = np.asarray(non_resident.fill_null(False)) & np.asarray(data_size.is_valid())
    value = [r if r is not None else b"" for r in runs.to_pylist()]
    lengths = np.array([len(v) for v in value], np.int64)
    base = np.cumsum(lengths) - lengths
    flat = np.frombuffer(b"".join(value) + b"\0" * 16, np.uint8)
    end = base + lengths
    plain = outside & np.asarray(runs.is_valid()) & (sizes > 0)
    at, start, total = base.copy(), np.zeros(n, np.int64), np.zeros(n, np.int64)
    live, rows, kinds, places, spans = np.flatnonzero(plain), [], [], [], []

    def number(where: np.ndarray, width: np.ndarray, signed: bool) -> np.ndarray:
        """Little-endian numbers of up to 7 bytes."""
        out = np.zeros(len(where), np.int64)
        for k in range(7):
            out |= np.where(k < width, flat[np.minimum(where + k, len(flat) - 1)].astype(np.int64) << (8 * k), 0)
        if signed:
            top = (width > 0) & (flat[np.minimum(where + np.maximum(width, 1) - 1, len(flat) - 1)] >= 128)
            out = np.where(top, out - (np.int64(1) << (8 * width)), out)
        return out

    largest = np.int64(1) << 61
    while len(live):
        inside = at[live] < end[live]
        plain[live[~inside]] = False
        live = live[inside]
        head = flat[at[live]].astype(np.int64)
        live, head = live[head != 0], head[head != 0]
        wide, far = head & 15, head >> 4
        fits = (wide >= 1) & (wide <= 7) & (far <= 7) & (at[live] + 1 + wide + far <= end[live])
        plain[live[~fits]] = False
        live, wide, far = live[fits], wide[fits], far[fits]
        cluster = cluster_size[live]
        length = number(at[live] + 1, wide, False)
        delta = number(at[live] + 1 + wide, far, True)
        room = largest // np.maximum(cluster, 1)
        fits = (cluster > 0) & (length > 0) & (length < room) & (np.abs(delta) < room)
        length, delta = length * cluster, delta * cluster
        moved = start[live] + delta
        fits &= (moved >= 0) & (moved < largest) & (total[live] + length < largest)
        plain[live[~fits]] = False
        live, length, moved, far, wide = live[fits], length[fits], moved[fits], far[fits], wide[fits]
        start[live], total[live] = moved, total[live] + length
        at[live] += 1 + wide + far
        rows.append(live)
        kinds.append(far > 0)
        places.append(moved)
        spans.append(length)
    row = np.concatenate(rows) if rows else np.empty(0, np.int64)
    order = np.argsort(row, kind="stable")
    row, kind, place, span = row[order], *(np.concatenate(x)[order] if rows else np.empty(0, np.int64) for x in (kinds, places, spans))
    plain &= (total >= sizes) & (np.bincount(row, minlength=n) > 0)
    errors: list[str | None] = [None] * n
    others: dict[int, list] = {}
    for i in np.flatnonzero(~plain):
        if not outside[i]:
            errors[i] = "attribute is resident"
        else:
            error, found = data_runs(value[i] if runs[int(i)].is_valid else None, int(cluster_size[i]), int(sizes[i]) & (1 << 64) - 1)
            errors[i], others[int(i)] = error, found
    kept = plain[row]
    row, kind, place, span = row[kept], kind[kept].astype(bool), place[kept], span[kept]
    if any(others.values()):  # put the few lists that were decoded one by one in their place
        extra = [(i, k == "data", p or 0, _signed(s)) for i, found in others.items() if errors[i] is None for k, p, s in found]
        if extra:
            more = [np.array(x, np.int64) for x in zip(*extra)]
            more[1] = more[1].astype(bool)
            row, kind, place, span = np.concatenate([row, more[0]]), np.concatenate([kind, more[1]]), np.concatenate([place, more[2]]), np.concatenate([span, more[3]])
            order = np.argsort(row, kind="stable")
            row, kind, place, span = row[order], kind[order], place[order], span[order]
    names = pa.array(np.where(kind, "data", "sparse"), pa.string()) if len(row) else pa.array([], pa.string())
    struct = pa.StructArray.from_arrays([names, pa.array(place.astype(np.int64), mask=~kind), pa.array(span.astype(np.int64))], fields=list(arrow_type(RUNS_TYPE).value_type))
    offsets = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    failed = np.array([e is not None for e in errors], bool)
    lists = pa.ListArray.from_arrays(pa.array(offsets), struct, mask=pa.array(failed)) if n else pa.array([], arrow_type(RUNS_TYPE))
    return pa.array(errors, pa.string()), lists
