"""Volume images: aligned reads, geometry and the bootstrap of the master file table.

An image is an ordinary file, so no privilege is needed and no device is opened.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np

from siltstone.errors import SiltstoneError
from siltstone.functions import layout
from siltstone.sources import records
from siltstone.sources.storage import open_file

ALIGNMENT = 4096
#: The most bytes that are read into memory at once.
LARGEST = 1 << 31


def check_alignment(alignment: int) -> int:
    if alignment <= 0 or alignment & (alignment - 1):
        raise SiltstoneError("INVALID_OPTION", details=f"alignment {alignment} is no power of two")
    return alignment


def round_down(position: int, alignment: int) -> int:
    return position & ~(alignment - 1)


def round_up(position: int, alignment: int) -> int:
    return round_down(position + alignment - 1, alignment)


def read_exactly(file: BinaryIO, position: int, size: int, alignment: int = ALIGNMENT) -> bytes:
    """``size`` bytes at ``position``, read as whole aligned blocks; less in the file is an error."""
    if position < 0:
        raise SiltstoneError("IO", details="invalid position")
    start = round_down(position, check_alignment(alignment))
    file.seek(start)
    block = file.read(round_up(position + size, alignment) - start)
    out = block[position - start : position - start + size]
    if len(out) < size:
        raise SiltstoneError("IO", details=f"unexpected end of file at byte {start + len(block)}")
    return out


@dataclass(frozen=True)
class Geometry:
    path: str
    cluster_size: int
    volume_size: int
    record_size: int
    mft_position: int


def geometry(path: str, sector: bytes) -> Geometry:
    """Sizes and positions from a boot sector; a record size that cannot hold a header is refused."""
    if len(sector) < layout.BOOT_SECTOR.itemsize:
        raise SiltstoneError("IO", details="unexpected end of the boot sector")
    boot = np.frombuffer(sector, layout.BOOT_SECTOR, 1)[0]
    cluster = int(boot["sectors_per_cluster"]) * int(boot["sector_size"])
    info = int(boot["file_record_size_info"])
    record = info * cluster if info > 0 else 1 << -info
    if info == 0 or record < layout.RECORD_HEADER.itemsize or cluster == 0:
        raise SiltstoneError("INVALID_GEOMETRY", details=f"record size {record}, cluster size {cluster}")
    return Geometry(path, cluster, int(boot["total_sectors"]) * int(boot["sector_size"]), record, int(boot["mft_lcn"]) * cluster)


#: An extent of a stream: (position in the stream, position in the image or None for a hole, length).
Extent = tuple[int, int | None, int]


class Bootstrap:
    """What must be known before the table can be read in parallel: sizes and extents of $DATA and $BITMAP."""

    def __init__(self, path: str, opener: Callable[[], BinaryIO] | None = None):
        self.open = opener or (lambda: open_file(path))
        with self.open() as file:
            self.geometry = geometry(path, read_exactly(file, 0, layout.BOOT_SECTOR.itemsize))
            first = self._record(file, self.geometry.mft_position)
            self.data_size, self.extents = self._stream(file, first, layout.DATA, "Data")
            self.bitmap_size, self.bitmap_extents = self._stream(file, first, layout.BITMAP, "Bitmap")
        self.n_records = self.data_size // self.geometry.record_size

    def _record(self, file: BinaryIO, position: int) -> dict:
        raw = read_exactly(file, position, self.geometry.record_size)
        table = np.frombuffer(raw, np.uint8).reshape(1, -1).copy()
        # Validity is told from the bytes as they are on disk, before the sector ends are put back.
        if not records.valid(table)[0]:
            raise SiltstoneError("INVALID_RECORD", position=position)
        if records.fix_up(table)[0]:
            raise SiltstoneError("CORRUPT_RECORD", number=0)
        return records.attributes_of(table)

    def _stream(self, file: BinaryIO, record: dict, type_id: int, name: str) -> tuple[int, list[Extent]]:
        """Size and extents of a stream of record 0, stitched from all records that hold a part of it."""
        parts = [a for a in record if a["type_id"] == type_id]
        for listing in [a for a in record if a["type_id"] == layout.ATTRIBUTE_LIST]:
            size, extents = self._extents(file, [listing])
            own = {0}
            for entry in records.list_entries(read_extents(file, extents, 0, size)):
                number = entry["reference"] & 0xFFFF_FFFF_FFFF
                if entry["type_id"] != type_id or number in own:
                    continue
                own.add(number)
                try:
                    other = self._record(file, self.geometry.mft_position + number * self.geometry.record_size)
                except SiltstoneError:
                    continue
                parts += [a for a in other if a["type_id"] == type_id]
        if not parts:
            raise SiltstoneError("MISSING_ATTRIBUTE", name=name)
        return self._extents(file, parts if parts[0]["non_resident"] else parts[:1])

    def _extents(self, file: BinaryIO, parts: list[dict]) -> tuple[int, list[Extent]]:
        if not parts[0]["non_resident"]:
            value = parts[0]["value"]
            if value is None:
                raise SiltstoneError("INVALID_DATA_RUN", details="resident attribute missing value")
            return len(value), [(0, None, len(value), value)]  # type: ignore[list-item]
        parts = sorted({a["lowest_vcn"]: a for a in reversed(parts)}.values(), key=lambda a: a["lowest_vcn"])
        size, out, at = parts[0]["data_size"] & (1 << 64) - 1, [], 0
        for part in parts:
            error, runs = records.data_runs(part["runs"], self.geometry.cluster_size, 1 if size else 0, check_total=False)
            if error:
                raise SiltstoneError("INVALID_DATA_RUN", details=error)
            for _, lcn, length in runs:
                out.append((at, lcn, length))
                at += length
        if at < size:
            raise SiltstoneError("INVALID_DATA_RUN", details="data runs shorter than declared size")
        return size, out


def read_content(file: BinaryIO, attribute: dict, cluster_size: int) -> bytes:
    """The whole value of an attribute: of a resident one its bytes, else its runs, holes as zeros, cut to its size."""
    if not attribute["non_resident"]:
        if attribute["value"] is None:
            raise SiltstoneError("INVALID_DATA_RUN", details="resident attribute missing value")
        return attribute["value"]
    size = attribute["data_size"] & (1 << 64) - 1
    error, runs = records.data_runs(attribute["runs"], cluster_size, size)
    if error:
        raise SiltstoneError("INVALID_DATA_RUN", details=error)
    extents, at = [], 0
    for _, lcn, length in runs:
        extents.append((at, lcn, length))
        at += length
    return read_extents(file, extents, 0, size)


def spans(extents: list[Extent], record_size: int, n_records: int) -> list[tuple[int, int]]:
    """(first, end) of the record numbers that do not lie in holes altogether."""
    out: list[list[int]] = []
    for extent in extents:
        if extent[1] is None and len(extent) == 3:
            continue
        first, end = extent[0] // record_size, min(-(-(extent[0] + extent[2]) // record_size), n_records)
        if out and first <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        elif first < end:
            out.append([first, end])
    return [(a, b) for a, b in out]


def read_extents(file: BinaryIO, extents: list[Extent], start: int, size: int) -> bytes:
    """Bytes start..start+size of a stream; holes are zeros."""
    if size > LARGEST:
        raise SiltstoneError("ALLOCATION_TOO_LARGE", size=size)
    out = bytearray()
    for extent in extents:
        at, position, length = extent[:3]
        low, high = max(at, start), min(at + length, start + size)
        if low >= high:
            continue
        if len(extent) == 4:  # resident: the bytes themselves
            out += extent[3][low - at : high - at]
        elif position is None:
            out += bytes(high - low)
        else:
            out += read_exactly(file, position + low - at, high - low)
    return bytes(out)
