"""Byte layouts and constants of the on-disk structures; all integers are little-endian.

The values here are fixed by the formats.
"""

from __future__ import annotations

import numpy as np

SECTOR = 512
ROOT_RECORD = 5
FIRST_NORMAL_RECORD = 24
SIGNATURE = b"FILE"
#: Ticks of 100 ns from 1601 to 1970.
EPOCH_TICKS = 116_444_736_000_000_000

RECORD_IN_USE = 1
RECORD_DIRECTORY = 2

POSIX, WIN32, DOS, WIN32_AND_DOS = 0, 1, 2, 3

STANDARD_INFORMATION = 0x10
ATTRIBUTE_LIST = 0x20
FILE_NAME = 0x30
DATA = 0x80
BITMAP = 0xB0
END = 0xFFFFFFFF

#: Flags of a name's file attributes.
READ_ONLY, HIDDEN, SYSTEM, REPARSE_POINT = 0x1, 0x2, 0x4, 0x400


def _packed(size: int, **fields: tuple[str, int]) -> np.dtype:
    return np.dtype({"names": [*fields], "formats": [f for f, _ in fields.values()], "offsets": [o for _, o in fields.values()], "itemsize": size})


BOOT_SECTOR = _packed(512, sector_size=("<u2", 11), sectors_per_cluster=("u1", 13), total_sectors=("<u8", 40), mft_lcn=("<u8", 48), mft_lcn_mirror=("<u8", 56), file_record_size_info=("i1", 64))
RECORD_HEADER = _packed(
    42, signature=("S4", 0), usa_offset=("<u2", 4), usa_length=("<u2", 6), lsn=("<u8", 8), sequence=("<u2", 16), link_count=("<u2", 18), attributes_offset=("<u2", 20),
    flags=("<u2", 22), used_size=("<u4", 24), allocated_size=("<u4", 28), base_reference=("<u8", 32), next_attribute_id=("<u2", 40),
)
ATTRIBUTE_HEADER = _packed(16, type_id=("<u4", 0), length=("<u4", 4), non_resident=("u1", 8), name_length=("u1", 9), name_offset=("<u2", 10), flags=("<u2", 12), id=("<u2", 14))
RESIDENT_HEADER = _packed(23, value_length=("<u4", 16), value_offset=("<u2", 20), indexed=("u1", 22))
NON_RESIDENT_HEADER = _packed(
    64, lowest_vcn=("<i8", 16), highest_vcn=("<i8", 24), runs_offset=("<u2", 32), compression_unit=("u1", 34), allocated_size=("<u8", 40), data_size=("<u8", 48), initialized_size=("<u8", 56)
)
STANDARD = _packed(36, creation=("<u8", 0), modification=("<u8", 8), mft_modification=("<u8", 16), access=("<u8", 24), file_attributes=("<u4", 32))
NAME_HEADER = _packed(66, parent_reference=("<u8", 0), allocated_size=("<u8", 40), real_size=("<u8", 48), file_attributes=("<u4", 56), reparse_tag=("<u4", 60), name_length=("u1", 64), namespace=("u1", 65))
LIST_ENTRY = _packed(26, type_id=("<u4", 0), length=("<u2", 4), name_length=("u1", 6), name_offset=("u1", 7), starting_vcn=("<u8", 8), base_reference=("<u8", 16), id=("<u2", 24))
USN_V2 = _packed(
    60, length=("<u4", 0), major=("<u2", 4), minor=("<u2", 6), file_id=("V8", 8), parent_id=("V8", 16), usn=("<i8", 24), ticks=("<i8", 32), reason=("<u4", 40),
    source_info=("<u4", 44), security_id=("<u4", 48), file_attributes=("<u4", 52), name_length=("<u2", 56), name_offset=("<u2", 58),
)
USN_V3 = _packed(
    76, length=("<u4", 0), major=("<u2", 4), minor=("<u2", 6), file_id=("V16", 8), parent_id=("V16", 24), usn=("<i8", 40), ticks=("<i8", 48), reason=("<u4", 56),
    source_info=("<u4", 60), security_id=("<u4", 64), file_attributes=("<u4", 68), name_length=("<u2", 72), name_offset=("<u2", 74),
)

#: Reason bits in the order in which they are written as text.
REASONS = (
    ("USN_REASON_BASIC_INFO_CHANGE", 0x8000),
    ("USN_REASON_CLOSE", 0x80000000),
    ("USN_REASON_COMPRESSION_CHANGE", 0x20000),
    ("USN_REASON_DATA_EXTEND", 0x2),
    ("USN_REASON_DATA_OVERWRITE", 0x1),
    ("USN_REASON_DATA_TRUNCATION", 0x4),
    ("USN_REASON_DESIRED_STORAGE_CLASS_CHANGE", 0x1000000),
    ("USN_REASON_EA_CHANGE", 0x400),
    ("USN_REASON_ENCRYPTION_CHANGE", 0x40000),
    ("USN_REASON_FILE_CREATE", 0x100),
    ("USN_REASON_FILE_DELETE", 0x200),
    ("USN_REASON_HARD_LINK_CHANGE", 0x10000),
    ("USN_REASON_INDEXABLE_CHANGE", 0x4000),
    ("USN_REASON_INTEGRITY_CHANGE", 0x800000),
    ("USN_REASON_NAMED_DATA_EXTEND", 0x20),
    ("USN_REASON_NAMED_DATA_OVERWRITE", 0x10),
    ("USN_REASON_NAMED_DATA_TRUNCATION", 0x40),
    ("USN_REASON_OBJECT_ID_CHANGE", 0x80000),
    ("USN_REASON_RENAME_NEW_NAME", 0x2000),
    ("USN_REASON_RENAME_OLD_NAME", 0x1000),
    ("USN_REASON_REPARSE_POINT_CHANGE", 0x100000),
    ("USN_REASON_SECURITY_CHANGE", 0x800),
    ("USN_REASON_STREAM_CHANGE", 0x200000),
    ("USN_REASON_TRANSACTED_CHANGE", 0x400000),
)
REASON = {name.removeprefix("USN_REASON_"): bit for name, bit in REASONS}
