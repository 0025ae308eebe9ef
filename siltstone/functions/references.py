"""File references: 64-bit values ``sequence << 48 | record_number``, kept bit for bit in a BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECORD_MASK = 0x0000_FFFF_FFFF_FFFF


def record_number(reference: Column) -> Column:
    """The low 48 bits."""
    return reference.bitwiseAND(F.lit(RECORD_MASK))


def sequence_number(reference: Column) -> Column:
    """The high 16 bits, unsigned."""
    return F.shiftrightunsigned(reference, 48).cast("int")


def make_reference(sequence: Column, number: Column) -> Column:
    """The reference of a sequence and a record number; a sequence of 0x8000 or more makes it negative."""
    return F.shiftleft(sequence.cast("bigint"), 48).bitwiseOR(number.bitwiseAND(F.lit(RECORD_MASK)))


def same_file_id(a: Column, b: Column) -> Column:
    """Equality of two file ids (structs of kind and id): a 64-bit id never equals a 128-bit one."""
    return (a["kind"] == b["kind"]) & (a["id"] == b["id"])
