"""Scalar functions over decoded columns, all of them built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import layout

#: Ticks since 1970 of the last instant of the year 9999; later times count as unset.
LAST_TICKS = 253_402_300_799 * 10_000_000 + 9_999_999
#: The most ticks whose nanoseconds fit an unsigned 64-bit number.
MOST_TICKS = 184_467_440_737_095_516


def unix_ticks(filetime: Column) -> Column:
    """Ticks since 1970 of a time since 1601: 0 before 1970 and past the year 9999 (top bit included)."""
    since = filetime - F.lit(layout.EPOCH_TICKS)
    return F.when(filetime < layout.EPOCH_TICKS, F.lit(0)).when(since > LAST_TICKS, F.lit(0)).otherwise(since).cast("bigint")


def utc_of_ticks(ticks: Column) -> Column:
    """The UTC time, without zone and whatever the session's is, of non-negative ticks since 1970."""
    seconds = ((ticks - ticks % 10).cast("decimal(20,0)") / F.lit(10_000_000)).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def filetime_to_timestamp(filetime: Column) -> Column:
    """The same as a TIMESTAMP_NTZ in UTC, which has microseconds."""
    return utc_of_ticks(unix_ticks(filetime))


def journal_ticks(ticks: Column) -> Column:
    """A journal time since 1601: not before 0, not beyond what an unsigned 64-bit number of nanoseconds holds."""
    return F.least(F.greatest(ticks, F.lit(0).cast("bigint")), F.lit(MOST_TICKS))


def reason_text(reason: Column) -> Column:
    """The names of the set bits, each followed by a blank; unknown bits are left out, '' for none."""
    return F.concat(*[F.when(reason.bitwiseAND(F.lit(bit)) != 0, F.lit(f"{name} ")).otherwise(F.lit("")) for name, bit in layout.REASONS])


def has_reason(reason: Column, mask: int) -> Column:
    return reason.bitwiseAND(F.lit(mask)) != 0


def flag(attributes: Column, bit: int) -> Column:
    """Whether a name's file attributes have a bit: READ_ONLY, HIDDEN, SYSTEM, REPARSE_POINT and others."""
    return attributes.bitwiseAND(F.lit(bit)) != 0


def in_use(flags: Column) -> Column:
    return flags.bitwiseAND(layout.RECORD_IN_USE) != 0


def is_directory(flags: Column) -> Column:
    return flags.bitwiseAND(layout.RECORD_DIRECTORY) != 0


def unsigned(bits: Column) -> Column:
    """The unsigned value of a 64-bit pattern kept in a BIGINT, as DECIMAL(20, 0)."""
    exact = bits.cast("decimal(20,0)")
    return F.when(bits < 0, exact + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(exact).cast("decimal(20,0)")


def join_path(*parts: Column) -> Column:
    """Path parts joined by a backslash; one at the beginning of a later part is dropped."""
    first, rest = parts[0], [F.regexp_replace(p, r"^\\", "") for p in parts[1:]]
    return F.concat_ws("\\", first, *rest)


def bit_set(bitmap: Column, number: Column) -> Column:
    """Bit ``number`` of a BINARY, lowest bit of each byte first; false beyond its end or below 0."""
    byte = F.floor(number / 8).cast("int")
    inside = (number >= 0) & (byte < F.length(bitmap))
    value = F.conv(F.hex(F.substring(bitmap, byte + 1, F.lit(1))), 16, 10).cast("int")
    return F.when(inside, F.shiftright(value, 0).bitwiseAND(F.pow(F.lit(2), number % 8).cast("int")) != 0).otherwise(F.lit(False))
