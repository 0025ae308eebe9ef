"""Operators over journal records: paths of events and the old name of a renamed file.

A record has ``journal``, ``seq`` (the read buffer it came in), ``usn``, ``file_id``, ``parent_id``,
``reason`` and ``name`` or ``path``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.columns import has_reason, join_path
from siltstone.functions.layout import REASON
from siltstone.operators.prefix import before
from siltstone.operators.skew import spread_join
from siltstone.session import written

#: Records with one of these are remembered as history, renames or not.
HISTORY = REASON["RENAME_OLD_NAME"] | REASON["HARD_LINK_CHANGE"] | REASON["REPARSE_POINT_CHANGE"]
NEW_NAME = REASON["RENAME_NEW_NAME"]


def reference_of(file_id: Column) -> Column:
    """A file id as the 64-bit reference; null for a 128-bit id whose upper half is not 0."""
    byte = [F.hex(F.substring(file_id["id"], n, 1)) for n in range(8, 0, -1)]
    high, low = F.conv(F.concat(*byte[:4]), 16, 10).cast("bigint"), F.conv(F.concat(*byte[4:]), 16, 10).cast("bigint")
    short = (F.length(file_id["id"]) == 8) | (F.hex(F.substring(file_id["id"], 9, 8)) == "0" * 16)
    return F.when(short, F.shiftleft(high, 32).bitwiseOR(low))


def with_paths(records: DataFrame, paths: DataFrame) -> DataFrame:
    """Add ``path``: that of the parent and the name, else that of the file, else the bare name.

    ``paths`` has (journal, reference, path) as of a snapshot, one row per reference; an empty path
    counts as none.  Paths are joined by key, so that they may be larger than memory.  Where they are too
    many to be sent to every task, the records are counted by key first, and those of a directory or file
    with a large part of all are spread over many tasks.
    """
    known = written(paths.where("path <> ''").select("journal", F.col("reference").alias("r"), F.col("path").alias("p")), "journal-paths")
    found = records.withColumn("_own_ref", reference_of(F.col("file_id"))).withColumn("_parent_ref", reference_of(F.col("parent_id")))
    for key, column in (("_parent_ref", "_parent_path"), ("_own_ref", "_own_path")):
        found = spread_join(found, known.select("journal", F.col("r").alias(key), F.col("p").alias(column)), ["journal", key], "left", F.col("usn"))
    path = F.coalesce(F.when(F.col("_parent_path").isNotNull(), join_path(F.col("_parent_path"), F.col("name"))), F.col("_own_path"), F.col("name"))
    return found.withColumn("path", path).select(*records.columns, "path")


def match_renames(records: DataFrame, trim: int | None = None) -> DataFrame:
    """(journal, usn, file_id, path, renamed_from) of the records with a new name, history unlimited.

    The oldest history entry of the same file before the record counts; entries up to ``trim`` are
    forgotten.  If the oldest entry of all is not before the record, none is, so one aggregate per
    file and one join give the match, without sorting the records of a file.
    """
    history = records.where(has_reason(F.col("reason"), HISTORY))
    if trim is not None:
        history = history.where(F.col("usn") > trim)
    oldest = history.groupBy("journal", "file_id").agg(F.min("usn").alias("first_usn"), F.min_by("path", F.struct("usn", "path")).alias("first_path"))
    probes = records.where(has_reason(F.col("reason"), NEW_NAME)).select("journal", "usn", "file_id", "path")
    matched = probes.join(oldest, ["journal", "file_id"], "left")
    return matched.select("journal", "usn", "file_id", "path", F.when(F.col("first_usn") < F.col("usn"), F.col("first_path")).alias("renamed_from"))


def match_renames_limited(records: DataFrame, most: int, trim: int | None = None) -> DataFrame:
    """The same where only the last ``most`` history entries of a journal are kept; 0 keeps all.

    An entry is visible to a record if fewer than ``most`` entries came after it up to the end of the
    record's read buffer (all of a buffer is remembered before its records are looked at).  Entries
    are numbered in order of buffer and usn; the numbers are cut into ranges of ``most``, so that a
    record meets the entries of its file in two ranges only.
    """
    if most == 0:
        return match_renames(records, trim)
    counts = records.groupBy("journal", "seq").agg(F.count(F.when(has_reason(F.col("reason"), HISTORY), 1)).alias("n"))
    ends = before(counts, ["journal"], "seq", "n", "begin", "journal-history").select("journal", "seq", (F.col("begin") + F.col("n")).alias("end"), "n")
    inside = Window.partitionBy("journal", "seq").orderBy("usn", "file_id", "path")
    history = records.where(has_reason(F.col("reason"), HISTORY)).withColumn("nth", F.row_number().over(inside)).join(ends, ["journal", "seq"])
    history = history.select("journal", "file_id", (F.col("end") - F.col("n") + F.col("nth")).alias("ordinal"), F.col("usn").alias("old_usn"), F.col("path").alias("old_path"))
    history = history.withColumn("range", F.floor(F.col("ordinal") / most))
    if trim is not None:
        history = history.where(F.col("old_usn") > trim)
    probes = records.where(has_reason(F.col("reason"), NEW_NAME)).join(ends.select("journal", "seq", "end"), ["journal", "seq"]).select("journal", "seq", "usn", "file_id", "path", "end")
    first, last = F.floor((F.col("end") - most + 1) / most), F.floor(F.col("end") / most)
    spread = probes.withColumn("range", F.explode(F.sequence(first, last)))
    seen = (F.col("ordinal") > F.col("end") - most) & (F.col("ordinal") <= F.col("end")) & (F.col("old_usn") < F.col("usn"))
    oldest = spread.join(history, ["journal", "file_id", "range"]).where(seen).groupBy("journal", "seq", "usn", "file_id").agg(F.min_by("old_path", "ordinal").alias("renamed_from"))
    return probes.join(oldest, ["journal", "seq", "usn", "file_id"], "left").select("journal", "seq", "usn", "file_id", "path", "renamed_from")
