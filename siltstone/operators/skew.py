"""Joins in which one key may hold a large part of the rows on the left."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.session import written

#: A key is hot if it has more than a thousandth of the rows, so there are fewer than a thousand, and at least LEAST.
SHARE, LEAST = 1000, 100_000
SALTS = 64
#: Columns that a join adds for its own use.
HOT, SALT = "_spread_hot", "_spread_salt"


def hot_keys(rows: DataFrame, on: Sequence[str]) -> DataFrame | None:
    """The keys with more than a thousandth of all rows, fewer than 1,000 by that; None where there are none."""
    counts = written(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST), "hot-keys")
    if counts.isEmpty():
        return None
    total = rows.count()
    hot = counts.where(F.col("n") * SHARE > total).select(*on)
    return None if hot.isEmpty() else hot


def _bytes(size: str) -> int:
    """The number of a size such as 10485760b or 10MB; negative ones are for never."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgt]?)i?b?\s*", size.lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def sent_to_all(right: DataFrame) -> bool:
    """Whether Spark will send a table to every task, going by its own estimate and threshold."""
    threshold = _bytes(right.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10MB"))
    return int(str(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= threshold


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str, spread_by: Column) -> DataFrame:
    """``left.join(right, on, how)`` where rows of hot keys on the left are dealt to SALTS tasks by a hash of ``spread_by``.

    The matching rows on the right are repeated for each of them.  Where Spark sends the right side to
    every task, there is nothing to spread and the rows on the left are not counted.  The bound on the
    number of hot keys is what makes sending those to every task safe.  ``how`` is inner, left,
    left_semi or left_anti.
    """
    hot = None if sent_to_all(right) else hot_keys(left, on)
    if hot is None:
        return left.join(right, list(on), how)
    marks = F.broadcast(hot.withColumn(HOT, F.lit(True)))
    spread = F.coalesce(F.col(HOT), F.lit(False))
    for c in on:  # rows without a key find nothing, wherever they go
        spread |= F.col(c).isNull()
    salted = left.join(marks, list(on), "left").withColumn(SALT, F.when(spread, F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")).otherwise(0)).drop(HOT)
    copies = F.when(F.col(HOT), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.join(marks, list(on), "left").withColumn(SALT, F.explode(copies)).drop(HOT)
    return salted.join(repeated, [*on, SALT], how).drop(SALT)
