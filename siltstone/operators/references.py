"""References to records that do not exist.

References and records are reduced to distinct keys before any shuffle, then grouped by a hash
bucket.  Within a bucket the keys are dictionary-encoded as dense integers; compressed bitmaps are
built per key range (65,536 codes) and period, and the codes that survive reference AND-NOT record
are decoded again.  The number of buckets follows the number of rows, so a bucket stays bounded; a
key that a third of all rows refer to is one bit.

Defined results: a null in any key column is no reference; a null period is a period of its own.
Repeated rows change nothing.  With no records every reference is an orphan, with no references the
result is empty.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.bitmaps import Bitmap

PER_BUCKET = 1 << 17


def _keys(table: pa.Table, n: int) -> np.ndarray:
    columns = [np.asarray(table[f"k{i}"].combine_chunks()).astype(np.int64) for i in range(n)]
    return np.stack(columns, 1) if len(columns[0]) else np.empty((0, n), np.int64)


def _encode(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct rows of ``keys`` and for each row its dense code."""
    if not len(keys):
        return keys, np.empty(0, np.int64)
    order = np.lexsort(keys.T[::-1])
    ordered = keys[order]
    new = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(1)])
    codes = np.empty(len(keys), np.int64)
    codes[order] = np.cumsum(new) - 1
    return ordered[new], codes


def _finder(n: int):
    def find(refs: pa.Table, records: pa.Table) -> pa.Table:
        a, b = _keys(refs, n), _keys(records, n)
        dictionary, codes = _encode(np.concatenate([a, b]))
        present = Bitmap.of(codes[len(a) :])
        group = np.asarray(pc.fill_null(refs["groups"], -1).combine_chunks())
        period = np.asarray(pc.fill_null(refs["period"], np.iinfo(np.int32).min).combine_chunks())
        combined, which = _encode(np.stack([group, period], 1).astype(np.int64))
        order = np.argsort(which, kind="stable")
        cuts = np.searchsorted(which[order], np.arange(len(combined) + 1))
        out: list[tuple[np.ndarray, int]] = []
        for i in range(len(combined)):
            missing = Bitmap.of(codes[: len(a)][order[cuts[i] : cuts[i + 1]]]).and_not(present)
            out.append((missing.values(), i))
        at = np.concatenate([v for v, _ in out]) if out else np.empty(0, np.int64)
        of = np.concatenate([np.full(len(v), i) for v, i in out]) if out else np.empty(0, np.int64)
        lost, kinds = dictionary[at], combined[of] if len(of) else np.empty((0, 2), np.int64)
        periods = pa.array(kinds[:, 1].astype(np.int32), pa.int32(), mask=kinds[:, 1] == np.iinfo(np.int32).min)
        return pa.Table.from_arrays([pa.array(kinds[:, 0].astype(np.int32), pa.int32()), periods, *[pa.array(lost[:, i], pa.int64()) for i in range(n)]], ["groups", "period", *[f"k{i}" for i in range(n)]])

    return find


def orphan_keys(references: DataFrame, records: DataFrame, key: Sequence[str], group: str, period: str, buckets: int) -> DataFrame:
    """Distinct (group, period, key) of references whose key no record has.

    ``group`` (an INT naming the referring table) and ``period`` (an INT such as year * 12 + month)
    are columns of ``references``; the columns of ``key`` are integers in both tables.
    """
    n = len(key)
    names = [f"k{i}" for i in range(n)]
    encode = [F.col(c).cast("bigint").alias(k) for c, k in zip(key, names)]
    bucket = F.pmod(F.xxhash64(*names), F.lit(buckets)).alias("bucket")
    refs = references.select(F.col(group).cast("int").alias("groups"), F.col(period).cast("int").alias("period"), *encode).dropna(subset=[*names, "groups"]).distinct().select("groups", "period", *names, bucket)
    have = records.select(*encode).dropna().distinct().select(*names, bucket)
    schema = ", ".join(["groups int", "period int", *[f"{k} bigint" for k in names]])
    lost = refs.groupBy("bucket").cogroup(have.groupBy("bucket")).applyInArrow(_finder(n), schema)
    return lost.select(F.col("groups").alias(group), F.col("period").alias(period), *[F.col(k).alias(c) for k, c in zip(names, key)])


def orphans_by_period(orphan_rows: DataFrame, group: str, period: str) -> DataFrame:
    """The report: orphan references per table and period."""
    return orphan_rows.groupBy(group, period).agg(F.count(F.lit(1)).alias("n_orphans"))
