"""Running sums and maxima over groups of any size: a group may spread over many tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import written

_OPERATIONS = {"sum": (np.add, 0), "max": (np.maximum, np.iinfo(np.int64).min)}


def _begins(batch: pa.RecordBatch, group: Sequence[str]) -> np.ndarray:
    """True where a row is of another group than the one before it; two nulls are the same."""
    n = batch.num_rows
    new = np.ones(n, bool)
    new[1:] = False
    for c in group:
        a, b = batch[c].slice(1), batch[c].slice(0, n - 1)
        new[1:] |= np.asarray(pc.fill_null(pc.not_equal(a, b), False)) | (np.asarray(a.is_null()) != np.asarray(b.is_null()))
    return new


def before(df: DataFrame, group: Sequence[str], order: str, value: str, out: str, label: str, operation: str = "sum") -> DataFrame:
    """The sum or maximum of ``value`` (a BIGINT without nulls) over the rows before each row of its group, as a BIGINT column.

    ``order`` is unique within a group; nulls in ``group`` are a group of their own.  Without a row
    before, the sum is 0 and the maximum the least BIGINT.  Rows are range-partitioned by group and
    order, run through once and written; a group that spreads over several partitions then gets what
    those before have, one row per group and partition.
    """
    step, nothing = _OPERATIONS[operation]
    ranged = df.repartitionByRange(*group, order).sortWithinPartitions(*group, order)
    names = [*df.columns, "local_run", "chunk"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, total = TaskContext.get().partitionId(), None, nothing
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = np.asarray(batch[value]).astype(np.int64)
            starts = np.flatnonzero(_begins(batch, group))
            local = np.empty(n, np.int64)
            first = [batch[c][0].as_py() for c in group]
            if operation == "sum":
                sums = np.cumsum(values) - values
                local = sums - np.repeat(sums[starts], np.diff(np.append(starts, n)))
            else:
                for a, b in zip(starts, [*starts[1:], n]):
                    local[a] = nothing
                    local[a + 1 : b] = np.maximum.accumulate(values[a : b - 1])
            if first == last:
                end = starts[1] if len(starts) > 1 else n
                local[:end] = step(local[:end], total)
            last, total = [batch[c][n - 1].as_py() for c in group], int(step(local[-1], values[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local), pa.array(np.full(n, part, np.int32))], names)

    local = written(ranged.mapInArrow(scan, f"{kinds}, local_run bigint, chunk int"), label)
    joined_values = F.col("local_run") + F.col(value) if operation == "sum" else F.greatest("local_run", value)
    totals = local.groupBy(*group, "chunk").agg(F.max(joined_values).alias("chunk_run"))
    w = Window.partitionBy(*group).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (F.sum if operation == "sum" else F.max)("chunk_run").over(w)
    earlier = totals.select(*[F.col(c).alias(f"g{i}") for i, c in enumerate(group)], F.col("chunk").alias("g_chunk"), carried.alias("carried")).where("carried IS NOT NULL")
    same = F.col("chunk") == F.col("g_chunk")
    for i, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"g{i}"))
    joined = local.join(earlier, same, "left")
    whole = F.col("local_run") + F.coalesce("carried", F.lit(0).cast("bigint")) if operation == "sum" else F.greatest("local_run", F.coalesce("carried", F.lit(nothing)))
    return joined.select(*df.columns, whole.alias(out))
