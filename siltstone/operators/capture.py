"""Processing only new or changed records: log-based change capture.

A run has three durable steps, each in the shared folder below ``home``:

1. ``plan``: the write-ahead plan.  For every partition of the log (a journal) it pins the identifiers
   that no successful batch and no earlier run has handled.  A plan that was written but not committed
   is used again as it is, so a replay handles exactly the records of the failed try.
2. the sink write.  Rows go to ``run=<n>``, which a replay overwrites; each (key, offset) has one row.
3. ``commit``: a numbered state file, published by a rename, that names the per-partition offsets and
   what lies below them.

The offset of a partition is the one after the highest that a run has handled.  What lies at or beyond
it is new and needs no look-up.  Late records lie below it: only they are compared with the handled
offsets, which are kept as compressed bitmaps per partition and range of 65,536 offsets.  Every run
adds one part of bitmaps, and after ``MERGE_EVERY`` parts they are merged and the old plans deleted, so
that neither the plan of a query nor the state grows with the number of runs.

Defined results: records with a null partition, offset or batch are pending like those of an unknown
batch, except that a null key cannot be told from another and is left out of the plan.  Lines with a
null batch or order count for nothing; where several lines share the highest order, one that is
committed makes the batch done.  Repeated rows and lines change nothing.  Empty tables give an empty
plan.  Other columns, whatever their names, are carried to the sink unread.  Partitions and offsets are
integers.  ``sink`` adds the number of the run as the column ``run``, in place of one of that name.
One writer at a time: a second one fails when it commits.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import bitmaps
from siltstone.operators.dedup_index import first_copies
from siltstone.session import latest_version, list_names, path_exists, put_text, put_version, remove, written

MERGE_EVERY = 8
#: A group of the look-up has at most 2 ** SPAN_BITS offsets: 16 containers.
SPAN_BITS = 20
HANDLED = "p bigint, span bigint, range bigint, container binary"


def done_batches(lines: DataFrame, batch: str = "batch_id", order: str = "log_no", status: str = "status", success: str = "committed") -> DataFrame:
    """The batches whose last line (highest ``order``) has the status ``success``."""
    good = F.when(F.col(status) == success, F.col(order))
    state = lines.where(F.col(batch).isNotNull()).groupBy(F.col(batch).alias("batch")).agg(F.max(order).alias("last"), F.max(good).alias("last_good"))
    return state.where("last = last_good").select("batch")


def pending_keys(records: DataFrame, done: DataFrame, partition: str = "journal_id", offset: str = "usn", batch: str = "batch_id") -> DataFrame:
    """(partition, offset) of the records none of whose batches is done, each once.

    The join is on the batch, whose states are aggregated first; the records are pre-aggregated by
    key before the second shuffle, so that many copies of one record cost one row per task.
    """
    rows = records.select(F.col(partition).alias("p"), F.col(offset).alias("o"), F.col(batch).alias("batch")).where("p IS NOT NULL AND o IS NOT NULL")
    marked = rows.join(done.withColumn("done", F.lit(1)), "batch", "left")
    kept = marked.groupBy("p", "o").agg(F.max("done").alias("done")).where("done IS NULL")
    return kept.select(F.col("p").alias(partition), F.col("o").alias(offset))


def _span(offset: str) -> F.Column:
    return F.shiftright(F.col(offset), SPAN_BITS).alias("span")


def _containers(table: pa.Table) -> dict[int, bytes]:
    """The handled offsets of a group, one container for each range."""
    out: dict[int, bytes] = {}
    for at, container in zip(table["range"].to_pylist(), table["container"].to_pylist()):
        out[at] = bitmaps.either(out[at], container) if at in out else container
    return out


def _rows(p: int | None, span: int | None, containers: dict[int, bytes]) -> pa.Table:
    n = len(containers)
    return pa.Table.from_arrays([pa.array([p] * n, pa.int64()), pa.array([span] * n, pa.int64()), pa.array(list(containers), pa.int64()), pa.array(list(containers.values()), pa.binary())], ["p", "span", "range", "container"])


def _absent(key: tuple, wanted: pa.Table, handled: pa.Table) -> pa.Table:
    offsets = np.asarray(wanted["o"].combine_chunks()).astype(np.int64)
    missing = np.ones(len(offsets), bool)
    for at, container in _containers(handled).items():
        mine = np.flatnonzero(offsets >> 16 == at)
        missing[mine] = ~bitmaps.contains(container, offsets[mine] & 0xFFFF)
    left = offsets[missing]
    return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(left), pa.int64()), pa.array(left)], ["p", "o"])


def _pack(key: tuple, keys: pa.Table) -> pa.Table:
    offsets = np.asarray(keys["o"].combine_chunks()).astype(np.int64)
    return _rows(key[0].as_py(), key[1].as_py(), {int(at): bitmaps.compress(offsets[offsets >> 16 == at] & 0xFFFF) for at in np.unique(offsets >> 16)})


def _merge(key: tuple, handled: pa.Table) -> pa.Table:
    return _rows(key[0].as_py(), key[1].as_py(), _containers(handled))


@dataclass(frozen=True)
class Plan:
    run: int
    path: str
    replayed: bool


class ChangeCapture:
    """Incremental reader of a partitioned log with a write-ahead plan and an idempotent sink."""

    def __init__(self, spark: SparkSession, home: str, partition: str = "journal_id", offset: str = "usn", batch: str = "batch_id"):
        self.spark, self.home = spark, home.rstrip("/")
        self.partition, self.offset, self.batch = partition, offset, batch

    def _state(self) -> dict:
        """The last commit: its run, the folder of its offsets and those of the handled bitmaps."""
        newest = latest_version(self.spark, self.home, "state")
        return json.loads(newest[1]) if newest else {"run": 0, "offsets": None, "handled": []}

    def plan(self, records: DataFrame, lines: DataFrame) -> Plan:
        """Write the plan of the next run, or give back the one that was planned but not committed."""
        state = self._state()
        run = state["run"] + 1
        path = f"{self.home}/plan/run={run}"
        if path_exists(self.spark, f"{self.home}/ready/run={run}"):
            return Plan(run, path, True)
        todo = pending_keys(records, done_batches(lines, self.batch), self.partition, self.offset, self.batch)
        if state["offsets"]:
            todo = self._unhandled(todo, state)
        todo.write.mode("overwrite").parquet(path)
        put_text(self.spark, f"{self.home}/ready/run={run}", "ready")
        return Plan(run, path, False)

    def _unhandled(self, todo: DataFrame, state: dict) -> DataFrame:
        """What lies at or beyond the offset of its partition, and of what lies below it what no run has handled."""
        plain = todo.select(F.col(self.partition).cast("bigint").alias("p"), F.col(self.offset).cast("bigint").alias("o"))
        offsets = self.spark.read.parquet(f"{self.home}/{state['offsets']}")
        # Written, since both halves are needed; no hint: there is one offset per partition, but nothing bounds those.
        marked = written(plain.join(offsets, "p", "left").select("p", "o", F.coalesce(F.col("o") >= F.col("next_offset"), F.lit(True)).alias("fresh")), "capture-pending")
        handled = self.spark.read.schema(HANDLED).parquet(*[f"{self.home}/{h}" for h in state["handled"]])
        below = marked.where("NOT fresh").select("p", "o", _span("o"))
        late = below.groupBy("p", "span").cogroup(handled.groupBy("p", "span")).applyInArrow(_absent, "p bigint, o bigint")
        kinds = {c: todo.schema[c].dataType for c in (self.partition, self.offset)}
        found = marked.where("fresh").select("p", "o").unionByName(late)
        return found.select(F.col("p").cast(kinds[self.partition]).alias(self.partition), F.col("o").cast(kinds[self.offset]).alias(self.offset))

    def keys(self, plan: Plan) -> DataFrame:
        """The identifiers pinned by a plan."""
        return self.spark.read.parquet(plan.path)

    def offsets(self, plan: Plan) -> DataFrame:
        """Per partition: first and last offset of the plan and the number of records."""
        return self.keys(plan).groupBy(self.partition).agg(F.min(self.offset).alias("first_offset"), F.max(self.offset).alias("last_offset"), F.count(F.lit(1)).alias("n_records"))

    def next_offsets(self) -> DataFrame | None:
        """(partition, next offset) as of the last commit; None before it."""
        path = self._state()["offsets"]
        return self.spark.read.parquet(f"{self.home}/{path}").select(F.col("p").alias(self.partition), F.col("next_offset").alias(f"next_{self.offset}")) if path else None

    def write(self, plan: Plan, records: DataFrame) -> str:
        """Write the planned records to the sink, one row each; running it again replaces the same rows.

        Of several copies the one with the fewest nulls is kept, ties by its values.
        """
        key = [self.partition, self.offset]
        target = f"{self.home}/sink/run={plan.run}"
        first_copies(records.join(self.keys(plan), key, "left_semi"), key).write.mode("overwrite").parquet(target)
        return target

    def commit(self, plan: Plan) -> None:
        """Publish the run as done, with the next offset of each partition and the bitmaps of what it handled."""
        state = self._state()
        if plan.run <= state["run"]:
            return
        keys = self.keys(plan).select(F.col(self.partition).cast("bigint").alias("p"), F.col(self.offset).cast("bigint").alias("o"))
        tops = keys.select("p", (F.col("o") + 1).alias("next_offset"))
        if state["offsets"]:
            tops = tops.unionByName(self.spark.read.parquet(f"{self.home}/{state['offsets']}"))
        new = {"run": plan.run, "offsets": f"offsets/run={plan.run}", "handled": [*state["handled"], f"handled/run={plan.run}"]}
        tops.groupBy("p").agg(F.max("next_offset").alias("next_offset")).write.mode("overwrite").parquet(f"{self.home}/{new['offsets']}")
        keys.withColumn("span", _span("o")).groupBy("p", "span").applyInArrow(_pack, HANDLED).write.mode("overwrite").parquet(f"{self.home}/{new['handled'][-1]}")
        merged = len(new["handled"]) > MERGE_EVERY
        if merged:
            parts = self.spark.read.schema(HANDLED).parquet(*[f"{self.home}/{h}" for h in new["handled"]])
            new["handled"] = [f"handled/upto={plan.run}"]
            parts.groupBy("p", "span").applyInArrow(_merge, HANDLED).write.mode("overwrite").parquet(f"{self.home}/{new['handled'][0]}")
        put_version(self.spark, self.home, "state", json.dumps(new))
        if merged:  # nothing refers any more to what came before
            for kind in ("plan", "ready", "offsets", "handled"):
                for name in list_names(self.spark, f"{self.home}/{kind}"):
                    if f"{kind}/{name}" not in (new["offsets"], *new["handled"], f"plan/run={plan.run}"):
                        remove(self.spark, f"{self.home}/{kind}/{name}")

    def run(self, records: DataFrame, lines: DataFrame, fail_before_commit: bool = False) -> Plan:
        """One run; ``fail_before_commit`` ends it after the sink write, as a crash would."""
        plan = self.plan(records, lines)
        self.write(plan, records)
        if not fail_before_commit:
            self.commit(plan)
        return plan

    def sink(self) -> DataFrame | None:
        """The rows of all runs in the sink, with the run as a column; None before the first run."""
        if not list_names(self.spark, f"{self.home}/sink"):
            return None
        return self.spark.read.parquet(f"{self.home}/sink")

    def forget(self, run: int) -> None:
        """Drop the files of an uncommitted plan, for a caller that gives the run up."""
        if run > self._state()["run"]:
            for kind in ("ready", "plan", "sink"):
                remove(self.spark, f"{self.home}/{kind}/run={run}")


def next_offsets(records: DataFrame, lines: DataFrame, partition: str = "journal_id", offset: str = "usn", batch: str = "batch_id", start: str = "start_usn", end: str = "next_usn") -> DataFrame:
    """Per partition the offset from which the next run reads once all pending records are handled.

    It is the highest end of a done batch, or the offset after the last record where that lies
    further.  As in a journal read, an end that is 0 or lies before its start does not advance it.
    A partition with neither records nor a valid end is left out.
    """
    good = lines.join(done_batches(lines, batch).withColumnRenamed("batch", batch), batch, "left_semi").where(f"{end} > 0 AND ({start} IS NULL OR {end} >= {start})")
    ends = good.select(F.col(partition).alias("p"), F.col(end).alias("o"))
    seen = records.select(F.col(partition).alias("p"), (F.col(offset) + 1).alias("o")).where("o IS NOT NULL")
    return ends.unionByName(seen).where("p IS NOT NULL").groupBy(F.col("p").alias(partition)).agg(F.max("o").alias("next_usn"))
