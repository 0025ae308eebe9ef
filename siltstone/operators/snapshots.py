"""What changed between full snapshots.

Keys get persistent ordinals: a key is assigned to a hash bucket and within it to the next free
number, which it keeps for good.  Per bucket and snapshot the keys present form a compressed bitmap
over ordinals; AND-NOT of consecutive bitmaps gives additions and removals, and the compared columns,
laid out as vectors aligned by ordinal, show which of the common keys changed.  A bucket is the low
bits of a hash.  As the keys grow, one more bit splits every bucket in two and the ordinals stay as
they are, so that a bucket stays bounded.

``snapshot_changes`` compares all snapshots that it is given.  ``SnapshotStore`` is for snapshots that
keep coming: it stores the ordinals, the rows of the last snapshot of each tree and the changes of
each call, so that a call reads nothing but the new snapshots and the last ones before them.  Its
manifest is published in numbered versions by a rename; a call that is repeated under the same name
gives the changes that it gave before.

Defined results: only snapshots in the log are compared, each with the one before it in the log of
its tree; a logged snapshot without rows is empty.  Rows with a null tree, snapshot or key are
ignored.  Compared columns are equal if both are null or both have the same value.  Copies of a key
are reduced to one before the shuffle; where they disagree, the greatest by value counts, column by
column, a null being the least.  Extra columns are ignored.  A snapshot that is logged after a later
one of its tree was compared cannot be put in its place any more: the store refuses it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from siltstone.operators.bitmaps import Bitmap
from siltstone.session import latest_version, put_version, written

PER_BUCKET = 1 << 15
KINDS = ("key", "added", "removed", "changed")


def _column(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table[name].combine_chunks()).astype(np.int64)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A vector of dense codes of the values; equal values and only they have equal codes."""
    encoded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    return np.asarray(encoded.indices.fill_null(-1)).astype(np.int64)


def _differ(n_values: int):
    def diff(key: tuple, rows: pa.Table, known: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        tree, number, pos = (_column(rows, c) for c in ("tree", "number", "pos"))
        # Ordinals: the known ones, then the new keys in sorted order.
        k_tree, k_number, k_ordinal = (_column(known, c) for c in ("tree", "number", "ordinal"))
        pairs = np.stack([np.concatenate([k_tree, tree]), np.concatenate([k_number, number])], 1)
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        ordered = pairs[order]
        first = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(1)]) if len(ordered) else np.empty(0, bool)
        dense = np.empty(len(pairs), np.int64)
        dense[order] = np.cumsum(first) - 1
        distinct = ordered[first]
        ordinal_of = np.full(len(distinct), -1, np.int64)
        ordinal_of[dense[: len(k_tree)]] = k_ordinal
        fresh = np.flatnonzero(ordinal_of < 0)
        ordinal_of[fresh] = np.arange(len(fresh)) + (k_ordinal.max() + 1 if len(k_ordinal) else 0)
        ordinal = ordinal_of[dense[len(k_tree) :]]
        by_ordinal = np.empty((int(ordinal_of.max()) + 1 if len(ordinal_of) else 0, 2), np.int64)
        by_ordinal[ordinal_of] = distinct
        values = [_codes(rows[f"v{n}"]) for n in range(n_values)]
        snapshot, after = _column(rows, "snapshot"), np.asarray(pc.fill_null(rows["after"], -1).combine_chunks()).astype(np.int64)
        has_after = np.asarray(pc.is_valid(rows["after"]).combine_chunks())

        out = [(distinct[fresh], ordinal_of[fresh], np.zeros(len(fresh), np.int64), np.full(len(fresh), -1, np.int64))]
        order = np.lexsort((ordinal, pos, tree))
        cuts = np.concatenate([[0], np.flatnonzero((np.diff(tree[order]) != 0) | (np.diff(pos[order]) != 0)) + 1, [len(order)]])
        groups = [order[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]
        size = len(by_ordinal)
        vectors: list[np.ndarray] | None = None
        before, before_at = Bitmap(), (None, None)
        for i, rows_of in enumerate(groups):
            at = (int(tree[rows_of[0]]), int(pos[rows_of[0]]))
            now = Bitmap.of(ordinal[rows_of])
            if before_at != (at[0], at[1] - 1):  # nothing of this bucket in the snapshot before
                before, vectors = Bitmap(), None
            number_now = int(snapshot[rows_of[0]])
            mine = []
            for v in values:
                vector = np.full(size, -1, np.int64)
                vector[ordinal[rows_of]] = v[rows_of]
                mine.append(vector)
            if at[1] > 0:
                found = [(1, now.and_not(before).values())]
                if len(before):
                    found.append((2, before.and_not(now).values()))
                    common = now.both(before).values()
                    changed = np.zeros(len(common), bool)
                    for new, old in zip(mine, vectors or []):
                        changed |= new[common] != old[common]
                    found.append((3, common[changed]))
                out += [(by_ordinal[o], o, np.full(len(o), kind), np.full(len(o), number_now)) for kind, o in found]
            following = groups[i + 1] if i + 1 < len(groups) else None
            if has_after[rows_of[0]] and (following is None or int(tree[following[0]]) != at[0] or int(pos[following[0]]) != at[1] + 1):
                o = now.values()  # the next snapshot has nothing of this bucket
                out.append((by_ordinal[o], o, np.full(len(o), 2), np.full(len(o), int(after[rows_of[0]]))))
            before, before_at, vectors = now, at, mine
        key_pairs, ordinals, kinds, snaps = (np.concatenate(x) for x in zip(*out))
        columns = [pa.array(np.full(len(kinds), bucket), pa.int64()), pa.array(ordinals, pa.int64()), pa.array(key_pairs[:, 0], pa.int64()), pa.array(key_pairs[:, 1], pa.int64()), pa.array(snaps, pa.int64(), mask=kinds == 0), pa.array(kinds.astype(np.int32), pa.int32())]
        return pa.Table.from_arrays(columns, ["bucket", "ordinal", "tree", "number", "snapshot", "kind"])

    return diff


ORDINALS = "ordinal bigint, tree bigint, number bigint"


def _bucket(bits: int) -> Column:
    return F.xxhash64("tree", "number").bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")).alias("bucket")


def bits_for(rows: int, least: int) -> int:
    """Bits of a bucket number that keep a bucket at about PER_BUCKET rows, with at least ``least`` buckets."""
    return (max(-(-rows // PER_BUCKET), least) - 1).bit_length()


def _one_each(rows: DataFrame, tree: str, snapshot: str, number: str, compare: Sequence[str]) -> DataFrame:
    """(tree, snapshot, number, v0..): one row a key, of copies that disagree the greatest.

    The copies are reduced by an aggregate, which combines before the shuffle.
    """
    plain = rows.select(F.col(tree).cast("bigint").alias("tree"), F.col(snapshot).cast("bigint").alias("snapshot"), F.col(number).cast("bigint").alias("number"), *[F.col(c).alias(f"v{n}") for n, c in enumerate(compare)])
    values = [f"v{n}" for n in range(len(compare))]
    best = plain.dropna(subset=["tree", "snapshot", "number"]).groupBy("tree", "snapshot", "number").agg(F.max(F.struct(*values)).alias("best"))
    return best.select("tree", "snapshot", "number", *[F.col(f"best.{v}").alias(v) for v in values])


def _log(log: DataFrame, tree: str, snapshot: str) -> DataFrame:
    return log.select(F.col(tree).cast("bigint").alias("tree"), F.col(snapshot).cast("bigint").alias("snapshot")).dropna().distinct()


def _found(kept: DataFrame, listed: DataFrame, known: DataFrame, n_values: int, bits: int) -> DataFrame:
    """(bucket, ordinal, tree, number, snapshot, kind) of new keys (kind 0) and changes, from one row a key and snapshot."""
    w = Window.partitionBy("tree").orderBy("snapshot")
    steps = listed.select("tree", "snapshot", (F.row_number().over(w) - 1).alias("pos"), F.lead("snapshot").over(w).alias("after"))
    schema = "bucket bigint, ordinal bigint, tree bigint, number bigint, snapshot bigint, kind int"
    placed = kept.join(steps, ["tree", "snapshot"]).withColumn("bucket", _bucket(bits))
    return placed.groupBy("bucket").cogroup(known.withColumn("bucket", _bucket(bits)).groupBy("bucket")).applyInArrow(_differ(n_values), schema)


def _named(found: DataFrame, kinds: dict[str, DataType]) -> DataFrame:
    """The changes under the column names and types of the rows; ``kinds`` has tree, snapshot and key in this order."""
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    return found.where("kind > 0").select(*[F.col(c).cast(t).alias(name) for c, (name, t) in zip(("tree", "snapshot", "number"), kinds.items())], kind.alias("change_kind"))


def snapshot_changes(rows: DataFrame, log: DataFrame, tree: str, snapshot: str, number: str, compare: Sequence[str], bits: int) -> DataFrame:
    """(tree, snapshot, number, change_kind) for each snapshot in the log but the first of its tree."""
    none = rows.sparkSession.createDataFrame([], ORDINALS)
    found = _found(_one_each(rows, tree, snapshot, number, compare), _log(log, tree, snapshot), none, len(compare), bits)
    return _named(found, {c: rows.schema[c].dataType for c in (tree, snapshot, number)})


class SnapshotStore:
    """Comparison of snapshots as they come, with persistent ordinals, in the shared folder below ``home``."""

    def __init__(self, spark: SparkSession, home: str, tree: str, snapshot: str, number: str, compare: Sequence[str], least_buckets: int = 1):
        self.spark, self.home, self.least = spark, home.rstrip("/"), least_buckets
        self.tree, self.snapshot, self.number, self.compare = tree, snapshot, number, list(compare)

    def _state(self) -> dict:
        newest = latest_version(self.spark, self.home, "manifest")
        return json.loads(newest[1]) if newest else {"calls": {}, "bits": 0, "keys": 0, "ordinals": []}

    def _path(self, kind: str, call: int) -> str:
        return f"{self.home}/{kind}/call={call}"

    def ordinals(self) -> DataFrame:
        """(bucket, ordinal, tree, number) of all keys known."""
        state = self._state()
        return self._ordinals(state).select(_bucket(state["bits"]), "ordinal", "tree", "number")

    def _ordinals(self, state: dict) -> DataFrame:
        if not state["ordinals"]:
            return self.spark.createDataFrame([], ORDINALS)
        return self.spark.read.schema(ORDINALS).parquet(*[self._path("ordinals", c) for c in state["ordinals"]])

    def advance(self, rows: DataFrame, log: DataFrame, name: str | None = None) -> DataFrame:
        """The changes of the snapshots in ``log`` that no call before has compared; ``rows`` has at least theirs.

        ``name`` names the call: one that is known gives its changes again.  Without it every call is new.
        """
        state = self._state()
        name = f"#{len(state['calls'])}" if name is None else name
        kinds = {c: rows.schema[c].dataType for c in (self.tree, self.snapshot, self.number)}
        if name not in state["calls"]:
            self._compare(rows, log, name, state)
        return _named(self.spark.read.parquet(self._path("changes", self._state()["calls"][name])), kinds)

    def _compare(self, rows: DataFrame, log: DataFrame, name: str, state: dict) -> None:
        spark, call = self.spark, len(state["calls"])
        listed = _log(log, self.tree, self.snapshot)
        kept = _one_each(rows, self.tree, self.snapshot, self.number, self.compare)
        if call:
            done = spark.read.parquet(self._path("log", call - 1))
            last = done.groupBy("tree").agg(F.max("snapshot").alias("last"))
            listed = listed.join(done, ["tree", "snapshot"], "left_anti")
            late = listed.join(last, "tree").where("snapshot < last").first()
            if late:
                raise ValueError(f"snapshot {late['snapshot']} of {late['tree']} comes after {late['last']} was compared")
            kept = kept.join(listed, ["tree", "snapshot"], "left_semi").unionByName(spark.read.parquet(self._path("last", call - 1)))
            steps = listed.unionByName(last.select("tree", F.col("last").alias("snapshot")))
        else:
            done, steps = None, listed
        bits = max(state["bits"], bits_for(rows.count() + state["keys"], self.least))
        found = _found(kept, steps, self._ordinals(state), len(self.compare), bits)
        found.write.mode("overwrite").parquet(self._path("changes", call))
        found = spark.read.parquet(self._path("changes", call))
        found.where("kind = 0").select("ordinal", "tree", "number").write.mode("overwrite").parquet(self._path("ordinals", call))
        newest = steps.groupBy("tree").agg(F.max("snapshot").alias("snapshot"))
        kept.join(newest, ["tree", "snapshot"], "left_semi").write.mode("overwrite").parquet(self._path("last", call))
        (listed if done is None else listed.unionByName(done)).write.mode("overwrite").parquet(self._path("log", call))
        keys = state["keys"] + spark.read.parquet(self._path("ordinals", call)).count()
        put_version(spark, self.home, "manifest", json.dumps({"calls": state["calls"] | {name: call}, "bits": bits, "keys": keys, "ordinals": [*state["ordinals"], call]}))


def change_details(changes: DataFrame, rows: DataFrame, log: DataFrame, tree: str, snapshot: str, number: str, compare: Sequence[str]) -> DataFrame:
    """The changes with the compared columns of the earlier (``old_``) and the later (``new_``) snapshot."""
    if clash := [c for c in compare if re.search(r"^(old|new)_", c)]:
        raise ValueError(f"compared columns must not begin with old_ or new_: {clash}")
    w = Window.partitionBy(tree).orderBy(snapshot)
    steps = log.select(tree, snapshot).distinct().withColumn("earlier", F.lag(snapshot).over(w))
    best = _one_each(rows, tree, snapshot, number, compare)
    kinds = {c: rows.schema[c].dataType for c in (tree, snapshot, number)}
    one = best.select(*[F.col(k).cast(t).alias(c) for k, (c, t) in zip(("tree", "snapshot", "number"), kinds.items())], *[F.col(f"v{n}").alias(c) for n, c in enumerate(compare)])
    new = one.select(tree, snapshot, number, *[F.col(c).alias(f"new_{c}") for c in compare])
    old = one.select(tree, F.col(snapshot).alias("earlier"), number, *[F.col(c).alias(f"old_{c}") for c in compare])
    return changes.join(steps, [tree, snapshot]).join(new, [tree, snapshot, number], "left").join(old, [tree, "earlier", number], "left").drop("earlier")
