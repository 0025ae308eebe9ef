"""Applying a stream of inserts, updates and deletes to a table.

Changes are made unique by their identifier, the latest change per key (highest sequence) is picked
with a window ranking, and the result is merged into the base.  The state keeps a tombstone for a
deleted key, so that an older change that arrives later cannot bring the key back; ``current`` drops
the tombstones.

Catalyst turns ``row_number() = 1`` into a group limit that runs before the shuffle, so a key with a
third of all rows costs one row per task, not one task for all its rows.

Defined results: a change with a null identifier, key or sequence is ignored; a null in the delete
condition means no delete.  Copies of a change may miss values: each carried column comes from the
latest change of the key in which it is not null, in its own type; where copies disagree, the greatest
value counts (of maps, which have no order, that with the greatest JSON text).  Changes of one key with
equal sequence but different identifiers are ordered by identifier, highest last.  Empty tables give
an empty state.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def _greatest(column: str, kind: DataType) -> Column:
    """The greatest value of a column; ``map`` anywhere in a type takes its order away."""
    if "map<" in kind.simpleString():
        return F.max_by(column, F.to_json(F.struct(column)))
    return F.max(column)


def unique_changes(changes: DataFrame, identifier: Sequence[str], key: Sequence[str], seq: str, delete: Column, carry: Sequence[str] = ()) -> DataFrame:
    """One row per identifier with columns i0.., k0.., seq, gone and the carried ones completed from all copies."""
    named = changes.select(
        *[F.col(c).alias(f"i{n}") for n, c in enumerate(identifier)],
        *[F.col(c).alias(f"k{n}") for n, c in enumerate(key)],
        F.col(seq).alias("seq"),
        F.coalesce(delete, F.lit(False)).cast("int").alias("gone"),
        *[F.col(c).alias(f"c_{c}") for c in carry],
    )
    ids, keys = [f"i{n}" for n in range(len(identifier))], [f"k{n}" for n in range(len(key))]
    whole = named.dropna(subset=[*ids, *keys, "seq"])
    return whole.groupBy(*ids).agg(*[F.max(k).alias(k) for k in keys], F.max("seq").alias("seq"), F.max("gone").alias("gone"), *[_greatest(f"c_{c}", whole.schema[f"c_{c}"].dataType).alias(f"c_{c}") for c in carry])


def latest_per_key(unique: DataFrame, n_ids: int, n_keys: int, carry: Sequence[str] = ()) -> DataFrame:
    """The last change of each key and, for each carried column, its last value that is not null."""
    keys, ids = [f"k{n}" for n in range(n_keys)], [f"i{n}" for n in range(n_ids)]
    order = [F.desc("seq"), *[F.desc(i) for i in ids]]
    last = unique.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rank = 1")
    if not carry:
        return last.select(*keys, "seq", "gone")
    # One candidate row per change and column that it sets, each value in a field of its own type; slot -1 is the change itself.
    def cell(slot: int) -> Column:
        values = [F.col(f"c_{c}") if n == slot else F.lit(None).cast(unique.schema[f"c_{c}"].dataType) for n, c in enumerate(carry)]
        return F.struct(F.lit(slot).alias("slot"), *[v.alias(f"c_{c}") for v, c in zip(values, carry)])

    cells = [cell(-1), *[F.when(F.col(f"c_{c}").isNotNull(), cell(n)) for n, c in enumerate(carry)]]
    long = unique.select(*keys, *ids, "seq", "gone", F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("cell")).select(*keys, *ids, "seq", "gone", "cell.*")
    top = long.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "slot").orderBy(*order))).where("rank = 1")
    wide = [F.max(F.when(F.col("slot") == -1, F.col(c))).alias(c) for c in ("seq", "gone")]
    for n, c in enumerate(carry):  # a key has one row per slot, so there is nothing to choose
        wide += [F.first(F.when(F.col("slot") == n, F.col(f"c_{c}")), ignorenulls=True).alias(f"c_{c}"), F.max(F.when(F.col("slot") == n, F.col("seq"))).alias(f"s_{c}")]
    return top.groupBy(*keys).agg(*wide)


def merge_state(base: DataFrame, new: DataFrame, n_keys: int, carry: Sequence[str] = ()) -> DataFrame:
    """Merge two states; per key the higher sequence wins, for the whole row and for each carried column.

    Both sides have one row per key, so the full join has no hot key.
    """
    keys = [f"k{n}" for n in range(n_keys)]
    a, b = base.alias("a"), new.alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full_outer")

    def newer(value: str, by: str) -> Column:
        take_b = F.col(f"a.{by}").isNull() | (F.col(f"b.{by}") >= F.col(f"a.{by}"))
        return F.when(F.col(f"b.{by}").isNotNull() & take_b, F.col(f"b.{value}")).otherwise(F.col(f"a.{value}")).alias(value)

    out = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys]
    out += [newer("seq", "seq"), newer("gone", "seq")]
    for c in carry:
        out += [newer(f"c_{c}", f"s_{c}"), newer(f"s_{c}", f"s_{c}")]
    return joined.select(*out)


def apply_changes(base: DataFrame | None, changes: DataFrame, identifier: Sequence[str], key: Sequence[str], seq: str, delete: Column, carry: Sequence[str] = ()) -> DataFrame:
    """The state after ``changes``; ``base`` is a state from an earlier call, or None for an empty table."""
    unique = unique_changes(changes, identifier, key, seq, delete, carry)
    new = latest_per_key(unique, len(identifier), len(key), carry)
    return new if base is None else merge_state(base, new, len(key), carry)


def current(state: DataFrame, key: Sequence[str], seq: str, carry: Sequence[str] = ()) -> DataFrame:
    """The keys that exist, without tombstones, under their own column names."""
    return state.where("gone = 0").select(*[F.col(f"k{n}").alias(c) for n, c in enumerate(key)], F.col("seq").alias(seq), *[F.col(f"c_{c}").alias(c) for c in carry])
