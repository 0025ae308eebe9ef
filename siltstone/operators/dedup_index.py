"""Messages delivered more than once: a persistent index of sorted identifier arrays.

The index is a set of immutable runs in the shared folder.  A run has, per hash prefix and block, the
sorted 64-bit hashes of its identifiers and, in the same order, the identifiers themselves.  An
incoming batch is first reduced to one row per identifier with its number of copies (before the
shuffle, so that a message repeated in a third of all rows costs one row per task), then grouped by
hash prefix beside the index blocks of that prefix; blocks of prefixes that the batch does not have
are left out before the shuffle.  Each group is binary-searched; equal hashes are confirmed on the
identifier, so a hash collision never loses a message.

Runs are merged in tiers: ``merge_every`` runs of one tier become one of the next, so that an
identifier is rewritten once per tier and not once per merge.  The prefix grows with the index, at
which all runs are merged, so that a group stays bounded.

A batch has a name.  The manifest, published in numbered versions by a rename, says which run belongs
to which batch: a batch that is admitted again, because something failed after it was indexed, gets
the run it had, and with it the same messages to hand on.  Merging is a step of its own before a new
batch; it never changes what a batch brought.

Defined results: identifiers are one or more integer columns.  A row with a null in its identifier
cannot be recognised: it counts as novel and is neither indexed nor reported.  Empty batches add an
empty run.  Extra columns are ignored.  A folder with runs but no manifest is refused.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.session import latest_version, list_names, put_version

BLOCK = 1 << 16
PER_PREFIX = 1 << 17


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    values = np.concatenate(rows) if rows else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    parts = [np.asarray(c.flatten()) for c in column.chunks]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _found(hashes: np.ndarray, keys: list[np.ndarray], h: np.ndarray, k: list[np.ndarray]) -> np.ndarray:
    """For each (h, k) whether it is among the sorted ``hashes`` with ``keys``."""
    hit = np.zeros(len(h), bool)
    if not len(hashes):
        return hit
    at = np.searchsorted(hashes, h, "left")
    left = np.arange(len(h))
    while len(left):
        inside = at[left] < len(hashes)
        left = left[inside]
        left = left[hashes[at[left]] == h[left]]
        same = np.ones(len(left), bool)
        for column, mine in zip(keys, k):
            same &= column[at[left]] == mine[left]
        hit[left[same]] = True
        left = left[~same]
        at[left] += 1
    return hit


def _searcher(n_keys: int):
    """The grouped function: ids and index blocks of one prefix -> a block row of the new run."""

    def search(key: tuple, ids: pa.Table, index: pa.Table) -> pa.Table:
        h = np.asarray(ids["h"].combine_chunks())
        k = [np.asarray(ids[f"k{n}"].combine_chunks()) for n in range(n_keys)]
        copies = np.asarray(ids["copies"].combine_chunks())
        order = np.lexsort([*reversed(k), h])
        h, k, copies = h[order], [x[order] for x in k], copies[order]
        seen = np.zeros(len(h), bool)
        # The blocks of one run and prefix are contiguous in hash order; each is searched by itself.
        for row in range(index.num_rows):
            one = index.slice(row, 1)
            seen |= _found(_flat(one["h"]), [_flat(one[f"k{n}"]) for n in range(n_keys)], h, k)
        again = (copies > 1) | seen
        starts = range(0, max(len(h), 1), BLOCK)
        blocks = [slice(s, s + BLOCK) for s in starts]
        new = ~seen
        columns = [pa.array([key[0].as_py()] * len(blocks), pa.int64()), _lists([h[b][new[b]] for b in blocks], pa.int64())]
        columns += [_lists([x[b][new[b]] for b in blocks], pa.int64()) for x in k]
        columns += [_lists([x[b][again[b]] for b in blocks], pa.int64()) for x in k]
        names = ["prefix", "h", *[f"k{n}" for n in range(n_keys)], *[f"again{n}" for n in range(n_keys)]]
        return pa.Table.from_arrays(columns, names)

    return search


def _merger(n_keys: int, shift: int):
    """Merge the blocks of several runs; the rows of a group are all of one old prefix.

    Hashes have 63 bits, so that their signed order is also that of their prefixes.
    """

    def merge(key: tuple, blocks: pa.Table) -> pa.Table:
        h = _flat(blocks["h"])
        k = [_flat(blocks[f"k{n}"]) for n in range(n_keys)]
        order = np.argsort(h, kind="stable")
        h, k = h[order], [x[order] for x in k]
        prefix = (h.view(np.uint64) >> np.uint64(shift)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(prefix)) + 1
        bounds = sorted({0, len(h), *cuts.tolist()})
        spans = [slice(s, min(s + BLOCK, e)) for b, e in zip(bounds, bounds[1:]) for s in range(b, e, BLOCK)]
        columns = [pa.array([prefix[s.start] for s in spans], pa.int64()), _lists([h[s] for s in spans], pa.int64())]
        columns += [_lists([x[s] for s in spans], pa.int64()) for x in k]
        columns += [_lists([np.empty(0, np.int64) for _ in spans], pa.int64()) for _ in k]
        names = ["prefix", "h", *[f"k{n}" for n in range(n_keys)], *[f"again{n}" for n in range(n_keys)]]
        return pa.Table.from_arrays(columns, names)

    return merge


class DedupIndex:
    """Exactly-once filter over batches of messages."""

    def __init__(self, spark: SparkSession, home: str, identifier: Sequence[str], merge_every: int = 4):
        self.spark, self.home, self.identifier, self.merge_every = spark, home.rstrip("/"), list(identifier), merge_every
        names = [f"k{n}" for n in range(len(self.identifier))] + [f"again{n}" for n in range(len(self.identifier))]
        self.schema = ", ".join(["prefix bigint", "h array<bigint>", *[f"{n} array<bigint>" for n in names]])

    def _manifest(self) -> dict:
        newest = latest_version(self.spark, self.home, "manifest")
        if newest:
            return json.loads(newest[1])
        if [x for x in list_names(self.spark, self.home) if x.startswith(("run-", "merged-"))]:
            raise OSError(f"{self.home} has runs but no manifest")
        empty = {"bits": 4, "rows": 0, "runs": [], "batches": {}, "merges": 0}
        self._publish(empty)  # before the first run, so that runs without a manifest can be told
        return empty

    def _publish(self, manifest: dict) -> None:
        put_version(self.spark, self.home, "manifest", json.dumps(manifest))

    def _read(self, runs: Sequence[str]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.home}/{r}" for r in runs])

    def admit(self, messages: DataFrame, batch: str | None = None, rows: int | None = None) -> str:
        """Index a batch and give the name of its run; a batch that is known already keeps its run.

        ``batch`` names the batch; without it every call is a new one.  ``rows`` is a size estimate,
        which is counted where absent.
        """
        manifest = self._manifest()
        batch = f"#{len(manifest['batches'])}" if batch is None else batch
        if batch in manifest["batches"]:
            return manifest["batches"][batch]
        rows = messages.count() if rows is None else rows
        manifest = self.maintain(rows)
        n, bits = len(self.identifier), manifest["bits"]
        names = [f"k{i}" for i in range(n)]

        def keyed(df: DataFrame) -> DataFrame:
            return df.withColumn("h", F.shiftrightunsigned(F.xxhash64(*names), 1)).withColumn("prefix", F.shiftrightunsigned("h", 63 - bits))

        plain = messages.select(*[F.col(c).cast("bigint").alias(k) for c, k in zip(self.identifier, names)]).dropna()
        ids = keyed(plain.groupBy(*names).agg(F.count(F.lit(1)).alias("copies")))
        index = self._read([r["name"] for r in manifest["runs"]]).select("prefix", "h", *names)
        if manifest["runs"]:
            index = index.join(keyed(plain).select("prefix").distinct(), "prefix", "left_semi")
        run = f"run-{len(manifest['batches']):06d}"
        found = ids.groupBy("prefix").cogroup(index.groupBy("prefix")).applyInArrow(_searcher(n), self.schema)
        found.write.mode("overwrite").parquet(f"{self.home}/{run}")
        manifest["batches"][batch] = run
        manifest["runs"].append({"name": run, "tier": 0})
        manifest["rows"] += rows
        self._publish(manifest)
        return run

    def maintain(self, coming: int = 0) -> dict:
        """Merge what is due, as a step of its own, and give the manifest; ``coming`` rows are about to be added."""
        manifest = self._manifest()
        need = max(4, ((manifest["rows"] + coming) // PER_PREFIX).bit_length())
        if not manifest["runs"]:
            manifest["bits"] = max(manifest["bits"], need)
            return manifest
        if need > manifest["bits"] + 2:
            return self._merge(manifest, manifest["runs"], need)
        for tier in sorted({r["tier"] for r in manifest["runs"]}):
            same = [r for r in manifest["runs"] if r["tier"] == tier]
            if len(same) >= self.merge_every:
                manifest = self._merge(manifest, same, manifest["bits"])
        return manifest

    def merge(self) -> dict:
        """Merge all runs into one, whatever their tier."""
        manifest = self._manifest()
        return self._merge(manifest, manifest["runs"], manifest["bits"])

    def _merge(self, manifest: dict, old: list[dict], bits: int) -> dict:
        """Replace runs by one, with a longer prefix where asked for; their files stay, as batches refer to them."""
        n = len(self.identifier)
        name = f"merged-{manifest['merges']:06d}"
        blocks = self._read([r["name"] for r in old]).where(F.size("h") > 0)
        blocks.groupBy("prefix").applyInArrow(_merger(n, 63 - bits), self.schema).write.mode("overwrite").parquet(f"{self.home}/{name}")
        kept = [r for r in manifest["runs"] if r not in old]
        manifest = manifest | {"bits": bits, "merges": manifest["merges"] + 1, "runs": [*kept, {"name": name, "tier": 1 + max((r["tier"] for r in old), default=0)}]}
        self._publish(manifest)
        return manifest

    def repeated(self) -> DataFrame:
        """The identifiers of which a copy was refused, in any batch, each once."""
        return self._pairs(list(self._manifest()["batches"].values()), "again").distinct()

    def novel(self, run: str) -> DataFrame:
        """The identifiers that the batch of ``run`` brought for the first time."""
        return self._pairs([run], "k")

    def kept(self, messages: DataFrame, run: str) -> DataFrame:
        """The rows of the batch of ``run`` to hand on: one of each novel message, and those without an identifier."""
        one = first_copies(messages, self.identifier)
        known = self.novel(run)
        whole = F.lit(True)
        for c in self.identifier:
            whole &= F.col(f"`{c}`").isNotNull()
        return one.join(known, self.identifier, "left_semi").unionByName(one.where(~whole))

    def _pairs(self, runs: Sequence[str], what: str) -> DataFrame:
        columns = [f"{what}{i}" for i in range(len(self.identifier))]
        pairs = self._read(runs).select(F.explode(F.arrays_zip(*columns)).alias("x"))
        return pairs.select(*[F.col(f"x.{c}").alias(name) for c, name in zip(columns, self.identifier)])


def first_copies(messages: DataFrame, identifier: Sequence[str]) -> DataFrame:
    """One row of each message: the one with the fewest nulls, then the greatest by its values.

    Rows with a null identifier are kept as they are.  The choice is an aggregate, so a message with
    very many copies is reduced before the shuffle.
    """
    rest = [c for c in messages.columns if c not in identifier]
    filled = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in rest), F.lit(0))
    whole = F.lit(True)
    for c in identifier:
        whole &= F.col(f"`{c}`").isNotNull()
    # Fields are named by position: the messages may have columns of any name.
    row = F.struct(filled.alias("n"), *[F.col(f"`{c}`").alias(f"r{i}") for i, c in enumerate(rest)])
    best = messages.where(whole).groupBy(*[F.col(f"`{c}`").alias(f"i{k}") for k, c in enumerate(identifier)]).agg(F.max(row).alias("best"))
    at = {c: f"i{k}" for k, c in enumerate(identifier)} | {c: f"best.r{i}" for i, c in enumerate(rest)}
    return best.select(*[F.col(at[c]).alias(c) for c in messages.columns]).unionByName(messages.where(~whole))
