"""Mixing sources to target weights, by entropy balancing.

Documents of a source get copies at a rate exp(lambda * x), x being their tokens over the mean of the
source, cut off at the largest number of repeats.  The lambda of each (mix, source) solves the convex
dual of the token constraint: distributed Newton steps over the histogram (source, tokens) -> documents,
which is exact and is the only thing that is read again and again.  A step that leaves the bracket known
to hold the solution is replaced by halving, and each step looks at a few more points to narrow it.  The
steps end when the tokens are within ``CLOSE_ENOUGH`` of the target, or when no number lies between the
ends of the bracket, which ``converged`` then denies.
Rates are rounded to copies batch by batch in order of size, by a running sum of the fractions, which
starts where the tokens still owed by the batches before ask for.

The target of a source is its weight over the weights of the mix, times the tokens of all documents.
Where even ``max_repeats`` copies of everything fall short, the dual has no bound: all documents get
``max_repeats`` copies and the source is reported as out of reach.

Defined results: sources are compared trimmed and in lower case; documents of a null source count for
the total but belong to no source.  Targets with a null mix, source or weight are ignored, a null
``max_repeats`` counts as 1; targets of one source in a mix are added.  A source without documents has
0 tokens.  Documents without tokens get no copies.  The targets are a parameter table: one row per
(mix, source) is held by the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOSE_ENOUGH = 1e-7
#: The most rows of a few numbers that are sent to every task.
SENT = 10_000
STATE = "mix_id int, source string, share double, target double, cap int, available bigint, reachable boolean, converged boolean, rate_lambda double, mean double"


def plain_source(source: Column) -> Column:
    return F.lower(F.regexp_replace(source, r"^\s+|\s+$", ""))


def histogram(sizes: DataFrame) -> DataFrame:
    """(source, n_tokens, n) of (doc_id, source, n_tokens)."""
    return sizes.where("source IS NOT NULL AND n_tokens > 0").groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n"))


def _to_all(rows: DataFrame, n: int) -> DataFrame:
    """Rows made of the targets, sent to every task if they are few; otherwise Spark is left to join them as it sees fit."""
    return F.broadcast(rows) if n <= SENT else rows


def _points(state: dict) -> list[float]:
    """Where a step evaluates the dual: at the Newton point, and around it to narrow the bracket in the same pass."""
    at, low, high = state["at"], state["low"], state["high"]
    far = 2 * abs(at) + 1
    a, b = low if math.isfinite(low) else min(at - far, high), high if math.isfinite(high) else max(at + far, low)
    more = [a + (b - a) * k / 4 for k in (1, 2, 3)] if math.isfinite(low) and math.isfinite(high) else [a, b]
    return sorted({at, *[p for p in more if low < p < high]})


def balance(sizes: DataFrame, targets: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per (mix, source) with its target, whether it can be reached, and lambda (null: at the cap)."""
    spark = sizes.sparkSession
    wanted = targets.select("mix_id", plain_source(F.col("source")).alias("source"), "weight", F.coalesce("max_repeats", F.lit(1)).alias("cap")).dropna()
    wanted = wanted.groupBy("mix_id", "source").agg(F.sum("weight").alias("weight"), F.max("cap").alias("cap"))
    whole = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total")).first()["total"]
    have = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("available"), F.sum("n").alias("documents"))
    rows = wanted.join(have, "source", "left").orderBy("mix_id", "source").collect()
    sums: dict[int, float] = {}
    for r in rows:
        sums[r["mix_id"]] = sums.get(r["mix_id"], 0.0) + r["weight"]
    state = []
    for r in rows:
        available, share = r["available"] or 0, r["weight"] / sums[r["mix_id"]] if sums[r["mix_id"]] else 0.0
        target = share * whole
        state.append({"mix_id": r["mix_id"], "source": r["source"], "share": share, "target": target, "cap": r["cap"], "available": available, "mean": available / r["documents"] if r["documents"] else 1.0, "low": -math.inf, "high": math.inf, "at": 0.0, "done": target <= 0, "full": False, "stuck": False})
        if not available and target > 0:  # nothing to tilt
            state[-1] |= {"done": True, "full": True}
    while left := [s for s in state if not s["done"]]:
        points = [(s["mix_id"], s["source"], float(at), float(s["cap"]), float(s["mean"])) for s in left for at in _points(s)]
        guess = spark.createDataFrame(points, "mix_id int, source string, at double, cap double, mean double")
        x = F.col("n_tokens") / F.col("mean")
        tilt = F.exp(F.least(F.col("at") * x, F.lit(50.0)))
        tokens = F.col("n") * F.col("n_tokens")
        # Gradient and curvature of the dual at lambda, and the limit of the gradient's first term for lambda to infinity.
        parts = [F.sum(tokens * F.least(tilt, "cap")).alias("value"), F.sum(F.when(tilt < F.col("cap"), tokens * tilt * x).otherwise(0.0)).alias("slope"), F.sum(tokens * F.col("cap")).alias("ceiling")]
        found: dict[tuple[int, str], list] = {}
        for r in counts.join(_to_all(guess, len(points)), "source").groupBy("mix_id", "source", "at").agg(*parts).collect():
            found.setdefault((r["mix_id"], r["source"]), []).append(r)
        for s in left:
            rows = found[s["mix_id"], s["source"]]
            best = min(rows, key=lambda r: (abs(r["value"] - s["target"]), abs(r["at"])))
            gap, s["at"] = best["value"] - s["target"], best["at"]
            if best["ceiling"] <= s["target"]:  # the dual rises for ever
                s["done"] = s["full"] = True
            elif abs(gap) <= CLOSE_ENOUGH * s["target"]:
                s["done"] = True
            else:
                for r in rows:  # the tokens grow with lambda
                    side, pick = ("low", max) if r["value"] < s["target"] else ("high", min)
                    s[side] = pick(s[side], r["at"])
                step = best["at"] - gap / best["slope"] if best["slope"] > 0 else math.nan
                far = 2 * abs(best["at"]) + 1
                if s["low"] < step < s["high"] and abs(step) <= 4 * far:
                    s["at"] = step
                elif math.isinf(s["high"]) or math.isinf(s["low"]):
                    s["at"] = far if gap < 0 else -far
                else:
                    s["at"] = (s["low"] + s["high"]) / 2
                    s["done"] = s["stuck"] = s["at"] in (s["low"], s["high"])
    out = []
    for s in state:
        # The exact test of those whose dual has no bound.
        short = s["full"] and s["available"] * s["cap"] < s["target"]
        out.append((s["mix_id"], s["source"], s["share"], s["target"], s["cap"], s["available"], not short, not s["stuck"], None if s["full"] else float(s["at"]), float(s["mean"])))
    return spark.createDataFrame(out, STATE)


def copies(sizes: DataFrame, state: DataFrame) -> DataFrame:
    """(mix_id, doc_id, source, n_tokens, copies) of the documents with at least one copy."""
    used = _to_all(state.where("target > 0").select("mix_id", "source", "cap", "rate_lambda", "mean"), state.count())
    tilt = F.exp(F.least(F.col("rate_lambda") * F.col("n_tokens") / F.col("mean"), F.lit(50.0)))
    rate = F.when(F.col("rate_lambda").isNull(), F.col("cap").cast("double")).otherwise(F.least(tilt, "cap"))
    rated = sizes.where("n_tokens > 0").join(used, "source").select("mix_id", "doc_id", "source", "n_tokens", rate.alias("rate"), "cap")
    kind = rated.schema["doc_id"].dataType.simpleString()

    def round_rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owed: dict[tuple[int, str], float] = {}
        random = np.random.default_rng(TaskContext.get().partitionId())
        for batch in batches:
            size, rate = np.asarray(batch["n_tokens"]).astype(np.float64), np.asarray(batch["rate"])
            low = np.floor(rate)
            part = rate - low
            kind = np.asarray(batch["mix_id"]).astype(np.int64) * (1 << 32) + np.asarray(batch["source"].dictionary_encode().indices)
            order = np.lexsort((size, kind))
            firsts = np.flatnonzero(np.diff(kind[order], prepend=kind[order][:1] - 1)) if len(order) else np.empty(0, np.int64)
            up = np.zeros(len(order))
            for a, b in zip(firsts, [*firsts[1:], len(order)]):  # one turn per mix and source
                rows = order[a:b]
                at = (batch["mix_id"][int(rows[0])].as_py(), batch["source"][int(rows[0])].as_py())
                # Tasks must not all round their first documents alike; later batches make up for what is owed.
                begin = min(max(0.5 + owed[at] / max(size[rows].mean(), 1.0), 0.0), 1 - 1e-9) if at in owed else random.random()
                sums = np.floor(begin + np.cumsum(part[rows]))
                up[rows] = np.diff(sums, prepend=0.0)
                owed[at] = owed.get(at, 0.0) + float(((part - up)[rows] * size[rows]).sum())
            copies = pa.array((low + up).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("mix_id", "doc_id", "source", "n_tokens")], copies], ["mix_id", "doc_id", "source", "n_tokens", "copies"])

    return rated.mapInArrow(round_rates, f"mix_id int, doc_id {kind}, source string, n_tokens bigint, copies int").where("copies > 0")


def shares(state: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per (mix, source) the share wanted, the tokens and share reached, and whether the target could be reached."""
    got = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"))
    whole = chosen.groupBy("mix_id").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"))
    out = state.join(got, ["mix_id", "source"], "left").join(whole, "mix_id", "left")
    tokens = F.coalesce("tokens", F.lit(0).cast("bigint"))
    return out.select("mix_id", "source", "share", "target", "available", tokens.alias("tokens"), F.coalesce(tokens / F.col("mix_tokens"), F.lit(0.0)).alias("reached_share"), F.coalesce("n_copies", F.lit(0).cast("bigint")).alias("n_copies"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "reachable", "converged")
