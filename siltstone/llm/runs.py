"""Repeated consecutive events in sequences: each stretch becomes one row with count and duration.

Events are made unique, range-partitioned by entity and order and sorted, so that one entity may
spread over many tasks.  Within a task every event becomes a Unicode code point (its canonical symbol;
the lowest bit flips wherever two neighbours do not belong together), the code points of a batch are
joined to a string, and a backreference pattern finds the repetitions; match spans are indices into
the events.  Stretches at the edge of a task are put together afterwards: at most two rows a task.

Defined results: two neighbours belong together if both have a symbol and a time, the symbols are
equal and the times differ by at most ``gap``; an event without a symbol or time stands alone (and
where ``least`` is 1 is reported with a 0 for what it lacks).  Rows with a null entity or order are ignored.  Copies
(equal entity and order) count once; where they disagree, the smallest symbol and time count.  Empty
tables give an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import written

#: First code point of the symbols: above the surrogates and all controls.
FIRST = 0x10000
COLUMNS = ("first", "last", "n", "t_first", "t_last", "symbol")


def _text(codes: np.ndarray, parity: np.ndarray) -> str:
    return (FIRST + 2 * codes + parity).astype("<u4").tobytes().decode("utf-32-le")


def _scanner(n_entity: int, gap: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    repeats = re.compile(r"(.)\1{%d,}" % (least - 1) if least > 1 else r"(.)\1*")
    start = re.compile(r"(.)\1*")
    names = [f"e{i}" for i in range(n_entity)]

    def batch_of(rows: list[tuple[np.ndarray, ...]], heads: list[bool], tails: list[bool]) -> pa.RecordBatch:
        whole = np.array(rows, np.int64).reshape(-1, n_entity + len(COLUMNS))
        columns = [pa.array(whole[:, i]) for i in range(whole.shape[1])]
        return pa.RecordBatch.from_arrays([*columns, pa.array(heads, pa.bool_()), pa.array(tails, pa.bool_())], [*names, *COLUMNS, "head", "tail"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] | None = None  # the stretch that is open at the end of the batch before
        held_ok = held_head = False
        for batch in batches:
            entity = [np.asarray(batch[i]) for i in range(n_entity)]
            order = np.asarray(batch[n_entity])
            valid = np.asarray(batch["ticks"].is_valid()) & np.asarray(batch["symbol"].is_valid())
            ticks = np.asarray(batch["ticks"].fill_null(0))
            symbol = np.asarray(batch["symbol"].fill_null(0))
            if not len(order):
                continue
            new = np.empty(len(order), bool)
            new[0] = held is None or [int(e[0]) for e in entity] != held[:n_entity] or int(order[0]) != held[n_entity + 1]
            new[1:] = order[1:] != order[:-1]
            for e in entity:
                new[1:] |= e[1:] != e[:-1]
            if not new.all():
                entity, order, ticks, symbol, valid = [e[new] for e in entity], order[new], ticks[new], symbol[new], valid[new]
            if not len(order):
                continue
            together = valid[1:] & valid[:-1] & (symbol[1:] == symbol[:-1]) & (np.abs(ticks[1:] - ticks[:-1]) <= gap)
            for e in entity:
                together &= e[1:] == e[:-1]
            _, codes = np.unique(symbol, return_inverse=True)
            text = _text(codes, np.concatenate([[0], np.cumsum(~together) & 1]))
            first_end = start.match(text).end()
            last_start = int(np.flatnonzero(~together)[-1]) + 1 if not together.all() else 0

            def row(a: int, b: int) -> list[int]:
                return [*(int(e[a]) for e in entity), int(order[a]), int(order[b - 1]), b - a, int(ticks[a]), int(ticks[b - 1]), int(symbol[a])]

            out, heads = [], []
            lead = row(0, first_end)
            lead_head = held is None and bool(valid[0])
            if held is not None:
                joins = held_ok and valid[0] and held[:n_entity] == lead[:n_entity] and held[-1] == lead[-1] and abs(lead[n_entity + 3] - held[n_entity + 4]) <= gap
                if joins:
                    lead = [*held[: n_entity + 1], lead[n_entity + 1], held[n_entity + 2] + lead[n_entity + 2], held[n_entity + 3], *lead[n_entity + 4 :]]
                    lead_head = held_head
                elif held[n_entity + 2] >= least or held_head:
                    out.append(held)
                    heads.append(held_head)
            if first_end < len(order):
                if lead[n_entity + 2] >= least or lead_head:
                    out.append(lead)
                    heads.append(lead_head)
                for m in repeats.finditer(text, first_end):
                    if m.start() < last_start:
                        out.append(row(*m.span()))
                        heads.append(False)
                held, held_head = row(last_start, len(order)), False
            else:
                held, held_head = lead, lead_head
            held_ok = bool(valid[-1])
            if out:
                yield batch_of(out, heads, [False] * len(out))
        if held is not None:
            yield batch_of([held], [held_head], [held_ok])

    return scan


def stretches(events: DataFrame, entity: Sequence[str], order: str, ticks: str, symbol: Column, gap: int, least: int) -> DataFrame:
    """(entity..., first_, last_ of ``order``, n_events, duration, symbol) of each longest stretch of at least ``least`` events.

    ``duration`` is the time of the last event minus that of the first; it is negative where a clock
    was put back.  Entity, order, time and symbol are integers.
    """
    names = [f"e{i}" for i in range(len(entity))]
    plain = events.select(*[F.col(c).cast("bigint").alias(n) for c, n in zip(entity, names)], F.col(order).cast("bigint").alias("o"), F.col(ticks).cast("bigint").alias("ticks"), symbol.cast("bigint").alias("symbol"))
    unique = plain.dropna(subset=[*names, "o"]).distinct()
    ordered = unique.repartitionByRange(*names, "o").sortWithinPartitions(*names, "o", F.asc_nulls_last("symbol"), F.asc_nulls_last("ticks"))
    schema = ", ".join([*[f"{n} bigint" for n in (*names, *COLUMNS)], "head boolean", "tail boolean"])
    parts = written(ordered.mapInArrow(_scanner(len(entity), gap, least), schema), "stretches")
    whole = parts.where("NOT head AND NOT tail").select(*names, *COLUMNS)
    w = Window.partitionBy(*names).orderBy("first")
    before = {c: F.lag(c).over(w) for c in ("tail", "symbol", "t_last")}
    edges = parts.where("head OR tail")
    fits = F.coalesce(F.col("head") & before["tail"] & (before["symbol"] == F.col("symbol")) & (F.abs(F.col("t_first") - before["t_last"]) <= gap), F.lit(False))
    grouped = edges.withColumn("begins", F.when(fits, 0).otherwise(1)).withColumn("g", F.sum("begins").over(w))
    joined = grouped.groupBy(*names, "g").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), F.min_by("t_first", "first").alias("t_first"), F.max_by("t_last", "last").alias("t_last"), F.max("symbol").alias("symbol"))
    every = whole.unionByName(joined.select(*names, *COLUMNS)).where(F.col("n") >= least)
    return every.select(*[F.col(n).alias(c) for n, c in zip(names, entity)], F.col("first").alias(f"first_{order}"), F.col("last").alias(f"last_{order}"), F.col("n").alias("n_events"), (F.col("t_last") - F.col("t_first")).alias("duration"), "symbol")
