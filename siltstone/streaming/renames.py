"""Matching renames in a stream of journal records, with the history as state.

Without a limit the history is kept per file: the oldest entry only, unless entries are trimmed.  A
limited history is global to a journal and depends on the read buffers, so it is kept per journal; its
state is bounded by the limit, and one journal is handled by one task at a time.

State needs a state store for ``transformWithState``; ``use_state_store`` selects it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siltstone.operators.journal import HISTORY, NEW_NAME

ENTRY = "usn bigint, kind string, id binary, path string"
OUTPUT = "journal string, usn bigint, kind string, id binary, path string, renamed_from string"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class RenameMatcher(StatefulProcessor):
    """``most`` entries of history are kept per key, 0 for all; ``trim`` forgets entries up to a usn."""

    def __init__(self, most: int = 0, trim: int | None = None):
        self.most, self.trim = most, trim

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.history = handle.getListState("history", ENTRY)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timer_values: Any) -> Iterator[Row]:
        entries = [tuple(e) for e in self.history.get()]
        known = len(entries)
        changed = False
        by_buffer: dict[int, list[Row]] = {}
        for row in sorted(rows, key=lambda r: (r["seq"], r["usn"])):
            by_buffer.setdefault(row["seq"], []).append(row)
        for buffer in by_buffer.values():
            for row in buffer:  # all of a buffer is remembered first
                if row["reason"] & HISTORY and (self.trim is None or row["usn"] > self.trim):
                    if not self.most and self.trim is None and entries and entries[0][0] <= row["usn"]:
                        continue  # of one file only the oldest entry can ever match
                    entry = (row["usn"], row["kind"], bytes(row["id"]), row["path"])
                    entries = [entry] if not self.most and self.trim is None else [*entries, entry]
                    if self.most:
                        entries = entries[-self.most :]
                    changed = True
            for row in buffer:
                if row["reason"] & NEW_NAME:
                    hit = next((e for e in entries if (e[1], bytes(e[2])) == (row["kind"], bytes(row["id"])) and e[0] < row["usn"]), None)
                    yield Row(journal=row["journal"], usn=row["usn"], kind=row["kind"], id=bytes(row["id"]), path=row["path"], renamed_from=hit[3] if hit else None)
        if changed or len(entries) != known:
            self.history.put(entries)

    def close(self) -> None:
        pass


def match_renames(records: DataFrame, most: int = 0, trim: int | None = None) -> DataFrame:
    """Streamed (journal, seq, usn, file_id, reason, path) -> (journal, usn, kind, id, path, renamed_from)."""
    flat = records.select("journal", "seq", "usn", F.col("file_id.kind").alias("kind"), F.col("file_id.id").alias("id"), "reason", "path")
    relevant = flat.where(F.col("reason").bitwiseAND(F.lit(HISTORY | NEW_NAME)) != 0)
    key = ["journal"] if most else ["journal", "kind", "id"]
    return relevant.groupBy(*key).transformWithState(statefulProcessor=RenameMatcher(most, trim), outputStructType=OUTPUT, outputMode="Append", timeMode="None")
