"""Filling fixed-capacity containers with items, by bounded-space online packing.

Each task keeps a fixed number of open windows per capacity, places an item where it leaves the least
space (best fit), and emits the fullest window when none fits.  What is still open at the end of the
tasks is merged: the windows of 16 tasks are packed as items themselves, by one group, which again
leaves at most as many open windows as one task, and so on until one group is left.  A group thus has
at most 16 x windows items, whatever the number of tasks, and nothing is shuffled but leftovers.

A text longer than the capacity is divided first: as many tokens as fit, cut at the strongest pause in
the last sixteenth, never within a character.  No other text is divided.  Every part is counted by
itself, as a cut can change how the text around it is split into tokens; it is placed and reported by
that size.

Defined results: an empty or null text has size 0 and goes into a container like any other.  Equal
rows are packed each.  Empty tables give no containers.  A single character of more tokens than the
capacity stays whole, in a container of its own that it exceeds.  Container ids are unique per capacity
and depend on how the input is split; the contents of a container are in order of placement.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.cuts import Text
from siltstone.llm.tokens import default_pattern, default_vocabulary, texts_of, tokenizer
from siltstone.session import written

WINDOWS = 64
MERGE_BY = 16


class Windows:
    """The open windows of one capacity in one task."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free: list[tuple[int, int]] = []  # (space left, container), sorted
        self.full: list[int] = []
        self.next = 0

    def place(self, size: int) -> int:
        """The container for an item of ``size``; containers that can take no more are moved to ``full``."""
        at = bisect_left(self.free, (size, -1))
        if at < len(self.free):
            space, container = self.free.pop(at)
        else:
            if len(self.free) >= self.most:
                self.full.append(self.free.pop(0)[1])
            space, container, self.next = self.capacity, self.next, self.next + 1
        if space > size:
            insort(self.free, (space - size, container))
        else:
            self.full.append(container)
        return container


def divide(text: Text, capacity: int) -> list[tuple[int, int, int]]:
    """(first, end, own size) of the parts of a text that is longer than the capacity; first and end are its tokens."""
    out, a = [], 0
    while a < text.n:
        b = text.n
        if b - a > capacity:
            cut = text.best(max(a + 1, a + capacity - capacity // 16), a + capacity, a + capacity)
            b = text.back(a + capacity) if cut is None else cut
        size = text.coder.count(text.piece(a, b)) if b > a else 0
        while b > a and size > capacity:  # by itself it has more tokens than within the text
            b = text.back(b - 1)
            size = text.coder.count(text.piece(a, b)) if b > a else 0
        if b <= a:  # one character of more tokens than fit
            b = next(i for i in range(a + 1, text.n + 1) if text.strength[i] >= 0)
            size = text.coder.count(text.piece(a, b))
        out.append((a, b, size))
        a = b
    return out


def pack(documents: DataFrame, key: str, text: str, capacities: Sequence[int], windows: int = WINDOWS, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(max_tokens, container_id, key, part_no, n_parts, first_char, n_chars, n_tokens): where each document went."""
    vocabulary, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()
    taken = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = taken.schema["key"].dataType.simpleString()
    names = ["max_tokens", "container_id", "key", "part_no", "n_parts", "first_char", "n_chars", "n_tokens"]
    schema = f"max_tokens int, container_id bigint, key {kind}, part_no int, n_parts int, first_char int, n_chars int, n_tokens int, open boolean"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(vocabulary, pattern)
        open_windows = {c: Windows(c, windows) for c in capacities}
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for i, value in enumerate(texts_of(batch, "text")):
                n, whole = coder.count(value), None
                for capacity, window in open_windows.items():
                    if n <= capacity:
                        rows.append((capacity, base + window.place(n), i, 0, 1, 0, len(value or ""), n))
                        continue
                    whole = whole or Text(value, coder)
                    parts = divide(whole, capacity)
                    for k, (a, b, size) in enumerate(parts):
                        rows.append((capacity, base + window.place(size), i, k, len(parts), *whole.chars(a, b), size))
            if rows:
                c = [*zip(*rows)]
                columns = [pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()), batch["key"].take(pa.array(c[2], pa.int64())), *[pa.array(x, pa.int32()) for x in c[3:]]]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(rows), pa.bool_())], [*names, "open"])
        for capacity, window in open_windows.items():
            left = [(base + container, capacity - space) for space, container in window.free]
            if left:
                ids, sizes = zip(*left)
                n = len(left)
                blank = pa.nulls(n, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([capacity] * n, pa.int32()), pa.array(ids, pa.int64()), pa.nulls(n, batch_type(kind)), blank, blank, blank, blank, pa.array(sizes, pa.int32()), pa.array([True] * n)], [*names, "open"])

    placed = written(taken.mapInArrow(place, schema), "packing")
    moved = merge_open(placed.where("open").select("max_tokens", "container_id", "n_tokens"), windows)
    items = placed.where("open IS NULL").drop("open").join(moved, ["max_tokens", "container_id"], "left")
    return items.select("max_tokens", F.coalesce("into_id", "container_id").alias("container_id"), F.col("key").alias(key), *names[3:])


def batch_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def _merger(windows: int):
    """Pack the leftovers of a few tasks: (max_tokens, group), (container_id, n_tokens) -> where each went."""

    def merge(key: tuple, left: pa.Table) -> pa.Table:
        capacity = key[0].as_py()
        # Large leftovers first: with few windows that wastes least.
        left = left.sort_by([("n_tokens", "descending"), ("container_id", "ascending")])
        ids, sizes = left["container_id"].to_pylist(), left["n_tokens"].to_pylist()
        open_windows = Windows(capacity, windows)
        names: dict[int, int] = {}  # the first item of a container gives it its id
        into = [names.setdefault(open_windows.place(min(s, capacity)), i) for s, i in zip(sizes, ids)]
        still = {names[container]: capacity - space for space, container in open_windows.free}
        n = len(ids)
        # The size of an open container stands once, with the item that names it.
        kept = [still.get(i) if i == t else None for i, t in zip(ids, into)]
        return pa.Table.from_arrays([pa.array([capacity] * n, pa.int32()), pa.array(ids, pa.int64()), pa.array(into, pa.int64()), pa.array(kept, pa.int32())], ["max_tokens", "container_id", "into_id", "n_open"])

    return merge


def merge_open(leftovers: DataFrame, windows: int) -> DataFrame:
    """(max_tokens, container_id, into_id) of the leftover windows; the task that left one is in the upper bits of its id.

    What is no longer open after a level has its place; only what is open goes on to the next.
    """
    schema = "max_tokens int, container_id bigint, into_id bigint, n_open int"
    tasks = (leftovers.agg(F.max(F.shiftrightunsigned("container_id", 40))).first()[0] or 0) + 1
    current, state, step = leftovers, None, 1
    while state is None or tasks > step:
        step *= MERGE_BY
        group = F.floor(F.shiftrightunsigned("container_id", 40) / step).alias("group")
        moves = written(current.groupBy("max_tokens", group).applyInArrow(_merger(windows), schema), "packing-open")
        if state is None:
            state = moves.select("max_tokens", "container_id", "into_id")
        else:
            to = moves.select("max_tokens", F.col("container_id").alias("into_id"), F.col("into_id").alias("further"))
            state = written(state.join(to, ["max_tokens", "into_id"], "left").select("max_tokens", "container_id", F.coalesce("further", "into_id").alias("into_id")), "packing-moves")
        current = moves.where("n_open IS NOT NULL").select("max_tokens", "container_id", F.col("n_open").alias("n_tokens"))
    return state


def containers(items: DataFrame) -> DataFrame:
    """(max_tokens, container_id, n_items, n_tokens, unused)."""
    return items.groupBy("max_tokens", "container_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("n_tokens")).withColumn("unused", F.col("max_tokens") - F.col("n_tokens"))
