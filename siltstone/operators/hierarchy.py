"""Parent-child links to full hierarchies, as nested sets.

Subtree sizes are summed upward, sibling ranges are allotted by prefix sums and carried downward.  Only
nodes that have children take part in that; the leaves are one aggregation and one ranking.  What the
upward pass leaves unprocessed is in or below a circle.

A tree of at most ``LOCAL`` inner nodes is swept by one task, level by level, beside all other such
trees.  A larger one is swept by all tasks: both passes double the distance they cover in each written
round (a node knows its ancestor 1, 2, 4, ... steps up), so that a depth d takes log2(d) rounds; a round
carries and writes only the nodes that have not reached their root, and one that brings no further
node to a root ends the pass.  Both ways give the same numbers.

Sibling ranks are counted within range partitions, with the sums of the partitions before added, so a
parent with a third of all rows is spread over many tasks, whatever its numbers look like.

Defined results: a null tree or node is ignored.  A node whose parent is null, absent or the node of
``ends`` is a root or hangs from one; a node that is its own parent is a circle unless it is in
``ends``.  Repeated links change nothing; of several parents the greatest counts in ``nested_sets``,
while ``endless`` follows all of them.  Extra columns are ignored.  Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import forest
from siltstone.operators.prefix import before
from siltstone.session import read_tables, write_table, written

LOCAL = 1 << 18
#: The most characters that the paths of such a tree may have in all; otherwise it is swept like a larger one.
MOST_TEXT = 1 << 28
#: A range of a nested set is cut into cells of 16 ** level numbers.
RADIX_BITS = 4

RANGES = "tree bigint, node bigint, parent bigint, size bigint, lft bigint, depth bigint, root bigint, path string"


def _local(with_path: bool, most_text: int):
    """Nested sets of one tree: (tree, node, parent, name, own) -> RANGES; paths are null if they have too many characters."""

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        node = np.asarray(rows["node"].combine_chunks())
        has = np.asarray(rows["parent"].combine_chunks().is_valid())
        up = forest.parent_index(node, np.asarray(rows["parent"].combine_chunks().fill_null(0)), has)
        depth = forest.depths(up)
        size = forest.subtree_sums(up, depth, np.asarray(rows["own"].combine_chunks()))
        step = forest.before_siblings(up, size) + (up >= 0)
        lft, root = forest.down(up, depth, step), forest.roots(up, depth)
        kept = np.flatnonzero(depth >= 0)
        lengths = np.asarray(pc.utf8_length(rows["name"]).combine_chunks()).astype(np.int64) if with_path else np.zeros(len(node), np.int64)
        if forest.down(up, depth, lengths)[kept].sum() > most_text:
            path = pa.nulls(len(kept), pa.string())
        elif with_path:
            own = np.empty(len(node), object)
            own[:] = rows["name"].to_pylist()
            path = pa.array(forest.down(up, depth, own)[kept], pa.large_string()).cast(pa.string())
        else:
            path = pa.array([""] * len(kept), pa.string())
        columns = [pa.array(np.full(len(kept), key[0].as_py())), *[pa.array(x[kept]) for x in (node,)], rows["parent"].combine_chunks().take(pa.array(kept)), *[pa.array(x[kept]) for x in (size, lft, depth)], pa.array(node[root[kept]]), path]
        return pa.Table.from_arrays(columns, ["tree", "node", "parent", "size", "lft", "depth", "root", "path"])

    return place


def _sweep_up(start: DataFrame) -> DataFrame:
    """(tree, node, size) of the nodes that reach a root, from (tree, node, parent, own).

    An open node adds its size to the node it jumps to, then takes over that one's jump.  What goes to
    a node that has ended already is written beside it and added up at the end.
    """
    begun = start.select("tree", "node", F.col("parent").alias("jump"), F.col("own").alias("size"), F.col("parent").isNotNull().alias("open"))
    paths = [write_table(begun, "tree-sizes")]
    latest = read_tables(begun, paths)
    left = latest.where("open").count()
    while left:
        now = latest.where("open")
        up = now.select("tree", F.col("node").alias("jump"), F.col("jump").alias("next"))
        reached = now.groupBy("tree", F.col("jump").alias("node")).agg(F.sum("size").alias("more"))
        step = now.join(up, ["tree", "jump"], "left").join(reached, ["tree", "node"], "full_outer")
        paths.append(write_table(step.select("tree", "node", F.col("next").alias("jump"), (F.coalesce("size", F.lit(0).cast("bigint")) + F.coalesce("more", F.lit(0).cast("bigint"))).alias("size"), F.col("next").isNotNull().alias("open")), "tree-sizes"))
        latest = read_tables(begun, paths[-1:])
        still = latest.where("open").count()
        if still == left:  # depths have no gaps: who has not ended by now never will
            break
        left = still
    return read_tables(begun, paths).where("NOT open").groupBy("tree", "node").agg(F.sum("size").alias("size"))


def _sweep_down(start: DataFrame) -> DataFrame:
    """(tree, node, lft, depth, root, path): folded from the root down, from rows with the columns jump, lft, depth, root and path."""
    start = start.withColumn("round", F.lit(0))
    paths = [write_table(start, "tree-ranges")]
    while not (latest := read_tables(start, paths[-1:]).where("jump IS NOT NULL")).isEmpty():
        known = read_tables(start, paths).where(F.col("jump").isNull() | (F.col("round") == len(paths) - 1))
        up = known.select("tree", F.col("node").alias("jump"), F.col("jump").alias("next"), *[F.col(c).alias(f"up_{c}") for c in ("lft", "depth", "root", "path")])
        folded = {c: F.col(c) + F.col(f"up_{c}") for c in ("lft", "depth")} | {"root": F.col("up_root"), "path": F.concat("up_path", "path")}
        moved = latest.join(up, ["tree", "jump"]).select("tree", "node", F.col("next").alias("jump"), *[v.alias(c) for c, v in folded.items()], F.lit(len(paths)).alias("round"))
        paths.append(write_table(moved.select(*start.columns), "tree-ranges"))
    return read_tables(start, paths).where("jump IS NULL").select("tree", "node", "lft", "depth", "root", "path")


def _swept(start: DataFrame) -> DataFrame:
    """Nested sets of large trees, swept by all tasks: (tree, node, parent, name, own) -> RANGES."""
    start = written(start, "tree-large")
    sized = start.join(_sweep_up(start), ["tree", "node"])
    placed = before(sized, ["tree", "parent"], "node", "size", "before", "tree-siblings")
    placed = written(placed, "tree-placed")
    step = F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint")
    begun = placed.select("tree", "node", F.col("parent").alias("jump"), (F.col("before") + step).alias("lft"), step.alias("depth"), F.col("node").alias("root"), F.col("name").alias("path"))
    return placed.select("tree", "node", "parent", "size").join(_sweep_down(begun), ["tree", "node"]).select("tree", "node", "parent", "size", "lft", "depth", "root", "path")


def _ranges(inner: DataFrame, with_path: bool) -> DataFrame:
    """The nested-set ranges of the inner nodes (tree, node, parent, name, own), written; those of circles are left out.

    ``own`` is 1 and the number of leaves of a node.  Children are laid out inner nodes first, then leaves.
    """
    large = inner.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LOCAL).select("tree")
    place = _local(with_path, MOST_TEXT)
    if large.isEmpty():
        ranges = written(inner.groupBy("tree").applyInArrow(place, RANGES), "tree-ranges")
    else:
        small = inner.join(large, "tree", "left_anti").groupBy("tree").applyInArrow(place, RANGES)
        ranges = written(small.unionByName(_swept(inner.join(large, "tree", "left_semi"))), "tree-ranges")
    wordy = ranges.where("path IS NULL").select("tree").distinct()
    if not with_path or wordy.isEmpty():
        return ranges
    wordy = written(wordy, "tree-wordy")
    return written(ranges.join(wordy, "tree", "left_anti").unionByName(_swept(inner.join(wordy, "tree", "left_semi"))), "tree-ranges")


def _links(links: DataFrame, tree: str, node: str, parent: str, ends: DataFrame | None, name: Column | None = None) -> DataFrame:
    """(tree, node, parent, name) of the links, without nodes that end a path and with null for a parent that does."""
    name = F.lit("") if name is None else F.coalesce(name, F.lit(""))
    out = links.select(F.col(tree).cast("bigint").alias("tree"), F.col(node).cast("bigint").alias("node"), F.col(parent).cast("bigint").alias("parent"), name.alias("name")).where("tree IS NOT NULL AND node IS NOT NULL")
    if ends is None:
        return out
    stop = ends.select(F.col(tree).cast("bigint").alias("tree"), F.col(node).cast("bigint").alias("node")).dropna().distinct()
    out = out.join(stop, ["tree", "node"], "left_anti")
    at = stop.select("tree", F.col("node").alias("parent"), F.lit(1).alias("ends"))
    return out.join(at, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("ends").isNull(), F.col("parent")).alias("parent"), "name")


def _inner(plain: DataFrame) -> DataFrame:
    """The rows of the nodes that are the parent of another; a parent that is no node becomes null."""
    parents = plain.where("parent IS NOT NULL").select("tree", F.col("parent").alias("node")).distinct()
    own = plain.join(parents, ["tree", "node"], "left_semi")
    there = own.select("tree", F.col("node").alias("parent"), F.lit(1).alias("there")).distinct()
    return own.join(there, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("there") == 1, F.col("parent")).alias("parent"), "name")


def nested_sets(links: DataFrame, tree: str, node: str, parent: str, name: Column | None = None, ends: DataFrame | None = None) -> DataFrame:
    """For each node: parent, root, depth, path, lft, rgt and n_below; nulls but the parent where the links never end.

    The nodes below a node are those of its tree with lft in (lft, rgt]; its ancestors those whose
    range holds its lft.  The path is the concatenation of ``name`` from the root down.  ``ends`` are
    not nodes themselves: what hangs from them are roots.
    """
    one = _links(links, tree, node, parent, ends, name).groupBy("tree", "node").agg(F.max(F.struct("parent", "name")).alias("x"))
    plain = written(one.select("tree", "node", F.col("x.parent").alias("parent"), F.col("x.name").alias("name")), "tree-links")
    inner = written(_inner(plain), "tree-inner")
    inside = inner.select("tree", F.col("node").alias("parent"), F.lit(1).alias("there"))
    leaf = plain.join(inner.select("tree", "node"), ["tree", "node"], "left_anti").join(inside, ["tree", "parent"], "left")
    leaf = leaf.select("tree", "node", F.when(F.col("there") == 1, F.col("parent")).alias("at"), "parent", "name", F.lit(1).cast("bigint").alias("size"))
    ranked = before(leaf, ["tree", "at"], "node", "size", "rank", "tree-leaves")
    counts = ranked.where("at IS NOT NULL").groupBy("tree", F.col("at").alias("node")).agg(F.max("rank").alias("top"))
    started = inner.join(counts, ["tree", "node"], "left").select("tree", "node", "parent", "name", (F.coalesce(F.col("top") + 1, F.lit(0)) + 1).cast("bigint").alias("own"))
    ranges = _ranges(started, name is not None)
    # What the leaves need to know of their parent; the roots of a tree have a row with a null parent.
    sizes = ranges.groupBy("tree", "parent").agg(F.sum("size").alias("before"))
    base = ranges.select("tree", F.col("node").alias("at"), F.col("lft").alias("p_lft"), F.col("root").alias("p_root"), F.col("depth").alias("p_depth"), F.col("path").alias("p_path"))
    known = base.join(sizes.where("parent IS NOT NULL").withColumnRenamed("parent", "at"), ["tree", "at"], "left").withColumn("before", F.coalesce("before", F.lit(0).cast("bigint")))
    below = ranked.where("at IS NOT NULL").join(known, ["tree", "at"], "left")
    below = below.select("tree", "node", "parent", F.col("p_root").alias("root"), (F.col("p_depth") + 1).alias("depth"), F.concat("p_path", "name").alias("path"), (F.col("p_lft") + 1 + F.col("before") + F.col("rank")).alias("lft"), "size")
    tops = ranked.where("at IS NULL").join(sizes.where("parent IS NULL").select("tree", "before"), "tree", "left")
    tops = tops.select("tree", "node", "parent", F.col("node").alias("root"), F.lit(0).cast("bigint").alias("depth"), F.col("name").alias("path"), (F.coalesce("before", F.lit(0).cast("bigint")) + F.col("rank")).alias("lft"), "size")
    # An inner node keeps the parent that it names, there or not, and has a row where it is in a circle, too.
    columns = ["root", "depth", "path", "lft", "size"]
    named = plain.join(inner.select("tree", "node"), ["tree", "node"], "left_semi").select("tree", "node", "parent").join(ranges.select("tree", "node", *columns), ["tree", "node"], "left")
    every = named.unionByName(below.select("tree", "node", "parent", *columns)).unionByName(tops.select("tree", "node", "parent", *columns))
    types = {c: links.schema[c].dataType for c in (tree, node)}
    size = F.when(F.col("lft").isNotNull(), F.col("size"))
    return every.select(F.col("tree").cast(types[tree]).alias(tree), F.col("node").cast(types[node]).alias(node), F.col("parent").alias(parent), "root", "depth", "path", "lft", (F.col("lft") + size - 1).alias("rgt"), (size - 1).alias("n_below"))


def _bad_junctions(edges: DataFrame, ranges: DataFrame, inner: DataFrame) -> DataFrame:
    """(tree, root) of the nodes with several parents from which some path never ends.

    Such a node is the root of a part of its own.  It waits for the parts in which its parents lie and
    is free once they are; only these nodes take part, level by level among themselves.
    """
    junctions = inner.where("n > 1").select("tree", "node").distinct()
    at = ranges.select("tree", F.col("node").alias("parent"), F.col("root").alias("for"))
    waits = edges.join(junctions, ["tree", "node"], "left_semi").where("parent IS NOT NULL").join(at, ["tree", "parent"], "left")
    plain_root = F.col("for").isNotNull() & F.col("junction").isNull()
    marked = waits.join(junctions.select("tree", F.col("node").alias("for"), F.lit(1).alias("junction")), ["tree", "for"], "left")
    left = written(marked.where(~plain_root).select("tree", "node", "for").distinct(), "tree-junctions")
    n = left.count()
    while n:
        waiting = left.select("tree", F.col("node").alias("for")).distinct()
        still = left.where("for IS NULL").unionByName(left.join(waiting, ["tree", "for"], "left_semi").select("tree", "node", "for"))
        left = written(still, "tree-junctions")
        now = left.count()
        if now == n:
            break
        n = now
    return left.select("tree", F.col("node").alias("root")).distinct()


def endless(links: DataFrame, tree: str, node: str, parent: str, ends: DataFrame | None = None) -> DataFrame:
    """(tree, node) of the nodes from which following some parent link never ends.

    The nested-set sweep leaves the inner nodes in or below a circle without a range; a node is
    endless if it is one of them or has one of them as a parent.  An inner node with several parents,
    which no forest can hold, is cut from them and made the root of its part; whether a part hangs from
    a circle is then settled among these nodes alone.
    """
    plain = written(_links(links, tree, node, parent, ends).select("tree", "node", "parent", F.lit("").alias("name")).distinct(), "tree-links")
    edges = _inner(plain).distinct()
    inner = written(edges.join(edges.groupBy("tree", "node").agg(F.count("parent").alias("n")), ["tree", "node"]), "tree-inner")
    inner = inner.where("parent IS NOT NULL OR n = 0")
    children = plain.where("parent IS NOT NULL").groupBy("tree", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    branches = inner.where("parent IS NOT NULL").groupBy("tree", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_inner"))
    cut = inner.where("n < 2").select("tree", "node", "parent", "name").unionByName(inner.where("n > 1").select("tree", "node", F.lit(None).cast("bigint").alias("parent"), "name").distinct())
    own = (1 + F.coalesce("n_children", F.lit(0)) - F.coalesce("n_inner", F.lit(0))).cast("bigint").alias("own")
    ranges = _ranges(cut.join(children, ["tree", "node"], "left").join(branches, ["tree", "node"], "left").select("tree", "node", "parent", "name", own), False)
    stuck = cut.select("tree", "node").join(ranges.select("tree", "node"), ["tree", "node"], "left_anti")
    if not inner.where("n > 1").isEmpty():
        bad = _bad_junctions(inner.select("tree", "node", "parent"), ranges, inner)
        stuck = stuck.unionByName(ranges.join(bad, ["tree", "root"], "left_semi").select("tree", "node"))
    below = plain.join(stuck.select("tree", F.col("node").alias("parent")), ["tree", "parent"], "left_semi").select("tree", "node").distinct()
    types = {c: links.schema[c].dataType for c in (tree, node)}
    return below.select(F.col("tree").cast(types[tree]).alias(tree), F.col("node").cast(types[node]).alias(node))


def _cells(low: Column, high: Column, levels: int) -> Column:
    """The cells that cover low..high exclusive, none of them part of another: at most 30 on each level."""

    def at_level(level: int):
        return lambda x: F.struct(F.lit(level).alias("level"), x.alias("cell"))

    radix = 1 << RADIX_BITS
    out = []
    for level in range(levels):
        up, down = F.shiftleft(F.shiftright(low + (radix - 1), RADIX_BITS), RADIX_BITS), F.shiftleft(F.shiftright(high, RADIX_BITS), RADIX_BITS)
        left = F.least(up, high)
        right = F.greatest(down, left)
        if level == levels - 1:  # the whole of the rest
            left, right = high, high
        for a, b in ((low, left), (right, high)):
            some = F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
            out.append(F.transform(some, at_level(level)))
        low, high = F.shiftright(up, RADIX_BITS), F.shiftright(down, RADIX_BITS)
    return F.flatten(F.array(*out))


def descendants(ranges: DataFrame, wanted: DataFrame, tree: str, node: str) -> DataFrame:
    """(tree, ancestor, node, distance) of all nodes below each of the ``wanted`` (tree, node), from their ranges.

    ``ranges`` is the result of ``nested_sets``.  The range of an ancestor is covered by cells of 1, 16,
    256, ... numbers, so that a node meets its ancestors by equality of cells and no others: the work
    is that of the result.  Nodes in or below a circle have no descendants.
    """
    plain = ranges.where("lft IS NOT NULL").select(F.col(tree).alias("t"), F.col(node).alias("n"), "lft", "rgt", "depth")
    plain = written(plain, "tree-descendants")
    most = plain.agg(F.max("rgt")).first()[0] or 0
    levels = max(1, -(-int(most + 1).bit_length() // RADIX_BITS))
    keys = wanted.select(F.col(tree).alias("t"), F.col(node).alias("n")).distinct()
    roots = plain.where("rgt > lft").join(keys, ["t", "n"], "left_semi")
    covered = roots.select("t", F.col("n").alias("ancestor"), F.col("depth").alias("at"), F.explode(_cells(F.col("lft") + 1, F.col("rgt") + 1, levels)).alias("c")).select("t", "ancestor", "at", "c.level", "c.cell")
    spots = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("lft", RADIX_BITS * k).alias("cell")) for k in range(levels)])
    spread = plain.select("t", "n", "depth", F.explode(spots).alias("c")).select("t", "n", "depth", "c.level", "c.cell")
    found = spread.join(covered, ["t", "level", "cell"])
    return found.select(F.col("t").alias(tree), "ancestor", F.col("n").alias(node), (F.col("depth") - F.col("at")).alias("distance"))
