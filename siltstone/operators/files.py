"""Listings over decoded file records: files, attributes, contents, names and full paths.

All functions take the table that the record source or ``decode_records`` gives; its key is
(image, record_number), so tables of many volumes can be handled at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.errors import SiltstoneError
from siltstone.functions import layout
from siltstone.functions.columns import filetime_to_timestamp, flag, in_use, is_directory, unix_ticks, unsigned
from siltstone.functions.references import make_reference, record_number
from siltstone.operators import forest
from siltstone.operators.skew import spread_join
from siltstone.session import read_tables, write_table, written
from siltstone.sources.records import run_lists
from siltstone.sources.storage import open_file
from siltstone.sources.volume import geometry, read_content, read_exactly

KEY = ["image", "record_number"]
MAX_DEPTH = 1024
ROUNDS = 10  # 2 ** 10 = MAX_DEPTH


def used_files(records: DataFrame) -> DataFrame:
    """The records that are files: normal number, allocated in the bitmap, valid, in use."""
    return records.where((F.col("record_number") >= layout.FIRST_NORMAL_RECORD) & F.col("allocated") & F.col("is_valid") & in_use(F.col("flags")))


def get_record(records: DataFrame, number: int) -> DataFrame:
    """One record by number, if it is valid; neither bitmap nor in-use flag matter."""
    return records.where((F.col("record_number") == number) & F.col("is_valid"))


def record_exists(records: DataFrame) -> DataFrame:
    """(image, record_number, record_exists) from the bitmap."""
    return records.select(*KEY, F.coalesce("allocated", F.lit(False)).alias("record_exists"))


def attributes(records: DataFrame) -> DataFrame:
    """One row per attribute, in order within the record by ``ordinal``."""
    return records.where("is_valid").select(*KEY, F.explode("attributes").alias("a")).select(*KEY, "a.*")


def _of(kind: int) -> Column:
    return F.filter("attributes", lambda a: a["type_id"] == kind)


def first_attribute(kind: int) -> Column:
    """The first attribute of a type, or null."""
    return F.get(_of(kind), F.lit(0))


def read_data(records: DataFrame) -> DataFrame:
    """(image, record_number, data): the value of the first data attribute where it is resident."""
    first = first_attribute(layout.DATA)
    return records.where("is_valid").select(*KEY, F.when(~first["non_resident"], first["value"]).alias("data"))


def read_contents(records: DataFrame) -> DataFrame:
    """(image, record_number, data, error): the whole value of the first data attribute, read from the image by the tasks.

    ``image`` is the path of the image, as the record source gives it.  Runs are joined, holes are zeros
    and the end is cut to the size.  ``error`` says why there are no data; a value too large to hold in
    memory is such an error.
    """
    first = first_attribute(layout.DATA)
    found = records.where("is_valid").select(*KEY, first.alias("a")).where("a IS NOT NULL")
    plain = found.select(*KEY, *[F.col(f"a.{c}").alias(c) for c in ("non_resident", "value", "data_size", "runs")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file, cluster = None, None, 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):  # contents are large, so few at a time
                part = batch.slice(begin, 64)
                data, errors = [], []
                for row in part.to_pylist():
                    if row["image"] != path:
                        path, file = row["image"], open_file(row["image"])
                        cluster = geometry(path, read_exactly(file, 0, layout.BOOT_SECTOR.itemsize)).cluster_size
                    try:
                        data.append(read_content(file, row, cluster))
                        errors.append(None)
                    except SiltstoneError as e:
                        data.append(None)
                        errors.append(str(e))
                yield pa.RecordBatch.from_arrays([part["image"], part["record_number"], pa.array(data, pa.binary()), pa.array(errors, pa.string())], [*KEY, "data", "error"])

    return plain.mapInArrow(read, "image string, record_number bigint, data binary, error string")


def data_runs(records: DataFrame, cluster_size: Column, kind: int = layout.DATA) -> DataFrame:
    """(image, record_number, data_size, error, runs) of the first attribute of a type.

    ``error`` says why there are no runs; for a resident attribute it is 'attribute is resident'.
    """
    runs_type = "array<struct<kind:string,lcn:bigint,length:bigint>>"
    first = first_attribute(kind)
    found = records.where("is_valid").select(*KEY, cluster_size.cast("bigint").alias("cluster_size"), first.alias("a")).where("a IS NOT NULL")
    plain = found.select(*KEY, "cluster_size", F.col("a.non_resident").alias("non_resident"), F.col("a.data_size").alias("data_size"), F.col("a.runs").alias("runs"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors, runs = run_lists(batch["runs"], np.asarray(batch["cluster_size"]), batch["data_size"], batch["non_resident"])
            yield pa.RecordBatch.from_arrays([batch["image"], batch["record_number"], batch["data_size"], errors, runs], [*KEY, "data_size", "error", "runs"])

    return plain.mapInArrow(decode, f"image string, record_number bigint, data_size bigint, error string, runs {runs_type}")


def _preferred(name: Column) -> Column:
    return name["namespace"].isin(layout.WIN32, layout.WIN32_AND_DOS)


def _usable(name: Column) -> Column:
    return name.isNotNull() & ~F.coalesce(flag(name["file_attributes"], layout.REPARSE_POINT), F.lit(False))


def _names_of(records: DataFrame, *more: Column) -> DataFrame:
    """What is needed of the valid records to name them, from one pass over them, as a written table.

    ``pick`` is the best of the own names; ``first`` the first name attribute, for lists of other
    records; ``steps`` the names and lists in order, only where there is a list.
    """
    has_list = F.exists("attributes", lambda a: a["type_id"] == layout.ATTRIBUTE_LIST)
    own = F.transform(F.filter(_of(layout.FILE_NAME), lambda a: _usable(a["name"])), lambda a: a["name"])
    pick = F.coalesce(F.get(F.filter(own, _preferred), F.lit(0)), F.try_element_at(own, F.lit(-1)))
    named = F.filter("attributes", lambda a: a["type_id"].isin(layout.FILE_NAME, layout.ATTRIBUTE_LIST))
    steps = F.transform(named, lambda a: F.struct(a["ordinal"].alias("at"), a["type_id"].alias("type_id"), a["name"].alias("name"), a["entries"].alias("entries")))
    first = first_attribute(layout.FILE_NAME)
    columns = [F.when(~has_list, pick).alias("pick"), F.when(has_list, steps).alias("steps"), first.isNotNull().alias("has_name"), first["name"].alias("first")]
    return written(records.where("is_valid").select(*KEY, *columns, *more), "names")


def best_names(records: DataFrame) -> DataFrame:
    """(image, record_number, name STRUCT) of the valid records that have a usable name.

    The first name for long file systems wins, else the last of the others; reparse points do not
    count.  Attribute lists are followed by a join; only records that have one take part in it.
    """
    return _best_of(_names_of(records))


def _best_of(names: DataFrame) -> DataFrame:
    return _all_named(names).select(*KEY, "name").where("name IS NOT NULL")


def _all_named(names: DataFrame) -> DataFrame:
    """The table of ``_names_of`` with the best name of each record; joined only where there are attribute lists."""
    simple = names.where("steps IS NULL").withColumn("name", F.col("pick"))
    listed = names.where("steps IS NOT NULL")
    if listed.isEmpty():
        return simple
    found = _names_with_lists(names)
    return written(simple.unionByName(listed.join(found, KEY, "left")), "best-names")


def _names_with_lists(names: DataFrame) -> DataFrame:
    """Names of the records with an attribute list, as an ordered fold over their candidates.

    Candidates are the own names and the name entries of the lists, in the order of a scan of the
    record.  A list that cannot be read ends the scan; an entry whose record or name attribute is
    missing leaves the file without a name; the first other name of a list ends that list.
    """
    steps = names.where("steps IS NOT NULL").select(*KEY, F.explode("steps").alias("a")).select(*KEY, "a.*")
    own = steps.where(F.col("type_id") == layout.FILE_NAME).select(*KEY, "at", F.lit(0).alias("nth"), F.when(_usable(F.col("name")), "name").otherwise("skip").alias("what"), "name")
    stops = steps.where((F.col("type_id") == layout.ATTRIBUTE_LIST) & F.col("entries").isNull()).select(*KEY, "at", F.lit(0).alias("nth"), F.lit("stop").alias("what"), "name")
    entries = steps.where(F.col("type_id") == layout.ATTRIBUTE_LIST).select("image", F.col("record_number").alias("owner"), "at", F.posexplode("entries").alias("nth", "e")).where(F.col("e.type_id") == layout.FILE_NAME)
    entries = entries.select("image", "owner", "at", "nth", record_number(F.col("e.reference")).alias("record_number"))
    targets = names.select(*KEY, "has_name", F.col("first").alias("name"))
    followed = entries.join(targets, KEY, "left").select("image", F.col("owner").alias("record_number"), "at", "nth", F.when(~F.coalesce("has_name", F.lit(False)), "abort").when(_usable(F.col("name")), "listed").otherwise("skip").alias("what"), "name")
    # A record has at most as many candidates as fit into it, so the array is bounded.
    ordered = own.unionByName(stops).unionByName(followed).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("at", "nth", "what", "name"))).alias("c"))
    kind = ordered.schema["c"].dataType.elementType["name"].dataType.simpleString()
    start = F.struct(F.lit(False).alias("done"), F.lit(-1).alias("left"), F.lit(None).cast(kind).alias("name"))

    def fold(acc: Column, c: Column) -> Column:
        usable = c["what"].isin("name", "listed")
        left_list = (c["what"] == "listed") & ~_preferred(c["name"])
        new = F.struct(
            (c["what"].isin("stop", "abort") | (usable & _preferred(c["name"]))).alias("done"),
            F.when(left_list, c["at"]).otherwise(acc["left"]).alias("left"),
            F.when(c["what"] == "abort", F.lit(None).cast(kind)).when(usable, c["name"]).otherwise(acc["name"]).alias("name"),
        )
        return F.when(acc["done"] | ((acc["left"] == c["at"]) & (c["what"] != "name")), acc).otherwise(new)

    return ordered.select(*KEY, F.aggregate("c", start, fold, lambda a: a["name"]).alias("name"))


#: An image of at most LOCAL directories is walked by one task, unless its paths have more than MOST_TEXT characters.
LOCAL, MOST_TEXT = 1 << 18, 1 << 28
#: So many directories on circles or too long chains, with their ancestors, are expanded by the task of their image.
MOST_LONG = 1 << 12
_WALKED = "image string, record_number bigint, path string, next bigint, ok boolean, open boolean"


def _walker(most: int, rounds: int, most_text: int, most_long: int):
    """The paths of the directories of one image, (image, record_number, path, next, ok) -> the same and whether a row is still open."""

    def walk(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("record_number")
        node = np.asarray(rows["record_number"].combine_chunks())
        ok = np.asarray(rows["ok"].combine_chunks())
        going = ok & (node != layout.ROOT_RECORD)
        following = np.asarray(rows["next"].combine_chunks().fill_null(-1))
        up = forest.parent_index(node, following, going)
        depth = forest.depths(up)
        size = np.asarray(pc.fill_null(pc.utf8_length(rows["path"]), 0).combine_chunks()).astype(np.int64)
        given = np.empty(len(node), object)
        given[:] = rows["path"].to_pylist()
        paths, still, came = given, going.copy(), ok
        root = forest.roots(up, depth)
        if forest.down(up, depth, size)[depth >= 0].sum() <= most_text:
            arrives = node[root] == layout.ROOT_RECORD
            good = arrives & (depth >= 0) & (depth <= most)
            bad = ~arrives & (depth >= 0) & (depth < most)
            own = np.where(ok, given, "")
            long = np.flatnonzero(going & ~(good | bad))
            seen, reach = np.zeros(len(node), bool), long  # with all that can be among their nearest ancestors
            for _ in range(most):
                reach = np.unique(reach[~seen[reach]])
                seen[reach] = True
                reach = up[reach][up[reach] >= 0]
                if not len(reach) or seen.sum() > most_long:
                    break
            # An image with more of them is left as it came: a round must not meet paths that are ahead of it.
            if seen.sum() <= most_long:
                paths = np.where(good, forest.down(up, np.where(depth <= most, depth, -1), own), np.where(bad, None, given))
                came, still = ok & ~bad, np.zeros(len(node), bool)
                those = np.flatnonzero(seen)
                at = np.full(len(node) + 1, -1)  # the last entry stands for no ancestor
                at[those] = np.arange(len(those))
                jump, text = at[up[those]], own[those]
                for _ in range(rounds):
                    further = jump >= 0
                    text[further], jump[further] = text[jump[further]] + text[further], jump[jump[further]]
                paths[long] = text[at[long]]
        arrays = [rows["image"].combine_chunks(), pa.array(node), pa.array(paths.tolist(), pa.string()), pa.array(np.where(still, following, layout.ROOT_RECORD)), pa.array(came), pa.array(still)]
        return pa.Table.from_arrays(arrays, ["image", "record_number", "path", "next", "ok", "open"])

    return walk


def directory_paths(names: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(image, record_number, path, ok) of every record that some name has as its parent.

    ``path`` has a leading backslash per component and is '' for the root.  A path has the nearest 1024
    components; a longer chain or a circle keeps those.  ``ok`` is false where an ancestor is missing.

    Each image is walked by one task.  What is too large for that is resolved by pointer doubling: after
    k rounds a row covers 2 ** k ancestors, so ten rounds are exactly 1024.  A round writes the rows it
    finishes and those still open, and only the open ones go on.
    """
    parent = record_number(F.col("name.parent_reference"))
    wanted = names.select("image", parent.alias("record_number")).distinct()
    root = F.col("record_number") == layout.ROOT_RECORD
    own = F.concat(F.lit("\\"), F.col("name.name"))
    begun = wanted.join(names, KEY, "left").select(*KEY, F.when(root, "").otherwise(own).alias("path"), F.when(root, F.lit(layout.ROOT_RECORD)).otherwise(parent).cast("bigint").alias("next"), (root | F.col("name").isNotNull()).alias("ok"))
    begun = written(begun, "paths")
    large = begun.groupBy("image").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LOCAL).select("image")
    walk = _walker(1 << rounds, rounds, MOST_TEXT, MOST_LONG)
    if large.isEmpty():
        state = begun.groupBy("image").applyInArrow(walk, _WALKED)
    else:
        untouched = F.col("ok") & (F.col("next") != layout.ROOT_RECORD)
        state = begun.join(large, "image", "left_anti").groupBy("image").applyInArrow(walk, _WALKED)
        state = state.unionByName(begun.join(large, "image", "left_semi").withColumn("open", F.coalesce(untouched, F.lit(False))))
    state = state.withColumn("round", F.lit(0))
    tables = [write_table(state, "paths")]
    while len(tables) <= rounds and not (latest := read_tables(state, tables[-1:]).where("open")).isEmpty():
        known = read_tables(state, tables).where(~F.col("open") | (F.col("round") == len(tables) - 1))
        up = known.select("image", F.col("record_number").alias("next"), F.col("path").alias("up_path"), F.col("next").alias("up_next"), F.col("ok").alias("up_ok"))
        moved = latest.join(up, ["image", "next"], "left")
        good = F.coalesce("up_ok", F.lit(False))
        further = good & F.col("up_next").isNotNull() & (F.col("up_next") != layout.ROOT_RECORD)
        last = len(tables) == rounds
        moved = moved.select(*KEY, F.when(good, F.concat("up_path", "path")).alias("path"), F.coalesce("up_next", "next").alias("next"), good.alias("ok"), (F.coalesce(further, F.lit(False)) & F.lit(not last)).alias("open"), F.lit(len(tables)).alias("round"))
        tables.append(write_table(moved.select(*state.columns), "paths"))
    done = read_tables(state, tables).where("NOT open")
    return done.select(*KEY, F.when(F.coalesce("ok", F.lit(False)), F.col("path")).alias("path"), F.coalesce("ok", F.lit(False)).alias("ok"))


def full_paths(records: DataFrame, volume: Column | None = None) -> DataFrame:
    """(image, record_number, reference_number, name, path) of all valid records; '' where there is no name or no way to the root.

    ``volume`` is put before each path; it is the image by default.
    """
    parts = _names_of(records, make_reference(F.col("sequence"), F.col("record_number")).alias("reference_number"))
    return _located(_all_named(parts), ["reference_number"], volume)


def _located(named: DataFrame, columns: Sequence[str], volume: Column | None, wanted: Column | None = None) -> DataFrame:
    """(image, record_number, columns..., name, path) of the ``wanted`` records, all by default; all of them lead to paths."""
    above = directory_paths(named.select(*KEY, "name").where("name IS NOT NULL")).select("image", F.col("record_number").alias("parent"), F.col("path").alias("above"), "ok")
    rows = named if wanted is None else named.where(wanted)
    placed = rows.select(*KEY, *columns, F.col("name.name").alias("name"), record_number(F.col("name.parent_reference")).alias("parent"))
    joined = spread_join(placed, above, ["image", "parent"], "left", F.col("record_number"))
    prefix = F.col("image") if volume is None else volume
    whole = F.concat(F.regexp_replace(prefix, r"\\$", ""), F.coalesce("above", F.lit("")), F.lit("\\"), F.col("name"))
    path = F.coalesce(F.when(F.col("ok"), whole), F.lit(""))
    return joined.select(*KEY, *columns, F.coalesce("name", F.lit("")).alias("name"), path.alias("path"))


INFO = ("reference_number", "is_directory", "size", "created", "accessed", "modified", "created_ticks", "accessed_ticks", "modified_ticks")


def _info() -> list[Column]:
    standard = F.try_element_at(F.filter("attributes", lambda a: a["standard"].isNotNull()), F.lit(-1))["standard"]
    sizes = F.filter("attributes", lambda a: (a["type_id"] == layout.DATA) & F.coalesce(a["data_size"], a["value_length"]).isNotNull())
    last = F.try_element_at(sizes, F.lit(-1))
    size = F.coalesce(F.when(last["non_resident"], unsigned(last["data_size"])).otherwise(last["value_length"].cast("decimal(20,0)")), F.lit(0).cast("decimal(20,0)"))
    times = {"created": "creation", "accessed": "access", "modified": "modification"}
    return [
        make_reference(F.col("sequence"), F.col("record_number")).alias("reference_number"), is_directory(F.col("flags")).alias("is_directory"), size.alias("size"),
        *[filetime_to_timestamp(standard[f]).alias(n) for n, f in times.items()], *[unix_ticks(standard[f]).alias(f"{n}_ticks") for n, f in times.items()],
    ]


def file_info(records: DataFrame) -> DataFrame:
    """Times and size of the files, without names: last standard information, last data attribute."""
    return used_files(records).select(*KEY, *_info())


def files(records: DataFrame, volume: Column | None = None) -> DataFrame:
    """The full listing: ``file_info`` with name and path, from one pass over the records.

    Paths come from all valid records, since a directory may be free, unallocated or a metadata file.
    """
    is_file = (F.col("record_number") >= layout.FIRST_NORMAL_RECORD) & F.col("allocated") & in_use(F.col("flags"))
    parts = _names_of(records, F.coalesce(is_file, F.lit(False)).alias("is_file"), *_info())
    return _located(_all_named(parts), INFO, volume, F.col("is_file"))
