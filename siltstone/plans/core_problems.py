"""Queries p1, p2, p4, p5, p6 and p7: the core operators over the file-system tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.references import RECORD_MASK, make_reference, record_number
from siltstone.operators import capture, changes, dedup_index, hierarchy, references, skew, snapshots
from siltstone.session import buckets_for, scratch_path, shuffle_partitions, written

FILE_DELETE = 0x200
#: Ticks of 100 ns from 1601 to 1970.
EPOCH_TICKS = 116_444_736_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- 1: processing only new or changed records ---------------------------------------------------


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identifiers pinned by the write-ahead plan of the next run."""
    run = capture.ChangeCapture(spark, scratch_path(spark, "capture"))
    return run.keys(run.plan(table(spark, sf_dir, "usn_record"), table(spark, sf_dir, "usn_batch")))


def p1_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sink holds after a run that dies before its commit, the replay, and a further run."""
    records = table(spark, sf_dir, "usn_record").select("batch_id", "journal_id", "usn", "volume_id", "ticks", "file_id", "parent_id", "reason")
    lines = table(spark, sf_dir, "usn_batch")
    home = scratch_path(spark, "capture")
    capture.ChangeCapture(spark, home).run(records, lines, fail_before_commit=True)
    for _ in range(2):
        capture.ChangeCapture(spark, home).run(records, lines)
    return capture.ChangeCapture(spark, home).sink().select("run", "journal_id", "usn", "volume_id", "ticks", "file_id", "parent_id", "reason")


def p1_next_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the third run handles after two over the earlier half of the deliveries: new records, and late ones below the offsets."""
    records, lines = table(spark, sf_dir, "usn_record"), table(spark, sf_dir, "usn_batch")
    low, high = records.agg(F.min("batch_id"), F.max("batch_id")).first()
    middle = ((low or 0) + (high or 0)) // 2
    run = capture.ChangeCapture(spark, scratch_path(spark, "capture"))
    for _ in range(2):
        run.commit(run.plan(records.where(F.col("batch_id") <= middle), lines))
    return run.keys(run.plan(records, lines))


def p1_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per journal the offset from which the run after this one reads."""
    return capture.next_offsets(table(spark, sf_dir, "usn_record"), table(spark, sf_dir, "usn_batch"))


# --- 2: applying inserts, updates and deletes ----------------------------------------------------

CARRIED = ("name", "parent_id")


def _apply(base: DataFrame | None, records: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    gone = F.col("reason").bitwiseAND(F.lit(FILE_DELETE)) != 0
    return changes.apply_changes(base, records, ["journal_id", "usn"], ["volume_id", "file_id"], "usn", gone, carry)


def _merged(spark: SparkSession, sf_dir: str, carry: tuple[str, ...]) -> DataFrame:
    """The changes of major version 3 merged into a base built from all others: late and out of order."""
    records = table(spark, sf_dir, "usn_record")
    base = _apply(None, records.where("NOT (major <=> 3)"), carry)
    return changes.current(_apply(base, records.where("major <=> 3"), carry), ["volume_id", "file_id"], "last_usn", carry)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, ())


def p2_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The present files with their last name and parent."""
    state = _apply(None, table(spark, sf_dir, "usn_record"), CARRIED)
    return changes.current(state, ["volume_id", "file_id"], "last_usn", CARRIED)


def p2_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The present files with what they carry, from a merge as in ``p2_found``."""
    return _merged(spark, sf_dir, CARRIED)


# --- 4: what changed between snapshots -----------------------------------------------------------


COMPARED = ("path", "size", "modified")


def _store(spark: SparkSession) -> snapshots.SnapshotStore:
    return snapshots.SnapshotStore(spark, scratch_path(spark, "snapshots"), "volume_id", "snapshot_no", "number", COMPARED, shuffle_partitions(spark))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark).advance(table(spark, sf_dir, "file_snapshot"), table(spark, sf_dir, "snapshot_log"))


def p4_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a store that is kept: the snapshots come in three calls, of which the second is repeated as after a failure."""
    rows, log = table(spark, sf_dir, "file_snapshot"), table(spark, sf_dir, "snapshot_log")
    numbers = [r[0] for r in log.select("snapshot_no").distinct().orderBy("snapshot_no").collect()]
    store, parts = _store(spark), []
    for name, until in (("one", numbers[len(numbers) // 3]), ("two", numbers[2 * len(numbers) // 3]), ("two", numbers[2 * len(numbers) // 3]), ("three", numbers[-1])) if numbers else ():
        parts.append(store.advance(rows.where(F.col("snapshot_no") <= until), log.where(F.col("snapshot_no") <= until), name))
    return parts[0].unionByName(parts[2]).unionByName(parts[3]) if parts else store.advance(rows, log)


def p4_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each change with path, size and modification time before and after."""
    found = p4_found(spark, sf_dir)
    return snapshots.change_details(found, table(spark, sf_dir, "file_snapshot"), table(spark, sf_dir, "snapshot_log"), "volume_id", "snapshot_no", "number", COMPARED)


# --- 5: messages delivered more than once --------------------------------------------------------


def _index(spark: SparkSession, sf_dir: str, waves: int, again: bool = False) -> tuple[dedup_index.DedupIndex, list[tuple[DataFrame, str]]]:
    """Index the deliveries in the order of their read batches, in ``waves`` incoming batches; with (batch, run) of each.

    With ``again`` every batch is admitted twice, the second time by a new process, as after a crash.
    """
    records = table(spark, sf_dir, "usn_record")
    low, high, rows = records.agg(F.min("batch_id"), F.max("batch_id"), F.count(F.lit(1))).first()
    home = scratch_path(spark, "dedup")
    low, span = low or 0, ((high or 0) - (low or 0)) // waves + 1
    runs = []
    for n in range(waves):
        inside = F.col("batch_id") < low + (n + 1) * span
        wave = records.where(F.coalesce(F.col("batch_id"), F.lit(low)) >= low + n * span).where(inside | F.col("batch_id").isNull() if n == 0 else inside)
        for _ in range(1 + again):
            index = dedup_index.DedupIndex(spark, home, ["journal_id", "usn"], merge_every=2)
            run = index.admit(wave, f"wave {n}", rows // waves)
        runs.append((wave, run))
    return index, runs


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _ = _index(spark, sf_dir, 3)
    return index.repeated()


def _kept(spark: SparkSession, sf_dir: str, again: bool) -> DataFrame:
    index, runs = _index(spark, sf_dir, 3, again)
    columns = ["journal_id", "usn", "volume_id", "ticks", "file_id", "parent_id", "reason"]
    parts = [index.kept(wave.select(*columns, "name"), run).select(*columns) for wave, run in runs]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p5_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each message: of the first batch that brought it the copy with the fewest nulls."""
    return _kept(spark, sf_dir, False)


def p5_retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where every batch is admitted once more after it was indexed, from an index opened anew."""
    return _kept(spark, sf_dir, True)


def p5_novel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per incoming batch the number of messages that it brought for the first time."""
    index, runs = _index(spark, sf_dir, 3)
    parts = [index.novel(r).groupBy().agg(F.count(F.lit(1)).alias("n_novel")).select(F.lit(n + 1).alias("wave"), "n_novel") for n, (_, r) in enumerate(runs)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- 6: parent-child links to full hierarchies ---------------------------------------------------


def _name_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "file_name").select("volume_id", "record_number", record_number(F.col("parent_reference")).alias("parent"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.endless(_name_links(spark, sf_dir), "volume_id", "record_number", "parent", table(spark, sf_dir, "system_record"))


def _main_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One link per record: the first Win32 name, else the last other one; system records are nodes, record 5 a root."""
    names = table(spark, sf_dir, "file_name")
    rank = F.when(F.col("namespace").isin(1, 3), -F.col("attr_id").cast("bigint")).otherwise(F.col("attr_id").cast("bigint") - (1 << 40))
    best = names.groupBy("volume_id", "record_number").agg(F.max(F.struct(rank.alias("rank"), record_number(F.col("parent_reference")).alias("parent"), F.col("name"))).alias("x"))
    system = table(spark, sf_dir, "system_record")
    volume = table(spark, sf_dir, "volumes").select("volume_id", F.col("path").alias("volume"))
    own = record_number(F.col("parent_reference"))
    top = own == F.col("record_number")
    roots = system.join(volume, "volume_id", "left").select("volume_id", "record_number", F.when(~top, own).alias("parent"), F.when(top, F.col("volume")).otherwise(F.concat(F.lit("\\"), F.col("name"))).alias("label"))
    found = best.select("volume_id", "record_number", F.col("x.parent").alias("parent"), F.concat(F.lit("\\"), F.coalesce("x.name", F.lit(""))).alias("label"))
    return found.unionByName(roots)


def p6_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth, root and nested-set range of every record; nulls where the links run in a circle."""
    return hierarchy.nested_sets(_main_links(spark, sf_dir), "volume_id", "record_number", "parent", F.col("label"))


def p6_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records below every record, with the number of links between them."""
    ranges = hierarchy.nested_sets(_main_links(spark, sf_dir), "volume_id", "record_number", "parent")
    return hierarchy.descendants(ranges, ranges, "volume_id", "record_number")


# --- 7: references to records that do not exist --------------------------------------------------


def _month_of_ticks(ticks: F.Column) -> F.Column:
    """Months since year 0 of a tick count since 1601; days alone decide, so no time zone matters."""
    since, day = ticks - F.lit(EPOCH_TICKS), F.lit(864_000_000_000)
    days = ((since - F.pmod(since, day)) / day).cast("int")  # whole days are exact as doubles
    at = F.date_from_unix_date(days)
    return F.year(at) * 12 + F.month(at) - 1


def _month_of_time(at: F.Column) -> F.Column:
    return F.year(at) * 12 + F.month(at) - 1


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(groups, period, volume_id, reference, owner_id, row_key, attr_id) of both referring tables."""
    usn = table(spark, sf_dir, "usn_record").select(
        F.lit(0).alias("groups"), _month_of_ticks(F.col("ticks")).alias("period"), "volume_id",
        F.col("parent_id").alias("reference"), F.col("journal_id").alias("owner_id"), F.col("usn").alias("row_key"), F.lit(0).alias("attr_id"),
    )
    names = table(spark, sf_dir, "file_name")
    owner = table(spark, sf_dir, "mft_record").groupBy("volume_id", "record_number").agg(F.max("captured_at").alias("at"))
    names = names.join(owner, ["volume_id", "record_number"], "left").select(
        F.lit(1).alias("groups"), _month_of_time(F.col("at")).alias("period"), "volume_id",
        F.col("parent_reference").alias("reference"), F.col("volume_id").cast("bigint").alias("owner_id"), F.col("record_number").alias("row_key"), "attr_id",
    )
    return usn.unionByName(names)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(volume_id, reference) of the records in use."""
    parts = [table(spark, sf_dir, t).where(F.col("flags").bitwiseAND(1) != 0).select("volume_id", make_reference(F.col("sequence"), F.col("record_number")).alias("reference")) for t in ("mft_record", "system_record")]
    return parts[0].unionByName(parts[1])


def _orphan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _references(spark, sf_dir)
    rows = table(spark, sf_dir, "usn_record").count() + table(spark, sf_dir, "file_name").count()
    lost = references.orphan_keys(refs, _records(spark, sf_dir), ["volume_id", "reference"], "groups", "period", buckets_for(rows, references.PER_BUCKET, shuffle_partitions(spark)))
    key = ["groups", "volume_id", "reference"]
    keys = written(lost.select(*key).distinct().withColumn("volume_id", F.col("volume_id").cast("int")), "orphan-keys")
    return skew.spread_join(refs, keys, key, "left_semi", F.col("row_key"))


def _table_name(column: str) -> F.Column:
    return F.when(F.col(column) == 0, F.lit("usn_record")).otherwise(F.lit("file_name")).alias("source_table")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphan_rows(spark, sf_dir).select(_table_name("groups"), "owner_id", "row_key", "attr_id").distinct()


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table and month; ``period`` is 'YYYY-MM', or null where the owner has no time."""
    rows = _orphan_rows(spark, sf_dir).select("groups", "period", "owner_id", "row_key", "attr_id").distinct()
    counts = references.orphans_by_period(rows, "groups", "period")
    month = F.concat(F.lpad(F.floor(F.col("period") / 12).cast("string"), 4, "0"), F.lit("-"), F.lpad((F.col("period") % 12 + 1).cast("string"), 2, "0"))
    return counts.select(_table_name("groups"), month.alias("period"), "n_orphans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_run, p1_next_run, p1_offsets, p2_found, p2_files, p2_merged, p4_found, p4_incremental, p4_details, p5_found, p5_kept, p5_retried, p5_novel, p6_found, p6_tree, p6_descendants, p7_found, p7_report)}

_DONE = "SELECT batch_id FROM usn_batch GROUP BY batch_id HAVING max(log_no) = max(log_no) FILTER (status = 'committed')"
_PENDING = f"SELECT journal_id, usn FROM usn_record GROUP BY journal_id, usn HAVING NOT bool_or(batch_id IN ({_DONE}))"
_FILES = """
WITH r AS (SELECT journal_id, usn, max(volume_id) AS volume_id, max(file_id) AS file_id, max(reason) AS reason, max(name) AS name, max(parent_id) AS parent_id FROM usn_record GROUP BY journal_id, usn)
SELECT volume_id, file_id, max(usn) AS last_usn, arg_max(name, usn) FILTER (name IS NOT NULL) AS name, arg_max(parent_id, usn) FILTER (parent_id IS NOT NULL) AS parent_id
FROM r GROUP BY volume_id, file_id HAVING arg_max(reason, usn) & 512 = 0
"""
_STEPS = """
WITH s AS (SELECT volume_id, snapshot_no, number, path, size, modified FROM file_snapshot QUALIFY row_number() OVER (PARTITION BY volume_id, snapshot_no, number ORDER BY path DESC NULLS LAST, size DESC NULLS LAST, modified DESC NULLS LAST) = 1),
l AS (SELECT volume_id, snapshot_no, lag(snapshot_no) OVER (PARTITION BY volume_id ORDER BY snapshot_no) AS earlier FROM snapshot_log),
n AS (SELECT l.earlier, s.* FROM l JOIN s USING (volume_id, snapshot_no) WHERE l.earlier IS NOT NULL),
o AS (SELECT l.snapshot_no AS later, s.* FROM l JOIN s ON s.volume_id = l.volume_id AND s.snapshot_no = l.earlier),
d AS (SELECT coalesce(n.volume_id, o.volume_id) AS volume_id, coalesce(n.snapshot_no, o.later) AS snapshot_no, coalesce(n.number, o.number) AS number,
  CASE WHEN o.number IS NULL THEN 'added' WHEN n.number IS NULL THEN 'removed' WHEN (n.path IS DISTINCT FROM o.path) OR (n.size IS DISTINCT FROM o.size) OR (n.modified IS DISTINCT FROM o.modified) THEN 'changed' END AS change_kind,
  o.path AS old_path, o.size AS old_size, o.modified AS old_modified, n.path AS new_path, n.size AS new_size, n.modified AS new_modified
  FROM n FULL JOIN o ON n.volume_id = o.volume_id AND n.snapshot_no = o.later AND n.number = o.number)
"""
_BELOW = f"""
WITH RECURSIVE links AS (SELECT DISTINCT volume_id, record_number, parent_reference & {RECORD_MASK} AS parent FROM file_name),
nodes AS (SELECT DISTINCT volume_id, record_number FROM links),
edges AS (SELECT l.volume_id, l.record_number, p.record_number AS parent FROM links l LEFT JOIN nodes p ON p.volume_id = l.volume_id AND p.record_number = l.parent AND (l.volume_id, l.parent) NOT IN (SELECT volume_id, record_number FROM system_record)),
"""
_P6 = f"""{_BELOW}
walk(volume_id, record_number) AS (
  SELECT volume_id, record_number FROM edges WHERE parent IS NULL
  UNION
  SELECT e.volume_id, e.record_number FROM walk w JOIN edges e ON e.volume_id = w.volume_id AND e.parent = w.record_number)
SELECT DISTINCT e.volume_id, e.record_number FROM edges e LEFT JOIN walk w ON w.volume_id = e.volume_id AND w.record_number = e.parent WHERE e.parent IS NOT NULL AND w.record_number IS NULL
"""
_TREE = f"""
WITH RECURSIVE best AS (
  SELECT volume_id, record_number, arg_max({{'parent': parent_reference & {RECORD_MASK}, 'name': name}}, CASE WHEN namespace IN (1, 3) THEN -attr_id ELSE attr_id - {1 << 40} END) AS x FROM file_name GROUP BY volume_id, record_number),
links AS (
  SELECT volume_id, record_number, x.parent AS parent, '\\' || coalesce(x.name, '') AS label FROM best
  UNION ALL SELECT s.volume_id, s.record_number, CASE WHEN parent_reference & {RECORD_MASK} <> record_number THEN parent_reference & {RECORD_MASK} END, CASE WHEN parent_reference & {RECORD_MASK} = record_number THEN v.path ELSE '\\' || name END FROM system_record s LEFT JOIN volumes v USING (volume_id)),
parents AS (SELECT DISTINCT volume_id, parent AS record_number FROM links WHERE parent IS NOT NULL),
kinds AS (SELECT l.*, CASE WHEN p.record_number IS NULL THEN 1 ELSE 0 END AS leaf, u.record_number AS up FROM links l LEFT JOIN parents p USING (volume_id, record_number) LEFT JOIN links u ON u.volume_id = l.volume_id AND u.record_number = l.parent),
walk(volume_id, record_number, root, depth, path, place, above) AS (
  SELECT volume_id, record_number, record_number, 0::BIGINT, label, [leaf, record_number], [record_number] FROM kinds WHERE up IS NULL
  UNION ALL
  SELECT k.volume_id, k.record_number, w.root, w.depth + 1, w.path || k.label, w.place || [k.leaf, k.record_number], w.above || [k.record_number] FROM walk w JOIN kinds k ON k.volume_id = w.volume_id AND k.up = w.record_number),
below AS (SELECT volume_id, record_number, count(*) - 1 AS n_below FROM (SELECT volume_id, unnest(above) AS record_number FROM walk) GROUP BY volume_id, record_number),
placed AS (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY place) - 1 AS lft FROM walk JOIN below USING (volume_id, record_number))
SELECT l.volume_id, l.record_number, l.parent, p.root, p.depth, p.path, p.lft, p.lft + p.n_below AS rgt, p.n_below FROM links l LEFT JOIN placed p USING (volume_id, record_number)
"""
_DESCENDANTS = f"""{_TREE[: _TREE.index("below AS (")]}
spread AS (SELECT volume_id, record_number, depth, unnest(above) AS ancestor, unnest(range(len(above))) AS nth FROM walk)
SELECT volume_id, ancestor, record_number, depth - nth AS distance FROM spread WHERE ancestor <> record_number
"""
_REFS = f"""
WITH used AS (SELECT volume_id, record_number, sequence FROM mft_record WHERE flags & 1 = 1 UNION SELECT volume_id, record_number, sequence FROM system_record WHERE flags & 1 = 1),
owners AS (SELECT volume_id, record_number, max(captured_at) AS at FROM mft_record GROUP BY volume_id, record_number),
refs AS (
  SELECT 'usn_record' AS source_table, journal_id AS owner_id, usn AS row_key, 0 AS attr_id, volume_id, parent_id AS reference, strftime(make_timestamp((ticks - {EPOCH_TICKS}) // 10), '%Y-%m') AS period FROM usn_record WHERE parent_id IS NOT NULL
  UNION SELECT 'file_name', f.volume_id::BIGINT, f.record_number, f.attr_id, f.volume_id, f.parent_reference, strftime(o.at, '%Y-%m') FROM file_name f LEFT JOIN owners o USING (volume_id, record_number) WHERE f.parent_reference IS NOT NULL),
lost AS (SELECT r.* FROM refs r LEFT JOIN used u ON u.volume_id = r.volume_id AND u.record_number = r.reference & {RECORD_MASK} AND u.sequence = (r.reference >> 48) & 65535 WHERE u.volume_id IS NULL)
"""

SQL: dict[str, str] = {
    "p1_found": _PENDING,
    "p1_run": f"SELECT 1::INTEGER AS run, journal_id, usn, max(volume_id) AS volume_id, max(ticks) AS ticks, max(file_id) AS file_id, max(parent_id) AS parent_id, max(reason) AS reason FROM usn_record WHERE (journal_id, usn) IN ({_PENDING}) GROUP BY journal_id, usn",
    "p1_next_run": f"{_PENDING} EXCEPT SELECT journal_id, usn FROM (SELECT journal_id, usn FROM usn_record WHERE batch_id <= (SELECT (min(batch_id) + max(batch_id)) // 2 FROM usn_record) GROUP BY journal_id, usn HAVING NOT bool_or(batch_id IN ({_DONE})))",
    "p1_offsets": f"SELECT journal_id, max(o) AS next_usn FROM (SELECT journal_id, usn + 1 AS o FROM usn_record UNION ALL SELECT journal_id, next_usn FROM usn_batch WHERE batch_id IN ({_DONE}) AND next_usn > 0 AND (start_usn IS NULL OR next_usn >= start_usn)) GROUP BY journal_id",
    "p2_found": f"SELECT volume_id, file_id, last_usn FROM ({_FILES})",
    "p2_files": _FILES,
    "p2_merged": _FILES,
    "p4_found": f"{_STEPS} SELECT DISTINCT volume_id, snapshot_no, number, change_kind FROM d WHERE change_kind IS NOT NULL",
    "p4_incremental": f"{_STEPS} SELECT DISTINCT volume_id, snapshot_no, number, change_kind FROM d WHERE change_kind IS NOT NULL",
    "p4_details": f"{_STEPS} SELECT DISTINCT * FROM d WHERE change_kind IS NOT NULL",
    "p5_found": "SELECT journal_id, usn FROM usn_record GROUP BY journal_id, usn HAVING count(*) > 1",
    "p5_kept": "SELECT journal_id, usn, max(volume_id) AS volume_id, max(ticks) AS ticks, max(file_id) AS file_id, max(parent_id) AS parent_id, max(reason) AS reason FROM usn_record GROUP BY journal_id, usn",
    "p5_retried": "SELECT journal_id, usn, max(volume_id) AS volume_id, max(ticks) AS ticks, max(file_id) AS file_id, max(parent_id) AS parent_id, max(reason) AS reason FROM usn_record GROUP BY journal_id, usn",
    "p5_novel": "WITH b AS (SELECT min(batch_id) AS low, (max(batch_id) - min(batch_id)) // 3 + 1 AS span FROM usn_record), f AS (SELECT journal_id, usn, min((batch_id - low) // span)::INTEGER + 1 AS wave FROM usn_record, b GROUP BY journal_id, usn) SELECT wave, count(*) AS n_novel FROM f GROUP BY wave",
    "p6_found": _P6,
    "p6_tree": _TREE,
    "p6_descendants": _DESCENDANTS,
    "p7_found": f"{_REFS} SELECT DISTINCT source_table, owner_id, row_key, attr_id FROM lost",
    "p7_report": f"{_REFS} SELECT source_table, period, count(*) AS n_orphans FROM lost GROUP BY source_table, period",
}
