"""Queries over volume images and journal captures, and the SQL over the tables they were made from.

Images and captures are written once and read with the data sources; a few queries decode records that
no image has.  The SQL side never sees a byte of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import layout, tables
from siltstone.functions.columns import filetime_to_timestamp, flag, in_use, is_directory, journal_ticks, reason_text, unsigned
from siltstone.functions.references import RECORD_MASK, make_reference, record_number, same_file_id, sequence_number
from siltstone.operators import files, journal
from siltstone.plans import encode
from siltstone.session import scratch_path, written
from siltstone.sources import datasource
from siltstone.sources.records import decode_records
from siltstone.sources.usn import DECODED as DECODED_RECORDS
from siltstone.sources.usn import accepted_buffers, decode_buffers, read_records

#: The root, which every volume has.
PROBE_RECORD = layout.ROOT_RECORD
TRIM_USN = 1_000_000
LIMIT = 8
#: Directories in the chain of ``mft_paths_deep``.
DEEP = 1100
MASK = layout.REASON["FILE_CREATE"] | layout.REASON["FILE_DELETE"]


def _images(spark: SparkSession, sf_dir: str, path: str | None = None, **options: object) -> DataFrame:
    """The records of images through the source; the image is the number of the volume."""
    datasource.register(spark)
    read = spark.read.format("siltstone_mft").option("path", path or encode.mft_image_files(spark, sf_dir) + "/volume-*.img")
    for name, value in options.items():
        read = read.option(name, str(value))
    return read.load().withColumn("image", F.regexp_extract("image", r"volume-(\d+)\.img$", 1))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir)


def _keys(df: DataFrame, *columns) -> DataFrame:
    return df.select(F.col("image").cast("int").alias("volume_id"), "record_number", *columns)


def mft_record_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records whose bit is set, of all numbers that the images have."""
    return _keys(files.record_exists(_records(spark, sf_dir)).where("record_exists"), "record_exists")


def mft_is_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of records of each volume that are valid; all other numbers of the table are zeros or holes."""
    whole = _images(spark, sf_dir).groupBy("image").agg(F.count_if("is_valid").alias("n_valid"), F.max(F.when(F.col("is_valid"), F.col("record_number"))).alias("last"))
    return whole.select(F.col("image").cast("int").alias("volume_id"), "n_valid", "last")


def mft_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid records with numbers 64 to 5000 and nothing of the others: the source skips their partitions."""
    found = _images(spark, sf_dir, first=64, last=5000, bytesPerPartition=1 << 20)
    return _keys(found.where("is_valid"), "sequence")


def mft_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of all volumes without names: record number, reference, directory flag."""
    info = files.used_files(_records(spark, sf_dir))
    return _keys(info, make_reference(F.col("sequence"), F.col("record_number")).alias("reference_number"), is_directory(F.col("flags")).alias("is_directory"))


def mft_get_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.get_record(_records(spark, sf_dir), PROBE_RECORD)
    return _keys(found, "sequence", "flags", "base_reference")


def mft_best_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = files.best_names(_records(spark, sf_dir))
    return _keys(names, F.col("name.name").alias("name"), F.col("name.namespace").alias("namespace"), record_number(F.col("name.parent_reference")).alias("parent"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full paths of all records, under the path of their volume."""
    records = _records(spark, sf_dir)
    volumes = spark.read.parquet(f"{sf_dir}/volumes.parquet").select(F.col("volume_id").cast("string").alias("image"), F.col("path").alias("volume"))
    paths = files.full_paths(records, F.lit(""))
    return paths.join(volumes, "image", "left").select("image", "record_number", "name", F.when(F.col("path") != "", F.concat("volume", "path")).otherwise(F.lit("")).alias("path"))


def mft_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name and full path of every record."""
    return _keys(_paths(spark, sf_dir), "name", "path")


def mft_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The complete listing: files with name, path, size and times."""
    records = _records(spark, sf_dir)
    volumes = spark.read.parquet(f"{sf_dir}/volumes.parquet").select(F.col("volume_id").cast("string").alias("image"), F.col("path").alias("volume"))
    listed = files.files(records, F.lit("")).join(volumes, "image", "left")
    path = F.when(F.col("path") != "", F.concat("volume", "path")).otherwise(F.lit("")).alias("path")
    return _keys(listed, "name", path, "is_directory", F.col("size").cast("bigint").alias("size"), "created", "accessed", "modified")


def mft_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(files.file_info(_records(spark, sf_dir)), "created", "accessed", "modified")


def mft_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attribute with its place and type."""
    return _keys(files.attributes(_records(spark, sf_dir)), "ordinal", F.col("type_id").cast("bigint").alias("type_id"), "id", "non_resident")


def mft_attribute_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name attributes of every record, through the table function over raw records."""
    tables.register(spark)
    _images(spark, sf_dir, output="raw").where("allocated").createOrReplaceTempView("siltstone_raw_records")
    rows = spark.sql("SELECT r.image, r.record_number, a.* FROM siltstone_raw_records r, LATERAL siltstone_attributes(r.raw) a WHERE a.name IS NOT NULL")
    return _keys(rows, "ordinal", F.col("id").alias("attr_id"), "name", "namespace", record_number(F.col("parent_reference")).alias("parent"))


def mft_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of every name attribute and of its record."""
    rows = _records(spark, sf_dir).where("is_valid").select("image", "record_number", "flags", F.explode("attributes").alias("a")).where("a.name IS NOT NULL")
    bits = F.col("a.name.file_attributes")
    names = {"is_readonly": layout.READ_ONLY, "is_hidden": layout.HIDDEN, "is_system": layout.SYSTEM, "is_reparse_point": layout.REPARSE_POINT}
    return _keys(rows, F.col("a.id").alias("attr_id"), in_use(F.col("flags")).alias("is_used"), is_directory(F.col("flags")).alias("is_directory"), *[flag(bits, b).alias(n) for n, b in names.items()])


def mft_ref_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference of every record, taken apart again."""
    reference = make_reference(F.col("sequence"), F.col("record_number"))
    rows = _records(spark, sf_dir).where("is_valid").withColumn("reference_number", reference)
    return _keys(rows, "reference_number", sequence_number(F.col("reference_number")).alias("sequence"), record_number(F.col("reference_number")).alias("low_bits"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_records(encode.document_images(spark, sf_dir))


def mft_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of every volume file, from its stream, resident or not."""
    return _keys(files.file_info(_records(spark, sf_dir)), F.col("size").cast("bigint").alias("size"))


def mft_named_stream_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of every document: that of its last data stream, which may be a named one."""
    rows = _documents(spark, sf_dir).withColumn("record_number", F.col("record_number") + layout.FIRST_NORMAL_RECORD)
    return files.file_info(rows).select((F.col("record_number") - layout.FIRST_NORMAL_RECORD).alias("doc_id"), F.col("size").cast("bigint").alias("size"))


def mft_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents of every document, read from its image: resident, or in two runs of clusters."""
    datasource.register(spark)
    records = spark.read.format("siltstone_mft").option("path", encode.document_image_file(spark, sf_dir)).load()
    found = files.read_contents(records.where(F.col("record_number") >= layout.FIRST_NORMAL_RECORD)).where("error IS NULL")
    return found.select((F.col("record_number") - layout.FIRST_NORMAL_RECORD).alias("doc_id"), F.decode("data", "UTF-8").alias("text"))


def mft_listed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of records whose names all lie in other records, told by an attribute list."""
    names = files.best_names(decode_records(encode.listed_name_images(spark, sf_dir)))
    return _keys(names.where(F.col("record_number") < 1 << 40), F.col("name.name").alias("name"), F.col("name.namespace").alias("namespace"))


def mft_paths_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths below a chain of more directories than a path may have, and on a circle: the nearest 1,024."""
    paths = files.full_paths(decode_records(encode.chain_images(spark, sf_dir, DEEP)), F.lit(""))
    return _keys(paths.where("record_number <> 5"), "name", "path")


def mft_read_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents that are kept in the record itself."""
    return files.read_data(_documents(spark, sf_dir)).select(F.col("record_number").alias("doc_id"), F.decode(F.col("data"), "UTF-8").alias("text")).where("text IS NOT NULL")


def mft_data_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of the contents that are not: position and length in bytes."""
    runs = files.data_runs(_documents(spark, sf_dir), F.lit(4096)).where("error IS NULL")
    return runs.select(F.col("record_number").alias("doc_id"), "data_size", F.posexplode("runs").alias("position", "run")).select("doc_id", "data_size", "position", "run.kind", "run.lcn", "run.length")


# --- journal -------------------------------------------------------------------------------------


def _usn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/usn_record.parquet")


def _buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The read buffers of all journals through the source."""
    datasource.register(spark)
    return spark.read.format("siltstone_usn").option("path", encode.journal_captures(spark, sf_dir)).load()


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_buffers(_buffers(spark, sf_dir))


def _plain(df: DataFrame, *columns) -> DataFrame:
    return df.select(F.col("journal").cast("bigint").alias("journal_id"), "usn", *columns)


def usn_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = [journal.reference_of(F.col(c)).alias(c) for c in ("file_id", "parent_id")]
    return _plain(_decoded(spark, sf_dir), "major", "ticks", F.col("file_id.kind").alias("kind"), *ids, "reason", "name")


def usn_reason_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(read_records(_buffers(spark, sf_dir), MASK), "reason")


def usn_reason_str(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).select("reason", reason_text(F.col("reason")).alias("reason_text"), "n")


def usn_timestamp_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = journal_ticks(F.col("ticks"))
    return _plain(_decoded(spark, sf_dir), ticks.alias("ticks"), (unsigned(ticks) * 100).cast("decimal(20,0)").cast("string").alias("nanoseconds"), filetime_to_timestamp(ticks).alias("at"))


def usn_start_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(read_records(_buffers(spark, sf_dir), start=TRIM_USN))


def usn_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader sees that starts after all that is there: nothing."""
    return _plain(read_records(_buffers(spark, sf_dir), start="next"))


def usn_is_own_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether file and parent are the same id."""
    return _plain(_decoded(spark, sf_dir), same_file_id(F.col("file_id"), F.col("parent_id")).alias("same"))


def usn_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all journals from a usn on and with a reason in the mask, as a stream that ends and is started again."""
    datasource.register(spark)
    home = scratch_path(spark, "usn-stream")
    source = spark.readStream.format("siltstone_usn").option("path", encode.journal_captures(spark, sf_dir)).option("startingUsn", str(TRIM_USN)).option("progress", f"{home}/progress")
    for most in (40, 1000):
        records = datasource.decode_stream(source.option("maxBuffersPerTrigger", str(most)).load(), MASK, TRIM_USN)
        query = records.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return _plain(spark.read.schema(DECODED_RECORDS).parquet(f"{home}/out"), "reason")


def usn_version_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without a name are written as version 4, which a reader passes over."""
    rows = _usn(spark, sf_dir).withColumn("major", F.when(F.col("name").isNull(), 4).otherwise(F.col("major")))
    return _plain(decode_buffers(encode.usn_buffers(rows)), "major", "name")


def usn_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The read batches that a cursor accepts: next offset neither 0 nor before the highest so far."""
    taken = accepted_buffers(encode.batch_buffers(spark, sf_dir))
    return taken.select(F.col("journal").cast("bigint").alias("journal_id"), F.col("seq").alias("log_no"), "next_usn")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct decoded records, with the bare name as path."""
    records = _decoded(spark, sf_dir).groupBy("journal", "usn").agg(F.max("file_id").alias("file_id"), F.max("reason").alias("reason"), F.max("name").alias("path"))
    return records


def _matched(df: DataFrame) -> DataFrame:
    return _plain(df, journal.reference_of(F.col("file_id")).alias("file_id"), "path", "renamed_from")


def usn_rename_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(journal.match_renames(written(_events(spark, sf_dir), "events")))


def usn_rename_match_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(journal.match_renames(written(_events(spark, sf_dir), "events"), TRIM_USN))


def usn_rename_match_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of the last LIMIT entries of a journal; a read buffer is 65,536 bytes of the journal."""
    events = _events(spark, sf_dir).withColumn("seq", F.floor(F.col("usn") / 65536))
    return _matched(journal.match_renames_limited(written(events, "events"), LIMIT))


def usn_enrich_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the journal records as of the file records, by volume."""
    found = files.full_paths(_records(spark, sf_dir), F.lit(""))
    paths = found.select(F.col("image").alias("journal"), F.col("reference_number").alias("reference"), "path")
    # A journal belongs to one volume.
    owner = _usn(spark, sf_dir).groupBy(F.col("journal_id").cast("string").alias("journal")).agg(F.max("volume_id").cast("string").alias("volume"))
    records = _decoded(spark, sf_dir).join(owner, "journal").withColumn("journal", F.col("volume")).drop("volume")
    return _plain(journal.with_paths(records, paths), "path").withColumnRenamed("journal_id", "volume_id").withColumn("volume_id", F.col("volume_id").cast("int")).distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        mft_record_exists, mft_is_valid, mft_range, mft_contents, mft_listed_names, mft_paths_deep, mft_files, mft_get_record, mft_best_name, mft_paths, mft_listing, mft_times, mft_attributes, mft_attribute_function, mft_flags, mft_ref_number, mft_size, mft_named_stream_size, mft_read_data, mft_data_runs,
        usn_decode, usn_reason_mask, usn_reason_str, usn_timestamp_ticks, usn_start_custom, usn_next, usn_is_own_parent, usn_stream, usn_version_mix, usn_cursor, usn_rename_match, usn_rename_match_trimmed, usn_rename_match_limited, usn_enrich_path,
    )
}

_ALL = f"""all_records AS (
  SELECT volume_id, record_number, sequence, flags, allocated, base_reference, created, modified, accessed FROM mft_record
  UNION ALL SELECT volume_id, record_number, sequence, flags, true, 0, NULL, NULL, NULL FROM system_record),
all_names AS (
  SELECT DISTINCT volume_id, record_number, attr_id, coalesce(parent_reference, {RECORD_MASK}) & {RECORD_MASK} AS parent, namespace, coalesce(file_attributes, 0) AS attributes, coalesce(real_size, 0) AS size, coalesce(name, '') AS name FROM file_name
  UNION ALL SELECT volume_id, record_number, 0, parent_reference & {RECORD_MASK}, namespace, 6, 0, name FROM system_record),
known AS (SELECT n.* FROM all_names n SEMI JOIN all_records r USING (volume_id, record_number)),
best AS (
  SELECT volume_id, record_number, coalesce(arg_min(n, attr_id) FILTER (namespace IN (1, 3)), arg_max(n, attr_id)) AS b FROM (SELECT *, {{'name': name, 'namespace': namespace, 'parent': parent}} AS n FROM known WHERE attributes & 1024 = 0) GROUP BY volume_id, record_number)
"""
_WALK = f"""WITH RECURSIVE {_ALL},
walk(volume_id, record_number, next, above, n) AS (
  SELECT volume_id, record_number, b.parent, '', 0 FROM best
  UNION ALL
  SELECT w.volume_id, w.record_number, p.b.parent, '\\' || p.b.name || w.above, w.n + 1 FROM walk w JOIN best p ON p.volume_id = w.volume_id AND p.record_number = w.next WHERE w.next <> 5 AND w.n < 1024),
reached AS (SELECT volume_id, record_number, above FROM walk WHERE next = 5 OR n = 1024),
paths AS (SELECT r.volume_id, r.record_number, coalesce(b.b.name, '') AS name, coalesce(v.path || w.above || '\\' || b.b.name, '') AS path
  FROM all_records r LEFT JOIN best b USING (volume_id, record_number) LEFT JOIN reached w USING (volume_id, record_number) LEFT JOIN volumes v USING (volume_id))
"""
_REFERENCE = "((CASE WHEN sequence >= 32768 THEN sequence - 65536 ELSE sequence END)::BIGINT * 281474976710656 + record_number)"
_EPOCH = "TIMESTAMP '1970-01-01'"
_TIMES = ", ".join(f"coalesce({c}, {_EPOCH}) AS {c}" for c in ("created", "accessed", "modified"))
_USED = f"record_number >= {layout.FIRST_NORMAL_RECORD} AND allocated AND flags & 1 = 1"
_BYTES = "octet_length(encode(coalesce(text, '')))"
_EVENTS = "events_once AS (SELECT journal_id, usn, max(file_id) AS file_id, max(reason) AS reason, max(coalesce(name, '')) AS path FROM usn_record GROUP BY journal_id, usn)"
_OLD = f"reason & {journal.HISTORY} <> 0"
_NEW = f"reason & {journal.NEW_NAME} <> 0"


def _rename_sql(more: str = "") -> str:
    return f"""WITH {_EVENTS}, h AS (SELECT journal_id, file_id, usn, path FROM events_once WHERE {_OLD} {more})
SELECT e.journal_id, e.usn, e.file_id, any_value(e.path) AS path, arg_min(h.path, h.usn) AS renamed_from FROM events_once e LEFT JOIN h ON h.journal_id = e.journal_id AND h.file_id = e.file_id AND h.usn < e.usn WHERE e.{_NEW} GROUP BY e.journal_id, e.usn, e.file_id"""


_REASON_CASES = " || ".join(f"CASE WHEN reason & {bit} <> 0 THEN '{name} ' ELSE '' END" for name, bit in layout.REASONS)
_TICKS = "greatest(ticks, 0)"

SQL: dict[str, str] = {
    "mft_record_exists": f"WITH {_ALL} SELECT volume_id, record_number, allocated AS record_exists FROM all_records WHERE allocated",
    "mft_is_valid": f"WITH {_ALL} SELECT volume_id, count(*) AS n_valid, max(record_number) AS last FROM all_records GROUP BY volume_id",
    "mft_range": f"WITH {_ALL} SELECT volume_id, record_number, sequence FROM all_records WHERE record_number BETWEEN 64 AND 5000",
    "mft_contents": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "mft_listed_names": f"WITH {_ALL}, usable AS (SELECT volume_id, record_number, arg_min({{'name': name, 'namespace': namespace}}, attr_id) AS b FROM known WHERE attributes & 1024 = 0 GROUP BY volume_id, record_number) SELECT volume_id, record_number, b.name AS name, b.namespace AS namespace FROM usable",
    "mft_paths_deep": f"""WITH chain AS (SELECT volume_id, unnest(range(24, {24 + DEEP}))::BIGINT AS record_number FROM volumes)
      SELECT volume_id, record_number, 'd' || record_number AS name, array_to_string(list_transform(range(greatest(24, record_number - 1024), record_number + 1), lambda x: '\\d' || x), '') AS path FROM chain
      UNION ALL SELECT volume_id, {24 + DEEP} + k AS record_number, 'd' || ({24 + DEEP} + k) AS name, array_to_string(list_transform(range(1025), lambda x: '\\d' || ({24 + DEEP} + (x + k) % 2)), '') AS path FROM volumes, (SELECT unnest([0, 1]) AS k)""",
    "mft_files": f"WITH {_ALL} SELECT volume_id, record_number, {_REFERENCE} AS reference_number, flags & 2 = 2 AS is_directory FROM all_records WHERE {_USED}",
    "mft_get_record": f"WITH {_ALL} SELECT volume_id, record_number, sequence, flags, coalesce(base_reference, 0) AS base_reference FROM all_records WHERE record_number = {PROBE_RECORD}",
    "mft_best_name": f"WITH {_ALL} SELECT volume_id, record_number, b.name AS name, b.namespace AS namespace, b.parent AS parent FROM best",
    "mft_paths": f"{_WALK} SELECT volume_id, record_number, name, path FROM paths",
    "mft_listing": f"{_WALK}, sizes AS (SELECT volume_id, record_number, max(size) AS size FROM known GROUP BY volume_id, record_number) SELECT volume_id, record_number, name, path, flags & 2 = 2 AS is_directory, coalesce(size, 0) AS size, {_TIMES} FROM paths JOIN all_records USING (volume_id, record_number) LEFT JOIN sizes USING (volume_id, record_number) WHERE {_USED}",
    "mft_times": f"WITH {_ALL} SELECT volume_id, record_number, {_TIMES} FROM all_records WHERE {_USED}",
    "mft_attributes": f"""WITH {_ALL}, k AS (SELECT *, row_number() OVER (PARTITION BY volume_id, record_number ORDER BY attr_id)::INTEGER AS nth, count(*) OVER (PARTITION BY volume_id, record_number)::INTEGER AS n FROM known)
      SELECT volume_id, record_number, 0 AS ordinal, 16::BIGINT AS type_id, 0 AS id, false AS non_resident FROM all_records
      UNION ALL SELECT volume_id, record_number, nth, 48, attr_id, false FROM k UNION ALL SELECT volume_id, record_number, n + 1, 128, 0, true FROM k WHERE nth = 1
      UNION ALL SELECT volume_id, record_number, n + 2, 176, 0, true FROM k WHERE nth = 1 AND record_number = 0""",
    "mft_attribute_function": f"WITH {_ALL} SELECT volume_id, record_number, row_number() OVER (PARTITION BY volume_id, record_number ORDER BY attr_id)::INTEGER AS ordinal, attr_id, name, namespace, parent FROM known JOIN all_records USING (volume_id, record_number) WHERE allocated",
    "mft_flags": f"WITH {_ALL} SELECT volume_id, record_number, attr_id, flags & 1 = 1 AS is_used, flags & 2 = 2 AS is_directory, attributes & 1 = 1 AS is_readonly, attributes & 2 = 2 AS is_hidden, attributes & 4 = 4 AS is_system, attributes & 1024 = 1024 AS is_reparse_point FROM known JOIN all_records USING (volume_id, record_number)",
    "mft_ref_number": f"WITH {_ALL} SELECT volume_id, record_number, {_REFERENCE} AS reference_number, sequence, record_number AS low_bits FROM all_records",
    "mft_size": f"WITH {_ALL}, sizes AS (SELECT volume_id, record_number, max(size) AS size FROM known GROUP BY volume_id, record_number) SELECT volume_id, record_number, coalesce(size, 0) AS size FROM all_records LEFT JOIN sizes USING (volume_id, record_number) WHERE {_USED}",
    "mft_named_stream_size": f"SELECT doc_id, coalesce(octet_length(encode(title)), {_BYTES})::BIGINT AS size FROM documents",
    "mft_read_data": f"SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE {_BYTES} <= 512",
    "mft_data_runs": f"""WITH d AS (SELECT doc_id, {_BYTES}::BIGINT AS data_size FROM documents WHERE {_BYTES} > 512)
      SELECT doc_id, data_size, 0 AS position, 'data' AS kind, (doc_id + 1000) * 4096 AS lcn, (data_size + 4095) // 4096 * 4096 AS length FROM d
      UNION ALL SELECT doc_id, data_size, 1, 'sparse', NULL, 8192 FROM d UNION ALL SELECT doc_id, data_size, 2, 'data', (doc_id + 500) * 4096, 4096 FROM d""",
    "usn_decode": "SELECT journal_id, usn, major, ticks, CASE major WHEN 3 THEN 'extended' ELSE 'normal' END AS kind, file_id, coalesce(parent_id, 0) AS parent_id, reason, coalesce(name, '') AS name FROM usn_record",
    "usn_reason_mask": f"SELECT journal_id, usn, reason FROM usn_record WHERE reason & {MASK} <> 0",
    "usn_reason_str": f"SELECT reason, {_REASON_CASES} AS reason_text, count(*) AS n FROM usn_record GROUP BY reason",
    "usn_timestamp_ticks": f"SELECT journal_id, usn, {_TICKS} AS ticks, ({_TICKS}::HUGEINT * 100)::VARCHAR AS nanoseconds, make_timestamp(greatest({_TICKS} - {layout.EPOCH_TICKS}, 0) // 10) AS at FROM usn_record",
    "usn_start_custom": f"SELECT journal_id, usn FROM usn_record WHERE usn >= {TRIM_USN}",
    "usn_next": "SELECT journal_id, usn FROM usn_record WHERE false",
    "usn_is_own_parent": "SELECT journal_id, usn, file_id = coalesce(parent_id, 0) AS same FROM usn_record",
    "usn_stream": f"SELECT journal_id, usn, reason FROM usn_record WHERE usn >= {TRIM_USN} AND reason & {MASK} <> 0",
    "usn_version_mix": "SELECT journal_id, usn, major, name FROM usn_record WHERE name IS NOT NULL",
    "usn_cursor": """WITH l AS (SELECT DISTINCT journal_id, log_no, next_usn FROM usn_batch WHERE next_usn IS NOT NULL),
      c AS (SELECT *, coalesce(max(next_usn) OVER (PARTITION BY journal_id ORDER BY log_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS highest FROM l)
      SELECT journal_id, log_no, next_usn FROM c WHERE next_usn <> 0 AND next_usn >= greatest(highest, 0)""",
    "usn_rename_match": _rename_sql(),
    "usn_rename_match_trimmed": _rename_sql(f"AND usn > {TRIM_USN}"),
    "usn_rename_match_limited": f"""WITH {_EVENTS}, s AS (SELECT *, usn // 65536 AS seq FROM events_once),
      h AS (SELECT *, row_number() OVER (PARTITION BY journal_id ORDER BY seq, usn) AS ordinal FROM s WHERE {_OLD}),
      ends AS (SELECT journal_id, seq, max(ordinal) AS last FROM h GROUP BY journal_id, seq),
      p AS (SELECT e.journal_id, e.usn, e.file_id, e.path, coalesce((SELECT max(last) FROM ends x WHERE x.journal_id = e.journal_id AND x.seq <= e.seq), 0) AS last FROM s e WHERE {_NEW})
      SELECT p.journal_id, p.usn, p.file_id, any_value(p.path) AS path, arg_min(h.path, h.ordinal) AS renamed_from FROM p LEFT JOIN h ON h.journal_id = p.journal_id AND h.file_id = p.file_id AND h.usn < p.usn AND h.ordinal > p.last - {LIMIT} AND h.ordinal <= p.last
      GROUP BY p.journal_id, p.usn, p.file_id""",
    "usn_enrich_path": f"""{_WALK}, refs AS (SELECT volume_id, {_REFERENCE} AS reference, substr(p.path, length(v.path) + 1) AS path FROM paths p JOIN all_records USING (volume_id, record_number) JOIN (SELECT volume_id, path FROM volumes) v USING (volume_id) WHERE p.path <> '')
      SELECT DISTINCT u.volume_id, u.usn, coalesce(p.path || '\\' || coalesce(u.name, ''), o.path, coalesce(u.name, '')) AS path FROM usn_record u LEFT JOIN refs p ON p.volume_id = u.volume_id AND p.reference = coalesce(u.parent_id, 0) LEFT JOIN refs o ON o.volume_id = u.volume_id AND o.reference = u.file_id""",
}
