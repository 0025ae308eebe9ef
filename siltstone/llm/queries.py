"""Queries p3, p8, p9 and p10: event stretches, packing, mixing and splitting, and the SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm import mixing, packing, runs, splitting, tokens
from siltstone.session import written

CLOSE = 0x8000_0000
GAP_TICKS = 300_000_000
LEAST = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _limits(spark: SparkSession, sf_dir: str, purpose: str) -> list[tuple[int, int]]:
    """The rows of the parameter table token_limit for a purpose, largest limit first."""
    rows = table(spark, sf_dir, "token_limit").where(F.col("purpose") == purpose).select("max_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("overlap")).distinct().collect()
    return sorted(((r["max_tokens"], r["overlap"]) for r in rows), reverse=True)


def _stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbol = F.col("reason").bitwiseAND(F.lit(~CLOSE))
    return runs.stretches(table(spark, sf_dir, "usn_record"), ["journal_id", "file_id"], "usn", "ticks", symbol, GAP_TICKS, LEAST)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stretches(spark, sf_dir).select("journal_id", "file_id", "first_usn", "last_usn")


def p3_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stretch with its number of records, duration in ticks and reason without CLOSE."""
    return _stretches(spark, sf_dir).withColumnRenamed("symbol", "reason")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", [c for c, _ in _limits(spark, sf_dir, "container")])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).where("n_parts > 1").select("max_tokens", "doc_id").distinct()


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or of every part of a divided one."""
    return _packed(spark, sf_dir)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(_packed(spark, sf_dir))


def p8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document and capacity: the characters in its parts, whether these follow each other without gap, and whether their containers hold no more than fits."""
    items = written(_packed(spark, sf_dir), "packed")
    fits = packing.containers(items).select("max_tokens", "container_id", (F.col("unused") >= 0).alias("fits"))
    return _coverage(items.join(fits, ["max_tokens", "container_id"]), "part_no", F.col("first_char"), F.col("first_char") + F.col("n_chars"), F.col("fits"))


def _coverage(parts: DataFrame, number: str, first: F.Column, end: F.Column, fits: F.Column) -> DataFrame:
    """(max_tokens, doc_id, n_chars, gapless, fits): a part begins where the one before it ends."""
    w = Window.partitionBy("max_tokens", "doc_id").orderBy(number)
    checked = parts.select("max_tokens", "doc_id", end.alias("end"), (first == F.coalesce(F.lag(end).over(w), F.lit(0))).alias("gapless"), fits.alias("fits"))
    return checked.groupBy("max_tokens", "doc_id").agg(F.max("end").cast("bigint").alias("n_chars"), F.bool_and("gapless").alias("gapless"), F.bool_and("fits").alias("fits"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", ["source"])
    return written(counted.withColumn("source", mixing.plain_source(F.col("source"))), "mixing-sizes")


def _balanced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = _sizes(spark, sf_dir)
    counts = written(mixing.histogram(sizes), "mixing-histogram")
    return sizes, mixing.balance(sizes, table(spark, sf_dir, "mix_target"), counts)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, state = _balanced(spark, sf_dir)
    return state.where("NOT reachable").select("mix_id", "source")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted and reached share of every source of every mix."""
    sizes, state = _balanced(spark, sf_dir)
    return mixing.shares(state, written(mixing.copies(sizes, state), "mixing-copies"))


def p9_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (mix, source): the share wanted, and whether lambda was found and no document is taken too often or from elsewhere.

    ``close``: the tokens reached are within a hundredth of the target and twice the longest document, or
    all documents were taken as often as allowed and still fall short.
    """
    sizes, state = _balanced(spark, sf_dir)
    reached = mixing.shares(state, written(mixing.copies(sizes, state), "mixing-copies"))
    caps = state.select("mix_id", "source", "cap")
    longest = sizes.agg(F.coalesce(F.max("n_tokens"), F.lit(0)).alias("longest")).first()["longest"]
    full = ~F.col("reachable") & (F.col("tokens") == F.col("available") * F.col("cap"))
    close = full | (F.abs(F.col("tokens") - F.col("target")) <= F.col("target") / 100 + 2 * longest)
    return reached.join(caps, ["mix_id", "source"]).select("mix_id", "source", F.round("share", 9).alias("share"), "converged", (F.col("most_copies") <= F.col("cap")).alias("within_repeats"), close.alias("close"))


def p9_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many copies of each document a mix takes."""
    sizes, state = _balanced(spark, sf_dir)
    return mixing.copies(sizes, state)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = splitting.pieces(table(spark, sf_dir, "documents"), "doc_id", "text", _limits(spark, sf_dir, "piece"), with_text=False)
    return cut.where("n_pieces > 1 AND piece_no = 0").select("max_tokens", "doc_id").distinct()


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece with its text and position."""
    return splitting.pieces(table(spark, sf_dir, "documents"), "doc_id", "text", _limits(spark, sf_dir, "piece"))


def p10_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document and limit: the characters in its pieces, whether these leave no gap, and whether each keeps the limit.

    The first character of a piece that is not overlap is where the piece before it ends.
    """
    found = written(p10_pieces(spark, sf_dir), "pieces")
    end = F.col("first_char") + F.col("n_chars")
    w = Window.partitionBy("max_tokens", "doc_id").orderBy("piece_no")
    joined = F.when(F.col("piece_no") == 0, F.col("first_char") == 0).otherwise((F.col("first_char") <= F.lag(end).over(w)) & (end > F.lag(end).over(w)) & ((F.col("n_overlap") > 0) | (F.col("first_char") == F.lag(end).over(w))))
    checked = found.select("max_tokens", "doc_id", end.alias("end"), joined.alias("gapless"), (F.col("n_tokens") <= F.col("max_tokens")).alias("fits"), (F.length("text") == F.col("n_chars")).alias("whole"))
    return checked.groupBy("max_tokens", "doc_id").agg(F.max("end").cast("bigint").alias("n_chars"), F.bool_and(F.col("gapless") & F.col("whole")).alias("gapless"), F.bool_and("fits").alias("fits"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p3_found, p3_runs, p8_found, p8_items, p8_containers, p8_coverage, p9_found, p9_shares, p9_copies, p9_balance, p10_found, p10_pieces, p10_coverage)}

_RUNS = f"""
WITH r AS (SELECT journal_id, file_id, usn, max(ticks) AS ticks, max(reason) & ~{CLOSE}::BIGINT AS reason FROM usn_record GROUP BY journal_id, file_id, usn),
n AS (SELECT *, CASE WHEN reason = lag(reason) OVER w AND abs(ticks - lag(ticks) OVER w) <= {GAP_TICKS} THEN 0 ELSE 1 END AS begins FROM r WINDOW w AS (PARTITION BY journal_id, file_id ORDER BY usn)),
g AS (SELECT *, sum(begins) OVER (PARTITION BY journal_id, file_id ORDER BY usn ROWS UNBOUNDED PRECEDING) AS g FROM n)
SELECT journal_id, file_id, min(usn) AS first_usn, max(usn) AS last_usn, count(*) AS n_events, arg_max(ticks, usn) - arg_min(ticks, usn) AS duration, max(reason) AS reason FROM g GROUP BY journal_id, file_id, g HAVING count(*) >= {LEAST}
"""

_PLAIN = "lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g'))"


def _covered(purpose: str) -> str:
    return f"SELECT max_tokens, doc_id, length(coalesce(text, '')) AS n_chars, true AS gapless, true AS fits FROM documents, (SELECT DISTINCT max_tokens FROM token_limit WHERE purpose = '{purpose}')"


#: SQL cannot count tokens.  It states what must hold of the results that are counted here; the rest is tested against plain Python.
SQL: dict[str, str] = {
    "p3_runs": _RUNS,
    "p3_found": f"SELECT journal_id, file_id, first_usn, last_usn FROM ({_RUNS})",
    "p8_coverage": _covered("container"),
    "p9_balance": f"SELECT mix_id, source, round(sum(weight) / sum(sum(weight)) OVER (PARTITION BY mix_id), 9) AS share, true AS converged, true AS within_repeats, true AS close FROM (SELECT mix_id, {_PLAIN} AS source, weight FROM mix_target WHERE weight IS NOT NULL) GROUP BY mix_id, source",
    "p10_coverage": _covered("piece"),
}
