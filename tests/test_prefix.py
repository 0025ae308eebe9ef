from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import skew
from siltstone.operators.prefix import before
from siltstone.session import written
from tests.conftest import rows


@pytest.mark.parametrize(("operation", "parts"), [("sum", 1), ("sum", 5), ("max", 5)])
def test_running_values_against_plain_python(spark, operation, parts):
    """A hot group spreads over all partitions; sparse numbers, nulls and text in the group."""
    r = random.Random(parts)
    data = [(1, r.choice([None, "a", "a", "a", "b"]), n * 10**9, r.randrange(-5 if operation == "max" else 0, 50)) for n in range(300)]
    df = spark.createDataFrame(data, "tree bigint, at string, node bigint, size bigint").repartition(parts)
    got = {x["node"]: x["run"] for x in before(df, ["tree", "at"], "node", "size", "run", "t", operation).collect()}
    nothing = [0] if operation == "sum" else [-(1 << 63)]
    assert got == {n: (sum if operation == "sum" else max)(nothing + [s for _, b, m, s in data if b == a and m < n]) for _, a, n, _ in data}
    assert before(df.limit(0), ["tree", "at"], "node", "size", "run", "t", operation).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_keys_are_spread_and_nothing_else_changes(spark, monkeypatch, how):
    monkeypatch.setattr(skew, "LEAST", 100)
    left = spark.range(900).select((F.when(F.col("id") < 300, 7).when(F.col("id") < 600, 8).when(F.col("id") < 650, None).otherwise(F.col("id"))).alias("k"), F.lit(1).alias("j"), F.col("id"), F.lit("s").alias("salt"), F.lit(0).alias("is_hot"))
    right = spark.createDataFrame([(7, 1, "x"), (7, 1, "y"), (700, 1, "z"), (701, 2, "w")], "k bigint, j int, v string")
    hot = skew.hot_keys(left, ["j", "k"])
    assert rows(hot) == [(1, 7), (1, 8)]
    assert skew.sent_to_all(written(right, "t"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not skew.sent_to_all(written(right, "t"))
        spread = skew.spread_join(left, right, ["j", "k"], how, F.col("id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert skew.SALT in spread._jdf.queryExecution().toString()
    assert rows(spread) == rows(left.join(right, ["j", "k"], how)) and spread.columns == left.join(right, ["j", "k"], how).columns
    assert skew.hot_keys(left.where("id > 650"), ["j", "k"]) is None
    assert [skew._bytes(x) for x in ("-1", "10485760b", "10MB", "2g")] == [-1, 10485760, 10 << 20, 2 << 30]
