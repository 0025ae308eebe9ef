from __future__ import annotations

import random

from siltstone.operators.references import orphan_keys, orphans_by_period
from tests.conftest import rows


def test_against_sets(spark):
    r = random.Random(3)
    refs = [(r.choice([0, 1]), r.choice([None, 1, 2, 3]), r.choice([None, 1, 2]), r.choice([None, *range(-20, 40)])) for _ in range(400)] + [(0, 1, 1, 33)] * 300
    have = [(r.choice([None, 1, 2]), r.choice([None, *range(-20, 40)])) for _ in range(60)]
    a = spark.createDataFrame([(*x, "c", 1) for x in refs], "g int, period int, v int, ref bigint, bucket string, k0 int")
    b = spark.createDataFrame([(*x, "c") for x in have], "v int, ref bigint, bucket string")
    for buckets in (1, 7):
        got = orphan_keys(a, b, ["v", "ref"], "g", "period", buckets)
        expected = {x for x in refs if None not in x[2:] and x[2:] not in set(have)}
        assert set(rows(got)) == expected and got.count() == len(expected)


def test_empty_sides(spark):
    a = spark.createDataFrame([(0, 5, 1, 2), (0, 5, 1, 2)], "g int, period int, v int, ref bigint")
    none = a.limit(0)
    assert rows(orphan_keys(a, none, ["v", "ref"], "g", "period", 3)) == [(0, 5, 1, 2)]
    assert orphan_keys(none, a, ["v", "ref"], "g", "period", 3).count() == 0
    assert rows(orphans_by_period(a, "g", "period")) == [(0, 5, 2)]
