from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siltstone.llm.runs import stretches
from tests.conftest import rows

SCHEMA = "j bigint, f bigint, usn bigint, ticks bigint, reason bigint, symbol string, head int, e0 string"


def brute(data, gap, least):
    by = {}
    for j, f, usn, ticks, reason in data:
        if None not in (j, f, usn):
            by.setdefault((j, f), {})[usn] = (ticks, reason)
    out = []
    for (j, f), events in by.items():
        run = []
        for usn in sorted(events):
            ticks, reason = events[usn]
            near = run and None not in (ticks, reason, *run[-1][1:]) and reason == run[-1][2] and abs(ticks - run[-1][1]) <= gap
            if not near:
                out += [(j, f, run)] if len(run) >= least else []
                run = []
            run.append((usn, ticks, reason))
        out += [(j, f, run)] if len(run) >= least else []
    return sorted((j, f, r[0][0], r[-1][0], len(r), (r[-1][1] or 0) - (r[0][1] or 0)) for j, f, r in out)


def make(spark, data):
    return spark.createDataFrame([(*r, "s", 1, "e") for r in data], SCHEMA)


@pytest.mark.parametrize(("seed", "batch", "parts"), [(1, 3, 4), (2, 1, 7), (3, 10000, 1), (4, 7, 3)])
def test_against_plain_python(spark, seed, batch, parts):
    r = random.Random(seed)
    data, ticks = [], 0
    for usn in range(600):
        ticks += r.choice([0, 1, 5, 10, 11, 50, -9])
        f = r.choice([1, 1, 1, 1, 2, 3])
        data.append((r.choice([1, 1, 2]), f, usn, r.choice([ticks] * 20 + [None]), r.choice([1, 1, 1, 1, 2, 2**32, None])))
    data += [(1, 1, 2000 + i, 5, 9) for i in range(150)]  # a stretch over many batches and tasks
    data += data[100:300] + [data[5]] * 300 + [(None, 1, 1, 1, 1), (1, None, 1, 1, 1), (1, 1, None, 1, 1)]
    r.shuffle(data)
    old = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for least in (1, 3):
            got = stretches(make(spark, data), ["j", "f"], "usn", "ticks", F.col("reason"), 10, least)
            known = brute(data, 10, least)
            assert rows(got.select("j", "f", "first_usn", "last_usn", "n_events", "duration")) == known
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_empty(spark):
    assert stretches(make(spark, []), ["j", "f"], "usn", "ticks", F.col("reason"), 10, 3).count() == 0
