from __future__ import annotations

import random
from datetime import datetime

from pyspark.sql import functions as F

from siltstone.operators.changes import apply_changes, current
from tests.conftest import rows

SCHEMA = "j bigint, usn bigint, v int, f bigint, reason bigint, name string, parent bigint, k0 string, seq string"


def make(spark, data):
    return spark.createDataFrame([(*r, "x", "y") for r in data], SCHEMA)


def apply(base, changes):
    return apply_changes(base, changes, ["j", "usn"], ["v", "f"], "usn", F.col("reason").bitwiseAND(F.lit(0x200)) != 0, ["name", "parent"])


def brute(data):
    out = {}
    for j, usn, v, f, reason, name, parent in sorted((r for r in data if None not in r[:4]), key=lambda r: r[1]):
        row = out.setdefault((v, f), [None, False, None, None])
        row[0], row[1] = usn, bool((reason or 0) & 0x200)
        row[2], row[3] = name if name is not None else row[2], parent if parent is not None else row[3]
    return sorted((*k, r[0], r[2], r[3]) for k, r in out.items() if not r[1])


def random_changes(seed, n=300):
    r = random.Random(seed)
    out = []
    for usn in range(n):
        f = r.choice([1, 1, 1, 2, 3, 4, 5, 6])  # one hot file
        row = (f % 2, usn, f % 2, f, r.choice([1, 0x100, 0x200, 0x300, None]), r.choice([None, f"n{usn}"]), r.choice([None, usn]))
        out += [row] * r.choice([1, 1, 3]) + [(*row[:5], None, None)] * r.choice([0, 0, 1])
    r.shuffle(out)
    return out


def test_against_plain_python(spark):
    for seed in range(3):
        data = random_changes(seed)
        got = current(apply(None, make(spark, data)), ["v", "f"], "last_usn", ["name", "parent"])
        assert rows(got) == brute(data)


def test_merging_in_any_order_gives_the_same(spark):
    data = random_changes(9)
    whole = brute(data)
    for cut in (100, 400):
        base = apply(None, make(spark, data[:cut]))
        assert rows(current(apply(base, make(spark, data[cut:])), ["v", "f"], "last_usn", ["name", "parent"])) == whole


def test_a_tombstone_outlives_an_older_change(spark):
    base = apply(None, make(spark, [(1, 20, 1, 1, 0x200, None, None)]))
    state = apply(base, make(spark, [(1, 10, 1, 1, 0x100, "old", 5)]))
    assert current(state, ["v", "f"], "last_usn").count() == 0
    assert rows(current(apply(state, make(spark, [(1, 30, 1, 1, 1, None, None)])), ["v", "f"], "last_usn", ["name", "parent"])) == [(1, 1, 30, "old", 5)]


def test_nulls_ties_and_empty(spark):
    data = [(None, 1, 1, 1, 1, "a", 1), (1, None, 1, 1, 1, "a", 1), (1, 1, None, 1, 1, "a", 1), (1, 1, 1, None, 1, "a", 1), (1, 5, 1, 2, None, None, None)]
    assert rows(current(apply(None, make(spark, data)), ["v", "f"], "u", ["name", "parent"])) == [(1, 2, 5, None, None)]
    assert current(apply(None, make(spark, [])), ["v", "f"], "u").count() == 0
    tie = [(1, 5, 1, 2, 1, "a", 1), (2, 5, 1, 2, 0x200, "b", 2)]  # the greater identifier counts
    assert current(apply(None, make(spark, tie)), ["v", "f"], "u").count() == 0


def test_carried_columns_keep_their_type(spark):
    """Structs, arrays, maps, bytes and times pass through as they are."""
    schema = "i bigint, k bigint, seq bigint, a array<int>, s struct<x:int,y:string>, m map<string,int>, t timestamp_ntz, b binary"
    at = datetime(2024, 10, 27, 2, 30)
    data = [(1, 1, 1, [1, 2], (1, "q"), {"u": 1}, at, bytearray(b"\xff\x00")), (2, 1, 2, None, None, None, None, None), (3, 1, 3, [3], None, None, None, None)]
    columns = ["a", "s", "m", "t", "b"]
    got = current(apply_changes(None, spark.createDataFrame(data, schema), ["i"], ["k"], "seq", F.lit(False), columns), ["k"], "seq", columns)
    assert got.schema["m"].dataType.simpleString() == "map<string,int>"
    assert [tuple(r) for r in got.collect()] == [(1, 3, [3], (1, "q"), {"u": 1}, at, bytearray(b"\xff\x00"))]
