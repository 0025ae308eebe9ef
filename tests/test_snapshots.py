from __future__ import annotations

import random

import pytest

from siltstone.operators import snapshots
from siltstone.operators.snapshots import SnapshotStore, change_details, snapshot_changes
from tests.conftest import rows

SCHEMA = "v int, s int, number bigint, path string, size bigint, kind string, bucket int, tree string"
LOG = "v int, s int, pos string"


def make(spark, data):
    return spark.createDataFrame([(*r, "k", 1, "t") for r in data], SCHEMA)


def brute(data, log):
    state = {}
    for v, s, n, path, size in data:
        if None not in (v, s, n):
            state.setdefault((v, s), {})[n] = (path, size)
    out = []
    for v in {x for x, _ in log}:
        steps = sorted({s for x, s in log if x == v})
        for before, after in zip(steps, steps[1:]):
            old, new = state.get((v, before), {}), state.get((v, after), {})
            out += [(v, after, n, "added") for n in new.keys() - old.keys()] + [(v, after, n, "removed") for n in old.keys() - new.keys()]
            out += [(v, after, n, "changed") for n in new.keys() & old.keys() if new[n] != old[n]]
    return sorted(out)


def random_snapshots(seed):
    r = random.Random(seed)
    log = [(v, s) for v in (1, 2, 3) for s in range(1, 7) if r.random() < 0.8]
    data = []
    for v in (1, 2, 4):  # 3 is logged without rows, 4 has rows without a log
        for s in range(1, 7):
            if r.random() < 0.2:
                continue
            data += [(v, s, n, r.choice(["a", "b", None, ""]), r.choice([1, 2, None])) for n in range(60) if r.random() < 0.5]
    data += data[:50] + [data[0]] * 200 + [(None, 1, 1, "a", 1), (1, None, 1, "a", 1), (1, 1, None, "a", 1)]
    r.shuffle(data)
    return data, log


def frames(spark, data, log):
    return make(spark, data), spark.createDataFrame([(*x, "p") for x in log], LOG)


def run(spark, data, log, bits=2):
    return snapshot_changes(*frames(spark, data, log), "v", "s", "number", ["path", "size"], bits)


def test_against_plain_python(spark):
    for seed, bits in ((1, 0), (2, 2), (3, 3)):
        data, log = random_snapshots(seed)
        assert rows(run(spark, data, log, bits)) == brute(data, log)


def store(spark, home):
    return SnapshotStore(spark, home, "v", "s", "number", ["path", "size"])


def test_snapshots_that_keep_coming(spark, home, monkeypatch):
    """Buckets split as keys are added, ordinals stay, and only new snapshots are compared."""
    monkeypatch.setattr(snapshots, "PER_BUCKET", 64)
    data, log = random_snapshots(5)
    got, before, bits = [], {}, []
    for until in (2, 4, 6):
        mine = [x for x in log if x[1] <= until]
        now = rows(store(spark, home).advance(*frames(spark, [x for x in data if x[1] is None or x[1] <= until], mine), f"week {until}"))
        again = store(spark, home).advance(*frames(spark, [], []), f"week {until}")
        assert rows(again) == now  # a call that is known gives what it gave
        got += now
        after = {(r["tree"], r["number"]): r["ordinal"] for r in store(spark, home).ordinals().collect()}
        assert all(after[k] == o for k, o in before.items())
        placed = [(r["bucket"], r["ordinal"]) for r in store(spark, home).ordinals().collect()]
        assert len(set(placed)) == len(placed) == len(after)
        before, bits = after, [*bits, store(spark, home)._state()["bits"]]
    assert sorted(got) == brute(data, log)
    assert bits == sorted(bits) and bits[0] >= 1
    newer = rows(store(spark, home).advance(*frames(spark, [(1, 7, 3, "z", 1)], [*log, (1, 7)])))  # the rows of the last one are stored
    last = max(s for v, s in log if v == 1)
    assert newer == [x for x in brute([x for x in data if x[1] != 7] + [(1, 7, 3, "z", 1)], [(1, last), (1, 7)])]
    missing = next(s for s in range(1, 7) if (2, s) not in log or s == 6)
    if (2, missing) not in log:
        with pytest.raises(ValueError, match="was compared"):
            store(spark, home).advance(*frames(spark, data, [*log, (2, missing)]))


def test_copies_that_disagree_give_the_same_in_any_order(spark):
    """The greatest by value counts, column by column; null is the least."""
    data = [(1, s, n, p, size) for n in range(200) for s in (1, 2) for p, size in (("a", 2), ("b", None), ("b", 1), (None, 9))]
    want = brute([(1, s, n, "b", 1) for n in range(200) for s in (1, 2)], [(1, 1), (1, 2)])
    r = random.Random(1)
    for parts in (1, 3, 7):
        r.shuffle(data)
        rows_, log = frames(spark, data, [(1, 1), (1, 2)])
        assert rows(snapshot_changes(rows_.repartition(parts), log, "v", "s", "number", ["path", "size"], 1)) == want == []


def test_empty_and_missing_snapshots(spark):
    assert run(spark, [], [(1, 1), (1, 2)]).count() == 0
    assert run(spark, [(1, 1, 5, "a", 1)], []).count() == 0
    assert rows(run(spark, [(1, 1, 5, "a", 1), (1, 3, 5, "a", 1)], [(1, 1), (1, 2), (1, 3)])) == [(1, 2, 5, "removed"), (1, 3, 5, "added")]


def test_details_have_both_sides(spark):
    data, log = [(1, 1, 5, "a", 1), (1, 2, 5, None, 1), (1, 2, 6, "b", 2)], [(1, 1), (1, 2)]
    frame = spark.createDataFrame([(*x, "p") for x in log], LOG)
    got = change_details(run(spark, data, log), make(spark, data), frame, "v", "s", "number", ["path", "size"])
    assert {(r["number"], r["change_kind"], r["old_path"], r["new_path"], r["old_size"], r["new_size"]) for r in got.collect()} == {(5, "changed", "a", None, 1, 1), (6, "added", None, "b", None, 2)}
