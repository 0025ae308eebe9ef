from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from siltstone import session
from siltstone.operators import dedup_index
from siltstone.operators.dedup_index import DedupIndex, first_copies
from tests.conftest import rows

SCHEMA = "a bigint, b bigint, h string, prefix int, copies int, best int"


def make(spark, ids):
    return spark.createDataFrame([(*i, "x", 1, 2, 3) for i in ids], SCHEMA)


def test_waves_against_a_counter(spark, home, monkeypatch):
    monkeypatch.setattr(dedup_index, "PER_PREFIX", 8)  # makes the prefix grow
    monkeypatch.setattr(dedup_index, "BLOCK", 16)
    r = random.Random(1)
    index, seen, refused = DedupIndex(spark, home, ["a", "b"], merge_every=2), Counter(), set()
    for wave in range(5):
        ids = [(7, 7)] * 60 + [(r.randrange(-30, 30), r.randrange(6)) for _ in range(120)]
        run = index.admit(make(spark, ids), f"wave {wave}")
        assert DedupIndex(spark, home, ["a", "b"]).admit(make(spark, ids), f"wave {wave}") == run  # admitted again: the same run
        counts = Counter(ids)
        fresh = sorted(i for i in counts if not seen[i])
        refused |= {i for i in counts if seen[i] or counts[i] > 1}
        seen += counts
        assert rows(index.novel(run)) == fresh
    assert rows(index.repeated()) == sorted(refused)
    assert len(index._manifest()["runs"]) <= 3 and index._manifest()["bits"] > 4
    assert len(index.merge()["runs"]) == 1
    assert index.novel(index.admit(make(spark, list(seen)))).count() == 0


def test_tiers(spark, home):
    """Two runs of a tier become one of the next; runs of other tiers stay."""
    index = DedupIndex(spark, home, ["a", "b"], merge_every=2)
    tiers = []
    for n in range(6):
        index.admit(make(spark, [(n, 0), (n, 1), (0, 0)]))
        tiers.append([r["tier"] for r in index._manifest()["runs"]])
    assert tiers == [[0], [0, 0], [1, 0], [1, 0, 0], [2, 0], [2, 0, 0]]
    assert rows(index.repeated()) == [(0, 0)]


class Crash(Exception):
    pass


OPERATIONS = ("latest_version", "put_version")


@pytest.mark.parametrize("at", [0, 1, 3, 5, 6])
def test_a_crash_at_any_step_neither_loses_nor_repeats(spark, home, monkeypatch, at):
    """The n-th access to the manifest fails; the batch is then admitted again by a new index."""
    waves = [[(1, 1), (1, 1), (2, 2)], [(2, 2), (3, 3)], [(3, 3), (4, 4), (1, 1)]]
    calls = [0]

    def failing(name):
        plain = getattr(session, name)

        def call(*args):
            calls[0] += 1
            if calls[0] == 2 * at + 1:
                raise Crash
            return plain(*args)

        return call

    for name in OPERATIONS:
        monkeypatch.setattr(dedup_index, name, failing(name))
    handed_on = []
    for n, ids in enumerate(waves):
        for _ in range(3):
            try:
                index = DedupIndex(spark, home, ["a", "b"], merge_every=2)
                batch = make(spark, ids)
                run = index.admit(batch, f"wave {n}", len(ids))
                got = rows(index.kept(batch, run).select("a", "b"))
                break
            except Crash:
                continue
        handed_on += got
    assert sorted(handed_on) == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert rows(DedupIndex(spark, home, ["a", "b"]).repeated()) == [(1, 1), (2, 2), (3, 3)]


def test_runs_without_a_manifest_are_refused(spark, home):
    index = DedupIndex(spark, home, ["a", "b"])
    index.admit(make(spark, [(1, 1)]))
    for name in session.list_names(spark, home):
        if name.startswith("manifest"):
            session.remove(spark, f"{home}/{name}")
    with pytest.raises(OSError, match="no manifest"):
        index.admit(make(spark, [(1, 1)]))


def test_versions_are_kept_and_never_replaced(spark, home):
    for n in range(12):
        assert session.put_version(spark, home, "m", f"text {n}") == n
    assert session.latest_version(spark, home, "m") == (11, "text 11")
    assert session.list_names(spark, home) == [f"m-{n:09d}" for n in range(3, 12)]
    with pytest.raises(OSError, match="another writer"):
        session.put_text(spark, f"{home}/m-000000011", "x")
    assert session.latest_version(spark, home, "other") is None


def test_nulls_and_empty_batches(spark, home):
    index = DedupIndex(spark, home, ["a", "b"])
    index.admit(make(spark, []))
    index.admit(make(spark, [(None, 1), (None, 1), (1, None), (2, 2)]))
    assert index.repeated().count() == 0
    last = make(spark, [(2, 2), (None, 1), (3, 3), (3, 3)])
    run = index.admit(last)
    assert rows(index.repeated()) == [(2, 2), (3, 3)]
    assert rows(index.kept(last, run).select("a", "b", "h")) == [(None, 1, "x"), (3, 3, "x")]


def test_equal_hashes_are_told_apart():
    hashes, keys = np.array([5, 5, 5, 9]), [np.array([1, 2, 3, 1])]
    got = dedup_index._found(hashes, keys, np.array([5, 5, 9, 9, 1]), [np.array([3, 4, 1, 2, 1])])
    assert got.tolist() == [True, False, True, False, False]


def test_first_copies_keep_the_fullest(spark):
    df = spark.createDataFrame([(1, 1, None, 1, None, 5), (1, 1, "z", 1, 2, 5), (None, 1, "q", 1, 1, 1), (None, 1, "q", 1, 1, 1)], SCHEMA)
    assert rows(first_copies(df, ["a", "b"])) == [(None, 1, "q", 1, 1, 1), (None, 1, "q", 1, 1, 1), (1, 1, "z", 1, 2, 5)]
