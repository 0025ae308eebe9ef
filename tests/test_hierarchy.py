from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import hierarchy
from siltstone.operators.hierarchy import descendants, endless, nested_sets
from tests.conftest import rows

SCHEMA = "v int, n bigint, p bigint, label string, tree string, node int"
ENDS = "v int, n bigint"


def make(spark, links):
    return spark.createDataFrame([(*x, f"/{x[1]}", "t", 1) for x in links], SCHEMA)


def brute_endless(links, ends):
    nodes = {x[:2] for x in links if None not in x[:2]} - set(ends)
    up = {x: set() for x in nodes}
    for v, n, p in links:
        if (v, n) in nodes and p is not None and (v, p) in nodes:
            up[v, n].add((v, p))
    good = set()
    while True:
        more = {x for x in nodes - good if up[x] <= good}
        if not more:
            return sorted(nodes - good)
        good |= more


def random_links(seed, several=False, n=120):
    r = random.Random(seed)
    links = []
    for v in (1, 2):
        for i in range(n):
            p = r.choice([None, 3, r.randrange(n), max(0, i - 1), max(0, i - 1), max(0, i - r.randrange(1, 9)), 9999])
            links.append((v, i, p))
            if several and r.random() < 0.2:
                links.append((v, i, r.randrange(n)))
    return links + links[:30] + [(None, 1, 2), (1, None, 2)]


@pytest.fixture(params=[hierarchy.LOCAL, 20], ids=["local", "swept"])
def local(request, monkeypatch):
    monkeypatch.setattr(hierarchy, "LOCAL", request.param)
    return request.param


def test_paths_too_long_for_a_task(spark, monkeypatch):
    """The tree with many characters is swept, the other is not; both get their paths."""
    monkeypatch.setattr(hierarchy, "MOST_TEXT", 50)
    links = [(1, i, i - 1 if i else None) for i in range(9)] + [(2, 1, None), (2, 2, 1), (2, 3, 2)]
    got = {(r["v"], r["n"]): r["path"] for r in nested_sets(make(spark, links), "v", "n", "p", F.col("label")).collect()}
    assert got == {(v, n): "".join(f"/{x}" for x in range(v - 1, n + 1)) for v, n, _ in links}


def test_endless_against_peeling(spark, local):
    links, ends = random_links(3, True, n=60), [(1, 0), (2, 0), (2, 50)]
    got = endless(make(spark, links), "v", "n", "p", spark.createDataFrame(ends, ENDS))
    assert rows(got) == brute_endless(links, ends)


def test_one_node_with_several_parents_does_not_change_the_others(spark):
    """A circle, a chain, and two inner nodes with several parents, of which one hangs from the circle through the other."""
    links = [(1, i, i - 1 if i else None) for i in range(40)] + [(1, 50, 51), (1, 51, 50)]
    links += [(1, 60, 39), (1, 60, 20), (1, 61, 60), (1, 70, 61), (1, 70, 51), (1, 71, 70), (1, 80, 71), (1, 80, 3), (1, 81, 80), (1, 90, 10), (1, 90, 61)]
    got = endless(make(spark, links), "v", "n", "p")
    assert rows(got) == brute_endless(links, []) == [(1, n) for n in (50, 51, 70, 71, 80, 81)]


def test_nested_sets(spark, local):
    for seed in (7,):
        links = random_links(seed)
        parent = {(v, n): p for v, n, p in links if None not in (v, n)}
        lost = set(brute_endless(links, []))
        got = {(r["v"], r["n"]): r for r in nested_sets(make(spark, links), "v", "n", "p", F.col("label")).collect()}
        assert got.keys() == parent.keys()
        below = {k: set() for k in parent}
        for (v, n), p in parent.items():
            r = got[v, n]
            if (v, n) in lost:
                assert (r["root"], r["depth"], r["lft"], r["rgt"], r["path"]) == (None,) * 5
                continue
            chain = [n]
            while p is not None and (v, p) in parent:
                below[v, p].add((v, n))
                chain.append(p)
                p = parent[v, p]
            assert (r["root"], r["depth"], r["path"]) == (chain[-1], len(chain) - 1, "".join(f"/{x}" for x in reversed(chain)))
        for v in (1, 2):
            placed = {k: r for k, r in got.items() if k[0] == v and k not in lost}
            assert sorted(r["lft"] for r in placed.values()) == list(range(len(placed)))
            for k, r in placed.items():
                inside = {j for j, x in placed.items() if r["lft"] < x["lft"] <= r["rgt"]}
                assert inside == below[k] and r["n_below"] == len(inside)


def test_long_chain_and_self_loop(spark):
    chain = [(1, i, i - 1 if i else None) for i in range(70)] + [(1, 1000, 1000), (1, 1001, 1000)]
    got = {r["n"]: r for r in nested_sets(make(spark, chain), "v", "n", "p").collect()}
    assert (got[69]["depth"], got[0]["n_below"], got[69]["root"]) == (69, 69, 0)
    assert got[1000]["lft"] is None and got[1001]["lft"] is None
    assert rows(endless(make(spark, chain), "v", "n", "p")) == [(1, 1000), (1, 1001)]


def test_a_chain_of_100000_and_nothing(spark):
    chain = spark.range(100_000).select(F.lit(1).alias("v"), F.col("id").alias("n"), (F.col("id") - 1).alias("p"))
    got = nested_sets(chain, "v", "n", "p")
    assert got.where("depth <> n OR lft <> n OR n_below <> 99999 - n").count() == 0 and got.count() == 100_000
    assert endless(chain, "v", "n", "p").count() == 0
    empty = make(spark, [])
    assert nested_sets(empty, "v", "n", "p").count() == 0 and endless(empty, "v", "n", "p").count() == 0
    assert descendants(nested_sets(empty, "v", "n", "p"), empty, "v", "n").count() == 0


def test_descendants(spark):
    links = random_links(5)
    parent = {(v, n): p for v, n, p in links if None not in (v, n)}
    lost = set(brute_endless(links, []))
    below = []
    for (v, n), p in parent.items():
        distance = 1
        while (v, n) not in lost and p is not None and (v, p) in parent:
            below.append((v, p, n, distance))
            p, distance = parent[v, p], distance + 1
    ranges = nested_sets(make(spark, links), "v", "n", "p")
    assert rows(descendants(ranges, ranges, "v", "n")) == sorted(below)
    some = [(1, 0, None), (2, 7, None), (2, 7, None), (2, 9999, None)]
    assert rows(descendants(ranges, make(spark, some), "v", "n")) == sorted(x for x in below if x[:2] in {(1, 0), (2, 7)})
