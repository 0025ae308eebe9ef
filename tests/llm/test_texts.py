"""Packing, splitting and mixing against plain Python."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siltstone.llm import mixing, packing, splitting
from siltstone.llm.cuts import Text
from siltstone.llm.tokens import default_pattern, default_vocabulary, token_counts, tokenizer
from tests.conftest import rows

WORDS = "alpha beta, gamma. delta! über straße 日本語。 код 🙂🙂 x1y2 return(foo)\n line\n\n \t {};".split(" ")


@pytest.fixture(scope="module")
def coder():
    return tokenizer(default_vocabulary(), default_pattern())


def texts():
    r = random.Random(4)
    out = [None, "", " ", "a", "one line\r\nanother\r\n\r\nthird", "x" * 5000, "🙂" * 900, "日本語" * 700, " " * 3000, "\n" * 2000, "0f3a" * 1500, "ab cd " * 4000]
    for _ in range(150):
        out.append(" ".join(r.choice(WORDS) for _ in range(r.choice([1, 5, 20, 60, 200, 900]))))
    return out + out[:20]


def documents(spark):
    data = [(i, t, "k", 1, "txt") for i, t in enumerate(texts())]
    return spark.createDataFrame(data, "doc_id bigint, text string, key string, n_tokens int, max_tokens string").repartition(5)


def test_token_counts(spark, coder):
    got = dict(rows(token_counts(documents(spark), "doc_id", "text")))
    assert got == {i: len(coder.encode(t or "")) for i, t in enumerate(texts())}


@pytest.mark.parametrize(("limit", "overlap"), [(50, 5), (320, 32), (1, 0), (7, 6), (64, 0)])
def test_pieces(coder, limit, overlap):
    for t in texts():
        whole = Text(t or "", coder)
        found = splitting.bisect(whole, limit, overlap)
        if whole.n <= limit:
            assert found == [(0, 0, whole.n, whole.n)]
            continue
        assert found[0][:2] == (0, 0) and found[-1][2] == whole.n and len(found) > 1
        for (_, _, end, _), (lead, a, b, _) in zip(found, found[1:]):
            assert a == end < b
            assert lead <= max(0, a - overlap) <= lead + 3  # moved back to the start of a character at most
        for lead, a, b, size in found:
            own = coder.encode(whole.piece(lead, b))
            assert size == len(own)
            one_character = not any(whole.strength[i] >= 0 for i in range(a + 1, b))
            assert len(own) <= limit or one_character
        assert "".join(whole.piece(a, b) for _, a, b, _ in found) == (t or "")


def test_cuts_fall_at_pauses(coder):
    paragraphs = "\n\n".join("word " * 39 + "end." for _ in range(8))
    whole = Text(paragraphs, coder)
    for _, a, _, _ in splitting.bisect(whole, 100, 0)[1:]:
        assert whole.strength[a] == 5 and whole.piece(0, a).endswith("\n\n")
    sentences = Text("One two three four five six. " * 100, coder)
    assert all(sentences.strength[a] == 3 for _, a, _, _ in splitting.bisect(sentences, 64, 0)[1:])


def test_piece_table(spark, coder):
    got = splitting.pieces(documents(spark), "doc_id", "text", [(320, 32), (50, 5)])
    assert got.columns == ["max_tokens", "doc_id", "piece_no", "n_pieces", "first_token", "n_tokens", "n_overlap", "first_char", "n_chars", "text"]
    known = texts()
    by = defaultdict(list)
    for r in got.collect():
        text = known[r["doc_id"]] or ""
        assert r["text"] == text[r["first_char"] : r["first_char"] + r["n_chars"]] and r["n_tokens"] == len(coder.encode(r["text"])) <= r["max_tokens"]
        by[r["max_tokens"], r["doc_id"]].append(r["piece_no"])
    assert len(by) == 2 * len(known) and all(sorted(x) == list(range(len(x))) for x in by.values())
    assert splitting.pieces(documents(spark).limit(0), "doc_id", "text", [(320, 32)]).count() == 0
    for wrong in ((50, 50), (7, 100), (7, -1)):
        with pytest.raises(ValueError, match="overlap"):
            splitting.pieces(documents(spark), "doc_id", "text", [(320, 32), wrong])


@pytest.mark.parametrize("windows", [1, 8, 64])
def test_packing(spark, coder, windows):
    known = texts()
    capacities = [256, 64]
    items = packing.pack(documents(spark), "doc_id", "text", capacities, windows).collect()
    used, parts = defaultdict(int), defaultdict(list)
    for r in items:
        used[r["max_tokens"], r["container_id"]] += r["n_tokens"]
        parts[r["max_tokens"], r["doc_id"]].append(r)
    assert all(n <= c for (c, _), n in used.items())
    assert len(parts) == len(capacities) * len(known)
    for (capacity, doc), found in parts.items():
        text, found = known[doc] or "", sorted(found, key=lambda r: r["part_no"])
        n = len(coder.encode(text))
        assert (len(found) > 1) == (n > capacity) and all(r["n_parts"] == len(found) for r in found)
        assert all(r["n_tokens"] == len(coder.encode(text[r["first_char"] : r["first_char"] + r["n_chars"]])) for r in found)
        assert "".join(text[r["first_char"] : r["first_char"] + r["n_chars"]] for r in found) == text
        assert all(len(coder.encode(text[r["first_char"] : r["first_char"] + r["n_chars"]])) <= capacity for r in found)
    for capacity in capacities:
        sizes = [n for (c, _), n in used.items() if c == capacity]
        assert windows < 8 or sum(sizes) / capacity / len(sizes) > 0.93


def test_packing_nothing(spark):
    assert packing.pack(documents(spark).limit(0), "doc_id", "text", [64]).count() == 0


def test_merging_is_bounded(spark, monkeypatch):
    """Windows that fit nowhere go through ever fewer groups; a group never gets more than those of its tasks and leaves few open."""
    tasks, windows, capacity = 40, 4, 100
    sizes, plain = [], packing._merger(windows)

    def watched(w):
        def merge(key, left):
            assert left.num_rows <= packing.MERGE_BY * windows
            return plain(key, left)

        return merge

    monkeypatch.setattr(packing, "_merger", watched)
    monkeypatch.setattr(packing, "MERGE_BY", 4)
    for size in (80, 30):
        left = [(capacity, (t << 40) + w, size) for t in range(tasks) for w in range(windows)]
        moved = packing.merge_open(spark.createDataFrame(left, "max_tokens int, container_id bigint, n_tokens int"), windows).collect()
        assert len(moved) == len({r["container_id"] for r in moved}) == tasks * windows
        used = defaultdict(int)
        for r in moved:
            used[r["into_id"]] += size
        assert max(used.values()) <= capacity and set(used) <= {i for _, i, _ in left}
        sizes.append(len(used))
    assert sizes[0] == 160 and sizes[1] <= 160 * 30 / 90 * 1.2


def test_a_character_larger_than_the_container(spark):
    got = packing.pack(spark.createDataFrame([(1, "\U00012345\U00012345")], "doc_id bigint, text string"), "doc_id", "text", [2]).collect()
    assert [r["n_chars"] for r in got] == [1, 1] and len({r["container_id"] for r in got}) == 2


def test_windows_place_best_fit():
    w = packing.Windows(10, 2)
    assert [w.place(s) for s in (6, 7, 3, 4)] == [0, 1, 1, 0] and w.full == [1, 0]
    assert [w.place(s) for s in (8, 9, 5)] == [2, 3, 4] and w.full == [1, 0, 3] and w.place(0) == 2


TARGETS = [
    (1, "a", 1.0, 1), (1, " B ", 1.0, 3), (1, "none", 0.5, 9),
    (2, "A", 3.0, 4), (2, "b", 1.0, 1), (2, None, 1.0, 1), (3, "b", 0.0, 2), (3, "c", 1.0, None), (None, "c", 1.0, 1), (4, "a", None, 1),
]


def sized(spark, n=4000):
    r = random.Random(2)
    data = [(i, r.choice(["a"] * 6 + ["b"] * 3 + ["c", None]), r.choice([0, 1, 3, 10, 40, 100, r.randrange(1, 900)])) for i in range(n)]
    return data, spark.createDataFrame(data, "doc_id bigint, source string, n_tokens bigint").repartition(3)


def test_mixing(spark):
    data, sizes = sized(spark)
    targets = spark.createDataFrame(TARGETS, "mix_id int, source string, weight double, max_repeats int")
    state = mixing.balance(sizes, targets, mixing.histogram(sizes))
    chosen = mixing.copies(sizes, state).cache()
    have = defaultdict(int)
    for _, s, n in data:
        have[s] += n
    whole = sum(n for *_, n in data)
    wanted = {(1, "a"): (0.4, 1), (1, "b"): (0.4, 3), (1, "none"): (0.2, 9), (2, "a"): (0.75, 4), (2, "b"): (0.25, 1), (3, "b"): (0.0, 2), (3, "c"): (1.0, 1)}
    got = {(r["mix_id"], r["source"]): r for r in mixing.shares(state, chosen).collect()}
    assert got.keys() == wanted.keys()
    for k, (share, cap) in wanted.items():
        r = got[k]
        reachable = have[k[1]] * cap >= share * whole
        assert r["converged"]
        assert r["reachable"] == reachable and abs(r["share"] - share) < 1e-12
        if reachable:
            assert abs(r["tokens"] - share * whole) <= max(2000, 0.02 * share * whole), (k, r)
        else:
            assert r["tokens"] == have[k[1]] * cap
        assert r["most_copies"] <= cap
    ids = {i: (s, n) for i, s, n in data}
    for r in chosen.collect():
        assert ids[r["doc_id"]] == (r["source"], r["n_tokens"]) and 1 <= r["copies"] <= 4
    assert chosen.count() == chosen.select("mix_id", "doc_id").distinct().count()


def test_mixing_nothing(spark):
    _, sizes = sized(spark, 10)
    targets = spark.createDataFrame(TARGETS, "mix_id int, source string, weight double, max_repeats int")
    none = sizes.limit(0)
    state = mixing.balance(none, targets, mixing.histogram(none))
    assert state.where("NOT reachable").count() == 0 and mixing.copies(none, state).count() == 0
    assert mixing.balance(sizes, targets.limit(0), mixing.histogram(sizes)).count() == 0


def test_sources_are_compared_plainly(spark):
    got = spark.createDataFrame([(" Wiki-Talk\t",), (None,), ("",)], "s string").select(mixing.plain_source(F.col("s")).alias("s"))
    assert [r["s"] for r in got.collect()] == ["wiki-talk", None, ""]
