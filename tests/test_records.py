from __future__ import annotations

import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.errors import SiltstoneError
from siltstone.functions import layout, tables
from siltstone.operators import files
from siltstone.plans import encode
from siltstone.sources import records
from tests.conftest import rows

W, D, P, B = layout.WIN32, layout.DOS, layout.POSIX, layout.WIN32_AND_DOS
REPARSE = 0x400


def name(text, namespace=W, parent=5, attributes=0):
    return encode.attribute(layout.FILE_NAME, encode.name_value(parent, text, namespace, attributes))


def listing(*entries):
    return encode.attribute(layout.ATTRIBUTE_LIST, encode.list_value([(layout.FILE_NAME, r) for r in entries]))


def table(spark, recs, mode="FAILFAST"):
    """recs: {number: raw} or {number: (raw, allocated)}."""
    data = [("v", n, *(r if isinstance(r, tuple) else (r, True))) for n, r in recs.items()]
    data = [(i, n, None if raw is None else bytearray(raw), a) for i, n, raw, a in data]
    return records.decode_records(spark.createDataFrame(data, "image string, record_number bigint, raw binary, allocated boolean"), mode)


def flags_of(spark, recs, mode="PERMISSIVE"):
    return {r["record_number"]: (r["is_valid"], r["corrupt"]) for r in table(spark, recs, mode).collect()}


def patched(raw, at, value):
    out = bytearray(raw)
    out[at : at + len(value)] = value
    return bytes(out)


GOOD = encode.record(1, 1, [name("a")])


def test_validity_rules(spark):
    got = flags_of(
        spark,
        {
            1: GOOD,
            2: patched(GOOD, 0, b"BAAD"),
            3: patched(GOOD, 24, struct.pack("<I", 1025)),  # used size beyond the record
            4: patched(GOOD, 20, struct.pack("<H", 2000)),  # attributes beyond the used size
            5: b"\0" * 1024,  # no update sequence: nothing to repair, then invalid
            6: patched(GOOD, 510, b"\xff\xff"),  # torn sector
            7: patched(GOOD, 6, struct.pack("<H", 600)),  # update sequence beyond the record
            8: b"FILE",
            9: None,
        },
    )
    assert got == {1: (True, False), 2: (False, False), 3: (False, False), 4: (False, False), 5: (False, False), 6: (False, True), 7: (False, True), 8: (False, True), 9: (False, True)}


def test_a_torn_sector_fails_the_job(spark):
    with pytest.raises(Exception, match="corrupt record 6"):
        table(spark, {1: GOOD, 6: patched(GOOD, 1022, b"\xff\xff")}).collect()
    with pytest.raises(SiltstoneError):
        records.decode_records(table(spark, {}), "SOMETIMES")


def test_sector_ends_are_put_back(spark):
    text = "ab" * 700
    raw = encode.record(1, 1, [encode.attribute(layout.DATA, text.encode())], size=2048)
    assert raw[510:512] == b"\x01\x02"
    assert files.read_data(table(spark, {30: raw})).first()["data"].decode() == text


def test_files_are_chosen(spark):
    recs = {24: GOOD, 23: GOOD, 25: (GOOD, False), 26: encode.record(1, 0, []), 27: encode.record(1, 3, [name("d")], base=99), 28: b"\0" * 1024}
    df = table(spark, recs)
    assert rows(files.used_files(df).select("record_number", "base_reference")) == [(24, 0), (27, 99)]
    assert rows(files.get_record(df, 23).select("record_number")) == [(23,)] and files.get_record(df, 28).count() == 0
    assert rows(files.file_info(df).select("record_number", "is_directory", "size", "created")) == [(24, False, 0, None), (27, True, 0, None)]


NAME_CASES = [
    ([name("w")], "w"),
    ([name("d", D), name("w")], "w"),
    ([name("p", P), name("d", D)], "d"),
    ([name("w", W, attributes=REPARSE), name("d", D)], "d"),
    ([name("w", W, attributes=REPARSE)], None),
    ([], None),
    ([listing(999), name("w")], None),  # missing record
    ([listing(101), name("w")], None),  # record without a name
    ([encode.stream_attribute(layout.ATTRIBUTE_LIST, 5, encode.run_list([(1, 1)])), name("w")], None),  # not in the record
    ([listing(100), name("w")], "w"),  # 100 has a short name
    ([listing(100)], "short"),
    ([listing(102), name("d", D)], "d"),
    ([listing(103), name("w")], "long"),
    ([listing(104, 103)], "long"),  # a reparse name is passed over
    ([listing(100, 103)], "short"),  # another name ends the list
    ([listing(100, 999), name("w")], "w"),  # so that what follows in it does not matter
    ([name("w1"), name("w2", B)], "w1"),
    ([name("p1", P), name("p2", P)], "p2"),
]


def test_best_name(spark):
    targets = {100: encode.record(1, 1, [name("short", D)]), 101: encode.record(1, 1, []), 102: encode.record(1, 1, [name("posix", P)]), 103: encode.record(1, 1, [name("long"), name("other")]), 104: encode.record(1, 1, [name("r", W, attributes=REPARSE)])}
    data = [(str(i), n, bytearray(raw), True) for i, (attributes, _) in enumerate(NAME_CASES) for n, raw in (targets | {50: encode.record(1, 1, attributes)}).items()]
    raw = spark.createDataFrame(data, "image string, record_number bigint, raw binary, allocated boolean")
    got = {int(r["image"]): r["name"] for r in files.best_names(records.decode_records(raw)).where("record_number = 50").select("image", "name.name").collect()}
    assert [got.get(i) for i in range(len(NAME_CASES))] == [expected for _, expected in NAME_CASES]


def test_size_and_times_are_those_of_the_last_attribute(spark):
    e = layout.EPOCH_TICKS
    std = [encode.attribute(layout.STANDARD_INFORMATION, encode.standard_information(e + t, e + 20, e + 39)) for t in (10, 70)]
    short = encode.attribute(layout.STANDARD_INFORMATION, b"\0" * 20)
    raw = encode.record(1, 1, [*std, short, encode.attribute(layout.DATA, b"12345"), encode.stream_attribute(layout.DATA, 1 << 63, b"\0", stream="ads")])
    row = files.file_info(table(spark, {40: raw})).first()
    assert int(row["size"]) == 1 << 63
    assert (row["created_ticks"], row["modified_ticks"], row["accessed_ticks"]) == (70, 20, 39)
    assert row["accessed"].isoformat() == "1970-01-01T00:00:00.000003"


def test_lone_surrogates(spark):
    value = struct.pack("<Q32xQQIIBB", 5, 0, 0, 0, 0, 3, W) + struct.pack("<HHH", 0xD800, 0x69, 0xDC00)
    raw = encode.record(1, 1, [encode.attribute(layout.FILE_NAME, value)])
    assert files.best_names(table(spark, {40: raw})).first()["name"]["name"] == "\ufffdi\ufffd"


def test_attributes_stop_where_they_are_broken(spark):
    raw = encode.record(1, 1, [name("a"), encode.attribute(layout.DATA, b"x")])
    first = struct.unpack_from("<H", raw, 20)[0]
    length = struct.unpack_from("<I", raw, first + 4)[0]
    for bad in (0, 5000):
        broken = patched(raw, first + length + 4, struct.pack("<I", bad))
        assert rows(files.attributes(table(spark, {40: broken})).select("ordinal", "type_id")) == [(0, layout.FILE_NAME)]
    assert rows(files.attributes(table(spark, {40: raw})).select("ordinal", "type_id")) == [(0, layout.FILE_NAME), (1, layout.DATA)]


RUNS = [
    (b"\x21\x02\x10\x00\x00", 4096, None),
    (b"\x11\x02\x10\x01\x03\x11\x01\xf8\x00", 100, None),  # backwards, with a hole
    (b"", 0, None),
    (b"\x11\x02\x10", 100, "unterminated data run sequence"),
    (b"\x10\x02\x00", 100, "invalid cluster count field"),
    (b"\x19\x02\x00", 100, "invalid cluster count field"),
    (b"\x91\x02\x00", 100, "invalid cluster offset field"),
    (b"\x14\x02\x00", 100, "unexpected end of run-length data"),
    (b"\x11\x00\x10\x00", 100, "cluster count is zero"),
    (b"\x18" + b"\xff" * 8 + b"\x01\x00", 100, "run length overflow"),
    (b"\x17" + b"\xff" * 6 + b"\x07\x01\x17" + b"\xff" * 6 + b"\x0f\x01\x00", 100, "total run length overflow"),
    (b"\x41\x02\x10", 100, "unexpected end of run-offset data"),
    (b"\x11\x02\xf0\x00", 100, "relative offset underflow"),
    (b"\x00", 100, "attribute has size but no runs"),
    (b"\x11\x02\x10\x00", 8193, "data runs shorter than declared size"),
]


@pytest.mark.parametrize(("runs", "size", "error"), RUNS)
def test_data_run_errors(runs, size, error):
    assert records.data_runs(runs, 4096, size)[0] == error


def test_data_runs_are_decoded(spark):
    assert records.data_runs(RUNS[1][0], 4096, 100)[1] == [("data", 16 * 4096, 8192), ("sparse", None, 3 * 4096), ("data", 8 * 4096, 4096)]
    assert records.data_runs(None, 4096, 5)[0] == "data runs offset outside attribute"
    r = random.Random(0)
    for _ in range(50):
        at, plain, expected = 0, [], []
        for _ in range(r.randrange(1, 9)):
            n, target = r.randrange(1, 1 << r.randrange(1, 30)), r.randrange(1 << r.randrange(1, 40))
            hole = r.random() < 0.2
            plain.append((None if hole else target - at, n))
            expected.append(("sparse", None, n * 512) if hole else ("data", target * 512, n * 512))
            at = at if hole else target
        assert records.data_runs(encode.run_list(plain), 512, 1) == (None, expected)
    df = table(spark, {40: encode.record(1, 1, [encode.attribute(layout.DATA, b"x")]), 41: encode.record(1, 1, [encode.stream_attribute(layout.DATA, 2_000_000_000, encode.run_list([(None, 488282)]))])})
    got = {r["record_number"]: r for r in files.data_runs(df, F.lit(4096)).collect()}
    assert got[40]["error"] == "attribute is resident"
    assert len(got[41]["runs"]) == 1 and got[41]["runs"][0]["kind"] == "sparse" and got[41]["runs"][0]["length"] >= got[41]["data_size"] == 2_000_000_000


def brute_paths(named):
    """{number: (name, parent)} -> {number: path}, walking up at most 1024 steps."""
    out = {}
    for n, (text, parent) in named.items():
        parts, at, ok = [], parent, True
        for _ in range(1024):
            if at == 5:
                break
            if at not in named:
                ok = False
                break
            parts.append(named[at][0])
            at = named[at][1]
        out[n] = "".join(f"\\{p}" for p in ["vol", *reversed(parts), text])[1:] if ok else ""
    return out


def test_paths_against_walking_up(spark):
    r = random.Random(5)
    named = {5: (".", 5)}
    for n in range(24, 120):
        named[n] = (f"n{n}", r.choice([5, 7777, *[r.randrange(24, 120) for _ in range(4)], max(24, n - 1), max(24, n - 1)]))
    named[24] = ("top", 5)
    recs = {n: encode.record(1, 1, [name(t, parent=p | 3 << 48)]) for n, (t, p) in named.items()}
    recs[200] = encode.record(1, 1, [])  # without a name
    recs[201] = encode.record(1, 1, [name("lost", parent=200)])
    got = {r["record_number"]: (r["name"], r["path"]) for r in files.full_paths(table(spark, recs), F.lit("vol")).collect()}
    expected = {n: (named[n][0], p) for n, p in brute_paths(named).items()} | {200: ("", ""), 201: ("lost", "")}
    assert got == expected


def test_path_depth_ends_at_1024(spark):
    named = {5: (".", 5), 24: ("c0", 5)}
    named |= {24 + i: (f"c{i}", 23 + i) for i in range(1, 1100)}
    recs = {n: encode.record(1, 1, [name(t, parent=p)]) for n, (t, p) in named.items()}
    got = {r["record_number"]: r["path"] for r in files.full_paths(table(spark, recs), F.lit("vol")).collect()}
    expected = brute_paths(named)
    for n in (24, 25, 24 + 1023, 24 + 1024, 24 + 1025, 24 + 1099):
        assert got[n] == expected[n], n


def test_nothing(spark):
    none = table(spark, {})
    assert files.files(none).count() == 0 and files.attributes(none).count() == 0


def test_run_lists_are_decoded_as_one_by_one():
    """Random lists, cut and changed ones, and numbers at the edges of what numpy can hold."""
    r = random.Random(6)
    lists, clusters, sizes, outside = [], [], [], []
    for n in range(400):
        runs, total = [], 0
        for _ in range(r.choice([0, 1, 2, 5])):
            count = r.choice([1, 3, 300, 1 << 20, 1 << 40, (1 << 62) + 1, 1 << 63])
            runs.append((r.choice([None, 5, 100, -50, 1 << 30, -(1 << 40), 1 << 60, -(1 << 62)]), count))
            total += count
        raw = encode.run_list(runs)
        if r.random() < 0.3:
            raw = raw[: r.randrange(len(raw) + 1)]
        if r.random() < 0.2 and raw:
            raw = bytes([*raw[:-1], r.randrange(256)])
        lists.append(None if r.random() < 0.03 else raw)
        clusters.append(r.choice([1, 512, 4096, 65536]))
        sizes.append(None if r.random() < 0.03 else r.choice([0, 1, total * clusters[-1] & (1 << 63) - 1, -1]))
        outside.append(r.choice([True] * 19 + [None, False]))
    errors, runs = records.run_lists(pa.array(lists, pa.binary()), np.array(clusters), pa.array(sizes, pa.int64()), pa.array(outside, pa.bool_()))
    for i, (error, found) in enumerate(zip(errors.to_pylist(), runs.to_pylist())):
        if not outside[i] or sizes[i] is None:
            assert (error, found) == ("attribute is resident", None)
            continue
        want = records.data_runs(lists[i], clusters[i], sizes[i] & (1 << 64) - 1)
        assert error == want[0] and (found is None if error else [tuple(x.values()) for x in found] == [(k, p, records._signed(n)) for k, p, n in want[1]]), i
    assert len(set(errors.to_pylist())) > 5
    assert records.run_lists(pa.array([], pa.binary()), np.array([], np.int64), pa.array([], pa.int64()), pa.array([], pa.bool_()))[1].to_pylist() == []


@pytest.mark.parametrize(("local", "text", "long"), [(1 << 18, 1 << 28, 1 << 12), (1 << 18, 1 << 28, 5), (1 << 18, 40, 5), (3, 1 << 28, 5)])
def test_paths_walked_and_doubled(spark, monkeypatch, local, text, long):
    """Trees, missing ancestors, circles and chains around the longest path, by one task for an image and by rounds."""
    for n, value in (("LOCAL", local), ("MOST_TEXT", text), ("MOST_LONG", long)):
        monkeypatch.setattr(files, n, value)
    r = random.Random(1)
    parent = {n: r.choice([5, 5, n - 1, n - 1, n - 1, n - 1, n - 1, 9999, r.randrange(24, 124)]) for n in range(24, 124)} | {n: n - 1 for n in range(201, 240)} | {200: 5, 300: 301, 301: 302, 302: 300, 303: 302, 400: 9999} | {n: n - 1 for n in range(401, 420)}
    names = spark.createDataFrame([("v", n, (p, f"n{n}")) for n, p in parent.items()] + [("w", 30, (5, "only"))], "image string, record_number bigint, name struct<parent_reference:bigint,name:string>")
    want = {("w", 5): ("", True)}
    for p in set(parent.values()):
        parts, at, ok = [], p, True
        while at != 5 and len(parts) < 8:
            if at not in parent:
                ok = False
                break
            parts.append(f"\\n{at}")
            at = parent[at]
        want["v", p] = ("".join(reversed(parts)), True) if ok else (None, False)
    got = {(x["image"], x["record_number"]): (x["path"], x["ok"]) for x in files.directory_paths(names, 3).collect()}
    assert got == want


def test_the_table_function_gives_what_the_listing_gives(spark):
    tables.register(spark)
    good = encode.record(1, 1, [name("a"), listing(77), name("b", P, 9), encode.attribute(layout.DATA, b"xyz")])
    raws = [(1, bytearray(good)), (2, None), (3, bytearray(b"FILE")), (4, bytearray(patched(good, 510, b"\xff\xff"))), (5, bytearray(1024))]
    spark.createDataFrame(raws, "n int, raw binary").createOrReplaceTempView("raw_for_test")
    got = spark.sql("SELECT r.n, a.ordinal, a.type_id, a.value_length, a.name, a.namespace, a.parent_reference FROM raw_for_test r, LATERAL siltstone_attributes(r.raw) a")
    assert rows(got) == [(1, 0, 48, 68, "a", W, 5), (1, 1, 32, 32, None, None, None), (1, 2, 48, 68, "b", P, 9), (1, 3, 128, 3, None, None, None)]
