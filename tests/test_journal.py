from __future__ import annotations

import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions.layout import REASON
from siltstone.functions.references import same_file_id
from siltstone.operators import journal
from siltstone.plans import encode
from siltstone.sources import datasource, usn
from siltstone.streaming import renames
from tests.conftest import rows

OLD, NEW, LINK, CLOSE = REASON["RENAME_OLD_NAME"], REASON["RENAME_NEW_NAME"], REASON["HARD_LINK_CHANGE"], REASON["CLOSE"]


def rec(major, number, reason=1, name="n", file_id=7, parent=5):
    wide = b"\0" * 8 if major == 3 else b""
    return encode.usn_record(major, number, 100 + number, struct.pack("<q", file_id) + wide, struct.pack("<q", parent) + wide, reason, name)


def buffer(next_usn, *records):
    return bytearray(struct.pack("<q", next_usn) + b"".join(records))


def buffers(spark, *bs, journal_name="j"):
    return spark.createDataFrame([(journal_name, i, b) for i, b in enumerate(bs)], "journal string, seq bigint, buffer binary")


def test_versions(spark):
    df = usn.decode_buffers(buffers(spark, buffer(9, rec(2, 1, CLOSE, "ä"), rec(4, 2), rec(3, 3, name=""), rec(2, 4, file_id=-3))))
    assert rows(df.select("usn", "major", "ticks", "reason", "name", "file_id.kind")) == [(1, 2, 101, CLOSE, "ä", "normal"), (3, 3, 103, 1, "", "extended"), (4, 2, 104, 1, "n", "normal")]
    assert rows(df.select("usn", journal.reference_of(F.col("file_id")))) == [(1, 7), (3, 7), (4, -3)]
    assert df.alias("a").join(df.alias("b"), F.col("a.file_id") == F.col("b.file_id")).where("a.major <> b.major").count() == 0


def test_the_walk_stops_at_broken_records(spark):
    good = rec(2, 1)
    broken = [good + b"\0" * 60, good + struct.pack("<IHH", 5000, 2, 0) + b"\0" * 60, good + b"\1\0\0\0", good]
    for tail in broken:
        assert usn.decode_buffers(buffers(spark, buffer(5, tail))).count() == 1
    assert usn.decode_buffers(buffers(spark, None, bytearray(b"\1\2"), buffer(3))).count() == 0


def test_the_cursor_never_goes_back(spark):
    df = buffers(spark, buffer(10, rec(2, 1)), buffer(0, rec(2, 2)), buffer(5, rec(2, 3)), buffer(10, rec(2, 4)), buffer(20, rec(2, 5)), buffer(15, rec(2, 6)))
    assert rows(usn.accepted_buffers(df).select("seq", "next_usn")) == [(0, 10), (3, 10), (4, 20)]
    assert rows(usn.read_records(df).select("usn")) == [(1,), (4,), (5,)]
    assert rows(usn.read_records(df, start=4).select("usn")) == [(4,), (5,)]
    assert usn.read_records(df, start="next").count() == 0
    assert usn.read_records(df, reason_mask=2).count() == 0
    assert rows(usn.accepted_buffers(df, 12).select("seq")) == [(4,)]


EVENTS = "journal string, seq bigint, usn bigint, kind string, id int, reason bigint, path string"


def events(spark, data):
    df = spark.createDataFrame(data, EVENTS)
    fid = F.struct("kind", F.encode(F.col("id").cast("string"), "UTF-8").alias("id"))
    return df.select("journal", "seq", "usn", fid.alias("file_id"), "reason", "path")


def brute(data, most=0, trim=None):
    """A reader with one history: all of a buffer is remembered before its records are looked at."""
    out = []
    for j in sorted({d[0] for d in data}):
        history = []
        mine = sorted((d for d in data if d[0] == j), key=lambda d: (d[1], d[2]))
        for seq in sorted({d[1] for d in mine}):
            for d in (x for x in mine if x[1] == seq):
                if d[5] & journal.HISTORY:
                    history = [*history, d][-most:] if most else [*history, d]
            for d in (x for x in mine if x[1] == seq):
                if d[5] & NEW:
                    hit = [h for h in history if h[3:5] == d[3:5] and h[2] < d[2] and (trim is None or h[2] > trim)]
                    out.append((j, d[2], d[6], hit[0][6] if hit else None))
    return sorted(out, key=lambda r: r[:2])


def random_events(seed, n=300):
    r = random.Random(seed)
    return [(r.choice("ab"), u // r.choice([7, 7, 7]), u, r.choice(["normal", "extended"]), r.choice([1, 1, 1, 2, 3, 4]), r.choice([OLD, NEW, NEW | CLOSE, LINK, 1, OLD | NEW]), f"p{u}") for u in range(n)]


@pytest.mark.parametrize(("most", "trim"), [(0, None), (0, 100), (1, None), (3, None), (8, 150)])
def test_rename_matching(spark, most, trim):
    data = random_events(most)
    got = journal.match_renames_limited(events(spark, data), most, trim)
    assert rows(got.select("journal", "usn", "path", "renamed_from")) == brute(data, most, trim)


def test_no_events(spark):
    none = events(spark, [])
    assert journal.match_renames(none).count() == 0 and journal.match_renames_limited(none, 3).count() == 0


def test_paths_are_found_by_parent_then_file_then_name(spark):
    df = usn.decode_buffers(buffers(spark, buffer(9, rec(2, 1, parent=50, file_id=60, name="a"), rec(3, 2, parent=51, file_id=60, name="b"), rec(2, 3, parent=51, file_id=61, name="c"), rec(2, 4, parent=52, file_id=60, name="d"))))
    paths = spark.createDataFrame([("j", 50, "C:\\p"), ("j", 60, "C:\\q\\f"), ("j", 52, ""), ("k", 51, "no")], "journal string, reference bigint, path string")
    assert rows(journal.with_paths(df, paths).select("usn", "path")) == [(1, "C:\\p\\a"), (2, "C:\\q\\f"), (3, "c"), (4, "C:\\q\\f")]


def write_captures(folder, data, per_file):
    folder.mkdir(exist_ok=True)
    for i in range(0, len(data), per_file):
        (folder / f"{i // per_file}.usn").write_bytes(bytes(buffer(data[min(i + per_file, len(data)) - 1][2] + 1, *[rec(2, d[2], d[5], d[6], file_id=d[4]) for d in data[i : i + per_file]])))


@pytest.mark.parametrize(("per_trigger", "most"), [(0, 0), (3, 0), (1, 3)])
def test_streamed_captures(spark, tmp_path, per_trigger, most):
    datasource.register(spark)
    data = [("j", u // 5, u, "normal", d[4], d[5], d[6]) for u, d in enumerate(random_events(11, 60))]
    write_captures(tmp_path / "j", data, 5)
    reader = spark.readStream.format("siltstone_usn").option("path", str(tmp_path / "j")).option("progress", str(tmp_path / "progress"))
    stream = reader.option("maxBuffersPerTrigger", str(per_trigger)).load()
    records = datasource.decode_stream(stream).withColumn("path", F.col("name"))
    query = renames.match_renames(records, most).writeStream.format("memory").queryName(f"renames{per_trigger}{most}").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert rows(spark.table(f"renames{per_trigger}{most}").select("journal", "usn", "path", "renamed_from")) == brute(data, most)
    batch = spark.read.format("siltstone_usn").option("path", str(tmp_path / "j")).load()
    assert rows(usn.read_records(batch).select("usn")) == [(d[2],) for d in data]


def test_a_restart_goes_on_where_it_stopped(spark, tmp_path):
    datasource.register(spark)
    data = [("j", u // 5, u, "normal", 1, 1, f"p{u}") for u in range(20)]
    write_captures(tmp_path / "j", data[:10], 5)
    for n in (10, 20):
        write_captures(tmp_path / "j", data[:n], 5)
        stream = datasource.decode_stream(spark.readStream.format("siltstone_usn").option("path", str(tmp_path / "j")).load()).select("usn")
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [(u,) for u in range(20)]


def stream(spark, tmp_path, most=0, **options):
    """Run a stream over all journal folders to the end of what is there; it goes on from its checkpoint."""
    datasource.register(spark)
    read = spark.readStream.format("siltstone_usn").option("path", str(tmp_path / "journals" / "*")).option("maxBuffersPerTrigger", str(most)).option("progress", str(tmp_path / "progress"))
    for name, value in options.items():
        read = read.option(name, str(value))
    query = datasource.decode_stream(read.load(), start=options.get("startingUsn", "first")).select("journal", "seq", "usn").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        query.processAllAvailable()
        batches = {p["batchId"]: p["numInputRows"] for p in (json.loads(x.json) for x in query.recentProgress) if p["numInputRows"]}
    finally:
        query.stop()
    return rows(spark.read.parquet(str(tmp_path / "out")).select("journal", "usn")), batches


def capture(tmp_path, name, seq, next_usn, *usns):
    folder = tmp_path / "journals" / name
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{seq}.usn").write_bytes(bytes(buffer(next_usn, *[rec(2, u) for u in usns])))


def test_a_late_journal_is_not_skipped(spark, tmp_path):
    """Journal a is far ahead when the buffers of b arrive; nothing is lost and nothing read twice."""
    for seq in range(6):
        capture(tmp_path, "a", seq, 10 * seq + 10, 10 * seq + 1)
    capture(tmp_path, "b", 0, 5, 1)
    assert stream(spark, tmp_path)[0] == [("a", 10 * s + 1) for s in range(6)] + [("b", 1)]
    for seq in (1, 2, 3):
        capture(tmp_path, "b", seq, 10 * seq, 10 * seq - 1)
    got, _ = stream(spark, tmp_path)
    assert got == sorted([("a", 10 * s + 1) for s in range(6)] + [("b", u) for u in (1, 9, 19, 29)])


def test_the_bound_holds_after_a_restart(spark, tmp_path):
    for seq in range(4):
        capture(tmp_path, "a", seq, 10 * seq + 10, 10 * seq + 1)
    got, batches = stream(spark, tmp_path, 2)
    assert got == [("a", 10 * s + 1) for s in range(4)] and set(batches.values()) == {2}
    for seq in range(4, 9):
        capture(tmp_path, "a", seq, 10 * seq + 10, 10 * seq + 1)
    got, batches = stream(spark, tmp_path, 2)
    assert got == [("a", 10 * s + 1) for s in range(9)] and max(batches.values()) == 2


def test_stop_rules_and_start(spark, tmp_path):
    """Next usn 0 or behind the current one: passed over, and the current one stays."""
    for seq, (following, usn) in enumerate([(10, 1), (0, 11), (5, 12), (20, 13), (15, 14), (30, 25)]):
        capture(tmp_path, "a", seq, following, usn)
    assert stream(spark, tmp_path)[0] == [("a", 1), ("a", 13), ("a", 25)]


@pytest.mark.parametrize(("start", "want"), [("first", [1, 13, 25]), ("14", [25]), ("next", [])])
def test_where_a_stream_starts(spark, tmp_path, start, want):
    for seq, (following, usn) in enumerate([(10, 1), (0, 11), (20, 13), (30, 25)]):
        capture(tmp_path, "a", seq, following, usn)
    got, _ = stream(spark, tmp_path, startingUsn=start)
    assert got == [("a", u) for u in want]
    capture(tmp_path, "a", 9, 50, 45)
    assert stream(spark, tmp_path, startingUsn=start)[0] == [("a", u) for u in [*want, 45]]


def test_names_are_decoded_like_one_by_one():
    parts = ["abc".encode("utf-16-le"), b"", b"\x00\xd8", b"\x00\xdcA\x00", "\U0001f642".encode("utf-16-le"), b"\x00\xd8", "x".encode("utf-16-le")]
    for more in ([], [b"a\0\0\0b\0"]):  # a unit 0 within a name
        whole = [*parts, *more]
        ends = [sum(map(len, whole[: i + 1])) for i in range(len(whole))]
        sizes = np.array([len(p) for p in whole])
        assert usn._names(b"".join(whole), np.array(ends) - sizes, sizes) == [p.decode("utf-16-le", "replace") for p in whole]


def test_file_ids_of_different_width_are_never_the_same(spark):
    df = usn.decode_buffers(buffers(spark, buffer(9, rec(2, 1, file_id=7, parent=7), rec(3, 2, file_id=7, parent=5))))
    a, b = df.select(F.col("usn").alias("a"), F.col("file_id").alias("x")), df.select(F.col("usn").alias("b"), F.col("file_id").alias("y"), F.col("parent_id").alias("z"))
    assert rows(a.join(b, same_file_id(F.col("x"), F.col("y"))).select("a", "b")) == [(1, 1), (2, 2)]
    assert rows(b.where(same_file_id(F.col("y"), F.col("z"))).select("b")) == [(1,)]
