"""Whole volume images through the data source."""

from __future__ import annotations

import pytest

from siltstone.functions import layout
from siltstone.operators import files
from siltstone.plans import encode
from siltstone.sources import datasource, storage
from siltstone.sources.volume import Bootstrap
from tests.conftest import rows
from tests.test_records import name

CLUSTER = 4096


def image(path, n=200, resident_bitmap=False, split=False, listed=False):
    """An image whose table lies in two extents; record 0 describes itself."""
    recs = {5: encode.record(5, 3, [name(".", layout.WIN32_AND_DOS)])}
    recs |= {i: encode.record(1, 3 if i % 10 == 0 else 1, [name(f"f{i}", parent=5 if i % 10 == 0 else i // 10 * 10), encode.attribute(layout.DATA, b"x" * (i % 7))]) for i in range(30, n)}
    bitmap = bytearray(-(-n // 8))
    for i in range(30, n):
        if i % 13:
            bitmap[i // 8] |= 1 << i % 8
    half = (n * 1024 // CLUSTER // 2) or 1
    total = -(-n * 1024 // CLUSTER)
    bits = encode.attribute(layout.BITMAP, bytes(bitmap)) if resident_bitmap else encode.stream_attribute(layout.BITMAP, len(bitmap), encode.run_list([(900, 1)]))
    size = n * 1024 + 100  # a partial record at the end is dropped
    runs = [(10, half), (400, total - half + 1)]
    if listed:
        entries = encode.attribute(layout.ATTRIBUTE_LIST, encode.list_value([(layout.DATA, 0), (layout.DATA, 1)]))
        recs[0] = encode.record(1, 1, [entries, encode.stream_attribute(layout.DATA, size, encode.run_list(runs[:1])), bits])
        recs[1] = encode.record(1, 1, [encode.stream_attribute(layout.DATA, 0, encode.run_list([(410, runs[1][1])]), lowest=half)], base=0)
    else:
        recs[0] = encode.record(1, 1, [encode.stream_attribute(layout.DATA, size, encode.run_list(runs)), bits])
    table = b"".join(recs.get(i, b"\0" * 1024) for i in range(n)) + b"\0" * 8192
    out = bytearray(1000 * CLUSTER)
    out[:512] = encode.boot_sector(512, 8, 8000, 10, -10)
    out[10 * CLUSTER : (10 + half) * CLUSTER] = table[: half * CLUSTER]
    out[410 * CLUSTER : 410 * CLUSTER + len(table) - half * CLUSTER] = table[half * CLUSTER :]
    out[900 * CLUSTER : 900 * CLUSTER + len(bitmap)] = bitmap
    path.write_bytes(bytes(out))
    return str(path)


@pytest.mark.parametrize("kind", [{}, {"resident_bitmap": True}, {"listed": True}])
def test_an_image_is_listed(spark, tmp_path, kind):
    datasource.register(spark)
    path = image(tmp_path / "a.img", **kind)
    assert Bootstrap(path).n_records == 200
    df = spark.read.format("siltstone_mft").option("path", path).option("bytesPerPartition", 40 * 1024).load()
    assert df.rdd.getNumPartitions() == 5
    got = {r["record_number"]: r for r in files.files(df).collect()}
    assert sorted(got) == [i for i in range(30, 200) if i % 13]
    for i, r in got.items():
        above = "" if i % 10 == 0 else f"\\f{i // 10 * 10}"
        assert r["path"] == f"{path}{above}\\f{i}" and int(r["size"]) == i % 7 and r["is_directory"] == (i % 10 == 0)
    exists = {r["record_number"]: r["record_exists"] for r in files.record_exists(df).collect()}
    assert len(exists) == 200 and exists[30] and not exists[0] and not exists[39]


def test_bounds_choose_partitions(spark, tmp_path):
    datasource.register(spark)
    path = image(tmp_path / "a.img")
    read = spark.read.format("siltstone_mft").option("path", path).option("bytesPerPartition", 16 * 1024)
    few = read.option("first", 100).option("last", 109).load()
    assert rows(few.select("record_number")) == [(i,) for i in range(100, 110)] and few.rdd.getNumPartitions() <= 2
    assert rows(read.option("first", 190).option("last", 250).load().select("record_number")) == [(i,) for i in range(190, 200)]
    whole = spark.read.format("siltstone_mft").option("path", path).load()
    assert files.get_record(whole, 201).count() == 0 and files.get_record(whole, 31).count() == 1
    assert whole.where("record_number > 150").count() == 49 and whole.count() == 200


def test_several_images_and_raw_output(spark, tmp_path):
    datasource.register(spark)
    for x in "ab":
        image(tmp_path / f"{x}.img", n=64)
    raw = spark.read.format("siltstone_mft").option("path", str(tmp_path / "*.img")).option("output", "raw").load()
    assert raw.count() == 128 and raw.columns == ["image", "record_number", "raw", "allocated"]
    from siltstone.sources.records import decode_records

    assert files.used_files(decode_records(raw)).groupBy("image").count().count() == 2


def test_broken_images_are_refused(spark, tmp_path):
    datasource.register(spark)
    path = tmp_path / "a.img"
    image(path)
    good = path.read_bytes()
    for change, error in ((lambda b: b[:300], "end"), (lambda b: b[: 10 * CLUSTER] + b"BAAD" + b[10 * CLUSTER + 4 :], "invalid record at byte position 40960"), (lambda b: b[:64] + b"\0" + b[65:], "geometry")):
        path.write_bytes(change(good))
        with pytest.raises(Exception, match=error):
            spark.read.format("siltstone_mft").option("path", str(path)).load().collect()
    torn = bytearray(good)
    torn[10 * CLUSTER + 40 * 1024 + 510] ^= 0xFF
    path.write_bytes(bytes(torn))
    read = spark.read.format("siltstone_mft").option("path", str(path))
    with pytest.raises(Exception, match="corrupt record 40"):
        read.load().collect()
    assert read.option("mode", "PERMISSIVE").load().where("corrupt").count() == 1


def test_holes_are_passed_over(spark, tmp_path):
    """A table of three extents of which the middle one is a hole; numbers in it have no rows unless asked for."""
    datasource.register(spark)
    n, per = 96, 32
    recs = [encode.record(1, 1, [name(f"f{i}")]) for i in range(n)]
    runs = [(10, 8), (None, 8), (30, 8)]
    recs[0] = encode.record(1, 1, [encode.stream_attribute(layout.DATA, n * 1024, encode.run_list(runs)), encode.attribute(layout.BITMAP, b"\xff" * (n // 8))])
    out = bytearray(100 * CLUSTER)
    out[:512] = encode.boot_sector(512, 8, 800, 10, -10)
    out[10 * CLUSTER : 18 * CLUSTER] = b"".join(recs[:per])
    out[40 * CLUSTER : 48 * CLUSTER] = b"".join(recs[2 * per :])
    (tmp_path / "a.img").write_bytes(bytes(out))
    read = spark.read.format("siltstone_mft").option("path", f"file://{tmp_path}/[ab].img").option("bytesPerPartition", 16 * 1024)
    some = [*range(per), *range(2 * per, n)]
    assert rows(read.load().where("is_valid").select("record_number")) == [(i,) for i in some] == rows(read.load().select("record_number"))
    whole = read.option("holes", "read").load()
    assert whole.count() == n and rows(whole.where("is_valid").select("record_number")) == [(i,) for i in some]
    assert rows(read.option("holes", "skip").option("first", 20).option("last", 70).load().select("record_number")) == [(i,) for i in some if 20 <= i <= 70]


def test_contents(spark, tmp_path):
    """Resident, fragmented with a hole and cut to size, empty, broken, and too large to hold."""
    datasource.register(spark)
    n = 40
    stream = encode.stream_attribute
    data = {
        30: encode.attribute(layout.DATA, b"small"), 31: stream(layout.DATA, 2 * CLUSTER + 5, encode.run_list([(50, 1), (None, 1), (-2, 1)])), 32: stream(layout.DATA, 0, b""),
        33: stream(layout.DATA, 9 * CLUSTER, encode.run_list([(50, 1)])), 34: stream(layout.DATA, 1 << 40, encode.run_list([(None, 1 << 28)])),
    }
    recs = [encode.record(1, 1, [data[i]] if i in data else [name(f"f{i}")]) for i in range(n)]
    recs[0] = encode.record(1, 1, [stream(layout.DATA, n * 1024, encode.run_list([(10, 10)])), encode.attribute(layout.BITMAP, b"\xff" * 5)])
    out = bytearray(100 * CLUSTER)
    out[:512] = encode.boot_sector(512, 8, 800, 10, -10)
    out[10 * CLUSTER : 20 * CLUSTER] = b"".join(recs)
    out[50 * CLUSTER : 51 * CLUSTER], out[48 * CLUSTER : 49 * CLUSTER] = b"a" * CLUSTER, b"b" * CLUSTER
    (tmp_path / "a.img").write_bytes(bytes(out))
    got = {r["record_number"]: (None if r["data"] is None else bytes(r["data"]), r["error"]) for r in files.read_contents(spark.read.format("siltstone_mft").option("path", str(tmp_path / "a.img")).load()).collect() if r["record_number"]}
    assert got[30] == (b"small", None) and got[31] == (b"a" * CLUSTER + b"\0" * CLUSTER + b"b" * 5, None) and got[32] == (b"", None)
    assert "shorter than declared" in got[33][1] and got[34] == (None, "allocation of 1099511627776 bytes exceeds the address space")


def test_patterns_and_files(tmp_path):
    for x in ("a/1.img", "a/2.img", "b/1.img", "b/x.txt"):
        (tmp_path / x).parent.mkdir(exist_ok=True)
        (tmp_path / x).write_bytes(b"abc")
    for head in ("", "file://"):
        assert storage.expand(f"{head}{tmp_path}/*/[12].img") == [f"{head}{tmp_path}/{x}" for x in ("a/1.img", "a/2.img", "b/1.img")]
        assert storage.expand(f"{head}{tmp_path}/a") == [f"{head}{tmp_path}/a"]
        assert sorted(storage.entries(f"{head}{tmp_path}/b")) == [("1.img", 3, False), ("x.txt", 3, False)]
        storage.write_file(f"{head}{tmp_path}/c/note", b"x")
        assert storage.read_file(f"{head}{tmp_path}/c/note") == b"x"
    with pytest.raises(Exception, match="cannot read"):
        storage.open_file(str(tmp_path / "none"))
    from pyarrow import fs

    other, inner = storage.Remote(fs.LocalFileSystem()), str(tmp_path / "d" / "note")  # as for other schemes
    other.write(inner, b"y")
    assert other.open(inner).read() == b"y" and other.entries(str(tmp_path / "d")) == [("note", 1, False)] and other.entries(str(tmp_path / "e")) == []
