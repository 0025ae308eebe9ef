from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltstone.errors import SiltstoneError
from siltstone.functions import columns, layout, references
from siltstone.sources import volume
from siltstone.plans import encode

E = layout.EPOCH_TICKS


def values(spark, kind, data, column):
    return [r[0] for r in spark.createDataFrame([(d,) for d in data], f"x {kind}").select(column(F.col("x"))).collect()]


def test_times(spark):
    data = [0, E - 1, E, E + 1, E + columns.LAST_TICKS, E + columns.LAST_TICKS + 1, -1, 2**63 - 1, None]
    assert values(spark, "bigint", data, columns.unix_ticks) == [0, 0, 0, 1, columns.LAST_TICKS, 0, 0, 0, None]
    got = values(spark, "bigint", [E + 19, E + columns.LAST_TICKS, 133_632_800_994_811_459], columns.filetime_to_timestamp)
    assert [t.isoformat() for t in got] == ["1970-01-01T00:00:00.000001", "9999-12-31T23:59:59.999999", "2024-06-19T14:14:59.481145"]
    assert values(spark, "bigint", [-5, 0, 7, 2**63 - 1], columns.journal_ticks) == [0, 0, 7, columns.MOST_TICKS]


def test_reason_text(spark):
    every = sum(bit for _, bit in layout.REASONS)
    got = values(spark, "bigint", [0, 0x1000 | 0x2000 | 0x80000000, 1 << 40 | 8, every], columns.reason_text)
    assert got[:3] == ["", "USN_REASON_CLOSE USN_REASON_RENAME_NEW_NAME USN_REASON_RENAME_OLD_NAME ", ""]
    assert got[3] == "".join(f"{n} " for n, _ in layout.REASONS) and len(layout.REASONS) == 24


def test_references_keep_their_bits(spark):
    df = spark.createDataFrame([(0x8842, 5), (1, 1 << 40), (0xFFFF, 2**48 - 1)], "s int, n bigint").withColumn("r", references.make_reference(F.col("s"), F.col("n")))
    got = df.select("s", "n", "r", references.sequence_number(F.col("r")).alias("s2"), references.record_number(F.col("r")).alias("n2")).collect()
    assert all((r["s"], r["n"]) == (r["s2"], r["n2"]) and r["r"] & (2**64 - 1) == r["s"] << 48 | r["n"] for r in got)


def test_unsigned_bits_and_bitmap(spark):
    assert [int(x) for x in values(spark, "bigint", [-1, 5, -(2**63)], columns.unsigned)] == [2**64 - 1, 5, 2**63]
    df = spark.range(-1, 20).withColumn("b", F.lit(bytearray(b"\x05\x80")))
    got = [r[0] for r in df.select(columns.bit_set(F.col("b"), F.col("id"))).collect()]
    assert [i - 1 for i, x in enumerate(got) if x] == [0, 2, 15]


def test_paths_are_joined(spark):
    df = spark.createDataFrame([("C:", "\\a", "b")], "x string, y string, z string")
    assert df.select(columns.join_path(F.col("x"), F.col("y"), F.col("z"))).first()[0] == "C:\\a\\b"


def test_geometry():
    g = volume.geometry("v", encode.boot_sector(512, 8, 1000, 4, -10))
    assert (g.cluster_size, g.volume_size, g.record_size, g.mft_position) == (4096, 512_000, 1024, 16384)
    assert volume.geometry("v", encode.boot_sector(512, 2, 1, 1, 1)).record_size == 1024
    for info in (0, -5):
        with pytest.raises(SiltstoneError, match="geometry"):
            volume.geometry("v", encode.boot_sector(512, 8, 1, 1, info))


def test_alignment(tmp_path):
    assert (volume.round_down(4097, 4096), volume.round_up(4097, 4096), volume.round_up(4096, 4096)) == (4096, 8192, 4096)
    path = tmp_path / "x"
    path.write_bytes(bytes(range(256)) * 40)
    with open(path, "rb") as f:
        assert volume.read_exactly(f, 4090, 20) == (bytes(range(256)) * 40)[4090:4110]
        for at, error in ((10230, "end of file"), (-1, "invalid position")):
            with pytest.raises(SiltstoneError, match=error):
                volume.read_exactly(f, at, 100)
        with pytest.raises(SiltstoneError, match="power of two"):
            volume.read_exactly(f, 0, 1, 3)


def test_errors_have_fields_and_travel():
    import pickle

    e = pickle.loads(pickle.dumps(SiltstoneError("CORRUPT_RECORD", number=3)))
    assert e.error_class == "CORRUPT_RECORD" and e.fields == {"number": 3} and str(e) == "corrupt record 3"
    with pytest.raises(ValueError):
        SiltstoneError("NO_SUCH")
