"""Images with more extents than record 0 has room to tell one by one, and the queries over them against their SQL."""

from __future__ import annotations

import datetime

import pytest

from siltstone.plans import encode, file_records
from siltstone.sources import records
from tests.conftest import rows

QUERIES = ["mft_attribute_function", "mft_files", "mft_is_valid", "mft_range", "mft_size", "mft_attributes", "mft_flags", "mft_listing", "mft_record_exists", "mft_times", "mft_best_name", "mft_get_record", "mft_paths", "mft_ref_number", "usn_enrich_path"]


@pytest.mark.parametrize("pages", [range(31), range(300), range(0, 400, 2), [0, 5, 7, 9000], [k * 379 + x for k in range(60) for x in (0, 1, 2, 366)]])
def test_a_run_list_has_room_and_tells_every_page(pages):
    size, cluster, begin = encode.PAGE * 1024, 4096, 16 << 20
    at, packed = encode._table_layout(list(pages), size, cluster, begin, 640)
    error, runs = records.data_runs(packed, cluster, 1, check_total=False)
    assert error is None and len(packed) <= 640 and len(at) == len(pages)
    found, nth = {}, 0
    for _, place, length in runs:
        if place is not None:
            found |= {nth + k: place + k * size for k in range(length // size)}
        nth += length // size
    assert all(found[p] == at[p] for p in pages) and nth == max(pages) + 1
    own = sorted((place, place + length) for _, place, length in runs if place is not None)
    assert own[0][0] == begin and all(a[1] < b[0] for a, b in zip(own, own[1:]))  # a gap between any two
    assert len(own) > 1


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Pages of 64 records: 300 in a row, 200 with a hole before each, and one so far away that the bitmap takes more than lies before the table."""
    home = str(tmp_path_factory.mktemp("fragmented"))
    at = datetime.datetime(2024, 5, 1, 12)
    numbers = [64 * p + 7 for p in [*range(1, 300), *range(301, 700, 2)]] + [130_000_000]
    root = (5 << 48) | 5

    def table(name, data, schema):
        spark.createDataFrame(data, schema).write.parquet(f"{home}/{name}.parquet")

    table("volumes", [(1, "\\\\.\\C:", 512, 8, 1 << 31, 786496, -10)], "volume_id int, path string, sector_size int, sectors_per_cluster int, total_sectors bigint, mft_lcn bigint, file_record_size_info int")
    table("system_record", [(1, n, n or 1, 3 if n == 5 else 1, root, 3, "." if n == 5 else f"$s{n}") for n in (0, 5, 6)], "volume_id int, record_number bigint, sequence int, flags int, parent_reference bigint, namespace int, name string")
    table("mft_record", [(1, n, 1 + i % 3, 1 if i % 4 else 3, i % 7 > 0, 0, at, None, at, at) for i, n in enumerate(numbers)], "volume_id int, record_number bigint, sequence int, flags int, allocated boolean, base_reference bigint, created timestamp_ntz, modified timestamp_ntz, accessed timestamp_ntz, captured_at timestamp_ntz")
    above = [root, *(((1 + i % 3) << 48) | n for i, n in enumerate(numbers))]
    table("file_name", [(1, n, 2, above[i // 2], 1, 32, i * 1000, f"f{n}") for i, n in enumerate(numbers)], "volume_id int, record_number bigint, attr_id int, parent_reference bigint, namespace int, file_attributes bigint, real_size bigint, name string")
    table("usn_record", [(1, 11, 1, 2, 100 + 8 * i, 10**17, at, above[i + 1], above[i // 2], 256, f"f{i}", at) for i in range(len(numbers))], "batch_id bigint, journal_id bigint, volume_id int, major int, usn bigint, ticks bigint, ts timestamp_ntz, file_id bigint, parent_id bigint, reason bigint, name string, delivered_at timestamp_ntz")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(encode, "PAGE", 64)
        yield home


@pytest.mark.parametrize("query", QUERIES)
def test_a_query_over_many_extents_gives_what_its_sql_gives(spark, tables, query):
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as db:
        for t in ("volumes", "system_record", "mft_record", "file_name", "usn_record"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet/*.parquet')")
        want = db.execute(file_records.SQL[query])
        names, want = [d[0] for d in want.description], want.fetchall()
    got = file_records.QUERIES[query](spark, tables)
    assert got.columns == names and want
    assert rows(got) == sorted(want, key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))
