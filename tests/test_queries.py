"""Registered view queries against DuckDB on the smallest tables."""

import duckdb
import pytest

from tidewright.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
# one of each family; the driver compares all of them
CHOSEN = [
    "agg_avg", "agg_multi_key", "agg_null_group", "distinct_lookup", "having_filter", "join_fanout_distinct", "self_join_theta", "scoped_having", "scoped_dimension_move", "widen_cap",
    "delta_filtered_view", "delta_random_mix", "delta_distinct", "cold_populated_partition", "cdc_debezium_batch", "cdc_watermark_suppression", "outbox_snapshot_diff", "verify_checksum",
    "reconcile_repairs", "stream_events_by_type", "reconcile_counts_writes_once", "restart_replays_writes", "outer_join_kept", "coarse_dirty_widens",
]


def test_every_query_has_its_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_entry_module(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and set(QUERIES) <= set(names)
    assert entry.entry(spark).count() >= 0
