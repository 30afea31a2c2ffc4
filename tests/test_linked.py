"""Correlation queries over all addresses of the tables, and transactions that lost their answers."""

import pytest
from test_correlate import S, frames
from test_queries import FOLDER, QUERIES, SQL, duck, plain  # noqa: F401

from tapline.operators import correlate
from tapline.plans import flow_queries

NAMES = "conn_asof_direct conn_first_after conn_fallback_unique_snapshot csv_guard best_candidate observed_conn_evidence".split()


@pytest.mark.parametrize("name", NAMES)
def test_all_addresses(spark, duck, name):  # noqa: F811
    want = duck.execute(SQL[name]).df()
    assert plain(QUERIES[name](spark, FOLDER).toPandas()) == plain(want)


def test_sequential_sees_all_addresses(spark):
    stored = spark.read.parquet(f"{FOLDER}/dns_tx_ip.parquet").select("tx_id").distinct()
    assert stored.join(flow_queries._linked(spark, FOLDER)[2], "tx_id", "left_anti").count() == 0
    got = QUERIES["conn_fallback_sequential"](spark, FOLDER).join(stored, "tx_id", "left_semi")
    assert got.count() == 0


def test_lost_answers(spark):
    tx = [(k, k * 100 * S, "a", "x.example", None, 1) for k in (1, 2, 3)]
    conns = [(k, 0, k, "a", f"{k}.{k}.{k}.{k}", "tcp", 443, k * 100 * S + S) for k in (1, 2, 3)]
    conns, tx, addresses = frames(spark, tx, [(1, "1.1.1.1", 0, 1), (3, "3.3.3.3", 0, 1)], conns)
    assert sorted(r.tx_id for r in correlate.direct(conns, tx, addresses).collect()) == [1, 3]
    assert [tuple(r) for r in correlate.fallback_snapshot(conns, tx, addresses).collect()] == [(2, 2, S)]
