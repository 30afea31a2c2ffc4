"""Cases of attribution and of the rules that settle names."""

import pytest

from tapline.operators import topology as T

TX = "tx_id bigint, req_ts_ns bigint, issuer_ip string, issuer_label string, dns_name string, resolver_ip string, dest_port int, proto string, pcap_file string, name_evidence int"
IPS = "tx_id bigint, ip string, ord int, evidence int"
EDGES = "edge_ord bigint, issuer_ip string, dst_ip string, proto string, port int, first_seen_ns bigint"
PAIRS = "ip string, dns string"
ROWS = "issuer string, dst string, dns_name string, dns_source string, proto string, port int, observed_ns bigint, ord bigint"
S = 10**9


@pytest.fixture
def run(spark):
    def make(edges, tx=(), ips=(), pairs=(), f=T.matrix, **more):
        e = spark.createDataFrame([(k, *x) for k, x in enumerate(edges)], EDGES)
        t = spark.createDataFrame([(i, ts, who, None, name, "8.8.8.8", port, proto, "a.pcap", ev) for i, ts, who, name, port, proto, ev in tx], TX)
        out = f(e, t, spark.createDataFrame(list(ips), IPS), spark.createDataFrame(list(pairs), PAIRS), **more)
        return sorted((r.issuer, r.dst, r.dns_name, r.dns_source, r.port) for r in out.collect())

    return make


@pytest.fixture
def rows(spark):
    return lambda items: spark.createDataFrame([(a, b, n, s, "tcp", p, 1, k) for k, (a, b, n, s, p) in enumerate(items)], ROWS)


def flat(df):
    return sorted((r.issuer, r.dst, r.dns_name, r.dns_source, r.port) for r in df.collect())


def test_map_for_running_sessions(run):
    e = [("10.10.10.10", "153.46.253.156", "tcp", 443, 1), ("10.10.10.10", "153.46.253.156", "tcp", 443, 2)]
    assert run(e, pairs=[("153.46.253.156", "Api.Example.")]) == [("10.10.10.10", "153.46.253.156", "api.example", "csv+mid", 443)]
    e = [("44.44.44.44", "153.46.253.156", "tcp", 443, 1)]
    assert run(e, pairs=[("153.46.253.156", "api.example")]) == [("44.44.44.44", "153.46.253.156", "api.example", "csv+conn", 443)]
    assert run([("100.64.0.1", "1.2.3.4", "tcp", 443, 1)]) == [("100.64.0.1", "1.2.3.4", "", "", 443)]


def test_ambiguous_map(run):
    e = [("10.0.0.1", "34.0.113.10", "tcp", 443, 1)]
    assert run(e, pairs=[("34.0.113.10", "a.example"), ("34.0.113.10", "b.example")]) == [("10.0.0.1", "34.0.113.10", "", "mid-session", 443)]


def test_private_destination_never_named(run):
    e = [("10.0.0.1", "10.4.17.52", "tcp", 443, 5 * S)]
    assert run(e, [(1, S, "10.0.0.1", "a.example", None, None, 1)], [(1, "10.4.17.52", 0, 33)], [("10.4.17.52", "x.example")]) == [("10.0.0.1", "10.4.17.52", "", "", 443)]


def test_strong_beats_map(run):
    e = [("100.84.31.44", "13.1.1.1", "tcp", 3000, 9 * S), ("100.84.31.44", "13.1.1.1", "tcp", 3000, 11 * S)]
    got = run(e, [(1, 10 * S, "100.84.31.44", "api.example", None, None, 1)], [(1, "13.1.1.1", 0, 1)], [("13.1.1.1", "other.example")])
    assert got == [("100.84.31.44", "13.1.1.1", "api.example", "dns+synack", 3000)]


def test_cross_port(run):
    e = [("100.84.31.44", "13.1.1.1", "tcp", 443, 11 * S), ("100.84.31.44", "13.1.1.1", "tcp", 80, 9 * S)]
    got = run(e, [(1, 10 * S, "100.84.31.44", "api.example", None, None, 1)], [(1, "13.1.1.1", 0, 1)], [("13.1.1.1", "google.com")], f=lambda *a, **k: T.settle_fallback(T.without_unnamed_twins(T.folded(T.attributed(*a, **k)))))
    assert got == [("100.84.31.44", "13.1.1.1", "", "", 80), ("100.84.31.44", "13.1.1.1", "api.example", "dns+synack", 443)]


def test_window_score_and_exclusions(run):
    me, dst = "10.0.0.1", "13.1.1.1"
    tx = [(1, S, me, "old.example", None, None, 1), (2, 100 * S, me, "port.example", 443, "tcp", 1), (3, 110 * S, me, "late.example", None, None, 1), (4, 111 * S, me, "udp.example", None, "udp", 1), (5, 300 * S, me, "future.example", None, None, 1)]
    ips = [(k, dst, 0, 1) for k in range(1, 6)]
    assert run([(me, dst, "tcp", 443, 121 * S + 1)], tx, ips) == [(me, dst, "port.example", "dns+synack", 443)]
    assert run([(me, dst, "tcp", 80, 120 * S)], tx, ips) == [(me, dst, "late.example", "dns+synack", 80)]
    assert run([(me, dst, "tcp", 80, 120 * S)], tx[:1], ips) == [(me, dst, "old.example", "dns+synack", 80)]
    assert run([(me, dst, "tcp", 80, 121 * S + 1)], tx[:1], ips)[0][3] == "mid-session"
    assert run([(me, dst, "tcp", 80, 10**6 * S)], tx[:1], ips, max_age_ns=0) == [(me, dst, "old.example", "dns+synack", 80)]
    bad = [(me, dst, "udp", 53, 1), (me, dst, "tcp", 853, 1), (me, dst, "udp", 5353, 1), ("8.8.8.8", dst, "tcp", 80, 1), (me, None, "tcp", 80, 1), (None, dst, "tcp", 80, 1), (me, dst, "tcp", 0, 1), ("", dst, "tcp", 80, 1)]
    assert run(bad, tx, ips) == []


def test_no_evidence_means_no_source(run):
    assert run([("10.0.0.1", "13.1.1.1", "tcp", 80, S)], [(1, S, "10.0.0.1", "a.example", None, None, 0)], [(1, "13.1.1.1", 0, 0)]) == [("10.0.0.1", "13.1.1.1", "a.example", "", 80)]


def test_blank_rows_are_filled_from_the_map(run):
    tx, ips, e = [(1, S, "10.0.0.1", ".", None, None, 1)], [(1, "13.1.1.1", 0, 1)], [("10.0.0.1", "13.1.1.1", "tcp", 80, S)]
    assert run(e, tx, ips, [("13.1.1.1", "m.example")]) == [("10.0.0.1", "13.1.1.1", "m.example", "csv+conn", 80)]
    assert run(e, tx, ips) == [("10.0.0.1", "13.1.1.1", "", "", 80)]
    assert run(e, tx, ips, [("13.1.1.1", "m.example"), ("13.1.1.1", "n.example")]) == [("10.0.0.1", "13.1.1.1", "", "", 80)]


def test_peers(rows):
    ip = "13.55.209.128"
    one = [("a", ip, "x.example", "dns+synack", 8883), ("b", ip, "", "", 8883)]
    assert ("b", ip, "x.example", "peer+ipport", 8883) in flat(T.completed_by_peers(rows(one)))
    inferred = [("a", ip, "x.example", "dns+conn+synack", 8883), ("b", ip, "", "mid-session", 8883)]
    assert ("b", ip, "x.example", "peer+ipport+conn", 8883) in flat(T.completed_by_peers(rows(inferred)))
    torn = [*one, ("c", ip, "y.example", "sni+synack", 8883)]
    assert ("b", ip, "", "", 8883) in flat(T.completed_by_peers(rows(torn)))
    both = [*one, ("c", ip, "z.example", "dns+conn+synack", 8883), ("d", ip, "q.example", "dns+conn+synack", 8883)]
    assert ("b", ip, "x.example", "peer+ipport", 8883) in flat(T.completed_by_peers(rows(both)))
    private = [("a", "10.0.0.9", "x.example", "dns+synack", 1), ("b", "10.0.0.9", "", "", 1)]
    assert flat(T.completed_by_peers(rows(private))) == sorted(private)


def test_fold_keeps_first_and_best(rows):
    got = T.folded(rows([("a", "1.1.1.1", "n", "", 1), ("a", "1.1.1.1", "n", "csv+mid", 1), ("a", "1.1.1.1", "n", "dns+synack", 1), ("a", "1.1.1.1", "n", "sni+synack", 1)])).collect()
    assert [(r.dns_source, r.ord) for r in got] == [("dns+synack", 0)]


def test_short_puts_unnamed_last(rows):
    got = flat(T.short(rows([("a", "1.1.1.1", "b.example", "dns", 1), ("a", "1.1.1.1", "", "", 1), ("a", "1.1.1.1", "a.example", "dns", 1), ("a", "1.1.1.1", "", "", 2)])))
    assert got == [("a", "1.1.1.1", "", "", 2), ("a", "1.1.1.1", "a.example", "dns", 1)]


def test_orders(rows):
    items = [("z", "10.4.17.52", "", "", 1), ("z", "34.253.43.136", "", "", 1), ("z", "1.1.1.1", "b", "", 1), ("a", "1.1.1.1", "", "", 1), ("z", "1.1.1.1", "a", "", 2)]
    assert [(r.issuer, r.dst, r.port) for r in T.ordered(rows(items)).collect()] == [("z", "1.1.1.1", 2), ("z", "1.1.1.1", 1), ("z", "34.253.43.136", 1), ("z", "10.4.17.52", 1), ("a", "1.1.1.1", 1)]
    assert [(r.issuer, r.ord) for r in T.ordered(rows(items), sort=False).collect()] == [("z", 0), ("z", 1), ("z", 2), ("z", 4), ("a", 3)]
    assert [r.dst for r in T.ordered(rows(items), by_name=False).collect()][:2] == ["1.1.1.1", "1.1.1.1"]


def test_empty(rows):
    empty = rows([("a", "1.1.1.1", "", "", 1)]).limit(0)
    for f in (T.folded, T.without_unnamed_twins, T.settle_fallback, T.completed_by_peers, T.short, T.ordered):
        assert f(empty).count() == 0


def best_by_hand(edges, tx, ips, max_age):
    out = {}
    for k, (who, dst, proto, port, t) in enumerate(edges):
        fit = []
        for i, ts, issuer, name, tx_port, tx_proto, ev in tx:
            if issuer == who and name and ts <= t and (not max_age or t - ts <= max_age) and (tx_proto is None or tx_proto == proto) and (not tx_port or tx_port == port) and any(j == i and ip == dst for j, ip, *_ in ips):
                fit.append((2 * (tx_proto is not None) + 2 * bool(tx_port) + (ev & 2) // 2, ts, -i))
        if fit:
            out[k] = -max(fit)[2]
    return out


def test_best_transaction_against_brute_force(spark):
    import random

    rng = random.Random(5)
    for max_age in (7, 40, 0):
        edges = [(rng.choice("ab"), rng.choice("xy"), rng.choice(["tcp", "udp", None]), rng.choice([80, 443]), rng.randrange(-100, 200)) for _ in range(150)]
        tx = [(i, rng.randrange(-100, 200), rng.choice(["a", "b", None]), rng.choice(["n.example", "m.example", None, ""]), rng.choice([None, 0, 80, 443]), rng.choice([None, None, "tcp", "udp"]), rng.choice([0, 1, 2, 3])) for i in range(80)]
        ips = [(i, ip, 0, 1) for i in range(80) for ip in rng.sample("xyz", rng.randint(0, 2))]
        e = spark.createDataFrame([(k, *x) for k, x in enumerate(edges)], EDGES)
        t = spark.createDataFrame([(i, ts, who, None, name, "8.8.8.8", port, proto, "a.pcap", ev) for i, ts, who, name, port, proto, ev in tx], TX)
        got = T.best_transactions(e, t, spark.createDataFrame(ips, IPS), max_age)
        assert {r.edge_ord: r.tx_id for r in got.collect()} == best_by_hand(edges, tx, ips, max_age)


@pytest.mark.parametrize("max_age", [T.MAX_AGE_NS, 0])
def test_burst_of_one_pair_is_linear(spark, max_age):
    from pyspark.sql import functions as F

    n = 60_000
    e = spark.range(n).select(F.col("id").alias("edge_ord"), F.lit("a").alias("issuer_ip"), F.lit("13.1.1.1").alias("dst_ip"), F.lit("tcp").alias("proto"), F.lit(443).alias("port"), (F.col("id") + 1000 * S).alias("first_seen_ns"))
    none = lambda kind: F.lit(None).cast(kind)
    t = spark.range(n).select(F.col("id").alias("tx_id"), (F.col("id") + 1000 * S).alias("req_ts_ns"), F.lit("a").alias("issuer_ip"), F.lit("n.example").alias("dns_name"), none("int").alias("dest_port"), none("string").alias("proto"), F.lit(1).alias("name_evidence"))
    ips = t.select("tx_id", F.lit("13.1.1.1").alias("ip"), F.lit(0).alias("ord"), F.lit(1).alias("evidence"))
    assert T.best_transactions(e, t, ips, max_age).filter("edge_ord = tx_id").count() == n
