import random

from tapline.operators import carry, correlate, transactions

CONNS = "conn_id bigint, file_idx int, pkt_idx bigint, issuer_ip string, dst_ip string, proto string, port int, ts_ns bigint"
TX = "tx_id bigint, req_ts_ns bigint, issuer_ip string, dns_name string, dest_port int, name_evidence int"
IPS = "tx_id bigint, ip string, ord int, evidence int"
S = 10**9


def sample(seed, n=160):
    rng = random.Random(seed)
    ips = ["1.1.1.1", "2.2.2.2", "3.3.3.3"]
    tx = [(k, rng.randint(0, 60) * S // 2, rng.choice(["a", "a", "b", None]), rng.choice(["x.example", "y.example", "local", None]), rng.choice([None, None, 0, 443]), rng.choice([0, 1])) for k in range(n // 2)]
    addresses = sorted({(k, rng.choice(ips), 0, 1) for k, *_ in tx for _ in range(rng.choice([0, 0, 1]))})
    conns = [(k, k % 3, k, rng.choice(["a", "a", "b"]), rng.choice([*ips, "9.9.9.9"]), rng.choice(["tcp", "tcp", "udp"]), 80 + k % 3, rng.randint(0, 60) * S // 2 + rng.randint(0, 1)) for k in range(n)]
    return tx, addresses, conns


def frames(spark, tx, addresses, conns):
    return spark.createDataFrame(conns, CONNS), spark.createDataFrame(tx, TX), spark.createDataFrame(addresses, IPS)


def by_hand(tx, addresses, conns, names):
    """Direct, snapshot and sequential matches, one connection after another."""
    have = {}
    for k, ip, *_ in addresses:
        have.setdefault(k, set()).add(ip)
    open_ = [t for t in tx if t[2] is not None and not (t[4] or 0) > 0]
    direct, once, later, gone = set(), set(), set(), set()
    for c, f, p, who, dst, proto, _, ts in sorted(conns, key=lambda c: (c[7], c[1], c[2])):
        keyed = [t for t in open_ if t[2] == who and dst in have.get(t[0], ())]
        if keyed:
            before = [t for t in keyed if t[1] < ts]
            if before:
                best = max(before, key=lambda t: (t[1], -t[0]))
                if ts - best[1] <= 5 * S:
                    direct.add((c, best[0], ts - best[1]))
            continue
        if proto != "tcp":
            continue
        fit = [t for t in open_ if t[2] == who and ts - 5 * S <= t[1] <= ts and t[3] and "." in t[3] and t[0] not in have]
        if len(fit) == 1:
            once.add((c, fit[0][0], ts - fit[0][1]))
        fit = [t for t in fit if t[0] not in gone]
        if len(fit) == 1 and (dst not in names or fit[0][3] in names[dst]):
            later.add((c, fit[0][0], ts - fit[0][1]))
            gone.add(fit[0][0])
    return direct, once, later


def test_against_one_by_one(spark):
    for seed in (1, 2, 3):
        tx, addresses, conns = sample(seed)
        c, t, a = frames(spark, tx, addresses, conns)
        pairs = spark.createDataFrame([("9.9.9.9", "X.example."), ("2.2.2.2", "q.example")], "ip string, dns string")
        direct, once, later = by_hand(tx, addresses, conns, {"9.9.9.9": {"x.example"}, "2.2.2.2": {"q.example"}})
        assert {tuple(r) for r in correlate.direct(c, t, a).collect()} == direct
        assert {tuple(r) for r in correlate.fallback_snapshot(c, t, a).collect()} == once
        assert {tuple(r) for r in correlate.fallback_sequential(c, t, a, pairs).collect()} == later


def test_guard(spark):
    cases = [("x.example", [], True), ("x.example", ["x.example"], True), ("X.example.", ["x.example", "y.example"], True), ("z.example", ["x.example"], False), ("z.example", ["x.example", "y.example"], False), ("z.example", ["."], True)]
    c = spark.createDataFrame([(k, 0, k, "a", f"1.1.1.{k}", "tcp", 1, 1) for k in range(len(cases))], CONNS)
    t = spark.createDataFrame([(k, 1, "a", name, None, 0) for k, (name, _, _) in enumerate(cases)], TX)
    pairs = spark.createDataFrame([(f"1.1.1.{k}", n) for k, (_, names, _) in enumerate(cases) for n in names], "ip string, dns string")
    m = spark.createDataFrame([(k, k, 0) for k in range(len(cases))], "conn_id bigint, tx_id bigint, dt_ns bigint")
    assert sorted(r.tx_id for r in correlate.allowed_by_map(m, c, t, pairs).collect()) == [k for k, (_, _, ok) in enumerate(cases) if ok]


def test_best_of_the_first(spark):
    c = spark.createDataFrame([(k, 0, k, "a", "1.1.1.1", "udp" if k == 3 else "tcp", 100 + k, 1) for k in range(12)], CONNS)
    m = spark.createDataFrame([(k, 1, 50 - k if k != 3 else 1) for k in range(12)] + [(0, 2, 7), (1, 2, 7)], "conn_id bigint, tx_id bigint, dt_ns bigint")
    got = {r.tx_id: (r.port, r.proto) for r in correlate.best_candidates(m, c).collect()}
    assert got == {1: (103, "udp"), 2: (100, "tcp")}
    assert {r.tx_id: r.port for r in correlate.best_candidates(m, c, only_tcp=True).collect()} == {1: 107, 2: 100}


def test_response_takes_latest_query_of_its_name(spark):
    key = (0, "me", 5000, "dns", "udp", 7)
    q = [(*key, t, p, i, n) for t, p, i, n in ((10, 1, 1, "a"), (20, 2, 2, "b"), (30, 3, 3, "a"), (90, 9, 9, "a"))]
    r = [(*key, t, p, i, n) for t, p, i, n in ((40, 4, 100, "a"), (41, 5, 101, "b"), (42, 6, 102, "c"), (43, 7, 103, ""), (5, 0, 104, "a"))] + [(0, "me", 5000, "dns", "udp", 0, 50, 8, 105, "a")]
    schema = "file_idx int, issuer_ip string, src_port int, resolver_ip string, proto string, dns_id int, ts_ns bigint, pkt_idx bigint, {} bigint, name string"
    got = transactions.matched(spark.createDataFrame(q, schema.format("query_id")), spark.createDataFrame(r, schema.format("response_id")))
    assert {(x.response_id, x.query_id) for x in got.collect()} == {(100, 3), (101, 2), (102, 3), (103, 3)}


def test_last_before_ties_and_empty(spark):
    p = spark.createDataFrame([("a", 10, 1), ("a", 12, 2), (None, 10, 3), ("b", 10, 4), ("a", None, 5)], "k string, t bigint, p bigint")
    f = spark.createDataFrame([("a", 10, 7), ("a", 10, 6), ("a", 7, 5), (None, 10, 9)], "k string, t bigint, id bigint")
    got = {r.p: r.fact_id for r in carry.last_before(p, f, ["k"], 3, strict=True).collect()}
    assert got == {1: 5, 2: 6, 3: None, 4: None, 5: None}
    got = {r.p: r.fact_id for r in carry.last_before(p, f, ["k"], 3, strict=False).collect()}
    assert got == {1: 6, 2: 6, 3: None, 4: None, 5: None}
    assert carry.last_before(p, f.limit(0), ["k"], 3, strict=True).filter("fact_id is not null").count() == 0
