import random

from pyspark.sql import functions as F

from tapline.operators import radius

MSG = "imsi string, ip string, sid string, ts_ms bigint, sess_time_sec bigint, status int"
H, M = 3_600_000, 60_000


def windows(spark, rows, **more):
    df = spark.createDataFrame([("i", "p", *r) if len(r) == 4 else r for r in rows], MSG)
    return sorted((r.sid, r.start_ms, r.end_ms, r.provisional) for r in radius.sessions(df, **more).collect())


def test_rules(spark):
    assert windows(spark, [("s", 1000, 0, 1), ("s", 9000, 8, 2), ("s", 20000, 19, 3)]) == [("s", 1000, 20000, False)]
    assert windows(spark, [("s", 20000, 15, 3)]) == [("s", 5000, 20000, False)]
    assert windows(spark, [("s", 20000, 15, 2)]) == [("s", 5000, 20000, True)]
    assert windows(spark, [("s", 20000, 15, 2), ("s", 24000, 0, 1), ("s", 30000, 0, 3)]) == [("s", 5000, 30000, False)]
    assert windows(spark, [("s", 1000, 0, 1), ("t", 5000, 0, 1), ("t", 6000, 0, 3)]) == [("s", 1000, 1000, False), ("t", 5000, 6000, False)]
    late = windows(spark, [("s", 1000, 0, 1), ("s", 2000, 0, 3), ("s", 2000 + 2 * M, 9, 2)])
    assert late == [("s", 1000, 2000, False), ("s", 1000, 2000 + 2 * M, False)]
    assert windows(spark, [("", 5000, 1, 3)]) == [("-", 4000, 5000, False)]


def test_open_sessions(spark):
    rows = [("s", 1000, 0, 1), ("i2", "p", "x", 5 * H, 0, 3)]
    assert ("s", 1000, 1000, False) not in windows(spark, rows)
    assert ("s", 1000, 1000, False) in windows(spark, rows, emit_open=True)
    assert ("s", 1000, 1000, False) in windows(spark, [("s", 1000, 0, 1), ("i2", "p", "x", 7 * H, 0, 3)])
    assert windows(spark, [(None, "p", "s", 1, 0, 3), ("i", None, "s", 1, 0, 3), ("i", "p", "s", None, 0, 3), ("i", "p", "s", 1, 0, None)]) == []


def test_repeats_against_one_by_one(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["hot", "hot", "a", None]), rng.choice([None, *range(300)])) for k in range(400)]
    kept, last = set(), {}
    for k, key, t in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (r[2], r[0])):
        if key not in last or t - last[key] > 20:
            last[key] = t
            kept.add(k)
    df = spark.createDataFrame(rows, "id2 bigint, key string, t bigint")
    got = radius.first_in_window(df, F.col("key"), F.col("t"), "id2", 20)
    assert {r[0] for r in got.collect()} == kept and got.columns == ["id2"]


def test_coalesce(spark):
    schema = "imsi string, ip string, sid string, start_ms bigint, end_ms bigint"
    rows = [("1", "p", "s", 0, 10), ("1", "p", "s", 10 + 2 * M, 20 + 2 * M), ("1", "p", "s", 10**9, None), ("1", "p", None, 5, 6), ("1", "p", "-", 7, 8), ("1", "p", "s", 9, 1), (None, "p", "s", 1, 2)]
    got = sorted(tuple(r) for r in radius.coalesced(spark.createDataFrame(rows, schema)).collect())
    assert got == [("1", "p", "-", 5, 8), ("1", "p", "s", 0, 20 + 2 * M), ("1", "p", "s", 10**9, None)]


def test_labels(spark):
    w = spark.createDataFrame([("000000000000002", "p", "s", 0, 100), ("000000000000001", "p", "s", 50, None), ("000000000000003", "q", "s", 0, 1)], "imsi string, ip string, sid string, start_ms bigint, end_ms bigint")
    e = spark.createDataFrame([(1, "p", 10), (2, "p", 60), (3, "p", 500), (4, "q", 2), (5, None, 1)], "tx bigint, ip string, t bigint")
    got = {r.tx: r.imsi for r in radius.labels(e, w, "tx", F.col("ip"), F.col("t")).collect()}
    assert got == {1: "000000000000002", 2: "000000000000001", 3: "000000000000001"}


def test_labels_keep_every_digit(spark):
    held = {"p": "1234567890123456", "q": "1234567890123457", "r": "12345678901234", "s": "012345678901234", "t": "00345678901234"}
    w = spark.createDataFrame([(imsi, ip, "s", 0, 100) for ip, imsi in held.items()] + [("12345678901234", "both", "s", 0, 9), ("123456789012340", "both", "s", 0, 9)], "imsi string, ip string, sid string, start_ms bigint, end_ms bigint")
    e = spark.createDataFrame([(k, ip, 5) for k, ip in enumerate([*held, "both"])], "tx bigint, ip string, t bigint")
    got = {r.tx: r.imsi for r in radius.labels(e, w, "tx", F.col("ip"), F.col("t")).collect()}
    assert got == dict(enumerate([*held.values(), "12345678901234"]))


def test_closed_windows_are_forgotten():
    machine = radius._Sessions(10**12, False)
    out = []
    for k in range(5000):
        t = k * 60_000
        out += machine.step({"imsi": "a", "ip": "b", "sid": f"s{k}", "ts_ms": t, "sess_time_sec": 5, "status": radius.STOP})
        if k:  # an interim a minute after the stop still prolongs the window before
            out += machine.step({"imsi": "a", "ip": "b", "sid": f"s{k - 1}", "ts_ms": t, "sess_time_sec": 5, "status": radius.INTERIM})
    assert len(machine.closed) <= radius.FEW and len(out) == 9999 and out[-1][4] == 4999 * 60_000
