import random

from pyspark.sql import functions as F

from tapline.functions.subscribers import imsi15, same_sid
from tapline.operators import messages
from tapline.plans.data_queries import MESSAGE_KEYS

SCHEMA = "recv_id bigint, imsi string, sid string, ts_ms bigint, status int, _n int"


def run(spark, rows, salts=4):
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    keys = {k: f(F.col(k)) for k, f in MESSAGE_KEYS.items()}
    args = (df, keys, ["imsi", "ts_ms"], "recv_id", salts)
    again = sorted(r[0] for r in messages.repeated_copies(*args).collect())
    first = sorted(r[0] for r in messages.first_copies(*args).collect())
    kept = sorted(r.recv_id for r in messages.deduplicated(*args).collect())
    assert len(again) == len(set(again))
    assert kept == sorted(set(r[0] for r in rows) - set(again))
    identified = {r[0] for r in rows if r[1] is not None and r[3] is not None}
    assert sorted(identified - set(again)) == first
    return again


def test_cases(spark):
    i = "001010000000001"
    rows = [(5, i, None, 1, 1), (3, f" {i}@r.example", "-", 1, 1), (4, i + "\0", " ", 1, 1), (6, i, "AB ", 2, 1), (7, i, "ab", 2, 1), (8, i, "ab", 2, 2), (9, None, "x", 1, 1), (10, None, "x", 1, 1), (11, i, "x", None, 1), (12, i, "x", None, 1), (13, i, "y", 5, None), (14, i, "y", 5, None)]
    assert run(spark, rows) == [4, 5, 7, 14]


def test_empty_and_all_equal(spark):
    i = "001010000000001"
    assert run(spark, [(n, i, "s", 1, 1) for n in range(200)], 8) == list(range(1, 200))
    df = spark.createDataFrame([], SCHEMA)
    assert messages.repeated_copies(df, {"imsi": imsi15(F.col("imsi")), "sid": same_sid(F.col("sid"))}, ["imsi"], "recv_id").count() == 0


def test_random(spark):
    rng = random.Random(2)
    rows = [(n, rng.choice([None, "0" * 14 + "1", "0" * 14 + "2"]), rng.choice([None, "", "-", "a", "A ", "b"]), rng.choice([None, 1, 2, 3]), rng.choice([1, 2])) for n in range(300)]
    seen, want = set(), []
    for n, imsi, sid, ts, st in rows:
        if imsi is None or ts is None:
            continue
        key = (imsi, (sid or "-").strip().lower() or "-", ts, st)
        if key in seen:
            want.append(n)
        seen.add(key)
    assert run(spark, rows) == want
