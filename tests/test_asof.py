import random

import numpy as np
from pyspark.sql import functions as F

from tapline.operators import asof


def run(spark, events, versions, **more):
    e = spark.createDataFrame(events, "id bigint, ip string, t bigint, version_id string")
    v = spark.createDataFrame(versions, "row bigint, ip string, s bigint, e bigint, k bigint, bucket int")
    out = asof.as_known(e, v, event_id="id", event_entity=F.col("ip"), event_time=F.col("t"), version_id="row", version_entity=F.col("ip"), start="s", end="e", known="k", **more)
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows))
    return dict(rows)


def brute(events, versions):
    out = {}
    for i, ip, t, _ in events:
        if ip is None or t is None:
            continue
        fit = [(s, s if k is None else k, r) for r, w, s, e, k, _ in versions if w == ip and s is not None and s <= t and (not e or e >= t) and (not e or e >= s) and (s if k is None else k) <= t]
        if fit:
            out[i] = max(fit)[2]
    return out


def test_cases(spark):
    events = [(1, "a", 10, "x"), (2, "a", 5, "x"), (3, None, 5, "x"), (4, "a", None, "x"), (5, "z", 1, "x"), (1, "a", 10, "x"), (6, "a", 20, "x")]
    versions = [(1, "a", 1, 0, 1, 0), (2, "a", 6, 10, 11, 0), (3, "a", 7, 10, 8, 0), (3, "a", 7, 10, 8, 0), (4, "a", 7, 9, 8, 0), (5, None, 1, None, 1, 0), (6, "a", None, None, 1, 0), (7, "a", 15, 12, 1, 0), (8, "a", 20, 20, 20, 0), (9, "a", 20, None, 20, 0)]
    assert run(spark, events, versions, bucket=4) == {1: 3, 2: 1, 6: 9} == brute(events, versions)


def test_empty(spark):
    assert run(spark, [(1, "a", 1, "")], [(1, "b", 1, 1, 1, 0)]) == {}
    e = spark.createDataFrame([], "id bigint, ip string, t bigint")
    v = spark.createDataFrame([], "row bigint, ip string, s bigint, e bigint, k bigint")
    assert asof.as_known(e, v, event_id="id", event_entity=F.col("ip"), event_time=F.col("t"), version_id="row", version_entity=F.col("ip"), start="s", end="e", known="k").count() == 0


def test_random_against_brute_force(spark):
    rng = random.Random(11)
    for bucket, cell in ((3, 2), (16, 5), (100_000, 100_000)):
        events = [(i, rng.choice(["hot", "hot", "a", "b", None]), rng.choice([None, *range(-50, 300)]), "") for i in range(400)]
        versions = []
        for r in range(250):
            s = rng.choice([None, *range(-60, 300)])
            versions.append((r, rng.choice(["hot", "hot", "a", "c", None]), s, rng.choice([None, 0, *((s + d) for d in range(-3, 90) if s is not None)]), rng.choice([None, *((s + d) for d in range(0, 60) if s is not None)]), 0))
        assert run(spark, events, versions, bucket=bucket, cell_rows=cell, task_rows=50) == brute(events, versions)


def test_best_cover():
    at = np.array([1, 3, 3, 7, 9])
    got = asof.best_cover(at, np.array([0, 3, 8, 4]), np.array([100, 3, 9, 6]), np.array([5, 9, 2, 7]))
    assert got.tolist() == [5, 9, 9, 5, 5]
