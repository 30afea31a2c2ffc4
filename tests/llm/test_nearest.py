import random

from pyspark.sql import functions as F

from tapline.llm import nearest


def run(spark, left, right, tol, by=nearest.nearest, **more):
    a = spark.createDataFrame(left, "lid bigint, who string, t bigint, bucket string, entity string")
    b = spark.createDataFrame(right, "rid bigint, who string, t bigint")
    out = by(a, b, left_id="lid", left_entity=F.col("who"), left_time="t", right_id="rid", right_entity=F.col("who"), right_time="t", tolerance=tol, **more)
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: (r[1], r[2]) for r in rows}


def brute(left, right, tol):
    out = {}
    for i, who, t, *_ in left:
        fit = [(abs(u - t), r) for r, w, u in right if who is not None and t is not None and w == who and u is not None and abs(u - t) <= tol]
        if fit:
            d, r = min(fit)
            out[i] = (r, d)
    return out


def test_cases(spark):
    left = [(1, "a", 10, "", ""), (1, "a", 10, "", ""), (2, "a", 100, "", ""), (3, None, 10, "", ""), (4, "a", None, "", ""), (5, "b", 10, "", ""), (6, "a", -7, "", "")]
    right = [(9, "a", 5), (8, "a", 15), (8, "a", 15), (7, "a", 105), (6, None, 10), (5, "a", None), (4, "a", -12), (3, "a", -12)]
    assert run(spark, left, right, 5) == {1: (8, 5), 2: (7, 5), 6: (3, 5)} == brute(left, right, 5)


def test_random(spark):
    rng = random.Random(4)
    for tol, span in ((5, 300), (40, 300), (3, 40)):
        left = [(i, rng.choice(["h", "h", "a", None]), rng.choice([None, *range(-span, span)]), "", "") for i in range(300)]
        right = [(i, rng.choice(["h", "h", "a", None]), rng.choice([None, *range(-span, span)])) for i in range(200)]
        assert run(spark, left, right, tol) == brute(left, right, tol)


def test_hot_buckets_are_sliced(spark):
    rng = random.Random(14)
    for tol, span, hot in ((100, 400, 3), (1000, 700, 5), (7, 40, 1)):
        left = [(i, rng.choice(["h", "h", "a"]), rng.randrange(-span, span), "", "") for i in range(160)]
        right = [(i, rng.choice(["h", "h", "a"]), rng.randrange(-span, span)) for i in range(60)]
        assert run(spark, left, right, tol, hot_rows=hot) == brute(left, right, tol)


def test_empty(spark):
    assert run(spark, [(1, "a", 1, "", "")], [(1, "b", 1)], 5) == {}


def test_one_instant_is_split(spark):
    rng = random.Random(15)
    left = [(i, "h", rng.choice([50, 50, 50, 51, 70]), "", "") for i in range(120)]
    right = [(i, "h", rng.choice([40, 52, 52, 52, 90])) for i in range(80)]
    for hot in (3, 10):
        assert run(spark, left, right, 12, hot_rows=hot) == brute(left, right, 12)


def test_join_gives_the_same(spark):
    rng = random.Random(24)
    for tol, span, most in ((5, 300, 10_000), (40, 60, 50), (7, 40, 0)):
        left = [(i, rng.choice(["h", "h", "a", None]), rng.choice([None, *range(-span, span)]), "", "") for i in range(200)]
        right = [(i, rng.choice(["h", "h", "a", None]), rng.choice([None, *range(-span, span)])) for i in range(120)]
        assert run(spark, left, right, tol, by=nearest.nearest_by_join, most_pairs=most) == brute(left, right, tol)
    assert run(spark, [(1, "a", 1, "", "")], [(1, "b", 1)], 5, by=nearest.nearest_by_join) == {}
