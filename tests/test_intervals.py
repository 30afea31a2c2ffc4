import random

from tapline.operators import intervals

SCHEMA = "who string, s bigint, e bigint, entity string, start string"


def frame(spark, rows):
    return intervals.usable(spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA), "who", "s", "e")


def brute(rows):
    found, spans = set(), []
    by = {}
    for who, s, e in rows:
        e = intervals.FOREVER if not e else e
        if who is not None and s is not None and e >= s:
            by.setdefault(who, []).append((s, e))
    for who, x in by.items():
        x.sort()
        top, begin = None, None
        for s, e in x:
            if top is None or s > top:
                if top is not None:
                    found.add((who, top, s))
                    spans.append((who, begin, top))
                begin = s
            top = e if top is None else max(top, e)
        spans.append((who, begin, top))
    return found, sorted(spans)


def check(spark, rows, chunk):
    df = frame(spark, rows)
    found, spans = brute(rows)
    got = [tuple(r) for r in intervals.gaps(df, chunk).collect()]
    assert len(got) == len(set(got)) and set(got) == found
    assert sorted((r.entity, r.period_start, r.period_end) for r in intervals.periods(df, chunk).collect()) == spans


def test_cases(spark):
    check(spark, [("a", 1, 5), ("a", 5, 6), ("a", 7, 9), ("a", 2, 3), ("b", 4, None), ("b", 99, 100), ("c", 10, 0), (None, 1, 2), ("d", None, 4), ("e", 9, 3)], 4)
    check(spark, [("a", 1, 5), ("a", 1, 5), ("a", 20, 20), ("a", 20, 30)], 1000)


def test_empty(spark):
    df = frame(spark, []) if False else frame(spark, [("a", 1, 2)]).limit(0)
    assert intervals.gaps(df).count() == 0 and intervals.periods(df).count() == 0


def test_random_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "x", "y", None]), rng.choice([None, *range(400)]), rng.choice([None, 0, *range(420)])) for _ in range(600)]
    rows = [(w, s, min(e, s + 6) if e and s and e > s else e) for w, s, e in rows]
    rows = [r for r in rows if r[2] not in (None, 0) or r[1] is None or r[1] > 300]
    for chunk in (7, 50, 10_000):
        check(spark, rows, chunk)


def test_gaps_come_from_periods(spark, monkeypatch):
    """What the periods are decides what the gaps are: joining the first two leaves the second gap only."""
    df = frame(spark, [("a", 1, 5), ("a", 9, 12), ("a", 20, 30)])
    joined = spark.createDataFrame([("a", 1, 12, 2), ("a", 20, 30, 1)], "entity string, period_start bigint, period_end bigint, n_intervals bigint")
    monkeypatch.setattr(intervals, "periods", lambda rows, chunk: joined)
    assert [tuple(r) for r in intervals.gaps(df, 4).collect()] == [("a", 12, 20)]
