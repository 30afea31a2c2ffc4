import itertools
import random

from pyspark.sql import functions as F

from tapline.llm import distinct

SCHEMA = "day int, net string, port int, src string, dst string, grouping string, word string"


def rows_(seed, n):
    rng = random.Random(seed)
    return [(rng.choice([None, 0, 1, 2]), rng.choice([None, "a", "b", ""]), rng.choice([None, 0, 80, 65535]), rng.choice([None, "hot", "hot", "hot", *map(str, range(150))]), rng.choice([None, *map(str, range(300))]), "x", "y") for _ in range(n)]


def brute(rows):
    out = {}
    for grouping in range(8):
        for r in rows:
            key = tuple("all" if grouping >> k & 1 else r[k] for k in range(3))
            sets = out.setdefault((grouping, key), (set(), set()))
            for s, v in zip(sets, r[3:5], strict=True):
                if v is not None:
                    s.add(v)
    return {k: (len(a), len(b)) for k, (a, b) in out.items()}


def test_cube_against_brute_force(spark):
    rows = [*rows_(1, 900), (9, "only", 1, None, None, "x", "y"), (9, "only", 2, None, "z", "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    for hot in (20, 100_000):
        got = distinct.cube_counts(df, {d: F.col(d) for d in ("day", "net", "port")}, {"s": F.col("src"), "d": F.col("dst")}, task_rows=100, hot_rows=hot).collect()
        have = {(r.grouping, tuple("all" if r.grouping >> k & 1 else r[k] for k in range(3))): (r.s, r.d) for r in got}
        assert len(have) == len(got) and have == brute(rows)


def test_empty_cube(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert distinct.cube_counts(df, {"day": F.col("day")}, {"s": F.col("src")}).count() == 0


def test_partials_merge_and_intersect(spark):
    df = spark.createDataFrame(rows_(3, 800), SCHEMA)
    first, later = df.filter("day = 0"), df.filter("day = 1 or day = 2")
    codes = distinct.cut(distinct.dictionary(first.select("src")))
    codes = distinct.cut(distinct.dictionary(later.select("src"), codes))
    all_codes = sorted(r.code for r in codes.collect())
    assert all_codes == list(range(len(all_codes)))
    parts = distinct.words(first, ["day"], "src", codes).unionByName(distinct.words(later, ["day"], "src", codes))
    whole = distinct.counted(distinct.merged(parts.withColumn("all", F.lit(1)), ["all"]), ["all"]).first().n
    sets = {d: {r[3] for r in rows_(3, 800) if r[0] == d and r[3] is not None} for d in (0, 1, 2)}
    assert whole == len(set.union(*sets.values()))
    for a, b in itertools.combinations((0, 1, 2), 2):
        x, y = (parts.filter(F.col("day") == d).drop("day").withColumn("k", F.lit(1)) for d in (a, b))
        assert distinct.counted(distinct.common(x, y, ["k"]), ["k"]).first().n == len(sets[a] & sets[b])


def counts_of(df):
    return {(r.grouping, tuple("all" if r.grouping >> k & 1 else r[k] for k in range(3))): (r.s, r.d) for r in df.collect()}


def test_stored_days_equal_the_whole(spark):
    rows = rows_(7, 900)
    rows += [(d, "a", -5 * (d or 0), f"late{d}", "hot2", "x", "y") for d in (0, 1, 2) for _ in range(40)]
    for hot in (30, 100_000):
        dims, idents = {d: F.col(d) for d in ("day", "net", "port")}, {"s": F.col("src"), "d": F.col("dst")}
        store = distinct.BitmapStore(spark, dims, idents, task_rows=100, hot_rows=hot)
        for day in (1, None, 0, 2):
            some = [r for r in rows if r[0] == day]
            store.add(spark.createDataFrame(some, SCHEMA))
        assert counts_of(store.cube()) == brute(rows)
        store.drop()


def test_codes_longer_than_a_word(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    digits = [rng.integers(0, 1000, 500) for _ in range(9)]
    word, bits = rng.integers(0, 50, 500), np.left_shift(np.uint64(1), rng.integers(0, 64, 500).astype(np.uint64))
    assert len(distinct._packs([1000] * 9 + [50])) > 1
    for grouping, group, w, b in distinct._lattice(digits, [1000] * 9, word, bits):
        want = {}
        for k in range(500):
            key = (*(0 if grouping >> n & 1 else int(d[k]) for n, d in enumerate(digits)), int(word[k]))
            want[key] = want.get(key, 0) | int(bits[k])
        assert {(*(int(g[k]) for g in group), int(w[k])): int(b[k]) for k in range(len(b))} == want
