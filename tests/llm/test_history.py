import random
import re

from pyspark.sql import functions as F

from tapline.llm import history

SCHEMA = "ip string, dns string, ord bigint, batch_no int, name string, digits string"


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def brute(rows):
    accepted, out = {}, set()
    for ip, dns, o, batch in sorted(rows, key=lambda r: r[2]):
        if ip is None or dns is None:
            continue
        ip, name = re.sub("(?i)^::ffff:", "", ip.strip()), re.sub(r"[\s.]+$", "", dns.strip()).lower()
        known = accepted.setdefault((ip, re.sub("[^0-9]", "", name)), [])
        if batch and any(lev(name, k) <= 2 for k in known):
            out.add(o)
        else:
            known.append(name)
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    got = [r[0] for r in history.near_known(df).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_cases(spark):
    names = ["a.example", "A.Example.", "ab.example", "abcd.example", "a1.example", "a2.example", "a12.x", "1a2.x", "", ".", "a", "bb", "ccc", "dddd", "x" * 500 + "a", "x" * 500 + "bcd"]
    rows = [("10.0.0.1", n, k, 0 if k < 2 else 1 + k // 6) for k, n in enumerate(names)]
    rows += [(None, "a", 100, 2), ("10.0.0.1", None, 101, 2), (" ::FFFF:10.0.0.1", "a.examplee", 102, 3), ("10.0.0.2", "a.example", 103, 3), ("10.0.0.2", "a.example", 104, 3)]
    assert run(spark, rows) == brute(rows)


def test_chain_is_decided_in_order(spark):
    names = ["aaaaaaaa", "aaaaaabb", "aaaabbbb", "aabbbbbb", "bbbbbbbb", "bbbbbbcc", "bbbbcccc"]
    rows = [("10.0.0.9", "zzzzzzzzzzzzz", 0, 0)] + [("10.0.0.9", n, k + 1, 1) for k, n in enumerate(names)]
    assert run(spark, rows) == brute(rows) == {2, 4, 6}


def test_random_hot_address(spark):
    rng = random.Random(8)
    rows = []
    for o in range(160):
        base = list(rng.choice(["gateway.example", "portal.example", "mail7.test", "ab"]))
        for _ in range(rng.randint(0, 4)):
            p = rng.randrange(len(base) + 1)
            base[p : p + rng.randint(0, 1)] = rng.choice(["", "x", "y", "7"])
        rows.append((rng.choice(["10.0.0.1", "10.0.0.1", "10.0.0.2"]), "".join(base), o, 0 if o < 50 else 1 + o // 90))
    assert run(spark, rows) == brute(rows)


def test_no_history_and_part_keys_are_complete(spark):
    rng = random.Random(9)
    pairs = []
    for k in range(400):
        a = "".join(rng.choices("abc", k=rng.randint(0, 12)))
        b = list(a)
        for _ in range(2):
            p = rng.randrange(len(b) + 1)
            b[p : p + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        pairs.append((k, a, "".join(b)))
    near = [(k, a, b) for k, a, b in pairs if lev(a, b) <= 2]
    df = spark.createDataFrame(near, "ord bigint, a string, b string").withColumns({"ip": F.lit("x"), "digits": F.lit("")})
    one = history.part_rows(df.withColumnRenamed("a", "name")).select("key", "ord")
    two = history.probe_rows(df.withColumnRenamed("b", "name")).select("key", "ord")
    assert one.join(two, ["key", "ord"]).select("ord").distinct().count() == len(near)


def pairs_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def accepted(index):
    return sorted(r.ord for r in index.table(history.WHOLE).select("ord").distinct().collect())


def test_reopened_history_goes_on(spark, tmp_path):
    folder = (tmp_path / "index").as_uri()
    index = history.AcceptedPairs(spark, folder)
    index.take(pairs_of(spark, [("10.0.0.1", "gateway.example", 0, 1), ("10.0.0.1", "gatewax.example", 1, 1), ("10.0.0.1", "other.test", 2, 1)]))
    assert accepted(index) == [0, 2]  # a first batch is compared with itself
    for forget in (False, True):
        if forget:  # as another session would find it
            spark.sql(f"DROP TABLE {index._name(index.generation)}")
        index = history.AcceptedPairs(spark, folder, compact_every=2)
        index.take(pairs_of(spark, [("10.0.0.1", "gateway.example", 3, 2), ("10.0.0.1", "Gateway.exampl", 4, 2), ("10.0.0.2", "gateway.example", 5, 2)]))
        assert accepted(index) == [0, 2, 5]  # and taking a batch again changes nothing
    assert index.generation >= 0
    index.drop()
    assert not (tmp_path / "index").exists()


def test_compaction_leaves_one_file_a_bucket(spark, tmp_path):
    index = history.AcceptedPairs(spark, (tmp_path / "index").as_uri(), compact_every=3)
    for k in range(6):
        index.take(pairs_of(spark, [(f"10.0.{k}.{j}", f"host{j}.example", 100 * k + j, k) for j in range(20)]))
    assert index.generation == 2 and len(accepted(index)) == 120
    files = [f.name for f in (tmp_path / "index" / "keys-2").glob("*.parquet")]
    assert 0 < len(files) <= index.buckets
    index.drop()


def test_failed_run_leaves_nothing(spark, monkeypatch):
    before = {t.name for t in spark.catalog.listTables()}
    monkeypatch.setattr(history.AcceptedPairs, "take", lambda *_: 1 / 0)
    try:
        history.near_known(pairs_of(spark, [("a", "b", 0, 0), ("a", "b", 1, 1)]))
    except ZeroDivisionError:
        pass
    assert {t.name for t in spark.catalog.listTables()} == before


def test_crowded_endings(spark, monkeypatch):
    monkeypatch.setattr(history, "CROWD", 3)
    monkeypatch.setattr(history, "LONG", 14)
    rng = random.Random(21)
    rows = []
    for o in range(150):
        base = list(rng.choice(["ab", "cde", "fghij", "a", "longer-label-here"]) + ".host.example")
        for _ in range(rng.randint(0, 3)):
            p = rng.randrange(len(base) + 1)
            base[p : p + rng.randint(0, 1)] = rng.choice(["", "x", "y"])
        rows.append(("10.0.0.1", "".join(base), o, 0 if o < 40 else 1 + o // 60))
    assert run(spark, rows) == brute(rows)


def test_long_chain_takes_no_rounds(spark):
    names = ["a" * (60 - k) + "b" * k for k in range(0, 60, 2)]
    rows = [("10.0.0.9", "z" * 200, 0, 0)] + [("10.0.0.9", n, k + 1, 1) for k, n in enumerate(names)]
    assert run(spark, rows) == brute(rows)
