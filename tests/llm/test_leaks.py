import random

from tapline.llm import leaks


def brute(docs, items, run):
    def grams(t):
        w = leaks.words_of(t)
        return {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}

    have = {i: grams(t) for i, t in items}
    return {(d, i) for d, t in docs for i, g in have.items() if g & grams(t)}


def run_(spark, docs, items, **more):
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id bigint, text string, words string")
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id bigint, text string, n int")
    rows = [tuple(r) for r in leaks.leaks(d, i, **more).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


TEXT = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def test_cases(spark):
    items = [(1, TEXT), (2, None), (3, ""), (4, "too short"), (5, TEXT.replace("seven", "SEVEN_"))]
    docs = [(1, f"x {TEXT.upper().replace(' ', ', ')} y"), (2, " ".join(TEXT.split()[:12])), (3, " ".join(TEXT.split()[1:])), (4, None), (5, ""), (6, TEXT.replace("seven", "7")), (7, "wörd " * 40_000 + TEXT), (8, TEXT.replace(" ", "_"))]
    assert run_(spark, docs, items) == brute(docs, items, 13)
    assert {(1, 1), (3, 5), (7, 1), (8, 1)} <= brute(docs, items, 13)


def test_random_and_blocks(spark):
    rng = random.Random(6)
    words = ["a", "b", "c"]
    docs = [(k, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for k in range(60)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(0, 20)))) for k in range(12)]
    for more in ({}, {"block_words": 40}):
        assert run_(spark, docs, items, run=7, gram=3, **more) == brute(docs, items, 7)


def test_empty(spark):
    assert run_(spark, [(1, TEXT)], [(1, "x")]) == set()


def test_long_items_and_hot_shingles(spark):
    rng = random.Random(16)
    words = ["a", "b", "c", "d"]
    boiler = " ".join(rng.choices(words, k=30))
    docs = [(k, " ".join(rng.choices(words, k=rng.randint(0, 30))) + " " + (boiler if k % 3 else "")) for k in range(60)]
    items = [(1, " ".join(rng.choices(words, k=400))), (2, boiler + " x"), (3, "y " + boiler), (4, " ".join(rng.choices(words, k=15)))]
    for more in ({"block_words": 200}, {"salt_rows": 4}, {"block_words": 300, "salt_rows": 2}):
        assert run_(spark, docs, items, run=6, gram=3, **more) == brute(docs, items, 6)


def test_blocks_are_bounded(spark):
    items = spark.createDataFrame([(k, "w " * n) for k, n in enumerate([500, 3, 90, 40, 13, 700])], "item_id bigint, text string")
    sizes = [sum(len(r.text.split()) for r in b.collect()) for b in leaks._blocks(items, 100, 13)]
    assert max(sizes) <= 100 and sum(sizes) >= 1343
