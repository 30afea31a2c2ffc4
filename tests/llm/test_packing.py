import random
from collections import Counter

from tapline.llm import packing


def best(items, capacity):
    items, found = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= found[0]:
            return
        if i == len(items):
            found[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b >= items[i]}.values():
            bins[k] -= items[i]
            go(i + 1, bins)
            bins[k] += items[i]
        bins.append(capacity - items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return found[0]


def test_reduction_keeps_an_optimum():
    rng = random.Random(1)
    for _ in range(400):
        capacity = rng.choice([10, 13, 20, 30])
        low = rng.choice([1, capacity // 4, capacity // 3])
        items = [rng.randint(max(1, low), capacity) for _ in range(rng.randint(1, 8))]
        fixed, rest = packing.reduced(Counter(items), capacity)
        left = [s for s, k in rest.items() for _ in range(k)]
        assert sum(k for _, k in fixed) + best(left, capacity) == best(items, capacity)


def test_plan_packs_every_counter_once():
    rng = random.Random(2)
    for _ in range(60):
        counts = Counter(min(100, 1 + int(rng.expovariate(0.05))) for _ in range(rng.randint(0, 3000)))
        got = Counter()
        for sizes, times in packing.plan(counts, 100):
            assert sum(sizes) <= 100
            for s in sizes:
                got[s] += times
        assert got == counts
        bins, total = sum(t for _, t in packing.plan(counts, 100)), sum(s * k for s, k in counts.items())
        assert bins <= -(-total // 100) * 1.02 + 1


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "PARTS", 3)
    rows = [(1, None), (2, ""), (3, "word " * 50), (4, "word " * 21), (5, "word " * 40), (6, "a"), (7, "a"), (8, "a")] + [(k, "tok " * 7) for k in range(10, 60)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, tokens int")
    got = packing.packed(df, capacity=20).collect()
    sizes = {r.doc_id: r.tokens for r in packing.token_counts(df).collect()}
    load, pieces = Counter(), {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append((r.piece_no, r.token_start, r.tokens))
        assert (r.container_id is None) == (r.tokens == 0)
        if r.container_id is not None:
            load[r.container_id] += r.tokens
    assert max(load.values()) <= 20 and set(load) == set(range(len(load)))
    for doc, n in sizes.items():
        parts = sorted(pieces[doc])
        assert sum(p[2] for p in parts) == n and [p[1] for p in parts] == [20 * k for k in range(len(parts))]
        assert len(parts) == max(1, -(-n // 20))
    assert packing.packed(df.limit(0)).count() == 0
