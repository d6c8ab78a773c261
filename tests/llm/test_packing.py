import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from corpusloom.llm import packing


def naive(items, capacity):
    """Best fit by looking at every bin."""
    bins, out, quota = [], [None] * len(items), packing.quotas(items, capacity)
    for i in sorted(range(len(items)), key=lambda i: -items[i][0]):
        n, s, c = items[i]
        fit = [b for b, (left, ss, cc) in enumerate(bins) if left >= n and (s is None or ss.count(s) < quota[s]) and (c is None or c not in cc) and left > 0]
        if fit:
            b = min(fit, key=lambda b: (bins[b][0], b))
        else:
            b = len(bins)
            bins.append([capacity, [], set()])
        out[i] = (b, capacity - bins[b][0])
        bins[b][0] -= n
        bins[b][1].append(s)
        bins[b][2].add(c)
    return out


def test_equals_looking_at_every_bin():
    rng = random.Random(1)
    for _ in range(60):
        items = [(rng.randrange(1, 30), rng.choice([None, "a", "b", "c", "d", "d", "d"]), rng.choice([None, *range(12), 0, 0, 0])) for _ in range(rng.randrange(0, 120))]
        assert packing.pack_items(items, 30) == naive(items, 30)


def test_quotas():
    items = [(10, "hot", None)] * 30 + [(10, f"s{i}", None) for i in range(10)] + [(10, None, None)] * 2
    assert packing.quotas(items, 42) == {"hot": 3, **{f"s{i}": 1 for i in range(10)}, None: 1}
    bins = Counter(b for b, _ in packing.pack_items(items, 42))
    assert len(bins) == 11 and max(bins.values()) == 4


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_A_SHARD", 40)
    rng = random.Random(2)
    rows = [(i, rng.choice(["s0", "s0", "s1", "s2", None]), rng.randrange(6), rng.randrange(0, 260)) for i in range(300)] + [(None, None, None, None)] + [(5, "s1", 3, 20)] * 30
    df = spark.createDataFrame(rows, "doc_id long, source string, c long, n int").withColumn("piece", F.lit("x")).withColumn("k", F.lit("y"))
    out = packing.pack(df, F.col("n"), cluster=F.col("c"), capacity=100).collect()
    info = {r[0]: r for r in rows}
    assert sum(r.length for r in out) == sum(r[3] or 0 for r in rows)
    assert sum(r.piece == 0 for r in out) == len(rows) and all((r.bin_id is None) == (r.length == 0) for r in out)
    bins = defaultdict(list)
    for r in out:
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    for inside in bins.values():
        inside.sort(key=lambda r: r.offset)
        at = 0
        for r in inside:
            assert r.offset == at
            at += r.length
        assert at <= 100
        sources = [info[r.doc_id][1] for r in inside if info[r.doc_id][1] is not None]
        clusters = [info[r.doc_id][2] for r in inside if info[r.doc_id][2] is not None]
        assert len(clusters) == len(set(clusters)) and max(Counter(sources).values(), default=0) <= 2
    assert packing.pack(df.limit(0), F.col("n")).count() == 0
