import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate as dc


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def brute_force(docs, items):
    """Pairs with a window that agrees in enough words, on any diagonal, around an agreeing seed."""
    out = set()
    for k, t in docs:
        d = words(t)
        for item, s in items:
            b = words(s)
            if len(b) < dc.SHORTEST:
                continue
            if len(b) < dc.SPAN:
                if any(d[i : i + len(b)] == b for i in range(len(d) - len(b) + 1)):
                    out.add((k, item))
                continue
            window = min(dc.WINDOW, len(b))
            for diag in range(-len(b), len(d)):
                same = [0 <= diag + j < len(d) and d[diag + j] == b[j] for j in range(len(b))]
                for j in range(len(b) - dc.SPAN + 1):
                    if any(all(same[j + o] for o, bit in enumerate(m) if bit == "1") for m in dc.MASKS):
                        lo, hi = max(0, j - (dc.WINDOW - dc.SPAN)), min(len(b), j + dc.WINDOW)
                        if any(sum(same[s0 : s0 + window]) >= dc.AGREE * window for s0 in range(lo, min(j, hi - window) + 1)):
                            out.add((k, item))
    return out


def pairs(df):
    return {(r.doc_id, r.item_id) for r in df.collect()}


@pytest.mark.parametrize("piece", [1, 7, 256])
def test_planted_passages_and_replaced_words(spark, monkeypatch, piece):
    monkeypatch.setattr(dc, "SEEDS_A_PASS", 150)  # several passes
    monkeypatch.setattr(dc, "PIECE", piece)
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([3, 5, 9, 12, 13, 20, 40, 40, 60])]
    items += [(20, items[6][1]), (21, None), (22, "")]
    docs = []
    for k in range(60):
        text = rng.choices(vocabulary, k=rng.randrange(0, 80))
        b = words(rng.choice(items[:9])[1])
        lo = rng.randrange(0, max(1, len(b) - 14))
        part = [w if rng.random() > 0.12 else "changed" for w in (b if k % 2 else b[lo : lo + 16])]
        at = rng.randrange(0, len(text) + 1)
        docs.append((k, " ".join(text[:at]).upper() + " " + ", ".join(part) + ".\n" + " ".join(text[at:])))
    docs += [(100, None), (101, ""), (102, items[8][1]), (102, items[8][1]), (None, items[7][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("seed", F.lit(1)).withColumn("item", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string")
    found = pairs(dc.find_overlaps(d, b))
    assert found == brute_force(docs, items) and (None, 7) in found and len(found) > 40
    bad = {k for k, _ in found}
    assert sorted(r.doc_id for r in dc.drop_contaminated(d, b).collect()) == sorted(k for k, _ in docs if k not in bad)
    assert dc.find_overlaps(d.limit(0), b).count() == 0 and dc.find_overlaps(d, b.limit(0)).count() == 0


def test_query_catches_every_copied_passage(spark, sf_dir):
    from corpusloom.llm.queries import op9_decontamination

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    grams = {}
    for item, t in items:
        b = words(t)
        for i in range(len(b) - 14):
            grams.setdefault(tuple(b[i : i + 15]), set()).add(item)
    copied = {(k, item) for k, t in docs for d in [words(t)] for i in range(len(d) - 14) for item in grams.get(tuple(d[i : i + 15]), ())}
    assert pairs(op9_decontamination(spark, sf_dir)) == copied


def passes_check(d, b):
    """Whether any window of the item ``b`` agrees in enough words at any place of ``d``; no seeds."""
    window = min(dc.WINDOW, len(b))
    for diag in range(-len(b), len(d)):
        same = [0 <= diag + j < len(d) and d[diag + j] == b[j] for j in range(len(b))]
        if any(sum(same[s : s + window]) >= dc.AGREE * window for s in range(len(b) - window + 1)):
            return True
    return False


def test_every_pattern_of_replaced_words_is_hit(spark):
    """All ways to replace as many words as the check lets pass, and copies with every fifth word replaced."""
    docs, items = [], []
    for n in range(10, 16):
        item = [f"n{n}w{i}" for i in range(n)]
        items.append((n, " ".join(item)))
        for k in range(1, n // 5 + 1):
            for gone in itertools.combinations(range(n), k):
                docs.append((len(docs), n, " ".join(["before", *["x" if i in gone else w for i, w in enumerate(item)], "after"])))
    for n in (20, 30, 60):
        item = [f"n{n}w{i}" for i in range(n)]
        items.append((n, " ".join(item)))
        docs += [(len(docs) + p, n, " ".join("x" if i % 5 == p else w for i, w in enumerate(item))) for p in range(5)]
    d = spark.createDataFrame([(k, t) for k, _, t in docs], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert len(docs) > 800 and pairs(dc.find_overlaps(d, b)) == {(k, n) for k, n, _ in docs}


def test_same_as_a_search_without_seeds(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([12, 13, 14, 15, 16, 30])]
    docs = []
    for k in range(80):
        b = words(rng.choice(items)[1])
        part = [w if rng.random() > 0.22 else "changed" for w in b]
        docs.append((k, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 9)) + part[rng.randrange(0, 3) :] + rng.choices(vocabulary, k=rng.randrange(0, 9)))))
    want = {(k, item) for k, t in docs for item, s in items if passes_check(words(t), words(s))}
    found = pairs(dc.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert found == want and 20 < len(want) < len(docs) * len(items)


def test_short_items(spark):
    """5 to 11 words by the same check, also at the ends of a document; fewer words as they are."""
    items, docs = [], []
    for n in range(1, 12):
        item = [f"s{n}w{i}" for i in range(n)]
        items.append((n, " ".join(item)))
        for k in range(0, 4):
            for gone in itertools.combinations(range(n), k):
                copy = ["x" if i in gone else w for i, w in enumerate(item)]
                for text in (copy, ["before", *copy, "after"], [w for i, w in enumerate(item) if i not in gone] if gone in ((0,), (n - 1,)) else copy):
                    docs.append((len(docs), " ".join(text)))
    want = {(k, n) for k, t in docs for n, s in items if passes_check(words(t), words(s))}
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = dc.find_overlaps(d, b)
    rows = found.collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and {n for _, n in want} == set(range(1, 12))
    sizes = {k: len(words(t)) for k, t in docs}
    assert all(0 <= r.doc_from <= r.doc_to < sizes[r.doc_id] for r in rows)
