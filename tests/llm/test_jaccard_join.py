import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import jaccard_join as jj


def brute_force(rows):
    """class id, links and copies of each row, by comparing all pairs of distinct texts."""
    texts = defaultdict(list)
    for i, (k, t) in enumerate(rows):
        texts[tuple((t or "").lower().split())].append((k, i))
    words = [w for w in texts if w]
    sets = [{w[i : i + 5] for i in range(len(w) - 4)} or {w} for w in words]
    by = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            by[x].add(i)
    links, parent = defaultdict(set), list(range(len(words)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j > i}:
            if len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                links[i].add(j)
                links[j].add(i)
                parent[root(i)] = root(j)
    least = {}
    for i, w in enumerate(words):
        least[root(i)] = min([least.get(root(i), float("inf"))] + [k for k, _ in texts[w]])
    out = {}
    for i, w in enumerate(words):
        for k, row in texts[w]:
            out[row] = (k, least[root(i)], len(links[i]), len(texts[w]) - 1)
    for k, row in texts.get((), []):
        out[row] = (k, k, 0, 0)
    return sorted(out.values())


def mutated(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"m{rng.randrange(10**6)}"
    return words


def corpus(seed=3, families=25):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(families):
        base = rng.choices(vocabulary, k=rng.randrange(8, 300))
        for _ in range(rng.randrange(1, 12)):
            rows.append(" ".join(mutated(base, rng, rng.randrange(0, 6))))
    rows += ["", " \n", "one two", "One  two", "x", "x"] + rows[:15]
    rng.shuffle(rows)
    return list(enumerate(rows))


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cid", F.lit(1)).withColumn("path", F.lit("p")).repartition(3)
    return sorted(map(tuple, jj.jaccard_join(df).collect()))


def test_against_brute_force(spark):
    rows = corpus()
    assert run(spark, rows) == brute_force(rows)


def test_small_leaves_and_blocks(spark, monkeypatch):
    """Every branch of the recursion: splits, the last level, block pairs."""
    monkeypatch.setattr(jj, "LEAF", 4)
    monkeypatch.setattr(jj, "BLOCK_TEXTS", 5)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = list(enumerate([" ".join(mutated(base, rng, 1)) for _ in range(40)] + [t for _, t in corpus(9, 8)]))
    assert run(spark, rows) == brute_force(rows)


def test_query_against_brute_force(spark, sf_dir):
    from corpusloom.llm.queries import op10_ngram_jaccard_join

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, op10_ngram_jaccard_join(spark, sf_dir).collect())) == brute_force(rows)


def test_nulls_empty_tables_and_dropping(spark):
    rows = [(None, None), (7, None), (None, "a b c d e f g"), (3, "a b c d e f g"), (2, "A b c d  e f g"), (2, "A b c d  e f g"), (9, "other words stand here in this text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.class_id) for r in jj.jaccard_join(df).collect()}
    assert got == {(None, None), (7, 7), (None, 2), (3, 2), (2, 2), (9, 9)}
    kept = sorted([tuple(r) for r in jj.drop_near_duplicates(df).collect()], key=str)
    assert kept == sorted([(None, None), (7, None), (2, "A b c d  e f g"), (9, "other words stand here in this text")], key=str)
    assert jj.jaccard_join(df.limit(0)).count() == 0 and jj.drop_near_duplicates(df.limit(0)).columns == ["doc_id", "text"]


def test_recall_of_the_runs():
    assert all(1 - (1 - jj.reached(d)) ** jj.runs() >= jj.RECALL for d in range(1, jj.DEPTH + 1))


@pytest.mark.parametrize("few", [1, 3, 12, 1000])
@pytest.mark.parametrize("m", [3, 90, 400])
def test_similar_is_exact_on_every_path(monkeypatch, few, m):
    """Elements counted by pairs, by products, and both; near copies, strangers and equal sets in one large block."""
    monkeypatch.setattr(jj, "FEW", few)
    rng = np.random.default_rng(m)
    bases = [np.unique(rng.integers(-(1 << 40), 1 << 40, 300)) for _ in range(4)]
    sets = [np.unique(np.concatenate([rng.choice(bases[i % 4], 270, replace=False), rng.integers(0, 1 << 40, int(n))])) for i, n in enumerate(rng.integers(0, 60, m))]
    sets[1] = sets[0]
    sizes = np.array([len(s) for s in sets])
    both = np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in sets] for a in sets])
    plain = (both >= 0.8 * (sizes[:, None] + sizes[None, :] - both)) & ~np.eye(m, dtype=bool)
    assert (jj.similar(sets) == plain).all() and plain.any() and not plain.all()


def test_components_of_a_hub_and_a_chain(spark):
    from corpusloom.llm._graph import components

    edges = [(0, i) for i in range(2, 900)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5001), (5001, 5000), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    assert found == {0: 0, **{i: 0 for i in range(2, 900)}, **{i: 1000 for i in range(1000, 1101)}, 5000: 5000, 5001: 5000}
