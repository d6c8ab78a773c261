import math
import random

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import vector_search as vs


def brute_force(rows, asks, k):
    good = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {i: q for i, q in sorted(good, key=lambda r: r[1], reverse=True) if asks(i)}.items():
        best = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in good if j != i)[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def run(spark, rows, k):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("shard", F.lit(1))
    return sorted(map(tuple, vs.top_k(df.repartition(3), F.pmod("vec_id", F.lit(20)) == 0, k).collect()))


def test_against_brute_force(spark, monkeypatch):
    """Several shards, blocks and leaves; ties, copies, missing and broken vectors."""
    monkeypatch.setattr(vs, "SHARD", 150)
    monkeypatch.setattr(vs, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vs, "LEAF", 8)
    rng = random.Random(4)
    rows = [(i, [round(rng.gauss(0, 0.2), 2) for _ in range(6)]) for i in range(500)]
    rows += [(500 + i, rows[40][1]) for i in range(120)] + [(700, None), (720, []), (740, [0.1, None]), (760, [float("nan")] * 6), (780, [float("inf")] * 6), (None, [0.5] * 6), (60, rows[3][1]), (800, [0.5, 0.5])]
    assert run(spark, rows, 5) == brute_force(rows, lambda i: i % 20 == 0, 5)


def test_few_and_no_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, -1.0])]
    assert run(spark, rows, 20) == [(0, 1, 1, -64 * 64 * 2 + 32 * 64)]
    assert vs.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.pmod("vec_id", F.lit(20)) == 0).count() == 0


def test_large_components_stay_exact():
    x = np.array([[1 << 30, 3], [1 << 30, 2]], np.int64)
    at, ids, scores = vs.Tree(np.array([1, 2]), x).search(np.array([0]), np.array([[1 << 30, 1]], np.int64), np.array([vs.NONE]), 2)
    assert sorted(zip(at, scores, ids, strict=True)) == [(0, (1 << 60) + 2, 2), (0, (1 << 60) + 3, 1)]


def test_scores_beyond_a_long_are_held_to_its_limits(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0]), (3, [1e30, 9.0]), (4, [0.0, 1.0])]
    assert run(spark, rows, 3) == [(0, 1, 1, vs.LONG), (0, 2, 3, vs.LONG), (0, 3, 4, 64 * 64)]
    assert run(spark, rows, 20)[-1] == (0, 4, 2, -vs.LONG - 1)


def test_cells_hold_every_row_once_and_split_copies(spark, monkeypatch):
    """A third of the rows are one vector: its cell is dealt over shards of bounded size."""
    monkeypatch.setattr(vs, "SHARD", 60)
    monkeypatch.setattr(vs, "CELL_LEAST", 8)
    rng = random.Random(8)
    rows = [(i, [0.25, 0.5, -1.0] if i % 3 == 0 else [rng.uniform(-1, 1) for _ in range(3)]) for i in range(600)]
    assert run(spark, rows, 4) == brute_force(rows, lambda i: i % 20 == 0, 4)
    x = np.array([[math.floor(64 * v) for v in r[1]] for r in rows], np.int64)
    cells = vs.Cells(x, 10)
    dealt = cells.route(x)
    for c, (low, high) in enumerate(cells.boxes):
        assert (dealt == c).any() and (x[dealt == c] >= low).all() and (x[dealt == c] <= high).all()


def test_boxes_save_work():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.integers(-5, 5, (4000, 3)), rng.integers(90, 100, (50, 3))])
    tree = vs.Tree(np.arange(len(x)), x)
    at, ids, scores = tree.search(np.array([-1]), np.array([[90, 90, 90]]), np.array([vs.NONE]), 5)
    want = sorted(((-int(s), i) for i, s in enumerate(x @ np.array([90, 90, 90]))))[:5]
    assert [(-int(s), int(i)) for s, i in zip(scores, ids, strict=True)] == want and tree.visited < len(tree.first) / 4
