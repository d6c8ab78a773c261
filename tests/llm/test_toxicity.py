import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import toxicity as tx


def all_maximal(scores):
    """Maximal segments by definition: take the best segment (shortest, then first), then do the same on either side."""
    best = None
    for a in range(len(scores)):
        total = 0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 0 and (best is None or total > best[0] + 1e-9 or abs(total - best[0]) < 1e-9 and b - a < best[2] - best[1]):
                best = (total, a, b)
    if best is None:
        return []
    total, a, b = best
    return all_maximal(scores[:a]) + [(a, b, total)] + [(x + b + 1, y + b + 1, s) for x, y, s in all_maximal(scores[b + 1 :])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([-1, -1, -1, -5, 2, 3, 4]), max_size=24))
def test_segments_are_the_maximal_ones(scores):
    found = tx.maximal_segments([(i, float(s)) for i, s in enumerate(scores) if s != -1], -1.0)
    expected = all_maximal(scores)
    assert sorted(round(s, 6) for *_, s in found) == sorted(round(float(s), 6) for *_, s in expected)


def test_linear_time():
    import time

    began = time.perf_counter()
    tx.maximal_segments([(3 * i, 2.0 - (i % 3) * 2.5) for i in range(300_000)], -0.2)
    assert time.perf_counter() - began < 5


TOXIC = ["vileness", "vilest", "brute", "foul"]


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "abcdefgh" for b in "aeiou" for c in "lmnrst"]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randrange(5, 200))
        toxic = int(rng.random() < 0.2)
        for _ in range(rng.randrange(1, 6) if toxic else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(TOXIC))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_learns_and_holds_out(spark):
    rows = corpus(1500, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "toxic").withColumn("text", F.lit(1))
    model = tx.fit_toxicity(docs.where("doc_id % 3 <> 1"), labels.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r.score for r in tx.score_documents(docs, model).collect()}
    held = [(got[i], y) for i, _, y in rows if i % 3 == 1]
    assert all(0 <= s <= 1 for s, _ in held)
    assert sum(s >= 0.7 for s, y in held if y) > 0.9 * sum(y for _, y in held) and sum(s >= 0.7 for s, y in held if not y) <= 2
    text = "alma " * 30 + "vilest brute foul " + "alma enos " * 30
    (a, b, _, p), *rest = model.passages(text)
    assert (a, b) == (1 + tx.tokens(text).index("vilest") - 1, tx.tokens(text).index("foul")) and p < 0.05 and not rest


def held_out(spark, rows):
    """Shares of toxic rows caught and of clean rows left alone, on a third that training has not seen."""
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "toxic")
    model = tx.fit_toxicity(docs.where("doc_id % 3 <> 1"), labels.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r.score for r in tx.score_documents(docs.where("doc_id % 3 = 1"), model).collect()}
    held = [(got[i], y) for i, _, y in rows if i % 3 == 1]
    return sum(s >= 0.7 for s, y in held if y) / sum(y for _, y in held), sum(s < 0.7 for s, y in held if not y) / sum(not y for _, y in held)


@pytest.mark.parametrize("form", ["beginning", "end", "inside", "pair", "dense"])
def test_learns_any_form(spark, form):
    """Toxic words of which only a beginning, an end or a middle part is fixed; pairs of harmless words; words that clean rows hold once, too."""
    rng = random.Random(form)
    syllables = [a + b for a in "bcdfghlmnprst" for b in "aeiou"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randrange(2, 4)))
    vocabulary = [word() for _ in range(3000)]
    make = {
        "beginning": lambda: "zwok" + word(), "end": lambda: word() + "zwok", "inside": lambda: word() + "zwok" + word(),
        "pair": lambda: f"{vocabulary[0]} {vocabulary[1]}", "dense": lambda: "zwok" + word(),
    }[form]
    rows = []
    for i in range(1500):
        words, toxic = rng.choices(vocabulary, k=rng.randrange(60, 200)), int(rng.random() < 0.2)
        extra = max(3, len(words) // 40) if toxic else int(form == "dense" and rng.random() < 0.15)
        for _ in range(extra):
            words.insert(rng.randrange(len(words) + 1), make())
        rows.append((i, " ".join(words), toxic))
    caught, left = held_out(spark, rows)
    assert caught >= 0.9 and left >= 0.98, (caught, left)


@pytest.mark.parametrize("reverse", [False, True])
def test_held_out_rows_of_the_given_table(spark, reverse):
    """The labels are noisy: a toxic row in sixteen has no toxic word at all."""
    from corpusloom.llm.queries import _remainder

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").withColumn("held_out", _remainder(3) == 1).select("doc_id", "text", "toxic", "held_out").collect()
    turn = (lambda t: re.sub(r"[^\W\d_]+", lambda m: m[0][::-1], t)) if reverse else (lambda t: t)
    rows = [(3 * n + 1 if r.held_out else 3 * n, turn(r.text or ""), r.toxic) for n, r in enumerate(rows)]
    caught, left = held_out(spark, rows)
    assert caught >= 0.85 and left >= 0.98, (caught, left)


def test_near_copies_count_once(spark):
    """A family of near copies of one toxic text teaches no more than the text."""
    rows = corpus(600, 2)
    copied = "quite harmless words about gardens stand in this long text which somebody has marked and copied "
    rows += [(1000 + 3 * i, copied * 3 + f"number{i}", 1) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = tx.fit_toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert "^gardens$" not in model.grams and not any("gardens" in p for p in model.pairs) and "^brute$" in model.grams


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "foul"), (3, "!!! 12"), (4, "foul " * 5000), (4, "foul " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(9))
    nothing = tx.fit_toxicity(df, spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int"))
    out = tx.score_documents(df, nothing).collect()
    assert len(out) == 6 and all(0 <= r.score < 0.7 and r.n_passages == 0 for r in out)
    assert tx.score_documents(df.limit(0), nothing).count() == 0
    assert tx.tokens("Wher. wher, wher other") == ["wher", "", "", "other"]
