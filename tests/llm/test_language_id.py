import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import language_id as li

WORDS = {"xx": ["kato", "lina", "moru", "tesi", "pako"], "yy": ["grund", "schift", "wald", "brecht", "zwolf"], "zz": ["été", "çava", "oiseau", "être", "là"]}


def texts(n, seed):
    rng = np.random.default_rng(seed)
    return [(" ".join(rng.choice(WORDS[y], int(rng.integers(2, 60)))), y) for y in WORDS for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    rows = texts(60, 0)
    return li.train([t for t, _ in rows], [y for _, y in rows])


def test_accuracy_on_unseen_texts(model):
    rows = texts(40, 1)
    langs, score, rejected = model.predict([t for t, _ in rows])
    assert np.mean([a == y for a, (_, y) in zip(langs, rows, strict=True)]) > 0.97 and ((score >= 0) & (score <= 1)).all()
    assert rejected.mean() < 0.02


def test_no_letters(model):
    langs, score, rejected = model.predict([None, "", "12 3!", "  ", "kato"])
    assert langs[:4] == ["und"] * 4 and (score[:4] == 0).all() and rejected[:4].all() and langs[4] == "xx"


def test_blocks_change_nothing(model, monkeypatch):
    rows = [t for t, _ in texts(20, 2)] + ["x" * 3000, "", "a1b2 " * 500]
    whole, has = model.batched(rows)
    one, _ = model.logits(rows)
    for block in (64, 7, 1):
        monkeypatch.setattr(li, "BLOCK", block)
        assert np.allclose(model.batched(rows)[0], whole) and np.allclose(model.logits(rows)[0], one)
    assert np.allclose(one, whole) and has.tolist() == [bool(t) for t in rows]


def test_training_repeats():
    rows = texts(10, 3)
    a, b = (li.train([t for t, _ in rows], [y for _, y in rows]) for _ in range(2))
    assert np.array_equal(a.table, b.table) and a.threshold == b.threshold


def test_tables(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate(texts(30, 4))] + [(900, "kato", None), (901, None, "xx"), (5, "wald grund", "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("mine"))
    out = li.identify(df, li.fit_language_model(df)).collect()
    assert len(out) == len(rows) and all(r.row.score == "mine" for r in out)
    assert {r.lang_pred for r in out if r.row.doc_id == 901} == {"und"} and np.mean([r.lang_pred == r.row.lang for r in out if r.row.lang and r.row.text]) > 0.95
    empty = li.fit_language_model(df.where("lang is null"))
    assert li.identify(df, empty).where("rejected").count() == len(rows)
    assert li.identify(df.limit(0), empty).count() == 0


def test_query_on_held_out_rows(spark, sf_dir):
    from corpusloom.llm.queries import op7_language_id

    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in op7_language_id(spark, sf_dir).collect() if r.held_out]
    assert len(held) > 30 and np.mean([r.lang_pred == known[r.doc_id] for r in held]) > 0.95


def test_sample_has_every_language_and_a_bound_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(li, "SAMPLE_BYTES", 40_000)
    seen = {}
    monkeypatch.setattr(li, "train", lambda texts, labels: seen.update(texts=texts, labels=labels))
    rows = [(i, f"text number {i} " * 5, f"l{i % 1200}") for i in range(2400)] + [(i, "x" * 3000, "big") for i in range(3000, 3200)]
    li.fit_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=100_000)
    assert sum(map(len, seen["texts"])) < 43_000
    monkeypatch.setattr(li, "SAMPLE_BYTES", 1 << 30)
    li.fit_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=100_000)
    assert len(set(seen["labels"])) == 1201
