import random

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import token_counts as tc
from corpusloom.llm.queries import TOKENIZER


@pytest.fixture(scope="module")
def counter():
    return tc.PretokenCounter(P.path(TOKENIZER), P.PATTERN, {" the": 1})


def library(counter, text):
    return len(counter.tok.encode(text, add_special_tokens=False).ids)


def test_every_plain_character_splits_as_the_library_does(counter):
    """Each code point between letters, digits, marks and spaces."""
    wrong = []
    assert not counter.odd("".join(map(chr, range(32, 127))) + "é海ñ\n")
    for block in range(0, 0x20000, 64):
        chars = [chr(c) for c in range(block, block + 64) if not 0xD800 <= c <= 0xDFFF]
        pieces = [f"a{c}b 1{c}2 !{c}? {c} \n{c}{c}x" for c in chars if not counter.odd(c)]
        if not pieces:
            continue
        whole = counter.tok.encode_batch(pieces, add_special_tokens=False)
        wrong += [p for p, e in zip(pieces, whole, strict=True) if counter.count(p) != len(e.ids)]
    assert not wrong


def test_random_texts(counter):
    rng = random.Random(7)
    alphabet = ["the", " ", "  ", "\n", "\t", "don't", "'ll", "é", "海", "1", "２", "!!", "<|endoftext|>", "<|endof", "\u200d", "\x1c", "🙂", "مرحبا", "हिन्दी", "\u0378", "_", "x" * 70]
    for _ in range(600):
        text = "".join(rng.choices(alphabet, k=rng.randrange(0, 12)))
        assert counter.count(text) == library(counter, text), repr(text)


def test_cache_is_bounded(counter, monkeypatch):
    monkeypatch.setattr(tc, "CACHED", 3)
    for word in ("qa", "qb", "qc", "qd", "qe", "qf"):
        counter.count(word)
    assert len(counter.lengths) <= 3 + len(counter.frequent) + 1


def test_rows_stay(spark):
    rows = [(1, "the cat"), (1, "the cat"), (None, None), (2, ""), (3, "word " * 600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("mine"))
    got = tc.count_tokens(df, P.path(TOKENIZER), P.PATTERN).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_bytes, r.over_limit) for r in got] == [(None, 0, False), (1, 7, False), (1, 7, False), (2, 0, False), (3, 3000, True)]
    assert got[0].n_tokens == 0 and got[1].n_tokens == 2
    assert tc.count_tokens(df.limit(0), P.path(TOKENIZER), P.PATTERN).count() == 0


def test_query_against_library(spark, sf_dir, counter):
    from corpusloom.llm.queries import op8_token_counts

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = op8_token_counts(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_tokens, r.n_bytes) == (library(counter, texts[r.doc_id]), len(texts[r.doc_id].encode()))
