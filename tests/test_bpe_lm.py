import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from corpusloom.config import ModelConfig
from corpusloom.functions import tokens
from corpusloom.operators import bpe, lm

SMALL = ModelConfig(dim=32, n_layers=2, n_heads=4, n_kv_heads=2, vocab_size=50, max_seq_len=64)


@pytest.fixture(scope="module")
def model():
    return lm.Decoder(SMALL, lm.init_params(SMALL))


def test_bytes_alone_are_the_byte_vocabulary():
    vocab = bpe.build_vocab([])
    assert len(vocab) == tokens.VOCAB
    tok = Tokenizer.from_str(bpe.tokenizer_json(vocab, []))
    text = "<s>assistant\nhé海 1</s>\n"
    assert tok.encode(text, add_special_tokens=False).ids == tokens.encode_text(text)


def test_training_encoding_and_decoding(spark, tmp_path):
    rng = random.Random(0)
    texts = [" ".join(rng.choices(["low", "lower", "lowest", "new", "newer", "été", "don't", "12"], k=30)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocab, merges = bpe.train(df, 280)
    assert len(vocab) == 280 and (vocab, merges) == bpe.train(df.repartition(3), 280)
    bpe.save(spark, f"{tmp_path}/tok", vocab, merges)
    assert bpe.load(spark, f"{tmp_path}/tok") == (vocab, merges)
    spec = spark.read.text(f"{tmp_path}/tok/tokenizer").first().value
    coded = bpe.encode(df, spec, "text")
    back = bpe.decode(coded, spec, "ids", "back").collect()
    tok = Tokenizer.from_str(spec)
    assert all(r.back == r.text and r.ids == tok.encode(r.text).ids and len(r.ids) < len(r.text.encode()) for r in back)


def test_pretokens_split_as_the_library(spark):
    from tokenizers import pre_tokenizers

    level = pre_tokenizers.ByteLevel(add_prefix_space=False)
    texts = ["a  b\n\n c d's 12x é海 !?", "  lead", "tail \n", "x\t\ty", "'ll it", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(bpe.pretokens(__import__("pyspark.sql.functions", fromlist=["col"]).col("t")).alias("p")).collect()
    for t, r in zip(texts, got, strict=True):
        assert [len(x.encode()) for x in r.p] == [len(p) for p, _ in level.pre_tokenize_str(t)], t


def test_cached_decoding_equals_one_pass(model):
    ids = np.random.default_rng(1).integers(3, 50, (2, 12))
    whole, _ = model.forward(ids)
    first, past = model.forward(ids[:, :5])
    second, past = model.forward(ids[:, 5:9], past, 5)
    third, _ = model.forward(ids[:, 9:], past, 9)
    assert np.allclose(whole, np.concatenate([first, second, third], axis=1), atol=1e-4)
    assert past[0][0].shape == (2, 9, 2, 8)


def test_chunk_mask_is_the_full_mask(model):
    ids = np.random.default_rng(2).integers(3, 50, (1, 8))
    _, past = model.forward(ids[:, :5])
    chunk = np.array([[1, 0, 1]])
    full = np.array([[1, 1, 1, 1, 1, 1, 0, 1]])
    assert np.allclose(model.forward(ids[:, 5:], past, 5, chunk)[0], model.forward(ids[:, 5:], past, 5, full)[0])
    with pytest.raises(ValueError):
        model.forward(ids[:, 5:], past, 5, np.ones((1, 4)))
    with pytest.raises(ValueError):
        model.forward(np.zeros((1, 65), int))


def test_padding_changes_nothing(model):
    ids = np.random.default_rng(3).integers(3, 50, (1, 9))
    padded, mask = np.zeros((1, 14), int), np.zeros((1, 14), int)
    padded[:, :9], mask[:, :9] = ids, 1
    assert np.allclose(model.token_nll(padded, mask)[:, :8], model.token_nll(ids), atol=1e-5)


def test_finished_rows_pad_and_all_finished_stops(model):
    def fixed(choices):
        def forward(ids, past, start):
            step = fixed.step
            fixed.step += 1
            out = np.full((len(ids), 1, 50), -9.0)
            for i, c in enumerate(choices):
                out[i, 0, c[min(step, len(c) - 1)]] = 9.0
            return out, []
        fixed.step = 0
        return forward

    prompt = np.array([[7, 8], [7, 8]])
    out = lm.generate(model, prompt, max_new_tokens=4, temperature=0, forward=fixed([[2], [5]]))
    assert out.tolist() == [[2, 0, 0, 0], [5, 5, 5, 5]]
    assert lm.generate(model, prompt, max_new_tokens=4, temperature=0, forward=fixed([[2], [2]])).tolist() == [[2], [2]]
    assert lm.generate(model, prompt, max_new_tokens=0).tolist() == prompt.tolist()


def test_next_token_rules():
    x = np.array([1.0, -1.0, 0.5, 0.9])
    assert lm.next_token(x, np.array([0]), 0, None, 2.0, 0.0) == 3
    assert lm.next_token(np.array([-1.0, -0.9]), np.array([0]), 0, None, 2.0, 0.0) == 0  # a negative logit rises
    assert {lm.next_token(np.log([0.5, 0.3, 0.15, 0.05]), np.array([], int), 1.0, 0.6, 1.0, u) for u in np.linspace(0, 0.999, 50)} == {0, 1}
    assert lm.next_token(np.log([0.5, 0.5]), np.array([], int), 1.0, 0.0, 1.0, 0.99) == 0


def test_scoring_rows(spark, model):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(3, 50, int(n)).tolist()) for i, n in enumerate([5, 1, 0, 20, 9])]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, ids array<int>").repartition(2), SMALL, model.params, batch=2).collect()}
    for i, ids in rows:
        expected = float(model.token_nll(np.array([ids])).sum()) if len(ids) > 1 else 0.0
        assert abs(got[i].nll_sum - expected) < 1e-3 and got[i].n_scored == max(0, len(ids) - 1)
    made = lm.generate_rows(spark.createDataFrame(rows[:1], "doc_id long, ids array<int>"), SMALL, model.params, max_new_tokens=3, trace=True).collect()
    assert [len(r.ids) for r in sorted(made, key=lambda r: r.step)] == list(range(1, len(made) + 1))


def test_config():
    assert ModelConfig().ffn_dim == 1408
    assert sum(int(np.prod(s)) for s in ModelConfig().shapes().values()) == 28_975_616
    for bad in ({"n_kv_heads": 3}, {"dim": 100, "n_heads": 8}, {"max_seq_len": 0}):
        with pytest.raises(ValueError):
            ModelConfig(**bad)


def test_all_distinct_words_count(spark):
    """The rarest of 260,000 distinct pre-tokens share the most frequent pair."""
    letters = "translate(cast(id AS string), '0123456789', 'abcdefghij')"
    head = spark.range(200_000).selectExpr(f"{letters} AS text")
    tail = spark.range(60_000).selectExpr(f"concat('zq', {letters}) AS text")
    _, merges = bpe.train(head.union(head).union(tail), 260)
    assert merges == [("z", "q")]


def plain_merges(words, n_merges):
    """Every pair counted anew for each merge."""
    parts, merges = [([bpe.alphabet()[b] for b in w.encode()], n) for w, n in words], []
    for _ in range(n_merges):
        counts = {}
        for p, n in parts:
            for pair in zip(p, p[1:]):
                counts[pair] = counts.get(pair, 0) + n
        if not counts:
            break
        merges.append(min(counts, key=lambda x: (-counts[x], x)))
        for p, _ in parts:
            j = 0
            while j + 1 < len(p):
                if (p[j], p[j + 1]) == merges[-1]:
                    p[j : j + 2] = [p[j] + p[j + 1]]
                j += 1
    return merges


def test_merges_equal_plain_counting():
    rng = random.Random(4)
    words = [("".join(rng.choices("aab", k=rng.randrange(1, 9))), rng.randrange(1, 5)) for _ in range(150)]
    assert bpe.learn_merges(words, 60) == plain_merges(words, 60)


def test_merges_of_many_tasks_equal_plain_counting(spark):
    rng = random.Random(5)
    words = {"".join(rng.choices("aabc", k=rng.randrange(1, 9))): rng.randrange(1, 5) for _ in range(150)} | {"a" * 701: 1, "ab" * 300: 2}
    rows = [(w,) for w, n in words.items() for _ in range(n)]
    want = plain_merges(list(words.items()), 120)
    assert bpe.train(spark.createDataFrame(rows, "text string").repartition(3), 259 + 120)[1] == want
    assert bpe.train(spark.createDataFrame([("ab",), (None,), ("",)], "text string"), 259 + 120)[1] == [("a", "b")]
    assert bpe.train(spark.createDataFrame([(None,)], "text string"), 259 + 120)[1] == []


def test_the_driver_holds_no_words(spark):
    import tracemalloc

    docs = spark.range(200_000).selectExpr("concat_ws(' ', translate(cast(id AS string), '0123456789', 'abcdefghij'), 'x') AS text")
    tracemalloc.start()
    bpe.train(docs, 300)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6, peak


def test_the_encoding_query_holds_no_words_on_the_driver(spark, tmp_path):
    import hashlib
    import tracemalloc

    from corpusloom.plans import queries as plans

    spark.range(100_000).selectExpr("concat(translate(cast(id AS string), '0123456789', 'abcdefghij'), ' the') AS text").write.parquet(f"{tmp_path}/documents.parquet")
    texts = ["abc the jihg the", "the the", "é the 12"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    tracemalloc.start()
    got = plans.QUERIES["bpe_encode"](spark, str(tmp_path)).collect()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(map(tuple, got)) == [(i, hashlib.md5(t.encode()).hexdigest(), True) for i, t in enumerate(texts)]
    assert peak < 12e6, peak
