import math
import random
import re

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusloom.functions import decode, losses, template, tokens
from corpusloom.operators import evaluate, examples, schedule, train
from corpusloom.sources import jsonl


def column(spark, rows, schema, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*exprs).collect()]


def mask_by_regex(ids, bos, eos, n, pad):
    """The mask's rules as a pattern over characters."""
    text = "".join(chr(0x4E00 + i) for i in ids)
    mark = lambda m: re.escape("".join(chr(0x4E00 + i) for i in m))
    out = [0] * len(ids)
    for m in re.finditer(f"{mark(bos)}(.*?(?:{mark(eos)}|\\Z))", text, re.S):
        for i in range(m.start(1), min(m.end(1), n)):
            out[i] = int(ids[i] != pad)
    return out


def test_mask_vectors(spark):
    rows = [([9, 9, 3, 4, 5, 8, 8, 0, 0, 0],), ([9, 9, 101, 102, 103, 104, 105, 0, 0, 0],), ([],)]
    got = column(spark, rows, "ids array<int>", tokens.assistant_mask(F.col("ids"), [9, 9], [8, 8], 10))
    assert [g[0] for g in got] == [[0, 0, 1, 1, 1, 1, 1, 0, 0, 0]] * 2 + [[]]


def test_mask_at_random(spark):
    rng = random.Random(11)
    rows = [([rng.choice([0, 1, 1, 2, 2, 3, 4]) for _ in range(rng.randrange(0, 24))],) for _ in range(500)]
    for n in (24, 9):
        got = column(spark, rows, "ids array<int>", tokens.assistant_mask(F.col("ids"), [1, 3], [2, 4], n))
        assert [g[0] for g in got] == [mask_by_regex(r[0], [1, 3], [2, 4], n, 0) for r in rows]


def test_byte_ids_and_back(spark):
    texts = ["<s>assistant\nhé海 1</s>\n", "", "a<unk>b<s", "".join(map(chr, range(1, 300))), "🙂</s></s>"]
    rows = [(t,) for t in texts]
    got = column(spark, rows, "t string", tokens.byte_ids(F.col("t")), tokens.byte_text(tokens.byte_ids(F.col("t"))), tokens.byte_text(tokens.byte_ids(F.col("t")), False))
    assert [g[0] for g in got] == [tokens.encode_text(t) for t in texts]
    assert [g[1] for g in got] == [re.sub("<unk>|<s>|</s>", "", t) for t in texts]
    assert [g[2] for g in got] == texts
    assert tokens.byte_id(10) == 201 and tokens.byte_id(32) == 223 and sorted(map(tokens.byte_id, range(256))) == list(range(3, 259))
    cut = column(spark, rows, "t string", examples.byte_tokens(F.col("t"), 5))
    assert [c[0] for c in cut] == [tokens.encode_text(t)[:5] for t in texts]


def test_arrays(spark):
    rows = [([5, 6, 7],)]
    got = column(spark, rows, "x array<int>", tokens.pad_to(F.col("x"), 5), tokens.tail(F.col("x"), 2), tokens.truncate(F.col("x"), 2), tokens.attention_mask(F.lit(3), 5), tokens.attention_mask(F.lit(0), F.lit(0)))[0]
    assert got == ([5, 6, 7, 0, 0], [6, 7], [5, 6], [1, 1, 1, 0, 0], [])
    e = spark.createDataFrame(rows, "x array<int>").select(examples.pretrain_example(F.col("x"), 5).alias("e")).first().e
    assert (e.x, e.y, e.loss_mask) == ([5, 6, 7, 0], [6, 7, 0, 0], [1, 1, 0, 0])
    assert tokens.prompt_budget(2048, 512) == 1536 and tokens.prompt_budget(16, 512) == 8


def rendered(spark, msgs, **k):
    df = spark.createDataFrame([(msgs,)], "m array<struct<role:string,content:string>>")
    return df.select(template.render_chat(F.col("m"), **k)).first()[0]


def test_template(spark):
    assert rendered(spark, [("user", "a"), ("assistant", "b")], system="S") == "<s>system\nS</s>\n<s>user\na</s>\n<s>assistant\nb</s>\n"
    assert rendered(spark, [("system", "X"), ("user", "a"), ("system", "no"), ("tool", "no")]) == "<s>system\nX</s>\n<s>user\na</s>\n<s>assistant\n"
    with pytest.raises(PySparkException):
        rendered(spark, [])
    df = spark.createDataFrame([([("system", "x"), ("user", "y"), ("assistant", "z")],)], "m array<struct<role:string,content:string>>")
    assert [m.role for m in df.select(template.parity_roles(F.col("m"))).first()[0]] == ["user", "assistant", "user"]
    assert [[m.content for m in df.select(template.history_window(F.col("m"), n)).first()[0]] for n in (0, 1, 9)] == [[], ["y", "z"], ["x", "y", "z"]]
    assert df.select(template.wrap_text(F.lit("hello world"))).first()[0] == "<s>hello world</s>"
    row = spark.range(1).select(*[template.prefix_delta(F.lit(a), F.lit(b)) for a, b in (("abc", "ab"), ("abc", "x"), ("abc", None))]).first()
    assert tuple(row) == ("c", "abc", "abc")
    assert "\033[1m" in df.select(template.transcript(F.col("m"), {"user": "\033[1m"})).first()[0]


def test_losses_against_numpy(spark):
    rng = np.random.default_rng(3)
    s, t, y, m = rng.normal(size=(12, 9)), rng.normal(size=(12, 9)), rng.integers(0, 9, 12), rng.integers(0, 2, 12)
    logp = lambda x: x - np.log(np.exp(x).sum(-1, keepdims=True))
    df = spark.createDataFrame([(a.tolist(), b.tolist(), int(c), int(d)) for a, b, c, d in zip(s, t, y, m, strict=True)], "s array<double>, t array<double>, y int, m int")
    ce = -logp(s)[np.arange(12), y]
    got = df.agg(losses.masked_mean(losses.cross_entropy(F.col("s"), F.col("y")), F.col("m")), losses.masked_mean(F.lit(1.0), F.lit(0))).first()
    assert got[0] == pytest.approx((ce * m).sum() / m.sum()) and got[1] == 0
    for temperature in (2.0, 4.0):
        p, q = logp(t / temperature), logp(s / temperature)
        kd = (np.exp(p) * (p - q)).sum(-1).mean() * temperature**2
        assert df.agg(F.avg(losses.kd_divergence(F.col("s"), F.col("t"), temperature))).first()[0] == pytest.approx(kd)
    loss = lambda *x: spark.range(1).select(losses.dpo(*map(F.lit, map(float, x)), 0.1)).first()[0]
    assert loss(-1, -5, -2, -2) < loss(-4, -1, -2, -2) and math.isfinite(loss(-1e5, 1e5, 0, 0))
    assert loss(0, 0, 0, 0) == pytest.approx(math.log(2))
    blend = spark.range(1).select(losses.kd_blend(F.lit(2.0), F.lit(5.0), 0.0), losses.kd_blend(F.lit(2.0), F.lit(5.0), 1.0)).first()
    assert tuple(blend) == (2.0, 5.0)


def test_decoding(spark):
    df = spark.createDataFrame([(1, [2.0, -1.0, 2.0, 0.5])], "s long, z array<double>")
    long = decode.long_logits(df, "s", "z")
    assert decode.greedy(long, "s").first().token_id == 0  # ties: the smaller id
    seen = spark.createDataFrame([(1, 1), (1, 1), (1, 0)], "s long, token_id int")
    assert {r.token_id: r.logit for r in decode.repetition_penalty(long, seen, "s", 2.0).collect()} == {0: 1.0, 1: -0.5, 2: 2.0, 3: 0.5}
    assert df.select(decode.penalised(F.col("z"), F.array(F.lit(0), F.lit(1)), 2.0)).first()[0] == [1.0, -0.5, 2.0, 0.5]
    probs = decode.probabilities(long, "s", 0.5)
    p = np.exp(np.array([2.0, -1.0, 2.0, 0.5]) / 0.5)
    assert np.allclose([r.prob for r in probs.orderBy("token_id").collect()], p / p.sum())
    kept = lambda top: sorted(r.token_id for r in decode.nucleus(probs, "s", top).collect())
    assert kept(0.0) == [0] and kept(0.6) == [0, 2] and kept(None) == kept(1.0) == [0, 1, 2, 3]
    many = spark.range(3000).select(F.col("id").alias("s"), F.explode(F.array(F.lit(0), F.lit(1))).alias("token_id")).withColumn("prob", F.when(F.col("token_id") == 0, 0.25).otherwise(0.75))
    share = decode.sample(many, "s", 5).agg(F.avg("token_id")).first()[0]
    assert 0.72 < share < 0.78 and decode.sample(many, "s", 5).agg(F.avg("token_id")).first()[0] == share
    trace = spark.createDataFrame([(0, 0, 2), (0, 1, 7), (0, 2, 2), (1, 0, 5), (1, 1, 5), (1, 2, 5)], "s long, step int, token int")
    out = decode.eos_padded(trace, "s", "step", "token", 2, 0).orderBy("s", "step").collect()
    assert [r.token for r in out] == [2, 0, 0, 5, 5, 5] and decode.stop_step(trace, "s", "step", "token", 2).first()[0] == 2


def test_learning_rate(spark):
    lr = lambda step, total=100: spark.range(1).select(schedule.learning_rate(F.lit(step), total, 1e-3)).first()[0]
    golden = {1: 1e-4, 10: 1e-3, 11: 0.000999726, 50: 0.000628142, 55: 0.00055, 100: 1e-4}
    for step, value in golden.items():
        assert lr(step) == pytest.approx(value, abs=1e-9) == train.rate_at(step, 100, 1e-3)
    assert lr(0) == lr(1) and lr(1000) == lr(100) and lr(5, 0) == 1e-3


def test_schedule(spark):
    assert schedule.total_steps(3, 100, 8, 4) == 9 and schedule.total_steps(1, 1, 8, 4) == 1
    plan = schedule.batch_plan(spark.range(1000).withColumnRenamed("id", "doc_id"), "doc_id", 64, 1, 2).collect()
    for e in (0, 1):
        ranks = sorted(r["rank"] for r in plan if r.epoch == e)
        assert ranks == list(range(1000)) and max(r.batch_id for r in plan) == 15
    assert [r.doc_id for r in sorted(plan, key=lambda r: (r.epoch, r["rank"]))][:1000] != list(range(1000))


def test_perplexity(spark):
    rows = [("a", 1.0, 1), ("a", 3.0, 1), ("b", 5.0, 0), ("c", 2.0, 1)]
    samples = evaluate.sample_ppl(spark.createDataFrame(rows, "s string, nll double, m int"), "s", mask="m")
    got = evaluate.report(samples).first()
    assert got.num_samples == 3 and got.n_tokens == 3 and got.average_ppl == pytest.approx(math.exp(2))
    assert got.mean == pytest.approx(math.exp(2)) and got.std == pytest.approx(0)
    none = evaluate.corpus_ppl(samples.where("s = 'b'")).first()
    assert none.average_ppl == float("inf") and none.num_samples == 1
    values = [1.0, 2.0, 4.0, 9.0, 20.0, 3.5]
    d = evaluate.distribution(spark.createDataFrame([(v,) for v in values], "ppl double")).first()
    assert (d.mean, d.median, d.std, d.p25, d.p75) == pytest.approx((np.mean(values), np.median(values), np.std(values), np.percentile(values, 25), np.percentile(values, 75)))


def test_strict_and_lenient_lines(spark, tmp_path):
    good = ['{"text": "a"}', '{"text": null}', '{"text": true}', '{"text": 5.0}', '{"text": 7}', ' {"text": "é", "x": 1} ']
    (tmp_path / "good.jsonl").write_text("\n".join(good) + "\n", encoding="utf-8")
    assert [r.text for r in jsonl.read_pretrain(spark, f"{tmp_path}/good.jsonl").orderBy("line_no").collect()] == ["a", "None", "True", "5.0", "7", "é"]
    assert sorted(jsonl.iterate_texts(spark, f"{tmp_path}/good.jsonl")) == sorted(["a", "None", "True", "5.0", "7", "é"])
    bad = ['{"text": "a"}', "", "{bad", '{"other": 1}', "[1]", "5", '{"text": "b"}\r']
    (tmp_path / "bad.jsonl").write_text("\n".join(bad) + "\n")
    ok, rejected = jsonl.read_lenient(spark, f"{tmp_path}/bad.jsonl")
    assert [(r.line_no, r.text) for r in ok.orderBy("line_no").collect()] == [(0, "a"), (6, "b")]
    assert {r.line_no: r.reason for r in rejected.collect()} == {1: "malformed", 2: "malformed", 3: "missing", 4: "no_object", 5: "no_object"}
    assert jsonl.read_lenient(spark, f"{tmp_path}/bad.jsonl", max_samples=2)[0].count() == 1 and jsonl.read_lenient(spark, f"{tmp_path}/bad.jsonl", max_samples=0)[0].count() == 2
    for lines in (bad[:2], bad[2:3], bad[3:4]):
        (tmp_path / "one.jsonl").write_text("\n".join([*lines, '{"text": "z"}']) + "\n")
        with pytest.raises(PySparkException):
            jsonl.read_pretrain(spark, f"{tmp_path}/one.jsonl").collect()


def test_conversation_and_preference_lines(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"conversations": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}\n')
    assert [m.content for m in jsonl.read_conversations(spark, f"{tmp_path}/c.jsonl").first().messages] == ["q", "a"]
    (tmp_path / "p.jsonl").write_text('{"prompt": "p", "chosen": "c", "rejected": "r"}\n')
    r = jsonl.read_preferences(spark, f"{tmp_path}/p.jsonl").first()
    assert (r.prompt, r.chosen, r.rejected) == ("p", "c", "r")
    made = examples.preference_examples(spark.createDataFrame([("p", "c", "rr")], "prompt string, chosen string, rejected string"), 256).first()
    assert sum(made.chosen_mask) == 1 + 2 and sum(made.rejected_mask) == 2 + 2
    (tmp_path / "p.jsonl").write_text('{"prompt": "p", "chosen": "c"}\n')
    with pytest.raises(PySparkException):
        jsonl.read_preferences(spark, f"{tmp_path}/p.jsonl").collect()


def test_prompts_stop_at_a_quit_word(spark):
    rows = [(0, " a "), (1, ""), (2, "b"), (3, "EXIT"), (4, "c")]
    assert [r.text for r in jsonl.prompts(spark.createDataFrame(rows, "line_no long, value string")).orderBy("line_no").collect()] == ["a", "b"]


def test_quantiles_are_exact(spark):
    import numpy as np

    from corpusloom.operators import evaluate

    rng = np.random.default_rng(3)
    for values in ([5.0], [1.0, 2.0], [-3.0, 0.0, 0.0, 9.0], list(rng.lognormal(2, 1, 501)), [7.5] * 40 + [1e300, -1e300]):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "ppl double").repartition(3)
        found = {r.q: r.x for r in evaluate.quantiles(df, "ppl", (0.0, 0.25, 0.5, 0.9, 1.0)).collect()}
        for q, x in found.items():
            assert x == pytest.approx(np.quantile(values, q), rel=1e-12), (len(values), q)
        assert len(found) == 5
    assert evaluate.distribution(spark.createDataFrame([], "ppl double")).first()["median"] is None


def test_lines_are_numbered_in_place_over_files_and_splits(spark, tmp_path):
    from corpusloom.sources import jsonl

    lines = [f"line {i} " + "x" * (i % 50) for i in range(3000)]
    for i in range(3):
        (tmp_path / f"part{i}.txt").write_text("\n".join(lines[i * 1000 : (i + 1) * 1000]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = jsonl.read_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 3
        assert [(r.line_no, r.value) for r in rows.orderBy("line_no").collect()] == list(enumerate(lines))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
