"""Training stages, perplexity and chat from files to results."""

import json

import numpy as np
import pytest

from corpusloom.config import ModelConfig, stage_config
from corpusloom.functions import template, tokens
from corpusloom.operators import chat, evaluate, lm, stages, train
from corpusloom.sources import artifacts

TINY = ModelConfig(dim=16, n_layers=2, n_heads=4, n_kv_heads=2, vocab_size=20, hidden_dim=24, max_seq_len=16)
SMALL = ModelConfig(dim=16, n_layers=1, n_heads=2, n_kv_heads=1, vocab_size=tokens.VOCAB, hidden_dim=24, max_seq_len=96)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    at = tmp_path_factory.mktemp("data")
    rows = {
        "pretrain": [{"text": f"plain text number {i} stands here"} for i in range(7)],
        "sft": [{"conversations": [{"role": "user", "content": f"ask {i}"}, {"role": "assistant", "content": f"answer {i}"}]} for i in range(6)],
        "dpo": [{"prompt": f"ask {i}", "chosen": f"good {i}", "rejected": f"bad {i}"} for i in range(5)],
    }
    for name, lines in rows.items():
        (at / f"{name}.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n")
    return {**{n: f"{at}/{n}.jsonl" for n in rows}, "distill": f"{at}/sft.jsonl"}


def options(files, stage, folder, **more):
    return stage_config(stage, data_path=files[stage], save_dir=str(folder), max_seq_len=96, batch_size=3, **more)


def same(a, b):
    return all(np.allclose(a[n], b[n], atol=1e-6) for n in a)


def test_a_stopped_run_goes_on_to_the_same_end(spark, files, tmp_path):
    whole, log = stages.run_stage(spark, "pretrain", SMALL, options(files, "pretrain", tmp_path / "a", epochs=3, accumulation_steps=2))
    stages.run_stage(spark, "pretrain", SMALL, options(files, "pretrain", tmp_path / "b", epochs=3, accumulation_steps=2), stop_after=1)
    assert not (tmp_path / "b" / "pretrain_final").exists()
    rest, more = stages.run_stage(spark, "pretrain", SMALL, options(files, "pretrain", tmp_path / "b", epochs=3, accumulation_steps=2, resume_from=f"{tmp_path}/b/epoch_1_checkpoint"))
    assert same(whole, rest) and [x[:3] for x in more] == [x[:3] for x in log[3:]] and np.allclose([x[3:] for x in more], [x[3:] for x in log[3:]], atol=1e-6)
    assert artifacts.load_train_state(spark, f"{tmp_path}/b/epoch_3_checkpoint")[:3] == (3, 0, 6)
    final = artifacts.params_dict(artifacts.load_weights(spark, f"{tmp_path}/b/pretrain_final"))
    assert same(final, rest) and artifacts.load_train_state(spark, f"{tmp_path}/b/pretrain_final") == (0, 0, 0, float("inf"))


def test_all_stages_in_a_row(spark, files, tmp_path):
    metrics = f"{tmp_path}/metrics"
    stages.run_stage(spark, "pretrain", SMALL, options(files, "pretrain", tmp_path, save_step=2, log_step=2, use_tracker=True), metrics=metrics)
    assert artifacts.load_train_state(spark, f"{tmp_path}/latest_checkpoint")[:3] == (0, 1, 2)
    assert {(r.step, r.metric) for r in spark.read.parquet(metrics).collect()} == {(s, m) for s in (0, 2) for m in ("loss", "lr", "global_step")}
    sft, _ = stages.run_stage(spark, "sft", SMALL, options(files, "sft", tmp_path), pretrained=f"{tmp_path}/pretrain_final")
    _, log = stages.run_stage(spark, "distill", SMALL, options(files, "distill", tmp_path), pretrained=f"{tmp_path}/pretrain_final", reference=f"{tmp_path}/sft_final")
    assert len(log) == 2 and all(np.isfinite(x[4]) for x in log)
    _, log = stages.run_stage(spark, "dpo", SMALL, options(files, "dpo", tmp_path), pretrained=f"{tmp_path}/sft_final")
    assert log[0][4] == pytest.approx(np.log(2), abs=1e-4)
    assert artifacts.discover_model(spark, str(tmp_path), 3).endswith("dpo_final") and artifacts.discover_model(spark, str(tmp_path), 0).endswith("pretrain_final")
    with pytest.raises(ValueError, match="teacher"):
        stages.run_stage(spark, "distill", SMALL, options(files, "distill", tmp_path))
    with pytest.raises(ValueError, match="tracking"):
        stages.run_stage(spark, "sft", SMALL, options(files, "sft", tmp_path, use_tracker=True))


def test_dropout_has_the_right_slope_and_changes_nothing_without_draws():
    from dataclasses import replace

    model = lm.Decoder(TINY, {k: v.astype(np.float64) for k, v in lm.init_params(TINY, 3).items()})
    dropped = lm.Decoder(replace(model.config, dropout=0.3), model.params)
    rng = np.random.default_rng(1)
    x, y, m = rng.integers(0, 20, (3, 5)), rng.integers(0, 20, (3, 5)), np.ones((3, 5))
    assert train.loss_and_gradient(dropped, x, y, m)[0] == train.loss_and_gradient(model, x, y, m)[0]
    draw = lambda: np.random.default_rng(9)
    loss, _, grad = train.loss_and_gradient(dropped, x, y, m, rng=draw())
    assert loss != train.loss_and_gradient(model, x, y, m)[0]
    for name in model.params:
        at = tuple(rng.integers(0, s) for s in model.params[name].shape)
        old, slope = model.params[name][at], []
        for h in (1e-5, -1e-5):
            model.params[name][at] = old + h
            slope.append(train.loss_and_gradient(dropped, x, y, m, rng=draw())[0])
        model.params[name][at] = old
        assert (slope[0] - slope[1]) / 2e-5 == pytest.approx(grad[name][at], rel=2e-3, abs=2e-5), name


def test_perplexity_from_file_to_report(spark, tmp_path):
    lines = [json.dumps({"text": t}) for t in ("first text", "a second one", "")] + ["{broken", json.dumps({"other": 1}), json.dumps({"text": 7})]
    (tmp_path / "eval.jsonl").write_text("\n".join(lines) + "\n")
    params = lm.init_params(SMALL, 4)
    artifacts.save_checkpoint(spark, f"{tmp_path}/model", params, raw=True)
    got = evaluate.perplexity(spark, f"{tmp_path}/eval.jsonl", f"{tmp_path}/model", SMALL, f"{tmp_path}/out", max_length=64).first()
    model, nll, n, ppl = lm.Decoder(SMALL, params), 0.0, 0, []
    for t in ("first text", "a second one", "", "7"):
        own = model.token_nll(np.array([tokens.encode_text(f"<s>{t}</s>")]))[0]
        nll, n = nll + own.sum(), n + len(own)
        ppl.append(float(np.exp(own.mean())))
    assert got.num_samples == 4 and got.n_tokens == n and got.average_ppl == pytest.approx(np.exp(nll / n), rel=1e-5)
    assert (got["mean"], got["median"], got["p25"], got["std"]) == pytest.approx((np.mean(ppl), np.median(ppl), np.percentile(ppl, 25), np.std(ppl)), rel=1e-5)
    saved = json.loads(spark.read.text(f"{tmp_path}/out/report").first()[0])
    assert saved["num_samples"] == 4 and saved["dataset_path"].endswith("eval.jsonl") and spark.read.parquet(f"{tmp_path}/out/samples").count() == 4


def test_strict_loading():
    shapes = {"a": (2,), "b": (1, 2)}
    a, b = np.zeros(2), np.zeros((1, 2))
    assert set(artifacts.matching({"a": a, "c": a}, shapes)) == {"a"}
    assert set(artifacts.matching({"a": a, "b": b}, shapes, strict=True)) == {"a", "b"}
    for wrong in ({"a": a}, {"a": a, "b": b, "c": a}):
        with pytest.raises(ValueError, match="missing"):
            artifacts.matching(wrong, shapes, strict=True)
    with pytest.raises(ValueError, match="shape"):
        artifacts.matching({"a": b}, shapes)


def test_chat_turn(spark):
    said = [("user", "one"), ("assistant", "two"), ("user", "three"), ("assistant", "four")]
    rows = spark.createDataFrame([(1, said, " hello "), (2, [], "x" * 200), (3, said, "  ")], "conv_id long, messages array<struct<role:string,content:string>>, question string")
    params = lm.init_params(SMALL, 2)
    for mode, turns in ((0, 0), (1, 1), (1, 0)):
        opts = dict(max_new_tokens=12, seed=3)
        got = {r.conv_id: r for r in chat.turn(rows, SMALL, params, mode=mode, history_turns=turns, **opts).collect()}
        assert set(got) == {1, 2}
        kept = said[-2 * turns :] if turns else []
        text = "<s>hello" if mode == 0 else f"<s>system\n{template.SYSTEM}</s>\n" + "".join(f"<s>user\n{c}</s>\n<s>assistant\n" if r == "user" else f"{c}</s>\n" for r, c in [*kept, ("user", "hello")])
        ids = tokens.encode_text(text)
        ids = ids[-tokens.prompt_budget(96, 12) :]
        new = lm.generate(lm.Decoder(SMALL, params), np.array([ids]), rows=[1], **opts)[0]
        back = lambda ids: bytes(sorted(range(256), key=tokens.byte_id)[i - 3] for i in ids if i >= 3).decode("utf-8", "replace")
        assert got[1].response == back(new) and [tuple(m) for m in got[1].messages] == [*kept, ("user", "hello")] + ([("assistant", back(new))] if back(new) else [])
        assert got[1].transcript.startswith("User: three" if turns else "User: hello")
        steps = sorted((r for r in chat.turn(rows, SMALL, params, mode=mode, history_turns=turns, trace=True, **opts).collect() if r.conv_id == 2), key=lambda r: r.step)
        assert steps[-1].response == got[2].response and [s.step for s in steps] == list(range(len(steps)))
        assert all(b.delta == (b.response[len(a.response) :] if b.response.startswith(a.response) else b.response) for a, b in zip(steps, steps[1:]))


def test_prompt_ids_are_encoded_again(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("é" * 10,), ("short",)], "t string").select(tokens.prompt_ids(template.pretrain_prompt(F.col("t")), 9).alias("ids")).collect()
    assert row[0].ids == tokens.encode_text("�" + "é" * 4) and row[1].ids == tokens.encode_text("<s>short")
