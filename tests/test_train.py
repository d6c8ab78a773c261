import numpy as np
import pytest

from corpusloom.config import STAGES, ModelConfig, precision, stage_config, str2bool
from corpusloom.operators import lm, schedule, train
from corpusloom.sources import artifacts

TINY = ModelConfig(dim=16, n_layers=2, n_heads=4, n_kv_heads=2, vocab_size=20, hidden_dim=24, max_seq_len=16)


def in_doubles(seed):
    model = lm.Decoder(TINY, {k: v.astype(np.float64) for k, v in lm.init_params(TINY, seed).items()})
    model.cos, model.sin = model.cos.astype(np.float64), model.sin.astype(np.float64)
    return model


@pytest.mark.parametrize("objective", [None, train.Distillation(TINY, in_doubles(5).params, 0.3, 2.0), train.Preference(TINY, in_doubles(6).params, 0.5)])
def test_gradient_is_the_slope(objective):
    rng = np.random.default_rng(0)
    model = in_doubles(1)
    params = model.params
    x, y, m = rng.integers(0, 20, (4, 6)), rng.integers(0, 20, (4, 6)), rng.integers(0, 2, (4, 6))
    loss, n, grad = train.loss_and_gradient(model, x, y, m, objective)
    assert n == (2 if isinstance(objective, train.Preference) else m.sum())
    for name in params:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in params[name].shape)
            old, slope = params[name][at], []
            for h in (1e-5, -1e-5):
                params[name][at] = old + h
                slope.append(train.loss_and_gradient(model, x, y, m, objective)[0])
            params[name][at] = old
            assert (slope[0] - slope[1]) / 2e-5 == pytest.approx(grad[name][at], rel=2e-3, abs=2e-5), name


def test_preferences_are_learned(spark):
    rng = np.random.default_rng(2)
    side = lambda: (rng.integers(0, 20, 6).tolist(), rng.integers(0, 20, 6).tolist(), [0, 0, 1, 1, 1, 1])
    schema = "struct<x:array<int>,y:array<int>,loss_mask:array<int>>"
    ex = spark.createDataFrame([(i, side(), side()) for i in range(6)], f"doc_id long, chosen {schema}, rejected {schema}")
    params = lm.init_params(TINY)
    goal = train.Preference(TINY, params, 0.5)
    first = train.batch_gradient(ex, TINY, params, goal)
    assert first[0] / first[1] == pytest.approx(np.log(2), abs=1e-4)
    out, updates, log = train.train(ex, schedule.batch_plan(ex, "doc_id", 6, 1, 4), "doc_id", TINY, params, learning_rate=0.02, epochs=4, objective=goal)
    assert updates == 4 and log[-1][4] < log[0][4]


def test_clip_and_adamw():
    grad, norm = train.clip({"a": np.array([3.0, 4.0])}, 1.0)
    assert norm == pytest.approx(5) and np.linalg.norm(grad["a"]) == pytest.approx(1, abs=1e-5)
    small, _ = train.clip({"a": np.array([0.3, 0.4])}, 1.0)
    assert small["a"].tolist() == [0.3, 0.4]
    out = train.AdamW(decay=0.0).step({"a": np.array([1.0, 1.0])}, {"a": np.array([0.5, -2.0])}, 0.1)
    assert np.allclose(out["a"], [0.9, 1.1], atol=1e-4)


def test_training_lowers_the_loss_and_resumes(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(12):
        ids = [(int(s) + j) % 20 for s in [rng.integers(0, 20)] for j in range(9)]
        rows.append((i, ids[:-1], ids[1:], [1] * 8))
    ex = spark.createDataFrame(rows, "doc_id long, x array<int>, y array<int>, loss_mask array<int>")
    plan = schedule.batch_plan(ex, "doc_id", 5, 7, 4)
    params = lm.init_params(TINY)
    seen = []
    out, updates, log = train.train(ex, plan, "doc_id", TINY, params, learning_rate=0.02, epochs=4, accumulation=2, on_step=lambda *a: seen.append(a))
    planned = schedule.accumulation(schedule.steps(spark, 4, 3), 3, 2).orderBy("epoch", "step").collect()
    assert [(r.epoch, r.step, r.global_step) for r in planned] == [(e, s, g) for e, s, g, *_ in log]
    assert updates == 8 and np.mean([x[4] for x in log[-3:]]) < np.mean([x[4] for x in log[:3]])
    artifacts.save_checkpoint(spark, f"{tmp_path}/ck", out, epoch=1, step=2, global_step=3, loss=0.5, config=vars(TINY) | {})
    assert artifacts.load_train_state(spark, f"{tmp_path}/ck") == (1, 2, 3, 0.5)
    back = artifacts.params_dict(artifacts.load_weights(spark, f"{tmp_path}/ck"))
    assert all(np.array_equal(back[k], out[k]) for k in out)
    _, updates, more = train.train(ex, plan, "doc_id", TINY, back, learning_rate=0.02, epochs=4, accumulation=2, start=(3, 1, 6))
    assert [(e, s) for e, s, *_ in more] == [(3, 1), (3, 2)]


def test_raw_weights_masks_and_discovery(spark, tmp_path):
    params = {"a": np.ones((2, 3), np.float32), "a_mask": np.ones(2, np.float32)}
    artifacts.save_checkpoint(spark, f"{tmp_path}/m/sft_final", params, raw=True)
    found = artifacts.discover_model(spark, f"{tmp_path}/m", 1)
    assert found.endswith("sft_final")
    weights = artifacts.load_weights(spark, found)
    assert list(artifacts.params_dict(weights)) == ["a"]
    assert artifacts.parameter_count(weights).first()[0] == 6 and artifacts.parameter_count(artifacts.freeze(weights)).first()[0] == 0
    assert artifacts.load_train_state(spark, found) == (0, 0, 0, float("inf"))
    with pytest.raises(FileNotFoundError):
        artifacts.discover_model(spark, f"{tmp_path}/m", 0)
    with pytest.raises(ValueError):
        artifacts.load_weights(spark, f"{tmp_path}/nothing")


def test_options():
    assert [str2bool(x) for x in ("Yes", "0", None, True, " t ")] == [True, False, False, True, True]
    with pytest.raises(ValueError):
        str2bool("maybe")
    assert {s: stage_config(s).batch_size for s in STAGES} == {"pretrain": 8, "sft": 8, "distill": 4, "dpo": 2}
    assert stage_config("dpo", use_tracker="y").use_tracker and stage_config("pretrain").learning_rate == 5e-4
    with pytest.raises(ValueError):
        stage_config("sft", nothing=1)
    assert precision("cpu", "float16") == {"autocast": False, "scaler": False}
    assert precision("cuda", "bfloat16") == {"autocast": True, "scaler": False} and precision("cuda:0", "float16")["scaler"]
