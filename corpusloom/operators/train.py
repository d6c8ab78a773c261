"""Training as a driver loop over distributed gradients.

Executors compute the gradient sums of their part of a batch (Arrow-batched numpy); the driver
adds them, clips, and takes an AdamW step. Only parameter-sized arrays travel: one partial sum a task. Models are small
by design; data is not.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.config import ModelConfig
from corpusloom.operators.lm import Decoder, Params, rms_norm, rotate, softmax


def _norm_back(d: np.ndarray, x: np.ndarray, w: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    r = 1 / np.sqrt((x * x).mean(-1, keepdims=True) + eps)
    dw = (d * x * r).reshape(-1, x.shape[-1]).sum(0)
    dx = d * w
    return r * (dx - x * (r * r) * (dx * x).mean(-1, keepdims=True)), dw


def _outer(d: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Gradient of ``w`` in ``x @ w.T``."""
    return d.reshape(-1, d.shape[-1]).T @ x.reshape(-1, x.shape[-1])


def log_probs(logits: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log-probability of each target."""
    top = logits.max(-1, keepdims=True)
    return np.take_along_axis(logits - top, y[..., None], -1)[..., 0] - np.log(np.exp(logits - top).sum(-1))


def _toward(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Gradient of ``-sum(weight * log_probs)``."""
    d = softmax(logits) * weight[..., None]
    np.put_along_axis(d, y[..., None], np.take_along_axis(d, y[..., None], -1) - weight[..., None], -1)
    return d


@dataclass
class CrossEntropy:
    """Sum of masked cross-entropies; counts scored places."""

    def __call__(self, x, y, mask, logits):
        return float(-(log_probs(logits, y) * mask).sum()), float(mask.sum()), _toward(logits, y, mask)


@dataclass
class Distillation:
    """``(1 - alpha) * cross-entropy + alpha * T**2 * KL(teacher || student)`` of masked places; the teacher is frozen."""

    config: ModelConfig
    params: Params
    alpha: float = 0.5
    temperature: float = 2.0

    def __call__(self, x, y, mask, logits):
        ce, n, d = CrossEntropy()(x, y, mask, logits)
        t = self.temperature
        p, q = softmax(Decoder(self.config, self.params).forward(x)[0] / t), softmax(logits / t)
        kl = float(((p * (np.log(p + 1e-30) - np.log(q + 1e-30))).sum(-1) * mask).sum()) * t * t
        return (1 - self.alpha) * ce + self.alpha * kl, n, (1 - self.alpha) * d + self.alpha * t * (q - p) * mask[..., None]


@dataclass
class Preference:
    """Sum over pairs of ``softplus(-beta * margin)``. The first half of the rows are the chosen ones, the second the
    rejected; the margin is the policy's difference of sequence log-probabilities less the frozen reference's. Counts pairs."""

    config: ModelConfig
    params: Params
    beta: float = 0.1

    def __call__(self, x, y, mask, logits):
        half = len(x) // 2
        total = lambda z: (log_probs(z, y) * mask).sum(-1)
        policy, reference = total(logits), total(Decoder(self.config, self.params).forward(x)[0])
        margin = self.beta * ((policy[:half] - policy[half:]) - (reference[:half] - reference[half:]))
        loss = np.maximum(-margin, 0) + np.log1p(np.exp(-np.abs(margin)))
        push = self.beta / (1 + np.exp(np.clip(margin, -60, 60)))
        weight = np.concatenate([push, -push])[:, None] * mask
        return float(loss.sum()), float(half), _toward(logits, y, weight)


def _dropout(rate: float, rng: np.random.Generator | None):
    """``keep(shape)``: factors that drop with this rate and scale up what stays; 1 without a rate or a generator."""
    if not rate or rng is None:
        return lambda shape: np.float32(1)
    return lambda shape: (rng.random(shape) >= rate).astype(np.float32) / np.float32(1 - rate)


def loss_and_gradient(model: Decoder, x: np.ndarray, y: np.ndarray, mask: np.ndarray, objective=None, rng: np.random.Generator | None = None) -> tuple[float, float, Params]:
    """An objective's sum and count, and the gradient of the sum; cross-entropy if none is named.

    With ``rng``, the configuration's dropout applies to embeddings, attention weights and both branches of a block.
    """
    c, p = model.config, model.params
    b, n = x.shape
    cos, sin, keep = model.cos[:n], model.sin[:n], _dropout(c.dropout, rng)
    kept_in = keep((b, n, c.dim))
    h, kept = p["embedding"][x] * kept_in, []
    rep, scale = c.n_heads // c.n_kv_heads, 1 / np.sqrt(c.head_dim)
    seen = np.tril(np.ones((n, n), bool))[None, None]
    for i in range(c.n_layers):
        w = lambda name: p[f"layers.{i}.{name}"]  # noqa: B023, E731
        u = rms_norm(h, w("attention_norm"), c.norm_eps)
        heads = lambda name, k: (u @ w(name).T).reshape(b, n, k, c.head_dim)  # noqa: B023, E731
        q, k, v = rotate(heads("wq", c.n_heads), cos, sin), rotate(heads("wk", c.n_kv_heads), cos, sin), heads("wv", c.n_kv_heads)
        qt, kt, vt = (a.transpose(0, 2, 1, 3) for a in (q, np.repeat(k, rep, 2), np.repeat(v, rep, 2)))
        a = softmax(np.where(seen, qt @ kt.transpose(0, 1, 3, 2) * scale, -np.inf))
        ka, ko, kf = keep(a.shape), keep(h.shape), keep(h.shape)
        o = ((a * ka) @ vt).transpose(0, 2, 1, 3).reshape(b, n, -1)
        mid = h + (o @ w("wo").T) * ko
        t = rms_norm(mid, w("ffn_norm"), c.norm_eps)
        g, f = t @ w("w1").T, t @ w("w3").T
        s = 1 / (1 + np.exp(-g))
        kept.append((h, u, qt, kt, vt, a, o, mid, t, g, f, s, ka, ko, kf))
        h = mid + ((g * s * f) @ w("w2").T) * kf
    top = rms_norm(h, p["norm"], c.norm_eps)
    logits = top @ p["embedding"].T
    loss, scored, d = (objective or CrossEntropy())(x, y, mask.astype(logits.dtype), logits)
    grad = {"embedding": _outer(d, top)}
    dh, grad["norm"] = _norm_back(d @ p["embedding"], h, p["norm"], c.norm_eps)
    fold = lambda z: z.transpose(0, 2, 1, 3).reshape(b, n, c.n_kv_heads, rep, c.head_dim).sum(3)
    for i in reversed(range(c.n_layers)):
        w = lambda name: p[f"layers.{i}.{name}"]  # noqa: B023, E731
        h0, u, qt, kt, vt, a, o, mid, t, g, f, s, ka, ko, kf = kept[i]
        dy = dh * kf
        dz = dy @ w("w2")
        dg, df = dz * f * s * (1 + g * (1 - s)), dz * g * s
        out = {"w2": _outer(dy, g * s * f), "w1": _outer(dg, t), "w3": _outer(df, t)}
        back, out["ffn_norm"] = _norm_back(dg @ w("w1") + df @ w("w3"), mid, w("ffn_norm"), c.norm_eps)
        dmid = dh + back
        dout = dmid * ko
        out["wo"] = _outer(dout, o)
        do = (dout @ w("wo")).reshape(b, n, c.n_heads, c.head_dim).transpose(0, 2, 1, 3)
        da = (do @ vt.transpose(0, 1, 3, 2)) * ka
        ds = a * (da - (da * a).sum(-1, keepdims=True)) * scale
        dq = rotate((ds @ kt).transpose(0, 2, 1, 3), cos, -sin).reshape(b, n, -1)
        dk = rotate(fold(ds.transpose(0, 1, 3, 2) @ qt), cos, -sin).reshape(b, n, -1)
        dv = fold((a * ka).transpose(0, 1, 3, 2) @ do).reshape(b, n, -1)
        out |= {"wq": _outer(dq, u), "wk": _outer(dk, u), "wv": _outer(dv, u)}
        back, out["attention_norm"] = _norm_back(dq @ w("wq") + dk @ w("wk") + dv @ w("wv"), h0, w("attention_norm"), c.norm_eps)
        dh = dmid + back
        grad |= {f"layers.{i}.{k}": v for k, v in out.items()}
    np.add.at(grad["embedding"], x, dh * kept_in)
    return loss, scored, grad


def clip(grad: Params, most: float) -> tuple[Params, float]:
    """Scale all gradients so that their common norm is at most ``most``."""
    norm = float(np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grad.values())))
    factor = min(1.0, most / (norm + 1e-6))
    return {n: g * factor for n, g in grad.items()}, norm


@dataclass
class AdamW:
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8
    decay: float = 0.01
    t: int = 0
    m: Params = field(default_factory=dict)
    v: Params = field(default_factory=dict)

    def step(self, params: Params, grad: Params, lr: float) -> Params:
        self.t += 1
        out = {}
        for n, w in params.items():
            g = grad[n]
            self.m[n] = self.beta1 * self.m.get(n, 0) + (1 - self.beta1) * g
            self.v[n] = self.beta2 * self.v.get(n, 0) + (1 - self.beta2) * g * g
            m, v = self.m[n] / (1 - self.beta1**self.t), self.v[n] / (1 - self.beta2**self.t)
            out[n] = (w * (1 - lr * self.decay) - lr * m / (np.sqrt(v) + self.eps)).astype(w.dtype)
        return out


def batch_gradient(examples: DataFrame, config: ModelConfig, params: Params, objective=None, seed: tuple[int, ...] | None = None) -> tuple[float, float, Params]:
    """:func:`loss_and_gradient` summed over ``examples``: one row of sums a task, not a row a sample.

    Examples are ``x, y, loss_mask``; for :class:`Preference` ``chosen, rejected`` structs of those. With a ``seed`` the
    configuration's dropout applies, drawn anew for every eight examples from the seed and their ids.
    """
    shared = examples.sparkSession.sparkContext.broadcast((config, params, objective))
    pairs = isinstance(objective, Preference)
    columns = [f"{side}.{c}" for side in ("chosen", "rejected") for c in ("x", "y", "loss_mask")] if pairs else ["x", "y", "loss_mask"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        config, params, goal = shared.value
        model, loss, n, total = Decoder(config, params), 0.0, 0.0, None
        for b in batches:
            for at in range(0, b.num_rows, 8):
                part = [np.array(b.column(i).slice(at, 8).to_pylist(), np.int64) for i in range(b.num_columns)]
                x, y, m = [np.concatenate([part[i], part[i + 3]]) for i in range(3)] if pairs else part
                rng = None if seed is None else np.random.default_rng([*seed, int(x.sum()), len(x)])
                one, scored, grad = loss_and_gradient(model, x, y, m, goal, rng)
                loss, n = loss + one, n + scored
                total = grad if total is None else {k: total[k] + g for k, g in grad.items()}
        if total is not None:
            out = io.BytesIO()
            np.savez(out, **total)
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([n]), pa.array([out.getvalue()], pa.binary())], names=["loss", "n", "grad"])

    rows = examples.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(run, "loss double, n double, grad binary")
    loss, n, total = 0.0, 0.0, {k: np.zeros_like(v) for k, v in params.items()}
    for r in rows.toLocalIterator():
        loss, n = loss + r.loss, n + r.n
        with np.load(io.BytesIO(r.grad)) as z:
            total = {k: g + z[k] for k, g in total.items()}
    return loss, n, total


def train(examples: DataFrame, plan: DataFrame, key: str, config: ModelConfig, params: Params, *, learning_rate: float, epochs: int = 1, accumulation: int = 1, grad_clip: float = 1.0, optimizer: AdamW | None = None, objective=None, on_step=None, on_epoch=None, start: tuple[int, int, int] = (0, 0, 0), seed: int = 1337, last_epoch: int | None = None) -> tuple[Params, int, list[tuple]]:
    """Run ``plan(epoch, key, batch_id)`` over ``examples(key, ...)``, as :func:`batch_gradient` takes them, for an objective:
    pretraining and chat tuning :class:`CrossEntropy`, distillation :class:`Distillation`, preferences :class:`Preference`.

    Gradients of a window of ``accumulation`` batches are averaged; a part window at an epoch's end is applied too.
    ``on_step(epoch, step, updates, rate, loss, params)`` is called after each batch, before a part window is applied, and
    ``on_epoch(epoch, updates, loss, params)`` after each epoch. ``start`` is (epoch, step, updates) to go on from; before
    ``last_epoch`` the run ends, with rates that still count on all ``epochs``. Examples lie in
    the order of their batches, so a batch's filter skips the cached blocks of others.
    Returns the parameters, the number of updates, and (epoch, step, updates, rate, loss) rows.
    """
    optimizer = optimizer or AdamW()
    n_batches = {r.epoch: r.n + 1 for r in plan.groupBy("epoch").agg({"batch_id": "max"}).toDF("epoch", "n").collect()}  # a row an epoch
    joined = plan.join(examples, key).repartitionByRange("epoch", "batch_id").sortWithinPartitions("epoch", "batch_id").persist()
    total = max(1, sum(n_batches.get(e, 0) for e in range(epochs)) // accumulation)
    updates, log, pending, waiting = start[2], [], None, 0
    try:
        for epoch in range(start[0], epochs if last_epoch is None else min(epochs, last_epoch)):
            mean = 0.0
            for step in range(start[1] if epoch == start[0] else 0, n_batches.get(epoch, 0)):
                rate = rate_at(max(updates, 1), total, learning_rate)
                drawn = (seed, epoch, step) if config.dropout else None
                loss, n, grad = batch_gradient(joined.where((joined.epoch == epoch) & (joined.batch_id == step)), config, params, objective, drawn)
                share, mean = 1.0 / max(n, 1.0) / accumulation, loss / max(n, 1.0)
                pending = {k: (0 if pending is None else pending[k]) + g * share for k, g in grad.items()}
                waiting += 1
                if waiting == accumulation:
                    params = optimizer.step(params, clip(pending, grad_clip)[0], rate)
                    updates, pending, waiting = updates + 1, None, 0
                if on_step:
                    on_step(epoch, step, updates, rate, mean, params)
                if waiting and step == n_batches[epoch] - 1:
                    params = optimizer.step(params, clip(pending, grad_clip)[0], rate)
                    updates, pending, waiting = updates + 1, None, 0
                log.append((epoch, step, updates, rate, mean))
            if on_epoch:
                on_epoch(epoch, updates, mean, params)
    finally:
        joined.unpersist()
    return params, updates, log


def rate_at(step: int, total: int, lr: float, warmup_ratio: float = 0.1) -> float:
    """:func:`corpusloom.operators.schedule.learning_rate` of one number."""
    if total <= 0:
        return lr
    warm, s = int(total * warmup_ratio), max(1, min(step, total))
    if warm and s <= warm:
        return lr * s / warm
    return float(0.1 * lr + 0.45 * lr * (1 + np.cos(np.pi * (s - warm) / max(1, total - warm))))
