"""A small decoder in numpy, scored and run inside Arrow-batched functions.

Pre-norm blocks of grouped-query attention with rotary positions on interleaved pairs and a gated
feed-forward layer; the output head is the embedding. Everything is computed in the precision of the parameters. Logits stay inside a kernel: rows carry a
sum of log-probabilities and a count, never (position, vocabulary) tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.config import ModelConfig

Params = dict[str, np.ndarray]
Cache = list[tuple[np.ndarray, np.ndarray]]


def init_params(config: ModelConfig, seed: int = 1337) -> Params:
    rng = np.random.default_rng(seed)
    return {n: np.ones(s, np.float32) if n.endswith("norm") else rng.normal(0, 0.02 if n == "embedding" else s[-1] ** -0.5, s).astype(np.float32) for n, s in config.shapes().items()}


def rms_norm(x: np.ndarray, weight: np.ndarray, eps: float) -> np.ndarray:
    return weight * (x / np.sqrt((x * x).mean(-1, keepdims=True) + eps))


def rotary_table(dim: int, end: int, theta: float) -> tuple[np.ndarray, np.ndarray]:
    """Cosine and sine by position and pair."""
    angle = np.outer(np.arange(end), theta ** (-np.arange(0, dim, 2) / dim))
    return np.cos(angle), np.sin(angle)


def rotate(x: np.ndarray, cos: np.ndarray, sin: np.ndarray) -> np.ndarray:
    """Turn each pair of neighbouring components; ``x`` is (batch, position, head, component)."""
    c, s = cos[None, :, None, :], sin[None, :, None, :]
    out = np.empty_like(x)
    out[..., 0::2] = x[..., 0::2] * c - x[..., 1::2] * s
    out[..., 1::2] = x[..., 0::2] * s + x[..., 1::2] * c
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def key_mask(mask: np.ndarray | None, batch: int, q_len: int, kv_len: int, cached: bool) -> np.ndarray | None:
    """A mask over all keys. With a cache, one over the new chunk is enough: what is cached can be attended."""
    if mask is None or mask.shape[-1] == kv_len and not (cached and mask.shape[-1] == q_len):
        return mask
    if cached and mask.shape[-1] == q_len:
        return np.concatenate([np.ones((batch, kv_len - q_len), mask.dtype), mask], axis=-1)
    raise ValueError(f"a mask of {mask.shape[-1]} places fits neither {kv_len} keys nor a chunk of {q_len}")


class Decoder:
    def __init__(self, config: ModelConfig, params: Params):
        wanted = config.shapes()
        if missing := [n for n in wanted if n not in params or params[n].shape != wanted[n]]:
            raise ValueError(f"parameters missing or of another shape: {missing[:3]}")
        self.config, self.params = config, params
        self.cos, self.sin = (a.astype(params["norm"].dtype) for a in rotary_table(config.head_dim, config.max_seq_len, config.rope_theta))

    def attention(self, i: int, x: np.ndarray, start: int, past: tuple | None, mask: np.ndarray | None) -> tuple[np.ndarray, tuple]:
        c, p = self.config, self.params
        b, n, _ = x.shape
        heads = lambda w, k: (x @ p[f"layers.{i}.{w}"].T).reshape(b, n, k, c.head_dim)
        cos, sin = self.cos[start : start + n], self.sin[start : start + n]
        q, k, v = rotate(heads("wq", c.n_heads), cos, sin), rotate(heads("wk", c.n_kv_heads), cos, sin), heads("wv", c.n_kv_heads)
        if past is not None:
            k, v = np.concatenate([past[0], k], axis=1), np.concatenate([past[1], v], axis=1)
        kept, m = (k, v), k.shape[1]
        k, v = (np.repeat(a, c.n_heads // c.n_kv_heads, axis=2).transpose(0, 2, 1, 3) for a in (k, v))
        scores = q.transpose(0, 2, 1, 3) @ k.transpose(0, 1, 3, 2) / np.sqrt(c.head_dim)
        seen = np.arange(m)[None, :] <= np.arange(n)[:, None] + (m - n)
        scores = np.where(seen[None, None], scores, -np.inf)
        if (keys := key_mask(mask, b, n, m, past is not None)) is not None:
            scores = np.where(keys[:, None, None, :] == 0, -np.inf, scores)
        with np.errstate(invalid="ignore"):
            out = softmax(scores.astype(x.dtype)) @ v
        return out.transpose(0, 2, 1, 3).reshape(b, n, -1) @ p[f"layers.{i}.wo"].T, kept

    def forward(self, ids: np.ndarray, past: Cache | None = None, start: int = 0, mask: np.ndarray | None = None) -> tuple[np.ndarray, Cache]:
        """Logits of every place, and the keys and values so far."""
        c, p = self.config, self.params
        if start + ids.shape[1] > c.max_seq_len:
            raise ValueError(f"{start + ids.shape[1]} places are more than the {c.max_seq_len} that have a rotation")
        h, kept = p["embedding"][ids], []
        for i in range(c.n_layers):
            a, kv = self.attention(i, rms_norm(h, p[f"layers.{i}.attention_norm"], c.norm_eps), start, past[i] if past else None, mask)
            h = h + a
            x = rms_norm(h, p[f"layers.{i}.ffn_norm"], c.norm_eps)
            gate = x @ p[f"layers.{i}.w1"].T
            h = h + (gate / (1 + np.exp(-gate)) * (x @ p[f"layers.{i}.w3"].T)) @ p[f"layers.{i}.w2"].T
            kept.append(kv)
        return rms_norm(h, p["norm"], c.norm_eps) @ p["embedding"].T, kept

    def token_nll(self, ids: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """Cost of each next token: (batch, places - 1), in double precision."""
        logits = self.forward(ids, mask=mask)[0][:, :-1].astype(np.float64)
        top = logits.max(-1, keepdims=True)
        lse = top[..., 0] + np.log(np.exp(logits - top).sum(-1))
        return lse - np.take_along_axis(logits, ids[:, 1:, None], axis=-1)[..., 0]


def next_token(logits: np.ndarray, seen: np.ndarray, temperature: float, top_p: float | None, penalty: float, uniform: float) -> int:
    """Penalty, temperature, nucleus, then an inverse-CDF draw; temperature 0 or less: the largest logit (ties: the smaller id)."""
    x = logits.astype(np.float64)
    if penalty != 1.0:
        x[np.unique(seen)] /= penalty
    if temperature <= 0:
        return int(x.argmax())
    p = softmax(x / temperature)
    if top_p is not None and top_p < 1.0:
        order = np.lexsort((np.arange(len(p)), -p))
        upto = np.cumsum(p[order])
        p[order[np.concatenate([[False], upto[:-1] > top_p])]] = 0
    upto = np.cumsum(p) / p.sum()
    return int(min(np.searchsorted(upto, uniform), np.flatnonzero(p)[-1]))


def stream(model: Decoder, ids: np.ndarray, *, eos: int = 2, pad: int = 0, max_new_tokens: int = 1024, temperature: float = 0.75, top_p: float | None = 0.9, penalty: float = 1.0, use_cache: bool = True, seed: int = 0, rows: list[int] | None = None, forward=None) -> Iterator[np.ndarray]:
    """After each step the new tokens so far, (batch, steps). A finished row goes on with pads; all finished ends it.

    Draws depend on the seed, the row's number in ``rows`` and the step, so batches do not matter.
    """
    import hashlib

    forward = forward or model.forward
    rows, begun = rows or list(range(len(ids))), ids.shape[1]
    finished, past = np.zeros(len(ids), bool), None
    for step in range(max_new_tokens):
        logits, past = forward(ids, None, 0) if past is None or not use_cache else forward(ids[:, -1:], past, ids.shape[1] - 1)
        new = np.full((len(ids), 1), pad, ids.dtype)
        for i in np.flatnonzero(~finished):
            u = int(hashlib.md5(f"{seed}:{rows[i]}:{step}".encode()).hexdigest()[:12], 16) / float(1 << 48)
            new[i, 0] = next_token(logits[i, -1], ids[i], temperature, top_p, penalty, u)
        ids = np.concatenate([ids, new], axis=1)
        yield ids[:, begun:]
        finished |= new[:, 0] == eos
        if finished.all():
            return


def generate(model: Decoder, ids: np.ndarray, **options) -> np.ndarray:
    """The new tokens; the prompt itself where none may be made."""
    out = ids
    for out in stream(model, ids, **options):  # noqa: B007
        pass
    return out


def score(rows: DataFrame, config: ModelConfig, params: Params, key: str = "doc_id", ids: str = "ids", batch: int = 8) -> DataFrame:
    """``key, nll_sum, n_scored`` of an id column. Rows are scored in batches of like length; padding is masked and changes nothing."""
    shared = rows.sparkSession.sparkContext.broadcast((config, params))  # one model; it has to fit an executor
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Decoder(*shared.value)
        for b in batches:
            texts = [np.array(x or [], np.int64) for x in b.column(1).to_pylist()]
            nll, n = np.zeros(len(texts)), np.array([max(0, len(t) - 1) for t in texts])
            order = [i for i in np.argsort([len(t) for t in texts], kind="stable") if n[i]]
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                x = np.zeros((len(part), max(len(texts[i]) for i in part)), np.int64)
                mask = np.zeros(x.shape, np.int64)
                for r, i in enumerate(part):
                    x[r, : len(texts[i])], mask[r, : len(texts[i])] = texts[i], 1
                nll[part] = np.where(mask[:, 1:] == 1, model.token_nll(x, mask), 0).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nll, pa.float64()), pa.array(n, pa.int64())], names=["k", "nll_sum", "n_scored"])

    return rows.select(F.col(key).alias("k"), F.col(ids).alias("ids")).mapInArrow(run, f"k {kind}, nll_sum double, n_scored long").withColumnRenamed("k", key)


def generate_rows(rows: DataFrame, config: ModelConfig, params: Params, key: str = "doc_id", ids: str = "ids", trace: bool = False, **options) -> DataFrame:
    """``key, step, ids``: the new tokens of each prompt after its last step, or with ``trace`` after every step."""
    shared = rows.sparkSession.sparkContext.broadcast((config, params))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Decoder(*shared.value)
        for b in batches:
            out = []
            for k, prompt in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                steps = [(k, s, x[0].tolist()) for s, x in enumerate(stream(model, np.array([prompt], np.int64), rows=[k], **options))] if prompt else []
                out += steps if trace else steps[-1:]
            cols = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.int32()))], names=["k", "step", "ids"])

    return rows.select(F.col(key).alias("k"), F.col(ids).alias("ids")).mapInArrow(run, f"k {kind}, step int, ids array<int>").withColumnRenamed("k", key)
