"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

Subwords are the one to three letter grams of the lower-cased text; whatever is no letter counts as a
space. The model is trained by stochastic gradient descent in numpy on a bounded sample
(``SAMPLE_ROWS``) of labelled rows. For prediction the embeddings and the softmax weights are
multiplied out, so a text costs one table lookup a gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusloom.llm._common import staged

BUCKETS = 1 << 16
DIM = 16
#: Most labelled rows that training uses, in equal parts by language as far as there are.
SAMPLE_ROWS = 3_000
#: Bytes of text from which no further row is taken.
SAMPLE_BYTES = 64 << 20
#: Share of right calibration predictions that rejection may cost, and the calibrated probability from which none is rejected.
REJECT_SHARE = 0.001
REJECT_BELOW = 0.5
UNKNOWN = "und"
#: Characters that are scored at once.
BLOCK = 1 << 20

_alpha: np.ndarray | None = None


def alpha() -> np.ndarray:
    global _alpha
    if _alpha is None:
        _alpha = np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool)
    return _alpha


def code_points(lowered: str) -> np.ndarray:
    """Letters as code points, all else as spaces."""
    cps = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(alpha()[cps], cps, np.uint32(32))


def gram_buckets(cps: np.ndarray) -> list[np.ndarray]:
    """Bucket of the gram of each length 1 to 3 that begins at each place; 0 for grams without a letter."""
    out, key = [], cps.astype(np.uint64)
    letters = cps != 32
    seen = letters
    for n in range(1, 4):
        if n > 1:
            key = key[:-1] * np.uint64(0x110000 + 1) + cps[n - 1 :]
            seen = seen[:-1] | letters[n - 1 :]
        mixed = (key + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        out.append(np.where(seen, 1 + (mixed >> np.uint64(40)).astype(np.int64) % (BUCKETS - 1), 0))
    return out


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages: embeddings times weights; row 0 is zero
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean gram score by language for each text, and which texts have a letter."""
        sums, grams = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for i, text in enumerate(texts):
            if not text:
                continue
            padded = f" {text.lower()} "
            for at in range(0, len(padded), BLOCK):  # blocks only bound memory: each gram counts in the block it begins in
                for buckets in gram_buckets(code_points(padded[at : at + BLOCK + 2])):
                    buckets = buckets[:BLOCK]
                    grams[i] += np.count_nonzero(buckets)
                    sums[i] += self.table[buckets].sum(axis=0, dtype=np.float64)
        return sums / np.maximum(grams, 1)[:, None] + self.bias, grams > 0

    def batched(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`logits` over many short texts at once."""
        out, has, at = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), dtype=bool), 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") < BLOCK):
                size += len(texts[end] or "")
                end += 1
            if end == at + 1:
                out[at:end], has[at:end] = self.logits(texts[at:end])
            else:
                rows = [f" {(t or '').lower()} " for t in texts[at:end]]
                ends = np.cumsum([len(r) for r in rows])
                starts, sums, grams = np.concatenate([[0], ends[:-1]]), 0.0, 0.0
                for n, buckets in enumerate(gram_buckets(np.append(code_points("".join(rows)), [np.uint32(32)] * 2)), 1):
                    buckets = buckets[: ends[-1]]
                    for over in range(1, n):  # grams that reach into the next text
                        buckets[ends - over] = 0
                    sums = sums + np.add.reduceat(self.table[buckets], starts, axis=0, dtype=np.float64)
                    grams = grams + np.add.reduceat((buckets != 0).astype(np.int64), starts)
                out[at:end], has[at:end] = sums / np.maximum(grams, 1)[:, None] + self.bias, grams > 0
            at = end
        return out, has

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated probability and rejection of each text."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        logits, has = self.batched(texts)
        p = softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        score = np.where(has, p[np.arange(len(texts)), best], 0.0)
        return [self.langs[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], score, ~has | (score < self.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], labels: list[str], epochs: int = 6, rate: float = 0.5, seed: int = 0) -> Model:
    """Fit on four fifths of the rows, each as a whole text and as windows of 20 to 300 characters, so
    that short texts are known; choose the temperature and the rejection threshold on the last fifth."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    rows = [(t, langs.index(y)) for t, y in zip(texts, labels, strict=True) if any(c.isalpha() for c in t)]
    order = rng.permutation(len(rows))
    fit, held = order[: len(rows) - len(rows) // 5], order[len(rows) - len(rows) // 5 :]

    def windows(text: str) -> list[str]:
        out = [text]
        for _ in range(3):
            n = int(rng.integers(20, 300))
            at = int(rng.integers(0, max(1, len(text) - n)))
            out.append(text[at : at + n])
        return out

    samples = []
    for i in fit:
        for w in windows(rows[i][0]):
            ids, n = np.unique(np.concatenate(gram_buckets(code_points(f" {w.lower()} "))), return_counts=True)
            ids, n = ids[ids > 0], n[ids > 0]
            if len(ids):
                samples.append((ids, (n / n.sum()).astype(np.float32), rows[i][1]))
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    emb[0] = 0
    weights, bias = np.zeros((DIM, len(langs)), dtype=np.float32), np.zeros(len(langs), dtype=np.float32)
    steps, step = epochs * max(1, len(samples)), 0
    for _ in range(epochs):
        for s in rng.permutation(len(samples)):
            ids, n, y = samples[s]
            lr, step = rate * (1 - step / steps), step + 1
            hidden = n @ emb[ids]
            err = softmax(hidden @ weights + bias)
            err[y] -= 1
            back = weights @ err
            weights -= lr * np.outer(hidden, err)
            bias -= lr * err
            emb[ids] -= (lr * len(ids) ** 0.5) * np.outer(n, back)
    model = Model(langs, emb @ weights, bias.astype(np.float64))
    if len(held):
        cut = [w for i in held for w in windows(rows[i][0])[:2]]
        y = np.repeat([rows[i][1] for i in held], 2)
        logits, _ = model.batched(cut)
        losses = {t: -np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in np.geomspace(0.1, 20, 60)}
        model.temperature = float(min(losses, key=losses.get))
        p = softmax(logits / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == y]
        model.threshold = min(REJECT_BELOW, float(np.quantile(right, REJECT_SHARE))) if len(right) else 0.0
    return model


def fit_language_model(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> Model:
    """Train on at most ``rows`` rows and about ``SAMPLE_BYTES`` of ``labelled``, chosen by a hash of key and text, about as many of each
    language, however many there are. Null languages and null texts are left out; no labelled row gives a model that rejects all."""
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"), F.xxhash64(F.lit("sample"), F.col(key), F.length(text)).alias("h"))
    sizes = staged(known.groupBy("l").agg(F.count("*").alias("n")))
    n_langs = sizes.count()
    if not n_langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    share = F.least(F.lit(1.0), F.lit(rows / n_langs) / F.col("n"))
    drawn = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    # the share keeps each draw near its part of ``rows``; the ordered limit makes the bound strict
    sample = known.join(sizes, "l").withColumn("d", drawn / share).where("d < 1").orderBy("d", "l", "t").limit(rows)
    upto = F.sum(F.octet_length("t").cast("long")).over(Window.orderBy("d", "l", "t").rowsBetween(Window.unboundedPreceding, -1))  # over at most ``rows`` rows
    got = sample.withColumn("upto", F.coalesce(upto, F.lit(0))).where(F.col("upto") < SAMPLE_BYTES).select("t", "l").collect()
    return train([r.t for r in got], [r.l for r in got])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``row, lang_pred, score, rejected``: each row of ``docs`` as a struct, so that no name can clash, with its
    language, calibrated probability (0 to 1) and whether it is rejected. Rows stay where they are.

    Texts that are null or have no letter are ``und`` with score 0, rejected; so is every row if the model knows no language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats

    # the text goes beside the other columns, not twice
    rest = [f for f in docs.schema.fields if f.name != text]
    kept = F.struct(*[F.col(f"`{f.name}`") for f in rest]) if rest else F.struct(F.lit(True).alias("none"))
    shaped = docs.select(kept.alias("row"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for at in range(0, max(1, b.num_rows), 512):
                part = b.slice(at, 512)
                langs, score, rejected = m.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["row", "t", "lang_pred", "score", "rejected"])

    schema = T.StructType([*shaped.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    out = shaped.mapInArrow(run, schema)
    return out.select(F.struct(*[F.col("t").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns]).alias("row"), "lang_pred", "score", "rejected")
