"""Toxicity by maximum-scoring segments of token log-odds.

Features of a token are the word itself, the 2- to 7-letter grams of the marked word (``^word$``), and the pair it makes with the
word before it. Their counts in toxic and clean rows give log-odds under an informative Dirichlet prior. A feature
that is significant in documents and in tokens scores the lower end of its log-odds; one that is met almost only within
a longer one says nothing of its own and is left out. A token scores its best feature, or ``drift``: what a token without any says
against toxicity, so that how densely toxic tokens stand counts. A linear-time scan finds every maximal scoring segment of a
text. A segment's significance follows the extreme-value law ``p = 1 - exp(-K n exp(-lambda S))`` with
lambda and K fitted on clean rows. Significant segments are passages. Only features of at least ``STRONG`` log-odds make segments; weaker ones
count in density alone. The strongest segment's ``log p`` and the density of scores give a probability by a logistic fit. Drift, lambda, K and the fit are taken from rows whose scores come from the other folds.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._common import stage_mark, staged, superseded

#: Most labelled rows that training uses.
SAMPLE_ROWS = 20_000
#: Weight of the prior, in rows and in tokens; what it adds to every feature.
PRIOR_ROWS, PRIOR_TOKENS, FLAT = 100.0, 1000.0, 0.5
#: Letters of a gram, marks included; whole marked words are features at any length.
GRAMS = range(2, 8)
#: Toxic rows that a feature needs; its z-value, by rows and by tokens; its log-odds; the log-odds from which it makes segments.
LEAST, Z_MIN, ODDS_MIN, STRONG = 4, 4.0, 0.7, 1.5
#: z-value by tokens from which a gram is counted by rows.
Z_LIKELY = 3.0
#: Tokens score the lower end of their log-odds, so many standard deviations below the estimate.
LOWER = 1.64
MOST_SCORE = 8.0
#: A gram of which a longer one has this share of toxic rows is left out.
CLOSED = 0.95
#: A clean token must lose this many times what clean tokens gain on average.
GAIN = 1.5
FOLDS = 4
RIDGE = 1.0
#: The strongest evidence (-log p) that still counts.
MOST_EVIDENCE = 60.0
P_PASSAGE = 0.05
_WORD = re.compile(r"[^\W\d_]+")
CACHED = 300_000


def tokens(text: str) -> list[str]:
    """Lower-cased words; a word that directly follows itself adds nothing and becomes ``''``."""
    words = _WORD.findall(text.lower())
    if any(map(eq, words, islice(words, 1, None))):
        words = [w if w != before else "" for w, before in zip(words, ["", *words], strict=False)]
    return words


def grams(word: str) -> set[str]:
    marked = f"^{word}$"
    return {marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)} | {marked}


def pairs_of(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, islice(words, 1, None), strict=False) if a and b]


def maximal_segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score), in linear time.

    ``scores`` has the positions of tokens that do not score ``drift`` (which is negative), in order.
    Candidates are kept as (first, last, sum before, sum after); a new one merges with the nearest
    earlier candidate of a smaller sum before it, if it ends higher than that one.
    """
    kept: list[list] = []
    total, at = 0.0, 0
    for place, s in scores:
        total += drift * (place - at)
        at = place + 1
        before, total = total, total + s
        if s <= 0:
            continue
        new = [place, place, before, total, -1]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= new[3]:
                new[4] = j
                kept.append(new)
                break
            new = [kept[j][0], new[1], kept[j][2], new[3], -1]
            del kept[j:]
    return [(a, b, hi - lo) for a, b, lo, hi, _ in kept]


class _Scores(dict):
    """Score of every word by its grams; 0 where none scores."""

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.by_length: dict[int, dict[str, float]] = defaultdict(dict)
        self.whole: dict[str, float] = {}
        for g, s in scores.items():
            if len(g) in GRAMS:
                self.by_length[len(g)][g] = s
            else:
                self.whole[g] = s

    def __missing__(self, word: str) -> float:
        s = 0.0
        if word:
            marked = f"^{word}$"
            s = self.whole.get(marked, 0.0)
            for n, known in self.by_length.items():
                for i in range(len(marked) - n + 1):
                    found = known.get(marked[i : i + n])
                    if found is not None and found > s:
                        s = found
        if len(self) >= CACHED:
            self.clear()
        self[word] = s
        return s


def strong(found: list[tuple[int, float]]) -> list[tuple[int, float]]:
    """The hits that can make a segment."""
    return [h for h in found if h[1] >= STRONG]


@dataclass
class Model:
    """What scoring needs; ``grams`` and ``pairs`` are as many as the bounded sample has significant ones."""

    grams: dict[str, float] = field(default_factory=dict)
    pairs: dict[str, float] = field(default_factory=dict)
    drift: float = -0.02
    lam: float = 1.0
    k: float = 0.1
    weights: tuple[float, ...] = (1.0, 0.0, 0.0, -5.0)

    def __post_init__(self) -> None:
        self._scores = _Scores(self.grams)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_scores"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def hits(self, text: str | None) -> tuple[list[tuple[int, float]], int]:
        """Place and score of every scoring token, and how many tokens there are."""
        words = tokens(text or "")
        scores = list(map(self._scores.__getitem__, words))
        if self.pairs:
            for i in range(1, len(words)):
                found = self.pairs.get(f"{words[i - 1]} {words[i]}")
                if found is not None and found > scores[i]:
                    scores[i] = found
        return [(i, s) for i, s in enumerate(scores) if s > 0] if any(scores) else [], len(words)

    def log_p(self, score: float, n: int) -> float:
        """Natural logarithm of the chance that a clean text of n tokens has a segment of this score."""
        e = math.log(self.k * max(n, 1)) - self.lam * score
        return e if e < -12 else math.log(-math.expm1(-math.exp(min(e, 5))))

    def passages(self, text: str | None) -> list[tuple[int, int, float, float]]:
        """Every significant passage: first and last token, score, p."""
        found, n = self.hits(text)
        return [(a, b, s, math.exp(lp)) for a, b, s in maximal_segments(strong(found), self.drift) if (lp := self.log_p(s, n)) <= math.log(P_PASSAGE)]

    def evidence(self, found: list[tuple[int, float]], n: int) -> tuple[tuple[float, float, float], int, tuple[int, int] | None]:
        """Strongest segment's ``-log p`` and the density of strong and of all scores; how many passages there are, where the strongest is."""
        if not found:
            return (0.0, 0.0, 0.0), 0, None
        dense = lambda hits: math.log1p(1000 * sum(s for _, s in hits) / (n + 20))
        most = strong(found)
        strength = sorted((self.log_p(s, n), a, b) for a, b, s in maximal_segments(most, self.drift))
        passages = sum(lp <= math.log(P_PASSAGE) for lp, *_ in strength)
        x = min(-strength[0][0], MOST_EVIDENCE) / 10 if strength else 0.0, dense(most), dense(found)
        return x, passages, strength[0][1:] if passages else None

    def probability(self, x: tuple[float, ...]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w * v for w, v in zip(self.weights, (*x, 1.0), strict=True))))))


def _odds(toxic, clean, n_toxic: float, n_clean: float, prior: float, rest: float, log, most):
    """Log-odds of toxic against clean counts among so many, and their standard deviation; on arrays or columns."""
    a = FLAT + prior * (toxic + clean) / (n_toxic + n_clean)
    t, c = toxic + a, clean + a
    return log(t / most(n_toxic + rest * a - t, 1.0)) - log(c / most(n_clean + rest * a - c, 1.0)), (1 / t + 1 / c) ** 0.5


def _selected(names: list[str], rows: np.ndarray, types: np.ndarray, n_rows: np.ndarray, n_types: np.ndarray) -> tuple[dict[str, float], dict[str, float]]:
    """Scores of the significant grams and pairs, of which ``rows[y]`` rows and ``types[y]`` distinct tokens of rows have each."""
    if not names or not n_rows.all() or not n_types.all():
        return {}, {}
    by_rows, sd_rows = _odds(rows[1], rows[0], n_rows[1], n_rows[0], PRIOR_ROWS, 2.0, np.log, np.maximum)
    by_types, sd_types = _odds(types[1], types[0], n_types[1], n_types[0], PRIOR_TOKENS, 2.0, np.log, np.maximum)
    scores = by_types - LOWER * sd_types
    good = (by_rows >= Z_MIN * sd_rows) & (by_types >= Z_MIN * sd_types) & (scores >= ODDS_MIN) & (rows[1] >= LEAST)
    longest, longer = max(GRAMS), defaultdict(float)  # most toxic rows of a longer gram
    for name, n in zip(names, rows[1], strict=True):
        if " " not in name:
            for part in (name[1:], name[:-1]) if len(name) <= longest else (name[i : i + longest] for i in range(len(name) - longest + 1)):
                longer[part] = max(longer[part], n)
    chosen = {names[i]: (min(MOST_SCORE, float(scores[i])), rows[1][i]) for i in np.flatnonzero(good)}
    single = {g: s for g, (s, n) in chosen.items() if " " not in g and longer[g] < CLOSED * n}
    alone = _Scores(single)
    return single, {p: s for p, (s, _) in chosen.items() if " " in p and not any(alone[w] for w in p.split(" "))}


def _tally(add) -> object:
    """A mapInArrow function: ``add(batch, toxic, clean)`` fills two counters, which leave as ``token, toxic, clean``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter(), Counter()

        def out() -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            made = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][w] for w in names], pa.int64()), pa.array([seen[0][w] for w in names], pa.int64())], names=["token", "toxic", "clean"])
            seen[0].clear()
            seen[1].clear()
            return made

        for b in batches:
            for at in range(0, b.num_rows, 500):
                add(b.slice(at, 500), seen[1], seen[0])
                if len(seen[0]) + len(seen[1]) > 400_000:
                    yield out()
        yield out()

    return run


def _count_words(b: pa.RecordBatch, toxic: Counter, clean: Counter) -> None:
    """t, y -> rows of every word; of pairs in toxic rows, which alone can become features; under a blank, all distinct words."""
    for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
        words = tokens(t)
        types = set(words) - {""}
        (toxic if y else clean).update(types)
        (toxic if y else clean)[" "] += len(types)
        if y:
            toxic.update(set(pairs_of(words)))


def _count_grams(b: pa.RecordBatch, toxic: Counter, clean: Counter) -> None:
    """token, toxic, clean of words -> the same of their grams."""
    for word, t, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
        for g in grams(word):
            if t:
                toxic[g] += t
            if c:
                clean[g] += c


def _count_rows(names: list[str]):
    """t, y, fold -> fold, y, id, rows, types of the features ``names``; the id -1 has rows and distinct words in all."""
    at = {name: i for i, name in enumerate(names)}
    pairs = any(" " in name for name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, types, known = defaultdict(Counter), defaultdict(Counter), {}
        for b in batches:
            for t, y, fold in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words = tokens(t)
                distinct = set(words) - {""}
                here = Counter()
                for w in distinct:
                    ids = known.get(w)
                    if ids is None:
                        if len(known) >= CACHED:
                            known.clear()
                        ids = known[w] = [at[g] for g in grams(w) if g in at]
                    if ids:
                        here.update(ids)
                if pairs:
                    here.update({at[p] for p in pairs_of(words) if p in at})
                rows[fold, y].update(here.keys())
                rows[fold, y][-1] += 1
                types[fold, y].update(here)
                types[fold, y][-1] += len(distinct)
        for (fold, y), n in rows.items():
            ids = list(n)
            own = types[fold, y]
            yield pa.RecordBatch.from_arrays(
                [pa.array([fold] * len(ids), pa.int32()), pa.array([y] * len(ids), pa.int32()), pa.array(ids, pa.int32()), pa.array([n[i] for i in ids], pa.int64()), pa.array([own[i] for i in ids], pa.int64())],
                names=["fold", "y", "id", "rows", "types"],
            )

    return run


def _find_hits(models):
    """t, y, fold -> y, m, n, places, scores: rows with hits under the model of their fold one by one, m = 1; all others of a class as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64()))
        bare = {0: [0, 0], 1: [0, 0]}

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["y", "m", "n", "places", "scores"])

        for b in batches:
            out = []
            for t, y, fold in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                found, n = models.value[fold].hits(t)
                if found:
                    out.append((y, 1, n, [i for i, _ in found], [s for _, s in found]))
                else:
                    bare[y][0] += 1
                    bare[y][1] += n
            yield made(out)
        yield made([(y, m, n, [], []) for y, (m, n) in bare.items() if m])

    return run


def _extreme_value(clean: list[tuple[list[tuple[int, float]], int]], n_bare: int, tokens_bare: int, drift: float) -> tuple[float, float]:
    """Lambda and K from the hits of clean rows and how many rows and tokens have none."""
    total = sum(n for _, n in clean) + tokens_bare + 1
    seen = Counter(round(s, 1) for found, _ in clean for _, s in found) + Counter({MOST_SCORE: 1})  # as if the best score had been met once more
    steps = [(s, n / total) for s, n in seen.items()]
    p0, low, high = 1 - sum(p for _, p in steps), 1e-6, 20.0
    for _ in range(80):  # the positive root of sum p(s) exp(lambda s) = 1
        mid = (low + high) / 2
        low, high = (mid, high) if p0 * math.exp(drift * mid) + sum(p * math.exp(s * mid) for s, p in steps) < 1 else (low, mid)
    best = [(n, max((s for *_, s in maximal_segments(found, drift)), default=0.0)) for found, n in clean]
    return low, (len(best) + n_bare + 1) / (sum(n * math.exp(-low * s) for n, s in best) + tokens_bare + 1)  # most likely K for the maxima


def _fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Newton steps for weighted logistic regression; a ridge on all but the constant, so that separable data end."""
    a, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    ridge = np.diag([RIDGE] * x.shape[1] + [1e-2])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (weight * (p - y)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def _near_copy_keys(words: Column) -> Column:
    """Three min-wise samples of the runs of three words; ``words`` must be a column, which lambdas read again and again."""
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.array(*[F.array_min(F.transform(runs, lambda r, s=s: F.xxhash64(F.lit(s), r))) for s in range(3)])


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int) -> DataFrame:
    """``t, y, fold`` of at most ``rows`` labelled rows; of texts that share a near-copy key, one."""
    mark = stage_mark()
    chosen = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg((F.max(F.col(label).cast("int")) > 0).cast("int").alias("y"))
        .orderBy(F.xxhash64(F.lit("toxicity"), "k"), "k").limit(rows)
    )
    # F.broadcast, twice: at most ``rows`` rows of numbers
    found = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull()).join(F.broadcast(chosen), "k")
    found = found.select("t", "y", F.struct(F.xxhash64("t").alias("h"), "k", F.monotonically_increasing_id().alias("r")).alias("row"), F.split(F.lower("t"), r"[^\p{L}]+").alias("w"))
    found = staged(found.select("t", "y", "row", _near_copy_keys(F.col("w")).alias("m")))
    one = found.select("row", "m")
    for i in range(3):
        one = one.groupBy(F.col("m")[i]).agg(F.min("row").alias("row"), F.min_by("m", "row").alias("m")).select("row", "m")
    kept = found.join(F.broadcast(one.select(F.col("row.r").alias("r"))), F.col("row.r") == F.col("r"))
    sample = staged(kept.repartition("r").select("t", "y", F.pmod("row.h", F.lit(FOLDS)).cast("int").alias("fold")))  # dealt evenly: three passes follow
    superseded(docs.sparkSession, mark)
    return sample


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Train on at most ``rows`` labelled rows, chosen by a hash of the key; equal and near-equal texts count once.

    Null keys, texts and labels are left out; of several labels of a key the largest counts. Without a toxic or a clean
    row, or a significant feature, the model finds nothing.
    """
    spark, sample = docs.sparkSession, _sample(docs, labels, key, text, label, rows)
    made = "token string, toxic long, clean long"
    words = staged(sample.select("t", "y").mapInArrow(_tally(_count_words), made).groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    total = words.where("token = ' '").first()
    if total is None or not total.toxic or not total.clean:
        return Model()
    every = words.where(F.instr("token", " ") == 0).mapInArrow(_tally(_count_grams), made).groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds, sd = _odds(F.col("toxic"), F.col("clean"), float(total.toxic), float(total.clean), PRIOR_TOKENS, 2.0, F.log, lambda a, b: F.greatest(a, F.lit(b)))
    likely = every.where((F.col("toxic") >= LEAST) & (odds >= Z_LIKELY * sd)).select("token").unionByName(words.where((F.col("toxic") >= LEAST) & (F.instr("token", " ") > 1)).select("token"))
    names = sorted(r.token for r in likely.collect())  # of at most ``rows`` rows
    counted = sample.select("t", "y", "fold").mapInArrow(_count_rows(names), "fold int, y int, id int, rows long, types long")
    counted = counted.groupBy("fold", "y", "id").agg(F.sum("rows").alias("rows"), F.sum("types").alias("types")).toArrow()
    rows_of, types_of = np.zeros((FOLDS, 2, len(names) + 1)), np.zeros((FOLDS, 2, len(names) + 1))
    where = tuple(counted.column(c).to_numpy() for c in ("fold", "y", "id"))  # the id -1 is the last place
    rows_of[where], types_of[where] = counted.column("rows").to_numpy(), counted.column("types").to_numpy()

    def selected(folds: list[int]) -> tuple[dict, dict]:
        r, t = rows_of[folds].sum(axis=0), types_of[folds].sum(axis=0)
        return _selected(names, r[:, :-1], t[:, :-1], r[:, -1], t[:, -1])

    all_folds = list(range(FOLDS))
    grams_, pairs_ = selected(all_folds)
    if not grams_ and not pairs_:
        return Model()
    models = spark.sparkContext.broadcast([Model(*selected([f for f in all_folds if f != fold])) for fold in all_folds])
    seen = sample.select("t", "y", "fold").mapInArrow(_find_hits(models), "y int, m long, n long, places array<int>, scores array<double>").collect()  # hits of at most ``rows`` rows
    hit = [(list(zip(r.places, r.scores, strict=True)), r.n, r.y) for r in seen if r.places]
    firm = [(strong(h), n, y) for h, n, y in hit]
    bare = {y: (sum(r.m for r in seen if not r.places and r.y == y), sum(r.n for r in seen if not r.places and r.y == y)) for y in (0, 1)}
    hits = [sum(len(h) for h, _, y in firm if y == c) for c in (0, 1)]
    n_tokens = [sum(n for _, n, y in hit if y == c) + bare[c][1] + 1 for c in (0, 1)]
    gained = sum(s for h, _, y in firm if not y for _, s in h) / n_tokens[0]
    # the log-odds of a token without a feature; a clean text must lose on average
    drift = min(-0.01, math.log((1 - hits[1] / n_tokens[1]) / (1 - hits[0] / n_tokens[0])) if hits[1] < n_tokens[1] and hits[0] < n_tokens[0] else -0.01, -GAIN * gained)
    lam, k = _extreme_value([(h, n) for h, n, y in firm if not y], *bare[0], drift)
    model = Model(grams_, pairs_, drift, lam, k)
    x = np.array([model.evidence(h, n)[0] for h, n, _ in hit] + [(0.0, 0.0, 0.0)] * 2)
    y, weight = np.array([float(y) for *_, y in hit] + [0.0, 1.0]), np.array([1.0] * len(hit) + [bare[0][0], bare[1][0]])
    return Model(grams_, pairs_, drift, lam, k, _fit_logistic(x, y, weight))


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score, n_passages, passage_from, passage_to``; passages are counted in words from 0, the last pair
    is the strongest one's. Rows stay; null and empty texts score as texts without a scoring token."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for at in range(0, max(1, b.num_rows), 256):
                part = b.slice(at, 256)
                rows = [m.evidence(*m.hits(t)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([m.probability(x) for x, _, _ in rows], pa.float64()), pa.array([n for _, n, _ in rows], pa.int32()),
                     pa.array([w and w[0] for _, _, w in rows], pa.int32()), pa.array([w and w[1] for _, _, w in rows], pa.int32())],
                    names=["k", "score", "n_passages", "passage_from", "passage_to"],
                )

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, score double, n_passages int, passage_from int, passage_to int")
    return out.withColumnRenamed("k", key)
