"""Jaccard self-join on five-word shingles by chosen paths.

Every distinct text is a set of shingle hashes, and a sketch of ``POSITIONS`` min-wise sampled ones. A
run splits all texts recursively: a node chooses one or two sketch positions (1 / ``THRESHOLD`` on average) and deals
its texts by the shingle sampled there, so similar texts go down a shared path and others part.
Nodes of at most ``LEAF`` texts are compared by brute force; larger ones are split again. Runs are
repeated until a pair at the threshold is met with probability ``RECALL``. What a leaf finds alike is
only a candidate: candidates are gathered into components, and inside a component all pairs are
compared exactly, on whole shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._common import stage_mark, staged, superseded
from corpusloom.llm._graph import attached, components

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
POSITIONS = 64
LEAF = 500
DEPTH = 4
#: Sketch agreement from which a pair is a candidate: four standard deviations under the threshold.
CANDIDATE = 0.6
#: Texts and words of one exact comparison; larger components are compared block against block.
BLOCK_TEXTS, BLOCK_WORDS = 1024, 1_500_000
#: Elements of so many sets are counted pair by pair.
FEW = 12

_rng = np.random.default_rng(20240229)
_MUL = (_rng.integers(0, 1 << 32, POSITIONS, dtype=np.uint64) | 1).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, POSITIONS, dtype=np.uint64).astype(np.uint32)
_P = np.uint64(0x9E3779B97F4A7C15)


def second_choice(path: int) -> bool:
    """Whether a node chooses a second position: so often that it chooses 1 / THRESHOLD on average."""
    return (path >> 7) % 1000 < 1000 * (1 / THRESHOLD - 1)


def reached(depth: int, s: float = THRESHOLD) -> float:
    """Chance that a pair of similarity s shares a node of this depth in one run."""
    two, p = 1 / THRESHOLD - 1, 1.0
    for _ in range(depth):
        p = (1 - two) * s * p + two * (1 - (1 - s * p) ** 2)
    return p


def runs(depth: int = DEPTH, recall: float = RECALL) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - reached(depth)))


def word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle_hashes(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts one after the other, and where each text's begin (one entry more than texts).

    A text of fewer than five words is one shingle; ``starts`` are the texts' places in ``words``.
    """
    w, n = words.view(np.uint64), np.diff(starts)
    padded = np.concatenate([w, np.zeros(SHINGLE, np.uint64)])
    h = np.zeros(len(w), np.uint64)
    for j in range(SHINGLE):
        h = h * _P + padded[j : len(w) + j]
    own = np.arange(len(w)) - np.repeat(starts[:-1] - starts[0], n)
    keep = own < np.repeat(np.maximum(n - SHINGLE + 1, (n > 0).astype(n.dtype)), n)
    for i in np.flatnonzero((n > 0) & (n < SHINGLE)):
        a, v = starts[i] - starts[0], int(n[i])
        for j in range(n[i]):
            v = (v * int(_P) + int(w[a + j])) & 0xFFFFFFFFFFFFFFFF
        h[a] = v
    h = h[keep]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h, np.concatenate([[0], np.cumsum(np.maximum(n - SHINGLE + 1, (n > 0).astype(n.dtype)))])


def sketch(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Texts x POSITIONS min-wise samples; every text has a shingle."""
    out = np.empty((len(starts) - 1, POSITIONS), np.uint32)
    x, at = (h >> np.uint64(32)).astype(np.uint32), 0
    while at < len(starts) - 1:
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + 65_536, "right")) - 1)
        part, cut = x[starts[at] : starts[end]], starts[at:end] - starts[at]
        for p in range(POSITIONS):
            out[at:end, p] = np.minimum.reduceat(part * _MUL[p] + _ADD[p], cut)
        at = end
    return out


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    starts = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    return values[starts[0] : starts[-1]], starts


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k, tk, words -> k, tk, cid, n_words, sketch; rows without words have a null cid."""
    for b in batches:
        for at in range(0, max(1, b.num_rows), 1000):
            part = b.slice(at, 1000)
            words, starts = _lists(part.column(2))
            n = np.diff(starts)
            h, cut = shingle_hashes(words, starts)
            some = np.flatnonzero(n)
            made = sketch(h, np.append(cut[:-1][some], cut[-1]))
            sketches: list = [None] * len(n)
            cids: list = [None] * len(n)
            off = starts - starts[0]
            for row, i in enumerate(some):
                sketches[i] = made[row].tobytes()
                cids[i] = hashlib.md5(words[off[i] : off[i + 1]].tobytes()).digest()
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cids, pa.binary()), pa.array(n, pa.int64()), pa.array(sketches, pa.binary())], names=["k", "tk", "cid", "n_words", "sketch"])


def _as_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, POSITIONS)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _child(path: np.ndarray, position: np.ndarray, value: np.ndarray) -> np.ndarray:
    return _mix(_mix(path.astype(np.uint64) + position.astype(np.uint64) * _P) ^ value.astype(np.uint64)).view(np.int64)


def _roots(n_runs: int):
    """First split of all runs: cid, sketch -> path, cid. Runs choose positions of their own."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s, paths, rows = _as_matrix(b.column(1)), [], np.arange(b.num_rows)
            for r in range(n_runs):
                root = int(_mix(np.array([r + 1], np.uint64))[0])
                for position in (2 * r % POSITIONS, (2 * r + 1) % POSITIONS)[: 1 + second_choice(root)]:
                    paths.append(_child(np.full(b.num_rows, root, np.uint64), np.full(b.num_rows, position), s[:, position]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(paths)), b.column(0).take(pa.array(np.tile(rows, len(paths))))], names=["path", "cid"])

    return split


def _deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, cid, sketch -> the paths one level down. A node's positions depend on its path alone."""
    for b in batches:
        if not b.num_rows:
            continue
        path, s, rows = b.column(0).to_numpy(), _as_matrix(b.column(2)), np.arange(b.num_rows)
        first = (_mix(path.view(np.uint64) + np.uint64(1)) % np.uint64(POSITIONS)).astype(np.int64)
        paths, kept = [_child(path.view(np.uint64), first, s[rows, first])], [rows]
        two = np.array([second_choice(int(p) & ((1 << 63) - 1)) for p in path], dtype=bool)
        if two.any():
            other = (first + 1 + (_mix(path.view(np.uint64) + np.uint64(2)) % np.uint64(POSITIONS - 1)).astype(np.int64)) % POSITIONS
            paths.append(_child(path[two].view(np.uint64), other[two], s[rows[two], other[two]]))
            kept.append(rows[two])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(paths)), b.column(1).take(pa.array(np.concatenate(kept)))], names=["path", "cid"])


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """The runs of rows with equal first columns, over batch borders; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None

    def together() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]

    for b in batches:
        if not b.num_rows:
            continue
        keys = list(zip(*[b.column(i).to_pylist() for i in range(n_keys)], strict=True))
        at = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[at]:
                if held and keys[at] != last:
                    yield together()
                    held.clear()
                held.append(b.slice(at, i - at))
                last, at = keys[at], i
                if i < len(keys):
                    yield together()
                    held.clear()
    if held:
        yield together()


def _labels(alike: np.ndarray) -> np.ndarray:
    """Component of each row of a symmetric boolean matrix, named by its first row."""
    label = np.full(len(alike), -1)
    for i in range(len(alike)):
        if label[i] < 0:
            label[i], front = i, [i]
            while front:
                new = np.flatnonzero(alike[front].any(axis=0) & (label < 0))
                label[new], front = i, list(new)
    return label


def _agreement(s: np.ndarray) -> np.ndarray:
    """Agreeing positions of each pair of sketches, by 256 rows at a time."""
    out = np.zeros((len(s), len(s)), np.uint8)
    t = np.ascontiguousarray(s.T)
    for p in range(POSITIONS):
        out += t[p][:, None] == t[p][None, :]
    return out


def _brute_force(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, bi, bj, cid, sketch -> star edges u, v of what is alike in a leaf."""
    us, vs = [], []
    for g in _groups(batches, 3):
        if g.num_rows < 2:
            continue
        label = _labels(_agreement(_as_matrix(g.column(4))) >= CANDIDATE * POSITIONS)
        moved = np.flatnonzero(label != np.arange(len(label)))
        if len(moved):
            cids = g.column(3).to_pylist()
            us += [cids[i] for i in moved]
            vs += [cids[label[i]] for i in moved]
        if len(us) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], names=["u", "v"])
            us, vs = [], []
    yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], names=["u", "v"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """root, blocks, cid, words -> root, blocks, cid, shingles: sorted distinct shingle hashes."""
    for b in batches:
        for at in range(0, max(1, b.num_rows), 500):
            part = b.slice(at, 500)
            h, cut = shingle_hashes(*_lists(part.column(3)))
            own = [np.unique(h[cut[i] : cut[i + 1]]).view(np.int64) for i in range(part.num_rows)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(own) if own else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), lists], names=["root", "blocks", "cid", "shingles"])


def similar(sets: list[np.ndarray], threshold: float = THRESHOLD) -> np.ndarray:
    """Boolean matrix of the pairs of sorted sets whose Jaccard similarity reaches the threshold, exactly.

    Elements that the same sets have count as one with a weight (128 random bits tell these groups apart). Those of few sets
    are counted pair by pair, the others by a matrix product; either way every pair's intersection is complete.
    """
    m, size = len(sets), np.array([len(s) for s in sets])
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        hit = both >= threshold * (size.sum() - both) - 1e-9
        return np.array([[False, hit], [hit, False]])
    values, rows = np.concatenate(sets), np.repeat(np.arange(m), size)
    order = np.argsort(values, kind="stable")  # rows of an element stay in order
    values, rows = values[order], rows[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    often = np.diff(np.append(first, len(values)))
    code = np.random.default_rng(7).integers(0, 1 << 63, (m, 2), dtype=np.uint64)
    owners = np.stack([np.add.reduceat(code[rows, i], first) for i in (0, 1)], axis=1)
    _, one, weight = np.unique(np.column_stack([owners, often.astype(np.uint64)]), axis=0, return_index=True, return_counts=True)
    both = np.zeros(m * m)
    for n in range(2, FEW + 1):  # pairs of at most FEW sets: no more than FEW times the elements
        at = np.flatnonzero(often[one] == n)
        if len(at):
            owning = rows[first[one[at]][:, None] + np.arange(n)]
            i, j = np.triu_indices(n, 1)
            both += np.bincount((owning[:, i] * m + owning[:, j]).ravel(), np.repeat(weight[at], len(i)).astype(float), m * m)
    both = both.reshape(m, m)
    both += both.T
    many = np.flatnonzero(often[one] > FEW)
    step = max(64, (1 << 22) // m)
    for a in range(0, len(many), step):
        part = many[a : a + step]
        n = often[one[part]]
        x = np.zeros((m, len(part)), np.float32)
        own = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        x[rows[np.repeat(first[one[part]], n) + own], np.repeat(np.arange(len(part)), n)] = 1
        both += (x * weight[part].astype(np.float32)) @ x.T  # whole numbers below 2**24: BLOCK_WORDS bounds them
    np.fill_diagonal(both, 0)
    return both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """root, bi, bj, cid, b, shingles -> cid, n_links, first: exact links of each text inside a group of blocks."""
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        c, n, f = zip(*out, strict=True) if out else ((), (), ())
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()), pa.array(n, pa.int64()), pa.array(f, pa.binary())], names=["cid", "n_links", "first"])

    for g in _groups(batches, 3):
        cids = g.column(3).to_pylist()
        once = [i for i in range(len(cids)) if i == 0 or cids[i] != cids[i - 1]]  # rows that repeat a document
        if len(once) < 2:
            continue
        values, starts = _lists(g.column(5))
        starts = starts - starts[0]
        alike = similar([values[starts[i] : starts[i + 1]] for i in once])
        bi, bj = g.column(1)[0].as_py(), g.column(2)[0].as_py()
        if bi != bj:
            b = g.column(4).to_numpy()[once]
            alike &= b[:, None] != b[None, :]
        label, links = _labels(alike), alike.sum(axis=1)
        out += [(cids[once[i]], int(links[i]), cids[once[label[i]]]) for i in np.flatnonzero(links)]
        if len(out) > 10_000:
            yield flush()
    yield flush()


def _block_pairs(blocks: Column, b: Column) -> Column:
    """The pairs (bi, bj) of blocks in which block b takes part."""
    return F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(b, j).alias("bi"), F.greatest(b, j).alias("bj"))))


def candidates(contents: DataFrame) -> DataFrame:
    """``u, v``: star edges between texts of ``contents(cid, sketch)`` that met and agreed in some leaf."""
    paths = contents.select("cid", "sketch").mapInArrow(_roots(runs()), "path long, cid binary")
    leaves = None
    for depth in range(1, DEPTH + 1):
        paths = staged(paths)
        crowded = paths.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        met = paths.join(crowded, "path")
        last = depth == DEPTH
        leaf = met if last else met.where(F.col("n") <= LEAF)
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        if last or crowded.where(F.col("n") > LEAF).isEmpty():
            break
        paths = met.where(F.col("n") > LEAF).join(contents, "cid").select("path", "cid", "sketch").mapInArrow(_deeper, "path long, cid binary")
    blocks = F.ceil(F.col("n") / LEAF).cast("int")
    dealt = leaves.select("path", "cid", blocks.alias("blocks"), F.pmod(F.xxhash64("cid"), blocks).cast("int").alias("b"))
    dealt = dealt.select("path", "cid", _block_pairs(F.col("blocks"), F.col("b")).alias("pair"))
    full = dealt.join(contents.select("cid", "sketch"), "cid").select("path", "pair.bi", "pair.bj", "cid", "sketch")
    return full.repartition("path", "bi", "bj").sortWithinPartitions("path", "bi", "bj", "cid").mapInArrow(_brute_force, "u binary, v binary")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: ``k, tk, cid`` of all rows, and ``cid, class_id, n_links, n_copies`` of all distinct texts.

    ``cid`` stands for the sequence of lower-cased words, ``tk`` for the text as it is. Links join
    different texts of similarity ``THRESHOLD`` or more; a class is what links connect.
    """
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("tk"), F.coalesce(word_hashes(F.col(text)), F.array().cast("array<bigint>")).alias("words"))
    kind = docs.schema[key].dataType.simpleString()
    spark = docs.sparkSession
    described = staged(rows.mapInArrow(_describe, f"k {kind}, tk long, cid binary, n_words long, sketch binary"))
    mark = stage_mark()
    contents = staged(
        described.where("cid is not null").groupBy("cid")
        .agg(F.min(F.struct(F.col("k").isNull().alias("no_k"), "k", "tk")).alias("rep"), F.count("*").alias("n"), F.first("n_words").alias("n_words"), F.first("sketch").alias("sketch"))
        .select("cid", F.col("rep.k").alias("rep"), F.col("rep.tk").alias("rep_tk"), "n", "n_words", "sketch")
    )
    searched = stage_mark()
    found = staged(components(candidates(contents)))
    superseded(spark, searched)
    sized = found.join(contents.select("cid", "rep", "rep_tk", "n_words"), found.node == contents.cid)
    sized = attached(sized, "root", "cid", {"texts": F.count("*"), "all_words": F.sum("n_words")}, {"texts": F.sum("texts"), "all_words": F.sum("all_words")})
    blocks = F.ceil(F.greatest(F.col("texts") / BLOCK_TEXTS, F.col("all_words") / BLOCK_WORDS)).cast("int")
    sought = sized.select("root", blocks.alias("blocks"), "cid", "rep", "rep_tk")
    wanted = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("tk"), F.col(text).alias("t")).join(sought, (F.col("tk") == F.col("rep_tk")) & F.col("k").eqNullSafe(F.col("rep")))
    sets = wanted.select("root", "blocks", "cid", word_hashes(F.col("t")).alias("words")).mapInArrow(_sets, "root binary, blocks int, cid binary, shingles array<long>")
    b = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    sets = sets.withColumn("b", b).select("root", "cid", "b", "shingles", _block_pairs(F.col("blocks"), F.col("b")).alias("pair"))
    sets = sets.select("root", "pair.bi", "pair.bj", "cid", "b", "shingles").repartition("root", "bi", "bj").sortWithinPartitions("root", "bi", "bj", "cid")
    links = staged(sets.mapInArrow(_verify, "cid binary, n_links long, first binary"))
    classes = components(links.select(F.col("cid").alias("u"), F.col("first").alias("v")))
    linked = links.groupBy("cid").agg(F.sum("n_links").alias("n_links")).join(classes, F.col("cid") == F.col("node")).select("cid", "root", "n_links")
    named = linked.join(contents.select("cid", "rep"), "cid")
    linked = attached(named, "root", "cid", {"class_rep": F.min("rep")}, {"class_rep": F.min("class_rep")}).select("cid", "class_rep", "n_links")
    texts = contents.select("cid", "rep", "n").join(linked, "cid", "left").select(
        "cid", F.coalesce("class_rep", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("n") - 1).alias("n_copies")
    )
    texts = staged(texts)
    superseded(spark, mark)
    return described.select("k", "tk", "cid"), texts


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, class_id, n_links, n_copies`` for every row of ``docs``.

    ``class_id`` is the smallest key of the row's class, ``n_links`` how many different texts are linked to its
    text, ``n_copies`` how many other rows have the same words. Rows without words (null, empty,
    blank) are classes by themselves with their own key. Texts of fewer than five words are one shingle. Null keys
    come last: a class has a null id only if all its keys are null.
    """
    rows, texts = near_duplicates(docs, key, text)
    worded = rows.where("cid is not null").join(texts, "cid").select(F.col("k").alias(key), "class_id", "n_links", "n_copies")
    bare = rows.where("cid is null").select(F.col("k").alias(key), F.col("k").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_copies"))
    return worded.unionByName(bare)


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class of ``docs``: the one with the smallest key (of repeated rows, one). Rows without words stay."""
    rows, texts = near_duplicates(docs, key, text)
    first = rows.where("cid is not null").join(texts.select("cid", "class_id"), "cid").where(F.col("k").eqNullSafe(F.col("class_id")))
    # of rows that share the class's smallest key, the one with the smallest text hash
    chosen = first.groupBy("class_id").agg(F.min("tk").alias("_tk"), F.count("*").alias("_n"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(text).alias("own"), F.col(key).alias("k"), F.col(text).alias("t"))
    marked = own.join(chosen, (F.col("own") == F.col("_tk")) & F.col("k").eqNullSafe(F.col("class_id")), "left")
    worded = F.size(F.filter(F.split(F.coalesce("t", F.lit("")), r"\s+"), lambda w: w != "")) > 0
    kept = marked.where(F.col("_n").isNotNull() | ~worded)
    single = kept.where(F.coalesce("_n", F.lit(1)) == 1).select("row.*")
    repeated = kept.where(F.col("_n") > 1).dropDuplicates(["k", "own"]).select("row.*")
    return single.unionByName(repeated)
