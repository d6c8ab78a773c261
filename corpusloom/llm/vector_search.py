"""Exact top-k search by inner product over one KD-tree per shard.

The first median splits are made once, on a bounded sample (``CELL_SAMPLE``), and deal all vectors to cells of like vectors; a
cell of more than ``SHARD`` vectors is dealt further by a hash, so that copies of one vector meet in no single task. Each shard is split at
medians of its widest dimension down to leaves of ``LEAF`` vectors, each with its tight bounding box. The most that a box allows
a query is the sum over dimensions of the larger of ``q * low`` and ``q * high``. A query visits leaves best bound first, in steps
of 1, 1, 2, 4, ... leaves between which its k-th score is raised, and stops where the best bound left cannot reach it. That score is
carried from shard to shard: queries first search the shard whose box promises them most, in blocks, and take what they found to all others.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._common import staged

SHARD = 8_192
LEAF = 64
QUERY_BLOCK = 512
#: Vectors from which the first splits are made, and the fewest of them in a cell.
CELL_SAMPLE, CELL_LEAST = 16_384, 64
#: Blocks of queries that one task takes through a shard's tree, which it loads once.
BLOCKS_A_TASK = 8
#: Below this, sums of products of whole numbers are exact in a double.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1
#: Where a query has no k-th score yet.
NONE = -LONG - 1


def quantised(vector: Column, scale: int = 64) -> Column:
    """``floor(scale * x)`` of every component; null for vectors that are null or have a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column; shorter ones end in zeros."""
    starts = column.offsets.to_numpy().astype(np.int64)
    n = np.diff(starts)
    width = max(int(n.max(initial=0)), width or 0)
    out = np.zeros((len(n), width), np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]]
    at = np.arange(len(values)) - np.repeat(starts[:-1] - starts[0], n)
    out[np.repeat(np.arange(len(n)), n), at] = values
    return out


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.hstack([x, np.zeros((len(x), width - x.shape[1]), x.dtype)])


def _halves(x: np.ndarray, part: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray] | None:
    """Dimension, cut, rows below it and the others: a median split of the widest dimension; None where all vectors are equal."""
    if not x.shape[1]:
        return None
    own = x[part]
    span = own.max(axis=0).astype(np.float64) - own.min(axis=0)
    wide = int(span.argmax())
    along = own[:, wide]
    low, cut = along.min(), np.median(along)
    if span[wide] <= 0 or low == along.max():
        return None
    left = along < cut if low < cut else along <= low
    return wide, float(cut) if low < cut else float(np.nextafter(float(low), np.inf)), part[left], part[~left]


class Cells:
    """The first splits: ``dim`` (-1 at cells), ``cut``, and ``child`` numbers of the two halves (of a cell: its own number, twice)."""

    def __init__(self, x: np.ndarray, n_cells: int):
        self.nodes, self.boxes = [], []
        most = max(CELL_LEAST, -(-len(x) // max(1, n_cells)))
        self._split(x, np.arange(len(x)), most)

    def _split(self, x: np.ndarray, part: np.ndarray, most: int) -> int:
        me = len(self.nodes)
        halves = _halves(x, part) if len(part) > most else None
        if halves is None:
            self.nodes.append([-1, 0.0, len(self.boxes), len(self.boxes)])
            own = x[part]
            self.boxes.append((own.min(axis=0), own.max(axis=0)) if len(own) else (np.zeros(x.shape[1], np.int64),) * 2)
        else:
            wide, cut, left, right = halves
            self.nodes.append([wide, cut, 0, 0])
            self.nodes[me][2:] = self._split(x, left, most), self._split(x, right, most)
        return me

    def route(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        out, stack = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while stack:
            node, part = stack.pop()
            dim, cut, a, b = self.nodes[node]
            if dim < 0:
                out[part] = a
                continue
            left = (x[part, dim] if dim < x.shape[1] else np.zeros(len(part))) < cut
            stack += [(a, part[left]), (b, part[~left])]
        return out

    def best(self, q: np.ndarray) -> np.ndarray:
        """For each query the cell whose box allows it most."""
        low, high = (np.array([box[i] for box in self.boxes], np.float64) for i in (0, 1))
        width = max(low.shape[1], q.shape[1])
        q, low, high = (widened(a.astype(np.float64), width) for a in (q, low, high))
        return (np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T).argmax(axis=1).astype(np.int32)


class Tree:
    """Leaves of a KD-tree in order: rows ``first`` to ``last`` and the tight box of each."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        rows, stack = [], [np.lexsort((ids,))]
        while stack:
            part = stack.pop()
            halves = _halves(x, part) if len(part) > LEAF else None
            if halves is None:
                rows.append(part)
            else:
                stack += [halves[3], halves[2]]
        take = np.concatenate(rows)
        self.ids, self.x = ids[take], x[take]
        self.last = np.cumsum([len(r) for r in rows])
        self.first = self.last - [len(r) for r in rows]
        self.low, self.high = (np.array([f(x[r], axis=0) for r in rows]) for f in (np.min, np.max))

    FIELDS = ("ids", "x", "first", "last", "low", "high")
    #: Leaves that queries have visited.
    visited = 0

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as z:
            for f in cls.FIELDS:
                setattr(tree, f, z[f])
        return tree

    def search(self, q_ids: np.ndarray, q: np.ndarray, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, id and score of what is among a query's k best here and at least ``known``, its k-th score elsewhere."""
        width = max(q.shape[1], self.x.shape[1])
        q, x, low, high = (widened(a, width) for a in (q, self.x, self.low, self.high))
        most = lambda a: max(abs(int(a.min(initial=0))), abs(int(a.max(initial=0))))
        kind = np.float64 if float(most(x)) * most(q) * max(width, 1) < EXACT else object
        q, x, low, high = (a.astype(kind) for a in (q, x, low, high))
        clipped = (lambda a: a) if kind is np.float64 else (lambda a: np.clip(a, -LONG - 1, LONG))
        bounds = clipped(np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T)
        order = np.argsort(-bounds, axis=1, kind="stable")
        floor = known.astype(kind)
        at, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)
        begin, end = 0, 1
        while begin < len(self.first):
            chunk = order[:, begin:end]
            goes = np.take_along_axis(bounds, chunk, 1) >= floor[:, None]
            if not goes.any():
                break
            found = [(at, ids, scores)]
            asks, places = np.nonzero(goes)
            leaves = chunk[asks, places]
            by_leaf = np.argsort(leaves, kind="stable")
            asks, leaves = asks[by_leaf], leaves[by_leaf]
            cuts = np.flatnonzero(np.diff(leaves, prepend=-1))
            self.visited += len(leaves)
            for a, b in zip(cuts, np.append(cuts[1:], len(leaves)), strict=True):
                rows, own = slice(self.first[leaves[a]], self.last[leaves[a]]), asks[a:b]
                s = clipped(q[own] @ x[rows].T)
                i, j = np.nonzero((s >= floor[own][:, None]) & (q_ids[own][:, None] != self.ids[rows][None, :]))
                found.append((own[i], self.ids[rows][j], s[i, j]))
            at, ids, scores = (np.concatenate(c) for c in zip(*found, strict=True))
            best = np.lexsort((ids, -scores, at))
            at, ids, scores = at[best], ids[best], scores[best]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            full = rank == k - 1
            floor[at[full]] = np.maximum(floor[at[full]], scores[full])
            at, ids, scores = at[rank < k], ids[rank < k], scores[rank < k]
            begin, end = end, end * 2
        return at, ids, scores


def _blobs(pack, names: tuple[str, ...]):
    """Runs of rows with one group number -> one row each, by ``pack(rows)``."""
    from corpusloom.llm.jaccard_join import _groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, 1):
            yield pa.RecordBatch.from_arrays([pa.array([g.column(0)[0].as_py()], pa.int32()), pa.array([pack(g)], pa.binary())], names=names)

    return run


def _tree(g: pa.RecordBatch) -> bytes:
    return Tree(g.column(1).to_numpy(), matrix(g.column(2))).dump()


def _block(g: pa.RecordBatch) -> bytes:
    out = io.BytesIO()
    ids = g.column(1).to_numpy()
    np.savez(out, ids=ids, q=matrix(g.column(2)), known=np.full(len(ids), NONE, np.int64))
    return out.getvalue()


def _search(k: int):
    """task, kind, data in order, a tree (kind 0) before the blocks that go through it -> query_id, vec_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for b in batches:
            for kind, data in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                if kind == 0:
                    tree = Tree.load(data.as_py())
                    continue
                with np.load(io.BytesIO(data.as_py())) as z:
                    ids, (at, vec, s) = z["ids"], tree.search(z["ids"], z["q"], z["known"], k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(vec), pa.array(np.array([int(v) for v in s], np.int64))], names=["query_id", "vec_id", "score"])

    return run


def _through(asked: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """Take ``asked(shard, part, queries)`` through ``trees(shard, tree)``: a task has one tree and the blocks of its part."""
    parts = asked.select("shard", "part").distinct()
    both = asked.select("shard", "part", F.lit(1).alias("kind"), F.col("queries").alias("data")).unionByName(
        trees.join(parts, "shard").select("shard", "part", F.lit(0).alias("kind"), F.col("tree").alias("data"))
    )
    task = F.struct("shard", "part").alias("task")
    return both.repartition("shard", "part").sortWithinPartitions("shard", "part", "kind").select(task, "kind", "data").mapInArrow(_search(k), "query_id long, vec_id long, score long")


def _routed(cells, choose: str):
    """id, v, r -> cell, id, v, r by a method of :class:`Cells`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(getattr(cells.value, choose)(matrix(b.column(1)))), *b.columns], names=["cell", "id", "v", "r"])

    return run


def _with_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, queries, ids, known -> block, queries that carry their k-th scores."""
    for b in batches:
        for block, queries, ids, known in zip(*(b.column(i) for i in range(4)), strict=True):
            with np.load(io.BytesIO(queries.as_py())) as z:
                best = dict(zip(ids.as_py() or [], known.as_py() or [], strict=True))
                out = io.BytesIO()
                np.savez(out, ids=z["ids"], q=z["q"], known=np.array([best.get(int(i), NONE) for i in z["ids"]], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int32()), pa.array([out.getvalue()], pa.binary())], names=["block", "queries"])


def top_k(vectors: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows for every row of ``vectors`` that ``queries`` selects.

    Ties go to the smaller id; a query's own id is no candidate. Vectors that are null or hold a null
    or non-finite component, and null ids, take no part; of vectors of different lengths the shorter end in zeros. Of rows that repeat an
    id each is a candidate; queries of one id are asked once, with one of its vectors. All rows are indexed, and all
    queries meet all shards, in blocks of bounded size. Components and scores beyond a long are held to its limits, so such scores tie.
    """
    from pyspark.sql.window import Window

    ready = staged(
        vectors.select(F.col(key).cast("long").alias("id"), quantised(F.col(vector), scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"), F.xxhash64(F.monotonically_increasing_id()).alias("r"))
        .where("id is not null and v is not null")
    )
    n = ready.count()
    sample = ready.orderBy("r").limit(CELL_SAMPLE).select("v").toArrow().column(0).combine_chunks()  # CELL_SAMPLE rows
    cells = ready.sparkSession.sparkContext.broadcast(Cells(matrix(sample if isinstance(sample, pa.Array) else sample.chunk(0)), -(-n // SHARD)))  # at most CELL_SAMPLE / CELL_LEAST boxes
    schema, grouped = "cell int, id long, v array<long>, r long", lambda df, g: df.repartition(g).sortWithinPartitions(g)
    placed = staged(ready.select("id", "v", "r").mapInArrow(_routed(cells, "route"), schema))
    asked = ready.where("asks").groupBy("id").agg(F.min("v").alias("v"), F.min("r").alias("r")).select("id", "v", "r").mapInArrow(_routed(cells, "best"), schema)
    asked = staged(asked)

    def numbered(rows: DataFrame, most: int) -> DataFrame:
        """``cell, start, parts``: how many parts of ``most`` rows a cell takes, numbered over all cells; a row a cell."""
        sizes = sorted((r.cell, r.n) for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect())
        out, start = [], 0
        for cell, size in sizes:
            out.append((cell, start, -(-size // most)))
            start += out[-1][2]
        return rows.sparkSession.createDataFrame(out, "cell int, start int, parts int")

    shards, blocks = numbered(placed, SHARD), numbered(asked, QUERY_BLOCK)
    n_shards, n_blocks = (x.agg(F.coalesce(F.sum("parts"), F.lit(0))).first()[0] for x in (shards, blocks))
    if not n_shards or not n_blocks:
        return ready.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    own = lambda rows, parts, name: rows.join(F.broadcast(parts), "cell").select((F.col("start") + F.pmod("r", "parts")).cast("int").alias(name), "id", "v")
    trees = staged(grouped(own(placed, shards, "shard"), "shard").mapInArrow(_blobs(_tree, ("shard", "tree")), "shard int, tree binary"))
    dealt = own(asked, blocks, "block")
    # a block's home is a shard of its cell, or any where the cell has no row
    homes = blocks.select("cell", F.explode(F.sequence("start", F.col("start") + F.col("parts") - 1)).alias("block")).join(shards.select("cell", F.col("start").alias("s"), F.col("parts").alias("p")), "cell", "left")
    homes = homes.select("block", F.coalesce(F.col("s") + F.pmod("block", "p"), F.pmod("block", F.lit(n_shards))).cast("int").alias("home"))
    made = staged(grouped(dealt, "block").mapInArrow(_blobs(_block, ("block", "queries")), "block int, queries binary").join(homes, "block"))

    part = F.floor(F.col("block") / BLOCKS_A_TASK).cast("int").alias("part")
    first = staged(_through(made.select(F.col("home").alias("shard"), part, "queries"), trees, k))
    known = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("known")).where(F.col("n") == k)
    known = dealt.select("block", F.col("id").alias("query_id")).join(known, "query_id").groupBy("block").agg(F.collect_list(F.struct("query_id", "known")).alias("of"))  # about QUERY_BLOCK a block
    carried = made.join(known, "block", "left").select("block", "queries", F.col("of.query_id").alias("ids"), F.col("of.known").alias("known")).mapInArrow(_with_known, "block int, queries binary")
    everywhere = carried.join(homes, "block").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).where(F.col("shard") != F.col("home"))
    rest = _through(everywhere.select("shard", part, "queries"), trees, k)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
