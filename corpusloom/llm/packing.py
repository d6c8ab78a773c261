"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Documents are dealt to packing shards of about ``ITEMS_A_SHARD`` pieces. In a shard, pieces go longest
first; open bins are ordered by what room they have left and carry bitmaps of the sources and duplicate
clusters inside. A piece goes into the tightest bin that has room, does not have its cluster, and has its source less
often than the source's quota: the search goes on from one residual to the next until such a bin is
found, or opens a new bin.

A source's quota is 1, unless it has more pieces than the fewest bins that could hold the shard: then
it is as many as fall on one such bin, rounded up. A source has as many bits as its quota, so a hot one
does not leave bins half empty.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._common import staged

CAPACITY = 2_048
ITEMS_A_SHARD = 20_000


class Bins:
    """Open bins by residual; bins of one residual by their bitmap of sources."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
        self.filled = 0  # bit r: there is an open bin with residual r
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.left: list[int] = []

    def find(self, need: int, source: int, cluster: int) -> int | None:
        """The tightest compatible bin, of several the oldest; ``source`` are the source's bits, ``cluster`` the cluster's (0: none)."""
        ahead = self.filled >> need
        at = need
        while ahead:
            step = (ahead & -ahead).bit_length() - 1
            at += step
            found = None
            for bitmap, bins in self.open[at].items():
                if not source or bitmap & source != source:
                    for b in bins:
                        if not self.clusters[b] & cluster:
                            found = b if found is None else min(found, b)
                            break
            if found is not None:
                return found
            ahead >>= step + 1
            at += 1
        return None

    def place(self, need: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin that takes a piece, and the piece's offset in it."""
        b = self.find(need, source, cluster)
        if b is None:
            b = len(self.left)
            self.left.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        else:
            at = self.open[self.left[b]]
            bins = at[self.sources[b]]
            bins.remove(b)
            if not bins:
                del at[self.sources[b]]
                if not at:
                    self.filled &= ~(1 << self.left[b])
        offset = self.capacity - self.left[b]
        self.left[b] -= need
        free = source & ~self.sources[b]
        self.sources[b] |= free & -free
        self.clusters[b] |= cluster
        if self.left[b]:
            bins = self.open[self.left[b]].setdefault(self.sources[b], [])
            at = len(bins)
            while at and bins[at - 1] > b:
                at -= 1
            bins.insert(at, b)
            self.filled |= 1 << self.left[b]
        return b, offset


def quotas(items: list[tuple[int, object, object]], capacity: int) -> dict[object, int]:
    """How often a bin may have each source."""
    fewest = max(1, -(-sum(n for n, _, _ in items) // capacity))
    return {s: max(1, -(-n // fewest)) for s, n in Counter(s for _, s, _ in items).items()}


def pack_items(items: list[tuple[int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each (length, source, cluster), longest first, equal ones in the order given."""
    quota = quotas(items, capacity)
    often = {c for c, n in Counter(c for _, _, c in items if c is not None).items() if n > 1}
    bit: dict = {}
    counts = {"s": 0, "c": 0}

    def mark(kind: str, x: object, n_bits: int = 1) -> int:
        if (kind, x) not in bit:
            bit[kind, x] = ((1 << n_bits) - 1) << counts[kind]
            counts[kind] += n_bits
        return bit[kind, x]

    bins, out = Bins(capacity), [(0, 0)] * len(items)
    for i in sorted(range(len(items)), key=lambda i: -items[i][0]):
        n, source, cluster = items[i]
        out[i] = bins.place(n, mark("s", source, quota[source]) if source is not None else 0, mark("c", cluster) if cluster in often else 0)
    return out


def pack(docs: DataFrame, length: Column, key: str = "doc_id", source: str = "source", cluster: Column | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``key, piece, start, length, bin_id, offset``: every document's pieces and where they lie.

    A document longer than ``capacity`` is cut; all its pieces but the last fill bins of their own. No
    bin has two pieces of one cluster, or more of one source than its quota (null ones conflict with nothing). Documents of length
    0 or null get one row of length 0 without a bin. Rows that repeat are packed each. Pieces of equal length are taken in an order that, like
    the shard a row goes to, depends on where the rows lie in the input; another layout of the same rows may pack them otherwise.
    """
    cluster = F.lit(None).cast("long") if cluster is None else cluster
    pieces = docs.select(F.col(key).alias("k"), F.col(source).cast("string").alias("s"), cluster.alias("c"), F.coalesce(length, F.lit(0)).cast("int").alias("total"))
    pieces = pieces.select("k", "s", "c", "total", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("total") / capacity).cast("int") - 1, F.lit(0)))).alias("piece"))
    pieces = staged(pieces.select("k", "s", "c", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.col("total") - F.col("piece") * capacity, F.lit(capacity)).alias("n"), F.xxhash64(F.monotonically_increasing_id()).alias("r")))
    shards = max(1, -(-pieces.where("n > 0").count() // ITEMS_A_SHARD))
    kind, ckind = docs.schema[key].dataType.simpleString(), pieces.schema["c"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corpusloom.llm.jaccard_join import _groups

        for g in _groups(batches, 1):
            placed = pack_items(list(zip(*(g.column(i).to_pylist() for i in (5, 2, 3)), strict=True)), capacity)
            shard = g.column(0)[0].as_py()
            bins, offsets = zip(*placed, strict=True)
            yield pa.RecordBatch.from_arrays(
                [g.column(1), g.column(4), g.column(6), g.column(5), pa.array([(shard << 32) + b for b in bins], pa.int64()), pa.array(offsets, pa.int32())],
                names=["k", "piece", "start", "length", "bin_id", "offset"],
            )

    dealt = pieces.where("n > 0").select(F.pmod("r", F.lit(shards)).alias("shard"), "k", "s", "c", "piece", "n", "start", "r").repartition("shard").sortWithinPartitions("shard", F.desc("n"), "r").drop("r")
    packed = dealt.mapInArrow(run, f"k {kind}, piece int, start int, length int, bin_id long, offset int")
    empty = pieces.where("n = 0").select("k", "piece", "start", F.col("n").alias("length"), F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("offset"))
    return packed.unionByName(empty).withColumnRenamed("k", key)
