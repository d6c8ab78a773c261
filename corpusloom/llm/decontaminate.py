"""Benchmark decontamination by spaced seeds; DataFrame functions only.

Words are runs of letters and digits, lower-cased. The masks pick any four of five words in a row and ignore the fifth.
A window of ``WINDOW`` words that agrees in ``AGREE`` of them has a fifth of its words replaced at most, so of the
runs of five that lie in it side by side one has no more than one replaced: every window that passes the check is hit by
a mask, wherever its replaced words are. Every hit is then verified word by word: some window of ``WINDOW`` words around it
must agree in at least ``AGREE`` of them. Shorter items are one window as a whole; of
those of fewer words than a mask every word must agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._common import staged

#: Fixed seeds: 1 is a word that must agree, 0 one that is ignored.
MASKS = ("01111", "10111", "11011", "11101", "11110")
SPAN = len(MASKS[0])
WINDOW = 15
AGREE = 0.8
#: Items of fewer words than SPAN are sought as a whole; of fewer than SHORTEST (none at all) not.
SHORTEST = 1
#: Seeds in one broadcast: each row takes some 200 bytes. More seeds are sought in further passes.
SEEDS_A_PASS = 200_000
#: Positions of a document that are looked up together; with them go the words around them, never the whole document.
PIECE = 256


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _seed(hashes: Column, at: Column, mask: str) -> Column:
    return F.xxhash64(F.lit(mask), *[F.get(hashes, at + o) for o, bit in enumerate(mask) if bit == "1"])


def _positions(n: Column, span: int, first: int = 0) -> Column:
    return F.when(n >= span, F.sequence(F.lit(first), n - span)).otherwise(F.array().cast("array<int>"))


def seeds(items: DataFrame) -> DataFrame:
    """``seed, item, j, around, lead, window, short`` of ``items(item, h)``.

    ``around`` are the item's word hashes near the seed, ``lead`` the seed's place in them.
    """
    reach = WINDOW - SPAN
    n = F.size("h")
    long = (
        items.where(n >= SPAN).select("item", "h", F.explode(_positions(n, SPAN)).alias("j"))
        .select("item", "j", F.slice("h", F.greatest(F.col("j") - reach, F.lit(0)) + 1, SPAN + 2 * reach).alias("around"), F.least("j", F.lit(reach)).alias("lead"), F.least(n, F.lit(WINDOW)).alias("window"),
                F.explode(F.array(*[_seed(F.col("h"), F.col("j"), m) for m in MASKS])).alias("seed"))
    )
    short = items.where((n >= SHORTEST) & (n < SPAN)).select("item", F.lit(0).alias("j"), F.col("h").alias("around"), F.lit(0).alias("lead"), n.alias("window"), F.xxhash64(F.lit("whole"), F.col("h")).alias("seed"))
    return long.unionByName(short)


def _agreeing(window_start: Column) -> Column:
    """Agreeing words in the window that begins at this place of ``around``."""
    return F.aggregate(
        F.sequence(window_start, window_start + F.col("window") - 1), F.lit(0),
        lambda acc, k: acc + F.coalesce(F.get("there", k) == F.get("around", k), F.lit(False)).cast("int"),
    )


def find_overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``key, item, n_hits, matched, doc_from, doc_to``: one row per document and benchmark item that overlap.

    ``n_hits`` counts verified (document position, item position) hits, ``matched`` is the most
    agreeing words in a window, ``doc_from`` to ``doc_to`` the words between the first and the last
    hit. Documents with equal ids count as one. Items with equal words are sought once and reported
    each. Null and empty texts on either side overlap nothing; very long ones are looked up piece by piece, in the same way at every
    place. Of windows that agree in equally many words ``matched`` is that number. Documents are read where they lie; only hits move.
    """
    prepared = staged(benchmark.select(F.col(item).alias("item"), word_hashes(F.coalesce(F.col(item_text), F.lit(""))).alias("h")).where(F.size("h") >= SHORTEST).withColumn("w", F.xxhash64("h")))
    unique = prepared.groupBy("w").agg(F.first("h").alias("h")).withColumnRenamed("w", "item")
    all_seeds = staged(seeds(unique).withColumn("block", F.pmod(F.xxhash64("item", "j"), F.lit(1 << 30))))
    passes = max(1, -(-all_seeds.count() // SEEDS_A_PASS))
    lengths = sorted(r.n for r in prepared.where(F.size("h") < SPAN).select(F.size("h").alias("n")).distinct().collect())  # SPAN - SHORTEST at most

    # from position -1 on: the first or the last word of an item of SPAN words may be the one that is missing, beyond an end of the document
    reach = WINDOW - SPAN
    hashed = docs.select(F.col(key).alias("k"), word_hashes(F.col(text)).alias("h")).where(F.size("h") >= SHORTEST)
    begin = lambda c: F.greatest(c * PIECE - 1 - reach, F.lit(0))
    pieces = hashed.select("k", F.size("h").alias("n"), F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("h") / PIECE).cast("int")), lambda c: F.struct(
        (c * PIECE - 1).alias("at"), begin(c).alias("lo"), F.slice("h", begin(c) + 1, (c + 1) * PIECE + SPAN + reach - begin(c)).alias("h")
    ))).alias("p"))
    windows = pieces.select("k", "n", "p.lo", "p.h", F.explode(F.sequence("p.at", F.least(F.col("p.at") + PIECE, F.col("n")) - 1)).alias("i"))
    here = F.col("i") - F.col("lo")  # the position's place in its piece
    tried = [
        F.when((F.col("i") + m.index("1") >= 0) & (F.col("i") + m.rindex("1") < F.col("n")), _seed(F.col("h"), here, m)) for m in MASKS
    ]  # null, which hits nothing, where words that must agree lie beyond an end
    tried += [F.when((F.col("i") >= 0) & (F.col("i") + m <= F.col("n")), F.xxhash64(F.lit("whole"), F.slice("h", F.greatest(here, F.lit(0)) + 1, m))) for m in lengths]
    tried = windows.select("k", "n", "lo", "h", "i", F.explode(F.array(*tried)).alias("seed"))

    found = None
    for p in range(passes):
        block = all_seeds.where(F.pmod("block", F.lit(passes)) == p).drop("block")
        over = (F.col("i") < 0) | (F.col("i") + F.least("window", F.lit(SPAN)) > F.col("n"))
        hits = tried.join(F.broadcast(block), "seed").where(~over | (F.col("window") == SPAN))  # longer items are hit elsewhere, too; at most about SEEDS_A_PASS rows, however large the benchmark
        # null in ``there``, the document's words beside ``around``, is a place outside the document
        before = F.greatest(F.col("lead") - F.col("i"), F.lit(0))
        there = F.concat(F.array_repeat(F.lit(None).cast("long"), before), F.slice("h", F.greatest(F.col("i") - F.col("lead"), F.lit(0)) - F.col("lo") + 1, F.size("around") - before))
        last = F.least(F.col("i") + F.least("window", F.lit(SPAN)), F.col("n")) - 1
        near = hits.select("k", "item", "i", "j", "window", "lead", "around", there.alias("there"), last.alias("last"))
        found = near if found is None else found.unionByName(near)
    # one row for each place that any mask hits
    places = found.groupBy("k", "item", "i", "j", "window", "lead", "last").agg(F.first("around").alias("around"), F.first("there").alias("there"))
    starts = F.sequence(F.lit(0), F.greatest(F.least(F.col("lead"), F.size("around") - F.col("window")), F.lit(0)))
    best = places.select("k", "item", "i", "last", "window", F.array_max(F.transform(starts, _agreeing)).alias("matched"))
    found = best.where(F.col("matched") >= F.ceil(F.col("window") * AGREE))
    pairs = found.groupBy("k", "item").agg(F.count("*").alias("n_hits"), F.max("matched").alias("matched"), F.greatest(F.min("i"), F.lit(0)).alias("doc_from"), F.max("last").alias("doc_to"))
    named = prepared.select(F.col("w").alias("item"), F.col("item").alias("name"))
    return pairs.join(named, "item").select(F.col("k").alias(key), F.col("name").alias(item), "n_hits", "matched", "doc_from", "doc_to")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item. Rows are told apart by id and text; null ids are kept apart by their text."""
    mark = F.struct(F.xxhash64(F.col(key), F.col(text)).alias("a"), F.xxhash64(F.lit("row"), F.col(text), F.col(key)).alias("b"))
    hits = staged(find_overlaps(docs.select(mark.alias("_mark"), F.col(text).alias("_t")), benchmark, "_mark", "_t", item, item_text).select("_mark").distinct())
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), mark.alias("_own"))
    return whole.join(hits, F.col("_own") == F.col("_mark"), "left_anti").select("row.*")
