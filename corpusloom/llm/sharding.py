"""Weighted rendezvous sharding of stable record keys, with gapless slots in every shard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm._common import staged

#: Hash values are the first 13 hex digits of an MD5, that is 52 bits: exact in a double.
HASH_DIGITS = 13
ROWS_A_BUCKET = 50_000


def _hash52(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("long")


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest score ``weight / -ln(u(key, shard))`` (ties: the smaller shard).

    ``u`` depends on the key and the shard's number alone, so adding shard n leaves every score of
    the shards before it as it was: rows move into the new shard only, in proportion to its weight.
    Null keys hash as the empty string with a mark of their own.
    """
    key = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    scores = []
    for shard, weight in enumerate(weights):
        if weight <= 0:
            raise ValueError("shard weights must be positive")
        u = (_hash52(F.concat(key, F.lit(f":{shard}"))) + 0.5) / float(1 << 4 * HASH_DIGITS)
        scores.append(F.struct((F.lit(float(weight)) / -F.log(u)).alias("score"), F.lit(-shard).alias("shard")))
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    return (-best["shard"]).cast("int")


def assign_shards(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, slot, and the shard under one shard more for every row of ``docs``.

    Columns: key, size, text_crc32, law, shard, slot, grown_shard. ``size`` is the UTF-8 length of the
    text (null: 0) plus 1; the checksum of a null text is that of the empty one. Slots number the rows
    of a shard from 0 without gaps, in the order of a hash of (key, checksum, size); repeated rows get
    neighbouring slots. The row order inside a shard is dealt to hash ranges of about
    ``ROWS_A_BUCKET`` rows, ranked per range and shifted by the ranges before it, so no task holds a
    shard. Identical rows are counted before the shuffle, which keeps a hot key out of one task.
    An empty table gives an empty result; other columns of ``docs`` are ignored.
    """
    source = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    base = staged(
        source.select(
            "k",
            (F.octet_length("t") + 1).cast("long").alias("size"),
            F.crc32(F.col("t").cast("binary")).alias("crc"),
            rendezvous(F.col("k"), weights).alias("shard"),
            rendezvous(F.col("k"), [*weights, sum(weights) / len(weights)]).alias("grown"),
        ).withColumn("h", _hash52(F.concat_ws(":", F.col("k").cast("string"), "crc", "size")))
    )
    n, bits = base.count(), 0
    while (len(weights) * ROWS_A_BUCKET) << bits < n and bits < 40:
        bits += 1
    part = F.shiftright("h", 4 * HASH_DIGITS - bits) if bits else F.lit(0).cast("long")
    keys = ["shard", "part", "h", "k", "size", "crc", "grown"]
    same = base.withColumn("part", part).groupBy(*keys).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        base.withColumn("part", part).groupBy("shard", "part").agg(F.count("*").alias("m"))
        .select("shard", "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("shard", "part").orderBy("h", "k", "crc", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = same.withColumn("upto", F.sum("n").over(inside)).join(starts, ["shard", "part"])
    first = F.col("start") + F.col("upto") - F.col("n")
    return ranked.select(
        F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard",
        F.explode(F.sequence(first, first + F.col("n") - 1)).alias("slot"), F.col("grown").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], key: str = "doc_id") -> None:
    """Write the records themselves, one folder per shard (``shard=0`` ...), without a shuffle."""
    if "shard" in docs.columns:
        raise ValueError("docs has a column named shard already")
    docs.withColumn("shard", rendezvous(F.col(key), weights)).write.partitionBy("shard").parquet(path)
