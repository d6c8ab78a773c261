"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._common import stage_mark, staged, superseded

#: Parts into which the rows of one key are dealt, so that a hub's rows meet in no single task.
SALTS = 256


def attached(rows: DataFrame, key: str, spread: str, partial: dict[str, Column], merged: dict[str, Column]) -> DataFrame:
    """``rows`` with aggregates over all rows of their ``key``: ``partial`` ones by key and part, ``merged`` ones of these by key.

    Rows of a key are dealt to parts by ``spread``. The merged row goes only to parts that the key has, so there are never more of them than rows.
    """
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    parts = dealt.groupBy(key, "_part").agg(*[c.alias(n) for n, c in partial.items()])
    whole = parts.groupBy(key).agg(*[c.alias(n) for n, c in merged.items()], F.collect_list("_part").alias("_parts"))  # SALTS numbers at most
    return dealt.join(whole.select(key, *merged, F.explode("_parts").alias("_part")), [key, "_part"]).drop("_part")


def _with_least(edges: DataFrame) -> DataFrame:
    """``u, v, m`` of ``edges(u, v)``: m is the smallest v of u."""
    return attached(edges, "u", "v", {"m": F.min("v")}, {"m": F.min("m")})


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every end of ``edges(u, v)``; root is the smallest node of the component.

    Each step is an aggregation and a join on a node and a part of its edges, so a node with very many edges is combined
    before the shuffle and its edges are spread over tasks. The number of steps grows with the
    logarithm of the component sizes. Each round is written to the shared folder, and the round before it deleted.
    """
    mark = stage_mark()
    now = staged(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    digest = lambda e: tuple(e.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    before = digest(now)
    while before[0]:
        both = _with_least(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = both.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        lower = _with_least(large.where(F.col("u") != F.col("v")))
        small = lower.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = staged(small.where(F.col("u") != F.col("v")).distinct())
        after = digest(now)
        superseded(edges.sparkSession, mark)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
