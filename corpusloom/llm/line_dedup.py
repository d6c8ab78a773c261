"""Cross-site line deduplication by distinct-site spread; DataFrame functions only.

A line (trimmed, not blank) that stands on at least ``min_sites`` distinct sites is boilerplate. It
stays in the document with the smallest id that has it, so no content is lost, and goes from all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._common import staged

MIN_SITES = 10
#: Sketches of 2**8 registers: a relative standard error of 1.04 / 16.
LG_K = 8
#: Estimates this near the threshold, in relative terms, are counted exactly: over 3.8 standard errors.
NEAR = 0.25


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _h1(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _row_key(key: Column, text: Column) -> tuple[Column, Column]:
    """128 bits that tell rows apart; rows that agree in id and text share all decisions."""
    return F.xxhash64(key, text), F.xxhash64(F.lit("row"), text, key.isNull(), key)


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """``h1, h2, keep_doc`` of the lines that ``lines(doc, site, h1, h2)`` has on ``min_sites`` sites or more.

    One aggregation merges a HyperLogLog sketch of sites per line hash (partial sketches are built
    before the shuffle, so a line on every page is a few rows). Clear cases are decided by the
    estimate; lines near the threshold are counted exactly. Null sites count for nothing.
    """
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.count("site").alias("n"), F.min("doc").alias("keep_doc")
    )
    likely = staged(spread.where((F.col("n") >= min_sites) & (F.col("sites") >= min_sites * (1 - NEAR))))
    sure = likely.where(F.col("sites") > min_sites * (1 + NEAR)).select("h1", "h2", "keep_doc")
    near = likely.where(F.col("sites") <= min_sites * (1 + NEAR)).select("h1", "h2", "keep_doc")
    exact = (
        lines.join(near, ["h1", "h2"]).groupBy("h1", "h2", "keep_doc", "site").agg(F.count("*").alias("n"))
        .groupBy("h1", "h2", "keep_doc").agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites)
    )
    return sure.unionByName(exact.select("h1", "h2", "keep_doc"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, key: str = "doc_id", site: str = "source", text: str = "text") -> DataFrame:
    """``row, n_lines, n_removed``: each row of ``docs`` as a struct with cleaned text (so that no name can clash), how
    many lines it had, and how many are gone.

    All rows stay, also those left without a line (text ``''``). Null and empty texts stay as they
    are with 0 lines. Rows that repeat an id keep a line alike. Blank lines are never removed. A null
    id sorts after every other; where all ids of a line are null, all keep it.
    """
    k1, k2 = _row_key(F.col(key), F.col(text))
    lines = staged(
        docs.select(k1.alias("k1"), k2.alias("k2"), F.col(key).alias("doc"), F.col(site).alias("site"), F.explode(_lines(F.col(text))).alias("line"))
        .where(F.trim("line") != "")
        .select("k1", "k2", "doc", F.col("site").cast("string").alias("site"), _h1(F.col("line")).alias("h1"), F.xxhash64(F.lit("line"), F.trim("line")).alias("h2"))
    )
    removed = staged(
        lines.join(boilerplate(lines, min_sites), ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("keep_doc")))
        .groupBy("k1", "k2").agg(F.collect_set("h1").alias("gone"))
        .select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("gone").alias("_gone"))
    )
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), k1.alias("_a1"), k2.alias("_a2"))
    joined = whole.join(removed, (F.col("_a1") == F.col("_k1")) & (F.col("_a2") == F.col("_k2")), "left")
    old = F.col("row")[text]
    kept = F.filter(_lines(old), lambda x: ~F.array_contains(F.col("_gone"), _h1(x)))
    n_lines = F.when(F.coalesce(old, F.lit("")) == "", 0).otherwise(F.size(_lines(old))).cast("long")
    out = joined.select("row", F.when(F.col("_gone").isNotNull(), kept).alias("kept"), n_lines.alias("n_lines"))
    clean = F.when(F.col("kept").isNull(), old).otherwise(F.array_join("kept", "\n"))
    columns = [clean.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns]
    return out.select(F.struct(*columns).alias("row"), "n_lines", F.when(F.col("kept").isNull(), 0).otherwise(F.col("n_lines") - F.size("kept")).cast("long").alias("n_removed"))
