"""JSON-lines sources with a strict and a lenient error policy.

Both keep the raw line, so the policy is a column expression and not a reader's side effect.
``try_parse_json`` decides validity; it also turns down duplicate keys and ``NaN``, which some parsers take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CONVERSATION = "struct<conversations:array<struct<role:string,content:string>>>"
PREFERENCE = "struct<prompt:string,chosen:string,rejected:string>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no`` (from 0, by file and place) and ``value``.

    A task's ids are consecutive, so a line's place in its file split is its id less the split's smallest; only the table of splits is
    ordered as a whole, and lines stay where they were read.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    before = Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("f", "b").agg(F.count("*").alias("n"), F.min("m").alias("first")).select("f", "b", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return lines.join(splits, ["f", "b"]).select((F.col("m") + F.col("shift")).alias("line_no"), "value")


def is_json(value: Column) -> Column:
    return F.try_parse_json(F.trim(value)).isNotNull()


def has_field(value: Column, field: str) -> Column:
    return F.array_contains(F.json_object_keys(value), field)


def coerce_text(value: Column, field: str) -> Column:
    """A field as text: null is ``None``, booleans ``True`` and ``False``, numbers as they are written;
    nested values keep their JSON form with spaces after commas and colons."""
    v = F.try_variant_get(F.try_parse_json(value), f"$.{field}", "variant")
    raw = F.get_json_object(value, f"$.{field}")
    kind = F.schema_of_variant(v)
    return (
        F.when(~has_field(value, field), F.lit(None).cast("string")).when(F.is_variant_null(v), F.lit("None")).when(kind == "BOOLEAN", F.initcap(raw))
        .otherwise(raw)
    )


def _strict(lines: DataFrame) -> Column:
    return F.when(is_json(F.col("value")), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("malformed or blank line "), F.col("line_no").cast("string"))).cast("string"))


def _checked(made: Column, *needed: Column) -> Column:
    bad = made.isNull()
    for n in needed:
        bad = bad | n.isNull()
    return F.when(~bad, made).otherwise(F.raise_error(F.lit("a line lacks a field")).cast("string"))


def read_pretrain(spark: SparkSession, path: str, field: str = "text") -> DataFrame:
    """``line_no, text``; the load fails on a malformed or blank line, or one without the field."""
    lines = read_lines(spark, path)
    lines = lines.withColumn("value", _strict(lines))
    return lines.select("line_no", _checked(coerce_text(F.col("value"), field)).alias("text"))


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, messages``; strict."""
    lines = read_lines(spark, path)
    parsed = F.from_json(_strict(lines), CONVERSATION, {"mode": "FAILFAST"})
    return lines.select("line_no", parsed["conversations"].alias("messages"))


def read_preferences(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, prompt, chosen, rejected``; strict."""
    lines = read_lines(spark, path)
    parsed = F.from_json(_strict(lines), PREFERENCE, {"mode": "FAILFAST"})
    out = lines.select("line_no", parsed.alias("p"))
    return out.select("line_no", *[_checked(F.col(f"p.{c}")).alias(c) for c in ("prompt", "chosen", "rejected")])


def classify(value: Column, field: str) -> Column:
    """``ok``, ``malformed``, ``no_object`` or ``missing``."""
    return (
        F.when(~F.coalesce(is_json(value), F.lit(False)), "malformed").when(F.json_object_keys(value).isNull(), "no_object")
        .when(~has_field(value, field), "missing").otherwise("ok")
    )


def lenient(lines: DataFrame, field: str = "text", max_samples: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted rows ``line_no, text`` and rejected ones ``line_no, value, reason`` of ``lines(line_no, value)``.

    ``max_samples`` bounds physical lines, not accepted ones; 0 and None mean all. A top-level value that is no object is
    rejected.
    """
    if max_samples:
        lines = lines.where(F.col("line_no") < max_samples)
    marked = lines.withColumn("reason", classify(F.col("value"), field))
    return marked.where("reason = 'ok'").select("line_no", coerce_text(F.col("value"), field).alias("text")), marked.where("reason <> 'ok'").select("line_no", "value", "reason")


def read_lenient(spark: SparkSession, path: str, field: str = "text", max_samples: int | None = None) -> tuple[DataFrame, DataFrame]:
    return lenient(read_lines(spark, path), field, max_samples)


def iterate_texts(spark: SparkSession, path: str, field: str = "text"):
    """Texts one by one on the driver, a partition at a time."""
    for row in read_pretrain(spark, path, field).select("text").toLocalIterator(prefetchPartitions=False):
        yield row.text


def prompts(rows: DataFrame, text: str = "value", quit_words: tuple[str, ...] = ("quit", "exit", "退出")) -> DataFrame:
    """Interactive input as a table ``(line_no, text)``: trimmed, empty lines skipped, everything from the first quit word on left out."""
    trimmed = rows.select("line_no", F.trim(text).alias("text"))
    stop = trimmed.where(F.lower("text").isin(*quit_words)).agg(F.min("line_no").alias("stop"))
    return trimmed.crossJoin(F.broadcast(stop)).where((F.col("text") != "") & (F.col("stop").isNull() | (F.col("line_no") < F.col("stop")))).drop("stop")  # one row
