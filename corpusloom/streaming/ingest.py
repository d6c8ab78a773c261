"""File streams of JSON lines. Everything row-local runs unchanged on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import template
from corpusloom.operators import examples
from corpusloom.sources import jsonl


def line_stream(spark: SparkSession, path: str, files_a_trigger: int = 16) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_a_trigger).text(path)


def pretrain_stream(lines: DataFrame, max_length: int, field: str = "text") -> DataFrame:
    """``text, ids`` of accepted lines; rejects are left out (see :func:`reject_stream`)."""
    ok = lines.where(jsonl.classify(F.col("value"), field) == "ok").select(jsonl.coerce_text(F.col("value"), field).alias("text"))
    return ok.withColumn("ids", examples.byte_tokens(template.wrap_text(F.col("text")), max_length))


def reject_stream(lines: DataFrame, field: str = "text") -> DataFrame:
    reason = jsonl.classify(F.col("value"), field)
    return lines.select("value", reason.alias("reason")).where("reason <> 'ok'")


def write_parquet(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Start an exactly-once file sink; a restart goes on from the checkpoint."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def for_each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Run what needs a whole batch (ranks, batch plans) on each micro-batch."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
