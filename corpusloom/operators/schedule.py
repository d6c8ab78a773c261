"""Batches, accumulation, learning rate, saving and resuming, planned as tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Rows that one task ranks, about.
RANKED_ROWS = 1 << 16


def total_steps(epochs: int, n: int | Column, batch_size: int, accumulation: int) -> int | Column:
    """Updates of a run over n rows: a number, or a column of them."""
    if isinstance(n, Column):
        return F.greatest(F.floor(epochs * F.ceil(n / batch_size) / accumulation), F.lit(1)).cast("long")
    return max(1, epochs * -(-n // batch_size) // accumulation)


def learning_rate(step: Column, total: int, lr: float, warmup_ratio: float = 0.1) -> Column:
    """Linear warm-up, then a cosine down to a tenth; steps are held to 1 .. ``total``; no total: ``lr``."""
    if total <= 0:
        return F.lit(float(lr))
    warm = int(total * warmup_ratio)
    s = F.greatest(F.least(step, F.lit(total)), F.lit(1)).cast("double")
    low = 0.1 * lr
    progress = (s - warm) / float(max(1, total - warm))
    cosine = F.lit(low) + (F.cos(progress * math.pi) + 1.0) * (0.5 * (lr - low))
    return F.when((F.lit(warm) > 0) & (s <= warm), s * (lr / max(1, warm))).otherwise(cosine)


def order_key(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key.cast("string")))


def global_rank(rows: DataFrame, key: str, digits: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``rank`` from 0 in the order of a hex string column, without one task that sees all rows.

    The first ``digits`` of the string split the rows into ranges in order; each is ranked by itself and shifted by those before it.
    """
    part = F.substring(key, 1, digits)
    ranged = rows.withColumn("_part", part)
    sizes = ranged.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_part").orderBy(key)
    ranked = ranged.withColumn("_r", F.row_number().over(inside))
    return ranked.join(starts, [*by, "_part"]).withColumn("rank", F.col("_start") + F.col("_r") - 1).drop("_part", "_r", "_start")


def batch_plan(rows: DataFrame, key: str, batch_size: int, seed: int, epochs: int = 1) -> DataFrame:
    """``epoch, key, rank, batch_id``: every epoch in an order that seed, epoch and key decide; the last batch may be short.

    Unlike a random permutation, a restart or another engine gives the same order.
    """
    epoch = F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch")
    keyed = rows.select(key, epoch).withColumn("_order", order_key(seed, F.col("epoch"), F.col(key)))
    digits = max(2, math.ceil(math.log(max(1, rows.count()) / RANKED_ROWS, 16)))  # as many ranges as the rows need
    ranked = global_rank(keyed, "_order", digits, by=("epoch",))
    return ranked.select("epoch", key, "rank", F.floor(F.col("rank") / batch_size).cast("long").alias("batch_id"))


def steps(spark: SparkSession, epochs: int, n_batches: int) -> DataFrame:
    return spark.range(epochs * n_batches).select((F.col("id") / n_batches).cast("int").alias("epoch"), (F.col("id") % n_batches).cast("int").alias("step"))


def accumulation(plan: DataFrame, n_batches: int, every: int) -> DataFrame:
    """``plan(epoch, step)`` with ``boundary``, ``flush`` (a part window at an epoch's end), ``global_step`` (updates done after the step)
    and ``lr_step`` (at which the step's rate is taken: the updates before it, 1 at least).

    Counts follow from epoch and step, so nothing is ordered.
    """
    per_epoch = -(-n_batches // every)
    boundary = (F.col("step") + 1) % every == 0
    flush = (F.col("step") == n_batches - 1) & ~boundary
    done = F.col("epoch") * per_epoch + F.floor((F.col("step") + 1) / every) + flush.cast("int")
    before = F.col("epoch") * per_epoch + F.floor(F.col("step") / every)
    return plan.select("epoch", "step", boundary.alias("boundary"), flush.alias("flush"), done.cast("long").alias("global_step"), F.greatest(before, F.lit(1)).cast("long").alias("lr_step"))


def save_points(planned: DataFrame, save_step: int) -> DataFrame:
    """Steps at which a checkpoint is written. Updates at an epoch's end come after the test, and a
    saved update is saved again by each step until the next update."""
    tested = F.col("global_step") - F.col("flush").cast("int")
    return planned.where((tested > 0) & (tested % save_step == 0)).select("epoch", "step", tested.cast("long").alias("global_step"))


def epoch_saves(spark: SparkSession, epochs: int, n_batches: int, every: int) -> DataFrame:
    """The manifest rows written after each epoch: the next epoch, step 0."""
    return spark.range(epochs).select((F.col("id") + 1).cast("int").alias("epoch"), F.lit(0).alias("step"), ((F.col("id") + 1) * -(-n_batches // every)).cast("long").alias("global_step"))


def resume(planned: DataFrame, epoch: int, step: int) -> DataFrame:
    """What runs after a restart: the stored step is the last finished one, and it is run again."""
    return planned.where((F.col("epoch") > epoch) | ((F.col("epoch") == epoch) & (F.col("step") >= step)))


def reported_loss(losses: DataFrame, every: int) -> DataFrame:
    """``epoch, loss``: the last micro-batch's loss, scaled back; no average."""
    return losses.groupBy("epoch").agg((F.max_by("loss", "step") * every).alias("loss"))
