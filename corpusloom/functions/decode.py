"""Next-token operators in long form: one row for each (sequence, token) with its logit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def long_logits(rows: DataFrame, seq: str, logits: str) -> DataFrame:
    return rows.select(F.col(seq), F.posexplode(logits).alias("token_id", "logit")).withColumn("logit", F.col("logit").cast("double"))


def repetition_penalty(logits: DataFrame, seen: DataFrame, seq: str, penalty: float) -> DataFrame:
    """Divide the logits of tokens that ``seen(seq, token_id)`` has. Negative logits rise by that; prompt and pad tokens count as seen."""
    if penalty == 1.0:
        return logits
    marks = seen.select(seq, "token_id").distinct().withColumn("_seen", F.lit(True))
    return logits.join(marks, [seq, "token_id"], "left").withColumn("logit", F.when(F.col("_seen"), F.col("logit") / penalty).otherwise(F.col("logit"))).drop("_seen")


def penalised(logits: Column, seen: Column, penalty: float) -> Column:
    """The array form of :func:`repetition_penalty`."""
    return F.transform(logits, lambda x, i: F.when(F.array_contains(seen, i), x / penalty).otherwise(x))


def probabilities(logits: DataFrame, seq: str, temperature: float = 1.0) -> DataFrame:
    """Add ``prob`` at a temperature over 0."""
    w = Window.partitionBy(seq)
    x = F.col("logit") / temperature
    out = logits.withColumn("_x", x - F.max(x).over(w))
    return out.withColumn("prob", F.exp("_x") / F.sum(F.exp("_x")).over(w)).drop("_x")


def nucleus(probs: DataFrame, seq: str, top_p: float | None) -> DataFrame:
    """Keep tokens by falling probability (ties: the smaller id) up to and with the one that takes the sum past ``top_p``."""
    if top_p is None or top_p >= 1.0:
        return probs
    w = Window.partitionBy(seq).orderBy(F.desc("prob"), "token_id")
    before = F.sum("prob").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return probs.withColumn("_before", before).where(F.coalesce(F.col("_before") <= top_p, F.lit(True))).drop("_before")


def greedy(logits: DataFrame, seq: str) -> DataFrame:
    """The token of the highest logit, the smallest id of several: one partial aggregation, no sort."""
    best = F.max(F.struct(F.col("logit"), (-F.col("token_id")).alias("t"))).alias("b")
    return logits.groupBy(seq).agg(best).select(seq, (-F.col("b.t")).cast("int").alias("token_id"))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on seed and keys alone: 48 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def sample(probs: DataFrame, seq: str, seed: int, step: int = 0) -> DataFrame:
    """Inverse-CDF sampling: the first token, by id, whose running share reaches a seeded uniform number.

    A run repeats exactly; it follows no other library's random numbers.
    """
    w = Window.partitionBy(seq).orderBy("token_id")
    total = F.sum("prob").over(Window.partitionBy(seq))
    upto = F.sum("prob").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ready = probs.withColumn("_upto", upto / total).withColumn("_u", uniform(seed, F.col(seq), F.lit(step)))
    reached = F.min(F.when(F.col("_upto") >= F.col("_u"), F.col("token_id")))
    return ready.groupBy(seq).agg(F.coalesce(reached, F.max("token_id")).cast("int").alias("token_id"))


def eos_padded(trace: DataFrame, seq: str, step: str, token: str, eos: int, pad: int) -> DataFrame:
    """A trace of raw choices as it is emitted: the end token once, then pads."""
    w = Window.partitionBy(seq).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max((F.col(token) == eos).cast("int")).over(w), F.lit(0)) == 1
    return trace.withColumn(token, F.when(ended, F.lit(pad)).otherwise(F.col(token)).cast("int")).withColumn("finished", ended)


def stop_step(trace: DataFrame, seq: str, step: str, token: str, eos: int) -> DataFrame:
    """One row: how many steps run until every sequence has emitted the end token."""
    ends = trace.groupBy(seq).agg(F.min(F.when(F.col(token) == eos, F.col(step))).alias("e"), F.max(step).alias("last"))
    return ends.agg(F.when(F.count("*") == F.count("e"), F.max("e")).otherwise(F.max("last")).cast("int").alias("stop_step"))
