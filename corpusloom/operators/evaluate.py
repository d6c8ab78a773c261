"""Perplexity: per sample, of the corpus, and how it is distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.config import ModelConfig
from corpusloom.functions import template
from corpusloom.operators import examples, lm
from corpusloom.operators.lm import Params
from corpusloom.sources import artifacts, jsonl


def sample_ppl(tokens: DataFrame, sample: str, nll: str = "nll", mask: str | None = None) -> DataFrame:
    """``sample, nll_sum, n_scored, ppl`` of scored tokens; samples without one have null."""
    m = F.col(mask).cast("double") if mask else F.lit(1.0)
    return with_ppl(tokens.groupBy(sample).agg(F.sum(F.col(nll) * m).alias("nll_sum"), F.sum(m).cast("long").alias("n_scored")))


def with_ppl(samples: DataFrame) -> DataFrame:
    return samples.withColumn("ppl", F.when(F.col("n_scored") > 0, F.exp(F.col("nll_sum") / F.col("n_scored"))))


def scorable(samples: DataFrame) -> DataFrame:
    return samples.where("n_scored > 0")


def micro_ppl(nll_sum: Column, n_scored: Column) -> Column:
    """Aggregate: exp of the mean over all tokens; infinity where none is scored."""
    n = F.coalesce(F.sum(n_scored), F.lit(0))
    return F.when(n > 0, F.exp(F.sum(nll_sum) / n)).otherwise(F.lit(float("inf")))


def corpus_ppl(samples: DataFrame) -> DataFrame:
    """``num_samples`` counts all samples, also those without a scored token."""
    return samples.agg(F.count("*").alias("num_samples"), F.coalesce(F.sum("n_scored"), F.lit(0)).cast("long").alias("n_tokens"), micro_ppl(F.col("nll_sum"), F.col("n_scored")).alias("average_ppl"))


def quantiles(samples: DataFrame, value: str, at: tuple[float, ...]) -> DataFrame:
    """``q, x``: exact quantiles with linear interpolation, of at least one value, without one task that sees all values.

    Values are counted by ranges of a thousandth of their logarithm; only the ranges that hold a wanted rank are sorted, each by itself.
    """
    v = F.col(value)
    ranged = samples.where(v.isNotNull()).select(v.alias("x"), F.floor(F.signum(v) * F.log1p(F.abs(v)) * 1000).alias("r"))
    sizes = ranged.groupBy("r").agg(F.count("*").alias("n"))  # ranges of doubles: some 700,000 on either side at most
    upto = sizes.select("r", F.sum("n").over(Window.orderBy("r")).alias("upto"), "n", F.sum("n").over(Window.partitionBy()).alias("total"))
    wanted = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), (F.lit(q) * (F.col("total") - 1)).alias("place")) for q in at])).alias("w")
    ranks = upto.select("r", (F.col("upto") - F.col("n")).alias("start"), "upto", wanted).select("r", "start", "upto", "w.q", "w.place", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    ranks = ranks.withColumn("rank", F.when(F.col("side") == 0, F.floor("place")).otherwise(F.ceil("place"))).where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("upto")))
    held = ranged.join(F.broadcast(ranks.select("r").distinct()), "r", "left_semi")  # two ranges a quantile at most
    placed = held.select("r", "x", (F.row_number().over(Window.partitionBy("r").orderBy("x")) - 1).alias("i"))
    found = placed.join(F.broadcast(ranks), "r").where(F.col("i") == F.col("rank") - F.col("start"))
    share = F.col("place") - F.floor("place")
    return found.groupBy("q").agg(F.sum(F.when(F.col("side") == 0, F.col("x") * (1 - share)).otherwise(F.col("x") * share)).alias("x"))


def distribution(samples: DataFrame, value: str = "ppl") -> DataFrame:
    """Exact statistics of the samples that have a value; the deviation is the population's."""
    v = F.col(value)
    plain = samples.where(v.isNotNull()).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    names = {0.25: "p25", 0.5: "median", 0.75: "p75"}
    wide = quantiles(samples, value, tuple(names)).agg(*[F.max(F.when(F.col("q") == q, F.col("x"))).alias(n) for q, n in names.items()])
    return plain.crossJoin(F.broadcast(wide)).select("mean", "median", "std", "min", "max", "p25", "p75")  # one row on either side


def report(samples: DataFrame) -> DataFrame:
    """One row: the corpus figures beside the distribution."""
    return corpus_ppl(samples).crossJoin(F.broadcast(distribution(scorable(samples))))  # one row on either side


def score_file(spark: SparkSession, path: str, config: ModelConfig, params: Params, *, max_length: int = 512, field: str = "text", max_samples: int | None = None) -> DataFrame:
    """``line_no, nll_sum, n_scored, ppl`` of every accepted line of a JSON-lines file, under a network over the byte vocabulary."""
    texts, _ = jsonl.read_lenient(spark, path, field, max_samples)
    coded = texts.select("line_no", examples.byte_tokens(template.wrap_text(F.col("text")), min(max_length, config.max_seq_len)).alias("ids"))
    return with_ppl(lm.score(coded, config, params, "line_no"))


def perplexity(spark: SparkSession, path: str, model_path: str, config: ModelConfig, out: str | None = None, **options) -> DataFrame:
    """The evaluation from file to report: one row of :func:`report` with the places of data and model.

    ``options`` are those of :func:`score_file`. With ``out``, the report is written there as JSON and the samples' own perplexities beside it as Parquet.
    """
    params = artifacts.matching(artifacts.params_dict(artifacts.load_weights(spark, model_path)), config.shapes())
    samples = score_file(spark, path, config, params, **options).persist()
    made = report(samples).select(F.lit(path).alias("dataset_path"), F.lit(model_path).alias("model_path"), "*")
    if out:
        artifacts.write_report(made, f"{out}/report")
        samples.write.parquet(f"{out}/samples")
    return made


def unigram_scores(targets: DataFrame, sample: str, vocab: int) -> DataFrame:
    """``sample, nll_sum, n_scored``: add-one unigram costs of ``targets(sample, token_id)``, the counts
    taken over all samples. A relational stand-in for a network; everything after it is the same.

    Tokens are counted by (sample, id) first, so the join with the id table, of ``vocab`` rows, is small.
    """
    own = targets.groupBy(sample, "token_id").agg(F.count("*").alias("n"))
    counts = own.groupBy("token_id").agg(F.sum("n").alias("c"))
    total = counts.agg(F.sum("c").alias("total"))
    costs = counts.crossJoin(F.broadcast(total)).select("token_id", (-F.log((F.col("c") + 1.0) / (F.col("total") + float(vocab)))).alias("cost"))
    joined = own.join(F.broadcast(costs), "token_id")  # at most ``vocab`` rows
    return joined.groupBy(sample).agg(F.sum(F.col("n") * F.col("cost")).alias("nll_sum"), F.sum("n").cast("long").alias("n_scored"))
