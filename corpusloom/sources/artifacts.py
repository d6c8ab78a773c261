"""Checkpoints, parameters, tokenizer files, reports and metrics as folders of Parquet and JSON.

A checkpoint is a folder: ``params`` (name, shape, values, requires_grad) and ``manifest`` (one row). It is written
beside its place and renamed, so a reader never meets half of one.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARAMS = "name string, shape array<int>, values array<float>, requires_grad boolean"
MANIFEST = "kind string, epoch int, step int, global_step long, loss double, config string"
#: Where each chat mode looks for its model: first name, then others in order.
MODEL_FILES = {
    0: ("pretrain", "pretrain_final", "latest_checkpoint"),
    1: ("SFT", "sft_final", "SFT", "latest_checkpoint"),
    2: ("distill", "distill_final", "latest_checkpoint"),
    3: ("dpo", "dpo_final", "latest_checkpoint"),
}


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def params_frame(spark: SparkSession, params: dict[str, np.ndarray], frozen: bool = False) -> DataFrame:
    rows = [(n, list(map(int, v.shape)), v.ravel().astype(float).tolist(), not frozen) for n, v in sorted(params.items())]
    return spark.createDataFrame(rows, PARAMS)


def params_dict(frame: DataFrame) -> dict[str, np.ndarray]:
    """Parameters on the driver; models of this kind are built to fit one machine."""
    return {r.name: np.array(r["values"], np.float32).reshape(r["shape"]) for r in frame.toLocalIterator()}


def freeze(frame: DataFrame) -> DataFrame:
    return frame.withColumn("requires_grad", F.lit(False))


def parameter_count(frame: DataFrame, trainable: bool = True) -> DataFrame:
    """How many numbers the shapes of ``frame(shape, requires_grad)`` hold."""
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)
    return frame.where("requires_grad" if trainable else "true").agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("n_params"))


def save_checkpoint(spark: SparkSession, path: str, params: dict[str, np.ndarray], *, epoch: int = 0, step: int = 0, global_step: int = 0, loss: float = float("inf"), config: dict | None = None, optimizer: dict[str, np.ndarray] | None = None, raw: bool = False) -> None:
    """Write a checkpoint, or with ``raw`` the parameters alone."""
    temp = f"{path}.{uuid.uuid4().hex}"
    params_frame(spark, params).coalesce(1).write.parquet(f"{temp}/params")
    if not raw:
        spark.createDataFrame([("checkpoint", epoch, step, global_step, float(loss), json.dumps(config or {}))], MANIFEST).coalesce(1).write.parquet(f"{temp}/manifest")
        if optimizer:
            params_frame(spark, optimizer).coalesce(1).write.parquet(f"{temp}/optimizer")
    fs, old = _fs(spark, path)
    if fs.exists(old):
        fs.delete(old, True)
    fs.rename(spark._jvm.org.apache.hadoop.fs.Path(temp), old)


def load_weights(spark: SparkSession, path: str) -> DataFrame:
    """Parameters of a checkpoint folder, of a bare parameter folder, or of Parquet parameters themselves.

    Parameters with ``mask`` in their name are left out, and rows without values, which are none.
    """
    for at in (f"{path}/params", f"{path}/state_dict", path):
        if exists(spark, at):
            found = spark.read.parquet(at)
            if {"name", "shape", "values"} <= set(found.columns):
                if "requires_grad" not in found.columns:
                    found = found.withColumn("requires_grad", F.lit(True))
                return found.where(~F.col("name").contains("mask") & F.col("values").isNotNull()).select("name", "shape", "values", "requires_grad")
    raise ValueError(f"no parameters in {path}")


def matching(params: dict[str, np.ndarray], shapes: dict[str, tuple[int, ...]], strict: bool = False) -> dict[str, np.ndarray]:
    """The parameters that ``shapes`` names. With ``strict``, missing or further names are an error; a wrong shape always is."""
    if wrong := sorted(n for n in shapes if n in params and params[n].shape != tuple(shapes[n])):
        raise ValueError(f"parameters of another shape: {wrong[:3]}")
    missing, further = sorted(set(shapes) - set(params)), sorted(set(params) - set(shapes))
    if strict and (missing or further):
        raise ValueError(f"missing: {missing[:3]}, not known: {further[:3]}")
    return {n: v for n, v in params.items() if n in shapes}


def train_state(manifest: DataFrame) -> DataFrame:
    """``epoch, step, global_step, loss`` with 0, 0, 0 and infinity where a manifest has none."""
    defaults = {"epoch": F.lit(0), "step": F.lit(0), "global_step": F.lit(0).cast("long"), "loss": F.lit(float("inf"))}
    return manifest.select(*[(F.coalesce(F.col(c), d) if c in manifest.columns else d).alias(c) for c, d in defaults.items()])


def load_train_state(spark: SparkSession, path: str) -> tuple[int, int, int, float]:
    if not exists(spark, f"{path}/manifest"):
        return 0, 0, 0, float("inf")
    r = train_state(spark.read.parquet(f"{path}/manifest")).first()
    return r.epoch, r.step, r.global_step, r.loss


def discover(candidates: DataFrame, present: DataFrame) -> DataFrame:
    """``mode, name``: for each mode the first of ``candidates(mode, priority, name)`` that ``present(name)`` has."""
    return candidates.join(present.select("name").distinct(), "name").groupBy("mode").agg(F.min_by("name", "priority").alias("name"))


def discover_model(spark: SparkSession, folder: str, mode: int) -> str:
    if mode not in MODEL_FILES:
        raise ValueError(f"unknown mode {mode}")
    for name in MODEL_FILES[mode]:
        if exists(spark, f"{folder}/{name}"):
            return f"{folder}/{name}"
    raise FileNotFoundError(f"no model for mode {mode} in {folder}")


def candidate_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, i, n) for m, names in MODEL_FILES.items() for i, n in enumerate(names)], "mode int, priority int, name string")


def to_plain(value):
    """numpy scalars and arrays as Python values, anything else unknown as text; for ``json.dumps(default=...)``."""
    if isinstance(value, np.generic):
        return value.item()
    return value.tolist() if isinstance(value, np.ndarray) else str(value)


def report_json(report: DataFrame) -> Column:
    return F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false"})


def write_report(report: DataFrame, path: str) -> None:
    """One JSON document a row, as text files."""
    report.select(report_json(report).alias("value")).write.text(path)


def log_metrics(spark: SparkSession, path: str | None, rows: list[tuple[str, int, int, str, float]], enabled: bool = True) -> None:
    """Append ``run, epoch, step, metric, value`` rows to a metrics table; nothing where tracking is off, an error where it is on without a place."""
    if enabled and not path:
        raise ValueError("tracking is on, but no metrics table is named")
    if enabled and rows:
        spark.createDataFrame(rows, "run string, epoch int, step int, metric string, value double").coalesce(1).write.mode("append").parquet(path)
