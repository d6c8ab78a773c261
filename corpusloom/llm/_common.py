"""What the operators of this subpackage share: table reading and durable staging."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where a session on one machine (a local master) names none, as in tests, a temporary folder is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = getattr(spark.sparkContext, "_corpusloom_shared", None)
    if made is None:
        made = spark.sparkContext._corpusloom_shared = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    return made


#: What this driver has staged, in order, for :func:`clear_staged` and :func:`superseded`.
_written: list[str] = []


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_staged(spark: SparkSession) -> None:
    """Delete what :func:`staged` has written, once no result that was made from it is needed any more."""
    _delete(spark, _written)
    _written.clear()


def stage_mark() -> int:
    """How much has been staged so far, for :func:`superseded`."""
    return len(_written)


def superseded(spark: SparkSession, since: int) -> None:
    """Delete what was staged since this mark but the last table, which was made from the others."""
    _delete(spark, _written[since:-1])
    del _written[since:-1]


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage durably: a lost executor rereads the files, and branches that use the result do not
    recompute what led to it. As its size is known when it is joined, a small table is broadcast (up to
    ``spark.sql.autoBroadcastJoinThreshold``) and the other side stays where it is; a larger one is shuffled.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)
