import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from corpusloom.llm import sharding


def check(rows, got):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_law_slots_and_growth(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_A_BUCKET", 16)
    rows = [(i, "x" * (i % 7)) for i in range(3000)] + [(5, "same")] * 500 + [(None, None), (None, "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("mine")).withColumn("h", F.lit(1))
    got = sharding.assign_shards(df, [1.0] * 16).collect()
    check(rows, got)
    assert len({(r.doc_id, r.shard) for r in got}) == len({r[0] for r in rows})
    moved = [r for r in got if r.grown_shard != r.shard]
    assert moved and all(r.grown_shard == 16 for r in moved)
    again = sharding.assign_shards(df.repartition(7), [1.0] * 17).collect()
    grown = {r.doc_id: r.grown_shard for r in got}
    assert all(grown[r.doc_id] == r.shard for r in again)


def test_weights(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    n = Counter(r.shard for r in sharding.assign_shards(df, [1.0, 3.0]).collect())
    assert 2.7 < n[1] / n[0] < 3.3


def test_empty(spark):
    assert sharding.assign_shards(spark.createDataFrame([], "doc_id long, text string"), [1.0, 1.0]).count() == 0


def test_written_shards(spark, tmp_path):
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    sharding.write_shards(df, f"{tmp_path}/out", [1.0] * 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 200 and back.select("shard").distinct().count() == 4
