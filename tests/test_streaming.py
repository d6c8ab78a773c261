import json

from pyspark.sql import functions as F

from corpusloom.functions import template
from corpusloom.operators import examples
from corpusloom.streaming import chat, ingest


def test_stream_equals_batch(spark, tmp_path):
    lines = [json.dumps({"text": f"text {i} é"}) for i in range(30)] + ["", "{bad", "[1]", '{"x": 1}']
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.jsonl").write_text("\n".join(lines[i::3]) + "\n")
    stream = ingest.line_stream(spark, f"{tmp_path}/in", 2)
    ingest.write_parquet(ingest.pretrain_stream(stream, 16), f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination(120)
    ingest.write_parquet(ingest.reject_stream(stream), f"{tmp_path}/bad", f"{tmp_path}/c2").awaitTermination(120)
    got = {(r.text, tuple(r.ids)) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = spark.createDataFrame([(f"text {i} é",) for i in range(30)], "text string")
    want = {(r.text, tuple(r.ids)) for r in batch.withColumn("ids", examples.byte_tokens(template.wrap_text(F.col("text")), 16)).collect()}
    assert got == want
    assert sorted(r.reason for r in spark.read.parquet(f"{tmp_path}/bad").collect()) == ["malformed", "malformed", "missing", "no_object"]


def test_keyed_history_equals_batch(spark, tmp_path):
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c}-{t}") for c in range(4) for t in range(7)]
    schema = "conv_id long, turn long, role string, text string"
    for i, part in enumerate((turns[:14], turns[14:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    assert ingest.write_parquet(chat.history_stream(stream, 2), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination(90)
    got = {(r.conv_id, r.turn, tuple(r.history_texts)) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = examples.history(spark.createDataFrame(turns, schema), 2)
    assert got == {(r.conv_id, r.turn, tuple(m.content for m in r.history)) for r in batch.collect()}
