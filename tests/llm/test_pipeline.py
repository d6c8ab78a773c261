import corpus_pipeline as cp
from corpusloom.llm import queries


def test_stages_on_the_small_table(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if i < len(cp.STAGES) - 1:
            assert out.columns == columns
            assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
        seen[name] = (docs, out)
        docs = out
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = seen["language_id"]
    assert len(ids(before) - ids(after)) <= 2
    before, after = seen["ngram_jaccard_join"]
    before.write.parquet(f"{tmp_path}/in/documents.parquet")
    classes = {r.doc_id: r.class_id for r in queries.op10_ngram_jaccard_join(spark, f"{tmp_path}/in").collect()}
    assert ids(after) == set(classes.values()) and after.count() == len(set(classes.values()))
    before, after = seen["decontamination"]
    assert ids(before) - ids(after) and len(ids(after)) > 0.9 * len(ids(before))
    before, after = seen["best_fit_packing"]
    assert ids(after) == ids(before)
    assert {r.doc_id for r in cp.run(spark, sf_dir).select("doc_id").collect()} == ids(after)


def test_stages_on_odd_tables(spark, sf_dir):
    """Nulls in every column, empty and very long texts, repeated rows, names that operators use inside, no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, cid string, row string, k long, _own int, _gone string, seed int, t string, words int"
    rest = ("c", "r", 1, 2, "g", 3, "t", 4)
    rows = [(i, f"words number {i} stand in this text of a plain kind {i * i}", "en", f"s{i % 3}", 9, *rest) for i in range(40)]
    rows += [(None, None, None, None, None, *[None] * 8), (50, None, "en", "s1", 0, *rest), (51, "", "en", None, 0, *rest), (None, "a text without an id stands here too", None, None, None, *[None] * 8)]
    rows += [rows[3], rows[3], (60, "very long " * 60_000, "en", "s0", None, *rest), (61, "12 34", "en", "s0", 5, *rest)]
    full = spark.createDataFrame(rows, schema)
    for table in (full, full.limit(0)):
        docs = table
        for i, (_, stage) in enumerate(cp.STAGES):
            alone = stage(spark, table, sf_dir)
            chained = stage(spark, docs, sf_dir)
            if i < len(cp.STAGES) - 1:
                assert alone.columns == table.columns and [f.dataType for f in alone.schema] == [f.dataType for f in table.schema]
                docs = chained
            n = alone.count()
            assert n == 0 if table is not full else n >= 40
    kept = [r.doc_id for r in cp.join_near_duplicates(spark, full, sf_dir).collect()]
    assert kept.count(3) == 1 and kept.count(None) == 2 and {50, 51, 60, 61} <= set(kept)
