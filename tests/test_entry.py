import os

import duckdb
import pytest

import __spark_entry__ as entry
from corpusloom.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def rows_of(df):
    names = sorted(df.columns)
    return sorted(tuple(plain(r[c]) for c in names) for r in df.collect())


def rows_of_sql(con, sql):
    found = con.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["conv_id", "n_tokens", "n_loss_tokens"]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(plans.QUERIES) - set(plans.ORACLE_SQL) == {"bpe_vocab", "generate_trace", "train_steps"}


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = plans.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(duck.sql(plans.ORACLE_SQL[name]).columns)
    assert rows_of(df) == rows_of_sql(duck, plans.ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["bpe_vocab", "generate_trace", "train_steps"])
def test_query_runs(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0


def test_network_and_vocabulary_queries_run_on_whole_texts(spark, sf_dir):
    from pyspark.sql import functions as F

    from corpusloom.operators import lm

    assert plans.QUERIES["bpe_vocab"](spark, sf_dir).count() == 6400
    sizes = {r.item_id: len(r.text.encode()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    assert {r.item_id: r.n_scored for r in plans.QUERIES["lm_score"](spark, sf_dir).collect()} == {k: n + 1 for k, n in sizes.items()}
    whole = plans._prompts(spark, sf_dir, 10_000)
    assert {r.item_id: r.n for r in whole.select("item_id", F.size("ids").alias("n")).collect()} == {k: n + 2 for k, n in sizes.items()}
    made = lm.generate_rows(whole, plans.NETWORK, lm.init_params(plans.NETWORK), "item_id", trace=True, max_new_tokens=8, seed=1)
    want = {(r.item_id, r.step, r.ids[-1]) for r in made.collect()}
    assert {(r.item_id, r.step, r.token_id) for r in plans.QUERIES["generate_trace"](spark, sf_dir).collect()} == want
