import os

import duckdb
import pytest

from corpusloom.llm import queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "conversations"):
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df, found = queries.QUERIES[name](spark, sf_dir), duck.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    at = [found.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=str)


def test_contracts(spark, sf_dir):
    """Types and first columns that the thin queries promise."""
    want = {
        "op2_toxicity": "doc_id bigint held_out boolean score double predicted int",
        "op3_chat_format": "conv_id bigint n_turns bigint turns_sha256 string loss_chars bigint loss_sha256 string formatted_chars bigint",
        "op4_exact_top_k": "query_id bigint rank int vec_id bigint score bigint",
        "op6_sharding": "doc_id bigint size bigint text_crc32 bigint law string shard int slot bigint grown_shard int",
        "op7_language_id": "doc_id bigint held_out boolean lang_pred string score double",
        "op8_token_counts": "doc_id bigint n_bytes bigint n_tokens bigint over_limit boolean",
    }
    for name, columns in want.items():
        found = " ".join(" ".join(x) for x in queries.QUERIES[name](spark, sf_dir).dtypes)
        assert found.startswith(columns), name
