import random
from collections import defaultdict

from pyspark.sql import functions as F

from corpusloom.llm import line_dedup as ld


def brute_force(rows, min_sites):
    sites, keep = defaultdict(set), {}
    for k, s, t in rows:
        for line in (t or "").split("\n"):
            if line.strip(" "):
                sites[line.strip(" ")].add(s)
                if k is not None:
                    keep[line.strip(" ")] = min(keep.get(line.strip(" "), k), k)
    bad = {line for line, s in sites.items() if len(s - {None}) >= min_sites}
    out = []
    for k, _, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if x.strip(" ") not in bad or keep.get(x.strip(" ")) == k]
        out.append((k, t if len(kept) == len(lines) else "\n".join(kept), len(lines) if t else 0, len(lines) - len(kept)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(6)
    common = [f"common line {i}" for i in range(40)]
    rows = []
    for k in range(400):
        lines = [rng.choice(common[: 1 + k % 40]) for _ in range(rng.randrange(0, 6))] + [f"own {k} {i}" for i in range(rng.randrange(0, 3))]
        rows.append((k, f"s{rng.randrange(25)}", "\n".join(lines)))
    rows += [(500, None, "common line 1"), (501, "s3", None), (502, "s4", ""), (503, "s5", "\n\n"), (None, "s6", "common line 1\nnull id"), (3, "s7", rows[3][2]), (3, "s7", rows[3][2])]
    rows += [(600 + i, f"s{i % 2}", "seen on two sites only") for i in range(60)] + [(800 + i, f"t{i}", " padded  \nrest") for i in range(14)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("line", F.lit("x")).withColumn("h1", F.lit(1)).withColumn("_gone", F.lit("g")).withColumn("n_lines", F.lit("n"))
    got = sorted([(r.row.doc_id, r.row.text, r.n_lines, r.n_removed) for r in ld.dedup_lines(df, 10).collect()], key=str)
    assert got == brute_force(rows, 10)
    assert ld.dedup_lines(df).select("row.*").columns == df.columns
    assert ld.dedup_lines(df.limit(0)).count() == 0


def test_estimates_far_from_the_threshold_are_enough(spark):
    rows = [(i, f"s{i}", "everywhere") for i in range(500)] + [(1000 + i, f"s{i}", "near") for i in range(9)] + [(2000 + i, f"s{i}", "just") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    left = {r.row.text for r in ld.dedup_lines(df, 10).where("row.doc_id not in (0, 2000)").collect()}
    assert left == {"", "near"}


def test_sql_agrees_on_odd_texts(spark, tmp_path):
    import duckdb

    from corpusloom.llm import queries

    rows = [(1, None, None), (2, "", "s1"), (3, " \n\n", "s2"), (4, "own", None)] + [(10 + i, f"shared by all\nown {i}", f"s{i}") for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = queries.op1_line_dedup(spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.OP1_SQL})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and len(want) == 16
