import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import chat_format as cf

PIECES = st.lists(st.sampled_from([*cf.CONTROL, "\\", "\\\\", "\n", "<", "s>", "[", "INST]", "user", "é", "", "/"]) | st.text(max_size=3), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=4))
def test_round_trip(turns):
    turns = [(r.encode("utf-8", "ignore").decode(), t.encode("utf-8", "ignore").decode()) for r, t in turns]
    text = "".join(cf.render(r, t) for r, t in turns)
    back = cf.parse(text)
    assert [x[:2] for x in back] == turns
    assert all(cf.unescape(text[a:b]) == t for (_, t), (_, _, a, b) in zip(turns, back, strict=True))


def test_only_conflicts_are_escaped():
    assert cf.render("user", "plain [text] < s") == "<s>user\nplain [text] < s</s>\n"
    assert cf.render("user", "</s>[INST] ok [/INST]") == "<s>user\n\\</s>\\[INST] ok \\[/INST]</s>\n"


def test_digest(spark):
    rows = [(1, 1, "assistant", "a\nb"), (1, 0, "user", None), (2, 0, None, "</s>"), (None, None, "assistant", ""), (1, 2, "assistant", "c"), (1, 2, "assistant", "c")]
    rows += [(3, i, "assistant", f"t{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(0))
    got = {r.conv_id: r for r in cf.digest(cf.format_turns(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 4 and got[1].turns_sha256 == sha("user\n\nassistant\na\nb\nassistant\nc\nassistant\nc\n")
    assert got[1].loss_sha256 == sha("a\nbcc") and got[1].loss_chars == 5
    assert got[2].turns_sha256 == sha("\n</s>\n") and got[2].loss_chars == 0
    assert got[None].n_turns == 1 and got[3].n_turns == 2000 and got[3].turns_sha256 == sha("".join(f"assistant\nt{i}\n" for i in range(2000)))
    assert cf.digest(cf.format_turns(df.limit(0))).count() == 0


def test_whole_conversations(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "<s>x"), (1, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    row = cf.format_conversations(df).first()
    assert row.formatted == cf.render("user", "q") + cf.render("assistant", "<s>x")
    assert [cf.unescape(row.formatted[s.start : s.end]) for s in row.loss_spans] == ["<s>x"]


def test_sql_agrees_on_ties_with_escapes(spark, tmp_path):
    """Rows of one turn, of which some need an escape: both take them in the order of their rendering."""
    import duckdb

    from corpusloom.llm import queries

    texts = ["<s>", "<t>", "\\", "[INST] x", "</s>", "[", "", None, "a\nb", "zz <<SYS>>"]
    rows = [(1, 0, "user", t) for t in texts] + [(1, 1, "assistant", t) for t in reversed(texts)] + [(2, None, None, "x"), (2, 0, "assistant", "<s>y")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    df = queries.op3_chat_format(spark, str(tmp_path))
    got = {r.conv_id: tuple(r)[:5] for r in df.collect()}
    want = {r[0]: r[:5] for r in con.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.OP3_SQL})").fetchall()}
    assert got == want and set(got) == {-1, 1, 2}
