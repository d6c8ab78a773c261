"""The registered queries over the shared tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom import config
from corpusloom.functions import decode, losses, template, tokens
from corpusloom.operators import bpe, evaluate, examples, lm, schedule, train
from corpusloom.session import table
from corpusloom.sources import artifacts, jsonl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LENGTH, SHORT, PAIR_LENGTH = 512, 128, 256
SYSTEM = template.SYSTEM


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(x: Column) -> Column:
    return F.round(x, 6)


# ---- conversations ----

#: Segment lengths in ids: an opening marker with its role line, the content, the closing marker.
_TURNS = f"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
s AS (SELECT *, strlen(text) AS n, CASE WHEN i % 2 = 0 THEN strlen(text) + 19 ELSE strlen(text) + 2 END AS seg FROM t),
o AS (SELECT *, {1 + 7 + len(SYSTEM) + 2} + coalesce(sum(seg) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o0 FROM s)
"""


@query(_TURNS + f"""
SELECT conv_id, CAST(least({LENGTH}, max(o0 + seg)) AS INTEGER) AS n_tokens,
  CAST(sum(CASE WHEN i % 2 = 1 THEN greatest(0, least(o0 + n + 2, {LENGTH}) - o0) ELSE 0 END) AS BIGINT) AS n_loss_tokens
FROM o GROUP BY conv_id
""")
def sft_loss_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = examples.sft_examples(table(spark, sf_dir, "conversations"), LENGTH)
    return made.select("conv_id", F.size("ids").alias("n_tokens"), F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_loss_tokens"))


@query(f"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)
SELECT conv_id, md5(
  '<s>system' || chr(10) || coalesce(max(text) FILTER (WHERE i = 1 AND role = 'system'), '{SYSTEM}') || '</s>' || chr(10) ||
  coalesce(string_agg(CASE role WHEN 'user' THEN '<s>user' || chr(10) || text || '</s>' || chr(10) || '<s>assistant' || chr(10)
    WHEN 'assistant' THEN text || '</s>' || chr(10) ELSE '' END, '' ORDER BY i), '')) AS prompt_md5
FROM t GROUP BY conv_id
""")
def chatml_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = examples.conversations(table(spark, sf_dir, "conversations"))
    return convs.select("conv_id", F.md5(template.render_chat(F.col("messages"))).alias("prompt_md5"))


@query("""
SELECT coalesce(role, '') AS role, CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END AS parity_role, count(*) AS n
FROM (SELECT role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) GROUP BY 1, 2
""")
def sft_role_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = examples.conversations(table(spark, sf_dir, "conversations")).withColumn("parity", template.parity_roles(F.col("messages")))
    both = convs.select(F.explode(F.arrays_zip("messages", "parity")).alias("m"))
    return both.groupBy(F.coalesce("m.messages.role", F.lit("")).alias("role"), F.col("m.parity.role").alias("parity_role")).agg(F.count("*").alias("n"))


@query("""
SELECT conv_id, turn, n_history, history_md5 FROM (
  SELECT conv_id, turn, role, CAST(count(*) OVER w AS INTEGER) AS n_history, md5(coalesce(string_agg(role || ':' || coalesce(text, ''), '|') OVER w, '')) AS history_md5
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))
WHERE role = 'user'
""")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = examples.history(table(spark, sf_dir, "conversations"), 2)
    text = F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return made.select("conv_id", "turn", F.size("history").alias("n_history"), F.md5(text).alias("history_md5"))


_PAIRS = """
WITH n AS (SELECT conv_id, turn, role, coalesce(text, '') AS prompt, lead(role) OVER w AS next_role, coalesce(lead(text) OVER w, '') AS chosen
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT * FROM n WHERE role = 'user' AND next_role = 'assistant'),
q AS (SELECT conv_id, turn, prompt, chosen, CASE WHEN count(*) OVER (PARTITION BY conv_id) = 1 THEN ''
  ELSE coalesce(lead(chosen) OVER (PARTITION BY conv_id ORDER BY turn), first_value(chosen) OVER (PARTITION BY conv_id ORDER BY turn)) END AS rejected FROM p)
"""


@query(_PAIRS + "SELECT conv_id, turn, md5(prompt) AS prompt_md5, md5(chosen) AS chosen_md5, md5(rejected) AS rejected_md5 FROM q")
def preference_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = examples.preference_pairs(table(spark, sf_dir, "conversations"))
    return pairs.select("conv_id", "turn", *[F.md5(c).alias(f"{c}_md5") for c in ("prompt", "chosen", "rejected")])


def _pair_sql(side: str) -> str:
    at = f"({1 + 7 + len(SYSTEM) + 2} + 19 + strlen(prompt))"
    return f"""CAST(least({PAIR_LENGTH}, {at} + strlen({side}) + 2) AS INTEGER) AS {side}_tokens,
  CAST(greatest(0, least({at} + strlen({side}) + 2, {PAIR_LENGTH}) - {at}) AS INTEGER) AS {side}_loss_tokens"""


@query(_PAIRS + f"SELECT conv_id, turn, {_pair_sql('chosen')}, {_pair_sql('rejected')} FROM q")
def preference_mask_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = examples.preference_examples(examples.preference_pairs(table(spark, sf_dir, "conversations")), PAIR_LENGTH)
    ones = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    return made.select("conv_id", "turn", *[x for s in ("chosen", "rejected") for x in (F.size(f"{s}_ids").alias(f"{s}_tokens"), ones(f"{s}_mask").alias(f"{s}_loss_tokens"))])


@query("""
SELECT conv_id, md5(string_agg(upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || coalesce(text, ''), chr(10) ORDER BY turn)) AS transcript_md5
FROM conversations GROUP BY conv_id
""")
def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = examples.conversations(table(spark, sf_dir, "conversations"))
    return convs.select("conv_id", F.md5(template.transcript(F.col("messages"))).alias("transcript_md5"))


@query("""
SELECT conv_id, turn, CAST(length(CASE WHEN starts_with(now, before) THEN substr(now, length(before) + 1) ELSE now END) AS INTEGER) AS delta_chars,
  md5(CASE WHEN starts_with(now, before) THEN substr(now, length(before) + 1) ELSE now END) AS delta_md5
FROM (SELECT conv_id, turn, now, coalesce(lag(now) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before
  FROM (SELECT conv_id, turn, string_agg(coalesce(text, ''), '' ) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS now FROM conversations))
""")
def prefix_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    grown = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.collect_list(F.coalesce("text", F.lit(""))).over(w.rowsBetween(-2, 0)), "").alias("now"))
    delta = template.prefix_delta(F.col("now"), F.col("before"))
    return grown.withColumn("before", F.lag("now").over(w)).select("conv_id", "turn", F.length(delta).alias("delta_chars"), F.md5(delta).alias("delta_md5"))


# ---- documents as training text ----

_BYTE = "list_transform(range(0, octet_length(encode({t}))), lambda i: CAST('0x' || substr(hex(encode({t})), 2 * i + 1, 2) AS INTEGER))"
_ID = """list_transform({b}, lambda b: CASE WHEN b BETWEEN 33 AND 126 THEN b - 30 WHEN b BETWEEN 161 AND 172 THEN b - 64
  WHEN b BETWEEN 174 AND 255 THEN b - 65 WHEN b < 33 THEN b + 191 WHEN b < 161 THEN b + 97 ELSE 258 END)"""


def _ids(text: str, length: int) -> str:
    """Wrapped ids of a text without special strings, cut to a length."""
    return f"list_slice(list_concat([1], {_ID.format(b=_BYTE.format(t=f'substr({text}, 1, {length})'))}, CASE WHEN strlen({text}) + 2 <= {length} THEN [2] ELSE [] END), 1, {length})"


@query("SELECT doc_id, md5('<s>' || text || '</s>') AS wrapped_md5, CAST(length(text) + 7 AS INTEGER) AS n_chars FROM documents")
def pretrain_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = template.wrap_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(wrapped).alias("wrapped_md5"), F.length(wrapped).alias("n_chars"))


def _document_ids(spark: SparkSession, sf_dir: str, length: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", examples.byte_tokens(template.wrap_text(F.col("text")), length).alias("ids"))


@query(f"""
SELECT lang, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(min(n) AS INTEGER) AS min_tokens, count(*) FILTER (WHERE n = {LENGTH}) AS n_full
FROM (SELECT lang, least({LENGTH}, strlen(text) + 2) AS n FROM documents) GROUP BY lang
""")
def pretrain_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size("ids")
    return _document_ids(spark, sf_dir, LENGTH).groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.sum(n).alias("n_tokens"), F.min(n).alias("min_tokens"), F.count_if(n == LENGTH).alias("n_full"))


@query(f"SELECT doc_id, {LENGTH - 1} AS width, CAST(least({LENGTH}, strlen(text) + 2) - 1 AS INTEGER) AS n_loss FROM documents")
def pretrain_mask_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _document_ids(spark, sf_dir, LENGTH).select("doc_id", examples.pretrain_example(F.col("ids"), LENGTH).alias("e"))
    return made.select("doc_id", F.size("e.x").alias("width"), F.aggregate("e.loss_mask", F.lit(0), lambda a, x: a + x).alias("n_loss"))


@query(f"""
WITH d AS (SELECT doc_id, {_ids('text', SHORT)} AS ids FROM documents)
SELECT doc_id,
  CAST(list_sum(list_transform(range(1, least(len(ids), {SHORT - 1}) + 1), lambda i: i * ids[i])) AS BIGINT) AS x_sum,
  CAST(list_sum(list_transform(range(2, len(ids) + 1), lambda i: (i - 1) * ids[i])) AS BIGINT) AS y_sum
FROM d
""")
def shift_xy_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _document_ids(spark, sf_dir, SHORT).select("doc_id", examples.pretrain_example(F.col("ids"), SHORT).alias("e"))
    check = lambda c: F.aggregate(F.transform(c, lambda v, i: (i + 1).cast("long") * v), F.lit(0).cast("long"), lambda a, x: a + x)
    return made.select("doc_id", check("e.x").alias("x_sum"), check("e.y").alias("y_sum"))


@query(f"""
WITH d AS (SELECT doc_id, doc_id // 8 AS batch_id, least({LENGTH}, strlen(text) + 2) AS n FROM documents)
SELECT doc_id, batch_id, CAST(max(n) OVER (PARTITION BY batch_id) AS INTEGER) AS padded_len, CAST(n AS INTEGER) AS n_attended FROM d
""")
def batch_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _document_ids(spark, sf_dir, LENGTH).withColumn("batch_id", F.floor(F.col("doc_id") / 8).cast("long"))
    docs = docs.withColumn("padded", tokens.pad_to(F.col("ids"), F.max(F.size("ids")).over(Window.partitionBy("batch_id"))))
    mask = tokens.attention_mask(F.size("ids"), F.size("padded"))
    return docs.select("doc_id", "batch_id", F.size("padded").alias("padded_len"), F.aggregate(mask, F.lit(0), lambda a, x: a + x).alias("n_attended"))


@query(f"""
WITH t AS (SELECT doc_id, text, octet_length(encode(text)) AS n FROM documents),
b AS (SELECT doc_id, n, {_ID.format(b="list_transform(range(greatest(0, n - 32), n), lambda i: CAST('0x' || substr(hex(encode(text)), 2 * i + 1, 2) AS INTEGER))")} AS ids FROM t)
SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_kept, CAST(list_sum(list_transform(range(1, len(ids) + 1), lambda i: i * ids[i])) AS BIGINT) AS tail_sum FROM b
""")
def prompt_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ids that a prompt may keep: a character is one id at least, so the text's own tail is enough."""
    budget = tokens.prompt_budget(64, 32)
    kept = tokens.tail(tokens.byte_ids(F.expr(f"right(text, {5 * budget})")), budget)
    docs = table(spark, sf_dir, "documents").select("doc_id", kept.alias("ids"))
    check = F.aggregate(F.transform("ids", lambda v, i: (i + 1).cast("long") * v), F.lit(0).cast("long"), lambda a, x: a + x)
    return docs.select("doc_id", F.size("ids").alias("n_kept"), check.alias("tail_sum"))


@query(f"""
WITH t AS (SELECT doc_id, octet_length(encode(text)) AS n, encode(text) AS e FROM documents),
c AS (SELECT doc_id, n + 1 AS n_all, list_transform(range(CASE WHEN n + 1 > 32 THEN n - 32 ELSE 0 END, n), lambda i: CAST('0x' || substr(hex(e), 2 * i + 1, 2) AS INTEGER)) AS b FROM t),
l AS (SELECT doc_id, n_all, b, CASE WHEN n_all <= 32 OR b[1] NOT BETWEEN 128 AND 191 THEN 0 WHEN b[2] NOT BETWEEN 128 AND 191 THEN 1 WHEN b[3] NOT BETWEEN 128 AND 191 THEN 2 ELSE 3 END AS cut FROM c),
r AS (SELECT doc_id, n_all, list_concat(flatten(list_transform(range(0, cut), lambda i: [239, 191, 189])), list_slice(b, cut + 1, len(b))) AS b FROM l),
i AS (SELECT doc_id, list_concat(CASE WHEN n_all <= 32 THEN [1] ELSE CAST([] AS INTEGER[]) END, {_ID.format(b='b')}) AS ids FROM r)
SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_ids, CAST(list_sum(list_transform(range(1, len(ids) + 1), lambda k: k * ids[k])) AS BIGINT) AS tail_sum FROM i
""")
def pretrain_prompt_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of the mode without chat tuning: cut to its last ids, decoded, encoded again."""
    ids = tokens.prompt_ids(template.pretrain_prompt(F.col("text")), tokens.prompt_budget(64, 32))
    docs = table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids"))
    return docs.select("doc_id", F.size("ids").alias("n_ids"), F.aggregate(F.transform("ids", lambda v, i: (i + 1).cast("long") * v), F.lit(0).cast("long"), lambda a, x: a + x).alias("tail_sum"))


@query("SELECT doc_id, md5(text) AS text_md5, CAST(strlen(text) AS INTEGER) AS n_ids FROM documents")
def byte_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", tokens.byte_ids(F.col("text")).alias("ids"))
    return docs.select("doc_id", F.md5(tokens.byte_text(F.col("ids"))).alias("text_md5"), F.size("ids").alias("n_ids"))


# ---- losses over vectors as logits ----

_LSE = "(list_max({x}) + ln(list_sum(list_transform({x}, lambda v: exp(v - list_max({x}))))))"
_VECS = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings)"


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", losses.doubles(F.col("embedding")).alias("z"))


@query(_VECS + f"""
SELECT vec_id, round({_LSE.format(x='z')}, 6) AS lse, round(list_max(z) - {_LSE.format(x='z')}, 6) AS top_logp FROM e
""")
def log_softmax_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _logits(spark, sf_dir)
    return z.select("vec_id", r6(losses.log_sum_exp(F.col("z"))).alias("lse"), r6(F.array_max(losses.log_softmax(F.col("z")))).alias("top_logp"))


@query(_VECS + f""", c AS (SELECT label, {_LSE.format(x='z')} - z[label + 1] AS ce, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 END AS m FROM e)
SELECT label, round(sum(ce * m) / greatest(sum(m), 1), 6) AS loss FROM c GROUP BY label
""")
def masked_ce(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _logits(spark, sf_dir).select("label", losses.cross_entropy(F.col("z"), F.col("label")).alias("ce"), (F.col("vec_id") % 3 != 0).cast("int").alias("m"))
    return z.groupBy("label").agg(r6(losses.masked_mean(F.col("ce"), F.col("m"))).alias("loss"))


_KD = _VECS + f""", p AS (SELECT a.vec_id, a.label, a.z AS z0, list_transform(a.z, lambda v: v / 2.0) AS s, list_transform(b.z, lambda v: v / 2.0) AS t FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
l AS (SELECT *, {_LSE.format(x='s')} AS ls, {_LSE.format(x='t')} AS lt FROM p),
k AS (SELECT vec_id, {_LSE.format(x='z0')} - z0[label + 1] AS ce, 4.0 * list_sum(list_transform(range(1, len(s) + 1), lambda i: exp(t[i] - lt) * ((t[i] - lt) - (s[i] - ls)))) AS kd FROM l)
"""


def _kd(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _logits(spark, sf_dir)
    teacher = z.select((F.col("vec_id") - 1).alias("vec_id"), F.col("z").alias("t"))
    return z.join(teacher, "vec_id").select("vec_id", losses.cross_entropy(F.col("z"), F.col("label")).alias("ce"), losses.kd_divergence(F.col("z"), F.col("t"), 2.0).alias("kd"))


@query(_KD + "SELECT vec_id, round(kd, 6) AS kd FROM k")
def kd_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kd(spark, sf_dir).select("vec_id", r6(F.col("kd")).alias("kd"))


@query(_KD + "SELECT CAST(vec_id % 10 AS BIGINT) AS batch, round(0.7 * avg(ce) + 0.3 * avg(kd), 6) AS loss FROM k GROUP BY 1")
def kd_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kd(spark, sf_dir).groupBy((F.col("vec_id") % 10).alias("batch")).agg(r6(losses.kd_blend(F.avg("ce"), F.avg("kd"), 0.3)).alias("loss"))


_LOGP = _VECS + f""", p AS (SELECT vec_id // 4 AS seq_id, vec_id % 4 AS pos, z[label + 1] - {_LSE.format(x='z')} AS logp FROM e)"""


def _target_logp(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _logits(spark, sf_dir)
    return z.select(F.floor(F.col("vec_id") / 4).cast("long").alias("seq_id"), (F.col("vec_id") % 4).alias("pos"), (-losses.cross_entropy(F.col("z"), F.col("label"))).alias("logp"))


@query(_LOGP + "SELECT seq_id, round(sum(logp * CASE WHEN pos > 0 THEN 1 ELSE 0 END), 6) AS logprob, count(*) FILTER (WHERE pos > 0) AS n_tokens FROM p GROUP BY seq_id")
def sequence_logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = (F.col("pos") > 0).cast("double")
    return _target_logp(spark, sf_dir).groupBy("seq_id").agg(r6(F.sum(F.col("logp") * m)).alias("logprob"), F.count_if(F.col("pos") > 0).alias("n_tokens"))


@query(_LOGP + """, w AS (SELECT seq_id, 0.1 * ((max(logp) FILTER (WHERE pos = 0) - max(logp) FILTER (WHERE pos = 1)) - (max(logp) FILTER (WHERE pos = 2) - max(logp) FILTER (WHERE pos = 3))) AS x
  FROM p GROUP BY seq_id HAVING count(*) = 4)
SELECT seq_id, round(ln(1 + exp(-x)), 6) AS loss FROM w
""")
def dpo_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _target_logp(spark, sf_dir).groupBy("seq_id").agg(F.count("*").alias("n"), *[F.max(F.when(F.col("pos") == i, F.col("logp"))).alias(f"p{i}") for i in range(4)])
    return wide.where("n = 4").select("seq_id", r6(losses.dpo(*[F.col(f"p{i}") for i in range(4)], 0.1)).alias("loss"))


# ---- perplexity ----

_PPL = f"""
WITH d AS (SELECT doc_id, lang, unnest(list_slice({_ids('text', LENGTH)}, 2, {LENGTH})) AS token_id FROM documents),
own AS (SELECT doc_id, lang, token_id, count(*) AS n FROM d GROUP BY ALL),
c AS (SELECT token_id, sum(n) AS c FROM own GROUP BY token_id),
k AS (SELECT token_id, -ln((c + 1.0) / ((SELECT sum(c) FROM c) + {tokens.VOCAB}.0)) AS cost FROM c),
s AS (SELECT doc_id, any_value(lang) AS lang, sum(n * cost) AS nll_sum, CAST(sum(n) AS BIGINT) AS n_scored, exp(sum(n * cost) / sum(n)) AS ppl FROM own JOIN k USING (token_id) GROUP BY doc_id)
"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _document_ids(spark, sf_dir, LENGTH)
    targets = docs.select("doc_id", F.explode(F.slice("ids", 2, LENGTH)).alias("token_id"))
    return evaluate.with_ppl(evaluate.unigram_scores(targets, "doc_id", tokens.VOCAB))


@query(_PPL + "SELECT doc_id, n_scored, round(nll_sum, 5) AS nll_sum, round(ppl, 5) AS ppl FROM s")
def doc_ppl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", "n_scored", F.round("nll_sum", 5).alias("nll_sum"), F.round("ppl", 5).alias("ppl"))


@query(_PPL + "SELECT count(*) AS num_samples, CAST(sum(n_scored) AS BIGINT) AS n_tokens, round(exp(sum(nll_sum) / sum(n_scored)), 5) AS average_ppl FROM s")
def corpus_ppl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.corpus_ppl(_scored(spark, sf_dir)).withColumn("average_ppl", F.round("average_ppl", 5))


@query(_PPL + """SELECT round(avg(ppl), 5) AS mean, round(quantile_cont(ppl, 0.5), 5) AS median, round(stddev_pop(ppl), 5) AS std, round(min(ppl), 5) AS min, round(max(ppl), 5) AS max,
  round(quantile_cont(ppl, 0.25), 5) AS p25, round(quantile_cont(ppl, 0.75), 5) AS p75 FROM s""")
def ppl_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = evaluate.distribution(evaluate.scorable(_scored(spark, sf_dir)))
    return stats.select(*[F.round(c, 5).alias(c) for c in stats.columns])


@query(_PPL + """SELECT lang, CAST(grouping(lang) AS INTEGER) AS is_total, count(*) AS num_samples, round(exp(sum(nll_sum) / sum(n_scored)), 5) AS average_ppl FROM s GROUP BY ROLLUP (lang)""")
def ppl_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    joined = _scored(spark, sf_dir).join(langs, "doc_id")
    return joined.rollup("lang").agg(F.grouping("lang").cast("int").alias("is_total"), F.count("*").alias("num_samples"), F.round(evaluate.micro_ppl(F.col("nll_sum"), F.col("n_scored")), 5).alias("average_ppl"))


@query(_PPL + """, g AS (SELECT count(*) AS num_samples, round(exp(sum(nll_sum) / sum(n_scored)), 5) AS average_ppl, round(quantile_cont(ppl, 0.5), 5) AS median FROM s)
SELECT 1 AS n_rows, num_samples, average_ppl, median FROM g""")
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as JSON, read back."""
    made = evaluate.report(_scored(spark, sf_dir))
    made = made.select(artifacts.report_json(made).alias("value"))
    back = made.select(F.from_json("value", "num_samples long, average_ppl double, median double").alias("r"))
    return back.select(F.lit(1).alias("n_rows"), "r.num_samples", F.round("r.average_ppl", 5).alias("average_ppl"), F.round("r.median", 5).alias("median"))


# ---- decoding ----

_LONG = """
WITH l AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS logit, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS token_id FROM embeddings)"""
_PROB = _LONG + """, m AS (SELECT *, exp(logit * 4 - max(logit * 4) OVER (PARTITION BY vec_id)) AS x FROM l),
p AS (SELECT vec_id, token_id, x / sum(x) OVER (PARTITION BY vec_id) AS prob FROM m)"""


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.long_logits(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def _probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.probabilities(_long(spark, sf_dir), "vec_id", 0.25)


@query(_LONG + """SELECT vec_id, round(sum(CASE WHEN token_id IN (label, label + 10, label + 20) THEN logit / 1.2 ELSE logit END), 6) AS logit_sum,
  round(max(CASE WHEN token_id IN (label, label + 10, label + 20) THEN logit / 1.2 ELSE logit END), 6) AS logit_max FROM l GROUP BY vec_id""")
def repetition_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.array(*[(F.col("label") + i).cast("int") for i in (0, 10, 20)])).alias("token_id"))
    out = decode.repetition_penalty(_long(spark, sf_dir), seen, "vec_id", 1.2)
    return out.groupBy("vec_id").agg(r6(F.sum("logit")).alias("logit_sum"), r6(F.max("logit")).alias("logit_max"))


@query(_PROB + "SELECT vec_id, token_id, round(prob, 9) AS prob FROM p")
def temperature_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probs(spark, sf_dir).select("vec_id", "token_id", F.round("prob", 9).alias("prob"))


@query(_PROB + """, c AS (SELECT *, coalesce(sum(prob) OVER (PARTITION BY vec_id ORDER BY prob DESC, token_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0.9, true) AS keep FROM p)
SELECT vec_id, count(*) AS n_kept, CAST(sum(token_id) AS BIGINT) AS id_sum FROM c WHERE keep GROUP BY vec_id""")
def nucleus_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = decode.nucleus(_probs(spark, sf_dir), "vec_id", 0.9)
    return kept.groupBy("vec_id").agg(F.count("*").alias("n_kept"), F.sum("token_id").alias("id_sum"))


@query(_LONG + "SELECT vec_id, token_id FROM (SELECT vec_id, token_id, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token_id) AS r FROM l) WHERE r = 1")
def greedy_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.greedy(_long(spark, sf_dir), "vec_id")


@query(_PROB + """, u AS (SELECT vec_id, token_id, round(sum(prob) OVER (PARTITION BY vec_id ORDER BY token_id ROWS UNBOUNDED PRECEDING) / sum(prob) OVER (PARTITION BY vec_id), 12) AS upto,
  CAST('0x' || substr(md5('7:' || vec_id || ':0'), 1, 12) AS BIGINT) / 281474976710656.0 AS u FROM p)
SELECT vec_id, CAST(coalesce(min(token_id) FILTER (WHERE upto >= u), max(token_id)) AS INTEGER) AS token_id FROM u GROUP BY vec_id""")
def inverse_cdf_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.sample(_probs(spark, sf_dir), "vec_id", 7)


_TRACE = "WITH t AS (SELECT vec_id // 8 AS seq_id, CAST(vec_id % 8 AS INTEGER) AS step, CAST(label AS INTEGER) AS token FROM embeddings)"


def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).cast("long").alias("seq_id"), (F.col("vec_id") % 8).cast("int").alias("step"), F.col("label").cast("int").alias("token"))


@query(_TRACE + """SELECT seq_id, step, CASE WHEN ended THEN 0 ELSE token END AS token, ended AS finished FROM (
  SELECT *, coalesce(max(token = 2) OVER (PARTITION BY seq_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM t)""")
def eos_pad_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.eos_padded(_trace(spark, sf_dir), "seq_id", "step", "token", 2, 0)


@query(_TRACE + """, s AS (SELECT seq_id, min(step) FILTER (WHERE token = 2) AS e, max(step) AS l FROM t GROUP BY seq_id)
SELECT CAST(CASE WHEN count(*) = count(e) THEN max(e) ELSE max(l) END AS INTEGER) AS stop_step FROM s""")
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.stop_step(_trace(spark, sf_dir), "seq_id", "step", "token", 2)


@query("SELECT doc_id, CAST(len(list_distinct(list_filter(string_split(text, ''), lambda c: c <> ''))) AS INTEGER) AS n_distinct FROM documents")
def distinct_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct items of a sequence, here of all characters of a text."""
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_distinct(chars)).alias("n_distinct"))


# ---- schedule ----


@query("""SELECT CAST(s AS BIGINT) AS step, round(CASE WHEN s <= 10 THEN 0.001 * greatest(s, 1) / 10 ELSE 0.0001 + 0.5 * 0.0009 * (1 + cos(pi() * (least(s, 100) - 10) / 90)) END, 12) AS lr FROM range(0, 121) r(s)""")
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(121).select(F.col("id").alias("step"), F.round(schedule.learning_rate(F.col("id"), 100, 1e-3), 12).alias("lr"))


@query("""SELECT epoch, doc_id, rn - 1 AS rank, (rn - 1) // 8 AS batch_id FROM (
  SELECT CAST(e AS INTEGER) AS epoch, doc_id, row_number() OVER (PARTITION BY e ORDER BY md5('1337:' || e || ':' || doc_id)) AS rn FROM documents, range(0, 2) r(e))""")
def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.batch_plan(table(spark, sf_dir, "documents"), "doc_id", 8, 1337, 2)


@query("""SELECT o_orderkey, rn - 1 AS rank, (rn - 1) // 64 AS batch_id FROM (
  SELECT o_orderkey, row_number() OVER (ORDER BY md5('1337:0:' || o_orderkey)) AS rn FROM orders)""")
def batch_plan_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.batch_plan(table(spark, sf_dir, "orders"), "o_orderkey", 64, 1337).drop("epoch")


_STEPS = """WITH s AS (SELECT CAST(i // 13 AS INTEGER) AS epoch, CAST(i % 13 AS INTEGER) AS step FROM range(0, 39) r(i)),
b AS (SELECT *, (step + 1) % 4 = 0 AS boundary, step = 12 AND (step + 1) % 4 <> 0 AS flush FROM s),
g AS (SELECT *, CAST(sum(CAST(boundary OR flush AS INTEGER)) OVER (ORDER BY epoch, step) AS BIGINT) AS global_step FROM b),
a AS (SELECT *, CAST(greatest(1, global_step - CAST(boundary OR flush AS INTEGER)) AS BIGINT) AS lr_step FROM g)
"""


def _planned(spark: SparkSession) -> DataFrame:
    return schedule.accumulation(schedule.steps(spark, 3, 13), 13, 4)


@query(_STEPS + "SELECT epoch, step, boundary, flush, global_step, lr_step FROM a")
def accum_global_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark)


@query(_STEPS + "SELECT epoch, step, CAST(global_step - CAST(flush AS INTEGER) AS BIGINT) AS global_step FROM a WHERE global_step - CAST(flush AS INTEGER) > 0 AND (global_step - CAST(flush AS INTEGER)) % 3 = 0")
def save_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.save_points(_planned(spark), 3)


@query("SELECT CAST(e + 1 AS INTEGER) AS epoch, 0 AS step, CAST((e + 1) * 4 AS BIGINT) AS global_step FROM range(0, 3) r(e)")
def epoch_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.epoch_saves(spark, 3, 13, 4)


@query(_STEPS + "SELECT epoch, step, global_step FROM a WHERE epoch > 1 OR (epoch = 1 AND step >= 6)")
def resume_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.resume(_planned(spark), 1, 6).select("epoch", "step", "global_step")


@query("SELECT CAST(label AS BIGINT) AS epoch, 4 * last(CAST(embedding[1] AS DOUBLE) ORDER BY vec_id) AS loss FROM embeddings GROUP BY label")
def reported_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("epoch"), F.col("vec_id").alias("step"), F.get("embedding", F.lit(0)).cast("double").alias("loss"))
    return schedule.reported_loss(rows, 4)


# ---- sources and artifacts ----

_VALUE = """SELECT event_id AS line_no, CASE event_id % 11 WHEN 0 THEN '' WHEN 1 THEN substr(props, 1, 4) WHEN 2 THEN '[1, 2]' WHEN 3 THEN '5' WHEN 4 THEN '{"other": 1}' ELSE '{"text": ' || CASE event_id % 5 WHEN 0 THEN 'null' WHEN 1 THEN 'true' WHEN 2 THEN '5.0' ELSE '"t' || event_id || '"' END || '}' END AS value FROM events"""


def _event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    text = F.when(i % 5 == 0, "null").when(i % 5 == 1, "true").when(i % 5 == 2, "5.0").otherwise(F.concat(F.lit('"t'), i.cast("string"), F.lit('"')))
    value = (
        F.when(i % 11 == 0, "").when(i % 11 == 1, F.substring("props", 1, 4)).when(i % 11 == 2, "[1, 2]").when(i % 11 == 3, "5").when(i % 11 == 4, '{"other": 1}')
        .otherwise(F.concat(F.lit('{"text": '), text, F.lit("}")))
    )
    return table(spark, sf_dir, "events").select(i.alias("line_no"), value.alias("value"))


@query(f"""SELECT line_no, CASE line_no % 5 WHEN 0 THEN 'None' WHEN 1 THEN 'True' WHEN 2 THEN '5.0' ELSE 't' || line_no END AS text FROM ({_VALUE}) WHERE line_no % 11 > 4""")
def jsonl_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonl.lenient(_event_lines(spark, sf_dir))[0]


@query(f"""SELECT reason, count(*) AS n FROM (SELECT CASE line_no % 11 WHEN 0 THEN 'malformed' WHEN 1 THEN 'malformed' WHEN 2 THEN 'no_object' WHEN 3 THEN 'no_object' ELSE 'missing' END AS reason
  FROM ({_VALUE}) WHERE line_no % 11 < 5 AND line_no < 500) GROUP BY reason""")
def jsonl_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonl.lenient(_event_lines(spark, sf_dir), max_samples=500)[1].groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""SELECT reason, count(*) AS n FROM (SELECT CASE line_no % 11 WHEN 0 THEN 'malformed' WHEN 1 THEN 'malformed' WHEN 2 THEN 'no_object' WHEN 3 THEN 'no_object' ELSE 'missing' END AS reason
  FROM ({_VALUE}) WHERE line_no % 11 < 5) GROUP BY reason""")
def jsonl_rejects_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all lines; ``jsonl_rejects`` has the loader's limit of lines."""
    return jsonl.lenient(_event_lines(spark, sf_dir))[1].groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT event_id, json_valid(props) AS valid, CAST(len(json_keys(props)) AS INTEGER) AS n_keys FROM events")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", jsonl.is_json(F.col("props")).alias("valid"), F.size(F.json_object_keys("props")).alias("n_keys"))


@query("SELECT doc_id, quality = 1 AS flag FROM labels")
def parse_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.when(F.col("quality") == 1, F.element_at(F.array(*map(F.lit, config.TRUE_WORDS)), (F.col("doc_id") % 5 + 1).cast("int"))).otherwise(F.element_at(F.array(*map(F.lit, config.FALSE_WORDS)), (F.col("doc_id") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "labels").select("doc_id", config.parse_bool(F.concat(F.lit(" "), F.upper(words))).alias("flag"))


@query("SELECT * FROM (VALUES (1, 'sft_final'), (2, 'latest_checkpoint'), (3, 'dpo'), (0, 'latest_checkpoint')) t(mode, name)")
def artifact_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = spark.createDataFrame([("sft_final",), ("latest_checkpoint",), ("dpo",), ("dpo_final",)], "name string")
    return artifacts.discover(artifacts.candidate_frame(spark), present)


@query("SELECT CAST(6400 * 512 + 512 + 8 * (2 * 512 + 4 * 512 * 512 + 3 * 512 * 1408) AS BIGINT) AS n_params")
def parameter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = [(n, list(s)) for n, s in config.ModelConfig().shapes().items()]
    frame = spark.createDataFrame(sizes, "name string, shape array<long>").withColumn("requires_grad", ~F.col("name").contains("mask"))
    return artifacts.parameter_count(frame)


@query("SELECT lang, CAST(greatest(1, 3 * CAST(ceil(count(*) / 8.0) AS BIGINT) // 4) AS BIGINT) AS total FROM documents GROUP BY lang")
def total_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of three epochs over each language's documents, eight a batch, four batches an update."""
    n = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return n.select("lang", schedule.total_steps(3, F.col("n"), 8, 4).alias("total"))


@query("SELECT doc_id, text FROM documents WHERE doc_id = 17")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("doc_id") == 17).select("doc_id", "text")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))


# ---- byte-pair encoding and the network ----

BPE_VOCAB = config.ModelConfig().vocab_size
#: Narrow and shallow; texts are as long as in the full size.
NETWORK = config.ModelConfig(dim=32, n_layers=2, n_heads=4, n_kv_heads=2, vocab_size=tokens.VOCAB, max_seq_len=config.ModelConfig().max_seq_len)
NEW_TOKENS = 8
TRAINED_LENGTH = 512


@query(r"""SELECT token, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(text, '''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+')) AS token FROM documents) GROUP BY token""")
def pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL lacks the pattern's look-ahead, which matters only for runs of white space; the table has none."""
    return bpe.pretoken_counts(table(spark, sf_dir, "documents"))


@query()
def bpe_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab, merges = bpe.train(table(spark, sf_dir, "documents"), BPE_VOCAB)
    rank = {a + b: i for i, (a, b) in enumerate(merges)}
    return spark.createDataFrame([(t, i, rank.get(t)) for t, i in vocab.items()], "token string, id int, merge_rank int")


@query("SELECT item_id, md5(text) AS text_md5, true AS shorter FROM benchmark")
def bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode again: the text comes back, in fewer ids than bytes."""
    items = table(spark, sf_dir, "benchmark")
    spec = bpe.tokenizer_json(*bpe.train(table(spark, sf_dir, "documents"), BPE_VOCAB))
    back = bpe.decode(bpe.encode(items, spec, "text"), spec, "ids", "back")
    return back.select("item_id", F.md5("back").alias("text_md5"), (F.size("ids") < F.octet_length("text")).alias("shorter"))


def _prompts(spark: SparkSession, sf_dir: str, length: int) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", examples.byte_tokens(template.wrap_text(F.col("text")), length).alias("ids"))


def _numeric(rows: DataFrame, run, columns: str) -> DataFrame:
    """``run(key, matrix)`` of each row's key and vectors, as the float columns ``columns``."""
    names = [c.split()[0] for c in columns.split(", ")]

    def batches(found):
        for b in found:
            made = [run(k, np.array(v, np.float64)) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([m[i] for m in made], pa.float64()) for i in range(len(names))]], names=["k", *names])

    return rows.mapInArrow(batches, "k long, " + columns)


_WHOLE = "seq_id, vec_id % 4 AS pos, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM (SELECT *, vec_id // 4 AS seq_id FROM embeddings) WHERE embedding IS NOT NULL AND len(embedding) = 64"


@query(f"""
WITH v AS (SELECT {_WHOLE}),
r AS (SELECT *, flatten(list_transform(range(0, 32), lambda i: [
  x[2 * i + 1] * cos(pos * pow(1e6, -2.0 * i / 64)) - x[2 * i + 2] * sin(pos * pow(1e6, -2.0 * i / 64)),
  x[2 * i + 1] * sin(pos * pow(1e6, -2.0 * i / 64)) + x[2 * i + 2] * cos(pos * pow(1e6, -2.0 * i / 64))])) AS q FROM v),
s AS (SELECT a.seq_id, a.pos, exp(list_inner_product(a.q, b.q) / 8) AS w, list_sum(list_transform(range(1, 65), lambda d: d * b.x[d])) AS f FROM r a JOIN r b ON a.seq_id = b.seq_id AND b.pos <= a.pos),
o AS (SELECT seq_id, pos, sum(w * f) / sum(w) AS f FROM s GROUP BY seq_id, pos)
SELECT seq_id, round(sum((pos + 1) * f), 5) AS checksum FROM o GROUP BY seq_id HAVING count(*) = 4
""")
def attention_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causal attention with rotary positions over sequences of four vectors; the projections are identities, in double precision."""
    eye = config.ModelConfig(dim=64, n_layers=1, n_heads=1, n_kv_heads=1, vocab_size=2, hidden_dim=2, max_seq_len=4)
    params = {n: np.eye(*shape) if n.split(".")[-1] in ("wq", "wk", "wv", "wo") else np.ones(shape) for n, shape in eye.shapes().items()}

    def run(_: int, x: np.ndarray) -> tuple[float]:
        out, _ = lm.Decoder(eye, params).attention(0, x[None], 0, None, None)
        return (round(float((out[0] * np.arange(1, 65) * np.arange(1, 5)[:, None]).sum()), 5),)

    rows = table(spark, sf_dir, "embeddings").where("size(embedding) = 64").groupBy(F.floor(F.col("vec_id") / 4).cast("long").alias("seq_id")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("v")).where("size(v) = 4")
    return _numeric(rows.select("seq_id", "v.embedding"), run, "checksum double").withColumnRenamed("k", "seq_id")


@query(f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64),
a AS (SELECT vec_id, w, list_reverse(w) AS g FROM v),
b AS (SELECT vec_id, g, list_transform(range(1, 65), lambda i: w[i] * (1 - 0.01 * 0.01) - 0.01 * g[i] / (abs(g[i]) + 1e-8)) AS w FROM a),
c AS (SELECT vec_id, list_transform(range(1, 65), lambda i: w[i] * (1 - 0.01 * 0.01) - 0.01 * ((0.9 * 0.1 * g[i] + 0.1 * 0.5 * w[i]) / (1 - 0.9 * 0.9))
  / (sqrt((0.999 * 0.001 * g[i] * g[i] + 0.001 * 0.25 * w[i] * w[i]) / (1 - 0.999 * 0.999)) + 1e-8)) AS w FROM b)
SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: i * w[i])), 5) AS checksum FROM c
""")
def adamw_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two updates of each vector: the first gradient is the vector reversed, the second half of what it has become."""
    def run(_: int, w: np.ndarray) -> tuple[float]:
        optimizer, params = train.AdamW(), {"w": w}
        params = optimizer.step(params, {"w": w[::-1]}, 0.01)
        params = optimizer.step(params, {"w": params["w"] / 2}, 0.01)
        return (round(float((params["w"] * np.arange(1, 65)).sum()), 5),)

    rows = table(spark, sf_dir, "embeddings").where("size(embedding) = 64").select("vec_id", "embedding")
    return _numeric(rows, run, "checksum double").withColumnRenamed("k", "vec_id")


@query(f"SELECT item_id, CAST(least({NETWORK.max_seq_len}, strlen(text) + 2) - 1 AS BIGINT) AS n_scored, true AS finite FROM benchmark")
def lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = evaluate.with_ppl(lm.score(_prompts(spark, sf_dir, NETWORK.max_seq_len), NETWORK, lm.init_params(NETWORK), "item_id"))
    return scored.select("item_id", "n_scored", ((F.col("ppl") > 1) & (F.col("ppl") < float("inf"))).alias("finite"))


@query()
def generate_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight sampled tokens after each prompt, step by step."""
    made = lm.generate_rows(_prompts(spark, sf_dir, tokens.prompt_budget(NETWORK.max_seq_len, NEW_TOKENS)), NETWORK, lm.init_params(NETWORK), "item_id", trace=True, max_new_tokens=NEW_TOKENS, seed=1)
    return made.select("item_id", "step", F.element_at("ids", -1).alias("token_id"))


@query()
def train_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two updates of pretraining on the benchmark's texts: epoch, step, updates, rate, loss."""
    ready = _prompts(spark, sf_dir, TRAINED_LENGTH).select("item_id", examples.pretrain_example(F.col("ids"), TRAINED_LENGTH).alias("e")).select("item_id", "e.*")
    plan = schedule.batch_plan(ready, "item_id", 64, 1337)
    _, _, log = train.train(ready, plan, "item_id", NETWORK, lm.init_params(NETWORK), learning_rate=5e-4)
    return spark.createDataFrame(log, "epoch int, step int, global_step int, lr double, loss double")
