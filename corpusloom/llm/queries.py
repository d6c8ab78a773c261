"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import chat_format, decontaminate, jaccard_join, language_id, line_dedup, packing, sharding, token_counts, toxicity, vector_search
from corpusloom.llm._common import table

SHARDS = 16
TOKENIZER = "byte_bpe_50k.json"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return clean.select("row.doc_id", "n_lines", "n_removed", F.md5("row.text").alias("text_md5"))


OP1_SQL = f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents),
b AS (SELECT trim(line, ' ') AS line, min(doc_id) AS keep FROM l WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}),
d AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
k AS (SELECT d.*, b.line IS NOT NULL AND d.doc_id <> b.keep AS gone FROM d LEFT JOIN b ON trim(d.line, ' ') = b.line)
SELECT t.doc_id, CASE WHEN coalesce(any_value(t.text), '') = '' THEN 0 ELSE count(*) END AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
  CASE WHEN any_value(t.text) IS NOT NULL THEN md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) END AS text_md5
FROM documents t LEFT JOIN k USING (doc_id) GROUP BY t.doc_id
"""


def _remainder(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(docs.where(_remainder(3) != 1), labels.where(_remainder(3) != 1))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_passages", "passage_from", "passage_to")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = "</s>[INST] ok [/INST]"
    turns = turns.unionByName(spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string"))
    return chat_format.digest(chat_format.format_turns(turns))


_ESCAPED = "replace(replace(replace(replace(replace(replace(replace({x}, chr(92), chr(92)||chr(92)), '<s>', chr(92)||'<s>'), '</s>', chr(92)||'</s>'), '[INST]', chr(92)||'[INST]'), '[/INST]', chr(92)||'[/INST]'), '<<SYS>>', chr(92)||'<<SYS>>'), '<</SYS>>', chr(92)||'<</SYS>>')"
OP3_SQL = f"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, shown)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, shown) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(shown)) AS BIGINT) AS formatted_chars
FROM (SELECT *, '<s>' || {_ESCAPED.format(x="role")} || chr(10) || {_ESCAPED.format(x="text")} || '</s>' || chr(10) AS shown FROM t) GROUP BY conv_id
"""


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def n_words(text: Column) -> Column:
    return F.when(F.trim(text) != "", F.size(F.split(F.trim(text), r"\s+"))).otherwise(0)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), n_words(F.col("text")), cluster=F.xxhash64("text"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


def language_model(docs: DataFrame) -> language_id.Model:
    return language_id.fit_language_model(docs.where(_remainder(4) != 2).select("doc_id", "text", "lang"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs.select("doc_id", "text"), language_model(docs))
    return found.select("row.doc_id", "lang_pred", "score", "rejected").select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


#: The checksum's table follows from its polynomial; a shard is the one whose hash with the key is largest, as weights are equal.
OP6_SQL = f"""
WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_concat([CAST(i AS BIGINT)], CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
b AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
y AS (SELECT doc_id, strlen(text) + 1 AS size, list_transform(range(0, strlen(text)), lambda i: CAST('0x' || substr(hex(encode(text)), 2 * i + 1, 2) AS BIGINT)) AS bytes FROM b),
c AS (SELECT doc_id, CAST(size AS BIGINT) AS size, xor(list_reduce(list_concat([4294967295], bytes), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS crc FROM y, tab),
h AS (SELECT *, list_transform(range(0, {SHARDS + 1}), lambda s: CAST('0x' || substr(md5('k' || doc_id || ':' || s), 1, 13) AS BIGINT)) AS u FROM c),
a AS (SELECT *, CAST(list_position(u, list_max(list_slice(u, 1, {SHARDS}))) - 1 AS INTEGER) AS shard, CAST(list_position(u, list_max(u)) - 1 AS INTEGER) AS grown_shard,
  CAST('0x' || substr(md5(doc_id || ':' || crc || ':' || size), 1, 13) AS BIGINT) AS o FROM h)
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY o, doc_id, crc, size) - 1 AS slot, grown_shard FROM a
"""


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _op9_sql() -> str:
    span, window = decontaminate.SPAN, decontaminate.WINDOW

    def keys(at: str) -> str:
        masks = [[o + 1 for o, bit in enumerate(m) if bit == "1"] for m in decontaminate.MASKS]
        return "[" + ", ".join(f"'{n}:' || concat_ws(' ', {', '.join(f'w[{at} + {o}]' for o in m)})" for n, m in enumerate(masks)) + "]"

    split = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, {split} AS w FROM documents WHERE text IS NOT NULL), b AS (SELECT item_id, {split} AS w FROM benchmark WHERE text IS NOT NULL),
di AS (SELECT doc_id, w, unnest(range(0, len(w) - {span} + 1)) AS i FROM d), bj AS (SELECT item_id, w, unnest(range(0, len(w) - {span} + 1)) AS j FROM b),
dk AS (SELECT doc_id, i, unnest({keys('i')}) AS k FROM di), bk AS (SELECT item_id, j, unnest({keys('j')}) AS k FROM bj),
hit AS (SELECT DISTINCT doc_id, item_id, i, j FROM dk JOIN bk USING (k)),
v AS (SELECT doc_id, item_id, i, j, least(len(b.w), {window}) AS win, greatest(j - {window - span}, 0) AS lo, least(j, greatest(len(b.w) - least(len(b.w), {window}), 0)) AS hi, d.w AS dw, b.w AS bw FROM hit JOIN d USING (doc_id) JOIN b USING (item_id)),
m AS (SELECT doc_id, item_id, i, j, win, list_max(list_transform(range(lo, hi + 1), lambda s: len(list_filter(range(s, s + win), lambda p: i - j + p >= 0 AND dw[i - j + p + 1] = bw[p + 1])))) AS matched FROM v)
SELECT doc_id, item_id, count(*) AS n_hits, CAST(max(matched) AS INTEGER) AS matched, CAST(min(i) AS INTEGER) AS doc_from, CAST(max(i) + {span - 1} AS INTEGER) AS doc_to
FROM m WHERE matched >= ceil(win * {decontaminate.AGREE}) GROUP BY doc_id, item_id
UNION ALL
SELECT doc_id, item_id, count(*), CAST(n AS INTEGER), CAST(min(i) AS INTEGER), CAST(max(i) + n - 1 AS INTEGER) FROM (
  SELECT doc_id, item_id, len(b.w) AS n, unnest(list_filter(range(0, len(d.w) - len(b.w) + 1), lambda i: list_slice(d.w, i + 1, i + len(b.w)) = b.w)) AS i
  FROM d, (SELECT * FROM b WHERE len(w) BETWEEN {decontaminate.SHORTEST} AND {span - 1}) b) GROUP BY doc_id, item_id, n
"""


OP10_SQL = """
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents),
d AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN NULL ELSE array_to_string(w, ' ') END AS c, w FROM t),
c AS (SELECT c, any_value(w) AS w, min(doc_id) AS rep, count(*) AS n FROM d WHERE c IS NOT NULL GROUP BY c),
x AS (SELECT row_number() OVER (ORDER BY rep, c) AS id, * FROM c),
s AS (SELECT id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s FROM x),
e AS (SELECT id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.id AS u, b.id AS v FROM e a JOIN e b ON a.g = b.g AND a.id <> b.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))),
r AS (SELECT id, id AS root FROM x UNION SELECT p.v, r.root FROM r JOIN p ON p.u = r.id),
m AS (SELECT id, min(root) AS root FROM r GROUP BY id),
k AS (SELECT m.root, min(x.rep) AS class_id FROM m JOIN x USING (id) GROUP BY m.root),
l AS (SELECT u AS id, count(*) AS n_links FROM p GROUP BY u)
SELECT d.doc_id, coalesce(k.class_id, d.doc_id) AS class_id, coalesce(l.n_links, 0) AS n_links, coalesce(x.n - 1, 0) AS n_copies
FROM d LEFT JOIN x ON d.c = x.c LEFT JOIN m ON m.id = x.id LEFT JOIN k ON k.root = m.root LEFT JOIN l ON l.id = x.id
"""


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_chat_format": op3_chat_format,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_sharding": op6_sharding,
    "op7_language_id": op7_language_id,
    "op8_token_counts": op8_token_counts,
    "op9_decontamination": op9_decontamination,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
}
ORACLE_SQL: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op3_chat_format": OP3_SQL, "op4_exact_top_k": OP4_SQL, "op6_sharding": OP6_SQL, "op9_decontamination": _op9_sql(), "op10_ngram_jaccard_join": OP10_SQL}
