"""Byte-level BPE: distributed pre-token counts, merge training on the counts, Arrow-batched encoding.

Only counting sees the corpus. The merges are learned on all distinct pre-tokens, of which every task of a barrier stage holds
a share (``merges.py``); the driver gets the merges.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.tokens import SPECIALS, byte_id
from corpusloom.operators import merges as merging
from corpusloom.operators.merges import alphabet

#: The published pre-token pattern of byte-level BPE. (?U): character classes follow Unicode.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def pretokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + PATTERN), F.lit(0))


def pretoken_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``token, n`` over all texts; words are counted before the shuffle."""
    return docs.select(F.explode(pretokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def learn_merges(words: Iterable[tuple[str, int]], n_merges: int) -> list[tuple[str, str]]:
    """The ``n_merges`` most frequent pairs one after the other; of equally frequent ones the smaller pair."""
    return merging.from_words(words, n_merges)


def build_vocab(merges: list[tuple[str, str]]) -> dict[str, int]:
    """Specials, then bytes, then merged tokens in their order."""
    to_char = alphabet()
    tokens = [*SPECIALS, *[to_char[b] for b in sorted(range(256), key=byte_id)]]
    tokens += [left + right for left, right in merges]
    return {t: i for i, t in enumerate(dict.fromkeys(tokens))}


def train(docs: DataFrame, vocab_size: int = 6400, text: str = "text") -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Vocabulary and merges; ids 0 to 2 are the specials."""
    if vocab_size < 256 + len(SPECIALS):
        raise ValueError("a vocabulary holds the specials and all bytes at least")
    merges = merging.from_counts(pretoken_counts(docs, text), vocab_size - 256 - len(SPECIALS))
    vocab = build_vocab(merges)
    assert [vocab[s] for s in SPECIALS] == [0, 1, 2]
    return vocab, merges


def tokenizer_json(vocab: dict[str, int], merges: list[tuple[str, str]]) -> str:
    """The tokenizer as one JSON document that the public tokenizers library loads."""
    added = [{"id": i, "content": s, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for i, s in enumerate(SPECIALS)]
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "vocab": vocab, "merges": [list(m) for m in merges]}
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": added, "normalizer": None, "pre_tokenizer": level, "post_processor": None, "decoder": level, "model": model}, ensure_ascii=False)


def save(spark: SparkSession, path: str, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
    """``vocab`` and ``merges`` as Parquet, and the JSON document as a text file."""
    spark.createDataFrame(sorted(vocab.items(), key=lambda x: x[1]), "token string, id int").coalesce(1).write.parquet(f"{path}/vocab")
    spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "rank int, left string, right string").coalesce(1).write.parquet(f"{path}/merges")
    spark.createDataFrame([(tokenizer_json(vocab, merges),)], "value string").coalesce(1).write.text(f"{path}/tokenizer")


def load(spark: SparkSession, path: str) -> tuple[dict[str, int], list[tuple[str, str]]]:
    vocab = {r.token: r.id for r in spark.read.parquet(f"{path}/vocab").collect()}
    merges = [(r.left, r.right) for r in spark.read.parquet(f"{path}/merges").orderBy("rank").collect()]
    return vocab, merges


def _library(spec: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec)


def encode(rows: DataFrame, spec: str, text: str, out: str = "ids") -> DataFrame:
    """``rows`` with the ids of a text column, one Arrow batch at a time; ``spec`` is :func:`tokenizer_json`'s document."""
    shared = rows.sparkSession.sparkContext.broadcast(spec)  # as large as the vocabulary

    def ids(batches):
        import pandas as pd

        tok = _library(shared.value)
        for b in batches:
            there = b.notna()
            coded = iter(tok.encode_batch(b[there].tolist(), add_special_tokens=False))
            yield pd.Series([next(coded).ids if x else None for x in there], index=b.index, dtype=object)

    return rows.withColumn(out, F.pandas_udf(_typed(ids), "array<int>")(text))


def _typed(f):
    """``f`` with the annotations by which Spark knows an iterator of series."""
    import pandas as pd

    f.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return f


def decode(rows: DataFrame, spec: str, ids: str, out: str = "text", skip_special: bool = True) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(spec)

    def text(batches):
        tok = _library(shared.value)
        for b in batches:
            yield b.map(lambda x: tok.decode(list(x), skip_special_tokens=skip_special) if x is not None else None)

    return rows.withColumn(out, F.pandas_udf(_typed(text), "string")(ids))
