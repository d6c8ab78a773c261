"""Token counts by a two-tier map-side lookup of pre-token lengths; no pre-token is ever shuffled."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FREQUENT = 32_768
#: Words that one partition reports for the frequent table; bounds what the merge moves.
REPORTED = 2_048
CACHED = 400_000
#: Longer pre-tokens are encoded each time, so that the cache stays small.
LONGEST_CACHED = 48


def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def odd_characters(tok, pattern: str) -> np.ndarray:
    """By code point, whether the pattern might split it otherwise than the library does.

    Every assigned character is tried between letters, digits, marks and spaces; those that are not
    assigned count as odd. Blocks that split alike as a whole need no second look.
    """
    import regex

    spans = regex.compile(pattern).finditer
    level = tok.pre_tokenizer.pre_tokenize_str

    def alike(chars: list[str]) -> bool:
        text = "".join(f"a{c}b 1{c}2 !{c}? {c} \n{c}{c}x" for c in chars)
        return [m.span() for m in spans(text)] == [at for _, at in level(text)]

    odd = np.ones(0x110000, dtype=bool)
    assigned = [c for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    for at in range(0, len(assigned), 128):
        block = assigned[at : at + 128]
        if alike([chr(c) for c in block]):
            odd[block] = False
        else:
            odd[[c for c in block if alike([chr(c)])]] = False
    return odd


class PretokenCounter:
    """Counts tokens of whole texts as ``tokenizer.encode(text, add_special_tokens=False)`` does.

    First tier: the given table of frequent pre-tokens. Second tier: a cache of what this worker has
    encoded, emptied when it reaches ``CACHED`` entries. Special strings inside a text are one token
    each, as the library's default has it. Texts with an odd character (:func:`odd_characters`) go to the library whole.
    """

    def __init__(self, path: str, pattern: str, frequent: dict[str, int], odd: np.ndarray | None = None):
        import regex

        self.tok = _tokenizer(path)
        self.find = regex.compile(pattern).findall
        self.table = odd_characters(self.tok, pattern) if odd is None else odd
        added = self.tok.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
            raise ValueError("added tokens that reach beyond their own string are not supported")
        self.special = re.compile("|".join(re.escape(t.content) for t in sorted(added, key=lambda t: -len(t.content)))) if added else None
        self.frequent = frequent
        outer = self

        class Cache(dict):
            def __missing__(self, piece: str) -> int:
                n = len(outer.tok.encode(piece, add_special_tokens=False).ids)
                if len(piece) <= LONGEST_CACHED:
                    if len(self) >= CACHED + len(outer.frequent):
                        self.clear()
                        self.update(outer.frequent)
                    self[piece] = n
                return n

        self.lengths = Cache(frequent)

    def odd(self, text: str) -> bool:
        return bool(self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any())

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.odd(text):
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        if self.special and self.special.search(text):
            pieces = self.special.split(text)
            return len(pieces) - 1 + sum(self.count(p) for p in pieces)
        return sum(map(self.lengths.__getitem__, self.find(text)))


#: The table that this worker's counter was made with, and the counter: its cache lives as long as the worker.
_own: list = [None, None]


def _counter(path: str, pattern: str, tables: tuple) -> PretokenCounter:
    if _own[0] is not tables:
        _own[:] = tables, PretokenCounter(path, pattern, *tables)
    return _own[1]


def frequent_lengths(docs: DataFrame, path: str, text: str = "text") -> dict[str, int]:
    """Lengths of the ``FREQUENT`` most frequent space-led words of all documents.

    Each partition counts its own words and reports at most ``REPORTED`` of them; only those
    summaries are merged. The table only saves time: a word that it lacks is encoded where it occurs.
    Its size is bounded by ``FREQUENT`` entries of at most ``LONGEST_CACHED`` characters.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(t.split(" "))
            if len(seen) > 40 * REPORTED:  # what a partition keeps is bounded too
                seen = Counter(dict(seen.most_common(10 * REPORTED)))
        top = [(w, n) for w, n in seen.most_common(2 * REPORTED) if w.isalpha() and len(w) < LONGEST_CACHED][:REPORTED]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    rows = (
        docs.select(F.col(text).alias("text")).mapInArrow(summarise, "word string, n long")
        .groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    )
    tok = _tokenizer(path)
    words = [" " + r.word for r in rows]
    return dict(zip(words, (len(e.ids) for e in tok.encode_batch(words, add_special_tokens=False)), strict=True))


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` of every whole text; a null text counts as empty.

    Rows stay where they are: repeated keys, null keys and other columns do no harm, an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    tables = spark.sparkContext.broadcast((frequent_lengths(docs, path, text), odd_characters(_tokenizer(path), pattern)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, pattern, tables.value)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, max(1, batch.num_rows), 256):
                n = [counter.count(t or "") for t in texts.slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), batch.column(2).slice(at, 256), pa.array(n, pa.int64())], names=["k", "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    counted = docs.select(
        F.col(key).alias("k"), F.col(text).alias("t"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")
    ).mapInArrow(count, f"k {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
