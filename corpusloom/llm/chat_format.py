"""Chat formatting by grammar round trip.

The grammar, in which ``*`` stands for any content without an unescaped control string::

    formatted := turn*
    turn      := "<s>" role "\\n" content "</s>" "\\n"

A backslash makes the next character plain. Control strings are fixed (``CONTROL``). A turn is first
rendered as it is; if the parser does not give back exactly the turn, the conflicting content is
escaped (``ESCAPES``, each rule taking in more), until it does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_TOKEN = re.compile(r"\\[\s\S]|" + "|".join(map(re.escape, CONTROL)) + r"|\\\Z")
_CONFLICT = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_ALL = re.compile(r"[\\<\[\n]")


class GrammarError(ValueError):
    pass


def _plain(text: str) -> str:
    return text


def _conflicts(text: str) -> str:
    return _CONFLICT.sub(lambda m: "\\" + m[0], text)


def _everything(text: str) -> str:
    return _ALL.sub(lambda m: "\\" + m[0], text)


ESCAPES = (_plain, _conflicts, _everything)
_UNESCAPE = re.compile(r"\\([\s\S])")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """The turns of a formatted text: role, content, and where the content's rendering starts and ends."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith("<s>", at):
            raise GrammarError(f"no turn begins at {at}")
        start, role_end = at + 3, None
        while role_end is None:
            line = formatted.find("\n", start)
            if line < 0:
                raise GrammarError("a role has no end")
            slashes = len(formatted[at + 3 : line]) - len(formatted[at + 3 : line].rstrip("\\"))
            role_end, start = (line, start) if slashes % 2 == 0 else (None, line + 1)
        role = formatted[at + 3 : role_end]
        if any(m[0] in CONTROL for m in _TOKEN.finditer(role)):
            raise GrammarError("a control string in a role")
        end = next((m for m in _TOKEN.finditer(formatted, role_end + 1) if m[0][0] != "\\" or len(m[0]) == 1), None)
        if end is None or end[0] != "</s>":
            raise GrammarError("a turn has no end, or a control string inside")
        if not formatted.startswith("\n", end.end()):
            raise GrammarError("no line end after a turn")
        turns.append((unescape(role), unescape(formatted[role_end + 1 : end.start()]), role_end + 1, end.start()))
        at = end.end() + 1
    return turns


def render(role: str, text: str) -> str:
    """One turn, escaped only as far as the round trip needs it."""
    for escape in ESCAPES:
        for role_escape in (escape, _everything):
            formatted = f"<s>{role_escape(role)}\n{escape(text)}</s>\n"
            try:
                turns = parse(formatted)
            except GrammarError:
                continue
            if len(turns) == 1 and turns[0][:2] == (role, text):
                return formatted
    raise GrammarError("no escape gives the turn back")  # not reached: the last rule leaves nothing to conflict


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, formatted``: every row rendered by itself, where it lies. Null roles and texts count as empty."""

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [render(r or "", t or "") for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["c", "n", "formatted"])

    kinds = [turns.schema[c].dataType.simpleString() for c in (conv, turn)]
    out = turns.select(F.col(conv), F.col(turn), F.col(role).cast("string"), F.col(text).cast("string")).toDF("c", "n", "r", "t")
    out = out.mapInArrow(rendered, f"c {kinds[0]}, n {kinds[1]}, formatted string")
    return out.select(F.col("c").alias(conv), F.col("n").alias(turn), "formatted")


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, formatted, loss_spans``: one row per conversation with the whole formatted text and the
    [start, end) code-point spans of assistant content in it. For conversations that fit a row;
    :func:`digest` streams those that do not."""
    chunks = format_turns(turns, conv, turn, role, text)
    whole = chunks.groupBy(conv).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(turn, "formatted"))), lambda x: x["formatted"]), "").alias("formatted"))

    @F.udf("array<struct<start:int,end:int>>", useArrow=True)
    def spans(formatted: str):
        return [(a, b) for r, _, a, b in parse(formatted) if r == "assistant"]

    return whole.withColumn("loss_spans", spans("formatted"))


class _Digest:
    def __init__(self) -> None:
        self.n = self.loss = self.chars = 0
        self.turns, self.masked = hashlib.sha256(), hashlib.sha256()

    def feed(self, formatted: str) -> None:
        """Whole turns of the formatted text, read back by the parser."""
        self.chars += len(formatted)
        for role, text, _, _ in parse(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == "assistant":
                self.loss += len(text)
                self.masked.update(text.encode("utf-8", "surrogatepass"))


def digest(chunks: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Digests of each conversation, read back from the output of :func:`format_turns`.

    Rows are ordered by turn (null first), ties by their rendering. Conversations are streamed in that
    order: a task holds one batch and a hash state, however long a conversation is. A null
    conversation id is one conversation of its own.
    """
    kind = chunks.schema[conv].dataType.simpleString()

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []

        def flush():
            names = ["c", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            types = [kept, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
            done.clear()
            return out

        def close():
            done.append((now, state.n, state.turns.hexdigest(), state.loss, state.masked.hexdigest(), state.chars))

        kept = None
        for b in batches:
            kept = b.column(0).type
            for c, chunk in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if state is None or c != now:
                    if state is not None:
                        close()
                    now, state = c, _Digest()
                state.feed(chunk)
            if len(done) >= 4096:
                yield flush()
        if state is not None:
            close()
        if done:
            yield flush()

    ordered = chunks.select(F.col(conv).alias("c"), F.col(turn).alias("n"), "formatted").repartition("c").sortWithinPartitions("c", "n", "formatted")
    out = ordered.select("c", "formatted").mapInArrow(read_back, f"c {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("c", conv)
