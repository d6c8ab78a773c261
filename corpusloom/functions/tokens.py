"""The merge-free byte vocabulary and array functions over token ids.

Ids 0 to 2 are ``<unk>`` (which pads too), ``<s>`` and ``</s>``; a byte's id is 3 plus its rank in the
printable-byte alphabet of byte-level BPE, which follows from a rule (:func:`byte_id`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.binding import bind

PAD = UNK_ID = 0
BOS_ID, EOS_ID = 1, 2
SPECIALS = ("<unk>", "<s>", "</s>")
VOCAB = 259
_SPLIT = "(?=<unk>|<s>|</s>)|(?<=<unk>|<s>|</s>)"


def byte_id(b: int) -> int:
    """Printable bytes first, in order; then the others, in order."""
    printable = lambda x: 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255
    return len(SPECIALS) + (sum(map(printable, range(b))) if printable(b) else sum(map(printable, range(256))) + sum(not printable(x) for x in range(b)))


def encode_text(text: str) -> list[int]:
    """Ids of a text in plain Python; for markers and tests."""
    import re

    out: list[int] = []
    for piece in re.split("(<unk>|<s>|</s>)", text):
        out += [SPECIALS.index(piece)] if piece in SPECIALS else [byte_id(b) for b in piece.encode()]
    return out


def byte_ids(text: Column) -> Column:
    table = F.array(*[F.lit(byte_id(b)) for b in range(256)])
    latin = lambda piece: F.filter(F.split(F.decode(F.encode(piece, "UTF-8"), "ISO-8859-1"), ""), lambda c: c != "")

    def piece_ids(piece: Column) -> Column:
        special = F.array_position(F.array(*map(F.lit, SPECIALS)), piece)
        return F.when(special > 0, F.array((special - 1).cast("int"))).otherwise(F.transform(latin(piece), lambda c: F.element_at(table, F.ascii(c) + 1)))

    return F.flatten(F.transform(F.split(text, _SPLIT), piece_ids))


def byte_text(ids: Column, skip_special: bool = True) -> Column:
    """The text of ids; a code point that was cut gives a replacement character."""
    chars = F.array(*[F.lit(bytes([b]).decode("latin-1")) for b in sorted(range(256), key=byte_id)])
    word = lambda i: F.when(i >= 3, F.element_at(chars, F.greatest(i - 2, F.lit(1)))).otherwise(F.lit("") if skip_special else F.element_at(F.array(*map(F.lit, SPECIALS)), F.least(i + 1, F.lit(3))))
    return F.make_valid_utf8(F.encode(F.array_join(F.transform(ids, word), ""), "ISO-8859-1").cast("string"))


def truncate(ids: Column, n: int) -> Column:
    return F.slice(ids, 1, n)


def tail(ids: Column, n: int) -> Column:
    return F.slice(ids, F.greatest(F.size(ids) - n, F.lit(0)) + 1, n)


def pad_to(ids: Column, n: int | Column, pad: int = PAD) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(F.lit(n) - F.size(ids), F.lit(0)) if isinstance(n, int) else F.greatest(n - F.size(ids), F.lit(0))))


def attention_mask(n_tokens: Column, padded: Column | int) -> Column:
    padded = F.lit(padded) if isinstance(padded, int) else padded
    return F.when(padded > 0, F.transform(F.sequence(F.lit(1), F.greatest(padded, F.lit(1))), lambda i: (i <= n_tokens).cast("int"))).otherwise(F.array().cast("array<int>"))


def pad_mask(ids: Column, pad: int = PAD) -> Column:
    return F.transform(ids, lambda i: (i != pad).cast("int"))


def prompt_budget(max_seq_len: int, max_new_tokens: int) -> int:
    return max(8, max_seq_len - max_new_tokens)


def prompt_ids(text: Column, budget: int) -> Column:
    """A prompt's ids. One of more than ``budget`` is cut to its last ids, decoded and encoded again, as it is shown to the model:
    a character that the cut goes through becomes replacement characters."""
    cut = lambda ids: byte_ids(byte_text(tail(ids, budget), skip_special=False))
    return bind(byte_ids(text), lambda ids: F.when(F.size(ids) > budget, cut(ids)).otherwise(ids))


def shift(ids: Column, mask: Column) -> Column:
    """``x, y, loss_mask``: inputs, targets one place on, and the targets' mask."""
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return F.struct(F.slice(ids, 1, n).alias("x"), F.slice(ids, 2, n).alias("y"), F.slice(mask, 2, n).alias("loss_mask"))


def assistant_mask(ids: Column, bos: list[int], eos: list[int], max_length: int, pad: int = PAD) -> Column:
    """1 on what an assistant says: after each opening marker up to and with its terminator.

    A span without a terminator runs to the end; scanning goes on behind a terminator. Places from
    ``max_length`` on and pads are 0.
    """

    def found(ids: Column, marker: list[int]) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(ids) - len(marker), F.lit(0))), lambda i: F.get(ids, i) == marker[0])
        return F.filter(at, lambda i: F.slice(ids, i + 1, len(marker)) == F.array(*map(F.lit, marker)))

    empty = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"))

    def spans_of(ids: Column, ends: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            a = i + len(bos)
            stop = F.coalesce(F.array_min(F.filter(ends, lambda x: x >= a)) + len(eos), F.size(ids))
            span = F.struct(a.alias("a"), F.least(stop, F.lit(max_length)).alias("b"))
            return F.when(i < acc["pos"], acc).otherwise(F.struct(stop.alias("pos"), F.concat(acc["spans"], F.array(span)).alias("spans")))

        return F.aggregate(found(ids, bos), empty, step, lambda acc: acc["spans"])

    def mask_of(ids: Column, spans: Column) -> Column:
        return F.transform(ids, lambda v, j: ((v != pad) & F.exists(spans, lambda s: (j >= s["a"]) & (j < s["b"]))).cast("int"))

    mask = bind(ids, lambda x: bind(found(x, eos), lambda ends: bind(spans_of(x, ends), lambda spans: mask_of(x, spans))))
    return F.when(F.size(ids) > 0, mask).otherwise(F.array().cast("array<int>"))
