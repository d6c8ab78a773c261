"""Training examples from text, conversations and preferences, over the byte vocabulary or any id column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import template, tokens

MARKER = tokens.encode_text(f"{template.BOS}assistant\n")
TERMINATOR = tokens.encode_text(f"{template.EOS}\n")


def byte_tokens(text: Column, max_length: int) -> Column:
    """The first ``max_length`` ids. A character is an id at least, but that a special string of up to five is one; no more
    characters are expanded than these ids can take."""
    specials = F.regexp_count(F.substring(text, 1, 5 * max_length + 5), F.lit("|".join(tokens.SPECIALS)))
    return tokens.truncate(tokens.byte_ids(F.substring(text, F.lit(1), specials * 4 + max_length + 5)), max_length)


def pretrain_example(ids: Column, max_length: int) -> Column:
    """Padded ids shifted into inputs, targets and a mask that leaves pads out."""
    padded = tokens.pad_to(tokens.truncate(ids, max_length), max_length)
    return tokens.shift(padded, tokens.pad_mask(padded))


def chat_example(ids: Column, max_length: int) -> Column:
    """As :func:`pretrain_example`, with a mask of what the assistant says."""
    padded = tokens.pad_to(tokens.truncate(ids, max_length), max_length)
    return tokens.shift(padded, tokens.assistant_mask(padded, MARKER, TERMINATOR, max_length))


def conversations(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``conv, messages`` from rows (conv, turn, role, text)."""
    return turns.groupBy(conv).agg(template.messages().alias("messages"))


def sft_examples(turns: DataFrame, max_length: int, conv: str = "conv_id", system: str = template.SYSTEM) -> DataFrame:
    """``conv, prompt, ids, mask``, roles by parity, ids cut to ``max_length``, the mask over them."""
    prompts = conversations(turns, conv).select(conv, template.render_chat(template.parity_roles(F.col("messages")), system).alias("prompt"))
    coded = prompts.withColumn("ids", byte_tokens(F.col("prompt"), max_length))
    return coded.withColumn("mask", tokens.assistant_mask(F.col("ids"), MARKER, TERMINATOR, max_length))


def preference_pairs(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``conv, turn, prompt, chosen, rejected``: each user turn that an assistant turn follows, with that reply chosen
    and the conversation's next reply (after the last, its first) rejected; a lone reply is set against an empty one."""
    w = Window.partitionBy(conv).orderBy("turn")
    text = F.coalesce("text", F.lit(""))
    paired = turns.select(conv, "turn", "role", text.alias("prompt"), F.lead("role").over(w).alias("next_role"), F.lead(text).over(w).alias("chosen"))
    paired = paired.where("role = 'user' and next_role = 'assistant'")
    other = F.coalesce(F.lead("chosen").over(w), F.first("chosen").over(w))
    alone = F.count("*").over(Window.partitionBy(conv)) == 1
    return paired.select(conv, "turn", "prompt", "chosen", F.when(alone, F.lit("")).otherwise(other).alias("rejected"))


def preference_examples(pairs: DataFrame, max_length: int, system: str = template.SYSTEM) -> DataFrame:
    """``pairs`` with ``chosen_ids, chosen_mask, rejected_ids, rejected_mask``."""
    for side in ("chosen", "rejected"):
        ids = byte_tokens(template.response_prompt(F.col("prompt"), F.col(side), system), max_length)
        pairs = pairs.withColumn(f"{side}_ids", ids)
    for side in ("chosen", "rejected"):
        pairs = pairs.withColumn(f"{side}_mask", tokens.assistant_mask(F.col(f"{side}_ids"), MARKER, TERMINATOR, max_length))
    return pairs


def history(turns: DataFrame, n_turns: int, conv: str = "conv_id") -> DataFrame:
    """``conv, turn, history``: for each user turn the last ``2 * n_turns`` messages before it."""
    w = Window.partitionBy(conv).orderBy("turn").rowsBetween(-2 * n_turns, -1)
    message = F.struct(F.col("role").alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    before = F.collect_list(message).over(w) if n_turns > 0 else F.slice(F.array(message), 1, 0)
    return turns.withColumn("history", before).where("role = 'user'").select(conv, "turn", "history")
