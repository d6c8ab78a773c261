"""One chat turn for every row of a table: history, prompt, tail, generation, transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import ModelConfig
from corpusloom.functions import template, tokens
from corpusloom.operators import lm
from corpusloom.operators.lm import Params

#: The mode without chat tuning, which is asked with the bare input.
PRETRAIN = 0


def prompt(messages: Column, question: Column, mode: int, history_turns: int, system: str = template.SYSTEM) -> Column:
    """The prompt text of a new question after the last ``history_turns`` turns of ``messages``."""
    if mode == PRETRAIN:
        return template.pretrain_prompt(question)
    asked = F.array(F.struct(F.lit("user").alias("role"), question.alias("content")))
    return template.render_chat(F.concat(template.history_window(messages, history_turns), asked), system)


def turn(rows: DataFrame, config: ModelConfig, params: Params, *, mode: int = 1, history_turns: int = 0, max_new_tokens: int = 64, system: str = template.SYSTEM, key: str = "conv_id", trace: bool = False, **options) -> DataFrame:
    """``key, step, delta, response, messages, transcript`` for ``rows(key, messages, question)``.

    With ``trace`` a row for every generated token, whose ``delta`` is what it adds to the text shown so far; otherwise the last
    one alone. ``messages`` goes on with the question and, unless it is empty, the response. Rows whose question is blank say nothing.
    """
    budget = tokens.prompt_budget(config.max_seq_len, max_new_tokens)
    kept = template.history_window(F.col("messages"), history_turns)
    asked = rows.where(F.trim("question") != "").select(key, kept.alias("before"), F.trim("question").alias("question"), tokens.prompt_ids(prompt(F.col("messages"), F.trim("question"), mode, history_turns, system), budget).alias("ids"))
    made = lm.generate_rows(asked, config, params, key, trace=True, max_new_tokens=max_new_tokens, **options)
    shown = tokens.byte_text(F.filter("ids", lambda i: i >= len(tokens.SPECIALS)))
    before = tokens.byte_text(F.filter(F.slice("ids", 1, F.greatest(F.size("ids") - 1, F.lit(0))), lambda i: i >= len(tokens.SPECIALS)))
    steps = made.select(key, "step", shown.alias("response"), template.prefix_delta(shown, before).alias("delta"))
    if not trace:
        steps = steps.groupBy(key).agg(F.max("step").alias("step"), F.max_by("response", "step").alias("response"), F.max_by("delta", "step").alias("delta"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    said = F.array(message("user", F.col("question")), message("assistant", F.col("response")))
    said = F.concat("before", F.when(F.col("response") != "", said).otherwise(F.slice(said, 1, 1)))
    whole = steps.join(asked.select(key, "before", "question"), key)
    return whole.select(key, "step", "delta", "response", said.alias("messages"), template.transcript(said).alias("transcript"))
