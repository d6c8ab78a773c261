"""Chat rendering as column expressions over ``array<struct<role, content>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SYSTEM = "You are a helpful assistant."
BOS, EOS, UNK = "<s>", "</s>", "<unk>"


def wrap_text(text: Column) -> Column:
    return F.concat(F.lit(BOS), text.cast("string"), F.lit(EOS))


def messages(role: str = "role", content: str = "text", order: str = "turn") -> Column:
    """Aggregate the rows of a conversation into its ordered messages."""
    return F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.coalesce(F.col(content), F.lit("")).alias("content")))),
        lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")),
    )


def parity_roles(msgs: Column) -> Column:
    """Roles by place: even places are the user's, odd ones the assistant's, whatever was stored."""
    return F.transform(msgs, lambda m, i: F.struct(F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), m["content"].alias("content")))


def render_chat(msgs: Column, system: str = SYSTEM) -> Column:
    """The prompt text. A first system message replaces the default one; later ones and unknown roles render
    as nothing; each user message opens an assistant turn. An empty list is an error."""
    first = F.element_at(F.when(F.size(msgs) > 0, msgs).otherwise(F.raise_error(F.lit("a conversation has no messages")).cast("array<struct<role:string,content:string>>")), 1)
    head = F.concat(F.lit(f"{BOS}system\n"), F.when(first["role"] == "system", first["content"]).otherwise(F.lit(system)), F.lit(f"{EOS}\n"))

    def turn(m: Column) -> Column:
        return (
            F.when(m["role"] == "user", F.concat(F.lit(f"{BOS}user\n"), m["content"], F.lit(f"{EOS}\n{BOS}assistant\n")))
            .when(m["role"] == "assistant", F.concat(m["content"], F.lit(f"{EOS}\n"))).otherwise(F.lit(""))
        )

    return F.concat(head, F.array_join(F.transform(msgs, turn), ""))


def pretrain_prompt(text: Column) -> Column:
    """What a model without chat tuning is asked: the text after a beginning mark, left open."""
    return F.concat(F.lit(BOS), text)


def response_prompt(prompt: Column, answer: Column, system: str = SYSTEM) -> Column:
    """A user turn and its answer, rendered."""
    return render_chat(F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("user", prompt), ("assistant", answer))]), system)


def history_window(msgs: Column, turns: int) -> Column:
    """The last ``2 * turns`` messages; none for 0."""
    if turns <= 0:
        return F.slice(msgs, 1, 0)
    return F.slice(msgs, F.greatest(F.size(msgs) - 2 * turns, F.lit(0)) + 1, 2 * turns)


def transcript(msgs: Column, colour: dict[str, str] | None = None) -> Column:
    """``Role: content`` lines, with ANSI colours by role if given."""
    def line(m: Column) -> Column:
        text = F.concat(F.initcap(m["role"]), F.lit(": "), m["content"])
        for role, code in (colour or {}).items():
            text = F.when(m["role"] == role, F.concat(F.lit(code), text, F.lit("\033[0m"))).otherwise(text)
        return text

    return F.array_join(F.transform(msgs, line), "\n")


def prefix_delta(now: Column, before: Column) -> Column:
    """What ``now`` adds to ``before``; all of it where ``before`` is no prefix."""
    before = F.coalesce(before, F.lit(""))
    return F.when(F.startswith(now, before), F.substring(now, F.length(before) + 1, F.length(now))).otherwise(now)
