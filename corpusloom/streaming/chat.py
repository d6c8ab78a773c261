"""Chat history as keyed state: the last ``2 * turns`` messages of each conversation.

State stays, or with a time to live goes after so long without a message, in processing time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MESSAGES = "conv_id long, roles array<string>, texts array<string>"
OUT = "conv_id long, turn long, history_roles array<string>, history_texts array<string>"


def history_stream(turns: DataFrame, n_turns: int, ttl_ms: int | None = None) -> DataFrame:
    """For each user turn of ``turns(conv_id, turn, role, text)`` the messages before it, as the batch operator gives them.

    Turns of a micro-batch are taken in turn order; turns that come later count as later. A time to live keeps
    a query going, so it does not end by itself with ``availableNow``.
    """
    keep = 2 * n_turns
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        roles, texts = map(list, state.get) if state.exists else ([], [])
        rows = pd.concat(list(batches)).sort_values("turn")
        out = []
        for r in rows.itertuples():
            text = r.text if r.text is not None else ""
            if r.role == "user":
                out.append((key[0], r.turn, list(roles), list(texts)))
            roles, texts = ((roles + [r.role])[-keep:], (texts + [text])[-keep:]) if keep else ([], [])
        state.update((roles, texts))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "turn", "history_roles", "history_texts"])

    return turns.groupBy("conv_id").applyInPandasWithState(step, OUT, "roles array<string>, texts array<string>", "append", timeout)
