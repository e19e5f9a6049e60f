"""Chat memory as a stateful stream: each user message is rewritten with the bounded history of its conversation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "conv_id string, turn long, text string, rewritten string, transcript string"
STATE = "roles array<string>, texts array<string>"


def remember(turns: DataFrame, messages: int = 6) -> DataFrame:
    """Streaming form of patterns.rewrite_turns: (conv_id, turn, role, text) in, a row per user message out.

    Messages of one batch are taken in the order of their turns; the state holds the last `messages` of them.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        roles, texts = (list(x) for x in state.get) if state.exists else ([], [])
        out = []
        for m in pd.concat(list(batches)).sort_values("turn").itertuples():
            if m.role == "user":
                last = next((t for r, t in zip(reversed(roles), reversed(texts)) if r == "assistant"), "")
                new = m.text if not roles else f"{m.text} (in the context of: {(last or '')[:80]}...)"
                out.append((key[0], m.turn, m.text, new, "\n".join(f"{(r or '').upper()}: {t}" for r, t in zip(roles, texts))))
            roles, texts = [*roles, m.role][-messages:], [*texts, m.text][-messages:]
        state.update((roles, texts))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "text", "rewritten", "transcript"])

    return turns.groupBy("conv_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
