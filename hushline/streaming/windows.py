"""Token-budget windows over a stream of lines: the greedy rule of `operators/windows.py`, kept between batches.

State per conversation is the open window (line numbers, at most a budget of tokens), so it stays
small however long the conversation grows. Lines of a batch are taken in order of line number.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from hushline.operators.windows import BUDGET

OUT = "window_id int, lines array<int>, tokens int, reason string"
STATE = "lines array<int>, tokens int, next_id int, since double"


def advance(state: tuple, rows: list[tuple], budget: int, now: float, limit: float) -> tuple[tuple, list[tuple]]:
    """(state, rows (line_no, tokens, last) in order) -> state, closed windows (id, lines, tokens, reason).

    A window closes before a line that would take it over the budget, when its oldest line has
    waited `limit` seconds (0: never), and after a row marked last. A row without tokens adds no line.
    """
    (held, used, at, since), out = state, []
    held = list(held)

    def close(reason: str) -> None:
        nonlocal held, used, at, since
        if held:
            out.append((at, held, used, reason))
            held, used, at, since = [], 0, at + 1, None

    if limit and since is not None and now - since >= limit:
        close("buffer_age")
    for line_no, tokens, last in rows:
        if tokens is not None:
            if used + tokens > budget:
                close("token_budget")
            held.append(line_no)
            used, since = used + tokens, now if since is None else since
        if last:
            close("end_of_input")
    return (held, used, at, since), out


def windows(lines: DataFrame, key: str = "conv_id", budget: int = BUDGET, limit: float = 0.0, clock: Callable[[], float] = time.time) -> DataFrame:
    """Stream of (key, line_no, tokens, last) -> key, window_id from 0, lines, tokens, reason.

    Rows of a null line_no come last in their batch (a bare end marker has tokens null, last true).
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = []
        if not state.hasTimedOut:
            for b in batches:
                none = b["line_no"].isna() | b["tokens"].isna()
                rows += [(0 if n else int(i), None if n else int(t), bool(e)) for i, t, e, n in zip(b["line_no"].fillna(0), b["tokens"].fillna(0), b["last"].fillna(False), none, strict=True)]
        rows.sort(key=lambda r: (r[1] is None, r[0]))
        before = tuple(state.get) if state.exists else ([], 0, 0, None)
        after, closed = advance(before, rows, budget, clock(), limit)
        state.update(after)
        if limit and after[0]:
            state.setTimeoutDuration(max(1, int((after[3] + limit - clock()) * 1000)))
        yield pd.DataFrame([(k[0], *c) for c in closed], columns=[key, "window_id", "lines", "tokens", "reason"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if limit else GroupStateTimeout.NoTimeout
    own = lines.select(key, "line_no", "tokens", "last")
    return own.groupBy(key).applyInPandasWithState(run, f"{key} {lines.schema[key].dataType.simpleString()}, {OUT}", STATE, "append", timeout)
