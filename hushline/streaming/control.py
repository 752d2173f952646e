"""Stateful operators with a small state per key: the queue controller and running speaker profiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

RATE, LEAST_SECONDS = 16_000, 0.5


def desired(state: str, depth: int, age: float | None, high: int, low: int, longest: float) -> tuple[str, str | None]:
    """The next state and why it changes. Deep queues and old entries promote; a drained queue without old entries demotes."""
    old = age is not None and age >= longest
    if state == "background" and (old or depth > high):
        return "promoted", "timeout" if old else "high_watermark"
    if state == "promoted" and depth < low and not old:
        return "background", "low_watermark"
    return state, None


def _stateful(rows: DataFrame, key: str, order: str, out: str, shape: str, start: tuple, fold: Callable) -> DataFrame:
    """fold(state, rows of one key in order) -> state, output tuples; a batch of a key is sorted by `order`."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(batches)).sort_values(order, kind="stable")
        after, found = fold(tuple(state.get) if state.exists else start, got)
        state.update(after)
        yield pd.DataFrame([(k[0], *f) for f in found], columns=[key, *[c.split()[0] for c in out.split(", ")]])

    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {rows.schema[key].dataType.simpleString()}, {out}", shape, "append", GroupStateTimeout.NoTimeout)


def controlled(samples: DataFrame, key: str, high: int, low: int, longest: float) -> DataFrame:
    """Stream of (key, seq, depth, age or null) -> key, seq, depth, state, reason (null: no change)."""
    if low >= high:
        raise ValueError("the low watermark must lie below the high one")

    def fold(state, rows):
        (now,), out = state, []
        for seq, depth, age in zip(rows["seq"], rows["depth"], rows["age"], strict=True):
            now, reason = desired(now, int(depth), None if pd.isna(age) else float(age), high, low, longest)
            out.append((int(seq), int(depth), now, reason))
        return (now,), out

    return _stateful(samples.select(key, "seq", "depth", "age"), key, "seq", "seq long, depth int, state string, reason string", "state string", ("background",), fold)


def profiles(speech: DataFrame, key: str, embed: Callable[[np.ndarray], np.ndarray | None], update_seconds: float) -> DataFrame:
    """Stream of (key, seq, samples array<float>, last) -> key, seq, seconds, profile at each update.

    New speech is embedded once it lasts `update_seconds` (half a second at least), the rest after a
    row marked last if it lasts half a second; the profile is the unit mean weighted by length. The
    state is the speech not yet embedded and a sum.
    """
    wait, least = round(max(LEAST_SECONDS, update_seconds) * RATE), round(LEAST_SECONDS * RATE)

    def fold(state, rows):
        pending, total, n = state
        pending, total, out = [np.asarray(pending, np.float32)], np.asarray(total, float), []
        for seq, samples, last in zip(rows["seq"], rows["samples"], rows["last"], strict=True):
            if samples is not None:
                pending.append(np.asarray(samples, np.float32))
            have = sum(map(len, pending))
            if have >= wait or (last and have >= least):
                vector, pending = embed(np.concatenate(pending)), []
                if vector is not None:
                    total = vector * have if not len(total) else total + vector * have
                    n += have
                    mean = total / n
                    norm = np.linalg.norm(mean)
                    out.append((int(seq), n / RATE, (mean / norm if norm > 1e-8 else mean).tolist()))
        return (np.concatenate(pending).tolist() if pending else [], total.tolist(), n), out

    return _stateful(speech.select(key, "seq", "samples", "last"), key, "seq", "seq long, seconds double, profile array<double>", "pending array<float>, total array<double>, n long", ([], [], 0), fold)
