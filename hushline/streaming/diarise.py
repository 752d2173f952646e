"""A diariser with state over streams of audio: an injected step model, fed in order, drained at the end."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout


class Diariser(Protocol):
    """state is anything that pickles: tensors, buffers, counts."""

    def start(self) -> Any: ...

    def accept(self, state: Any, audio: np.ndarray) -> tuple[Any, list[np.ndarray]]:
        """The next state, and the probabilities of each frame that is now certain."""

    def finish(self, state: Any) -> list[np.ndarray]:
        """The frames still held back."""


def diarised(blocks: DataFrame, key: str, model: Callable[[], Diariser]) -> DataFrame:
    """Stream of (key, seq, samples array<float>, last) -> key, frame, probabilities array<float>.

    Blocks of a batch are taken by seq; a block that was taken before is passed over, one that is
    missing raises, as audio can't be skipped. After a row marked last the held-back frames come
    and the state goes.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        engine = model()
        following, frame, held = (state.get[0], state.get[1], pickle.loads(state.get[2])) if state.exists else (0, 0, engine.start())
        out, over = [], False
        for seq, samples, last in pd.concat(list(batches)).sort_values("seq", kind="stable")[["seq", "samples", "last"]].itertuples(index=False):
            if seq < following or over:
                continue
            if seq > following:
                raise ValueError(f"block {following} of {k[0]} is missing")
            held, found = engine.accept(held, np.asarray(samples if samples is not None else [], np.float32))
            out, following = out + found, following + 1
            if last:
                out, over = out + engine.finish(held), True
        if over:
            state.remove()
        else:
            state.update((following, frame + len(out), pickle.dumps(held)))
        yield pd.DataFrame({key: [k[0]] * len(out), "frame": range(frame, frame + len(out)), "probabilities": [np.asarray(p, np.float32).tolist() for p in out]})

    own = blocks.select(key, "seq", "samples", "last")
    return own.groupBy(key).applyInPandasWithState(run, f"{key} {blocks.schema[key].dataType.simpleString()}, frame long, probabilities array<float>", "following long, frame long, held binary", "append", GroupStateTimeout.NoTimeout)


def whole(audio: np.ndarray, model: Diariser) -> np.ndarray:
    """The same over one whole recording: (frames, slots)."""
    state, found = model.accept(model.start(), audio)
    rows = [*found, *model.finish(state)]
    return np.stack(rows) if rows else np.zeros((0, 0), np.float32)
