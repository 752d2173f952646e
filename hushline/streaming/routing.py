"""Streams of activity and audio cut as they come: the router of frames, and pieces of audio between gaps.

Both keep a state per key of bounded size and give what the batch operators (activity.routes,
lookups.gap_pieces) give for the same rows, whatever the batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from hushline.streaming.control import _stateful


def strongest(active: np.ndarray, p: np.ndarray, most: int) -> list[int]:
    """The active slots, or the `most` of highest p among them (ties to the higher slot), ascending."""
    slots = np.flatnonzero(active)
    return sorted(slots[np.lexsort((slots, p[slots]))[-most:]].tolist())


def routed(frames: DataFrame, key: str, threshold: float, longest: int, most_slots: int = 3, eager: bool = False) -> DataFrame:
    """Stream of (key, frame, probabilities array, last) -> key, slots, route, first, last_frame.

    A frame is stable once its follower is there (median of three). One speaker's run passes, at its
    end or, if `eager`, at the end of each batch as far as it goes; a run of several waits for its
    end or for `longest` frames and is separated. Frames that aren't contiguous raise.
    """

    def fold(state, rows):
        before, now, frame, slots, first = (list(state[0]), list(state[1]), state[2], list(state[3]), state[4])
        out = []

        def emit(until: int) -> None:
            if slots:
                out.append((list(slots), "pass" if len(slots) == 1 else "separate", first, until))

        def settle(following: np.ndarray) -> None:
            nonlocal slots, first
            p = np.asarray(now, float)
            on = p >= threshold
            past = np.asarray(before, float) >= threshold if before else on
            found = strongest(past.astype(int) + on + (following >= threshold) >= 2, p, most_slots)
            if found != slots or len(slots) > 1 and frame - first >= longest:
                emit(frame - 1)
                slots, first = found, frame

        for k, p, last in zip(rows["frame"], rows["probabilities"], rows["last"], strict=True):
            p = np.asarray(p, float)
            if now:
                if k != frame + 1:
                    raise ValueError(f"frame {frame + 1} is missing")
                settle(p)
                before = now
            now, frame = p.tolist(), int(k)
            if last:
                settle(p)
                emit(frame)
                before, now, slots = [], [], []
        if eager and len(slots) == 1 and now and first < frame:
            emit(frame - 1)
            first = frame
        return (before, now, frame, slots, first), out

    return _stateful(frames.select(key, "frame", "probabilities", "last"), key, "frame", "slots array<int>, route string, first long, last_frame long", "before array<double>, now array<double>, frame long, slots array<int>, first long", ([], [], -1, [], 0), fold)


def pieces(chunks: DataFrame, key: str, gap: float, longest: float) -> DataFrame:
    """Stream of (key, seq, start, stop, last) of audio -> key, start, stop, boundary: cut every `longest`, and after more than `gap` without audio."""

    def fold(state, rows):
        start, stop, out = state[0], state[1], []

        def cut(final: str) -> None:
            nonlocal start
            k = 0
            while start is not None and stop - (start + k * longest) >= longest:
                out.append((start + k * longest, start + (k + 1) * longest, "full"))
                k += 1
            start = None if start is None else start + k * longest
            if final and start is not None and stop > start:
                out.append((start, stop, final))

        for a, b, last in zip(rows["start"], rows["stop"], rows["last"], strict=True):
            if not pd.isna(a):
                if start is not None and abs(a - stop) > gap:
                    cut("gap")
                    start = None
                start = float(a) if start is None else start
                stop = float(b)
                cut("")
            if last:
                cut("end")
                start = None
        return (start, stop), out

    return _stateful(chunks.select(key, "seq", "start", "stop", "last"), key, "seq", "start double, stop double, boundary string", "start double, stop double", (None, 0.0), fold)
