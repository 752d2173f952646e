"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into quantile bins. Boosting cycles over the features; each step fits a
shallow tree to the gradient histogram over one feature's bins and adds it to that feature's
lookup table. Then the strongest pairs of features get trees over their joint bins. A score is
the sum of looked-up table entries, one vectorised addition per table.

Only features of the text enter a score. The fit uses a bounded sample of labelled rows
(`sample_rows`, a documented parameter); scoring covers all rows.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of, unused

SAMPLE_ROWS, BINS, ROUNDS, RATE, PAIRS, CUTOFF = 20_000, 32, 120, 0.15, 6, 0.3
FEATURES = ("log_words", "word_length", "upper", "symbols", "shouts", "pipes", "distinct", "repeated_lines", "top_word", "echoes", "digits", "line_words", "unended", "longest_run")
_UPPER, _DIGITS, _SYMBOLS = bytes(range(65, 91)), b"0123456789", b"#*$%&|<>{}[]=\\^~_@+"


def features(text: bytes) -> list[float]:
    """One number for each of FEATURES; an empty text gives zeros."""
    words, chars = text.split(), max(len(text), 1)
    n = max(len(words), 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = Counter(words)
    echoes = sum(map(bytes.__eq__, words, words[1:]))
    less = lambda chars_out: (len(text) - len(text.translate(None, chars_out))) / chars
    return [
        math.log1p(len(words)), sum(map(len, words)) / n, less(_UPPER), less(_SYMBOLS), text.count(b"!") / chars, text.count(b"|") / n, len(counts) / n, 1 - len(set(lines)) / max(len(lines), 1),
        max(counts.values(), default=0) / n, echoes / n, less(_DIGITS), math.log1p(len(words) / max(len(lines), 1)), sum(not x.rstrip().endswith((b".", b"?", b"!", b":", b'"')) for x in lines) / max(len(lines), 1), math.log1p(max(map(len, words), default=0)),
    ]


def _shallow(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Greedy tree over ordered bins: the step of each bin."""
    cg, ch = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    parts = [(0, len(g))]
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1)
    while len(parts) < leaves:
        best = max(((gain(a, m) + gain(m, b) - gain(a, b), a, m, b) for a, b in parts for m in range(a + 1, b)), default=(0,))
        if best[0] <= 1e-9:
            break
        _, a, m, b = best
        parts[parts.index((a, b)) : parts.index((a, b)) + 1] = [(a, m), (m, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1)
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Best four-leaf tree over two features' bins: one cut of each. Its step, and its gain."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    n, m = g.shape
    i, j = np.meshgrid(np.arange(1, n), np.arange(1, m), indexing="ij")
    total = 0.0
    for c, d in ((cg[i, j], ch[i, j]), (cg[i, -1] - cg[i, j], ch[i, -1] - ch[i, j]), (cg[-1, j] - cg[i, j], ch[-1, j] - ch[i, j]), (cg[-1, -1] - cg[i, -1] - cg[-1, j] + cg[i, j], ch[-1, -1] - ch[i, -1] - ch[-1, j] + ch[i, j])):
        total = total + c**2 / (d + 1)
    a, b = np.unravel_index(int(np.argmax(total)), total.shape)
    out = np.zeros_like(g)
    for x in (slice(0, a + 1), slice(a + 1, None)):
        for y in (slice(0, b + 1), slice(b + 1, None)):
            out[x, y] = g[x, y].sum() / (h[x, y].sum() + 1)
    return out, float(total.max())


@dataclass
class Model:
    """edges: inner bin edges by feature; tables by feature; pairs: (i, j, table over coarse bins)."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        total, b = np.full(len(x), self.intercept), self.bins(x)
        for k, table in enumerate(self.tables):
            total += table[b[:, k]]
        for i, j, table in self.pairs:
            total += table[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, bins: int = BINS, rounds: int = ROUNDS, rate: float = RATE, pairs: int = PAIRS) -> Model:
    """Cyclic boosting on log loss. Without rows of both labels: the constant smoothed share of ones."""
    share = (y.sum() + 1) / (len(y) + 2)
    start = math.log(share / (1 - share))
    if not len(y) or y.min() == y.max():
        return Model(start, [], [], [])
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    model = Model(start, edges, [np.zeros(len(e) + 1) for e in edges], [])
    b, total = model.bins(x), np.full(len(y), start)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            if len(table) == 1:
                continue
            r, w = slopes()
            step = rate * _shallow(np.bincount(b[:, k], r, len(table)), np.bincount(b[:, k], w, len(table)))
            table += step
            total += step[b[:, k]]
    grids = {}
    for i in range(len(edges)):
        for j in range(i):
            if (shape := (len(model.tables[i]), len(model.tables[j])))[0] > 1 and shape[1] > 1:
                grids[i, j] = (b[:, i] * shape[1] + b[:, j], shape)

    def joint(at, shape):
        r, w = slopes()
        return _cross(np.bincount(at, r, shape[0] * shape[1]).reshape(shape), np.bincount(at, w, shape[0] * shape[1]).reshape(shape))

    strongest = sorted(grids, key=lambda p: -joint(*grids[p])[1])[:pairs]
    model.pairs = [(i, j, np.zeros(grids[i, j][1])) for i, j in strongest]
    for _ in range(rounds // 4):
        for i, j, table in model.pairs:
            at, shape = grids[i, j]
            step = rate * joint(at, shape)[0]
            table += step
            total += step.ravel()[at]
    return model


def _featurise(texts: pa.Array) -> np.ndarray:
    texts = pc.fill_null(texts, "").cast(pa.binary()).to_pylist()
    return np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


def _feature_rows(batches):
    for b in batches:
        x = _featurise(b.column(1))
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x[:, k]) for k in range(x.shape[1])]], ["quality", *FEATURES])


def held_out(column: str = "doc_id") -> F.Column:
    """Rows kept from the fit: crc32 of the id as text divides by five. Null ids aren't held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most `sample_rows` labelled rows that aren't held out, the least by hash of their id.

    Null labels and ids are left out; labels without a document, too. A repeated id counts as often
    as its rows and labels match. Without labelled rows the model is a constant.
    """
    sample = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id").select("quality", "text")
    got = rows.mapInArrow(_feature_rows, "quality int, " + ", ".join(f"{x} double" for x in FEATURES)).toPandas()
    return fit(got[list(FEATURES)].to_numpy(np.float64), (got.quality.to_numpy() > 0).astype(np.float64))


def scored(docs: DataFrame, model: Model, cutoff: float = CUTOFF) -> DataFrame:
    """docs with score double and predicted int, one row per row.

    Null and empty texts score as a text without words. Null and repeated ids are ids like others.
    Columns of docs named score or predicted are replaced; all others stay whatever their names. A
    very long text is featurised whole, in one task. An empty table stays empty.
    """
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    kept = [F.col(f"`{c}`") for c in names]

    def run(batches):
        for b in batches:
            s = model.score(_featurise(b.column(b.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array((s >= cutoff).astype(np.int32))], [*names, "score", "predicted"])

    own = docs.select(*kept, F.col("text").alias(unused("text_", names)))
    return own.mapInArrow(run, T.StructType([*[docs.schema[c] for c in names], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def keep_good(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """docs without the rows that the classifier rejects; columns unchanged, whatever their names. A filter in place."""
    model = train(docs, labels)

    def run(batches, at=docs.columns.index("text")):
        for b in batches:
            yield b.filter(pa.array(model.score(_featurise(b.column(at))) >= cutoff))

    return docs.mapInArrow(run, docs.schema)
