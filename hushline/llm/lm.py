"""Stupid-backoff language-model scores, computed relationally.

Texts are kept in slabs. A slab's n-grams, orders 1 to 3, are exploded to 64-bit hashes and
pre-aggregated; rows (hash range, slab, blocks of ascending hashes with counts, a block per order)
go to the count tables, which are partitioned by hash range. A range adds up the counts and joins
them back to each slab's blocks; the slab looks its n-grams up again and sums the scores per
document. Nothing is collected, and a frequent n-gram is one entry per slab.

Slabs and ranges are both sized by bytes, so that a task holds as much at any scale. A slab sends
one row to a range at most: rows in all are slabs times ranges, or fewer where n-grams are few.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import mixed, pack, unpack
from .slabs import dealt, read_table, slabs

ORDER, BACKOFF, MIN_COUNT = 3, 0.4, 2
#: Bytes of text whose n-grams make a range of the count tables: a few million entries.
RANGE_BYTES = 10 << 20
_IN_WORD = np.ones(256, bool)
_IN_WORD[list(b" \t\n\x0b\x0c\r")] = False


def _word_hashes(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each lower-cased word, end to end, and the words' number by text."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.ascii_trim_whitespace(texts.combine_chunks().cast(pa.large_string()))))
    sizes = np.diff(words.offsets.to_numpy())
    coded = pc.dictionary_encode(words.flatten())
    names = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
    flat = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(names) else np.zeros(0, np.uint64)
    blank = np.fromiter((not w for w in names), bool, len(names))
    if blank.any():  # an empty text splits into one empty word
        drop = blank[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = sizes - np.bincount(np.repeat(np.arange(len(sizes)), sizes)[drop], minlength=len(sizes))
        flat = flat[~drop]
    return flat, sizes.astype(np.int64)


def _grams(words: np.ndarray, sizes: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: the hash of the n-gram that ends at each place, and where it lies in one text."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, now = [(words, np.ones(len(words), bool))], words
    for n in range(1, order):
        longer = np.zeros_like(words)
        longer[n:] = mixed(now[n - 1 : -1] * np.uint64(0x9E3779B97F4A7C15) + words[n:]) if len(words) > n else 0
        now = longer
        out.append((now, place >= n))
    return out


def _tables(table: pa.Table, order: int):
    words, sizes = _word_hashes(table.column("text"))
    return sizes, [(h, ok, *np.unique(h[ok], return_inverse=True)) for h, ok in _grams(words, sizes, order)]


def count_words(table: pa.Table) -> int:
    """Words of all texts, counted as places where one begins."""
    n = 0
    for texts in table.column("text").chunks:
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if len(texts) and offsets[-1] > offsets[0]:
            word = _IN_WORD[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
            begins = word.copy()
            begins[1:] &= ~word[:-1]
            at = offsets[:-1][np.diff(offsets) > 0] - offsets[0]
            begins[at] = word[at]
            n += int(begins.sum())
    return n


def _split(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of `ranges` equal parts of the hash space starts in the ascending keys."""
    edges = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


_BLOCKS, _TOTALS = "range int, slab long, keys array<binary>, counts array<binary>", "slab long, range int, totals array<binary>"
_MANY = pa.list_(pa.binary())


def _count(order: int, ranges: int, folder: str):
    def run(batches):
        for b in batches:
            for slab, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys, counts = [[] for _ in range(ranges)], [[] for _ in range(ranges)]
                for _, _, ascending, at in _tables(read_table(folder, file, ["text"]), order)[1]:
                    n, cuts = np.bincount(at, minlength=len(ascending)).astype(np.uint32), _split(ascending, ranges).tolist()
                    for r, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        keys[r].append(pack(ascending[x:y], True))
                        counts[r].append(pack(n[x:y]))
                yield pa.RecordBatch.from_arrays([pa.array(range(ranges), pa.int32()), pa.array([slab] * ranges, pa.int64()), pa.array(keys, _MANY), pa.array(counts, _MANY)], ["range", "slab", "keys", "counts"])

    return run


def _add_up(table: pa.Table) -> pa.Table:
    """The corpus counts of one range, joined to every slab's blocks."""
    keys, counts = table.column("keys").to_pylist(), table.column("counts").to_pylist()
    out: list[list[bytes]] = [[] for _ in keys]
    for order in range(len(keys[0])):
        blocks = [unpack(k[order], np.uint64, True) for k in keys]
        _, at = np.unique(np.concatenate(blocks), return_inverse=True)
        total = np.bincount(at, np.concatenate([unpack(c[order], np.uint32) for c in counts])).astype(np.uint64)
        for k, part in enumerate(np.split(at, np.cumsum([len(b) for b in blocks])[:-1])):
            out[k].append(pack(total[part]))
    return pa.table([table.column("slab"), table.column("range"), pa.array(out, _MANY)], ["slab", "range", "totals"])


def _score(order: int, backoff: float, least: int, words_in_all: int, folder: str):
    def run(index: pa.Table, totals: pa.Table) -> pa.Table:
        docs = read_table(folder, index.column("file")[0].as_py())
        sizes, tables = _tables(docs, order)
        blocks = [t for _, t in sorted(zip(totals.column("range").to_pylist(), totals.column("totals").to_pylist(), strict=True))]
        counts = []
        for k, (h, ok, _, at) in enumerate(tables):
            full = np.zeros(len(h))
            full[ok] = np.concatenate([unpack(t[k], np.uint64) for t in blocks])[at]
            counts.append(full)
        places = len(tables[0][0])
        score = (order - 1) * math.log(backoff) + np.log(np.maximum(counts[0], 1) / max(words_in_all, 1))
        done = np.zeros(places, bool)
        for k in range(order - 1, 0, -1):
            context = np.concatenate(([0.0], counts[k - 1][:-1]))[:places]
            use = ~done & tables[k][1] & (counts[k] >= least)
            score[use] = (order - 1 - k) * math.log(backoff) + np.log(counts[k][use] / context[use])
            done |= use
        ends = np.cumsum(sizes)
        sums = np.concatenate(([0.0], np.cumsum(score)))
        return pa.table([docs.column("doc_id").combine_chunks(), pa.array(sizes), pa.array(np.where(sizes > 0, sums[ends] - sums[ends - sizes], 0.0))], ["doc_id", "n_words", "score"])

    return run


def lm_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_words, score, mean_score), one row per row.

    score sums ln S over the words: S is count(n-gram)/count(context) for the longest order whose
    n-gram occurs `min_count` times or more in the corpus, times `backoff` for each order dropped,
    and count(word)/words at the last. N-grams don't cross documents. Null and empty texts have no
    words: score 0, mean null. Repeated rows, of null ids too, count and score each; a very long
    text is a slab of its own. Other columns are ignored. An empty table gives an empty table.
    """
    index, folder = slabs(docs, "lm", measure=count_words)
    count, size, words = index.agg(F.count("*"), F.sum("bytes"), F.sum("measure")).first()
    ranges = max(1, math.ceil((size or 0) / RANGE_BYTES))
    own = dealt(index.select("slab", "file"), count)
    totals = dealt(own.mapInArrow(_count(order, ranges, folder), _BLOCKS), ranges, "range").groupBy("range").applyInArrow(_add_up, _TOTALS)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = own.groupBy("slab").cogroup(dealt(totals, count).groupBy("slab")).applyInArrow(_score(order, backoff, min_count, words or 0, folder), f"doc_id {kind}, n_words long, score double")
    return scored.withColumn("mean_score", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")))
