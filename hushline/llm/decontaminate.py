"""Benchmark decontamination by CGK random-walk embedding and bit-sampling LSH.

Words are lower-cased and stripped of ASCII punctuation at their ends. An item of L words is found
in a text if some run of the text's words is within floor((1 - similarity) * L) word edits of it.

1. Windows. k edits leave one of the item's k+1 equal pieces whole, so a match holds a run of
   floor(L/(k+1)) words of a piece (at most four are used). Where a text holds such a run, windows
   of L words are cut around it. This gate names places and lengths, not items; it loses nothing.
2. The CGK walk copies an item or window to some 2L symbols: each step writes the current word and
   moves on or stays, by a random bit of step and word. Small edit distance becomes small Hamming
   distance. Each of REPEATS walks is a hash table, keyed by the symbols at SAMPLES of its steps
   (and L). Candidates are the items that the tables hold under a window's keys, and no others;
   samples after a walk's end match nothing.
3. Candidates are verified by exact edit distance against any substring nearby.

The items are a stated query set in blocks of about `block_items`, built by tasks into files in the
shared folder. Documents are passed over once; a task goes through the blocks, holding a few.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, text_of, written
from .packing import mixed
from .slabs import by_bytes, place

SIMILARITY, REPEATS, SAMPLES, BLOCK_ITEMS, SLICE_BYTES, HELD_BLOCKS, CHUNK = 0.8, 128, 3, 20_000, 2 << 20, 6, 100_000
#: Steps of a walk that are sampled, for each word of the window; walks end after two on average.
STRETCH = 1.7
PUNCTUATION = ".,;:!?\"'()[]{}<>*_-"
_PAD = np.int64(-1)


def _normal(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words end to end, and the words' number by text."""
    # lower case by the library's Unicode rules; white space is the six ASCII characters
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.utf8_lower(texts.cast(pa.large_string()))))
    return pc.ascii_trim(words.flatten(), PUNCTUATION), np.diff(words.offsets.to_numpy())


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... n[k] times, for each k."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Items:
    """A block of items: word numbers, gates, and the hash tables of the walks."""

    def __init__(self, ids: list, texts: list[str | None], similarity: float = SIMILARITY, repeats: int = REPEATS, samples: int = SAMPLES, seed: int = 11):
        flat, sizes = _normal(pa.array([t or "" for t in texts], pa.string()))
        self.vocabulary = pc.unique(flat)
        numbers = pc.index_in(flat, self.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        cuts = np.cumsum(sizes)
        kept = [k for k in range(len(ids)) if (texts[k] or "").strip(" \t\n\x0b\x0c\r")]
        self.ids, self.words = [ids[k] for k in kept], [numbers[cuts[k] - sizes[k] : cuts[k]] for k in kept]
        self.edits = [int((1 - similarity) * len(w) + 1e-9) for w in self.words]
        self.longest = max(map(len, self.words), default=0)
        self.most_edits = dict(zip(map(len, self.words), self.edits, strict=True))
        rng = np.random.default_rng(seed)
        self.salts, self.places = rng.integers(1, 1 << 62, repeats, np.uint64), rng.random((repeats, samples))
        runs: dict[int, set] = {}
        for w, k in zip(self.words, self.edits, strict=True):
            piece = len(w) // (k + 1)
            q = min(4, piece)
            h = _runs(w, q)
            runs.setdefault(q, set()).update((int(h[o]), o, len(w)) for o in range(0, (k + 1) * piece, piece))
        self.gates = {}
        for q, found in runs.items():
            keys, offsets, lengths = (np.array(c, t) for c, t in zip(zip(*sorted(found), strict=True), (np.uint64, np.int64, np.int64), strict=True))
            distinct, first = np.unique(keys, return_index=True)
            bitmap = np.zeros(1 << 20, bool)
            bitmap[(distinct >> np.uint64(44)).astype(np.int64)] = True
            self.gates[q] = (distinct, first, np.diff(np.append(first, len(keys))), offsets, lengths, bitmap)
        own = [self.keys(np.stack([np.pad(w, (0, self.longest - len(w)), constant_values=_PAD) for w in self.words[k : k + 512]]), np.array([len(w) for w in self.words[k : k + 512]])) for k in range(0, len(self.words), 512)]
        table = np.concatenate(own, axis=1) if own else np.zeros((repeats, 0), np.uint64)
        self.order = np.argsort(table, axis=1, kind="stable").astype(np.int32)
        self.table = np.take_along_axis(table, self.order, axis=1)

    def keys(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(repeats, rows) table keys of windows: the walk over the first sizes[k] symbols of each row of x; 0 where a sample lies after its end."""
        repeats, n = len(self.salts), len(x)
        at, keys, ended = np.zeros((repeats, n), np.int64), np.zeros((repeats, n), np.uint64), np.zeros((repeats, n), bool)
        sampled = (self.places[:, :, None] * (STRETCH * sizes)[None, None, :]).astype(np.int64)
        rows = np.arange(n)
        for step in range(int(sampled.max(initial=-1)) + 1):
            inside = at < sizes[None, :]
            symbol = np.where(inside, x[rows[None, :], np.minimum(at, x.shape[1] - 1)], _PAD).astype(np.uint64)
            for s in range(sampled.shape[1]):
                here = sampled[:, s] == step
                keys = np.where(here, mixed(keys * np.uint64(31) + symbol + np.uint64(s + 1)), keys)
                ended |= here & ~inside
            at += inside & ((mixed(symbol * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step) + self.salts[:, None]) >> np.uint64(40)) & np.uint64(1)).astype(bool)
        return np.where(ended, np.uint64(0), mixed(keys ^ mixed(sizes.astype(np.uint64))[None, :]) | np.uint64(1))

    def candidates(self, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs that some table brings together, each once, ascending."""
        pairs = [np.zeros(0, np.int64)]
        for k in range(0, len(x), 512):
            for r, mine in enumerate(self.keys(x[k : k + 512], sizes[k : k + 512])):
                left, n = np.searchsorted(self.table[r], mine, "left"), np.searchsorted(self.table[r], mine, "right")
                n = np.where(mine == 0, 0, n - left)
                if n.any():
                    pairs.append((np.repeat(np.arange(k, k + len(mine)), n) << 32) | self.order[r][_spread(left, n)])
        both = np.unique(np.concatenate(pairs))
        return both >> 32, both & 0xFFFFFFFF

    def windows(self, ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Windows that the gates name, as (text, start within it, words), each once, in bounded chunks."""
        if not len(begins):
            return
        wide, deep = int((ends - begins).max()) + 2 * self.longest + 1, self.longest + 1
        codes = np.zeros(0, np.int64)
        for q, (distinct, first, many, offsets, lengths, bitmap) in self.gates.items():
            h = _runs(ids, q)
            maybe = np.flatnonzero(bitmap[(h >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(distinct, h[maybe]), len(distinct) - 1)
            same = distinct[at] == h[maybe]
            maybe, at = maybe[same], at[same]
            text = np.searchsorted(ends, maybe, side="right")
            whole = maybe + q <= ends[text] if len(maybe) else np.zeros(0, bool)
            maybe, at, text = maybe[whole], at[whole], text[whole]
            upto, k = np.cumsum(many[at]), 0
            while k < len(maybe):
                end = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + CHUNK, "right")))
                n = many[at[k:end]]
                entry = _spread(first[at[k:end]], n)
                start = np.repeat(maybe[k:end] - begins[text[k:end]], n) - offsets[entry] + self.longest
                codes = np.unique(np.append(codes, (np.repeat(text[k:end], n) * wide + start) * deep + lengths[entry]))
                k = end
        for k in range(0, len(codes), CHUNK):
            part = codes[k : k + CHUNK]
            yield part // deep // wide, part // deep % wide - self.longest, part % deep

    def find(self, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, words, edits) of the best place of each item in each text that holds it."""
        if not self.words or not len(texts):
            return []
        flat, sizes = _normal(texts)
        ids = pc.fill_null(pc.index_in(flat, self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        ends = np.cumsum(sizes)
        begins = ends - sizes
        hits: set[tuple[int, int, int]] = set()

        def tried(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
            """Adds the candidates of windows; returns which had none."""
            none = np.ones(len(text), bool)
            for k in range(0, len(text), 4096):
                t, s, n = text[k : k + 4096], start[k : k + 4096], size[k : k + 4096]
                at = (begins[t] + s)[:, None] + np.arange(self.longest)[None, :]
                inside = (at >= begins[t][:, None]) & (at < ends[t][:, None])
                x = np.where(inside, ids[np.clip(at, 0, max(len(ids) - 1, 0))], 0)
                window, item = self.candidates(x, n)
                hits.update(zip(t[window].tolist(), item.tolist(), s[window].tolist(), strict=True))
                none[k + window] = False
            return none

        for text, start, size in self.windows(ids, begins, ends):  # as cut, and where the tables hold nothing, moved by up to the edits
            none = tried(text, start, size)
            text, start, size = text[none], start[none], size[none]
            most = np.array([self.most_edits[n] for n in size.tolist()], np.int64)
            for shift in range(1, int(most.max(initial=0)) + 1):
                able = most >= shift
                for way in (shift, -shift):
                    tried(text[able], start[able] + way, size[able])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        regions: list[list[int]] = []
        for t, i, d in sorted(hits):
            k = self.edits[i]
            a, b = max(int(begins[t]), int(begins[t]) + d - k), min(int(ends[t]), int(begins[t]) + d + len(self.words[i]) + k)
            if regions and regions[-1][:2] == [t, i] and a <= regions[-1][3]:
                regions[-1][3] = max(b, regions[-1][3])
            else:
                regions.append([t, i, a, b])
        for t, i, a, b in regions:
            got = _substring_edits(self.words[i], ids[a:b])
            if got[0] <= self.edits[i] and (got[0], a + got[1]) < best.get((t, i), (self.edits[i] + 1,))[:2]:
                best[t, i] = (got[0], a + got[1], got[2])
        return [(t, i, first - int(begins[t]), n, e) for (t, i), (e, first, n) in sorted(best.items())]


def _runs(ids: np.ndarray, q: int) -> np.ndarray:
    """A hash of each run of q words (as word numbers)."""
    if len(ids) < q:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(ids) - q + 1, np.uint64)
    for k in range(q):
        h = h * np.uint64(0x100000001B3) + ids[k : len(ids) - q + 1 + k].astype(np.uint64)
    return mixed(h)


def _substring_edits(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edits between pattern and any run of text; that run's start and length, the earliest."""
    cost, start = list(range(len(pattern) + 1)), [0] * (len(pattern) + 1)
    best, words = (len(pattern), 0, 0), pattern.tolist()
    for j, symbol in enumerate(text.tolist()):
        now, begun = [0], [j + 1]
        for i, w in enumerate(words):
            ways = ((cost[i] + (w != symbol or not symbol), start[i]), (cost[i + 1] + 1, start[i + 1]), (now[i] + 1, begun[i]))
            c, s = min(ways)
            now.append(c)
            begun.append(s)
        cost, start = now, begun
        if cost[-1] < best[0]:
            best = (cost[-1], start[-1], j + 1 - start[-1])
    return best


def build_blocks(items: DataFrame, similarity: float = SIMILARITY, block_items: int = BLOCK_ITEMS) -> tuple[str, list[str]]:
    """Builds blocks of items in tasks; their folder and names. Only the names reach the driver."""
    folder = fresh_path(items.sparkSession, "items")
    own = items.where("text IS NOT NULL").select("item_id", "text")
    blocks = max(1, math.ceil(own.count() / block_items))

    def build(table: pa.Table) -> pa.Table:
        (fs, path), name = place(folder), f"{uuid.uuid4().hex}.items"
        fs.create_dir(path, recursive=True)
        rows = sorted(zip(table.column("item_id").to_pylist(), table.column("text").to_pylist(), strict=True), key=lambda r: (r[0] is None, r))
        with fs.open_output_stream(f"{path}/{name}") as sink:
            sink.write(pickle.dumps(Items([r[0] for r in rows], [r[1] for r in rows], similarity)))
        return pa.table([[name]], ["name"])

    named = own.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))).groupBy("block").applyInArrow(build, "name string")
    return folder, sorted(r[0] for r in written(named, "item-blocks").collect())


_HELD: dict[tuple[str, str], Items] = {}


def load_block(folder: str, name: str) -> Items:
    """A block of items, kept by this worker while it is one of the last HELD_BLOCKS."""
    if (folder, name) not in _HELD:
        while len(_HELD) >= HELD_BLOCKS:
            del _HELD[next(iter(_HELD))]
        fs, path = place(folder)
        with fs.open_input_file(f"{path}/{name}") as source:
            _HELD[folder, name] = pickle.loads(source.read())
    return _HELD[folder, name]


def leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, edits): the best place of each item in each row that holds it.

    Null and empty texts hold nothing, and items without words are held by nothing. Items of fewer
    than five words have no edits, so only their words as they are hold them. Repeated rows give
    repeated results, repeated items too; null ids are ids. A very long text is worked through
    whole, in one task. Other columns are ignored. No items or no rows: an empty table.
    """
    id_type, item_type = docs.schema["doc_id"].dataType, items.schema["item_id"].dataType
    schema = f"doc_id {id_type.simpleString()}, item_id {item_type.simpleString()}, first_word int, n_words int, edits int"
    folder, names = build_blocks(items, similarity, block_items)

    def run(batches):
        for b in batches:
            for name in names:
                block = load_block(folder, name)
                for k, n in by_bytes(b.column(1), SLICE_BYTES):
                    if got := block.find(b.column(1).slice(k, n)):
                        t, i, first, long, e = zip(*got, strict=True)
                        ids = pa.array([block.ids[x] for x in i]).cast(schema_of[1].type)
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([k + x for x in t])), ids, pa.array(first, pa.int32()), pa.array(long, pa.int32()), pa.array(e, pa.int32())], ["doc_id", "item_id", "first_word", "n_words", "edits"])

    from pyspark.sql.pandas.types import to_arrow_schema

    schema_of = to_arrow_schema(items.sparkSession.createDataFrame([], schema).schema)
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def decontaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """docs without the rows that hold an item; columns unchanged. A filter in place: nothing is shuffled.

    Null and empty texts hold nothing and stay, as do rows with null ids; repeated rows stay or go
    alike. A very long text is worked through whole, in one task. Columns may have any names. No
    items: all rows. An empty table stays empty.
    """
    folder, names = build_blocks(items, similarity, block_items)

    def run(batches, at=docs.columns.index("text")):
        for b in batches:
            keep, texts = np.ones(b.num_rows, bool), pc.fill_null(b.column(at), "")
            for name in names:
                block = load_block(folder, name)
                for k, n in by_bytes(texts, SLICE_BYTES):
                    keep[[k + x[0] for x in block.find(texts.slice(k, n))]] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
