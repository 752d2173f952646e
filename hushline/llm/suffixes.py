"""Removal of repeated 100-byte strings by a distributed merge of sorted suffix runs.

Sorting every suffix of a corpus would move it many times over, so the sort is sparse. Every
100-byte string holds an anchor: the place of the least hash among its 36-byte substrings. Equal
strings have the same anchor at the same offset, so only suffixes that start at anchors (one byte
in about 33) need sorting, with the 64 bytes before them as left context.

1. A slab's anchors are found once and kept beside its texts. They go to ranges as (hash of the 36
   bytes, hash of the whole context, place).
   An anchor whose whole context occurs earlier is repeated in full. One whose 36 bytes occur
   nowhere else is settled, too. Undecided are those that share the 36 bytes with an earlier
   anchor but not the context: the edges of copied passages.
2. Only those are exchanged as suffixes: each slab sends sorted, front-coded runs (length of the
   prefix shared with the one before, and the rest), and a range merges its runs in a loser tree
   that carries longest common prefixes, so that known prefixes are never compared again. The
   merged order with its prefix lengths gives, for each split of 100 bytes into left and right of
   the anchor, the classes of equal strings; all but the earliest of a class are repeated.
3. Each slab marks its repeated strings and cuts their bytes out.

Hashes have 64 bits; the whole context is compared by 128. A suffix that many documents share is
one entry per slab and context. Slabs and ranges are both sized by bytes: a slab sends a row to a
range at most, and a task holds as much at any scale.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import mixed, pack, unpack
from .slabs import dealt, read_table, slabs

LENGTH, GRAM, CHUNK_BYTES, RANGE_BYTES = 100, 36, 1 << 20, 24 << 20
LEFT, PAD = LENGTH - GRAM, 164
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(5).integers(1, 1 << 63, 257, np.uint64) | np.uint64(1)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _twice(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of 2n symbols from those of n; the last n places are dropped."""
    return h[:-n] * _power(n) + h[n:]


def _slide(x: np.ndarray, width: int, least) -> np.ndarray:
    """least over x[i : i + width], for each whole window."""
    step = 1
    while step * 2 <= width:
        x = least(x[:-step], x[step:])
        step *= 2
    return least(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


class Chunk:
    """Texts of one chunk with padding between them: symbols, and each text's start and end."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = PAD + np.cumsum(sizes + PAD) - sizes - PAD
        self.ends = self.starts + sizes
        self.symbols = np.full(int(self.ends[-1]) + PAD, 256, np.int16)
        for s, e, t in zip(self.starts.tolist(), self.ends.tolist(), texts, strict=True):
            self.symbols[s:e] = np.frombuffer(t, np.uint8)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each anchor: its place in the chunk, its text, the hash of its 36 bytes, and of its context."""
        h1 = _TABLE[self.symbols]
        h2 = _twice(h1, 1)
        h4 = _twice(h2, 2)
        h32 = _twice(_twice(_twice(h4, 4), 8), 16)
        n = len(h32) - 4
        grams = mixed(h32[:n] * _power(4) + h4[32 : 32 + n])
        whole = np.zeros(n + 1, np.int32)
        for s, e in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            if e - s >= LENGTH:
                whole[s] += 1
                whole[e - LENGTH + 1] -= 1
        window = np.cumsum(whole)[:n].astype(bool)  # a string of 100 bytes starts here
        least = _slide(grams, LEFT + 1, np.minimum)
        least = np.where(window[: len(least)], least, np.uint64(0))
        most = _slide(np.concatenate((np.zeros(LEFT, np.uint64), least, np.zeros(n - len(least), np.uint64))), LEFT + 1, np.maximum)
        at = np.flatnonzero((most == grams[: len(most)]) & (most > 0))
        context = np.zeros(len(at), np.uint64)
        for shift in (-64, -32, 0, 32, 64):
            context = mixed(context * np.uint64(31) + h32[at + shift])
        context = mixed(context * np.uint64(31) + h4[at + 96])
        return at, np.searchsorted(self.ends, at, side="right"), mixed(grams[at] ^ np.uint64(0x5851F42D4C957F2D)), context


def _chunks(texts: list[bytes]):
    """(first text, chunk) over runs of texts of about CHUNK_BYTES."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_BYTES or k == len(texts) - 1:
            yield first, Chunk(texts[first : k + 1])
            first, size = k + 1, 0


def find_anchors(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """A slab's rows in order of (doc_id, text), null ids first, and its anchors: text, at, gram, context, in order of (gram, context, place)."""
    ids, texts = table.column("doc_id").to_pylist(), table.column("text").cast(pa.large_binary()).to_pylist()
    rows = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, texts[k]))
    parts: list[list[np.ndarray]] = [[], [], [], []]
    for first, chunk in _chunks([texts[k] for k in rows]):
        at, text, gram, context = chunk.anchors()
        for x, y in zip(parts, (text + first, at - chunk.starts[text], gram, context), strict=True):
            x.append(y)
    text, at, gram, context = (np.concatenate(x) if x else np.zeros(0) for x in parts)
    order = np.lexsort((context, gram))  # stable: within equals, by place
    columns = [text[order].astype(np.int32), at[order].astype(np.uint32), gram[order].astype(np.uint64), context[order].astype(np.uint64)]
    return table.take(pa.array(rows, pa.int64())), pa.table([pa.array(c) for c in columns], ["text", "at", "gram", "context"])


class Slab:
    """A slab's documents in order, and the anchors to be sent: the earliest of each (gram, context)."""

    def __init__(self, folder: str, file: str, ranges: int, with_texts: bool = True):
        table, anchors = read_table(folder, file, None if with_texts else ["doc_id"]), read_table(folder, file + ".side")
        self.ids = table.column("doc_id").combine_chunks()
        self.texts = table.column("text").cast(pa.large_binary()).to_pylist() if with_texts else []
        self.text, self.at, self.gram, self.context = (anchors.column(c).to_numpy() for c in ("text", "at", "gram", "context"))
        self.at = self.at.astype(np.int64)
        new = np.ones(len(self.gram), bool)
        new[1:] = (self.gram[1:] != self.gram[:-1]) | (self.context[1:] != self.context[:-1])
        self.sent, self.local = np.flatnonzero(new), np.flatnonzero(~new)  # the first of each, and those that repeat it here
        edges = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
        self.cuts = np.concatenate(([0], np.searchsorted(self.gram[self.sent], edges), [len(self.sent)]))

    def places(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """doc_id and place of anchors; null ids count as the least."""
        ids = self.ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False).astype(np.int64)
        return ids[self.text[entries]], self.at[entries]


_BLOCKS = "range int, slab long, kind int, a binary, b binary, c binary, d binary"


def _block_table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], ["range", "slab", "kind", "a", "b", "c", "d"])


def _send_anchors(ranges: int, folder: str):
    def run(batches):
        for batch in batches:
            for slab, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b, out = Slab(folder, file, ranges, with_texts=False), []
                for r, (x, y) in enumerate(zip(b.cuts[:-1].tolist(), b.cuts[1:].tolist(), strict=True)):
                    if y > x:
                        e = b.sent[x:y]
                        ids, at = b.places(e)
                        out.append((r, slab, 0, pack(b.gram[e], True), pack(b.context[e]), pack(ids), pack(at.astype(np.uint32))))
                yield from _block_table(out).to_batches()

    return run


def _join_blocks(table: pa.Table, dtypes: tuple, ascending: tuple) -> tuple[list[int], list[np.ndarray], list[int]]:
    buckets = table.column("slab").to_pylist()
    columns = [[unpack(x, t, up) for x in table.column(c).to_pylist()] for c, t, up in zip("abcd", dtypes, ascending, strict=False)]
    return buckets, [np.concatenate(c) for c in columns], [len(x) for x in columns[0]]


def _decide(table: pa.Table) -> pa.Table:
    """For each block: 1 where the whole context occurs earlier, 2 where it is to be compared, else 0."""
    buckets, (gram, context, doc, at), sizes = _join_blocks(table, (np.uint64, np.uint64, np.int64, np.uint32), (True, False, False, False))
    order = np.lexsort((at, np.repeat(buckets, sizes), doc, context, gram))
    g, c = gram[order], context[order]
    new_g, new = np.ones(len(g), bool), np.ones(len(g), bool)
    new_g[1:] = g[1:] != g[:-1]
    new[1:] = new_g[1:] | (c[1:] != c[:-1])
    contexts = np.add.reduceat(new, np.flatnonzero(new_g)) if len(g) else np.zeros(0)
    verdict = np.zeros(len(g), np.uint8)
    verdict[order] = np.where(new, np.where(contexts[np.cumsum(new_g) - 1] > 1, 2, 0), 1) if len(g) else 0
    cuts = np.cumsum([0, *sizes])
    r = table.column("range")[0].as_py()
    return _block_table([(r, b, 1, pack(verdict[x:y]), None, None, None) for b, x, y in zip(buckets, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if verdict[x:y].any()])


def _verdicts(b: Slab, told: pa.Table) -> np.ndarray:
    out = np.zeros(len(b.sent), np.uint8)
    for r, kind, a in zip(told.column("range").to_pylist(), told.column("kind").to_pylist(), told.column("a").to_pylist(), strict=True):
        if kind == 1:
            out[b.cuts[r] : b.cuts[r + 1]] = unpack(a, np.uint8)
    return out


def front_code(run: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """A sorted run as shared prefix lengths, rest lengths, and the rests end to end."""
    shared, rests, before = np.zeros(len(run), np.uint8), [], b""
    for k, s in enumerate(run):
        n = shared[k] = _common(before, s, 0)
        rests.append(s[n:])
        before = s
    return shared, np.fromiter(map(len, rests), np.uint8, len(rests)), b"".join(rests)


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, given that the first `known` bytes agree."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    low, high = known, n  # agree up to low, not up to high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray, bytes]]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Merges front-coded sorted runs with an LCP loser tree: (run, index) in order, and the prefix each shares with the one before.

    A node keeps the loser's string and the prefix it shares with the string that beat it. Of two
    contenders that were last compared with the same winner, the one sharing more with it is the
    smaller; only if both share equally many bytes are bytes compared, from there on.
    """
    k = 1
    while k < max(len(runs), 1):
        k *= 2
    streams = []
    for shared, rest, data in runs:
        streams.append((shared.tolist(), rest.tolist(), data))
    position, offset = [-1] * len(runs), [0] * len(runs)
    current: list[bytes | None] = [None] * k
    lcp = [0] * k

    def advance(r: int) -> None:
        """The next string of run r; its own shared length is the prefix shared with the winner just output."""
        shared, rest, data = streams[r]
        position[r] += 1
        i = position[r]
        if i == len(shared):
            current[r] = None
            return
        n, o = shared[i], offset[r]
        current[r] = (current[r][:n] if n else b"") + data[o : o + rest[i]]
        offset[r] = o + rest[i]
        lcp[r] = n

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's lcp becomes the prefix shared with the winner."""
        x, y = current[a], current[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if lcp[a] > lcp[b]:
            return a, b
        if lcp[a] < lcp[b]:
            return b, a
        n = _common(x, y, lcp[a])
        first = a if (x[n:], a) <= (y[n:], b) else b
        other = b if first == a else a
        lcp[other] = n
        return first, other

    for r in range(len(runs)):
        advance(r)
        lcp[r] = 0
    losers = [0] * k
    winners = list(range(k))
    level = k // 2
    while level >= 1:
        following = []
        for j in range(level):
            w, l = play(winners[2 * j], winners[2 * j + 1])
            losers[level + j] = l
            following.append(w)
        winners, level = following, level // 2
    top, out, prefix = winners[0], [], []
    while current[top] is not None:
        out.append((top, position[top]))
        prefix.append(lcp[top])
        advance(top)
        node = (top + k) // 2
        while node >= 1:
            top, losers[node] = play(top, losers[node])
            node //= 2
    return out, np.array(prefix, np.int64)


def _contexts(b: Slab, entries: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Left context (64 bytes at most) and right context (100 at most) of anchors."""
    left, right = [], []
    for t, a in zip(b.text[entries].tolist(), b.at[entries].tolist(), strict=True):
        s = b.texts[t]
        left.append(s[max(0, a - LEFT) : a])
        right.append(s[a : a + LENGTH])
    return left, right


def _send_runs(ranges: int, folder: str):
    def run(index: pa.Table, told: pa.Table) -> pa.Table:
        if not told.num_rows or not any((unpack(a, np.uint8) == 2).any() for a in told.column("a").to_pylist()):
            return _block_table([])
        slab, out = index.column("slab")[0].as_py(), []
        b = Slab(folder, index.column("file")[0].as_py(), ranges)
        verdict = _verdicts(b, told)
        for r, (x, y) in enumerate(zip(b.cuts[:-1].tolist(), b.cuts[1:].tolist(), strict=True)):
            entries = x + np.flatnonzero(verdict[x:y] == 2)
            if not len(entries):
                continue
            left, right = _contexts(b, b.sent[entries])
            order = sorted(range(len(right)), key=right.__getitem__)
            ids, at = b.places(b.sent[entries[order]])
            shared, rest, data = front_code([right[k] for k in order])
            lefts = [left[k] for k in order]
            own = np.array([ids, at.astype(np.int64), (entries[order] - x).astype(np.int64)])
            out.append((r, slab, 2, pack(np.stack([shared, rest, np.fromiter(map(len, lefts), np.uint8, len(lefts))]).reshape(-1)), pack(np.frombuffer(data, np.uint8)), pack(np.frombuffer(b"".join(lefts), np.uint8)), pack(own.reshape(-1))))
        return _block_table(out)

    return run


def repeated_splits(prefix: np.ndarray, lefts: list[bytes], rights: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """(entries, 65) whether the string with l bytes left of the anchor occurs at an earlier entry.

    Entries are in suffix order with their shared prefixes; rights are their suffixes' lengths, rank
    their order in the corpus.
    """
    n = len(lefts)
    sizes = np.fromiter(map(len, lefts), np.int64, n)
    bytes_back = np.zeros((n, LEFT), np.uint8)
    for k, s in enumerate(lefts):
        bytes_back[k, : len(s)] = np.frombuffer(s, np.uint8)[::-1]
    out, left = np.zeros((n, LEFT + 1), bool), np.zeros(n, np.uint64)
    for l in range(LEFT + 1):
        segment = np.cumsum(prefix < LENGTH - l).astype(np.uint64)
        fits = np.flatnonzero((sizes >= l) & (rights >= LENGTH - l))
        if len(fits) > 1:
            key = mixed(mixed(segment[fits]) ^ left[fits])
            order = np.lexsort((rank[fits], key))
            again = np.zeros(len(fits), bool)
            again[order[1:]] = key[order[1:]] == key[order[:-1]]
            out[fits[again], l] = True
        if l < LEFT:
            left = left + _TABLE[bytes_back[:, l]] * _power(l)
    return out


def _merge(table: pa.Table) -> pa.Table:
    buckets, runs, lefts, places = table.column("slab").to_pylist(), [], [], []
    for a, b, c, d in zip(*(table.column(x).to_pylist() for x in "abcd"), strict=True):
        heads = unpack(a, np.uint8).reshape(3, -1)
        runs.append((heads[0], heads[1], unpack(b, np.uint8).tobytes()))
        text, ends = unpack(c, np.uint8).tobytes(), np.cumsum(heads[2].astype(np.int64)).tolist()
        lefts.append([text[s:e] for s, e in zip([0, *ends], ends, strict=False)])
        places.append(unpack(d, np.int64).reshape(3, -1))
    order, prefix = merge_runs(runs)
    first = np.cumsum([0, *[p.shape[1] for p in places]])
    flat = np.array([first[r] + i for r, i in order], np.int64)
    whole = np.concatenate(places, axis=1)[:, flat]
    lengths = np.concatenate([r[0].astype(np.int64) + r[1] for r in runs])[flat]
    rank = np.empty(len(flat), np.int64)
    rank[np.lexsort((whole[1], np.array(buckets)[[r for r, _ in order]], whole[0]))] = np.arange(len(flat))
    again = repeated_splits(prefix, [lefts[r][i] for r, i in order], lengths, rank)
    bits, run_of = np.packbits(again, axis=1, bitorder="little"), np.array([r for r, _ in order])
    r = table.column("range")[0].as_py()
    out = []
    for k, b in enumerate(buckets):
        mine = np.flatnonzero((run_of == k) & again.any(axis=1))
        if len(mine):
            out.append((r, b, 3, pack(whole[2][mine]), pack(bits[mine].reshape(-1)), None, None))
    return _block_table(out)


def _cut(ranges: int, folder: str, texts_too: bool):
    def run(index: pa.Table, told: pa.Table) -> pa.Table:
        b = Slab(folder, index.column("file")[0].as_py(), ranges)
        sizes = np.fromiter(map(len, b.texts), np.int64, len(b.texts))
        begins = np.cumsum(sizes) - sizes
        verdict = _verdicts(b, told)
        full = np.concatenate((b.local, b.sent[verdict == 1]))
        starts = np.zeros(int(sizes.sum()) + 1, np.int32)  # where repeated strings start, as differences

        def mark(text: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
            low, high = np.maximum(low, 0), np.minimum(high, sizes[text] - LENGTH)
            ok = low <= high
            np.add.at(starts, begins[text[ok]] + low[ok], 1)
            np.add.at(starts, begins[text[ok]] + high[ok] + LENGTH, -1)

        mark(b.text[full], b.at[full] - LEFT, b.at[full])
        for r, kind, a, bits in zip(*(told.column(c).to_pylist() for c in ("range", "kind", "a", "b")), strict=True):
            if kind == 3:
                e = b.sent[b.cuts[r] + unpack(a, np.int64)]
                which, l = np.nonzero(np.unpackbits(unpack(bits, np.uint8).reshape(len(e), -1), axis=1, bitorder="little")[:, : LEFT + 1])
                mark(b.text[e][which], b.at[e][which] - l, b.at[e][which] - l)
        gone = np.cumsum(starts)[:-1] > 0
        removed, spans, digests, kept = [], [], [], []
        for t, s, n in zip(b.texts, begins.tolist(), sizes.tolist(), strict=True):
            g = gone[s : s + n]
            count = int(g.sum())
            removed.append(count)
            spans.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if n else 0)
            rest = np.frombuffer(t, np.uint8)[~g].tobytes() if count else t
            digests.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest if texts_too else b"")
        out = [b.ids, pa.array(sizes), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())]
        return pa.table(out[: 5 + texts_too], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + texts_too])

    return run


def without_repeats(docs: DataFrame, texts_too: bool = True) -> DataFrame:
    """docs (doc_id integer, text) -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]), one row per row.

    A byte goes if some 100-byte string that covers it also starts earlier in the corpus: in a
    document of smaller doc_id, or earlier in its own. Null texts are empty; nulls come before all
    ids. Rows that repeat a doc_id lie by their text within a slab, and by their slab between
    slabs; each later one's strings repeat. A very long text is a slab of its own, worked through in
    one task. Other columns are ignored. An empty table gives an empty table.
    """
    index, folder = slabs(docs, "suffixes", side=find_anchors)
    count, size = index.agg(F.count("*"), F.sum("bytes")).first()
    ranges = max(1, math.ceil((size or 0) / RANGE_BYTES))
    own = dealt(index.select("slab", "file"), count)
    verdicts = dealt(own.mapInArrow(_send_anchors(ranges, folder), _BLOCKS), ranges, "range").groupBy("range").applyInArrow(_decide, _BLOCKS)
    runs = own.groupBy("slab").cogroup(dealt(verdicts, count).groupBy("slab")).applyInArrow(_send_runs(ranges, folder), _BLOCKS)
    splits = dealt(runs, ranges, "range").groupBy("range").applyInArrow(_merge, _BLOCKS)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts_too
    return own.groupBy("slab").cogroup(dealt(verdicts.unionByName(splits), count).groupBy("slab")).applyInArrow(_cut(ranges, folder, texts_too), schema)
