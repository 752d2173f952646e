"""SimHash near-duplicates by covering locality-sensitive hashing.

Every text gets a 64-bit fingerprint (majority of its shingles' hashes). For a radius r each bit
position gets a vector of r+1 random bits; each non-zero vector v of r+1 bits gives a table whose
mask holds the positions with odd <m(i), v>. The vectors of r differing positions span less than
the whole space, so some v is orthogonal to all of them: every pair within the radius agrees on
the mask of at least one of the 2^(r+1)-1 tables. That is a guarantee, not a probability.

Work is done on distinct fingerprints. In a table, those that agree on its mask can differ only in
its free positions. So each member of a bucket of two or more is dealt to itself and to its words
with one free position flipped: two of a bucket differ in at most two bits if and only if they meet
at some word. Those that meet are linked to the least of them (at most 65 can meet). No pairs are
compared, so a bucket of any size costs as much for each member, and nothing is capped.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, text_of
from .components import components

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined, xx = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < shingle:
        return xx(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    hashes = np.fromiter((xx(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _add_fingerprints(shingle: int):
    def run(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()
            fps = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps.view(np.int64))], [*b.schema.names[:-1], "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the columns named in `also`, fp long): one row per row of docs."""
    return docs.select("doc_id", *also, text_of().alias("text")).mapInArrow(_add_fingerprints(shingle), T.StructType([*[docs.schema[c] for c in ("doc_id", *also)], T.StructField("fp", T.LongType())]))


def masks(radius: int = RADIUS, seed: int = 7) -> list[int]:
    """The covering masks as signed longs; each bit position has a non-zero random vector, dealt evenly."""
    rng, kinds = random.Random(seed), (1 << (radius + 1)) - 1
    vectors = [i % kinds + 1 for i in range(BITS)]
    rng.shuffle(vectors)
    out = []
    for v in range(1, kinds + 1):
        m = sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() & 1)
        out.append(m - (1 << BITS) if m >> (BITS - 1) else m)
    return out


def links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> (u, v) links within two bits that connect all those within two bits."""
    signed = lambda i: (1 << i) - (1 << BITS if i == BITS - 1 else 0)
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks())])
    keyed = fps.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key")
    free = F.array(*[F.array(*[F.lit(0).cast("long"), *[F.lit(signed(i)).cast("long") for i in range(BITS) if not m >> i & 1]]) for m in masks()])
    words = keyed.join(shared, ["t", "key"]).select("t", "fp", F.explode(F.transform(F.element_at(free, F.col("t") + 1), lambda x: F.col("fp").bitwiseXOR(x))).alias("word"))
    met = words.groupBy("t", "word").agg(F.min("fp").alias("v"), F.collect_list("fp").alias("us")).where(F.size("us") > 1)
    return met.select(F.explode("us").alias("u"), "v").where("u <> v").distinct()


def _rooted(distinct: DataFrame) -> DataFrame:
    """distinct (fp, ...) with the root of each fingerprint's component."""
    found = components(links(distinct.select("fp")))
    return distinct.join(found, distinct.fp == found.node, "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, fingerprint, component_id), one row per row of docs.

    Null and empty texts have fingerprint zero and link like any other. A document on its own is
    its own component. Equal texts share a fingerprint, so copies cost one comparison in all.
    Other columns are ignored, whatever their names. Null doc_ids stay and never name a component
    unless a component has no other. Repeated rows give repeated results. A very long text is
    fingerprinted whole, in one task. An empty table gives an empty table.
    """
    own = cut(fingerprints(docs, shingle))
    distinct = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    rooted = _rooted(distinct)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return own.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, the one with the smallest doc_id; columns unchanged.

    Null doc_ids come last; rows with equal doc_id go by a hash of the text, equal rows by their JSON.
    A row counts by its own text: a repeated doc_id stays once for each component that it leads.
    Columns may have any names. Null and empty texts are one component. An empty table stays empty.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("row"), "doc_id", text_of().alias("text"), F.xxhash64(text_of()).alias("hash"))
    own = cut(fingerprints(rows, also=("hash",)))
    copies = own.groupBy("fp", "doc_id", "hash").agg(F.count("*").alias("n"))
    distinct = cut(copies.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash", "n")).alias("first")))
    keep = cut(_rooted(distinct).groupBy("root").agg(F.min("first").alias("k")).select(F.col("k.doc_id").alias("id"), F.col("k.hash").alias("h"), "k.n"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("h"))
    once, more = (rows.join(keep.where(n), same, "left_semi").select("row", "doc_id", "hash") for n in ("n = 1", "n > 1"))
    w = Window.partitionBy("doc_id", "hash").orderBy(F.to_json("row"))
    first = more.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")
    return once.unionByName(first).select("row.*")
