"""Mixing sources to target weights by Sainte-Lague apportionment.

A source's target is its share by weight, at most `most` times its own words, the excess shared
again. Targets are turned into whole blocks of equally many words: the sources get blocks by
highest quotients target/(2q+1), then each source's shards get its blocks by highest quotients of
their sizes. A shard's documents lie end to end in seeded order and are cut into blocks; whole
passes take them all, and of the rest a seeded one-to-one map of the blocks' numbers selects as
many as the quota asks for. A document's taken words are those in selected blocks.

Only sizes travel: a total per source reaches the driver (MOST_SOURCES at most), and a total per
shard the task of its source.
"""

from __future__ import annotations

import heapq
import math
import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_of, written

WEIGHTS, SHARE, MOST, BLOCK, SEED = (3, 1, 2), 1.5, 2.0, 50, 17
#: Words of a shard, about; a shard's rows are one window task. Sources of which the driver holds a total; more raise an error.
SHARD_WORDS, MOST_SOURCES = 200_000, 5_000_000
SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: F.Column) -> F.Column:
    """Runs of anything but the six ASCII white-space characters."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, SPACE))).cast("long")


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Target of each source, in the order given; weights repeat. Sources without words get 0."""
    w = [weights[k % len(weights)] for k in range(len(sizes))]
    fixed: dict[int, float] = {k: 0.0 for k, x in enumerate(sizes) if x == 0}
    left = share * sum(sizes)
    while free := [k for k in range(len(sizes)) if k not in fixed]:
        rest = left - sum(fixed.values())
        total = sum(w[k] for k in free)
        above = [k for k in free if rest * w[k] / total > most * sizes[k]]
        if not above:
            return [fixed[k] if k in fixed else rest * w[k] / total for k in range(len(sizes))]
        fixed |= {k: float(most * sizes[k]) for k in above}
    return [fixed[k] for k in range(len(sizes))]


def sainte_lague(weights: list[float], seats: int) -> list[int]:
    """Whole seats by highest quotients weight/(2q+1); ties go to the earlier. No weight: no seats."""
    total = sum(weights)
    if total <= 0 or seats <= 0:
        return [0] * len(weights)
    q = [math.floor(w / total * seats + 0.5) for w in weights]  # right but for a few seats, which are given or taken one by one
    off = seats - sum(q)
    if off >= 0:
        heap = [(-w / (2 * n + 1), k) for k, (w, n) in enumerate(zip(weights, q, strict=True)) if w > 0]
        heapq.heapify(heap)
        for _ in range(off):
            k = heap[0][1]
            q[k] += 1
            heapq.heapreplace(heap, (-weights[k] / (2 * q[k] + 1), k))
    else:
        heap = [(w / (2 * n - 1), -k) for k, (w, n) in enumerate(zip(weights, q, strict=True)) if n > 0]
        heapq.heapify(heap)
        for _ in range(-off):
            k = -heapq.heappop(heap)[1]
            q[k] -= 1
            if q[k]:
                heapq.heappush(heap, (weights[k] / (2 * q[k] - 1), -k))
    give = [(-w / (2 * n + 1), k) for k, (w, n) in enumerate(zip(weights, q, strict=True)) if w > 0]
    take = [(w / (2 * n - 1), -k) for k, (w, n) in enumerate(zip(weights, q, strict=True)) if n > 0]
    heapq.heapify(give)
    heapq.heapify(take)
    while True:  # seats move while a quotient that has none beats one that has
        while -give[0][0] != weights[give[0][1]] / (2 * q[give[0][1]] + 1):
            heapq.heappop(give)
        while not q[-take[0][1]] or take[0][0] != weights[-take[0][1]] / (2 * q[-take[0][1]] - 1):
            heapq.heappop(take)
        best, last = give[0][1], -take[0][1]
        if best == last or (-give[0][0], -best) <= (take[0][0], -last):
            return q
        for k, n in ((last, -1), (best, 1)):
            q[k] += n
            heapq.heappush(give, (-weights[k] / (2 * q[k] + 1), k))
            if q[k]:
                heapq.heappush(take, (weights[k] / (2 * q[k] - 1), -k))


def source_quotas(totals: list[tuple[str | None, int]], block: int = BLOCK, **by) -> list[tuple]:
    """(source, words) -> (source, source_size, target, blocks, shards), in order of code points, null last."""
    rows = sorted(totals, key=lambda r: (r[0] is None, (r[0] or "").encode()))
    aim = targets([n for _, n in rows], **by)
    return [(s, n, float(t), k, max(1, round(n / SHARD_WORDS))) for (s, n), t, k in zip(rows, aim, sainte_lague(aim, round(sum(aim) / block)), strict=True)]


def shard_quotas(words: list[int], blocks: int, block: int, most: float, seed: int) -> list[tuple[int, int, int, int, int]]:
    """Of each shard: its blocks, whole passes, further blocks, and the factor and offset that select them.

    A shard is cut into equal blocks of as near `block` words as a whole number of them allows.
    Block b is selected if (factor * b + offset) mod blocks is less than the further blocks; the
    factor shares no divisor with their number, so that this holds for exactly as many.
    """
    out = []
    for k, (n, quota) in enumerate(zip(words, sainte_lague([float(n) for n in words], blocks), strict=True)):
        own, rnd = max(1, round(n / block)) if n else 0, random.Random(f"{seed} {k} {n}")
        quota = min(quota, int(most * own))
        factor = next((a for a in iter(lambda: rnd.randrange(1, max(own, 2)), None) if math.gcd(a, own) == 1), 1) if own else 1
        out.append((own, quota // own if own else 0, quota % own if own else 0, factor, rnd.randrange(max(own, 1))))
    return out


_OWN = ("size", "source_size", "target", "taken")


def row_hash(docs: DataFrame, seed: int = SEED) -> Column:
    """A seeded hash of a row's columns, but for those that mix() replaces and for maps and variants: where the row lies in its shard."""
    return F.xxhash64(F.lit(seed), *[F.col(f"`{f.name}`") for f in docs.schema if f.name not in _OWN and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])


def mix(docs: DataFrame, seed: int = SEED, block: int = BLOCK, size: Column | None = None, hashed: Column | None = None, **by) -> DataFrame:
    """docs with size, source_size, target and taken (words the mix takes of the row, repeats counted).

    `size` is the words of a row, counted in `text` if not given; `hashed` its row_hash. Null texts have size 0; null
    sources are a source of their own, the last, apart from the empty one. Repeated rows count each;
    null ids are ids. Columns of docs named size, source_size, target or taken are replaced, all
    others stay whatever their names. A document may be longer than a shard. Reruns agree: rows lie
    by a hash of their columns. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in _OWN]).alias("row")
    own = docs.select(row, "source", (word_count(text_of()) if size is None else size.cast("long")).alias("size"), (row_hash(docs, seed) if hashed is None else hashed).alias("hash"))
    narrow = written(own.select("source", "size", "hash"), "mix-sizes")
    sums = narrow.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    quotas_of = list(zip(*source_quotas([tuple(r) for r in sums], block, **by), strict=True)) or [()] * 5
    kinds = {"of": pa.string(), "source_size": pa.int64(), "target": pa.float64(), "blocks": pa.int64(), "shards": pa.int32()}
    table = spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(quotas_of, kinds.values(), strict=True)], list(kinds)))
    small = (lambda df: F.broadcast(df)) if len(sums) <= 50_000 else (lambda df: df)  # rows of the table that are broadcast; beyond, the join shuffles
    sharded = lambda df: df.join(small(table), df.source.eqNullSafe(table.of)).withColumn("shard", F.pmod("hash", "shards").cast("int")).drop("of", "shards")

    def quotas(shards: pa.Table) -> pa.Table:
        shards = shards.sort_by("at")
        got = shard_quotas(shards.column("words").to_pylist(), shards.column("blocks")[0].as_py(), block, by.get("most", MOST), seed)
        return pa.table([shards.column(c) for c in ("of", "at", "words")] + [pa.array(c, pa.int64()) for c in zip(*got, strict=True)], ["of", "at", "words", "own", "passes", "further", "factor", "shift"])

    totals = sharded(narrow).groupBy(F.col("source").alias("of"), F.col("shard").alias("at"), "blocks").agg(F.sum("size").alias("words"))
    plan = written(totals.groupBy("of").applyInArrow(quotas, "of string, at int, words long, own long, passes long, further long, factor long, shift long"), "mix-quotas")
    own = sharded(own)
    both = own.join(plan, own.source.eqNullSafe(plan.of) & (own.shard == plan.at))
    first = F.coalesce(F.sum("size").over(Window.partitionBy("source", "shard").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # block b of a shard begins at its word b * words div own; those from the first to the last of a document's words are looked at
    chosen = F.expr("""aggregate(sequence(((first + 1) * own - 1) div words, ((first + size) * own - 1) div words), 0L, (n, b) -> n + if(pmod(factor * b + shift, own) < further,
        least((b + 1) * words div own, first + size) - greatest(b * words div own, first), 0L))""")
    taken = F.when(F.col("size") > 0, F.col("passes") * F.col("size") + F.when(F.col("further") > 0, chosen).otherwise(0)).otherwise(0)
    return both.withColumn("first", first).select("row.*", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, seed: int = SEED, **by) -> DataFrame:
    """The mix as whole documents, columns unchanged: a row for each pass that takes half of it or more.

    A document is taken in blocks, so in part; it stays if half or more is in. Documents without
    words are dropped, as no quota asks for them. Columns may have any names, those of mix() too.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), word_count(text_of()).alias("words"), "source", row_hash(docs, seed).alias("hash"))
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    got = mix(row, seed, size=F.col("words"), hashed=F.col("hash"), **by).where("size > 0").select("row", times.alias("times")).where("times > 0")
    return got.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
