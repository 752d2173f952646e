"""Retrieval over remembered edits: the nearest by cosine, with a floor and a bound on each line, merged to best scores.

Vectors are unit-length arrays. Every query of a stated set is scored against every remembered
vector, in blocks: a task meets one block of queries with one part of the memory, both of bounded
size, in Arrow, multiplies them a tile at a time, and sends on the best `candidates` of each query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Candidates of a query, how many of them are kept, and the floor of their scores.
CANDIDATES, TOP, THRESHOLD = 20, 8, 0.774
#: Queries and remembered vectors that meet in one task, at most; of long vectors, as many as BYTES hold, and queries only for so many PAIRS sent on.
BLOCK, PART, BYTES, PAIRS = 40_000, 20_000, 1 << 25, 1 << 20
#: A small memory is dealt out too: to so many parts, unless they'd have fewer vectors than LEAST.
PARTS, LEAST = 16, 1000
#: Of these, so many are multiplied at a time.
TILE, PIECE = 256, 2048


def check(candidates: int, top: int, context: int = 0) -> None:
    """Raises unless all are in range."""
    if candidates < 1 or top < 1 or context < 0:
        raise ValueError("candidates and top must be at least 1, context not negative")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A row of `width` numbers for each vector; those that it lacks are 0."""
    lists = column.combine_chunks()
    flat = lists.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) == len(lists) * width:
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width))
    out[np.arange(width) < lists.value_lengths().to_numpy(zero_copy_only=False)[:, None]] = flat
    return out


def _rounded(x: np.ndarray) -> np.ndarray:
    """To six places, halves away from zero, as SQL does."""
    x = x * 1e6
    whole = np.trunc(x)
    return (whole + np.where(np.abs(x - whole) >= 0.5, np.copysign(1, x), 0)) / 1e6 + 0.0


def _best(ids: np.ndarray, q: np.ndarray, items: np.ndarray, m: np.ndarray, candidates: int, threshold: float, others: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of m, score) of each query's best. Items ascend, so once a query has enough, a later one counts only if its score is higher."""
    floor, rows, columns, kept = np.full(len(q), threshold - 6e-7), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for at in range(0, len(m), PIECE):
        s = q @ m[at : at + PIECE].T
        r, c = np.nonzero(~(s < floor[:, None]))
        x, c = _rounded(s[r, c]), c + at
        ok = ~(x < threshold) & (ids[r] != items[c]) if others else ~(x < threshold)
        rows, columns, kept = np.append(rows, r[ok]), np.append(columns, c[ok]), np.append(kept, x[ok])
        high = np.where(np.isnan(kept), np.inf, kept)  # NaN stands above all, as in SQL
        order = np.lexsort((columns, -high, rows))
        place = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
        last = order[place == candidates - 1]
        floor[rows[last]] = high[last] + 4e-7
        order = order[place < candidates]
        rows, columns, kept = rows[order], columns[order], kept[order]
    return rows, columns, kept


def met(asked: pa.Table, own: pa.Table, width: int, candidates: int, threshold: float, others: bool = False) -> pa.Table:
    """asked (query, v) and own (item, v) -> (query, item, score): each query's best `candidates` among these items."""
    own = own.take(pa.array(np.argsort(own.column("item").to_numpy(), kind="stable")))
    names, items, m = own.column("item").combine_chunks(), own.column("item").to_numpy(), _matrix(own.column("v"), width)
    out = [pa.table([asked.column("query").slice(0, 0), names.slice(0, 0), pa.array([], pa.float64())], ["query", "item", "score"])]
    for at in range(0, asked.num_rows, TILE):
        some = asked.slice(at, TILE)
        ids = some.column("query").combine_chunks()
        rows, columns, kept = _best(ids.to_numpy(zero_copy_only=False), _matrix(some.column("v"), width), items, m, candidates, threshold, others)
        out.append(pa.table([ids.take(pa.array(rows)), names.take(pa.array(columns)), pa.array(kept)], ["query", "item", "score"]))
    return pa.concat_tables(out)


def scores(queries: DataFrame, memory: DataFrame, candidates: int = CANDIDATES, threshold: float = THRESHOLD, block: int = BLOCK, others: bool = False) -> DataFrame:
    """queries (query, v), memory (item, v) -> (query, item, score, rank): each query's best items, by score and then the lesser item.

    Queries go in blocks of `block` at most (by hash), whatever their number. With `others`, a query
    doesn't meet the item of its own number. Rows without a number or vector meet nothing.
    """
    check(candidates, 1)
    queries, memory = queries.where("query IS NOT NULL AND v IS NOT NULL"), memory.where("item IS NOT NULL AND v IS NOT NULL")
    (n_queries, wide), (n_items, wide_items) = (d.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first() for d in (queries, memory))
    width = max(wide, wide_items)
    most = max(1, BYTES // (8 * max(1, width)))
    blocks = max(1, -(-n_queries // max(1, min(block, most, PAIRS // candidates))))
    cells = max(1, -(-n_items // min(PART, most)), min(PARTS, -(-n_items // LEAST)))
    schema = f"query {queries.schema['query'].dataType.simpleString()}, item {memory.schema['item'].dataType.simpleString()}, score double"

    def dealt(rows: DataFrame, key: str, own: str, n: int, other: str, times: int) -> DataFrame:
        return rows.select(key, "v", F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias(other)).groupBy("part", "cell")

    def run(asked: pa.Table, own: pa.Table) -> pa.Table:
        return met(asked.select(["query", "v"]), own.select(["item", "v"]), width, candidates, threshold, others)

    found = dealt(queries, "query", "part", blocks, "cell", cells).cogroup(dealt(memory, "item", "cell", cells, "part", blocks)).applyInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item"))
    return found.withColumn("rank", rank).where(F.col("rank") <= candidates)


def retrieved(queries: DataFrame, memory: DataFrame, candidates: int = CANDIDATES, top: int = TOP, threshold: float = THRESHOLD, others: bool = False) -> DataFrame:
    """Each query's first `top` of its `candidates` best items, down to the threshold (equal passes)."""
    check(candidates, top)
    return scores(queries, memory, min(candidates, top), threshold, others=others)


def merged(found: DataFrame, by: list[str]) -> DataFrame:
    """Each item once for each group of queries (a window), with its best score, and `place`: the best comes last."""
    best = found.groupBy(*by, "item").agg(F.max("score").alias("score"), F.count("*").alias("queries"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("score", "item")))


def first_seen(lines: DataFrame, by: list[str], order: str) -> DataFrame:
    """The first-seen text of each line number; later ones don't alter it."""
    return lines.groupBy(*by, "n").agg(F.min_by("text", order).alias("text"))


def profile(records: DataFrame, by: list[str], order: str, fields: list[str]) -> DataFrame:
    """(by, profile): a key's records as a JSON array with an indent of two, in order; `[]` needs a record-less key row of its own."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*fields).alias("record")))), lambda x: x["record"])
    return records.groupBy(*by).agg(F.to_json(listed, {"pretty": "true"}).alias("profile"))
