"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules look at one text: its words, symbols, repeated lines and repeated 8-word windows.
Across documents, lines are normalised and hashed; a line that occurs in more distinct documents
of its host than both a fixed limit and a share of the host's documents is boilerplate. Its
words are taken off, and documents with too few words left are rejected.

Texts are read once: a pass writes each row's counts and the hashes of its lines as a table, and
all that follows works on that. So a filter on the result never repeats the counting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

WINDOW, MIN_WORDS, MAX_REPEAT, LINE_DOCS, LINE_SHARE, LEFT_SHARE = 8, 20, 30, 10, 0.05, 0.3
SPACE, BLANKS = r"[\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"


def repeat_words(words: str = "_words", window: int = WINDOW) -> dict[str, str]:
    """SQL expressions, step by step, for the number of words in windows found twice or more.

    _hashes: a hash per word; _keys: a hash per window, by doubling; _again: ascending starts of windows whose
    key another window shares. The covered words are the union of [start, start + window).
    """
    if window & (window - 1):
        raise ValueError("the window is a power of two")
    steps = ", ".join(str(1 << k) for k in range(window.bit_length() - 1))
    return {
        "_hashes": f"transform({words}, w -> xxhash64(w))",
        "_keys": f"CASE WHEN size(_hashes) >= {window} THEN slice(aggregate(array({steps}), _hashes, (h, s) -> zip_with(h, slice(h, s + 1, size(h)), (a, b) -> xxhash64(a, b))), 1, size(_hashes) - {window - 1}) ELSE array() END",
        "_ordered": "CASE WHEN size(array_distinct(_keys)) < size(_keys) THEN sort_array(transform(_keys, (k, i) -> struct(k AS k, i AS i))) ELSE cast(array() AS array<struct<k: bigint, i: int>>) END",
        "_again": "array_sort(transform(filter(_ordered, (x, j) -> coalesce(x.k = get(_ordered, j - 1).k, false) OR coalesce(x.k = get(_ordered, j + 1).k, false)), x -> x.i))",
        "n_repeat_words": f"aggregate(transform(_again, (x, j) -> least({window}, coalesce(get(_again, j + 1) - x, {window}))), 0L, (a, b) -> a + b)",
    }


def profiles(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, source) -> a written table: one row per row, with the base counts, base_failed, and its lines' hashes.

    Columns: row (a number of its own), doc_id, other (tells null ids apart, by text), host, counts,
    and lines, an array of (line, words) over the lines with a word.
    """
    bare = F.btrim(F.col("text"), F.lit(BLANKS))
    out = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("host"), text_of().alias("text"))
    out = out.select(
        "doc_id", "host", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("other"), F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"), F.length(F.regexp_replace("text", r"[^#*$%&|<>]++", "")).cast("long").alias("n_symbols"),
        F.expr("filter(split(text, '\\n'), x -> x RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')").alias("_lines"), F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE)).alias("_words"),
    )
    out = out.withColumn("n_words", F.size("_words").cast("long")).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    for name, step in repeat_words().items():
        out = out.withColumn(name, F.expr(step))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    lines = F.transform("_lines", lambda x: F.struct(F.xxhash64(F.lower(F.btrim(x, F.lit(" \t\r")))).alias("line"), F.size(F.split(F.btrim(x, F.lit(BLANKS)), SPACE)).alias("words")))
    return written(out.select(F.monotonically_increasing_id().alias("row"), "doc_id", "other", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), lines.alias("lines")), "rules")


def boilerplate(profiled: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """profiles -> (host, line): hashes of the lines that occur in too many distinct documents of a host.

    A doc_id that repeats is one document; rows without one are told apart by their texts. Equal
    pairs of line and document are dropped before lines are counted, so a common line is spread
    over its documents first.
    """
    held = profiled.select("host", "doc_id", "other", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line")).distinct()
    hosts = profiled.select("host", "doc_id", "other").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    many = held.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > line_docs)
    return many.join(hosts, "host").where(F.col("n") > line_share * F.col("docs")).select("host", "line")


def judged(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, left_share: float = LEFT_SHARE) -> DataFrame:
    """docs (doc_id, text, source) -> one row per row: base counts, base_failed, n_left (words after removal), kept.

    Null and empty texts have no words and fail. A null source is a host like any other, the empty
    one's. Rows that repeat a doc_id, null or not, are judged each by its own text; equal rows get
    equal verdicts. A document is depleted if fewer than MIN_WORDS or `left_share` of its words are
    left. A very long text is one row's arrays in one task. Other columns are ignored, whatever
    their names. An empty table gives an empty table.
    """
    all_ = profiles(docs)
    off = all_.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.line", "x.words").join(boilerplate(all_, line_docs, line_share), ["host", "line"]).groupBy("row").agg(F.sum("words").alias("off"))
    left = (F.col("n_words") - F.coalesce("off", F.lit(0))).alias("n_left")
    both = all_.drop("lines").join(off, "row", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", left)
    return both.withColumn("kept", ~F.col("base_failed") & (F.col("n_left") >= MIN_WORDS) & (F.col("n_left") >= left_share * F.col("n_words")))
