"""Joins and set checks that the engine's steps rest on, as operators on a caller's tables."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def zipped(left: DataFrame, right: DataFrame, by: list[str], order: str) -> DataFrame:
    """Rows of both paired by their place in the group: (by, place, left, right, problem); one side's rows without a partner are `uneven`."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    pack = lambda df, name: df.select(*by, at.alias("place"), F.struct(*[c for c in df.columns if c not in by]).alias(name))
    both = pack(left, "left").join(pack(right, "right"), [*by, "place"], "full")
    return both.withColumn("problem", F.when(F.col("left").isNull() | F.col("right").isNull(), "uneven"))


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], value: str, by: list[str]) -> DataFrame:
    """(by, found, dropped): rows with and without a value that isn't empty."""
    hit = F.coalesce(F.col(value).cast("string") != "", F.lit(False))
    return rows.join(table.select(*on, value), on, "left").groupBy(*by).agg(F.count_if(hit).alias("found"), F.count_if(~hit).alias("dropped"))


def scored(items: DataFrame, scores: DataFrame, on: list[str]) -> DataFrame:
    """items with their score; one that is missing counts as 0 and is told by `missing`."""
    return items.join(scores.select(*on, "score", F.lit(True).alias("_there")), on, "left").withColumn("missing", F.col("_there").isNull()).withColumn("score", F.coalesce("score", F.lit(0))).drop("_there")


def rendered_groups(items: DataFrame, groups: DataFrame, on: list[str], value: str, order: str, none: str = "none") -> DataFrame:
    """groups with `rendered`, their items' values in order, joined by commas; `none` where there are none. A group's text is one row."""
    listed = items.groupBy(*on).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(value).alias("_x")))), lambda x: x["_x"]), ", ").alias("rendered"))
    return groups.join(listed, on, "left").withColumn("rendered", F.coalesce("rendered", F.lit(none)))


def certain(items: DataFrame, by: list[str], order: str, certainty: str, least: int) -> DataFrame:
    """items (by, order, value, certainty) that are certain enough, numbered in their group; an unknown certainty is 0."""
    return items.where(F.coalesce(certainty, F.lit(0)) >= least).withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(order)))


def left_to_do(cases: DataFrame, done: DataFrame, on: list[str], failed: Column) -> DataFrame:
    """Cases without a finished run."""
    return cases.join(done.where(~failed).select(*on), on, "left_anti")


def release(approved: DataFrame, sealed: DataFrame, on: str) -> DataFrame:
    """approved ids with a status: `released`, `missing` or, where the other side has it more than once, `duplicate`."""
    n = sealed.groupBy(on).agg(F.count("*").alias("_n"))
    return approved.join(n, on, "left").withColumn("status", F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "duplicate").otherwise("released")).drop("_n")


def grid(spark: SparkSession, dimensions: dict[str, list[int]], name: str) -> DataFrame:
    """Every combination of the values, with its name. The dimensions are configuration; rows are made on the driver."""
    rows = [(*values, name.format(**dict(zip(dimensions, values, strict=True)))) for values in itertools.product(*dimensions.values())]
    return spark.createDataFrame(rows, ", ".join(f"{d} int" for d in dimensions) + ", name string")


def filled(own: DataFrame, matched: DataFrame, on: list[str]) -> DataFrame:
    """own (on, profile) with missing profiles taken from matched (on, profile); `filled` tells which."""
    both = own.join(matched.select(*on, F.col("profile").alias("_other")), on, "left")
    return both.withColumn("filled", F.col("profile").isNull() & F.col("_other").isNotNull()).withColumn("profile", F.coalesce("profile", "_other")).drop("_other")


def latest(updates: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    return updates.groupBy(*by).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def first_wins(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.min_by(value, order).alias(value), F.min(order).alias(order))


def new_records(records: DataFrame, by: list[str], guess: str, order: str, prior: DataFrame | None = None) -> DataFrame:
    """records whose guess, in lower case with single spaces, is new in its group: the first of each, and none that `prior` has.

    Guesses are compared by their SHA-256, so that long ones aren't dealt out.
    """
    key = F.sha2(F.lower(F.trim(F.regexp_replace(guess, r"\s+", " "))), 256)
    own = records.withColumn("_key", key)
    if prior is not None:
        own = own.join(prior.select(*by, key.alias("_key")), [*by, "_key"], "left_anti")
    return own.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "_key").orderBy(order))).where("_rank = 1").drop("_rank", "_key")


def unknown(keys: Column, allowed: list[str]) -> Column:
    return F.array_except(keys, F.array(*map(F.lit, allowed)))


def missing(keys: Column, required: list[str]) -> Column:
    return F.array_except(F.array(*map(F.lit, required)), keys)


def sessions(events: DataFrame, by: list[str], order: str, gap: float) -> DataFrame:
    """events with `session`, counted from 0: a new one begins after more than `gap`."""
    w = Window.partitionBy(*by).orderBy(order)
    far = F.coalesce(F.col(order) - F.lag(order).over(w) > gap, F.lit(False))
    return events.withColumn("_far", far.cast("int")).withColumn("session", F.sum("_far").over(w)).drop("_far")


def gap_pieces(chunks: DataFrame, by: list[str], gap: float, longest: float) -> DataFrame:
    """chunks (by, start, stop) of audio -> (by, session, piece, start, stop, boundary): joined where they follow within `gap`, then cut every `longest`.

    boundary: `full` where a piece is cut, `gap` at a session's end, `end` at the end of the stream.
    """
    w = Window.partitionBy(*by).orderBy("start")
    far = F.coalesce(F.abs(F.col("start") - F.lag("stop").over(w)) > gap, F.lit(False)).cast("int")
    own = chunks.withColumn("_far", far).withColumn("session", F.sum("_far").over(w)).groupBy(*by, "session").agg(F.min("start").alias("_a"), F.max("stop").alias("_b"))
    own = own.withColumn("_last", F.max("session").over(Window.partitionBy(*by)) == F.col("session"))
    cut = own.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil((F.col("_b") - F.col("_a")) / longest) - 1))))
    stop = F.least(F.col("_a") + (F.col("piece") + 1) * longest, "_b")
    boundary = F.when((F.col("piece") + 1) * longest <= F.col("_b") - F.col("_a"), "full").when(F.col("_last"), "end").otherwise("gap")
    return cut.select(*by, "session", "piece", (F.col("_a") + F.col("piece") * longest).alias("start"), stop.alias("stop"), boundary.alias("boundary"))


def endpoints(speech: DataFrame, by: list[str], hangover: float = 1.2, longest: float = 30.0) -> DataFrame:
    """speech (by, start, stop) -> (by, utterance, start, stop, boundary): utterances that end after `hangover` of silence or at `longest`.

    The stand-in for an endpoint detector without its model: speech that is nearer than the hangover
    is one utterance; `silence` ends come the hangover after the last speech, `longest` ones as the
    utterance fills up, and `end` is the end of the stream.
    """
    named = gap_pieces(speech, by, hangover, longest)
    kind = F.when(F.col("boundary") == "full", "longest").when(F.col("boundary") == "gap", "silence").otherwise("end")
    stop = F.col("stop") + F.when(F.col("boundary") == "gap", hangover).otherwise(0.0)
    return named.select(*by, F.row_number().over(Window.partitionBy(*by).orderBy("session", "piece")).alias("utterance"), "start", F.bround(stop, 3).alias("stop"), kind.alias("boundary"))


def cpu_set(spec: Column) -> Column:
    """`0-3,5` as an ascending array without repeats; null where a part is empty, half a range, or falls."""
    parts = F.transform(F.split(spec, ","), lambda p: F.trim(p))
    low, high = (lambda p: F.split(p, "-")[0].cast("int")), (lambda p: F.element_at(F.split(p, "-"), -1).cast("int"))
    fine = F.forall(parts, lambda p: p.rlike("^[0-9]+(-[0-9]+)?$"))
    spread = F.transform(parts, lambda p: F.when(low(p) <= high(p), F.sequence(low(p), high(p))))
    return F.when(fine, F.when(F.forall(spread, lambda x: x.isNotNull()), F.sort_array(F.array_distinct(F.flatten(spread)))))


def size_in_billions(name: Column) -> Column:
    """The last `7B` or `350M` of a model's name, in billions; null without one."""
    last = F.try_element_at(F.regexp_extract_all(name, F.lit(r"(?i)([0-9]+(?:\.[0-9]+)?\s*[BM])"), F.lit(1)), F.lit(-1))
    number = F.regexp_extract(last, r"[0-9.]+", 0).cast("double")
    return F.when(F.upper(last).endswith("M"), number / 1000).otherwise(number)


def associated_data(form: Column, source_name: Column, track_id: Column) -> Column:
    """Canonical compact JSON of the three, keys in order of the alphabet."""
    return F.to_json(F.struct(form.alias("format"), source_name.alias("source_name"), track_id.alias("track_id")))


def base64_text(data: Column) -> Column:
    """Base64 in one line."""
    return F.regexp_replace(F.base64(data), r"\s", "")


def prompt(template: str, values: dict[str, Column]) -> Column:
    """template with each `{{NAME}}` filled in, one name after the other: what one value brings in, a later one fills."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value)
    return out


def templates(text: str) -> tuple[str, str]:
    """A prompt file's two sections, each headed by a line of dashes and a name."""
    parts = [p.split("\n", 1)[1].strip() for p in text.split("----- ")[1:] if "\n" in p]
    if len(parts) != 2:
        raise ValueError(f"a prompt file has two sections, not {len(parts)}")
    return parts[0], parts[1]
