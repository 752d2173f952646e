"""Speaker activity over frames, as operators on a caller's table.

A frame table has the key columns named in `by` (a recording or stream), `slot`, `frame` (from 0,
contiguous; see `gaps`) and `p`, the slot's probability; an activity table has `active` as well.
Work is dealt by recording and slot or by recording and frame, so many recordings spread well and
one is bounded by its length. Rates are frames or samples a second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _along(by: list[str]) -> Window:
    return Window.partitionBy(*by, "slot").orderBy("frame")


def activity(frames: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """frames with `active`: the median of three frames' p >= threshold, along each slot; at the ends the frame itself counts twice."""
    on, along = (F.col("p") >= threshold).cast("int"), _along(by)
    return frames.withColumn("active", F.coalesce(F.lag(on).over(along), on) + on + F.coalesce(F.lead(on).over(along), on) >= 2)


def gaps(frames: DataFrame, by: list[str]) -> DataFrame:
    """(by, slot, after, next): places where frame numbers aren't contiguous; a fit frame table has none."""
    return frames.select(*by, "slot", F.col("frame").alias("after"), F.lead("frame").over(_along(by)).alias("next")).where("next <> after + 1")


def runs(points: DataFrame, by: list[str], at: str = "frame") -> DataFrame:
    """(by, first, last): the runs of consecutive numbers in `at`, for each value of the columns in `by`."""
    island = F.col(at) - F.row_number().over(Window.partitionBy(*by).orderBy(at))
    return points.select(*by, at, island.alias("island")).groupBy(*by, "island").agg(F.min(at).alias("first"), F.max(at).alias("last")).drop("island")


def label(slot: Column) -> Column:
    return F.concat(F.lit("SPEAKER_"), F.lpad(slot.cast("string"), 2, "0"))


def segments(active: DataFrame, by: list[str], rate: float, least: float = 0.1) -> DataFrame:
    """(by, slot, speaker, start, stop) in seconds, of the runs of at least `least` seconds. Order by start and speaker to list them."""
    found = runs(active.where("active"), [*by, "slot"]).where((F.col("last") + 1 - F.col("first")) / rate >= least)
    return found.select(*by, "slot", label(F.col("slot")).alias("speaker"), F.bround(F.col("first") / rate, 3).alias("start"), F.bround((F.col("last") + 1) / rate, 3).alias("stop"))


def slot_sets(active: DataFrame, by: list[str]) -> DataFrame:
    """(by, frame, slots, n): the active slots of each frame, ascending; frames without any are left out."""
    return active.where("active").groupBy(*by, "frame").agg(F.sort_array(F.collect_set("slot")).alias("slots")).withColumn("n", F.size("slots"))


def pieces(found: DataFrame, size: Column) -> DataFrame:
    """Rows with first and last cut into rows of at most `size` numbers each."""
    cut = found.withColumn("_size", size).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("last") - F.col("first")) / F.col("_size")))))
    low = F.col("first") + F.col("_k") * F.col("_size")
    return cut.withColumn("last", F.least(F.col("last"), low + F.col("_size") - 1)).withColumn("first", low).drop("_size", "_k")


def overlap_regions(active: DataFrame, by: list[str], rate: float, least: float, most: float) -> DataFrame:
    """(by, slots, speakers, start, stop) in seconds: runs of one and the same set of two or more slots.

    A run's whole length is held against `least`; then it is cut into pieces of `most` seconds.
    """
    found = runs(slot_sets(active, by).where("n >= 2"), [*by, "slots", "n"]).where((F.col("last") + 1 - F.col("first")) / rate >= least)
    return pieces(found, F.lit(max(1, int(most * rate)))).select(*by, "slots", F.col("n").alias("speakers"), (F.col("first") / rate).alias("start"), ((F.col("last") + 1) / rate).alias("stop"))


def active_slots(active: DataFrame, by: list[str], rate: float, least: float, forced: int | None = None) -> DataFrame:
    """(by, slot, seconds): slots with `least` seconds of speech; only the `forced` longest if given, ties to the lower slot."""
    found = active.groupBy(*by, "slot").agg((F.count_if(F.col("active")) / rate).alias("seconds")).where(F.col("seconds") >= least)
    if forced is None:
        return found
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("seconds"), "slot"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= forced).drop("_rank")


def to_samples(frame: Column, rate: float, sample_rate: int) -> Column:
    """The sample at which a frame starts, cut to a whole number."""
    return (frame / rate * sample_rate).cast("long")


def solo_clips(active: DataFrame, by: list[str], rate: float, sample_rate: int, least: float = 0.5, most: int = 8) -> DataFrame:
    """(by, slot, rank, start, stop) in samples: each slot's longest runs in which no other speaks, the earlier first among equals."""
    alone = slot_sets(active, by).where("n = 1").withColumn("slot", F.element_at("slots", 1))
    found = runs(alone, [*by, "slot"]).select(*by, "slot", to_samples(F.col("first"), rate, sample_rate).alias("start"), to_samples(F.col("last") + 1, rate, sample_rate).alias("stop"))
    rank = F.row_number().over(Window.partitionBy(*by, "slot").orderBy(F.desc(F.col("stop") - F.col("start")), "start"))
    return found.where(F.col("stop") - F.col("start") >= least * sample_rate).withColumn("rank", rank).where(F.col("rank") <= most)


def masks(active: DataFrame, by: list[str], separated: DataFrame | None = None) -> DataFrame:
    """(by, slot, frame, solo, uncovered) of active frames.

    solo: no other slot is active. uncovered: not solo, and in none of the `separated` intervals
    (by, first, last), whose frames are joined by equality.
    """
    n = F.count("*").over(Window.partitionBy(*by, "frame"))
    marked = active.where("active").select(*by, "slot", "frame", (n == 1).alias("solo"))
    if separated is None:
        return marked.withColumn("uncovered", ~F.col("solo"))
    covered = separated.select(*by, F.explode(F.sequence("first", "last")).alias("frame")).distinct().withColumn("_covered", F.lit(True))
    return marked.join(covered, [*by, "frame"], "left").select(*by, "slot", "frame", "solo", (~F.col("solo") & F.col("_covered").isNull()).alias("uncovered"))


def top_slots(active: DataFrame, by: list[str], most: int = 3) -> DataFrame:
    """(by, frame, slots): the active slots, or where more than `most` are active those with the highest p (ties to the higher slot); ascending."""
    rank = F.row_number().over(Window.partitionBy(*by, "frame").orderBy(F.desc("p"), F.desc("slot")))
    return active.where("active").withColumn("_rank", rank).where(F.col("_rank") <= most).groupBy(*by, "frame").agg(F.sort_array(F.collect_set("slot")).alias("slots"))


def sample_spans(active: DataFrame, by: list[str], rate: float, sample_rate: int, counts: DataFrame) -> DataFrame:
    """(by, slot, start, stop): runs as samples, the end held to the recording's `samples` in counts (by, samples)."""
    found = runs(active.where("active"), [*by, "slot"]).join(counts, by)
    return found.select(*by, "slot", to_samples(F.col("first"), rate, sample_rate).alias("start"), F.least(to_samples(F.col("last") + 1, rate, sample_rate), "samples").alias("stop")).where("stop > start")


def speech_extract(regions: DataFrame, by: list[str], sample_rate: int, counts: DataFrame) -> DataFrame:
    """regions (by, start, stop in seconds) -> (by, regions, samples): speech joined end to end, held to the recording's `samples`."""
    inside = regions.join(counts, by).select(*by, F.greatest(F.lit(0), F.bround(F.col("start") * sample_rate)).cast("long").alias("a"), F.least(F.bround(F.col("stop") * sample_rate).cast("long"), "samples").alias("b"))
    return inside.groupBy(*by).agg(F.count("*").alias("regions"), F.sum(F.greatest(F.lit(0), F.col("b") - F.col("a"))).alias("samples"))


def routes(active: DataFrame, by: list[str], rate: float, most: float, most_slots: int = 3) -> DataFrame:
    """(by, slots, route, first, last): what becomes of each stretch of frames.

    Frames without a speaker are left out; one speaker's run passes whole; runs of several are cut
    at `most` seconds and separated. Of more than `most_slots` slots the strongest count.
    """
    found = runs(top_slots(active, by, most_slots), [*by, "slots"]).withColumn("route", F.when(F.size("slots") == 1, "pass").otherwise("separate"))
    return pieces(found, F.when(F.col("route") == "pass", F.col("last") - F.col("first") + 1).otherwise(F.lit(max(1, round(most * rate))).cast("long")))


def with_context(routed: DataFrame, rate: float, sample_rate: int, collar: float) -> DataFrame:
    """Routed frames (first, last, samples) with core and context in samples; the context adds `collar` seconds each side, within the recording."""
    start = F.bround(F.col("first") / rate * sample_rate).cast("long")
    stop = F.least("samples", F.bround((F.col("last") + 1) / rate * sample_rate).cast("long"))
    side = round(collar * sample_rate)
    return routed.withColumn("core_start", start).withColumn("core_stop", stop).withColumn("context_start", F.greatest(F.lit(0), start - side)).withColumn("context_stop", F.least("samples", stop + side))


def forced_blocks(lengths: DataFrame, rate: float, seconds: float, speakers: Column) -> DataFrame:
    """lengths (..., frames) cut into fixed blocks whatever the activity; one forced speaker passes, more are separated."""
    own = lengths.where("frames > 0").withColumn("first", F.lit(0).cast("long")).withColumn("last", F.col("frames") - 1).withColumn("route", F.when(speakers == 1, "pass").otherwise("separate"))
    return pieces(own, F.lit(max(1, round(seconds * rate))).cast("long")).drop("frames")


def track_layout(parts: DataFrame, by: list[str], totals: DataFrame) -> DataFrame:
    """parts (by, start, stop in samples) -> (..., silence, kept, silence_after): a track written in order.

    Silence up to a part's start, then what of it lies after all that was written, and after the
    last part silence up to the recording's `samples` in totals (by, samples).
    """
    order = Window.partitionBy(*by).orderBy("start", "stop")
    cursor = F.coalesce(F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = parts.select(*by, "start", "stop").join(totals.select(*by, F.col("samples").alias("_total")), by).select("*", cursor.alias("_cursor"), F.lead("start").over(order).isNull().alias("_last"))
    end = F.when(F.col("_last"), F.greatest(F.lit(0), F.col("_total") - F.greatest("stop", "_cursor"))).otherwise(0)
    return own.select(*by, "start", "stop", F.greatest(F.lit(0), F.col("start") - F.col("_cursor")).alias("silence"), F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "_cursor")).alias("kept"), end.alias("silence_after"))


def fixed_chunks(lengths: DataFrame, size: int) -> DataFrame:
    """lengths (..., n) -> (..., chunk, first, stop, final): [k size, min((k + 1) size, n)); nothing for n = 0. `final` marks where a stream is flushed."""
    own = lengths.where("n > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / size))))
    return own.withColumn("first", F.col("chunk") * size).withColumn("stop", F.least((F.col("chunk") + 1) * size, "n")).withColumn("final", F.col("stop") == F.col("n")).drop("n")


# Features
def emitted(rows: DataFrame, logits: str, index: str, frame_seconds: float) -> DataFrame:
    """rows with `probabilities`, the sigmoid of all logits but the first and the last, and `at`, index times frame_seconds."""
    inner = F.slice(logits, 2, F.greatest(F.size(logits) - 2, F.lit(0)))
    return rows.withColumn("probabilities", F.transform(inner, lambda x: 1 / (1 + F.exp(-x.cast("double"))))).withColumn("at", F.col(index) * frame_seconds)


def less_running_mean(frames: DataFrame, by: list[str], value: str) -> DataFrame:
    """frames with `x`: value less the mean of all frames up to this one, along each slot."""
    return frames.withColumn("x", F.col(value) - F.avg(value).over(_along(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def stacked(frames: DataFrame, by: list[str], value: str, context: int, every: int) -> DataFrame:
    """(by, slot, frame, features): each `every`-th frame with `context` frames each side, the end frames repeated.

    Only centres with a whole stride of frames count: of n frames, n div every of them.
    """
    along, whole = _along(by), Window.partitionBy(*by, "slot")
    ends = [F.first(value).over(_along(by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(value).over(_along(by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))]
    side = [F.coalesce(F.lag(value, -k).over(along), ends[k > 0]) if k else F.col(value) for k in range(-context, context + 1)]
    own = frames.select(*by, "slot", "frame", F.array(*side).alias("features"), F.count("*").over(whole).alias("_n"))
    return own.where((F.col("frame") % every == 0) & (F.col("frame") / every < F.floor(F.col("_n") / every))).drop("_n")


def loud_blocks(samples: DataFrame, by: list[str], size: int, least: float) -> DataFrame:
    """samples (by, at, x) -> (by, block, rms): blocks of `size` samples whose root mean square is `least` or more."""
    blocks = samples.groupBy(*by, F.floor(F.col("at") / size).alias("block"))
    return blocks.agg(F.sqrt(F.sum(F.col("x") * F.col("x")) / F.count("*")).alias("rms")).where(F.col("rms") >= least)


def core(context: Column, context_start: Column, core_start: Column, samples: Column) -> Column:
    """The core's samples out of those of its context."""
    return F.slice(context, core_start - context_start + 1, samples)


def fixed_length(x: Column, n: int) -> Column:
    """x cut to n elements, or filled up with zeros at its end."""
    return F.concat(F.slice(x, 1, n), F.array_repeat(F.lit(0).cast("float"), F.greatest(F.lit(n) - F.size(x), F.lit(0))))
