"""Summaries of timings, power, scores and queues, as operators on a caller's table.

Groups are the columns named in `by`. What is summed up is pre-aggregated before it is dealt out;
bounds over a whole table are one aggregated row that is joined back, never a window without keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed value: tokens that a line has on average.
TOKENS_PER_LINE = 21.9625


def timing_summary(rows: DataFrame, by: list[str], seconds: str = "seconds") -> DataFrame:
    """(by, n, mean_seconds, maximum_seconds), rounded to six places; null seconds don't count, and a group without any has nulls."""
    return rows.groupBy(*by).agg(F.count(seconds).alias("n"), F.bround(F.avg(seconds), 6).alias("mean_seconds"), F.bround(F.max(seconds), 6).alias("maximum_seconds"))


def lag_summary(rows: DataFrame, by: list[str], at: str, lag: str, warmup: float) -> DataFrame:
    """The same over rows after the warm-up; groups with none stay, with nulls."""
    return timing_summary(rows.withColumn(lag, F.when(F.col(at) > warmup, F.col(lag))), by, lag)


def power_summary(samples: DataFrame, by: list[str], idle: float = 0.0) -> DataFrame:
    """samples (by, at, watts) -> (by, n, duration, mean, p95_nearest, p95_linear, peak, energy), less `idle` watts.

    p95_nearest is the value at place min(n - 1, floor(0.95 n)) of the sorted ones, p95_linear the
    interpolated percentile; energy is the trapezoid sum. Samples are ranked by a window, so that a
    long run is sorted, not gathered in one row.
    """
    order, ranked = Window.partitionBy(*by).orderBy("at"), Window.partitionBy(*by).orderBy("w")
    own = samples.withColumn("w", F.col("watts") - idle)
    strip = (F.col("w") + F.lag("w").over(order)) / 2 * (F.col("at") - F.lag("at").over(order))
    own = own.withColumn("_strip", strip).withColumn("_k", F.row_number().over(ranked) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    place = 0.95 * (F.col("_n") - 1)
    nearest = F.max(F.when(F.col("_k") == F.least(F.col("_n") - 1, F.floor(0.95 * F.col("_n"))), F.col("w")))
    linear = F.sum(F.when(F.col("_k") == F.floor(place), F.col("w") * (1 - (place - F.floor(place)))).when(F.col("_k") == F.floor(place) + 1, F.col("w") * (place - F.floor(place))))
    return own.groupBy(*by).agg(F.count("*").alias("n"), (F.max("at") - F.min("at")).alias("duration"), F.avg("w").alias("mean"), nearest.alias("p95_nearest"), linear.alias("p95_linear"), F.max("w").alias("peak"), F.coalesce(F.sum("_strip"), F.lit(0.0)).alias("energy"))


def moving_average(samples: DataFrame, by: list[str], value: str, width: int = 25) -> DataFrame:
    """samples (by, at, value) with `smooth`: the mean of `width` values around; the value itself where the window would reach over an end."""
    order, half = Window.partitionBy(*by).orderBy("at"), width // 2
    k, n = F.row_number().over(order), F.count("*").over(Window.partitionBy(*by))
    return samples.withColumn("smooth", F.when((k <= half) | (n - k < half), F.col(value)).otherwise(F.avg(value).over(order.rowsBetween(-half, half))))


def rails(readings: DataFrame, by: list[str], core: str = "VDD_CORE") -> DataFrame:
    """readings (by, line) of a power chip -> (by, rail_watts, total_w, core_w): watts of rails with both a current and a voltage.

    Lines look like `3V3_SYS_A current(1)=0.05` and `3V3_SYS_V volt(9)=3.3`; others are passed over.
    """
    form = r"^\s*(\w+)_([AV])\s+\w+\([0-9]+\)=([0-9.]+)"
    own = readings.where(F.col("line").rlike(form)).select(*by, F.regexp_extract("line", form, 1).alias("rail"), F.regexp_extract("line", form, 2).alias("kind"), F.regexp_extract("line", form, 3).try_cast("double").alias("x"))
    pairs = own.groupBy(*by, "rail").agg(F.max(F.when(F.col("kind") == "A", F.col("x"))).alias("a"), F.max(F.when(F.col("kind") == "V", F.col("x"))).alias("v"))
    watts = pairs.select(*by, "rail", (F.col("a") * F.col("v")).alias("w")).where("w IS NOT NULL")
    return watts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rail", "w")))).alias("rail_watts"), F.sum("w").alias("total_w"), F.sum(F.when(F.col("rail") == core, F.col("w"))).alias("core_w"))


def real_time_factor(events: DataFrame, by: list[str], capture: str, seconds: Column) -> DataFrame:
    """events (by, stage, stop) -> (by, rtf): the last end of any stage but `capture` over the audio's seconds; null where that isn't positive."""
    ended = F.max(F.when(F.col("stage") != capture, F.col("stop")))
    return events.groupBy(*by).agg(F.when(seconds > 0, ended / seconds).alias("rtf"))


def weighted_rtf(one: Column, two: Column, three: Column) -> Column:
    """One factor for the shares of time with one, two and three speakers."""
    return 0.81 * one + 0.15 * two + 0.04 * three


def leakage(scores: DataFrame, by: list[str]) -> DataFrame:
    """scores (by, score) -> (by, leakage, items): the mean of items' scores, 0 where there are none."""
    return scores.groupBy(*by).agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("leakage"), F.count("score").alias("items"))


def utility(readability: Column, meaning: Column, hallucinations: Column) -> Column:
    """A struct (score, error): the mean of three judgements; one that is missing or out of range gives 0 and says which."""
    fine = lambda x, low, high: F.coalesce(x.between(low, high), F.lit(False))
    error = F.when(~fine(readability, 1, 10), "readability").when(~fine(meaning, 1, 10), "meaning").when(~F.coalesce(hallucinations.isin(0, 1), F.lit(False)), "hallucinations")
    return F.struct(F.when(error.isNull(), (readability / 10 + meaning / 10 + hallucinations) / 3).otherwise(0.0).alias("score"), error.alias("error"))


def split_counts(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """rows (split), expected (split, n) -> (split, n, expected, mismatch); a split on one side only is a mismatch."""
    own = rows.groupBy("split").agg(F.count("*").alias("n"))
    both = own.join(expected.withColumnRenamed("n", "expected"), "split", "full")
    return both.select("split", F.coalesce("n", F.lit(0)).alias("n"), "expected", (~F.col("n").eqNullSafe(F.col("expected"))).alias("mismatch"))


def run_report(windows: DataFrame, by: list[str]) -> DataFrame:
    """windows (by, edits, started, stopped, seconds) -> (by, active, empty, elapsed_ratio): windows with and without edits, elapsed time over the audio's."""
    return windows.groupBy(*by).agg(F.count_if(F.col("edits") > 0).alias("active"), F.count_if(F.col("edits") == 0).alias("empty"), ((F.max("stopped") - F.min("started")) / F.max("seconds")).alias("elapsed_ratio"))


def verdict_counts(records: DataFrame, by: list[str]) -> DataFrame:
    """records (by, reason) -> (by, accepted, rejected, reasons): how often each reason was given, by reason. A null reason is acceptance."""
    each = records.groupBy(*by, "reason").agg(F.count("*").alias("n"))
    reasons = F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))))
    return each.groupBy(*by).agg(F.sum(F.when(F.col("reason").isNull(), F.col("n")).otherwise(0)).alias("accepted"), F.sum(F.when(F.col("reason").isNotNull(), F.col("n")).otherwise(0)).alias("rejected"), reasons.alias("reasons"))


def mean_vector(vectors: DataFrame, by: list[str]) -> DataFrame:
    """vectors (by, v, weight) -> (by, v): the weighted mean, made of unit length. Groups without weight are left out."""
    parts = vectors.select(*by, "weight", F.posexplode("v").alias("place", "x")).groupBy(*by, "place").agg((F.sum(F.col("x").cast("double") * F.col("weight")) / F.sum("weight")).alias("m"))
    whole = parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "m"))), lambda x: x["m"]).alias("_v"))
    size = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    return whole.select(*by, F.transform("_v", lambda x: x / size).alias("v")).where(size > 0)


def less_group_mean(vectors: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """vectors (by, keep, v) as rows (by, keep, place, x): each column less its mean in the group. Means are pre-aggregated and joined back."""
    parts = vectors.select(*by, *keep, F.posexplode("v").alias("place", "x"))
    return parts.join(parts.groupBy(*by, "place").agg(F.avg("x").alias("_m")), [*by, "place"]).select(*by, *keep, "place", (F.col("x") - F.col("_m")).alias("x"))


def bounds(rows: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """rows with `<name>_low` and `<name>_high`, over the table or the groups. One small row a group is joined back."""
    ends = [f(n).alias(f"{n}_{k}") for n in names for f, k in ((F.min, "low"), (F.max, "high"))]
    return rows.join(rows.groupBy(*by).agg(*ends), by) if by else rows.crossJoin(rows.agg(*ends))


def scaled(name: str, flat: Column | None = None) -> Column:
    """A bounded column between its bounds, 0 to 1; `flat` (null if not given) where they are equal."""
    low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
    return F.when(high > low, (F.col(name) - low) / (high - low)).otherwise(F.lit(None) if flat is None else flat)


def composite(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows with `composite`: the mean of the metrics, each scaled over the table; one that is the same everywhere counts as 1."""
    return bounds(rows, names).withColumn("composite", sum((scaled(n, F.lit(1.0)) for n in names[1:]), scaled(names[0], F.lit(1.0))) / len(names)).drop(*[f"{n}_{k}" for n in names for k in ("low", "high")])


def best(rows: DataFrame, by: list[str], order: str, score: str, least: int = 1) -> DataFrame:
    """rows (by, config, order, score) -> (by, config, score): of each config its last record, of those the least score; groups of fewer than `least` configs are left out."""
    last = rows.groupBy(*by, "config").agg(F.max_by(score, order).alias(score))
    return last.groupBy(*by).agg(F.min_by("config", F.struct(score, "config")).alias("config"), F.min(score).alias(score), F.count("*").alias("configs")).where(F.col("configs") >= least).drop("configs")


def distance_to_best(rows: DataFrame, ideal: dict[str, tuple[float, float]]) -> DataFrame:
    """rows with `distance` to the ideal point and `behind`, the distance less that of the nearest row. ideal: name -> (value there, what counts as one)."""
    own = rows.withColumn("distance", F.sqrt(sum(((F.col(n) - at) / unit) * ((F.col(n) - at) / unit) for n, (at, unit) in ideal.items())))
    return own.crossJoin(own.agg(F.min("distance").alias("_least"))).withColumn("behind", F.col("distance") - F.col("_least")).drop("_least")


def skyline(rows: DataFrame, by: list[str], cost: str, gain: str, order: str) -> DataFrame:
    """The rows that no cheaper one equals in gain, walked by rising cost (ties in the order given): a running maximum, no join of all pairs."""
    before = F.max(gain).over(Window.partitionBy(*by).orderBy(cost, order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_best", before).where(F.col("_best").isNull() | (F.col(gain) > F.col("_best"))).drop("_best")


def queue_depth(events: DataFrame, by: list[str], order: str) -> DataFrame:
    """events (by, item, order, change: 1 in, -1 out) -> with depth, and oldest: the order of the earliest item still waiting (first in, first out)."""
    w = Window.partitionBy(*by).orderBy(order)
    own = events.withColumn("depth", F.sum("change").over(w)).withColumn("_out", F.sum(F.when(F.col("change") < 0, 1).otherwise(0)).over(w))
    arrivals = events.where("change > 0").select(*by, F.col(order).alias("oldest"), (F.row_number().over(w) - 1).alias("_out"))
    return own.join(arrivals, [*by, "_out"], "left").withColumn("oldest", F.when(F.col("depth") > 0, F.col("oldest"))).drop("_out")


def skip_offsets(skips: DataFrame, queries: DataFrame, by: list[str]) -> DataFrame:
    """queries (by, at) with `offset`, the seconds skipped up to and at `at`, and `skip_at`, the last skip's time (null before any).

    skips: (by, at, skipped). One ordered pass over both tables: no range join.
    """
    rest = [c for c in queries.columns if c not in (*by, "at")]
    both = skips.select(*by, "at", "skipped", F.lit(0).alias("_kind"), F.lit(None).cast(queries.select(F.struct(*rest)).schema[0].dataType).alias("_row")).unionByName(queries.select(*by, "at", F.lit(0.0).alias("skipped"), F.lit(1).alias("_kind"), F.struct(*rest).alias("_row")))
    w = Window.partitionBy(*by).orderBy("at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = both.withColumn("offset", F.sum("skipped").over(w)).withColumn("skip_at", F.last(F.when(F.col("_kind") == 0, F.col("at")), True).over(w))
    return own.where("_kind = 1").select(*by, "at", "_row.*", "offset", "skip_at")


def cumulative(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """rows with `cumulative`, the running total; rows of equal order count together."""
    return rows.withColumn("cumulative", F.sum(value).over(Window.partitionBy(*by).orderBy(order)))


def rebuilt_timeline(events: DataFrame, skips: DataFrame, by: list[str], capture: str = "source_capture") -> DataFrame:
    """events (by, at, stage, available) -> moved by what was skipped up to `at`; capture events are left out. The lag is against the unmoved `available`."""
    moved = skip_offsets(skips, events.where(F.col("stage") != capture), by)
    return moved.withColumn("completed", F.col("at") + F.coalesce("offset", F.lit(0.0))).withColumn("lag", F.bround(F.col("completed") - F.col("available"), 6)).drop("skip_at")


def since_start(rows: DataFrame, by: list[str], at: str) -> DataFrame:
    """rows with `since`, the time from the group's first, to six places."""
    return rows.withColumn("since", F.bround(F.col(at) - F.min(at).over(Window.partitionBy(*by)), 6))


def token_budget(lines: Column) -> Column:
    """Tokens for so many lines: one at least, rounded half to even."""
    return F.greatest(F.lit(1), F.bround(lines * TOKENS_PER_LINE)).cast("int")


def dense_lines(n: Column, share: float) -> Column:
    """Whether line n (from 0) is one of the evenly spread `share` of lines."""
    return F.floor((n + 1) * share + 0.5) > F.floor(n * share + 0.5)


def longest_prefix(parts: DataFrame, by: list[str], order: str, tokens: str, budget: int) -> DataFrame:
    """(by, parts, tokens): how many leading parts fit the budget; groups of which none fits have zeros."""
    total = parts.withColumn("_upto", F.sum(tokens).over(Window.partitionBy(*by).orderBy(order)))
    return total.groupBy(*by).agg(F.count_if(F.col("_upto") <= budget).alias("parts"), F.coalesce(F.max(F.when(F.col("_upto") <= budget, F.col("_upto"))), F.lit(0)).alias("tokens"))


def diagnostics(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs (by, x, y) of samples -> (by, peak_x, peak_y, correlation, finite); no correlation where one of them hardly varies."""
    odd = F.isnan("x") | F.isnan("y") | (F.abs("x") == float("inf")) | (F.abs("y") == float("inf"))
    alive = (F.stddev_pop("x") > 1e-8) & (F.stddev_pop("y") > 1e-8)
    return pairs.groupBy(*by).agg(F.max(F.abs("x")).alias("peak_x"), F.max(F.abs("y")).alias("peak_y"), F.when(alive, F.corr("x", "y")).alias("correlation"), (F.count_if(F.coalesce(odd, F.lit(True))) == 0).alias("finite"))


def idle(checks: DataFrame, by: list[str]) -> DataFrame:
    """checks (by, chunk, routed, ok) -> (by, idle): all checks hold, and the last chunk was routed."""
    return checks.groupBy(*by).agg((F.bool_and("ok") & (F.max_by("routed", "chunk") == F.max("chunk"))).alias("idle"))


def hysteresis(samples: DataFrame, by: list[str], order: str, high: int, low: int, longest: float) -> DataFrame:
    """samples (by, order, depth, age or null) with `state`: promoted above `high` or from `longest` on, background again below `low`.

    No sample can both promote and demote, so the state is that of the last signal, without a fold.
    """
    if low >= high:
        raise ValueError("the low watermark must lie below the high one")
    old = F.coalesce(F.col("age") >= longest, F.lit(False))
    signal = F.when(old | (F.col("depth") > high), "promoted").when(F.col("depth") < low, "background")
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return samples.withColumn("state", F.coalesce(F.last(signal, True).over(w), F.lit("background")))


def of_seed(rows: DataFrame, seed: int, base: int) -> DataFrame:
    """The rows of one seed; of the base seed, the whole pool."""
    return rows if seed == base else rows.where(F.col("seed") == seed)
