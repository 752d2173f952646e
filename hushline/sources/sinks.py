"""Writers. Spark's commit protocol makes each whole or absent; a rerun replaces what it wrote before."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushline.operators import lines


def transcripts(turns: DataFrame, folder: str, key: str = "conv_id", apart: bool = False) -> None:
    """(key, n, speaker, text) as numbered text: JSON lines of key and transcript, or with `apart` a folder of one file per conversation.

    A folder each suits some thousands of conversations; more belong in one table.
    """
    if not apart:
        lines.transcript(turns, [key]).write.mode("overwrite").json(folder)
        return
    line = lines.rendered(F.col("n"), F.col("speaker"), F.col("text"))
    turns.select(key, "n", line.alias("value")).repartition(key).sortWithinPartitions(key, "n").select(key, "value").write.partitionBy(key).mode("overwrite").text(folder)


def jsonl(rows: DataFrame, folder: str, *order: str) -> None:
    """A JSON object a line; with `order`, sorted over all files."""
    (rows.orderBy(*order) if order else rows).write.mode("overwrite").json(folder)


def manifest(rows: DataFrame, folder: str, columns: list[str], split: str | None = None) -> None:
    """CSV of stated columns in that order with a header, of one split or all."""
    kept = rows if split is None else rows.where(F.col("split") == split)
    kept.select(*columns).orderBy(columns[0]).write.mode("overwrite").csv(folder, header=True, lineSep="\n")


def allowed(artifacts: DataFrame, names: set[str]) -> DataFrame:
    """Artifacts (a `path` column) whose file name is on the list; anything else never reaches the device."""
    return artifacts.where(F.element_at(F.split("path", "/"), -1).isin(sorted(names)))


def artifact_manifest(artifacts: DataFrame) -> DataFrame:
    """artifacts (name, content) -> (name, bytes, sha256)."""
    return artifacts.select("name", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def artifacts_of(spark: SparkSession, pattern: str) -> DataFrame:
    """The manifest of files, by path."""
    return artifact_manifest(spark.read.format("binaryFile").load(pattern).select(F.col("path").alias("name"), "content"))


def state_of(text: Column) -> Column:
    """A state file's JSON object as a map of texts; one that is missing or broken is empty."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(text), "$", "map<string,string>"), F.create_map().cast("map<string,string>"))


def csv_row(fields: list[Column]) -> Column:
    """Fields as a CSV line with its end; those with commas, quotes or line ends are quoted."""
    quoted = [F.when(f.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(f, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(f, F.lit(""))) for f in fields]
    return F.concat(F.concat_ws(",", *quoted), F.lit("\n"))


def appended(logs: list[DataFrame]) -> DataFrame:
    """Logs one after the other, rows as they are."""
    return reduce(lambda a, b: a.unionByName(b), logs)


def delivered(rows: DataFrame, sinks: dict[str, Column]) -> DataFrame:
    """Each row once for every sink whose condition it meets, in one pass."""
    names = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in sinks.items()]))
    return rows.withColumn("sink", F.explode(names))


def power_log(samples: DataFrame, folder: str) -> None:
    """Power samples as CSV in the fixed order of columns."""
    samples.select("unix_seconds", "monotonic_seconds", "aggregate_pmic_w", "vdd_core_w", "sample_duration_seconds", F.to_json("rail_watts").alias("rail_watts")).write.mode("overwrite").csv(folder, header=True, lineSep="\n")


def bundle(lines_: DataFrame, before: DataFrame, timings: DataFrame, trace: DataFrame, folder: str, key: str = "conv_id") -> None:
    """All outputs of a run side by side: raw and anonymised transcripts, timings and the trace, each whole or absent."""
    transcripts(before, f"{folder}/raw_transcript", key)
    transcripts(lines_.where("text IS NOT NULL"), f"{folder}/anonymised_transcript", key)
    jsonl(timings, f"{folder}/anonymised_word_timestamps", key)
    jsonl(trace, f"{folder}/trace", "start_seconds")
