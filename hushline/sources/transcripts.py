"""Readers of transcripts, corpora, labels and diarisations: files in, rows out.

Every reader keeps the place of a record in its file: Spark numbers the rows of a split in order,
and splits of a file in order, so `at` sorts records as they stand, without counting lines first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# How transcript lines are written.
NUMBERED = r"(?s)^\s*(\d+)\s*:\s*(.*)$"
SPEAKER = r"(?s)^\s*([A-Za-z_][\w .-]*?)\s*:\s*(.*)$"
DEFAULT_SPEAKER = "speaker_a"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
CATEGORIES = ("identity", "demographic", "location", "economic", "lifestyle", "relational", "health", "legal", "appearance")


def bare(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def turns_of_text(text: Column) -> Column:
    """array<struct<speaker, text>> of numbered, labelled or plain lines; blank lines are left out, null texts have none."""
    lines = F.filter(F.transform(F.split(text, LINE_ENDS), bare), lambda x: x != "")
    plain = F.transform(lines, lambda x: F.when(x.rlike(NUMBERED), bare(F.regexp_extract(x, NUMBERED, 2))).otherwise(x))

    def turn(x: Column) -> Column:
        labelled = x.rlike(SPEAKER)
        return F.struct(F.when(labelled, bare(F.regexp_extract(x, SPEAKER, 1))).otherwise(DEFAULT_SPEAKER).alias("speaker"), F.when(labelled, bare(F.regexp_extract(x, SPEAKER, 2))).otherwise(x).alias("text"))

    return F.coalesce(F.transform(plain, turn), F.array().cast("array<struct<speaker:string,text:string>>"))


def turns_of_json(record: Column) -> Column:
    """The same of a JSON record: {text}, {turns: [...]} or [...], of {speaker, text} or [speaker, text]. No JSON: none."""
    v = F.try_parse_json(record)
    items = F.coalesce(F.try_variant_get(v, "$.turns", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    absent = F.array().cast("array<struct<speaker:string,text:string>>")

    def turn(x: Column) -> Column:
        speaker = F.coalesce(F.try_variant_get(x, "$.speaker", "string"), F.try_variant_get(x, "$[0]", "string"), F.lit(DEFAULT_SPEAKER))
        return F.struct(speaker.alias("speaker"), F.coalesce(F.try_variant_get(x, "$.text", "string"), F.try_variant_get(x, "$[1]", "string"), F.lit("")).alias("text"))

    return F.when(F.try_variant_get(v, "$.text", "string").isNotNull(), turns_of_text(F.try_variant_get(v, "$.text", "string"))).otherwise(F.coalesce(F.transform(items, turn), absent))


def exploded(records: DataFrame, *key: str) -> DataFrame:
    """(key, turns) -> key, n from 1, speaker, text."""
    return records.select(*key, F.posexplode("turns").alias("k", "t")).select(*key, (F.col("k") + 1).alias("n"), "t.speaker", "t.text")


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, at, line of text files; lines in order of `at` within a file."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def load_records(spark: SparkSession, source: str) -> DataFrame:
    """file, at, n, speaker, text: a .jsonl source is read line by line, a .json one whole, another as text.

    A source of several lines, or that no file matches, is itself the text of one transcript.
    """
    if source.endswith(".jsonl"):
        return exploded(lines(spark, source).where(F.trim("line") != "").select("file", "at", turns_of_json(F.col("line")).alias("turns")), "file", "at")
    if "\n" in source or not matches(spark, source):
        return exploded(spark.createDataFrame([(None, 0, source)], "file string, at long, body string").select("file", "at", turns_of_text(F.col("body")).alias("turns")), "file", "at")
    whole = spark.read.text(source, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))
    if not source.endswith(".json"):
        return exploded(whole.select("file", F.lit(0).cast("long").alias("at"), turns_of_text(F.col("body")).alias("turns")), "file", "at")
    v = F.try_parse_json("body")
    records = F.coalesce(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.to_json(x)), F.array("body"))
    return exploded(whole.select("file", F.posexplode(records).alias("at", "r")).select("file", F.col("at").cast("long").alias("at"), turns_of_json(F.col("r")).alias("turns")), "file", "at")


def matches(spark: SparkSession, pattern: str) -> bool:
    """Whether any file matches, on whatever file system the path names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def strict_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """file, at, line of JSON objects. Blank lines are left out; the first line that is no object raises ValueError with file:line."""
    all_ = lines(spark, path)
    kept = all_.where(bare(F.col("line")) != "")
    bad = kept.where(~F.coalesce(F.schema_of_variant(F.try_parse_json("line")).startswith("OBJECT"), F.lit(False)))
    first = bad.orderBy("file", "at").limit(1).collect()
    if first:
        n = all_.where((F.col("file") == first[0]["file"]) & (F.col("at") <= first[0]["at"])).count()
        raise ValueError(f"{first[0]['file']}:{n}: not a JSON object")
    return kept


def lenient_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a stated schema; lines that are blank or no JSON are left out."""
    got = spark.read.schema(f"{schema}, _bad string").json(path, columnNameOfCorruptRecord="_bad")
    return got.where("_bad IS NULL").drop("_bad")


def aliased(rows: DataFrame, key: str, at: str, speaker: str = "speaker") -> DataFrame:
    """rows with n (from 1, by `at`) and alias: speaker_a, speaker_b ... by first appearance within key."""
    own = Window.partitionBy(key)
    numbered = rows.withColumn("n", F.row_number().over(own.orderBy(at))).withColumn("_first", F.min("n").over(Window.partitionBy(key, speaker)))
    rank = F.dense_rank().over(own.orderBy("_first"))
    return numbered.withColumn("alias", F.concat(F.lit("speaker_"), F.chr((rank + 96).cast("long")))).drop("_first")


def corpus(spark: SparkSession, pattern: str, manifest: DataFrame | None = None) -> DataFrame:
    """conversation_id, n, alias, utterance of CSV files `<conversation>/<folder>/<file>.csv`, of those in the manifest if one is given."""
    read = spark.read.csv(pattern, header=True, multiLine=True, escape='"', schema="speaker string, utterance string", enforceSchema=False)
    rows = read.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3).alias("conversation_id"), F.monotonically_increasing_id().alias("at"), "speaker", F.coalesce("utterance", F.lit("")).alias("utterance"))
    if manifest is not None:
        rows = rows.join(manifest.select("conversation_id").distinct(), "conversation_id", "left_semi")
    return aliased(rows, "conversation_id", "at").select("conversation_id", "n", "alias", "utterance")


def skipped(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Conversations of the manifest that gave no row."""
    return manifest.select("conversation_id").distinct().join(rows, "conversation_id", "left_anti")


def diarisation(spark: SparkSession, path: str) -> DataFrame:
    """file, speaker, spans (in file order). An empty speaker, or an end not after its start, raises when read."""
    shape = "array<struct<start:double,end:double,speaker:string>>"
    read = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.from_json("value", shape)).alias("at", "s"))
    fine = (F.coalesce(F.col("s.speaker"), F.lit("")) != "") & F.coalesce(F.col("s.end") > F.col("s.start"), F.lit(False))
    checked = read.withColumn("s", F.when(fine, F.col("s")).otherwise(F.raise_error(F.concat(F.lit("bad segment "), F.col("at"), F.lit(" of "), F.col("file"))).cast("struct<start:double,end:double,speaker:string>")))
    spans = F.transform(F.array_sort(F.collect_list(F.struct("at", "s.start", "s.end"))), lambda x: F.struct(x["start"], x["end"]))
    return checked.groupBy("file", F.col("s.speaker").alias("speaker")).agg(spans.alias("spans"))


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """Label files, at any depth: file, sha256 of the bytes, speaker, category, n, value, reasoning, certainty, lines, fine.

    fine: a known category and all four fields. A file that is no JSON has one row, not fine.
    """
    item = "array<struct<reasoning:string,value:string,lines:array<int>,certainty:int>>"
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(folder)
    files = read.select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"), F.from_json(F.decode("content", "utf-8"), "struct<speakers:array<map<string,string>>>").alias("j"))
    speakers = files.select("file", "sha256", F.explode_outer("j.speakers").alias("s"))
    entries = speakers.select("file", "sha256", F.col("s")["speaker"].alias("speaker"), F.explode_outer(F.map_filter("s", lambda k, v: k != "speaker")).alias("category", "items"))
    rows = entries.select("file", "sha256", "speaker", "category", F.posexplode_outer(F.from_json("items", item)).alias("n", "i"))
    fine = F.col("category").isin(*CATEGORIES) & F.col("i.value").isNotNull() & F.col("i.reasoning").isNotNull() & F.col("i.certainty").isNotNull() & F.col("i.lines").isNotNull()
    return rows.select("file", "sha256", "speaker", "category", "n", "i.value", "i.reasoning", "i.certainty", "i.lines", F.coalesce(fine, F.lit(False)).alias("fine"))
