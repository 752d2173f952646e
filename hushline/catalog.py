"""All queries of the conversation engine, with their SQL."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushline.functions import alignment, envelope
from hushline.operators.causal import Models, causal_loop
from hushline.operators.matching import matched
from hushline.operators.windows import BUDGET, causal_windows, token_count
from hushline.plans import adapters, views
from hushline.plans.adapters import TURNS
from hushline.session import shared_path, ship
from hushline.sources import transcripts
from hushline.streaming.windows import windows

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
FLAGSHIP = "windows_by_budget"

_FOLD = f"""
WITH RECURSIVE l AS (SELECT conv_id, n AS line_no, length(text) - length(replace(text, ' ', '')) + 1 AS tokens FROM {TURNS}),
w AS (SELECT conv_id, line_no, tokens AS used, 0 AS window_id FROM l WHERE line_no = 1 UNION ALL
SELECT l.conv_id, l.line_no, CASE WHEN w.used > 0 AND w.used + l.tokens > {BUDGET} THEN l.tokens ELSE w.used + l.tokens END, w.window_id + CASE WHEN w.used > 0 AND w.used + l.tokens > {BUDGET} THEN 1 ELSE 0 END FROM w JOIN l ON l.conv_id = w.conv_id AND l.line_no = w.line_no + 1)
"""
_WINDOWS = _FOLD + "SELECT conv_id, window_id, count(*) AS lines, min(line_no) AS first_line FROM w GROUP BY conv_id, window_id"
_STREAMED = _FOLD + "SELECT conv_id, window_id, count(*) AS lines, min(line_no) AS first_line, max(used) AS tokens FROM w WHERE window_id < (SELECT max(window_id) FROM w x WHERE x.conv_id = w.conv_id) GROUP BY conv_id, window_id"


def _tables(spark: SparkSession, sf_dir: str) -> adapters.Tables:
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, line_no, speaker, text, tokens."""
    own = adapters.turns(_tables(spark, sf_dir)).withColumnRenamed("n", "line_no")
    return own.withColumn("tokens", token_count(F.col("text")))


def windows_by_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _lines(spark, sf_dir).select("conv_id", "line_no", "tokens")
    return causal_windows(own).groupBy("conv_id", "window_id").agg(F.count("*").alias("lines"), F.min("line_no").alias("first_line"))


def sealed_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seals each turn under its own associated data, opens it again, and checks that changed data or bytes don't open.

    The key is derived from the turn here as a fixture; real keys come from a secure random source.
    """
    turns_ = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    key, plain, aad = F.unhex(F.sha2(F.concat_ws(":", "conv_id", "turn"), 256)), F.encode("text", "utf-8"), F.concat_ws(":", "conv_id", "turn", "role")
    one = turns_.select("conv_id", "turn", key.alias("key"), plain.alias("plain"), aad.alias("aad")).withColumn("sealed", envelope.seal(F.col("plain"), F.col("key"), F.col("aad")))
    last = F.col("sealed").substr(F.length("sealed"), F.lit(1))
    flipped = F.concat(F.col("sealed").substr(F.lit(1), F.length("sealed") - 1), F.when(last == F.lit(b"\x00"), F.lit(b"\x01")).otherwise(F.lit(b"\x00")))
    tries = {"opens": envelope.opened(F.col("sealed"), F.col("key"), F.col("aad")).eqNullSafe(F.col("plain")), "wrong_aad_fails": envelope.opened(F.col("sealed"), F.col("key"), F.concat("aad", F.lit("x"))).isNull(), "flipped_fails": envelope.opened(flipped, F.col("key"), F.col("aad")).isNull()}
    return one.select("conv_id", "turn", F.length("plain").cast("long").alias("plaintext_bytes"), F.length("sealed").cast("long").alias("sealed_bytes"), F.sha2("plain", 256).alias("plaintext_sha256"), *[c.alias(n) for n, c in tries.items()])


def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows by budget over conversations as a stream that has not ended: the last window of each stays open."""
    source = ship(spark).read.parquet(f"{sf_dir}/conversations.parquet")
    lines = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/conversations.parque[t]")  # a pattern may name a folder or one file
    own = adapters.turns(lambda _: lines).select("conv_id", F.col("n").alias("line_no"), token_count(F.col("text")).alias("tokens"), F.lit(False).alias("last"))
    path = shared_path(spark, "windows")
    query = windows(own).writeStream.format("parquet").option("checkpointLocation", shared_path(spark, "windows-state")).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.parquet(path).select("conv_id", "window_id", F.size("lines").cast("long").alias("lines"), F.element_at("lines", 1).alias("first_line"), F.col("tokens").cast("long").alias("tokens"))


def transcript_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as JSON lines, {turns} of objects or bare pairs by id, and loaded again."""
    turns_ = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    objects = F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("speaker"), x["text"].alias("text"))).alias("turns")))
    pairs = F.to_json(F.transform("t", lambda x: F.array(x["role"], x["text"])))
    path = shared_path(spark, "records")
    turns_.select(F.when(F.col("conv_id") % 2 == 0, objects).otherwise(pairs).alias("value")).write.text(path + ".jsonl")
    return transcripts.load_records(spark, path + ".jsonl").groupBy("n", "speaker", "text").agg(F.count("*").alias("records"))


def stand_ins() -> Models:
    """Models for fixtures, fixed by line numbers so that SQL can tell what comes out.

    infer: a fact on the window, one that every window repeats, and one of no known attribute.
    rewrite: digits are masked; by n mod 8 a line is deleted (4), grown fourfold (3), given another
    speaker (5) or none (7), or its edit comes with one of a line outside the window (6).
    """

    def infer(window: str, profile: str) -> str:
        facts = [("identity", "begins at line " + window.split(":")[0]), ("health", "as before"), ("mood", "calm")]
        return "Findings: " + json.dumps([{"speaker": "speaker_a", "attribute": a, "guess": g} for a, g in facts])

    def rewrite(window: str, profile: str, examples: str) -> str:
        out = []
        for line in window.split("\n"):
            n, speaker, text = line.split(": ", 2)
            kind, masked = int(n) % 8, re.sub("[0-9]", "#", text)
            if kind == 6:
                out.append(f"edit {int(n) + 1000} {speaker}: elsewhere")
            out.append({3: f"edit {n} {speaker}: {text * 4}", 4: f"edit {n}", 5: f"edit {n} speaker_z: {masked}", 7: f"edit {n} {masked}"}.get(kind, f"edit {n} {speaker}: {masked}"))
        return "\n".join(out)

    def embed(texts: list[str]) -> np.ndarray:
        v = np.array([np.bincount(np.frombuffer(t.lower().encode(), np.uint8), minlength=256)[97:123] for t in texts], float) + 1e-9
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    return Models(infer, rewrite, embed)


def causal_rewriting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The causal loop over every conversation with stand-in models: lines as rewritten (null: deleted), and how many new facts and errors their window gave."""
    done = causal_loop(_lines(ship(spark), sf_dir), stand_ins)
    return done.select("conv_id", "window_id", F.size("facts").cast("long").alias("facts"), F.size("errors").cast("long").alias("errors"), F.explode("lines").alias("l")).select("conv_id", "window_id", "facts", "errors", "l.line_no", "l.after")


def retimed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a word each third of a second, re-timed after their digits are masked and every seventh word is dropped."""
    parts = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    timed = F.transform(parts, lambda w, k: F.struct(w.alias("word"), (k / 3).alias("start"), ((k + 1) / 3).alias("stop")))
    said = F.array_join(F.filter(parts, lambda w, k: k % 7 != 6), " ")
    turns_ = ship(spark).read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 100 + F.col("turn")).alias("turn_id"), timed.alias("words"), F.regexp_replace(said, "[0-9]", "#").alias("text"), F.lit(0.0).alias("start"), (F.size(parts) / 3).alias("stop"))
    return alignment.retimed_lines(turns_, "turn_id").select("turn_id", F.posexplode("words").alias("place", "w")).select("turn_id", "place", "w.*")


def channel_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: three channels against three speakers, with mean event values as similarities; pairs without events are unknown."""
    e = ship(spark).read.parquet(f"{sf_dir}/events.parquet").select("user_id", (F.col("event_id") % 3).alias("channel"), F.concat(F.lit("speaker_"), F.substring("event_type", 1, 1)).alias("speaker"), (F.col("value") / 100).alias("x"))
    return matched(e.groupBy("user_id", "channel", "speaker").agg(F.round(F.avg("x"), 6).alias("similarity")), "user_id", 0.1)


def retimed_unique_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where every word is one of its kind, every seventh is dropped and every fifth replaced: SQL can tell which keep their times."""
    parts = F.transform(F.filter(F.split("text", r"\s+"), lambda w: w != ""), lambda w, k: F.concat(w, F.lit("x"), k.cast("string")))
    timed = F.transform(parts, lambda w, k: F.struct(w.alias("word"), (k / 2).alias("start"), ((k + 1) / 2).alias("stop")))
    said = F.filter(F.transform(parts, lambda w, k: F.when(k % 7 == 6, "").when(k % 5 == 4, F.concat(F.lit("zzzzzz"), k.cast("string"))).otherwise(w)), lambda w: w != "")
    lines = adapters.turns(_tables(ship(spark), sf_dir)).select((F.col("conv_id") * 100 + F.col("n")).alias("turn_id"), timed.alias("words"), F.array_join(said, " ").alias("text"), F.lit(0.0).alias("start"), (F.size(parts) / 2).alias("stop"))
    return alignment.retimed_lines(lines, "turn_id").select("turn_id", F.posexplode("words").alias("place", "w")).select("turn_id", "place", "w.*")


def channel_matching_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: two channels against two speakers, few enough for SQL."""
    e = ship(spark).read.parquet(f"{sf_dir}/events.parquet").select("user_id", (F.col("event_id") % 2).alias("channel"), F.when(F.col("event_type") == "click", "speaker_c").otherwise("speaker_o").alias("speaker"), (F.col("value") / 100).alias("x"))
    return matched(e.groupBy("user_id", "channel", "speaker").agg(F.round(F.avg("x") + 1e-9, 6).alias("similarity")), "user_id", 0.1)


_CAUSAL = (
    _FOLD
    + f"""SELECT w.conv_id, w.window_id, CASE w.window_id WHEN 0 THEN 2 ELSE 1 END::BIGINT AS facts, 1 + sum(errors) OVER (PARTITION BY w.conv_id, w.window_id)::BIGINT AS errors, w.line_no, after FROM w JOIN
(SELECT conv_id, n, CASE WHEN n % 8 = 4 OR n % 8 = 7 AND trim(text) = '' THEN NULL ELSE speaker || ': ' || CASE WHEN n % 8 <> 3 THEN trim(masked) WHEN grown THEN text ELSE trim(text || text || text || text) END END AS after,
CASE n % 8 WHEN 5 THEN 1 WHEN 6 THEN 1 WHEN 7 THEN (trim(text) <> '')::INT WHEN 3 THEN (grown AND trim(text || text || text || text) <> text)::INT ELSE 0 END AS errors FROM
(SELECT *, regexp_replace(text, '[0-9]', '#', 'g') AS masked, length(speaker || ': ' || trim(text || text || text || text)) > 2.5 * length(speaker || ': ' || text) AS grown FROM {TURNS})) t ON t.conv_id = w.conv_id AND t.n = w.line_no"""
)
_UNIQUE = f"""WITH s AS (SELECT conv_id * 100 + n AS turn_id, unnest(range(0, len(p))) AS k, unnest(p) AS word FROM (SELECT conv_id, n, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS p FROM {TURNS})),
f AS (SELECT *, k % 7 < 6 AND k % 5 < 4 AS kept, k % 7 < 6 AS said, CASE WHEN k % 5 = 4 THEN 'zzzzzz' || k ELSE word || 'x' || k END AS new FROM s),
g AS (SELECT *, count(*) FILTER (kept) OVER (PARTITION BY turn_id ORDER BY k) AS run FROM f),
r AS (SELECT *, min(k) FILTER (NOT kept) OVER (PARTITION BY turn_id, run) AS low, max(k) FILTER (NOT kept) OVER (PARTITION BY turn_id, run) AS high, CASE WHEN said THEN greatest(1, length(regexp_replace(lower(new), '[^a-z0-9]', '', 'g'))) ELSE 0 END AS weight FROM g),
t AS (SELECT *, sum(weight) FILTER (NOT kept) OVER (PARTITION BY turn_id, run ORDER BY k) AS upto, sum(weight) FILTER (NOT kept) OVER (PARTITION BY turn_id, run) AS total FROM r)
SELECT turn_id, row_number() OVER (PARTITION BY turn_id ORDER BY k) - 1 AS place, new AS word, CASE WHEN kept THEN k / 2 ELSE round(low / 2 + (high + 1 - low) / 2 * (upto - weight) / total, 3) END::DOUBLE AS start, CASE WHEN kept THEN (k + 1) / 2 ELSE round(low / 2 + (high + 1 - low) / 2 * upto / total, 3) END::DOUBLE AS stop, kept FROM t WHERE said"""
_TWO = """WITH m AS (SELECT user_id, event_id % 2 AS channel, CASE event_type WHEN 'click' THEN 'speaker_c' ELSE 'speaker_o' END AS speaker, round(avg(value / 100) + 1e-9, 6) AS s FROM events GROUP BY ALL),
o AS (SELECT *, greatest(0, coalesce(s - (SELECT x.s FROM m x WHERE x.user_id = m.user_id AND x.channel = m.channel AND x.speaker <> m.speaker AND (x.s < m.s OR x.s = m.s AND x.speaker > m.speaker)), 0)) AS lead FROM m),
b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY s + lead / 2 DESC, s DESC, lead DESC, channel DESC, speaker DESC) = 1),
u AS (SELECT b.*, b.s >= 0.1 AS taken FROM b),
c AS (SELECT DISTINCT user_id, channel FROM m), p AS (SELECT DISTINCT user_id, speaker FROM m),
rest AS (SELECT c.user_id, c.channel, row_number() OVER (PARTITION BY c.user_id ORDER BY c.channel) AS k, count(*) OVER (PARTITION BY c.user_id) AS n, u.taken FROM c JOIN u ON u.user_id = c.user_id WHERE NOT u.taken OR c.channel <> u.channel),
free AS (SELECT p.user_id, p.speaker, row_number() OVER (PARTITION BY p.user_id ORDER BY p.speaker) AS k FROM p JOIN u ON u.user_id = p.user_id WHERE NOT u.taken OR p.speaker <> u.speaker),
z AS (SELECT rest.*, free.speaker, m.s FROM rest JOIN free ON free.user_id = rest.user_id AND free.k = rest.k LEFT JOIN m ON m.user_id = rest.user_id AND m.channel = rest.channel AND m.speaker = free.speaker)
SELECT user_id, channel, speaker, 'fingerprint' AS method, s AS similarity, round(lead, 6) AS margin FROM u WHERE taken
UNION ALL SELECT user_id, channel, speaker, CASE WHEN taken AND s >= 0.1 THEN 'fingerprint' WHEN taken AND n = 1 THEN 'elimination' ELSE 'ambiguous' END, CASE WHEN taken AND s >= 0.1 THEN s END, CASE WHEN taken AND s >= 0.1 THEN 0.0 END FROM z"""
_FILES = "SELECT n, role AS speaker, text, count(*) AS records FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY n, role, text"
_SEALED = "SELECT conv_id, turn, CAST(strlen(text) AS BIGINT) AS plaintext_bytes, CAST(strlen(text) + 28 AS BIGINT) AS sealed_bytes, sha256(text) AS plaintext_sha256, true AS opens, true AS wrong_aad_fails, true AS flipped_fails FROM conversations"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (windows_by_budget, sealed_tracks, streamed_windows, causal_rewriting, retimed_turns, retimed_unique_words, channel_matching, channel_matching_of_two, transcript_files)
    return {q.__name__: q for q in own} | {name: lambda spark, sf_dir, q=q: q(_tables(ship(spark), sf_dir)) for name, q in views.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {FLAGSHIP: _WINDOWS, "sealed_tracks": _SEALED, "streamed_windows": _STREAMED, "causal_rewriting": _CAUSAL, "retimed_unique_words": _UNIQUE, "channel_matching_of_two": _TWO, "transcript_files": _FILES} | views.SQL
