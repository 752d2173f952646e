"""The test tables seen as the engine's own: turns, frames, audio chunks, logs and answers; and the same views in DuckDB's SQL.

`events` stands in for what a recording gives: a user is a recording, the event's number modulo
three its slot. Every adapter takes whole tables and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hushline.operators import lines

Tables = Callable[[str], DataFrame]


def turns(t: Tables) -> DataFrame:
    """conv_id, n from 1, speaker (speaker_a, speaker_s or speaker_u), text in one line."""
    return t("conversations").select("conv_id", (F.col("turn") + 1).cast("int").alias("n"), F.concat(F.lit("speaker_"), F.substring("role", 1, 1)).alias("speaker"), lines.one_line(F.col("text")).alias("text"))


def numbered(t: Tables) -> DataFrame:
    return turns(t).select("conv_id", "n", lines.rendered(F.col("n"), F.col("speaker"), F.col("text")).alias("line"))


def answers(t: Tables) -> DataFrame:
    """conv_id, answer: a model's edits of a conversation, a sentence first, then a line for each turn; see EDITS."""
    k = F.col("n") - 1
    form = F.when(k == 5, "").when(k == 6, "speaker_a:").otherwise(F.concat(F.when(k % 3 == 0, F.lit(": speaker_u: ")).when(k % 3 == 1, F.lit("speaker_x: ")).otherwise(F.lit("")), "text"))
    row = F.concat(F.when(k % 2 == 0, "Edit ").otherwise("edit "), F.when(k == 7, 91).otherwise(k % 4 + 1).cast("string"), F.lit(" "), form)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", row.alias("row")))), lambda x: x["row"])
    return turns(t).groupBy("conv_id").agg(F.concat(F.lit("These are my edits of 12 lines:\n"), F.array_join(listed, "\n")).alias("answer"))


def frames(t: Tables) -> DataFrame:
    """user_id, slot, frame, p."""
    slot = (F.col("event_id") % 3).cast("int")
    return t("events").select("user_id", slot.alias("slot"), (F.row_number().over(Window.partitionBy("user_id", slot).orderBy("event_id")) - 1).cast("long").alias("frame"), (F.col("value") / 40).alias("p"))


def lengths(t: Tables, each: int = 1) -> DataFrame:
    """user_id, samples: `each` for every frame of the longest slot."""
    return frames(t).groupBy("user_id").agg(((F.max("frame") + 1) * each).alias("samples"))


def skips(t: Tables) -> DataFrame:
    return t("events").where("event_type = 'error'").select("user_id", F.col("event_id").cast("double").alias("at"), F.col("value").alias("skipped"))


def moments(t: Tables) -> DataFrame:
    return t("events").where("event_type <> 'error'").select("user_id", F.col("event_id").cast("double").alias("at"), F.col("event_type").alias("stage"))


def power(t: Tables) -> DataFrame:
    return t("events").select("user_id", F.col("event_id").cast("double").alias("at"), F.col("value").alias("watts"))


def chunks(t: Tables) -> DataFrame:
    """user_id, start, stop: a chunk for each event, which lasts up to 300 (by its value) from its number on."""
    return t("events").select("user_id", F.col("event_id").cast("double").alias("start"), (F.col("event_id") + F.floor(F.col("value")) % 300 + 1).cast("double").alias("stop"))


#: The same in DuckDB's SQL, each as a subquery.
TURNS = r"(SELECT conv_id, CAST(turn + 1 AS INT) AS n, 'speaker_' || substring(role, 1, 1) AS speaker, regexp_replace(text, '\s*[\r\n]+\s*', ' ', 'g') AS text FROM conversations)"
LINES = f"(SELECT conv_id, n, n || ': ' || speaker || ': ' || text AS line FROM {TURNS})"
EDITS = f"""(SELECT conv_id, n AS ordinal, CASE WHEN n = 8 THEN 91 ELSE (n - 1) % 4 + 1 END AS n, trim(CASE n WHEN 6 THEN '' WHEN 7 THEN 'speaker_a:' ELSE CASE (n - 1) % 3 WHEN 0 THEN ': speaker_u: ' WHEN 1 THEN 'speaker_x: ' ELSE '' END || text END) AS replacement FROM {TURNS})"""
FRAMES = "(SELECT user_id, CAST(event_id % 3 AS INT) AS slot, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) - 1 AS frame, value / 40 AS p FROM events)"
#: A frame is active if two of the three around it are; beyond an end the frame itself stands in.
ACTIVE = f"""(SELECT f.user_id, f.slot, f.frame, f.p, (CASE WHEN f.p >= 0.5 THEN 1 ELSE 0 END) + (CASE WHEN coalesce(b.p, f.p) >= 0.5 THEN 1 ELSE 0 END) + (CASE WHEN coalesce(a.p, f.p) >= 0.5 THEN 1 ELSE 0 END) > 1 AS active
FROM {FRAMES} f LEFT JOIN {FRAMES} b ON b.user_id = f.user_id AND b.slot = f.slot AND b.frame = f.frame - 1 LEFT JOIN {FRAMES} a ON a.user_id = f.user_id AND a.slot = f.slot AND a.frame = f.frame + 1)"""
SETS = f"(SELECT user_id, frame, list(slot ORDER BY slot) AS slots, count(*) AS n FROM {ACTIVE} WHERE active GROUP BY ALL)"
LENGTHS = f"(SELECT user_id, max(frame) + 1 AS frames FROM {FRAMES} GROUP BY user_id)"
SKIPS = "(SELECT user_id, CAST(event_id AS DOUBLE) AS at, value AS skipped FROM events WHERE event_type = 'error')"
CHUNKS = "(SELECT user_id, CAST(event_id AS DOUBLE) AS start, CAST(event_id + floor(value)::BIGINT % 300 + 1 AS DOUBLE) AS stop FROM events)"


def islands(source: str, by: str, at: str = "frame") -> str:
    """Runs of consecutive numbers, found by where a run begins."""
    return f"(SELECT {by}, min({at}) AS first, max({at}) AS last FROM (SELECT *, sum(begins) OVER (PARTITION BY {by} ORDER BY {at}) AS run FROM (SELECT *, CASE WHEN lag({at}) OVER (PARTITION BY {by} ORDER BY {at}) = {at} - 1 THEN 0 ELSE 1 END AS begins FROM {source})) GROUP BY {by}, run)"
