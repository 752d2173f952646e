"""A query for each operator on the test tables, beside SQL for DuckDB that is written apart from the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hushline.functions import payloads
from hushline.operators import activity, lines, lookups, measures, memory
from hushline.sources import sinks, transcripts

from .adapters import ACTIVE, CHUNKS, EDITS, FRAMES, LENGTHS, LINES, SETS, SKIPS, TURNS, Tables, answers, chunks, frames, islands, lengths, moments, numbered, power, skips, turns

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}
USER, CONV, RATE, SAMPLES = ["user_id"], ["conv_id"], 10, 80


def view(sql: str) -> Callable:
    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _active(t: Tables) -> DataFrame:
    return activity.activity(frames(t), USER)


# Activity over frames
@view(f"SELECT user_id, slot, frame, active FROM {ACTIVE}")
def median_filter(t):
    return _active(t).select("user_id", "slot", "frame", "active")


@view(f"SELECT user_id, slot, 'SPEAKER_0' || slot AS speaker, round(first / 10.0, 3)::DOUBLE AS start, round((last + 1) / 10.0, 3)::DOUBLE AS stop FROM {islands(f'(SELECT * FROM {ACTIVE} WHERE active)', 'user_id, slot')} WHERE last > first")
def segments(t):
    return activity.segments(_active(t), USER, RATE, 0.2)


@view(f"SELECT a.user_id, a.slot, a.frame AS after, min(b.frame) AS next FROM (SELECT * FROM {ACTIVE} WHERE active) a JOIN (SELECT * FROM {ACTIVE} WHERE active) b ON b.user_id = a.user_id AND b.slot = a.slot AND b.frame > a.frame GROUP BY ALL HAVING min(b.frame) > a.frame + 1")
def continuity_guard(t):
    return activity.gaps(_active(t).where("active"), USER)


@view(f"""SELECT user_id, slots, len(slots) AS speakers, (first + 3 * k) / 10.0::DOUBLE AS start, least(first + 3 * k + 3, last + 1) / 10.0::DOUBLE AS stop
FROM (SELECT *, unnest(range(0, (last - first) // 3 + 1)) AS k FROM {islands(f'(SELECT * FROM {SETS} WHERE n > 1)', 'user_id, slots')} WHERE last > first)""")
def overlap_regions(t):
    return activity.overlap_regions(_active(t), USER, RATE, 0.2, 0.3)


@view(f"SELECT user_id, slot, n / 10.0::DOUBLE AS seconds, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, slot) AS rank FROM (SELECT user_id, slot, count(*) AS n FROM {ACTIVE} WHERE active GROUP BY ALL) WHERE n >= 5) WHERE rank <= 2")
def speech_seconds(t):
    found = activity.active_slots(_active(t), USER, RATE, 0.5, 2)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("seconds"), "slot")))


@view(f"""SELECT user_id, slot, rank, start, stop FROM (SELECT *, row_number() OVER (PARTITION BY user_id, slot ORDER BY stop - start DESC, start) AS rank FROM
(SELECT user_id, slot, first * 8 AS start, (last + 1) * 8 AS stop FROM {islands(f'(SELECT *, slots[1] AS slot FROM {SETS} WHERE n = 1)', 'user_id, slot')}) WHERE stop - start >= 16) WHERE rank <= 8""")
def solo_runs(t):
    return activity.solo_clips(_active(t), USER, RATE, SAMPLES, 0.2)


@view(f"""SELECT a.user_id, a.slot, a.frame, s.n = 1 AS solo, s.n > 1 AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT user_id, event_id % 50 AS low FROM events WHERE event_type = 'error') x WHERE x.user_id = a.user_id AND a.frame BETWEEN x.low AND x.low + 2) AS uncovered
FROM (SELECT * FROM {ACTIVE} WHERE active) a JOIN {SETS} s ON s.user_id = a.user_id AND s.frame = a.frame""")
def solo_masks(t):
    separated = t("events").where("event_type = 'error'").select("user_id", (F.col("event_id") % 50).alias("first"), (F.col("event_id") % 50 + 2).alias("last"))
    return activity.masks(_active(t), USER, separated)


@view(f"SELECT user_id, frame, list(slot ORDER BY slot) AS slots FROM (SELECT * FROM {ACTIVE} WHERE active QUALIFY row_number() OVER (PARTITION BY user_id, frame ORDER BY p DESC, slot DESC) <= 2) GROUP BY ALL")
def top_slots_of_two(t):
    return activity.top_slots(_active(t), USER, 2)


@view(f"SELECT user_id, frame, slots FROM {SETS}")
def top_slots(t):
    """Three slots at most are active at a frame of three, so all of them stay: the deployed bound."""
    return activity.top_slots(_active(t), USER)


@view(f"SELECT i.user_id, slot, first * 8 AS start, least((last + 1) * 8, frames * 8 - 4) AS stop FROM {islands(f'(SELECT * FROM {ACTIVE} WHERE active)', 'user_id, slot')} i JOIN {LENGTHS} l ON l.user_id = i.user_id WHERE least((last + 1) * 8, frames * 8 - 4) > first * 8")
def interval_samples(t):
    return activity.sample_spans(_active(t), USER, RATE, SAMPLES, lengths(t, 8).withColumn("samples", F.col("samples") - 4))


@view(f"""SELECT i.user_id, count(*) AS regions, sum(greatest(0, least((last + 1) * 8, frames * 8 - 4) - first * 8))::BIGINT AS samples FROM {islands(f'(SELECT * FROM {ACTIVE} WHERE active)', 'user_id, slot')} i JOIN {LENGTHS} l ON l.user_id = i.user_id WHERE last > first GROUP BY ALL""")
def speech_samples(t):
    regions = activity.segments(_active(t), USER, RATE, 0.2).select("user_id", "start", "stop")
    return activity.speech_extract(regions, USER, SAMPLES, lengths(t, 8).withColumn("samples", F.col("samples") - 4))


_ROUTES = f"""(SELECT user_id, slots, CASE len(slots) WHEN 1 THEN 'pass' ELSE 'separate' END AS route, first + size * k AS first, least(last, first + size * (k + 1) - 1) AS last
FROM (SELECT *, unnest(range(0, (last - first) // size + 1)) AS k FROM (SELECT *, CASE len(slots) WHEN 1 THEN last - first + 1 ELSE 3 END AS size FROM {islands(SETS, 'user_id, slots')})))"""


@view(f"SELECT user_id, slots, route, first, last FROM {_ROUTES}")
def activity_routes(t):
    return activity.routes(_active(t), USER, RATE, 0.3)


@view(f"""SELECT r.user_id, slots, route, first, last, first * 8 AS core_start, least((last + 1) * 8, frames * 8) AS core_stop, greatest(0, first * 8 - 40) AS context_start, least(least((last + 1) * 8, frames * 8) + 40, frames * 8) AS context_stop
FROM {_ROUTES} r JOIN {LENGTHS} l ON l.user_id = r.user_id WHERE route = 'separate'""")
def separation_contexts(t):
    routed = activity.routes(_active(t), USER, RATE, 0.3).where("route = 'separate'").join(lengths(t, 8), USER)
    return activity.with_context(routed, RATE, SAMPLES, 0.5).drop("samples")


@view(f"SELECT user_id, 50 * k AS first, least(frames, 50 * k + 50) - 1 AS last, CASE user_id % 2 WHEN 0 THEN 'pass' ELSE 'separate' END AS route FROM (SELECT *, unnest(range(0, (frames - 1) // 50 + 1)) AS k FROM {LENGTHS})")
def forced_blocks(t):
    return activity.forced_blocks(lengths(t).withColumnRenamed("samples", "frames"), RATE, 5.0, F.col("user_id") % 2 + 1)


_TOTAL = "(SELECT user_id, CAST(max(event_id) + 200 AS DOUBLE) AS samples FROM events GROUP BY user_id)"


@view(f"""SELECT user_id, start, stop, greatest(0, start - written) AS silence, greatest(0, stop - greatest(start, written)) AS kept, CASE WHEN start = final THEN greatest(0, samples - greatest(stop, written)) ELSE 0 END AS silence_after
FROM (SELECT c.user_id, c.start, c.stop, any_value(s.samples) AS samples, coalesce(max(o.stop), 0) AS written, (SELECT max(start) FROM {CHUNKS} x WHERE x.user_id = c.user_id) AS final
FROM {CHUNKS} c JOIN {_TOTAL} s ON s.user_id = c.user_id LEFT JOIN {CHUNKS} o ON o.user_id = c.user_id AND o.start < c.start GROUP BY ALL)""")
def track_layout(t):
    return activity.track_layout(chunks(t), USER, t("events").groupBy("user_id").agg((F.max("event_id") + 200).cast("double").alias("samples")))


@view("SELECT doc_id, k AS chunk, 500 * k AS first, least(500 * k + 500, n) AS stop, 500 * k + 500 >= n AS final FROM (SELECT doc_id, length(text) AS n, unnest(range(0, (length(text) + 499) // 500)) AS k FROM documents)")
def fixed_chunks(t):
    return activity.fixed_chunks(t("documents").select("doc_id", F.length("text").cast("long").alias("n")), 500)


@view("SELECT vec_id, round(vec_id * 0.1, 6)::DOUBLE AS at, place, round(1 / (1 + exp(-x)), 9) AS p FROM (SELECT vec_id, unnest(range(0, 62)) AS place, CAST(unnest(embedding[2:63]) AS DOUBLE) AS x FROM embeddings)")
def sigmoid_emit(t):
    own = activity.emitted(t("embeddings").select("vec_id", "embedding"), "embedding", "vec_id", 0.1)
    return own.select("vec_id", F.round("at", 6).alias("at"), F.posexplode("probabilities").alias("place", "p")).withColumn("p", F.round("p", 9))


@view(f"SELECT a.user_id, a.slot, a.frame, round(a.p - avg(b.p) + 1e-7, 5) + 0.0 AS x FROM {FRAMES} a JOIN {FRAMES} b ON b.user_id = a.user_id AND b.slot = a.slot AND b.frame <= a.frame GROUP BY a.user_id, a.slot, a.frame, a.p")
def cumulative_mean(t):
    return activity.less_running_mean(frames(t), USER, "p").select("user_id", "slot", "frame", (F.round(F.col("x") + 1e-7, 5) + 0.0).alias("x"))


@view(f"""SELECT a.user_id, a.slot, a.frame, k - 2 AS shift, b.p AS p FROM (SELECT f.*, n, unnest(range(0, 5)) AS k FROM {FRAMES} f JOIN (SELECT user_id, slot, count(*) AS n FROM {FRAMES} GROUP BY ALL) c ON c.user_id = f.user_id AND c.slot = f.slot WHERE frame % 3 = 0 AND frame < n - n % 3) a
JOIN {FRAMES} b ON b.user_id = a.user_id AND b.slot = a.slot AND b.frame = greatest(0, least(a.n - 1, a.frame + k - 2))""")
def context_stacking(t):
    own = activity.stacked(frames(t), USER, "p", 2, 3)
    return own.select("user_id", "slot", "frame", F.posexplode("features").alias("k", "p")).select("user_id", "slot", "frame", (F.col("k") - 2).alias("shift"), "p")


@view(f"SELECT user_id, slot, frame // 10 AS block, round(sqrt(avg(p * p)), 6) AS rms FROM {FRAMES} GROUP BY ALL HAVING sqrt(avg(p * p)) >= 0.5")
def rms_gate(t):
    own = activity.loud_blocks(frames(t).select("user_id", "slot", F.col("frame").alias("at"), F.col("p").alias("x")), ["user_id", "slot"], 10, 0.5)
    return own.withColumn("rms", F.round("rms", 6))


@view("SELECT vec_id, embedding[9:56] AS core FROM embeddings")
def core_crop(t):
    return t("embeddings").select("vec_id", activity.core(F.col("embedding"), F.lit(100), F.lit(108), F.lit(48)).alias("core"))


@view("SELECT vec_id, 48 AS size, embedding[1:48] AS v FROM embeddings UNION ALL SELECT vec_id, 72, list_concat(embedding, [CAST(0 AS FLOAT), 0, 0, 0, 0, 0, 0, 0]) FROM embeddings")
def pad_or_cut(t):
    both = [t("embeddings").select("vec_id", F.lit(n).alias("size"), activity.fixed_length(F.col("embedding"), n).alias("v")) for n in (48, 72)]
    return both[0].unionByName(both[1])


# Transcript lines
@view(f"SELECT conv_id, string_agg(line, chr(10) ORDER BY n) AS transcript FROM {LINES} GROUP BY conv_id")
def format_transcript(t):
    return lines.transcript(turns(t), CONV)


@view(f"""SELECT conv_id, n, trim(substr(line, strpos(line, ': ') + 2 + strpos(substr(line, strpos(line, ': ') + 2), ':'))) AS text_of, n AS line_number_of, '[' || n || ']' || substr(line, strpos(line, ':') + 1) AS context, true AS in_window FROM {LINES}
UNION ALL SELECT conv_id, -n, trim(text), NULL, text, false FROM {TURNS} WHERE NOT regexp_matches(text, '^[0-9]')""")
def text_and_number(t):
    own = numbered(t).unionByName(turns(t).where("NOT text RLIKE '^[0-9]'").select("conv_id", (-F.col("n")).alias("n"), F.col("text").alias("line")))
    line = F.col("line")
    return own.select("conv_id", "n", lines.text_of(line).alias("text_of"), lines.line_number(line).alias("line_number_of"), lines.context_line(line).alias("context"), lines.is_window_line(line).alias("in_window"))


@view(f"""SELECT conv_id, n, text, CASE WHEN copies > 1 THEN 'repeated' END AS problem FROM (SELECT conv_id, n % 5 + 1 AS n, trim(text) AS text, count(*) OVER (PARTITION BY conv_id, n % 5) AS copies FROM {TURNS} WHERE n <> 4)
UNION ALL SELECT conv_id, NULL, '', 'not numbered' FROM {TURNS} WHERE n = 4""")
def numbered_output_scan(t):
    own = turns(t).select("conv_id", F.when(F.col("n") == 4, "no number").otherwise(F.concat((F.col("n") % 5 + 1).cast("string"), F.lit(": "), "speaker", F.lit(": "), F.trim("text"))).alias("line"))
    return lines.numbered_outputs(own, CONV)


@view(f"SELECT conv_id, ordinal, n, replacement FROM {EDITS}")
def edit_extraction(t):
    return lines.edits(answers(t), CONV)


@view(f"SELECT conv_id, n, arg_max(replacement, ordinal) AS replacement, min(ordinal) AS ordinal, count(*) AS proposals FROM {EDITS} GROUP BY conv_id, n")
def edit_last_wins(t):
    return lines.last_wins(lines.edits(answers(t), CONV), CONV)


@view(f"SELECT e.conv_id, e.ordinal, e.n, e.replacement FROM {EDITS} e LEFT JOIN {TURNS} t ON t.conv_id = e.conv_id AND t.n = e.n WHERE t.n IS NULL")
def edit_out_of_window(t):
    return lines.outside(lines.edits(answers(t), CONV), turns(t), CONV)


#: What an edit says of its speaker and text, by its form: with a label (after a colon or not) or without.
_SAID = f"""(SELECT e.conv_id, e.ordinal, e.n, t.speaker, t.text AS was, CASE WHEN regexp_matches(e.replacement, '^(: *)?speaker_[a-z]:') THEN regexp_extract(e.replacement, 'speaker_[a-z]') END AS said,
trim(regexp_replace(trim(regexp_replace(e.replacement, '^:', '')), '^speaker_[a-z]:', '')) AS body, e.replacement = '' AS gone FROM {EDITS} e JOIN {TURNS} t ON t.conv_id = e.conv_id AND t.n = e.n)"""


@view(f"""SELECT conv_id, ordinal, n, CASE WHEN gone THEN '' ELSE speaker || ': ' || body END AS replacement,
CASE WHEN gone THEN NULL WHEN said IS NULL THEN 'repaired missing speaker label ''' || speaker || '''' WHEN said <> speaker THEN 'repaired speaker ''' || said || ''' to ''' || speaker || '''' END AS note FROM {_SAID}""")
def edit_normalise(t):
    return lines.normalised(lines.edits(answers(t), CONV), turns(t), CONV).select("conv_id", "ordinal", "n", "replacement", "note")


_APPLIED = f"""(SELECT t.conv_id, t.n, t.speaker, t.text AS was, s.body, CASE WHEN s.gone IS NULL THEN NULL WHEN s.gone THEN 'deleted' WHEN s.body = t.text THEN 'unchanged' WHEN length(t.speaker || ': ' || s.body) > 2.5 * length(trim(t.speaker || ': ' || t.text)) THEN 'too long' ELSE 'edited' END AS outcome
FROM {TURNS} t LEFT JOIN (SELECT * FROM {_SAID} QUALIFY row_number() OVER (PARTITION BY conv_id, n ORDER BY ordinal DESC) = 1) s ON s.conv_id = t.conv_id AND s.n = t.n)"""


def _applied(t: Tables) -> DataFrame:
    return lines.applied(turns(t), lines.last_wins(lines.edits(answers(t), CONV), CONV), CONV)


@view(f"SELECT conv_id, n, speaker, outcome, CASE outcome WHEN 'deleted' THEN NULL WHEN 'edited' THEN body ELSE was END AS text FROM {_APPLIED}")
def edit_apply(t):
    return _applied(t)


@view(f"SELECT conv_id, n, CASE outcome WHEN 'edited' THEN body ELSE was END AS text, n * 2.5::DOUBLE AS start FROM {_APPLIED} WHERE outcome IS DISTINCT FROM 'deleted' AND trim(CASE outcome WHEN 'edited' THEN body ELSE was END) <> ''")
def anonymised_timing(t):
    return lines.timed(_applied(t).select("conv_id", "n", "text"), turns(t).select("conv_id", "n", (F.col("n") * 2.5).alias("start")), CONV)


@view(f"""SELECT a.conv_id, a.n, string_agg(CASE WHEN b.n < a.n THEN '[' || b.n || '] ' || b.speaker || ': ' || b.was WHEN b.n = a.n THEN 'Original: ' || a.n || ': ' || a.speaker || ': ' || a.was || chr(10) || 'Changed: ' || a.n || ': ' || a.speaker || ': ' || a.body ELSE '[' || b.n || '] ' || b.speaker || ': ' || b.was END, chr(10) ORDER BY b.n) AS entry
FROM (SELECT * FROM {_APPLIED} WHERE outcome = 'edited') a JOIN {_APPLIED} b ON b.conv_id = a.conv_id AND b.n BETWEEN a.n - 2 AND a.n + 2 GROUP BY a.conv_id, a.n""")
def edit_rendering(t):
    own, before = _applied(t).where("outcome = 'edited'"), numbered(t)
    done = own.select("conv_id", "n", lines.rendered(F.col("n"), F.col("speaker"), F.col("text")).alias("after")).join(before.withColumnRenamed("line", "before"), ["conv_id", "n"])
    return lines.rendered_edits(done, before.withColumnRenamed("line", "text"), CONV)


@view(f"SELECT a.conv_id, a.n, b.n AS other, b.text FROM {TURNS} a JOIN {TURNS} b ON b.conv_id = a.conv_id AND abs(a.n - b.n) IN (1, 2)")
def neighbour_lines(t):
    return lines.neighbours(turns(t), turns(t), CONV)


_WORD_ROWS = f"(SELECT conv_id, n, unnest(range(0, len(parts))) AS place, unnest(parts) AS word, len(parts) AS words FROM (SELECT conv_id, n, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS parts FROM {TURNS}))"
_WEIGHED = f"(SELECT *, greatest(1, length(regexp_replace(lower(word), '[^a-z0-9]', '', 'g'))) AS weight FROM {_WORD_ROWS})"


@view(f"""SELECT conv_id, n, place, word, round(n * 3 + 2.5 * (upto - weight) / total + 1e-8, 2) AS start, CASE WHEN place + 1 = words THEN n * 3 + 2.5 ELSE round(n * 3 + 2.5 * upto / total + 1e-8, 2) END AS stop
FROM (SELECT *, CAST(sum(weight) OVER (PARTITION BY conv_id, n ORDER BY place) AS DOUBLE) AS upto, CAST(sum(weight) OVER (PARTITION BY conv_id, n) AS DOUBLE) AS total FROM {_WEIGHED})""")
def proportional_timing(t):
    own = lines.proportional_timing(turns(t).select("conv_id", "n", "text", (F.col("n") * 3.0).alias("start"), (F.col("n") * 3 + 2.5).alias("stop")), CONV, None)
    return own.select("conv_id", "n", "place", "word", F.round(F.col("start") + 1e-8, 2).alias("start"), F.round(F.col("stop") + 1e-8, 2).alias("stop"))


@view(f"SELECT conv_id, n, place, word, round_even(n * 3 + 2.5::DOUBLE * place / words, 3) AS start, round_even(n * 3 + 2.5::DOUBLE * (place + 1) / words, 3) AS stop FROM {_WORD_ROWS}")
def uniform_timing(t):
    return lines.uniform_timing(turns(t).select("conv_id", "n", "text", (F.col("n") * 3.0).alias("start"), (F.col("n") * 3 + 2.5).alias("stop")), CONV)


_TOKENS = "(SELECT user_id, event_id, event_id / 10.0 AS ts, CASE event_type WHEN 'click' THEN ' cl' WHEN 'view' THEN 'ew' WHEN 'purchase' THEN '<b>' WHEN 'error' THEN ' .' ELSE '' || substring(event_type, 1, 2) END AS piece FROM events)"


@view(f"""WITH k AS (SELECT *, trim(piece) AS clean, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM {_TOKENS} WHERE piece <> '<b>'),
w AS (SELECT *, (sum(CASE WHEN i = 1 OR piece = ' cl' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS word_no, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM k),
g AS (SELECT user_id, word_no, string_agg(clean, '' ORDER BY event_id) AS word, min(ts) AS a, max(ts) AS z FROM w GROUP BY ALL)
SELECT g.user_id, word_no, word, round(greatest(5, a), 3)::DOUBLE AS start, round(greatest(greatest(5, a), least(900, coalesce(lead(a) OVER (PARTITION BY g.user_id ORDER BY word_no), z + least(1.12, greatest(0.02, coalesce(s.gap, 0.32)))))), 3)::DOUBLE AS stop FROM g JOIN (SELECT user_id, min(gap) AS gap FROM w GROUP BY user_id) s ON s.user_id = g.user_id""")
def subword_words(t):
    kind = F.col("event_type")
    piece = F.when(kind == "click", " cl").when(kind == "view", "ew").when(kind == "purchase", "<b>").when(kind == "error", " .").otherwise(F.substring(kind, 1, 2))
    tokens = t("events").select("user_id", F.col("event_id").alias("place"), (F.col("event_id") / 10).alias("at"), piece.alias("piece"), F.lit(5.0).alias("line_start"), F.lit(900.0).alias("line_end"))
    return lines.subword_timing(tokens, USER)


@view(f"SELECT conv_id, n, speaker, trim(text) AS text, round(n * 1.2345 + 0.00001, 3)::DOUBLE AS start FROM {TURNS} WHERE trim(text) <> ''")
def line_commit(t):
    return lines.committed(turns(t).withColumn("speaker", F.upper("speaker")).withColumn("start", F.col("n") * 1.2345 + 0.00001), CONV)


@view("SELECT user_id, event_id, event_type FROM (SELECT e.*, (SELECT max(event_id) FROM events x WHERE x.user_id = e.user_id AND x.event_id < e.event_id) AS prior FROM events e) e LEFT JOIN (SELECT event_id AS i, event_type AS was FROM events) p ON p.i = e.prior WHERE was IS NULL OR was <> event_type")
def change_only(t):
    return lines.changes(t("events"), USER, "event_id", "event_type").select("user_id", "event_id", "event_type")


# Memory
_SCORED = """(SELECT q.vec_id AS query, e.vec_id AS item, round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: CAST(z[1] AS DOUBLE) * z[2])), 6) AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id)"""


def _found(t: Tables) -> DataFrame:
    """Every twentieth vector against all others."""
    e = t("embeddings")
    return memory.retrieved(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v")), e.select(F.col("vec_id").alias("item"), F.col("embedding").alias("v")), 20, 8, 0.3, others=True)


@view(f"SELECT query, item, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM {_SCORED}) WHERE rank <= 8 AND score >= 0.3")
def retrieval_top_k(t):
    return _found(t).select("query", "item", "score")


@view(f"""SELECT win, item, score, queries, row_number() OVER (PARTITION BY win ORDER BY score, item) AS place FROM (SELECT query // 100 AS win, item, max(score) AS score, count(*) AS queries FROM
(SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM {_SCORED}) WHERE rank <= 8 AND score >= 0.3 GROUP BY ALL)""")
def retrieval_merge(t):
    return memory.merged(_found(t).withColumn("win", F.expr("query div 100")), ["win"])


@view(f"SELECT conv_id, n % 3 AS n, (SELECT text FROM {TURNS} x WHERE x.conv_id = t.conv_id AND x.n % 3 = t.n % 3 ORDER BY x.n LIMIT 1) AS text FROM {TURNS} t GROUP BY ALL")
def first_wins(t):
    return memory.first_seen(turns(t).select("conv_id", (F.col("n") % 3).alias("n"), F.col("n").alias("seen"), "text"), CONV, "seen")


@view("SELECT user_id, count(*) AS records, string_agg(event_type, ',' ORDER BY event_id) AS kinds FROM events WHERE event_id % 7 = 0 GROUP BY user_id")
def profile_rendering(t):
    """Profiles rendered as JSON and read back, as blanks in JSON are not SQL's concern."""
    text = memory.profile(t("events").where("event_id % 7 = 0"), USER, "event_id", ["event_id", "event_type"])
    read = F.from_json("profile", "array<struct<event_id: bigint, event_type: string>>")
    return text.select("user_id", F.size(read).cast("long").alias("records"), F.array_join(F.transform(read, lambda x: x["event_type"]), ",").alias("kinds"))


# Joins and sets
@view(f"""SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.place, b.place) AS place, a.n AS user_line, b.n AS reply_line, CASE WHEN a.n IS NULL OR b.n IS NULL THEN 'uneven' END AS problem
FROM (SELECT conv_id, n, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS place FROM {TURNS} WHERE speaker = 'speaker_u') a FULL JOIN (SELECT conv_id, n, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS place FROM {TURNS} WHERE speaker = 'speaker_a') b ON a.conv_id = b.conv_id AND a.place = b.place""")
def positional_zip(t):
    of = lambda s: turns(t).where(F.col("speaker") == s).select("conv_id", "n")
    return lookups.zipped(of("speaker_u"), of("speaker_a"), CONV, "n").select("conv_id", "place", F.col("left.n").alias("user_line"), F.col("right.n").alias("reply_line"), "problem")


@view(f"SELECT t.conv_id, count(l.quality) AS found, count(*) - count(l.quality) AS dropped FROM {TURNS} t LEFT JOIN labels l ON l.doc_id = t.conv_id * 10 + t.n GROUP BY t.conv_id")
def lookup_with_drop(t):
    return lookups.looked_up(turns(t).withColumn("doc_id", F.col("conv_id") * 10 + F.col("n")), t("labels"), ["doc_id"], "quality", CONV)


@view("SELECT d.doc_id, d.lang, coalesce(l.toxic, 0) AS score, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_join_default(t):
    return lookups.scored(t("documents").select("doc_id", "lang"), t("labels").select("doc_id", F.col("toxic").alias("score")), ["doc_id"])


@view("SELECT n_nationkey AS nation, coalesce((SELECT string_agg(s_name, ', ' ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey), 'none') AS rendered FROM nation")
def group_render(t):
    return lookups.rendered_groups(t("supplier").withColumnRenamed("s_nationkey", "nation"), t("nation").select(F.col("n_nationkey").alias("nation")), ["nation"], "s_name", "s_suppkey")


@view("SELECT d.lang, d.source, d.doc_id, row_number() OVER (PARTITION BY d.lang, d.source ORDER BY d.doc_id) AS place FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality >= 1")
def label_groups(t):
    own = t("documents").select("doc_id", "lang", "source").join(t("labels").select("doc_id", "quality"), "doc_id")
    return lookups.certain(own, ["lang", "source"], "doc_id", "quality", 1).drop("quality")


@view("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_anti_join(t):
    return lookups.left_to_do(t("orders").select("o_orderkey", "o_custkey"), t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"], F.col("l_returnflag") != "R")


@view("SELECT n_nationkey * 3 AS id, CASE (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey * 3) WHEN 0 THEN 'missing' WHEN 1 THEN 'released' ELSE 'duplicate' END AS status FROM nation")
def release_lookup(t):
    return lookups.release(t("nation").select((F.col("n_nationkey") * 3).alias("id")), t("supplier").withColumnRenamed("s_nationkey", "id"), "id")


@view("SELECT a AS diariser, b AS asr, c AS llm, 'l' || a || '_a' || b || '_m' || c AS name FROM range(1, 5) x(a), range(1, 5) y(b), range(1, 5) z(c)")
def grid_cross_join(t):
    return lookups.grid(t("nation").sparkSession, {"diariser": [1, 2, 3, 4], "asr": [1, 2, 3, 4], "llm": [1, 2, 3, 4]}, "l{diariser}_a{asr}_m{llm}")


@view("SELECT s.s_suppkey AS k, coalesce(CASE WHEN e.vec_id % 2 = 0 THEN e.label END, CASE WHEN e.label % 3 < 2 THEN e.label END) AS profile, coalesce(e.vec_id % 2 <> 0 AND e.label % 3 < 2, false) AS filled FROM supplier s LEFT JOIN embeddings e ON e.vec_id = s.s_suppkey")
def profile_bootstrap(t):
    e = t("embeddings").select(F.col("vec_id").alias("k"), "label")
    own = t("supplier").select(F.col("s_suppkey").alias("k")).join(e.where("k % 2 = 0").withColumnRenamed("label", "profile"), "k", "left")
    return lookups.filled(own, e.where("label % 3 < 2").withColumnRenamed("label", "profile"), ["k"])


@view("SELECT user_id, event_type, value, event_id FROM events e WHERE event_type <> 'error' AND event_id = (SELECT max(event_id) FROM events x WHERE x.user_id = e.user_id AND x.event_type = e.event_type)")
def latest_profile(t):
    return lookups.latest(t("events").where("event_type <> 'error'"), ["user_id", "event_type"], "event_id", "value")


@view("SELECT user_id, value, event_id FROM events WHERE event_id IN (SELECT min(event_id) FROM events GROUP BY user_id)")
def first_event(t):
    return lookups.first_wins(t("events"), USER, "event_id", "value")


@view(r"SELECT lang, source, min(doc_id) AS doc_id FROM documents WHERE doc_id % 20 > 0 AND NOT EXISTS (SELECT 1 FROM documents p WHERE p.doc_id % 20 = 0 AND p.lang = documents.lang AND p.source = documents.source AND lower(trim(regexp_replace(p.text, '[ \t\n\v\f\r]+', ' ', 'g'))) = lower(trim(regexp_replace(documents.text, '[ \t\n\v\f\r]+', ' ', 'g')))) GROUP BY lang, source, lower(trim(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g')))")
def exact_dedup(t):
    d = t("documents").select("doc_id", "lang", "source", "text")
    return lookups.new_records(d.where("doc_id % 20 > 0"), ["lang", "source"], F.col("text"), "doc_id", d.where("doc_id % 20 = 0")).drop("text")


@view("SELECT user_id, list_sort(list_filter(['click', 'view', 'shutdown', 'purchase'], lambda x: NOT list_contains(list(DISTINCT event_type), x))) AS missing, list_sort(list_filter(list(DISTINCT event_type), lambda x: x NOT IN ('click', 'view'))) AS unknown FROM events GROUP BY user_id")
def unknown_keys(t):
    kinds = F.collect_set("event_type")
    own = t("events").groupBy("user_id").agg(kinds.alias("kinds"))
    return own.select("user_id", F.sort_array(lookups.missing(F.col("kinds"), ["click", "view", "shutdown", "purchase"])).alias("missing"), F.sort_array(lookups.unknown(F.col("kinds"), ["click", "view"])).alias("unknown"))


_FIXED = f"(SELECT *, coalesce(start - lag(stop) OVER w > 40 OR lag(stop) OVER w - start > 40, false)::INT AS far FROM {CHUNKS} WINDOW w AS (PARTITION BY user_id ORDER BY start))"


@view(f"""WITH s AS (SELECT *, (sum(far) OVER (PARTITION BY user_id ORDER BY start))::BIGINT AS session FROM {_FIXED}), g AS (SELECT user_id, session, min(start) AS a, max(stop) AS z FROM s GROUP BY ALL),
p AS (SELECT *, unnest(range(0, greatest(1, ceil((z - a) / 100)::BIGINT))) AS piece FROM g)
SELECT user_id, session, piece, a + 100.0 * piece AS start, least(a + 100.0 * (piece + 1), z) AS stop, CASE WHEN a + 100.0 * (piece + 1) <= z THEN 'full' WHEN session = max(session) OVER (PARTITION BY user_id) THEN 'end' ELSE 'gap' END AS boundary FROM p""")
def gap_pieces(t):
    return lookups.gap_pieces(chunks(t), USER, 40, 100)


@view(f"""WITH s AS (SELECT *, (sum(far) OVER (PARTITION BY user_id ORDER BY start))::BIGINT AS session FROM {_FIXED.replace('> 40', '> 60')}), g AS (SELECT user_id, session, min(start) AS a, max(stop) AS z FROM s GROUP BY ALL),
p AS (SELECT *, unnest(range(0, greatest(1, ceil((z - a) / 250)::BIGINT))) AS piece FROM g), b AS (SELECT *, a + 250.0 * (piece + 1) <= z AS full_, session = max(session) OVER (PARTITION BY user_id) AS final FROM p)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY session, piece) AS utterance, a + 250.0 * piece AS start, round(least(a + 250.0 * (piece + 1), z) + CASE WHEN NOT full_ AND NOT final THEN 60 ELSE 0 END, 3) AS stop, CASE WHEN full_ THEN 'longest' WHEN final THEN 'end' ELSE 'silence' END AS boundary FROM b""")
def silence_endpoints(t):
    return lookups.endpoints(chunks(t), USER, 60, 250)


@view("SELECT user_id, session, count(*) AS n FROM (SELECT *, (sum(far) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS session FROM (SELECT *, coalesce(event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) > 200, false)::INT AS far FROM events)) GROUP BY ALL")
def gap_segments(t):
    return lookups.sessions(t("events"), USER, "event_id", 200).groupBy("user_id", "session").agg(F.count("*").alias("n"))


@view("SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE list_sort(list_distinct(list_concat(range(event_id % 4, event_id % 4 + 3), [event_id % 9]))) END AS cpus FROM events")
def cpu_set_parse(t):
    i = F.col("event_id")
    span = F.concat((i % 4).cast("string"), F.lit("-"), (i % 4 + 2).cast("string"), F.lit(","), (i % 9).cast("string"))
    spec = F.when(i % 5 == 0, F.concat(span, F.lit(","))).when(i % 5 == 1, F.concat((i % 4 + 2).cast("string"), F.lit("-"), (i % 4).cast("string"))).otherwise(span)
    return t("events").select("event_id", lookups.cpu_set(spec).cast("array<bigint>").alias("cpus"))


@view("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN p_size::DOUBLE ELSE (p_size + 0.5) / 1000 END AS size FROM part")
def size_parse(t):
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    name = F.when(k == 0, F.concat("p_name", F.lit(" of no size"))).when(k == 1, F.concat(F.lit("small-9B-"), size, F.lit("b"))).otherwise(F.concat(F.lit("e5-"), size, F.lit(".5 M")))
    return t("part").select("p_partkey", lookups.size_in_billions(name).alias("size"))


@view(f"""SELECT conv_id, n, '{{"format":"v1","source_name":"' || speaker || '","track_id":"' || n || '"}}' AS aad FROM {TURNS} WHERE n < 5 UNION ALL SELECT conv_id, n, '{{"format":"v1","source_name":"a \\"b\\"\\\\","track_id":"' || n || '"}}' FROM {TURNS} WHERE n >= 5""")
def aad_builder(t):
    name = F.when(F.col("n") < 5, F.col("speaker")).otherwise('a "b"\\')
    return turns(t).select("conv_id", "n", lookups.associated_data(F.lit("v1"), name, F.col("n").cast("string")).alias("aad"))


@view(f"SELECT conv_id, n, base64(encode(text)) AS coded FROM {TURNS}")
def base64_codec(t):
    return turns(t).select("conv_id", "n", lookups.base64_text(F.encode("text", "utf-8")).alias("coded"))


@view(f"SELECT conv_id, n, 'Window: ' || replace(text, '{{{{PROFILE}}}}', speaker) || CASE WHEN n % 2 = 0 THEN ' ' || speaker ELSE '' END || ' Profile: ' || speaker AS prompt FROM {TURNS}")
def prompt_render(t):
    """Every turn as a window; every other one itself holds a name in braces, which the value that follows fills."""
    text = F.when(F.col("n") % 2 == 0, F.concat("text", F.lit(" {{PROFILE}}"))).otherwise(F.col("text"))
    return turns(t).select("conv_id", "n", lookups.prompt("Window: {{WINDOW}} Profile: {{PROFILE}}", {"WINDOW": text, "PROFILE": F.col("speaker")}).alias("prompt"))


# Measures
@view("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_seconds, round(max(value), 6) AS maximum_seconds FROM events GROUP BY event_type")
def timing_summary(t):
    return measures.timing_summary(t("events"), ["event_type"], "value")


@view("SELECT user_id, count(*) FILTER (event_id > 5000) AS n, round(avg(value) FILTER (event_id > 5000), 6) AS mean_seconds, round(max(value) FILTER (event_id > 5000), 6) AS maximum_seconds FROM events GROUP BY user_id")
def lag_summary(t):
    return measures.lag_summary(t("events"), USER, "event_id", "value", 5000)


@view("""SELECT user_id, count(*) AS n, max(event_id)::DOUBLE - min(event_id) AS duration, round(avg(value) - 0.5 + 1e-8, 5) AS mean, round(list_sort(list(value))[1 + least(count(*) - 1, floor(0.95 * count(*))::BIGINT)] - 0.5 + 1e-8, 5) AS p95_nearest, round(quantile_cont(value, 0.95) - 0.5 + 1e-8, 5) AS p95_linear,
round(max(value) - 0.5 + 1e-8, 5) AS peak, round(coalesce(sum((value + before - 1) / 2 * (event_id - since)), 0), 3) AS energy FROM (SELECT *, lag(value) OVER w AS before, lag(event_id) OVER w AS since FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY user_id""")
def power_summary(t):
    own = measures.power_summary(power(t), USER, 0.5)
    return own.select("user_id", "n", "duration", *[F.round(F.col(c) + 1e-8, 5).alias(c) for c in ("mean", "p95_nearest", "p95_linear", "peak")], F.round("energy", 3).alias("energy"))


@view("""SELECT user_id, event_id::DOUBLE AS at, round(CASE WHEN k <= 12 OR n - k < 12 THEN value ELSE (SELECT avg(value) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS j FROM events) x WHERE x.user_id = e.user_id AND x.j BETWEEN e.k - 12 AND e.k + 12) END, 5) AS smooth
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) e""")
def moving_average(t):
    return measures.moving_average(power(t), USER, "watts").select("user_id", "at", F.round("smooth", 5).alias("smooth"))


@view("""SELECT user_id, round(sum(a * v), 4) AS total_w, round(sum(a * v) FILTER (rail = 0), 4) AS core_w, count(a * v) AS rails FROM (SELECT user_id, event_id % 10 AS rail, max(value) FILTER (event_type = 'click') AS a, max(value) FILTER (event_type = 'view') AS v FROM events GROUP BY ALL) GROUP BY user_id HAVING count(a * v) > 0""")
def rail_power_pivot(t):
    i, kind = F.col("event_id"), F.when(F.col("event_type") == "click", "A current").when(F.col("event_type") == "view", "V volt")
    rail = F.when(i % 10 == 0, "VDD_CORE").otherwise(F.concat(F.lit("R"), (i % 10).cast("string")))
    text = F.coalesce(F.concat(F.lit(" "), rail, F.lit("_"), kind, F.lit("("), (i % 24).cast("string"), F.lit(")="), F.expr("format_number(value, '0.##########')")), F.lit("no reading"))
    got = measures.rails(t("events").select("user_id", text.alias("line")), USER)
    return got.select("user_id", F.round("total_w", 4).alias("total_w"), F.round("core_w", 4).alias("core_w"), F.size("rail_watts").cast("long").alias("rails"))


@view("SELECT user_id, CASE WHEN user_id % 5 > 0 THEN max(event_id) FILTER (event_type <> 'view') / (user_id % 5)::DOUBLE END AS rtf FROM events GROUP BY user_id")
def real_time_factor(t):
    own = t("events").select("user_id", F.col("event_type").alias("stage"), F.col("event_id").cast("double").alias("stop"))
    return measures.real_time_factor(own, USER, "view", F.max(F.col("user_id") % 5))


@view("SELECT user_id, round((81 * avg(value) FILTER (event_id % 3 = 0) + 15 * avg(value) FILTER (event_id % 3 = 1) + 4 * avg(value) FILTER (event_id % 3 = 2)) / 100, 6) AS rtf FROM events GROUP BY user_id")
def weighted_factor(t):
    one, two, three = (F.avg(F.when(F.col("event_id") % 3 == k, F.col("value"))) for k in range(3))
    return t("events").groupBy("user_id").agg(F.round(measures.weighted_rtf(one, two, three), 6).alias("rtf"))


@view("SELECT d.lang, coalesce(sum(l.toxic) / count(l.toxic), 0)::DOUBLE AS leakage, count(l.toxic) AS items FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang")
def leakage_fraction(t):
    return measures.leakage(t("documents").select("doc_id", "lang").join(t("labels").select("doc_id", F.col("toxic").alias("score")), "doc_id", "left"), ["lang"])


@view("""SELECT event_id, error, CASE WHEN error IS NULL THEN round((value / 10 + event_id % 11 / 10 + user_id % 3) / 3, 9) ELSE 0 END AS score
FROM (SELECT *, CASE WHEN value < 1 OR value > 10 THEN 'readability' WHEN event_id % 11 = 0 THEN 'meaning' WHEN user_id % 3 = 2 THEN 'hallucinations' END AS error FROM events)""")
def utility_score(t):
    got = measures.utility(F.col("value"), F.col("event_id") % 11, F.col("user_id") % 3)
    return t("events").select("event_id", got.alias("u")).select("event_id", "u.error", F.round("u.score", 9).alias("score"))


@view("""SELECT split, count(*) FILTER (seen) AS n, max(want) AS expected, coalesce(count(*) FILTER (seen) <> max(want), true) OR count(*) FILTER (seen) = 0 AS mismatch FROM
(SELECT ['test', 'train', 'val', 'val'][1 + doc_id % 4] AS split, true AS seen, NULL AS want FROM labels UNION ALL SELECT * FROM (VALUES ('test', false, 10), ('val', false, (SELECT count(*) FROM labels WHERE doc_id % 4 >= 2)), ('dev', false, 3))) GROUP BY split""")
def split_counts(t):
    own = t("labels").select(F.element_at(F.array(*map(F.lit, ("test", "train", "val", "val"))), (F.col("doc_id") % 4 + 1).cast("int")).alias("split"))
    expected = t("labels").agg(F.count_if(F.col("doc_id") % 4 >= 2).alias("v")).select(F.explode(F.array(F.struct(F.lit("test").alias("split"), F.lit(10).cast("long").alias("n")), F.struct(F.lit("val").alias("split"), F.col("v").alias("n")), F.struct(F.lit("dev").alias("split"), F.lit(3).cast("long").alias("n")))).alias("x")).select("x.*")
    return measures.split_counts(own, expected)


@view("SELECT user_id, count(*) FILTER (event_type <> 'error') AS active, count(*) FILTER (event_type = 'error') AS empty, round((max(event_id + value) - min(event_id)) / max(event_id), 6) AS elapsed_ratio FROM events GROUP BY user_id")
def run_report(t):
    own = t("events").select("user_id", (F.col("event_type") != "error").cast("int").alias("edits"), F.col("event_id").alias("started"), (F.col("event_id") + F.col("value")).alias("stopped"), F.col("event_id").alias("seconds"))
    return measures.run_report(own, USER).withColumn("elapsed_ratio", F.round("elapsed_ratio", 6))


@view("""SELECT user_id, sum(n) FILTER (reason IS NULL)::BIGINT AS accepted, coalesce(sum(n) FILTER (reason IS NOT NULL), 0)::BIGINT AS rejected, coalesce(string_agg(reason || ' ' || n, ', ' ORDER BY reason) FILTER (reason IS NOT NULL), '') AS reasons
FROM (SELECT user_id, CASE WHEN value < 1 THEN 'too small' WHEN event_type = 'error' THEN 'failed' END AS reason, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id""")
def validation_counts(t):
    got = measures.verdict_counts(t("events").select("user_id", F.when(F.col("value") < 1, "too small").when(F.col("event_type") == "error", "failed").alias("reason")), USER)
    return got.select("user_id", F.when(F.col("accepted") > 0, F.col("accepted")).alias("accepted"), "rejected", F.array_join(F.transform("reasons", lambda x: F.concat(x["reason"], F.lit(" "), x["n"].cast("string"))), ", ").alias("reasons"))


@view("""WITH m AS (SELECT label, place, sum(x * (vec_id + 1)) / sum(vec_id + 1) AS m FROM (SELECT label, vec_id, unnest(range(0, 64)) AS place, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY ALL)
SELECT label, place, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 5) + 0.0 AS x FROM m""")
def weighted_vector_mean(t):
    got = measures.mean_vector(t("embeddings").select("label", F.col("embedding").alias("v"), (F.col("vec_id") + 1).alias("weight")), ["label"])
    return got.select("label", F.posexplode("v").alias("place", "x")).withColumn("x", F.round("x", 5) + 0.0)


@view("SELECT a.vec_id, place, round(x - m, 6) + 0.0 AS x FROM (SELECT label, vec_id, unnest(range(0, 64)) AS place, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) a JOIN (SELECT label, k, avg(y) AS m FROM (SELECT label, unnest(range(0, 64)) AS k, CAST(unnest(embedding) AS DOUBLE) AS y FROM embeddings) GROUP BY ALL) b ON a.label = b.label AND a.place = b.k")
def mean_centred(t):
    got = measures.less_group_mean(t("embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v")), ["label"], ["vec_id"])
    return got.select("vec_id", "place", (F.round("x", 6) + 0.0).alias("x"))


_PER_USER = "(SELECT user_id, avg(value) AS a, count(*)::DOUBLE AS b, 1.0::DOUBLE AS c FROM events GROUP BY user_id)"


def _per_user(t: Tables) -> DataFrame:
    return t("events").groupBy("user_id").agg(F.avg("value").alias("a"), F.count("*").cast("double").alias("b"), F.lit(1.0).alias("c"))


@view(f"SELECT user_id, round(((a - la) / (ha - la) + (b - lb) / (hb - lb) + 1) / 3, 6) AS composite FROM {_PER_USER}, (SELECT min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb FROM {_PER_USER})")
def composite_score(t):
    return measures.composite(_per_user(t), ["a", "b", "c"]).select("user_id", F.round("composite", 6).alias("composite"))


@view("SELECT user_id, event_id, (value - low) / nullif(high - low, 0) AS scaled FROM events JOIN (SELECT user_id AS u, min(value) AS low, max(value) AS high FROM events GROUP BY ALL) ON u = user_id")
def min_max_scaling(t):
    return measures.bounds(t("events").select("user_id", "event_id", "value"), ["value"], USER).select("user_id", "event_id", measures.scaled("value").alias("scaled"))


@view("""WITH l AS (SELECT user_id % 10 AS pool, user_id AS config, arg_max(value, event_id) AS value FROM events GROUP BY ALL) SELECT pool, arg_min(config, value) AS config, min(value) AS value FROM l GROUP BY pool HAVING count(*) >= 10""")
def best_per_config(t):
    return measures.best(t("events").select((F.col("user_id") % 10).alias("pool"), F.col("user_id").alias("config"), "event_id", "value"), ["pool"], "event_id", "value", 10)


@view(f"SELECT user_id, round(d, 6) AS distance, round(d - (SELECT min(sqrt(((a - 40) / 40) ** 2 + ((b - 60) / 30) ** 2)) FROM {_PER_USER}), 6) AS behind FROM (SELECT user_id, sqrt(((a - 40) / 40) ** 2 + ((b - 60) / 30) ** 2) AS d FROM {_PER_USER})")
def distance_to_best(t):
    got = measures.distance_to_best(_per_user(t), {"a": (40.0, 40.0), "b": (60.0, 30.0)})
    return got.select("user_id", F.round("distance", 6).alias("distance"), F.round("behind", 6).alias("behind"))


_ORDER_LINES = "(SELECT o_custkey, o_orderkey, o_totalprice AS price, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"


@view(f"SELECT a.o_custkey, a.o_orderkey, a.price, a.n FROM {_ORDER_LINES} a WHERE NOT EXISTS (SELECT 1 FROM {_ORDER_LINES} b WHERE b.o_custkey = a.o_custkey AND (b.price < a.price OR b.price = a.price AND b.o_orderkey < a.o_orderkey) AND b.n >= a.n)")
def skyline_walk(t):
    n = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    own = t("orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("price")).join(n, "o_orderkey")
    return measures.skyline(own, ["o_custkey"], "price", "n", "o_orderkey")


_MOVES = "(SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END AS change FROM events)"


@view(f"""WITH q AS (SELECT *, sum(change) OVER (PARTITION BY user_id ORDER BY event_id) AS depth, count(*) FILTER (change < 0) OVER (PARTITION BY user_id ORDER BY event_id) AS gone FROM {_MOVES})
SELECT user_id, event_id, depth::BIGINT AS depth, CASE WHEN depth > 0 THEN (SELECT a.event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM {_MOVES} WHERE change > 0) a WHERE a.user_id = q.user_id AND a.k = q.gone + 1) END AS oldest FROM q""")
def queue_depth(t):
    kind = F.col("event_type")
    own = t("events").select("user_id", "event_id", F.when(kind == "click", 1).when(kind == "view", -1).otherwise(0).alias("change"))
    return measures.queue_depth(own, USER, "event_id").drop("change")


@view(f"SELECT e.user_id, e.event_id::DOUBLE AS at, round(coalesce((SELECT sum(skipped) FROM {SKIPS} s WHERE s.user_id = e.user_id AND s.at <= e.event_id), 0), 6) AS virtual_offset FROM events e WHERE event_type <> 'error'")
def virtual_offset_as_of(t):
    got = measures.skip_offsets(skips(t), moments(t), USER)
    return got.select("user_id", "at", F.round("offset", 6).alias("virtual_offset"))


@view(f"SELECT e.user_id, e.event_id::DOUBLE AS at, s.at AS skip_at FROM (SELECT *, event_id::DOUBLE AS moment FROM events WHERE event_type <> 'error') e ASOF LEFT JOIN {SKIPS} s ON s.user_id = e.user_id AND e.moment >= s.at")
def last_skip_as_of(t):
    return measures.skip_offsets(skips(t), moments(t), USER).select("user_id", "at", "skip_at")


@view(f"SELECT s.user_id, s.at, s.skipped, round((SELECT sum(skipped) FROM {SKIPS} x WHERE x.user_id = s.user_id AND x.at <= s.at), 6) AS cumulative FROM {SKIPS} s")
def cumulative_skip(t):
    return measures.cumulative(skips(t), USER, "at", "skipped").withColumn("cumulative", F.round("cumulative", 6))


@view(f"""SELECT e.user_id, e.event_id::DOUBLE AS at, round(e.event_id + moved, 6) AS completed, round(e.event_id + moved - (e.event_id - e.event_id % 5), 6) AS lag FROM (SELECT *, coalesce((SELECT sum(skipped) FROM {SKIPS} s WHERE s.user_id = events.user_id AND s.at <= events.event_id), 0) AS moved FROM events) e WHERE event_type NOT IN ('error', 'view')""")
def timeline_rebuilt(t):
    own = moments(t).withColumn("available", F.col("at") - F.col("at") % 5)
    return measures.rebuilt_timeline(own, skips(t), USER, "view").select("user_id", "at", F.round("completed", 6).alias("completed"), "lag")


@view("SELECT user_id, event_id, (event_id - (SELECT min(event_id) FROM events x WHERE x.user_id = e.user_id))::DOUBLE AS since FROM events e")
def clock_rebase(t):
    return measures.since_start(t("events").select("user_id", "event_id", F.col("event_id").cast("double").alias("at")), USER, "at").drop("at")


@view("SELECT n, greatest(1, round_even(n * 21.9625, 0))::INT AS budget FROM (SELECT DISTINCT turn + 1 AS n FROM conversations)")
def token_budget(t):
    return t("conversations").select((F.col("turn") + 1).alias("n")).distinct().withColumn("budget", measures.token_budget(F.col("n")))


@view("SELECT n, floor(0.3 * n + 0.8) - floor(0.3 * n + 0.5) >= 1 AS dense FROM (SELECT DISTINCT turn AS n FROM conversations)")
def activation_schedule(t):
    return t("conversations").select(F.col("turn").alias("n")).distinct().withColumn("dense", measures.dense_lines(F.col("n"), 0.3))


_COUNTED = f"(SELECT conv_id, n, len(string_split(text, ' ')) AS tokens FROM {TURNS})"


def _counted(t: Tables) -> DataFrame:
    return turns(t).select("conv_id", "n", F.size(F.split("text", " ")).alias("tokens"))


@view(f"SELECT conv_id, count(*) FILTER (upto <= 200) AS parts, coalesce(max(upto) FILTER (upto <= 200), 0)::BIGINT AS tokens FROM (SELECT a.conv_id, a.n, sum(b.tokens) AS upto FROM {_COUNTED} a JOIN {_COUNTED} b ON b.conv_id = a.conv_id AND b.n <= a.n GROUP BY ALL) GROUP BY conv_id")
def prefix_under_budget(t):
    return measures.longest_prefix(_counted(t), CONV, "n", "tokens", 200)


@view(f"SELECT conv_id, sum(tokens)::BIGINT AS tokens, CASE WHEN sum(tokens) > 264 THEN 'over budget' ELSE 'ok' END AS verdict FROM {_COUNTED} GROUP BY conv_id")
def fixture_budget(t):
    own = _counted(t).groupBy("conv_id").agg(F.sum("tokens").alias("tokens"))
    return own.withColumn("verdict", F.when(F.col("tokens") <= measures.token_budget(F.lit(12)), "ok").otherwise("over budget"))


@view("SELECT user_id, max(abs(value)) AS peak_x, max(abs(event_id))::DOUBLE AS peak_y, round(CASE WHEN stddev_pop(value) > 1e-8 AND stddev_pop(event_id) > 1e-8 THEN corr(value, event_id::DOUBLE) END, 6) AS correlation, bool_and(isfinite(value)) AS finite FROM events GROUP BY user_id")
def separation_diagnostics(t):
    got = measures.diagnostics(t("events").select("user_id", F.col("value").alias("x"), F.col("event_id").cast("double").alias("y")), USER)
    return got.withColumn("correlation", F.round("correlation", 6))


@view("SELECT user_id, bool_and(value > 0.05) AND arg_max(event_id - event_id % 3, event_id) = max(event_id) AS idle FROM events GROUP BY user_id")
def idle_predicate(t):
    i = F.col("event_id")
    return measures.idle(t("events").select("user_id", i.alias("chunk"), (i - i % 3).alias("routed"), (F.col("value") > 0.05).alias("ok")), USER)


# Sources and sinks
@view(r"""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY place) AS n, CASE WHEN label <> '' THEN label ELSE 'speaker_a' END AS speaker, CASE WHEN label <> '' THEN trim(substr(line, strpos(line, ':') + 1)) ELSE line END AS text
FROM (SELECT *, trim(regexp_extract(line, '^([A-Za-z_][0-9A-Za-z_ .-]*?)\s*:', 1)) AS label FROM (SELECT conv_id, turn, place, trim(regexp_replace(trim(raw), '^[0-9]+\s*:', '')) AS line FROM
(SELECT conv_id, turn, unnest(range(0, len(parts))) AS place, unnest(parts) AS raw FROM (SELECT conv_id, turn, string_split(CASE WHEN turn % 2 = 0 THEN (turn + 1) || ': ' || role || ' : ' ELSE '' END || text, chr(10)) AS parts FROM conversations)) WHERE trim(raw) <> ''))""")
def turn_parse(t):
    text = F.concat(F.when(F.col("turn") % 2 == 0, F.concat((F.col("turn") + 1).cast("string"), F.lit(": "), "role", F.lit(" : "))).otherwise(F.lit("")), "text")
    return transcripts.exploded(t("conversations").select("conv_id", "turn", transcripts.turns_of_text(text).alias("turns")), "conv_id", "turn")


@view(f"""SELECT conv_id, n, text, 'speaker_' || chr(96 + (SELECT count(DISTINCT b.speaker) FROM {TURNS} b WHERE b.conv_id = a.conv_id AND b.n <= (SELECT min(c.n) FROM {TURNS} c WHERE c.conv_id = a.conv_id AND c.speaker = a.speaker))::INT) AS alias FROM {TURNS} a""")
def speaker_alias(t):
    return transcripts.aliased(turns(t).withColumnRenamed("n", "at"), "conv_id", "at").select("conv_id", "n", "text", "alias")


@view(f"SELECT conv_id, n, speaker, text FROM {TURNS} WHERE conv_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def manifest_semi_join(t):
    return turns(t).join(t("labels").where("quality = 1").select(F.col("doc_id").alias("conv_id")).distinct(), "conv_id", "left_semi")


@view("SELECT DISTINCT doc_id AS conversation_id FROM labels WHERE doc_id NOT IN (SELECT conv_id FROM conversations)")
def manifest_skipped(t):
    return transcripts.skipped(t("conversations").withColumnRenamed("conv_id", "conversation_id"), t("labels").withColumnRenamed("doc_id", "conversation_id"))


@view("SELECT page_id AS name, sha256(html) AS sha256, strlen(html) AS bytes FROM pages")
def artifact_digest(t):
    return sinks.artifact_manifest(t("pages").select(F.col("page_id").alias("name"), F.encode("html", "utf-8").alias("content")))


@view("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS keys FROM events")
def event_props_scan(t):
    """States read from JSON; every third one is cut off, which reads as an empty state."""
    text = F.when(F.col("event_id") % 3 == 0, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    return t("events").select("event_id", sinks.state_of(text).alias("s")).select("event_id", F.try_element_at("s", F.lit("k")).alias("k"), F.size("s").alias("keys"))


@view("SELECT ['train', 'val', 'test'][1 + doc_id % 3] AS split, doc_id, ['train', 'val', 'test'][1 + doc_id % 3] || ',' || doc_id || ',' || lang || chr(10) AS row_text FROM documents")
def manifest_rows(t):
    own = t("documents").select(F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), (F.col("doc_id") % 3 + 1).cast("int")).alias("split"), "doc_id", "lang")
    return own.select("split", "doc_id", sinks.csv_row([F.col("split"), F.col("doc_id").cast("string"), F.col("lang")]).alias("row_text"))


@view(f"SELECT conv_id, n, 'turn' AS kind, text FROM {TURNS} UNION ALL SELECT conv_id, n, 'edit', replacement FROM {EDITS}")
def profile_log(t):
    logs = [turns(t).select("conv_id", "n", F.lit("turn").alias("kind"), "text"), lines.edits(answers(t), CONV).select("conv_id", "n", F.lit("edit").alias("kind"), F.col("replacement").alias("text"))]
    return sinks.appended(logs)


@view("SELECT event_id, sink FROM events, (VALUES ('writer'), ('recogniser')) v(sink) WHERE event_type IN ('click', 'view') UNION ALL SELECT event_id, 'errors' FROM events WHERE event_type = 'error'")
def route_by_kind(t):
    kind = F.col("event_type")
    sent = sinks.delivered(t("events"), {"writer": kind.isin("click", "view"), "recogniser": kind.isin("click", "view"), "errors": kind == "error"})
    return sent.select("event_id", "sink")


@view("SELECT s AS seed, event_id, value FROM events, (VALUES (0), (1), (2)) v(s) WHERE s = 0 OR user_id % 4 = s")
def run_filter(t):
    own = t("events").withColumn("seed", (F.col("user_id") % 4).cast("int"))
    return sinks.appended([measures.of_seed(own, k, 0).select(F.lit(k).alias("seed"), "event_id", "value") for k in (0, 1, 2)])


@view("""WITH RECURSIVE q AS (SELECT user_id, event_id, event_id % 11 AS depth, CASE WHEN event_id % 11 > 0 THEN value * 2 END AS age, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
s AS (SELECT user_id, event_id, k, depth, CASE WHEN coalesce(age >= 90, false) OR depth > 6 THEN 'promoted' ELSE 'background' END AS state FROM q WHERE k = 1
UNION ALL SELECT q.user_id, q.event_id, q.k, q.depth, CASE WHEN s.state = 'background' THEN CASE WHEN coalesce(q.age >= 90, false) OR q.depth > 6 THEN 'promoted' ELSE 'background' END ELSE CASE WHEN q.depth < 3 AND NOT coalesce(q.age >= 90, false) THEN 'background' ELSE 'promoted' END END FROM s JOIN q ON q.user_id = s.user_id AND q.k = s.k + 1)
SELECT user_id, event_id, depth, state FROM s""")
def hysteresis_state(t):
    i = F.col("event_id")
    return measures.hysteresis(t("events").select("user_id", "event_id", (i % 11).alias("depth"), F.when(i % 11 > 0, F.col("value") * 2).alias("age")), USER, "event_id", 6, 3, 90.0).drop("age")


_GUESSES = """(SELECT conv_id * 100 + turn AS turn_id, turn, 'speaker_' || substring(role, 1, 1) AS speaker, CASE turn % 8 WHEN 1 THEN 'none' WHEN 2 THEN 'Unknown' WHEN 5 THEN '  ' ELSE text END AS guess FROM conversations)"""


@view(f"""SELECT turn_id, a AS at, speaker, CASE WHEN turn % 4 = 3 THEN 'mood' ELSE 'identity' END AS attribute, trim(guess) AS guess, CASE WHEN trim(guess) = '' THEN 'guess missing' WHEN turn % 4 = 3 THEN 'unknown attribute' WHEN length(trim(guess)) > 1000 THEN 'guess too long'
WHEN turn % 8 = 1 THEN 'no inference' WHEN turn % 8 = 2 THEN 'generic guess' WHEN a = 1 AND turn % 8 = 4 THEN 'line references' WHEN a = 1 THEN 'duplicate' END AS reason FROM {_GUESSES}, (VALUES (0), (1)) v(a) WHERE guess IS NOT NULL""")
def payload_validation(t):
    """Whole turns as guesses in payloads in prose, with a citation before them, one cut off or with a comma too many; void, generic and blank guesses, and line references as text."""
    k = F.col("turn") % 8
    guess = F.when(k == 1, "none").when(k == 2, "Unknown").when(k == 5, "  ").otherwise(F.col("text"))
    held = F.to_json(F.struct(guess.alias("guess")))  # {"guess":"..."}: the whole text as a JSON string
    record = F.concat(F.lit('{"speaker": "Speaker '), F.substring("role", 1, 1), F.lit('", "attribute": "'), F.when(F.col("turn") % 4 == 3, "mood").otherwise("identity"), F.lit('", '), F.expr("substring({0}, 2, length({0}) - 2)".format("_held")))
    own = t("conversations").withColumn("_held", held).withColumn("_record", record)
    text = F.concat(F.lit("As line [1] says: ["), "_record", F.lit("}, "), "_record", F.when(k == 4, ', "lines": ["1"]').otherwise(F.lit("")), F.when(F.col("turn") % 2 == 0, F.lit("},]")).otherwise(F.lit("")))
    found = payloads.recovered(own.select((F.col("conv_id") * 100 + F.col("turn")).alias("turn_id"), F.when(guess.isNotNull(), text).alias("payload")), "turn_id", "payload")
    return payloads.validated(found, "turn_id").drop("reasoning")


@view(f"SELECT conv_id, n, regexp_matches(text, '(?i)^(none|no (new|additional)|no speaker)') AND regexp_matches(text, '(?i)^(none(;|$|[^0-9A-Za-z_])|no (new|additional)($|[^0-9A-Za-z_])|no speaker($|[^0-9A-Za-z_]))') AS no_inference, lower(trim(text)) IN ('something', 'someone', 'unknown', 'a person') AS generic FROM (SELECT conv_id, n, CASE n % 4 WHEN 0 THEN 'No new ' || text WHEN 1 THEN 'nonesuch ' || text WHEN 2 THEN text ELSE 'Someone' END AS text FROM {TURNS})")
def guess_classes(t):
    k = F.col("n") % 4
    text = F.when(k == 0, F.concat(F.lit("No new "), "text")).when(k == 1, F.concat(F.lit("nonesuch "), "text")).when(k == 2, F.col("text")).otherwise("Someone")
    return turns(t).select("conv_id", "n", text.rlike(payloads.NO_INFERENCE).alias("no_inference"), F.trim(text).rlike(payloads.GENERIC).alias("generic"))
