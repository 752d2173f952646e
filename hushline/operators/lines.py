"""Transcript lines and edits of them, as operators on a caller's table.

Lines have the key columns named in `by` (a conversation), `n` (the line number), `speaker` and
`text`; some operators take a rendered `line` ("n: speaker: text"). Digits are ASCII digits. Lines
with a line break inside follow `newline`: "collapse" joins them by one space, "reference" keeps
the first physical line only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# How lines, labels and edits are written, and how far an edit may grow a line.
NUMBERED, LABELLED, EDIT = r"(?s)^\s*([0-9]+)\s*:\s*(.*)$", r"(?s)^\s*([A-Za-z_][\w .-]*?)\s*:\s*(.*)$", r"(?i)^edit\s+([0-9]+)\s*(.*)$"
SPEAKER_PREFIX, MOST_GROWTH = r"(?i)^speaker(?:[ _.-]|$)", 2.5


def one_line(text: Column, newline: str = "collapse") -> Column:
    """text without line breaks."""
    if newline == "collapse":
        return F.regexp_replace(text, r"\s*[\r\n]+\s*", " ")
    return F.regexp_extract(text, r"^[^\r\n]*", 0)


def rendered(n: Column, speaker: Column, text: Column) -> Column:
    return F.concat(n.cast("string"), F.lit(": "), speaker, F.lit(": "), text)


def transcript(lines: DataFrame, by: list[str]) -> DataFrame:
    """lines -> (by, transcript): all lines in order, one per row of text. A conversation is one row, so it must fit in one."""
    ordered = F.array_sort(F.collect_list(F.struct("n", rendered(F.col("n"), F.col("speaker"), F.col("text")).alias("line"))))
    return lines.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("transcript"))


def _parts(line: Column) -> Column:
    return F.split(line, ":", 3)


def _is_number(x: Column) -> Column:
    return F.trim(x).rlike("^[0-9]+$")


def is_window_line(line: Column) -> Column:
    """Whether a line has a number, a speaker and a text; others are dropped from windows."""
    return (F.size(_parts(line)) == 3) & _is_number(_parts(line)[0])


def text_of(line: Column) -> Column:
    """The text without number and speaker; a line of another form as it is, without space around."""
    return F.when(is_window_line(line), F.trim(F.get(_parts(line), F.lit(2)))).otherwise(F.trim(line))


def line_number(line: Column) -> Column:
    head = F.trim(F.split(line, ":", 2)[0])
    return F.when(head.rlike("^[0-9]+$"), head.try_cast("int"))


def context_line(line: Column) -> Column:
    """`n: rest` as `[n] rest`, so that it can't be taken for an edit; other lines as they are."""
    return F.when(line.contains(":") & _is_number(F.split(line, ":", 2)[0]), F.concat(F.lit("["), F.trim(F.split(line, ":", 2)[0]), F.lit("]"), F.get(F.split(line, ":", 2), F.lit(1)))).otherwise(line)


def without_speaker(text: Column) -> Column:
    """text without a leading `speaker...:` label."""
    return F.regexp_replace(text, r"(?i)^\s*speaker[^:]*:\s*", "")


def speaker_key(speaker: Column) -> Column:
    """One key for `speaker a`, `Speaker-A` and `a`; one prefix is taken off, and an empty name gives the prefix alone."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(speaker), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.concat(F.lit("speaker_"), F.regexp_replace(plain, "^speaker_", ""))


def numbered_outputs(lines: DataFrame, by: list[str]) -> DataFrame:
    """lines (by, line) -> (by, n, text, problem): `not numbered`, `repeated` or null. A speaker label is taken off the text."""
    n = F.regexp_extract("line", NUMBERED, 1).try_cast("int")
    own = lines.select(*by, n.alias("n"), without_speaker(F.trim(F.regexp_extract("line", NUMBERED, 2))).alias("text"))
    copies = F.count("*").over(Window.partitionBy(*by, "n"))
    return own.withColumn("problem", F.when(F.col("n").isNull(), "not numbered").when(copies > 1, "repeated"))


# Edits
def edits(answers: DataFrame, by: list[str]) -> DataFrame:
    """answers (by, answer) -> (by, ordinal, n, replacement) of the lines in form `edit <n> <text>`; all other lines are left out."""
    own = answers.select(*by, F.posexplode(F.split("answer", r"\r?\n")).alias("ordinal", "row")).withColumn("row", F.trim("row"))
    return own.where(F.col("row").rlike(EDIT)).select(*by, "ordinal", F.regexp_extract("row", EDIT, 1).try_cast("int").alias("n"), F.trim(F.regexp_extract("row", EDIT, 2)).alias("replacement"))


def last_wins(proposed: DataFrame, by: list[str]) -> DataFrame:
    """One edit a line: the last one's text, at the place of the first."""
    return proposed.groupBy(*by, "n").agg(F.max_by("replacement", "ordinal").alias("replacement"), F.min("ordinal").alias("ordinal"), F.count("*").alias("proposals"))


def outside(proposed: DataFrame, lines: DataFrame, by: list[str]) -> DataFrame:
    """Edits of lines that aren't there."""
    return proposed.join(lines.select(*by, "n"), [*by, "n"], "left_anti")


def normalised(proposed: DataFrame, lines: DataFrame, by: list[str]) -> DataFrame:
    """Edits of lines that are there, with their replacement made fit and a note.

    A leading colon goes; nothing left deletes the line. A missing speaker is put in, and one of
    another name is put right, both with a note; names count as equal by speaker_key.
    """
    both = proposed.join(lines.select(*by, "n", F.col("speaker").alias("_own"), F.col("text").alias("_was")), [*by, "n"])
    body = F.trim(F.regexp_replace(F.trim("replacement"), "^:", ""))
    both = both.withColumn("_body", body).withColumn("_said", F.trim(F.regexp_extract("_body", LABELLED, 1)))
    both = both.withColumn("_said", F.when(F.col("_said").rlike(SPEAKER_PREFIX), F.col("_said"))).withColumn("_text", F.when(F.col("_said").isNotNull(), F.trim(F.regexp_extract("_body", LABELLED, 2))).otherwise(F.col("_body")))
    note = F.when(F.col("_body") == "", F.lit(None)).when(F.col("_said").isNull(), F.concat(F.lit("repaired missing speaker label '"), F.col("_own"), F.lit("'")))
    note = note.when(speaker_key(F.col("_said")) != speaker_key(F.col("_own")), F.concat(F.lit("repaired speaker '"), F.col("_said"), F.lit("' to '"), F.col("_own"), F.lit("'")))
    fit = F.when(F.col("_body") == "", "").otherwise(F.concat("_own", F.lit(": "), "_text"))
    return both.withColumn("replacement", fit).withColumn("note", note).drop("_body", "_said", "_text")


def applied(lines: DataFrame, proposed: DataFrame, by: list[str]) -> DataFrame:
    """lines (by, n, speaker, text) with one edit a line at most -> (by, n, speaker, text, outcome).

    outcome: `deleted` (such rows stay, with a null text), `unchanged` by an edit that says the
    same, `too long` (over 2.5 times the line, label included: ignored), `edited`, or null without
    an edit. Text and label are counted in characters.
    """
    fit = normalised(proposed, lines, by).select(*by, "n", "replacement")
    both = lines.join(fit, [*by, "n"], "left").withColumn("_before", F.concat("speaker", F.lit(": "), "text"))
    outcome = F.when(F.col("replacement").isNull(), F.lit(None)).when(F.col("replacement") == "", "deleted").when(F.col("replacement") == F.col("_before"), "unchanged").when(F.length("replacement") > MOST_GROWTH * F.length(F.trim("_before")), "too long").otherwise("edited")
    both = both.withColumn("outcome", outcome)
    text = F.when(F.col("outcome") == "deleted", F.lit(None)).when(F.col("outcome") == "edited", F.expr("substring(replacement, length(speaker) + 3)")).otherwise(F.col("text"))
    return both.withColumn("text", text).drop("replacement", "_before")


def timed(lines: DataFrame, timings: DataFrame, by: list[str]) -> DataFrame:
    """Surviving lines (by, n, ...) with their timing; lines of empty or no text are left out."""
    return lines.where(F.trim("text") != "").join(timings, [*by, "n"])


# Lines around a line
def neighbours(lines: DataFrame, of: DataFrame, by: list[str], reach: int = 2) -> DataFrame:
    """(by, n, other, text): the lines within `reach` numbers of each of `of` (by, n), without itself. Gaps stay gaps.

    The other side is dealt to the numbers that it is near to, so the join is one of equality.
    """
    dealt = lines.select(*by, F.col("n").alias("other"), "text", F.explode(F.sequence(F.col("n") - reach, F.col("n") + reach)).alias("n"))
    return of.select(*by, "n").distinct().join(dealt, [*by, "n"]).where("other <> n")


def rendered_edits(done: DataFrame, remembered: DataFrame, by: list[str], reach: int = 2) -> DataFrame:
    """done (by, n, before, after) -> (by, n, entry): an edit between the remembered lines (by, n, text: whole lines) around it.

    An edit whose own line isn't remembered has no context.
    """
    near = neighbours(remembered, done.join(remembered.select(*by, "n"), [*by, "n"], "left_semi"), by, reach).withColumn("text", context_line(F.col("text")))
    side = lambda which: F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("other", "text")))), lambda x: x["text"])
    sides = near.groupBy(*by, "n").agg(side(F.col("other") < F.col("n")).alias("_above"), side(F.col("other") > F.col("n")).alias("_below"))
    own = F.array(F.concat(F.lit("Original: "), "before"), F.concat(F.lit("Changed: "), "after"))
    none = F.array().cast("array<string>")
    return done.join(sides, [*by, "n"], "left").select(*by, "n", F.array_join(F.concat(F.coalesce("_above", none), own, F.coalesce("_below", none)), "\n").alias("entry"))


# Timing of words
def word_weight(word: Column) -> Column:
    """Letters and digits of a word, one at least (ASCII; functions.alignment has the Unicode key)."""
    return F.greatest(F.lit(1), F.length(F.regexp_replace(F.lower(word), "[^a-z0-9]", "")))


def _words(lines: DataFrame) -> DataFrame:
    parts = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return lines.withColumn("_n", F.size(parts)).select("*", F.posexplode(parts).alias("place", "word")).drop("text")


def proportional_timing(lines: DataFrame, by: list[str], places: int | None = 3) -> DataFrame:
    """lines (by, n, text, start, stop) -> (by, n, place, word, start, stop): a line's time dealt to its words by weight.

    The last word ends where the line does; `places` rounds, None doesn't.
    """
    order = Window.partitionBy(*by, "n").orderBy("place")
    own = _words(lines).withColumn("_w", word_weight(F.col("word")))
    own = own.withColumn("_upto", F.sum("_w").over(order)).withColumn("_all", F.sum("_w").over(Window.partitionBy(*by, "n")))
    span, near = F.greatest(F.col("stop") - F.col("start"), F.lit(0.0)), (lambda x: F.bround(x, places) if places is not None else x)
    begin, end = F.col("start") + span * (F.col("_upto") - F.col("_w")) / F.col("_all"), F.when(F.col("place") + 1 == F.col("_n"), F.greatest("start", "stop")).otherwise(F.col("start") + span * F.col("_upto") / F.col("_all"))
    return own.select(*by, "n", "place", "word", near(begin).alias("_a"), near(end).alias("_b")).withColumnsRenamed({"_a": "start", "_b": "stop"})


def uniform_timing(lines: DataFrame, by: list[str]) -> DataFrame:
    """The same with equal shares, of 0.001 seconds in all at least."""
    span, own = F.greatest(F.lit(0.001), F.col("stop") - F.col("start")), _words(lines)
    return own.select(*by, "n", "place", "word", F.bround(F.col("start") + span * F.col("place") / F.col("_n"), 3).alias("_a"), F.bround(F.col("start") + span * (F.col("place") + 1) / F.col("_n"), 3).alias("_b")).withColumnsRenamed({"_a": "start", "_b": "stop"})


def subword_timing(tokens: DataFrame, by: list[str]) -> DataFrame:
    """tokens (by, place, piece, at, line_start, line_end) -> (by, word_no, word, start, stop): words of an utterance from its subword pieces.

    Pieces that begin with space or a low block begin a word, unless they are punctuation alone;
    pieces in angle brackets are markup. A word ends where the next begins; the last one ends after
    the least gap between tokens, held between 0.02 and 1.12 seconds (0.32 where there is none).
    """
    clean = F.regexp_replace("piece", "^\\s*▁?", "")
    own = tokens.withColumn("_clean", clean).where((F.col("_clean") != "") & ~F.col("_clean").rlike("^<.*>$"))
    order, all_ = Window.partitionBy(*by).orderBy("place"), Window.partitionBy(*by)
    begins = F.col("piece").rlike("^(?:\\s|▁)") & ~F.col("_clean").rlike(r"^(?U)[\W_]+$")
    own = own.withColumn("word_no", F.sum((begins | (F.row_number().over(order) == 1)).cast("int")).over(order))
    step = F.col("at") - F.lag("at").over(Window.partitionBy(*by).orderBy("at"))
    own = own.withColumn("_gap", F.when(step > 0, step))
    own = own.withColumn("_span", F.least(F.lit(1.12), F.greatest(F.lit(0.02), F.coalesce(F.min("_gap").over(all_), F.lit(0.32)))))
    words = own.groupBy(*by, "word_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "_clean"))), lambda x: x["_clean"]), "").alias("word"), F.min_by("at", "place").alias("_at"), F.max_by("at", "place").alias("_last"), F.max("_span").alias("_span"), F.max("line_start").alias("_low"), F.max("line_end").alias("_high"))
    start = F.bround(F.greatest("_low", "_at"), 3)
    follows = F.coalesce(F.lead("_at").over(Window.partitionBy(*by).orderBy("word_no")), F.col("_last") + F.col("_span"))
    return words.select(*by, "word_no", "word", start.alias("start"), F.bround(F.greatest(start, F.least("_high", follows)), 3).alias("stop"))


def committed(lines: DataFrame, by: list[str]) -> DataFrame:
    """Lines as they are logged: empty ones dropped, speakers in lower case, times rounded to the millisecond."""
    times = [F.bround(c, 3).alias(c) for c in ("start", "stop") if c in lines.columns]
    return lines.where(F.trim("text") != "").select(*by, "n", F.lower(F.trim("speaker")).alias("speaker"), F.trim("text").alias("text"), *times)


def changes(log: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value isn't empty and differs from that of the row before."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return log.withColumn("_before", before).where((F.col(value) != "") & ~F.col(value).eqNullSafe(F.col("_before"))).drop("_before")
