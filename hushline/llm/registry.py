"""The corpus operators' queries and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushline.session import ship

from . import decontaminate, licenses, lm, mixing, pii, quality, rules, simhash, suffixes, tokens
from .common import documents, text_of, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.lm_scores(documents(spark, sf_dir))
    return scored.select("doc_id", "n_words", F.round("score", 3).alias("score"), F.round("mean_score", 5).alias("mean_score"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(documents(spark, sf_dir))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op6_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(documents(spark, sf_dir), texts_too=False)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = quality.scored(docs.select("doc_id", "text"), quality.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    sized = written(docs.select("doc_id", "source", mixing.word_count(text_of()).alias("words"), F.xxhash64(text_of()).alias("of_text")), "mix-sizes")
    return mixing.mix(sized, size=F.col("words")).select("doc_id", "size", "source_size", "target", "taken")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_QUERIES = (op1_lm_scoring, op2_license_scan, op3_token_files, op4_personal_data, op5_decontamination, op6_repeated_strings, op7_quality, op8_near_duplicates, op9_quality_rules, op10_mixing, pipeline)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: lambda spark, sf_dir, q=q: q(ship(spark), sf_dir) for q in _QUERIES}


_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_LM = rf"""
WITH w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
p AS (SELECT doc_id, i, words[i] AS c, CASE WHEN i > 1 THEN words[i-1] END AS b, CASE WHEN i > 2 THEN words[i-2] END AS a FROM w, unnest(range(1, len(words) + 1)) AS t(i)),
n1 AS (SELECT c, count(*) AS n FROM p GROUP BY ALL),
n2 AS (SELECT b, c, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY ALL),
n3 AS (SELECT a, b, c, count(*) AS n FROM p WHERE a IS NOT NULL GROUP BY ALL),
s AS (SELECT p.doc_id, CASE WHEN n3.n >= 2 THEN ln(n3.n / x2.n) WHEN n2.n >= 2 THEN ln(0.4) + ln(n2.n / x1.n) ELSE 2 * ln(0.4) + ln(n1.n / (SELECT count(*) FROM p)) END AS s
  FROM p JOIN n1 ON p.c = n1.c LEFT JOIN n2 ON p.b = n2.b AND p.c = n2.c LEFT JOIN n3 ON p.a = n3.a AND p.b = n3.b AND p.c = n3.c
  LEFT JOIN n2 x2 ON p.a = x2.b AND p.b = x2.c LEFT JOIN n1 x1 ON p.b = x1.c)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, round(coalesce(t.s, 0.0), 3) AS score, round(t.s / len(words), 5) AS mean_score
FROM w LEFT JOIN (SELECT doc_id, sum(s) AS s FROM s GROUP BY 1) t ON w.doc_id = t.doc_id
"""

_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
b AS (SELECT doc_id, host, text, {_WORDS.format("text")} AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS k FROM b, unnest(range(1, CAST(len(words) AS BIGINT) - 6)) AS t(i)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
c AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY 1),
l AS (SELECT doc_id, host, lower(trim(x, ' ' || chr(9) || chr(13))) AS line, len({_WORDS.format("x").replace("lambda x: x", "lambda y: y")}) AS words FROM (SELECT doc_id, host, unnest(lines) AS x FROM b)),
h AS (SELECT host, count(*) AS docs FROM d GROUP BY 1),
m AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT doc_id) AS n FROM l GROUP BY ALL) JOIN h USING (host) WHERE n > {rules.LINE_DOCS} AND n > {rules.LINE_SHARE} * docs),
o AS (SELECT doc_id, sum(words) AS n FROM l JOIN m USING (host, line) GROUP BY 1),
f AS (SELECT b.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(words) - coalesce(o.n, 0) AS BIGINT) AS n_left
  FROM b LEFT JOIN c ON b.doc_id = c.doc_id LEFT JOIN o ON b.doc_id = o.doc_id)
SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT} * n_words AS base_failed,
  NOT (n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT} * n_words) AND n_left >= {rules.MIN_WORDS} AND n_left >= {rules.LEFT_SHARE} * n_words AS kept FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_lm_scoring": _LM, "op9_quality_rules": _RULES}
