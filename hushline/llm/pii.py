"""Personal data: base patterns, and bootstrapped contextual extraction, in DataFrame functions only.

Seed entities, the base kinds and secrets of known form (hashes in hex, access keys, web tokens),
make a graph of lexical patterns and instances. A pattern is a kind and a context, of four shapes
with digits and spacing generalised: the two words before and the marks between, the word before
where marks set it off (`token = "`), the two words after, and the words on both sides. Rounds
alternate: a pattern's confidence is the share of its occurrences that are known instances of its
kind; an instance's score is the best confidence among its patterns. Patterns with confidence and
support enough make their unknown values instances of the kind, which lends support to further
patterns. The graph is kept pre-aggregated by (context, value), so a context or value that many
texts share is one row. Rounds end when one adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, text_of

ROUNDS, CONFIDENCE, SUPPORT, MARK, CONTEXT_CHARS = 3, 0.7, 3, "\x01", 60
KINDS, SEEDS = ("email", "ip", "card", "phone"), ("email", "ip", "card", "phone", "secret")

#: The base patterns, made linear: possessive where the next part excludes the class, and no start inside a run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9_-]{20,}+|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)(?![A-Za-z0-9])",
    "value": r"(?<![A-Za-z0-9_.@+/-])(?=[A-Za-z_.@+/-]*[0-9@])[A-Za-z0-9_.@+/-]{5,}+",
}
GATES = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9]", "secret": r"[0-9a-f]{32}|AKIA|gh[pousr]_|xox[abprs]-|sk-|eyJ", "value": r"[0-9@]"}


def _valid(kind: F.Column, hit: F.Column) -> F.Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    parts = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    ip = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))
    back = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.try_cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    luhn = F.aggregate(back, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0
    n = F.length(digits)
    return F.when(kind == "ip", ip).when(kind == "card", F.when(n.between(16, 19), luhn).otherwise(False)).when(kind == "phone", n.between(8, 15)).when(kind == "value", n + 4 * F.instr(hit, "@") >= 4).otherwise(True)


def _contexts() -> F.Column:
    """The contexts of a match, from `tail` before and `head` after it."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "#")
    words = lambda c: F.filter(F.split(plain(c), r"[^\p{L}\p{N}#_]+"), lambda x: x != "")
    marks = lambda c, at: F.right(F.regexp_replace(F.regexp_extract(plain(c), at, 1), r"\s+", ""), F.lit(4))
    before, after, left, right = words("tail"), words("head"), marks("tail", r"([^\p{L}\p{N}#_]*)$"), marks("head", r"^([^\p{L}\p{N}#_]*)")
    last, first = F.try_element_at(before, F.lit(-1)), F.try_element_at(after, F.lit(1))
    return F.array_compact(F.array(
        F.when(F.size(before) >= 2, F.concat(F.lit("before "), F.try_element_at(before, F.lit(-2)), F.lit(" "), last, F.lit(" "), left)), F.when((F.size(before) >= 1) & (left != ""), F.concat(F.lit("marked "), last, F.lit(" "), left)),
        F.when(F.size(after) >= 2, F.concat(F.lit("after "), right, F.lit(" "), first, F.lit(" "), F.try_element_at(after, F.lit(2)))), F.when((F.size(before) >= 1) & (F.size(after) >= 1), F.concat(F.lit("between "), last, F.lit(" "), left, F.lit(" "), right, F.lit(" "), first)),
    ))


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, _hash, kind, start, end, hit, contexts) of every valid match; kind `value` for candidates.

    A secret that overlaps a base match is left out, and so is a candidate that overlaps a base
    match or a secret: it is the same occurrence seen twice. Places are in code points. Only texts
    with a digit or an at sign are looked at. Rows with equal doc_id and text share their mentions.
    The text between matches is reduced to its length and its ends before it is dealt out.
    """
    own = docs.select("doc_id", text_of().alias("_text")).where(F.col("_text").rlike("[0-9@]"))
    own = own.select("doc_id", F.xxhash64("_text").alias("_hash"), F.translate("_text", MARK, "\x02").alias("_text"))
    tried = []
    for kind, regex in PATTERNS.items():
        pieces = F.split(F.regexp_replace("_text", regex, f"{MARK}$0{MARK}"), MARK, -1)
        between = lambda f: lambda p, i: F.when(i % 2 == 0, f(p, F.lit(CONTEXT_CHARS)))
        cells = F.transform(pieces, lambda p, i: F.struct(F.length(p).alias("n"), F.when(i % 2 == 1, p).alias("hit"), between(F.right)(p, i).alias("tail"), between(F.left)(p, i).alias("head")))
        tried.append(F.when(F.col("_text").rlike(GATES[kind]), F.struct(F.lit(kind).alias("kind"), cells.alias("cells"))))
    kinds = own.select("doc_id", "_hash", F.explode(F.array_compact(F.array(*tried))).alias("x")).select("doc_id", "_hash", "x.kind", "x.cells").where(F.size("cells") > 1)
    cells = kinds.select("doc_id", "_hash", "kind", F.posexplode("cells").alias("at", "c")).select("doc_id", "_hash", "kind", "at", "c.*").dropDuplicates(["doc_id", "_hash", "kind", "at"])
    w = Window.partitionBy("doc_id", "_hash", "kind").orderBy("at")
    placed = cells.withColumn("end", F.sum("n").over(w)).withColumn("tail", F.lag("tail").over(w)).withColumn("head", F.lead("head").over(w)).where("hit IS NOT NULL")
    valid = placed.where(_valid(F.col("kind"), F.col("hit"))).select("doc_id", "_hash", "kind", (F.col("end") - F.col("n")).alias("start"), "end", "hit", _contexts().alias("contexts"))
    by = Window.partitionBy("doc_id", "_hash")

    def clear(kinds: tuple[str, ...]) -> F.Column:
        """Whether no other match of these kinds overlaps: of those that start here or before, the reach; of those after, the first."""
        one = F.col("kind").isin(*kinds)
        reach = F.max(F.when(one, F.col("end"))).over(by.orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
        following = F.min(F.when(one, F.col("start"))).over(by.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0))
        return F.coalesce(reach <= F.col("start"), F.lit(True)) & F.coalesce(following >= F.col("end"), F.lit(True))

    marked = valid.select("*", clear(KINDS).alias("_base"), clear(SEEDS).alias("_seed"))
    return marked.where(F.col("kind").isin(*KINDS) | ((F.col("kind") == "secret") & F.col("_base")) | ((F.col("kind") == "value") & F.col("_seed"))).drop("_base", "_seed")


def discover(found: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """mentions -> patterns (kind, context, confidence) and instances (kind, value, score) after the rounds.

    A pattern needs `support` distinct known values of its kind and at least `confidence`, counted
    as known occurrences over all occurrences plus one. A value takes the kind of its best pattern
    (ties: the first kind by name).
    """
    edges = cut(found.select(F.explode("contexts").alias("context"), F.lower("hit").alias("value"), "kind").groupBy("context", "value", "kind").agg(F.count("*").alias("n")))
    totals = edges.groupBy("context").agg(F.sum("n").alias("total"))
    seeds = edges.where("kind <> 'value'").select("kind", "value").distinct().withColumn("score", F.lit(1.0))
    known, patterns, last = seeds, None, None
    occurrences = edges.groupBy("context", "value").agg(F.sum("n").alias("n"))
    for _ in range(rounds):
        backed = occurrences.join(known, "value").groupBy("kind", "context").agg(F.sum(F.col("n") * F.col("score")).alias("backed"), F.count("*").alias("values")).where(F.col("values") >= support)
        patterns = cut(backed.join(totals, "context").select("kind", "context", (F.col("backed") / (F.col("total") + 1)).alias("confidence")).where(F.col("confidence") >= confidence))
        new = edges.where("kind = 'value'").select("context", "value").join(patterns, "context").join(seeds.select("value"), "value", "left_anti")
        best = cut(new.groupBy("value").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "kind")).alias("b")).select("b.kind", "value", (-F.col("b.c")).alias("score")))
        known, now = seeds.unionByName(best), best.agg(F.count("*"), F.sum(F.round("score", 9))).first()
        if not now[0] or now == last:
            break
        last = now
    return patterns, known


def personal_data(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> one row per row: n_email, n_ip, n_card, n_phone of the base, base_sha256, spans, n_spans.

    Null and empty texts have no spans: counts 0, the hash of an empty string, an empty string.
    Spans that the method adds, secrets and discovered instances, overlap no base span; an instance
    carries the kind of its patterns, secrets come after the base kinds. Rows that repeat a doc_id,
    null or not, count each by its own text. Very long texts are taken whole, each in one row until
    its matches are dealt out. Other columns are ignored, whatever their names. An empty table gives
    an empty table.
    """
    found = cut(mentions(docs))
    patterns, known = discover(found)
    sure = found.where("kind <> 'value'").select("doc_id", "_hash", "kind", "start", "end", F.col("kind").isin(*KINDS).alias("base"))
    more = found.where("kind = 'value'").select("doc_id", "_hash", "start", "end", F.lower("hit").alias("value"), F.explode("contexts").alias("context"))
    more = more.join(known.where("score < 1").select("kind", "value"), "value").join(patterns.select("kind", "context"), ["kind", "context"], "left_semi").select("doc_id", "_hash", "kind", "start", "end", F.lit(False).alias("base")).distinct()
    span = F.struct(F.array_position(F.array(*map(F.lit, SEEDS)), F.col("kind")).alias("k"), "start", "end", "kind")
    counts = [F.count_if((F.col("kind") == k) & F.col("base")).alias(f"n_{k}") for k in KINDS]
    spans = sure.unionByName(more).groupBy("doc_id", "_hash").agg(*counts, F.count("*").alias("n_spans"), F.collect_list(F.when(F.col("base"), span)).alias("_base"), F.collect_list(span).alias("_all"))
    line = "array_join(transform(array_sort({}), x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    spans = spans.withColumn("_base", F.expr(line.format("_base"))).withColumn("spans", F.expr(line.format("_all")))
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("_hash"))
    both = rows.join(spans.drop("_all").withColumnRenamed("doc_id", "_id").withColumnRenamed("_hash", "_h"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")), "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return both.select("doc_id", *[count(f"n_{k}") for k in KINDS], F.sha2(F.coalesce("_base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), count("n_spans"))
