"""Greedy token-budget windows over a conversation's lines.

A window takes lines while it is empty or stays within the budget; one line over the budget is a
window of its own. The running total restarts at data-dependent places, so no plain window function
expresses it: lines are folded per conversation, and the fold carries only sizes and window starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUDGET = 264


def token_count(text: F.Column) -> F.Column:
    """Words between single spaces; any column expression can stand in."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1


def causal_windows(lines: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(conv_id, line_no, tokens) -> (conv_id, line_no, window_id from 0), one shuffle on conv_id."""
    ordered = lines.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "tokens"))).alias("l"))
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("id"), F.array().cast("array<int>").alias("ids"))

    def step(a, x):
        flush = (a["used"] > 0) & (a["used"] + x["tokens"] > budget)
        used = F.when(flush, x["tokens"]).otherwise(a["used"] + x["tokens"]).cast("int")
        window = (a["id"] + flush.cast("int")).cast("int")
        return F.struct(used.alias("used"), window.alias("id"), F.concat(a["ids"], F.array(window)).alias("ids"))

    folded = ordered.select("conv_id", "l", F.aggregate("l", start, step, lambda a: a["ids"]).alias("ids"))
    return folded.select("conv_id", F.explode(F.arrays_zip("l", "ids")).alias("z")).select("conv_id", F.col("z.l.line_no").alias("line_no"), F.col("z.ids").alias("window_id"))
