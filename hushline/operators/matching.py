"""Greedy one-to-one matching of separated channels to known speakers, per key.

A pair's strength is its similarity plus half its lead over the channel's next best free speaker;
leads change as speakers are taken, so the rounds are sequential. A key holds a few channels and
speakers (three each in a conversation), which bounds a group; all keys go side by side.
"""

from __future__ import annotations

from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MINIMUM = 0.3
OUT = pa.list_(pa.struct([("channel", pa.int64()), ("speaker", pa.string()), ("method", pa.string()), ("similarity", pa.float64()), ("margin", pa.float64())]))


def greedy(similarity: dict[tuple[int, str], float], channels: set[int], speakers: set[str], minimum: float = MINIMUM) -> list[dict]:
    """Strongest pair first (ties: greater similarity, lead, channel, name), down to `minimum`; the rest are paired in order.

    A rest of one channel is `elimination` if any pair was matched, any other rest `ambiguous`.
    """
    channels, speakers, out = set(channels), set(speakers), []
    while channels and speakers:
        offers = []
        for c in channels:
            ranked = sorted((-similarity[c, s], s) for s in speakers if (c, s) in similarity)
            leads = [b - a for (a, _), (b, _) in pairwise(ranked)] + [0.0]
            offers += [(lead / 2 - x, -x, lead, c, s) for (x, s), lead in zip(ranked, leads, strict=False)]
        if not offers or (best := max(offers))[1] < minimum:
            break
        _, x, lead, c, s = best
        out.append({"channel": c, "speaker": s, "method": "fingerprint", "similarity": round(x, 6), "margin": round(lead, 6)})
        channels.discard(c)
        speakers.discard(s)
    method = "elimination" if out and len(channels) == 1 else "ambiguous"
    out += [{"channel": c, "speaker": s, "method": method} for c, s in zip(sorted(channels), sorted(speakers), strict=False)]
    return sorted(out, key=lambda m: m["channel"])


def matched(pairs: DataFrame, key: str, minimum: float = MINIMUM) -> DataFrame:
    """(key, channel, speaker, similarity or null where no profile is known) -> key, channel, speaker, method, similarity, margin.

    Of repeated pairs the greatest similarity counts; rows without channel or speaker are left out.
    """
    own = pairs.where("channel IS NOT NULL AND speaker IS NOT NULL").groupBy(key, "channel", "speaker").agg(F.max("similarity").alias("similarity"))
    groups = own.groupBy(key).agg(F.collect_list(F.struct(F.col("channel").cast("long").alias("channel"), "speaker", F.col("similarity").cast("double").alias("similarity"))).alias("pairs"))

    def run(batches):
        for b in batches:
            found = []
            for rows in b.column(1).to_pylist():
                known = {(r["channel"], r["speaker"]): r["similarity"] for r in rows if r["similarity"] is not None}
                found.append(greedy(known, {r["channel"] for r in rows}, {r["speaker"] for r in rows}, minimum))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, OUT)], [key, "m"])

    shape = "array<struct<channel:bigint,speaker:string,method:string,similarity:double,margin:double>>"
    return groups.mapInArrow(run, f"{key} {pairs.schema[key].dataType.simpleString()}, m {shape}").select(key, F.explode("m").alias("m")).select(key, "m.*")
