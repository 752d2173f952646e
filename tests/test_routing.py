"""Streams cut in batches against the batch operators on the whole."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushline.functions import signal
from hushline.operators import activity, lookups
from hushline.streaming.routing import pieces, routed

RND = random.Random(31)


def streamed(spark, tmp_path, batches, schema, plan, name):
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    query = plan(stream).writeStream.format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"{name}-c")).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_router(spark, tmp_path):
    p = np.array([[RND.choice((0.1, 0.2, 0.9, 0.9)) for _ in range(4)] for _ in range(80)])
    p[20:35] = [0.9, 0.9, 0.1, 0.1]
    rows = [("r", k, p[k].tolist(), k == 79) for k in range(80)]
    schema = "key string, frame long, probabilities array<double>, last boolean"
    got = streamed(spark, tmp_path, [rows[:1], rows[1:30], rows[30:31], rows[31:]], schema, lambda s: routed(s, "key", 0.5, 4), "router")
    frames = spark.createDataFrame([("r", s, k, float(p[k, s])) for k in range(80) for s in range(4)], "key string, slot int, frame long, p double")
    want = activity.routes(activity.activity(frames, ["key"]), ["key"], 10, 0.4).collect()
    assert sorted((r.slots, r.route, r["first"], r.last_frame) for r in got) == sorted((r.slots, r.route, r["first"], r["last"]) for r in want)
    eager = streamed(spark, tmp_path, [rows[:40], rows[40:]], schema, lambda s: routed(s, "key", 0.5, 4, eager=True), "eager")
    assert sum(r.last_frame - r["first"] + 1 for r in eager) == sum(r.last_frame - r["first"] + 1 for r in got)


def test_pieces(spark, tmp_path):
    at, rows = 0.0, []
    for k in range(60):
        at += RND.choice((0.0, 0.0, 0.0, 0.01, 3.0))
        rows.append(("s", k, at, at + RND.choice((0.5, 1.0, 2.0)), k == 59))
        at = rows[-1][3]
    schema = "key string, seq long, start double, stop double, last boolean"
    got = streamed(spark, tmp_path, [rows[:7], rows[7:8], rows[8:40], rows[40:]], schema, lambda s: pieces(s, "key", 0.02, 2.5), "pieces")
    want = lookups.gap_pieces(spark.createDataFrame(rows, schema), ["key"], 0.02, 2.5).collect()
    close = lambda rows: sorted((round(r.start, 6), round(r.stop, 6), r.boundary) for r in rows if r.stop - r.start > 1e-9)
    assert close(got) == close(want)


def test_workers_and_tracks(spark):
    given = spark.createDataFrame([(1, [1.0, 2.0]), (2, []), (3, None)], "k int, samples array<float>")

    def model():
        def split(x):
            if not len(x):
                raise ValueError("no audio")
            return [x / 2, x * 2]

        return split

    got = sorted((r.k, r.channel, r.samples, r.stage, r.error) for r in signal.worked(given, "k", "separate", model).collect() if r.elapsed_seconds >= 0)
    assert got == [(1, 0, [0.5, 1.0], "separate", None), (1, 1, [2.0, 4.0], "separate", None), (2, 0, None, "separate", "ValueError: no audio"), (3, 0, None, "separate", "ValueError: no audio")]
    parts = spark.createDataFrame([("t", 2, 5, [1.0, 2.0, 3.0]), ("t", 4, 6, [9.0, 8.0])], "track string, start long, stop long, samples array<float>")
    laid = activity.track_layout(parts, ["track"], spark.createDataFrame([("t", 8)], "track string, samples long")).join(parts, ["track", "start", "stop"])
    assert signal.track(laid, "track").first().samples == [0, 0, 1, 2, 3, 8, 0, 0]


def test_missing_frames_raise(spark, tmp_path):
    rows = [("r", k, [0.9], False) for k in (0, 2)]
    with pytest.raises(Exception, match="frame 1 is missing"):
        streamed(spark, tmp_path, [rows], "key string, frame long, probabilities array<double>, last boolean", lambda s: routed(s, "key", 0.5, 4), "missing")
    assert spark.range(1).select(F.lit(1)).count() == 1
