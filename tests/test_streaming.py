"""Windows kept between batches, and the tail source."""

import json

import numpy as np
import pytest

from hushline.streaming.control import controlled, profiles
from hushline.streaming.tail import TailSource, complete_lines
from hushline.streaming.windows import advance, windows

NEW = ([], 0, 0, None)


def test_advance():
    state, out = advance(NEW, [(1, 4, False), (2, 7, False), (3, 20, False), (4, 1, False)], 10, 0.0, 0)
    assert out == [(0, [1], 4, "token_budget"), (1, [2], 7, "token_budget"), (2, [3], 20, "token_budget")] and state[0] == [4]
    state, out = advance(state, [(5, 2, False)], 10, 6.0, 5)
    assert out == [(3, [4], 1, "buffer_age")] and state == ([5], 2, 4, 6.0)
    assert advance(state, [(0, None, True)], 10, 7.0, 5) == (([], 0, 5, None), [(4, [5], 2, "end_of_input")])
    assert advance(NEW, [(0, None, True)], 10, 7.0, 5) == (NEW, [])


def test_windows_over_batches(spark, tmp_path):
    shape = "conv_id long, line_no int, tokens int, last boolean"
    source, out = tmp_path / "in", str(tmp_path / "out")

    def feed(name, rows):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(source))
        query = windows(spark.readStream.schema(shape).parquet(str(source)), budget=10).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out)
        query.awaitTermination(120)

    feed("a", [(1, 2, 7, False), (1, 1, 4, None), (2, 1, 3, False)])
    feed("b", [(1, 3, 3, False), (2, None, None, True), (1, 4, 1, False)])
    got = {(r.conv_id, r.window_id, tuple(r.lines), r.tokens, r.reason) for r in spark.read.parquet(out).collect()}
    assert got == {(1, 0, (1,), 4, "token_budget"), (1, 1, (2, 3), 10, "token_budget"), (2, 0, (1,), 3, "end_of_input")}


def test_tail(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    assert complete_lines(str(p), 0) == ([], 0)
    p.write_text('{"a": 1}\n\n{"a": 2}\n{"a":')
    assert complete_lines(str(p), 0) == (['{"a": 1}', '{"a": 2}'], 19)
    spark.dataSource.register(TailSource)

    def drain():
        stream = spark.readStream.format("jsonl_tail").option("path", str(p)).load()
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).start(str(tmp_path / "o"))
        query.processAllAvailable()
        query.stop()
        return sorted(json.loads(r.line)["a"] for r in spark.read.parquet(str(tmp_path / "o")).collect())

    assert drain() == [1, 2]
    with p.open("a") as f:
        f.write(' 3}\nbroken\n{"a": 4}\n')
    assert drain() == [1, 2, 3]


def run_batches(spark, folder, shape, make, *batches):
    for rows in batches:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        query = make(spark.readStream.schema(shape).parquet(str(folder / "in"))).writeStream.format("parquet").option("checkpointLocation", str(folder / "c")).trigger(availableNow=True).start(str(folder / "o"))
        query.awaitTermination(120)
    return spark.read.parquet(str(folder / "o")).orderBy("seq").collect()


def test_controller(spark, tmp_path):
    with pytest.raises(ValueError, match="watermark"):
        controlled(spark.range(1), "id", 2, 2, 1.0)
    got = run_batches(spark, tmp_path, "q string, seq long, depth int, age double", lambda s: controlled(s, "q", 5, 2, 60.0), [("a", 2, 6, None), ("a", 1, 5, 59.0)], [("a", 3, 2, 1.0), ("a", 4, 1, 60.0), ("a", 5, 1, None), ("a", 6, 0, 60.0)])
    assert [(r.state, r.reason) for r in got] == [("background", None), ("promoted", "high_watermark"), ("promoted", None), ("promoted", None), ("background", "low_watermark"), ("promoted", "timeout")]


def test_profiles(spark, tmp_path):
    def embed(x):
        return np.array([float(x.mean()), 1.0]) if x.any() else None

    def speech(seq, value, n, last=False):
        return ("s", seq, [float(value)] * n, last)

    got = run_batches(spark, tmp_path, "who string, seq long, samples array<float>, last boolean", lambda s: profiles(s, "who", embed, 1.0), [speech(1, 1, 10_000)], [speech(2, 1, 6_000), speech(3, 0, 16_000), speech(4, 4, 8_000, True), speech(5, 4, 10, True)])
    assert [(r.seq, r.seconds) for r in got] == [(2, 1.0), (4, 1.5)]
    assert np.allclose(got[0].profile, np.array([1, 1]) / 2**0.5) and np.allclose(got[1].profile, np.array([2, 1]) / 5**0.5)
