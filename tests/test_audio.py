"""Track listing, PCM blocks, decoders."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from hushline import catalog
from hushline.sources import audio


def test_track_files(spark, tmp_path):
    with pytest.raises(ValueError, match="no "):
        audio.track_files(spark, str(tmp_path))
    for name in ("a.mkv", "b.c.mkv", "other.txt"):
        (tmp_path / name).write_bytes(b"12345")
    assert [(r.track_id, r.bytes) for r in audio.track_files(spark, str(tmp_path)).orderBy("track_id").collect()] == [("a", 5), ("b.c", 5)]
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "a.mkv").write_bytes(b"1")
    with pytest.raises(ValueError, match="twice: a"):
        audio.track_files(spark, str(tmp_path))


def test_pcm_blocks(spark):
    x = np.arange(-5, 6, dtype="<i2") * 1000
    files = spark.createDataFrame([("a", bytearray(x.tobytes())), ("b", bytearray()), ("c", None)], "k string, content binary")
    got = audio.pcm_blocks(files, "k", seconds=0.5, rate=8).select("*", audio.samples(F.col("pcm")).alias("x")).orderBy("block").collect()
    assert [(r.k, r.block, r.start_seconds, len(r.x)) for r in got] == [("a", 0, 0.0, 4), ("a", 1, 0.5, 4), ("a", 2, 1.0, 3)]
    assert np.allclose(np.concatenate([r.x for r in got]), x / 32768)
    with pytest.raises(Exception, match="half a sample at the end of d"):
        audio.pcm_blocks(spark.createDataFrame([("d", bytearray(b"abc"))], "k string, content binary"), "k").collect()


def test_decoder(spark):
    files = spark.createDataFrame([("a", bytearray(b"\x01\x03")), ("n", None)], "k string, content binary")
    got = audio.decoded(files, "k", lambda b: np.array([list(b), [0] * len(b)], float)).collect()
    assert [(r.k, r.samples) for r in got] == [("a", [0.5, 1.5])]


def test_queries_without_sql(spark):
    words = catalog.queries()["retimed_turns"](spark, "/root/testdata/sf0.001").where("kept").count()
    pairs = catalog.queries()["channel_matching"](spark, "/root/testdata/sf0.001").collect()
    assert words > 100 and len({(r.user_id, r.channel) for r in pairs}) == len(pairs) == len({(r.user_id, r.speaker) for r in pairs})
