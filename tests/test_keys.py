"""Key wrapping, sealing and release."""

import pytest
from pyspark.sql import functions as F

from hushline.functions import keys

LABEL = b"tests"


@pytest.fixture(scope="module")
def pair(spark):
    return keys.key_pair(spark, 3072)


def test_wrap(spark, pair):
    key = keys.fresh_key()
    wrapped = keys.wrap(spark, key, pair[0], LABEL)
    assert keys.unwrap(spark, wrapped, pair[1], LABEL) == key
    assert wrapped != keys.wrap(spark, key, pair[0], LABEL)
    with pytest.raises(Exception, match="BadPadding"):
        keys.unwrap(spark, wrapped, pair[1], b"other")
    with pytest.raises(ValueError, match="256-bit"):
        keys.unwrap(spark, keys.wrap(spark, b"short", pair[0], LABEL), pair[1], LABEL)
    with pytest.raises(ValueError, match="3072"):
        keys.wrap(spark, key, keys.key_pair(spark, 2048)[0], LABEL)
    assert len(keys.fingerprint(pair[0])) == 64


def test_protect_and_release(spark, pair, tmp_path):
    tracks = spark.createDataFrame([("t1", "a.bin", bytearray(b"one"), "x"), ("t2", "b.bin", bytearray(b""), "y"), ("t3", "c.bin", bytearray(b"three"), "z")], "track_id string, source_file string, plain binary, aad string")
    sealed, manifest = keys.protect(tracks, pair[0], LABEL)
    sealed.write.parquet(str(tmp_path / "s"))
    sealed = spark.read.parquet(str(tmp_path / "s"))
    assert "key" not in sealed.columns and "plain" not in sealed.columns
    released = keys.release(spark, manifest, {"t1", "t2"}, pair[1], LABEL, "form 7")
    assert [t["track_id"] for t in released["approved_tracks"]] == ["t1", "t2"] and released["consent_reference"] == "form 7"
    assert {r.track_id: bytes(r.plain) for r in keys.open_released(sealed, released).collect()} == {"t1": b"one", "t2": b""}
    assert {r.track_id: bytes(r.plain) for r in keys.open_fingerprints(sealed, manifest, pair[1], LABEL).collect()} == {"t1": b"one", "t2": b"", "t3": b"three"}
    with pytest.raises(ValueError, match="t9"):
        keys.release(spark, manifest, {"t1", "t9"}, pair[1], LABEL, "form 7")
    changed = sealed.withColumn("aad", F.lit("w"))
    with pytest.raises(Exception, match="does not open: t"):
        keys.open_released(changed, released).collect()
