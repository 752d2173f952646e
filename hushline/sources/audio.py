"""Audio as rows: track files by name, 16-bit PCM in blocks, samples as arrays. Other codecs need an injected decoder."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RATE, SCALE = 16_000, 32_768


def track_files(spark: SparkSession, folder: str, ending: str = "mkv") -> DataFrame:
    """track_id (the name without its ending), file, bytes. No file, or a name twice, raises ValueError.

    Contents are not read: only the columns of the listing are asked for. Files of no bytes are not listed.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{ending}").load(folder)
    files = read.select(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("track_id"), F.col("path").alias("file"), F.col("length").alias("bytes"))
    if files.isEmpty():
        raise ValueError(f"no *.{ending} in {folder}")
    twice = [r[0] for r in files.groupBy("track_id").count().where("count > 1").orderBy("track_id").select("track_id").limit(10).collect()]
    if twice:
        raise ValueError("names that occur twice: " + ", ".join(twice))
    return files


def pcm_blocks(files: DataFrame, key: str, content: str = "content", seconds: float = 5.0, rate: int = RATE) -> DataFrame:
    """key, block from 0, start_seconds, pcm: bytes in blocks of equal length, the last one as it comes. Empty contents have none."""
    size = max(1, round(seconds * rate)) * 2
    n = F.length(content)
    even = F.when(n % 2 == 0, n).otherwise(F.raise_error(F.concat(F.lit("half a sample at the end of "), F.col(key).cast("string"))).cast("int"))
    cut = files.where(n > 0).select(key, content, F.explode(F.sequence(F.lit(0), F.ceil(even / size).cast("int") - 1)).alias("block"))
    return cut.select(key, "block", (F.col("block") * (size / 2 / rate)).alias("start_seconds"), F.col(content).substr(F.col("block") * size + 1, F.lit(size)).alias("pcm"))


def samples(pcm: Column) -> Column:
    """array<float> in [-1, 1) of little-endian 16-bit samples; null stays null."""

    @F.pandas_udf("array<float>")
    def decoded(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else np.frombuffer(b, "<i2").astype(np.float32) / SCALE)

    return decoded(pcm)


def decoded(files: DataFrame, key: str, decoder: Callable[[bytes], np.ndarray], content: str = "content") -> DataFrame:
    """key, samples: each file by the decoder; several channels (rows of a matrix) become their mean."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        found = (decoder(bytes(b)) for b in s)
        return pd.Series([(x.mean(axis=0) if x.ndim > 1 else x).astype(np.float32) for x in found], index=s.index)

    return files.where(F.col(content).isNotNull()).select(key, run(F.col(content)).alias("samples"))
