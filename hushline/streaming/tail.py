"""Tail of a growing JSONL file as a stream source: complete lines since the last batch.

A batch ends before the first line that is no JSON or not yet closed by a line end, and tries it
again next time. A missing file gives no rows. Register with `spark.dataSource.register(TailSource)`,
then `spark.readStream.format("jsonl_tail").option("path", p)`. For many or large logs use the file
source over rotated files instead: this one reads on the driver, at most `max_bytes` a batch.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

MAX_BYTES = 8 << 20


def complete_lines(path: str, begin: int, most: int = MAX_BYTES, end: int | None = None) -> tuple[list[str], int]:
    """Lines from byte `begin` that are whole JSON values, and the byte after them; a line over `most` is read whole."""
    if not os.path.isfile(path):
        return [], begin
    out, at = [], begin
    with open(path, "rb") as f:
        f.seek(begin)
        while (end is None or at < end) and at - begin < most:
            raw = f.readline()
            if not raw.endswith(b"\n"):
                break
            try:
                text = raw.decode("utf-8").strip()
                if text:
                    json.loads(text)
            except ValueError:
                break
            at += len(raw)
            if text:
                out.append(text)
    return out, at


class TailReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("max_bytes", MAX_BYTES))

    def initialOffset(self) -> dict:
        return {"bytes": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        found, at = complete_lines(self.path, start["bytes"], self.most)
        return iter([(x,) for x in found]), {"bytes": at}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        found, _ = complete_lines(self.path, start["bytes"], end["bytes"] - start["bytes"], end["bytes"])
        return iter([(x,) for x in found])

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return "line string"

    def simpleStreamReader(self, schema) -> TailReader:
        return TailReader(self.options)
