"""Slabs: texts in compressed Arrow files of bounded bytes, for operators that pass over them more than once.

A map task cuts its rows into slabs of about `each` bytes and writes every slab to the shared
folder under a name of its own; the index, written as a table, names the files of the attempts that
counted. Later passes read a slab by its name, so texts are stored once and shuffled never, and a
slab's size doesn't depend on ids, sources or row counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, text_of, written

SLAB_BYTES = 8 << 20
INDEX = "slab long, file string, rows long, bytes long, measure long"


def place(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a folder given as a path or a URI."""
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_table(table: pa.Table, fs: pyarrow.fs.FileSystem, path: str) -> None:
    with fs.open_output_stream(path) as sink, pa.ipc.new_file(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table, max_chunksize=2000)


def read_table(folder: str, name: str, columns: list[str] | None = None) -> pa.Table:
    fs, path = place(folder)
    with fs.open_input_file(f"{path}/{name}") as source:
        schema = pa.ipc.open_file(source).schema
        options = pa.ipc.IpcReadOptions(included_fields=[schema.get_field_index(c) for c in columns]) if columns else None
        return pa.ipc.open_file(source, options=options).read_all()


def by_bytes(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first, length) of runs of rows of about `most` bytes, a row at least."""
    sizes, k = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)), 0
    while k < len(sizes):
        end = max(k + 1, int(np.searchsorted(sizes, (int(sizes[k - 1]) if k else 0) + most, side="right")))
        yield k, end - k
        k = end


def slabs(docs: DataFrame, kind: str, each: int = SLAB_BYTES, measure: Callable[[pa.Table], int] | None = None, side: Callable[[pa.Table], tuple[pa.Table, pa.Table]] | None = None) -> tuple[DataFrame, str]:
    """docs (doc_id, text) -> the index (INDEX) of its slabs, and the folder of their files (doc_id, text).

    `measure` gives a number of each slab for the index. `side` may order a slab's rows and make a
    table of its own from them, which is kept beside it as `<file>.side`. Null texts become empty.
    An empty table has no slabs.
    """
    folder = fresh_path(docs.sparkSession, kind)

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        (fs, path), held, size = place(folder), [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, n
            if not n:
                fs.create_dir(path, recursive=True)
            table, name = pa.concat_tables(held).combine_chunks(), f"{part:06d}-{n:06d}-{uuid.uuid4().hex}.arrow"
            if side:
                table, more = side(table)
                write_table(more, fs, f"{path}/{name}.side")
            write_table(table, fs, f"{path}/{name}")
            row = ((part << 32) + n, name, table.num_rows, size, measure(table) if measure else 0)
            held, size, n = [], 0, n + 1
            return pa.RecordBatch.from_pylist([dict(zip(("slab", "file", "rows", "bytes", "measure"), row, strict=True))], schema=pa.schema([("slab", pa.int64()), ("file", pa.string()), ("rows", pa.int64()), ("bytes", pa.int64()), ("measure", pa.int64())]))

        for b in batches:
            table = pa.table([b.column(0), b.column(1).cast(pa.large_string())], ["doc_id", "text"])
            for k, rows in by_bytes(b.column(1), each // 4):
                held.append(table.slice(k, rows))
                size += pc.sum(pc.binary_length(held[-1].column("text"))).as_py() or 0
                if size >= each:
                    yield flush()
        if held:
            yield flush()

    index = written(docs.select("doc_id", text_of().alias("text")).mapInArrow(run, INDEX), f"{kind}-index")
    return index, folder


def dealt(rows: DataFrame, count: int, by: str = "slab") -> DataFrame:
    """rows dealt to `count` tasks by a slab or range, so that tasks grow in number with the data, not in size."""
    return rows.repartition(max(1, count), F.col(by))
