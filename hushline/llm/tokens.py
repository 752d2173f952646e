"""Token ids as Arrow stream files of fixed-size lists, for zero-copy random access.

Documents are dealt by ranges of (doc_id, hash of the text), so a file holds a run of the global
order and rows of one id need not stay together. A task encodes its documents, appends the end id to
each, and cuts the run into sequences of equal length; a file ends with the document that fills it.
Each record batch has two columns, `ids` and `mask`, as fixed-size lists (the mask is false on the
padding of a file's last sequence), and all but the last hold BATCH sequences, so sequence i lies
in a known place of the mapped file: SequenceFile gives it without reading or copying the rest. A
task writes under a name of its own attempt and the index names the file, so a rerun of a lost task
leaves no mixed files.

A text is encoded through its pieces between spaces and line ends: the tokenizer's rules never
reach across them (white space is dropped and splits words), so each distinct piece is encoded
once per task and the ids are gathered in Arrow. That is checked against whole-text encoding.
"""

from __future__ import annotations

import json
import math
import os
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_path, text_of, written
from .slabs import by_bytes, place

END, SEQUENCE, BATCH, PART_BYTES, FILE_IDS, SLICE_BYTES, GATHER_WORDS = 2, 1024, 256, 12 << 20, 4 << 20, 8 << 20, 200_000
#: Letters that stay letters when composed and lower-cased (some others end in a mark then, which joins a stop).
LETTERS = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}\x{391}-\x{3A1}\x{3A3}-\x{3C9}\x{400}-\x{481}\x{4E00}-\x{9FFF}"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Encodes texts by distinct stems; keeps a bounded table of the stems seen, as flat arrays.

    A stem is a piece without the comma or full stop after a last letter (LETTERS), a word of its
    own to the tokenizer; an ASCII piece is lower-cased first, as the tokenizer does. Stems of
    a-z alone are one word each, so the model without its normaliser gives their ids, and the
    tokens that end a word tell them apart.
    """

    def __init__(self, path: str, keep: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        suffix, steps = spec["model"].get("end_of_word_suffix"), [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.plain = bool(suffix) and steps == ["NFC", "Replace", "Lowercase"]
        if self.plain:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[k for w, k in spec["model"]["vocab"].items() if w.endswith(suffix)]] = True
        del spec
        self._forget()

    @contextmanager
    def _by_words_alone(self) -> Iterator[None]:
        """The tokenizer without its normaliser, splitting at white space only. It is one object, as a second would double a worker's memory."""
        from tokenizers.pre_tokenizers import WhitespaceSplit

        parts = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = None, WhitespaceSplit()
        try:
            yield
        finally:
            self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = parts

    def _forget(self) -> None:
        self.stems, self.flat, self.sizes = pa.array([], pa.large_string()), np.zeros(0, self.dtype), np.zeros(0, np.int64)
        self._learn(pa.array([".", ","], pa.large_string()))

    def _full(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts, end to end, and how many each has, by the tokenizer as it is."""
        e = self.tokenizer.encode(" ".join(parts), add_special_tokens=False)
        starts = np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids))
        cuts = np.searchsorted(starts, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1))
        return np.array(e.ids, self.dtype), np.diff(cuts, prepend=0)

    def _letters(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for parts of a-z alone."""
        with self._by_words_alone():
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, self.dtype)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(cuts, prepend=0)) if len(cuts) == len(parts) else self._full(parts)

    def _learn(self, new: pa.Array) -> None:
        """Adds distinct stems that are not known yet."""
        simple = pc.match_substring_regex(new, "^[a-z]+$") if self.plain else pa.array(np.zeros(len(new), bool))
        stems, flat, sizes = [self.stems], [self.flat], [self.sizes]
        for some, encode in ((new.filter(simple), self._letters), (new.filter(pc.invert(simple)), self._full)):
            for k in range(0, len(some), 10_000):
                ids, n = encode(some[k : k + 10_000].to_pylist())
                flat.append(ids)
                sizes.append(n)
            stems.append(some)
        self.stems, self.flat, self.sizes = pa.concat_arrays(stems), np.concatenate(flat), np.concatenate(sizes)

    def pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, end to end, and how many each has."""
        ascii_ = pc.and_not(pc.string_is_ascii(pieces), pc.match_substring(pieces, "<|"))
        stems = pc.if_else(ascii_, pc.ascii_lower(pieces), pieces)
        stopped = pc.match_substring_regex(stems, f"[{LETTERS}][.,]$")
        tail = stopped.to_numpy(zero_copy_only=False)
        comma = pc.ends_with(stems, ",").to_numpy(zero_copy_only=False)
        coded = pc.dictionary_encode(pc.if_else(stopped, pc.replace_substring_regex(stems, "[.,]$", ""), stems))
        if len(self.stems) + len(coded.dictionary) > self.keep:
            self._forget()
        at = pc.index_in(coded.dictionary, self.stems)
        if at.null_count:
            self._learn(coded.dictionary.filter(pc.is_null(at)))
            at = pc.index_in(coded.dictionary, self.stems)
        stem = at.to_numpy()[coded.indices.to_numpy()]
        first, own = np.cumsum(self.sizes) - self.sizes, self.sizes[stem]
        n = own + tail
        out, upto = _gather(self.flat, first[stem], n), np.cumsum(n)
        out[upto[tail] - 1] = self.flat[first[comma[tail].astype(np.int64)]]  # stems 0 and 1 are the stop and the comma
        return out, n

    def texts(self, texts: pa.Array, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each with the end id, and the counts. Pieces are looked up once, ids gathered some texts at a time."""
        texts = texts.cast(pa.large_string())
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        at = words.offsets.to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(words.flatten())
        flat, sizes = self.pieces(coded.dictionary)
        # the end id is one more piece, put after each text's last word
        flat, sizes, words = np.append(flat, np.array([end], self.dtype)), np.append(sizes, 1), coded.indices.to_numpy()
        first, at, parts, counts, k = np.cumsum(sizes) - sizes, at - at[0], [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)], 0
        while k < len(at) - 1:
            stop = max(k + 1, int(np.searchsorted(at, at[k] + GATHER_WORDS, side="right")) - 1)
            own = at[k : stop + 1] - at[k]
            which = np.insert(words[at[k] : at[stop]], own[1:], len(sizes) - 1)
            n = sizes[which]
            parts.append(_gather(flat, first[which], n))
            counts.append(np.diff(np.concatenate(([0], np.cumsum(n)))[own + np.arange(len(own))]))
            k = stop
        return np.concatenate(parts), np.concatenate(counts)


def _gather(flat: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """flat[first[k] : first[k] + n[k]] for each k, end to end; places past the end give its last value."""
    at = np.repeat(first - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    return flat.take(at, mode="clip")


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """One encoder, with its pieces, for each worker process: tasks that follow find common pieces known."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def file_schema(sequence: int, dtype) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])


class SequenceWriter:
    """Writes a run of ids as fixed-size-list batches; memory is one batch and the rest of a sequence."""

    def __init__(self, sink, sequence: int, dtype):
        self.schema, self.sequence, self.dtype = file_schema(sequence, dtype), sequence, dtype
        self.out, self.rest = pa.ipc.new_stream(sink, self.schema), np.zeros(0, dtype)

    def _put(self, ids: np.ndarray, mask: np.ndarray) -> None:
        for k in range(0, len(ids), self.sequence * BATCH):
            a, b = pa.array(ids[k : k + self.sequence * BATCH]), pa.array(mask[k : k + self.sequence * BATCH])
            self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(a, self.sequence), pa.FixedSizeListArray.from_arrays(b, self.sequence)], schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        ids = np.concatenate((self.rest, ids))
        n = len(ids) // (self.sequence * BATCH) * self.sequence * BATCH
        self._put(ids[:n], np.ones(n, bool))
        self.rest = ids[n:]

    def close(self) -> None:
        pad = -len(self.rest) % self.sequence
        self._put(np.concatenate((self.rest, np.zeros(pad, self.dtype))), np.arange(len(self.rest) + pad) < len(self.rest))
        self.out.close()


class SequenceFile:
    """Random access to the sequences of a stream file. A local file is mapped: only what is asked for is read, and ids are views of it."""

    def __init__(self, folder: str, name: str):
        fs, path = place(folder)
        self.source = pa.memory_map(f"{path}/{name}") if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(f"{path}/{name}")
        self.batches = list(pa.ipc.open_stream(self.source))
        self.sequence = self.batches[0].schema.field("ids").type.list_size if self.batches else 0

    def __len__(self) -> int:
        return (len(self.batches) - 1) * BATCH + self.batches[-1].num_rows if self.batches else 0

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Sequence i: its ids and mask."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        batch, at = self.batches[i // BATCH], i % BATCH * self.sequence
        return batch.column(0).values.to_numpy()[at : at + self.sequence], batch.column(1).values.slice(at, self.sequence)

    def ids(self, at: int, n: int) -> np.ndarray:
        """n ids of the file's run from place `at`; a view where they lie in one batch."""
        each, parts = BATCH * self.sequence, []
        while n > 0:
            within = at % each
            part = self.batches[at // each].column(0).values.to_numpy()[within : within + n]
            parts.append(part)
            at, n = at + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)

    def close(self) -> None:
        self.batches = []
        self.source.close()


def write_files(docs: DataFrame, folder: str, tokenizer: str | None = None, sequence: int = SEQUENCE, end: int = END) -> DataFrame:
    """Writes docs' token files to `folder` (any file system URI); the index: doc_id, file, at, n_tokens, task, part.

    `at` is the place of a document's first id in its file's run, (task, part) the file's rank. Null
    texts are empty: just the end id. Null doc_ids come first; rows of equal doc_id lie by hash of
    their text, and equal rows in any order. A very long text is encoded in one task and lies in one
    file. Other columns are ignored. An empty table gives an empty index and no files. The index is
    written to the shared folder, so the files are written once.
    """
    tokenizer = tokenizer or default_tokenizer()
    own = docs.select("doc_id", text_of().alias("text"))
    parts = max(1, math.ceil((own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / PART_BYTES))
    dealt = own.withColumn("hash", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "hash").sortWithinPartitions("doc_id", "hash").drop("hash")

    def run(batches):
        task, part, encoder, writer, at = TaskContext.get().partitionId(), 0, None, None, 0
        fs, path = place(folder)
        for b in batches:
            encoder = encoder or encoder_for(tokenizer)
            for k, rows in by_bytes(b.column(1), SLICE_BYTES):
                if writer is None:
                    fs.create_dir(path, recursive=True)
                    name = f"part-{task:06d}-{part:04d}-{uuid.uuid4().hex}.arrows"
                    sink = fs.open_output_stream(f"{path}/{name}")
                    writer, at = SequenceWriter(sink, sequence, encoder.dtype), 0
                ids, n = encoder.texts(b.column(1).slice(k, rows), end)
                writer.add(ids)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, rows), pa.array([name] * rows), pa.array(starts), pa.array(n), pa.array(np.full(rows, task, np.int32)), pa.array(np.full(rows, part, np.int32))], ["doc_id", "file", "at", "n_tokens", "task", "part"])
                if at >= FILE_IDS:
                    writer.close()
                    sink.close()
                    writer, part = None, part + 1
        if writer is not None:
            writer.close()
            sink.close()

    return written(dealt.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, file string, at long, n_tokens long, task int, part int"), "token-index")


def read_documents(index: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file, at) of each document, read back from the files.

    start counts the ids of all documents before it, over all files; ids_crc32 is over its ids as
    little-endian unsigned 32-bit integers. Files' totals are added up in groups of 1024 tasks, and
    the groups' totals in one short window; nothing reaches the driver. An empty index gives an
    empty table.
    """
    files = index.groupBy("file").agg(F.min("task").alias("task"), F.min("part").alias("part"), F.sum("n_tokens").alias("n")).withColumn("group", F.floor(F.col("task") / 1024))
    until = Window.rowsBetween(Window.unboundedPreceding, -1)
    groups = files.groupBy("group").agg(F.sum("n").alias("n")).select("group", F.coalesce(F.sum("n").over(until.orderBy("group")), F.lit(0)).alias("first"))
    within = F.coalesce(F.sum("n").over(until.partitionBy("group").orderBy("task", "part")), F.lit(0))
    offsets = files.withColumn("within", within).join(groups, "group").select("file", (F.col("first") + F.col("within")).alias("before"))
    schema = index.schema["doc_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        source = SequenceFile(folder, table.column("file")[0].as_py())
        at, size = table.column("at").to_numpy(), table.column("n_tokens").to_numpy()
        crc = np.fromiter((zlib.crc32(source.ids(a, k).astype("<u4")) for a, k in zip(at.tolist(), size.tolist(), strict=True)), np.int64, len(at))
        source.close()
        start = table.column("before").to_numpy() + at
        return pa.table([table.column("doc_id"), pa.array(start), pa.array(size), pa.array(crc), table.column("file"), table.column("at")], ["doc_id", "start", "n_tokens", "ids_crc32", "file", "at"])

    # the index holds a few dozen bytes per document and a group is one file's documents
    return index.join(offsets, "file").groupBy("file").applyInArrow(run, f"doc_id {schema}, start long, n_tokens long, ids_crc32 long, file string, at long")


def token_table(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, start, n_tokens, ids_crc32), one row per row: written to token files and read back.

    Nulls, repeats, long texts, other columns and empty tables: as write_files and read_documents say.
    """
    folder = folder or fresh_path(docs.sparkSession, "tokens")
    return read_documents(write_files(docs, folder, tokenizer), folder).drop("file", "at")
