"""Token ids in files of separately compressed documents, with one zstandard dictionary for all files of a folder.

A file is, little-endian: b"WFTK", version u32, its number u64, the dictionary's SHA-256 (32 bytes), documents u64, length of
the index u64; the frames, one a document; the index, a zstandard frame of three arrays (doc_id i64, with the smallest for
null; offset u64 of the frame behind the head; ids u32); b"TKE\\n". A frame holds a document's ids as u16 where the vocabulary
allows it, else as u32 (version 1 or 2). One document is read by its entry of the index and its frame alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm import tokens as tok
from weftline.llm.base import scratch, trimmed

HEAD = struct.Struct("<4sIQ32sQQ")
MAGIC, TAIL, NO_ID = b"WFTK", "TKE\n", -(1 << 63)
#: Ids of a file before the next one begins; documents that a dictionary is trained on, and its bytes; bytes of text in a range of ids.
FILE_IDS, SAMPLE, DICTIONARY, RANGE = 8_000_000, 512, 65_536, 16 << 20
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def train(docs: DataFrame, path: str, end: int, narrow: bool) -> bytes:
    """The dictionary, of the ids of at most SAMPLE documents, those of the smallest hashes of their ids; empty if they are too few."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for ids in tok.encoder(path).ids(batch.column(0).to_pylist()):
                whole = np.append(ids, end).astype("<u2" if narrow else "<u4").tobytes()
                parts += [whole[k : k + 4096] for k in range(0, len(whole), 4096)]
        try:
            trained = zstandard.train_dictionary(DICTIONARY, parts).as_bytes() if len(parts) >= 16 else b""
        except zstandard.ZstdError:
            trained = b""
        yield pa.RecordBatch.from_arrays([pa.array([trained], pa.binary())], names=["dictionary"])

    sample = docs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("text")
    found = sample.coalesce(1).mapInArrow(make, "dictionary binary").first()
    return bytes(found[0]) if found else b""


def encode(dictionary: bytes, number: int, doc_ids: list[int | None], frames: list[bytes], counts: list[int], narrow: bool) -> bytes:
    ends = np.cumsum([0, *map(len, frames)]).astype("<u8")
    index = zstandard.compress(np.array([NO_ID if d is None else d for d in doc_ids], "<i8").tobytes() + ends[:-1].tobytes() + np.array(counts, "<u4").tobytes())
    return HEAD.pack(MAGIC, 1 if narrow else 2, number, hashlib.sha256(dictionary).digest(), len(frames), len(index)) + b"".join(frames) + index


class Reader:
    """One file's bytes: number, doc_ids, counts, and ids(k) of its k-th document."""

    def __init__(self, content: bytes, dictionary: bytes) -> None:
        magic, version, self.number, digest, n, size = HEAD.unpack_from(content)
        if magic != MAGIC or version not in (1, 2):
            raise ValueError("not a token file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the file was written with another dictionary")
        self.content, self.kind = content, "<u2" if version == 1 else "<u4"
        self.end = len(content) - len(TAIL) - size
        index = zstandard.decompress(content[self.end : self.end + size], max_output_size=n * 20)
        ids, self.offsets, self.counts = np.frombuffer(index, "<i8", n), np.frombuffer(index, "<u8", n, n * 8), np.frombuffer(index, "<u4", n, n * 16)
        self.doc_ids = [None if d == NO_ID else d for d in ids.tolist()]
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, k: int) -> np.ndarray:
        at = HEAD.size + int(self.offsets[k])
        upto = HEAD.size + int(self.offsets[k + 1]) if k + 1 < len(self.offsets) else self.end
        return np.frombuffer(self.unpack.decompress(self.content[at:upto], max_output_size=int(self.counts[k]) * 4), self.kind).astype("<u4")


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = 2) -> None:
    """Files under folder/ids, ascending by doc_id within and across them, and the dictionary under folder/dictionary."""
    path = path or tok.default_path()
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    narrow = tok.encoder(path).tokenizer.get_vocab_size() <= 1 << 16 and end < 1 << 16
    dictionary = train(docs, path, end, narrow)
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    sent = spark.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(sent.value) if sent.value else None)
        held, files = ([], [], []), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                for doc_id, ids in zip(some.column(0).to_pylist(), tok.encoder(path).ids(some.column(1).to_pylist())):
                    frame = pack.compress(np.append(ids, end).astype("<u2" if narrow else "<u4").tobytes())
                    for part, x in zip(held, (doc_id, frame, len(ids) + 1)):
                        part.append(x)
                if sum(held[2]) >= FILE_IDS:
                    yield file(base + files, held)
                    held, files = ([], [], []), files + 1
        if held[0]:
            yield file(base + files, held)

    def file(number: int, held: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([encode(sent.value, number, *held, narrow)], pa.binary())], names=["content"])

    # As many ranges as the texts' bytes ask for, so that none grows with the table.
    ranges = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE + 1
    ordered = docs.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text")
    # A row is a file's bytes but for its last four, which are the text writer's line end.
    ordered.mapInArrow(trimmed(run), "content binary").select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", TAIL).text(f"{folder}/ids")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """For each document of the files: doc_id, start (ids of all documents before it), n_tokens and the ids' ids_crc32."""
    dictionary = bytes(spark.read.parquet(f"{folder}/dictionary").first()[0])
    sent = spark.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                if not content.as_py():
                    continue
                r = Reader(content.as_py(), sent.value)
                before = np.cumsum([0, *r.counts.tolist()])
                yield pa.RecordBatch.from_arrays([pa.array([r.number] * len(r.doc_ids), pa.int64()), pa.array(r.doc_ids, pa.int64()), pa.array(before[:-1], pa.int64()), pa.array(r.counts.astype(np.int64)), pa.array([zlib.crc32(r.ids(k).tobytes()) for k in range(len(r.doc_ids))], pa.int64())], names=["file", "doc_id", "inside", "n_tokens", "ids_crc32"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Reader(content.as_py(), sent.value) for content in batch.column(0) if content.as_py()]
            yield pa.RecordBatch.from_arrays([pa.array([r.number for r in found], pa.int64()), pa.array([int(r.counts.sum()) for r in found], pa.int64())], names=["file", "n"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/ids").select("content")
    rows = files.mapInArrow(trimmed(run), "file long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    # One row for each file, of its index alone: their running sum is one task's.
    ends = files.mapInArrow(trimmed(total), "file long, n long")
    before = ends.select("file", (F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    return rows.join(before, "file").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str | None = None, end: int = 2) -> DataFrame:
    """write() to the shared folder, then read().

    A null text is an empty one, which is the end id alone. Null doc_ids come first and stay null; rows that share one stand
    in the order of their texts. An empty table gives an empty one; other columns are ignored.
    """
    folder = scratch(docs.sparkSession)
    write(docs, folder, path, end)
    return read(docs.sparkSession, folder)
