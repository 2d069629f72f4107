"""Token counts by separator scan over flat, unindexed token files.

A token file is a run of big-endian unsigned 16-bit ids without any index; each document ends with ``END``. A file is
scanned in blocks: each block is one vectorised search for ``END``, which gives the documents that end inside it. The
document that straddles a block boundary is stitched by a prefix scan over the blocks of its file: the running maximum
of the last separator seen, and the last document header seen, up to the block before.

``write_token_files`` writes such files from texts through Spark's own writer, so that they land where the cluster's
file system is. ``END`` is an id above the vocabulary whose two bytes are valid text, as the writer needs for its record end. Five leading ids of 13 bits each carry the document's id; they are no tokens and aren't counted. Texts are written by
classes of size, the longer ones fewer to a file, so that a file stays under FILE_BYTES unless one text alone is larger. A
file is read whole by a task; one over 2 GB, which Spark's reader doesn't take, must be cut before.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_bpe, default_vocab, scratch_dir, table

END = 0xC480
HEADER = 5
BLOCK_TOKENS = 1 << 20
#: Bytes of a record, about, and records of a file at most.
RECORD_BYTES, FILE_RECORDS = 16_000_000, 10

_SHIFTS = np.arange(4, -1, -1, dtype=np.uint64) * np.uint64(13)


def header_of(doc_id: int | None) -> np.ndarray:
    """Zigzag form of a 64-bit id, plus one (null: zero), as five ids of 13 bits."""
    z = 0 if doc_id is None else ((doc_id << 1) ^ (doc_id >> 63)) % (1 << 64) + 1
    return np.array([(z >> s) & 0x1FFF for s in (52, 39, 26, 13, 0)], dtype=">u2")


def id_of(head: np.ndarray) -> int | None:
    z = 0
    for x in head.tolist():
        z = z << 13 | x
    return None if not z else (lambda v: (v >> 1) ^ -(v & 1))(z - 1)


def write_token_files(docs: DataFrame, path: str, vocab: str, id_col: str = "doc_id", text_col: str = "text", record_bytes: int = RECORD_BYTES, file_records: int = FILE_RECORDS) -> None:
    """Encodes every whole text (null: no tokens) and writes flat token files in ``path``, in one scan without a shuffle. Null and
    repeated ids and repeated rows are written as they are; an empty table gives no documents."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocab)
        if bpe.n_vocab > END:
            raise ValueError(f"the vocabulary has ids from {END} on")
        end = np.array([END], ">u2").tobytes()  # the writer ends a record with it, too
        record = lambda parts: pa.RecordBatch.from_arrays([pa.array([end.join(parts)], pa.binary())], ["value"])
        held, size = [], 0
        for batch in batches:
            for i, t in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                one = header_of(i).tobytes() + np.array(bpe.encode(t, allowed_special="all") if t else [], dtype=">u2").tobytes()
                if held and size + len(one) > record_bytes:
                    yield record(held)
                    held, size = [], 0
                held.append(one)
                size += len(one) + len(end)
        if held:
            yield record(held)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encoded, "value binary")
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", chr(0x100)).option("maxRecordsPerFile", file_records).text(path)


_BLOCK = T.StructType([T.StructField("path", T.StringType()), T.StructField("block", T.LongType()), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("last_end", T.LongType()), T.StructField("last_id", T.LongType()), T.StructField("has_start", T.BooleanType()), T.StructField("size", T.LongType())])


def blocks_of(content, end_id: int = END, header: int = HEADER, block_tokens: int = BLOCK_TOKENS) -> Iterator[dict]:
    """For each block: where documents end in it, and the ids of those that start in it."""
    flat = np.frombuffer(content, dtype=">u2")
    for k, at in enumerate(range(0, max(1, len(flat)), block_tokens)):
        ends = np.flatnonzero(flat[at : at + block_tokens] == end_id) + at
        starts = np.concatenate([[0] if k == 0 else [], ends + 1]).astype(np.int64)
        starts = starts[starts < len(flat)]
        ids = [id_of(flat[s : s + header]) if header else None for s in starts.tolist()]
        yield {"block": k, "ends": ends.tolist(), "ids": ids, "last_end": int(ends[-1]) if len(ends) else None, "last_id": ids[-1] if ids else None, "has_start": bool(ids), "size": len(flat)}


def count_tokens(spark: SparkSession, path: str, end_id: int = END, header: int = HEADER, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row a document of the files in ``path``: path, doc_index (from 0 in its file), start (of its first token, in
    ids), n_tokens, doc_id (from the header; null without one), terminated (false for a last document without END).
    Documents don't go from one file to the next. Empty files hold no document."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                for row in blocks_of(content.as_buffer(), end_id, header, block_tokens):
                    yield pa.RecordBatch.from_pylist([{"path": name.as_py()} | row], schema=_SCHEMA)

    blocks = files.mapInArrow(scan, _BLOCK)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy("path").orderBy(F.col("block").desc())
    stitched = blocks.select(
        "*",
        F.coalesce(F.max("last_end").over(before), F.lit(-1)).alias("carry_end"),
        F.max_by("last_id", F.when(F.col("has_start"), F.col("block"))).over(before).alias("carry_id"),
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).cast("long").alias("carry_n"),
        F.row_number().over(last).alias("from_last"),
    )
    # the document that is open at the block's start comes first, then those that start inside it
    carried = F.when(F.col("block") == 0, F.expr("cast(array() as array<bigint>)")).otherwise(F.array("carry_id"))
    begins = F.concat(F.array(F.col("carry_end") + 1), F.transform("ends", lambda e: e + 1))
    # a last document that END doesn't close ends where the file does
    opened = F.when((F.col("from_last") == 1) & (F.coalesce("last_end", "carry_end") + 1 < F.col("size")), F.array("size")).otherwise(F.expr("cast(array() as array<bigint>)"))
    rows = stitched.select("path", "carry_n", F.size("ends").alias("n"), F.posexplode(F.arrays_zip(F.concat("ends", opened).alias("e"), F.slice(begins, 1, F.size("ends") + F.size(opened)).alias("b"), F.slice(F.concat(carried, "ids"), 1, F.size("ends") + F.size(opened)).alias("d"))).alias("i", "x"))
    start = F.col("x.b") + header
    return rows.select("path", (F.col("carry_n") + F.col("i")).alias("doc_index"), start.alias("start"), F.greatest(F.lit(0), F.col("x.e") - start).alias("n_tokens"), F.col("x.d").alias("doc_id"), (F.col("i") < F.col("n")).alias("terminated"))


_SCHEMA = pa.schema([("path", pa.string()), ("block", pa.int64()), ("ends", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("last_end", pa.int64()), ("last_id", pa.int64()), ("has_start", pa.bool_()), ("size", pa.int64())])


def op10_token_counts(spark, sf_dir):
    """Tokens of every document, read back from flat token files (END not counted). SQL has no byte-level BPE: tests
    hold the counts against the tokenizers library."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, default_vocab())
    return count_tokens(spark, path).select("doc_id", "n_tokens")
