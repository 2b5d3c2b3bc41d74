"""Token-id files: whole texts as ids in coded blocks, in ascending doc_id order.

A file is a Parquet container that Spark's commit protocol writes, so a lost or repeated task leaves no half file. Each row is a
segment: whole documents (doc_ids, lengths), the ids of its part before it (`before`), and `frames`: length-prefixed blocks of
lexicask.llm.codec, each independently reset and checksummed. A part is one range of doc_ids.

Defined results: a null or empty text has only the end id; repeated doc_ids are separate documents; null doc_ids come first; an
empty table gives files without segments; a text longer than a block fills several blocks of one segment. Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicask.llm.codec import MOST, decode_block, encode_block
from lexicask.llm.common import shared_dir, slices, table
from lexicask.llm.tokenids import tokens

SEGMENT = "part int, before long, doc_ids array<long>, lengths array<long>, n_tokens long, frames binary"


def _frames(ids: bytes, vocab: int) -> bytes:
    flat, out = np.frombuffer(ids, "<u4"), []
    for a in range(0, len(flat), MOST):
        block = encode_block(flat[a : a + MOST], vocab)
        out += [len(block).to_bytes(4, "little"), block]
    return b"".join(out)


def blocks(frames: bytes) -> Iterator[np.ndarray]:
    """The ids of each block of a segment."""
    at = 0
    while at < len(frames):
        size = int.from_bytes(frames[at : at + 4], "little")
        yield decode_block(frames[at + 4 : at + 4 + size])
        at += 4 + size


def write(docs: DataFrame, path: str, end: int = 1, tokenizer: str | None = None, parts: int | None = None) -> None:
    """Write the ids of every text of docs (doc_id, text), each followed by the id `end`. parts: files, Spark's shuffle partitions by default."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, worker = TaskContext.get().partitionId(), tokens(tokenizer)
        vocab = max(worker.tokenizer.get_vocab_size(), end + 1)
        schema = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("frames", pa.binary())])
        before, size, doc_ids, kept = 0, 0, [], []

        def segment():
            row = {"part": part, "before": before, "doc_ids": doc_ids, "lengths": [len(x) // 4 for x in kept], "n_tokens": size, "frames": _frames(b"".join(kept), vocab)}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for some in slices(batch):
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), worker.of_column(some.column("text"), end), strict=True):
                    n = len(ids) // 4
                    if kept and size + n > MOST:
                        yield segment()
                        before, size, doc_ids, kept = before + size, 0, [], []
                    doc_ids.append(doc_id)
                    kept.append(ids)
                    size += n
        if kept:
            yield segment()

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dealt = own.repartitionByRange(parts, "doc_id") if parts else own.repartitionByRange("doc_id")
    dealt.sortWithinPartitions("doc_id").mapInArrow(encode, SEGMENT).write.mode("overwrite").parquet(path)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Segments with `first`: the ids before each. The totals that are broadcast have one row for each written part."""
    segments = spark.read.schema(SEGMENT).parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    from pyspark.sql import Window

    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_before"))
    return segments.join(F.broadcast(before), "part").withColumn("first", F.col("part_before") + F.col("before"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (array of int) of each written document."""
    return _read(spark, path, whole=True)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of each written document."""
    return _read(spark, path, whole=False)


def _read(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = np.concatenate([np.zeros(0, "<u4"), *blocks(batch.column("frames")[k].as_py())])
                lengths = np.array(batch.column("lengths")[k].as_py(), np.int64)
                stops = np.cumsum(lengths)
                starts = stops - lengths
                first = batch.column("first")[k].as_py()
                cut = [ids[a:b] for a, b in zip(starts.tolist(), stops.tolist())]
                last = pa.array([x.astype(np.int32) for x in cut], pa.list_(pa.int32())) if whole else pa.array([zlib.crc32(x.tobytes()) for x in cut], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[k].values, pa.array(starts + first), pa.array(lengths), last], names=["doc_id", "start", "n_tokens", "ids" if whole else "ids_crc32"])

    kind = "ids array<int>" if whole else "ids_crc32 long"
    return _placed(spark, path).select("first", "doc_ids", "lengths", "frames").mapInArrow(decode, f"doc_id long, start long, n_tokens long, {kind}")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/ids"
    write(table(spark, sf_dir, "documents"), path, end=1)
    return digests(spark, path)
