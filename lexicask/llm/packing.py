"""Packing along a space-filling curve: similar documents lie in the same sequences.

A document's hashed word vector (signed buckets) is projected to four numbers, each is spread evenly over 2 ** 10 steps, and the
four are joined to a Hilbert key. Documents are range-sorted by (key, doc_id), so copies of one text by the thousand are still
dealt to many tasks, and each range is cut along the curve into sequences of `length` ids with nothing between documents. The
rest of a range becomes sequences whose lengths are powers of two, so no sequence needs padding. With `stored_order` (docs read from
files whose order matters, such as a mixture) the order is kept in stretches of `STRETCH` rows of a file: stretches follow each
other as the files and their rows do, and the curve orders the documents within each.

Defined results: a null or empty text has only the end id; a text longer than a sequence goes on in the next ones; repeated rows
are packed one by one; an empty table gives no piece. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicask.llm.common import shared_dir, slices, store, table, words_of
from lexicask.llm.tokenids import tokens

DIMENSIONS, BITS, BUCKETS = 4, 10, 1 << 14
#: Documents that are hashed or tokenized together.
GROUP = 256
#: Consecutive rows of a stored order that are packed along the curve together.
STRETCH = 4096
#: Standard deviation of a mean projected word vector that is spread over the steps.
SPREAD = 0.25
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(1)
def projection() -> np.ndarray:
    """What a word adds to each dimension: a row for each bucket and sign."""
    plus = np.random.default_rng(20).standard_normal((DIMENSIONS, BUCKETS)).astype(np.float32)
    return np.concatenate([plus, -plus], axis=1)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of each row of unsigned coordinates below 2 ** bits (Skilling's transform, on columns)."""
    x = [points[:, k].astype(np.int64) for k in range(points.shape[1])]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x = [v ^ t for v in x]
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = (key << 1) | (v >> b & 1)
    return key


def curve_keys(column: pa.Array) -> np.ndarray:
    """Hilbert key of each text of a string column."""
    h, row, n = words_of(column)
    spots = np.zeros((len(n), DIMENSIONS))
    bucket = (h & np.uint64(2 * BUCKETS - 1)).view(np.int64)
    some = np.flatnonzero(n)
    if len(some):
        first = (np.cumsum(n) - n)[some]
        for d in range(DIMENSIONS):
            spots[some, d] = np.add.reduceat(projection()[d].take(bucket), first, dtype=np.float64) / n[some]
    even = 1 / (1 + np.exp(-1.702 * spots / SPREAD))  # the logistic curve close to the normal distribution
    return hilbert(np.minimum((even * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def ordered(docs: DataFrame, parts: int | None = None, work: str | None = None, stored_order: bool = False) -> DataFrame:
    """doc_id and text, range-partitioned and sorted along the curve (of each stretch). The keys are stored with the texts first, so that finding the ranges does not make them twice."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, GROUP):
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(curve_keys(some.column("text")))], names=[*some.schema.names, "curve"])

    own, kind, by = [F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")], "doc_id long, text string", ["curve", "doc_id"]
    if stored_order:
        own.append(F.format_string("%s:%012d", F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / STRETCH)).alias("stretch"))
        kind, by = f"{kind}, stretch string", ["stretch", *by]
    keys = store(docs.select(*own).mapInArrow(keyed, f"{kind}, curve long"), f"{work or shared_dir(docs.sparkSession)}/curve")
    dealt = keys.repartitionByRange(parts, *by) if parts else keys.repartitionByRange(*by)
    return dealt.sortWithinPartitions(*by)


def pack(docs: DataFrame, length: int = 4096, end: int = 2, tokenizer: str | None = None, parts: int | None = None, with_ids: bool = False, stored_order: bool = False) -> DataFrame:
    """One row for each piece: its document, place there, sequence, place there, and with_ids its token ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        worker, sequence = tokens(tokenizer), TaskContext.get().partitionId() << 36
        names = [x.split()[0] for x in PIECE.split(", ")]
        rows: list[tuple] = []
        waiting: list[tuple] = []  # pieces of the sequence that is not full: (doc_id, start, ids, doc_tokens)
        filled = 0

        def close(pieces):
            nonlocal sequence
            offset = 0
            for doc_id, start, ids, all_ids in pieces:
                n = len(ids) // 4
                rows.append((doc_id, start, n, zlib.crc32(ids), all_ids, sequence, offset, ids))
                offset += n
            sequence += 1

        def flush():
            columns = list(zip(*rows)) if rows else [()] * 8
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in columns[7]], pa.list_(pa.int32())))
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names + ["ids"] * with_ids)

        for batch in batches:
            for some in slices(batch, GROUP):
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), worker.of_column(some.column("text"), end), strict=True):
                    total, at = len(ids) // 4, 0
                    while at < total:
                        n = min(length - filled, total - at)
                        waiting.append((doc_id, at, ids[4 * at : 4 * (at + n)], total))
                        at, filled = at + n, filled + n
                        if filled == length:
                            close(waiting)
                            waiting, filled = [], 0
                if rows:
                    yield flush()
        room = filled and 1 << (filled.bit_length() - 1)
        pieces, used = [], 0
        for doc_id, start, ids, total in waiting:  # the rest, as sequences of descending powers of two
            at = 0
            while at < len(ids) // 4:
                n = min(room - used, len(ids) // 4 - at)
                pieces.append((doc_id, start + at, ids[4 * at : 4 * (at + n)], total))
                at, used, filled = at + n, used + n, filled - n
                if used == room:
                    close(pieces)
                    pieces, used, room = [], 0, filled and 1 << (filled.bit_length() - 1)
        if rows:
            yield flush()

    return ordered(docs, parts, stored_order=stored_order).mapInArrow(cut, PIECE + ", ids array<int>" * with_ids)


def op10_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
