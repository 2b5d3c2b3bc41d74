"""Shared helpers: table access, durable intermediate tables, ASCII-white-space words over whole Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from lexicask.plans.workdir import discard, shared_folder  # noqa: F401

#: Bytes that separate words everywhere in this subpackage: space and \t \n \v \f \r.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
STEP = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, work: str | None = None) -> str:
    """A new folder that all executors see: below `work`, else where the session keeps its checkpoints."""
    return shared_folder(spark, "lexicask", work)


def store(df: DataFrame, path: str, compression: str = "snappy") -> DataFrame:
    """Write df once and read it again: cuts lineage by files that survive a lost executor."""
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows of a string column, each row followed by one space, and each row's first byte (n + 1 offsets). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    joined = pc.binary_join_element_wise(column, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    if isinstance(joined, pa.ChunkedArray):
        joined = joined.combine_chunks()
    _, offsets, data = joined.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[joined.offset : joined.offset + len(joined) + 1] if len(joined) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and len(joined) else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def slices(batch: pa.RecordBatch, rows: int = 256, most: int = 2 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most `rows` rows and about `most` bytes of a string column, a row at least: what is worked on together."""
    upto = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    a = 0
    while a < batch.num_rows:
        before = upto[a - 1] if a else 0
        b = min(a + rows, max(a + 1, int(np.searchsorted(upto, before + most, side="right"))))
        yield batch.slice(a, b - a)
        a = b


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array of uint64."""
    h = h ^ (h >> np.uint64(33))
    h *= MIX1
    h ^= h >> np.uint64(33)
    h *= MIX2
    h ^= h >> np.uint64(33)
    return h


#: Bytes as they are, and with A-Z lower-cased.
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32
#: Masks of the first n bytes of a little-endian 64-bit integer.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def words_of(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows in order, the row of each word, and the number of words of each row."""
    return words_and_heads(column, lower)[:3]


def words_and_heads(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As words_of, and the first eight bytes of each word as a little-endian integer (zeros after a shorter one).

    The whole batch is done at once: words (A-Z lower-cased if asked) are read in pieces of eight bytes, each piece is mixed with
    its place, and the sum of a word's pieces with its length. No byte is left out, however long the word.
    """
    data, starts = text_buffer(column)
    n = len(starts) - 1
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n, np.int64), np.zeros(0, np.uint64)
    if not len(data):
        return none
    space = SPACES[data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    into = ~space[edge]
    # the buffer ends in a space, so words are runs that end at an edge into a space
    ends, begins = edge[into] + 1, edge[~into] + 1
    if not space[0]:
        begins = np.concatenate([np.zeros(1, begins.dtype), begins])
    if not len(begins):
        return none
    padded = np.zeros(len(data) + 8, np.uint8)
    np.take(LOWER if lower else SAME, data, out=padded[: len(data)])
    eight = np.ndarray((len(data),), "<u8", padded, strides=(1,))  # eight bytes from each byte
    lengths = ends - begins
    pieces = (lengths + 7) >> 3
    heads = eight[begins] & FIRST[np.minimum(lengths, 8)]
    if (pieces == 1).all():
        total = mixed(heads + STEP)
    else:
        first = np.cumsum(pieces) - pieces
        within = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
        at = np.repeat(begins, pieces) + 8 * within
        value = eight[at] & FIRST[np.minimum(np.repeat(ends, pieces) - at, 8)]
        total = np.add.reduceat(mixed(value + (within + 1).astype(np.uint64) * STEP), first)
    h = mixed(total + lengths.astype(np.uint64))
    row = np.searchsorted(begins, starts)  # words before each row
    count = np.diff(row)
    return h, np.repeat(np.arange(n), count), count.astype(np.int64), heads
