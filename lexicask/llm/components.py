"""Connected components of an undirected graph of long ids: up to `MOST` links in one task, more by alternating large-star and small-star rounds.

Every round is a few shuffles over the remaining links, never a collection of them; rounds are written to the shared folder, and
the one before is deleted. A node with very many links is met in a join that AQE can split and in partial aggregates. What one task
takes has a fixed bound, so it does not grow with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicask.llm.common import discard, store

#: Links that one task joins by itself (two ids of 8 bytes each), instead of rounds of shuffles.
MOST = 1 << 20


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of links a, b, and the smallest id of each one's component."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    least = np.arange(len(ids))
    while len(x):
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (further := least[least]).tobytes() != least.tobytes():
            least = further
        x, y = least[x], least[y]
        x, y = x[x != y], y[x != y]
    return ids, ids[least]


def components_of_few(links: DataFrame, work: str) -> DataFrame | None:
    """As components, if there are at most MOST links; else None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *((batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in joined(*(np.concatenate(x) for x in zip(*found)))], names=["id", "component"])

    if links.count() > MOST:
        return None
    return store(links.filter("a <> b").select("a", "b").coalesce(1).mapInArrow(run, "id long, component long"), f"{work}/joined")


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: a > b. large: larger neighbours of each node move to its smallest one; else smaller ones and the node itself do."""
    if large:
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        joined = links.join(least, "a")
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionAll(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def components(links: DataFrame, work: str) -> DataFrame:
    """links: a, b (long, not null; loops and repeats allowed), read twice. Returns id and component (its smallest id) of every linked id."""
    spark = links.sparkSession
    few = components_of_few(links, work)
    if few is not None:
        return few
    now = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before, k = None, 0
    now = store(now, f"{work}/links0")
    while True:
        k += 1
        nxt = store(_star(_star(now, True), False), f"{work}/links{k}")
        discard(spark, f"{work}/links{k - 1}")
        sums = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = nxt
        if tuple(sums) == before:
            break
        before = tuple(sums)
    # at the end every link leads to its component's smallest id
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
