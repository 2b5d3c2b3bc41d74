"""Token lookup, forward seek and frequencies over postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexicask.operators.build import SLICE
from lexicask.schema import Features


def lookup(postings: DataFrame, field: str, token: str, features: Features = Features.POSITIONS, ordered: bool = False) -> DataFrame:
    """doc_id, tf and positions of a token, at the feature level; no rows if the token is unknown. Both filters reach the scan. ordered: by ascending doc_id."""
    found = postings.filter((F.col("field") == field) & (F.col("token") == token))
    tf = F.col("tf") if features.has_term_frequency else F.lit(1).cast("long")
    positions = F.col("positions") if features.has_positions else F.array().cast("array<int>")
    out = found.select("doc_id", tf.alias("tf"), positions.alias("positions"))
    return out.orderBy("doc_id") if ordered else out


def seek(postings: DataFrame, field: str, token: str, target: int) -> DataFrame:
    """The first posting of a token at or after a doc_id; no row past the end."""
    return lookup(postings, field, token).filter(F.col("doc_id") >= target).orderBy("doc_id").limit(1)


def following(postings: DataFrame, field: str, token: str, after: int) -> DataFrame:
    """The posting after a doc_id; no row at the end."""
    return seek(postings, field, token, after + 1)


def seek_batch(postings: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (field, token, target) with doc_id, the first one of the token at or after the target (null past the end).

    Postings of the targets' tokens and targets are sorted together by slices of doc_ids: the least doc_id from the back of a slice
    answers its targets. A target behind the last posting of its slice takes the least of the next slice that has one, from a table
    of one row for each slice. No posting meets more than its own slice's targets, and no task holds a whole posting list.
    """
    key = ["field", "token"]
    wanted = targets.select(*key, F.col("target").cast("long").alias("target")).distinct()
    low = wanted.groupBy(*key).agg(F.min("target").alias("_low"))
    near = postings.select(*key, "doc_id").join(low, key).filter("doc_id >= _low").select(*key, F.col("doc_id").alias("at"), F.col("doc_id").alias("doc_id"))
    slice_ = F.floor(F.col("at") / F.lit(SLICE))
    both = near.withColumn("_kind", F.lit(0)).unionByName(wanted.select(*key, F.col("target").alias("at"), F.lit(None).cast("long").alias("doc_id"), F.lit(1).alias("_kind"))).withColumn("_slice", slice_)
    back = Window.partitionBy(*key, "_slice").orderBy(F.desc("at"), "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = both.withColumn("_found", F.min("doc_id").over(back)).filter("_kind = 1").select(*key, "_slice", F.col("at").alias("target"), "_found")
    firsts = near.groupBy(*key, slice_.alias("_slice")).agg(F.min("doc_id").alias("_first"))
    ends = firsts.select(*key, "_slice", F.lit(None).cast("long").alias("target"), F.lit(None).cast("long").alias("_found"), "_first").unionByName(here.withColumn("_first", F.lit(None).cast("long")))
    later = Window.partitionBy(*key).orderBy(F.desc("_slice")).rangeBetween(Window.unboundedPreceding, -1)
    answered = ends.withColumn("_later", F.min("_first").over(later)).filter("target IS NOT NULL")
    return answered.select(*key, "target", F.coalesce("_found", "_later").alias("doc_id"))


def size_hint(token_stats: DataFrame, field: str, *tokens: str) -> DataFrame:
    """Documents of each token, exactly, without reading postings."""
    return token_stats.filter((F.col("field") == field) & F.col("token").isin(*tokens)).select("token", F.col("doc_frequency").alias("size_hint"))
