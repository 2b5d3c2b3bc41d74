"""From texts to occurrences, postings, statistics and blocks. Every function maps DataFrames to a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexicask.functions.text import tokens
from lexicask.schema import BLOCK, Features

#: doc_ids of one slice of a token's posting list when its entries are numbered.
SLICE = 1 << 16


def occurrences(docs: DataFrame, fields: dict[str, Column | str], start: int = 0) -> DataFrame:
    """field, doc_id, pos, token of each token of each field. docs has doc_id; `start` is added to it. Field texts may be null."""
    texts = F.array(*[F.struct(F.lit(name).alias("field"), (F.col(c) if isinstance(c, str) else c).cast("string").alias("text")) for name, c in fields.items()])
    each = docs.select((F.col("doc_id") + F.lit(start)).cast("long").alias("doc_id"), F.explode(texts).alias("f")).select("f.field", "doc_id", "f.text")
    return each.select("field", "doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))


def document_postings(docs: DataFrame, fields: dict[str, Column | str], features: Features = Features.POSITIONS, start: int = 0) -> DataFrame:
    """postings() of the occurrences of docs, whose doc_ids are distinct: all occurrences of a document lie in its row, so they are grouped there and nothing is shuffled."""
    texts = F.array(*[F.struct(F.lit(name).alias("field"), (F.col(c) if isinstance(c, str) else c).cast("string").alias("text")) for name, c in fields.items()])
    each = docs.select((F.col("doc_id") + F.lit(start)).cast("long").alias("doc_id"), F.explode(texts).alias("f")).select("f.field", "doc_id", tokens(F.col("f.text")).alias("_t"))
    none = F.array().cast("array<int>")
    if features is Features.DOC:
        return each.select("field", F.explode(F.array_distinct("_t")).alias("token"), "doc_id", F.lit(1).cast("long").alias("tf"), none.alias("positions"))
    # sorted by token (and place, where positions are kept); where a new token begins; each token's stretch
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  evaluates value once
    starts = lambda s, of: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (of(x) != of(F.get(s, i - 1))), i).otherwise(-1)), lambda i: i >= 0)
    stretch = lambda s, of, b, k, at: F.struct(of(F.get(s, b)).alias("token"), b.alias("at"), (F.coalesce(F.get(at, k + 1), F.size(s)) - b).alias("n"))
    if features is Features.TERM_FREQUENCY:  # plain strings sort faster than structs
        of = lambda x: x
        grouped = bound(F.sort_array("_t"), lambda s: bound(starts(s, of), lambda at: F.transform(at, lambda b, k: stretch(s, of, b, k, at))))
        found = each.select("field", "doc_id", F.explode(grouped).alias("g"))
        return found.select("field", "g.token", "doc_id", F.col("g.n").cast("long").alias("tf"), none.alias("positions"))
    of = lambda x: x["t"]
    placed = F.sort_array(F.transform("_t", lambda t, i: F.struct(t.alias("t"), i.alias("i"))))
    places = lambda s, g: F.transform(F.slice(s, g["at"] + 1, g["n"]), lambda x: x["i"])
    grouped = bound(placed, lambda s: bound(starts(s, of), lambda at: F.transform(F.transform(at, lambda b, k: stretch(s, of, b, k, at)), lambda g: F.struct(g["token"].alias("token"), places(s, g).alias("positions")))))
    found = each.select("field", "doc_id", F.explode(grouped).alias("g"))
    return found.select("field", "g.token", "doc_id", F.size("g.positions").cast("long").alias("tf"), "g.positions")


def postings(occurrences: DataFrame, features: Features = Features.POSITIONS) -> DataFrame:
    """One row for each (field, token, doc_id): tf (1 below TERM_FREQUENCY) and ordered positions (empty below POSITIONS)."""
    grouped = occurrences.groupBy("field", "token", "doc_id")
    none = F.array().cast("array<int>")
    if features is Features.DOC:
        return grouped.agg(F.lit(1).cast("long").alias("tf")).select("field", "token", "doc_id", "tf", none.alias("positions"))
    if features is Features.TERM_FREQUENCY:
        return grouped.agg(F.count("*").alias("tf")).select("field", "token", "doc_id", "tf", none.alias("positions"))
    return grouped.agg(F.count("*").alias("tf"), F.array_sort(F.collect_list(F.col("pos").cast("int"))).alias("positions"))


def token_stats(postings: DataFrame) -> DataFrame:
    """Documents and occurrences of each token, and its document where there is only one."""
    counts = postings.groupBy("field", "token").agg(F.count("*").alias("doc_frequency"), F.sum("tf").alias("term_frequency"), F.min("doc_id").alias("_first"))
    return with_single(counts)


def with_single(counts: DataFrame) -> DataFrame:
    return counts.select("field", "token", "doc_frequency", "term_frequency", F.when(F.col("doc_frequency") == 1, F.col("_first")).alias("single_docid"))


def doc_stats(occurrences: DataFrame) -> DataFrame:
    return occurrences.groupBy("field", "doc_id").agg(F.count("*").alias("doc_len"))


def blocks(postings: DataFrame, size: int = BLOCK) -> DataFrame:
    """field, token, block_no, first_docid, last_docid and n_docs of each block; tokens of a single document have none.

    A token's doc_ids are listed by slices of `SLICE` ids, so no group holds a whole posting list; the window that adds slices up has
    one row for each. A slice gives its part of each block it reaches into, and parts of a block are put together.
    """
    key = ["field", "token"]
    lists = postings.groupBy(*key, F.floor(F.col("doc_id") / F.lit(SLICE)).alias("_slice")).agg(F.sort_array(F.collect_list("doc_id")).alias("_ids"))
    whole = Window.partitionBy(*key)
    n = F.size("_ids").cast("long")
    counted = lists.withColumn("_df", F.sum(n).over(whole)).withColumn("_before", F.sum(n).over(whole.orderBy("_slice")) - n).filter("_df > 1")
    each = counted.select(*key, "_ids", "_before", F.explode(F.sequence(F.expr(f"_before div {size}"), F.expr(f"(_before + size(_ids) - 1) div {size}"))).alias("block_no"))
    low, high = F.expr(f"CAST(greatest(block_no * {size} - _before, 0) AS INT)"), F.expr(f"CAST(least((block_no + 1) * {size} - _before, size(_ids)) AS INT)")
    parts = each.select(*key, "block_no", F.get("_ids", low).alias("a"), F.get("_ids", high - 1).alias("b"), (high - low).alias("n"))
    return parts.groupBy(*key, "block_no").agg(F.min("a").alias("first_docid"), F.max("b").alias("last_docid"), F.sum("n").cast("long").alias("n_docs"))
