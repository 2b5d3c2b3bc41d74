"""Scoring, phrases and boolean queries over postings: beyond single-token lookup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def bm25(postings: DataFrame, doc_stats: DataFrame, n_docs: int, field: str, tokens: list[str]) -> DataFrame:
    """doc_id and score by the published BM25 formula, idf = ln(1 + (N - df + 0.5) / (df + 0.5)), for documents with any of the tokens."""
    found = postings.filter((F.col("field") == field) & F.col("token").isin(*dict.fromkeys(tokens))).select("token", "doc_id", "tf")
    df = found.groupBy("token").agg(F.count("*").alias("df"))  # a row for each query token
    lengths = doc_stats.filter(F.col("field") == field).select("doc_id", "doc_len")
    mean = lengths.agg((F.sum("doc_len") / F.lit(n_docs)).alias("m")).scalar()
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / mean))
    return found.join(F.broadcast(df), "token").join(lengths, "doc_id").groupBy("doc_id").agg(F.sum(part).alias("score"))


def top(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "doc_id").limit(k)


def phrase(postings: DataFrame, field: str, tokens: list[str]) -> DataFrame:
    """doc_id and n_matches of documents that hold the tokens at consecutive positions."""
    mine = postings.filter((F.col("field") == field) & F.col("token").isin(*dict.fromkeys(tokens)))
    # every token's positions, moved back by its place in the phrase: a match is a start that all of them share
    places = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in enumerate(tokens)])
    starts = mine.select("doc_id", "token", F.explode("positions").alias("pos")).withColumn("p", F.explode(places)).filter("p.t = token")
    whole = starts.groupBy("doc_id", (F.col("pos") - F.col("p.k")).alias("start")).agg(F.count("*").alias("n")).filter(F.col("n") == len(tokens))
    return whole.groupBy("doc_id").agg(F.count("*").alias("n_matches"))


def any_of(postings: DataFrame, field: str, tokens: list[str]) -> DataFrame:
    return postings.filter((F.col("field") == field) & F.col("token").isin(*tokens)).select("doc_id").distinct()


def all_of(postings: DataFrame, field: str, tokens: list[str]) -> DataFrame:
    """Documents with all of the tokens: one aggregate over their postings."""
    own = list(dict.fromkeys(tokens))
    found = postings.filter((F.col("field") == field) & F.col("token").isin(*own)).select("doc_id", "token")
    return found.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(own)).select("doc_id")


def none_of(docs: DataFrame, postings: DataFrame, field: str, tokens: list[str]) -> DataFrame:
    """Of docs (doc_id), those without any of the tokens."""
    return docs.join(any_of(postings, field, tokens), "doc_id", "left_anti")


def boolean(docs: DataFrame, postings: DataFrame, field: str, must: list[str] = (), should: list[str] = (), must_not: list[str] = ()) -> DataFrame:
    """doc_id of docs with every `must`, at least one `should` if any is given, and no `must_not`."""
    steps = []
    if must:
        steps.append(lambda d: d.join(all_of(postings, field, list(must)), "doc_id", "left_semi"))
    if should:
        steps.append(lambda d: d.join(any_of(postings, field, list(should)), "doc_id", "left_semi"))
    if must_not:
        steps.append(lambda d: none_of(d, postings, field, list(must_not)))
    return reduce(lambda d, f: f(d), steps, docs.select("doc_id"))
