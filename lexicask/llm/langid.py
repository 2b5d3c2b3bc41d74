"""Language identification by Bayesian evidence fusion.

Evidence for each row: its text, the language its markup declares, the suffix of its address and its host.

1. Text: a naive Bayes model of hashed byte trigrams for every declared language, fitted on a bounded sample of rows that declare
   it, and one for text of no known language (und): trigrams of independent bytes, with the byte frequencies of the whole sample,
   towards which the languages' models are smoothed.
   A text's log-likelihood counts for `WEIGHT` trigrams at most, so that a long text does not silence all other evidence by length.
2. Declared language: how far declarations can be trusted is learnt from all rows, as smoothed counts of (declared, the text's
   language) that a grouped aggregation gives. Declarations that no row's text bears out say nothing by themselves.
3. Host: language shares of the texts of each host, smoothed towards its suffix's shares, which are smoothed towards those of all
   rows. All are grouped aggregations; hosts are joined, never collected.
A row's own text is taken out of the counts of 2 and 3 before they judge it, so no evidence counts twice.

The fused posterior is the normalised product. A row is kept if its language is known, wanted, and more probable than all others
together. There is no limit to the number of languages that documents may declare; a table with more than `MOST` tags is refused.

Defined results: a null or empty text gives no text evidence; null or unknown declarations, hosts and suffixes give none of
theirs; rows with no evidence at all get the prior, and no language (und) if that does not decide; of equally probable languages
the first by name is named, but with a half or less it is und; repeated rows are judged one by one; the order of the rows does not
matter; an empty table, or one in which nothing is declared, has only the language und and rejects nothing but what is unwanted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexicask.llm.common import shared_dir, slices, store, table, text_buffer

#: Rows of each declared language that the text model is fitted on, about; declared tags beyond which a table is refused (there
#: are 18,278 tags of two or three letters, and the model that tasks receive has 128 KB for each).
SAMPLE, MOST = 2000, 2000
FEATURES = 1 << 15
#: Trigrams that the text's evidence counts for at most.
WEIGHT = 64.0
#: Rows that a parent's shares count for in its child's.
PULL = 20.0


def _trigrams(data: np.ndarray) -> np.ndarray:
    """Feature of the trigram that starts at each byte (the last two are padding)."""
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint32)
    long = np.concatenate([data, np.full(2, 32, np.uint32)])
    return ((long[:-2] << np.uint32(16) | long[1:-1] << np.uint32(8) | long[2:]) * np.uint32(2654435761)) >> np.uint32(17)


def _inside(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Feature of the trigram at each byte of a buffer of texts; FEATURES where it begins at a text's end or crosses into the next text."""
    feature = _trigrams(data)
    feature[starts[1:] - 1] = FEATURES
    feature[np.maximum(starts[1:] - 2, starts[:-1])] = FEATURES
    return feature


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0)


def _unordered(n: np.ndarray) -> np.ndarray:
    """Probability of each feature when bytes follow each other without order. n: how often each of the 256 bytes occurs."""
    p = (n + 1.0) / (n.sum() + 256.0)
    p[65:91], p[97:123] = 0.0, p[97:123] + p[65:91]  # trigrams are lower-cased
    used = np.flatnonzero(p).astype(np.uint32)
    total = np.zeros(FEATURES)
    pair = (used[:, None] << np.uint32(8) | used[None, :]).reshape(-1)
    q = np.outer(p[used], p[used]).reshape(-1)
    for a in used:
        at = (((np.uint32(a) << np.uint32(16)) | pair) * np.uint32(2654435761)) >> np.uint32(17)
        total += p[a] * np.bincount(at, weights=q, minlength=FEATURES)
    return total


@dataclass(frozen=True)
class Evidence:
    """rows: text, _declared (primary subtag, lower case), _suffix, _host, and the caller's columns under inner names, which cannot clash."""

    rows: DataFrame
    inner: dict[str, str]


def evidence(rows: DataFrame, declared: str, address_suffix: str | None, host: str, text: str = "text") -> Evidence:
    tag = F.lower(F.regexp_extract(F.col(declared).cast("string"), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))
    suffix = F.lower(F.col(address_suffix).cast("string")) if address_suffix else F.lit(None).cast("string")
    inner = {c: "text" if c == text else f"_c{k}" for k, c in enumerate(rows.columns)}
    carried = [F.col(f"`{c}`").alias(x) for c, x in inner.items() if c != text]
    own = [F.col(text).cast("string").alias("text"), F.when(~tag.isin("", "und"), tag).alias("_declared"), suffix.alias("_suffix"), F.lower(F.col(host).cast("string")).alias("_host")]
    return Evidence(rows.select(*carried, *own), inner)


def fit(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, the last of them und, and log-probabilities (FEATURES + 1 x languages; the last row is 0) of their trigrams."""
    counts = rows.filter("_declared IS NOT NULL").groupBy("_declared").agg(F.count("*").alias("n")).limit(MOST + 1).collect()
    if len(counts) > MOST:
        raise ValueError(f"more than {MOST} declared languages")
    names = sorted(r["_declared"] for r in counts)
    if not names:
        return ["und"], np.zeros((FEATURES + 1, 1), np.float32)
    share = rows.sparkSession.createDataFrame([(r["_declared"], int(min(1.0, SAMPLE / r["n"]) * (1 << 40)), names.index(r["_declared"])) for r in counts], "_declared string, _below long, _k int")
    place_of = F.pmod(F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind]), F.lit(1 << 40))  # of the whole row, so that copies of one text are not drawn together
    drawn = rows.withColumn("_at", place_of).join(F.broadcast(share), "_declared").filter("_at < _below")  # MOST rows at most
    size = len(names) * FEATURES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sparse sums: what is held are the distinct trigrams of the task's share of the sample
        at, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for some in slices(batch, 4096):
                data, starts = text_buffer(some.column("text"))
                feature = _inside(data, starts).astype(np.int64)
                kind = np.repeat(some.column("_k").to_numpy().astype(np.int64), np.diff(starts))
                plain = np.bincount(data, minlength=256)
                plain[32] -= some.num_rows  # the space after each text is padding
                new = [(kind * FEATURES + feature)[feature < FEATURES], size + np.arange(256)]
                at, place = np.unique(np.concatenate([at, *new]), return_inverse=True)
                total = np.bincount(place, weights=np.concatenate([total, np.ones(len(new[0])), plain])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total)], names=["at", "n"])

    found = drawn.select("_k", "text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = found.column("at").to_numpy(), found.column("n").to_numpy()
    seen = np.zeros((FEATURES, len(names)))
    own = at < size
    seen[at[own] % FEATURES, at[own] // FEATURES] = n[own]
    plain = np.zeros(256)
    plain[at[~own] - size] = n[~own]
    other = _unordered(plain)[:, None]
    # languages are smoothed towards the same independent bytes, so a trigram that none has seen never speaks for one of them
    logs = np.log(np.concatenate([(seen + 0.5 * FEATURES * other) / (seen.sum(axis=0) + 0.5 * FEATURES), other], axis=1))
    return [*names, "und"], np.concatenate([logs, np.zeros((1, len(names) + 1))]).astype(np.float32)


def scored(rows: DataFrame, names: list[str], model: np.ndarray) -> DataFrame:
    """rows with _ll, the text's tempered log-likelihood of each language, and _said, the place of the greatest (null without text)."""
    sent = rows.sparkSession.sparkContext.broadcast(model)  # MOST languages at most
    schema = T.StructType([*rows.schema.fields, T.StructField("_ll", T.ArrayType(T.DoubleType())), T.StructField("_said", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for some in slices(batch, 4096):
                data, starts = text_buffer(some.column("text"))
                feature, lengths = _inside(data, starts), np.diff(starts)
                ll = np.zeros((some.num_rows, len(names)))
                for k in range(len(names)):
                    ll[:, k] = _sums(np.take(model[:, k], feature), starts[:-1])
                n = np.maximum(lengths - 2, 0)
                ll *= (np.minimum(n, WEIGHT) / np.maximum(n, 1))[:, None]
                ll -= ll.max(axis=1, keepdims=True)
                said = pa.array(ll.argmax(axis=1), pa.int32(), mask=n == 0)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(ll.reshape(-1)), len(names)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*some.columns, lists, said], names=[*some.schema.names, "_ll", "_said"])

    return rows.mapInArrow(run, schema)


def _shares(counts: DataFrame, key: list[str], m: int) -> DataFrame:
    """By key, an array of the rows of each language and their sum."""
    sums = [F.sum(F.when(F.col("_said") == k, F.col("n")).otherwise(0)) for k in range(m)]
    return counts.groupBy(*key).agg(F.array(*sums).alias("c"), F.sum("n").alias("total"))


def fuse(rows: DataFrame, names: list[str], wanted: tuple[str, ...] | None = None) -> DataFrame:
    """Scored rows with language, confidence and kept instead of the columns that begin with an underscore. rows: a stored table; it is read twice."""
    spark, m = rows.sparkSession, len(names)
    said = rows.filter("_said IS NOT NULL")
    by_host = said.groupBy("_host", "_suffix", "_said").agg(F.count("*").alias("n"))
    heard = np.zeros((m, m))  # declared, text's language
    for r in said.filter(F.col("_declared").isin(names)).groupBy("_declared", "_said").agg(F.count("*").alias("n")).collect():  # languages squared at most
        heard[names.index(r["_declared"]), r["_said"]] = r["n"]
    overall = _shares(by_host, [], m).first()
    base = np.array([x or 0 for x in overall["c"]], float) + 1.0
    # one row for each language: what is declared, how often with each language of the text, and how often that is at all
    trust = spark.createDataFrame([(name, heard[k].tolist(), heard.sum(axis=0).tolist()) for k, name in enumerate(names)], "_declared string, _heard array<double>, _times array<double>")
    all_rows = F.array(*[F.lit(float(x)) for x in base])
    suffixes = _shares(by_host.filter("_suffix IS NOT NULL"), ["_suffix"], m).select("_suffix", F.col("c").alias("_c_suffix"), F.col("total").alias("_n_suffix"))
    hosts = _shares(by_host.filter("_host IS NOT NULL").withColumn("_suffix", F.coalesce("_suffix", F.lit(""))), ["_host", "_suffix"], m)
    hosts = hosts.select("_host", F.col("_suffix").alias("_host_suffix"), F.col("c").alias("_c_host"), F.col("total").alias("_n_host"))
    joined = rows.withColumn("_host_suffix", F.coalesce("_suffix", F.lit(""))).join(hosts, ["_host", "_host_suffix"], "left").join(suffixes, "_suffix", "left").join(F.broadcast(trust), "_declared", "left")
    mine = lambda i: F.when(i == F.col("_said"), 1.0).otherwise(0.0)  # noqa: E731  the row's own text, which is in all these counts
    one = F.when(F.col("_said").isNotNull(), 1.0).otherwise(0.0)
    joined = joined.withColumn("_prior", F.transform(all_rows, lambda x, i: (x - mine(i)) / (F.lit(float(base.sum())) - one)))
    for level in ("suffix", "host"):
        of = F.col(f"_n_{level}") - one + F.lit(PULL)
        blend = F.zip_with(F.transform(f"_c_{level}", lambda x, i: x - mine(i)), "_prior", lambda x, p: x + F.lit(PULL) * p)
        joined = joined.withColumn("_of", of).withColumn("_prior", F.coalesce(F.transform(blend, lambda x: x / F.col("_of")), "_prior"))
    logs = F.transform("_prior", lambda p: F.log(p))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    trusted = F.transform("_heard", lambda x, i: F.log((x - mine(i) + 0.5) / (F.get("_times", i) - mine(i) + F.lit(0.5 * m))))
    done = joined.withColumn("_score", add(logs, "_ll")).withColumn("_score", F.coalesce(add("_score", trusted), "_score")).withColumn("_top", F.array_max("_score"))
    done = done.withColumn("confidence", 1 / F.aggregate("_score", F.lit(0.0), lambda t, x: t + F.exp(x - F.col("_top"))))
    decided = F.get(F.array(*[F.lit(x) for x in names]), F.array_position("_score", F.col("_top")).cast("int") - 1)
    language = F.when(F.col("confidence") > 0.5, decided).otherwise(F.lit("und"))
    known = F.col("language") != "und" if names != ["und"] else F.lit(True)
    kept = known & (F.col("language").isin(*wanted) if wanted else F.lit(True))
    out = done.withColumn("language", language).withColumn("kept", kept)
    return out.drop("_ll", "_said", "_score", "_top", "_host", "_suffix", "_host_suffix", "_declared", "_prior", "_of", "_heard", "_times", "_c_suffix", "_n_suffix", "_c_host", "_n_host")


def _judged(found: Evidence, carry: list[str], wanted: tuple[str, ...] | None, work: str | None = None) -> tuple[DataFrame, list]:
    """Judged rows with language, confidence and kept, and the carried columns."""
    names, model = fit(found.rows)
    inner = {c: found.inner[c] for c in carry}
    own = scored(found.rows.select(*[x for x in inner.values() if x != "text"], "text", "_declared", "_suffix", "_host"), names, model)
    own = own if "text" in inner.values() else own.drop("text")
    path = f"{work or shared_dir(found.rows.sparkSession)}/scored"
    return fuse(store(own, path), names, wanted), [F.col(x).alias(c) for c, x in inner.items()]


def identify(found: Evidence, carry: list[str], wanted: tuple[str, ...] | None = None, work: str | None = None) -> DataFrame:
    """The columns in carry, language, confidence and kept."""
    judged, carried = _judged(found, carry, wanted, work)
    return judged.select(*carried, "language", "confidence", "kept")


def of_documents(docs: DataFrame, carry: list[str], wanted: tuple[str, ...] | None = None) -> DataFrame:
    """Documents: lang is what is declared, source is the host; documents have no address."""
    return identify(evidence(docs, "lang", None, "source"), carry, wanted)


def of_pages(pages: DataFrame, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """Pages: the lang of <html>, host and last label of the host of url; scripts, styles and tags are no text."""
    # cut after the last '>', so that every alternative that begins also ends: nothing is read twice, however hostile the page
    closed = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?s)^(.*)>", 0)
    tail = F.substring("html", F.length(closed) + 1, F.lit(1 << 30))
    hidden = F.concat(F.regexp_replace(closed, r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*+>.*?(?:</\1[^>]*+>|\z)|<[a-z/!][^>]*+>", " "), F.coalesce(tail, F.lit("")))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    marked = pages.select(
        "page_id",
        hidden.alias("text"),
        F.regexp_extract(F.regexp_extract(closed, r"(?i)<html\b[^>]*+>", 0), r"(?i)\blang\s*+=\s*+[\"']?([A-Za-z-]+)", 1).alias("_lang"),
        F.when(host != "", host).alias("_name"),
    ).withColumn("_end", F.substring_index("_name", ".", -1))
    return identify(evidence(marked, "_lang", "_end", "_name"), ["page_id"], wanted)


def stage(docs: DataFrame, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """The documents, with their own columns, whose language is known and wanted (any language by default)."""
    judged, carried = _judged(evidence(docs, "lang", None, "source"), list(docs.columns), wanted)
    return judged.filter("kept").select(*carried)


def op4_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_documents(table(spark, sf_dir, "documents"), ["doc_id"])


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_pages(table(spark, sf_dir, "pages"))
