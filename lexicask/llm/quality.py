"""Quality rules as a bitmask ledger. DataFrame functions only.

`ledger` evaluates every rule once for each document and keeps the measurements and one bit per failed rule.
`decide` applies a versioned policy (a mask of the rules that count) to a ledger without reading the text again, and
`ablations` says what each rule of a policy rejects alone, from counts of the distinct bit patterns.

Defined results: null and empty texts have no words and fail `few_words`; repeated rows are judged one by one; an empty
table gives an empty ledger; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicask.llm.common import table

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: Name and failure condition of each rule; the place in the list is the rule's bit and never changes.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("shouting", "2 * n_exclaims > n_words"),
]
BASE = ("few_words", "repeated_windows")
#: Rules that each version of the policy enforces.
POLICIES = {"v1": BASE, "v2": tuple(name for name, _ in RULES)}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_exclaims"]


def mask(version: str) -> int:
    bits = {name: 1 << k for k, (name, _) in enumerate(RULES)}
    return sum(bits[name] for name in POLICIES[version])


def _repeat_words(words: F.Column) -> F.Column:
    """Words that lie in a window of three words found twice or more: sort (window hash, place), keep those equal to a neighbour, add up the covered places. n log n for any text."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(
        F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))),
        lambda x, i: F.struct(F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)).alias("h"), i.alias("i")),
    )
    same = lambda s, k, x: F.coalesce(F.get(s, k).getField("h") == x.getField("h"), F.lit(False))
    twins = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: same(s, k - 1, x) | same(s, k + 1, x)), lambda x: x.getField("i")))
    covered = lambda p: F.aggregate(
        p,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a.getField("n") + F.least(F.lit(3), x - a.getField("last"))).alias("n")),
        lambda a: a.getField("n"),
    )
    # a value bound by transform(array(value), ...) is evaluated once however often the lambda uses it
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    return bound(hashes, lambda h: bound(F.sort_array(windows(h)), lambda s: covered(twins(s))))


def ledger(docs: DataFrame, keep: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, the measurements and fail_bits; keep: also row, a struct of all its columns."""
    row = [F.struct(*docs.columns).alias("row")] if keep else []
    text = F.coalesce(F.col("text"), F.lit(""))
    first = docs.select("doc_id", *row, text.alias("_t"), F.array_remove(F.split(text, SPACE), "").alias("_w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    measured = first.select(
        "doc_id",
        *(["row"] if keep else []),
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w")).alias("n_repeat_words"),
        (F.length("_t") - F.length(F.replace(F.col("_t"), F.lit("!"), F.lit("")))).cast("long").alias("n_exclaims"),
    )
    bits = [F.when(F.expr(rule), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, (_, rule) in enumerate(RULES)]
    return measured.withColumn("fail_bits", sum(bits[1:], bits[0]))


def decide(book: DataFrame, version: str = "v2") -> DataFrame:
    """The ledger with base_failed and kept under one version of the policy."""
    base = sum(1 << k for k, (name, _) in enumerate(RULES) if name in BASE)
    return book.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(base)) != 0).withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(version) | base)) == 0)


def ablations(book: DataFrame, version: str = "v2") -> DataFrame:
    """For each rule of a version: documents it fails, those that it alone rejects (kept without it), and kept documents with the whole policy.

    Counts of the distinct bit patterns (at most 2 ** len(RULES) rows) are all that is shuffled.
    """
    on = mask(version)
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(on)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, (name, _) in enumerate(RULES) if on >> k & 1])
    each = patterns.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    return each.groupBy("rule", "bit").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("n_kept"),
    )


def stage(docs: DataFrame, version: str = "v2") -> DataFrame:
    """The documents, with their own columns, that the policy keeps."""
    return decide(ledger(docs, keep=True), version).filter("kept").select("row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(ledger(table(spark, sf_dir, "documents"))).select("doc_id", *[m for m in MEASURES if m not in ("n_lines", "n_exclaims")], "base_failed", "kept", "n_lines", "n_exclaims", "fail_bits")


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM g),
twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, s) > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(t, '!'))::BIGINT AS n_exclaims
  FROM d LEFT JOIN cov ON cov.rid = d.rid),
b AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
    + 8 * (100 * n_dup_lines > 50 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT + 64 * (2 * n_exclaims > n_words)::BIGINT AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, n_exclaims, fail_bits FROM b
"""
