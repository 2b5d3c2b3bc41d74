"""Mixing sources to target weights by Pfair scheduling. DataFrame and SQL functions only.

A source's documents, in a fixed pseudo-random order, form blocks of `block` documents. Weights are positive rationals; as whole
numbers without a common divisor they are w, and their sum is the period W. Block j (from 0) of a source is released at slot
floor(j * W / w) and due by slot ceil((j + 1) * W / w). In each slot the released block with the earliest deadline runs, so in any
prefix every source that still has documents is within one block of its exact share w / W, however long the run.
After W slots every source has had exactly w of them, so the schedule of one period, folded from an array of slots in one row (its
size is sources x period, whatever the number of documents), repeats without any rounding. Slots of a source that has run out stay
empty, so every document appears exactly once.

Given weights are taken as the simplest fractions with denominators up to 10,000, and as millionths if these have no common
denominator up to a million. Without given weights a source's weight is its share of the square roots of the sources' sizes in
whole thousandths, one at least; any number of sources is allowed.

Defined results: a null source is the source ''; a source without a given weight has weight 1; null doc_ids come first in their
bucket; repeated rows each get a place; an empty table gives no row. Columns of docs are kept; the added ones are block, slot and
position, and an input column with such a name is replaced.
"""

from __future__ import annotations

from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexicask.llm.common import table

#: Buckets of a source's pseudo-random order (hexadecimal digits of a digest): each is numbered by itself, so no source is one task.
DIGITS = 3
#: Slots of a schedule that are folded together.
STRETCH = 500


def whole_weights(weights: dict[str, float]) -> tuple[dict[str, int], int]:
    """Weights as whole numbers, and the weight 1 on the same scale."""
    exact = {s: Fraction(w).limit_denominator(10_000) for s, w in weights.items()}
    scale = lcm(*(f.denominator for f in exact.values())) if exact else 1
    if scale > 1_000_000 or any(f == 0 for f in exact.values()):
        exact, scale = {s: Fraction(round(w * 1_000_000), 1_000_000) for s, w in weights.items()}, 1_000_000
    if any(f <= 0 for f in exact.values()):
        raise ValueError("a weight must be at least a millionth")
    return {s: int(f * scale) for s, f in exact.items()}, scale


def schedule(counts: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row of arrays over the sources in order: s, n, k (slots in a period) and slots; and period, the number of slots.

    counts: s, n. The fold goes by stretches of slots, so that no array is copied for every slot of a long period.
    """
    # an aggregate of one row between steps: the optimizer would else write a step's expression into the lambdas of the next ones
    held = lambda row: row.agg(*[F.first(c).alias(c) for c in row.columns])
    if weights is None:
        # shares of the square roots in thousandths, in whole numbers so that every engine rounds alike
        weight = "greatest(1L, (2000 * x.r + total) div (2 * total))"
        raw = F.expr("CAST(round(sqrt(n) * 1000) AS BIGINT)")
    else:
        whole, one = whole_weights(weights)
        raw = F.lit(one).cast("long")
        for name, w in whole.items():
            raw = F.when(F.col("s") == F.lit(name), F.lit(w).cast("long")).otherwise(raw)
        weight = "x.r"
    row = counts.select("s", "n", raw.alias("r")).agg(F.sort_array(F.collect_list(F.struct("s", "n", "r"))).alias("a"))
    row = held(row.select("a", F.expr("aggregate(a, 0L, (t, x) -> t + x.r)").alias("total")))
    row = held(row.select("a", F.expr(f"transform(a, x -> {weight})").alias("w")))
    row = held(row.select("a", "w", F.expr("aggregate(w, 0L, (g, x) -> aggregate(sequence(1, 64), named_struct('p', g, 'q', x), (u, i) -> if(u.q = 0, u, named_struct('p', u.q, 'q', u.p % u.q)), u -> u.p))").alias("g")))
    row = held(row.select("a", F.expr("transform(w, x -> x div g)").alias("k"), F.expr("aggregate(w, 0L, (t, x) -> t + x) div g").alias("period")))
    first = "array_min(filter(transform(u.served, (c, i) -> if(c * period div k[i] <= t, named_struct('due', ((c + 1) * period + k[i] - 1) div k[i], 'i', i), NULL)), x -> x IS NOT NULL)).i"
    inner = f"""aggregate(sequence(v.t, least(v.t + {STRETCH} - 1, period - 1)), named_struct('served', v.served, 'runs', CAST(array() AS ARRAY<INT>)),
      (u, t) -> transform(array({first}), p -> named_struct('served', transform(u.served, (c, i) -> c + if(i = p, 1L, 0L)), 'runs', concat(u.runs, array(p))))[0])"""
    fold = f"""aggregate(sequence(0L, period - 1, {STRETCH}L), named_struct('served', transform(k, x -> 0L), 't', 0L, 'runs', CAST(array() AS ARRAY<ARRAY<INT>>)),
      (v, z) -> transform(array({inner}), u -> named_struct('served', u.served, 't', v.t + {STRETCH}, 'runs', concat(v.runs, array(u.runs))))[0], v -> flatten(v.runs))"""
    row = held(row.select("a", "k", "period", F.expr(f"if(size(k) = 0, CAST(array() AS ARRAY<INT>), {fold})").alias("runs")))
    return row.select(
        "period",
        F.expr("transform(a, x -> x.s)").alias("s"),
        F.expr("transform(a, x -> x.n)").alias("n"),
        "k",
        F.expr("transform(k, (x, i) -> filter(transform(runs, (p, t) -> if(p = i, t, -1)), t -> t >= 0))").alias("slots"),
    )


def mix(docs: DataFrame, block: int = 8, weights: dict[str, float] | None = None, source: str = "source") -> DataFrame:
    """docs with block (of its source), slot and position (dense, from 0) in the mixture."""
    own = docs.drop("block", "slot", "position")
    # the caller's columns travel in a struct, so that none of their names can clash
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = own.select(F.struct(*own.columns).alias("_row"), F.col("doc_id").alias("_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_s"), key.alias("_h")).withColumn("_b", F.substring("_h", 1, DIGITS))
    light = docs.select(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_s"), F.substring(key, 1, DIGITS).alias("_b"))
    # counts of each bucket of each source, at most 16 ** DIGITS for a source, and the documents before each
    sizes = light.groupBy("_s", "_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_s", "_b", (F.sum("_n").over(Window.partitionBy("_s").orderBy("_b")) - F.col("_n")).alias("_before"))
    plan = schedule(sizes.groupBy(F.col("_s").alias("s")).agg(F.sum("_n").alias("n")), weights)
    per_source = plan.select("period", F.explode(F.arrays_zip("s", "k", "slots")).alias("p")).select(F.col("p.s").alias("_s"), F.col("p.k").alias("_k"), F.col("p.slots").alias("_slots"), F.col("period").alias("_w"))
    ranked = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", "_id")) - 1)
    ranked = ranked.join(before, ["_s", "_b"]).withColumn("_g", F.col("_before") + F.col("_r"))
    placed = (
        ranked.join(F.broadcast(per_source), "_s")  # a row for each source; together one number for each slot of a period
        .withColumn("block", F.expr(f"_g div {block}"))
        .withColumn("slot", F.expr("(block div _k) * _w + _slots[CAST(block % _k AS INT)]"))
        .withColumn("_plan", plan.select(F.struct("n", "k", "slots", "period")).scalar())
    )
    # a source's slots before slot t of a period are floor(t * k / W), or one more: the schedule is never a whole block off
    floor = "((slot % _w) * _plan.k[i]) div _w"
    before_it = f"(slot div _w) * _plan.k[i] + {floor} + if(coalesce(get(_plan.slots[i], CAST({floor} AS INT)) < slot % _w, false), 1, 0)"
    position = f"aggregate(sequence(0, size(_plan.n) - 1), 0L, (t, i) -> t + least(_plan.n[i], {block} * ({before_it}))) + _g % {block}"
    return placed.withColumn("position", F.expr(position)).select(*[F.col("_row").getField(c).alias(c) for c in own.columns], "block", "slot", "position")


def stage(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The documents, with their own columns, range-sorted in the order of the mixture."""
    mixed = mix(docs.select(F.struct(*docs.columns).alias("_docs"), "doc_id", "source"), weights=weights)
    return mixed.repartitionByRange("position").sortWithinPartitions("position").select("_docs.*")


def op1_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


OP1_SQL = """
WITH RECURSIVE c AS (SELECT coalesce(source, '') AS s, count(*)::BIGINT AS n, round(sqrt(count(*)) * 1000)::BIGINT AS r FROM documents GROUP BY 1),
z AS (SELECT s, n, row_number() OVER (ORDER BY s) AS i, greatest(1, (2000 * r + sum(r) OVER ()) // (2 * sum(r) OVER ()))::BIGINT AS w FROM c),
d AS (SELECT max(q) AS d FROM (SELECT unnest(range(1, (SELECT min(w) + 1 FROM z))) AS q) WHERE (SELECT bool_and(w % q = 0) FROM z)),
x AS (SELECT s, n, i, w // d AS k FROM z, d),
ks AS (SELECT list(k ORDER BY i) AS k, sum(k)::BIGINT AS w FROM x),
e AS (
  SELECT 0::BIGINT AS t, list_transform(k, lambda v: 0::BIGINT) AS served, 0::BIGINT AS pick, k, w FROM ks
  UNION ALL
  SELECT t + 1, list_transform(served, lambda v, j: v + (j = p)::BIGINT), p, k, w
  FROM (SELECT t, served, k, w, list_min(list_filter(list_transform(served, lambda v, j: CASE WHEN v * w // k[j] <= t THEN {'due': ((v + 1) * w + k[j] - 1) // k[j], 'j': j} END), lambda v: v IS NOT NULL)).j::BIGINT AS p FROM e WHERE t < w)),
runs AS (SELECT t - 1 AS t, pick, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth FROM e WHERE t > 0),
g AS (SELECT doc_id, coalesce(source, '') AS s, source, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS g FROM documents)
SELECT doc_id, source, g // 8 AS block, (g // 8 // x.k) * (SELECT w FROM ks) + runs.t AS slot,
       row_number() OVER (ORDER BY (g // 8 // x.k) * (SELECT w FROM ks) + runs.t, g % 8) - 1 AS position
FROM g JOIN x ON x.s = g.s JOIN runs ON runs.pick = x.i AND runs.nth = (g // 8) % x.k
"""
