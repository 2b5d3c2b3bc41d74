"""Delta forms of ascending lists and the packed form of token statistics, as column expressions. Parquet does this work for stored indexes; these serve exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Items of a list that are summed together.
STRETCH = 1000


def deltas(values: Column) -> Column:
    """First value, then differences of neighbours. Null: null; empty: empty."""
    before = F.slice(F.concat(F.array(F.lit(0).cast("long")), values), F.lit(1), F.size(values))
    return F.zip_with(values, before, lambda x, y: x - y)


def undeltas(values: Column) -> Column:
    """The list whose deltas are given. The running sum is kept in stretches of `STRETCH`, so that no long list is copied for each of its items."""
    start = lambda t: F.struct(t.alias("t"), F.array().cast("array<long>").alias("a"))
    step = lambda s, x: F.struct((s["t"] + x).alias("t"), F.concat(s["a"], F.array(s["t"] + x)).alias("a"))
    whole = values.cast("array<long>")
    stretches = F.sequence(F.lit(1), F.size(whole), F.lit(STRETCH))
    outer = F.struct(F.lit(0).cast("long").alias("t"), F.array().cast("array<array<long>>").alias("a"))
    bound = lambda s, at: F.get(F.transform(F.array(F.aggregate(F.slice(whole, at, F.lit(STRETCH)), start(s["t"]), step)), lambda u: F.struct(u["t"].alias("t"), F.concat(s["a"], F.array(u["a"])).alias("a"))), F.lit(0))
    return F.when(F.size(whole) > 0, F.aggregate(stretches, outer, bound, lambda s: F.flatten(s["a"]))).otherwise(whole)


def packed_stats(doc_frequency: Column, term_frequency: Column, single_docid: Column) -> Column:
    """(key, term_frequency): key is the document of a token of one document with a low bit 1, else the document frequency with a low bit 0."""
    key = F.when(doc_frequency == 1, F.shiftleft(single_docid, 1).bitwiseOR(F.lit(1))).otherwise(F.shiftleft(doc_frequency, 1))
    return F.struct(key.alias("key"), term_frequency.alias("term_frequency"))


def unpacked_stats(packed: Column) -> Column:
    """(doc_frequency, term_frequency, single_docid) of packed statistics."""
    key, single = packed["key"], packed["key"].bitwiseAND(F.lit(1)) == 1
    value = F.shiftright(key, 1)
    return F.struct(F.when(single, F.lit(1).cast("long")).otherwise(value).alias("doc_frequency"), packed["term_frequency"].alias("term_frequency"), F.when(single, value).alias("single_docid"))
