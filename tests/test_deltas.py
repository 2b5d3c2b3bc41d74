from pyspark.sql import functions as F

from lexicask.functions.deltas import deltas, packed_stats, undeltas, unpacked_stats


def test_lists(spark):
    lists = [[], [0], [5], [0, 0, 3, 7, 7, 1000000], [9, 10], None]
    df = spark.createDataFrame([(x,) for x in lists], "a array<long>").select("a", deltas(F.col("a")).alias("d"))
    rows = df.select("a", "d", undeltas(F.col("d")).alias("b")).collect()
    assert [r.b for r in rows] == lists and rows[3].d == [0, 0, 3, 4, 0, 999993] and rows[0].d == []


def test_stats(spark):
    df = spark.createDataFrame([(1, 4, 0), (1, 2, 77), (2, 9, None), (300, 300, None)], "df long, tf long, one long")
    packed = df.select("*", packed_stats(F.col("df"), F.col("tf"), F.col("one")).alias("p"))
    rows = packed.select("*", unpacked_stats(F.col("p")).alias("u")).collect()
    assert all((r.u.doc_frequency, r.u.term_frequency, r.u.single_docid) == (r.df, r.tf, r.one) for r in rows)
    assert [r.p.key for r in rows] == [1, 155, 4, 600]
