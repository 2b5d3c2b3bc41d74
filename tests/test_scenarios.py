"""Single-token scenarios at each feature level: listing, seeking, frequencies, positions, block boundaries."""

import pytest
from pyspark.sql import functions as F

from lexicask.operators import build, lookup
from lexicask.schema import OCCURRENCES, Features

D, T, P = Features.DOC, Features.TERM_FREQUENCY, Features.POSITIONS


def postings(spark, level, docs, token="x", field="f"):
    rows = [(field, d, p, token) for d, positions in docs.items() for p in positions]
    return build.postings(spark.createDataFrame(rows, OCCURRENCES), level)


def listed(df):
    return [(r.doc_id, r.tf, r.positions) for r in df.orderBy("doc_id").collect()]


LISTS = [
    (D, {5: [0]}, [(5, 1, [])]),
    (D, {d: [0] for d in (1, 3, 7, 9)}, [(d, 1, []) for d in (1, 3, 7, 9)]),
    (T, {1: [0, 3, 7]}, [(1, 3, [])]),
    (T, {1: [0, 1], 5: [0], 9: [0, 1, 2]}, [(1, 2, []), (5, 1, []), (9, 3, [])]),
    (P, {42: [5, 10]}, [(42, 2, [5, 10])]),
    (P, {1: [0, 2], 3: [1], 6: [0, 4, 8]}, [(1, 2, [0, 2]), (3, 1, [1]), (6, 3, [0, 4, 8])]),
    (D, {1: [0, 1, 2], 2: [0]}, [(1, 1, []), (2, 1, [])]),
    (T, {7: [0, 3, 9]}, [(7, 3, [])]),
    (D, {1: [0, 1], 2: [0]}, [(1, 1, []), (2, 1, [])]),
    (T, {1: [0, 5]}, [(1, 2, [])]),
    (P, {1: [3, 6], 2: [0]}, [(1, 2, [3, 6]), (2, 1, [0])]),
    (P, {d: [d, d + 1000] for d in range(259)}, [(d, 2, [d, d + 1000]) for d in range(259)]),
    (D, {d: [0] for d in range(384)}, [(d, 1, []) for d in range(384)]),
]


@pytest.mark.parametrize("level, docs, expected", LISTS)
def test_listing(spark, level, docs, expected):
    assert listed(lookup.lookup(postings(spark, level, docs), "f", "x", level)) == expected


SEEKS = [
    (D, {d: [0] for d in (2, 4, 6, 8)}, [(4, 4), (6, 6), (7, 8), (9, None)]),
    (D, {d: [0] for d in (10, 20, 30)}, [(15, 20), (25, 30), (31, None)]),
    (T, {d: [0] for d in range(1, 6)}, [(3, 3), (4, 4), (5, 5), (6, None)]),
    (P, {d: [0] for d in (10, 20, 30, 40)}, [(11, 20), (30, 30), (31, 40), (41, None)]),
    (P, {10: [1, 5], 20: [3], 30: [0, 7]}, [(20, 20), (21, 30)]),
    (P, {d: [d] for d in range(259)}, [(256, 256)]),
    (D, {d: [0] for d in range(266)}, [(261, 261), (262, 262)]),
    (D, {d: [0] for d in (5, 10, 15)}, [(10, 10), (11, 15), (16, None)]),
    (D, {3: [0]}, [(4, None), (3, 3)]),  # past a single document
    (D, {1: [0], 2: [0]}, [(9, None), (9, None)]),  # past the end, again and again
]


@pytest.mark.parametrize("level, docs, seeks", SEEKS)
def test_seek(spark, level, docs, seeks):
    p = postings(spark, level, docs).cache()
    targets = spark.createDataFrame([("f", "x", t) for t, _ in seeks], "field string, token string, target long")
    assert {r.target: r.doc_id for r in lookup.seek_batch(p, targets).collect()} == dict(seeks)
    t, d = seeks[0]
    assert [r.doc_id for r in lookup.seek(p, "f", "x", t).collect()] == ([] if d is None else [d])
    p.unpersist()


def test_seek_then_next_and_positions(spark):
    p = postings(spark, P, {10: [1, 5], 20: [3], 30: [0, 7]})
    assert listed(lookup.seek(p, "f", "x", 20)) == [(20, 1, [3])]
    assert listed(lookup.following(p, "f", "x", 20)) == [(30, 2, [0, 7])]
    assert listed(lookup.following(p, "f", "x", 30)) == []


def test_missing_token_and_levels(spark):
    p = postings(spark, P, {1: [0, 1]})
    assert listed(lookup.lookup(p, "f", "ghost")) == []
    assert listed(lookup.lookup(p, "f", "x", T)) == [(1, 2, [])]
    assert listed(lookup.lookup(p, "f", "x", D)) == [(1, 1, [])]
    assert [(x.has_term_frequency, x.has_positions) for x in (D, T, P)] == [(False, False), (True, False), (True, True)]


def test_tokens_and_fields_are_isolated(spark):
    rows = [("f", d, 0, "a") for d in (1, 7)] + [("f", d, 0, "b") for d in (10, 20)] + [("f", d, 0, "a:b") for d in (3, 4)] + [("g", 2, 0, "a")]
    p = build.postings(spark.createDataFrame(rows, OCCURRENCES))
    found = lookup.seek_batch(p, spark.createDataFrame([("f", "b", 5), ("f", "a", 2), ("f", "a:b", 0), ("g", "a", 0)], "field string, token string, target long"))
    assert {(r.field, r.token): r.doc_id for r in found.collect()} == {("f", "b"): 10, ("f", "a"): 7, ("f", "a:b"): 3, ("g", "a"): 2}


def test_stats(spark):
    docs = {1: [0, 1, 2], 2: [0]}
    for level, total in ((D, 2), (T, 4), (P, 4)):
        (r,) = build.token_stats(postings(spark, level, docs)).collect()
        assert (r.doc_frequency, r.term_frequency, r.single_docid) == (2, total, None)
    (r,) = build.token_stats(postings(spark, P, {9: [0, 1]})).collect()
    assert (r.doc_frequency, r.term_frequency, r.single_docid) == (1, 2, 9)


def test_blocks(spark):
    sizes = {"one": 1, "two": 2, "full": 256, "more": 257, "three": 513}
    rows = [("f", d * 1000, 0, t) for t, n in sizes.items() for d in range(n)]
    found = build.blocks(build.postings(spark.createDataFrame(rows, OCCURRENCES), D)).orderBy("token", "block_no").collect()
    assert {t: sum(r.token == t for r in found) for t in sizes} == {"one": 0, "two": 1, "full": 1, "more": 2, "three": 3}
    assert [(r.block_no, r.first_docid, r.last_docid, r.n_docs) for r in found if r.token == "more"] == [(0, 0, 255000, 256), (1, 256000, 256000, 1)]


def test_unicode_tokens(spark):
    df = spark.createDataFrame([(0, "naïve café—x2 ½ Ⅻ don't foo_bar 你好 नमस्ते"), (1, "…"), (2, None)], "doc_id long, text string")
    rows = build.occurrences(df, {"f": "text"}).orderBy("doc_id", "pos").collect()
    assert [r.token for r in rows] == ["naïve", "café", "x2", "½", "Ⅻ", "don", "t", "foo", "bar", "你好", "नमस", "ते"]
    assert [r.pos for r in rows] == list(range(12))


def test_sums_hold(spark, sf):
    o = build.occurrences(spark.read.parquet(f"{sf}/documents.parquet"), {"f": "text"})
    p = build.postings(o).cache()
    assert p.filter(F.size("positions") != F.col("tf")).count() == 0
    assert p.agg(F.sum("tf")).first()[0] == o.count()
    s = build.token_stats(p)
    assert s.agg(F.sum("doc_frequency")).first()[0] == p.count()
    p.unpersist()
