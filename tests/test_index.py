import os
import shutil

import pytest
from pyspark.sql import functions as F

from lexicask.operators import build, lookup, search
from lexicask.plans import catalogue
from lexicask.plans.index import Index, IndexRefused, drop
from lexicask.plans.ingest import ingest
from lexicask.plans.numbering import dense_ids
from lexicask.schema import OCCURRENCES, Features
from lexicask.streaming.ingest import ingest_stream

P = {"f": Features.POSITIONS}


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_generations_equal_bulk(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/documents.parquet")
    whole = Index.open(spark, f"{tmp_path}/whole", P).append(source, {"f": "text"})
    parts = Index.open(spark, f"{tmp_path}/parts", P)
    for low, high in ((0, 1), (1, 70), (70, 10**9)):
        parts = parts.append(source.filter((F.col("doc_id") >= low) & (F.col("doc_id") < high)), {"f": "text"})
    merged = parts.compact()
    for other in (parts, merged):
        for name in ("postings", "token_stats", "doc_stats", "blocks"):
            a, b = getattr(whole, name)(), getattr(other, name)()
            assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, name
    assert len(parts.manifest.generations) == 3 and len(merged.manifest.generations) == 1
    old = {r.doc_id for r in parts.lookup("f", "the").collect()}  # a reader of the old manifest still sees its files
    assert merged.vacuum() == 3
    assert {r.doc_id for r in Index.open(spark, f"{tmp_path}/parts").lookup("f", "the").collect()} == old
    assert merged.size_hint("f", "the") == len(old) and merged.size_hint("f", "ghost") == 0


def test_single_hit_promotion_and_seek(spark, tmp_path):
    index = Index.open(spark, f"{tmp_path}/i", P).append(docs(spark, [(1, "t t")]), {"f": "text"})
    (r,) = index.token_stats().collect()
    assert (r.doc_frequency, r.term_frequency, r.single_docid) == (1, 2, 1) and index.blocks().count() == 0
    index = index.append(docs(spark, [(5, "t")]), {"f": "text"})
    (r,) = index.token_stats().collect()
    assert (r.doc_frequency, r.term_frequency, r.single_docid) == (2, 3, None)
    assert index.blocks().first()["first_docid"] == 1
    assert [x.doc_id for x in index.seek("f", "t", 2).collect()] == [5] and index.seek("f", "t", 6).count() == 0
    targets = spark.createDataFrame([("f", "t", 0), ("f", "t", 6)], "field string, token string, target long")
    assert {(x.target, x.doc_id) for x in index.seek_batch(targets).collect()} == {(0, 1), (6, None)}


def test_docids(spark, tmp_path):
    index = Index.open(spark, f"{tmp_path}/i", P).append(docs(spark, [(0, "…"), (1, "x")]), {"f": "text"})
    assert index.manifest.next_docid == 2 and index.manifest.n_docs == 2
    for bad in ([(0, "again")], [(2, "a"), (2, "b")], [(None, "a")]):
        with pytest.raises(IndexRefused):
            index.append(docs(spark, bad), {"f": "text"})
    assert index.append(docs(spark, []), {"f": "text"}) is index
    with pytest.raises(IndexRefused):
        index.append(docs(spark, [(9, "a")]), {"g": "text"})


def test_features_are_stored(spark, tmp_path):
    Index.open(spark, f"{tmp_path}/i", {"f": Features.DOC}).append(docs(spark, [(1, "w w w"), (2, "w")]), {"f": "text"})
    with pytest.raises(IndexRefused):
        Index.open(spark, f"{tmp_path}/i", P)
    index = Index.open(spark, f"{tmp_path}/i")
    assert [(r.doc_id, r.tf, r.positions) for r in index.lookup("f", "w").orderBy("doc_id").collect()] == [(1, 1, []), (2, 1, [])]
    with pytest.raises(IndexRefused):
        index.features("g")
    with pytest.raises(IndexRefused):
        Index.open(spark, f"{tmp_path}/none")


def test_a_second_writer_is_refused(spark, tmp_path):
    one = Index.open(spark, f"{tmp_path}/i", P)
    one.append(docs(spark, [(0, "a")]), {"f": "text"})
    with pytest.raises(IndexRefused):
        one.append(docs(spark, [(0, "b")]), {"f": "text"})
    assert [r.token for r in Index.open(spark, f"{tmp_path}/i").token_stats().collect()] == ["a"]


def test_own_tokens(spark, tmp_path):
    rows = spark.createDataFrame([("f", 3, 0, "a:b"), ("f", 3, 7, "")], OCCURRENCES)
    index = Index.open(spark, f"{tmp_path}/i", P).append_occurrences(rows, spark.createDataFrame([(3,)], "doc_id long"))
    assert index.lookup("f", "").first()["positions"] == [7] and index.lookup("f", "a").count() == 0


def test_lookup_prunes(spark, sf, tmp_path):
    index = Index.open(spark, f"{tmp_path}/i", P).append(spark.read.parquet(f"{sf}/documents.parquet"), {"f": "text"})
    plan = index.lookup("f", "the").select("doc_id")._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x)
    assert "EqualTo(token,the)" in scan and "bucket" in scan.split("PartitionFilters")[1] and "positions" not in scan.split("ReadSchema")[1]


def test_search_prunes(spark, sf, tmp_path):
    """Only the buckets of the query's tokens are read; results as over all postings."""
    source = spark.read.parquet(f"{sf}/documents.parquet")
    index = Index.open(spark, f"{tmp_path}/i", P).append(source, {"f": "text"})
    targets = spark.createDataFrame([("f", "the", 5), ("f", "of", 60), ("f", "ghost", 1)], "field string, token string, target long")
    for df in (index.bm25("f", ["the", "of"]), index.phrase("f", ["of", "the"]), index.all_of("f", ["the", "of"]), index.seek_batch(targets)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        scans = [x for x in plan.splitlines() if "FileScan" in x and "token#" in x]
        assert scans and all("bucket" in x.split("PartitionFilters: [")[1].split("]")[0] for x in scans)
    assert index.all_of("f", ["the", "of"]).count() == search.all_of(index.postings(), "f", ["the", "of"]).count() > 0
    got = [r.doc_id for r in index.lookup("f", "the", ordered=True).collect()]
    assert got == sorted(got) and len(got) == index.size_hint("f", "the")
    with pytest.raises(IndexRefused):
        Index.open(spark, f"{tmp_path}/d", {"f": Features.DOC}).phrase("f", ["a"])


def test_document_postings_equal_grouped_occurrences(spark, sf):
    source = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionAll(docs(spark, [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "b a b … a a"), (10**6 + 3, "x " * 30000)]))
    for level in Features:
        a = build.document_postings(source, {"f": "text", "g": F.lit("z y z")}, level)
        b = build.postings(build.occurrences(source, {"f": "text", "g": F.lit("z y z")}), level).select(*a.columns)
        assert a.dtypes == b.dtypes and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert "Exchange" not in a._jdf.queryExecution().executedPlan().toString()


def test_batched_seeks_over_slices(spark, monkeypatch):
    monkeypatch.setattr(lookup, "SLICE", 10)
    rows = [("f", t, d) for t, ids in (("a", [0, 3, 9, 10, 55, 99]), ("b", [42])) for d in ids]
    targets = [("f", t, d) for t in ("a", "b", "c") for d in (0, 1, 9, 10, 11, 42, 43, 56, 99, 100)]
    got = {(r.token, r.target): r.doc_id for r in lookup.seek_batch(spark.createDataFrame(rows, "field string, token string, doc_id long"), spark.createDataFrame(targets + targets[:3], "field string, token string, target long")).collect()}
    assert got == {(t, x): min((d for _, u, d in rows if u == t and d >= x), default=None) for _, t, x in targets}


def test_stat_and_drop(spark, tmp_path):
    path = f"{tmp_path}/i"
    index = Index.open(spark, path, P).append(docs(spark, [(0, "a b"), (1, "b")]), {"f": "text"})
    found = {(r.field, r.section): r.rows for r in index.stat().collect() if r.bytes > 0 and r.size}
    assert found == {("f", "postings"): 3, ("f", "token_stats"): 2, ("f", "doc_stats"): 2}
    assert drop(spark, path) == "dropped" and drop(spark, path) == "skipped"


def test_ingest_batches_and_limit(spark, tmp_path):
    source = docs(spark, [(k, f"word{k % 3} é") for k in range(10)])
    index, said = ingest(Index.open(spark, f"{tmp_path}/i", P), source, {"f": "text"}, limit=7, batch_size=3)
    assert (said["n_docs"], said["next_docid"], len(index.manifest.generations)) == (7, 7, 3) and said["total_bytes"] == 7 * 8
    index, said = ingest(index, source, {"f": "text"})
    assert said["next_docid"] == 17 and index.size_hint("f", "é") == 17


def test_stream(spark, tmp_path):
    source = docs(spark, [(k, "a b") for k in range(4)])
    source.coalesce(1).write.parquet(f"{tmp_path}/in")
    index = Index.open(spark, f"{tmp_path}/i", P)
    stream = spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in")
    ingest_stream(stream, index, {"f": "text"}, f"{tmp_path}/c").awaitTermination()
    assert Index.open(spark, f"{tmp_path}/i").size_hint("f", "a") == 4
    docs(spark, [(9, "a")]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    ingest_stream(stream, index, {"f": "text"}, f"{tmp_path}/c").awaitTermination()
    index = Index.open(spark, f"{tmp_path}/i")
    assert index.size_hint("f", "a") == 5 and index.manifest.next_docid == 10
    assert index.append(docs(spark, [(50, "x")]), {"f": "text"}, batch=("stream", 0)) is index  # replayed


def test_dense_ids(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("text")).repartition(7)
    got = dense_ids(rows, ["k"], f"{tmp_path}/w", start=5)
    assert got.columns == ["doc_id", "k", "text"] and got.filter("doc_id <> k + 5").count() == 0 and got.count() == 1000
    assert dense_ids(rows.limit(0), ["k"], f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("files", [0, 1, 5])
def test_stream_of_a_table(spark, sf, tmp_path, files):
    """The table is one file (0), or a folder of one file or more; other tables and copies beside it are not read."""
    source, at = spark.read.parquet(f"{sf}/documents.parquet"), f"{tmp_path}/documents.parquet"
    if files:
        source.repartition(files).write.parquet(at)
    else:
        shutil.copy(f"{sf}/documents.parquet", at)
    source.limit(9).write.parquet(f"{tmp_path}/labels.parquet")
    os.makedirs(f"{tmp_path}/old")
    shutil.copy(f"{sf}/documents.parquet", f"{tmp_path}/old/documents.parquet")
    found, whole = catalogue.stream_ingest(spark, str(tmp_path)), catalogue.token_stats(spark, sf)
    assert whole.count() > 0 and found.exceptAll(whole).count() == 0 and whole.exceptAll(found).count() == 0
