"""The pipeline's stages in order, and each stage's decision against its operator."""

import __spark_entry__ as entry
import corpus_pipeline
from lexicask.llm import mixing, neardup, packing, quality


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        path = f"{tmp_path}/{k}"
        out.write.parquet(path)
        kept = spark.read.parquet(path)
        if k < 4:
            assert kept.columns == columns
            seen.append(kept.count())
        if k == 0:
            good = {r.doc_id for r in quality.decide(quality.ledger(docs)).collect() if r.kept}
            assert {r.doc_id for r in kept.collect()} == good and 0 < len(good) < seen[0]
        if k == 2:
            classes = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
            assert {r.doc_id for r in kept.collect()} == {d for d, c in classes.items() if c == d}
        docs = kept
    assert seen == sorted(seen, reverse=True) and seen[3] == seen[4]
    pieces = docs.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(pieces) == seen[4] and all(r["sum(length)"] == r["max(doc_tokens)"] for r in pieces)


def test_mixture_survives_packing(spark, sf, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 16, raising=False)
    packed, mix, weights = corpus_pipeline.STAGES[4], mixing.mix, {}
    monkeypatch.setattr(mixing, "mix", lambda docs, **given: mix(docs, weights=dict(weights)))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("pfair_mixing", corpus_pipeline.pfair_mixing), packed])
    sources = sorted({r.source or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("source").collect()})

    def run(heavy):
        weights.update({s: 100.0 if s == heavy else 1.0 for s in sources})
        return sorted((r.sequence_id, r.offset, r.doc_id) for r in corpus_pipeline.run(spark, sf).collect())

    first = run(sources[0])
    assert first == run(sources[0]) and first != run(sources[-1])


def test_registered():
    names = list(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_evidence", "weighted_minhash", "pfair_mixing", "curve_packing"]
