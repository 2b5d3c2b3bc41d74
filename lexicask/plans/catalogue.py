"""The queries over the driver's tables that do not need the llm subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicask.functions import deltas
from lexicask.functions.text import format_bytes
from lexicask.operators import build, lookup, search
from lexicask.plans.index import Index
from lexicask.plans.ingest import ingest, text_bytes
from lexicask.plans.numbering import dense_ids
from lexicask.plans.workdir import shared_folder
from lexicask.schema import Features
from lexicask.sources import linedocs
from lexicask.streaming.ingest import ingest_stream, table_stream

TARGETS = [("the", 0), ("the", 10), ("the", 500), ("the", 100_000_000), ("and", 77), ("ghost", 3)]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _fields():
    return {"body": "text", "title": F.substring_index("text", "\n", 1), "label": "source"}


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.occurrences(_documents(spark, sf_dir), {"body": "text"})


def _postings(spark: SparkSession, sf_dir: str, features: Features = Features.POSITIONS) -> DataFrame:
    return build.document_postings(_documents(spark, sf_dir), {"body": "text"}, features)


def work_dir(spark: SparkSession) -> str:
    """A new folder for a stored index: in the cluster's shared folder, where one is set."""
    return shared_folder(spark, "index")


def occurrences(spark, sf_dir):
    return _occurrences(spark, sf_dir).drop("field")


def postings_positions(spark, sf_dir):
    return _postings(spark, sf_dir).drop("field")


def postings_tf(spark, sf_dir):
    return _postings(spark, sf_dir, Features.TERM_FREQUENCY).select("token", "doc_id", "tf")


def postings_doc(spark, sf_dir):
    return _postings(spark, sf_dir, Features.DOC).select("token", "doc_id", "tf")


def token_stats(spark, sf_dir):
    return build.token_stats(_postings(spark, sf_dir, Features.TERM_FREQUENCY)).drop("field")


def token_stats_doc(spark, sf_dir):
    return build.token_stats(_postings(spark, sf_dir, Features.DOC)).drop("field")


def doc_stats(spark, sf_dir):
    return build.doc_stats(_occurrences(spark, sf_dir)).drop("field")


def lookup_token(spark, sf_dir):
    return lookup.lookup(_postings(spark, sf_dir), "body", "the")


def lookup_missing(spark, sf_dir):
    return lookup.lookup(_postings(spark, sf_dir), "body", "ghost")


def seek(spark, sf_dir):
    return lookup.seek(_postings(spark, sf_dir), "body", "the", 100)


def seek_batch(spark, sf_dir):
    targets = spark.createDataFrame([("body", t, d) for t, d in TARGETS], "field string, token string, target long")
    return lookup.seek_batch(_postings(spark, sf_dir, Features.DOC), targets).drop("field")


def posting_blocks(spark, sf_dir):
    return build.blocks(_postings(spark, sf_dir, Features.DOC)).drop("field")


def size_hint(spark, sf_dir):
    return lookup.size_hint(build.token_stats(_postings(spark, sf_dir, Features.TERM_FREQUENCY)), "body", "the", "and", "ghost")


def multi_field_stats(spark, sf_dir):
    return build.token_stats(build.document_postings(_documents(spark, sf_dir), _fields(), Features.TERM_FREQUENCY))


def ingest_metrics(spark, sf_dir):
    return text_bytes(_documents(spark, sf_dir), _fields())


def limit_ingest(spark, sf_dir):
    """The first hundred documents, by ingest's own limit."""
    index, _ = ingest(Index.open(spark, work_dir(spark), {"body": Features.POSITIONS}), _documents(spark, sf_dir), {"body": "text"}, limit=100)
    return index.token_stats().drop("field")


def batched_ingest(spark, sf_dir):
    """Commits of 300 documents at most, then the index's facts."""
    docs = _documents(spark, sf_dir)
    index, said = ingest(Index.open(spark, work_dir(spark), {"body": Features.TERM_FREQUENCY}), docs, {"body": "text"}, batch_size=max(1, docs.count() // 3))
    return spark.createDataFrame([(index.manifest.n_docs, index.manifest.next_docid, said["total_bytes"])], "n_docs long, next_docid long, total_bytes long")


def own_tokens(spark, sf_dir):
    """Postings of occurrences that another tokenizer gives: here white-space words."""
    words = _documents(spark, sf_dir).select(F.lit("body").alias("field"), "doc_id", F.posexplode(F.split("text", " ")).alias("pos", "token"))
    return build.postings(words, Features.POSITIONS).drop("field")


def line_docs(spark, sf_dir):
    """documents written as binary line documents and read back, numbered by their places."""
    path = work_dir(spark)
    docs = _documents(spark, sf_dir)
    linedocs.write(docs.select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), F.col("source").alias("random_label"), F.lit(5).alias("time_of_day_secs"), (F.col("doc_id") * 1000).alias("timestamp_ms")), path)
    return linedocs.read(spark, path).select("doc_id", "title", F.md5("body").alias("body_md5"), "random_label", "time_of_day_secs", "timestamp_ms")


def stream_ingest(spark, sf_dir):
    """A stream of the table's files, every micro-batch one generation."""
    path = work_dir(spark)
    stream = table_stream(spark, f"{sf_dir}/documents.parquet")
    ingest_stream(stream, Index.open(spark, f"{path}/index", {"body": Features.TERM_FREQUENCY}), {"body": "text"}, f"{path}/checkpoint").awaitTermination()
    return Index.open(spark, f"{path}/index").token_stats().drop("field")


def index_stat(spark, sf_dir):
    """Rows of each section of each field of a stored index."""
    index = Index.open(spark, work_dir(spark), {"body": Features.TERM_FREQUENCY, "label": Features.DOC}).append(_documents(spark, sf_dir), {"body": "text", "label": "source"})
    return index.stat().select("field", "section", "rows", (F.col("bytes") > 0).alias("has_bytes"))


def stored_search(spark, sf_dir):
    """Boolean, phrase and batched seeks on a stored index, one row for each answer."""
    docs = _documents(spark, sf_dir)
    index = Index.open(spark, work_dir(spark), {"body": Features.POSITIONS}).append(docs, {"body": "text"})
    targets = spark.createDataFrame([("body", t, d) for t, d in TARGETS], "field string, token string, target long")
    none = F.lit(None).cast("long")
    return (
        index.boolean(docs, "body", must=["the"], must_not=["of"]).select(F.lit("not").alias("kind"), "doc_id", none.alias("n"))
        .unionAll(index.all_of("body", ["the", "of"]).select(F.lit("and"), "doc_id", none))
        .unionAll(index.phrase("body", ["of", "the"]).select(F.lit("phrase"), "doc_id", "n_matches"))
        .unionAll(index.seek_batch(targets).select(F.concat(F.lit("seek "), "token"), "doc_id", "target"))
    )


def stored_bm25(spark, sf_dir):
    index = Index.open(spark, work_dir(spark), {"body": Features.POSITIONS}).append(_documents(spark, sf_dir), {"body": "text"})
    return search.top(index.bm25("body", ["the", "and", "of"]).select("doc_id", F.round("score", 6).alias("score")), 20)


def cursor(spark, sf_dir):
    """A token's postings in ascending order of doc_id, each with the next one's doc_id and the place where its positions begin."""
    found = lookup.lookup(_postings(spark, sf_dir), "body", "of", ordered=True)
    return found.select("doc_id", F.size("positions").alias("n_positions"), F.get("positions", F.lit(0)).alias("first_pos"))


def position_deltas(spark, sf_dir):
    """Positions as deltas, and back."""
    p = _postings(spark, sf_dir).select("token", "doc_id", deltas.deltas(F.col("positions").cast("array<long>")).alias("deltas"))
    return p.select("token", "doc_id", "deltas", deltas.undeltas(F.col("deltas")).alias("positions"))


def packed_stats(spark, sf_dir):
    """Statistics in their packed form, and back."""
    p = token_stats(spark, sf_dir).select("token", deltas.packed_stats(F.col("doc_frequency"), F.col("term_frequency"), F.col("single_docid")).alias("p"))
    back = deltas.unpacked_stats(F.col("p"))
    return p.select("token", F.col("p.key").alias("key"), back["doc_frequency"].alias("doc_frequency"), back["term_frequency"].alias("term_frequency"), back["single_docid"].alias("single_docid"))


def byte_sizes(spark, sf_dir):
    """Bytes of each document's text, as text."""
    n = F.octet_length("text").cast("long") * F.pow(F.lit(7), F.col("doc_id") % 10).cast("long")
    return _documents(spark, sf_dir).select("doc_id", n.alias("n")).select("doc_id", format_bytes(F.col("n")).alias("size"))


def incremental_equals_bulk(spark, sf_dir):
    """Statistics summed over three stored generations."""
    docs = _documents(spark, sf_dir)
    index = Index.open(spark, work_dir(spark), {"body": Features.POSITIONS})
    for low, high in ((0, 1), (1, 437), (437, 1 << 62)):
        index = index.append(docs.filter((F.col("doc_id") >= low) & (F.col("doc_id") < high)), {"body": "text"})
    return index.token_stats().drop("field")


def stored_lookup(spark, sf_dir):
    """A token's postings from a stored and compacted index of two fields."""
    docs = _documents(spark, sf_dir)
    index = Index.open(spark, work_dir(spark), {"body": Features.POSITIONS, "label": Features.DOC})
    for low, high in ((0, 500), (500, 1 << 62)):
        index = index.append(docs.filter((F.col("doc_id") >= low) & (F.col("doc_id") < high)), {"body": "text", "label": "source"})
    return index.compact().lookup("body", "of")


def conversation_stats(spark, sf_dir):
    """A second corpus: doc_ids are minted densely in the order of conversation and turn."""
    docs = dense_ids(spark.read.parquet(f"{sf_dir}/conversations.parquet"), ["conv_id", "turn"], work_dir(spark))
    return build.token_stats(build.postings(build.occurrences(docs, {"text": "text", "role": "role"}), Features.TERM_FREQUENCY))


def bm25_topk(spark, sf_dir):
    occurrences = _occurrences(spark, sf_dir)
    n = _documents(spark, sf_dir).count()
    scores = search.bm25(build.postings(occurrences, Features.TERM_FREQUENCY), build.doc_stats(occurrences), n, "body", ["the", "and", "of"])
    return search.top(scores.select("doc_id", F.round("score", 6).alias("score")), 20)


def phrase(spark, sf_dir):
    return search.phrase(_postings(spark, sf_dir), "body", ["of", "the"])


def bool_and(spark, sf_dir):
    return search.all_of(_postings(spark, sf_dir, Features.DOC), "body", ["the", "of"])


def bool_or(spark, sf_dir):
    return search.any_of(_postings(spark, sf_dir, Features.DOC), "body", ["the", "der"])


def bool_not(spark, sf_dir):
    return search.boolean(_documents(spark, sf_dir), _postings(spark, sf_dir, Features.DOC), "body", must=["the"], must_not=["of"])


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup_token(spark, sf_dir).orderBy("doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        *(occurrences, postings_positions, postings_tf, postings_doc, token_stats, token_stats_doc, doc_stats, lookup_missing, seek, seek_batch, posting_blocks, size_hint),
        *(multi_field_stats, ingest_metrics, limit_ingest, incremental_equals_bulk, stored_lookup, conversation_stats, bm25_topk, phrase, bool_and, bool_or, bool_not),
        *(batched_ingest, own_tokens, line_docs, stream_ingest, index_stat, stored_search, stored_bm25, cursor, position_deltas, packed_stats, byte_sizes),
    )
} | {"lookup": lookup_token}

_O = r"""WITH o AS (SELECT doc_id, unnest(range(len(t)))::INTEGER AS pos, unnest(t) AS token FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS t FROM documents)),
p AS (SELECT token, doc_id, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM o GROUP BY ALL) """
_STATS = "SELECT {}token, count(*) AS doc_frequency, sum(tf)::BIGINT AS term_frequency, CASE WHEN count(*) = 1 THEN min(doc_id) END AS single_docid FROM p {} GROUP BY {}token"
_TARGETS = ", ".join(f"('{t}', {d}::BIGINT)" for t, d in TARGETS)

ORACLE_SQL = {
    "occurrences": _O + "SELECT * FROM o",
    "postings_positions": _O + "SELECT * FROM p",
    "postings_tf": _O + "SELECT token, doc_id, tf FROM p",
    "postings_doc": _O + "SELECT DISTINCT token, doc_id, 1::BIGINT AS tf FROM o",
    "token_stats": _O + _STATS.format("", "", ""),
    "token_stats_doc": _O + "SELECT token, count(*) AS doc_frequency, count(*) AS term_frequency, CASE WHEN count(*) = 1 THEN min(doc_id) END AS single_docid FROM p GROUP BY token",
    "doc_stats": _O + "SELECT doc_id, count(*) AS doc_len FROM o GROUP BY doc_id",
    "lookup": _O + "SELECT doc_id, tf, positions FROM p WHERE token = 'the'",
    "lookup_missing": _O + "SELECT doc_id, tf, positions FROM p WHERE token = 'ghost'",
    "seek": _O + "SELECT doc_id, tf, positions FROM p WHERE token = 'the' AND doc_id >= 100 ORDER BY doc_id LIMIT 1",
    "seek_batch": _O + f"SELECT t.token, t.target, p.doc_id FROM (VALUES {_TARGETS}) t(token, target) ASOF LEFT JOIN p ON p.token = t.token AND t.target <= p.doc_id",
    "posting_blocks": _O + """, r AS (SELECT token, doc_id, (row_number() OVER (PARTITION BY token ORDER BY doc_id) - 1) // 256 AS block_no, count(*) OVER (PARTITION BY token) AS df FROM p)
SELECT token, block_no, min(doc_id) AS first_docid, max(doc_id) AS last_docid, count(*) AS n_docs FROM r WHERE df > 1 GROUP BY token, block_no""",
    "size_hint": _O + "SELECT token, count(*) AS size_hint FROM p WHERE token IN ('the', 'and', 'ghost') GROUP BY token",
    "multi_field_stats": r"""WITH f AS (SELECT 'body' AS field, doc_id, text FROM documents UNION ALL SELECT 'title', doc_id, split_part(text, chr(10), 1) FROM documents UNION ALL SELECT 'label', doc_id, source FROM documents),
o AS (SELECT field, doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS token FROM f), p AS (SELECT field, token, doc_id, count(*) AS tf FROM o GROUP BY ALL) """ + _STATS.format("field, ", "", "field, "),
    "ingest_metrics": "SELECT count(*) AS n_docs, sum(strlen(text) + strlen(split_part(text, chr(10), 1)) + strlen(source))::BIGINT AS total_bytes FROM documents",
    "limit_ingest": _O + _STATS.format("", "WHERE doc_id < 100", ""),
    "incremental_equals_bulk": _O + _STATS.format("", "", ""),
    "stored_lookup": _O + "SELECT doc_id, tf, positions FROM p WHERE token = 'of'",
    "conversation_stats": r"""WITH d AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS doc_id, role, text FROM conversations),
f AS (SELECT 'text' AS field, doc_id, text FROM d UNION ALL SELECT 'role', doc_id, role FROM d),
o AS (SELECT field, doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS token FROM f), p AS (SELECT field, token, doc_id, count(*) AS tf FROM o GROUP BY ALL) """ + _STATS.format("field, ", "", "field, "),
    "bm25_topk": _O + """, l AS (SELECT doc_id, count(*) AS doc_len FROM o GROUP BY doc_id), n AS (SELECT count(*) AS n FROM documents), a AS (SELECT sum(doc_len) / (SELECT n FROM n) AS m FROM l),
q AS (SELECT * FROM p WHERE token IN ('the', 'and', 'of')), d AS (SELECT token, count(*) AS df FROM q GROUP BY token)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / m))), 6) AS score
FROM q JOIN d USING (token) JOIN l USING (doc_id), n, a GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20""",
    "phrase": _O + "SELECT a.doc_id, count(*) AS n_matches FROM o a JOIN o b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.token = 'of' AND b.token = 'the' GROUP BY a.doc_id",
    "bool_and": _O + "SELECT doc_id FROM p WHERE token = 'the' INTERSECT SELECT doc_id FROM p WHERE token = 'of'",
    "bool_or": _O + "SELECT DISTINCT doc_id FROM p WHERE token IN ('the', 'der')",
    "batched_ingest": "SELECT count(*) AS n_docs, max(doc_id) + 1 AS next_docid, sum(strlen(text))::BIGINT AS total_bytes FROM documents",
    "own_tokens": "WITH o AS (SELECT doc_id, unnest(range(len(t)))::INTEGER AS pos, unnest(t) AS token FROM (SELECT doc_id, string_split(text, ' ') AS t FROM documents)) SELECT token, doc_id, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM o GROUP BY ALL",
    "line_docs": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, split_part(text, chr(10), 1) AS title, md5(text) AS body_md5, source AS random_label, 5::INTEGER AS time_of_day_secs, doc_id * 1000 AS timestamp_ms FROM documents",
    "stream_ingest": _O + _STATS.format("", "", ""),
    "index_stat": _O + """, l AS (SELECT unnest(regexp_extract_all(source, '[\\p{L}\\p{N}]+')) AS token, doc_id FROM documents), b AS (SELECT DISTINCT token, doc_id FROM l)
SELECT field, section, rows, true AS has_bytes FROM (
SELECT 'body' AS field, 'postings' AS section, (SELECT count(*) FROM p) AS rows UNION ALL SELECT 'body', 'token_stats', (SELECT count(DISTINCT token) FROM p) UNION ALL SELECT 'body', 'doc_stats', (SELECT count(DISTINCT doc_id) FROM p)
UNION ALL SELECT 'label', 'postings', (SELECT count(*) FROM b) UNION ALL SELECT 'label', 'token_stats', (SELECT count(DISTINCT token) FROM b) UNION ALL SELECT 'label', 'doc_stats', (SELECT count(DISTINCT doc_id) FROM b))""",
    "stored_search": _O + f"""SELECT 'not' AS kind, doc_id, NULL::BIGINT AS n FROM (SELECT doc_id FROM p WHERE token = 'the' EXCEPT SELECT doc_id FROM p WHERE token = 'of')
UNION ALL SELECT 'and', doc_id, NULL FROM (SELECT doc_id FROM p WHERE token = 'the' INTERSECT SELECT doc_id FROM p WHERE token = 'of')
UNION ALL SELECT 'phrase', a.doc_id, count(*) FROM o a JOIN o b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.token = 'of' AND b.token = 'the' GROUP BY a.doc_id
UNION ALL SELECT 'seek ' || t.token, p.doc_id, t.target FROM (VALUES {_TARGETS}) t(token, target) ASOF LEFT JOIN p ON p.token = t.token AND t.target <= p.doc_id""",
    "cursor": _O + "SELECT doc_id, len(positions)::INTEGER AS n_positions, positions[1] AS first_pos FROM p WHERE token = 'of'",
    "position_deltas": _O + "SELECT token, doc_id, list_transform(positions, lambda x, i: (x - coalesce(CASE WHEN i > 1 THEN positions[i - 1] END, 0))::BIGINT) AS deltas, positions::BIGINT[] AS positions FROM p",
    "packed_stats": _O + ", s AS (" + _STATS.format("", "", "") + ") SELECT *, CASE WHEN doc_frequency = 1 THEN single_docid * 2 + 1 ELSE doc_frequency * 2 END AS key FROM s",
    "byte_sizes": "WITH b AS (SELECT doc_id, strlen(text)::BIGINT * pow(7, doc_id % 10)::BIGINT AS n FROM documents) SELECT doc_id, CASE WHEN n >= 1073741824 THEN printf('%.2f GB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.2f MB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.2f KB', n / 1024.0) ELSE n || ' B' END AS size FROM b",
    "bool_not": _O + "SELECT doc_id FROM p WHERE token = 'the' EXCEPT SELECT doc_id FROM p WHERE token = 'of'",
}
ORACLE_SQL["stored_bm25"] = ORACLE_SQL["bm25_topk"]
