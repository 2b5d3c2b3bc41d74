"""Bulk ingest of any DataFrame of documents, with metrics: documents, bytes of field text, documents a second, GiB an hour."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexicask.plans.index import Index


def text_bytes(docs: DataFrame, fields: dict[str, Column | str]) -> DataFrame:
    """n_docs and total_bytes: UTF-8 bytes of the fields of all documents."""
    sizes = [F.coalesce(F.octet_length(F.col(c) if isinstance(c, str) else c), F.lit(0)).cast("long") for c in fields.values()]
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(sum(sizes[1:], sizes[0])), F.lit(0)).alias("total_bytes"))


def ingest(index: Index, docs: DataFrame, fields: dict[str, Column | str], limit: int | None = None, batch_size: int | None = None) -> tuple[Index, dict]:
    """Append documents numbered from 0 (doc_id) after the index's own. limit: only the first. batch_size: documents of a commit, all by default.

    With a batch size the source is read once and dealt to one folder for each commit, so no commit reads another one's documents.
    """
    began, start, spark = time.time(), index.manifest.next_docid, index.spark
    if limit is not None:
        docs = docs.filter(F.col("doc_id") < limit)
    facts = text_bytes(docs, fields).first()
    moved = docs.withColumn("doc_id", F.col("doc_id") + F.lit(start))
    if batch_size:
        kind, names = moved.schema, list(fields)
        path = f"{index.path}/incoming/{uuid.uuid4().hex}"
        moved.withColumn("_commit", F.floor((F.col("doc_id") - F.lit(start)) / F.lit(batch_size))).repartitionByRange("_commit", "doc_id").write.partitionBy("_commit").parquet(path)
        for k in sorted(int(x.split("=")[1]) for x in index.files.names(path) if x.startswith("_commit=")):
            index = index.append(spark.read.schema(kind).parquet(f"{path}/_commit={k}"), {f: fields[f] for f in names})
        index.files.delete(path)
    else:
        index = index.append(moved, fields)
    seconds = time.time() - began
    return index, {"n_docs": facts["n_docs"], "total_bytes": facts["total_bytes"], "seconds": seconds, "gb_per_hour": facts["total_bytes"] / 2**30 / seconds * 3600, "docs_per_second": facts["n_docs"] / seconds, "next_docid": index.manifest.next_docid}
