"""Micro-batch ingest: every batch of a stream becomes one generation of an index, named by the stream and the batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexicask.plans.index import Index


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the rows of a Parquet table that is there: a folder of files, or one file, which Spark takes as a stream only by a pattern."""
    where, path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), path.rstrip("/")
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    single = files.exists(where) and files.getFileStatus(where).isFile()
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]" if single else path)


def ingest_stream(docs: DataFrame, index: Index, fields: dict[str, Column | str], checkpoint: str, name: str = "stream", **trigger) -> StreamingQuery:
    """Start appending a streaming DataFrame (doc_id, texts). doc_ids of later batches must be greater. A replayed batch is committed once.

    trigger: as for DataStreamWriter.trigger, availableNow=True by default.
    """
    spark, path = index.spark, index.path

    def commit(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()  # read for the checks, the postings and the lengths
        try:
            Index.open(spark, path).append(held, fields, batch=(name, batch_id))
        finally:
            held.unpersist()

    return docs.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
