"""Dense document numbers for rows that have none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_ids(rows: DataFrame, order: list[str], work: str, start: int = 0) -> DataFrame:
    """rows with doc_id: their places in the order, from `start`, without gaps. Rows that tie are numbered in any order.

    Rows are range-sorted and stored once in `work`, so that their places stay as they are; places within a partition are added
    to the sizes of the partitions before it, one row for each partition.
    """
    local = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.shiftright(local, 33).cast("int"), "_at": local.bitwiseAND(F.lit((1 << 33) - 1))})
    placed.write.parquet(work)
    stored = rows.sparkSession.read.schema(placed.schema).parquet(work)
    sizes = stored.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return stored.join(F.broadcast(before), "_part").withColumn("doc_id", F.col("_before") + F.col("_at") + F.lit(start)).select("doc_id", *rows.columns)
