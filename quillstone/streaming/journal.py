"""Streaming ingestion of objects and journal entries into a table on disk; an extension beyond batch replication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def ingest(stream: DataFrame, table: str, checkpoint: str, keys: tuple[str, ...]) -> StreamingQuery:
    """Appends the rows of a stream whose keys the Parquet table lacks, once each, whatever is sent again.

    Each micro-batch is written under its own number with overwrite, so a batch that is run again after a failure
    replaces what it wrote.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(list(keys))
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
        files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if files.exists(where):
            there = spark.read.parquet(table).filter(f"batch <> {number}").select(*keys)
            rows = rows.join(there, list(keys), "left_anti")
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
