"""Changes from elsewhere: a folder of rows as a stream, each batch put into a table, whose observers are told."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..locks import Priority


def follow(spark: SparkSession, db, table, folder: str, checkpoint: str, kind: str = "parquet"):
    """A streaming query that inserts or replaces rows which arrive in ``folder``; exactly once by primary key."""
    rows = spark.readStream.schema(table.struct()).format(kind).load(folder)

    def apply(batch, _):
        if not batch.isEmpty():
            db.create_transaction(priority=Priority.EXTERNAL_CHANGE).exec([db.insert_or_replace().into(table).values(batch)])

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
