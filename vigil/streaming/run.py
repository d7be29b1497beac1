"""Runs a stream over what there is now and gives its result as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vigil import store
from vigil.streaming.ordered import STATE_STORE


def as_stream(table: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """A stream of the rows that the table has now, in the order in which its files happen to come; files: so many a batch."""
    path = store.new_path(table.sparkSession, name)
    table.write.parquet(path)
    reader = table.sparkSession.readStream.schema(table.schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def finished(stream: DataFrame, name: str, checkpoint: str | None = None, path: str | None = None) -> DataFrame:
    """The rows that the stream gives of all input there is now, appended to a Parquet table in the shared folder.

    With the checkpoint and path of an earlier run it goes on where that one ended.
    """
    spark = stream.sparkSession
    path = path or store.new_path(spark, name)
    checkpoint = checkpoint or store.new_path(spark, f"{name}-checkpoint")
    key, provider = STATE_STORE
    before = spark.conf.get(key, None)
    spark.conf.set(key, provider)  # a query takes the session's settings as it starts
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
