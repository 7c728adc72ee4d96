"""Running a stream over what is there now."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusmith.session import shared_folder


def read_stream(spark: SparkSession, directory: str, table: str, files_per_batch: int = 1000) -> DataFrame:
    """A table of a data directory as a file stream; it may be one file or a directory of files."""
    schema = spark.read.parquet(f"{directory}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{directory}/{table}.parquet*")


def run_once(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Process everything available, then stop; the result as a batch DataFrame.

    Output and progress go to a new folder under ``folder`` or the session's
    shared folder. With ``complete`` or ``update`` the last version of the
    output is written by foreachBatch.
    """
    spark = stream.sparkSession
    base = f"{(folder or shared_folder(spark)).rstrip('/')}/stream-{uuid.uuid4()}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{base}/out").start()
    else:
        query = writer.foreachBatch(lambda df, batch: df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
