"""Incremental landing of time exports with Structured Streaming.

New export files dropped into a folder are cut at their rows' ends and appended to
the month-partitioned landing table.  A stream sees pieces of files, so it reads
UTF-8 documents without CDATA, own entities and nested rows, and does not check that
a document is whole; ``sources.landed.land`` with the batch scan does all that.  The
stream's checkpoint (in the shared checkpoint folder) records which files were
taken, so a restarted or failed job neither loses nor duplicates entries.
Reports then read the landing table with partition pruning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import parse_row_fragments


def time_xml_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 100) -> DataFrame:
    """Streaming DataFrame of valid, normalised time entries of new files."""
    frag = (
        spark.readStream.format("text").option("lineSep", "</row>")
        .option("maxFilesPerTrigger", max_files_per_trigger).load(folder)
        .select("value", F.col("_metadata.file_path").alias("source_file"))
    )
    return parse_row_fragments(frag)


def start_landing(spark: SparkSession, folder: str, target: str, checkpoint: str,
                  available_now: bool = True) -> StreamingQuery:
    """Appends new files' entries to ``target`` (parquet, partitioned by month)."""
    writer = (
        time_xml_stream(spark, folder).writeStream.format("parquet")
        .option("path", target).option("checkpointLocation", checkpoint)
        .partitionBy("month").outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
