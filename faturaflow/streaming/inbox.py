"""A folder of PDF files as a stream of results: the batch plan over new files. An extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faturaflow.plans import pipeline

FILES = "path string, modificationTime timestamp, length long, content binary"


def results(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """Results of the files that arrive in a folder; stateless, so any restart goes on where it was."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", files_a_batch).load(folder)
    return pipeline.process(files.select(F.col("path").alias("source"), F.lit("file").alias("input_type"), "content"))


def write(results_: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Results appended as Parquet, exactly once, under a checkpoint."""
    return results_.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
