"""A folder watched for new files, admitted and decoded as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.unicode import decode
from pageloom.operators.admission import admit

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, target: str, *, files_per_batch: int = 1000) -> DataFrame:
    """A stream of path, file_name, source_format, skipped, error, text of the folder's files, each once."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).load(folder)
    named = files.withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    checked = admit(named, F.lit(target))
    text = F.when(F.col("source_format").isin("txt", "markdown") & F.col("error").isNull(), decode("content"))
    return checked.withColumn("__d", text).select("path", "file_name", "length", "source_format", "skipped", F.coalesce("error", "__d.error").alias("error"), F.col("__d.text").alias("text"), F.col("__d.encoding").alias("encoding"))
