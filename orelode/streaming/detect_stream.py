"""Detection on a stream of objects: files that arrive are scanned as they come.

The scan is stateless, so any source with a key and a payload will do, and a
restart goes on from the stream's checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.operators import detect, findings


def object_stream(spark: SparkSession, directory: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of Parquet files of objects that arrive in ``directory``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(directory)


def finding_stream(objects: DataFrame, key: str = "oid") -> DataFrame:
    """Scored findings of a stream of objects; exposure is not known to a stream."""
    blobs = objects.where("type = 'blob'").select(F.col(key).alias("blob_id"), "payload")
    return findings.scored(detect.candidates(blobs))


def windowed_counts(found: DataFrame, at: str, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """Findings by window and tier; what comes later than ``late`` no longer counts."""
    return found.withWatermark(at, late).groupBy(F.window(at, width), "pattern_name").agg(F.count(F.lit(1)).alias("n_candidates"))
