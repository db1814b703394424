"""Places of rows in a whole order, without one task that sees them all."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from orelode.session import materialize, parallelism


def global_rank(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """``df`` with the place of each row (from 1) in ``order``, which should tell all rows apart.

    Rows are cut by range, sorted within their range and counted off there; a
    range's first place is the number of rows before it, one number per range.
    Rows that ``order`` holds equal lie in one range, in any order among themselves.
    """
    p = parallelism(df.sparkSession)
    schema = StructType([*df.schema.fields, StructField("_part", LongType()), StructField("_at", LongType())])

    def count_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            yield b.append_column("_at", pa.array(range(at + 1, at + 1 + b.num_rows), pa.int64()))
            at += b.num_rows

    ranged = df.repartitionByRange(p, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id().cast("long"))
    kept = materialize(ranged.mapInArrow(count_off, schema), "ranked")
    sizes = {r["_part"]: r["count"] for r in kept.groupBy("_part").count().collect()}  # a row per range
    before, total = [], 0
    for part in range(p):
        before.append(total)
        total += sizes.get(part, 0)
    first = F.element_at(F.array(*map(F.lit, before)), (F.col("_part") + 1).cast("int"))
    return kept.withColumn(name, F.col("_at") + first).drop("_part", "_at")
