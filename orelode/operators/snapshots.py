"""What changed between full snapshots.

Method: a bucketed key-to-hash index of the last snapshot.  Rows are placed in
buckets of (stream, hash of the path); within a bucket snapshots pass in order.
Each new row probes the index of the last snapshot: no entry is an addition,
another hash a change; what was not probed is a removal; then the new rows'
index takes the old one's place.  The index holds keys and 64-bit hashes of
values only; old values are fetched afterwards, for changed keys alone
(:func:`change_values`).

A bucket's index holds one snapshot's share of one stream's paths, so its size
is bounded by the number of buckets, which follows the largest snapshot.

Defined results: rows with null path, stream or snapshot number are ignored;
exact repetitions count once; a path listed twice with different content in one
snapshot counts as the set of its contents; null equals null only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHANGES = "stream_id bigint, snapshot_no int, path string, change string"


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, number = None, None
    last: dict = {}
    now: dict = {}
    first = True
    out: tuple[list, list, list, list] = ([], [], [], [])

    def swap() -> None:
        """The snapshot ``number`` is complete: compare, then its index is the last one."""
        nonlocal last, now, first
        if not first:
            for path, value in now.items():
                old = last.pop(path, None)
                if old is None:
                    add(path, "added")
                elif old != value:
                    add(path, "changed")
            for path in last:
                add(path, "removed")
        last, now, first = now, {}, False

    def add(path: str, change: str) -> None:
        for column, x in zip(out, (place[0], number, path, change)):
            column.append(x)

    def flush() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=["stream_id", "snapshot_no", "path", "change"])
        for column in out:
            column.clear()
        return batch

    for batch in batches:
        for stream, bucket, no, path, value in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if (stream, bucket) != place:
                if place is not None:
                    swap()
                place, number, last, now, first = (stream, bucket), no, {}, {}, True
            elif no != number:
                swap()
                number = no
            # A null path marks that the snapshot was delivered, in every bucket.
            if path is not None:
                now[path] = value if path not in now else now[path] ^ value
        if len(out[0]) >= 20_000:
            yield flush()
    if place is not None:
        swap()
    if out[0]:
        yield flush()


def value_hash() -> Column:
    return F.xxhash64("blob_oid", F.col("blob_oid").isNull(), "mode", F.col("mode").isNull())


def keyed(snapshots: DataFrame) -> DataFrame:
    """``(stream_id, snapshot_no, path, value)``: each listed path of each snapshot, repetitions once."""
    rows = snapshots.where("stream_id is not null and snapshot_no is not null and path is not null")
    return rows.select(F.col("stream_id").cast("bigint").alias("stream_id"), F.col("snapshot_no").cast("int").alias("snapshot_no"), "path", value_hash().alias("value")).distinct()


def deliveries(snapshots: DataFrame) -> DataFrame:
    """``(stream_id, snapshot_no, n)`` of every snapshot that came, those that list nothing too."""
    came = snapshots.where("stream_id is not null and snapshot_no is not null")
    return came.groupBy(F.col("stream_id").cast("bigint").alias("stream_id"), F.col("snapshot_no").cast("int").alias("snapshot_no")).agg(F.count("path").alias("n"))


def probed(rows: DataFrame, delivered: DataFrame, keys_per_bucket: int = 20_000) -> DataFrame:
    """Changes between consecutive snapshots of ``rows`` (as of :func:`keyed`) and ``delivered``."""
    buckets = delivered.groupBy("stream_id").agg(F.ceil(F.max("n") / keys_per_bucket).cast("int").alias("b"))
    buckets = buckets.select("stream_id", F.greatest("b", F.lit(1)).alias("n_buckets"))
    placed = rows.join(buckets, "stream_id").select(
        "stream_id", F.pmod(F.xxhash64("path"), F.col("n_buckets")).cast("int").alias("bucket"), "snapshot_no", "path", "value"
    )
    # Every bucket must see that a snapshot came, even one that lists none of its paths.
    marks = delivered.join(buckets, "stream_id").select(
        "stream_id", F.explode(F.sequence(F.lit(0), F.col("n_buckets") - 1)).alias("bucket"), "snapshot_no", F.lit(None).cast("string").alias("path"), F.lit(None).cast("bigint").alias("value")
    )
    return placed.unionByName(marks).repartition("stream_id", "bucket").sortWithinPartitions("stream_id", "bucket", "snapshot_no").mapInArrow(_probe, CHANGES)


def snapshot_changes(snapshots: DataFrame, keys_per_bucket: int = 20_000) -> DataFrame:
    """``(stream_id, snapshot_no, path, change)`` between consecutive delivered snapshots."""
    return probed(keyed(snapshots), deliveries(snapshots), keys_per_bucket)


def change_values(changes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Old and new content of each change, fetched for changed keys only.

    Also gives the commit at which the later snapshot was taken, which is the
    commit where a removal was observed.
    """
    sets = snapshots.where("path is not null").groupBy("stream_id", "snapshot_no", "path").agg(F.min(F.struct("blob_oid", "mode")).alias("content"))
    heads = snapshots.groupBy("stream_id", "snapshot_no").agg(F.min("commit_sha").alias("observed_commit"), F.min("taken_at").alias("observed_at"))
    order = Window.partitionBy("stream_id").orderBy("snapshot_no")
    heads = heads.where("stream_id is not null and snapshot_no is not null").withColumn("last_no", F.lag("snapshot_no").over(order))
    c = changes.join(heads, ["stream_id", "snapshot_no"])
    wanted = changes.select("stream_id", "path").distinct()
    sets = sets.join(wanted, ["stream_id", "path"], "left_semi")
    new = sets.select("stream_id", "snapshot_no", "path", F.col("content.blob_oid").alias("new_blob"), F.col("content.mode").alias("new_mode"))
    old = sets.select("stream_id", F.col("snapshot_no").alias("last_no"), "path", F.col("content.blob_oid").alias("old_blob"), F.col("content.mode").alias("old_mode"))
    return c.join(old, ["stream_id", "last_no", "path"], "left").join(new, ["stream_id", "snapshot_no", "path"], "left").select(
        "stream_id", "last_no", "snapshot_no", "path", "change", "old_blob", "old_mode", "new_blob", "new_mode", "observed_commit", "observed_at"
    )
