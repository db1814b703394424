"""Keyed state kept between batches, as tables in a shared folder.

A state is cut into buckets by a hash of its key.  A batch writes only the
buckets it touches, beside what it hands on, and then a manifest that names the
version of every bucket; the manifest alone makes the batch count.  So a batch
that fails half-way leaves the old state, and one that is repeated changes
nothing and hands on the same rows again.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.operators import orphans, snapshots
from orelode.session import shared_dir

#: How many batches can be asked for again.
KEPT = 100


class BucketedState:
    """A table in ``buckets`` parts, each replaced alone, and what every batch handed on."""

    def __init__(self, spark: SparkSession, name: str, schema: str, key: list[str], buckets: int, directory: str | None = None) -> None:
        self.spark, self.schema, self.buckets, self.key = spark, schema, buckets, key
        self.root = f"{(directory or shared_dir(spark)).rstrip('/')}/state/{name}"
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def _batches(self) -> list[int]:
        return sorted(int(s.getPath().getName()[1:-5]) for s in self._fs.listStatus(self._path(self.root)) if s.getPath().getName().endswith(".json"))

    @property
    def batch(self) -> int:
        """The last batch that is in the state; -1 for none."""
        return max(self._batches(), default=-1)

    def _manifest(self) -> dict[int, int]:
        """Bucket to the batch that wrote it."""
        if self.batch < 0:
            return {}
        text = self.spark.read.text(f"{self.root}/m{self.batch}.json", wholetext=True).first()[0]  # a number per bucket
        return {int(k): v for k, v in json.loads(text).items()}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def read(self, some: list[int] | None = None) -> DataFrame:
        """The state, or the given buckets of it."""
        by: dict[int, list[int]] = {}
        for b, v in self._manifest().items():
            if some is None or b in some:
                by.setdefault(v, []).append(b)
        out = self.spark.createDataFrame([], self.schema)
        for v, bs in by.items():
            out = out.unionByName(self.spark.read.schema(f"{self.schema}, _bucket int").option("basePath", f"{self.root}/v{v}").parquet(f"{self.root}/v{v}").where(F.col("_bucket").isin(bs)).drop("_bucket"))
        return out

    def touched(self, *keyed: DataFrame) -> list[int]:
        """The buckets that rows with the key fall in; at most ``buckets``."""
        found: set[int] = set()
        for df in keyed:
            found |= {r.b for r in df.select(self.bucket().alias("b")).distinct().collect()}
        return sorted(found)

    def commit(self, batch: int, buckets: list[int], state: DataFrame, handed_on: DataFrame) -> None:
        """Make ``state`` the content of ``buckets`` after ``batch``."""
        before = self._manifest()
        handed_on.write.mode("overwrite").parquet(f"{self.root}/out{batch}")
        state.withColumn("_bucket", self.bucket()).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.root}/v{batch}")
        manifest = json.dumps(before | dict.fromkeys(buckets, batch))
        half = self._path(f"{self.root}/m{batch}.half")
        out = self._fs.create(half, True)
        out.write(bytearray(manifest.encode()))
        out.close()
        self._fs.rename(half, self._path(f"{self.root}/m{batch}.json"))
        needed = set(before.values()) | {batch}  # the version before stays for readers that have begun
        for s in self._fs.listStatus(self._path(self.root)):
            name = s.getPath().getName()
            old = name[1:].isdigit() and name[0] == "v" and int(name[1:]) not in needed
            if old or name.startswith("out") and int(name[3:]) <= batch - KEPT:
                self._fs.delete(s.getPath(), True)

    def handed_on(self, batch: int, schema: str) -> DataFrame:
        """What ``batch`` gave; the last ``KEPT`` batches can be asked for."""
        return self.spark.read.schema(schema).parquet(f"{self.root}/out{batch}")


class OrphanLedger:
    """Pending orphans over batches of references and objects that come in any order.

    Each batch hands on the counts per table and period as they are after it.
    """

    SCHEMA = "oid string, month int, source_table string, balance bigint, waiting bigint"
    COUNTS = "source_table string, period string, n_references bigint, n_missing bigint"

    def __init__(self, spark: SparkSession, name: str = "orphans", directory: str | None = None, buckets: int = 64) -> None:
        self.state = BucketedState(spark, name, self.SCHEMA, ["oid"], buckets, directory)

    def advance(self, batch: int, references: DataFrame | None = None, objects: DataFrame | None = None, count: bool = True) -> bool:
        """Take in a batch: new references wait, arriving objects resolve, deletions reopen.  False if it was in already."""
        if batch <= self.state.batch:
            return False
        parts = []
        if references is not None:
            parts.append(orphans.reference_ledger(references))
        if objects is not None:
            parts.append(orphans.parent_ledger(objects))
        new = orphans.merge_ledgers(*parts)
        buckets = self.state.touched(new) if self.state.batch >= 0 else list(range(self.state.buckets))
        merged = orphans.merge_ledgers(self.state.read(buckets), new).where("balance <> 0 or waiting <> 0")
        others = self.state.read([b for b in range(self.state.buckets) if b not in buckets])
        counts = orphans.pending_counts(merged.unionByName(others)) if count else self.state.spark.createDataFrame([], self.COUNTS)
        self.state.commit(batch, buckets, merged, counts)
        return True

    def pending(self) -> DataFrame:
        return orphans.pending(self.state.read())

    def counts(self, batch: int | None = None) -> DataFrame:
        """``(source_table, period, n_references, n_missing)`` as they were after a batch, the last by default."""
        return self.state.handed_on(self.state.batch if batch is None else batch, self.COUNTS)


class SnapshotIndex:
    """A bucketed key-to-hash index of each stream's last snapshot, kept between batches.

    A batch holds any number of whole later snapshots of some streams.  The
    index of a stream's last snapshot is probed by its next, and so on; the last
    of the batch takes its place.  Which snapshot of a stream was last is kept
    apart from the paths, so one that lists nothing counts as well.  Rows of a
    snapshot that is not later than its stream's last change nothing.
    """

    SCHEMA = "stream_id bigint, snapshot_no int, path string, value bigint"

    def __init__(self, spark: SparkSession, name: str = "snapshots", buckets: int = 64, directory: str | None = None) -> None:
        self.state = BucketedState(spark, name, self.SCHEMA, ["stream_id", "path"], buckets, directory)

    def apply(self, snapshot: DataFrame, batch: int, keys_per_bucket: int = 20_000) -> DataFrame:
        """The changes of a batch; those of one that is repeated, again."""
        if batch > self.state.batch:
            from orelode.session import materialize

            kept = self.state.read()
            # A row without path holds the number of its stream's last snapshot.
            last = kept.where("path is null").select("stream_id", F.col("snapshot_no").alias("last_no"))
            fresh = lambda df: df.join(last, "stream_id", "left").where("last_no is null or snapshot_no > last_no").drop("last_no")
            new = materialize(fresh(snapshots.keyed(snapshot)), "snapshot-rows")
            came = materialize(fresh(snapshots.deliveries(snapshot)), "snapshot-deliveries")
            streams = came.select("stream_id").distinct()
            held = kept.join(streams, "stream_id", "left_semi")
            old = held.where("path is not null")
            sizes = held.groupBy("stream_id", "snapshot_no").agg(F.count("path").alias("n"))
            changes = snapshots.probed(old.unionByName(new), sizes.unionByName(came), keys_per_bucket)
            ends = came.groupBy("stream_id").agg(F.max("snapshot_no").alias("snapshot_no"))
            index = new.join(ends, ["stream_id", "snapshot_no"], "left_semi").groupBy("stream_id", "snapshot_no", "path").agg(F.bit_xor("value").alias("value"))
            index = index.unionByName(ends.select("stream_id", "snapshot_no", F.lit(None).cast("string").alias("path"), F.lit(None).cast("bigint").alias("value")))
            # Paths of the streams that came, old and new, tell the buckets that change.
            buckets = self.state.touched(held, index) if self.state.batch >= 0 else list(range(self.state.buckets))
            rest = self.state.read(buckets).join(streams, "stream_id", "left_anti")
            self.state.commit(batch, buckets, rest.unionByName(index), changes)
        return self.state.handed_on(batch, snapshots.CHANGES)
