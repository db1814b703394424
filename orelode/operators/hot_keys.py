"""Per-key results where a few keys hold most records.

Method: eager aggregation through joins.  Both inputs of a join are aggregated
by join key before they meet, the compact states are joined, counts are
multiplied and sums scaled, and the product is rolled up.  No step moves the
raw rows of one key to one task: duplicates are removed by a digest of the
whole row (hot keys spread over all partitions) and every roll-up combines on
the map side, so a key costs at most one record per map task.  Where states of
one join key are many themselves (a commit with very many blobs), they are
spread over salts, and the other side's states, one or few per key, are
repeated per salt.

Keys that need salts or shards are told by a share of all rows: no more than
``HEAVY`` keys can hold over one in ``HEAVY`` of them, so this list may be sent
to every task at every size of the input.

Defined results: null keys count in totals but are no keys; an empty table
gives no rows; further columns take part only in the test for exact duplicates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.functions.digest import row_digest


HEAVY = 10_000


def heavy_keys(counts: DataFrame, least: int) -> DataFrame:
    """Of ``counts(key, n)``: the keys with more than ``least`` rows and over one in ``HEAVY`` of all; ``HEAVY`` at most."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_total"))
    return counts.crossJoin(F.broadcast(total)).where((F.col("n") > least) & (F.col("n") * HEAVY > F.col("_total"))).drop("_total")  # one row


def distinct_keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row (keys, ``_d1``, ``_d2``) per distinct row of ``df``.

    Only keys and digest are shuffled, not the row.
    """
    d1, d2 = row_digest(df.columns)
    return df.select(*keys, d1.alias("_d1"), d2.alias("_d2")).groupBy(*keys, "_d1", "_d2").agg(F.lit(1).alias("_one")).drop("_one")


def key_counts(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    """``(key_kind, key_value, n_rows)`` for each kind -> column of ``keys``.

    A row per kind with a null ``key_value`` holds the rows without that key.
    """
    pairs = df.groupBy(*keys.values()).agg(F.count(F.lit(1)).alias("n"))
    both = F.array(*(F.struct(F.lit(kind).alias("key_kind"), F.col(c).cast("string").alias("key_value")) for kind, c in keys.items()))
    return (
        pairs.select(F.explode(both).alias("k"), "n")
        .groupBy("k.key_kind", "k.key_value")
        .agg(F.sum("n").alias("n_rows"))
    )


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: str,
    left_by: list[str] = [],
    right_by: list[str] = [],
    left_sum: Column | None = None,
    count_as: str = "n_rows",
    sum_as: str = "total",
    states_per_salt: int = 100_000,
) -> DataFrame:
    """``left JOIN right USING (on)`` grouped by both ``by`` lists, without the join's rows.

    Gives the number of joined rows and, if asked, the sum of a left column
    over them.  Null join keys match nothing, as in SQL.
    """
    states = [F.count(F.lit(1)).alias("_nl")] + ([F.sum(left_sum).alias("_sl")] if left_sum is not None else [])
    l = left.where(F.col(on).isNotNull()).groupBy(on, *left_by).agg(*states)
    r = right.where(F.col(on).isNotNull()).groupBy(on, *right_by).agg(F.count(F.lit(1)).alias("_nr"))
    if left_by:
        many = heavy_keys(l.groupBy(on).agg(F.count(F.lit(1)).alias("n")), states_per_salt).select(on, F.ceil(F.col("n") / states_per_salt).cast("int").alias("_salts"))
        l = l.join(F.broadcast(many), on, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*left_by), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")
        r = r.join(F.broadcast(many), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    keys = [on, "_salt"] if left_by else [on]
    out = [F.sum(F.col("_nl") * F.col("_nr")).alias(count_as)]
    if left_sum is not None:
        out.append(F.sum(F.col("_sl") * F.col("_nr")).alias(sum_as))
    return l.join(r, keys).groupBy(*left_by, *right_by).agg(*out)


def occurrence_counts(occurrences: DataFrame) -> DataFrame:
    """``(key_kind, key_value, n_occurrences, n_total)`` of every blob and commit over the distinct rows.

    Rows are aggregated to states of (blob, commit) and these rolled up to
    either key; ``n_total`` counts all distinct rows, those with null keys included.
    """
    rows = distinct_keyed(occurrences, ["blob_id", "commit_sha"])
    counts = key_counts(rows, {"blob": "blob_id", "commit": "commit_sha"})
    total = counts.where("key_kind = 'blob'").agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_total"))
    return counts.where("key_value is not null").crossJoin(F.broadcast(total)).withColumnRenamed("n_rows", "n_occurrences")  # one row


def occurrence_profile(occurrences: DataFrame, commits: DataFrame) -> DataFrame:
    """Counts of every blob and commit over the distinct rows of ``occurrences``.

    Columns: key_kind, key_value, n_occurrences, n_commit_rows and n_joined (the
    size of the join with ``commits``, of commits only).  The compact states of
    both sides are joined in full: a commit without occurrences has a row, too.
    """
    counts = occurrence_counts(occurrences)
    of_commits = commits.where("commit_sha is not null").groupBy(F.col("commit_sha").alias("key_value")).agg(F.count(F.lit(1)).alias("n_commit_rows"))
    of_commits = of_commits.withColumn("key_kind", F.lit("commit"))
    return counts.join(of_commits, ["key_kind", "key_value"], "full").select(
        "key_kind",
        "key_value",
        F.coalesce("n_occurrences", F.lit(0)).alias("n_occurrences"),
        F.coalesce("n_commit_rows", F.lit(0)).alias("n_commit_rows"),
        (F.coalesce("n_occurrences", F.lit(0)) * F.coalesce("n_commit_rows", F.lit(0))).alias("n_joined"),
    )


def hot_keys(counts: DataFrame, percent: int = 1) -> DataFrame:
    """Keys of :func:`occurrence_counts` with at least ``percent`` % of all rows; none of no rows."""
    return counts.where((F.col("n_occurrences") * 100 >= F.col("n_total") * percent) & (F.col("n_total") > 0)).select("key_kind", "key_value")


def occurrence_lists(occurrences: DataFrame, key: str, shard_rows: int = 10_000) -> DataFrame:
    """The occurrence list of every value of ``key``, cut into shards of about ``shard_rows``.

    Columns: key_value, shard, n_shards, n_rows, occurrences (sorted by time,
    commit, blob, path and so on within a shard).  Exact repetitions count once;
    rows that differ in any column stay apart.  A hot key has many shards, so no
    task or row holds an unbounded list; which shard a row falls in depends on
    its digest alone.  Rows of the heaviest keys meet their number of shards
    where they lie; the others, none of which holds over one in ``HEAVY`` of all
    rows, by a join.
    """
    d1, d2 = row_digest(occurrences.columns)
    fields = [c for c in ("commit_timestamp", "commit_sha", "blob_id", "path", "commit_date", "author", "loaded_at") if c in occurrences.columns]
    rows = occurrences.where(F.col(key).isNotNull()).select(F.col(key).alias("key_value"), d1.alias("_d1"), d2.alias("_d2"), F.struct(*fields).alias("o"))
    rows = rows.groupBy("key_value", "_d1", "_d2").agg(F.first("o").alias("o"))
    counts = occurrences.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key_value")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_rows)
    heavy = heavy_keys(counts, shard_rows).select("key_value", F.ceil(F.col("n") / shard_rows).cast("int").alias("n_shards"))
    first = rows.join(F.broadcast(heavy), "key_value", "left")
    middle = counts.join(F.broadcast(heavy.select("key_value")), "key_value", "left_anti").select("key_value", F.ceil(F.col("n") / shard_rows).cast("int").alias("_more"))
    light = first.where("n_shards is null").join(middle, "key_value", "left").withColumn("n_shards", F.coalesce("_more", F.lit(1))).drop("_more")
    placed = first.where("n_shards is not null").unionByName(light)
    placed = placed.withColumn("shard", F.pmod("_d1", F.col("n_shards")).cast("int"))
    return placed.groupBy("key_value", "shard", "n_shards").agg(F.sort_array(F.collect_list("o")).alias("occurrences")).select(
        "key_value", "shard", "n_shards", F.size("occurrences").alias("n_rows"), "occurrences"
    )
