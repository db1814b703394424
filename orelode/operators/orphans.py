"""References to records that do not exist, per table and month.

Method: keyed pending-orphan state, maintained incrementally.  The state of an
OID is a short ledger by month and table: how many copies arrived, how many went, how
many references wait.  New references probe the parents' running balance,
arriving parents resolve what waits, deletions reopen it; the snapshot at each
month's end is the balance then.  The ledger is additive, so increments (late
ones too) merge by summing (:func:`merge_ledgers`), and an OID never holds more
rows than there are months and tables, however many references or copies name it.

Defined results: references that are no OID after trimming, and references
without a time, are none; a copy without ``stored_at`` is never present; a copy
deleted in or before the month it was stored is present at no month's end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space at either end, Unicode's and the separators 1C-1F included.
_EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def trimmed_oid(c: Column) -> Column:
    """The trimmed text if it is an OID, else null."""
    t = F.regexp_replace(c, _EDGE, "")
    return F.when(t.rlike(r"\A[0-9a-f]{40}\z"), t)


def month_no(c: Column) -> Column:
    return (F.year(c) * 12 + F.month(c) - 1).cast("int")


def month_name(c: Column) -> Column:
    return F.format_string("%04d-%02d", (F.floor(c / 12)).cast("int"), (F.pmod(c, F.lit(12)) + 1).cast("int"))


def reference_rows(tree_entries: DataFrame, refs: DataFrame, classifications: DataFrame) -> DataFrame:
    """``(source_table, record_id, month, oid)`` of every reference that names an OID."""
    one = tree_entries.where(~F.col("mode").eqNullSafe("160000")).select(
        F.lit("fx_tree_entry").alias("source_table"), F.col("entry_id").alias("record_id"), F.col("observed_at").alias("at"), F.col("child_oid").alias("oid")
    )
    two = refs.select(F.lit("fx_ref"), "ref_id", "observed_at", "content")
    three = classifications.select(F.lit("fx_classification"), "scan_id", "scanned_at", F.explode("unresolved_oids"))
    return (
        one.union(two)
        .union(three)
        .select("source_table", F.col("record_id").cast("bigint").alias("record_id"), month_no(F.col("at")).alias("month"), trimmed_oid(F.col("oid")).alias("oid"))
        .where("oid is not null and month is not null")
    )


def parent_ledger(objects: DataFrame) -> DataFrame:
    """``(oid, month, source_table, balance, waiting)``: net copies gained by the end of each month; their source is ''."""
    # What is stored before the next month's first instant counts from that month on;
    # what is deleted before that instant is gone from that month on.
    rows = objects.select("oid", month_no(F.col("stored_at")).alias("a"), month_no(F.col("deleted_at")).alias("z")).where("oid is not null and a is not null and (z is null or z > a)")
    steps = F.filter(
        F.array(
            F.struct(F.col("a").alias("month"), F.lit(1).alias("d")),
            F.when(F.col("z").isNotNull(), F.struct(F.col("z").alias("month"), F.lit(-1).alias("d"))),
        ),
        lambda s: s.isNotNull(),
    )
    return rows.select("oid", F.explode(steps).alias("s")).groupBy("oid", F.col("s.month").alias("month")).agg(F.sum("s.d").cast("bigint").alias("balance")).select("oid", "month", F.lit("").alias("source_table"), "balance", F.lit(0).cast("bigint").alias("waiting"))


def reference_ledger(references: DataFrame) -> DataFrame:
    return references.groupBy("oid", "month", "source_table").agg(F.count(F.lit(1)).alias("waiting")).select("oid", "month", "source_table", F.lit(0).cast("bigint").alias("balance"), "waiting")


def merge_ledgers(*parts: DataFrame) -> DataFrame:
    """The state after all increments, in whatever order they came."""
    return reduce(DataFrame.unionByName, parts).groupBy("oid", "month", "source_table").agg(F.sum("balance").alias("balance"), F.sum("waiting").alias("waiting"))


def waiting_rows(ledger: DataFrame) -> DataFrame:
    """The ledger's rows of references that wait for a parent at their month's end."""
    run = Window.partitionBy("oid").orderBy("month").rangeBetween(Window.unboundedPreceding, 0)
    return ledger.withColumn("held", F.sum("balance").over(run)).where("waiting > 0 and held <= 0")


def pending_counts(ledger: DataFrame) -> DataFrame:
    """``(source_table, period, n_references, n_missing)``: what waits, per table and month; repeated references count."""
    return waiting_rows(ledger).groupBy("source_table", month_name(F.col("month")).alias("period")).agg(F.sum("waiting").alias("n_references"), F.count(F.lit(1)).alias("n_missing"))


def pending(ledger: DataFrame) -> DataFrame:
    """``(oid, month)`` at whose end references of that month wait for a parent."""
    return waiting_rows(ledger).select("oid", "month").distinct()


def orphan_references(references: DataFrame, objects: DataFrame, always: DataFrame) -> DataFrame:
    """Every reference without a parent at its month's end.

    ``always`` holds OIDs that are present at all times (a fixed, small table).
    The pending set holds one row per OID and month, so the join back to the
    references may be skewed on one side only, which AQE splits.
    """
    refs = waiting_for(references, always)
    return orphans_of(refs, pending(merge_ledgers(parent_ledger(objects), reference_ledger(refs))))


def waiting_for(references: DataFrame, always: DataFrame) -> DataFrame:
    """The references to what is not present at all times."""
    return references.join(always.select("oid").where("oid is not null").distinct(), "oid", "left_anti")


def orphans_of(references: DataFrame, wait: DataFrame) -> DataFrame:
    """The references among those pending, by name of their month, each once."""
    return (
        references.join(wait, ["oid", "month"], "left_semi")
        .select("source_table", month_name(F.col("month")).alias("period"), "record_id", F.col("oid").alias("missing_oid"))
        .distinct()
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per table and month."""
    return orphans.groupBy("source_table", "period").agg(
        F.count(F.lit(1)).alias("n_references"), F.countDistinct("record_id").alias("n_records"), F.countDistinct("missing_oid").alias("n_missing")
    )
