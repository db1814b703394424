"""Findings: candidates with their blob's exposure, paths and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.operators import detect

#: What each state means for recovery (fixed values).
EXPLANATIONS = {
    "ACTIVE": "ACTIVE EXPOSURE: The secret exists in the current worktree HEAD. It is directly checked out on the working tree and visible in HEAD commit history.",
    "HISTORICAL": "HISTORICAL EXPOSURE: The secret is no longer present in current HEAD, but is reachable through other Git branches, tags, or refs. Anyone cloning or fetching refs can extract this secret.",
    "ZOMBIE": "ZOMBIE (DANGLING) EXPOSURE: The secret is an unreferenced orphan object physically persisting on disk in loose or pack storage. It is invisible to standard 'git log' or branch checkouts, but remains fully recoverable by direct object inspection until Git garbage collection ('git gc --prune=now') deletes or repacks the object.",
    "UNRESOLVED_MISSING": "UNRESOLVED STORAGE: The secret is referenced in the Git DAG but its payload could not be extracted from storage.",
}
UNKNOWN_STATE = "Unknown exposure state."


def scored(candidates: DataFrame, states: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """Findings of candidates.

    ``states(oid, exposure_state)``; ``paths(oid, path_score)``.  A blob
    without paths scores 0 for them.
    """
    c = candidates.dropDuplicates(["blob_id", "byte_offset", "pattern_name"])
    c = c.join(states.withColumnRenamed("oid", "blob_id"), "blob_id") if states is not None else c.withColumn("exposure_state", F.lit(None).cast("string"))
    c = c.join(paths.withColumnRenamed("oid", "blob_id"), "blob_id", "left") if paths is not None else c.withColumn("path_score", F.lit(0))
    c = c.withColumn("path_score", F.coalesce("path_score", F.lit(0))).withColumn("entropy_score", detect.entropy_score(F.col("entropy")))
    c = c.withColumn("confidence_score", detect.confidence(F.col("base_score"), F.col("entropy_score"), F.col("context_score"), F.col("path_score")))
    digest = detect.finding_digest(F.col("blob_id"), F.col("byte_offset"), F.col("pattern_name"))
    return c.withColumn("confidence_tier", detect.tier(F.col("confidence_score"))).withColumn("full_digest", digest).withColumn("id", F.substring("full_digest", 1, 16)).withColumn(
        "evidence_signals", detect.evidence(F.col("base_score"), F.col("pattern_name"), F.col("category"), F.col("entropy"), F.col("entropy_score"), F.col("context_score"), F.col("keywords"), F.col("path_score"))
    )


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(detect.tier_rank(F.col("confidence_tier")).desc(), F.col("confidence_score").desc(), "id")


def at_least(findings: DataFrame, minimum: str) -> DataFrame:
    """The display filter; totals are taken from what lies before it."""
    rank = detect.TIERS.index(detect.parse_tier(minimum)) + 1
    return findings.where(detect.tier_rank(F.col("confidence_tier")) >= rank)


def explain(findings: DataFrame, finding_id: str) -> DataFrame:
    key = finding_id.lower()
    meaning = F.lit(UNKNOWN_STATE)
    for state, text in EXPLANATIONS.items():
        meaning = F.when(F.col("exposure_state") == state, text).otherwise(meaning)
    return ordered(findings.where((F.col("id") == key) | (F.col("full_digest") == key))).limit(1).withColumn("recovery_explanation", meaning)


def summary(findings: DataFrame, states: DataFrame, displayed: str = "LOW") -> DataFrame:
    """One row of counts: blobs by state, findings by tier, what is displayed."""
    s = states.agg(
        F.count(F.lit(1)).alias("total_blobs"), *(F.count_if(F.col("exposure_state") == x).alias(f"{x.lower()}_blobs") for x in ("ACTIVE", "HISTORICAL", "ZOMBIE"))
    )
    rank = detect.TIERS.index(detect.parse_tier(displayed)) + 1
    f = findings.agg(
        F.count(F.lit(1)).alias("total_findings"),
        F.count_if(detect.tier_rank(F.col("confidence_tier")) >= rank).alias("displayed_findings"),
        *(F.count_if(F.col("confidence_tier") == x).alias(f"{x.lower()}_findings") for x in reversed(detect.TIERS)),
    )
    return s.crossJoin(f)  # one row each


def by_state(findings: DataFrame) -> DataFrame:
    return findings.groupBy("exposure_state", "confidence_tier", "pattern_name").agg(F.count(F.lit(1)).alias("n_findings"), F.countDistinct("blob_id").alias("n_blobs"), F.max("confidence_score").alias("max_score"))
