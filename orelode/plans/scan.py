"""The scan of one repository, from files to findings."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.limits import MAX_PEEL_DEPTH, Limits
from orelode.operators import detect, findings, graph, history
from orelode.session import materialize
from orelode.sources import objects as store
from orelode.sources.repository import RefError, Repository, RepositoryNotFound, all_refs, discover, resolve_head


@dataclass
class ScanResult:
    """All stages of a scan; every DataFrame can be queried on."""

    repository: Repository
    head: str
    started: float
    min_confidence: str
    objects: DataFrame
    reach: DataFrame
    states: DataFrame
    unresolved: DataFrame
    occurrences: DataFrame
    findings: DataFrame
    gaps: DataFrame
    anomalies: DataFrame
    duration_ms: int = 0
    refs: dict[str, str] = field(default_factory=dict)

    def register(self) -> None:
        """Make the stages SQL views."""
        for name in TABLES:
            getattr(self, name).createOrReplaceTempView(name)


def peel(roots: DataFrame, objects: DataFrame, tags: DataFrame) -> DataFrame:
    """``(root, node, type, error)``: references followed through tags, at most ``MAX_PEEL_DEPTH`` objects deep."""
    kinds = objects.select(F.col("oid").alias("node"), "type")
    at = roots.select(F.col("node").alias("root"), "node", F.array("node").alias("past")).join(kinds, "node", "left").withColumn("error", F.lit(None).cast("string"))
    for _ in range(MAX_PEEL_DEPTH - 1):  # the object behind the last step must be looked at as well
        on = at.where("type = 'tag' and error is null")
        if on.isEmpty():
            break
        step = on.select("root", F.col("node").alias("oid"), "past").join(tags, "oid", "left")
        step = step.select("root", F.col("target").alias("node"), F.array_append("past", F.col("target")).alias("past"), F.when(F.col("target").isNull(), "malformed tag object").when(F.array_contains("past", F.col("target")), "symbolic ref cycle detected").alias("error"))
        at = materialize(at.where("not (type <=> 'tag') or error is not null").unionByName(step.join(kinds, "node", "left")), "peel")
    deep = F.when((F.col("type") == "tag") & F.col("error").isNull(), "maximum tag peel depth exceeded").when(F.col("type").isNull() & F.col("error").isNull(), "object not found").otherwise(F.col("error"))
    return at.select("root", "node", "type", deep.alias("error"))


def _notes(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "type string, location string, description string")


def _note(df: DataFrame, kind: str, location, description) -> DataFrame:
    return df.select(F.lit(kind).alias("type"), location.alias("location"), description.alias("description"))


def run_scan(spark: SparkSession, path: str, min_confidence: str = "LOW", limits: Limits = Limits()) -> ScanResult:
    started = time.time()
    minimum = detect.parse_tier(min_confidence)
    repo = discover(path)
    notes: list[tuple[str, str, str]] = []
    head = ""
    try:
        head, _ = resolve_head(repo)
    except (RefError, OSError) as e:
        notes.append(("MALFORMED_REF", "HEAD", f"failed to resolve HEAD: {e}"))
    refs = all_refs(repo)
    notes += refs.anomalies

    where = f"{repo.common_dir}/objects"
    stored = store.ObjectStore(spark, where, limits=limits)
    loose, packed, objects = stored.loose, stored.packed, stored.objects
    sound = objects.where("error is null")
    meta = sound.select("oid", "type", "size", "integrity_mismatch", "computed_oid")
    commits = materialize(store.parsed_commits(sound), "commits")
    entries = materialize(store.parsed_entries(sound), "entries")
    tags = store.parsed_tags(sound)

    # Roots: peeled references, each by what it names.
    roots = spark.createDataFrame([("head", head)] * bool(head) + [("all", x) for x in {head, *refs.by_name.values()} - {""}], "tag string, node string")
    peeled = materialize(peel(roots.select("node").distinct(), meta, tags), "peeled")
    typed = roots.withColumnRenamed("node", "root").join(peeled, "root")
    mark = {"commit": "c:", "tree": "t:", "blob": "b:"}
    prefix = F.when(F.col("type") == "commit", "c:").when(F.col("type") == "tree", "t:").when(F.col("type") == "blob", "b:")
    seeds = typed.where(F.col("error").isNull() & F.col("type").isin(*mark)).select("tag", F.concat(prefix, "node").alias("node"))

    # Edges: a node is known by what it is taken for, since the three sets are apart.
    good = commits.where("error is null")
    c_tree = good.select(F.concat(F.lit("c:"), "oid").alias("src"), F.concat(F.lit("t:"), "tree").alias("dst"))
    c_parent = good.select("oid", F.explode("parents").alias("p")).select(F.concat(F.lit("c:"), "oid"), F.concat(F.lit("c:"), "p"))
    e = entries.where("error is null")
    kinds = meta.select(F.col("oid").alias("child_oid"), F.col("type").alias("child_type"))
    exists = objects.select(F.col("oid").alias("child_oid"), (F.col("loose_file") | F.col("error").isNull()).alias("there"))
    full = materialize(e.join(kinds, "child_oid", "left").join(exists, "child_oid", "left").withColumn("there", F.coalesce("there", F.lit(False))), "typed-entries")
    as_blob = F.col("mode").isin("100644", "100755", "120000")
    to = F.when(F.col("mode") == "40000", "t:").when(as_blob & F.col("there"), "b:").when(F.col("unknown_mode") & (F.col("child_type") == "blob"), "b:")
    t_child = full.select(F.concat(F.lit("t:"), "tree_oid").alias("src"), F.concat(to, "child_oid").alias("dst")).where("dst is not null")
    edges = c_tree.union(c_parent).union(t_child)
    nodes = good.select(F.concat(F.lit("c:"), "oid").alias("node"), F.lit("").alias("part"), F.col("timestamp").alias("pos")).union(e.select(F.concat(F.lit("t:"), "tree_oid"), F.lit(""), F.lit(0).cast("bigint")).distinct())
    reached = materialize(graph.closure(nodes, edges, seeds, "scan"), "reach")
    reach = reached.select("tag", F.substring("node", 1, 1).alias("kind"), F.substring("node", 3, 40).alias("oid"))
    visited = reach.select("kind", "oid").distinct()

    # States: what HEAD reaches, what references reach, what is only stored.
    head_b = reach.where("kind = 'b' and tag = 'head'").select("oid").distinct().withColumn("exposure_state", F.lit("ACTIVE"))
    all_b = reach.where("kind = 'b'").select("oid").distinct()
    old = all_b.join(head_b.select("oid"), "oid", "left_anti").withColumn("exposure_state", F.lit("HISTORICAL"))
    lost = meta.where("type = 'blob'").select("oid").join(all_b, "oid", "left_anti").withColumn("exposure_state", F.lit("ZOMBIE"))
    states = materialize(head_b.union(old).union(lost), "states")

    # Anomalies of what was visited.
    loc = F.col("oid")
    seen_meta = visited.where("kind in ('c', 't')").join(meta, "oid", "left")
    gone = seen_meta.where("type is null")
    bad_hash = seen_meta.where("integrity_mismatch")
    bad_c = visited.where("kind = 'c'").join(commits.where("error is not null").select("oid", "error"), "oid")
    bad_t = visited.where("kind = 't'").join(entries.where("error is not null").select(F.col("tree_oid").alias("oid"), "error"), "oid")
    wrong = seen_meta.where("(kind = 'c' and type <> 'commit') or (kind = 't' and type <> 'tree')")
    in_tree = full.join(visited.where("kind = 't'").select(F.col("oid").alias("tree_oid")), "tree_oid")
    name = F.concat(F.col("tree_oid"), F.lit(":"), history.text("name"))
    missing_blob = in_tree.where(as_blob & ~F.col("there"))
    missing_odd = in_tree.where(F.col("unknown_mode") & F.col("child_type").isNull())
    found = [
        _notes(spark, notes),
        packed.where("note_kind = 'anomaly'").select(F.col("note_type").alias("type"), "location", "description"),
        _note(gone, "MISSING_REFERENCED_OBJECT", loc, F.concat(F.lit("missing "), F.when(F.col("kind") == "c", "commit").otherwise("tree"), F.lit(" object: object not found"))),
        _note(typed.where("error is not null"), "MISSING_REFERENCED_OBJECT", F.col("root"), F.concat(F.lit("failed to resolve root ref target: "), F.col("error"))),
        _note(bad_hash, "LOOSE_INTEGRITY_MISMATCH", loc, F.format_string("loose object hash mismatch (expected %s, computed %s)", "oid", "computed_oid")),
        _note(bad_c, "MALFORMED_COMMIT", loc, F.concat(F.lit("malformed commit payload: "), F.col("error"))),
        _note(bad_t, "MALFORMED_TREE", loc, F.concat(F.lit("malformed tree payload: "), F.col("error"))),
        _note(wrong.where("kind = 't'"), "MALFORMED_TREE", loc, F.concat(F.lit("malformed tree payload: object is a "), F.col("type"))),
        _note(wrong.where("kind = 'c'"), "MALFORMED_COMMIT", loc, F.concat(F.lit("malformed commit payload: object is a "), F.col("type"))),
        _note(in_tree.where("safety_flag > 0"), "UNSAFE_TREE_NAME", name, F.format_string("unsafe entry name flag=%d", "safety_flag")),
        _note(in_tree.where("unknown_mode"), "UNKNOWN_TREE_MODE", name, F.concat(F.lit("unknown octal mode: "), F.col("mode"))),
        _note(in_tree.where("unknown_mode and child_type = 'tree'"), "TREE_TYPE_MISMATCH", F.col("child_oid"), F.concat(F.lit("tree object under non-40000 mode "), F.col("mode"), F.lit("; subtree recursion inhibited"))),
        _note(missing_blob, "MISSING_REFERENCED_OBJECT", F.col("child_oid"), F.format_string("referenced blob %s missing from storage", "child_oid")),
        _note(missing_odd, "MISSING_REFERENCED_OBJECT", F.col("child_oid"), F.lit("missing object for unknown mode entry: object not found")),
        _note(objects.where("error is not null and source = 'loose'"), "CORRUPTED_LOOSE_OBJECT", F.col("location"), F.format_string("failed to read loose object %s: %s", "oid", "error")),
        _note(loose.where("integrity_mismatch"), "LOOSE_INTEGRITY_MISMATCH", F.col("location"), F.format_string("loose object hash mismatch (expected %s, computed %s)", "oid", "computed_oid")),
    ]
    # Histories: each root tree is expanded once.
    known = good.join(visited.where("kind = 'c'").select("oid"), "oid").select(F.col("oid").alias("commit_sha"), "tree", "author", "timestamp")
    paths, deep = history.tree_paths(known.select(F.col("tree").alias("node")).distinct(), e.select(F.col("tree_oid").alias("node"), F.col("child_oid").alias("child"), "name", "mode", F.lit("").alias("part"), F.lit(0).alias("pos")), limits.tree_depth)
    occurrences = materialize(history.occurrences(paths, known).withColumn("path", history.text("path")), "occurrences")
    deep_note = F.format_string(f"tree %s exceeds maximum history traversal depth of {limits.tree_depth}", "node")
    found.append(_note(deep, "RECURSION_DEPTH_EXCEEDED", F.col("node"), deep_note))
    if visited.count() > limits.total_objects:
        found.append(_notes(spark, [("RECURSION_DEPTH_EXCEEDED", head, "total object traversal safety ceiling reached")]))
    anomalies = found[0]
    for x in found[1:]:
        anomalies = anomalies.union(x)
    anomalies = materialize(anomalies.distinct(), "anomalies")
    unresolved = anomalies.where("type = 'MISSING_REFERENCED_OBJECT'").where(F.col("location").rlike(r"\A[0-9a-f]{40}\z")).select(F.col("location").alias("oid")).distinct()

    # Findings: payloads are searched where they lie; candidates, which are few, meet states, paths and occurrences.
    scores = occurrences.groupBy(F.col("blob_id").alias("oid")).agg(detect.path_score_of_all(F.col("path")).alias("path_score"))
    found_in = materialize(detect.candidates(sound.select(F.col("oid").alias("blob_id"), "payload"), most=limits.blob_bytes), "candidates")
    raw = findings.scored(found_in, states, scores)
    row = F.struct("commit_timestamp", "commit_sha", "path", "commit_date", "author")
    # A report lists the occurrences of its findings; those of other blobs are never gathered.
    wanted = occurrences.join(found_in.select("blob_id").distinct(), "blob_id", "left_semi").groupBy("blob_id").agg(F.sort_array(F.collect_set(row)).alias("os"))
    gone_ = F.col("exposure_state") != "ACTIVE"
    first, last = F.get("os", F.lit(0)), F.element_at("os", -1)
    final = raw.join(wanted, "blob_id", "left").select(
        "id", F.col("full_digest").alias("fullDigest"), F.col("blob_id").alias("blobId"), "fingerprint", F.col("exposure_state").alias("exposureState"), F.col("pattern_name").alias("patternName"), "category",
        F.col("confidence_score").alias("confidenceScore"), F.col("confidence_tier").alias("confidenceTier"), "redacted", F.col("line_number").alias("lineNumber"), F.col("byte_offset").alias("byteOffset"), F.col("is_binary").alias("isBinary"),
        F.transform("os", lambda o: F.struct(o["commit_sha"].alias("commitSha"), o["commit_timestamp"].alias("commitTimestamp"), o["commit_date"].alias("commitDate"), o["author"].alias("author"), o["path"].alias("path"))).alias("occurrences"),
        F.when(F.col("os").isNotNull(), F.struct(
            first["commit_sha"].alias("earliestObservedCommit"), first["commit_date"].alias("earliestObservedDate"), first["author"].alias("earliestObservedAuthor"),
            F.when(gone_, last["commit_sha"]).alias("removalObservedCommit"), F.when(gone_, last["commit_date"]).alias("removalObservedDate"),
            F.when(gone_, history.NOTE_GONE).otherwise(history.NOTE_ACTIVE).alias("evidenceNote"),
        )).alias("timeline"),
        F.col("evidence_signals").alias("evidenceSignals"),
    )
    final = materialize(final, "findings")
    gaps = (
        _note(unresolved, "unresolvedPackOnly", F.col("oid"), F.format_string("referenced object %s could not be resolved from storage", "oid"))
        .union(packed.where("note_kind = 'gap'").select("note_type", "location", "description"))
        .union(_note(sound.join(states.select("oid"), "oid", "left_semi").where(F.col("size") > limits.blob_bytes), "skippedOversizeBlob", F.col("oid"), F.format_string("blob %s size %d exceeds 10MB limit and was skipped", "oid", "size")))
        .union(_note(deep, "treeDepthLimitExceeded", F.col("node"), deep_note))
        .withColumnRenamed("location", "target")
        .distinct()
    )
    gaps = materialize(gaps, "gaps")
    return ScanResult(repo, head, started, minimum, objects, reach, states, unresolved, occurrences, final, gaps, anomalies, int((time.time() - started) * 1000), refs.by_name)


def ordered_findings(result: ScanResult, minimum: str = "LOW") -> DataFrame:
    rank = detect.TIERS.index(minimum) + 1
    shown = result.findings.where(detect.tier_rank(F.col("confidenceTier")) >= rank)
    return shown.orderBy(detect.tier_rank(F.col("confidenceTier")).desc(), F.col("confidenceScore").desc(), "id")


TABLES = ("objects", "reach", "states", "unresolved", "occurrences", "findings", "gaps", "anomalies")


def run_scans(spark: SparkSession, paths: list[str], min_confidence: str = "LOW", limits: Limits = Limits()) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(the tables of all repositories, told apart by ``repo_id``; path to what kept a repository from being scanned)."""
    out: dict[str, DataFrame] = {}
    failed: dict[str, str] = {}
    for path in paths:
        try:
            r = run_scan(spark, path, min_confidence, limits)
        except (RepositoryNotFound, OSError) as e:
            failed[path] = str(e)
            continue
        for name in TABLES:
            one = getattr(r, name).withColumn("repo_id", F.lit(r.repository.git_dir))
            out[name] = out[name].unionByName(one) if name in out else one
    return out, failed
