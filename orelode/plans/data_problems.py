"""Queries of the general data problems (p1, p2, p3, p5, p6) and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.operators import hierarchy, history, hot_keys, nested, orphans, snapshots
from orelode.sources.tables import table
from orelode.streaming.state import OrphanLedger, SnapshotIndex

NO_BOUND = 2**31 - 1  # circles end each walk; the ceiling of levels is one of scans


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hot_keys.hot_keys(hot_keys.occurrence_counts(table(spark, d, "fx_occurrence")))


def p1_key_counts(spark: SparkSession, d: str) -> DataFrame:
    return hot_keys.occurrence_profile(table(spark, d, "fx_occurrence"), table(spark, d, "fx_commit"))


def p1_blob_repo_counts(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "fx_occurrence"), table(spark, d, "fx_commit")
    return hot_keys.eager_join_aggregate(o, c, "commit_sha", ["blob_id"], ["repo_id"], F.col("commit_timestamp"), "n_joined", "sum_timestamp")


def p1_occurrence_lists(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "fx_occurrence")
    one = hot_keys.occurrence_lists(o, "blob_id").withColumn("key_kind", F.lit("blob"))
    return one.unionByName(hot_keys.occurrence_lists(o, "commit_sha").withColumn("key_kind", F.lit("commit")))


def p1_list_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of all lists, taken out of them again."""
    return p1_occurrence_lists(spark, d).select("key_kind", "key_value", F.explode("occurrences").alias("o")).select("key_kind", "key_value", "o.*")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchies(table(spark, d, "fx_commit"), table(spark, d, "fx_tree_entry"))


def p2_commit_paths(spark: SparkSession, d: str) -> DataFrame:
    p = hierarchy.forest_paths(hierarchy.commit_nodes(table(spark, d, "fx_commit")), "commit-paths")
    return p.select("node", F.element_at("path", 1).alias("root"), (F.size("path") - 1).alias("depth"), F.array_join("path", "/").alias("path"))


def p2_commit_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendant_counts(hierarchy.descendant_index(hierarchy.commit_nodes(table(spark, d, "fx_commit")), "commit-index"))


def p2_commit_descendant_index(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendant_index(hierarchy.commit_nodes(table(spark, d, "fx_commit")), "commit-index")


def p2_tree_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.tree_descendants(table(spark, d, "fx_tree_entry"))


def p2_tree_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every tree below every root tree, at every path of names."""
    e = table(spark, d, "fx_tree_entry").where("tree_oid is not null and name is not null")
    e = e.select(F.col("tree_oid").alias("node"), F.col("child_oid").alias("child"), "name", "mode", F.col("repo_id").alias("part"), F.col("observed_at").alias("pos"))
    roots = table(spark, d, "fx_commit").where("tree is not null").select(F.col("tree").alias("node")).distinct()
    return history.expand_trees(roots, e, NO_BOUND).where("kind = 'tree'").select("root", "node", F.hex("path").alias("path_hex"), "depth")


def _ledger(spark: SparkSession, d: str) -> tuple[DataFrame, OrphanLedger]:
    """The references, and the ledger kept through two batches: references wait, then objects arrive and go."""
    refs = orphans.reference_rows(table(spark, d, "fx_tree_entry"), table(spark, d, "fx_ref"), table(spark, d, "fx_classification"))
    refs = orphans.waiting_for(refs, table(spark, d, "fx_alternate"))
    ledger = OrphanLedger(spark, f"orphans-{uuid.uuid4().hex}", buckets=16)
    ledger.advance(0, references=refs, count=False)
    ledger.advance(1, objects=table(spark, d, "fx_object"))
    return refs, ledger


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    refs, ledger = _ledger(spark, d)
    return orphans.orphans_of(refs, ledger.pending())


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """What waits per table and month after the last batch, as the ledger counted it."""
    return _ledger(spark, d)[1].counts()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(p3_found(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """By two batches through the kept index: the lower half of the numbers, then the rest."""
    s = table(spark, d, "fx_snapshot")
    ends = s.agg(F.min("snapshot_no"), F.max("snapshot_no")).first()
    middle = (ends[0] + ends[1]) // 2 if ends[0] is not None else 0
    index = SnapshotIndex(spark, f"snapshots-{uuid.uuid4().hex}", buckets=16)
    first = index.apply(s.where(F.col("snapshot_no") <= middle), 0)
    return first.unionByName(index.apply(s.where(F.col("snapshot_no") > middle), 1))


def p5_change_values(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "fx_snapshot")
    return snapshots.change_values(snapshots.snapshot_changes(s), s)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.child_keys(nested.flat_tables(table(spark, d, "scan_report")))


def p6_flat_tables(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_tables(table(spark, d, "scan_report"))


def _p6(child_table: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return nested.typed(nested.flat_tables(table(spark, d, "scan_report")), child_table).drop("rest", "variant")

    return query


def p6_variants(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each subtype table, from the tables themselves."""
    t = nested.variant_tables(table(spark, d, "scan_report"))
    return t.groupBy("child_table", "variant").agg(F.count(F.lit(1)).alias("n_rows"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_key_counts, p1_blob_repo_counts, p1_occurrence_lists, p1_list_rows, p2_found, p2_commit_paths, p2_commit_descendants, p2_commit_descendant_index, p2_tree_descendants, p2_tree_paths, p3_found, p3_report, p3_counts, p5_found, p5_change_values, p6_found, p6_flat_tables, p6_variants)
} | {f"p6_{t}s": _p6(t) for t in ("finding", "occurrence", "signal", "timeline")}

_OCC = "(SELECT DISTINCT * FROM fx_occurrence)"
_P3 = """
WITH refs AS (
  SELECT 'fx_tree_entry' AS source_table, entry_id AS record_id, observed_at AS ts, child_oid AS oid FROM fx_tree_entry WHERE mode IS DISTINCT FROM '160000'
  UNION ALL SELECT 'fx_ref', ref_id, observed_at, content FROM fx_ref
  UNION ALL SELECT 'fx_classification', scan_id, scanned_at, unnest(unresolved_oids) FROM fx_classification
), named AS (
  SELECT source_table, record_id, date_trunc('month', ts) AS month, regexp_replace(regexp_replace(oid, '^\\s+', ''), '\\s+$', '') AS oid FROM refs WHERE ts IS NOT NULL
), cases AS (
  SELECT * FROM named n WHERE regexp_full_match(oid, '[0-9a-f]{40}') AND oid NOT IN (SELECT oid FROM fx_alternate)
    AND NOT EXISTS (SELECT 1 FROM fx_object o WHERE o.oid = n.oid AND o.stored_at < n.month + INTERVAL 1 MONTH
                    AND (o.deleted_at IS NULL OR o.deleted_at >= n.month + INTERVAL 1 MONTH))
), found AS (SELECT DISTINCT source_table, strftime(month, '%Y-%m') AS period, record_id, oid AS missing_oid FROM cases)
"""
_P5 = """
WITH nums AS (SELECT stream_id, snapshot_no, lag(snapshot_no) OVER (PARTITION BY stream_id ORDER BY snapshot_no) AS last_no
              FROM (SELECT DISTINCT stream_id, snapshot_no FROM fx_snapshot)),
s AS (SELECT DISTINCT stream_id, snapshot_no, path, blob_oid, mode FROM fx_snapshot WHERE path IS NOT NULL),
old AS (SELECT n.stream_id, n.snapshot_no, s.path, s.blob_oid, s.mode FROM nums n JOIN s ON s.stream_id = n.stream_id AND s.snapshot_no = n.last_no),
new AS (SELECT s.* FROM s JOIN nums n USING (stream_id, snapshot_no) WHERE n.last_no IS NOT NULL)
SELECT stream_id, snapshot_no, path, CASE WHEN o.stream_id IS NULL THEN 'added' WHEN n.stream_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT *, true AS here FROM new) n FULL JOIN (SELECT *, true AS here FROM old) o USING (stream_id, snapshot_no, path)
WHERE n.here IS NULL OR o.here IS NULL OR n.blob_oid IS DISTINCT FROM o.blob_oid OR n.mode IS DISTINCT FROM o.mode
"""
_P6 = """
WITH raw AS (SELECT DISTINCT report_id, body FROM scan_report WHERE body IS NOT NULL),
js AS (SELECT report_id, CASE WHEN json_valid(b) THEN CAST(b AS JSON) END AS j FROM (SELECT report_id, ltrim(body, chr(65279) || chr(32) || chr(9) || chr(10) || chr(13)) AS b FROM raw)),
rep AS (SELECT report_id, coalesce(j->'$.payload.report', j->'$.report', j)->'$.findings' AS r FROM js WHERE j IS NOT NULL),
fs AS MATERIALIZED (SELECT report_id, CASE WHEN json_type(r) = 'VARCHAR' THEN CAST(r->>'$' AS JSON) ELSE r END AS fs FROM rep),
f AS MATERIALIZED (
  SELECT report_id, x->>'$.id' AS finding_id, x FROM (SELECT report_id, unnest(json_extract(fs, '$[*]')) AS x FROM fs WHERE json_type(fs) = 'ARRAY') WHERE json_type(x) = 'OBJECT'
  UNION ALL SELECT report_id, coalesce(x->>'$.id', k), x FROM (SELECT report_id, k, json_extract(fs, '$."' || k || '"') AS x FROM (SELECT report_id, fs, unnest(json_keys(fs)) AS k FROM fs WHERE json_type(fs) = 'OBJECT')) WHERE json_type(x) = 'OBJECT'),
p AS (SELECT report_id, finding_id, 'occurrence' AS child_table, 'occurrences' AS part, x->'$.occurrences' AS v FROM f
  UNION ALL SELECT report_id, finding_id, 'signal', 'evidencesignals', coalesce(x->'$.evidenceSignals', x->'$.evidence_signals') FROM f
  UNION ALL SELECT report_id, finding_id, 'timeline', 'timeline', CASE WHEN json_type(x->'$.timeline') = 'VARCHAR' THEN CAST(x->>'$.timeline' AS JSON) ELSE x->'$.timeline' END FROM f),
e AS MATERIALIZED (SELECT report_id, finding_id, child_table, part, CAST(i - 1 AS INTEGER) AS child_pos, 'list of ' || child_table AS variant, l[i] AS x FROM (SELECT *, json_extract(v, '$[*]') AS l FROM p WHERE json_type(v) = 'ARRAY'), unnest(range(1, len(l) + 1)) AS u(i) WHERE json_type(l[i]) <> 'NULL'
  UNION ALL SELECT report_id, finding_id, child_table, part, 0, child_table, v FROM p WHERE json_type(v) = 'OBJECT'),
t AS (SELECT report_id, finding_id, child_pos, part, CAST(child_pos AS VARCHAR) AS place, child_table, x FROM e)
"""


def _both(camel: str, kind: str = "VARCHAR") -> str:
    """A field under either spelling."""
    snake = "".join(f"_{c.lower()}" if c.isupper() else c for c in camel)
    return f"CAST(coalesce(x->>'$.{camel}', x->>'$.{snake}') AS {kind}) AS "


def _p6_part(kind: str, columns: str) -> str:
    return f"{_P6} SELECT report_id, finding_id, child_pos, part, place, {columns} FROM t WHERE child_table = '{kind}'"


_UP = """
WITH RECURSIVE c AS (SELECT commit_sha AS node, min(parents[1]) AS parent FROM fx_commit WHERE commit_sha IS NOT NULL GROUP BY 1),
w(node, path) AS (SELECT node, [node] FROM c WHERE parent IS NULL OR parent NOT IN (SELECT node FROM c)
  UNION ALL SELECT c.node, list_append(path, c.node) FROM w JOIN c ON c.parent = w.node)"""
_TREES = """
WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT tree_oid AS node, child_oid AS child, name FROM fx_tree_entry WHERE tree_oid IS NOT NULL AND name IS NOT NULL AND mode = '40000'),
n AS MATERIALIZED (SELECT DISTINCT tree_oid AS node FROM fx_tree_entry WHERE tree_oid IS NOT NULL AND name IS NOT NULL),
w(root, node, path, line) AS (
  SELECT DISTINCT tree, tree, ''::BLOB, [tree] FROM fx_commit WHERE tree IN (SELECT node FROM n)
  UNION ALL SELECT root, child, CASE WHEN octet_length(path) = 0 THEN name ELSE path || '/'::BLOB || name END, list_append(line, child)
  FROM w JOIN e USING (node) WHERE child IN (SELECT node FROM n) AND NOT list_contains(line, child))"""
SQL = {
    "p2_commit_paths": _UP + " SELECT node, path[1] AS root, CAST(len(path) - 1 AS INTEGER) AS depth, array_to_string(path, '/') AS path FROM w",
    "p2_commit_descendants": _UP + " SELECT node, count(*) - 1 AS n_descendants FROM (SELECT unnest(path) AS node FROM w) GROUP BY node",
    "p2_tree_descendants": """
WITH RECURSIVE n AS MATERIALIZED (SELECT DISTINCT tree_oid AS node FROM fx_tree_entry WHERE tree_oid IS NOT NULL),
e AS MATERIALIZED (SELECT DISTINCT tree_oid AS a, child_oid AS z FROM fx_tree_entry WHERE mode = '40000' AND tree_oid IS NOT NULL AND child_oid IN (SELECT node FROM n)),
t(node, descendant, line) AS (SELECT a, z, [z] FROM e UNION ALL SELECT node, z, list_append(line, z) FROM t JOIN e ON a = descendant WHERE NOT list_contains(line, z))
SELECT node, descendant, CAST(min(len(line)) AS INTEGER) AS distance FROM t GROUP BY node, descendant""",
    "p2_tree_paths": _TREES + " SELECT root, node, hex(path) AS path_hex, CAST(len(line) - 1 AS INTEGER) AS depth FROM w WHERE len(line) > 1",
    "p2_found": """
WITH RECURSIVE c AS MATERIALIZED (SELECT commit_sha AS node, min(parents[1]) AS parent FROM fx_commit WHERE commit_sha IS NOT NULL GROUP BY 1),
w(node, root, depth) AS (SELECT node, node, 0 FROM c WHERE parent IS NULL OR parent NOT IN (SELECT node FROM c) UNION ALL SELECT c.node, root, depth + 1 FROM w JOIN c ON c.parent = w.node),
r(start, cur, line) AS (SELECT node, parent, [node] FROM c WHERE node NOT IN (SELECT node FROM w)
  UNION ALL SELECT start, c.parent, list_append(line, cur) FROM r JOIN c ON c.node = cur WHERE cur <> start AND NOT list_contains(line, cur)),
n AS MATERIALIZED (SELECT DISTINCT tree_oid AS node FROM fx_tree_entry WHERE tree_oid IS NOT NULL),
e AS MATERIALIZED (SELECT DISTINCT tree_oid AS a, child_oid AS z FROM fx_tree_entry WHERE mode = '40000' AND tree_oid IS NOT NULL AND child_oid IN (SELECT node FROM n)),
t(root, node, line) AS (SELECT DISTINCT tree, tree, [tree] FROM fx_commit WHERE tree IN (SELECT node FROM n)
  UNION ALL SELECT root, z, list_append(line, z) FROM t JOIN e ON a = node WHERE NOT list_contains(line, z)),
reach(a, z) AS (SELECT a, z FROM e UNION SELECT reach.a, e.z FROM reach JOIN e ON e.a = reach.z)
SELECT 'commit' AS hierarchy, node, root, depth FROM w UNION ALL SELECT DISTINCT 'commit', start, '', -1 FROM r WHERE cur = start
UNION ALL SELECT DISTINCT 'tree', node, root, CAST(len(line) - 1 AS INTEGER) FROM t UNION ALL SELECT DISTINCT 'tree', a, '', -1 FROM reach WHERE a = z""",
    "p5_change_values": """
WITH heads AS (SELECT stream_id, snapshot_no, min(commit_sha) AS observed_commit, min(taken_at) AS observed_at FROM fx_snapshot WHERE stream_id IS NOT NULL GROUP BY ALL),
nums AS (SELECT *, lag(snapshot_no) OVER (PARTITION BY stream_id ORDER BY snapshot_no) AS last_no FROM heads),
s AS (SELECT DISTINCT stream_id, snapshot_no, path, blob_oid, mode FROM fx_snapshot WHERE path IS NOT NULL),
old AS (SELECT n.stream_id, n.snapshot_no, s.path, s.blob_oid AS old_blob, s.mode AS old_mode, true AS o FROM nums n JOIN s ON s.stream_id = n.stream_id AND s.snapshot_no = n.last_no),
new AS (SELECT s.stream_id, s.snapshot_no, path, blob_oid AS new_blob, mode AS new_mode, true AS n FROM s JOIN nums USING (stream_id, snapshot_no) WHERE last_no IS NOT NULL)
SELECT stream_id, last_no, snapshot_no, path, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'removed' ELSE 'changed' END AS change, old_blob, old_mode, new_blob, new_mode, observed_commit, observed_at
FROM (SELECT * FROM new FULL JOIN old USING (stream_id, snapshot_no, path)) JOIN nums USING (stream_id, snapshot_no)
WHERE o IS NULL OR n IS NULL OR old_blob IS DISTINCT FROM new_blob OR old_mode IS DISTINCT FROM new_mode""",
    "p1_found": f"""
WITH o AS {_OCC}, k AS (SELECT 'blob' AS key_kind, blob_id AS key_value FROM o UNION ALL SELECT 'commit', commit_sha FROM o)
SELECT key_kind, key_value FROM k WHERE key_value IS NOT NULL GROUP BY ALL HAVING count(*) * 100 >= (SELECT count(*) FROM o)""",
    "p1_key_counts": f"""
WITH o AS {_OCC}, k AS (SELECT 'blob' AS key_kind, blob_id AS key_value FROM o UNION ALL SELECT 'commit', commit_sha FROM o),
n AS (SELECT key_kind, key_value, count(*) AS n_occurrences FROM k WHERE key_value IS NOT NULL GROUP BY ALL),
c AS (SELECT 'commit' AS key_kind, commit_sha AS key_value, count(*) AS m FROM fx_commit WHERE commit_sha IS NOT NULL GROUP BY 2)
SELECT key_kind, key_value, coalesce(n_occurrences, 0) AS n_occurrences, coalesce(m, 0) AS n_commit_rows, coalesce(n_occurrences, 0) * coalesce(m, 0) AS n_joined
FROM n FULL JOIN c USING (key_kind, key_value)""",
    "p1_blob_repo_counts": """
SELECT blob_id, repo_id, count(*) AS n_joined, CAST(sum(commit_timestamp) AS BIGINT) AS sum_timestamp
FROM fx_occurrence JOIN fx_commit USING (commit_sha) GROUP BY ALL""",
    "p6_found": f"""{_P6} SELECT DISTINCT 'finding' AS child_table, report_id, finding_id, 0 AS child_pos FROM f UNION ALL SELECT DISTINCT child_table, report_id, finding_id, child_pos FROM e""",
    "p6_findings": f"""{_P6} SELECT report_id, finding_id, 0 AS child_pos, 'findings' AS part, '0' AS place, {_both('blobId')}blob_id, {_both('patternName')}pattern_name, {_both('exposureState')}exposure_state, {_both('confidenceScore', 'BIGINT')}confidence_score,
  {_both('confidenceTier')}confidence_tier, x->>'$.redacted' AS redacted, {_both('lineNumber', 'BIGINT')}line_number, {_both('byteOffset', 'BIGINT')}byte_offset, {_both('isBinary', 'BOOLEAN')}is_binary FROM f""",
    "p6_occurrences": _p6_part("occurrence", f"{_both('commitSha')}commit_sha, {_both('commitTimestamp', 'BIGINT')}commit_timestamp, x->>'$.author' AS author, x->>'$.path' AS path"),
    "p6_signals": _p6_part("signal", "x->>'$.rule' AS rule, CAST(x->>'$.score' AS BIGINT) AS score, x->>'$.detail' AS detail"),
    "p6_timelines": _p6_part("timeline", f"{_both('earliestObservedCommit')}earliest_commit, {_both('removalObservedCommit')}removal_commit, {_both('evidenceNote')}evidence_note"),
    "p1_list_rows": f"""
WITH o AS {_OCC}, k AS (SELECT 'blob' AS key_kind, blob_id AS key_value, * FROM o UNION ALL SELECT 'commit', commit_sha, * FROM o)
SELECT key_kind, key_value, commit_timestamp, commit_sha, blob_id, path, commit_date, author, loaded_at FROM k WHERE key_value IS NOT NULL""",
    "p3_found": _P3 + "SELECT * FROM found",
    "p3_report": _P3 + "SELECT source_table, period, count(*) AS n_references, count(DISTINCT record_id) AS n_records, count(DISTINCT missing_oid) AS n_missing FROM found GROUP BY ALL",
    "p3_counts": _P3.replace("), found AS", "), w AS (SELECT source_table, strftime(month, '%Y-%m') AS period, oid FROM cases), found AS") + "SELECT source_table, period, count(*) AS n_references, count(DISTINCT oid) AS n_missing FROM w GROUP BY ALL",
    "p5_found": _P5,
}
