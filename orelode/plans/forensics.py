"""Queries of detection, graph, history and report over the tables, and their SQL.

The tables have no HEAD; branches (``refs/heads``) play its part: what they
reach is ACTIVE, what only other references reach HISTORICAL, other stored
blobs ZOMBIE.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.decode.tree import KNOWN_MODES
from orelode.operators import detect, findings, graph, history
from orelode.session import materialize
from orelode.sources.tables import table

# ------------------------------------------------------------------ inputs


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("blob_id"), F.col("text").cast("binary").alias("payload"))


def _text_findings(spark: SparkSession, d: str) -> DataFrame:
    return findings.scored(detect.candidates(_texts(spark, d)))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return graph.stored_objects(table(spark, d, "fx_object"))


def _reach(spark: SparkSession, d: str) -> DataFrame:
    return graph.reachability(table(spark, d, "fx_commit"), table(spark, d, "fx_tree_entry"), table(spark, d, "fx_ref"))


def _states(spark: SparkSession, d: str) -> DataFrame:
    return graph.exposure_states(_reach(spark, d), _stored(spark, d))


def _occurrences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fx_occurrence").fillna("", ["path", "author", "commit_date"])


def _path_scores(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "fx_occurrence").where("blob_id is not null")
    return o.groupBy(F.col("blob_id").alias("oid")).agg(detect.path_score_of_all(F.col("path")).alias("path_score"))


def _store_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of the copy of each blob that counts; payloads do not move."""
    o = table(spark, d, "fx_object").where("deleted_at is null and type = 'blob' and oid is not null")
    c = detect.candidates(o.select(F.concat_ws("|", "oid", "storage").alias("blob_id"), "payload"))
    at = _stored(spark, d).where("type = 'blob'").select(F.concat_ws("|", "oid", "storage").alias("blob_id"), "oid")
    return c.join(at, "blob_id").drop("blob_id").withColumnRenamed("oid", "blob_id")


def _store_findings(spark: SparkSession, d: str) -> DataFrame:
    return findings.scored(_store_candidates(spark, d), _states(spark, d), _path_scores(spark, d))


# ----------------------------------------------------------------- queries


def scan_candidates(spark, d):
    return detect.candidates(_texts(spark, d)).select("blob_id", "pattern_name", "category", "byte_offset", "line_number", "length", "fingerprint")


def scan_candidates_builtin(spark, d):
    return detect.candidates_sql(_texts(spark, d))


def entropy_tiers(spark, d):
    return detect.candidates(_texts(spark, d)).select("blob_id", "pattern_name", "byte_offset", F.round("entropy", 6).alias("entropy"), detect.entropy_score(F.col("entropy")).alias("entropy_score"))


def context_keywords(spark, d):
    return detect.candidates(_texts(spark, d)).select("blob_id", "pattern_name", "byte_offset", "context_score", F.array_join("keywords", " ").alias("keywords"))


def binary_oversize_flags(spark, d):
    return detect.blob_flags(table(spark, d, "fx_object").where("type = 'blob'").select(F.col("oid").alias("blob_id"), "payload"))


def path_scores(spark, d):
    p = table(spark, d, "fx_occurrence").select("path").distinct()
    return p.select("path", detect.is_sensitive_path(F.col("path")).alias("sensitive"), detect.is_test_path(F.col("path")).alias("test"), detect.path_score(F.col("path")).alias("path_score"))


def path_score_agg(spark, d):
    return _path_scores(spark, d)


def confidence_tiers(spark, d):
    return _text_findings(spark, d).select("id", "blob_id", "pattern_name", "byte_offset", "confidence_score", "confidence_tier")


def redacted_findings(spark, d):
    return _text_findings(spark, d).select("id", "full_digest", "blob_id", "fingerprint", "redacted")


def evidence_signals(spark, d):
    f = _text_findings(spark, d).select("id", F.posexplode("evidence_signals").alias("pos", "s"))
    return f.select("id", "pos", "s.rule", "s.score", "s.detail")


def blob_oids(spark, d):
    o = table(spark, d, "fx_object").where("payload is not null")
    head = F.concat(F.concat_ws(" ", "type", F.octet_length("payload").cast("string")).cast("binary"), F.unhex(F.lit("00")))
    named = o.select("oid", "storage", F.sha1(F.concat(head, F.col("payload"))).alias("computed_oid"))
    return named.withColumn("integrity_mismatch", F.col("oid") != F.col("computed_oid"))


def oid_validation(spark, d):
    c = table(spark, d, "fx_ref").select("ref_id", "content").union(table(spark, d, "fx_tree_entry").select("entry_id", "child_oid"))
    return c.select("ref_id", "content", F.coalesce(F.col("content").rlike(r"\A[0-9a-f]{40}\z"), F.lit(False)).alias("is_oid"))


def entry_flags(spark, d):
    n = F.col("name")
    flag = F.when(F.octet_length(n) == 0, 1).when(n == F.lit(b"."), 2).when(n == F.lit(b".."), 3).when(F.hex(n).rlike("^(..)*?2F"), 4).otherwise(0)
    return table(spark, d, "fx_tree_entry").select("entry_id", "mode", F.when(n.isNotNull(), flag).alias("safety_flag"), (~F.col("mode").isin(*KNOWN_MODES)).alias("unknown_mode"))


def tree_canonical_order(spark, d):
    """Whether each tree's entries ascend; one row per entry counts, whatever was delivered twice."""
    e = table(spark, d, "fx_tree_entry").where("tree_oid is not null and name is not null").select("tree_oid", "pos", F.hex(F.concat("name", F.when(F.col("mode") == "40000", F.lit(b"/")).otherwise(F.lit(b"")))).alias("k")).distinct()
    # An entry list is a tree's own and short: sorted arrays compare neighbours without a window.
    t = e.groupBy("tree_oid").agg(F.sort_array(F.collect_list(F.struct("pos", "k"))).alias("es"))
    ok = F.forall(F.sequence(F.lit(1), F.size("es")), lambda i: (i == 1) | (F.element_at("es", F.greatest(i - 1, F.lit(1)))["k"] < F.element_at("es", i)["k"]))
    return t.select("tree_oid", F.size("es").alias("n_entries"), ok.alias("is_sorted"))


def ref_precedence(spark, d):
    return graph.ref_targets(table(spark, d, "fx_ref"))


def loose_over_pack(spark, d):
    return _stored(spark, d)


def object_edges(spark, d):
    return graph.object_edges(table(spark, d, "fx_commit"), table(spark, d, "fx_tree_entry"))


def root_set(spark, d):
    return graph.root_set(table(spark, d, "fx_ref"))


def reachable_objects(spark, d):
    return _reach(spark, d)


def exposure_states(spark, d):
    return _states(spark, d)


def unresolved_refs(spark, d):
    return graph.unresolved(_reach(spark, d), _stored(spark, d))


def dangling_objects(spark, d):
    return graph.dangling(_reach(spark, d), _stored(spark, d))


def _tree_paths(spark, d):
    e = table(spark, d, "fx_tree_entry").where("tree_oid is not null and name is not null")
    e = e.select(F.col("tree_oid").alias("node"), F.col("child_oid").alias("child"), "name", "mode", F.col("repo_id").alias("part"), F.col("observed_at").alias("pos"))
    roots = table(spark, d, "fx_commit").where("tree is not null").select(F.col("tree").alias("node")).distinct()
    return history.tree_paths(roots, e)


def path_expansion(spark, d):
    paths, _ = _tree_paths(spark, d)
    return paths.select("root", F.hex("path").alias("path_hex"), "blob")


def tree_depth_gaps(spark, d):
    _, deep = _tree_paths(spark, d)
    return deep.select("root", "node", F.hex("path").alias("path_hex"))


def blob_occurrences(spark, d):
    paths, _ = _tree_paths(spark, d)
    c = table(spark, d, "fx_commit").where("tree is not null").select("commit_sha", "tree", history.person(F.col("author")).alias("author"), F.regexp_extract("author", r"(\d+)\s+[+-]\d{4}\s*$", 1).try_cast("bigint").alias("timestamp")).distinct()
    return history.occurrences(paths, c).withColumn("path_hex", F.hex("path")).drop("path")


def timeline(spark, d):
    return history.timelines(_occurrences(spark, d), _states(spark, d))


def finding_dedup(spark, d):
    twice = _texts(spark, d)
    c = detect.candidates(twice.union(twice))
    return c.dropDuplicates(["blob_id", "byte_offset", "pattern_name"]).groupBy("pattern_name").agg(F.count(F.lit(1)).alias("n"))


def anomaly_dedup(spark, d):
    """Structural anomalies of tree entries, each once."""
    e = entry_flags(spark, d).join(table(spark, d, "fx_tree_entry").select("entry_id", "tree_oid", F.hex("name").alias("name_hex")), "entry_id")
    a = e.where("safety_flag > 0").select(F.lit("UNSAFE_TREE_NAME").alias("type"), F.concat_ws(":", "tree_oid", "name_hex").alias("location"), F.format_string("unsafe entry name flag=%d", "safety_flag").alias("description"))
    b = e.where("unknown_mode").select(F.lit("UNKNOWN_TREE_MODE"), F.concat_ws(":", "tree_oid", "name_hex"), F.format_string("unknown octal mode: %s", "mode"))
    return a.union(b).dropDuplicates(["type", "location", "description"])


def store_findings(spark, d):
    return _store_findings(spark, d).select("id", "blob_id", "exposure_state", "pattern_name", "byte_offset", "line_number", "is_binary", "redacted", "path_score", "confidence_score", "confidence_tier")


def summary_by_state(spark, d):
    return findings.by_state(_store_findings(spark, d))


def summary_counts(spark, d):
    states = materialize(_states(spark, d), "states")
    return findings.summary(findings.scored(_store_candidates(spark, d), states, _path_scores(spark, d)), states, "high")


def state_tier_cube(spark, d):
    return _store_findings(spark, d).cube("exposure_state", "confidence_tier").agg(F.count(F.lit(1)).alias("n_findings"))


def min_confidence_filter(spark, d):
    return findings.at_least(_text_findings(spark, d), "high").select("id", "confidence_tier", "confidence_score")


def explain_lookup(spark, d):
    """The first finding by order, looked up by its id."""
    f = materialize(_store_findings(spark, d), "findings")
    first = findings.ordered(f).limit(1).select("id").collect()  # one row
    return findings.explain(f, first[0].id if first else "0" * 16).select("id", "full_digest", "exposure_state", "recovery_explanation")


QUERIES = {
    f.__name__: f
    for f in (
        scan_candidates, scan_candidates_builtin, entropy_tiers, context_keywords, binary_oversize_flags, path_scores, path_score_agg, confidence_tiers, redacted_findings, evidence_signals, blob_oids, oid_validation,
        entry_flags, tree_canonical_order, ref_precedence, loose_over_pack, object_edges, root_set, reachable_objects, exposure_states, unresolved_refs, dangling_objects, path_expansion, tree_depth_gaps, blob_occurrences,
        timeline, finding_dedup, anomaly_dedup, store_findings, summary_by_state, summary_counts, state_tier_cube, min_confidence_filter, explain_lookup,
    )
}

# --------------------------------------------------------------------- SQL


def _ascii(text: str) -> str:
    """As many ASCII characters as ``text`` has bytes."""
    return f"regexp_replace(regexp_replace(regexp_replace({text}, '[\\x{{10000}}-\\x{{10FFFF}}]', '????', 'g'), '[\\x{{800}}-\\x{{FFFF}}]', '???', 'g'), '[\\x{{80}}-\\x{{7FF}}]', '??', 'g')"


_TEXTS = f"SELECT CAST(doc_id AS VARCHAR) AS id, {_ascii('text')} AS a, contains(substr({_ascii('text')}, 1, 8192), chr(0)) AS bin FROM documents WHERE text IS NOT NULL"
_BLOB_TEXT = "regexp_replace(replace(CAST(payload AS VARCHAR), '\\x0A', chr(10)), '\\\\x[0-9A-F]{2}', '?', 'g')"
_STORED = """
SELECT oid, min(k).t AS type, min(k).z AS size, min(k).s AS storage, count(*) AS n_copies
FROM (SELECT oid, {'r': CASE WHEN storage = 'loose' THEN 0 ELSE 1 END, 's': storage, 't': type, 'z': size} AS k FROM fx_object WHERE deleted_at IS NULL AND oid IS NOT NULL) GROUP BY oid"""


@lru_cache
def _candidates(rel: str) -> str:
    parts = []
    for p in detect.PATTERNS:
        parts.append(f"""
SELECT id, bin, a, '{p.name}' AS pattern_name, '{p.category}' AS category, {p.base} AS base, {str(p.is_private_key).lower()} AS pk, ms[k] AS v,
       CAST(list_sum(list_transform(sg[1:k], lambda x: strlen(x))) + coalesce(list_sum(list_transform(ms[1:k-1], lambda x: strlen(x))), 0) AS INTEGER) AS off
FROM (SELECT id, bin, a, regexp_extract_all(a, '{p.regex}') AS ms, string_split_regex(a, '{p.regex}') AS sg FROM ({rel}) WHERE regexp_matches(a, '{p.regex}')), unnest(range(1, len(ms) + 1)) AS u(k)""")
    words = "|".join(detect.CONTEXT_WORDS)
    return f"""
SELECT *, CASE WHEN r >= 4.5 THEN 25 WHEN r >= 3.8 THEN 18 WHEN r >= 3.0 THEN 10 ELSE 0 END AS es, CASE WHEN len(words) > 0 THEN 20 ELSE 0 END AS cs,
  sha256(encode(id) || '\\x00'::BLOB || encode(CAST(off AS VARCHAR)) || '\\x00'::BLOB || encode(pattern_name)) AS digest,
  CASE WHEN pk OR contains(v, 'PRIVATE KEY') THEN '[REDACTED PRIVATE KEY]' WHEN length(v) <= 8 THEN '...' ELSE v[1:4] || '...' || v[-4:] END AS redacted
FROM (SELECT id, pattern_name, category, base, pk, v, off, bin, CAST(CASE WHEN bin THEN 1 ELSE 1 + off - length(replace(substr(a, 1, off), chr(10), '')) END AS INTEGER) AS line,
  list_entropy(string_split(v, '')) AS e, round(list_entropy(string_split(v, '')), 9) AS r,
  list_filter(ws, lambda x, i: list_position(ws, x) = i) AS words
  FROM (SELECT *, list_transform(regexp_extract_all(substr(a, greatest(off - 100, 0) + 1, off + length(v) + 100 - greatest(off - 100, 0)), '(?i)(?:^|[^a-zA-Z0-9])({words})(?:$|[^a-zA-Z0-9])', 1), lambda x: lower(x)) AS ws FROM ({' UNION ALL '.join(parts)})))"""


_TIER = "CASE WHEN score >= 90 THEN 'CRITICAL' WHEN score >= 70 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END"
_TEXT_C = _candidates(_TEXTS)
_TEXT_F = f"SELECT *, {_TIER} AS tier FROM (SELECT *, least(greatest(base + es + cs, 0), 100) AS score, digest[1:16] AS fid FROM ({_TEXT_C}))"
_NAMES = ", ".join(f"'{n}'" for n in detect.SENSITIVE_NAMES)
_PARTS = ", ".join(f"'{n}'" for n in detect.TEST_PARTS)
_BASE = "list_last(string_split(regexp_replace(lower(path), '/+$', ''), '/'))"
_SENS = f"({_BASE} IN ({_NAMES}) OR starts_with({_BASE}, '.env.') OR ends_with({_BASE}, '.pem') OR ends_with({_BASE}, '.key'))"
_TEST = f"(list_has_any(string_split(lower(path), '/'), [{_PARTS}]) OR len(list_filter(string_split(lower(path), '/'), lambda x: {' OR '.join(f'ends_with(x, {chr(39)}{s}{chr(39)})' for s in detect.TEST_SUFFIXES)})) > 0)"
_PATH_AGG = f"SELECT blob_id AS oid, CASE WHEN bool_or(coalesce({_SENS}, false)) THEN 10 WHEN bool_and(coalesce({_TEST}, false)) THEN -30 ELSE 0 END AS path_score FROM fx_occurrence WHERE blob_id IS NOT NULL GROUP BY blob_id"
_REFS = """
SELECT repo_id, name, oid, origin FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id, name ORDER BY (origin = 'loose') DESC, observed_at DESC, ref_id DESC) AS rn
  FROM (SELECT *, regexp_replace(regexp_replace(content, '^\\s+', ''), '\\s+$', '') AS oid FROM fx_ref) WHERE regexp_full_match(oid, '[0-9a-f]{40}')) WHERE rn = 1"""
_ROOTS = f"SELECT 'head' AS tag, oid AS node FROM ({_REFS}) WHERE name LIKE 'refs/heads/%' UNION SELECT 'all', oid FROM ({_REFS})"
_EDGES = """
SELECT DISTINCT src, dst FROM (
  SELECT commit_sha AS src, unnest(parents) AS dst FROM fx_commit UNION ALL SELECT commit_sha, tree FROM fx_commit
  UNION ALL SELECT tree_oid, child_oid FROM fx_tree_entry WHERE mode IS DISTINCT FROM '160000') WHERE src IS NOT NULL AND dst IS NOT NULL"""
_REACH = f"WITH RECURSIVE edges AS MATERIALIZED ({_EDGES}), reach(tag, node) AS ({_ROOTS} UNION SELECT tag, dst FROM reach JOIN edges ON src = node)"
_STATES = f"""{_REACH}, stored AS MATERIALIZED ({_STORED}), states AS MATERIALIZED (
  SELECT oid, CASE WHEN oid IN (SELECT node FROM reach WHERE tag = 'head') THEN 'ACTIVE' WHEN oid IN (SELECT node FROM reach) THEN 'HISTORICAL' ELSE 'ZOMBIE' END AS exposure_state
  FROM stored WHERE type = 'blob')"""
_BLOBS = f"SELECT DISTINCT o.oid AS id, {_BLOB_TEXT} AS a, regexp_matches(hex(payload[1:8192]), '^(..)*00') AS bin FROM fx_object o JOIN stored s ON s.oid = o.oid AND s.storage = o.storage WHERE deleted_at IS NULL AND o.type = 'blob' AND s.type = 'blob' AND payload IS NOT NULL"
_FOUND = f"""{_STATES}, blobs AS MATERIALIZED ({_BLOBS}), paths AS ({_PATH_AGG}), found AS MATERIALIZED (
  SELECT *, {_TIER} AS tier FROM (SELECT c.*, digest[1:16] AS fid, exposure_state, coalesce(path_score, 0) AS ps, least(greatest(base + es + cs + coalesce(path_score, 0), 0), 100) AS score
  FROM ({_candidates('SELECT * FROM blobs')}) c JOIN states s ON s.oid = c.id LEFT JOIN paths p ON p.oid = c.id))"""
_PATHS = """
WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT tree_oid AS node, child_oid AS child, name, mode FROM fx_tree_entry WHERE tree_oid IS NOT NULL AND name IS NOT NULL AND child_oid IS NOT NULL),
w(root, node, path, line) AS (
  SELECT DISTINCT tree, tree, ''::BLOB, [tree] FROM fx_commit WHERE tree IN (SELECT node FROM e)
  UNION ALL SELECT root, child, CASE WHEN octet_length(path) = 0 THEN name ELSE path || '/'::BLOB || name END, list_append(line, child)
  FROM w JOIN e USING (node) WHERE mode = '40000' AND child IN (SELECT node FROM e) AND NOT list_contains(line, child)),
blobs AS (SELECT root, CASE WHEN octet_length(path) = 0 THEN name ELSE path || '/'::BLOB || name END AS path, child AS blob FROM w JOIN e USING (node) WHERE mode IN ('100644', '100755', '120000'))"""
_RANK = "CASE tier WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END"
_DATE = "CASE WHEN ts = 0 THEN '' ELSE strftime(make_timestamp(ts * 1000000), '%Y-%m-%dT%H:%M:%SZ') END"
_EXPLAIN = " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in findings.EXPLANATIONS.items())

SQL = {
    "scan_candidates": f"SELECT id AS blob_id, pattern_name, category, off AS byte_offset, line AS line_number, CAST(length(v) AS INTEGER) AS length, sha256(v) AS fingerprint FROM ({_TEXT_C})",
    "scan_candidates_builtin": f"SELECT id AS blob_id, pattern_name, off AS byte_offset, line AS line_number, sha256(v) AS fingerprint FROM ({_TEXT_C})",
    "entropy_tiers": f"SELECT id AS blob_id, pattern_name, off AS byte_offset, round(e, 6) AS entropy, es AS entropy_score FROM ({_TEXT_C})",
    "context_keywords": f"SELECT id AS blob_id, pattern_name, off AS byte_offset, cs AS context_score, array_to_string(words, ' ') AS keywords FROM ({_TEXT_C})",
    "binary_oversize_flags": "SELECT oid AS blob_id, octet_length(payload) AS size, regexp_matches(hex(payload[1:8192]), '^(..)*00') AS is_binary, octet_length(payload) > 10485760 AS is_oversize FROM fx_object WHERE type = 'blob'",
    "path_scores": f"SELECT path, {_SENS} AS sensitive, {_TEST} AS test, CASE WHEN {_SENS} THEN 10 ELSE 0 END + CASE WHEN {_TEST} THEN -30 ELSE 0 END AS path_score FROM (SELECT DISTINCT path FROM fx_occurrence)",
    "path_score_agg": _PATH_AGG,
    "confidence_tiers": f"SELECT fid AS id, id AS blob_id, pattern_name, off AS byte_offset, score AS confidence_score, tier AS confidence_tier FROM ({_TEXT_F})",
    "redacted_findings": f"SELECT fid AS id, digest AS full_digest, id AS blob_id, sha256(v) AS fingerprint, redacted FROM ({_TEXT_F})",
    "evidence_signals": f"""
WITH f AS (SELECT fid, list_filter([{{'rule': 'Strong Pattern Match', 'score': base, 'detail': printf('Matched %s (%s)', pattern_name, category)}}, {{'rule': 'Shannon Entropy Analysis', 'score': es, 'detail': printf('Entropy: %.2f bits/byte', e)}}, {{'rule': 'Context Keywords', 'score': cs, 'detail': printf('Nearby keywords: [%s]', array_to_string(words, ' '))}}], lambda x: x.score <> 0) AS s FROM ({_TEXT_F}))
SELECT fid AS id, CAST(k - 1 AS INTEGER) AS pos, s[k].rule AS rule, s[k].score AS score, s[k].detail AS detail FROM f, unnest(range(1, len(s) + 1)) AS u(k)""",
    "blob_oids": "SELECT oid, storage, c AS computed_oid, oid <> c AS integrity_mismatch FROM (SELECT oid, storage, sha1(encode(type || ' ' || octet_length(payload)) || '\\x00'::BLOB || payload) AS c FROM fx_object WHERE payload IS NOT NULL)",
    "oid_validation": "SELECT ref_id, content, coalesce(regexp_full_match(content, '[0-9a-f]{40}'), false) AS is_oid FROM (SELECT ref_id, content FROM fx_ref UNION ALL SELECT entry_id, child_oid FROM fx_tree_entry)",
    "entry_flags": "SELECT entry_id, mode, CASE WHEN octet_length(name) = 0 THEN 1 WHEN name = '.'::BLOB THEN 2 WHEN name = '..'::BLOB THEN 3 WHEN regexp_matches(hex(name), '^(..)*2F') THEN 4 WHEN name IS NOT NULL THEN 0 END AS safety_flag, mode NOT IN ('40000', '100644', '100755', '120000', '160000') AS unknown_mode FROM fx_tree_entry",
    "tree_canonical_order": """
WITH e AS (SELECT DISTINCT tree_oid, pos, hex(name || CASE WHEN mode = '40000' THEN '/'::BLOB ELSE ''::BLOB END) AS k FROM fx_tree_entry WHERE tree_oid IS NOT NULL AND name IS NOT NULL),
l AS (SELECT tree_oid, k, lag(k) OVER (PARTITION BY tree_oid ORDER BY pos, k) AS p FROM e)
SELECT tree_oid, CAST(count(*) AS INTEGER) AS n_entries, bool_and(p IS NULL OR p < k) AS is_sorted FROM l GROUP BY tree_oid""",
    "ref_precedence": _REFS,
    "loose_over_pack": _STORED,
    "object_edges": _EDGES,
    "root_set": _ROOTS,
    "reachable_objects": f"{_REACH} SELECT tag, node FROM reach",
    "exposure_states": f"{_STATES} SELECT * FROM states",
    "unresolved_refs": f"{_STATES} SELECT DISTINCT node AS oid FROM reach WHERE node NOT IN (SELECT oid FROM stored)",
    "dangling_objects": f"{_STATES} SELECT oid, type FROM stored WHERE oid NOT IN (SELECT node FROM reach)",
    "path_expansion": f"{_PATHS} SELECT root, hex(path) AS path_hex, blob FROM blobs",
    "tree_depth_gaps": f"{_PATHS} SELECT root, child AS node, hex(CASE WHEN octet_length(path) = 0 THEN name ELSE path || '/'::BLOB || name END) AS path_hex FROM w JOIN e USING (node) WHERE mode = '40000' AND list_contains(line, child)",
    "blob_occurrences": f"""{_PATHS}, c AS (SELECT DISTINCT commit_sha, tree, regexp_extract(author, '^(.*<.*>)\\s+\\d+\\s+[+-]\\d{{4}}\\s*$', 1) AS author, TRY_CAST(regexp_extract(author, '(\\d+)\\s+[+-]\\d{{4}}\\s*$', 1) AS BIGINT) AS ts FROM fx_commit)
SELECT blob AS blob_id, commit_sha, ts AS commit_timestamp, {_DATE} AS commit_date, author, hex(path) AS path_hex FROM blobs JOIN c ON c.tree = blobs.root""",
    "timeline": f"""{_STATES}, o AS (SELECT blob_id, {{'t': commit_timestamp, 'c': commit_sha, 'p': coalesce(path, ''), 'd': coalesce(commit_date, ''), 'a': coalesce(author, '')}} AS k FROM fx_occurrence WHERE blob_id IS NOT NULL),
ends AS (SELECT blob_id, min(k) AS a, max(k) AS z, count(*) AS n FROM o GROUP BY 1)
SELECT oid, exposure_state, n AS n_occurrences, a.c AS earliest_commit, a.d AS earliest_date, a.a AS earliest_author, CASE WHEN exposure_state <> 'ACTIVE' THEN z.c END AS removal_commit, CASE WHEN exposure_state <> 'ACTIVE' THEN z.d END AS removal_date,
  CASE WHEN exposure_state <> 'ACTIVE' THEN '{history.NOTE_GONE}' ELSE '{history.NOTE_ACTIVE}' END AS evidence_note FROM ends JOIN states ON oid = blob_id""",
    "finding_dedup": f"SELECT pattern_name, count(DISTINCT (id, off)) AS n FROM ({_TEXT_C}) GROUP BY 1",
    "anomaly_dedup": """
WITH e AS (SELECT tree_oid, hex(name) AS n, mode, CASE WHEN octet_length(name) = 0 THEN 1 WHEN name = '.'::BLOB THEN 2 WHEN name = '..'::BLOB THEN 3 WHEN regexp_matches(hex(name), '^(..)*2F') THEN 4 ELSE 0 END AS f FROM fx_tree_entry)
SELECT DISTINCT 'UNSAFE_TREE_NAME' AS type, concat_ws(':', tree_oid, n) AS location, 'unsafe entry name flag=' || f AS description FROM e WHERE f > 0
UNION ALL SELECT DISTINCT 'UNKNOWN_TREE_MODE', concat_ws(':', tree_oid, n), 'unknown octal mode: ' || mode FROM e WHERE mode NOT IN ('40000', '100644', '100755', '120000', '160000')""",
    "store_findings": f"{_FOUND} SELECT fid AS id, id AS blob_id, exposure_state, pattern_name, off AS byte_offset, line AS line_number, bin AS is_binary, redacted, ps AS path_score, score AS confidence_score, tier AS confidence_tier FROM found",
    "summary_by_state": f"{_FOUND} SELECT exposure_state, tier AS confidence_tier, pattern_name, count(*) AS n_findings, count(DISTINCT id) AS n_blobs, max(score) AS max_score FROM found GROUP BY ALL",
    "summary_counts": f"""{_FOUND} SELECT (SELECT count(*) FROM states) AS total_blobs, (SELECT count(*) FROM states WHERE exposure_state = 'ACTIVE') AS active_blobs, (SELECT count(*) FROM states WHERE exposure_state = 'HISTORICAL') AS historical_blobs,
  (SELECT count(*) FROM states WHERE exposure_state = 'ZOMBIE') AS zombie_blobs, count(*) AS total_findings, count(*) FILTER ({_RANK} >= 3) AS displayed_findings, count(*) FILTER (tier = 'CRITICAL') AS critical_findings,
  count(*) FILTER (tier = 'HIGH') AS high_findings, count(*) FILTER (tier = 'MEDIUM') AS medium_findings, count(*) FILTER (tier = 'LOW') AS low_findings FROM found""",
    "state_tier_cube": f"{_FOUND} SELECT exposure_state, tier AS confidence_tier, count(*) AS n_findings FROM found GROUP BY CUBE (exposure_state, tier)",
    "min_confidence_filter": f"SELECT fid AS id, tier AS confidence_tier, score AS confidence_score FROM ({_TEXT_F}) WHERE {_RANK} >= 3",
    "explain_lookup": f"{_FOUND} SELECT fid AS id, digest AS full_digest, exposure_state, CASE exposure_state {_EXPLAIN} END AS recovery_explanation FROM found ORDER BY {_RANK} DESC, score DESC, fid LIMIT 1",
}
