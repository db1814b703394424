"""The general data problems against brute force, with the cases each docstring defines."""

import json
import random
from collections import Counter, defaultdict
from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from orelode.operators import hierarchy, hot_keys, nested, orphans, snapshots

OCC = "blob_id string, commit_sha string, commit_timestamp bigint, commit_date string, author string, path string, loaded_at timestamp"
COMMIT = "repo_id string, commit_sha string, tree string, parents array<string>, author string, committer string, message string, loaded_at timestamp"
ENTRY = "entry_id bigint, repo_id string, tree_oid string, pos int, mode string, name binary, child_oid string, observed_at timestamp"
DAY = dt(2024, 1, 31, 12)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ------------------------------------------------------------------ hot keys


def test_hot_keys(spark):
    data = [("hot", f"c{i % 40}", 1, None, "a", f"p{i}", DAY) for i in range(120)] + [(None, "c0", 1, None, None, None, DAY)] * 2 + [("once", None, 0, "", "a", "p", DAY)] * 3
    data += [("", "c1", 1, None, "a", "p", DAY), (None, "c1", 1, None, "a", "p", DAY)]
    o = spark.createDataFrame(data, OCC).withColumn("n_rows", F.lit(1))  # a clashing name
    c = spark.createDataFrame([("r", f"c{i}", "t", None, "a", "b", "m", DAY) for i in (0, 1, 2, 3, 4, 99)] * 2, COMMIT)
    prof = {(r.key_kind, r.key_value): r for r in hot_keys.occurrence_profile(o, c).collect()}
    total = len(set(data))
    assert {r.n_total for r in hot_keys.occurrence_counts(o).collect()} == {total}
    want = Counter(("blob", x[0]) for x in set(data) if x[0] is not None) + Counter(("commit", x[1]) for x in set(data) if x[1] is not None)
    assert {k: r.n_occurrences for k, r in prof.items() if r.n_occurrences} == want
    assert prof["commit", "c1"].n_joined == 2 * want["commit", "c1"] and prof["commit", "c9"].n_joined == 0
    assert (prof["commit", "c99"].n_occurrences, prof["commit", "c99"].n_commit_rows) == (0, 2)
    found = rows(hot_keys.hot_keys(hot_keys.occurrence_counts(o)))
    assert found == sorted((k for k, n in want.items() if n * 100 >= total), key=str)
    assert hot_keys.hot_keys(hot_keys.occurrence_counts(o.limit(0))).count() == 0 and hot_keys.occurrence_lists(o.limit(0), "blob_id").count() == 0
    got = hot_keys.eager_join_aggregate(o, c, "commit_sha", ["blob_id"], ["repo_id"], F.col("commit_timestamp"))
    plain = o.join(c.drop("author", "loaded_at"), "commit_sha").groupBy("blob_id", "repo_id").agg(F.count("*").alias("n_rows"), F.sum("commit_timestamp").alias("total"))
    assert rows(got) == rows(plain)
    salted = hot_keys.eager_join_aggregate(o, c, "commit_sha", ["blob_id", "path"], ["repo_id"], F.col("commit_timestamp"), states_per_salt=1)
    plain = o.join(c.drop("author", "loaded_at"), "commit_sha").groupBy("blob_id", "path", "repo_id").agg(F.count("*").alias("n_rows"), F.sum("commit_timestamp").alias("total"))
    assert rows(salted) == rows(plain)
    lists = hot_keys.occurrence_lists(o, "blob_id", 10).collect()
    assert sum(r.n_rows for r in lists if r.key_value == "hot") == 120 and len([r for r in lists if r.key_value == "hot"]) > 5
    assert sum(r.n_rows for r in lists if r.key_value == "once") == 1  # exact repetitions count once
    apart = o.withColumn("extra", F.expr("if(path = 'p7', 1, 0)")).unionByName(o.where("path = 'p7'").withColumn("extra", F.lit(2)))
    assert sum(r.n_rows for r in hot_keys.occurrence_lists(apart, "blob_id", 10).collect() if r.key_value == "hot") == 121  # they differ in a column that is not listed
    light = [("k%d" % (i % 5), "c", i, None, "a", "p", DAY) for i in range(100)]  # more rows than a shard, though none heavy
    hot_keys.HEAVY, kept = 2, hot_keys.HEAVY
    try:
        got = hot_keys.occurrence_lists(spark.createDataFrame(light, OCC), "blob_id", 5).collect()
    finally:
        hot_keys.HEAVY = kept
    assert sum(r.n_rows for r in got) == 100 and {r.n_shards for r in got} == {4}


# ---------------------------------------------------------------- hierarchies


def brute_forest(par):
    out = set()
    for n in par:
        p, seen = n, []
        while p in par and p not in seen:
            seen.append(p)
            p = par[p]
        if p in seen:
            if n in seen[seen.index(p) :] :
                out.add((n, "", -1))
        else:
            out.add((n, seen[-1], len(seen) - 1))
    return out


def random_forest(seed, n=300):
    r = random.Random(seed)
    par = {f"n{i:03}": (None if r.random() < 0.03 else f"n{r.randrange(max(1, i - 20), i + 1) - 1:03}" if i and r.random() < 0.9 else f"gone{i}") for i in range(n)}
    for a, b in ((50, 55), (120, 190), (200, 200)):  # circles, one of a single node
        par[f"n{a:03}"] = f"n{b:03}"
        x = b
        while x > a and f"n{x:03}" not in (None,):
            par[f"n{x:03}"] = f"n{x - 1:03}"
            x -= 1
    return par


@pytest.mark.parametrize("finish", [300_000, 5])
@pytest.mark.parametrize("chunk", [40_000, 37])
def test_forest(spark, monkeypatch, finish, chunk):
    monkeypatch.setattr(hierarchy, "FINISH_ROWS", finish)
    monkeypatch.setattr(hierarchy, "CHUNK_NODES", chunk)
    par = random_forest(chunk + finish)
    nodes = spark.createDataFrame([(n, p, None if i % 9 == 0 else f"r{i % 2}", DAY) for i, (n, p) in enumerate(par.items())], "node string, parent string, part string, pos timestamp")
    got = hierarchy.forest(nodes).collect()
    assert len(got) == len(par)
    assert {tuple(r) for r in got if r.root is not None} == brute_forest(par)


def brute_walk(children, roots):
    def reach(n):
        seen, st = set(), list(children[n])
        while st:
            x = st.pop()
            if x not in seen:
                seen.add(x)
                st += children[x]
        return seen

    ring = {n for n in list(children) if n in reach(n)}
    out = set()

    def go(n, d, past):
        out.add((roots_now, n, d))
        for c in children[n]:
            if c not in past:
                go(c, d + 1, past | {c})

    for roots_now in roots:
        go(roots_now, 0, {roots_now})
    return out, ring


@pytest.mark.parametrize("finish, chunk, share", [(300_000, 40_000, 50_000), (3, 4, 2)])
def test_walk(spark, monkeypatch, finish, chunk, share):
    monkeypatch.setattr(hierarchy, "FINISH_ROWS", finish)
    monkeypatch.setattr(hierarchy, "CHUNK_NODES", chunk)
    r = random.Random(4)
    names = [f"t{i:02}" for i in range(30)]
    links = {(names[i], names[j]) for i in range(30) for j in range(i + 1, 30) if r.random() < 0.07} | {("t09", "t05"), ("t20", "t18"), ("t18", "t20"), ("t25", "t25")}
    children = defaultdict(list)
    for a, b in links:
        children[a].append(b)
    for n in names:
        children[n]
    want, ring = brute_walk(children, names[:6])
    nodes = spark.createDataFrame([(n, "r", i) for i, n in enumerate(names)], "node string, part string, pos int")
    got, rings = hierarchy.walk_graph(nodes, spark.createDataFrame(sorted(links), "parent string, child string"), spark.createDataFrame([(n,) for n in names[:6]], "node string"), states_per_place=share)
    assert {tuple(x) for x in got.collect()} == want
    assert {x.node for x in rings.collect()} == ring


def brute_pairs(children):
    """Shortest distance by one link or more from each node to each it reaches."""
    out = set()
    for n in list(children):
        seen, front, d = set(), {n}, 0
        while front:
            d += 1
            front = {z for x in front for z in children[x]} - seen
            seen |= front
            out |= {(n, z, d) for z in front}
    return out


@pytest.mark.parametrize("finish, chunk", [(300_000, 40_000), (300_000, 37), (5, 37)])
def test_descendants(spark, monkeypatch, finish, chunk):
    monkeypatch.setattr(hierarchy, "FINISH_ROWS", finish)
    monkeypatch.setattr(hierarchy, "CHUNK_NODES", chunk)
    par = random_forest(chunk + finish)
    children = defaultdict(list)
    for n, p in par.items():
        if p in par:
            children[p].append(n)
    for n in par:
        children[n]
    nodes = spark.createDataFrame([(n, p, None if i % 9 == 0 else f"r{i % 2}", DAY) for i, (n, p) in enumerate(par.items())], "node string, parent string, part string, pos timestamp")
    index = hierarchy.materialize(hierarchy.descendant_index(nodes), "test-index")
    assert sorted(r.node for r in index.collect()) == sorted(par)
    assert {r.node for r in index.collect() if r.circle} == {n for n, _, d in brute_forest(par) if d == -1}
    got = rows(hierarchy.descendant_pairs(index))
    assert got == sorted(brute_pairs(children), key=str)  # on and below circles too, each once
    assert hierarchy.descendant_index(nodes.limit(0)).count() == 0


def test_tree_descendants(spark):
    links = [("t1", "t2"), ("t2", "t3"), ("t1", "t3"), ("t3", "t4"), ("t5", "t6"), ("t6", "t7"), ("t7", "t5"), ("t7", "t4"), ("t8", "t8"), ("t6", "t6")]
    e = [(i, "r", a, 0, "40000", b"d", z, DAY) for i, (a, z) in enumerate(links)] * 2 + [(90, "r", "t4", 0, "100644", b"f", None, None), (91, "r", "t4", 0, "40000", b"g", "none", DAY), (92, "r", "t1", 0, "100644", b"g", "t8", DAY), (93, "r", None, 0, "40000", b"g", "t8", DAY)]
    children = defaultdict(list)
    for a, z in links:
        children[a].append(z)
    children["t4"]
    got = rows(hierarchy.tree_descendants(spark.createDataFrame(e, ENTRY)))
    assert got == sorted(brute_pairs(children), key=str)  # no commit takes any of them as root
    assert hierarchy.tree_descendants(spark.createDataFrame([], ENTRY)).count() == 0


def test_tree_paths_have_no_ceiling(spark, tmp_path):
    from orelode.plans import data_problems

    n = 1_005
    spark.createDataFrame([(i, "r", f"t{i:04}", 0, "40000", b"d", f"t{i + 1:04}", DAY) for i in range(n)] + [(n, "r", f"t{n:04}", 0, "100644", b"f", "x", DAY)], ENTRY).write.parquet(f"{tmp_path}/fx_tree_entry.parquet")
    spark.createDataFrame([("r", "c", "t0000", None, "a", "b", "m", DAY)], COMMIT).write.parquet(f"{tmp_path}/fx_commit.parquet")
    got = data_problems.p2_tree_paths(spark, str(tmp_path)).select("node", "depth").collect()
    assert sorted(tuple(r) for r in got) == [(f"t{i:04}", i) for i in range(1, n + 1)]


def test_hierarchies(spark):
    c = [("r", "c1", "t1", None, "a", "b", "m", DAY), ("r", "c2", "t1", ["c1", "c9"], "a", "b", "m", DAY), ("r", "c2", "t1", ["c1", "c9"], "a", "b", "m", dt(2024, 2, 1)), ("r", "c3", "tx", ["zz"], "a", None, "m", None), (None, "c4", None, [], "a", "b", "m", DAY), ("r", "c5", "t1", ["c5"], "a", "b", "m", DAY), ("r", "c6", "t1", ["c5"], "a", "b", "m", DAY)]
    e = [(1, "r", "t1", 0, "40000", b"d", "t2", DAY), (2, "r", "t1", 1, "040000", b"x", "t3", DAY), (3, "r", "t2", 0, "40000", b"u", "t1", DAY), (3, "r", "t2", 0, "40000", b"u", "t1", DAY), (4, None, "t3", 0, "100644", b"f", None, None), (5, "r", "t2", 1, "40000", b"g", "none", DAY)]
    got = rows(hierarchy.hierarchies(spark.createDataFrame(c, COMMIT), spark.createDataFrame(e, ENTRY)))
    assert got == sorted([
        ("commit", "c1", "c1", 0), ("commit", "c2", "c1", 1), ("commit", "c3", "c3", 0), ("commit", "c4", "c4", 0), ("commit", "c5", "", -1),
        ("tree", "t1", "t1", 0), ("tree", "t2", "t1", 1), ("tree", "t1", "", -1), ("tree", "t2", "", -1),
    ], key=str)
    assert hierarchy.hierarchies(spark.createDataFrame([], COMMIT), spark.createDataFrame([], ENTRY)).count() == 0


# -------------------------------------------------------------------- orphans


def test_orphans(spark):
    a, b, c, d = ("a" * 40, "b" * 40, "c" * 40, "d" * 40)
    e = [(1, "r", "t", 0, "100644", b"n", f" {a}\n", DAY), (1, "r", "t", 0, "100644", b"n", f" {a}\n", DAY), (2, "r", "t", 0, "160000", b"n", b, DAY), (3, "r", "t", 0, None, b"n", b, DAY), (4, "r", "t", 0, "100644", b"n", "A" * 40, DAY), (5, "r", "t", 0, "100644", b"n", c, None), (6, "r", "t", 0, "100644", b"n", d, dt(2024, 2, 3)), (7, "r", "t", 0, "100644", b"n", None, DAY)]
    refs = spark.createDataFrame([(9, "r", "x", f"\t{c} ", "loose", dt(2023, 12, 1)), (8, "r", "x", "ref: y", "loose", DAY)], "ref_id bigint, repo_id string, name string, content string, origin string, observed_at timestamp")
    cls = spark.createDataFrame([(5, "r", DAY, 1, 1, 1, [a, None, "zz", b]), (6, "r", DAY, 1, 1, 1, None), (7, "r", DAY, 1, 1, 1, [])], "scan_id bigint, repo_id string, scanned_at timestamp, n_active int, n_historical int, n_zombie int, unresolved_oids array<string>")
    obj = spark.createDataFrame([
        ("r", a, dt(2024, 2, 1), None), ("r", a, dt(2024, 2, 1), None),  # arrives a month too late
        ("r", b, dt(2023, 5, 1), dt(2024, 2, 1)), ("q", b, dt(2024, 5, 1), None),  # goes at the first instant of the next month
        ("r", d, dt(2024, 1, 1), dt(2024, 2, 29)), ("r", d, dt(2023, 1, 1), dt(2022, 1, 1)), ("r", c, None, None),
    ], "repo_id string, oid string, stored_at timestamp, deleted_at timestamp")
    none = spark.createDataFrame([], "oid string, type string, payload binary")
    r = orphans.reference_rows(spark.createDataFrame(e, ENTRY), refs, cls)
    want = [("fx_classification", "2024-01", 5, a), ("fx_ref", "2023-12", 9, c), ("fx_tree_entry", "2024-01", 1, a), ("fx_tree_entry", "2024-02", 6, d)]
    assert rows(orphans.orphan_references(r, obj, none)) == want
    assert rows(orphans.orphan_references(r, obj, spark.createDataFrame([(a, "blob", b"")], "oid string, type string, payload binary"))) == want[1:2] + want[3:]
    # Increments merge to the same state, in any order.
    whole = orphans.merge_ledgers(orphans.parent_ledger(obj), orphans.reference_ledger(r))
    early, late = obj.where("stored_at < '2024-01-15'"), obj.where("not (stored_at < '2024-01-15') or stored_at is null")
    parts = orphans.merge_ledgers(orphans.merge_ledgers(orphans.parent_ledger(late), orphans.reference_ledger(r)), orphans.parent_ledger(early))
    assert rows(orphans.pending(whole)) == rows(orphans.pending(parts))
    assert orphans.orphan_report(orphans.orphan_references(r, obj, none)).count() == 4
    assert orphans.orphan_references(r.limit(0), obj, none).count() == 0


# ------------------------------------------------------------------ snapshots


def test_snapshots(spark):
    r = random.Random(2)
    data = []
    for stream in range(4):
        for no in (1, 2, 5, 6):
            for p in range(40):
                if r.random() < 0.8:
                    data.append((stream, "r", no, DAY, f"c{no}", f"p{p}", r.choice(("x", "y", None)), r.choice(("m", None)), DAY))
    data += data[:50] + [(9, "r", 1, DAY, "c", "p", "x", "m", DAY), (3, "r", 7, DAY, "c", None, "x", "m", DAY), (None, "r", 1, DAY, "c", "p", "x", "m", DAY)]
    r.shuffle(data)
    schema = "stream_id bigint, repo_id string, snapshot_no int, taken_at timestamp, commit_sha string, path string, blob_oid string, mode string, delivered_at timestamp"
    snaps = defaultdict(dict)
    for s, _, no, _, _, p, b, m, _ in data:
        if s is not None:
            snaps[s, no]
            if p is not None:
                snaps[s, no][p] = (b, m)
    want = set()
    for s in {k[0] for k in snaps}:
        nos = sorted(n for q, n in snaps if q == s)
        for a, z in zip(nos, nos[1:]):
            old, new = snaps[s, a], snaps[s, z]
            want |= {(s, z, p, "added") for p in new.keys() - old.keys()} | {(s, z, p, "removed") for p in old.keys() - new.keys()} | {(s, z, p, "changed") for p in old.keys() & new.keys() if old[p] != new[p]}
    df = spark.createDataFrame(data, schema)
    for size in (20_000, 7):
        got = [tuple(x) for x in snapshots.snapshot_changes(df, size).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    values = snapshots.change_values(snapshots.snapshot_changes(df), df).collect()
    assert len(values) == len(want)
    for v in values:
        assert (v.old_blob, v.old_mode) == snaps[v.stream_id, v.last_no].get(v.path, (None, None)) and (v.new_blob, v.new_mode) == snaps[v.stream_id, v.snapshot_no].get(v.path, (None, None))
    assert snapshots.snapshot_changes(df.limit(0)).count() == 0


# --------------------------------------------------------------------- nested


def test_nested(spark):
    occ = {"commitSha": "c", "commitTimestamp": 5, "commitDate": "d", "author": "a", "path": "p"}
    sig = {"rule": "r", "score": 1, "detail": None}
    full = {"id": "f1", "patternName": "P", "redacted": "x...y", "occurrences": [None, occ, occ], "timeline": {"earliestObservedCommit": "c"}, "evidenceSignals": [sig]}
    snake = {"id": "f2", "pattern_name": "P", "occurrences": occ, "timeline": json.dumps({"earliest_observed_commit": "c"}), "evidence_signals": None}
    bare = {"id": "f3", "blobId": "b", "timeline": None}
    keyed = {"fullDigest": "z", "blobId": "b", "occurrences": [], "evidenceSignals": json.dumps([sig, sig])}
    plain = lambda fs: {"schemaVersion": "1.0", "findings": fs}
    bodies = [
        (1, json.dumps(plain([full, None, bare]))), (1, json.dumps(plain([full, None, bare]))), (2, "﻿" + json.dumps({"meta": {}, "payload": {"report": {"schema_version": "1", "findings": [snake]}}})),
        (3, json.dumps(plain({"k1": keyed, "k2": None}))), (4, json.dumps(plain(json.dumps([bare])))), (5, json.dumps(plain(None))), (6, '{"schemaVersion": "1.0", "fin'), (7, None), (8, "null"), (9, json.dumps({"schemaVersion": "1.0"})), (10, json.dumps(json.dumps(plain([bare])))), (11, ""),
    ]
    df = spark.createDataFrame(bodies, "report_id bigint, body string").withColumn("child_table", F.lit("clash"))
    got = rows(nested.child_keys(nested.flat_tables(df)))
    want = [("finding", r, f, 0) for r, f in ((1, "f1"), (1, "f3"), (2, "f2"), (3, "k1"), (4, "f3"), (10, "f3"))]
    want += [("timeline", 1, "f1", 0), ("timeline", 2, "f2", 0), ("occurrence", 1, "f1", 1), ("occurrence", 1, "f1", 2), ("occurrence", 2, "f2", 0), ("signal", 1, "f1", 0), ("signal", 3, "k1", 0), ("signal", 3, "k1", 1)]
    assert got == sorted(want, key=str)
    flat = {(r.child_table, r.report_id, r.finding_id, r.child_pos): r for r in nested.flat_tables(df).collect()}
    assert flat["occurrence", 1, "f1", 1].commit_sha == "c" and flat["occurrence", 2, "f2", 0].variant == "occurrence" and flat["timeline", 2, "f2", 0].variant == "text of timeline"
    assert flat["finding", 1, "f1", 0].redacted == "x...y" and flat["timeline", 2, "f2", 0].earliest_commit == "c"
    assert nested.flat_tables(df.limit(0)).count() == 0


def nested_rows(body, rid=1):
    return list(nested.rows_of(rid, body))


def test_deep_and_long_reports():
    deep = '{"schemaVersion": "1", "findings": [{"id": "x", "redacted": "r", "timeline": ' + '{"a":' * 600 + "1" + "}" * 600 + "}]}"
    assert [(r["child_table"], len(r["variant"]) < 60) for r in nested_rows(deep)] == [("report", True), ("finding", True), ("timeline", True)]
    assert [r["child_table"] for r in nested_rows('{"a":' * 100_000)] == ["unreadable"] and nested.report_of("[" * 100_000)[0] is None
    many = json.dumps({"schemaVersion": "1", "findings": [{"id": "x", "occurrences": [{"commitSha": "c", "path": "p"}] * 50_000}]})
    assert sum(1 for _ in nested_rows(many)) == 50_002
    # A sibling of any depth hides nothing, and is kept itself.
    pit = "[" * 200_000 + "]" * 200_000
    got = nested_rows('{"schemaVersion":"1","deep":' + pit + ',"findings":[{"id":"a"}]}')
    assert [r["child_table"] for r in got] == ["report", "finding"] and pit in got[0]["rest"]
    assert nested.dumps(nested.loads(pit)) == pit


@pytest.mark.parametrize("text", ["{}", "[]", ' { "a" : [ 1 , -2.5e3 , "x\\n" , true , null , { } , [ ] ] , "a" : { "b" : [ [ ] ] } } ', '"t"', "0"])
def test_reader_of_deep_json(text):
    assert nested._deep_loads(text.strip()) == json.loads(text)


@pytest.mark.parametrize("text", ["", "{", "[1", "[1,]", '{"a"}', '{"a":}', "{1:2}", "[1 2]", "1 2", "tru", "]", '{"a":1,}'])
def test_reader_refuses(text):
    with pytest.raises(ValueError):
        nested._deep_loads(text)


def test_nothing_vanishes():
    wrap = lambda f: json.dumps({"meta": {"host": "h"}, "payload": {"schemaVersion": "1", "findings": f, "coverageGaps": [1]}})
    f = {"id": "a", "confidenceScore": 85.0, "lineNumber": "12", "byteOffset": "12x", "isBinary": "true", "blobId": 7, "novel": {"x": [1]}}
    report, envelope, row = nested_rows(wrap([[[f]]]))
    assert (row["confidence_score"], row["line_number"], row.get("byte_offset"), row["is_binary"], row["blob_id"]) == (85, 12, None, True, "7")
    assert json.loads(row["rest"]) == {"confidencescore": 85.0, "linenumber": "12", "byteoffset": "12x", "isbinary": "true", "novel": {"x": [1]}}
    assert json.loads(report["rest"]) == {"schemaversion": "1", "coveragegaps": [1]} and json.loads(envelope["rest"]) == {"meta": {"host": "h"}, "payload": None}
    o = lambda v, name="occurrences": [(r["child_table"], r["child_pos"], r["place"], r.get("commit_sha"), r["rest"]) for r in nested_rows(json.dumps({"schemaVersion": "1", "findings": [{"id": "a", name: v}]})) if r["child_table"] not in ("report", "finding")]
    assert o({"0": {"commitSha": "p"}, "4": {"commitSha": "q"}}) == [("occurrence", 0, "0", "p", None), ("occurrence", 4, "4", "q", None)]  # a map of places
    assert o([[{"commitSha": "p"}, {"commitSha": "q"}], None, {"commitSha": "r"}]) == [("occurrence", 0, "0.0", "p", None), ("occurrence", 0, "0.1", "q", None), ("occurrence", 2, "2", "r", None)]
    assert o(["plain", 5]) == [("occurrence", 0, "0", None, '"plain"'), ("occurrence", 1, "1", None, "5")] and o("") == [] == o(" ") == o([]) == o(None)
    assert o([{"commitTimestamp": 1.7e9}])[0][4] == '{"committimestamp": 1700000000.0}'
    assert [x[:3] for x in o([{"evidenceNote": "n"}, {"evidenceNote": "m"}], "timeline")] == [("timeline", 0, "0"), ("timeline", 1, "1")]
    assert [x[0] for x in o([{"commitSha": "p"}], "seenBefore")] == ["occurrence"]  # told by its state, under a name of its own
    assert o("seen in passing", "timeline") == [("timeline", 0, "0", None, '"seen in passing"')]
    assert [r["finding_id"] for r in nested_rows(wrap({"k": [{"id": "x"}, {"redacted": "r"}], "m": json.dumps(json.dumps({"redacted": "r"}))}))[2:]] == ["x", "k", "m"]


def test_variants(spark, tmp_path):
    occ = {"commitSha": "c", "path": "p"}
    bodies = [(1, json.dumps({"schemaVersion": "1", "findings": [{"id": "a", "occurrences": [occ, occ]}, {"id": "b", "occurrences": occ}, {"id": "c", "occurrences": json.dumps([occ])}]})), (2, "{")]
    df = spark.createDataFrame(bodies, "report_id bigint, body string")
    t = nested.variant_tables(df, str(tmp_path / "v"))
    got = Counter((r.child_table, r.variant) for r in t.collect())
    assert got == {("report", "report"): 1, ("finding", "finding"): 3, ("occurrence", "list of occurrence"): 2, ("occurrence", "occurrence"): 1, ("occurrence", "text of list of occurrence"): 1, ("unreadable", "unreadable"): 1}
    assert nested.typed(t, "occurrence").columns == ["report_id", "finding_id", "child_pos", "part", "place", "variant", "commit_sha", "commit_timestamp", "author", "path", "rest"]
    assert nested.typed(t, "unreadable").first().detail.startswith("no JSON") and nested.typed(t, "occurrence").count() == 4
