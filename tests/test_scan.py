import io
import json
import shutil

import pytest

from orelode.cli import main
from orelode.decode import pack
from orelode.plans.report import report, to_json
from orelode.plans.scan import run_scan
from orelode.sources import repository
from tests.stores import AWS, GITHUB, PEM, SLACK, Store, three_states


def scanned(spark, path, minimum="low"):
    return report(run_scan(spark, str(path), minimum))


def test_three_states(spark, tmp_path):
    _, oids = three_states(tmp_path)
    r = scanned(spark, tmp_path)
    by = {f["exposureState"]: f for f in r["findings"]}
    assert {k: by[k.upper()]["blobId"] for k in oids} == oids
    a, h, z = by["ACTIVE"], by["HISTORICAL"], by["ZOMBIE"]
    assert (a["lineNumber"], a["byteOffset"], a["redacted"]) == (3, 29, "AK" + "IA...CDEF")
    assert a["occurrences"][0]["path"] == "config.env" and a["occurrences"][0]["author"] == "Alice Smith <alice@example.com>"
    assert a["timeline"]["evidenceNote"].startswith("Secret remains active") and "removalObservedCommit" not in a["timeline"]
    assert h["timeline"]["removalObservedDate"] == "2023-11-14T22:15:00Z"
    assert z["occurrences"] is None and z["timeline"] is None and z["redacted"] == "[REDACTED PRIVATE KEY]"
    assert r["summary"]["totalBlobsScanned"] == 3 and r["summary"]["totalFindingsCount"] == 3
    assert r["coverageGaps"] == [] and r["structuralAnomalies"] == []
    assert a["confidenceScore"] == 45 + 18 + 20 and a["confidenceTier"] == "HIGH"  # 4.0 bits, "token" nearby
    text = to_json(r)
    for secret in (AWS, GITHUB, PEM):
        assert secret not in text


def test_same_secret_twice_and_display(spark, tmp_path):
    s = Store(tmp_path)
    one, two = s.blob(f"a {SLACK}\n"), s.blob(f"b {SLACK}\n")
    s.ref("refs/heads/main", s.commit(s.tree(("100644", "a.txt", one), ("100644", "b.txt", one), ("100644", "c.txt", two))))
    r = scanned(spark, tmp_path, "CRITICAL")
    assert r["summary"]["totalFindingsCount"] == 2 and r["findings"] == []
    r = scanned(spark, tmp_path)
    assert sorted(len(f["occurrences"]) for f in r["findings"]) == [1, 2]
    assert len({f["fingerprint"] for f in r["findings"]}) == 1


def test_paths_missing_and_malformed(spark, tmp_path):
    s = Store(tmp_path)
    b = s.blob(f"x {AWS}\n")
    under_bad = s.blob(f"y {GITHUB}\n")
    odd = s.tree(("100644", "..", b), ("100664", "odd", b), ("100644", "gone", "1" * 40), ("160000", "sub", "2" * 40))
    raw = s.blob(f"z {SLACK}\n")
    s.ref("refs/heads/raw", s.commit(s.put("tree", b"100644 \xff\xfe.txt\0" + bytes.fromhex(raw))))
    good = s.commit(s.tree(("40000", "dir", odd)))
    bad = s.commit(s.tree(("100644", "f", under_bad)), at="NOT_A_TIMESTAMP")
    s.ref("refs/heads/main", good)
    s.ref("refs/heads/bad", bad)
    s.ref("refs/heads/lost", "3" * 40)
    (s.git / "objects" / "ab").mkdir()
    (s.git / "objects" / "ab" / ("c" * 38)).write_bytes(b"junk")
    r = scanned(spark, tmp_path)
    by = {f["blobId"]: f for f in r["findings"]}
    assert by[b]["exposureState"] == "ACTIVE" and [o["path"] for o in by[b]["occurrences"]] == ["dir/.."]
    assert by[under_bad]["exposureState"] == "ZOMBIE" and by[under_bad]["timeline"] is None
    assert [o["path"] for o in by[raw]["occurrences"]] == ["\ufffd\ufffd.txt"]
    kinds = {a["Type"] for a in r["structuralAnomalies"]}
    assert {"UNSAFE_TREE_NAME", "UNKNOWN_TREE_MODE", "MISSING_REFERENCED_OBJECT", "MALFORMED_COMMIT", "CORRUPTED_LOOSE_OBJECT"} <= kinds
    assert {g["target"] for g in r["coverageGaps"] if g["type"] == "unresolvedPackOnly"} == {"1" * 40, "3" * 40}


def test_tree_in_itself(spark, tmp_path):
    s = Store(tmp_path)
    # A circle cannot be hashed, so the file of one tree is put under another's name.
    inner = s.tree(("40000", "loop", "a" * 40))
    path = s.git / "objects" / "aa" / ("a" * 38)
    path.parent.mkdir(exist_ok=True)
    shutil.copy(s.git / "objects" / inner[:2] / inner[2:], path)
    s.ref("refs/heads/main", s.commit("a" * 40))
    r = scanned(spark, tmp_path)
    assert [g["type"] for g in r["coverageGaps"]] == ["treeDepthLimitExceeded"]
    assert {"RECURSION_DEPTH_EXCEEDED", "LOOSE_INTEGRITY_MISMATCH"} <= {a["Type"] for a in r["structuralAnomalies"]}


def packed(s: Store, name: str, oids: list[str]) -> None:
    kinds = {v: k for k, v in pack.KINDS.items()}
    folder = s.git / "objects" / "pack"
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(pack.encode_pack([pack.encode_entry(kinds[s.kept[o][0]], s.kept[o][1]) for o in oids]))


def test_packs_and_worktree(spark, tmp_path):
    s = Store(tmp_path / "main")
    a = s.blob(f"k = {AWS}\n", write=False)
    t = s.tree(("100644", ".env", a), write=False)
    c = s.commit(t)
    z = s.blob(f"z {SLACK}\n", write=False)
    packed(s, "pack-1.pack", [a, t])
    packed(s, "pack-2.PACK", [z])
    (s.git / "objects" / "pack" / "pack-3.pack").write_bytes(b"JUNK" * 20)
    s.ref("refs/heads/main", c)
    linked = tmp_path / "linked"
    linked.mkdir()
    meta = s.git / "worktrees" / "linked"
    meta.mkdir(parents=True)
    (meta / "HEAD").write_text(c + "\n")
    (meta / "commondir").write_text("../..\n")
    (linked / ".git").write_text(f"gitdir: {meta}\n")
    for path in (tmp_path / "main", linked):
        r = scanned(spark, path)
        by = {f["blobId"]: f for f in r["findings"]}
        assert by[a]["exposureState"] == "ACTIVE" and by[z]["exposureState"] == "ZOMBIE"
        assert any(x["rule"] == "Path Sensitivity" and x["score"] == 10 for x in by[a]["evidenceSignals"])
        assert "unreadablePack" in {g["type"] for g in r["coverageGaps"]}


def test_tags(spark, tmp_path):
    s = Store(tmp_path)
    b = s.blob(f"t {AWS}\n")
    at = s.commit(s.tree(("100644", "x", b)))
    for i in range(3):
        at = s.put("tag", f"object {at}\ntype commit\ntag t{i}\n\nm".encode())
    s.ref("refs/tags/v1", at)
    for i in range(12):
        at = s.put("tag", f"object {at}\ntype tag\ntag d{i}\n\nm".encode())
    s.ref("refs/tags/deep", at)
    s.ref("refs/heads/main", s.commit(s.tree()))
    r = scanned(spark, tmp_path)
    assert r["findings"][0]["exposureState"] == "HISTORICAL"
    assert any("peel depth" in a["Description"] for a in r["structuralAnomalies"])


def test_cli(spark, tmp_path):
    three_states(tmp_path / "r")

    def run(*args):
        out, err = io.StringIO(), io.StringIO()
        return main(list(args), out, err, spark), out.getvalue(), err.getvalue()

    code, out, err = run("scan", str(tmp_path / "r"), "--json")
    doc = json.loads(out)
    assert code == 1 and err == "" and doc["schemaVersion"] == "1.0" and out.endswith("}\n")
    fid = doc["findings"][0]["id"]
    code, out, err = run("scan", f"--repo={tmp_path / 'r'}", "--no-color")
    assert code == 1 and fid in out and "\033" not in out and err.startswith("Scanning")
    code, out, _ = run("explain", fid.upper(), "--repo", str(tmp_path / "r"), "--json")
    assert code == 0 and json.loads(out)["finding"]["id"] == fid
    code, out, _ = run("explain", doc["findings"][0]["fullDigest"], "--repo", str(tmp_path / "r"), "--no-color")
    assert code == 0 and "--- Evidence Signals ---" in out
    assert run("explain", "0" * 16, "--repo", str(tmp_path / "r"))[0] == 1
    assert run("explain", "xyz")[0] == 2
    (tmp_path / "none").mkdir()
    code, out, _ = run("scan", str(tmp_path / "none" / "missing"), "--json")
    assert code == 2 and json.loads(out)["fatalError"]
    for bad in ([], ["what"], ["scan", "--min-confidence", "High"], ["scan", "--what"], ["explain"]):
        assert run(*bad)[0] == 2
    assert run("version")[0] == 0 and run("help")[0] == 0
    Store(tmp_path / "e").ref("refs/heads/main", "0" * 40) or (tmp_path / "e")
    s = Store(tmp_path / "clean")
    s.ref("refs/heads/main", s.commit(s.tree(("100644", "readme.txt", s.blob("hello\n")))))
    code, out, _ = run("scan", str(tmp_path / "clean"), "--json")
    assert code == 0 and json.loads(out)["findings"] == [] and json.loads(out)["coverageGaps"] == []


def test_refs(tmp_path):
    s = Store(tmp_path)
    one, two = "1" * 40, "2" * 40
    (s.git / "packed-refs").write_text(f"# pack-refs\n{one} refs/heads/main\n{one} refs/heads/kept\n{two} refs/tags/v1\n^{one}\nbad line\nxyz refs/heads/x\n^zz\n")
    s.ref("refs/heads/main", two)
    s.ref("refs/heads/kept", "nonsense")
    (s.git / "refs/heads/alias").write_text("ref: refs/heads/main\n")
    (s.git / "refs/heads/ring").write_text("ref: refs/heads/ring\n")
    (s.git / "refs/heads/out").write_text("ref: refs/../../etc\n")
    repo = repository.discover(str(tmp_path))
    r = repository.all_refs(repo)
    assert r.by_name == {"refs/heads/main": two, "refs/heads/kept": one, "refs/tags/v1": two, "refs/heads/alias": two}
    kinds = sorted((a[0], a[1]) for a in r.anomalies)
    assert kinds == [("MALFORMED_PACKED_REF", "packed-refs:6"), ("MALFORMED_PACKED_REF", "packed-refs:7"), ("MALFORMED_PACKED_REF", "packed-refs:8"), ("MALFORMED_REF", "refs/heads/kept"), ("MALFORMED_REF", "refs/heads/out"), ("MALFORMED_REF", "refs/heads/ring")]
    assert repository.resolve_head(repo) == (two, False)
    (s.git / "HEAD").write_text("ref: refs/heads/unborn\n")
    assert repository.resolve_head(repo) == ("", True)
    (s.git / "HEAD").write_text(one)
    assert repository.resolve_head(repo) == (one, False)
    for bad in ("", "zzz", "ref:"):
        (s.git / "HEAD").write_text(bad)
        with pytest.raises(repository.RefError):
            repository.resolve_head(repo)
    with pytest.raises(repository.RepositoryNotFound):
        repository.discover(str(tmp_path / "no" / "where"))


def test_many_repositories_and_limits(spark, tmp_path):
    from orelode.limits import Limits
    from orelode.plans.scan import run_scans
    from orelode.sources.objects import ObjectStore

    _, oids = three_states(tmp_path / "a")
    three_states(tmp_path / "b")
    tables, failed = run_scans(spark, [str(tmp_path / x) for x in ("a", "b", "missing")], limits=Limits(blob_bytes=30))
    assert list(failed) == [str(tmp_path / "missing")]
    got = sorted((r.repo_id[-6:], r.exposureState) for r in tables["findings"].collect())
    assert got == []  # all blobs are larger than that, and are gaps
    assert sorted((r.repo_id[-6:], r.type) for r in tables["gaps"].collect()) == [(f"{x}/.git", "skippedOversizeBlob") for x in ("a", "b") for _ in range(3)]
    s = ObjectStore(spark, str(tmp_path / "a/.git/objects"), packs=False)
    ask = spark.createDataFrame([(oids["active"],), ("0" * 40,)], "oid string")
    assert {r.oid: r.there for r in s.exists(ask).collect()} == {oids["active"]: True, "0" * 40: False} and [r.type for r in s.read(ask).collect()] == ["blob"]


def test_release(spark):
    from orelode import session

    kept = session._written[:]
    session._written.clear()
    try:
        t = session.materialize(spark.range(3), "gone")
        assert t.count() == 3 and session.release(spark) == 1 and session.release(spark) == 0
        with pytest.raises(Exception, match="(?i)exist|not.found"):
            t.count()
    finally:
        session._written.extend(kept)
