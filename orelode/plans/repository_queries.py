"""Queries of discovery, references, reports and the command line, over small repositories made for them.

What these operators read are folders on the driver's own file system, so each
query makes a few below the shared folder and tells paths from there on.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from orelode.cli import main
from orelode.decode import pack
from orelode.decode.envelope import encode_loose
from orelode.decode.tree import encode_tree
from orelode.operators.detect import parse_tier
from orelode.plans import expected, report
from orelode.plans.scan import run_scan
from orelode.plans.store_queries import KIND_NO, _values
from orelode.session import shared_dir
from orelode.sources import repository


def _folder(spark: SparkSession) -> Path:
    where = shared_dir(spark)
    if ":" in where and not where.startswith("file:"):
        raise ValueError("these repositories lie in a folder of the file system")
    path = Path(where.removeprefix("file:").replace("//", "/"), "orelode", f"repositories-{uuid.uuid4().hex}")
    path.mkdir(parents=True)
    return path


def _bare(at: Path) -> Path:
    for d in ("objects", "refs/heads"):
        (at / d).mkdir(parents=True)
    (at / "HEAD").write_text("ref: refs/heads/main\n")
    return at


def repository_cases(spark: SparkSession, d: str) -> DataFrame:
    """Where a repository is found from, and what it is."""
    root = _folder(spark)
    _bare(root / "work/.git")
    (root / "work/a/b").mkdir(parents=True)
    _bare(root / "bare.store")
    meta = root / "work/.git/worktrees/linked"
    meta.mkdir(parents=True)
    (meta / "commondir").write_text("../..\n")
    (root / "linked").mkdir()
    (root / "linked/.git").write_text(f"gitdir: {meta}\n")
    (root / "relative").mkdir()
    (root / "relative/.git").write_text("gitdir: ../work/.git\n")
    (root / "odd").mkdir()
    (root / "odd/.git").write_text("nothing\n")
    (root / "half/objects").mkdir(parents=True)
    rows = []
    for case in ("work", "work/a/b", "bare.store", "bare.store/refs", "linked", "relative", "odd", "half", "missing"):
        try:
            r = repository.discover(str(root / case))
            rows.append((case, *(str(Path(x).relative_to(root)) for x in (r.worktree_root, r.git_dir, r.common_dir)), r.is_bare, None))
        except repository.RepositoryNotFound as e:
            rows.append((case, None, None, None, None, str(e).replace(str(root) + "/", "")))
    return spark.createDataFrame(rows, "name string, worktree string, git_dir string, common_dir string, is_bare boolean, error string")


ONE, TWO = "1" * 40, "2" * 40


def reference_cases(spark: SparkSession, d: str) -> DataFrame:
    """What references lead to: loose and packed, symbolic, malformed, in circles; HEAD in all its forms."""
    root = _folder(spark)
    git = _bare(root / "r/.git")
    (git / "packed-refs").write_text(f"# packed\n{ONE} refs/heads/main\n{ONE} refs/heads/kept\n{TWO} refs/tags/v1\n^{ONE}\nbad line\nxyz refs/heads/x\n^zz\n\n{TWO} refs/heads/crlf\r\n")
    loose = {"main": TWO, "kept": "nonsense", "alias": "ref: refs/heads/main", "far": "ref: refs/tags/v1", "ring": "ref: refs/heads/ring", "out": "ref: refs/../../etc", "gone": "ref: refs/heads/none"} | {f"chain{i}": f"ref: refs/heads/chain{i + 1}" for i in range(12)} | {"chain12": ONE}
    for name, text in loose.items():
        (git / "refs/heads" / name).write_text(text + "\n")
    repo = repository.discover(str(root / "r"))
    found = repository.all_refs(repo)
    rows = [("ref", n, o, found.origin[n]) for n, o in found.by_name.items()] + [("anomaly", where, what, kind) for kind, where, what in found.anomalies]
    for text in ("ref: refs/heads/main", "ref: refs/heads/unborn", "ref: refs/heads/kept", ONE, "", "zzz", "ref:"):
        (git / "HEAD").write_text(text)
        try:
            oid, unborn = repository.resolve_head(repo)
            rows.append(("head", text, oid, "unborn" if unborn else "born"))
        except repository.RefError as e:
            rows.append(("head", text, str(e), "error"))
    for name in ("refs/heads/main", "HEAD", "", "a\\b", "refs/a:b", "/refs/a", "refs//a", "refs/./a", "refs/../a", "heads/a"):
        try:
            repository.check_ref_name(name)
            rows.append(("name", name, "", "good"))
        except repository.RefError as e:
            rows.append(("name", name, str(e), "bad"))
    return spark.createDataFrame(rows, "kind string, name string, value string, note string")


AWS, SLACK, TOKEN = "AK" + "IA" + "0123456789ABCDEF", "xo" + "xb-" + "1234567890-1234567890-" + "AbCdEfGhIjKl", "gh" + "p_" + "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0eF3hI6"


def _store(root: Path) -> dict[str, str]:
    """A repository with a secret in every state, loose and packed, and with faults."""
    git = _bare(root / ".git")
    kept: list[tuple[str, bytes]] = []

    def put(kind: str, payload: bytes, loose: bool = True) -> str:
        oid, raw = encode_loose(kind, payload)
        if loose:
            path = git / "objects" / oid[:2] / oid[2:]
            path.parent.mkdir(exist_ok=True)
            path.write_bytes(raw)
        else:
            kept.append((kind, payload))
        return oid

    def commit(tree: str, at: int, *parents: str) -> str:
        who = f"Alice Smith <alice@example.com> {at} +0000"
        return put("commit", "".join([f"tree {tree}\n", *(f"parent {p}\n" for p in parents), f"author {who}\n", f"committer {who}\n\nmessage\n"]).encode())

    active = put("blob", f"line 1\nline 2\nconst token = '{AWS}';\n".encode())
    old = put("blob", f"export T={TOKEN}\n".encode(), loose=False)
    lost = put("blob", f"\0{SLACK}\n".encode(), loose=False)
    inner = put("tree", encode_tree([("100644", b"..", active), ("100664", b"odd", active), ("100644", b"gone", ONE), ("160000", b"sub", TWO)]), loose=False)
    first = commit(put("tree", encode_tree([("100644", b"token.txt", old)])), 1_700_000_100)
    main_ = commit(put("tree", encode_tree([("100644", b"config.env", active), ("40000", b"dir", inner)])), 1_700_000_000)
    tag = put("tag", f"object {first}\ntype commit\ntag v1\n\nm".encode())
    for name, oid in (("refs/heads/main", main_), ("refs/tags/v1", tag), ("refs/heads/lost", "3" * 40)):
        (git / name).parent.mkdir(exist_ok=True)
        (git / name).write_text(oid + "\n")
    folder = git / "objects/pack"
    folder.mkdir()
    (folder / "pack-1.pack").write_bytes(pack.encode_pack([pack.encode_entry(KIND_NO[k], p) for k, p in kept]))
    (folder / "pack-2.pack").write_bytes(b"JUNK" * 20)
    (git / "objects/ab").mkdir(exist_ok=True)
    (git / "objects/ab" / ("c" * 38)).write_bytes(b"junk")
    return {active: "<active>", old: "<old>", lost: "<lost>", first: "<first>", main_: "<main>", inner: "<inner>", str(root): "<root>"}


def _named(text: str, names: dict[str, str]) -> str:
    for long, short in names.items():
        text = text.replace(long, short).replace(long[:8], short) if len(long) == 40 else text.replace(long, short)
    return text


def scan_cases(spark: SparkSession, d: str) -> DataFrame:
    """A scan from files to report: findings in order, summary, gaps and anomalies."""
    root = _folder(spark) / "r"
    names = _store(root)
    r = run_scan(spark, str(root))
    doc = json.loads(_named(report.to_json(report.report(r)), names))
    rows = [("head", 0, doc["repository"]["headResolved"], "")] + [("summary", 0, k, str(v)) for k, v in doc["summary"].items()]
    for i, f in enumerate(doc["findings"]):
        rows.append(("finding", i, f["blobId"], "|".join(str(f[k]) for k in ("exposureState", "patternName", "category", "confidenceScore", "confidenceTier", "redacted", "lineNumber", "byteOffset", "isBinary"))))
        rows += [("occurrence", i * 10 + k, f["blobId"], f"{o['path']} {o['commitSha']} {o['commitDate']} {o['author']}") for k, o in enumerate(f["occurrences"] or [])]
        rows += [("signal", i * 10 + k, f["blobId"], f"{s['rule']} {s['score']} {s['detail']}") for k, s in enumerate(f["evidenceSignals"])]
        if f["timeline"]:
            rows.append(("timeline", i, f["blobId"], " ".join(f["timeline"].get(k, "-") for k in ("earliestObservedCommit", "earliestObservedDate", "removalObservedCommit", "removalObservedDate"))))
    rows += [("gap", i, g["type"], g["target"]) for i, g in enumerate(doc["coverageGaps"])] + [("anomaly", i, a["Type"], a["Location"]) for i, a in enumerate(doc["structuralAnomalies"])]
    return spark.createDataFrame(rows, "kind string, place int, name string, value string")


def cli_cases(spark: SparkSession, d: str) -> DataFrame:
    """Exit code and first lines of either stream, for commands right and wrong."""
    root = _folder(spark)
    names = _store(root / "r") | {str(root): "<here>"}
    (root / "none").mkdir()
    digest = hashlib.sha256(b"\0".join([next(k for k, v in names.items() if v == "<active>").encode(), b"29", b"AWS Access Key"])).hexdigest()
    repo = ["--repo", str(root / "r"), "--no-color"]
    calls = {
        "none": [], "unknown": ["what"], "version": ["version"], "help": ["-h"], "json": ["scan", f"--repo={root / 'r'}", "--json"], "critical": ["scan", *repo, "--min-confidence=CRITICAL"],
        "mixed tier": ["scan", "--min-confidence", "High"], "no tier": ["scan", "--min-confidence"], "unknown flag": ["scan", "--what"], "two paths": ["scan", "a", "b"], "no store": ["scan", str(root / "missing")], "no store json": ["scan", str(root / "missing"), "--json"],
        "explain digest": ["explain", digest.upper(), *repo], "explain none": ["explain", "0" * 16, *repo], "explain malformed": ["explain", "xyz", *repo], "explain nothing": ["explain"], "explain no store": ["explain", "0" * 16, "--repo", str(root / "missing")],
    }
    rows = []
    for name, args in calls.items():
        out, err = io.StringIO(), io.StringIO()
        code = main(args, out, err, spark)
        text = lambda x: _named(x.getvalue(), names).split("\n")[0]
        rows.append((name, code, text(out), text(err)))
    return spark.createDataFrame(rows, "name string, code int, out string, err string")


def report_lines(spark: SparkSession, d: str) -> DataFrame:
    """The texts of a report and of an explanation, line by line, and how JSON is written."""
    root = _folder(spark) / "r"
    names = _store(root)
    r = run_scan(spark, str(root))
    doc = report.report(r)
    doc["scan"]["durationMs"] = 0
    f = doc["findings"][0]
    x = {"finding": f, "recoveryExplanation": "<meaning>", "repositoryPath": str(root)}
    ids = {v["fullDigest"]: f"<digest{i}>" for i, v in enumerate(doc["findings"])} | {v["id"]: f"<id{i}>" for i, v in enumerate(doc["findings"])} | {v["fingerprint"]: f"<print{i}>" for i, v in enumerate(doc["findings"])}
    rows = []
    for kind, text in (("report", report.to_text(doc, True)), ("explanation", report.explanation_text(x, True)), ("color", report.to_text(doc).split("\n", 1)[0] + "\n"), ("json", report.to_json({"a": ["<&>", "é "], "b": [], "c": None}))):
        for a, b in ids.items():
            text = text.replace(a, b)
        rows += [(kind, i, line) for i, line in enumerate(_named(text, names).split("\n")[:-1])]
    return spark.createDataFrame(rows, "kind string, place int, line string")


def tier_names(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for text in ("low", "LOW", "Low", "medium", "HIGH", "high", "critical", "CRITICAL", "", "none"):
        try:
            rows.append((text, parse_tier(text)))
        except ValueError:
            rows.append((text, None))
    return spark.createDataFrame(rows, "name string, tier string")


QUERIES = {f.__name__: f for f in (repository_cases, reference_cases, scan_cases, cli_cases, report_lines, tier_names)}


def _rows(text: str, kinds: str) -> list[tuple]:
    """Rows of ``text``, cells apart by broken bars; ``kinds`` has s, i or b for each column."""
    read = {"s": str, "i": int, "b": lambda x: x == "true"}
    return [tuple(None if c == "~" else read[k](c) for c, k in zip(line.split(" ¦ "), kinds, strict=True)) for line in text.strip("\n").split("\n")]


SQL: dict[str, str] = {
    "repository_cases": _values("name, worktree, git_dir, common_dir, is_bare, error", _rows(expected.REPOSITORY_CASES, "ssssbs")),
    "reference_cases": _values("kind, name, value, note", _rows(expected.REFERENCE_CASES, "ssss")),
    "scan_cases": _values("kind, place, name, value", _rows(expected.SCAN_CASES, "siss")),
    "cli_cases": _values("name, code, out, err", _rows(expected.CLI_CASES, "siss")),
    "report_lines": _values("kind, place, line", _rows(expected.REPORT_LINES, "sis")),
    "tier_names": _values("name, tier", [("low", "LOW"), ("LOW", "LOW"), ("Low", None), ("medium", "MEDIUM"), ("HIGH", "HIGH"), ("high", "HIGH"), ("critical", "CRITICAL"), ("CRITICAL", "CRITICAL"), ("", None), ("none", None)]),
}
