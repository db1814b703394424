"""Reports of a scan: one JSON document, text for people, and an explanation of one finding."""

from __future__ import annotations

import json
import re
import time
from typing import Any

from pyspark.sql import SparkSession

from orelode.limits import SCHEMA_VERSION, TOOL_NAME, TOOL_VERSION
from orelode.operators import detect, findings
from orelode.plans.scan import ScanResult, ordered_findings, run_scan


class MalformedFindingId(ValueError):
    pass


class FindingNotFound(LookupError):
    pass


def _finding(row) -> dict[str, Any]:
    f = row.asDict(recursive=True)
    if f["timeline"]:  # removals are left out where there is none
        f["timeline"] = {k: v for k, v in f["timeline"].items() if not (k.startswith("removal") and not v)}
    return f


def report(result: ScanResult) -> dict[str, Any]:
    """The report; only findings, gaps and anomalies reach the driver, and no raw secret."""
    by_state = {r.exposure_state: r["count"] for r in result.states.groupBy("exposure_state").count().collect()}
    by_tier = {r.confidenceTier: r["count"] for r in result.findings.groupBy("confidenceTier").count().collect()}
    shown = [_finding(r) for r in ordered_findings(result, result.min_confidence).collect()]
    repo = result.repository
    head = {"headResolved": result.head} if result.head else {}
    return {
        "schemaVersion": SCHEMA_VERSION,
        "tool": {"name": TOOL_NAME, "version": TOOL_VERSION},
        "repository": {"path": repo.worktree_root, "gitDir": repo.git_dir, "commonDir": repo.common_dir, "isBare": repo.is_bare} | head,
        "scan": {"startTime": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(result.started)), "durationMs": result.duration_ms, "minConfidence": result.min_confidence},
        "summary": {
            "totalBlobsScanned": sum(by_state.values()),
            **{f"{s.lower()}BlobsCount": by_state.get(s, 0) for s in ("ACTIVE", "HISTORICAL", "ZOMBIE")},
            "totalFindingsCount": sum(by_tier.values()),
            "displayedFindingsCount": len(shown),
            **{f"{t.lower()}FindingsCount": by_tier.get(t, 0) for t in reversed(detect.TIERS)},
        },
        "findings": shown,
        "coverageGaps": [r.asDict() for r in result.gaps.select("type", "target", "description").orderBy("target", "type", "description").collect()],
        "structuralAnomalies": [{"Type": r.type, "Location": r.location, "Description": r.description} for r in result.anomalies.orderBy("type", "location", "description").collect()],
        "fatalError": None,
    }


def fatal_report(path: str, message: str) -> dict[str, Any]:
    counts = ["totalBlobsScanned", "activeBlobsCount", "historicalBlobsCount", "zombieBlobsCount", "totalFindingsCount", "displayedFindingsCount", "criticalFindingsCount", "highFindingsCount", "mediumFindingsCount", "lowFindingsCount"]
    return {
        "schemaVersion": SCHEMA_VERSION, "tool": {"name": TOOL_NAME, "version": TOOL_VERSION}, "repository": {"path": path, "gitDir": "", "commonDir": "", "isBare": False},
        "scan": {"startTime": "", "durationMs": 0, "minConfidence": ""}, "summary": dict.fromkeys(counts, 0), "findings": [], "coverageGaps": [], "structuralAnomalies": [], "fatalError": message,
    }


def to_json(document: Any) -> str:
    """Two spaces of indent, a last newline, and what could end a script escaped."""
    text = json.dumps(document, indent=2, ensure_ascii=False)
    for c in "<>&  ":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text + "\n"


_CODES = {"bold": "\033[1m", "red": "\033[31m", "green": "\033[32m", "yellow": "\033[33m", "blue": "\033[34m", "magenta": "\033[35m", "cyan": "\033[36m", "none": ""}
_STATE = {"ACTIVE": "red", "HISTORICAL": "yellow", "ZOMBIE": "magenta"}
_TIER = {"CRITICAL": "red", "HIGH": "yellow", "MEDIUM": "blue"}


def _painter(no_color: bool):
    def paint(text: str, *styles: str) -> str:
        return text if no_color else "".join(_CODES[s] for s in styles) + text + "\033[0m"

    return paint


# The labels of both texts are fixed values.


def to_text(r: dict[str, Any], no_color: bool = False) -> str:
    paint = _painter(no_color)
    s, repo = r["summary"], r["repository"]
    out = [paint("=== Forensic Scan Report ===", "bold", "cyan"), f"Repository: {repo['path']}"]
    if repo.get("headResolved"):
        out.append(f"HEAD Commit: {repo['headResolved']}")
    out += [f"Scan Duration: {r['scan']['durationMs']} ms | Blobs Scanned: {s['totalBlobsScanned']}", "", paint("--- Summary ---", "bold")]
    out.append(f"Total Findings: {s['totalFindingsCount']} (Displayed: {s['displayedFindingsCount']})")
    out += ["  " + " ".join(f"[{t}: {s[f'{t.lower()}FindingsCount']}]" for t in reversed(detect.TIERS)), ""]
    if not r["findings"]:
        out.append(paint("No findings detected matching current filters.", "green"))
    else:
        out.append(paint("--- Findings ---", "bold"))
    for n, f in enumerate(r["findings"], 1):
        place = f"Binary data (byte offset {f['byteOffset']})" if f["isBinary"] else f"Line {f['lineNumber']} (byte offset {f['byteOffset']})"
        out += [
            f"[{n}] Finding ID: {paint(f['id'], 'bold')}",
            f"    Exposure:   {paint(f['exposureState'], _STATE.get(f['exposureState'], 'blue'), 'bold')}",
            f"    Confidence: {paint(f['confidenceTier'], _TIER.get(f['confidenceTier'], 'none'), 'bold')} ({f['confidenceScore']}/100)",
            f"    Pattern:    {f['patternName']} ({f['category']})",
            f"    Blob OID:   {f['blobId']}",
            f"    Redacted:   {paint(f['redacted'], 'bold')}",
            f"    Location:   {place}",
        ]
        if f["occurrences"]:
            out += ["    Occurrences:"] + [f"      - {o['path']} (commit {o['commitSha'][:8]}, {o['commitDate']})" for o in f["occurrences"]]
        if f["timeline"]:
            t = f["timeline"]
            out += [f"    Timeline:   {t['evidenceNote']}", f"                Earliest observed: commit {t['earliestObservedCommit'][:8]} ({t['earliestObservedDate']})"]
        out.append("")
    for title, rows in (("Coverage Gaps", [(g["type"], g["target"], g["description"]) for g in r["coverageGaps"]]), ("Structural Anomalies", [(a["Type"], a["Location"], a["Description"]) for a in r["structuralAnomalies"]])):
        if rows:
            out += [paint(f"--- {title} ---", "yellow", "bold")] + [f"  [{a}] {b}: {c}" for a, b, c in rows] + [""]
    return "\n".join(out) + "\n"


def check_id(finding_id: str) -> str:
    if len(finding_id) not in (16, 64) or not re.fullmatch(r"[0-9a-fA-F]+", finding_id):
        raise MalformedFindingId(f'malformed finding ID: expected 16 or 64 hexadecimal characters (got "{finding_id}")')
    return finding_id.lower()


def explain(spark: SparkSession, path: str, finding_id: str) -> dict[str, Any]:
    """One finding and what its state means; the scan is run anew, since nothing is kept."""
    key = check_id(finding_id)
    result = run_scan(spark, path)
    rows = ordered_findings(result).where((result.findings.id == key) | (result.findings.fullDigest == key)).limit(1).collect()
    if not rows:
        raise FindingNotFound(f'finding "{finding_id}" was not found in current repository state')
    f = _finding(rows[0])
    return {"finding": f, "recoveryExplanation": findings.EXPLANATIONS.get(f["exposureState"], findings.UNKNOWN_STATE), "repositoryPath": result.repository.worktree_root}


def explanation_text(x: dict[str, Any], no_color: bool = False) -> str:
    paint = _painter(no_color)
    f = x["finding"]
    out = [
        paint("=== Finding Explanation ===", "bold", "cyan"),
        f"Finding ID:      {paint(f['id'], 'bold')} (Full Digest: {f['fullDigest']})",
        f"Secret Category: {f['category']} ({f['patternName']})",
        f"Blob OID:        {f['blobId']}",
        f"Fingerprint:     {f['fingerprint']}",
        f"Redacted:        {paint(f['redacted'], 'bold')}",
        f"Confidence:      {paint(f['confidenceTier'], 'bold')} ({f['confidenceScore']}/100)",
        "", paint("--- Exposure & Forensics ---", "bold"), x["recoveryExplanation"], "", paint("--- Evidence Signals ---", "bold"),
        *(f"  * [{s['score']:+d}] {s['rule']}: {s['detail']}" for s in f["evidenceSignals"]), "",
    ]
    if f["occurrences"]:
        out += [paint("--- Historical Occurrences ---", "bold"), *(f"  * {o['path']} in commit {o['commitSha']} by {o['author']} on {o['commitDate']}" for o in f["occurrences"]), ""]
    if t := f["timeline"]:
        out += [paint("--- Timeline ---", "bold"), f"  {t['evidenceNote']}", f"  Earliest observed: commit {t['earliestObservedCommit']} by {t['earliestObservedAuthor']} on {t['earliestObservedDate']}"]
        if t.get("removalObservedCommit"):
            out.append(f"  Removal reference: commit {t['removalObservedCommit']} on {t['removalObservedDate']}")
        out.append("")
    return "\n".join(out) + "\n"
