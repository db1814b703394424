"""Detection of secret-shaped bytes, and their scores.

One Arrow pass over the payloads finds candidates with everything that needs
the bytes (place, line, entropy, surroundings); scoring, tiers, names and
redaction are built-in expressions downstream.  The raw candidate leaves the
pass only as fingerprint and redacted text.

Patterns are data: pass a list of :class:`Pattern` of your own.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.limits import BINARY_SNIFF_BYTES, CONTEXT_BYTES, MAX_BLOB_SCANNED


@dataclass(frozen=True)
class Pattern:
    name: str
    category: str
    regex: str
    base: int
    is_private_key: bool = False


#: The shipped patterns (fixed values).
PATTERNS = (
    Pattern("AWS Access Key", "aws", r"(A3T[A-Z0-9]|AKIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{16}", 45),
    Pattern("GitHub Token", "github", r"gh[pousr]_[A-Za-z0-9_]{36,255}", 45),
    Pattern("Slack Token", "slack", r"xox[baprs]-[0-9]{10,13}-[0-9]{10,13}[a-zA-Z0-9-]*", 40),
    Pattern("Private Key", "crypto", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", 45, True),
)
#: Words that make a secret likelier nearby (fixed values).
CONTEXT_WORDS = ("api_key", "secret", "token", "password", "authorization", "private_key")
_CONTEXT = re.compile(rb"(?i)(?:^|[^a-zA-Z0-9])(" + "|".join(CONTEXT_WORDS).encode() + rb")(?:$|[^a-zA-Z0-9])")
#: Base names, components and suffixes of paths (fixed values).
SENSITIVE_NAMES = (".env", ".env.local", ".env.production", ".env.development", "credentials", "credentials.json", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "secrets.json", "secrets.yaml", "secrets.yml")
TEST_PARTS = ("test", "tests", "testdata", "fixture", "fixtures", "example", "examples", "spec", "specs", "mock", "mocks")
TEST_SUFFIXES = ("_test.go", ".test.js", ".spec.ts")

CANDIDATES = (
    "blob_id string, pattern_name string, category string, is_private_key boolean, byte_offset int, line_number int, length int, fingerprint string, redacted string, "
    "base_score int, entropy double, context_score int, keywords array<string>, is_binary boolean"
)
_SCHEMA = pa.schema([
    ("blob_id", pa.string()), ("pattern_name", pa.string()), ("category", pa.string()), ("is_private_key", pa.bool_()), ("byte_offset", pa.int32()), ("line_number", pa.int32()), ("length", pa.int32()), ("fingerprint", pa.string()), ("redacted", pa.string()),
    ("base_score", pa.int32()), ("entropy", pa.float64()), ("context_score", pa.int32()), ("keywords", pa.list_(pa.string())), ("is_binary", pa.bool_()),
])


def shannon(data: bytes) -> float:
    """Bits per byte."""
    n = len(data)
    return -sum(c / n * math.log2(c / n) for _, c in sorted(Counter(data).items())) + 0.0 if n else 0.0


def redact(secret: bytes, private_key: bool = False) -> str:
    text = secret.decode("latin-1")
    if private_key or "PRIVATE KEY" in text:
        return "[REDACTED PRIVATE KEY]"
    return "..." if len(text) <= 8 else f"{text[:4]}...{text[-4:]}"


def is_binary(payload: bytes) -> bool:
    return b"\0" in payload[:BINARY_SNIFF_BYTES]


def keywords_near(payload: bytes, start: int, end: int, reach: int = CONTEXT_BYTES) -> list[str]:
    window = payload[max(0, start - reach) : end + reach]
    return list(dict.fromkeys(m.decode().lower() for m in _CONTEXT.findall(window)))


def scan_blob(payload: bytes, patterns: tuple[Pattern, ...] = PATTERNS, most: int = MAX_BLOB_SCANNED) -> Iterator[tuple]:
    """All matches, pattern by pattern; nothing for payloads beyond the ceiling."""
    if not payload or len(payload) > most:
        return
    binary = is_binary(payload)
    line, counted = 1, 0
    for p, regex in zip(patterns, _compiled(patterns)):
        line, counted = 1, 0
        for m in regex.finditer(payload):
            a, z = m.span()
            if not binary:  # lines are counted on from the match before
                line += payload.count(b"\n", counted, a)
                counted = a
            found = m.group(0)
            words = keywords_near(payload, a, z)
            yield (p.name, p.category, p.is_private_key, a, line, len(found), hashlib.sha256(found).hexdigest(), redact(found, p.is_private_key), p.base, shannon(found), 20 if words else 0, words, binary)


_CACHE: dict = {}


def _compiled(patterns: tuple[Pattern, ...]) -> list[re.Pattern]:
    if patterns not in _CACHE:
        _CACHE[patterns] = [re.compile(p.regex.encode()) for p in patterns]
    return _CACHE[patterns]


def _scan(batches: Iterable[pa.RecordBatch], patterns: tuple[Pattern, ...], most: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(key, *f) for key, payload in zip(b.column(0).to_pylist(), b.column(1)) for f in scan_blob(payload.as_py() or b"", patterns, most)]
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def candidates(blobs: DataFrame, patterns: tuple[Pattern, ...] = PATTERNS, most: int = MAX_BLOB_SCANNED) -> DataFrame:
    """Candidates in ``blobs(blob_id, payload)``; oversize payloads are passed over before they are sent to Python."""
    fit = blobs.select(F.col("blob_id").cast("string").alias("blob_id"), F.col("payload").cast("binary").alias("payload")).where(F.octet_length("payload") <= most)
    return fit.mapInArrow(lambda it: _scan(it, patterns, most), CANDIDATES)


def latin1(payload: Column) -> Column:
    """A text with one character per byte."""
    return F.decode(payload.cast("binary"), "ISO-8859-1")


def candidates_sql(blobs: DataFrame, patterns: tuple[Pattern, ...] = PATTERNS) -> DataFrame:
    """Place and line of candidates by built-in expressions alone: the cross-check of :func:`candidates`."""
    t = blobs.where(F.octet_length("payload") <= MAX_BLOB_SCANNED).select(F.col("blob_id").cast("string").alias("blob_id"), latin1(F.col("payload")).alias("t"))
    out = None
    for p in patterns:
        one = t.where(F.col("t").rlike(p.regex)).select(
            "blob_id", "t", F.regexp_extract_all("t", F.lit(f"({p.regex})"), F.lit(1)).alias("ms"), F.split("t", p.regex, -1).alias("sg")
        )
        one = one.select("blob_id", "t", "ms", "sg", F.posexplode("ms").alias("k", "v"))
        start = F.aggregate(F.slice("sg", 1, F.col("k") + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice("ms", 1, F.col("k")), F.lit(0), lambda a, x: a + F.length(x))
        one = one.select("blob_id", F.lit(p.name).alias("pattern_name"), start.alias("byte_offset"), F.col("v"), "t")
        pre = F.expr("substr(t, 1, byte_offset)")
        binary = F.instr(F.substring("t", 1, BINARY_SNIFF_BYTES), "\0") > 0
        line = F.when(binary, F.lit(1)).otherwise(1 + F.length(pre) - F.length(F.replace(pre, F.lit("\n"), F.lit(""))))
        one = one.select("blob_id", "pattern_name", "byte_offset", line.cast("int").alias("line_number"), F.sha2(F.encode("v", "ISO-8859-1"), 256).alias("fingerprint"))
        out = one if out is None else out.unionByName(one)
    return out


# ------------------------------------------------------------ expressions


def entropy_score(e: Column) -> Column:
    e = F.round(e, 9)
    return F.when(e >= 4.5, 25).when(e >= 3.8, 18).when(e >= 3.0, 10).otherwise(0)


def _base_name(path: Column) -> Column:
    bare = F.regexp_replace(F.lower(path), "/+$", "")
    return F.element_at(F.split(bare, "/"), -1)


def is_sensitive_path(path: Column) -> Column:
    b = _base_name(path)
    return b.isin(*SENSITIVE_NAMES) | b.startswith(".env.") | b.endswith(".pem") | b.endswith(".key")


def is_test_path(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    named = F.arrays_overlap(parts, F.array(*map(F.lit, TEST_PARTS)))
    ends = F.exists(parts, lambda p: p.endswith(TEST_SUFFIXES[0]) | p.endswith(TEST_SUFFIXES[1]) | p.endswith(TEST_SUFFIXES[2]))
    return named | ends


def path_score(path: Column) -> Column:
    """+10 for a sensitive name, -30 for a test component, added up."""
    return F.when(is_sensitive_path(path), 10).otherwise(0) + F.when(is_test_path(path), -30).otherwise(0)


def path_score_of_all(path: Column) -> Column:
    """Over all of a blob's paths: +10 if any is sensitive, else -30 if all are tests, else 0."""
    return F.when(F.bool_or(F.coalesce(is_sensitive_path(path), F.lit(False))), 10).when(F.bool_and(F.coalesce(is_test_path(path), F.lit(False))), -30).otherwise(0)


def confidence(*scores: Column) -> Column:
    total = scores[0]
    for s in scores[1:]:
        total = total + s
    return F.least(F.greatest(total, F.lit(0)), F.lit(100)).cast("int")


TIERS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def tier(score: Column) -> Column:
    return F.when(score >= 90, "CRITICAL").when(score >= 70, "HIGH").when(score >= 40, "MEDIUM").otherwise("LOW")


def tier_rank(name: Column) -> Column:
    out = F.when(name == TIERS[0], 1)
    for i, t in enumerate(TIERS[1:], 2):
        out = out.when(name == t, i)
    return out.otherwise(0)


def parse_tier(text: str) -> str:
    """All lower or all upper case."""
    if text.upper() in TIERS and text in (text.upper(), text.lower()):
        return text.upper()
    raise ValueError(f"invalid confidence tier: {text}")


def finding_digest(blob: Column, offset: Column, pattern: Column) -> Column:
    z = F.unhex(F.lit("00"))
    return F.sha2(F.concat(blob.cast("binary"), z, offset.cast("string").cast("binary"), z, pattern.cast("binary")), 256)


def evidence(base: Column, pattern: Column, category: Column, entropy: Column, e_score: Column, c_score: Column, words: Column, p_score: Column) -> Column:
    """The signals that count, in order."""
    def signal(rule: str, score: Column, detail: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), score.cast("int").alias("score"), detail.alias("detail"))

    every = F.array(
        signal("Strong Pattern Match", base, F.format_string("Matched %s (%s)", pattern, category)),
        signal("Shannon Entropy Analysis", e_score, F.format_string("Entropy: %.2f bits/byte", entropy)),
        signal("Context Keywords", c_score, F.concat(F.lit("Nearby keywords: ["), F.array_join(words, " "), F.lit("]"))),
        signal("Path Sensitivity", p_score, F.format_string("Path signal score: %+d", p_score)),
    )
    return F.filter(every, lambda s: s["score"] != 0)


def blob_flags(blobs: DataFrame) -> DataFrame:
    """Size, whether binary, whether too large to scan."""
    head = F.hex(F.substring(F.col("payload").cast("binary"), 1, BINARY_SNIFF_BYTES))
    return blobs.select(
        F.col("blob_id").cast("string").alias("blob_id"), F.octet_length("payload").cast("bigint").alias("size"), head.rlike("^(..)*?00").alias("is_binary"), (F.octet_length("payload") > MAX_BLOB_SCANNED).alias("is_oversize")
    )
