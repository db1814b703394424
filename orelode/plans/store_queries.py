"""Queries of the operators on bytes: envelopes, packs and deltas, commits, trees and tags, over the object table.

Stores are files, which the tables are not; so each object is first written as
a loose file or into a pack, exactly as a store holds it, and then read by the
operator.  The last digit of an object's name tells which fault, if any, is put
into its bytes, so that SQL knows what must come out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.decode import pack
from orelode.decode.commit import parse_commit, parse_identity
from orelode.decode.envelope import encode_loose, object_name
from orelode.operators import graph
from orelode.operators.order import global_rank
from orelode.plans.scan import peel
from orelode.session import parallelism
from orelode.sources import objects as store
from orelode.sources.tables import table

# ----------------------------------------------------------- loose files


def loose_file(oid: str, kind: str, payload: bytes) -> bytes:
    """The file of an object, with the fault that its name's last digit stands for."""
    digit, n = oid[-1], len(payload)
    head = {"4": b"blobb %d\0" % n, "5": b"%s %d\0" % (kind.encode(), n + 1), "6": b"%s %d\0" % (kind.encode(), n - 1), "7": b"%s 0%d\0" % (kind.encode(), n), "8": b"%s %d" % (kind.encode(), n)}.get(digit)
    if digit == "8":
        payload = b""
    elif digit == "9":
        payload += b"!"
    raw = zlib.compress(head + payload) if head else encode_loose(kind, payload)[1]
    if digit == "0":
        return raw[:-6]
    if digit == "1":
        return raw[:-1] + bytes([raw[-1] ^ 255])
    return raw + b"xyz" if digit == "2" else b"\0\1" + raw if digit == "3" else raw


def _read_loose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ["oid", "type", "size", "computed_oid", "integrity_mismatch", "trailing_bytes", "error"], [pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string()]

    def rows():
        for b in batches:
            files = ((f"/objects/{o[:2]}/{o[2:]}", loose_file(o, k, p.as_py())) for o, k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)))
            for r in store.loose_rows(files):
                yield (r[0], r[1], r[2], r[4], r[5], r[6], r[10])

    yield from store._emit(rows(), names, types, 5_000)


def _objects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fx_object").where("oid is not null and type is not null and payload is not null").select("oid", "type", "payload")


def loose_decoding(spark: SparkSession, d: str) -> DataFrame:
    """Every stored object as a loose file, read back."""
    return _objects(spark, d).mapInArrow(_read_loose, "oid string, type string, size bigint, computed_oid string, integrity_mismatch boolean, trailing_bytes bigint, error string")


# ----------------------------------------------------------------- packs


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _copy(start: int, size: int) -> bytes:
    """A copy instruction with all its bytes given."""
    return bytes([0xFF]) + start.to_bytes(4, "little") + size.to_bytes(3, "little")


def _insert(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 127])]) + data[i : i + 127] for i in range(0, len(data), 127))


def delta(base: bytes, keep: int, target: bytes) -> bytes:
    """From ``base`` to ``target``, whose first ``keep`` bytes are those of the base."""
    copies = b"".join(_copy(i, min(65_535, keep - i)) for i in range(0, keep, 65_535))
    return _number(len(base)) + _number(len(target)) + copies + _insert(target[keep:])


KIND_NO = {v: k for k, v in pack.KINDS.items()}


def pack_of(rows: list[tuple[str, str, bytes]]) -> tuple[bytes, dict[int, str]]:
    """(a pack, offset to name) of objects, some as deltas, some at fault; bases for the deltas are put in as well."""
    entries: list[bytes] = []
    at, names = 12, {}

    def put(entry: bytes, name: str | None = None) -> int:
        nonlocal at
        start = at
        if name:
            names[start] = name
        entries.append(entry)
        at += len(entry)
        return start

    def ofs(instructions: bytes, base: int, name: str | None = None) -> int:
        return put(pack.encode_entry(pack.OFS_DELTA, instructions, pack.encode_distance(at - base)), name)

    for oid, kind, payload in rows:
        digit, n = oid[-1], len(payload)
        half = n // 2
        base = payload[:half] + b"base"
        if digit in "234567890ab"[:9] + "ab" and digit != "0":
            start = put(pack.encode_entry(KIND_NO[kind], base))
        if digit == "0":
            raw = pack.encode_entry(KIND_NO[kind], payload)
            put(bytes([raw[0] ^ 1]) + raw[1:], oid)
        elif digit == "1":
            put(pack.encode_entry(pack.REF_DELTA, delta(base, half, payload), bytes.fromhex(oid)[::-1]), oid)
        elif digit in "23":
            ofs(delta(base, half, payload), start, oid)
        elif digit == "4":
            ofs(delta(base + b"more", half, payload), ofs(delta(base, len(base), base + b"more"), start), oid)
        elif digit == "5":
            ofs(_number(len(base) + 1) + _number(n) + _insert(payload), start, oid)
        elif digit == "6":
            ofs(_number(len(base)) + _number(n + 9) + _copy(len(base), 9), start, oid)
        elif digit == "7":
            ofs(delta(base, half, payload) + b"\1x", start, oid)
        elif digit == "8":
            ofs(_number(len(base)) + _number(n + 1) + b"\0", start, oid)
        elif digit == "9":
            ofs(_number(len(base)) + _number(n + 9) + b"\11x", start, oid)
        elif digit == "a":
            ofs(_number(len(base)) + _number(1) + b"\2xx", start, oid)
        elif digit == "b":
            ofs(delta(base, half, payload), at - 1, oid)
        else:
            put(pack.encode_entry(KIND_NO[kind], payload), oid)
    return pack.encode_pack(entries), names


_PACK_ROWS = "oid string, outcome string, type string, size bigint, computed_oid string, error string"


def _read_packs(batches: Iterable[pa.RecordBatch], most: int = 256) -> Iterator[pa.RecordBatch]:
    def read(rows):
        raw, names = pack_of(rows)
        got = pack.parse_pack(raw, "p.pack")
        for oid, kind, payload, offset in got.objects:
            if offset in names:
                yield (names[offset], "object", kind, len(payload), oid, None)
        for outcome, notes in (("gap", got.gaps), ("anomaly", got.anomalies)):
            for kind, where, what in notes:
                yield (names.get(int(where.rpartition(":")[2])), outcome, None, None, None, f"{kind}: " + (what.rpartition(" ")[2] if outcome == "anomaly" else what))

    def rows():
        some: list[tuple[str, str, bytes]] = []
        for b in batches:
            for o, k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                some.append((o, k, p.as_py()))
                if len(some) == most:
                    yield from read(some)
                    some = []
        if some:
            yield from read(some)

    yield from store._emit(rows(), ["oid", "outcome", "type", "size", "computed_oid", "error"], [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()], 5_000)


def pack_decoding(spark: SparkSession, d: str) -> DataFrame:
    """Every stored object in packs of up to 256, whole or as a delta, read back."""
    return _objects(spark, d).mapInArrow(_read_packs, _PACK_ROWS)


def frames() -> Iterator[tuple[str, bytes]]:
    """Packs whose frame is sound or at fault."""
    blob = pack.encode_entry(3, b"hello")
    good = pack.encode_pack([blob, blob])
    again = lambda body: body + __import__("hashlib").sha1(body).digest()
    yield "sound", good
    yield "empty", pack.encode_pack([])
    yield "short", good[:20]
    yield "no pack", b"JUNK" + good[4:]
    yield "version 3", pack.encode_pack([blob], version=3)
    yield "checksum", good[:-1] + bytes([good[-1] ^ 1])
    yield "too few", pack.encode_pack([blob], declared=2)
    yield "trailing", again(good[:-20] + b"xx")
    yield "type 0", again(pack.encode_pack([blob, bytes([0x05]) + zlib.compress(b"hello")])[:-20])
    yield "type 5", again(pack.encode_pack([bytes([0x55]) + zlib.compress(b"hello"), blob])[:-20])
    yield "header too long", pack.encode_pack([bytes([0xB5] + [0x80] * 10 + [0])])
    yield "header cut", pack.encode_pack([blob, b"\xb5\x80"])
    yield "no zlib", pack.encode_pack([blob, bytes([0x35]) + b"nozlib"])
    yield "base before all", pack.encode_pack([pack.encode_entry(6, delta(b"hello", 5, b"hello!"), pack.encode_distance(1_000))])
    yield "base is itself", pack.encode_pack([pack.encode_entry(6, delta(b"hello", 5, b"hello!"), pack.encode_distance(0))])
    yield "distance cut", pack.encode_pack([blob, b"\x65\x80"])
    yield "oid cut", pack.encode_pack([blob, b"\x75" + b"x" * 9])
    yield "delta", pack.encode_pack([blob, pack.encode_entry(6, delta(b"hello", 5, b"hello!"), pack.encode_distance(len(blob)))])


def pack_frames(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for name, raw in frames():
        r = pack.parse_pack(raw, "p")
        said = [f"{t} {w}" for t, w, _ in r.gaps + r.anomalies]
        rows.append((name, r.version, r.declared, r.decoded, r.error, ",".join(k for _, k, _, _ in r.objects), ",".join(said)))
    return spark.createDataFrame(rows, "name string, version int, declared int, decoded int, error string, objects string, notes string")


# ------------------------------------------------- commits, trees and tags


def parsed_commits(spark: SparkSession, d: str) -> DataFrame:
    """Every commit payload, parsed."""
    c = store.parsed_commits(_objects(spark, d).distinct())
    return c.select("oid", "tree", F.array_join("parents", " ").alias("parents"), "author", "timestamp", "zone", "committer", F.size("extra_headers").alias("n_extra"), F.sha2("message", 256).alias("message_digest"), "error")


def parsed_trees(spark: SparkSession, d: str) -> DataFrame:
    """Every tree payload, parsed to its entries."""
    t = store.parsed_entries(_objects(spark, d).distinct())
    return t.select("tree_oid", "pos", "mode", F.hex("name").alias("name_hex"), "child_oid", "safety_flag", "unknown_mode", "error")


def commit_faults(spark: SparkSession, d: str) -> DataFrame:
    """What is said about commits and identities at fault."""
    t, who = "tree " + "a" * 40 + "\n", "A B <a@b> 12 +0100"
    a, c = f"author {who}\n", f"committer {who}\n"
    cases = {
        "empty": "", "no gap": t + a + c, "no tree": a + c + "\nm", "short tree": "tree abc\n" + a + c + "\nm", "second tree": t + t + a + c + "\nm", "bad parent": t + "parent xyz\n" + a + c + "\nm", "no author": t + c + "\nm", "no committer": t + a + "\nm", "two authors": t + a + a + c + "\nm",
        "no space": t + "word\n" + a + c + "\nm", "continued": t + a + c + "gpgsig one\n two\n\nm", "continued at once": " x\n" + t + a + c + "\nm", "zone": t + "author A <a@b> 12 0100\n" + c + "\nm", "time": t + "author A <a@b> -12 +0100\n" + c + "\nm", "late": t + f"author A <a@b> {1 << 63} +0100\n" + c + "\nm", "no mail": t + "author A 12 +0100\n" + c + "\nm",
    }
    rows = []
    for name, text in cases.items():
        r = parse_commit(text.encode())
        rows.append((name, r if isinstance(r, str) else "", "" if isinstance(r, str) else ";".join(f"{k}={v!r}" for k, v in r.extra_headers)))
    for name, line in {"plain": who, "spaces": "  A  B   <a@b>   12   +0100 ", "two mails": "A <x> <a@b> 1 -0730", "no name": "<a@b> 0 +0000"}.items():
        r = parse_identity(line, "Author")
        rows.append((name, r if isinstance(r, str) else "", "" if isinstance(r, str) else f"{r.name}|{r.email}|{r.timestamp}|{r.zone}"))
    return spark.createDataFrame(rows, "name string, error string, value string")


def _tags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in batches:
            for target in b.column(0).to_pylist():
                node, levels = target, int(target[-1], 16)
                for level in range(1, levels + 1):
                    payload = f"object {node}\ntype commit\ntag t{level}\n\nm".encode()
                    node = object_name("tag", payload)
                    yield target, node, payload, level == levels

    yield from store._emit(rows(), ["target", "node", "payload", "last"], [pa.string(), pa.string(), pa.binary(), pa.bool_()], 5_000)


def tag_chain(targets: DataFrame) -> DataFrame:
    """``(target, node, payload, last)``: before each target as many nested tags as its last digit says, up to 15."""
    return targets.select("target").mapInArrow(_tags, "target string, node string, payload binary, last boolean")


def peeled_tags(spark: SparkSession, d: str) -> DataFrame:
    """Every reference's target behind a chain of tags, followed through them."""
    targets = graph.ref_targets(table(spark, d, "fx_ref")).select(F.col("oid").alias("target")).distinct()
    tags = tag_chain(targets)
    kinds = graph.stored_objects(table(spark, d, "fx_object")).select("oid", "type")
    objects = kinds.unionByName(tags.select(F.col("node").alias("oid"), F.lit("tag").alias("type")))
    known = store.parsed_tags(tags.select(F.col("node").alias("oid"), F.lit("tag").alias("type"), "payload"))
    ends = tags.where("last").select("node", "target").unionByName(targets.where("target like '%0'").select(F.col("target").alias("node"), "target"))
    return peel(ends.select("node"), objects, known).join(ends.withColumnRenamed("node", "root"), "root").select("target", F.when(F.col("error").isNull(), F.col("node")).alias("node"), F.when(F.col("error").isNull(), F.col("type")).alias("type"), "error")


# ----------------------------------------------------------------- orders


def object_order(spark: SparkSession, d: str) -> DataFrame:
    """Stored objects with their place by name."""
    return global_rank(graph.stored_objects(table(spark, d, "fx_object")).select("oid"), "oid")


def occurrence_order(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences with their place in their blob's list, by time, commit and path."""
    o = table(spark, d, "fx_occurrence").where("blob_id is not null").select("blob_id", "commit_timestamp", "commit_sha", F.coalesce("path", F.lit("")).alias("path")).distinct()
    r = global_rank(o, "blob_id", "commit_timestamp", "commit_sha", "path")
    first = r.groupBy("blob_id").agg(F.min("rank").alias("first"))
    return r.join(first, "blob_id").select("blob_id", "commit_timestamp", "commit_sha", "path", (F.col("rank") - F.col("first") + 1).alias("place"))


def anomaly_order(spark: SparkSession, d: str) -> DataFrame:
    """Anomalies with their place by type, location and description."""
    from orelode.plans.forensics import anomaly_dedup

    return global_rank(anomaly_dedup(spark, d), "type", "location", "description")


def gap_order(spark: SparkSession, d: str) -> DataFrame:
    """Objects that are referred to and stored nowhere, as gaps in order of target, type and description."""
    from orelode.plans.forensics import unresolved_refs

    gaps = unresolved_refs(spark, d).select(F.lit("unresolvedPackOnly").alias("type"), F.col("oid").alias("target"), F.format_string("referenced object %s could not be resolved from storage", "oid").alias("description"))
    return global_rank(gaps, "target", "type", "description")


def pack_order(spark: SparkSession, d: str) -> DataFrame:
    """Packs by name, and the objects of each in order."""
    o = table(spark, d, "fx_object").where("storage <> 'loose' and oid is not null").select("storage", "oid").distinct()
    return global_rank(o, "storage", "oid")


QUERIES = {
    f.__name__: f
    for f in (loose_decoding, pack_decoding, pack_frames, parsed_commits, parsed_trees, commit_faults, peeled_tags, object_order, occurrence_order, anomaly_order, gap_order, pack_order)
}

# --------------------------------------------------------------------- SQL


def _values(columns: str, rows: list[tuple]) -> str:
    def lit(v):
        return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({columns})"


_OBJ = "(SELECT oid, type, payload, octet_length(payload) AS n, right(oid, 1) AS x FROM fx_object WHERE oid IS NOT NULL AND type IS NOT NULL AND payload IS NOT NULL)"
_NAME = "sha1(encode(type || ' ' || octet_length(p)) || '\\x00'::BLOB || p)"
SQL = {
    "loose_decoding": f"""
WITH o AS (SELECT *, CASE x WHEN '0' THEN 'TruncatedZlibStream' WHEN '1' THEN 'ZlibChecksumFailed' WHEN '3' THEN 'InvalidZlibStream' WHEN '4' THEN 'UnknownObjectType' WHEN '5' THEN 'TruncatedPayload'
    WHEN '6' THEN CASE WHEN n = 0 THEN 'MalformedSize' ELSE 'TrailingPayloadData' END WHEN '7' THEN 'MalformedSize' WHEN '8' THEN 'MissingHeaderTerminator' END AS error, CASE WHEN x = '9' THEN payload || '!'::BLOB ELSE payload END AS p FROM {_OBJ})
SELECT oid, CASE WHEN error IS NULL THEN type END AS type, CASE WHEN error IS NULL THEN octet_length(p) END AS size, CASE WHEN error IS NULL THEN {_NAME} END AS computed_oid,
  error IS NULL AND {_NAME} <> oid AS integrity_mismatch, CAST(CASE WHEN x = '2' THEN 3 ELSE 0 END AS BIGINT) AS trailing_bytes, error FROM o""",
    "pack_decoding": f"""
WITH o AS (SELECT *, payload AS p, CASE x WHEN '0' THEN 'PackObjectSizeMismatch' WHEN '5' THEN 'DeltaBaseSizeMismatch' WHEN '6' THEN 'DeltaCopyOutOfBounds' WHEN '7' THEN 'DeltaTrailingInstructionData' WHEN '8' THEN 'InvalidDeltaInstruction'
    WHEN '9' THEN 'TruncatedDeltaInstruction' WHEN 'a' THEN 'DeltaReconstructionSizeMismatch' WHEN 'b' THEN 'InvalidOfsDeltaOffset' END AS e FROM {_OBJ}), k AS (SELECT *, e IS NULL AND x <> '1' AS good FROM o)
SELECT oid, CASE WHEN good THEN 'object' WHEN x = '1' THEN 'gap' ELSE 'anomaly' END AS outcome, CASE WHEN good THEN type END AS type, CASE WHEN good THEN n END AS size, CASE WHEN good THEN {_NAME} END AS computed_oid,
  CASE WHEN x = '1' THEN 'unresolvedPackOnly: unsupported REF_DELTA targeting base ' || array_to_string(list_reverse(regexp_extract_all(oid, '..')), '') WHEN NOT good THEN 'CORRUPTED_PACK_ENTRY: ' || e END AS error FROM k""",
    "pack_frames": _values("name, version, declared, decoded, error, objects, notes", [
        ("sound", 2, 2, 2, None, "blob,blob", ""), ("empty", 2, 0, 0, None, "", ""), ("short", 0, 0, 0, "NotAPackFile", "", ""), ("no pack", 0, 0, 0, "NotAPackFile", "", ""), ("version 3", 3, 0, 0, "UnsupportedPackVersion", "", ""),
        ("checksum", 2, 2, 2, None, "blob,blob", "PACK_CHECKSUM_MISMATCH p"), ("too few", 2, 2, 1, None, "blob", "PACK_COUNT_MISMATCH p"), ("trailing", 2, 2, 2, None, "blob,blob", "PACK_TRUNCATED_OR_CORRUPTED p:40"),
        ("type 0", 2, 2, 1, None, "blob", "PACK_TRUNCATED_OR_CORRUPTED p:26,PACK_COUNT_MISMATCH p"), ("type 5", 2, 2, 0, None, "", "PACK_TRUNCATED_OR_CORRUPTED p:12,PACK_COUNT_MISMATCH p"), ("header too long", 2, 1, 0, None, "", "PACK_TRUNCATED_OR_CORRUPTED p:12,PACK_COUNT_MISMATCH p"),
        ("header cut", 2, 2, 1, None, "blob", "PACK_TRUNCATED_OR_CORRUPTED p:26,PACK_COUNT_MISMATCH p"), ("no zlib", 2, 2, 1, None, "blob", "PACK_TRUNCATED_OR_CORRUPTED p:26,PACK_COUNT_MISMATCH p"),
        ("base before all", 2, 1, 1, None, "", "CORRUPTED_PACK_ENTRY pack_offset:12"), ("base is itself", 2, 1, 1, None, "", "CORRUPTED_PACK_ENTRY pack_offset:12"), ("distance cut", 2, 2, 2, None, "blob", "PACK_TRUNCATED_OR_CORRUPTED p:26,CORRUPTED_PACK_ENTRY pack_offset:26"),
        ("oid cut", 2, 2, 1, None, "blob", "PACK_TRUNCATED_OR_CORRUPTED p:26,PACK_COUNT_MISMATCH p"), ("delta", 2, 2, 2, None, "blob,blob", ""),
    ]),
    "parsed_commits": """
WITH o AS (SELECT DISTINCT oid, type, payload FROM fx_object WHERE type = 'commit' AND oid IS NOT NULL AND payload IS NOT NULL), t AS (SELECT oid, decode(payload) AS t FROM o), h AS (SELECT oid, split_part(t, chr(10) || chr(10), 1) AS h, substr(t, strpos(t, chr(10) || chr(10)) + 2) AS m FROM t)
SELECT oid, regexp_extract(h, '^tree ([0-9a-f]{40})', 1) AS tree, array_to_string(regexp_extract_all(h, '(?m)^parent ([0-9a-f]{40})$', 1), ' ') AS parents, regexp_extract(h, '(?m)^author (.*>) \\d+ [+-]\\d{4}$', 1) AS author, CAST(regexp_extract(h, '(?m)^author .*> (\\d+) [+-]\\d{4}$', 1) AS BIGINT) AS timestamp,
  regexp_extract(h, '(?m)^author .*> \\d+ ([+-]\\d{4})$', 1) AS zone, regexp_extract(h, '(?m)^committer (.*>) \\d+ [+-]\\d{4}$', 1) AS committer, CAST(len(regexp_extract_all(h, '(?m)^[^ ]+')) - len(regexp_extract_all(h, '(?m)^(?:tree|parent|author|committer) ')) AS INTEGER) AS n_extra, sha256(m) AS message_digest, CAST(NULL AS VARCHAR) AS error FROM h""",
    "parsed_trees": """
WITH RECURSIVE t AS (SELECT DISTINCT oid, hex(payload) AS h FROM fx_object WHERE type = 'tree' AND oid IS NOT NULL AND payload IS NOT NULL),
e(oid, h, pos, entry) AS (SELECT oid, h, -1, '' FROM t UNION ALL SELECT oid, substr(h, length(x) + 1), pos + 1, x FROM (SELECT oid, h, pos, regexp_extract(h, '^(?:3[0-9])+20(?:..)*?00.{40}') AS x FROM e WHERE h <> '') WHERE x <> ''),
f AS (SELECT oid, pos, regexp_extract(entry, '^((?:3[0-9])+?)20', 1) AS m, regexp_extract(entry, '^(?:3[0-9])+20((?:..)*?)00.{40}$', 1) AS name_hex, lower(right(entry, 40)) AS child_oid FROM e WHERE pos >= 0), g AS (SELECT *, decode(unhex(m)) AS mode FROM f)
SELECT oid AS tree_oid, CAST(pos AS INTEGER) AS pos, mode, name_hex, child_oid, CASE WHEN name_hex = '' THEN 1 WHEN name_hex = '2E' THEN 2 WHEN name_hex = '2E2E' THEN 3 WHEN regexp_matches(name_hex, '^(..)*2F') THEN 4 ELSE 0 END AS safety_flag,
  mode NOT IN ('40000', '100644', '100755', '120000', '160000') AS unknown_mode, CAST(NULL AS VARCHAR) AS error FROM g""",
    "commit_faults": _values("name, error, value", [
        ("empty", "CommitMissingTree", ""), ("no gap", "CommitMissingMessageSeparator", ""), ("no tree", "CommitMissingTree", ""), ("short tree", "CommitMalformedTreeRef", ""), ("second tree", "CommitMalformedHeaderLine", ""), ("bad parent", "CommitMalformedParentRef", ""),
        ("no author", "CommitMissingAuthor", ""), ("no committer", "CommitMissingCommitter", ""), ("two authors", "CommitDuplicateAuthor", ""), ("no space", "CommitMalformedHeaderLine", ""), ("continued", "", "gpgsig='one\\ntwo'"), ("continued at once", "CommitMalformedHeaderLine", ""),
        ("zone", "CommitMalformedTimezone", ""), ("time", "CommitMalformedTimestamp", ""), ("late", "CommitMalformedTimestamp", ""), ("no mail", "CommitMalformedAuthorLine", ""),
        ("plain", "", "A B|a@b|12|+0100"), ("spaces", "", "A  B|a@b|12|+0100"), ("two mails", "", "A <x>|a@b|1|-0730"), ("no name", "", "|a@b|0|+0000"),
    ]),
}


def _late_sql() -> dict[str, str]:
    from orelode.plans import forensics

    refs = f"(SELECT DISTINCT oid AS target, right(oid, 1) AS x FROM ({forensics._REFS}))"
    return {
        "peeled_tags": f"""
SELECT target, CASE WHEN ok AND type IS NOT NULL THEN target END AS node, CASE WHEN ok THEN type END AS type, CASE WHEN NOT ok THEN 'maximum tag peel depth exceeded' WHEN type IS NULL THEN 'object not found' END AS error
FROM (SELECT target, x BETWEEN '0' AND '9' AS ok, type FROM {refs} LEFT JOIN ({forensics._STORED}) s ON s.oid = target)""",
        "object_order": f"SELECT oid, row_number() OVER (ORDER BY oid) AS rank FROM ({forensics._STORED})",
        "occurrence_order": "SELECT *, row_number() OVER (PARTITION BY blob_id ORDER BY commit_timestamp, commit_sha, path) AS place FROM (SELECT DISTINCT blob_id, commit_timestamp, commit_sha, coalesce(path, '') AS path FROM fx_occurrence WHERE blob_id IS NOT NULL)",
        "anomaly_order": f"SELECT *, row_number() OVER (ORDER BY type, location, description) AS rank FROM ({forensics.SQL['anomaly_dedup']})",
        "gap_order": f"SELECT 'unresolvedPackOnly' AS type, oid AS target, 'referenced object ' || oid || ' could not be resolved from storage' AS description, row_number() OVER (ORDER BY oid) AS rank FROM ({forensics.SQL['unresolved_refs']})",
        "pack_order": "SELECT *, row_number() OVER (ORDER BY storage, oid) AS rank FROM (SELECT DISTINCT storage, oid FROM fx_object WHERE storage <> 'loose' AND oid IS NOT NULL)",
    }


SQL |= _late_sql()
