"""Objects of a repository as a DataFrame, from loose files and packs.

Files are read with ``binaryFile``, a task per group of files (loose) or per
pack, which cannot be split.  The folder is named explicitly, since names that
begin with a dot are hidden when a parent is listed.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode import schemas
from orelode.decode.commit import parse_commit, tag_target
from orelode.decode.envelope import decode_loose
from orelode.decode.pack import parse_pack
from orelode.decode.tree import parse_tree
from orelode.limits import MAX_OBJECT_BYTES, Limits
from orelode.session import materialize

_LOOSE = re.compile(r"/([0-9a-fA-F]{2})/([0-9a-fA-F]{38})$")
_OBJ = ["oid", "type", "size", "payload", "computed_oid", "integrity_mismatch", "trailing_bytes", "source", "location", "pos", "error"]
_OBJ_T = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]


def _emit(rows: Iterable[tuple], names: list[str], types: list, size: int = 200) -> Iterator[pa.RecordBatch]:
    some: list[tuple] = []
    for r in rows:
        some.append(r)
        if len(some) == size:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*some), types)], names=names)
            some = []
    if some:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*some), types)], names=names)


def _local(path: str) -> str:
    return re.sub(r"^file:/*", "/", path)


def loose_rows(files: Iterable[tuple[str, bytes]], max_size: int = MAX_OBJECT_BYTES) -> Iterator[tuple]:
    for path, raw in files:
        m = _LOOSE.search(path)
        if not m:
            continue
        oid = (m.group(1) + m.group(2)).lower()
        o = decode_loose(raw, oid, max_size)
        yield (oid, o.type, o.size, o.payload, o.computed_oid, o.integrity_mismatch, o.trailing_bytes, "loose", _local(path), 0, o.error)


def loose_objects(spark: SparkSession, objects_dir: str, max_size: int = MAX_OBJECT_BYTES) -> DataFrame:
    """A row per loose file, decoded or with its error."""
    root = Path(objects_dir)
    there = [p for p in root.iterdir() if re.fullmatch(r"[0-9a-fA-F]{2}", p.name) and p.is_dir() and any(p.iterdir())] if root.is_dir() else []
    if not there:
        return spark.createDataFrame([], schemas.OBJECTS)
    files = spark.read.format("binaryFile").load(f"{objects_dir}/[0-9a-fA-F][0-9a-fA-F]/*").select("path", "content")

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((p.as_py(), c.as_py()) for b in batches for p, c in zip(b.column(0), b.column(1)))
        yield from _emit(loose_rows(pairs, max_size), _OBJ, _OBJ_T)

    return files.mapInArrow(decode, schemas.OBJECTS)


def pack_files(objects_dir: str) -> list[str]:
    folder = Path(objects_dir, "pack")
    return sorted(str(p) for p in folder.iterdir() if p.name.lower().endswith(".pack")) if folder.is_dir() else []


_PACKED = schemas.OBJECTS + ", note_kind string, note_type string, description string"


def pack_rows(path: str, content: bytes, limits: Limits = Limits()) -> Iterator[tuple]:
    none = (None,) * 6
    found = parse_pack(content, path, limits.object_bytes, limits.delta_depth, limits.pack_bytes)
    if found.error:
        yield (*none, None, "pack", path, 0, None, "anomaly", "PACK_TRUNCATED_OR_CORRUPTED", f"failed to parse pack file: {found.error}")
        yield (*none, None, "pack", path, 0, None, "gap", "unreadablePack", f"pack file could not be parsed: {found.error}")
        return
    for oid, kind, payload, offset in found.objects:
        yield (oid, kind, len(payload), payload, oid, False, 0, "pack", path, offset, None, None, None, None)
    for kind, notes in (("gap", found.gaps), ("anomaly", found.anomalies)):
        for t, where, what in notes:
            yield (*none, None, "pack", where, 0, None, kind, t, what)


def packed_objects(spark: SparkSession, paths: list[str], limits: Limits = Limits()) -> DataFrame:
    """A row per object, gap and anomaly of all packs; oversize packs are not read."""
    fit = [p for p in paths if Path(p).stat().st_size <= limits.pack_bytes]
    notes = []
    for p in sorted(set(paths) - set(fit)):
        said = f"pack file size ({Path(p).stat().st_size} bytes) exceeds safety ceiling ({limits.pack_bytes} bytes)"
        notes += [(None,) * 7 + ("pack", p, 0, None, k, t, said) for k, t in (("gap", "packTooLarge"), ("anomaly", "PACK_TOO_LARGE"))]
    extra = spark.createDataFrame(notes, _PACKED)
    if not fit:
        return extra

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for p, c in zip(b.column(0), b.column(1)) for r in pack_rows(_local(p.as_py()), c.as_py(), limits))
        yield from _emit(rows, [*_OBJ, "note_kind", "note_type", "description"], [*_OBJ_T, pa.string(), pa.string(), pa.string()])

    files = spark.read.format("binaryFile").load(fit).select("path", "content")
    return files.mapInArrow(decode, _PACKED).unionByName(extra)


def combined(loose: DataFrame, packed: DataFrame) -> DataFrame:
    """One row per OID: a sound loose copy before packs, packs by name, the first in each.

    ``loose_file`` tells that a loose file of that name exists, sound or not.
    Only names and places are compared; the payload of the winner is fetched.
    """
    have = packed.where("note_kind is null").drop("note_kind", "note_type", "description")
    every = loose.unionByName(have)
    rank = F.struct(F.col("error").isNotNull().alias("bad"), (F.col("source") != "loose").alias("packed"), "location", "pos")
    best = every.groupBy("oid").agg(F.min(rank).alias("k"), F.bool_or(F.col("source") == "loose").alias("loose_file"))
    best = best.select("oid", F.col("k.location").alias("location"), F.col("k.pos").alias("pos"), "loose_file")
    return every.join(best, ["oid", "location", "pos"])


class ObjectStore:
    """The objects of one repository: by name, whether there, and all; loose files and packs, or loose files alone.

    ``objects`` is the unified table (:func:`combined`); every answer is a
    DataFrame, so many names are asked for at once.
    """

    def __init__(self, spark: SparkSession, objects_dir: str, packs: bool = True, limits: Limits = Limits()) -> None:
        self.loose = materialize(loose_objects(spark, objects_dir, limits.object_bytes), "loose")
        self.packed = materialize(packed_objects(spark, pack_files(objects_dir) if packs else [], limits), "packed")
        self.objects = materialize(combined(self.loose, self.packed), "objects")

    def read(self, names: DataFrame) -> DataFrame:
        """The sound objects among ``names(oid)``."""
        return self.objects.where("error is null").join(names.select("oid").distinct(), "oid", "left_semi")

    def exists(self, names: DataFrame) -> DataFrame:
        """``(oid, there)`` of ``names(oid)``: a loose file of that name counts even if it cannot be read."""
        there = self.objects.select("oid", (F.col("loose_file") | F.col("error").isNull()).alias("there"))
        return names.select("oid").distinct().join(there, "oid", "left").withColumn("there", F.coalesce("there", F.lit(False)))


# -------------------------------------------------------------- decoding


def _commit_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in batches:
            for oid, payload in zip(b.column(0).to_pylist(), b.column(1)):
                c = parse_commit(payload.as_py() or b"")
                if isinstance(c, str):
                    yield (oid, None, None, None, None, None, None, None, None, c)
                else:
                    yield (oid, c.tree, c.parents, f"{c.author.name} <{c.author.email}>", c.author.timestamp, c.author.zone, f"{c.committer.name} <{c.committer.email}>", [{"key": k, "value": v} for k, v in c.extra_headers], c.message, None)

    yield from _emit(rows(), ["oid", "tree", "parents", "author", "timestamp", "zone", "committer", "extra_headers", "message", "error"],
                     [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())])), pa.binary(), pa.string()])


def _tree_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in batches:
            for oid, payload in zip(b.column(0).to_pylist(), b.column(1)):
                t = parse_tree(payload.as_py() or b"")
                if isinstance(t, str):
                    yield (oid, None, None, None, None, None, None, t)
                else:
                    yield from ((oid, e.pos, e.mode, e.name, e.oid, e.safety_flag, e.unknown_mode, None) for e in t)

    yield from _emit(rows(), ["tree_oid", "pos", "mode", "name", "child_oid", "safety_flag", "unknown_mode", "error"], [pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string(), pa.int32(), pa.bool_(), pa.string()], 5_000)


def _tag_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = ((oid, tag_target(p.as_py() or b"")) for b in batches for oid, p in zip(b.column(0).to_pylist(), b.column(1)))
    yield from _emit(rows, ["oid", "target"], [pa.string(), pa.string()])


def parsed_commits(objects: DataFrame) -> DataFrame:
    return objects.where("type = 'commit'").select("oid", "payload").mapInArrow(_commit_rows, schemas.COMMITS)


def parsed_entries(objects: DataFrame) -> DataFrame:
    """Entries of all trees; a tree that cannot be read is one row with an error."""
    return objects.where("type = 'tree'").select("oid", "payload").mapInArrow(_tree_rows, schemas.ENTRIES)


def parsed_tags(objects: DataFrame) -> DataFrame:
    return objects.where("type = 'tag'").select("oid", "payload").mapInArrow(_tag_rows, schemas.TAGS)
