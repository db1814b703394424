"""Paths of trees, occurrences of blobs in commits, and their timelines."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.limits import MAX_TREE_DEPTH
from orelode.operators.graph import by_chunk, of_chunks
from orelode.operators.hierarchy import _batches, placement
from orelode.session import materialize

#: Sentences of the report (fixed values).
NOTE_ACTIVE = "Secret remains active and reachable from current HEAD."
NOTE_GONE = "Evidence indicates secret is no longer present in current HEAD; historical commit reference preserved."

_ROWS = "kind string, root string, node string, path binary, depth int, line array<string>, chunk int"


def _expand(batches: Iterator[pa.RecordBatch], max_depth: int) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, order, root, node, path, depth, line, child, name, to, leaf) sorted by chunk and order."""

    def rows():
        chunk, down = None, defaultdict(list)
        for b in batches:
            for c, order, root, node, path, depth, line, child, name, to, leaf in zip(*(b.column(i).to_pylist() for i in range(11))):
                if c != chunk:
                    chunk, down = c, defaultdict(list)
                if order == 0:
                    down[node].append((child, name, to, leaf))
                    continue
                todo = [(node, path, depth, tuple(line))]
                while todo:
                    at, prefix, d, past = todo.pop()
                    for child, name, to, leaf in down.get(at, ()):
                        full = prefix + b"/" + name if prefix else name
                        if leaf:
                            yield "blob", root, child, full, d, None, None
                        elif child in past or d + 1 > max_depth:
                            yield "deep", root, child, full, d + 1, None, None
                            continue
                        else:
                            yield "tree", root, child, full, d + 1, None, None
                        if leaf:
                            continue
                        if to is None:
                            todo.append((child, full, d + 1, (*past, child)))
                        else:
                            yield "cross", root, child, full, d + 1, [*past, child], to

    yield from _batches(rows(), ["kind", "root", "node", "path", "depth", "line", "chunk"], [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int32(), pa.list_(pa.string()), pa.int32()])


def expand_trees(roots: DataFrame, entries: DataFrame, max_depth: int = MAX_TREE_DEPTH) -> DataFrame:
    """``(kind, root, node, path, depth)``: blobs and trees under each root, and where expansion stopped (``deep``).

    ``roots(node)`` distinct; ``entries(node, child, name, mode, part, pos)``.
    Only the standard modes are followed; names are joined as they are.  A tree
    at two paths gives both.  Expansion stops where a tree contains itself, or
    beyond ``max_depth``.
    """
    nodes = entries.groupBy("node").agg(F.min("part").alias("part"), F.min("pos").alias("pos"))
    placed = placement(nodes, entries.where("mode = '40000' and child is not null").select(F.col("node").alias("parent"), "child").distinct(), "paths")
    leaf = F.col("mode").isin("100644", "100755", "120000")
    use = entries.where("child is not null").where(leaf | (F.col("mode") == "40000")).select("node", "child", "name", leaf.alias("leaf")).distinct()
    links = use.join(placed, "node").join(placed.select(F.col("node").alias("child"), F.col("chunk").alias("other")), "child", "left")
    links = links.where("leaf or other is not null").select("chunk", "node", "child", "name", F.when(~F.col("leaf") & (F.col("other") != F.col("chunk")), F.col("other")).alias("to"), "leaf")
    links = materialize(by_chunk(links), "paths-links")
    none = lambda t: F.lit(None).cast(t)
    front = roots.join(placed, "node")
    front = front.select(F.col("node").alias("root"), "node", F.lit(b"").alias("path"), F.lit(0).alias("depth"), F.array("node").alias("line"), "chunk")
    front = materialize(front, "paths-front")
    found = []
    while True:
        edges = links.select("chunk", F.lit(0).alias("order"), none("string").alias("root"), "node", none("binary").alias("path"), none("int").alias("depth"), none("array<string>").alias("line"), "child", "name", "to", "leaf")
        states = front.select("chunk", F.lit(1).alias("order"), "root", "node", "path", "depth", "line", none("string").alias("child"), none("binary").alias("name"), none("int").alias("to"), none("boolean").alias("leaf"))
        out = of_chunks(edges, front).unionByName(states).repartition("chunk").sortWithinPartitions("chunk", "order")
        out = materialize(out.mapInArrow(lambda it: _expand(it, max_depth), _ROWS), "paths-round")
        found.append(out.where("kind <> 'cross'").select("kind", "root", "node", "path", "depth"))
        front = out.where("kind = 'cross'").select("root", "node", "path", "depth", "line", "chunk")
        if front.isEmpty():
            break
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every


def tree_paths(roots: DataFrame, entries: DataFrame, max_depth: int = MAX_TREE_DEPTH) -> tuple[DataFrame, DataFrame]:
    """``(root, path, blob)`` of each root tree, and ``(root, node, path)`` where expansion stopped."""
    every = expand_trees(roots, entries, max_depth)
    return every.where("kind = 'blob'").select("root", "path", F.col("node").alias("blob")), every.where("kind = 'deep'").select("root", "node", "path")


def text(column: str) -> Column:
    """Bytes as text; what is no UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(F.col(column).cast("string"))


def epoch_date(seconds: Column) -> Column:
    """RFC 3339 in UTC; empty for 0; null where no calendar date exists."""
    return F.when(seconds == 0, F.lit("")).when(seconds <= 253402300799, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def person(raw: Column) -> Column:
    """``name <mail>`` of ``name <mail> seconds zone``."""
    return F.regexp_extract(raw, r"^(.*<.*>)\s+\d+\s+[+-]\d{4}\s*$", 1)


def occurrences(paths: DataFrame, commits: DataFrame) -> DataFrame:
    """``(blob_id, commit_sha, commit_timestamp, commit_date, author, path)`` of all commits.

    ``paths(root, path, blob)`` are expanded once per root tree and joined to
    its commits; ``commits(commit_sha, tree, author, timestamp)`` distinct.
    Paths stay bytes.
    """
    return paths.join(commits, paths.root == commits.tree).select(
        F.col("blob").alias("blob_id"), "commit_sha", F.col("timestamp").alias("commit_timestamp"), epoch_date(F.col("timestamp")).alias("commit_date"), "author", "path"
    )


def timelines(occurrences: DataFrame, states: DataFrame) -> DataFrame:
    """First and last sight of each blob; what is ACTIVE has no removal.

    Minimum and maximum combine on the map side, so a blob with a third of all
    occurrences costs no more than any other.
    """
    row = F.struct("commit_timestamp", "commit_sha", "path", "commit_date", "author")
    ends = occurrences.where("blob_id is not null").groupBy(F.col("blob_id").alias("oid")).agg(F.min(row).alias("a"), F.max(row).alias("z"), F.count(F.lit(1)).alias("n_occurrences"))
    gone = F.col("exposure_state") != "ACTIVE"
    return states.join(ends, "oid").select(
        "oid", "exposure_state", "n_occurrences",
        F.col("a.commit_sha").alias("earliest_commit"), F.col("a.commit_date").alias("earliest_date"), F.col("a.author").alias("earliest_author"),
        F.when(gone, F.col("z.commit_sha")).alias("removal_commit"), F.when(gone, F.col("z.commit_date")).alias("removal_date"),
        F.when(gone, NOTE_GONE).otherwise(NOTE_ACTIVE).alias("evidence_note"),
    )
