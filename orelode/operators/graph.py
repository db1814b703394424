"""Reachability over an object graph, and the exposure of its blobs.

The graph is cut into chunks along its own chains (see
:func:`orelode.operators.hierarchy.placement`).  In each round every chunk
follows its own links as far as they go; only nodes entered from another chunk
go to the next round, if they were not entered before.  A round costs one
shuffle of the links and the entered nodes; rounds number as many as the chunk
borders a path crosses.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orelode.operators.hierarchy import _batches, placement
from orelode.session import materialize

_REACHED = "kind string, tag string, node string, chunk int"


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, order, tag, node, child, to) sorted by chunk and order: links, then entered nodes."""

    def one(down: dict, entered: dict):
        for tag, todo in entered.items():
            seen = set(todo)
            stack = list(todo)
            crossed = set()
            while stack:
                at = stack.pop()
                yield "reached", tag, at, None
                for child, to in down.get(at, ()):
                    if to is None or to >= 0:
                        if (child, to) not in crossed:
                            crossed.add((child, to))
                            yield ("leaf" if to is None else "cross"), tag, child, to
                    elif child not in seen:
                        seen.add(child)
                        stack.append(child)

    def rows():
        chunk, down, entered = None, defaultdict(list), defaultdict(list)
        for b in batches:
            for c, order, tag, node, child, to in zip(*(b.column(i).to_pylist() for i in range(6))):
                if c != chunk:
                    yield from one(down, entered)
                    chunk, down, entered = c, defaultdict(list), defaultdict(list)
                if order == 0:
                    down[node].append((child, to))
                else:
                    entered[tag].append(node)
        yield from one(down, entered)

    yield from _batches(rows(), ["kind", "tag", "node", "chunk"], [pa.string(), pa.string(), pa.string(), pa.int32()])


def by_chunk(links: DataFrame) -> DataFrame:
    """Each chunk's links together, so that a round reads those of its own chunks only."""
    return links.repartition("chunk").sortWithinPartitions("chunk")


def of_chunks(links: DataFrame, front: DataFrame, most: int = 1_000) -> DataFrame:
    """The links of the chunks in ``front``: by name, which files are skipped by, if they are few."""
    few = [r.chunk for r in front.select("chunk").distinct().limit(most + 1).collect()]
    return links.where(F.col("chunk").isin(few)) if len(few) <= most else links.join(front.select("chunk").distinct(), "chunk", "left_semi")


def closure(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, tag: str = "closure") -> DataFrame:
    """``(tag, node)`` of all that each tag's seeds reach, themselves included.

    ``nodes(node, part, pos)`` are those with edges of their own, one row each;
    ``edges(src, dst)`` may end in others, which are leaves; ``seeds(tag, node)``.
    """
    edges = materialize(edges.select(F.col("src").alias("parent"), F.col("dst").alias("child")).distinct(), f"{tag}-edges")
    placed = placement(nodes, edges, tag)
    links = edges.select(F.col("parent").alias("node"), "child").join(placed, "node")
    links = links.join(placed.select(F.col("node").alias("child"), F.col("chunk").alias("other")), "child", "left").select(
        # -1: the child lies in the same chunk; null: it has no edges of its own
        "chunk", F.lit(0).alias("order"), F.lit(None).cast("string").alias("tag"), "node", "child", F.when(F.col("other") == F.col("chunk"), -1).otherwise(F.col("other")).alias("to"),
    )
    links = materialize(by_chunk(links), f"{tag}-links")
    seeds = seeds.select("tag", "node").where("node is not null").distinct()
    seeds = materialize(seeds.join(placed, "node", "left"), f"{tag}-seeds")
    leaves = [seeds.where("chunk is null").select("tag", "node")]
    front = seeds.where("chunk is not null").select("tag", "node", "chunk")
    entered, reached = front, []
    while True:
        states = front.select("chunk", F.lit(1).alias("order"), "tag", "node", F.lit(None).cast("string").alias("child"), F.lit(None).cast("int").alias("to"))
        active = of_chunks(links, front)
        out = active.unionByName(states).repartition("chunk").sortWithinPartitions("chunk", "order").mapInArrow(_spread, _REACHED)
        out = materialize(out, f"{tag}-round")
        reached.append(out.where("kind = 'reached'").select("tag", "node"))
        leaves.append(out.where("kind = 'leaf'").select("tag", "node"))
        front = materialize(out.where("kind = 'cross'").select("tag", "node", "chunk").distinct().join(entered, ["tag", "node"], "left_anti"), f"{tag}-front")
        if front.isEmpty():
            break
        entered = entered.unionByName(front)
        if len(reached) % 8 == 0:
            entered = materialize(entered, f"{tag}-entered")
    every = leaves[0]
    for x in leaves[1:] + reached:
        every = every.unionByName(x)
    return every.distinct()


# ------------------------------------------------------------ object tables


def stored_objects(objects: DataFrame, extra: list[str] = []) -> DataFrame:
    """One row per OID present: loose copies before packs, packs by name.

    The choice is an aggregate, so no copies of one OID are gathered.
    """
    present = objects.where("deleted_at is null and oid is not null") if "deleted_at" in objects.columns else objects.where("oid is not null")
    rank = F.struct(F.when(F.col("storage") == "loose", 0).otherwise(1).alias("r"), "storage")
    pick = F.struct(rank.alias("rank"), "type", "size", *extra)
    best = present.groupBy("oid").agg(F.min(pick).alias("o"), F.count(F.lit(1)).alias("n_copies"))
    return best.select("oid", "o.type", "o.size", F.col("o.rank.storage").alias("storage"), "n_copies", *(F.col(f"o.{c}") for c in extra))


def ref_targets(refs: DataFrame) -> DataFrame:
    """``(repo_id, name, oid, origin)``: loose before packed, the latest of each; symbolic and malformed ones have none.

    A malformed loose reference leaves the packed one standing.
    """
    valid = refs.withColumn("oid", F.regexp_replace("content", r"^\s+|\s+\z", "")).where(F.col("oid").rlike(r"\A[0-9a-f]{40}\z"))
    w = Window.partitionBy("repo_id", "name").orderBy((F.col("origin") == "loose").desc(), F.col("observed_at").desc(), F.col("ref_id").desc())
    return valid.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("repo_id", "name", "oid", "origin")


def object_edges(commits: DataFrame, entries: DataFrame) -> DataFrame:
    """``(src, dst)``: commits to parents and trees, trees to all they name but links to other repositories."""
    c = commits.where("commit_sha is not null")
    a = c.select(F.col("commit_sha").alias("src"), F.explode("parents").alias("dst"))
    b = c.select("commit_sha", "tree")
    t = entries.where("not mode <=> '160000'").select("tree_oid", "child_oid")
    return a.union(b).union(t).where("src is not null and dst is not null").distinct()


def object_nodes(commits: DataFrame, entries: DataFrame) -> DataFrame:
    a = commits.where("commit_sha is not null").select(F.col("commit_sha").alias("node"), F.col("repo_id").alias("part"), F.col("loaded_at").alias("pos"))
    b = entries.where("tree_oid is not null").select("tree_oid", "repo_id", "observed_at")
    return a.union(b).groupBy("node").agg(F.min("part").alias("part"), F.min("pos").alias("pos"))


def root_set(refs: DataFrame) -> DataFrame:
    """``(tag, node)``: branches are ``head``, all references are ``all``."""
    t = ref_targets(refs)
    return t.where("name like 'refs/heads/%'").select(F.lit("head").alias("tag"), F.col("oid").alias("node")).union(t.select(F.lit("all"), "oid")).distinct()


def reachability(commits: DataFrame, entries: DataFrame, refs: DataFrame) -> DataFrame:
    """``(tag, node)`` of everything reachable; payloads never enter."""
    return closure(object_nodes(commits, entries), object_edges(commits, entries), root_set(refs), "reach")


def exposure_states(reach: DataFrame, stored: DataFrame) -> DataFrame:
    """``(oid, exposure_state)`` of every stored blob."""
    flags = reach.groupBy(F.col("node").alias("oid")).agg(F.bool_or(F.col("tag") == "head").alias("head"))
    return stored.where("type = 'blob'").select("oid").join(flags, "oid", "left").select(
        "oid", F.when(F.col("head"), "ACTIVE").when(F.col("head").isNotNull(), "HISTORICAL").otherwise("ZOMBIE").alias("exposure_state")
    )


def unresolved(reach: DataFrame, stored: DataFrame) -> DataFrame:
    """Reachable OIDs that are stored nowhere."""
    return reach.select(F.col("node").alias("oid")).distinct().join(stored.select("oid"), "oid", "left_anti")


def dangling(reach: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored objects of any type that no reference reaches."""
    return stored.select("oid", "type").join(reach.select(F.col("node").alias("oid")).distinct(), "oid", "left_anti")
