"""Parent-child links to full hierarchies.

Method: weighted disjoint-set forests.  Nodes are cut into chunks by range of
(repository, time), where most links stay inside a chunk.  Each chunk builds a
forest of its own links, every node holding the offset to its local root; only
local roots whose parent lies in another chunk are left, as links of a
contracted graph.  That graph is merged by the same step, pairwise at first
(pointers double) and in one task when it is known to be small.  What ends in
no root ends in a circle; circles are told on that remainder alone.  Depths and
paths then come from indexed traversal, chunk by chunk.

No task holds more than one chunk; the last merge runs in one task only after
its rows have been counted against ``FINISH_ROWS``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.session import materialize, parallelism

FINISH_ROWS = 300_000
CHUNK_NODES = 40_000


def _chunks(spark, n: int) -> int:
    return max(min(parallelism(spark), 1 + n // 2_000), -(-n // CHUNK_NODES))


# ---------------------------------------------------------------- forests


def resolve(links: dict[str, str | None]) -> Iterator[tuple[str, str, int, str | None, bool]]:
    """(node, local root, offset, the root's parent outside, in a circle) of each node.

    A node that leads to a circle has that circle's smallest node as its root
    and is told by offset -1.
    """
    root: dict[str, str] = {}
    off: dict[str, int] = {}
    ring: set[str] = set()
    for start in links:
        path, seen = [], {}
        node: str | None = start
        while node is not None and node in links and node not in root and node not in seen:
            seen[node] = len(path)
            path.append(node)
            node = links[node]
        if node is not None and node in seen:  # closes a circle
            loop = path[seen[node] :]
            ring.update(loop)
            head = min(loop)
            for x in path:
                root[x], off[x] = head, -1
            continue
        if node is not None and node in root:
            top, base = root[node], off[node]
        else:
            top, base = path.pop(), 0
            root[top], off[top] = top, 0
        for x in reversed(path):
            base = base + 1 if base >= 0 else -1
            root[x], off[x] = top, base
    for x in links:
        r = root[x]
        yield x, r, off[x], links[r] if off[x] >= 0 else None, x in ring


_LOCAL = "node string, root string, off int, ext string, ring boolean"


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links: dict[str, str | None] = {}
    for b in batches:
        links.update(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    yield from _batches(resolve(links), ["node", "root", "off", "ext", "ring"], [pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_()])


def _batches(rows, names, types, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    buffer: list = []
    for r in rows:
        buffer.append(r)
        if len(buffer) == size:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*buffer), types)], names=names)
            buffer = []
    if buffer:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*buffer), types)], names=names)


def _finish_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contracted links (node, target, weight, end) to (node, root, dist); root '' leads to a circle."""
    to: dict[str, tuple[str | None, int]] = {}
    for b in batches:
        for n, t, w in zip(*(b.column(i).to_pylist() for i in range(3))):
            to[n] = (t, w)
    done: dict[str, tuple[str, int]] = {}
    for start in to:
        path, seen, node = [], set(), start
        while node in to and node not in done and node not in seen:
            seen.add(node)
            path.append(node)
            node = to[node][0]
        if node in seen or done.get(node, ("x",))[0] == "":
            for x in path:
                done[x] = ("", -1)
            continue
        top, base = done.get(node, (node, 0))
        for x in reversed(path):
            base += to[x][1]
            done[x] = (top, base)
    yield from _batches(((n, r, d) for n, (r, d) in done.items()), ["node", "root", "dist"], [pa.string(), pa.string(), pa.int32()])


def _finish_rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links: dict[str, str | None] = {}
    for b in batches:
        links.update(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    yield from _batches(((n,) for n, *_, ring in resolve(links) if ring), ["node"], [pa.string()])


def forest(nodes: DataFrame, tag: str = "forest") -> DataFrame:
    """``(node, root, depth)`` of ``nodes(node, parent, part, pos)``, one row per node.

    ``parent`` names a node, or nothing that is a node (then the node is its own
    root); ``part`` and ``pos`` are where the node lies, for locality only.
    A node on a circle has root '' and depth -1; one that merely leads into a
    circle has root null.
    """
    spark = nodes.sparkSession
    nodes = materialize(nodes.select("node", "parent", "part", "pos"), f"{tag}-nodes")
    n = nodes.count()
    p = _chunks(spark, n)
    local = materialize(nodes.repartitionByRange(p, "part", "pos", "node").select("node", "parent").mapInArrow(_local_forest, _LOCAL), f"{tag}-local")
    # Contracted graph: local roots with a parent outside their chunk.
    open_ = local.where("node = root and off = 0 and ext is not null").select("node", "ext")
    at = local.select(F.col("node").alias("ext"), F.col("root").alias("t"), F.col("off").alias("toff"))
    joined = open_.join(at, "ext", "left")
    links = materialize(
        joined.select(
            "node",
            F.when(F.col("t").isNull(), F.lit(None)).when(F.col("toff") < 0, F.lit("")).otherwise(F.col("t")).alias("target"),
            (F.col("toff") + 1).alias("weight"),
        ).where("target is not null"),
        f"{tag}-links",
    )
    m = links.count()
    merged = _merge_links(links, m, tag)
    # A local root that is no contracted node is a root of the whole.
    tops = merged.select(F.col("node").alias("root"), F.col("root").alias("top"), "dist")
    full = local.join(tops, "root", "left").select(
        "node",
        F.when((F.col("off") < 0) | (F.col("top") == ""), F.lit(None)).otherwise(F.coalesce("top", "root")).alias("root"),
        F.when((F.col("off") < 0) | (F.col("top") == ""), F.lit(-1)).otherwise(F.col("off") + F.coalesce("dist", F.lit(0))).alias("depth"),
    )
    full = materialize(full, f"{tag}-full")
    bad = full.where("root is null").select("node")
    rest = materialize(nodes.join(bad, "node", "left_semi").select("node", "parent"), f"{tag}-rest")
    rings = _ring_nodes(rest, rest.count(), tag)
    return full.join(rings.withColumn("ring", F.lit(True)), "node", "left").select(
        "node", F.when(F.col("ring"), F.lit("")).otherwise(F.col("root")).alias("root"), "depth"
    )


def _merge_links(links: DataFrame, m: int, tag: str) -> DataFrame:
    """Follow contracted links to their ends: (node, root, dist); root '' is a circle."""
    rounds = 0
    whole = m
    while m > FINISH_ROWS and 2**rounds <= whole:
        # Pointers double; a link whose target has no link is at its end and stays.
        a, b = links.alias("a"), links.select(F.col("node").alias("mid"), F.col("target").alias("next"), F.col("weight").alias("more")).alias("b")
        step = a.join(b, F.col("a.target") == F.col("b.mid"), "left")
        links = materialize(
            step.select("node", F.coalesce("next", "target").alias("target"), (F.col("weight") + F.coalesce("more", F.lit(0))).alias("weight"), F.col("next").isNotNull().alias("moved")),
            f"{tag}-double",
        )
        m = links.where("moved").count()
        links = links.drop("moved")
        rounds += 1
        if m == 0:
            return links.select("node", F.col("target").alias("root"), F.when(F.col("target") == "", F.lit(-1)).otherwise(F.col("weight").cast("int")).alias("dist"))
    if m <= FINISH_ROWS and rounds == 0:
        done = links.select("node", "target", "weight").coalesce(1).mapInArrow(_finish_forest, "node string, root string, dist int")
        return materialize(done, f"{tag}-merged")
    # Few links still move, or all that move lie on circles (more doublings than links).
    ends = links.select(F.col("node").alias("mid")).distinct()
    moving = links.join(ends, links.target == ends.mid, "left_semi")
    fixed = links.join(ends, links.target == ends.mid, "left_anti").select("node", F.col("target").alias("root"), F.col("weight").cast("int").alias("dist"))
    if 2**rounds > whole:
        return fixed.unionByName(moving.select("node", F.lit("").alias("root"), F.lit(-1).alias("dist")))
    reach = moving.join(fixed.select(F.col("node").alias("target"), F.col("root"), F.col("dist")), "target", "left")
    direct = reach.where("root is not null").select("node", "root", (F.col("weight") + F.col("dist")).cast("int").alias("dist"))
    left = moving.join(direct.select("node"), "node", "left_anti")
    tail = materialize(left.unionByName(direct.select("node", F.col("root").alias("target"), F.col("dist").cast("int").alias("weight")).join(left.select(F.col("target").alias("node")).distinct(), "node", "left_semi")), f"{tag}-tail")
    return _merge_links(tail, tail.count(), tag).join(left.select("node"), "node", "left_semi").unionByName(fixed).unionByName(direct)


def _ring_nodes(rest: DataFrame, m: int, tag: str) -> DataFrame:
    """The nodes on circles among links that all lead to one."""
    if m <= FINISH_ROWS:
        return rest.coalesce(1).mapInArrow(_finish_rings, "node string")
    # The image of following at least m links is exactly the circles.
    step, k = rest.select("node", F.col("parent").alias("to")), 0
    while 2**k < m:
        step = materialize(step.alias("a").join(step.select(F.col("node").alias("to"), F.col("to").alias("on")), "to").select("node", F.col("on").alias("to")), f"{tag}-image")
        k += 1
    return step.select(F.col("to").alias("node")).distinct()


_SEGMENT = "node string, top string, segment array<string>, ext string"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, local root, nodes from the local root down, the root's parent outside)."""
    links: dict[str, str | None] = {}
    for b in batches:
        links.update(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))

    def rows():
        for node, root, off, ext, _ in resolve(links):
            if off < 0:
                continue
            line = [node]
            while line[-1] != root:
                line.append(links[line[-1]])
            yield node, root, line[::-1], ext

    yield from _batches(rows(), ["node", "top", "segment", "ext"], [pa.string(), pa.string(), pa.list_(pa.string()), pa.string()], 1_000)


def forest_paths(nodes: DataFrame, tag: str = "paths") -> DataFrame:
    """``(node, path)``: the nodes from the root down to each node, by indexed parent traversal.

    Each chunk walks its own parents; the paths of the few local roots whose
    parent lies elsewhere are completed chunk by chunk, then put before the
    segments.  Nodes that end in a circle have no path.
    """
    nodes = materialize(nodes.select("node", "parent", "part", "pos"), f"{tag}-nodes")
    p = _chunks(nodes.sparkSession, nodes.count())
    local = materialize(nodes.repartitionByRange(p, "part", "pos", "node").select("node", "parent").mapInArrow(_segments, _SEGMENT), f"{tag}-local")
    heads = local.where("node = top")
    inner = heads.join(local.select(F.col("node").alias("ext"), F.col("top").alias("over"), F.col("segment").alias("before")), "ext", "left")
    known_nodes = nodes.select(F.col("node").alias("ext"), F.lit(True).alias("there"))
    inner = materialize(inner.join(known_nodes, "ext", "left").select("top", "over", "before", F.coalesce("there", F.lit(False)).alias("there")), f"{tag}-inner")
    done = inner.where("not there").select("top", F.array().cast("array<string>").alias("lead"))
    whole, fresh = done, done
    while True:
        step = inner.where("over is not null").join(fresh.withColumnRenamed("top", "over"), "over").select("top", F.concat("lead", "before").alias("lead"))
        fresh = materialize(step, f"{tag}-lead")
        if fresh.isEmpty():
            break
        whole = whole.unionByName(fresh)
    return local.join(whole, "top").select("node", F.concat("lead", "segment").alias("path"))


def descendant_counts(index: DataFrame) -> DataFrame:
    """``(node, n_descendants)`` of all that neither lie on a circle nor lead into one, from :func:`descendant_index`."""
    on = index.where("circle is not null").select("root").distinct()
    return index.join(on, "root", "left_anti").select("node", (F.col("leave") - F.col("enter")).alias("n_descendants"))


# ------------------------------------------------------------ descendants


def _finish_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links: dict[str, str | None] = {}
    for b in batches:
        links.update(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    size: dict[str, int] = defaultdict(int)
    found = list(resolve(links))
    for _, head, *_ in found:
        size[head] += 1
    yield from _batches(((n, head, size[head]) for n, head, *_ in found), ["node", "head", "circle"], [pa.string(), pa.string(), pa.int32()])


def ring_heads(rings: DataFrame, tag: str) -> DataFrame:
    """``(node, head, circle)`` of ``rings(node, parent)``, the nodes on circles: its circle's smallest node and length."""
    m = rings.count()
    if m <= FINISH_ROWS:
        return materialize(rings.coalesce(1).mapInArrow(_finish_heads, "node string, head string, circle int"), f"{tag}-heads")
    # The smallest of the 2**k nodes from each on; pointers double until that is all of them.
    step, k = rings.select("node", F.col("parent").alias("to"), F.least("node", "parent").alias("head")), 0
    while 2**k < m:
        on = step.select(F.col("node").alias("to"), F.col("to").alias("on"), F.col("head").alias("other"))
        step = materialize(step.join(on, "to").select("node", F.col("on").alias("to"), F.least("head", "other").alias("head")), f"{tag}-heads")
        k += 1
    return step.select("node", "head").join(step.groupBy("head").agg(F.count(F.lit(1)).cast("int").alias("circle")), "head").select("node", "head", "circle")


def _finish_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(top, over, own) of pieces to (top, total), with all pieces that hang below."""
    over: dict[str, str | None] = {}
    total: dict[str, int] = {}
    for b in batches:
        for t, o, n in zip(*(b.column(i).to_pylist() for i in range(3))):
            over[t], total[t] = o, n
    waits: dict[str, int] = defaultdict(int)
    for o in over.values():
        if o is not None:
            waits[o] += 1
    ready = [t for t in over if not waits[t]]
    while ready:
        t = ready.pop()
        if (o := over[t]) is not None:
            total[o] += total[t]
            waits[o] -= 1
            if not waits[o]:
                ready.append(o)
    yield from _batches(total.items(), ["top", "total"], [pa.string(), pa.int64()])


def _totals(pieces: DataFrame, tag: str) -> DataFrame:
    """``(top, total)`` of ``pieces(top, over, own)``."""
    if pieces.count() <= FINISH_ROWS:
        return materialize(pieces.coalesce(1).mapInArrow(_finish_totals, "top string, total bigint"), f"{tag}-totals")
    links = materialize(pieces.where("over is not null").select(F.col("top").alias("node"), F.col("over").alias("target"), F.lit(1).alias("weight")), f"{tag}-over")
    level = _merge_links(links, links.count(), f"{tag}-level").select(F.col("node").alias("top"), F.col("dist").alias("level"))
    pieces = materialize(pieces.join(level, "top", "left").withColumn("level", F.coalesce("level", F.lit(0))), f"{tag}-levels")
    done, below = [], None
    for k in range(pieces.agg(F.max("level")).first()[0], -1, -1):  # from the lowest up
        here = pieces.where(F.col("level") == k)
        if below is not None:
            more = below.where("over is not null").groupBy(F.col("over").alias("top")).agg(F.sum("total").alias("more"))
            here = here.join(more, "top", "left").withColumn("own", F.col("own") + F.coalesce("more", F.lit(0)))
        below = materialize(here.select("top", "over", F.col("own").alias("total")), f"{tag}-total")
        done.append(below.select("top", "total"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


_INSIDE = "node string, top string, hung boolean, enter bigint, size bigint, depth int"


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Preorder within each piece: rows (top, node, parent, total); a row with a total is a piece hung below ``parent``."""
    down: dict[str, list[tuple[str, int | None]]] = defaultdict(list)
    tops: dict[str, str] = {}
    for b in batches:
        for top, node, parent, total in zip(*(b.column(i).to_pylist() for i in range(4))):
            if parent is None:
                tops[node] = top
            else:
                down[parent].append((node, total))

    def rows():
        for top in tops:
            at, line, open_ = 1, [], [(top, 0, 1, iter(sorted(down.get(top, ()))))]
            while open_:
                node, depth, enter, rest = open_[-1]
                for child, total in rest:
                    at += 1
                    if total is not None:
                        line.append((child, top, True, at, total, depth + 1))
                        at += total - 1
                    else:
                        open_.append((child, depth + 1, at, iter(sorted(down.get(child, ())))))
                        break
                else:
                    open_.pop()
                    line.append((node, top, False, enter, at - enter + 1, depth))
            yield from line

    yield from _batches(rows(), ["node", "top", "hung", "enter", "size", "depth"], [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int32()])


def descendant_index(nodes: DataFrame, tag: str = "index") -> DataFrame:
    """``(node, root, depth, enter, leave, circle)``: the descendants of every node as intervals, one row per node.

    Nodes are numbered from 1 within their root, each before those below it.
    The descendants of a node are the rows of its root with ``enter`` in
    (its own enter, its leave], at distance of the difference of depths.  A
    circle is cut above its smallest node, which is the root of all that lies on
    the circle or leads into it; ``circle`` is its length for the nodes on it,
    else null.  From such a node every node of the root is reached, itself too:
    those outside its interval at the difference of depths plus ``circle``.
    :func:`descendant_pairs` writes this out.  ``nodes`` as in :func:`forest`.

    A chunk numbers its own pieces; sizes of pieces are summed upwards and
    places downwards over the contracted links, as in :func:`forest`.
    """
    nodes = materialize(nodes.select("node", "parent", "part", "pos"), f"{tag}-nodes")
    on = forest(nodes, f"{tag}-forest").where("root = ''").select("node")
    heads = ring_heads(materialize(nodes.join(on, "node", "left_semi").select("node", "parent"), f"{tag}-on"), tag)
    cut = F.when(F.col("head") == F.col("node"), F.lit(None)).otherwise(F.col("parent"))
    nodes = materialize(nodes.join(heads, "node", "left").select("node", cut.alias("parent"), "part", "pos", "circle"), f"{tag}-cut")
    p = _chunks(nodes.sparkSession, nodes.count())
    local = materialize(nodes.repartitionByRange(p, "part", "pos", "node").select("node", "parent").mapInArrow(_local_forest, _LOCAL), f"{tag}-local")
    at = local.select(F.col("node").alias("ext"), F.col("root").alias("over"))
    pieces = local.where("node = root").select(F.col("node").alias("top"), "ext").join(at, "ext", "left")
    pieces = materialize(pieces.join(local.groupBy(F.col("root").alias("top")).agg(F.count(F.lit(1)).alias("own")), "top").select("top", "ext", "over", "own"), f"{tag}-pieces")
    hung = pieces.where("over is not null").join(_totals(pieces.select("top", "over", "own"), tag), "top")
    rows = local.join(nodes.select("node", "parent"), "node").select(
        F.col("root").alias("top"), "node", F.when(F.col("node") == F.col("root"), F.lit(None)).otherwise(F.col("parent")).alias("parent"), F.lit(None).cast("bigint").alias("total")
    )
    rows = rows.unionByName(hung.select(F.col("over").alias("top"), F.col("top").alias("node"), F.col("ext").alias("parent"), "total"))
    inside = materialize(rows.repartition(p, "top").mapInArrow(_intervals, _INSIDE), f"{tag}-inside")
    base = None
    for what, weight in (("enter", F.col("enter") - 1), ("depth", F.col("depth"))):
        links = materialize(inside.where("hung").select("node", F.col("top").alias("target"), weight.cast("int").alias("weight")), f"{tag}-{what}")
        one = _merge_links(links, links.count(), f"{tag}-{what}").select(F.col("node").alias("top"), F.col("root").alias(f"{what}_root"), F.col("dist").alias(f"{what}_base"))
        base = one if base is None else base.join(one, "top")
    enter = F.col("enter") + F.coalesce("enter_base", F.lit(0))
    out = inside.where("not hung").join(base, "top", "left").join(nodes.select("node", "circle"), "node")
    return out.select("node", F.coalesce("enter_root", "top").alias("root"), (F.col("depth") + F.coalesce("depth_base", F.lit(0))).cast("int").alias("depth"), enter.alias("enter"), (enter + F.col("size") - 1).alias("leave"), "circle")


def descendant_pairs(index: DataFrame) -> DataFrame:
    """``(node, descendant, distance)`` of what :func:`descendant_index` gave; as many rows as there are pairs."""
    b = index.select("root", F.col("node").alias("descendant"), F.col("enter").alias("at"), F.col("depth").alias("deep"))
    inside = F.col("at").between(F.col("enter") + 1, F.col("leave"))
    far = F.col("deep") - F.col("depth") + F.when(inside, F.lit(0)).otherwise(F.col("circle"))
    return index.join(b, "root").where(inside | F.col("circle").isNotNull()).select("node", "descendant", far.alias("distance"))


def placement(nodes: DataFrame, links: DataFrame, tag: str) -> DataFrame:
    """``(node, chunk)``: where each node lies, so that few paths leave a chunk.

    A node that several others link to is hung below one of them; the forest of
    these links is found as above, and nodes are cut into chunks by range of
    (the root's repository, root, depth).  A chain thus lies in one chunk, or
    crosses borders once per chunk it fills.  ``links(parent, child)``.  What
    fits one chunk is one.
    """
    nodes = materialize(nodes.select("node", "part", "pos"), f"{tag}-nodes")
    if nodes.count() <= CHUNK_NODES:
        return nodes.select("node", F.lit(0).alias("chunk"))
    above = links.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("parent"))
    hung = forest(nodes.join(above, "node", "left").select("node", "parent", "part", "pos"), f"{tag}-hung")
    of_root = nodes.select(F.col("node").alias("root"), F.col("part").alias("root_part"))
    where = hung.join(of_root, "root", "left").join(nodes.select("node", "part"), "node")
    where = where.select("node", F.coalesce("root_part", "part").alias("a"), F.coalesce("root", F.lit("")).alias("b"), F.col("depth").alias("c"))
    p = _chunks(nodes.sparkSession, nodes.count())
    return materialize(where.repartitionByRange(p, "a", "b", "c", "node").select("node", F.spark_partition_id().alias("chunk")), f"{tag}-placed")


# ------------------------------------------------- hierarchies with shared parts


def _peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop links of a partition that cannot lie on a circle, as far as one chunk tells.

    Rows (chunk, parent, child, here), chunk by chunk: all links of the chunk's
    parents; ``here`` tells that the child is a parent of the same chunk.
    """
    def one(chunk: int, links: list):
        alive: dict[str, int] = defaultdict(int)
        above = defaultdict(list)
        for a, z, here in links:
            alive[a] += 1
            if here:
                above[z].append(a)
        dead = [z for z in above if z not in alive]
        gone = set(dead)
        while dead:
            z = dead.pop()
            for a in above.get(z, ()):
                alive[a] -= 1
                if not alive[a]:
                    gone.add(a)
                    dead.append(a)
        return ((chunk, a, z, here) for a, z, here in links if a not in gone and z not in gone)

    def rows():
        now, links = None, []
        for b in batches:
            for chunk, a, z, here in zip(*(b.column(i).to_pylist() for i in range(4))):
                if chunk != now:
                    yield from one(now, links)
                    now, links = chunk, []
                links.append((a, z, here))
        yield from one(now, links)

    yield from _batches(rows(), ["chunk", "parent", "child", "here"], [pa.int32(), pa.string(), pa.string(), pa.bool_()])


def _strong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes that reach themselves, by strongly connected components."""
    out: dict[str, list[str]] = defaultdict(list)
    for b in batches:
        for a, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            out[a].append(z)
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    on: set[str] = set()
    stack: list[str] = []
    found: list[str] = []
    for start in list(out):
        if start in index:
            continue
        work = [(start, iter(out[start]))]
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        while work:
            node, it = work[-1]
            for nxt in it:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    stack.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(out.get(nxt, ()))))
                    break
                if nxt in on:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        part.append(x)
                        if x == node:
                            break
                    if len(part) > 1 or node in out.get(node, ()):
                        found += part
    yield from _batches(((n,) for n in found), ["node"], [pa.string()])


def ring_nodes_of_graph(links: DataFrame, tag: str = "graph") -> DataFrame:
    """``(node)`` of every node of ``links(chunk, parent, child, cchunk)`` that can reach itself.

    Each round peels whole chunks from the leaves up, then drops links to nodes
    that have none left.  Beyond ``FINISH_ROWS`` remaining links, components are
    told by colors instead of in a single task.
    """
    left = links.select("chunk", "parent", "child", (F.col("chunk") == F.col("cchunk")).alias("here"))
    before = -1
    while True:
        left = left.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_peel, "chunk int, parent string, child string, here boolean")
        left = materialize(left, f"{tag}-peeled")
        left = materialize(left.join(left.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select("chunk", "parent", "child", "here"), f"{tag}-left")
        now = left.count()
        if now <= FINISH_ROWS or now == before:
            break
        before = now
    pairs = left.select("parent", "child")
    if now <= FINISH_ROWS:
        return materialize(pairs.coalesce(1).mapInArrow(_strong, "node string"), f"{tag}-rings")
    return _strong_by_colors(pairs.distinct(), tag)


def _strong_by_colors(links: DataFrame, tag: str) -> DataFrame:
    """Nodes that reach themselves, from ``links(parent, child)`` of any number.

    Every node takes the smallest name among those that reach it as its color;
    what reaches the node of that name within the color is its component.  The
    components go, then what has no way in or no way out, until nothing is left.
    No more than one row per node and link is ever held.
    """
    found = materialize(links.where("parent = child").select(F.col("parent").alias("node")).distinct(), f"{tag}-loops")
    links = materialize(links.where("parent <> child"), f"{tag}-colored")
    while True:
        before = -1
        while (now := links.count()) != before:  # neither a first nor a last node lies on a circle
            before = now
            links = links.join(links.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").join(links.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
            links = materialize(links.select("parent", "child"), f"{tag}-trimmed")
        if not now:
            return found.distinct()
        nodes = links.select(F.col("parent").alias("node")).distinct()
        color = materialize(nodes.withColumn("color", F.col("node")), f"{tag}-color")
        while True:
            sent = links.join(color.withColumnRenamed("node", "parent"), "parent").groupBy(F.col("child").alias("node")).agg(F.min("color").alias("got"))
            color = materialize(color.join(sent, "node", "left").select("node", F.least("color", F.coalesce("got", "color")).alias("color"), (F.col("got") < F.col("color")).alias("new")), f"{tag}-color")
            moved = color.where("new").isEmpty()
            color = color.select("node", "color")
            if moved:
                break
        same = links.join(color.select(F.col("node").alias("parent"), "color"), "parent").join(color.select(F.col("node").alias("child"), F.col("color").alias("other")), "child").where("color = other")
        same = materialize(same.select("parent", "child"), f"{tag}-same")
        part = front = materialize(color.where("node = color").select("node"), f"{tag}-heads")
        while not front.isEmpty():
            step = same.join(front.withColumnRenamed("node", "child"), "child").select(F.col("parent").alias("node")).distinct()
            front = materialize(step.join(part, "node", "left_anti"), f"{tag}-back")
            part = materialize(part.unionByName(front), f"{tag}-part")
        sizes = part.join(color, "node").groupBy("color").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("color")
        found = materialize(found.unionByName(part.join(color, "node").join(sizes, "color", "left_semi").select("node")), f"{tag}-strong")
        links = links.join(part.withColumnRenamed("node", "parent"), "parent", "left_anti").join(part.withColumnRenamed("node", "child"), "child", "left_anti")
        links = materialize(links.select("parent", "child"), f"{tag}-left")


_STATES = "kind string, root string, node string, depth int, seen array<string>, chunk int"
_NAMES = ["kind", "root", "node", "depth", "seen", "chunk"]
_TYPES = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.int32()]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk states through the links of their chunk.

    Rows come sorted by (place, order): first a place's links, then its states;
    a place is one chunk, or one share of a chunk with many states.
    """

    def rows():
        place = None
        down: dict[str, list] = {}
        for b in batches:
            for pl, order, root, node, depth, seen, child, chunk, ring in zip(*(b.column(i).to_pylist() for i in range(9))):
                if pl != place:
                    place, down = pl, defaultdict(list)
                if order == 0:
                    down[node].append((child, chunk, ring))
                    continue
                first = (node, depth, tuple(seen))
                known, todo = {first}, [first]
                reported = set()
                while todo:
                    at, d, past = todo.pop()
                    if (at, d) not in reported:
                        reported.add((at, d))
                        yield "state", root, at, d, None, None
                    for child, cchunk, cring in down.get(at, ()):
                        if cring:
                            if child in past:
                                continue
                            then = tuple(sorted((*past, child)))
                        else:
                            then = past
                        if cchunk is None:
                            new = (child, d + 1, then)
                            if new not in known:
                                known.add(new)
                                todo.append(new)
                        else:
                            yield "cross", root, child, d + 1, list(then), cchunk

    yield from _batches(rows(), _NAMES, _TYPES)


def walk_graph(nodes: DataFrame, links: DataFrame, roots: DataFrame, tag: str = "walk", states_per_place: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """All (root, node, depth) by paths without a repeated node, and the nodes on circles.

    ``nodes(node, part, pos)``, ``links(parent, child)`` between nodes, and
    ``roots(node)``, all distinct.  A path can repeat only nodes that lie on
    circles, so a state carries just those it has passed.
    """
    placed = placement(nodes, links, tag)
    links = (
        links.join(placed.select(F.col("node").alias("parent"), "chunk"), "parent")
        .join(placed.select(F.col("node").alias("child"), F.col("chunk").alias("cchunk")), "child")
        .select("chunk", "parent", "child", "cchunk")
    )
    links = materialize(links, f"{tag}-links")
    rings = ring_nodes_of_graph(links, tag)
    marked = rings.withColumn("ring", F.lit(True))
    links = links.join(marked.withColumnRenamed("node", "child"), "child", "left").select(
        "chunk", F.col("parent").alias("node"), "child", F.when(F.col("cchunk") != F.col("chunk"), F.col("cchunk")).alias("cchunk"), F.coalesce("ring", F.lit(False)).alias("ring")
    )
    links = materialize(links, f"{tag}-marked")
    front = roots.join(placed, "node").join(marked, "node", "left").select(
        F.col("node").alias("root"), "node", F.lit(0).alias("depth"), F.when(F.col("ring"), F.array("node")).otherwise(F.array().cast("array<string>")).alias("seen"), "chunk"
    )
    front = materialize(front, f"{tag}-front")
    found, past = [], front
    while True:
        # Shares per chunk, one row per chunk that has states.
        shares = front.groupBy("chunk").agg(F.ceil(F.count(F.lit(1)) / states_per_place).cast("int").alias("shares"))
        states = front.join(shares, "chunk").select(
            F.struct("chunk", F.pmod(F.xxhash64("root"), F.col("shares")).cast("int").alias("share")).alias("place"), F.lit(1).alias("order"), "root", "node", "depth", "seen",
            F.lit(None).cast("string").alias("child"), F.lit(None).cast("int").alias("to"), F.lit(None).cast("boolean").alias("ring"),
        )
        edges = links.join(shares, "chunk").select(
            "chunk", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "node", "child", "cchunk", "ring"
        ).select(
            F.struct("chunk", "share").alias("place"), F.lit(0).alias("order"), F.lit(None).cast("string").alias("root"), "node", F.lit(None).cast("int").alias("depth"),
            F.lit(None).cast("array<string>").alias("seen"), "child", F.col("cchunk").alias("to"), "ring",
        )
        both = edges.unionByName(states).select((F.col("place.chunk").cast("bigint") * 1_000_000 + F.col("place.share")).alias("place"), "order", "root", "node", "depth", "seen", "child", "to", "ring")
        out = materialize(both.repartition("place").sortWithinPartitions("place", "order").mapInArrow(_walk, _STATES), f"{tag}-round")
        found.append(out.where("kind = 'state'").select("root", "node", "depth"))
        cross = out.where("kind = 'cross'").select("root", "node", "depth", "seen", "chunk").distinct()
        front = materialize(cross.join(past, ["root", "node", "depth", "seen"], "left_anti"), f"{tag}-front")
        if front.isEmpty():
            break
        past = past.unionByName(front)
        if len(found) % 8 == 0:
            past = materialize(past, f"{tag}-past")
    all_ = found[0]
    for f in found[1:]:
        all_ = all_.unionByName(f)
    return all_.distinct(), rings


# ----------------------------------------------------------- the project's tables


def commit_nodes(commits: DataFrame) -> DataFrame:
    """Commits by first parent, a row each; one without repository or time is placed apart, which costs locality only."""
    return commits.where("commit_sha is not null").groupBy(F.col("commit_sha").alias("node")).agg(
        F.min(F.get("parents", F.lit(0))).alias("parent"), F.min("repo_id").alias("part"), F.min("loaded_at").alias("pos")
    )


def commit_forest(commits: DataFrame) -> DataFrame:
    """``(node, root, depth)`` of commits by first parent; see :func:`forest`."""
    return forest(commit_nodes(commits), "commit")


def tree_graph(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees and the links between them."""
    entries = entries.where("tree_oid is not null")
    nodes = entries.groupBy(F.col("tree_oid").alias("node")).agg(F.min("repo_id").alias("part"), F.min("observed_at").alias("pos"))
    # Links to what is no node fall out when links are placed.
    links = entries.where("mode = '40000' and child_oid is not null").select(F.col("tree_oid").alias("parent"), F.col("child_oid").alias("child")).distinct()
    return nodes, links


def tree_walk(entries: DataFrame, commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(root, node, depth) of trees below the trees of commits, and tree nodes on circles."""
    nodes, links = tree_graph(entries)
    roots = commits.where("tree is not null").select(F.col("tree").alias("node")).distinct()
    return walk_graph(nodes, links, roots, "tree")


def tree_descendants(entries: DataFrame) -> DataFrame:
    """``(node, descendant, distance)`` of every tree: each tree below it once, at its least distance.

    A tree on a circle is its own descendant, at the length of its shortest
    circle.  Trees are shared, so no intervals; their depth bounds the pairs.
    """
    nodes, links = tree_graph(entries)
    states, rings = walk_graph(nodes, links, nodes.select("node"), "tree-below")
    least = materialize(states.groupBy(F.col("root").alias("node"), F.col("node").alias("descendant")).agg(F.min("depth").alias("distance")), "tree-below-least")
    # Paths do not come back to where they began; the last link of a circle is put on here.
    closing = links.join(rings.select(F.col("node").alias("child")), "child").select(F.col("child").alias("node"), F.col("parent").alias("descendant"))
    back = least.join(closing, ["node", "descendant"]).groupBy("node").agg((F.min("distance") + 1).alias("distance"))
    return least.where("distance > 0").unionByName(back.select("node", F.col("node").alias("descendant"), "distance"))


def hierarchies(commits: DataFrame, entries: DataFrame) -> DataFrame:
    """``(hierarchy, node, root, depth)`` of both hierarchies, circles as root '' and depth -1."""
    c = commit_forest(commits).where("root is not null").select(F.lit("commit").alias("hierarchy"), "node", "root", F.col("depth").cast("int").alias("depth"))
    states, rings = tree_walk(entries, commits)
    t = states.select(F.lit("tree").alias("hierarchy"), "node", "root", "depth")
    r = rings.select(F.lit("tree").alias("hierarchy"), "node", F.lit("").alias("root"), F.lit(-1).alias("depth"))
    return c.unionByName(t).unionByName(r)
