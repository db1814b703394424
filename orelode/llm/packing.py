"""Filling fixed-capacity containers with texts.

Method: lexical retrieval packing.  Texts are cut into index shards of about
``SHARD_DOCS`` by a hash of their id; each shard is a BM25 inverted index over
token ids, weighted by statistics of the whole corpus.  A seed, the largest
text not yet placed, queries the index; its unused neighbours fill the seed's
window best first, each if it fits, until none fits.  A window then takes the
smallest container class that holds it.  Neighbours in other shards are not
retrieved (the README has the recall this gives).

The statistics are a vector over the vocabulary, whose size is fixed, so they
may be sent to every task.  Shards are packed one after another within a task;
memory is bounded by a shard.  Which shard a text is in, and so the result,
depends on the data alone, not on the number of tasks.  Very frequent terms (in over a quarter of all
texts), which are few, are kept as dense columns beside the inverted index.

Defined results: a text longer than the largest class is split into full
containers, its rest is an item like others; texts without tokens (null,
empty) lie at the end of some container of their shard; of the deliveries of
one id the first by repository (null before all) and then by hash of the text
counts, each text without an id by itself; without any class every text has a
null container.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.llm.tokenizer import VOCABULARY, encoder_of, shipped
from orelode.session import materialize, parallelism

SHARD_DOCS = 2_000
K1, B = 1.2, 0.75
VECTORS = "repo_id string, doc_id bigint, digest bigint, n_tokens bigint, terms array<int>, tfs array<int>"
PLACED = "doc_id bigint, piece int, token_start bigint, n_tokens bigint, container_id string, class_id int, pos int"
_PLACED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("token_start", pa.int64()), ("n_tokens", pa.int64()), ("container_id", pa.string()), ("class_id", pa.int32()), ("pos", pa.int32())])


def _vectors(batches: Iterable[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    e = encoder_of(vocabulary.value)
    for batch in batches:
        for at in range(0, batch.num_rows, 1_000):
            part = batch.slice(at, 1_000)
            sizes, terms, tfs, ends = [], [], [], [0]
            for text in part.column(3):
                ids = np.array(e.encode(text.as_py()), np.int32)
                u, c = np.unique(ids, return_counts=True)
                sizes.append(len(ids))
                terms.append(u)
                tfs.append(c)
                ends.append(ends[-1] + len(u))
            off = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(off, pa.array(np.concatenate(x).astype(np.int32))) for x in (terms, tfs)]
            yield pa.record_batch([part.column(0), part.column(1), part.column(2), pa.array(sizes, pa.int64()), *lists], names=["repo_id", "doc_id", "digest", "n_tokens", "terms", "tfs"])


def term_vectors(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Token counts of each text, whole."""
    file = shipped(documents.sparkSession, vocabulary)
    return documents.select("repo_id", F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("digest"), "text").mapInArrow(lambda it: _vectors(it, file), VECTORS)


def _frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(1, np.int64)
    n = total = 0
    for b in batches:
        terms = b.column(1).flatten().to_numpy(zero_copy_only=False)
        c = np.bincount(terms, minlength=len(df)) if len(terms) else np.zeros(1, np.int64)
        if len(c) > len(df):
            df = np.concatenate([df, np.zeros(len(c) - len(df), np.int64)])
        df[: len(c)] += c
        n += b.num_rows
        total += int(np.sum(b.column(0).to_numpy()))
    at = np.flatnonzero(df)
    yield pa.record_batch([pa.array(np.concatenate([[-1, -2], at]), pa.int32()), pa.array(np.concatenate([[n, total], df[at]]), pa.int64())], names=["term", "n"])


def corpus_statistics(vectors: DataFrame) -> tuple[np.ndarray, int, float]:
    """(document frequency by term, texts, mean tokens) over all texts."""
    rows = vectors.select("n_tokens", "terms").mapInArrow(_frequencies, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()  # at most one row per vocabulary entry
    by = {r.term: r.n for r in rows}
    n, total = by.pop(-1, 0), by.pop(-2, 0)
    df = np.zeros(max(by, default=0) + 1, np.int64)
    for t, c in by.items():
        df[t] = c
    return df, n, total / n if n else 1.0


class Shard:
    """An inverted index over the items of one shard."""

    def __init__(self, sizes: np.ndarray, terms: list[np.ndarray], tfs: list[np.ndarray], df: np.ndarray, n: int, mean: float) -> None:
        self.m = len(sizes)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.common = df * 4 > n
        doc = np.repeat(np.arange(self.m, dtype=np.int32), [len(t) for t in terms])
        term = np.concatenate(terms) if terms else np.zeros(0, np.int32)
        tf = (np.concatenate(tfs) if tfs else np.zeros(0)).astype(np.float32)
        weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / mean))).astype(np.float32)
        keep = ~self.common[term]
        column = np.cumsum(self.common) - 1
        self.dense = np.zeros((int(self.common.sum()), self.m), np.float32)
        self.dense[column[term[~keep]], doc[~keep]] = weight[~keep]
        self.columns = [column[t[self.common[t]]] for t in terms]
        doc, term, weight = doc[keep], term[keep], weight[keep]
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.starts = np.searchsorted(term[order], np.arange(len(df) + 1))
        self.terms = [t[~self.common[t]] for t in terms]

    def all_scores(self, item: int) -> np.ndarray:
        """BM25 over all terms of the item."""
        return self.scores(item) + self.dense[self.columns[item]].sum(axis=0)

    def scores(self, item: int) -> np.ndarray:
        """The part of the terms that are not common."""
        t = self.terms[item]
        a, z = self.starts[t], self.starts[t + 1]
        length = z - a
        if not length.sum():
            return np.zeros(self.m)
        at = np.repeat(a - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        return np.bincount(self.doc[at], self.weight[at], self.m)


def fill(sizes: np.ndarray, capacity: int, scores) -> list[list[int]]:
    """Windows of items no larger than ``capacity`` each, ``scores(seed)`` ranking neighbours."""
    free = np.ones(len(sizes), bool)
    free[sizes == 0] = False
    windows = []
    seeds = np.argsort(-sizes, kind="stable")
    for seed in seeds:
        if not free[seed]:
            continue
        free[seed] = False
        window, room = [int(seed)], capacity - int(sizes[seed])
        rest = np.flatnonzero(free & (sizes <= room))
        if len(rest):
            s = scores(int(seed))[rest]
            # Best first, runs of neighbours at a time: all of a run that fits is taken.
            ranked = rest[np.argsort(-s, kind="stable")]
            while len(ranked) and room:
                ranked = ranked[sizes[ranked] <= room]
                ends = np.cumsum(sizes[ranked])
                k = int(np.searchsorted(ends, room, "right"))
                if not k:
                    break
                window += ranked[:k].tolist()
                free[ranked[:k]] = False
                room -= int(ends[k - 1])
                ranked = ranked[k:]
        windows.append(window)
    return windows


def pack_shard(rows: list[tuple], classes: list[tuple[int, int]], df: np.ndarray, n: int, mean: float) -> Iterator[tuple]:
    """(doc_id, piece, token_start, n_tokens, container_id, class_id, pos) of a shard's texts."""
    if not classes:
        yield from ((doc, 0, 0, size, None, None, None) for doc, size, _, _ in rows)
        return
    largest = classes[-1][1]
    ids, sizes, terms, tfs = [], [], [], []
    for doc, size, t, f in rows:
        pieces = (size - 1) // largest if size else 0
        for k in range(pieces):
            yield doc, k, k * largest, largest, f"{doc}:{k}", classes[-1][0], 0
        ids.append((doc, pieces))
        sizes.append(size - pieces * largest)
        terms.append(t)
        tfs.append(f)
    size = np.array(sizes, np.int64)
    shard = Shard(size, terms, tfs, df, n, mean)
    windows = fill(size, largest, shard.all_scores)
    empty = np.flatnonzero(size == 0).tolist()
    if empty:
        if windows:
            windows[-1] += empty
        else:
            windows = [empty]
    for w in windows:
        used = int(size[w].sum())
        cls = next(c for c, cap in classes if cap >= used)
        doc, piece = ids[w[0]]
        name = f"{doc}:{piece}"
        for pos, x in enumerate(w):
            d, piece = ids[x]
            yield d, piece, piece * largest, int(size[x]), name, cls, pos


def _pack(batches: Iterable[pa.RecordBatch], classes, stats) -> Iterator[pa.RecordBatch]:
    df, n, mean = stats.value
    rows: list[tuple] = []
    now = last = None

    def done() -> pa.RecordBatch:
        out = list(zip(*pack_shard(rows, classes, df, n, mean)))
        rows.clear()
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(out, _PLACED)], schema=_PLACED)

    for b in batches:
        terms, tfs = b.column(3), b.column(4)
        flat_t, flat_f = terms.values.to_numpy(), tfs.values.to_numpy()
        ot, of = terms.offsets.to_numpy(), tfs.offsets.to_numpy()
        for i, (shard, doc, size) in enumerate(zip(*(b.column(k).to_pylist() for k in range(3)))):
            if shard != now:
                if rows:
                    yield done()
                now, last = shard, None
            if doc is None or doc != last:  # deliveries of one id follow each other
                rows.append((doc, size, flat_t[ot[i] : ot[i + 1]], flat_f[of[i] : of[i + 1]]))
            last = doc
    if rows:
        yield done()


def container_classes(table: DataFrame) -> list[tuple[int, int]]:
    """(class_id, capacity) by capacity; a fixed table of few rows, which is checked."""
    rows = table.where("capacity_tokens > 0 and class_id is not null").groupBy("capacity_tokens").agg(F.min("class_id").alias("class_id")).orderBy("capacity_tokens").limit(1_001).collect()
    if len(rows) > 1_000:
        raise ValueError("more than 1,000 container classes")
    return [(r.class_id, r.capacity_tokens) for r in rows]


def packed(documents: DataFrame, classes: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Where each text, or piece of one too long for any class, lies."""
    spark = documents.sparkSession
    vectors = materialize(term_vectors(documents, vocabulary), "term-vectors")
    stats = spark.sparkContext.broadcast(corpus_statistics(vectors))  # one number per vocabulary entry
    kinds = container_classes(classes)
    shards = max(1, -(-stats.value[1] // SHARD_DOCS))
    tasks = min(shards, max(2 * parallelism(spark), shards // 8))
    shard = F.pmod(F.xxhash64(F.coalesce("doc_id", "digest")), F.lit(shards)).cast("int")
    placed = vectors.withColumn("shard", shard).repartitionByRange(tasks, "shard").sortWithinPartitions("shard", "doc_id", "repo_id", "digest")
    return placed.select("shard", "doc_id", "n_tokens", "terms", "tfs").mapInArrow(lambda it: _pack(it, kinds, stats), PLACED)


def container_use(placed: DataFrame, classes: DataFrame) -> DataFrame:
    """Containers, tokens and unused space per class."""
    one = placed.where("container_id is not null").groupBy("container_id", "class_id").agg(F.sum("n_tokens").alias("used"))
    return (
        one.join(F.broadcast(classes.select("class_id", "capacity_tokens")), "class_id")  # a fixed table
        .groupBy("class_id")
        .agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("tokens"), (F.sum("capacity_tokens") - F.sum("used")).alias("unused"))
    )


def faults(placed: DataFrame, classes: DataFrame) -> DataFrame:
    """One row: texts placed; those whose pieces overlap or leave gaps; containers over their capacity; containers that a smaller class would hold."""
    of_text = placed.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("piece").alias("k"), F.max("piece").alias("last"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"), F.sum("n_tokens").alias("size"))
    texts = of_text.agg(F.count(F.lit(1)).alias("n_texts"), F.count_if(F.expr("n <> k or k <> last + 1 or end <> size")).alias("n_broken"))
    one = placed.where("container_id is not null").groupBy("container_id", "class_id").agg(F.sum("n_tokens").alias("used"))
    kinds = classes.where("capacity_tokens > 0 and class_id is not null").select("class_id", F.col("capacity_tokens").alias("capacity"))  # a fixed table
    below = one.join(F.broadcast(kinds), "class_id").crossJoin(F.broadcast(kinds.groupBy().agg(F.collect_list("capacity").alias("all"))))
    of_container = below.agg(F.count_if(F.expr("used > capacity")).alias("n_over"), F.count_if(F.expr("exists(all, c -> c < capacity and c >= used)")).alias("n_too_large"))
    return texts.crossJoin(of_container)  # one row each
