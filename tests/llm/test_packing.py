import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from orelode.llm import packing, tokenizer


def brute_bm25(seed, docs, df, n, mean):
    out = []
    for d in docs:
        size, tf = sum(d.values()), d
        s = 0.0
        for t in docs[seed]:
            if df[t] * 4 > n or t not in tf:
                continue
            s += math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (packing.K1 + 1) / (tf[t] + packing.K1 * (1 - packing.B + packing.B * size / mean))
        out.append(s)
    return out


def test_scores():
    r = random.Random(1)
    docs = [Counter(r.choices(range(50), [1 / (i + 1) for i in range(50)], k=r.randint(1, 40))) for _ in range(60)]
    df = np.bincount([t for d in docs for t in d], minlength=60)
    mean = sum(sum(d.values()) for d in docs) / 60
    shard = packing.Shard(np.array([sum(d.values()) for d in docs]), [np.array(sorted(d), np.int32) for d in docs], [np.array([d[t] for t in sorted(d)], np.int32) for d in docs], df, 60, mean)
    for seed in range(60):
        assert np.allclose(shard.scores(seed), brute_bm25(seed, docs, df, 60, mean), rtol=1e-4)


def test_common_terms():
    r = random.Random(5)
    docs = [Counter(r.choices(range(12), k=r.randint(1, 30))) for _ in range(40)]  # nearly all terms are common
    df = np.bincount([t for d in docs for t in d], minlength=12)
    mean = sum(sum(d.values()) for d in docs) / 40
    args = [np.array([sum(d.values()) for d in docs]), [np.array(sorted(d), np.int32) for d in docs], [np.array([d[t] for t in sorted(d)], np.int32) for d in docs], df, 40, mean]
    shard = packing.Shard(*args)
    assert shard.common.any()
    for seed, d in enumerate(docs):
        want = []
        for x in docs:
            size = sum(x.values())
            want.append(sum(math.log1p((40 - df[t] + 0.5) / (df[t] + 0.5)) * x[t] * (packing.K1 + 1) / (x[t] + packing.K1 * (1 - packing.B + packing.B * size / mean)) for t in d if t in x))
        assert np.allclose(shard.all_scores(seed), want, rtol=1e-4)
    # Texts that share only common terms are taken best first, not in order of place.
    rows = [(i, size, np.array(t, np.int32), np.array(f, np.int32)) for i, (size, t, f) in enumerate([(6, [0, 1], [3, 3]), (4, [2], [4]), (4, [0, 1], [2, 2]), (4, [2], [4])])]
    df = np.array([2, 2, 2])
    placed = list(packing.pack_shard(rows, [(1, 10)], df, 4, 4.5))
    assert {x[0] for x in placed if x[4] == "0:0"} == {0, 2}


def test_fill():
    r = random.Random(2)
    for cap in (10, 100):
        sizes = np.array([r.randint(0, cap) for _ in range(200)])
        windows = packing.fill(sizes, cap, lambda i: np.array([r.random() for _ in sizes]))
        items = sorted(x for w in windows for x in w)
        assert items == np.flatnonzero(sizes).tolist() and all(sizes[w].sum() <= cap for w in windows)
        assert len(windows) <= 1.25 * math.ceil(sizes.sum() / cap) + 1


SCHEMA = "repo_id string, doc_id bigint, text string, n_tokens string"


@pytest.mark.parametrize("shard", [2_000, 7])
def test_packed(spark, monkeypatch, shard):
    r = random.Random(3)
    monkeypatch.setattr(packing, "SHARD_DOCS", shard)
    words = "fix the parser queue index of lines that wait for a token in every log file".split()
    rows = [(None if i % 11 == 0 else f"r{i % 3}", i, " ".join(r.choices(words, k=r.choice((3, 20, 80)))), "clash") for i in range(80)]
    rows += [("r1", 100, "long " * 700, "x"), ("r1", 101, None, "x"), ("r1", 102, "", "x"), ("r2", 5_000, "x y z " * 64, "x")] + rows[:5]
    docs = spark.createDataFrame(rows, SCHEMA)
    classes = spark.createDataFrame([(1, "small", 64), (2, "large", 256), (3, "none", None), (4, "bad", 0)], "class_id int, label string, capacity_tokens int")
    placed = packing.packed(docs, classes).collect()
    by = defaultdict(list)
    for p in placed:
        by[p.doc_id].append(p)
    e = tokenizer.encoder()
    assert set(by) == {d for _, d, *_ in rows}
    for d, text in {(x[1], x[2]) for x in rows}:
        n = len(e.encode(text))
        pieces = sorted(by[d], key=lambda p: p.piece)
        assert sum(p.n_tokens for p in pieces) == n and [p.piece for p in pieces] == list(range(len(pieces)))
        assert len(pieces) == max(1, math.ceil(n / 256))  # split only beyond the largest class
        assert [p.token_start for p in pieces] == [256 * k for k in range(len(pieces))]
    used = defaultdict(int)
    for p in placed:
        used[p.container_id, p.class_id] += p.n_tokens
    cap = {1: 64, 2: 256}
    assert all(n <= cap[c] for (_, c), n in used.items()) and len({k for k, _ in used}) == len(used)
    assert all(c == 1 or n > 64 for (_, c), n in used.items())
    if shard > 100:
        assert sum(used.values()) / sum(cap[c] for _, c in used) > 0.8  # four small shards
    assert {r.class_id for r in packing.container_use(packing.packed(docs, classes), classes).collect()} == {c for _, c in used}


def test_no_rows_no_classes(spark):
    docs = spark.createDataFrame([("r", 1, "a b", "x")], SCHEMA)
    none = spark.createDataFrame([], "class_id int, label string, capacity_tokens int")
    assert [tuple(r) for r in packing.packed(docs, none).collect()] == [(1, 0, 0, 2, None, None, None)]
    assert packing.packed(docs.limit(0), none).count() == 0


def test_repeats_and_tasks(spark, monkeypatch):
    """One id under several repositories is placed once; the result does not depend on the number of tasks."""
    monkeypatch.setattr(packing, "SHARD_DOCS", 5)
    rows = [(repo, i, f"text number {i} of many", "x") for i in range(30) for repo in ("r1", "r2", None)] + [("r0", 3, "another text under the same id", "x"), (None, None, "no id", "x"), (None, None, "no id at all", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    classes = spark.createDataFrame([(1, "small", 16), (2, "large", 64)], "class_id int, label string, capacity_tokens int")
    got = sorted((tuple(r) for r in packing.packed(docs, classes).collect()), key=str)
    assert len(got) == 32 and len({r[0] for r in got}) == 31
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted((tuple(r) for r in packing.packed(docs.repartition(7), classes).collect()), key=str) == got
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert tuple(packing.faults(packing.packed(docs, classes), classes).first()) == (30, 0, 0, 0)
