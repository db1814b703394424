import random
from datetime import datetime as dt

from pyspark.sql import functions as F

from orelode.operators import detect, orphans, snapshots
from orelode.streaming.detect_stream import finding_stream, object_stream, windowed_counts
from orelode.streaming.state import OrphanLedger, SnapshotIndex
from tests.stores import AWS, SLACK


def test_finding_stream(spark, tmp_path):
    schema = "oid string, type string, payload binary, stored_at timestamp"
    rows = [(f"o{i}", "blob" if i % 3 else "tree", f"k = {AWS if i % 2 else SLACK}".encode(), dt(2024, 1, 1, i)) for i in range(10)]
    for i in range(2):
        spark.createDataFrame(rows[i * 5 : i * 5 + 5], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = object_stream(spark, str(tmp_path / "in"), schema, 1)
    q = finding_stream(stream).select("blob_id", "pattern_name", "confidence_score").writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = detect.candidates(spark.createDataFrame(rows, schema).where("type = 'blob'").withColumnRenamed("oid", "blob_id"))
    assert {(r.blob_id, r.pattern_name) for r in spark.table("found").collect()} == {(r.blob_id, r.pattern_name) for r in batch.collect()}
    counts = windowed_counts(spark.createDataFrame([(dt(2024, 1, 1, i // 4), "p") for i in range(8)], "at timestamp, pattern_name string"), "at")
    assert sorted(r.n_candidates for r in counts.collect()) == [4, 4]


def test_orphan_ledger(spark, tmp_path):
    a, b = "a" * 40, "b" * 40
    refs = spark.createDataFrame([("t", 1, 24288, a), ("t", 2, 24289, a), ("t", 3, 24288, b)], "source_table string, record_id bigint, month int, oid string")
    objs = spark.createDataFrame([(a, dt(2024, 2, 5), None), (b, dt(2023, 1, 1), dt(2024, 1, 5))], "oid string, stored_at timestamp, deleted_at timestamp")
    led = OrphanLedger(spark, directory=str(tmp_path))
    assert led.pending().count() == 0
    assert led.advance(0, references=refs)
    assert led.pending().count() == 3  # nothing has arrived
    assert led.advance(1, objects=objs.where(F.col("oid") == a))
    assert sorted(tuple(r) for r in led.pending().collect()) == [(a, 24288), (b, 24288)]
    assert not led.advance(1, objects=objs)  # a repeated batch counts once
    assert led.advance(2, objects=objs.where(F.col("oid") == b))
    whole = orphans.pending(orphans.merge_ledgers(orphans.reference_ledger(refs), orphans.parent_ledger(objs)))
    assert sorted(map(tuple, led.pending().collect())) == sorted(map(tuple, whole.collect()))


def test_orphan_counts(spark, tmp_path):
    r = random.Random(5)
    oid = lambda: r.choice("abcdef") * 40
    refs = spark.createDataFrame([(r.choice("tu"), i, r.randint(24286, 24290), oid()) for i in range(120)], "source_table string, record_id bigint, month int, oid string")
    objs = spark.createDataFrame([(oid(), dt(2024, r.randint(1, 3), 5), r.choice((None, dt(2024, r.randint(2, 4), 5)))) for _ in range(9)], "oid string, stored_at timestamp, deleted_at timestamp")
    led = OrphanLedger(spark, directory=str(tmp_path), buckets=4)
    whole = lambda *parts: sorted(map(tuple, orphans.pending_counts(orphans.merge_ledgers(*parts)).collect()))
    half, rest = refs.where("record_id % 3 = 0"), refs.where("record_id % 3 <> 0")
    for batch, (x, o) in enumerate(((half, None), (None, objs), (rest, None))):
        assert led.advance(batch, x, o)
    assert sorted(map(tuple, led.counts().collect())) == whole(orphans.reference_ledger(refs), orphans.parent_ledger(objs))
    assert sorted(map(tuple, led.counts(0).collect())) == whole(orphans.reference_ledger(half))  # as they were
    assert not led.advance(2, refs) and led.state.batch == 2
    one = refs.limit(1)
    led.advance(3, one)
    assert len({v for v in led.state._manifest().values()}) > 1  # only the touched bucket is new
    assert sorted(map(tuple, led.counts().collect())) == whole(orphans.reference_ledger(refs.unionByName(one)), orphans.parent_ledger(objs))


SNAP = "stream_id bigint, snapshot_no int, path string, blob_oid string, mode string"


def test_snapshot_index(spark, tmp_path):
    """Random batches, with empty snapshots, several of a stream at once, gaps, repetitions and replays, give what one pass gives."""
    r = random.Random(1)
    data, numbers = [], {s: sorted(r.sample(range(20), 6)) for s in (1, 2, 3)}
    for s, nos in numbers.items():
        for no in nos:
            listed = [(s, no, f"p{p}", r.choice(("x", "y", None)), "m") for p in range(25) if r.random() < 0.6] if no != nos[2] else []
            data += [*listed, *listed[:3], (s, no, None, "x", "m")]
    df = spark.createDataFrame(data, SNAP)
    want = {tuple(x) for x in snapshots.snapshot_changes(df).collect()}
    cuts = {s: sorted(r.sample(nos, 2)) for s, nos in numbers.items()}
    batch_of = lambda s, no: sum(no >= c for c in cuts[s])
    index, got, given = SnapshotIndex(spark, directory=str(tmp_path), buckets=4), [], {}
    for i in range(3):
        part = spark.createDataFrame([x for x in data if batch_of(x[0], x[1]) == i], SNAP)
        given[i] = (part, sorted(map(tuple, index.apply(part, i).collect())))
        got += given[i][1]
        assert sorted(map(tuple, index.apply(part, i).collect())) == given[i][1]  # a replay
    assert len(got) == len(set(got)) and set(got) == want
    assert sorted(map(tuple, index.apply(given[0][0], 0).collect())) == given[0][1]  # an earlier one, too
    assert index.apply(given[1][0], 3).count() == 0  # late rows of what has passed change nothing
    assert index.apply(df.limit(0), 4).count() == 0


def test_snapshot_index_after_nothing(spark, tmp_path):
    index = SnapshotIndex(spark, directory=str(tmp_path), buckets=2)
    one = lambda no, *paths: spark.createDataFrame([(7, no, p, "x", "m") for p in paths], SNAP)
    assert index.apply(one(1, "a"), 0).count() == 0
    assert [tuple(x) for x in index.apply(one(2, None), 1).collect()] == [(7, 2, "a", "removed")]
    assert [tuple(x) for x in index.apply(one(3, "b"), 2).collect()] == [(7, 3, "b", "added")]
