"""Stores written batch by batch: bucketed history with tombstones, segmented index."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from cmdlens.functions.hashing import command_hash
from cmdlens.operators.index import build_index
from cmdlens.operators.ingest import ingest, merge_history
from cmdlens.sources.bucket_store import BucketStore
from cmdlens.streaming.segments import SegmentedIndex
from tests.conftest import make_events

COLS = ["hash", "cmd", "cwd", "ts_ms", "source", "tool", "category"]


def table(df):
    return sorted(tuple(r) for r in df.select(*COLS).collect())


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_ino for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def random_events(seed, n, commands=40):
    r = random.Random(seed)
    return [(i, f"cmd {r.randrange(commands)}", r.choice(["/a", "/b", ""]), r.randrange(1000), r.choice(["", "", "agent"]),
             r.choice(["", "Bash", "Read"]), r.choice(["", "shell"])) for i in range(n)]


def test_batches_in_any_order_equal_a_full_ingest(spark, tmp_path):
    rows = random_events(1, 300)
    store = BucketStore(spark, str(tmp_path / "s"), buckets=8)
    parts = [rows[i::4] for i in range(4)]
    for epoch, part in enumerate([parts[2], parts[0], parts[3], parts[1]], 1):
        store.upsert(make_events(spark, part), epoch)
        if epoch == 2:
            store.upsert(make_events(spark, part), epoch)     # a write repeated after a failure
    assert table(store.history()) == table(ingest(make_events(spark, rows)))
    assert store.upsert(make_events(spark, []), 9) == []


def test_an_upsert_rewrites_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "s")
    store = BucketStore(spark, path, buckets=64)
    store.upsert(make_events(spark, [(i, f"c{i}", "/a", i) for i in range(400)]), 1)
    before = files(path)
    batch = make_events(spark, [(1000, "c7", "/b", 5000), (1001, "brand new", "/b", 5001)])
    touched = store.upsert(batch, 2)
    after = files(path)
    changed = {p.split("bucket=")[1].split("/")[0] for p, _ in set(before.items()) ^ set(after.items())}
    assert {int(b) for b in changed} == set(touched) and len(touched) <= 2
    assert len(after) >= 60 and store.history().count() == 401
    assert store.history().filter("cmd = 'c7'").first().cwd == "/b"


def test_stored_rows_are_not_exchanged_for_a_small_batch(spark, tmp_path, monkeypatch):
    store = BucketStore(spark, str(tmp_path / "s"), buckets=8)
    store.upsert(make_events(spark, [(i, f"c{i}", "/a", i) for i in range(200)]), 1)
    plans = []
    monkeypatch.setattr(BucketStore, "_overwrite", lambda self, rows: plans.append(rows._jdf.queryExecution().executedPlan().toString()))
    store.upsert(make_events(spark, [(900, "c3", "/b", 900)]), 2)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plans[0])
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]


def test_prune_is_seen_at_once_and_after_compaction(spark, tmp_path):
    path = str(tmp_path / "s")
    store = BucketStore(spark, path, buckets=4)
    events = make_events(spark, [(i, f"cmd {i}", "/a", i, "agent" if i % 2 else "") for i in range(20)])
    store.upsert(events, 1)
    idx = build_index(store.history())
    before = files(path + "/rows")
    gone = spark.createDataFrame([(f"cmd {i}",) for i in (3, 4, 5)], "cmd string").select(command_hash("cmd").alias("hash"))
    store.prune(gone, 2)
    store.prune(gone, 2)                                       # repeated
    assert files(path + "/rows") == before                     # nothing is rewritten
    want = sorted(f"cmd {i}" for i in range(20) if i not in (3, 4, 5))
    assert sorted(r.cmd for r in store.history().collect()) == want
    alive = {r.hash for r in store.history().collect()}
    assert {r.hash for r in store.live_index(idx).select("hash").distinct().collect()} <= alive
    assert store.compact() and not files(path + "/tombstones")
    assert sorted(r.cmd for r in store.history().collect()) == want
    assert store.compact() == []
    # seen again: visible, with old tags and a new place
    store.upsert(make_events(spark, [(50, "cmd 3", "/n", 7), (51, "cmd 4", "/n", 8)]), 3)
    got = {r.cmd: (r.cwd, r.ts_ms, r.source) for r in store.history().filter("cmd in ('cmd 3', 'cmd 4', 'cmd 5')").collect()}
    assert got == {"cmd 3": ("/n", 7, "agent"), "cmd 4": ("/n", 8, "")}
    # pruned again and seen again with the tombstone still there
    store.prune(gone, 4)
    store.upsert(make_events(spark, [(60, "cmd 5", "/m", 9)]), 5)
    assert sorted(r.cmd for r in store.history().collect()) == sorted(set(want) | {"cmd 5"})
    assert {r.hash for r in store.live_index(build_index(events.select(command_hash("cmd").alias("hash"), "cmd"))).select("hash").distinct().collect()
            } >= {r.hash for r in store.history().collect()}


def test_a_bucket_that_loses_all_rows_stays_empty(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "s"), buckets=1)
    store.upsert(make_events(spark, [(1, "a", "/x", 1), (2, "b", "/x", 2)]), 1)
    store.prune(store.history().select("hash"), 2)
    store.compact()
    assert store.history().count() == 0 and store.rows().count() == 0
    store.upsert(make_events(spark, [(3, "a", "/y", 3)]), 3)
    assert [(r.cmd, r.cwd) for r in store.history().collect()] == [("a", "/y")]


def test_open_epochs_are_read_and_folded(spark, tmp_path):
    rows = random_events(7, 240)
    store = BucketStore(spark, str(tmp_path / "s"), buckets=8)
    store.upsert(make_events(spark, rows[:60]), 1)
    for epoch, part in ((2, rows[60:120]), (3, rows[120:180]), (3, rows[120:180]), (4, rows[180:])):
        before = files(str(tmp_path / "s" / "rows"))
        store.append(make_events(spark, part), epoch)
        assert files(str(tmp_path / "s" / "rows")) == before
    full = table(ingest(make_events(spark, rows)))
    assert store.open_epochs() == [2, 3, 4] and table(store.history()) == full
    assert store.fold() and store.open_epochs() == [] and table(store.history()) == full
    assert store.fold() == []
    # a prune of what an open epoch holds
    store.append(make_events(spark, [(900, "only here", "/a", 5, "agent"), (901, "cmd 1", "/a", 9000)]), 5)
    gone = store.history().filter("cmd in ('only here', 'cmd 1')").select("hash")
    store.prune(gone, 6)
    want = [r for r in full if r[1] != "cmd 1"]
    assert store.open_epochs() == [] and table(store.history()) == want
    store.append(make_events(spark, [(950, "only here", "/b", 3)]), 7)
    back = store.history().filter("cmd = 'only here'").first()
    assert (back.cwd, back.ts_ms, back.source) == ("/b", 3, "agent") and store.history().count() == len(want) + 1


def test_late_update_without_order_is_refused(spark):
    old = ingest(make_events(spark, [(1, "a", "/x", 10)]))
    with pytest.raises(Exception, match="late update"):
        merge_history(old, ingest(make_events(spark, [(2, "a", "/y", 5)]))).collect()
    merged = merge_history(old, ingest(make_events(spark, [(2, "a", "/y", 15), (3, "b", "/z", 1)])))
    assert {(r.cmd, r.cwd) for r in merged.collect()} == {("a", "/y"), ("b", "/z")}


def rows_of(spark, epoch, n=50):
    return spark.createDataFrame([((epoch * 7 + i) % 90, f"h{epoch}-{i}") for i in range(n)], "ngram int, hash string")


def test_segments_stay_few_and_sorted(spark, tmp_path):
    idx = SegmentedIndex(spark, str(tmp_path / "i"), fanout=3)
    want = []
    for epoch in range(14):
        idx.append(rows_of(spark, epoch), epoch)
        want += [tuple(r) for r in rows_of(spark, epoch).collect()]
        per_level = {}
        for _, level, _ in idx.live():
            per_level[level] = per_level.get(level, 0) + 1
        assert max(per_level.values()) <= 2 and len(per_level) <= 3
        assert len(files(str(tmp_path / "i" / "segments"))) <= 2 * 2 * 3       # live ones and those of the manifest before
    assert sorted(map(tuple, idx.read().collect())) == sorted(want)
    assert len(idx.manifests()) == 2
    # a lookup is pushed to the sorted files
    plan = idx.read().filter(F.col("ngram").isin(3, 5))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(ngram" in plan
    idx.append(spark.createDataFrame([], "ngram int, hash string"), 14)      # an empty batch
    assert sorted(map(tuple, idx.read().collect())) == sorted(want)


def test_a_repeated_or_failed_batch_changes_nothing(spark, tmp_path, monkeypatch):
    idx = SegmentedIndex(spark, str(tmp_path / "i"), fanout=2)
    idx.append(rows_of(spark, 0), 0)
    live = idx.live()
    idx.append(rows_of(spark, 0), 0)
    assert idx.live() == live
    # fails after the merge, before the manifest: the old manifest stays in force, the batch is written again
    real = SegmentedIndex._write
    calls = []

    def failing(self, rows, name, n):
        real(self, rows, name, n)
        calls.append(name)
        if len(calls) == 2:
            raise RuntimeError("lost")
    monkeypatch.setattr(SegmentedIndex, "_write", failing)
    with pytest.raises(RuntimeError):
        idx.append(rows_of(spark, 1), 1)
    assert idx.live() == live and sorted(map(tuple, idx.read().collect())) == sorted(map(tuple, rows_of(spark, 0).collect()))
    monkeypatch.setattr(SegmentedIndex, "_write", real)
    idx.append(rows_of(spark, 1), 1)
    assert idx.read().count() == 100 and [x[1] for x in idx.live()] == [1]
