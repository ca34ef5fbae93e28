"""Work per task stays bounded: files, sorting tasks and texts are dealt by size, with the same results."""

import glob

from pyspark.sql import functions as F

from cmdlens.functions.keywords import found_keywords
from cmdlens.operators import hashlet, search
from cmdlens.operators.util import spread
from cmdlens.plans import registry
from cmdlens.streaming.segments import SegmentedIndex


def test_texts_are_dealt_evenly(spark):
    """One partition of texts: keyword search spreads it, each text searched once."""
    texts = [f"alpha{i % 7} beta\nbeta gamma{i}" for i in range(200)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    assert spread(rows, "text").rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    keywords = ["alpha3", "ta", "mma19", "nowhere"]
    hits = search.keyword_hits(rows, keywords, "text")
    assert hits.rdd.getNumPartitions() > 1
    got = {r.doc_id: r.found for r in hits.collect()}
    assert got == {i: f for i, t in enumerate(texts) if (f := sorted(k for k in keywords if k in t))}
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_keywords_of_pieces_and_of_whole_texts(spark):
    rows = spark.createDataFrame([(1, "ab  cd\ncd ab"), (2, "é日本 é"), (3, None), (4, ""), (5, "abcd\tab")], "k int, t string")
    for kws in (["ab", "cd", "é", "本", "\tab", "abc"], ["ab", "b  c", "d\nc", "é"], ["abcdefghijklmnopqrstuvwxyz", "cd"]):
        got = {r.k: r.f for r in rows.select("k", found_keywords("t", kws).alias("f")).collect()}
        want = {r.k: None if r.t is None else sorted(k for k in kws if k in r.t) for r in rows.collect()}
        assert got == want


def test_log_files_follow_the_size(spark):
    lines = spark.range(4000).select(F.lpad(F.col("id").cast("string"), 99, "x").alias("text"))
    path = registry._as_log_files(lines, spark, "size-test", file_bytes=40_000)
    assert len(glob.glob(f"{path.removeprefix('file:')}/part-*")) == 10      # 396,000 bytes
    assert spark.read.text(path).exceptAll(lines.toDF("value")).count() == 0 and spark.read.text(path).count() == 4000
    path = registry._as_log_files(lines.limit(3), spark, "size-test")
    assert spark.read.text(path).count() == 3


def test_segment_files_follow_the_rows(spark, tmp_path):
    idx = SegmentedIndex(spark, str(tmp_path))
    idx.append(spark.range(2_200_000).select((F.col("id") % 5000).cast("int").alias("ngram"), F.col("id").cast("string").alias("hash")), 0)
    assert len(glob.glob(f"{tmp_path}/segments/l0-e0/part-*")) == 3
    assert idx.read().count() == 2_200_000


def test_prefixes_are_sorted_in_tasks_of_bounded_size(spark, monkeypatch):
    history = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.col("id").cast("string").alias("cmd"),
                                       F.lit("").alias("cwd"), F.lit(0).cast("long").alias("ts_ms"), F.lit("").alias("source"))
    prefixes = history.select(F.explode(F.array(F.substring("hash", 1, 3), F.substring("hash", 1, 9))).alias("prefix")).distinct()
    plain = {tuple(r) for r in hashlet.resolve_prefixes(history, prefixes).collect()}
    monkeypatch.setattr(hashlet, "ROWS_PER_TASK", 100)
    res = hashlet.resolve_prefixes(history, prefixes)
    assert {tuple(r) for r in res.collect()} == plain and len(plain) == prefixes.count()
    assert "RepartitionByExpression" in res._jdf.queryExecution().logical().toString()
