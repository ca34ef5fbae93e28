import random

import pytest
from pyspark.sql import functions as F

from cmdlens.operators import sketches, stats


def log(spark, labels):
    return spark.createDataFrame([(x, "/a", i * 3_600_000) for i, x in enumerate(labels)], "cmd string, cwd string, ts_ms long")


@pytest.mark.parametrize("tracked,shape", [(64, "skewed"), (64, "flat"), (1000, "flat"), (16, "ties")])
def test_sketched_top_list_is_exact(spark, tracked, shape):
    """Few labels take most rows; all labels equally frequent (more than a sketch tracks); ties at the cut."""
    r = random.Random(3)
    labels = {"skewed": lambda: f"c{int(r.paretovariate(0.7)) % 5000}", "flat": lambda: f"c{r.randrange(600)}",
              "ties": lambda: f"c{r.randrange(40)}"}[shape]
    if shape == "ties":
        rows = [f"c{i % 40}" for i in range(4000)] + [None, None]
    else:
        rows = [labels() for _ in range(20_000)]
    df = log(spark, rows).repartition(4)
    for kept in (None, sketches.frequent_sketches(df, F.col("cmd"), F.date_trunc("month", F.timestamp_millis("ts_ms")).cast("string"), tracked)):
        got = sketches.top_list_sketched(df, F.col("cmd"), 10, kept, tracked).collect()
        want = stats.top_counts(df.filter("cmd is not null"), F.col("cmd"), 10).collect()
        assert got == want


def test_recount_exchanges_candidates_only(spark):
    r = random.Random(4)
    rows = ["hot"] * 9000 + ["warm"] * 4000 + [f"x{r.randrange(5000)}" for _ in range(6000)]
    df = log(spark, rows).repartition(4)
    top = sketches.top_list_sketched(df, F.col("cmd"), 2, None, 64)
    assert [tuple(x) for x in top.collect()] == [("hot", 9000), ("warm", 4000)]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan


def test_empty_log(spark):
    df = log(spark, [])
    assert sketches.top_list_sketched(df, F.col("cmd"), 5).collect() == []
    ranges = spark.createDataFrame([("all", "1970-01-01", "1970-01-02")], "name string, from_day string, to_day string")
    assert sketches.distinct_in_ranges(sketches.distinct_sketches(df), ranges).collect() == []


def test_distinct_counts_of_ranges(spark):
    df = log(spark, [f"prog{i % 50} {i % 700}" for i in range(3000)])     # an hour each, 125 days
    kept = sketches.distinct_sketches(df)
    ranges = spark.createDataFrame([("d", "1970-01-02", "1970-01-02"), ("w", "1970-01-05", "1970-01-11"), ("all", "1970-01-01", "1970-12-31")],
                                   "name string, from_day string, to_day string")
    got = {r.name: r for r in sketches.distinct_in_ranges(kept, ranges).collect()}
    assert (got["d"].n, got["w"].n, got["all"].n) == (24, 168, 3000)
    for name, commands, programs in (("d", 24, 24), ("w", 168, 50), ("all", 700, 50)):
        assert abs(got[name].unique_commands - commands) <= 0.05 * commands + 1
        assert abs(got[name].unique_programs - programs) <= 0.05 * programs + 1
