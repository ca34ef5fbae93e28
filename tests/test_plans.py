"""Physical-plan properties: pushdown, no cross joins, shuffle-free search, partial top-k."""

from cmdlens.operators.index import batch_search
from cmdlens.operators.ingest import ingest
from cmdlens.operators.search import find
from cmdlens.operators.stats import top_list
from cmdlens.sources import fixtures
from tests.conftest import SMOKE_DIR


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def stored_history(spark, tmp_path):
    h = ingest(fixtures.command_events(fixtures.load(spark, SMOKE_DIR, "events")))
    path = str(tmp_path / "history")
    h.write.parquet(path)
    return spark.read.parquet(path)


def test_find_pushes_filters_and_needs_no_shuffle(spark, tmp_path):
    h = stored_history(spark, tmp_path)
    plan = plan_of(find(h, ["git", "status"], cwd="/home/u7/proj"))
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,)]" in plan
    assert "tool" not in plan.split("ReadSchema:")[1].split("\n")[0]   # unused columns pruned
    assert "TakeOrderedAndProject" in plan
    assert "Exchange hashpartitioning" not in plan


def test_ingest_reads_only_needed_columns(spark):
    ev = fixtures.command_events(fixtures.load(spark, SMOKE_DIR, "events"))
    plan = plan_of(ingest(ev))
    schema = plan.split("ReadSchema:")[1].split("\n")[0]
    assert "props" not in schema and "value" not in schema


def test_batch_search_uses_partial_group_limit(spark, tmp_path):
    h = stored_history(spark, tmp_path)
    q = spark.createDataFrame([("a", ["git", "1"], "/home/u7/proj"), ("b", ["ls"], "")],
                              "qid string, keywords array<string>, cwd string")
    plan = plan_of(batch_search(h, q))
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_top_list_combines_map_side(spark, tmp_path):
    h = stored_history(spark, tmp_path)
    plan = plan_of(top_list(h, "programs"))
    assert "partial_count" in plan and "TakeOrderedAndProject" in plan


def test_no_registered_query_plans_a_cross_join(spark):
    from cmdlens.plans import registry
    for name, fn in registry.QUERIES.items():
        plan = plan_of(fn(spark, SMOKE_DIR))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_stored_layouts_prune(spark, tmp_path):
    from pyspark.sql import functions as F
    from cmdlens.operators.index import build_index
    from cmdlens.sources import store
    h = ingest(fixtures.command_events(fixtures.load(spark, SMOKE_DIR, "events")))
    store.write_history(h, str(tmp_path / "h"))
    back = store.read_history(spark, str(tmp_path / "h"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, h.select(*back.columns).collect()))
    plan = plan_of(find(back, ["git"]))
    assert "PartitionFilters: [(coalesce(source" in plan
    store.write_index(build_index(h), str(tmp_path / "i"))
    idx = spark.read.parquet(str(tmp_path / "i"))
    assert "PushedFilters: [In(ngram" in plan_of(idx.filter(F.col("ngram").isin(1, 2, 3)))


def test_history_is_joined_after_the_trigram_join(spark, tmp_path):
    """The prebuilt index meets the asked trigrams first; the history joins what is left."""
    from cmdlens.operators.index import asked_postings, build_index
    h = stored_history(spark, tmp_path)
    build_index(h).write.parquet(str(tmp_path / "idx"))
    sets = spark.createDataFrame([("a", "", 6777204)], "gk string, place string, ngram int")
    idx = spark.read.parquet(str(tmp_path / "idx"))
    plans = []
    import cmdlens.operators.index as index_module
    real = index_module.materialize
    try:
        index_module.materialize = lambda df, tag: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df
        asked_postings(idx, sets, h.select("hash", "cwd", "ts_ms"))
    finally:
        index_module.materialize = real
    lines = plans[0].split("\n")
    joins = [i for i, x in enumerate(lines) if "Join Inner, (hash" in x]
    grams = [i for i, x in enumerate(lines) if "Join Inner, (ngram" in x]
    # an outer join is printed above what it reads
    assert joins and grams and all(any(j < g for j in joins) for g in grams)


def test_resolve_prefixes_reads_the_history_once(spark, tmp_path, monkeypatch):
    """One scan of the history, met by the asked buckets before its exchange; no join has it as a whole."""
    from cmdlens.operators import hashlet
    h = stored_history(spark, tmp_path)
    p = spark.createDataFrame([("ab",), ("abcdef12",), ("zz",)], "prefix string")
    plans, real = [], hashlet.materialize
    monkeypatch.setattr(hashlet, "materialize", lambda df, tag: plans.append(plan_of(df)) or real(df, tag))
    plans.append(plan_of(hashlet.resolve_prefixes(h, p)))
    assert sum(x.count("ReadSchema: struct<hash:string,cmd:string") for x in plans) == 1
    stream = next(x for x in plans if "ReadSchema: struct<hash:string,cmd:string" in x)
    assert "BroadcastHashJoin" in stream and "SortMergeJoin" not in stream
