
from pyspark.sql import functions as F

from cmdlens.operators.index import build_index
from cmdlens.operators.ingest import ingest
from cmdlens.sources import fixtures
from cmdlens.streaming import ingest as streaming
from tests.conftest import SMOKE_DIR


def _sorted(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_stream_equals_batch_across_restarts(spark, tmp_path):
    ev = fixtures.command_events(fixtures.load(spark, SMOKE_DIR, "events"))
    src = tmp_path / "src"
    # two files arriving in separate micro-batches, second one after a restart
    ev.filter(F.col("event_id") < 500).write.parquet(str(src / "a"))
    schema = spark.read.parquet(str(src / "a")).schema
    out, ckpt = str(tmp_path / "latest"), str(tmp_path / "ckpt")

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(src))
        streaming.start_latest(stream, out, ckpt).awaitTermination()

    run()
    ev.filter(F.col("event_id") >= 500).write.parquet(str(src / "b"))
    run()
    cols = ["hash", "cmd", "cwd", "ts_ms", "source", "tool", "category"]
    assert _sorted(streaming.read_latest(spark, out), cols) == _sorted(ingest(ev), cols)


def test_stream_index_equals_batch(spark, tmp_path):
    ev = fixtures.command_events(fixtures.load(spark, SMOKE_DIR, "events"))
    ev.write.parquet(str(tmp_path / "src"))
    schema = spark.read.parquet(str(tmp_path / "src")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "src"))
    streaming.start_index(stream, str(tmp_path / "idx"), str(tmp_path / "ck")).awaitTermination()
    got = _sorted(spark.read.parquet(str(tmp_path / "idx")), ["ngram", "hash"])
    assert got == _sorted(build_index(ingest(ev)), ["ngram", "hash"])


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "hash" in df.columns
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 40


def test_some_oracles_match_at_smoke_scale(spark):
    """DuckDB oracle equality on sf0.001 for a sample of queries."""
    import __spark_entry__ as E
    from tests.oracle_compare import compare, duck_connect
    con = duck_connect(SMOKE_DIR)
    qs, sqls = E.queries(), E.oracle_sql()
    for name in ["ingest_latest", "find_ranked", "find_local", "squelch_glob", "stats_overview",
                 "activity_heatmap", "resolve_prefixes", "tool_calls_parsed", "phrase_fuzzy", "batch_search"]:
        r = compare(spark, con, name, qs[name], sqls[name], SMOKE_DIR)
        assert r["ok"], r


def test_line_and_tool_call_streams(spark, tmp_path):
    logs, hooks = tmp_path / "logs", tmp_path / "hooks"
    logs.mkdir(); hooks.mkdir()
    (logs / "a.txt").write_text("git status\r\n\nls -la\ngit status\n")
    (hooks / "a.json").write_text('{"tool_name": "Bash", "tool_input": {"command": " make "}, "cwd": "/w"}\n'
                                  '{"tool_name": "TodoWrite", "tool_input": {}}\nnot json\n')
    out1, out2 = str(tmp_path / "o1"), str(tmp_path / "o2")
    streaming.start_latest(streaming.line_stream(spark, str(logs), cwd="/w"), out1,
                           str(tmp_path / "c1")).awaitTermination()
    streaming.start_latest(streaming.tool_call_stream(spark, str(hooks)), out2,
                           str(tmp_path / "c2")).awaitTermination()
    assert sorted(r.cmd for r in streaming.read_latest(spark, out1).collect()) == ["git status", "ls -la"]
    got = [(r.cmd, r.cwd, r.source, r.tool, r.category) for r in streaming.read_latest(spark, out2).collect()]
    assert got == [("[Bash] make", "/w", "agent", "Bash", "shell")]


def test_resolve_single_prefix(spark):
    from cmdlens.plans.commands import resolve_prefix
    h = ingest(fixtures.command_events(fixtures.load(spark, SMOKE_DIR, "events")))
    target = h.first().hash
    assert resolve_prefix(h, target[:10].upper()).first().status == "found"
    assert resolve_prefix(h, "zz").first().status == "invalid"
