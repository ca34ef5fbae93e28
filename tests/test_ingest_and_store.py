from pyspark.sql import functions as F

from cmdlens.operators.ingest import ingest, merge_history, meta_map, meta_table
from cmdlens.sources import store
from cmdlens.sources.tool_calls import tool_calls, tool_events
from tests.conftest import make_events


def test_duplicate_is_one_row_latest_wins(spark):
    h = ingest(make_events(spark, [(1, "git status", "/a", 1000), (2, "git status", "/b", 3000),
                                   (3, "git status", "/c", 2000)])).collect()
    assert len(h) == 1 and h[0].ts_ms == 3000 and h[0].cwd == "/b"


def test_tie_broken_by_event_id(spark):
    h = ingest(make_events(spark, [(5, "x", "/late", 1000), (4, "x", "/early", 1000)])).first()
    assert h.cwd == "/late"


def test_sticky_tag(spark):
    ev = make_events(spark, [(1, "x", "/a", 1000, "agent", "Bash", "shell"), (2, "x", "/b", 2000)])
    h = ingest(ev).first()
    assert (h.source, h.tool, h.category, h.cwd) == ("agent", "Bash", "shell", "/b")
    assert sorted(tuple(r)[1:] for r in meta_table(ingest(ev)).collect()) == [
        ("category", "shell"), ("source", "agent"), ("tool", "Bash")]
    assert meta_map(ingest(make_events(spark, [(1, "y", "", 1)]))).first().meta == {}


def test_default_cwd(spark):
    h = ingest(make_events(spark, [(1, "x", "", 1000)]), default_cwd="/home").first()
    assert h.cwd == "/home"


def test_merge_history(spark):
    a = ingest(make_events(spark, [(1, "x", "/a", 1000, "agent"), (2, "y", "/a", 1000)]))
    b = ingest(make_events(spark, [(3, "x", "/b", 2000), (4, "z", "/b", 2000)]))
    got = {r.cmd: (r.cwd, r.ts_ms, r.source) for r in merge_history(a, b).collect()}
    assert got == {"x": ("/b", 2000, "agent"), "y": ("/a", 1000, ""), "z": ("/b", 2000, "")}


def test_encode_decode(spark):
    h = ingest(make_events(spark, [(1, "ünïcode cmd", "/ä", 1000)]))
    raw = store.encode_history(h)
    back = store.decode_history(raw).first()
    assert back.cmd == "ünïcode cmd" and back.cwd == "/ä"


def test_bad_rows_and_missing_cwd(spark, tmp_path):
    raw = spark.createDataFrame([("h1", 1, "Z2l0", None), ("h2", 2, "!!!", "L2E="), ("h3", 3, "bHM=", "%%")],
                                "hash string, ts long, cmd string, cwd string")
    got = sorted((r.hash, r.cmd, r.cwd) for r in store.decode_history(raw).collect())
    assert got == [("h1", "git", ""), ("h3", "ls", "")]
    old = spark.createDataFrame([("h1", 1, "Z2l0")], "hash string, ts long, cmd string")
    old.write.parquet(str(tmp_path / "old"))
    back = store.decode_history(store.read_history_raw(spark, str(tmp_path / "old"))).first()
    assert back.cwd == "" and back.cmd == "git"


def test_line_source(spark, tmp_path):
    p = tmp_path / "cmds.txt"
    p.write_bytes(b"git status\r\n\nls -la\nmake\n")
    ev = store.read_lines(spark, str(p), cwd="/w", source="agent", ts_ms=5)
    assert sorted(r.cmd for r in ev.collect()) == ["git status", "ls -la", "make"]
    assert {r.cwd for r in ev.collect()} == {"/w"}


def test_tool_calls(spark):
    rows = [
        (1, 10, '{"tool_name": "Bash", "tool_input": {"command": "  ls -la  "}, "cwd": "/w"}'),
        (2, 20, '{"tool_name": "Read", "tool_input": {"file_path": "   "}, "cwd": "/w"}'),
        (3, 30, '{"tool_name": "TodoWrite", "tool_input": {}, "cwd": "/w"}'),
        (4, 40, '{"tool_name": "Mystery", "tool_input": {"a": "b"}, "cwd": "/w"}'),
        (5, 50, '{"tool_name": "Grep", "tool_inp'),
        (6, 60, '{"tool_name": "CronList", "tool_input": {}}'),
        (7, 70, '{}'),
        (8, 80, '[1, 2]'),
        (9, 90, '{"tool_name": "Bash", "tool_input": "ls"}'),
    ]
    df = spark.createDataFrame(rows, "event_id long, ts_ms long, js string")
    got = {r.event_id: (r.display, r.category, r.tool, r.tool_cwd) for r in tool_calls(df).collect()}
    assert got == {1: ("[Bash] ls -la", "shell", "Bash", "/w"), 2: ("[Read]", "file", "Read", "/w"),
                   4: ("[Mystery]", "other", "Mystery", "/w"), 6: ("[CronList]", "cron", "CronList", ""),
                   7: ("[]", "other", "", "")}
    ev = tool_events(df, source="agent").filter(F.col("event_id") == 1).first()
    assert (ev.cmd, ev.source, ev.tool, ev.category) == ("[Bash] ls -la", "agent", "Bash", "shell")
