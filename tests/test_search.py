import itertools

from pyspark.sql import functions as F

from cmdlens.operators.index import batch_search, build_index
from cmdlens.operators.search import find, normalize_limit
from cmdlens.plans import commands
from tests.conftest import make_history


def cmds(df):
    return [r.cmd for r in df.orderBy("pos").collect()]


def test_ranked_first(spark):
    h = make_history(spark, [(1, "git status", "/a", 1000), (2, "git commit -m test", "/a", 2000),
                             (3, "ls -la", "/a", 3000), (4, "docker ps", "/a", 4000)])
    assert cmds(find(h, ["git", "status"]))[0] == "git status"


def test_short_keyword_scans(spark):
    h = make_history(spark, [(1, "ls", "/a", 1000), (2, "ls -la", "/a", 2000),
                             (3, "cat foo.txt", "/a", 3000), (4, "go build ./...", "/a", 4000)])
    assert cmds(find(h, ["ls"])) == ["ls -la", "ls"]


def test_empty_keywords(spark):
    h = make_history(spark, [(1, "ls", "/a", 1000)])
    assert find(h, [""]).count() == 0
    assert find(h, []).count() == 0


def test_limit(spark):
    h = make_history(spark, [(i, f"echo {i}", "/a", i) for i in range(20)])
    assert find(h, ["echo"], limit=3).count() == 3
    assert find(h, ["echo"], limit=0).count() == 5
    assert normalize_limit(50, clamp=True) == 20 and normalize_limit(1, clamp=True) == 5


def test_local_and_fallback(spark):
    h = make_history(spark, [(1, "make build", "/proj/a", 1000), (2, "make test", "/proj/b", 2000)])
    local = find(h, ["make"], cwd="/proj/a").collect()
    assert [r.cmd for r in local] == ["make build"] and not local[0].is_global
    assert local[0].cwd == ""  # directory column cleared for scoped, non-fallback results
    other = find(h, ["make"], cwd="/proj/c").orderBy("pos").collect()
    assert [r.cmd for r in other] == ["make test", "make build"] and all(r.is_global for r in other)


def test_source_filters(spark):
    h = make_history(spark, [(1, "git status", "/a", 1000), (2, "git log", "/a", 2000, "agent", "Bash", "shell")])
    assert cmds(find(h, ["git"])) == ["git status"]
    assert cmds(find(h, ["git"], source="agent")) == ["git log"]
    assert sorted(cmds(find(h, ["git"], source="all"))) == ["git log", "git status"]


def test_squelch_after_limit(spark):
    h = make_history(spark, [(1, "git status", "/a", 3000), (2, "git log", "/a", 2000), (3, "git diff", "/a", 1000)])
    got = cmds(find(h, ["git"], limit=2, squelch_patterns=["git status"]))
    # the limit picks the two newest first; noise is removed afterwards
    assert got == ["git log"]


def test_ranked_then_scan_fallback(spark):
    # keyword "xyz" has no trigram hits, so the short keyword "ls" scan answers
    h = make_history(spark, [(1, "ls -la", "/a", 1000), (2, "pwd", "/a", 2000)])
    got = find(h, ["xyz", "ls"]).collect()
    assert [r.cmd for r in got] == ["ls -la"] and got[0].rank == 0


def test_reverse(spark):
    h = make_history(spark, [(i, f"echo {i}", "/a", i) for i in range(3)])
    assert cmds(find(h, ["echo"], reverse=True)) == ["echo 0", "echo 1", "echo 2"]


def test_annotation_flag(spark):
    h = make_history(spark, [(1, "git status", "/a", 1000), (2, "git log", "/a", 2000)])
    ann = h.filter(F.col("cmd") == "git log").select("hash", F.lit(1).alias("type"), F.lit("prune").alias("desc"))
    got = {r.cmd: r.annotation_type for r in find(h, ["git"], annotations=ann).collect()}
    assert got == {"git status": 0, "git log": 1}


def test_batch_equals_single_queries(spark):
    rows = []
    words = ["git status", "git commit -m x", "make build", "ls -la", "ls", "docker ps", "kubectl get po",
             "vim é.txt", "go test ./..."]
    dirs = ["/a", "/b", "/c"]
    for i, (w, d) in enumerate(itertools.product(words, dirs)):
        rows.append((i, f"{w} {i % 4}", d, 1000 + i * 7 % 23))
    h = make_history(spark, rows)
    cases = [(["git", "status"], "/a"), (["ls"], "/b"), (["make", "1"], "/nowhere"), (["xyz", "ls"], ""),
             (["é"], "/c"), (["", ""], "/a"), (["do", "po"], ""), (["kubectl"], "/c")]
    qdf = spark.createDataFrame([(str(i), kws, d) for i, (kws, d) in enumerate(cases)],
                                "qid string, keywords array<string>, cwd string")
    for idx in (None, build_index(h)):
        got = {}
        for r in batch_search(h, qdf, limit=4, index=idx).collect():
            got.setdefault(r.qid, []).append((r.pos, r.cmd, r.is_global, r.cwd))
        for i, (kws, d) in enumerate(cases):
            want = [(r.pos, r.cmd, r.is_global, r.cwd) for r in find(h, kws, limit=4, cwd=d or None).collect()]
            assert sorted(got.get(str(i), [])) == sorted(want), (kws, d)


def test_rank_and_scan_of_many_terms(spark):
    """One form for any number of terms, multi-byte trigrams included."""
    import cmdlens.operators.search as S
    words = [f"é{i:02d}ü" for i in range(70)]
    texts = [" ".join(words[i::7]) for i in range(7)] + ["", "é", "é0", "xé01üx"]
    df = spark.createDataFrame([(t,) for t in texts], "cmd string")
    grams = S.query_grams(words)

    def rank(t, gs):
        b = t.encode()
        return len({(b[i] << 16) | (b[i + 1] << 8) | b[i + 2] for i in range(len(b) - 2)} & set(gs))
    for n in (1, 9, 10, 11, 66, len(grams)):
        got = df.select("cmd", S.rank_column(F.col("cmd"), grams[:n]).alias("r"), S.scan_column(F.col("cmd"), words[:n]).alias("s")).collect()
        assert got == [(t, rank(t, grams[:n]), any(w in t for w in words[:n])) for t in texts], n


def test_found_keywords_against_brute_force(spark):
    """Keywords of any length (also beyond a window), bytes that start in the middle of others, null and empty texts."""
    import random
    from cmdlens.functions.keywords import found_keywords, holds_any
    r = random.Random(4)
    alphabet = "abé日 \n"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 120))) for _ in range(150)] + [None, "", "a"]
    for least, most, count in ((1, 3, 4), (3, 6, 40), (1, 40, 300), (20, 40, 50), (17, 17, 1)):
        # some keywords are cut from the texts, so that long ones are found
        kws = [(t or "zz")[i:i + r.randrange(least, most + 1)] for t in r.choices(texts, k=count) for i in [r.randrange(0, 60)]]
        kws += ["".join(r.choice(alphabet) for _ in range(r.randrange(least, most + 1))) for _ in range(count)] + ["", ""]
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        got = df.select("i", found_keywords("t", kws).alias("f"), holds_any("t", kws).alias("h")).orderBy("i").collect()
        for (i, f, h), t in zip(got, texts):
            want = None if t is None else sorted({k for k in kws if k and k in t}, key=str.encode)
            assert f == want and h == bool(want), (t, f, want)


def test_find_limit_beyond_top_k(spark, monkeypatch):
    """Both sides of the reach give the same hits, positions and order."""
    import cmdlens.operators.search as S
    h = make_history(spark, [(i, f"git cmd {i % 37} {'status' if i % 3 else ''}", "/a" if i % 2 else "/b", 1000 + i % 50) for i in range(200)])
    for kw in (dict(keywords=["git", "status"]), dict(keywords=["gi"], reverse=True), dict(keywords=["status"], cwd="/a"),
               dict(keywords=["git"], cwd="/none"), dict(keywords=["git"], squelch_patterns=["glob:*3*"])):
        monkeypatch.setattr(S, "TOP_K_REACH", 100_000)
        want = {n: find(h, limit=n, **kw).collect() for n in (4, 5, 6, 1000)}
        for n in want:
            monkeypatch.setattr(S, "TOP_K_REACH", 5)
            large = find(h, limit=n, **kw)
            assert large.collect() == want[n], (kw, n)
        plan = large._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject" not in plan


def test_cat_limit_beyond_top_k(spark, monkeypatch):
    h = make_history(spark, [(i, f"cmd {i % 37}", "/a", 1000 + i) for i in range(200)])
    want = [(r.cmd, r.pos) for r in commands.cat(h, limit=30).collect()]
    monkeypatch.setattr(commands, "TOP_K_REACH", 3)
    large = commands.cat(h, limit=30)
    assert [(r.cmd, r.pos) for r in large.collect()] == want
    # the only single-partition window is over the partitions' sizes
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan


def test_history_and_cat(spark):
    h = make_history(spark, [(1, "git status", "/a", 1000), (2, "make", "/b", 2000), (3, "ls", "/a", 3000),
                             (4, "tagged", "/a", 4000, "agent")])
    assert [r.cmd for r in commands.history(h).collect()] == ["ls", "make", "git status"]
    assert [r.cmd for r in commands.history(h, reverse=True).collect()] == ["git status", "make", "ls"]
    local = commands.history(h, cwd="/a").collect()
    assert [r.cmd for r in local] == ["ls", "git status"] and {r.cwd for r in local} == {""}
    assert [r.cmd for r in commands.cat(h).collect()] == ["git status", "make", "ls"]
    assert [r.cmd for r in commands.cat(h, limit=2).collect()] == ["make", "ls"]
    assert [r.cmd for r in commands.cat(h, source="all", limit=1).collect()] == ["tagged"]
    # limit applies before noise filtering
    assert [r.cmd for r in commands.cat(h, limit=2, squelch_patterns=["ls"]).collect()] == ["make"]


def test_phrase_order(spark):
    h = make_history(spark, [(1, "git commit -m fix", "/a", 1000), (2, "git comit fix", "/a", 2000),
                             (3, "gi comt -m fix", "/a", 3000), (5, "gti commt -m fix", "/a", 5000), (4, "ls", "/a", 4000)])
    got = commands.filtered_history(h, "  Git Comit ").collect()
    assert [(r.cmd, r.exact) for r in got] == [("git comit fix", True), ("gi comt -m fix", False),
                                               ("git commit -m fix", False)]
    assert commands.filtered_history(h, "   ").count() == 0


def test_long_queries(spark):
    words = [f"w{i}x" for i in range(80)]
    rows = [(i, f"echo {w} é{i}", "/a", i) for i, w in enumerate(words)]
    h = make_history(spark, rows)
    long_kw = "".join(words)
    got_long = find(h, [long_kw], limit=10).collect()
    assert len(got_long) == 10 and all(r.rank > 0 for r in got_long)
    many = find(h, words + ["zz"], limit=100).collect()
    assert len(many) == 80


def test_keyword_queries_from_text(spark):
    h = make_history(spark, [(1, "git status", "/a", 1000), (2, "make build", "/b", 2000),
                             (3, "git log", "/b", 3000)])
    typed = spark.createDataFrame([("1", "  git   st ", "/b"), ("2", "", "/a")], "id string, q string, d string")
    q = commands.keyword_queries(typed, "id", "q", "d")
    assert [r.keywords for r in q.orderBy("qid").collect()] == [["git", "st"], []]
    got = [(r.qid, r.cmd) for r in batch_search(h, q).orderBy("qid", "pos").collect()]
    want = [("1", r.cmd) for r in find(h, ["git", "st"], cwd="/b").collect()]
    assert got == want


def test_find_accepts_query_string(spark):
    h = make_history(spark, [(1, "git status", "/a", 1000), (2, "git log", "/a", 2000)])
    assert cmds(find(h, "  git   status ")) == cmds(find(h, ["git", "status"]))
    assert find(h, "   ").count() == 0


def test_cat_tool_and_category_filters(spark):
    h = make_history(spark, [(1, "[Read] a.go", "/w", 1000, "agent", "Read", "file"),
                             (2, "[Bash] ls", "/w", 2000, "agent", "Bash", "shell"),
                             (3, "[Read] b.go", "/w", 3000, "agent", "Read", "file")])
    assert [r.cmd for r in commands.cat(h, source="agent", tool="Read").collect()] == ["[Read] a.go", "[Read] b.go"]
    assert [r.cmd for r in commands.cat(h, source="agent", category="shell", limit=5).collect()] == ["[Bash] ls"]
    assert [r.cmd for r in commands.history(h, source="all", tool="Read").collect()] == ["[Read] b.go", "[Read] a.go"]
