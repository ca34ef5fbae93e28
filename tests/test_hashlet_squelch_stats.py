from pyspark.sql import functions as F

from cmdlens.operators import maintenance, stats
from cmdlens.operators.hashlet import min_hashlet_len, resolve_prefixes
from cmdlens.operators.index import build_index
from cmdlens.operators.squelch import DEFAULT_SQUELCH, active_list, compile_patterns, squelch
from tests.conftest import make_history


def min_len(spark, hashes):
    df = spark.createDataFrame([(h,) for h in hashes], "hash string")
    return min_hashlet_len(df).first().min_len


def test_min_len_vectors(spark):
    # fixed values: the floor is 4, equal hashes need all 64 characters
    assert min_len(spark, []) == 4
    assert min_len(spark, ["a" * 64]) == 4
    assert min_len(spark, ["aaa0" + "0" * 60, "aaa1" + "0" * 60]) == 4
    assert min_len(spark, ["aaaaa0" + "0" * 58, "aaaaa1" + "0" * 58]) == 6
    assert min_len(spark, ["a" * 64, "a" * 64]) == 64
    assert min_len(spark, [str(i) + "0" * 63 for i in range(10)]) == 4


def test_min_len_unique_property(spark):
    h = make_history(spark, [(i, f"cmd {i}", "/a", i) for i in range(500)])
    n = min_hashlet_len(h).first().min_len
    hashes = [r.hash for r in h.collect()]
    assert len({x[:n] for x in hashes}) == len(hashes)
    assert len({x[:n - 1] for x in hashes}) < len(hashes) or n == 4


def test_resolve_prefix_statuses(spark):
    h = make_history(spark, [(i, f"cmd {i}", "/a", i) for i in range(40)])
    hashes = sorted(r.hash for r in h.collect())
    target = hashes[0]
    prefixes = [target[:12], target[:12].upper(), "", "xyz!", "f" * 20, target[:1], target]
    p = spark.createDataFrame([(x,) for x in prefixes], "prefix string")
    got = {r.prefix: (r.status, r.hash) for r in resolve_prefixes(h, p).collect()}
    assert got[target[:12]] == ("found", target)
    assert got[target[:12].upper()] == ("found", target)
    assert got[target] == ("found", target)
    assert got[""][0] == "empty" and got["xyz!"][0] == "invalid"
    assert got["f" * 20][0] == "not_found"
    n_first = sum(1 for x in hashes if x.startswith(target[:1]))
    assert got[target[:1]][0] == ("ambiguous" if n_first > 1 else "found")


def test_squelch_kinds(spark):
    commands = ["df", "df -h", "df /srv", "dfx", "hg update", "hg merge tip"]
    df = spark.createDataFrame([(c,) for c in commands], "cmd string")

    def gone(patterns):
        return sorted(set(commands) - {r.cmd for r in squelch(df, patterns).collect()})
    assert gone(["df"]) == ["df"]
    assert gone(["glob:df *"]) == ["df -h"]
    assert gone(["regex:^hg [a-m]"]) == ["hg merge tip"]
    assert gone(["dfx", "glob:df ?*", "regex:e$"]) == ["df -h", "dfx", "hg update"]
    assert gone([]) == []


def test_squelch_bad_patterns_warn_and_skip(spark):
    c = compile_patterns(["regex:(unclosed", "glob:[abc", "regex:a(?=b)", "ok", "regex:a{2,1}"])
    assert c.exact == ["ok"] and not c.regexes and len(c.warnings) == 4
    assert "repeat" in c.warnings[-1]


def test_active_list():
    assert active_list() == DEFAULT_SQUELCH and len(DEFAULT_SQUELCH) == 23
    assert active_list(user_patterns=["x"])[-1] == "x"
    assert active_list(clear_defaults=True, user_patterns=["x"]) == ["x"]


def test_stats(spark):
    rows = [(1, "git status", "/a", 0), (2, "git log", "/a", 3_600_000), (3, "make", "", 2 * 86_400_000),
            (4, "ls", "/b", 5), (5, "FOO=1 go test", "/b", 86_400_000 + 7)]
    h = make_history(spark, rows)
    base = stats.stats_base(h, squelch_patterns=DEFAULT_SQUELCH)
    ov = stats.overview(base).first()
    assert (ov.total_commands, ov.unique_commands, ov.unique_programs) == (4, 4, 3)
    assert abs(ov.avg_per_day - 2.0) < 1e-9
    top = [(r.label, r["count"]) for r in stats.top_list(base, "programs").collect()]
    assert top == [("git", 2), ("go", 1), ("make", 1)]
    assert [r.label for r in stats.top_list(base, "dirs").collect()] == ["/a", "/b"]
    hourly = stats.hourly_distribution(base).collect()
    assert len(hourly) == 24 and sum(r["count"] for r in hourly) == ov.total_commands
    view = stats.top_list_view(base, "categories").collect()
    assert view[0].rank == 1 and abs(sum(r.share_pct for r in view) - 100.0) < 1e-9
    hm = stats.activity_heatmap(base, weeks=2).collect()
    assert len(hm) == 14 and sum(r["count"] for r in hm) == 4
    rough = stats.overview(base, approximate=0.02).first()
    assert (rough.unique_commands, rough.unique_programs) == (4, 3) and rough.avg_per_day == ov.avg_per_day
    empty = stats.overview(base.limit(0)).first()
    assert empty.total_commands == 0 and empty.avg_per_day == 0.0


def test_stats_all_grouping_sets(spark):
    h = make_history(spark, [(1, "git status", "/a", 0), (2, "git log", "", 3_600_000)])
    got = {(r.dimension, r.label): r["count"] for r in stats.stats_all(h).collect()}
    assert got[("programs", "git")] == 2 and got[("dirs", "/a")] == 1 and ("dirs", None) not in got
    assert got[("hour", "0")] == 1 and got[("categories", "vcs")] == 2


def test_top_n_tiebreak(spark):
    rows = [(i, lbl, "/a", i) for i, lbl in enumerate(["beta", "alpha", "gamma"])]
    base = make_history(spark, rows)
    assert stats.top_list(base, "commands", 3).first().label == "alpha"


def test_prune_cycle(spark):
    h = make_history(spark, [(1, "git status", "/a", 1, "agent"), (2, "rm -rf x", "/a", 2), (3, "ls", "/a", 3)])
    idx = build_index(h)
    empty = spark.createDataFrame([], "hash string, type int, desc string")
    marks = h.filter(F.col("cmd") != "ls").select("hash")
    ann = maintenance.mark_prune(empty, marks)
    ann = maintenance.mark_prune(ann, marks)  # idempotent upsert
    assert ann.count() == 2
    ann = maintenance.unmark_prune(ann, h.filter(F.col("cmd") == "git status").select("hash"))
    assert maintenance.prune_count(h, ann).first().pruned == 1
    new_h, new_idx, new_ann, _ = maintenance.prune_apply(h, idx, ann)
    assert sorted(r.cmd for r in new_h.collect()) == ["git status", "ls"]
    gone = h.filter(F.col("cmd") == "rm -rf x").first().hash
    assert new_idx.filter(F.col("hash") == gone).count() == 0 and new_ann.count() == 0
    assert maintenance.prune_candidates(new_h, ann).count() == 0
