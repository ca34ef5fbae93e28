"""The bounded top-k join of batch search: exact, and no more rows than the queries and their hits call for."""

import random

import pytest

from cmdlens.operators import index
from cmdlens.sources import fixtures
from cmdlens.operators.ingest import ingest
from cmdlens.operators.util import materialize


def brute(commands, sets, n):
    """commands: hash -> (cwd, ts, grams); sets: (gk, place) -> grams."""
    out = []
    for (gk, place), grams in sets.items():
        rows = [(-len(g & grams), -ts, h) for h, (cwd, ts, g) in commands.items() if g & grams and place in ("", cwd)]
        out += [(gk, place, h, -ts, -rank) for rank, ts, h in sorted(rows)[:n]]
    return sorted(out)


@pytest.mark.parametrize("seed,n", [(1, 1), (2, 3), (3, 5), (4, 50)])
def test_ranked_top_is_exact(spark, seed, n):
    """Skewed trigrams, many ties of rank and time, rare and frequent mixed, places with few and many rows."""
    r = random.Random(seed)
    def gram():
        return min(int(r.paretovariate(0.6)), 60)
    commands = {f"h{i:04d}": (r.choice(["", "/a", "/a", "/b"]), r.randrange(40), {gram() for _ in range(r.randrange(1, 12))}) for i in range(400)}
    sets = {(f"g{k}", p): grams for k in range(40)
            for grams in [{gram() for _ in range(r.randrange(1, 9))} | ({99} if k % 7 == 0 else set())] for p in ("", "/a", "/b", "/none")[:r.randrange(1, 5)]}
    idx = spark.createDataFrame([(g, h) for h, (_, _, gs) in commands.items() for g in gs], "ngram int, hash string")
    places = spark.createDataFrame([(h, cwd, ts) for h, (cwd, ts, _) in commands.items()], "hash string, cwd string, ts_ms long")
    asked = spark.createDataFrame([(k, p, g) for (k, p), gs in sets.items() for g in gs], "gk string, place string, ngram int")
    got = sorted(tuple(x) for x in index.ranked_top(idx, places, asked, n).select("gk", "place", "hash", "ts_ms", "rank").collect())
    assert got == brute(commands, sets, n)


def joined_rows(spark, sf_dir, n=5):
    """Rows of the bounded joins, and of the join of every set with every command that shares a trigram."""
    ev = fixtures.load(spark, sf_dir, "events")
    h = materialize(ingest(fixtures.command_events(ev)))
    q = index._query_keys(fixtures.search_queries(ev))
    sets = materialize(q.selectExpr("gk", "'' AS place", "explode(_grams) AS ngram").distinct())
    idx = materialize(index.build_index(h))
    postings = index.asked_postings(idx, sets, h.select("hash", "cwd", "ts_ms"))
    first = materialize(index.first_candidates(postings, sets, n))
    grams = postings.groupBy("hash").agg({"ngram": "collect_set"}).toDF("hash", "has")
    wants = sets.groupBy("gk", "place").agg({"ngram": "collect_set"}).toDF("gk", "place", "wants")
    ranked = materialize(first.join(grams, "hash").join(wants, ["gk", "place"]).selectExpr(
        "gk", "place", "hash", "ts_ms", "size(array_intersect(has, wants)) AS rank"))
    bounded = first.count() + index.further_candidates(postings, sets, ranked, n).count()
    return bounded, idx.join(sets, "ngram").count(), sets.select("gk").distinct().count()


def test_joined_rows_follow_the_queries(spark):
    small, small_all, small_sets = joined_rows(spark, "/root/testdata/sf0.001")
    large, large_all, large_sets = joined_rows(spark, "/root/testdata/sf0.01")
    print("bounded", small, large, "all pairs", small_all, large_all, "sets", small_sets, large_sets)
    assert large_sets > 5 * small_sets and large_all > 50 * small_all      # the data do grow
    # rows per set stay what the limit and a set's few trigrams ask for
    assert large / large_sets < 1.5 * small / small_sets
    assert large < 0.2 * large_all


def test_frequent_trigrams_that_seldom_meet(spark):
    """Two frequent trigrams, together in a few old commands: the join meets these, not every posting of one."""
    rows = [(1 if i % 2 else 2, f"h{i:05d}") for i in range(4000)] + [(g, f"old{i}") for i in range(6) for g in (1, 2)]
    idx = spark.createDataFrame(rows, "ngram int, hash string")
    hashes = sorted({h for _, h in rows})
    places = spark.createDataFrame([(h, "", 1000 + i if h[0] == "h" else i) for i, h in enumerate(hashes)], "hash string, cwd string, ts_ms long")
    sets = spark.createDataFrame([(f"g{k}", "", g) for k in range(3) for g in (1, 2)], "gk string, place string, ngram int")
    postings = index.asked_postings(idx, sets, places)
    first = materialize(index.first_candidates(postings, sets, 5).selectExpr("gk", "place", "hash", "ts_ms", "rank"))
    assert {r.rank for r in first.collect()} == {2} and first.count() == 15
    assert index.further_candidates(postings, sets, first, 5).count() <= 3
