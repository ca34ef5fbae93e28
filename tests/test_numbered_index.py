"""A trigram index keyed by the commands' numbers: narrow rows, same answers."""

import pytest

from cmdlens.operators import index
from cmdlens.operators.ingest import ingest
from cmdlens.sources import store

from .conftest import make_events


def log(spark):
    """Times repeat, so ties go by hash; ``ls`` is a keyword of two bytes."""
    words = ["git status", "git commit -m fix", "ls", "ls -la", "make build", "docker ps view"]
    rows = [(i, f"{words[i % 6]} {i // 12}" if i % 5 else words[i % 6], f"/p{i % 3}" if i % 4 else "", 1000 + i % 7)
            for i in range(120)]
    return ingest(make_events(spark, rows))


def asked(spark):
    return spark.createDataFrame(
        [("a", ["git", "status"], ""), ("b", ["view", "7"], "/p1"), ("c", ["ls"], "/p2"), ("d", ["make", "1"], "/none"),
         ("e", ["commit"], None), ("f", ["zzz"], "")], "qid string, keywords array<string>, cwd string")


def test_numbers_rise_from_the_newest(spark):
    rows = index.numbered(log(spark)).orderBy("seq").collect()
    assert len({r.seq for r in rows}) == len(rows) > 50
    assert [(-r.ts_ms, r.hash) for r in rows] == sorted((-r.ts_ms, r.hash) for r in rows)


def test_index_by_number_gives_the_same_hits(spark, tmp_path):
    h = index.numbered(log(spark))
    store.write_index(index.build_index(h, key_col="seq"), str(tmp_path / "idx"))
    stored = spark.read.parquet(str(tmp_path / "idx"))
    assert dict(stored.dtypes) == {"ngram": "int", "seq": "bigint"}     # 12 bytes a row, no hash
    by_hash = index.build_index(h.drop("seq"))
    want = sorted(map(str, index.batch_search(h.drop("seq"), asked(spark), 4, index=by_hash).collect()))
    assert len(want) > 10
    for hist, idx in ((h, stored), (h.drop("seq"), None), (h, by_hash)):
        assert sorted(map(str, index.batch_search(hist, asked(spark), 4, index=idx).collect())) == want


def test_index_by_number_needs_its_history(spark):
    h = index.numbered(log(spark))
    with pytest.raises(ValueError, match="numbered"):
        index.batch_search(h.drop("seq"), asked(spark), index=index.build_index(h, key_col="seq"))


def test_registered_query_stores_numbers(spark, monkeypatch):
    """batch_search_indexed: the index on disk and its sort hold no 64-character hashes."""
    import __spark_entry__ as E

    seen = []
    write = store.write_index
    monkeypatch.setattr(store, "write_index", lambda idx, path: (seen.append(dict(idx.dtypes)), write(idx, path)))
    assert E.queries()["batch_search_indexed"](spark, "/root/testdata/sf0.001").count() > 0
    assert seen and all("string" not in d.values() for d in seen)


def test_repeated_rows_of_a_command_count_once(spark):
    rows = [("g", "", f"h{i}", 10 - i, 3) for i in range(4) for _ in range(5)]
    df = spark.createDataFrame(rows, "gk string, place string, hash string, ts_ms long, rank long")
    assert sorted(r.hash for r in index._best(df, 3).collect()) == ["h0", "h1", "h2"]
