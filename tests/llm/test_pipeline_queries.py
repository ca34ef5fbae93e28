import os

import pytest

import corpus_pipeline
from cmdlens.llm import chunk_dedup, feistel_pii, queries, simhash_dedup, suffix_quality
from cmdlens.llm.queries import PSEUDONYM_KEY
from tests.conftest import SMOKE_DIR

from .cases import awkward, frame


def through(spark, docs, tmp_path):
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    return docs


def test_pipeline_awkward_rows(spark, tmp_path):
    df = frame(spark, awkward())
    pieces = through(spark, df, tmp_path)
    good = {(r.doc_id, r.text) for r in suffix_quality.keep_good(df).collect()}
    after = spark.read.parquet(str(tmp_path / "2")).collect()
    # one row of each group, and only rows that passed the rules
    assert len({(r.doc_id, r.text) for r in after}) == len(after) and {(r.doc_id, r.text) for r in after} <= good
    assert chunk_dedup.deduplicate(spark.read.parquet(str(tmp_path / "2"))).filter("not kept").count() == 0
    fps = [r.component_id for r in simhash_dedup.near_duplicates(spark.read.parquet(str(tmp_path / "2"))).collect()]
    assert len(fps) == len(set(fps))
    clean = spark.read.parquet(str(tmp_path / "3"))
    assert sorted(str(r.text) for r in clean.collect()) == sorted(
        str(r.text) for r in feistel_pii.pseudonymise(spark.read.parquet(str(tmp_path / "2")), PSEUDONYM_KEY).collect())
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in clean.collect()}


def test_pipeline_empty_table(spark, tmp_path):
    assert through(spark, frame(spark, []), tmp_path).count() == 0


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, SMOKE_DIR)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from tests.oracle_compare import compare, duck_connect
    con = duck_connect(SMOKE_DIR) if os.path.isdir(SMOKE_DIR) else duckdb.connect()
    result = compare(spark, con, name, queries.QUERIES[name], queries.ORACLE[name], SMOKE_DIR)
    assert result["ok"], result


def test_op3_returns_the_ids(spark):
    import struct
    import zlib
    rows = queries.op3_piece_fst(spark, SMOKE_DIR).collect()
    assert rows and sum(r.n_ids for r in rows) > 0
    for r in rows:
        assert len(r.ids) == r.n_ids and zlib.crc32(struct.pack(f"<{r.n_ids}I", *r.ids)) == r.ids_crc32
