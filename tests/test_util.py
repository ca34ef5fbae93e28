import pytest
from pyspark.sql import functions as F

from cmdlens.operators.util import materialize, with_position
from cmdlens.session import ensure_checkpoint_dir


def test_materialize_cuts_lineage(spark):
    assert ensure_checkpoint_dir(spark)
    df = spark.range(100).selectExpr("id", "id * 2 AS twice").filter("id % 3 = 0")
    m = materialize(df)
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan and "Range" not in plan           # reads the files, not the lineage
    assert sorted(tuple(r) for r in m.collect()) == sorted(tuple(r) for r in df.collect())


def test_with_position_numbers_rows_in_order(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("k"))
    got = {r.k: r.pos for r in with_position(df, [F.col("k").desc()]).collect()}
    assert got == {k: 1000 - k for k in range(1000)}
    assert with_position(df.limit(0), [F.col("k").asc()]).count() == 0


def test_checkpoint_folder_is_required_off_local(spark, monkeypatch):
    import cmdlens.session as S

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        S.ensure_checkpoint_dir(Session())


def test_release_scratch_deletes_own_tables(spark):
    import os

    import cmdlens.session as S
    m = materialize(spark.range(5), "gone")
    folder = m.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    kept, S._SCRATCH[:] = S._SCRATCH[:-1], S._SCRATCH[-1:]
    assert os.path.isdir(folder) and S.release_scratch(spark) == 1 and not os.path.exists(folder)
    S._SCRATCH[:] = kept
