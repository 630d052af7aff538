import pytest

from heronry import tables


def test_kept_tables_follow_their_source(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    built = []

    def get():
        source = spark.read.parquet(path)
        return tables.kept(source, "doubled", lambda: built.append(1) or source.selectExpr("id * 2 as x"))

    spark.range(3).write.parquet(path)
    assert sorted(r.x for r in get().collect()) == [0, 2, 4] == sorted(r.x for r in get().collect()) and len(built) == 1
    spark.range(5, 6).write.mode("overwrite").parquet(path)
    assert [r.x for r in get().collect()] == [10] and len(built) == 2


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        tables.shared_dir(Session())
