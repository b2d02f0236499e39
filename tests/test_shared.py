from types import SimpleNamespace

import pytest

from crestline import shared


def session(master, folder=None):
    conf = SimpleNamespace(get=lambda name, default: folder if name == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))


def test_only_a_local_session_gets_a_folder_of_its_own():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="checkpoint.dir"):
            shared.shared_dir(session(master))
        assert shared.shared_dir(session(master, "hdfs://x/y/")) == "hdfs://x/y"
    own = shared.shared_dir(session("local[4]"))
    assert own.startswith("file:///") and own == shared.shared_dir(session("local[4]"))


def test_tables_are_written_read_and_cleared(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (None, "x")], "a int, b string")
    kept = shared.written(rows, "t")
    assert sorted(map(str, kept.collect())) == sorted(map(str, rows.collect())) and kept.schema == rows.schema
    assert shared.written(rows.where("false"), "t").collect() == []
    from pathlib import Path

    folder = Path(shared.scratch(spark, "x").removeprefix("file://")).parent
    assert list(folder.iterdir())
    shared.drop_written(kept)
    assert not Path(kept.written_to.removeprefix("file://")).exists()
    shared.drop_written(rows.withColumnRenamed("a", "written_to"))
    shared.delete(spark, f"file://{folder}/never-was")
    shared.clear_scratch(spark)
    assert not folder.exists()
