from types import SimpleNamespace

import pytest

from placebook import session


def fake(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default: folder or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app"))


def test_the_named_folder_is_used():
    assert session.shared_folder(fake("yarn", "hdfs://x/checkpoints/")) == "hdfs://x/checkpoints"
    assert session.new_folder(fake("yarn", "hdfs://x"), "hits").startswith("hdfs://x/placebook/hits-")


def test_a_folder_is_always_needed():
    for master in ("yarn", "local[2]", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_folder(fake(master))


def test_queries_bring_a_folder_only_to_runs_of_one_process(monkeypatch):
    import __spark_entry__ as entry

    for master, known, given in (("local[2]", {}, True), ("local", {}, True), ("local-cluster[2,1,1024]", {}, False), ("local[2]", {"spark.checkpoint.dir": "/x"}, False)):
        conf = dict(known)
        spark = SimpleNamespace(conf=SimpleNamespace(get=conf.get, set=conf.__setitem__), sparkContext=SimpleNamespace(master=master))
        entry._with_folder(lambda spark, sf_dir: None)(spark, "")
        assert (session.FOLDER in conf) == given


def test_stored_rows_come_back(spark):
    df = spark.sql("select 1 as a, array('x', null) as b, cast(null as string) as c")
    stored = session.materialize(df, "test")
    assert stored.collect() == df.collect() and stored.dtypes == df.dtypes
