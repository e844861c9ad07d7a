"""Session helpers: shared folders, file systems by URI, small scans."""

import pytest
from pyarrow import fs

from orrery import session as S


def test_store_takes_the_names_of_hadoop(tmp_path, monkeypatch):
    assert S.store("dbfs:/mnt/x")[1] == "/dbfs/mnt/x"
    for uri in (f"file:{tmp_path}/a", f"file://{tmp_path}/a", f"{tmp_path}/a"):
        where, path = S.store(uri)
        assert isinstance(where, fs.LocalFileSystem) and path == f"{tmp_path}/a"
    asked = []

    class Systems:
        from_uri = asked.append

    monkeypatch.setattr(S.fs, "FileSystem", Systems)
    S.store("s3a://bucket/key")
    S.store("hdfs://host/key")
    assert asked == ["s3://bucket/key", "hdfs://host/key"]


def test_no_local_folder_on_a_cluster(spark):
    class Conf:
        @staticmethod
        def get(*_):
            return None

    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return Conf

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        S.shared_dir(Session)
    Context.master = "local[8]"
    assert S.shared_dir(Session) == S.LOCAL_CHECKPOINTS


def test_only_small_scans_are_dealt_out(spark, sf, monkeypatch):
    docs = S.table(spark, sf, "documents")
    assert S.spread(docs).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    monkeypatch.setattr(S, "SPREAD_BYTES", 0)
    assert S.spread(docs) is docs
