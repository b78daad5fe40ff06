from __future__ import annotations

import pytest

from folioscope.cluster import new_run_dir, remove_run_dirs, settle, shared_dir


class Session:
    def __init__(self, master, configured=""):
        self.sparkContext = type("Context", (), {"master": master, "applicationId": master})
        self.conf = {"spark.checkpoint.dir": configured} if configured else {}


def test_the_configured_folder_is_used():
    session = Session("spark://host", "hdfs://shared/x/")
    assert shared_dir(session) == "hdfs://shared/x"
    one, two = new_run_dir(session, "a"), new_run_dir(session, "a")
    assert one.startswith("hdfs://shared/x/spark://host/a-") and one != two


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session("spark://host"))


def test_a_local_session_falls_back_to_its_warehouse():
    session = Session("local[2]")
    session.conf["spark.sql.warehouse.dir"] = "/somewhere/warehouse"
    assert shared_dir(session) == "/somewhere/warehouse/_runs"


def test_settled_tables_go_with_the_application(spark):
    path = new_run_dir(spark, "kept")
    assert settle(spark.range(3), path).count() == 3
    remove_run_dirs(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
