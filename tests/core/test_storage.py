from types import SimpleNamespace

import pytest

from lexigrid.functions.storage import shared_folder


def session(master, **conf):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, default=None: conf.get(k.replace(".", "_"), default)), sparkContext=SimpleNamespace(master=master))


def test_shared_folder():
    assert shared_folder(session("yarn", spark_checkpoint_dir="hdfs://x/y/")) == "hdfs://x/y"
    assert shared_folder(session("local[4]", spark_sql_warehouse_dir="file:/w")) == "file:/w/shared"
    assert shared_folder(session("spark://h:1", spark_sql_warehouse_dir="s3a://b/w")) == "s3a://b/w/shared"
    for folder in ("file:/w", "/w"):
        with pytest.raises(ValueError):
            shared_folder(session("spark://h:1", spark_sql_warehouse_dir=folder))
