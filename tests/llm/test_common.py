import os

import pytest

from corpusloom.llm import _common


def test_staging_and_clearing(spark):
    df = _common.staged(spark.range(5))
    path = _common._written[-1].removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(path)
    _common.clear_staged(spark)
    assert not os.path.isdir(path) and not _common._written


def test_a_cluster_must_name_its_shared_folder():
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda name, default: default)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getConf": staticmethod(dict)})

    with pytest.raises(ValueError, match="checkpoint"):
        _common.shared_dir(Session)
