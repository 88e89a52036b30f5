import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from reelspark.session import DEFAULT_CONF

    ckpt = tempfile.mkdtemp(prefix="reelspark-test-ckpt-")
    b = SparkSession.builder.master("local[4]").appName("reelspark-tests")
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    s = (b.config("spark.sql.shuffle.partitions", "8")
         .config("spark.checkpoint.dir", ckpt).getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(ckpt)
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path(tmp_path):
    return str(tmp_path)
