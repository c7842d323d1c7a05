import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

FIXTURES = os.path.join(ROOT, "tests", "fixtures")
RESULTS = os.path.join(FIXTURES, "results")
ANNOTATIONS = os.path.join(FIXTURES, "datasets", "ArTest.csv")
SF = os.environ.get("SCORECRAFT_TEST_SF", "/root/testdata/sf0.01")
SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from scorecraft.session import CLUSTER_CONF, checkpoint_dir
    b = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
    for k, v in CLUSTER_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)
    yield s


def rows(df):
    return [tuple(r) for r in df.collect()]
