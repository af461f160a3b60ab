import pytest
from pyspark.sql import SparkSession

#: Few partitions, as the tables are small; work tables go to a folder of the run.
CONF = {"spark.sql.shuffle.partitions": "2", "spark.default.parallelism": "2", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = f"file://{tmp_path_factory.mktemp('shared')}"
    s = SparkSession.builder.master("local[4]").config(map=CONF).config("spark.checkpoint.dir", shared).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s
