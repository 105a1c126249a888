import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = SparkSession.builder.master("local[4]").config("spark.driver.memory", "3g").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", f"{shared}/warehouse").config("spark.checkpoint.dir", f"file://{shared}/checkpoints").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
