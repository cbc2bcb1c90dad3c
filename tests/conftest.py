import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-tests-")).config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    yield session
    session.stop()
