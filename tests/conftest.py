import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, os.fspath(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp()).config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp()}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from weftline.runtime import ship

    ship(session)
    yield session
    session.stop()
