from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    """A session with a shared folder of its own, in which the tests leave nothing but what results still need."""
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]").appName("undertow-tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(shared)).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    from undertow.sources.stage import clear_stages

    clear_stages(session)
    left = [p for p in shared.rglob("*") if p.is_file()]
    session.stop()
    assert not left


@pytest.fixture(scope="session")
def sf() -> str:
    return "/root/testdata/sf0.001"
