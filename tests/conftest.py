import os
import tempfile

import pytest

from trailtally.session import get_session

DEFAULT_DATA = "/root/testdata/sf0.01"
DATA = os.environ.get("TRAILTALLY_DATA", DEFAULT_DATA)


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "trailtally-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="trailtally-checkpoints-"),
            "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="trailtally-warehouse-"),
            "spark.sql.maxMetadataStringLength": "2000",
            "spark.driver.memory": "8g",
            "spark.driver.bindAddress": "127.0.0.1",
            "spark.driver.host": "127.0.0.1",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA
