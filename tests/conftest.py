from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from silvaspark.session import builder

    base = tmp_path_factory.mktemp("spark")
    session = (
        builder("local[4]", 4)
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .config("spark.checkpoint.dir", f"file://{base}/shared")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.hadoop.javax.jdo.option.ConnectionURL", "jdbc:derby:memory:x;create=true")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
