import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from shelfwise.session import ensure_checkpoint_dir, get_session

    s = get_session(master="local[8]", shuffle_partitions=8,
                    extra={"spark.driver.memory": "8g"})
    ensure_checkpoint_dir(s, tempfile.mkdtemp(prefix="shelfwise-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents "
              "embeddings pages benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return con


@pytest.fixture(scope="session")
def skewed_base(spark):
    """sf0.01 tables with a third of all lines on one product, a third of all
    orders on one customer and a third of all events on one user."""
    from .test_skew import make_skewed_copy
    return make_skewed_copy(spark)
