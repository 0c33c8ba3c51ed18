"""Written steps: what they leave behind."""

import re
import time

from shelfwise.llm.common import drop, stored


def _shuffles(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    return set(re.findall(r"shuffle_(\d+)_", env.blockManager().diskBlockManager().getAllFiles().mkString(" ")))


def test_shuffle_files_go_with_the_step(spark):
    """Also those of the step that has just been written."""
    before = _shuffles(spark)
    df = spark.range(0, 5000, 1, 4).selectExpr("id % 7 AS k", "id").repartition(5, "k")
    t = stored(df, "test")
    end = time.time() + 5
    while _shuffles(spark) - before and time.time() < end:
        time.sleep(0.1)
    assert not _shuffles(spark) - before
    assert t.count() == 5000
    drop(t)
