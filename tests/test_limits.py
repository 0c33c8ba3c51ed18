"""ST-1 with moving windows: brute force, hot keys, and the stream against the batch."""

import datetime as dt
import os
import random
import tempfile

import pytest

from shelfwise.operators import scan
from shelfwise.plans.registry import ORACLE, QUERIES
from shelfwise.schemas import SOURCE_SCHEMAS
from shelfwise.streaming import jobs
from shelfwise.streaming import limits as L

from .compare import compare
from .conftest import SF01

START = dt.datetime(2024, 1, 1)
MINUTE = dt.timedelta(minutes=1)


def calls(seed, n=400, span=3600):
    rnd = random.Random(seed)
    at = lambda: START + dt.timedelta(seconds=rnd.randrange(span), microseconds=rnd.choice([0, 0, 1, 999_999]))
    # half of all calls are of one key; seconds repeat, so moments do
    return [(i, at(), 5 if rnd.random() < 0.5 else rnd.randrange(4), rnd.choice(["log-in", "reset", "free"]), 0.0, None) for i in range(n)]


def brute(rows, limit, window, route=False):
    key = (lambda r: (r[2], r[3])) if route else (lambda r: (r[2],))
    found = set()
    for r in rows:
        if r[1] is None or route and r[3] not in limit:
            continue
        mine = [x for x in rows if x[1] is not None and key(x) == key(r) and r[1] - window < x[1] <= r[1]]
        if len(mine) > (limit[r[3]] if route else limit):
            found.add((r[1], *key(r), sum(x[1] == r[1] for x in mine), len(mine)))
    return sorted(found, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_batch_equals_brute_force(spark):
    rows = calls(1) + [(900, START, None, "log-in", 0.0, None), (901, START, None, "log-in", 0.0, None), (902, None, 5, None, 0.0, None)]
    ev = spark.createDataFrame(rows, SOURCE_SCHEMAS["events"])
    got = rows_of(L.over_moving_limit(ev, limit=4, window="1 minute"))
    assert got == brute(rows, 4, MINUTE) and len(got) > 10
    # a call exactly one window earlier is outside
    pair = spark.createDataFrame([(1, START, 1, "x", 0.0, None), (2, START + MINUTE, 1, "x", 0.0, None)], SOURCE_SCHEMAS["events"])
    assert L.over_moving_limit(pair, limit=1, window="1 minute").count() == 0
    assert L.over_moving_limit(pair, limit=1, window="61 seconds").count() == 1
    limits = {"log-in": 3, "reset": 2}
    got = rows_of(L.over_moving_limit(ev, limit=limits, window="2 minutes", route="event_type"))
    assert got == brute([r for r in rows if r[3]], limits, 2 * MINUTE, route=True) and len(got) > 10
    assert L.over_moving_limit(ev.limit(0)).count() == 0
    with pytest.raises(ValueError):
        L.window_micros("0 seconds")


def test_a_hot_key_is_cut(spark, monkeypatch):
    rows = calls(2, n=3000)
    ev = spark.createDataFrame(rows, SOURCE_SCHEMAS["events"])
    whole = rows_of(L.over_moving_limit(ev, limit=20, window="1 minute"))
    cuts = []
    real = scan.splitters
    monkeypatch.setattr(scan, "splitters", lambda *a, **k: cuts.append(real(*a, **k)) or cuts[-1])
    monkeypatch.setattr(L, "ROWS", 400)
    assert rows_of(L.over_moving_limit(ev, limit=20, window="1 minute")) == whole and whole
    assert cuts[-1] is not None and cuts[-1].table.count() >= 1


@pytest.mark.parametrize("name", ["over_moving_limit_daily", "over_moving_route_limits"])
def test_queries(spark, duck, name):
    got = QUERIES[name](spark, SF01)
    assert not compare(got, duck, ORACLE[name]) and got.count() > 0


@pytest.mark.parametrize("route", [None, "event_type"])
def test_stream_equals_batch(spark, route):
    """Calls out of order by less than the watermark, in several micro-batches; a last
    call far ahead moves the watermark past all others."""
    tmp = tempfile.mkdtemp(prefix="sw-moving-")
    rnd = random.Random(3)
    rows = sorted(calls(4), key=lambda r: r[1] + dt.timedelta(seconds=rnd.uniform(-250, 250)))
    end = (999, START + dt.timedelta(days=1), 77, "free", 0.0, None)
    for i in range(5):
        part = rows[i * 80:(i + 1) * 80]
        spark.createDataFrame(part, SOURCE_SCHEMAS["events"]).coalesce(1).write.parquet(f"{tmp}/ev/p{i}")
        for f in os.listdir(f"{tmp}/ev/p{i}"):
            os.utime(f"{tmp}/ev/p{i}/{f}", (1_700_000_000 + i, 1_700_000_000 + i))
    spark.createDataFrame([end], SOURCE_SCHEMAS["events"]).coalesce(1).write.parquet(f"{tmp}/ev/p9")
    limit = {"log-in": 3, "reset": 2} if route else 4
    q = jobs.start_over_moving_limit(spark, f"{tmp}/ev", f"{tmp}/out", f"{tmp}/ck", limit=limit, route=route, watermark="10 minutes",
                                     max_files_per_trigger=1, trigger={"availableNow": True})
    q.awaitTermination(300)
    ev = spark.createDataFrame(rows, SOURCE_SCHEMAS["events"])
    want = rows_of(L.over_moving_limit(ev, limit=limit, window="1 minute", route=route))
    assert rows_of(spark.read.parquet(f"{tmp}/out")) == want and len(want) > 5
    # what is left in the state is the last call's key
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8
