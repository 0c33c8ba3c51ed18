"""op4 against Python's patterns, and the battery on known strings."""

import hashlib
import random
import re
import string

from shelfwise.llm import secret_scan as S
from shelfwise.llm.queries import QUERIES
from tests.conftest import SF01

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
OTHERS = (("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24))


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for kind, (_, pattern, least) in enumerate(OTHERS, 1):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)


def written(spans):
    return ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_whole_table(spark, duck):
    rows = dict(duck.sql("select doc_id, text from documents").fetchall())
    got = QUERIES["op4_secret_scan"](spark, SF01).collect()
    assert len(got) == len(rows) and sum(r.n_assign for r in got) > 5
    for r in got:
        b = base(rows[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in b) for n in range(3)]
        assert r.base_sha256 == hashlib.sha256(written(b).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [x for x in spans if not x.startswith("random")] == [x for x in written(b).split(",") if x]


EDGES = [(1, None), (2, ""), (3, "password: token: abcdefgh"), (3, "password: token: abcdefgh"), (None, "é API_KEY='abc123xyz'"),
         (5, "\U0001f600 ab AKIA" + "A" * 16 + " AKIAAKIA" + "B" * 14), (6, ("deadbeef" * 4 + " ") * 300), (7, "apikey=short SECRET = x=y=z=w"),
         (8, "f" * 24 + "g" + "0" * 23), (9, "x " * 40000 + "passwd:'hunter22'"), (10, "token=1234567token=7654321 " * 2)]


def test_edges(spark):
    df = spark.createDataFrame(EDGES, "doc_id long, text string").selectExpr("*", "1 AS row", "'a' AS base", "2 AS kind")
    got = sorted(([r.doc_id, [tuple(x) for x in r.base]] for r in S.scan(df).collect()), key=str)
    assert got == sorted(([i, base(t)] for i, t in EDGES), key=str)
    assert S.scan(df.limit(0)).count() == 0


def test_masks_exactly_the_spans(spark):
    df = spark.createDataFrame(EDGES, "doc_id long, text string").withColumn("lang", S.F.lit("en"))
    got = {(r.doc_id, r.text) for r in S.masked(df).collect()}

    def mask(text):
        out, at = "", 0
        for s, _, e in base(text):
            if s >= at:
                out += text[at:s] + "[SECRET]"
            at = max(at, e)
        return None if text is None else out + text[at:]

    assert got == {(i, mask(t)) for i, t in EDGES}


def test_battery_tells_random_from_text(spark):
    rng = random.Random(3)
    letters, words = string.ascii_letters + string.digits, "the of and tion er ing re on th nd ed ou ha es st".split()
    rows = [("random", "".join(rng.choice(letters) for _ in range(40))) for _ in range(150)]
    rows += [("random", "".join(rng.choice("0123456789abcdef") for _ in range(64))) for _ in range(150)]
    rows += [("text", "".join(rng.choice(words) for _ in range(16))) for _ in range(1500)]
    rows += [("text", "ABCD" * 10), ("text", letters), ("text", "a" * 64), ("text", "0123456789" * 5)] * 20
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "row long, kind string, token string")
    found = S.discoveries(S.stored(S.battery(df), "tested")).groupBy("kind").count().collect()
    found = {r["kind"]: r["count"] for r in found}
    assert found["random"] > 285 and found.get("text", 0) <= 0.01 * found["random"]


def test_the_main_path_has_no_python(spark):
    plan = QUERIES["op4_secret_scan"](spark, SF01)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_decimal_runs_leave_the_threshold_of_keys_alone(spark):
    from shelfwise.llm import secret_scan

    keys = [("base62", 40.0, 3.0, 0.5)] + [("base62", 40.0, 0.0, 0.5)] * 4
    numbers = [("decimal", 40.0, 0.0, 0.5)] * 1000
    df = spark.createDataFrame(keys + numbers, "encoding string, length double, evidence double, randomness double")
    assert [(r.encoding, r.evidence) for r in secret_scan.discoveries(df).collect()] == [("base62", 3.0)]


def test_masked_keeps_columns_of_any_name(spark):
    rows = [(1, "password=hunter2hunter2 end", "keep", 7), (2, "nothing here", None, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string, _spans int")
    got = sorted(map(tuple, S.masked(df).collect()))
    assert got == [(1, "[SECRET] end", "keep", 7), (2, "nothing here", None, 8)]
