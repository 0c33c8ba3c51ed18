"""Every stage against brute force on its own input."""

import pytest

import corpus_pipeline as C
from shelfwise.llm.common import read, stored
from tests.conftest import SF01
from tests.llm.test_decontam import brute as hits
from tests.llm.test_ngram_join import brute as groups
from tests.llm.test_secret_scan import base as secrets
from tests.llm.test_tokens import check_packing


@pytest.fixture(scope="module")
def stages(spark):
    out = [read(spark, SF01, "documents")]
    for name, stage in C.STAGES:
        out.append(stored(stage(spark, out[-1], SF01), name))
    return out


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_columns_stay(stages):
    assert all(s.dtypes == stages[0].dtypes for s in stages[:-1])


def test_language_keeps_all_that_have_letters(stages):
    kept = rows(stages[1], "doc_id")
    want = [(i,) for i, t in rows(stages[0], "doc_id", "text") if any(c.isalpha() for c in t or "")]
    assert len(want) - len(kept) <= 0.01 * len(want) and set(kept) <= set(want)


def test_one_document_of_each_group_stays(stages):
    want, _ = groups(rows(stages[1], "doc_id", "text"))
    assert rows(stages[2], "doc_id") == [(i,) for i, _, c in want if i == c]


def test_contaminated_documents_go(stages, duck):
    items = duck.sql("select item_id, text from benchmark").fetchall()
    want = sorted((i,) for i, _, hit, _ in hits(rows(stages[2], "doc_id", "text"), items, 10) if not hit)
    assert rows(stages[3], "doc_id") == want and len(want) < stages[2].count()


def test_secrets_are_masked(stages):
    before = dict(rows(stages[3], "doc_id", "text"))
    after = {i: (t, n) for i, t, n in rows(stages[4], "doc_id", "text", "n_chars")}
    assert before.keys() == after.keys() and all(len(t) == n for t, n in after.values())
    changed = [i for i in before if before[i] != after[i][0]]
    assert {i for i in before if secrets(before[i])} <= set(changed)
    for i in changed:
        assert "[SECRET]" in after[i][0] and not secrets(after[i][0])
    assert 0 < len(changed) < 0.2 * len(before)


def test_packing_holds_all_that_is_left(stages):
    check_packing(stages[5].collect(), rows(stages[4], "doc_id", "text"), 2048)


def test_run_gives_the_last_stage(spark, stages):
    assert C.run(spark, SF01).count() == stages[5].count()


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "en", "s", 0), (None, "one two three four five six seven", "en", "s", 3), (2, "12 34", None, None, None),
         (3, "password=abcdef01 and more words than that", "en", "s", 1), (3, "password=abcdef01 and more words than that", "en", "s", 1)],
        "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in C.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF01), name)
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in docs.collect()), key=str) == [
        (3, "[SECRET] and more words than that", 33), (None, "one two three four five six seven", 33)]
    empty = docs.limit(0)
    for name, stage in C.STAGES:
        empty = stored(stage(spark, empty, SF01), name)
    assert empty.count() == 0


def test_rows_that_share_an_id_or_have_none_are_decided_one_by_one(spark):
    item = read(spark, SF01, "benchmark").orderBy("item_id").first().text
    words = ["alpha beta gamma delta epsilon zeta eta theta", "red orange yellow green blue indigo violet black",
             "one two three four five six seven eight nine", "north south east west up down left right"]
    made = [(None, words[0]), (None, words[1]), (7, words[2]), (7, words[3]), (7, item), (None, item)]
    docs = spark.createDataFrame(made, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    unique = stored(C.near_duplicate_stage(spark, docs, SF01), "t")
    assert rows(unique, "text") == sorted((t,) for t in {*words, item})
    clean = C.decontamination_stage(spark, docs, SF01)
    assert rows(clean, "text") == sorted((t,) for t in words)


def test_gibberish_goes(spark):
    import random

    rng = random.Random(4)
    letters = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(150)) for _ in range(20)]
    docs = read(spark, SF01, "documents")
    more = spark.createDataFrame([(-i - 1, t, None, "s", len(t)) for i, t in enumerate(letters)], docs.schema)
    kept = C.language_stage(spark, docs.unionByName(more), SF01)
    assert kept.filter("doc_id < 0").count() == 0
    assert kept.filter("doc_id >= 0").count() >= 0.99 * docs.count()
