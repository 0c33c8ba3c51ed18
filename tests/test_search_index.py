"""FLT-6 by index equals the plain search for every term."""

import random
import re
import tempfile

import pytest

from shelfwise.operators.catalog import search
from shelfwise.operators.search_index import TextIndex
from shelfwise.plans.registry import ORACLE, QUERIES

from .compare import compare
from .conftest import SF01

ROWS = [(1, "Red Chair", "A chair, red"), (2, "trolley", None), (3, None, "Économie – éco"), (4, "", ""), (5, "aa", "aaaa aaaa"),
        (6, "x😀y", "line\nbreak"), (7, "red", "sofa of 100% wool_"), (8, "DRESSER", "Redwood  chair")]


def ids(df):
    return sorted(r.id for r in df.collect())


def test_query(spark, duck):
    got = QUERIES["search_by_index"](spark, SF01)
    assert not compare(got, duck, ORACLE["search_by_index"]) and got.filter("term = 'd widge'").count() > 0


@pytest.fixture(scope="module")
def indexed(spark):
    products = spark.createDataFrame(ROWS, "id long, name string, description string")
    index = TextIndex(spark, tempfile.mkdtemp(prefix="sw-index-") + "/i", parts=8)
    index.build(products)
    return index, products


def test_every_kind_of_term(spark, indexed):
    index, products = indexed
    rnd = random.Random(2)
    texts = [t for _, a, b in ROWS for t in (a, b) if t]
    terms = {t[i:i + n] for t in texts for n in (1, 2, 3, 5, 9) for i in [rnd.randrange(max(1, len(t) - n + 1))]}
    # a term over the two fields of a product, one that shares its grams only, and the odd ones
    terms |= {"chaira", "edr", "aaaaa", "RED", "É", "%", "_", "\n", "😀y", "k  ", "zzz", "zz zz", " ", "d", None, ""}
    for term in terms:
        assert ids(index.search(products, term)) == ids(search(products, term)), repr(term)


def test_only_the_folders_of_the_grams_are_read(spark, indexed):
    index, _ = indexed
    found = index.candidates("chair")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gram" in plan or "In(gram" in plan
    parts = set(index._grams_of("chair").values())
    assert re.search(r"PartitionFilters: \[part#\d+ IN \(|PartitionFilters: \[isnotnull\(part", plan)
    assert 0 < len(parts) < 8 and sorted(r.key for r in found.collect()) == [1, 8]


def test_a_posting_for_each_place(spark, indexed):
    index, products = indexed
    postings = spark.read.parquet(f"{index.path}/postings")
    # no more than characters: short terms are the starts of grams, not grams of their own
    most = products.selectExpr("sum(coalesce(length(name), 0) + coalesce(length(description), 0))").first()[0]
    assert 0 < postings.count() <= most
    assert sorted(r.key for r in index.candidates("c").collect()) == ids(search(products, "c"))
