"""The SQL of the operators that SQL can express gives what brute force gives
(and with it, by the tests of each operator, what the queries give)."""

import hashlib

from shelfwise.llm.queries import ORACLE
from tests.llm.test_decontam import brute as hits
from tests.llm.test_ngram_join import brute as groups
from tests.llm.test_substring import brute as spans


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_sql_equals_brute_force(duck):
    docs = duck.sql("select doc_id, text from documents").fetchall()
    items = duck.sql("select item_id, text from benchmark").fetchall()
    want = {
        "op1_substring_dedup": [(i, n, r, sha(k)) for i, n, r, k in spans(docs, 20)],
        "op3_benchmark_decontamination": [(i, n, h, len(f), sha(",".join(f)), h > 0) for i, n, h, f in hits(docs, items, 10)],
        "op7_ngram_jaccard_join": groups(docs)[0],
    }
    assert want.keys() == ORACLE.keys()
    for name, rows in want.items():
        assert sorted(duck.sql(ORACLE[name]).fetchall()) == sorted(rows), name
