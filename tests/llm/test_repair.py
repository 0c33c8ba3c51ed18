"""op11 against a search over all edits, and conversations in many segments."""

import hashlib
import heapq
import itertools
import re
import zlib

from pyspark.sql import functions as F

from shelfwise.llm import repair as R
from shelfwise.llm.queries import QUERIES
from tests.conftest import SF01

WHITE = " \t\n\x0b\f\r"
NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}
STATE = {"s": 1, "u": 2, "a": 3}
OPEN = {0: "su", 1: "u", 2: "a", 3: "u"}


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        rest = text.strip(WHITE)
        out.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def search(rows, faults):
    """Least (cost, audit) by a search over rows done and roles written."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            return cost, audit
        heapq.heappush(heap, (cost + 3, audit + "I", i, STATE[NEXT[state]]))
        if i < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state))
            if faults[i] not in ("blank", "duplicate"):
                late = 3 * (faults[i] == "truncated")
                heapq.heappush(heap, (cost + 3 + late, audit + "R", i + 1, STATE[NEXT[state]]))
                if rows[i][0][:1] and rows[i][0][0] in OPEN[state]:
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, STATE[rows[i][0][0]]))


def written(rows, audit):
    out, i, last = [], 0, ""
    for e in audit:
        if e == "D":
            i += 1
            continue
        role = rows[i][0] if e == "K" else "assistant" if last == "u" else "user"
        out.append(f"{role}:{'' if e == 'I' else rows[i][1]}")
        last, i = role[0], i + (e != "I")
    return "\n".join(out)


def expected(conv, rows):
    """``rows``: (turn, role, text) after damage, any order."""
    rows = sorted(((t is not None, t or 0, r, x) for t, r, x in rows))
    turns = {t for known, t, _, _ in rows if known}
    rows = [(r, x) for _, _, r, x in rows]
    faults = faults_of(rows)
    cost, audit = search(rows, faults)
    letters = [r[:1] for r, _ in rows]
    return (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:])), cost, audit,
            hashlib.sha256(written(rows, audit).encode()).hexdigest())


def damaged(conv, turn, role, text):
    role, text = " " if role is None else role, " " if text is None else text
    kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    if kind == 0:
        return []
    if kind in (1, 2):
        text = "" if kind == 1 else re.sub("[.!?]", "", text)
    return [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def all_expected(table, damage=True):
    by_conv = {}
    for conv, turn, role, text in table:
        by_conv.setdefault(conv, []).extend(damaged(conv, turn, role, text) if damage else
                                              [(turn, " " if role is None else role, " " if text is None else text)])
    return in_order(expected(c, rows) for c, rows in by_conv.items())


def test_whole_table(spark, duck):
    table = duck.sql("select conv_id, turn, role, text from conversations").fetchall()
    assert in_order(QUERIES["op11_conversation_repair"](spark, SF01).collect()) == all_expected(table)


def test_matrices_against_every_edit_sequence():
    """Sequences of up to two symbols: all edit strings of up to six letters."""
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "d": "user"}
    own = R.Grammar(["ua", "Ud"])
    for symbols in itertools.chain.from_iterable(itertools.product(R.SYMBOLS, repeat=n) for n in range(3)):
        found = []
        for n in range(7):
            for edits in itertools.product("DIKR", repeat=n):
                if sum(e != "I" for e in edits) != len(symbols):
                    continue
                state, cost, i, good = 0, 0, 0, True
                for e in edits:
                    if e == "I":
                        state, cost = STATE[NEXT[state]], cost + 3
                        continue
                    s, i = symbols[i], i + 1
                    if e == "D":
                        cost += 4
                        continue
                    cost += (3 if e == "R" else 0) + 3 * s.isupper()
                    if s == "d" or (e == "K" and s.lower() not in OPEN[state]):
                        good = False
                        break
                    state = STATE[NEXT[state]] if e == "R" else STATE[s.lower()]
                if good and state in (0, 3):
                    found.append((cost, "".join(edits)))
        m = own.solve("".join(symbols))
        end = R.best(m, 0, R.CLOSING)
        price, rest = R._CLOSE[end]
        assert (m.cost[0][end] + price, m.edits(0, end) + rest) == min(found), (symbols, names)


def hot_rows():
    """A conversation and the null id with many rows each, ties, repeats across segments, nulls and odd roles."""
    rows = []
    for i in range(900):
        for conv in (7, None):
            role = ["user", "assistant", "system", "tool", None, "User", ""][(i * i + (conv or 3)) % 7 if i % 5 else i % 2]
            text = [f"text {i}.", f"text {i % 40}!", " \t", None, f"open {i}", ""][i * 7 % 6 if i % 3 else 0]
            rows.append((conv, None if i % 50 == 0 else i // 2 * 3, role, text))
    rows += [(i, t, r, f"{i} {t}?") for i in range(20, 90) for t, r in enumerate(["system", "user", "assistant"] * (i % 3))]
    return rows + rows[:30] + [(1, 0, "user", "w " * 200_000 + "."), (2, -2**62, "user", "a."), (2, 2**62, "assistant", "b.")]


def test_conversations_in_many_segments(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 AS seg", "'x' AS letters", "2 AS key", "3 AS copies").repartition(5)
    fixed = R.Repair(df, most_rows=16)
    assert in_order(fixed.report().collect()) == all_expected(rows, damage=False)
    assert fixed.edges.filter("conv_id = 7").count() > 20
    texts = [(r.roles, r.texts) for r in fixed.parts().filter("conv_id is null").orderBy("seg").collect()]
    text = "\n".join(f"{a}:{b}" for p, q in texts for a, b in zip(p, q))
    assert hashlib.sha256(text.encode()).hexdigest() in {r[-1] for r in all_expected(rows, damage=False)}


def test_rules_change_no_result_and_are_the_frequent_pairs(spark):
    sequences = spark.createDataFrame([("suaua", 5), ("uauaua", 3), ("aaaa", 2), ("UaUa", 1)], "symbols string, n long")
    rules = R.build_rules(sequences, most=8, at_once=1)
    assert rules[0] == "ua" and rules[1] == chr(R._RULE_BASE) * 2
    own, plain = R.Grammar(rules), R.Grammar([])
    for s in ["suaua", "uauaua", "aaaa", "UaUaUad", "", "xdxdXSsu"]:
        a, b = own.solve(s), plain.solve(s)
        assert a.cost == b.cost and all(a.edits(p, q) == b.edits(p, q) for p in range(4) for q in range(4) if a.cost[p][q] < R._FAR)


def test_empty_table_and_dropped_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert R.repair(R.damaged(empty), copies="copies").collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "a."), (gone + 1, None, None, None)]
    df = spark.createDataFrame(rows, empty.schema).withColumn("kind", F.lit("mine"))
    got = in_order(R.repair(R.damaged(df), copies="copies").collect())
    assert got == all_expected(rows)
    assert (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got
