"""Op 11: repair of conversation structure by dynamic programming over a grammar.

A conversation in order should read ``(s?(ua)+)?`` by the first letters of its
roles.  Rows are kept (0), given the other role (3) or deleted (4), empty rows are
inserted (3), and an undeleted truncated row adds 3; blank and duplicate rows must
go.  Wanted are the least cost and, among its edits, the ASCII-least sequence of
``D I K R``.

**States.**  0 nothing yet, 1 after s, 2 after u, 3 after a.  A state and an edit
give the next state and the row written, so edits tell all.  Each row is a symbol
(role letter and fault) with a min-plus matrix over the states: least cost, and the
place of its edits among those of its line.  Edits of a segment end with those of
its last row, so two that lead to different states differ before either ends; their
order then holds whatever follows, and matrices multiply by costs and places alone.

**Grammar.**  Re-Pair: the most frequent adjacent symbols of all sequences become a
rule, again and again, counted by Spark over the distinct sequences.  Each rule has
one matrix, the product of its two symbols'; its audit is a rope, the state in the
middle, unrolled when it is asked for.  Rules and matrices are few (``RULES``), and
every conversation is evaluated over them, whichever task it is in.

**Segments.**  Rows are sorted by conversation and turn over all tasks by range, and
each task cuts its rows into segments of one conversation (at most ``ROWS`` rows and
about ``BYTES`` of text).  A conversation in several segments, however long, is
joined by the segments' matrices: a pass from its end gives the best way on from each
state, a pass from its start the state at each segment; both hold one segment at a
time.  Only the digest of a repaired conversation has to run over its texts in order.

Defined cases: a null conv_id is one conversation; null turns come first; rows of one
turn stand in order of role and text; null roles and texts are one blank; repeated
rows are duplicates but for the first; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import stored

ROWS = 1024                 # rows of a segment
BYTES = 256 << 10           # its text; a longer text is a segment
RULES = 256
AT_ONCE = 32                # rules of a round of counting, none of which shares a symbol's side with another
MEMORY = 50_000             # sequences that a Python worker remembers

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
WHITE = " \t\n\x0b\f\r"
ENDS = ".!?"
_LETTERS = "sua"
_STATES = range(4)
_FAR = 1 << 60
_NAMES = {2: "user", 3: "assistant"}
_NEXT = {0: 2, 1: 2, 2: 3, 3: 2}                   # state after an inserted or rerolled row
_KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_CLOSE = {0: (0, ""), 1: (2 * INSERT, "II"), 2: (INSERT, "I"), 3: (0, "")}
_RULE_BASE = 0x100          # code points of rules


# --- matrices ---------------------------------------------------------------------------------

class Matrix:
    """``cost[p][q]``, ``place[p][q]`` (order of the edits from p to q among those from
    p), and the rope: edits themselves, or the state between two parts."""

    def __init__(self, cost, order, words=None, left=None, right=None, middle=None):
        self.cost, self.words, self.left, self.right, self.middle = cost, words, left, right, middle
        self.place = [[0] * 4 for _ in _STATES]
        for p in _STATES:
            for k, q in enumerate(sorted((q for q in _STATES if cost[p][q] < _FAR), key=lambda q: order[p][q])):
                self.place[p][q] = k

    def edits(self, p: int, q: int) -> str:
        out, todo = [], [(self, p, q)]
        while todo:
            m, a, b = todo.pop()
            if m.words is not None:
                out.append(m.words[a][b])
            else:
                r = m.middle[a][b]
                todo += [(m.right, r, b), (m.left, a, r)]
        return "".join(out)


def symbol_matrix(symbol: str) -> Matrix:
    """``d``: must go.  Else s, u, a or x (any other role), a capital for a truncated row."""
    letter, late = symbol.lower(), TRUNCATED * symbol.isupper()
    cost = [[_FAR] * 4 for _ in _STATES]
    words = [[""] * 4 for _ in _STATES]
    for p in _STATES:
        state, inserts = p, 0
        while inserts <= 3:
            options = [("D", state, DELETE)]
            if symbol != "d":
                options.append(("R", _NEXT[state], REROLE + late))
                if (state, letter) in _KEPT:
                    options.append(("K", _KEPT[state, letter], late))
            for edit, q, price in options:
                new = (inserts * INSERT + price, "I" * inserts + edit)
                if new < (cost[p][q], words[p][q]):
                    cost[p][q], words[p][q] = new
            state, inserts = _NEXT[state], inserts + 1
    return Matrix(cost, words, words=words)


def product(left: Matrix, right: Matrix) -> Matrix:
    cost = [[_FAR] * 4 for _ in _STATES]
    middle = [[0] * 4 for _ in _STATES]
    order = [[None] * 4 for _ in _STATES]
    for p in _STATES:
        near = [r for r in _STATES if left.cost[p][r] < _FAR]
        for q in _STATES:
            best = min(((left.cost[p][r] + right.cost[r][q], left.place[p][r], r) for r in near if right.cost[r][q] < _FAR),
                       default=None)
            if best is not None:
                r = best[2]
                cost[p][q], middle[p][q], order[p][q] = best[0], r, (best[1], right.place[r][q])
    return Matrix(cost, order, left=left, right=right, middle=middle)


_identity = [[0 if p == q else _FAR for q in _STATES] for p in _STATES]
NOTHING = Matrix(_identity, [[""] * 4] * 4, words=[[""] * 4] * 4)
SYMBOLS = "suaxSUAXd"


class Grammar:
    """Rules (pairs of code points) and a matrix for each, made bottom-up."""

    def __init__(self, rules: list[str]):
        self.rules = rules
        self.matrix = {s: symbol_matrix(s) for s in SYMBOLS}
        for k, pair in enumerate(rules):
            self.matrix[chr(_RULE_BASE + k)] = product(self.matrix[pair[0]], self.matrix[pair[1]])
        self.known: dict[str, Matrix] = {}

    def compressed(self, text: str) -> str:
        for k, pair in enumerate(self.rules):
            text = text.replace(pair, chr(_RULE_BASE + k))
        return text

    def solve(self, symbols: str) -> Matrix:
        found = self.known.get(symbols)
        if found is None:
            found = NOTHING
            for s in self.compressed(symbols):
                found = self.matrix[s] if found is NOTHING else product(found, self.matrix[s])
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[symbols] = found
        return found


_grammars: dict[tuple, Grammar] = {}


def grammar(rules: list[str]) -> Grammar:
    """The worker's grammar of these rules, with the sequences it has solved."""
    key = tuple(rules)
    if key not in _grammars:
        _grammars.clear()
        _grammars[key] = Grammar(rules)
    return _grammars[key]


def best(m: Matrix, start: int, onward: list[int]) -> int:
    """State at the end of a segment, from its start state and the costs beyond it."""
    return min((q for q in _STATES if m.cost[start][q] < _FAR and onward[q] < _FAR),
               key=lambda q: (m.cost[start][q] + onward[q], m.place[start][q]))


CLOSING = [_CLOSE[q][0] for q in _STATES]


# --- the grammar, counted by Spark ------------------------------------------------------------

def _pair_counts(rules: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = grammar(rules)
        for batch in batches:
            weights = batch.column(1).to_numpy(zero_copy_only=False)
            text = own.compressed("\n".join(batch.column(0).to_pylist()))
            codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
            line = np.cumsum(codes == 10)
            first, second = codes[:-1], codes[1:]
            start = np.maximum.accumulate(np.where(np.append(True, first != second), np.arange(len(codes)), 0))[:-1]
            keep = (first != 10) & (second != 10) & ((first != second) | ((np.arange(len(first)) - start) % 2 == 0))
            pairs, spot = np.unique(first[keep] << 32 | second[keep], return_inverse=True)
            yield pa.RecordBatch.from_arrays([
                pa.array(pairs), pa.array(np.bincount(spot, weights[line[:-1][keep]], len(pairs)).astype(np.int64))],
                names=["pair", "n"])
    return run


def build_rules(sequences: DataFrame, most: int = RULES, at_once: int = AT_ONCE) -> list[str]:
    """Re-Pair rules of a table of distinct sequences (``symbols``, ``n``)."""
    rules: list[str] = []
    while len(rules) < most:
        top = sequences.mapInArrow(_pair_counts(rules), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")) \
            .filter("n > 1").orderBy(F.desc("n"), "pair").limit(4 * at_once).collect()
        lefts, rights, chosen = set(), set(), []
        for r in top:
            a, b = chr(r.pair >> 32), chr(r.pair & 0xFFFFFFFF)
            if a not in rights and b not in lefts and (a != b or a not in lefts | rights):
                lefts.add(a)
                rights.add(b)
                chosen.append(a + b)
        chosen = chosen[:min(at_once, most - len(rules))]
        if not chosen:
            break
        rules += chosen
    return rules


# --- rows to segments -------------------------------------------------------------------------

_SEGMENT = ("conv_id long, seg long, whole boolean, roles array<string>, texts array<string>, letters string, "
            "faults string, symbols string, digests array<binary>, turns long, first_turn long, last_turn long")


_TYPES = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
_TYPES |= {f"array<{k}>": pa.list_(v) for k, v in _TYPES.items()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def letter_of(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin(*_LETTERS), first).otherwise("x")


def fault_of(text: Column) -> Column:
    """``b`` blank, ``t`` truncated, ``.`` neither."""
    rest = F.rtrim(text, F.lit(WHITE))
    return F.when(rest == "", "b").when(F.right(rest, F.lit(1)).isin(*ENDS), ".").otherwise("t")


def _digest(role: str, text: str) -> bytes:
    r = role.encode()
    return hashlib.blake2b(len(r).to_bytes(8, "little") + r + text.encode(), digest_size=16).digest()


class _Segments:
    """Cuts a task's sorted rows into segments."""

    def __init__(self, schema: pa.Schema, conv, most_rows: int):
        self.schema, self.out, self.size, self.most_rows = schema, [], 0, most_rows
        self.next = TaskContext.get().partitionId() << 32
        self.conv, self.begun = conv, False         # the conversation at hand, and whether it has a segment
        self.first = True                           # of the task: rows before may lie in another
        self._clear()

    def _clear(self) -> None:
        self.roles, self.texts, self.letters, self.faults, self.turns, self.bytes = [], [], [], [], [], 0

    def add(self, turn, role: str, text: str, letter: str, fault: str) -> None:
        if self.roles and (len(self.roles) >= self.most_rows or self.bytes + len(text) > BYTES):
            self.close(False)
        self.roles.append(role)
        self.texts.append(text)
        self.letters.append(letter)
        self.faults.append(fault)
        self.turns.append(turn)
        self.bytes += len(text) + len(role)

    def close(self, ends: bool) -> None:
        """``ends``: the next row is of another conversation."""
        whole = ends and not self.first and not self.begun
        digests = [_digest(r, t) for r, t in zip(self.roles, self.texts)]
        seen: set[bytes] = set()
        for i, d in enumerate(digests):
            if d in seen and self.faults[i] != "b":
                self.faults[i] = "d"
            seen.add(d)
        turns = [t for t in self.turns if t is not None]
        letters, faults = "".join(self.letters), "".join(self.faults)
        self.out.append((self.conv, self.next, whole, self.roles, self.texts, letters, faults, symbols_of(letters, faults),
                         [] if whole else digests, len(set(turns)), turns[0] if turns else None, turns[-1] if turns else None))
        self.next += 1
        self.size += self.bytes
        self.begun = True
        self._clear()

    def turn_to(self, conv) -> None:
        self.close(True)
        self.conv, self.begun, self.first = conv, False, False

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.out)) if self.out else [[] for _ in self.schema]
        self.out, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


def _cut(most_rows: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = None
        for batch in batches:
            for conv, turn, role, text, letter, fault, copies in zip(*[c.to_pylist() for c in batch.columns]):
                if cutter is None:
                    cutter = _Segments(_schema(_SEGMENT), conv, most_rows)
                elif conv != cutter.conv:
                    cutter.turn_to(conv)
                for _ in range(copies):
                    cutter.add(turn, role, text, letter, fault)
                if cutter.size > 16 * BYTES or len(cutter.out) >= 4096:
                    yield cutter.take()
        if cutter is not None:
            cutter.close(False)
            yield cutter.take()
    return run


def segments(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
             copies: str | None = None, most_rows: int = ROWS) -> DataFrame:
    """The rows of each conversation, in order, in segments.  ``copies``: a column that
    says how often a row stands (0: only its conversation is known)."""
    col = lambda name: F.col(f"`{name}`")       # noqa: E731
    times = F.lit(1) if copies is None else col(copies)
    own = rows.select(col(conv).cast("long").alias("conv_id"), col(turn).cast("long").alias("turn"),
                      F.coalesce(col(role).cast("string"), F.lit(" ")).alias("role"),
                      F.coalesce(col(text).cast("string"), F.lit(" ")).alias("text"), times.cast("int").alias("copies"))
    own = own.withColumns({c: F.when(F.col("copies") > 0, F.col(c)) for c in ("turn", "role", "text")}).select(
        "conv_id", "turn", "role", "text", letter_of(F.col("role")).alias("letter"), fault_of(F.col("text")).alias("fault"), "copies")
    # Equal rows may lie in any order: the last column lets many of them lie in several tasks.
    order = ["conv_id", "turn", "role", "text", "_spread"]
    return own.withColumn("_spread", F.monotonically_increasing_id()).repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]) \
        .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order]).drop("_spread").mapInArrow(_cut(most_rows), _SEGMENT)


# --- conversations in several segments --------------------------------------------------------

def symbols_of(letters: str, faults: str) -> str:
    return "".join("d" if f in "bd" else c.upper() if f == "t" else c for c, f in zip(letters, faults))


def _key() -> list[Column]:
    """A conversation as two columns without nulls."""
    return [F.col("conv_id").isNull().alias("no_id"), F.coalesce("conv_id", F.lit(0)).alias("key")]


_ORDER = ["no_id", "key", "seg"]


def _with_earlier(edges: DataFrame) -> DataFrame:
    """Segments whose rows were seen in an earlier segment: those rows are duplicates."""
    rows = edges.select(*_key(), "seg", F.posexplode("digests").alias("at", "digest"))
    first = rows.groupBy("no_id", "key", "digest").agg(F.min(F.struct("seg", "at")).alias("first"))
    later = rows.join(first, ["no_id", "key", "digest"]).filter("seg > first.seg").groupBy("seg").agg(F.collect_list("at").alias("later"))
    return edges.drop("digests").join(later, "seg", "left")


def _marked(faults: str, later: list[int] | None) -> str:
    if not later:
        return faults
    out = list(faults)
    for i in later:
        if out[i] != "b":
            out[i] = "d"
    return "".join(out)


def _edge_matrices(rules: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = grammar(rules)
        for batch in batches:
            found = [own.solve(symbols_of(a, _marked(f, x))) for a, f, x in zip(*[c.to_pylist() for c in batch.columns[3:6]])]
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:3], pa.array([[v for line in m.cost for v in line] for m in found], pa.list_(pa.int64())),
                pa.array([[v for line in m.place for v in line] for m in found], pa.list_(pa.int32()))],
                names=["no_id", "key", "seg", "cost", "place"])
    return run


def _onward(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments from the last one of a conversation: best end state for each start state."""
    conv, beyond = None, CLOSING
    for batch in batches:
        steps, last = [], []
        for no_id, key, cost, place in zip(*[batch.column(c).to_pylist() for c in ("no_id", "key", "cost", "place")]):
            last.append((no_id, key) != conv)
            if last[-1]:
                conv, beyond = (no_id, key), CLOSING
            step = []
            for p in _STATES:
                ways = [(cost[4 * p + q] + beyond[q], place[4 * p + q], q) for q in _STATES if cost[4 * p + q] < _FAR and beyond[q] < _FAR]
                step.append(min(ways, default=(_FAR, 0, p)))
            steps.append([s[2] for s in step])
            beyond = [s[0] for s in step]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("no_id", "key", "seg")], pa.array(steps, pa.list_(pa.int32())),
                                          pa.array(last, pa.bool_())], names=["no_id", "key", "seg", "step", "last"])


def _along(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments from the first one of a conversation: start and end state of each."""
    conv, state = None, 0
    for batch in batches:
        starts, ends = [], []
        for no_id, key, step in zip(*[batch.column(c).to_pylist() for c in ("no_id", "key", "step")]):
            if (no_id, key) != conv:
                conv, state = (no_id, key), 0
            starts.append(state)
            state = step[state]
            ends.append(state)
        yield pa.RecordBatch.from_arrays([batch.column("seg"), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), batch.column("last")],
                                         names=["seg", "start", "end", "last"])


# --- repaired segments ------------------------------------------------------------------------

_PART = ("conv_id long, seg long, whole boolean, cost long, audit string, roles array<string>, texts array<string>, blank long, "
         "duplicate long, truncated long, illegal long, letters string, turns long, first_turn long, last_turn long")


def apply_edits(edits: str, start: int, roles: list[str], texts: list[str], letters: str) -> tuple[list[str], list[str]]:
    state, i, out_roles, out_texts = start, 0, [], []
    for e in edits:
        if e == "D":
            i += 1
            continue
        if e == "K":
            state = _KEPT[state, letters[i]]
            out_roles.append(roles[i])
        else:
            state = _NEXT[state]
            out_roles.append(_NAMES[state])
        out_texts.append("" if e == "I" else texts[i])
        i += e != "I"
    return out_roles, out_texts


_LEGAL = {"su", "ua", "au"}


def _repaired(rules: list[str]):
    """Segments with their start and end states (null: the whole conversation)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, schema = grammar(rules), _schema(_PART)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                faults = _marked(r["faults"], r["later"])
                m = own.solve(symbols_of(r["letters"], faults))
                start = 0 if r["whole"] else r["start"]
                end = best(m, 0, CLOSING) if r["whole"] else r["end"]
                price, rest = _CLOSE[end] if r["whole"] or r["last"] else (0, "")
                audit, letters = m.edits(start, end) + rest, r["letters"]
                roles, texts = apply_edits(audit, start, r["roles"], r["texts"], letters)
                out.append((r["conv_id"], r["seg"], r["whole"], m.cost[start][end] + price, audit, roles, texts, faults.count("b"),
                            faults.count("d"), faults.count("t"), sum(a + b not in _LEGAL for a, b in zip(letters, letters[1:])),
                            letters[:1] + letters[-1:], r["turns"], r["first_turn"], r["last_turn"]))
            columns = list(zip(*out)) if out else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, schema)], schema=schema)
    return run


class Repair:
    """Repaired conversations: ``whole`` (one segment each) and ``edges`` (segments of
    conversations that may have several)."""

    def __init__(self, rows: DataFrame, most_rules: int = RULES, **columns):
        table = stored(segments(rows, **columns), "segments")
        sequences = stored(table.groupBy("symbols").agg(F.count("*").alias("n")), "sequences")
        self.rules = build_rules(sequences, most_rules)
        step = [F.lit(None).cast(t).alias(c) for c, t in (("later", "array<int>"), ("start", "int"), ("end", "int"), ("last", "boolean"))]
        self.whole = table.filter("whole").drop("digests", "symbols").select("*", *step).mapInArrow(_repaired(self.rules), _PART)
        edges = stored(_with_earlier(table.filter("not whole").drop("symbols")), "edges")
        path = edges.select(*_key(), "seg", "letters", "faults", "later").mapInArrow(
            _edge_matrices(self.rules), "no_id boolean, key long, seg long, cost array<long>, place array<int>")
        path = path.repartition("no_id", "key").sortWithinPartitions("no_id", "key", F.desc("seg")).mapInArrow(
            _onward, "no_id boolean, key long, seg long, step array<int>, last boolean")
        path = path.repartition("no_id", "key").sortWithinPartitions(*_ORDER).mapInArrow(
            _along, "seg long, start int, end int, last boolean")
        self.edges = edges.join(path, "seg").mapInArrow(_repaired(self.rules), _PART)

    def parts(self) -> DataFrame:
        """conv_id, seg (ascending within a conversation), ``roles`` and ``texts`` of the
        repaired rows, cost, edits (``audit``) and the counts of the segment."""
        return self.whole.unionByName(self.edges)

    def report(self) -> DataFrame:
        """One row for each conversation, as in the contract of ``op11``."""
        edges = self.edges.select("*", *_key()).repartition("no_id", "key").sortWithinPartitions(*_ORDER).drop("no_id", "key")
        return self.whole.mapInArrow(_reports, _REPORT).unionByName(edges.mapInArrow(_reports, _REPORT))


_REPORT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")


class _Total:
    """What a conversation's segments, in order, add up to."""

    def __init__(self, conv):
        self.conv, self.audit, self.hash, self.written = conv, [], hashlib.sha256(), False
        self.cost = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.letter, self.least, self.most = "", None, None

    def add(self, r: dict) -> None:
        for name in ("cost", "blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + r[name])
        if r["letters"]:
            self.illegal += bool(self.letter) and self.letter + r["letters"][0] not in _LEGAL
            self.letter = r["letters"][-1]
        if r["first_turn"] is not None:
            self.turns -= r["first_turn"] == self.most
            self.least = r["first_turn"] if self.least is None else self.least
            self.most = r["last_turn"]
        self.audit.append(r["audit"])
        if r["roles"]:
            text = "\n".join(f"{a}:{b}" for a, b in zip(r["roles"], r["texts"]))
            self.hash.update((("\n" if self.written else "") + text).encode())
            self.written = True

    def row(self) -> tuple:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        return (self.conv, gaps if gaps < 1 << 63 else None, self.blank, self.duplicate, self.truncated, self.illegal, self.cost,
                "".join(self.audit), self.hash.hexdigest())


def _reports(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, total = _schema(_REPORT), None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if total is None or r["whole"] or r["conv_id"] != total.conv:
                if total is not None:
                    done.append(total.row())
                total = _Total(r["conv_id"])
            total.add(r)
        yield batch_of(done)
    if total is not None:
        yield batch_of([total.row()])


def damaged(rows: DataFrame) -> DataFrame:
    """Rows damaged by crc32(``conv_id:turn``) % 20 (nulls: one blank): 0 drops the row
    (``copies`` 0), 1 empties the text, 2 takes its ``.!?``, 3 repeats it, 4 makes it the user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    return rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def repair(rows: DataFrame, **columns) -> DataFrame:
    return Repair(rows, **columns).report()
