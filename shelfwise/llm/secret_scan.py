"""Secret scan by a battery of randomness tests, in DataFrame operations alone.

Base patterns (passwords and keys assigned, access keys, long hex runs) come
first.  Then every run of 20 or more letters, digits, ``+ / _ -`` is a candidate:

1. Its encoding is inferred from its characters (decimal, hex, base32, base36,
   base62, base64), which gives an alphabet of k symbols.
2. Three tests hold it against a random string of that alphabet: chi-squared for
   uniform use of the symbols, runs above and below the middle of the alphabet,
   and lag-1 serial correlation.  The smallest p-value times three (Bonferroni)
   must be at least ``ALPHA``: a candidate that any test finds too regular is
   not taken for random.
3. The evidence against ordinary text is length-aware: under letters at their
   usual frequencies the chi-squared statistic has mean k - 1 + e L and variance
   2 (k - 1) + 4 e L, with an excess e known for each encoding, so a short run
   cannot be very surprising and a long one can.  The lower tail is the p-value.
4. False discoveries are controlled over the whole table, by class of length
   (powers of two): Benjamini and Hochberg's rule at ``RATE`` on the counts of
   p-values in bins of 1/20 decade, whose number is bounded.

Runs of decimal digits have no alternative to be held against (evidence 0): they
are never reported, and are left out of the totals of their class of length.

Positions come from ``split``: the pieces between matches and the matches, laid
end to end, are the text.  All positions are in code points, end exclusive.

Defined cases: a null text is empty; rows that repeat a doc_id are scanned and
returned one by one; a null doc_id stays null.  A found run that overlaps a base
span is not reported twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import free_name, stored

# Fixed patterns of the base.
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}"            # a run of 20 or more in all
HEX = r"[0-9a-f]{24,}"                   # maximal runs of 24 or more
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"

ALPHA = 0.001
RATE = 0.01
BINS = 20                                # of p-values, for each power of ten
KINDS = ("assign", "access", "hex", "random")

#: encoding, its characters, its symbols in order, excess of chi-squared per
#: character under ordinary text: k * sum(q^2) - 1, with q the frequency of each
#: letter (sum 0.066 over a-z; 0.28 over a-f; digits alone 0.1)
ENCODINGS = (
    ("decimal", "^[0-9]+$", "0123456789", 0.0),
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 3.48),
    ("base32", "^[A-Z2-7]+$", "abcdefghijklmnopqrstuvwxyz234567", 1.11),
    ("base36", "^([a-z0-9]+|[A-Z0-9]+)$", "abcdefghijklmnopqrstuvwxyz0123456789", 1.38),
    ("base62", "^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 3.09),
    ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 3.22),
)
_FOLDED = ("hex", "base32", "base36")    # symbols are compared without case

_SPAN = "array<struct<start:long,kind:int,end:long,match:string>>"


def _located(found: str, gaps: str, kind: int) -> Column:
    """Spans of the matches ``found`` between the pieces ``gaps``."""
    return F.expr(f"""
        aggregate(arrays_zip({found}, {gaps}),
                  named_struct('at', 0L, 'out', cast(array() AS {_SPAN})),
                  (acc, x) -> CASE WHEN x.{found} IS NULL THEN acc ELSE named_struct(
                      'at', acc.at + char_length(x.{gaps}) + char_length(x.{found}),
                      'out', array_append(acc.out, named_struct(
                          'start', acc.at + char_length(x.{gaps}), 'kind', {kind},
                          'end', acc.at + char_length(x.{gaps}) + char_length(x.{found}), 'match', x.{found}))) END,
                  acc -> acc.out)""")


def _matches(df: DataFrame, pattern: str, name: str, kind: int) -> DataFrame:
    """Add ``name``: spans of the leftmost non-overlapping matches."""
    df = df.withColumn("_found", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    df = df.withColumn("_gaps", F.when(F.size("_found") > 0, F.split("text", pattern, -1)))
    return df.withColumn(name, F.when(F.size("_found") > 0, _located("_found", "_gaps", kind))
                         .otherwise(F.array().cast(_SPAN))).drop("_found", "_gaps")


def _tail(z: Column) -> Column:
    """-log10 of the upper tail of the normal distribution at z >= 0."""
    return (z * z / 2 + 0.9189385332046727 - F.log(2 / (z + F.sqrt(z * z + 2.546479089470325)))) / 2.302585092994046


def battery(runs: DataFrame) -> DataFrame:
    """For a column ``token``: encoding, chi2, z of each test, randomness (the
    combined p-value) and evidence (-log10 p against ordinary text)."""
    bare = F.regexp_replace("token", "=+$", "")
    df = runs.withColumn("_b", bare).withColumn("length", F.char_length("_b").cast("double"))
    encoding = F.lit("base64")
    for name, pattern, _, _ in reversed(ENCODINGS[:-1]):
        encoding = F.when(F.col("_b").rlike(pattern), F.lit(name)).otherwise(encoding)
    df = df.withColumn("encoding", encoding)

    def by_encoding(value):
        out = value(ENCODINGS[-1])
        for e in ENCODINGS[:-1]:
            out = F.when(F.col("encoding") == e[0], value(e)).otherwise(out)
        return out

    df = df.withColumn("k", by_encoding(lambda e: F.lit(float(len(e[2])))))
    df = df.withColumn("excess", by_encoding(lambda e: F.lit(e[3])))
    df = df.withColumn("_s", F.when(F.col("encoding").isin(*_FOLDED), F.lower("_b"))
                       .otherwise(F.translate("_b", "-_", "+/")))
    df = df.withColumn("_alphabet", by_encoding(lambda e: F.lit(e[2])))
    df = df.withColumn("_x", F.expr("transform(split(_s, ''), c -> cast(instr(_alphabet, c) AS double))"))
    df = df.withColumn("_x", F.expr("filter(_x, v -> v > 0)"))
    df = df.withColumn("_sum2", F.expr(
        "aggregate(array_distinct(_x), 0D, (acc, v) -> acc + power(cast(size(filter(_x, w -> w = v)) AS double), 2))"))
    df = df.withColumn("chi2", F.expr("k / length * _sum2 - length"))
    df = df.withColumn("z_chi2", F.expr(                         # Wilson and Hilferty
        "(power(greatest(chi2, 0D) / (k - 1), 1D / 3) - (1 - 2 / (9 * (k - 1)))) / sqrt(2 / (9 * (k - 1)))"))
    df = df.withColumn("_high", F.expr("cast(size(filter(_x, v -> v > k / 2)) AS double)"))
    df = df.withColumn("_runs", F.expr(
        "1 + cast(size(filter(sequence(2, size(_x)), i -> (_x[i - 1] > k / 2) <> (_x[i - 2] > k / 2))) AS double)"))
    df = df.withColumn("_mean", F.expr("1 + 2 * _high * (length - _high) / length"))
    df = df.withColumn("_var", F.expr("(_mean - 1) * (_mean - 2) / (length - 1)"))
    df = df.withColumn("z_runs", F.expr("CASE WHEN _var > 0 THEN (_runs - _mean) / sqrt(_var) ELSE 40D END"))
    df = df.withColumn("_m", F.expr("aggregate(_x, 0D, (acc, v) -> acc + v) / length"))
    df = df.withColumn("_ss", F.expr("aggregate(_x, 0D, (acc, v) -> acc + power(v - _m, 2))"))
    df = df.withColumn("_lag", F.expr(
        "aggregate(sequence(2, size(_x)), 0D, (acc, i) -> acc + (_x[i - 1] - _m) * (_x[i - 2] - _m))"))
    df = df.withColumn("z_serial", F.expr("CASE WHEN _ss > 0 THEN (_lag / _ss + 1 / length) * sqrt(length) ELSE 40D END"))
    two_sided = [F.least(F.lit(1.0), 2 * F.pow(F.lit(10.0), -_tail(F.least(F.abs(F.col(z)), F.lit(30.0)))))
                 for z in ("z_chi2", "z_runs", "z_serial")]
    df = df.withColumn("randomness", F.least(F.lit(1.0), 3 * F.least(*two_sided)))
    df = df.withColumn("_z", F.expr("((k - 1) + excess * length - chi2) / sqrt(2 * (k - 1) + 4 * excess * length)"))
    df = df.withColumn("evidence", F.when((F.col("_z") > 0) & (F.col("excess") > 0), _tail(F.least("_z", F.lit(60.0))))
                       .otherwise(F.lit(0.0)))
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def discoveries(tested: DataFrame, rate: float = RATE, alpha: float = ALPHA) -> DataFrame:
    """Rows of ``tested`` that are random secrets at a false-discovery rate of
    ``rate``, for each class of length."""
    df = tested.filter("encoding <> 'decimal'").withColumn("_class", F.floor(F.log2("length"))).withColumn("_bin", F.floor(F.col("evidence") * BINS))
    counts = df.groupBy("_class", "_bin").agg(F.count(F.lit(1)).alias("_c"))    # some thousand rows at most
    down = Window.partitionBy("_class").orderBy(F.desc("_bin"))
    whole = Window.partitionBy("_class")
    least = (counts.select("_class", "_bin", F.sum("_c").over(down).alias("_above"), F.sum("_c").over(whole).alias("_all"))
             .filter(F.pow(F.lit(10.0), -F.col("_bin") / BINS) <= rate * F.col("_above") / F.col("_all"))
             .groupBy("_class").agg(F.min("_bin").alias("_least")))
    return (df.join(F.broadcast(least), "_class").filter((F.col("_bin") >= F.col("_least")) & (F.col("randomness") >= alpha))
            .drop("_class", "_bin", "_least"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: row (its number), doc_id, n_assign, n_access,
    n_hex, base and spans (arrays of start, kind, end; kind numbers KINDS)."""
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return _scan(base)


def _scan(base: DataFrame) -> DataFrame:
    """``scan`` of columns row, doc_id, text."""
    df = base
    for kind, (name, pattern) in enumerate((("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("random", CANDIDATE))):
        df = _matches(df, pattern, name, kind)
    df = df.withColumn("assign", F.filter("assign", lambda s: F.char_length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 6))
    plain = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"),
                                                        s["end"].alias("end")))
    df = df.withColumn("base", F.array_sort(F.concat(plain("assign"), plain("access"), plain("hex"))))
    apart = F.expr("filter(random, c -> NOT exists(base, b -> b.start < c.end AND c.start < b.end))")
    found = stored(df.select("row", "doc_id", "base", apart.alias("random"),
                             *[F.size(c).cast("long").alias(f"n_{c}") for c in ("assign", "access", "hex")]), "spans")
    runs = found.select("row", F.explode("random").alias("c")).select(
        "row", F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.col("c.match").alias("token"))
    more = (discoveries(stored(battery(runs), "tested")).groupBy("row")
            .agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end")).alias("more")))
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:long,kind:int,end:long>>"))))
    return found.drop("random").join(more, "row", "left").withColumn("spans", spans).drop("more")


def written(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each span (or spans that overlap) replaced by ``mask``."""
    row, own = free_name(docs, "_row"), free_name(docs, "_spans")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "masked")
    spans = _scan(rows.select(F.col(row).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                              F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")))
    found = spans.filter(F.size("spans") > 0).select(F.col("row").alias(row), F.col("spans").alias(own))
    text = F.expr(f"""
        aggregate({own}, named_struct('at', 0L, 'out', ''),
                  (acc, s) -> CASE WHEN s.start < acc.at THEN named_struct('at', greatest(acc.at, s.end), 'out', acc.out)
                      ELSE named_struct('at', s.end, 'out', concat(acc.out,
                          substring(`{text_col}`, cast(acc.at + 1 AS int), cast(s.start - acc.at AS int)), '{mask}')) END,
                  acc -> concat(acc.out, substring(`{text_col}`, cast(acc.at + 1 AS int))))""")
    return (rows.join(found, row, "left")
            .withColumn(text_col, F.when(F.col(own).isNull(), F.col(f"`{text_col}`")).otherwise(text))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
