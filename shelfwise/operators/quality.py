"""Data-quality and integrity jobs (DQ-1..DQ-8), from the DDL constraints and
the shop's validators.

Each job returns violations as ``(table, rule, key, detail)`` strings, so the
results of several jobs stack with ``unionByName``.  All are single scans,
aggregates or anti joins; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.fixed import (ALLOWED_EXTENSIONS, EMAIL_PATTERN, MAX_IMAGE_BYTES,
                             MAX_IMAGES_PER_UPLOAD)
from shelfwise.functions.expressions import file_extension
from shelfwise.schemas import DOMAINS, WIDTHS

VIOLATION_COLUMNS = ("table", "rule", "key", "detail")
MONEY_LIMIT = 100_000_000  # decimal(10,2) holds |x| < 1e8


def _key(cols) -> Column:
    cols = [cols] if isinstance(cols, str) else list(cols)
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def _out(df: DataFrame, table: str, rule, key: Column, detail: Column) -> DataFrame:
    rule_col = rule if isinstance(rule, Column) else F.lit(rule)
    return df.select(F.lit(table).alias("table"), rule_col.alias("rule"),
                     key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def stack(*violations: DataFrame) -> DataFrame:
    """Union several violation frames."""
    return reduce(lambda a, b: a.unionByName(b), violations)


def null_violations(df: DataFrame, cols, table: str, key="id") -> DataFrame:
    """DQ-1: NOT NULL, all columns checked in one pass (one row per null cell)."""
    flagged = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols]),
                       lambda x: x.isNotNull())
    hits = df.select(_key(key).alias("_k"), F.explode(flagged).alias("_c"))
    return _out(hits, table, "not_null", F.col("_k"), F.col("_c"))


def duplicate_keys(df: DataFrame, cols, table: str, fold_case: bool = False) -> DataFrame:
    """DQ-2: UNIQUE / PRIMARY KEY: key values held by more than one row
    (NULL keys are not duplicates, as in SQL).  ``fold_case`` compares text keys
    in lower case, as e-mail addresses are."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    nn = df.select(*[F.lower(c).alias(c) for c in cols]) if fold_case else df
    for c in cols:
        nn = nn.filter(F.col(c).isNotNull())
    dup = nn.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return _out(dup, table, F.lit("unique:" + ",".join(cols)), _key(cols),
                F.concat(F.lit("rows="), F.col("_n").cast("string")))


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str, table: str,
            parent_table: str, key="id") -> DataFrame:
    """DQ-3: child rows whose (non-NULL) reference has no parent row."""
    keys = parent.select(F.col(pk).alias(fk))
    bad = child.filter(F.col(fk).isNotNull()).join(keys, fk, "left_anti")
    return _out(bad, table, f"fk:{fk}->{parent_table}.{pk}", _key(key), F.col(fk))


def out_of_domain(df: DataFrame, col: str, table: str, values=None, key="id") -> DataFrame:
    """DQ-4: ENUM domain (the shop's endpoints accept any text)."""
    values = values or DOMAINS[(table, col)]
    bad = df.filter(F.col(col).isNotNull() & ~F.col(col).isin(*values))
    return _out(bad, table, f"domain:{col}", _key(key), F.col(col))


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c)) == "")


def product_violations(products: DataFrame) -> DataFrame:
    """DQ-5: the product form's rules: name, description and category
    present, price present and non-zero, stock not negative."""
    checks = [
        ("name_missing", _blank("name")),
        ("description_missing", _blank("description")),
        ("category_missing", _blank("category")),
        ("price_missing_or_zero", F.col("price").isNull() | (F.col("price") == 0)),
        ("stock_negative", F.col("stock") < 0),
    ]
    flagged = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks]),
                       lambda x: x.isNotNull())
    hits = products.select(F.col("id").cast("string").alias("_k"), F.explode(flagged).alias("_r"))
    return _out(hits, "products", F.col("_r"), F.col("_k"), F.lit(None))


def line_violations(items: DataFrame, key=("order_id", "product_id")) -> DataFrame:
    """DQ-5: order lines with a quantity that is not positive (the order
    model sets no lower bound; a negative line would raise stock)."""
    bad = items.filter(F.col("quantity") <= 0)
    return _out(bad, "order_items", "quantity_not_positive", _key(key), F.col("quantity"))


def bad_emails(df: DataFrame, table: str, col: str = "email", key="id") -> DataFrame:
    """DQ-6: e-mail addresses not of the shape ``x@y.z``."""
    bad = df.filter(F.col(col).isNull() | ~F.col(col).rlike(EMAIL_PATTERN))
    return _out(bad, table, "email_shape", _key(key), F.col(col))


def width_violations(df: DataFrame, table: str, key="id",
                     money_cols: tuple[str, ...] = ()) -> DataFrame:
    """DQ-7: text longer than the declared width; money outside decimal(10,2)."""
    checks = [(f"width:{c}>{n}", F.length(F.col(c)) > n)
              for c, n in WIDTHS.get(table, {}).items() if c in df.columns]
    checks += [(f"range:{c}", F.abs(F.col(c).cast("double")) >= MONEY_LIMIT)
               for c in money_cols if c in df.columns]
    if not checks:
        return _out(df.limit(0), table, "width", F.lit(None), F.lit(None))
    flagged = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks]),
                       lambda x: x.isNotNull())
    hits = df.select(_key(key).alias("_k"), F.explode(flagged).alias("_r"))
    return _out(hits, table, F.col("_r"), F.col("_k"), F.lit(None))


def image_type(content: Column) -> Column:
    """The image type told by the leading bytes: jpeg, png, webp, else NULL."""
    h = F.hex(F.substring(content, 1, 12))
    return (F.when(F.substring(h, 13, 8).isin("4A464946", "45786966"), "jpeg")  # JFIF / Exif at 6
            .when(F.substring(h, 1, 8) == "FFD8FFDB", "jpeg")
            .when(F.substring(h, 1, 16) == "89504E470D0A1A0A", "png")
            .when((F.substring(h, 1, 8) == "52494646") & (F.substring(h, 17, 8) == "57454250"),
                  "webp"))


def image_violations(images: DataFrame) -> DataFrame:
    """DQ-8: an image manifest (``read_images``) checked like an upload:
    extension and leading bytes both an allowed type, at most 5 MiB each, at
    most 5 files per upload folder (every file of a larger upload is flagged).
    """
    # the file's type is told before the rows move; its bytes stay where they are
    narrow = images.select("path", "upload", "file_name", "length", image_type(F.col("content")).alias("_type"))
    per_upload = narrow.groupBy("upload").agg(F.count(F.lit(1)).alias("_files"))
    large = per_upload.filter(F.col("_files") > MAX_IMAGES_PER_UPLOAD)
    j = narrow.join(large, "upload", "left")
    checks = [
        ("extension", ~F.coalesce(file_extension("file_name").isin(*ALLOWED_EXTENSIONS), F.lit(False))),
        ("content_type", ~F.coalesce(F.col("_type").isin(*ALLOWED_EXTENSIONS), F.lit(False))),
        ("too_large", F.col("length") > MAX_IMAGE_BYTES),
        ("too_many_in_upload", F.col("_files").isNotNull()),
    ]
    flagged = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks]),
                       lambda x: x.isNotNull())
    hits = j.select("path", F.explode(flagged).alias("_r"))
    return _out(hits, "product_images", F.col("_r"), F.col("path"), F.lit(None))
