"""Scalar expressions and predicates (FLT-3, FLT-4, FLT-6, FLT-8).

Each function returns a ``Column`` built from native Spark functions, so it
stays inside whole-stage code generation and, where it is a plain comparison
on a stored column, is pushed into the Parquet scan.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.fixed import DELIVERY_FEE, FREE_DELIVERY_FROM, LINE_TEXT_FORMAT
from shelfwise.schemas import MONEY, SALE_STATUSES


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_of_literal(as_of=None) -> Column:
    """``NOW()`` as a parameter (SC-5).

    ``None`` means the current time; strings and datetimes become
    ``timestamp_ntz`` literals, which compare with stored timestamps without a
    time-zone shift and fold to a constant that is pushed down.
    """
    if as_of is None:
        return F.current_timestamp().cast("timestamp_ntz")
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, _dt.datetime):
        as_of = as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(str(as_of)).cast("timestamp_ntz")


def is_sale(status="status") -> Column:
    """FLT-3: the order statuses that count as a sale."""
    return _col(status).isin(*SALE_STATUSES)


def window_start(as_of=None, days: int | None = None, months: int | None = None) -> Column:
    """SC-4: ``as_of - INTERVAL n DAY|MONTH`` (a constant Catalyst folds)."""
    if (days is None) == (months is None):
        raise ValueError("give exactly one of days= or months=")
    start = as_of_literal(as_of)
    if days is not None:
        return start - F.make_dt_interval(F.lit(int(days)))
    return start - F.make_ym_interval(F.lit(0), F.lit(int(months)))


def since(ts="created_at", as_of=None, days: int | None = None,
          months: int | None = None) -> Column:
    """FLT-4 / SC-4: ``ts >= as_of - INTERVAL n DAY|MONTH`` keeping the time of day.

    Month arithmetic clamps at month end (31 Mar - 1 month = 29 Feb 2024).
    """
    return _col(ts) >= window_start(as_of, days, months)


def since_month(month="created_month", as_of=None, days: int | None = None,
                months: int | None = None) -> Column:
    """The partition-column form of :func:`since` for a table partitioned by
    the first day of the month: implied by ``since``, so adding it changes no
    result, and it lets Spark skip every month before the window."""
    return _col(month) >= F.trunc(window_start(as_of, days, months), "MM")


def status_is(status_value: str, status="status") -> Column:
    """FLT-8: case-folded status equality (the tables compare case-insensitively)."""
    return F.lower(_col(status)) == F.lower(F.lit(status_value))


def search_match(term: str | None, name="name", description="description") -> Column:
    """FLT-6: literal, case-folded substring test on name or description.

    An empty or missing term matches every row; a NULL description does not
    match (and does not fail).
    """
    if not term:
        return F.lit(True)
    t = F.lit(term.lower())
    on_name = F.coalesce(F.contains(F.lower(_col(name)), t), F.lit(False))
    on_desc = F.coalesce(F.contains(F.lower(_col(description)), t), F.lit(False))
    return on_name | on_desc


def money(c) -> Column:
    """Cast to the shop's money type, decimal(10,2)."""
    return _col(c).cast(MONEY)


def delivery_fee(subtotal, free_from=FREE_DELIVERY_FROM, fee=DELIVERY_FEE) -> Column:
    """SC-8 / AG-15: 0 when the subtotal reaches ``free_from``, else ``fee``."""
    return F.when(_col(subtotal) >= F.lit(free_from), F.lit(0)).otherwise(F.lit(fee))


def file_extension(name) -> Column:
    """SC-13: last dot-separated part of a file name, lower case."""
    return F.lower(F.element_at(F.split(_col(name), r"\."), -1))


def name_token(*parts) -> Column:
    """SC-20: stable unique name for stored content.

    A content hash instead of a random token, so a retried task writes the
    same name.
    """
    return F.sha2(F.concat_ws("/", *[_col(p).cast("string") for p in parts]), 256)


def line_text(name="product_name", quantity="quantity", price="price") -> Column:
    """SC-15: ``<name> (Qty: <q>) - Rs. <amount>`` for one order line."""
    amount = (_col(quantity) * _col(price)).cast("decimal(31,2)")
    return F.format_string(LINE_TEXT_FORMAT, _col(name), _col(quantity),
                           amount.cast("string"))


def split_list(c, sep: str = ",") -> Column:
    """SC-12: a delimited string as an array; NULL or empty gives ``[]``
    (``split('')`` alone would give ``['']``)."""
    col = _col(c)
    return F.when(col.isNull() | (col == ""), F.array().cast("array<string>")) \
        .otherwise(F.split(col, F.lit(sep)))


def month_label(ts="created_at") -> Column:
    """SC-3, text form: ``yyyy-MM`` of a timestamp."""
    return F.date_format(_col(ts), "yyyy-MM")


def first_element(arr) -> Column:
    """SC-19: first element of an array, NULL when empty."""
    return F.get(_col(arr), 0)
