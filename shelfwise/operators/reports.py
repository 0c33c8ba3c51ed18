"""Reports, KPIs and views: AG-1..AG-3b, AG-6..AG-10 (with JN-4, FLT-3, FLT-4).

Every aggregate here is a hash aggregate with a map-side partial step, so a
hot key (one product in a third of all lines) is combined inside each map
task before the shuffle.  Dimension joins happen *after* aggregation, on one
row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.expressions import is_sale, since, since_month
from shelfwise.fixed import DAILY_WINDOW_DAYS, MONTHLY_WINDOW_MONTHS
from shelfwise.schemas import LINE_MONEY_SUM, MONEY_SUM


def _zero_money():
    return F.lit(0).cast(MONEY_SUM)


# ---------------------------------------------------------------- KPIs
def user_count(users: DataFrame) -> DataFrame:
    """AG-1: number of users (all statuses, as the dashboard counts them)."""
    return users.agg(F.count(F.lit(1)).alias("count"))


def product_count(products: DataFrame) -> DataFrame:
    """AG-2: number of products (all of them, including stock 0)."""
    return products.agg(F.count(F.lit(1)).alias("count"))


def order_kpis(orders: DataFrame) -> DataFrame:
    """AG-3: number of sale orders and their revenue, 0 when there are none."""
    return orders.filter(is_sale()).agg(
        F.count(F.lit(1)).alias("count"),
        F.coalesce(F.sum("total_amount"), _zero_money()).cast(MONEY_SUM).alias("total_sales"))


def dashboard(users: DataFrame, products: DataFrame, orders: DataFrame) -> DataFrame:
    """AG-3b: the four dashboard tiles in one row.

    The three one-row aggregates are stacked with ``unionByName`` and folded
    by one global aggregate (no cross join).
    """
    u = users.agg(F.count(F.lit(1)).alias("total_users"))
    p = products.agg(F.count(F.lit(1)).alias("total_products"))
    o = order_kpis(orders).select(F.col("count").alias("sale_orders"),
                                  F.col("total_sales").alias("revenue"))
    stacked = u.unionByName(p, allowMissingColumns=True).unionByName(o, allowMissingColumns=True)
    return stacked.agg(
        F.coalesce(F.max("total_users"), F.lit(0)).cast("long").alias("total_users"),
        F.coalesce(F.max("total_products"), F.lit(0)).cast("long").alias("total_products"),
        F.coalesce(F.max("sale_orders"), F.lit(0)).cast("long").alias("sale_orders"),
        F.coalesce(F.max("revenue"), _zero_money()).cast(MONEY_SUM).alias("revenue"))


# ---------------------------------------------------------------- views
def top_selling(products: DataFrame, items: DataFrame, orders: DataFrame | None = None,
                sales_only: bool = False) -> DataFrame:
    """AG-6 (the best-seller view): per product the number of lines,
    units and revenue at the price of sale, by revenue descending.

    The shop's view puts the status test inside the ``ON`` of a second left
    join and aggregates no order column, so it counts every line whatever the
    order status; that is the default here, and the join to ``orders`` is
    left out (exact, since ``orders.id`` is unique).  ``sales_only=True``
    keeps only lines of sale orders.

    Lines are aggregated per product *before* the join to ``products``.
    """
    lines = items
    if sales_only:
        if orders is None:
            raise ValueError("sales_only=True needs orders")
        sale_ids = orders.filter(is_sale()).select(F.col("id").alias("order_id"))
        lines = lines.join(sale_ids, "order_id", "left_semi")
    per_product = lines.groupBy(F.col("product_id").alias("id")).agg(
        F.count("order_id").alias("sales_count"),
        F.sum("quantity").alias("total_quantity_sold"),
        F.sum(F.col("quantity") * F.col("price")).alias("total_revenue"))
    joined = products.select("id", "name", "category", "color").join(per_product, "id", "left")
    return joined.select(
        "id", "name", "category", "color",
        F.coalesce(F.col("sales_count"), F.lit(0)).cast("long").alias("sales_count"),
        F.coalesce(F.col("total_quantity_sold"), F.lit(0)).cast("long").alias("total_quantity_sold"),
        F.coalesce(F.col("total_revenue"), F.lit(0)).cast(LINE_MONEY_SUM).alias("total_revenue"),
    ).orderBy(F.col("total_revenue").desc(), F.col("id"))


# ---------------------------------------------------------------- sales reports
def _period_key(period: str):
    if period == "monthly":
        return F.trunc(F.col("created_at"), "MM"), dict(months=MONTHLY_WINDOW_MONTHS)
    return F.to_date(F.col("created_at")), dict(days=DAILY_WINDOW_DAYS)


def _in_window(orders: DataFrame, as_of, window: dict):
    pred = is_sale() & since("created_at", as_of, **window)
    if "created_month" in orders.columns:   # month-partitioned storage: prune
        pred = pred & since_month("created_month", as_of, **window)
    return orders.filter(pred)


def sales_report(orders: DataFrame, period: str = "daily", as_of=None,
                 days: int | None = None, months: int | None = None) -> DataFrame:
    """AG-7 / AG-8: sale orders per day over the last 7 days, or per month
    (first day of the month, as a date) over the last 12 months.

    The window keeps the time of day of ``as_of``; ``days`` / ``months``
    replace the default window length.  An unknown period gives the daily
    report, as the endpoint does.  Columns: ``date, orders, revenue``.
    """
    period = "monthly" if period == "monthly" else "daily"
    key, window = _period_key(period)
    if days is not None or months is not None:
        window = dict(days=days) if days is not None else dict(months=months)
    return (_in_window(orders, as_of, window)
            .groupBy(key.alias("date"))
            .agg(F.count(F.lit(1)).alias("orders"),
                 F.coalesce(F.sum("total_amount"), _zero_money()).cast(MONEY_SUM).alias("revenue"))
            .orderBy(F.col("date").desc()))


def sales_report_proc(orders: DataFrame, period: str, as_of=None) -> DataFrame:
    """AG-9: the stored-procedure form: ``date, total_orders, revenue`` with a
    plain SUM; an unknown period gives an empty result with the same columns."""
    known = period in ("daily", "monthly")
    key, window = _period_key(period if known else "daily")
    out = (_in_window(orders, as_of, window)
           .groupBy(key.alias("date"))
           .agg(F.count(F.lit(1)).alias("total_orders"),
                F.sum("total_amount").cast(MONEY_SUM).alias("revenue")))
    if not known:
        out = out.filter(F.lit(False))
    return out.orderBy(F.col("date").desc())


def report_totals(report: DataFrame, orders_col: str = "orders",
                  revenue_col: str = "revenue") -> DataFrame:
    """AG-10: totals of a report and the average order value (0 with no orders).

    Lazy: one global aggregate over the (small) report, nothing collected.
    """
    agg = report.agg(
        F.coalesce(F.sum(orders_col), F.lit(0)).cast("long").alias("total_orders"),
        F.coalesce(F.sum(revenue_col), F.lit(0)).cast(MONEY_SUM).alias("total_revenue"))
    return agg.select(
        "total_orders", "total_revenue",
        F.when(F.col("total_orders") > 0,
               F.col("total_revenue").cast("double") / F.col("total_orders"))
         .otherwise(F.lit(0.0)).alias("avg_order_value"))
