"""Order operators: FLT-5, FLT-8, FLT-9, FLT-10, JN-1, JN-2, JN-5, AG-13..AG-16,
SR-1, SR-2, SC-15.

The shop lists orders and then runs one query per order for its items; here
that is one join and one grouping.  Lines are rows ``(order_id, position, ...)``
numbered for all orders alike; nesting them into one array per order is a
separate step, the same at every size, and the order of the list is made last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.expressions import delivery_fee, line_text, status_is
from shelfwise.operators.scan import row_number_within
from shelfwise.fixed import DELIVERY_FEE, FREE_DELIVERY_FROM
from shelfwise.schemas import LINE_MONEY_SUM, MONEY


# ---------------------------------------------------------------- filters
def lookup(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """FLT-5: rows of ``df`` whose key is in ``keys`` (set form of a keyed
    look-up).  The keys are made distinct first (combined in each task), so a key
    that a fact table repeats millions of times arrives as a few rows."""
    names = [on] if isinstance(on, str) else list(on)
    return df.join(keys.select(*names).distinct(), on, "left_semi")


def by_status(orders: DataFrame, status: str | None) -> DataFrame:
    """FLT-8: orders with the given status, case-folded; empty keeps all."""
    if not status:
        return orders
    return orders.filter(status_is(status))


def orders_of(orders: DataFrame, users: DataFrame) -> DataFrame:
    """FLT-9 + SR-1: the orders owned by the given users, newest first."""
    owners = users.select(F.col("id").alias("user_id"))
    return newest_first(orders.join(owners, "user_id", "left_semi"))


def pending(orders: DataFrame) -> DataFrame:
    """FLT-10: pending orders (those that may be sent again)."""
    return orders.filter(status_is("pending"))


def newest_first(orders: DataFrame) -> DataFrame:
    """SR-1: newest first, id as the tie-break."""
    return orders.orderBy(F.col("created_at").desc(), F.col("id").desc())


def recent_orders(orders: DataFrame, n: int = 5) -> DataFrame:
    """SR-2: the ``n`` most recent orders (a top-n, no full sort)."""
    return newest_first(orders).limit(n)


# ---------------------------------------------------------------- joins
def admin_orders(orders: DataFrame, users: DataFrame) -> DataFrame:
    """JN-1: orders with customer name and phone, newest first."""
    return newest_first(_with_customer(orders, users))


def _with_customer(orders: DataFrame, users: DataFrame) -> DataFrame:
    phone = F.col("phone") if "phone" in users.columns else F.lit(None).cast("string")
    u = users.select(F.col("id").alias("user_id"), F.col("name").alias("customer_name"),
                     phone.alias("customer_phone"))
    return orders.join(u, "user_id", "inner").select(
        "id", "user_id", "customer_name", "customer_phone", "total_amount", "status",
        "delivery_address", "created_at")


def order_lines(items: DataFrame, products: DataFrame, extra=(),
                skew_salts: int | None = None) -> DataFrame:
    """JN-2: order lines with product name and the *current* product price.

    A product in a large share of all lines is split by AQE's skew-join
    handling (or the product side is broadcast when measured small); with
    ``skew_salts`` the join salts hot products explicitly instead.
    """
    p = products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"),
                        F.col("price").alias("current_price"))
    if skew_salts:
        from shelfwise.operators.joins import salted_join
        joined = salted_join(items, p, "product_id", "inner", salts=skew_salts)
    else:
        joined = items.join(p, "product_id", "inner")
    return joined.select(
        "order_id", "product_id", "product_name", "quantity",
        F.col("current_price").alias("price"), *extra)


def existing(df: DataFrame, parent: DataFrame, fk: str, pk: str = "id") -> tuple[DataFrame, DataFrame]:
    """JN-5: split ``df`` into rows whose ``fk`` exists in ``parent`` and rows
    whose does not (a NULL key is neither accepted nor a missing reference:
    it goes with the rejected rows)."""
    # distinct combines in each task: a repeated key arrives as a few rows
    keys = parent.select(F.col(pk).alias(fk)).distinct()
    return df.join(keys, fk, "left_semi"), df.join(keys, fk, "left_anti")


# ---------------------------------------------------------------- nesting
def numbered_lines(items: DataFrame, products: DataFrame) -> DataFrame:
    """The lines of every order as rows ``(order_id, position, product_id,
    product_name, quantity, price)``, positions from 0 by product and quantity."""
    lines = order_lines(items.select("order_id", "product_id", "quantity"), products.select("id", "name", "price"))
    return row_number_within(lines, ["order_id"], ["product_id", "quantity"], "_pos", counted=items).select(
        "order_id", (F.col("_pos") - 1).cast("int").alias("position"), "product_id", "product_name", "quantity", "price")


def orders_with_items(orders: DataFrame, items: DataFrame, products: DataFrame,
                      users: DataFrame | None = None) -> DataFrame:
    """AG-13: orders with their lines nested as ``items``
    (``array<struct<product_id, product_name, quantity, price>>``, by product and
    quantity), one row per order, newest first (SR-1).

    Orders without lines keep an empty array.  ``users`` (JN-1) adds the
    customer's name and phone.  One exchange of the lines on the order id serves
    the grouping and the join.
    """
    lines = order_lines(items.select("order_id", "product_id", "quantity"), products.select("id", "name", "price"))
    nested = (lines.groupBy("order_id")
              .agg(F.array_sort(F.collect_list(F.struct("product_id", "quantity", "product_name", "price"))).alias("_l"))
              .select(F.col("order_id").alias("id"),
                      F.transform("_l", lambda x: F.struct(
                          x["product_id"].alias("product_id"), x["product_name"].alias("product_name"),
                          x["quantity"].alias("quantity"), x["price"].alias("price"))).alias("items")))
    base = _with_customer(orders, users) if users is not None else orders
    empty = F.array().cast(nested.schema["items"].dataType)
    return newest_first(base.join(nested, "id", "left").withColumn("items", F.coalesce(F.col("items"), empty)))


def orders_with_items_of(orders: DataFrame, items: DataFrame, products: DataFrame, owners: DataFrame) -> DataFrame:
    """FLT-9 + AG-13: the order history of the given users (``id``), newest first."""
    own = orders.join(owners.select(F.col("id").alias("user_id")).distinct(), "user_id", "left_semi")
    wanted = items.join(own.select(F.col("id").alias("order_id")), "order_id", "left_semi")
    return orders_with_items(own, wanted, products)


def line_counts(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """AG-14: number of lines (of known products) per order, 0 when none."""
    known = items.join(products.select(F.col("id").alias("product_id")), "product_id", "left_semi")
    per = known.groupBy(F.col("order_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    return orders.select("id").join(per, "id", "left").select(
        "id", F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias("line_count"))


# ---------------------------------------------------------------- money
def order_totals(lines: DataFrame, orders: DataFrame | None = None, key: str = "order_id",
                 free_from=FREE_DELIVERY_FROM, fee=DELIVERY_FEE) -> DataFrame:
    """AG-15: ``subtotal = sum(quantity * price)``, ``delivery`` (0 from
    ``free_from`` up, else ``fee``) and ``total`` per order or cart.

    With ``orders`` given, orders without lines are kept with 0 / 0 / 0 (an
    empty cart shows no delivery charge).
    """
    per = lines.groupBy(key).agg(
        F.sum(F.col("quantity") * F.col("price")).cast(LINE_MONEY_SUM).alias("subtotal"),
        F.count(F.lit(1)).alias("_n"))
    if orders is not None:
        per = orders.select(F.col("id").alias(key)).join(per, key, "left")
    subtotal = F.coalesce(F.col("subtotal"), F.lit(0).cast(LINE_MONEY_SUM))
    delivery = F.when(F.coalesce(F.col("_n"), F.lit(0)) == 0, F.lit(0)) \
        .otherwise(delivery_fee(subtotal, free_from, fee)).cast(MONEY)
    return per.select(
        key, subtotal.alias("subtotal"), delivery.alias("delivery"),
        (subtotal + delivery).cast(LINE_MONEY_SUM).alias("total"))


def cart_lines(lines: DataFrame, key: str = "order_id") -> DataFrame:
    """AG-16: merge lines of the same product (quantities add up) and count
    the units of the whole cart or order."""
    merged = lines.groupBy(key, "product_id").agg(
        F.sum("quantity").cast("long").alias("quantity"),
        F.count(F.lit(1)).alias("merged_lines"))
    return merged


def cart_units(lines: DataFrame, key: str = "order_id") -> DataFrame:
    """AG-16: total units per cart or order."""
    return lines.groupBy(key).agg(F.sum("quantity").cast("long").alias("total_units"))


def order_line_text(lines_with_names: DataFrame) -> DataFrame:
    """SC-15: one text per line, ``<name> (Qty: <q>) - Rs. <amount>``."""
    return lines_with_names.withColumn("line_text", line_text("product_name", "quantity", "price"))


def order_text(lines_with_names: DataFrame, key: str = "order_id", order=("product_id", "quantity"),
               free_from=FREE_DELIVERY_FROM, fee=DELIVERY_FEE) -> DataFrame:
    """SC-15 for a whole order: the texts of its lines joined by newline in line
    order, with its money (AG-15): ``(order_id, order_text, subtotal, delivery, total)``."""
    texts = (order_line_text(lines_with_names).groupBy(key)
             .agg(F.array_sort(F.collect_list(F.struct(*order, "line_text"))).alias("_l"))
             .select(key, F.array_join(F.transform("_l", lambda x: x["line_text"]), "\n").alias("order_text")))
    return texts.join(order_totals(lines_with_names, key=key, free_from=free_from, fee=fee), key)
