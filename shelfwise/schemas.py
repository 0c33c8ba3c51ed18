"""Typed schemas of the shop tables, their keys, references, domains and defaults.

Keys are ``long`` so that the same schema holds both the small shop tables and
tables derived from large fact data.  Money is ``decimal(10,2)`` end to end;
sums widen the way Spark widens them and are cast to agreed types at the edge.
"""

from __future__ import annotations

from pyspark.sql import types as T

from shelfwise.fixed import DEFAULTS, DOMAINS, SALE_STATUSES, WIDTHS  # noqa: F401

MONEY = T.DecimalType(10, 2)
# sum(decimal(10,2)) -> decimal(20,2); sum(int * decimal(10,2)) -> decimal(31,2)
MONEY_SUM = T.DecimalType(20, 2)
LINE_MONEY_SUM = T.DecimalType(31, 2)


def _s(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


L, I, S, B, TS, D = (T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType(),
                     T.TimestampNTZType(), T.DateType())

SCHEMAS: dict[str, T.StructType] = {
    "users": _s(("id", L, False), ("name", S, False), ("email", S, False),
                ("password", S, False), ("is_verified", B, True), ("reset_token", S, True),
                ("status", S, True), ("created_at", TS, True), ("updated_at", TS, True)),
    "admins": _s(("id", L, False), ("name", S, False), ("email", S, False),
                 ("password", S, False), ("role", S, True), ("status", S, True),
                 ("created_at", TS, True), ("updated_at", TS, True)),
    "categories": _s(("id", L, False), ("name", S, False), ("description", S, True),
                     ("status", S, True), ("created_at", TS, True)),
    "products": _s(("id", L, False), ("name", S, False), ("description", S, True),
                   ("category", S, False), ("category_id", L, False), ("price", MONEY, False),
                   ("stock", I, False), ("image_url", S, True), ("color", S, True),
                   ("material", S, True), ("size", S, True), ("image_count", I, True),
                   ("status", S, True), ("created_at", TS, True), ("updated_at", TS, True)),
    "product_images": _s(("id", L, False), ("product_id", L, False), ("image_url", S, False),
                         ("is_primary", B, True), ("sort_order", I, True),
                         ("created_at", TS, True)),
    "orders": _s(("id", L, False), ("user_id", L, False), ("total_amount", MONEY, False),
                 ("status", S, True), ("delivery_address", S, False),
                 ("payment_method", S, True), ("notes", S, True), ("created_at", TS, True),
                 ("updated_at", TS, True)),
    "order_items": _s(("id", L, True), ("order_id", L, False), ("product_id", L, False),
                      ("quantity", I, False), ("price", MONEY, False), ("color", S, True),
                      ("size", S, True), ("created_at", TS, True)),
    "inventory_logs": _s(("id", L, True), ("product_id", L, False), ("old_stock", I, False),
                         ("new_stock", I, False), ("action", S, False), ("admin_id", L, True),
                         ("created_at", TS, True)),
    "activity_logs": _s(("id", L, True), ("admin_id", L, False), ("action", S, False),
                        ("details", S, True), ("ip_address", S, True), ("created_at", TS, True)),
    "user_addresses": _s(("id", L, False), ("user_id", L, False), ("address", S, False),
                         ("city", S, False), ("postal_code", S, True), ("is_default", B, True),
                         ("created_at", TS, True)),
}

# Batch inputs (the request models of the shop, in set form).
NEW_ORDERS = _s(("order_ref", L, False), ("user_id", L, False),
                ("items", T.ArrayType(_s(("product_id", L, False), ("quantity", I, False))), False),
                ("total_amount", MONEY, True), ("status", S, True), ("created_at", TS, True))
STATUS_CHANGES = _s(("order_id", L, False), ("status", S, False), ("admin_id", L, True),
                    ("ts", TS, False))

# Schemas of the driver tables the adapters read (explicit, no inference).
SOURCE_SCHEMAS: dict[str, T.StructType] = {
    "customer": _s(("c_custkey", L, True), ("c_name", S, True), ("c_nationkey", I, True),
                   ("c_acctbal", T.DoubleType(), True), ("c_mktsegment", S, True)),
    "supplier": _s(("s_suppkey", L, True), ("s_name", S, True), ("s_nationkey", I, True),
                   ("s_acctbal", T.DoubleType(), True)),
    "part": _s(("p_partkey", L, True), ("p_name", S, True), ("p_brand", S, True),
               ("p_type", S, True), ("p_size", I, True), ("p_retailprice", T.DoubleType(), True)),
    "orders": _s(("o_orderkey", L, True), ("o_custkey", L, True), ("o_orderstatus", S, True),
                 ("o_totalprice", T.DoubleType(), True), ("o_orderdate", TS, True),
                 ("o_orderpriority", S, True)),
    "lineitem": _s(("l_orderkey", L, True), ("l_partkey", L, True), ("l_suppkey", L, True),
                   ("l_linenumber", I, True), ("l_quantity", T.DoubleType(), True),
                   ("l_extendedprice", T.DoubleType(), True), ("l_discount", T.DoubleType(), True),
                   ("l_tax", T.DoubleType(), True), ("l_returnflag", S, True),
                   ("l_linestatus", S, True), ("l_shipdate", TS, True)),
    "events": _s(("event_id", L, True), ("ts", TS, True), ("user_id", L, True),
                 ("event_type", S, True), ("value", T.DoubleType(), True), ("props", S, True)),
    "pages": _s(("page_id", L, True), ("url", S, True), ("html", S, True)),
}

# Foreign keys: (child, fk column, parent, parent key, on delete).
FOREIGN_KEYS: tuple[tuple[str, str, str, str, str], ...] = (
    ("products", "category_id", "categories", "id", "RESTRICT"),
    ("product_images", "product_id", "products", "id", "CASCADE"),
    ("orders", "user_id", "users", "id", "CASCADE"),
    ("order_items", "order_id", "orders", "id", "CASCADE"),
    ("order_items", "product_id", "products", "id", "CASCADE"),
    ("inventory_logs", "product_id", "products", "id", "CASCADE"),
    ("inventory_logs", "admin_id", "admins", "id", "SET NULL"),
    ("activity_logs", "admin_id", "admins", "id", "CASCADE"),
    ("user_addresses", "user_id", "users", "id", "CASCADE"),
)
# Primary and unique keys.
UNIQUE_KEYS: dict[str, tuple[tuple[str, ...], ...]] = {
    "users": (("id",), ("email",)),
    "admins": (("id",), ("email",)),
    "categories": (("id",), ("name",)),
    "products": (("id",),),
    "product_images": (("id",),),
    "orders": (("id",),),
    "order_items": (("id",),),
    "inventory_logs": (("id",),),
    "activity_logs": (("id",),),
    "user_addresses": (("id",),),
}


def not_null_columns(table: str) -> list[str]:
    return [f.name for f in SCHEMAS[table].fields if not f.nullable]
