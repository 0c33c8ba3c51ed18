"""Shop tables derived from the driver's test tables (FIXTURES section 3).

``shop_tables(spark, sf_dir)`` returns lazily built, typed shop tables.  Every
column is a native expression of the source columns, so filters on shop columns
that map to stored columns still reach the Parquet scan, and nothing is written
or read before a query asks for it.  A deployment that wants its shop tables
stored writes them once with :func:`write_shop_tables`.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.fixed import ORDER_DELIVERY_ADDRESS, ORDER_PAYMENT_METHOD
from shelfwise.operators.scan import row_number_within
from shelfwise.schemas import MONEY
from shelfwise.sources.tables import read_table


class ShopTables:
    """Shop tables over one folder of driver tables, each a plan."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base

    @cached_property
    def users(self) -> DataFrame:
        return self._derive_users()

    @cached_property
    def categories(self) -> DataFrame:
        return self._derive_categories()

    @cached_property
    def products(self) -> DataFrame:
        return self._derive_products()

    @cached_property
    def product_images(self) -> DataFrame:
        return self._derive_product_images()

    @cached_property
    def orders(self) -> DataFrame:
        return self._derive_orders()

    @cached_property
    def order_items(self) -> DataFrame:
        return self._derive_order_items()

    @cached_property
    def events(self) -> DataFrame:
        return self._derive_events()

    @cached_property
    def status_changes(self) -> DataFrame:
        return self._derive_status_changes()

    def source(self, name: str) -> DataFrame:
        return read_table(self.spark, self.base, name, source=True)

    def _derive_users(self) -> DataFrame:
        c = self.source("customer")
        return c.select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit(""))),
                     F.lit("@example.com")).alias("email"),
            F.lit("*").alias("password"),
            F.lit(False).alias("is_verified"),
            F.lit(None).cast("string").alias("reset_token"),
            F.when(F.col("c_acctbal") < 0, "inactive").otherwise("active").alias("status"),
            F.lit(None).cast("timestamp_ntz").alias("created_at"),
            F.lit(None).cast("timestamp_ntz").alias("updated_at"),
        )

    def _derive_categories(self) -> DataFrame:
        # dense_rank over p_type == position of the type among the distinct types, a small domain.
        types = self.source("part").select(F.col("p_type").alias("name")).distinct()
        ranked = types.withColumn("id", F.row_number().over(Window.orderBy("name")))
        return ranked.select(
            F.col("id").cast("long").alias("id"),
            "name",
            F.lit(None).cast("string").alias("description"),
            F.when(F.col("name") == "PROMO", "inactive").otherwise("active").alias("status"),
            F.lit(None).cast("timestamp_ntz").alias("created_at"),
        )

    def _derive_products(self) -> DataFrame:
        p = self.source("part")
        cats = self.categories.select(F.col("name").alias("p_type"), F.col("id").alias("category_id"))
        return p.join(cats, "p_type", "left").select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("name"),
            F.concat(F.col("p_name"), F.lit(" "), F.lower(F.col("p_type"))).alias("description"),
            F.col("p_type").alias("category"),
            F.col("category_id"),
            F.col("p_retailprice").cast(MONEY).alias("price"),
            (F.col("p_size") % 10).cast("int").alias("stock"),
            F.lit(None).cast("string").alias("image_url"),
            F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)).alias("color"),
            F.col("p_brand").alias("material"),
            F.lit(None).cast("string").alias("size"),
            F.lit(0).alias("image_count"),
            F.lit("active").alias("status"),
            F.lit(None).cast("timestamp_ntz").alias("created_at"),
            F.lit(None).cast("timestamp_ntz").alias("updated_at"),
        )

    def _derive_product_images(self) -> DataFrame:
        pg = self.source("pages").select(
            F.col("page_id").alias("id"),
            (F.col("page_id") % 100).alias("product_id"),
            F.col("url").alias("image_url"))
        numbered = row_number_within(pg, ["product_id"], ["id"], "pos")
        return numbered.select(
            "id", "product_id", "image_url",
            (F.col("pos") == 1).alias("is_primary"),
            (F.col("pos") - 1).cast("int").alias("sort_order"),
            F.lit(None).cast("timestamp_ntz").alias("created_at"),
        )

    def _derive_orders(self) -> DataFrame:
        o = self.source("orders")
        status = (F.when(F.col("o_orderstatus") == "F", "delivered")
                  .when((F.col("o_orderstatus") == "O")
                        & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "shipped")
                  .when(F.col("o_orderstatus") == "O", "confirmed")
                  .when(F.col("o_orderpriority") == "5-LOW", "cancelled")
                  .otherwise("pending"))
        return o.select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_totalprice").cast(MONEY).alias("total_amount"),
            status.alias("status"),
            F.lit(ORDER_DELIVERY_ADDRESS).alias("delivery_address"),
            F.lit(ORDER_PAYMENT_METHOD).alias("payment_method"),
            F.lit(None).cast("string").alias("notes"),
            F.col("o_orderdate").alias("created_at"),
            F.col("o_orderdate").alias("updated_at"),
        )

    def _derive_order_items(self) -> DataFrame:
        li = self.source("lineitem")
        return li.select(
            F.lit(None).cast("long").alias("id"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            # try_divide: a zero quantity gives a NULL price (flagged by DQ-1), not a failed job
            F.floor(F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))).cast(MONEY).alias("price"),
            F.lit(None).cast("string").alias("color"),
            F.lit(None).cast("string").alias("size"),
            F.col("l_shipdate").alias("created_at"),
        )

    def _derive_events(self) -> DataFrame:
        return self.source("events").select("event_id", "ts", "user_id", "event_type",
                                            "value", "props")

    def _derive_status_changes(self) -> DataFrame:
        """A status-change feed derived from order lines: each shipped line
        reports its order's state (R returned -> cancelled, A accepted ->
        delivered, otherwise shipped) at its ship date, by its supplier."""
        li = self.source("lineitem")
        return li.select(
            F.col("l_orderkey").alias("order_id"),
            F.when(F.col("l_returnflag") == "R", "cancelled")
             .when(F.col("l_returnflag") == "A", "delivered")
             .otherwise("shipped").alias("status"),
            F.col("l_suppkey").alias("admin_id"),
            F.col("l_shipdate").alias("ts"),
        )


def shop_tables(spark: SparkSession, base: str) -> ShopTables:
    """The shop tables over ``base``."""
    return ShopTables(spark, base.rstrip("/"))


def write_shop_tables(tables: ShopTables, path: str, names=("users", "categories", "products", "product_images", "orders",
                                                            "order_items")) -> None:
    """The one-off job of a deployment: store the shop tables below ``path``,
    orders by month, so that reports over a time span read only its months."""
    for name in names:
        df = getattr(tables, name)
        if name == "orders":
            (df.withColumn("created_month", F.trunc(F.col("created_at"), "MM"))
             .repartition("created_month", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("created_at")
             .write.partitionBy("created_month").parquet(f"{path}/{name}.parquet"))
        else:
            df.write.parquet(f"{path}/{name}.parquet")
