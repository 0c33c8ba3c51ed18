"""Customer operators: AG-4, AG-5 (with JN-3), JN-6, FLT-11.

Orders are aggregated per user first (map-side partial aggregation absorbs a
user holding a large share of all orders), then joined to users on one row
per key, so users without orders keep zero counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.schemas import MONEY_SUM


def _phone(users: DataFrame):
    # The shop selects u.phone, which its current schema no longer has.
    return F.col("phone") if "phone" in users.columns else F.lit(None).cast("string")


def customers(users: DataFrame, orders: DataFrame) -> DataFrame:
    """AG-4: every user with the number of their orders (all statuses, 0 kept)."""
    per_user = orders.groupBy(F.col("user_id").alias("id")).agg(F.count("id").alias("n"))
    return (users.select("id", "name", "email", _phone(users).alias("phone"))
            .join(per_user, "id", "left")
            .select("id", "name", "email", "phone",
                    F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("order_count")))


def customer_order_summary(users: DataFrame, orders: DataFrame) -> DataFrame:
    """AG-5 (the customer summary view): orders, total spent (0 when
    none) and the last order time (NULL when none) per user, all statuses."""
    per_user = orders.groupBy(F.col("user_id")).agg(
        F.count("id").alias("total_orders"),
        F.sum("total_amount").alias("total_spent"),
        F.max("created_at").alias("last_order_date"))
    return (users.select(F.col("id").alias("user_id"), "name", "email")
            .join(per_user, "user_id", "left")
            .select("user_id", "name", "email",
                    F.coalesce(F.col("total_orders"), F.lit(0)).cast("long").alias("total_orders"),
                    F.coalesce(F.col("total_spent"), F.lit(0)).cast(MONEY_SUM).alias("total_spent"),
                    "last_order_date"))


def new_users(candidates: DataFrame, users: DataFrame, order_by=("created_at",)) -> DataFrame:
    """JN-6: registrations whose e-mail is not taken yet (case-folded).

    Within one batch the earliest candidate per e-mail wins (``order_by``,
    then the candidate columns as a tie-break).  Repeated e-mails are reduced
    by ``min_by`` over a struct (a mergeable aggregate, so a popular address
    is combined map-side), then anti-joined against the existing users.
    """
    cand = candidates.withColumn("_email_key", F.lower(F.trim(F.col("email"))))
    rank = F.struct(*[F.col(c) for c in order_by], *[F.col(c) for c in candidates.columns
                                                     if c not in order_by])
    first = cand.groupBy("_email_key").agg(F.min_by(F.struct(*[F.col(c) for c in candidates.columns]),
                                                    rank).alias("r"))
    taken = users.select(F.lower(F.trim(F.col("email"))).alias("_email_key"))
    return first.join(taken, "_email_key", "left_anti").select("r.*")


def public_users(users: DataFrame) -> DataFrame:
    """FLT-11: users without credentials."""
    return users.select("id", "name", "email")


def public_admins(admins: DataFrame) -> DataFrame:
    """FLT-11: admins without credentials."""
    return admins.select("id", "name", "email", "role")

