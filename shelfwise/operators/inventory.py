"""Inventory operators: WN-7 (price at sale), WN-1 (stock ledger), WN-4 (order
admission against stock).

The shop places one order at a time: lock each product row, check every line
against the stock *before* this order's own deductions, then insert the order,
its lines and one ledger row per line, or roll everything back.  Here the same
decisions are made for a whole batch of orders at once, in a fixed order
(``created_at``, then order id), without a per-order loop on the driver.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from shelfwise.fixed import LEDGER_ACTION
from shelfwise.operators.scan import Splitters, running_sum, splitters
from shelfwise.session import require_checkpoint_dir, written


def price_lines(items: DataFrame, products: DataFrame) -> DataFrame:
    """WN-7: stamp each new line with the product's current price (inner join:
    a line for an unknown product gets no price and no row)."""
    p = products.select(F.col("id").alias("product_id"), F.col("price").alias("_p"))
    return items.drop("price").join(p, "product_id", "inner").withColumnRenamed("_p", "price")


def stock_ledger(products: DataFrame, lines: DataFrame, orders: DataFrame,
                 line_order=("product_id", "quantity"), action: str = LEDGER_ACTION) -> DataFrame:
    """WN-1: one ledger row per accepted line, in order placement order.

    ``old_stock`` is the product's opening stock less every earlier line of
    that product; ``new_stock = old_stock - quantity``.  Lines are ordered by
    the order's ``created_at`` and id, then ``line_order`` inside the order.
    The running sum is the skew-safe keyed scan: a product on a third of all
    lines is still spread over many tasks.
    """
    o = orders.select(F.col("id").alias("order_id"), F.col("created_at").alias("_placed"))
    p = products.select(F.col("id").alias("product_id"), F.col("stock").alias("_open"))
    keep = ["order_id", "product_id", "quantity"] + [c for c in line_order
                                                     if c not in ("order_id", "product_id", "quantity")]
    l = (lines.select(*keep)
         .join(o, "order_id", "inner").join(p, "product_id", "inner"))
    l = l.withColumn("_q", F.col("quantity").cast("long"))
    run = running_sum(l, ["product_id"], ["_placed", "order_id", *line_order], ["_q"], ["_used"], counted=lines)
    new_stock = (F.col("_open") - F.col("_used")).cast("int")
    return run.select(
        "product_id", "order_id", "quantity",
        (new_stock + F.col("quantity")).cast("int").alias("old_stock"),
        new_stock.alias("new_stock"),
        F.lit(action).alias("action"),
        F.col("_placed").alias("created_at"))


class Admission(NamedTuple):
    accepted: DataFrame      # order_id
    rejected: DataFrame      # order_id, reason, product_id, available, requested
    closing_stock: DataFrame  # product_id, stock
    rounds: int


def _order_product(items: DataFrame) -> DataFrame:
    # One row per (order, product): total units and the largest single line.  Dealt
    # by order, as the join with the orders is.
    return items.repartition("order_id").groupBy("order_id", "product_id").agg(
        F.sum("quantity").cast("long").alias("total"),
        F.max("quantity").cast("long").alias("need"))


PLACE = ["created_at", "order_id"]
_DECIDED = ["order_id", "product_id", "created_at", "total", "need", "stock", "_v"]
ROUNDS_AT_ONCE = 3          # rounds of admission between two written tables,
FEW = 500_000               # with at most so many undecided pairs; one with more


def _round(pairs: DataFrame, cut: Splitters | None, recorded: bool) -> DataFrame:
    """One round over pairs with a verdict ``_v``: U undecided, A accepted in the round
    before, a accepted earlier, R rejected.  What was decided before goes on only where
    no written table has ``recorded`` it."""
    undecided, fresh, zero = F.col("_v") == "U", F.col("_v") == "A", F.lit(0).cast("long")
    run = running_sum(
        pairs.select("*", F.when(fresh, F.col("total")).otherwise(zero).alias("a_new"),
                     F.when(undecided, F.greatest(F.col("total"), zero)).otherwise(zero).alias("u_pos"),
                     F.when(undecided, F.least(F.col("total"), zero)).otherwise(zero).alias("u_neg")),
        ["product_id"], PLACE, ["a_new", "u_pos", "u_neg"], ["a_run", "pos_run", "neg_run"], inclusive=False, cut=cut)
    if recorded:
        run = run.filter(undecided)
    left, unknown = F.col("stock") - F.col("acc_before") - F.col("a_run"), F.col("stock").isNull()
    judged = run.select(
        "order_id", "product_id", "created_at", "total", "need", "stock",
        (F.col("acc_before") + F.col("a_run")).alias("acc_before"), "_v",
        F.when(unknown, False).otherwise(F.col("need") <= left - F.col("pos_run")).alias("_fits"),
        F.when(unknown, True).otherwise(F.col("need") > left - F.col("neg_run")).alias("_fails"))
    order = Window.partitionBy("order_id")          # the lines of one request
    fits, fails = F.bool_and("_fits").over(order), F.bool_or("_fails").over(order)
    verdict = F.when(undecided, F.when(fits, "A").when(fails, "R").otherwise("U")).when(fresh, "a").otherwise(F.col("_v"))
    still = F.col("_new").isin("U", "R")            # nothing reads these of an accepted pair
    return judged.withColumn("_new", verdict).select(
        "order_id", "product_id", "created_at", "total", F.when(still, F.col("need")).alias("need"), "stock",
        F.when(still, F.col("acc_before")).alias("acc_before"), F.col("_new").alias("_v"))


def admit_orders(products: DataFrame, orders: DataFrame, items: DataFrame,
                 users: DataFrame | None = None, max_rounds: int | None = None,
                 line_order: str | None = None) -> Admission:
    """WN-4: accept an order only if every line fits the stock left by earlier
    *accepted* orders; a rejected order deducts nothing.

    Exact set-based method, in rounds.  For every (order, product) pair with
    ``total`` units and largest line ``need``, and the orders before it on the
    same product:

    * ``sure_left = stock - accepted - undecided(+)`` is the least stock that
      can be left for it; ``best_left = stock - accepted - undecided(-)`` the
      most;
    * all lines ``need <= sure_left``: accept; any line ``need > best_left``:
      reject; otherwise the order stays undecided.

    The earliest undecided order has ``sure_left == best_left``, so each round
    decides at least one order.  What is decided leaves the pairs (the totals of
    accepted ones are folded into ``acc_before``), so rounds shrink.  A round, or a
    few of them (``ROUNDS_AT_ONCE``) when ``FEW`` pairs are left, makes one plan
    without a self-join, whose result is one written table; the job that writes it
    counts what is left.  Each pair is decided in one of the tables, which together
    are the verdicts.  The products with
    many pairs are cut into blocks once, before the first round; a round adds the
    sums of the blocks before.

    Orders of unknown users and orders with a line for an unknown product are
    rejected up front (``unknown_user`` / ``unknown_product``), as the shop
    does.  A rejected order reports its first failing line, whatever fails in it:
    in ``line_order`` (a column of ``items``) when given, else by product id.
    ``max_rounds`` (default: none) raises instead of looping longer.
    """
    require_checkpoint_dir(products.sparkSession)
    o = orders.select(F.col("id").alias("order_id"), "user_id", "created_at")
    if users is not None:
        known_users = users.select(F.col("id").alias("user_id"), F.lit(True).alias("_user_ok"))
        o = o.join(known_users, "user_id", "left")
    else:
        o = o.withColumn("_user_ok", F.lit(True))
    o = o.withColumn("_user_ok", F.coalesce(F.col("_user_ok"), F.lit(False)))
    stock = products.select(F.col("id").alias("product_id"), F.col("stock").cast("long").alias("stock"))

    # Every (order, product) pair of a known user's order with the order's position,
    # and a row without ``_line`` for an order without lines.  One written table.
    pairs = _order_product(items.select("order_id", "product_id", "quantity")).withColumn("_line", F.lit(True))
    size = Observation()
    pe = written(o.filter("_user_ok").select("order_id", "created_at").join(pairs, "order_id", "left")
                 .observe(size, F.count_if(F.col("_line")).alias("n")), "admission-pairs")
    n_left = size.get["n"]
    lines_of = pe.filter(F.col("_line")).drop("_line")
    cut = splitters(lines_of, ["product_id"], PLACE)

    unknown_user = o.filter(~F.col("_user_ok")).select(
        "order_id", F.lit("unknown_user").alias("reason"),
        *[F.lit(None).cast("long").alias(c) for c in ("product_id", "available", "requested")])

    # With the product's stock (NULL: unknown product, which the first round rejects).
    carried = lines_of.join(stock, "product_id", "left").select(
        "order_id", "product_id", "created_at", "total", "need", "stock",
        F.lit(0).cast("long").alias("acc_before"), F.lit("U").alias("_v"))
    steps: list[DataFrame] = []
    rounds = 0
    while n_left > 0:
        at_once = ROUNDS_AT_ONCE if n_left <= FEW else 1
        for k in range(at_once if max_rounds is None else min(at_once, max_rounds - rounds)):
            carried = _round(carried, cut, recorded=k == 0)
            rounds += 1
        left = Observation()
        steps.append(written(carried.observe(left, F.count_if(F.col("_v") == "U").alias("n")), "admission-round"))
        n_left = left.get["n"]
        if n_left and rounds == max_rounds:
            raise RuntimeError(f"order admission did not finish in {max_rounds} rounds")
        carried = steps[-1].filter(F.col("_v").isin("U", "A"))
        if not cut:         # dealt before the columns that a round derives
            carried = carried.repartition("product_id")

    decided = _union_all([t.filter(F.col("_v") != "U").select(*_DECIDED[:-1], F.upper("_v").alias("_v")) for t in steps],
                         pe.select("order_id", "product_id", "created_at", "total", "need", F.col("total").alias("stock"),
                                   F.lit("U").alias("_v")).filter(F.lit(False)))
    # One small table of the accepted orders (an order without lines passes every check).
    yes = decided.filter(F.col("_v") == "A")
    accepted = written(yes.select("order_id").unionByName(pe.filter(F.col("_line").isNull()).select("order_id")).distinct(),
                       "admission-orders")

    # Exact "available" for rejected orders: stock left by all earlier accepted
    # orders, for every pair of a known user's order; then the first line that
    # fails, an unknown product (nothing available) like one that lacks stock.
    both = decided.filter(F.col("stock").isNotNull()).select(
        "order_id", "product_id", "created_at", "need", "stock",
        F.when(F.col("_v") == "A", F.col("total")).otherwise(F.lit(0)).cast("long").alias("a_new"),
        (F.col("_v") == "R").alias("_r"))
    run = running_sum(both, ["product_id"], PLACE, ["a_new"], ["a_run"], inclusive=False, cut=cut).filter(F.col("_r"))
    failing = (run.select("order_id", "product_id", "need", (F.col("stock") - F.col("a_run")).alias("available"),
                          F.lit("insufficient_stock").alias("reason"))
               .filter(F.col("need") > F.col("available"))
               .unionByName(decided.filter(F.col("stock").isNull()).select(
                   "order_id", "product_id", "need", F.lit(0).cast("long").alias("available"),
                   F.lit("unknown_product").alias("reason"))))
    if line_order is None:
        first = failing.groupBy("order_id").agg(F.min_by(
            F.struct("product_id", "available", F.col("need").alias("q"), "reason"), "product_id").alias("_f"))
    else:
        # The lines of rejected orders, checked one by one against the stock
        # available to the order; the first in item order is reported.
        lines = items.select("order_id", "product_id", F.col("quantity").cast("long").alias("q"),
                             F.col(line_order).alias("_pos"))
        first = (lines.join(failing.drop("need"), ["order_id", "product_id"], "inner")
                 .filter((F.col("reason") == "unknown_product") | (F.col("q") > F.col("available")))
                 .groupBy("order_id")
                 .agg(F.min_by(F.struct("product_id", "available", "q", "reason"), F.col("_pos")).alias("_f")))
    rejected = first.select(
        "order_id", F.col("_f.reason").alias("reason"), F.col("_f.product_id").alias("product_id"),
        F.col("_f.available").alias("available"), F.col("_f.q").alias("requested")).unionByName(unknown_user)

    used = yes.groupBy("product_id").agg(F.sum("total").alias("_used"))
    closing = (stock.join(used, "product_id", "left")
               .select("product_id",
                       (F.col("stock") - F.coalesce(F.col("_used"), F.lit(0))).alias("stock")))
    return Admission(accepted, rejected, closing, rounds)


def _union_all(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = parts[0] if parts else empty
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Placement(NamedTuple):
    orders: DataFrame         # new order rows (shop schema), accepted orders only
    items: DataFrame          # new order_items rows, price at sale
    ledger: DataFrame         # one inventory_logs row per accepted line
    products: DataFrame       # products with the closing stock
    rejected: DataFrame       # order_ref, reason, product_id, available, requested


def place_orders(products: DataFrame, users: DataFrame, requests: DataFrame,
                 orders: DataFrame | None = None) -> Placement:
    """The order endpoint in set form (JN-5, WN-4, WN-7, WN-1, WN-5).

    ``requests`` has the :data:`shelfwise.schemas.NEW_ORDERS` shape:
    ``order_ref, user_id, items array<struct<product_id, quantity>>,
    total_amount, status, created_at``.  Orders are admitted in
    ``(created_at, order_ref)`` order against the products' stock; accepted
    ones get new ids after the largest id in ``orders`` (or keep
    ``order_ref``), their lines the current price, and one ledger row per line
    in item order.  Total and status are stored as sent.
    """
    from shelfwise.fixed import ORDER_DELIVERY_ADDRESS, ORDER_PAYMENT_METHOD
    from shelfwise.operators.maintenance import assign_ids
    from shelfwise.sources.tables import with_defaults

    # Written once: admission, new orders, their lines and the ledger read it.
    requests = written(requests, "requests")
    lines = requests.select("order_ref", "created_at",
                            F.posexplode("items").alias("line_no", "item")).select(
        F.col("order_ref").alias("order_id"), "created_at", "line_no",
        F.col("item.product_id").alias("product_id"), F.col("item.quantity").alias("quantity"))
    cand = requests.select(F.col("order_ref").alias("id"), "user_id", "created_at")
    adm = admit_orders(products, cand, lines.select("order_id", "product_id", "quantity", "line_no"),
                       users, line_order="line_no")

    accepted = requests.join(adm.accepted.withColumnRenamed("order_id", "order_ref"),
                             "order_ref", "left_semi")
    if orders is not None:
        keyed = assign_ids(orders, accepted, ["created_at", "order_ref"], "id")
    else:
        keyed = accepted.withColumn("id", F.col("order_ref"))
    new_orders = with_defaults(keyed.select(
        "id", "user_id", "total_amount", "status", "created_at",
        F.lit(ORDER_DELIVERY_ADDRESS).alias("delivery_address"),
        F.lit(ORDER_PAYMENT_METHOD).alias("payment_method"),
        F.col("created_at").alias("updated_at")), "orders")
    id_map = keyed.select("order_ref", F.col("id").alias("_new_id"))

    # joined by request, of which there are fewer than lines
    acc_lines = written(requests.select("order_ref", "created_at", "items").join(id_map, "order_ref", "inner")
                 .select(F.col("_new_id").alias("order_id"), "created_at", F.posexplode("items").alias("line_no", "item"))
                 .select("order_id", "line_no", F.col("item.product_id").alias("product_id"),
                         F.col("item.quantity").alias("quantity"), "created_at"), "accepted-lines")
    priced = price_lines(acc_lines, products)
    new_items = with_defaults(priced, "order_items")
    ledger = stock_ledger(products, acc_lines, new_orders.select("id", "created_at"),
                          line_order=("line_no",))
    closing = adm.closing_stock.select(F.col("product_id").alias("id"), F.col("stock").alias("_s"))
    new_products = (products.join(closing, "id", "left")
                    .withColumn("stock", F.coalesce(F.col("_s"), F.col("stock")).cast("int"))
                    .drop("_s").select(*products.columns))
    rejected = adm.rejected.withColumnRenamed("order_id", "order_ref")
    return Placement(new_orders, new_items, ledger, new_products, rejected)
