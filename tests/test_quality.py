"""Data-quality rules on rows made to break them (the driver data is clean
for some rules, so the oracle checks see zero rows there)."""

from decimal import Decimal

from shelfwise.operators import quality as Q


def test_rules_fire_on_bad_rows(spark):
    products = spark.createDataFrame(
        [(1, "Bag", "ok", "A", Decimal("10.00"), 5),
         (2, " ", None, "A", Decimal("0.00"), -1),
         (3, "Pouch", "x" * 3, None, None, 0)],
        "id long, name string, description string, category string, price decimal(10,2), stock int")
    got = {(r.key, r.rule) for r in Q.product_violations(products).collect()}
    assert got == {("2", "name_missing"), ("2", "description_missing"), ("2", "price_missing_or_zero"),
                   ("2", "stock_negative"), ("3", "category_missing"), ("3", "price_missing_or_zero")}

    nulls = {(r.key, r.detail) for r in Q.null_violations(products, ["description", "category"],
                                                          "products").collect()}
    assert nulls == {("2", "description"), ("3", "category")}

    items = spark.createDataFrame([(1, 5, 2), (1, 6, 0), (2, 5, -3)],
                                  "order_id long, product_id long, quantity int")
    assert {r.key for r in Q.line_violations(items).collect()} == {"1|6", "2|5"}

    users = spark.createDataFrame([(1, "a@b.co", "active"), (2, "bad@", "gone"), (3, "a@b.co", None)],
                                  "id long, email string, status string")
    assert {r.key for r in Q.bad_emails(users, "users").collect()} == {"2"}
    assert {r.key for r in Q.duplicate_keys(users, ["email"], "users").collect()} == {"a@b.co"}
    assert {r.key for r in Q.out_of_domain(users, "status", "users").collect()} == {"2"}

    orders = spark.createDataFrame([(10, 1), (11, 9), (12, None)], "id long, user_id long")
    orphans = Q.orphans(orders, "user_id", users, "id", "orders", "users").collect()
    assert [(r.key, r.detail) for r in orphans] == [("11", "9")]

    wide = spark.createDataFrame([(1, "n" * 256, Decimal("1.00"))], "id long, name string, price decimal(12,2)")
    rules = {r.rule for r in Q.width_violations(wide, "products", money_cols=("price",)).collect()}
    assert rules == {"width:name>255"}
    stacked = Q.stack(Q.line_violations(items), Q.bad_emails(users, "users"))
    assert stacked.count() == 3
