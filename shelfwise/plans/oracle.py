"""Oracle SQL building blocks: the FIXTURES section 3 adapter as DuckDB CTEs.

Each registered query's oracle is ``WITH <needed CTEs> <body>``; the CTEs
derive the shop tables from the driver's views with the same expressions the
Spark adapter uses, so both sides compute from identical inputs.
"""

from __future__ import annotations

import re

AS_OF = "2001-08-01 12:00:00"
AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"

# name -> SQL body.  Order matters only through the dependency scan below.
CTES: dict[str, str] = {
    "s_users": """SELECT c_custkey AS id, c_name AS name,
        concat(lower(replace(c_name, '#', '')), '@example.com') AS email,
        CASE WHEN c_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status
      FROM customer""",
    "s_categories": """SELECT CAST(dense_rank() OVER (ORDER BY p_type) AS BIGINT) AS id,
        p_type AS name,
        CASE WHEN p_type = 'PROMO' THEN 'inactive' ELSE 'active' END AS status
      FROM (SELECT DISTINCT p_type FROM part) t""",
    "s_products": """SELECT p_partkey AS id, p_name AS name,
        concat(p_name, ' ', lower(p_type)) AS description, p_type AS category,
        c.id AS category_id, CAST(p_retailprice AS DECIMAL(10,2)) AS price,
        CAST(p_size % 10 AS INTEGER) AS stock, split_part(p_name, ' ', 1) AS color,
        p_brand AS material
      FROM part LEFT JOIN s_categories c ON c.name = part.p_type""",
    "s_images": """SELECT page_id AS id, page_id % 100 AS product_id, url AS image_url,
        CAST(row_number() OVER (PARTITION BY page_id % 100 ORDER BY page_id) - 1 AS INTEGER)
          AS sort_order
      FROM pages""",
    "s_orders": """SELECT o_orderkey AS id, o_custkey AS user_id,
        CAST(o_totalprice AS DECIMAL(10,2)) AS total_amount,
        CASE WHEN o_orderstatus = 'F' THEN 'delivered'
             WHEN o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'shipped'
             WHEN o_orderstatus = 'O' THEN 'confirmed'
             WHEN o_orderpriority = '5-LOW' THEN 'cancelled'
             ELSE 'pending' END AS status,
        'Pakistan' AS delivery_address,
        o_orderdate AS created_at
      FROM orders""",
    "s_items": """SELECT l_orderkey AS order_id, l_partkey AS product_id,
        CAST(l_quantity AS INTEGER) AS quantity,
        CAST(floor(l_extendedprice / l_quantity) AS DECIMAL(10,2)) AS price,
        l_shipdate AS created_at
      FROM lineitem""",
    "s_changes": """SELECT l_orderkey AS order_id,
        CASE WHEN l_returnflag = 'R' THEN 'cancelled'
             WHEN l_returnflag = 'A' THEN 'delivered' ELSE 'shipped' END AS status,
        l_suppkey AS admin_id, l_shipdate AS ts
      FROM lineitem""",
}


def _deps(sql: str) -> list[str]:
    return [n for n in CTES if re.search(rf"\b{n}\b", sql)]


def with_ctes(body: str) -> str:
    """Prefix ``body`` with the adapter CTEs it uses (transitively, in order)."""
    needed: list[str] = []

    def visit(name: str):
        if name in needed:
            return
        for d in _deps(CTES[name]):
            if d != name:
                visit(d)
        needed.append(name)

    for n in _deps(body):
        visit(n)
    if not needed:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({CTES[n]})" for n in needed)
    body = body.strip()
    if m := re.match(r"(?i)^(with(\s+recursive)?)\s", body):
        return f"{m[1].upper()} {ctes},\n{body[m.end():].lstrip()}"
    return f"WITH {ctes}\n{body}"
