"""Sources (typed reads, seeds, image files, migration) and sinks (append)."""

from shelfwise.sources.adapters import ShopTables, shop_tables  # noqa: F401
from shelfwise.sources.sinks import append, check_schema  # noqa: F401
from shelfwise.sources.tables import (  # noqa: F401
    conform,
    read_images,
    read_jdbc,
    read_table,
    seed_categories,
    seed_products,
    with_defaults,
)
