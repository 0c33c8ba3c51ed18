"""Catalogue operators: FLT-1, FLT-2, FLT-6, FLT-7, FLT-11, AG-11, AG-12,
WN-2, WN-3, SR-3, SR-4, SR-5, JN-7.

Image lists are numbered rows, ``(product_id, position, image_url)``, for all
products alike; nesting them into one array per product is a separate last step
(the page's shape), the same at every size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.expressions import search_match
from shelfwise.operators.scan import row_number_within

CATALOG_COLUMNS = ("id", "name", "description", "price", "stock", "category", "category_id",
                   "color", "material", "size", "created_at")


def number_images(images: DataFrame, key: str = "product_id",
                  order=("sort_order", "id"), out: str = "position", counted: DataFrame | None = None) -> DataFrame:
    """WN-3: number images 0, 1, ... within ``key`` in ``order``; position 0
    is primary.  Skew-safe (a key may hold any share of the rows)."""
    numbered = row_number_within(images, [key], list(order), "_pos", counted)
    return (numbered.withColumn(out, (F.col("_pos") - 1).cast("int"))
            .withColumn("is_primary", F.col(out) == 0)
            .drop("_pos"))


def image_urls(images: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """AG-11: image URLs per product in ``(sort_order, id)`` order, as rows
    ``(product_id, position, image_url)`` with positions from 0."""
    narrow = images.select("product_id", "sort_order", "id", "image_url")
    return number_images(narrow, counted=counted).select("product_id", "position", "image_url")


def nest_images(urls: DataFrame) -> DataFrame:
    """AG-11 as the page shows it: one row ``(product_id, images)`` per product."""
    return urls.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("position", "image_url"))).alias("_l")) \
        .select("product_id", F.transform("_l", lambda x: x["image_url"]).alias("images"))


def catalog(products: DataFrame, images: DataFrame) -> DataFrame:
    """FLT-1 + AG-11: in-stock products with their image URLs (``[]`` when none),
    one row per product.  The stock filter is pushed to the scan of ``products``.
    """
    in_stock = products.filter(F.col("stock") > 0).select(*CATALOG_COLUMNS)
    # only the images of shown products are numbered and nested (positions
    # are per product, so this changes no result)
    shown = images.join(in_stock.select(F.col("id").alias("product_id")), "product_id", "left_semi")
    nested = nest_images(image_urls(shown, counted=images)).withColumnRenamed("product_id", "id")
    return in_stock.join(nested, "id", "left").select(
        *CATALOG_COLUMNS, F.coalesce(F.col("images"), F.array().cast("array<string>")).alias("images"))


def image_counts(products: DataFrame, images: DataFrame) -> DataFrame:
    """AG-12: recompute ``image_count`` for every product (0 when none)."""
    counts = images.groupBy(F.col("product_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    return (products.join(counts, "id", "left")
            .withColumn("image_count", F.coalesce(F.col("_n"), F.lit(0)).cast("int"))
            .drop("_n").select(*products.columns))


def first_image(images: DataFrame) -> DataFrame:
    """WN-2: the first image per product by ``(sort_order, id)``.

    ``min_by`` is a mergeable aggregate: combined map-side, so no product's
    images are gathered in one place.
    """
    return images.groupBy("product_id").agg(
        F.min_by(F.struct("id", "image_url"), F.struct("sort_order", "id")).alias("_f")
    ).select("product_id", F.col("_f.id").alias("image_id"), F.col("_f.image_url").alias("image_url"))


def search(products: DataFrame, term: str | None) -> DataFrame:
    """FLT-6: case-folded substring search on name or description."""
    return products.filter(search_match(term))


def by_category(products: DataFrame, category: str | None) -> DataFrame:
    """FLT-7: products of one category; empty or ``None`` keeps all."""
    if not category:
        return products
    return products.filter(F.col("category") == F.lit(category))


def sort_catalog(products: DataFrame, mode: str | None) -> DataFrame:
    """SR-3: ``price-low``, ``price-high``, ``newest`` (id descending); any
    other mode leaves the order as it is.  Ties keep id order, as the page's
    stable sort does."""
    if mode == "price-low":
        return products.orderBy(F.col("price").asc(), F.col("id").asc())
    if mode == "price-high":
        return products.orderBy(F.col("price").desc(), F.col("id").asc())
    if mode == "newest":
        return products.orderBy(F.col("id").desc())
    return products


def filter_catalog(products: DataFrame, term: str | None = None, category: str | None = None,
                   mode: str | None = None) -> DataFrame:
    """The catalogue page's filter: search, category, then sort."""
    return sort_catalog(by_category(search(products, term), category), mode)


def head(products: DataFrame, n: int = 5) -> DataFrame:
    """SR-4: the first ``n`` products by id (a top-n: ``TakeOrderedAndProject``)."""
    return products.orderBy("id").limit(n)


def product_images(images: DataFrame, products: DataFrame) -> DataFrame:
    """SR-5: the images of the given products, by product then ``(sort_order, id)``."""
    keys = products.select(F.col("id").alias("product_id"))
    return (images.join(keys, "product_id", "left_semi")
            .orderBy("product_id", "sort_order", "id"))


def active_categories(categories: DataFrame) -> DataFrame:
    """FLT-2: active categories ``(id, name)`` by name."""
    return categories.filter(F.col("status") == "active").select("id", "name").orderBy("name")


def category_list(categories: DataFrame) -> DataFrame:
    """FLT-11: categories ``(id, name, description)``."""
    return categories.select("id", "name", "description")


def resolve_category(products: DataFrame, categories: DataFrame) -> DataFrame:
    """JN-7: category name from ``category_id``, falling back to the stored text."""
    names = categories.select(F.col("id").alias("_cid"), F.col("name").alias("_cname"))
    return (products.join(names, products["category_id"] == names["_cid"], "left")
            .withColumn("category", F.coalesce(F.col("_cname"), F.col("category")))
            .drop("_cid", "_cname"))
