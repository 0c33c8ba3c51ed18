"""Image upload intake in batch form (SRC-3 + DQ-8 + WN-3 + SC-20 + AG-12).

An upload is one folder of files for one product.  As in the shop, an upload
is all or nothing: if the product does not exist, or any file breaks a rule
(type, leading bytes, size, more than five files), none of its files is
stored.  Accepted files are numbered in file-name order (position 0 is the
primary image) and get a content-derived name, so a retried job produces the
same names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.fixed import UPLOAD_URL_PREFIX
from shelfwise.functions.expressions import file_extension, name_token
from shelfwise.operators.catalog import image_counts, number_images
from shelfwise.operators.maintenance import assign_ids
from shelfwise.operators.quality import image_violations


class Intake(NamedTuple):
    images: DataFrame        # new product_images rows
    rejected: DataFrame      # upload, product_id, reason
    products: DataFrame      # products with image_count recomputed


def intake_uploads(manifest: DataFrame, products: DataFrame, images: DataFrame,
                   url_prefix: str = UPLOAD_URL_PREFIX) -> Intake:
    """``manifest`` is :func:`shelfwise.sources.read_images` output whose
    ``upload`` folder name is the product id."""
    # the digest of each file stands for its bytes from here on
    m = manifest.select("path", "upload", "file_name", F.col("upload").cast("long").alias("product_id"),
                        F.sha2("content", 256).alias("digest"))
    bad_rules = image_violations(manifest).select(
        F.col("key").alias("path"), F.col("rule").alias("reason"))
    by_rule = (m.join(bad_rules, "path", "inner")
               .groupBy("upload", "product_id").agg(F.min("reason").alias("reason")))
    known = products.select(F.col("id").alias("product_id"))
    no_product = (m.join(known, "product_id", "left_anti").select("upload", "product_id")
                  .distinct().withColumn("reason", F.lit("unknown_product")))
    rejected = no_product.unionByName(by_rule.join(no_product.select("upload"), "upload", "left_anti"))

    ok = m.join(rejected.select("upload"), "upload", "left_anti")
    numbered = number_images(ok.select("upload", "product_id", "file_name", "digest", "path"),
                             key="upload", order=("file_name", "path"), out="sort_order")
    rows = numbered.select(
        "product_id",
        F.concat(F.lit(url_prefix),
                 name_token(F.col("product_id"), F.col("file_name"), F.col("digest")),
                 F.lit("."), file_extension("file_name")).alias("image_url"),
        "is_primary", "sort_order",
        F.lit(None).cast("timestamp_ntz").alias("created_at"))
    new_images = assign_ids(images, rows, ["product_id", "sort_order"])
    all_images = images.select(*new_images.columns).unionByName(new_images)
    return Intake(new_images, rejected, image_counts(products, all_images))
