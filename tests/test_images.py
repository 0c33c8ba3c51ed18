import os
import tempfile

from shelfwise.operators.quality import image_violations
from shelfwise.sources.tables import read_images

PNG = bytes.fromhex("89504E470D0A1A0A") + b"\0" * 24
JPG = b"\xff\xd8\xff\xe0\x00\x10JFIF\x00" + b"\0" * 20
WEBP = b"RIFF\x24\x00\x00\x00WEBPVP8 " + b"\0" * 16
GIF = b"GIF89a" + b"\0" * 26


def _write(d, name, data):
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, name), "wb") as f:
        f.write(data)


def test_image_manifest_rules(spark):
    root = tempfile.mkdtemp(prefix="sw-img-")
    _write(f"{root}/u1", "a.png", PNG)
    _write(f"{root}/u1", "b.JPG", JPG)
    _write(f"{root}/u1", "c.webp", WEBP)
    _write(f"{root}/u1", "d.png", GIF)          # wrong leading bytes
    _write(f"{root}/u1", "e.gif", GIF)          # wrong extension and bytes
    for i in range(6):                          # six files in one upload
        _write(f"{root}/u2", f"{i}.png", PNG)
    imgs = read_images(spark, root)
    assert imgs.count() == 11
    v = {(r.key.split("/")[-2] + "/" + r.key.split("/")[-1], r.rule)
         for r in image_violations(imgs).collect()}
    assert ("u1/d.png", "content_type") in v
    assert ("u1/e.gif", "extension") in v and ("u1/e.gif", "content_type") in v
    assert not any(k.startswith("u1/a") or k.startswith("u1/b") or k.startswith("u1/c") for k, _ in v)
    assert sum(1 for k, r in v if r == "too_many_in_upload") == 6


def test_upload_intake_all_or_nothing(spark):
    from shelfwise.operators.uploads import intake_uploads
    from shelfwise.sources.tables import seed_products

    root = tempfile.mkdtemp(prefix="sw-up-")
    _write(f"{root}/3", "b.png", PNG)
    _write(f"{root}/3", "a.jpg", JPG)
    _write(f"{root}/4", "x.png", PNG)
    _write(f"{root}/4", "y.png", GIF)        # one bad file rejects the whole upload
    _write(f"{root}/99", "z.png", PNG)       # no such product
    images = spark.createDataFrame([(1, 3, "/old.png", True, 0, None)],
                                   "id long, product_id long, image_url string, is_primary boolean, "
                                   "sort_order int, created_at timestamp_ntz")
    res = intake_uploads(read_images(spark, root), seed_products(spark), images)
    new = sorted((r.product_id, r.sort_order, r.is_primary, r.id) for r in res.images.collect())
    assert new == [(3, 0, True, 2), (3, 1, False, 3)]
    urls = [r.image_url for r in res.images.orderBy("sort_order").collect()]
    assert urls[0].startswith("/uploads/") and urls[0].endswith(".jpg")
    again = [r.image_url for r in intake_uploads(read_images(spark, root), seed_products(spark),
                                                 images).images.orderBy("sort_order").collect()]
    assert urls == again                     # content-derived names repeat
    rej = {r.product_id: r.reason for r in res.rejected.collect()}
    assert rej == {4: "content_type", 99: "unknown_product"}
    counts = {r.id: r.image_count for r in res.products.collect()}
    assert counts[3] == 3 and counts[4] == 0
