"""Catalogue search, paging, change feeds and product reviews."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.kernels import ratio, rounded

MAX_PAGE, MAX_REVIEW_PAGE, FEATURED = 100, 50, 8
STARS = [1, 2, 3, 4, 5]


def product_search(products: DataFrame, *, category: str | None = None, featured: bool | None = None,
                   search: str | None = None, min_price: float = 0, max_price: float = 999999) -> DataFrame:
    """Filtered products. The texts are used as patterns, so % and _ keep
    their wildcard meaning."""
    out = products.where(F.col("price").between(min_price, max_price))
    if category:
        out = out.where(F.col("category").ilike(f"%{category}%"))
    if featured is not None:
        out = out.where(F.col("is_featured") == featured)
    if search:
        out = out.where(F.col("name").ilike(f"%{search}%") | F.col("description").ilike(f"%{search}%"))
    return out


def _page_bounds(limit: int, offset: int, most: int) -> None:
    if not 0 < limit <= most or offset < 0:
        raise ValueError(f"limit must be in 1..{most} and offset not negative")


def page(rows: DataFrame, *, limit: int = 20, offset: int = 0, order: tuple[str, ...] = ("sku",)) -> DataFrame:
    _page_bounds(limit, offset, MAX_PAGE)
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_info(rows: DataFrame, *, limit: int = 20, offset: int = 0) -> DataFrame:
    _page_bounds(limit, offset, MAX_PAGE)
    total = F.count(F.lit(1))
    return rows.agg(total.alias("total"), F.lit(limit).alias("limit"), F.lit(offset).alias("offset"),
                    F.ceil(total / limit).cast("bigint").alias("pages"))


def products_by_id(products: DataFrame, ids: DataFrame) -> DataFrame:
    return products.join(ids.select("id"), "id", "left_semi")


def missing_ids(products: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("id").distinct().join(products, "id", "left_anti")


def apply_changes(products: DataFrame, changes: DataFrame, *order: str) -> DataFrame:
    """Applies a feed of (op, id, columns) with op create, update or delete.

    Updates and deletes of ids that do not exist at that point have no effect:
    whatever precedes the last create or delete of an id is settled by it, and
    only updates after it count.
    """
    body = [c for c in products.columns if c != "id"]
    at = F.struct(*order)
    hard = F.col("op").isin("create", "delete")
    feed = changes.groupBy("id").agg(
        F.max_by("op", F.when(hard, at)).alias("_hard"), F.max(F.when(hard, at)).alias("_hard_at"),
        F.max_by(F.struct(*body), F.when(F.col("op") == "create", at)).alias("_created"),
        F.max_by(F.struct(*body), F.when(F.col("op") == "update", at)).alias("_updated"),
        F.max(F.when(F.col("op") == "update", at)).alias("_updated_at"))
    joined = products.withColumn("_old", F.struct(*body)).select("id", "_old").join(feed, "id", "full_outer")
    base = F.when(F.col("_hard") == "delete", F.lit(None)).when(F.col("_hard") == "create", F.col("_created")) \
            .otherwise(F.col("_old"))
    later = F.col("_updated_at").isNotNull() & (F.col("_hard_at").isNull() | (F.col("_updated_at") > F.col("_hard_at")))
    settled = joined.withColumn("_base", base).where(F.col("_base").isNotNull())
    final = settled.withColumn("_row", F.when(later, F.col("_updated")).otherwise(F.col("_base")))
    return final.select("id", *[F.col(f"_row.{c}").alias(c) for c in body])


def load_new_products(existing: DataFrame, incoming: DataFrame, *order: str) -> DataFrame:
    """Rows to insert: the first per sku in ``order`` whose sku is new."""
    first = F.row_number().over(Window.partitionBy("sku").orderBy(*order))
    fresh = incoming.withColumn("_r", first).where("_r = 1").drop("_r")
    return fresh.join(existing.select("sku"), "sku", "left_anti").select(*incoming.columns)


def fill_images(products: DataFrame, images: DataFrame) -> DataFrame:
    """Sets image_url from (sku, image_url) where it is NULL; nothing else changes."""
    named = images.groupBy("sku").agg(F.min("image_url").alias("_new"))
    out = products.join(named, "sku", "left").withColumn("image_url", F.coalesce("image_url", "_new"))
    return out.select(*products.columns)


def featured_products(products: DataFrame, n: int = FEATURED) -> DataFrame:
    return product_search(products, featured=True).orderBy("sku").limit(n)


def half_up(x: Column) -> Column:
    """Rounds to a whole number, halves towards positive infinity."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def with_discount(products: DataFrame) -> DataFrame:
    off = (F.lit(1.0) - F.col("price").cast("double") / F.col("original_price").cast("double")) * 100
    there = F.coalesce(F.col("original_price"), F.lit(0)) != 0
    return products.withColumn("discount_pct", F.when(there, half_up(off)).otherwise(F.lit(0)))


# --- reviews ---------------------------------------------------------------------

def review_order(sort: str) -> list[Column]:
    orders = {"recent": F.col("review_date").desc_nulls_last(), "highest": F.col("stars").desc(),
              "lowest": F.col("stars").asc()}
    if sort not in orders:
        raise ValueError(f"sort must be one of {sorted(orders)}")
    rest = ["review_date", "stars", "title", "author", "body", "verified"]
    return [orders[sort], *[F.col(c).asc_nulls_last() for c in rest]]


def reviews_page(reviews: DataFrame, *, sort: str = "recent", limit: int = 10, offset: int = 0,
                 product_id: object = None) -> DataFrame:
    """One page of reviews per product (or of one product). The rank limit is
    applied before the shuffle."""
    _page_bounds(limit, offset, MAX_REVIEW_PAGE)
    rows = reviews if product_id is None else reviews.where(F.col("product_id") == F.lit(product_id))
    w = Window.partitionBy("product_id").orderBy(*review_order(sort))
    ranked = rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= offset + limit)
    return ranked.where(F.col("position") > offset)


def star_distribution(reviews: DataFrame, *, limit: int = 10) -> DataFrame:
    """Per product: reviews per star (zero-filled), total and page count."""
    counts = [F.count_if(F.col("stars") == s).alias(f"stars_{s}") for s in STARS]
    total = F.count(F.lit(1))
    return reviews.groupBy("product_id").agg(*counts, total.alias("total"),
                                             F.ceil(total / limit).cast("bigint").alias("pages"))


def rating_summary(distribution: DataFrame) -> DataFrame:
    """Average and bar percentages out of a star distribution."""
    total = F.col("total")
    stars = sum((F.col(f"stars_{s}") * s for s in STARS[1:]), F.col("stars_1"))
    average = F.coalesce(rounded(ratio(stars, total), 4), F.lit(0.0)).alias("avg_rating")
    bars = [F.when(total > 0, half_up(F.col(f"stars_{s}") / total * 100)).otherwise(F.lit(0)).alias(f"pct_{s}")
            for s in STARS]
    return distribution.select("product_id", average, *bars)
