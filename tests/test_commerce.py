import random

import pytest
from pyspark.sql import functions as F

from parley.operators import catalog, orders


def fold(events):
    """The cart store, event by event."""
    carts = {}
    for cart, item, action, q, price, _ in sorted(events, key=lambda e: e[5]):
        items = carts.setdefault(cart, {})
        if action == "clear":
            items.clear()
        elif action == "remove" or (action == "update" and q <= 0):
            items.pop(item, None)
        elif action == "update" and item in items:
            items[item] = (q, items[item][1])
        elif action == "add":
            old = items.get(item)
            items[item] = (old[0] + q, old[1]) if old else (q, price)
    return {(c, i): v for c, items in carts.items() for i, v in items.items()}


@pytest.mark.parametrize("seed", range(6))
def test_cart_equals_event_fold(spark, seed):
    rng = random.Random(seed)
    events = [(rng.randint(1, 3), rng.choice("xyz"), rng.choices(["add", "update", "remove", "clear"], [5, 4, 2, 1])[0],
               rng.randint(-1, 5), float(rng.randint(1, 9)), i) for i in range(80)]
    events = [(c, i, a, abs(q) + 1 if a == "add" else q, p, at) for c, i, a, q, p, at in events]
    events = [(c, None if a == "clear" else i, a, q, p, at) for c, i, a, q, p, at in events]
    df = spark.createDataFrame(events, "cart int, item string, action string, quantity int, price double, position bigint")
    got = {(r.cart, r.item): (r.quantity, r.price) for r in orders.merge_carts(df).collect()}
    assert got == fold(events)


@pytest.mark.parametrize("price,quantity,want", [
    ("49.99", 1, (49.99, 4.00, 9.99, 63.98)), ("50.00", 1, (50.00, 4.00, 0.00, 54.00)), ("10.05", 1, (10.05, 0.80, 9.99, 20.84))])
def test_pricing(spark, price, quantity, want):
    items = spark.createDataFrame([(1, price, quantity)], "order_id int, price string, quantity int")
    row = orders.order_pricing(items).first()
    assert tuple(float(x) for x in row[1:]) == want


def test_unknown_and_bad_statuses(spark):
    stored = spark.createDataFrame([(1, "pending"), (2, "pending")], "id int, status string")
    updates = spark.createDataFrame([(1, "shipped", 1), (1, "lost", 2), (9, "shipped", 1), (2, None, 1)],
                                    "order_id int, status string, at int")
    assert dict(map(tuple, orders.apply_statuses(stored, updates, "at").collect())) == {1: "shipped", 2: "pending"}
    assert orders.rejected_statuses(updates).count() == 2


def test_user_orders_and_registration(spark):
    rows = spark.createDataFrame([(1, 7, 1), (2, 7, 3), (3, 8, 2)], "id int, user_id int, created_at int")
    assert [r.id for r in orders.user_orders(rows, 7).collect()] == [2, 1]
    old = spark.createDataFrame([("a@x",)], "email string")
    new = spark.createDataFrame([("a@x", 1), ("b@x", 2), ("b@x", 3)], "email string, at int")
    assert [tuple(r) for r in orders.register_users(old, new, "at").collect()] == [("b@x", 2)]


@pytest.fixture(scope="module")
def products(tables):
    return tables["products"]


def test_search_keeps_wildcards(products):
    every = products.count()
    assert catalog.product_search(products, search="%").count() == every
    assert catalog.product_search(products, search="r_d").count() == products.where("name ilike '%r_d%'").count() > 0


def test_pages(products):
    first = catalog.page(products, limit=7).collect()
    second = catalog.page(products, limit=7, offset=7).collect()
    assert [r.sku for r in first + second] == [r.sku for r in products.orderBy("sku").limit(14).collect()]
    info = catalog.page_info(products, limit=7).first()
    assert info.pages == -(-products.count() // 7)
    for bad in ({"limit": 0}, {"limit": 101}, {"offset": -1}):
        with pytest.raises(ValueError):
            catalog.page(products, **bad)


def test_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, sku string")
    feed = spark.createDataFrame([("update", 1, "a2", 1), ("update", 1, "a3", 2), ("delete", 2, None, 1), ("update", 2, "x", 2),
                                  ("update", 9, "x", 1), ("create", 4, "d", 1), ("update", 4, "d2", 2)],
                                 "op string, id int, sku string, at int")
    assert dict(map(tuple, catalog.apply_changes(old, feed, "at").collect())) == {1: "a3", 3: "c", 4: "d2"}


def test_reviews(spark):
    rows = spark.createDataFrame([(1, 5, None), (1, 3, "2024-01-02"), (1, 1, "2024-01-03"), (2, 4, None)],
                                 "product_id int, stars int, d string").select(
        "product_id", "stars", F.col("d").cast("date").alias("review_date"),
        *[F.lit(None).cast("string").alias(c) for c in ("title", "author", "body")], F.lit(True).alias("verified"))
    page = catalog.reviews_page(rows, product_id=1, limit=2).orderBy("position").collect()
    assert [r.stars for r in page] == [1, 3]  # missing dates come last
    dist = {r.product_id: r for r in catalog.star_distribution(rows).collect()}
    assert (dist[1].stars_1, dist[1].stars_2, dist[1].total, dist[2].pages) == (1, 0, 3, 1)
    summary = {r.product_id: r for r in catalog.rating_summary(catalog.star_distribution(rows)).collect()}
    assert (summary[1].avg_rating, summary[1].pct_5, summary[2].pct_4) == (3.0, 33, 100)
    with pytest.raises(ValueError):
        catalog.reviews_page(rows, sort="best")


def test_discount_rounds_half_up(spark):
    df = spark.createDataFrame([(95.5, 100.0), (5.0, None), (5.0, 0.0), (110.0, 100.0)], "price double, original_price double")
    assert [r.discount_pct for r in catalog.with_discount(df).collect()] == [5, 0, 0, -10]
