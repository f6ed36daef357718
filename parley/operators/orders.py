"""Order pricing, item lists, status changes, carts and user registration."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley import schemas

# Fixed values.
TAX_RATE = "0.08"
FREE_SHIPPING_FROM = "50"
SHIPPING = "9.99"
STATUSES = ["pending", "confirmed", "shipped", "delivered", "cancelled"]


def _money(x: str) -> Column:
    return F.lit(x).cast("decimal(10,2)")


def price(c: str | Column) -> Column:
    """A price as decimal; a binary value is read by its decimal digits first."""
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("decimal(28,10)").cast("decimal(10,2)")


def _totals(subtotal: Column) -> list[Column]:
    tax = F.round(subtotal * _money(TAX_RATE), 2).cast("decimal(18,2)")
    shipping = F.when(subtotal >= _money(FREE_SHIPPING_FROM), _money("0")).otherwise(_money(SHIPPING))
    total = F.round(subtotal + tax + shipping, 2).cast("decimal(18,2)")
    return [subtotal.alias("subtotal"), tax.alias("tax"), shipping.alias("shipping"), total.alias("total")]


def order_pricing(items: DataFrame) -> DataFrame:
    """Totals per order out of one row per item (order_id, quantity, price)."""
    line = price("price") * F.col("quantity")
    sums = items.groupBy("order_id").agg(F.sum(line).cast("decimal(18,2)").alias("_s"))
    return sums.select("order_id", *_totals(F.col("_s")))


def price_order_lists(orders: DataFrame) -> DataFrame:
    """The same for orders that carry an ``items`` array."""
    zero = F.lit(0).cast("decimal(18,2)")
    subtotal = F.aggregate("items", zero, lambda a, i: (a + i["price"] * i["quantity"]).cast("decimal(18,2)"))
    priced = orders.withColumn("_s", subtotal)
    return priced.select(*orders.columns, *_totals(F.col("_s")))


def parse_items(orders: DataFrame, column: str = "items") -> DataFrame:
    return orders.withColumn(column, F.from_json(column, schemas.ITEMS))


def serialise_items(orders: DataFrame, column: str = "items") -> DataFrame:
    return orders.withColumn(column, F.to_json(column))


def user_orders(orders: DataFrame, user_id: object) -> DataFrame:
    """All orders of one user, newest first."""
    return orders.where(F.col("user_id") == F.lit(user_id)).orderBy(F.col("created_at").desc(), "id")


def newest_orders(orders: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` orders of every user."""
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), "id")
    return orders.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def rejected_statuses(updates: DataFrame) -> DataFrame:
    return updates.where(~F.coalesce(F.col("status").isin(STATUSES), F.lit(False)))


def apply_statuses(orders: DataFrame, updates: DataFrame, *order: str) -> DataFrame:
    """Sets the latest valid status per order; unknown orders are ignored."""
    latest = (updates.where(F.col("status").isin(STATUSES)).groupBy("order_id")
              .agg(F.max_by("status", F.struct(*order)).alias("_status")))
    joined = orders.join(latest, orders["id"] == latest["order_id"], "left")
    return joined.withColumn("status", F.coalesce("_status", "status")).select(*orders.columns)


def merge_carts(events: DataFrame, position: str = "position") -> DataFrame:
    """Cart contents out of a log of (cart, item, action, quantity, price).

    Actions: add, update (sets the quantity of an item that is in the cart, or
    removes it at zero or less), remove, and clear (item is NULL). Nothing is
    folded row by row. What counts per slot is the last event that empties it,
    the first add after that, the last update after the add, and the adds from
    there on. Each is an aggregate that combines before it shuffles, so a slot
    may have any number of events.
    """
    p = F.col(position)
    last_clear = events.where("action = 'clear'").groupBy("cart").agg(F.max(p).alias("_cleared"))
    emptied = (F.col("action") == "remove") | ((F.col("action") == "update") & (F.col("quantity") <= 0))
    log = (events.where("action <> 'clear'").join(last_clear, "cart", "left")
           .where(F.col("_cleared").isNull() | (p > F.col("_cleared"))).drop("_cleared")
           .withColumns({"_emptied": F.coalesce(emptied, F.lit(False)), "_add": F.col("action") == "add"}))
    return _slots(log, p)


def _later(p: Column, mark: str) -> Column:
    return F.col(mark).isNull() | (p > F.col(mark))


def _quantity(p: Column) -> Column:
    set_to = F.max(F.when(p == F.col("_set_at"), F.col("quantity")))
    added = F.sum(F.when(F.col("_add") & _later(p, "_set_at"), F.col("quantity")))
    return (F.coalesce(set_to, F.lit(0)) + F.coalesce(added, F.lit(0))).cast("bigint").alias("quantity")


def _slots(log: DataFrame, p: Column) -> DataFrame:
    slot = ["cart", "item"]
    emptied = log.groupBy(*slot).agg(F.max(F.when(F.col("_emptied"), p)).alias("_emptied_at"))
    live = log.join(emptied, slot).where(~F.col("_emptied") & _later(p, "_emptied_at"))
    added_at = F.when(F.col("_add"), p)
    opened = live.groupBy(*slot).agg(F.min(added_at).alias("_opened"), F.min_by("price", added_at).alias("_price"))
    present = live.join(opened.where("_opened is not null"), slot)
    sets = ~F.col("_add") & (p > F.col("_opened"))
    last_set = present.groupBy(*slot).agg(F.max(F.when(sets, p)).alias("_set_at"))
    return present.join(last_set, slot).groupBy(*slot).agg(_quantity(p), F.max("_price").alias("price"))


def cart_totals(carts: DataFrame) -> DataFrame:
    line = price("price") * F.col("quantity")
    return carts.groupBy("cart").agg(F.count(F.lit(1)).alias("items"), F.sum(line).cast("decimal(18,2)").alias("total"))


def register_users(existing: DataFrame, incoming: DataFrame, *order: str) -> DataFrame:
    """Accepted registrations: the first per e-mail that is not taken."""
    first = F.row_number().over(Window.partitionBy("email").orderBy(*order))
    fresh = incoming.withColumn("_r", first).where("_r = 1").drop("_r")
    return fresh.join(existing.select("email"), "email", "left_anti").select(*incoming.columns)
