"""Relational coverage on the star schema: filters, joins, grouping sets, windows, semi and anti joins, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heronry.tables import table

_PRICE = "l_extendedprice * (1 - l_discount)"


def _price():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def r_price_summary(spark, d):
    rows = table(spark, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(_price()), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("n"))


def r_revenue_forecast(spark, d):
    rows = table(spark, d, "lineitem").where("l_discount between 0.049 and 0.071 and l_quantity < 24")
    return rows.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


def r_nation_revenue(spark, d):
    t = {n: table(spark, d, n) for n in ("lineitem", "orders", "customer", "nation", "region")}
    rows = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.round(F.sum(_price()), 2).alias("revenue"), F.count("*").alias("n"))


def r_large_orders(spark, d):
    """Orders above 250 pieces with their owner; the aggregate runs before the join."""
    big = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty")).where("qty > 250")
    rows = big.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("o_orderkey", "c_name", F.round("qty", 2).alias("qty"), F.round("o_totalprice", 2).alias("price"))


def r_customers_without_orders(spark, d):
    lost = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return lost.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def r_top_orders(spark, d):
    """The three dearest orders of each priority."""
    rank = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, d, "orders").withColumn("place", rank).where("place <= 3").select("o_orderpriority", "place", "o_orderkey", "o_totalprice")


def r_orders_of_owner(spark, d):
    """Order and owner, with what a caller who is not the owner would see."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    own = F.col("o_orderkey") % 2 == F.col("c_custkey") % 2
    return rows.groupBy(F.when(own, "found").otherwise("permission_denied").alias("result"), "o_orderstatus").agg(F.count("*").alias("n"))


QUERIES = {
    "r_price_summary": (
        r_price_summary,
        f"SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum({_PRICE}), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    ),
    "r_revenue_forecast": (r_revenue_forecast, "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.049 AND 0.071 AND l_quantity < 24"),
    "r_nation_revenue": (
        r_nation_revenue,
        f"SELECT r_name, n_name, round(sum({_PRICE}), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    ),
    "r_large_orders": (
        r_large_orders,
        "SELECT o_orderkey, c_name, round(qty, 2) AS qty, round(o_totalprice, 2) AS price FROM (SELECT l_orderkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 250) JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey",
    ),
    "r_customers_without_orders": (r_customers_without_orders, "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY 1"),
    "r_top_orders": (r_top_orders, "SELECT o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place, o_orderkey, o_totalprice FROM orders QUALIFY place <= 3"),
    "r_orders_of_owner": (
        r_orders_of_owner,
        "SELECT CASE WHEN o_orderkey % 2 = c_custkey % 2 THEN 'found' ELSE 'permission_denied' END AS result, o_orderstatus, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    ),
}
