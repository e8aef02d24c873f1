"""Relational extensions over the star schema: joins of each kind, grouping sets, frames, sketches. The reference has none of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import read_table
from .registry import query


@query("select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*)::bigint as count_order from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def ext_pricing_summary(spark: SparkSession, base: str) -> DataFrame:
    """A filtered aggregation over the largest table."""
    li = read_table(spark, base, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"))


@query("select r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)")
def ext_revenue_rollup(spark: SparkSession, base: str) -> DataFrame:
    """A chain of joins under a rollup."""
    t = lambda n: read_table(spark, base, n)
    li = t("lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    places = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    j = li.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.rollup("r_name", "n_name").agg(F.round(F.sum("rev"), 2).alias("revenue"))


@query("select c_mktsegment, o_orderpriority, count(*)::bigint as orders from orders join customer on o_custkey = c_custkey group by cube (c_mktsegment, o_orderpriority)")
def ext_orders_cube(spark: SparkSession, base: str) -> DataFrame:
    """Orders by all combinations of two attributes."""
    j = read_table(spark, base, "orders").join(read_table(spark, base, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.cube("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("orders"))


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 250000)")
def ext_no_orders(spark: SparkSession, base: str) -> DataFrame:
    """Customers without a large order."""
    return read_table(spark, base, "customer").join(read_table(spark, base, "orders").where("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("select o_orderkey, o_custkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row), 2) as last_three from orders")
def ext_moving_sum(spark: SparkSession, base: str) -> DataFrame:
    """The sum of the last three orders of each customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    return read_table(spark, base, "orders").select("o_orderkey", "o_custkey", F.round(F.sum("o_totalprice").over(w), 2).alias("last_three"))


@query()
def ext_approx_distinct(spark: SparkSession, base: str) -> DataFrame:
    """Distinct parts of each return flag by a sketch."""
    return read_table(spark, base, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"))
