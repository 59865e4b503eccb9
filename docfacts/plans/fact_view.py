"""A facts table made of the star-schema tables, for queries and their SQL.

Orders are deals, lines are facts; every value is an arithmetic of numeric columns, so that SQL can state it too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL = """
facts AS (
  SELECT 'D' || l_orderkey AS deal_id, 'A' || l_orderkey || '-' || (l_suppkey % 2) AS accession,
    CASE l_linenumber % 5 WHEN 0 THEN 'exit_multiple' WHEN 3 THEN 'terminal_growth' WHEN 4 THEN 'implied_growth' ELSE 'discount_rate' END AS field,
    round(CASE l_linenumber % 5 WHEN 0 THEN l_quantity WHEN 3 THEN 1 + l_tax * 80 WHEN 4 THEN 1 + l_tax * 100 ELSE 2 + l_discount * 100 END, 4) AS low,
    round(CASE l_linenumber % 5 WHEN 0 THEN l_quantity WHEN 3 THEN 1 + l_tax * 80 WHEN 4 THEN 1 + l_tax * 100 ELSE 2 + l_discount * 100 END, 4) + round(l_discount * 20, 4) AS high,
    CASE WHEN l_suppkey % 11 = 0 THEN 'unattributed' ELSE 'S' || (l_suppkey % 7) END AS advisor,
    CASE WHEN l_partkey % 4 = 3 THEN 'acquirer' ELSE 'target' END AS subject,
    CASE WHEN l_returnflag = 'R' THEN 'ddm' ELSE 'dcf' END AS analysis,
    (l_partkey * 37) % 9000 AS span_start, CAST(o_orderdate AS DATE) AS filing_date, CAST(year(o_orderdate) AS BIGINT) AS year,
    (50 + c_nationkey % 20) || '11' AS sic, c_name AS company
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
),
yields AS (SELECT CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS dgs10 FROM orders WHERE o_orderkey % 50 = 0 GROUP BY 1)
"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    n = F.col("l_linenumber") % 5
    low = F.round(F.when(n == 0, F.col("l_quantity")).when(n == 3, 1 + F.col("l_tax") * 80).when(n == 4, 1 + F.col("l_tax") * 100).otherwise(2 + F.col("l_discount") * 100), 4)
    rows = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    text = lambda *parts: F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    return rows.select(
        text("D", F.col("l_orderkey")).alias("deal_id"),
        text("A", F.col("l_orderkey"), "-", F.col("l_suppkey") % 2).alias("accession"),
        F.when(n == 0, "exit_multiple").when(n == 3, "terminal_growth").when(n == 4, "implied_growth").otherwise("discount_rate").alias("field"),
        low.alias("low"),
        (low + F.round(F.col("l_discount") * 20, 4)).alias("high"),
        F.when(F.col("l_suppkey") % 11 == 0, "unattributed").otherwise(text("S", F.col("l_suppkey") % 7)).alias("advisor"),
        F.when(F.col("l_partkey") % 4 == 3, "acquirer").otherwise("target").alias("subject"),
        F.when(F.col("l_returnflag") == "R", "ddm").otherwise("dcf").alias("analysis"),
        ((F.col("l_partkey") * 37) % 9000).alias("span_start"),
        F.col("o_orderdate").cast("date").alias("filing_date"),
        F.year("o_orderdate").cast("long").alias("year"),
        text(F.lit(50) + F.col("c_nationkey") % 20, "11").alias("sic"),
        F.col("c_name").alias("company"),
    )


def yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where(F.col("o_orderkey") % 50 == 0)
    return orders.groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.max("o_totalprice").alias("dgs10"))
