"""The monthly price fact that queries use, from the driver's tables.

A product is a part brand, a state a supplier nation.  Prices are whole units
of 1e-4, so sums and comparisons are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The period up to which rows count as observed.
AS_OF = (2001, 8)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fact(spark: SparkSession, sf_dir: str, product: str = "p_brand") -> DataFrame:
    """product (an expression over part), uf, region, ano, mes, periodo, preco_q and obs."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.expr(product).alias("product"))
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("uf"), F.col("r_name").alias("region"))
    sellers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey").join(places, "s_nationkey")
    rows = items.join(parts, "l_partkey").join(sellers, "l_suppkey")
    return (
        rows.groupBy("product", "uf", "region", F.year("l_shipdate").alias("ano"), F.month("l_shipdate").alias("mes"))
        .agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.sum(F.col("l_quantity").cast("long")).alias("qty"), F.count("*").alias("obs"))
        .select("product", "uf", "region", "ano", "mes", (F.col("ano") * 12 + F.col("mes")).alias("periodo"), F.expr("cents * 100 div qty").alias("preco_q"), "obs")
    )


#: The same table in SQL, to stand after "fact AS".
FACT = """(
  SELECT *, ano * 12 + mes AS periodo FROM (
    SELECT p_brand AS product, n_name AS uf, r_name AS region, CAST(year(l_shipdate) AS INTEGER) AS ano, CAST(month(l_shipdate) AS INTEGER) AS mes,
      CAST((sum(CAST(round(l_extendedprice * 100) AS BIGINT)) * 100) // sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS preco_q, count(*) AS obs
    FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
    JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
    GROUP BY ALL))"""
