"""Windows, as-of joins, top rows and pages over the price fact."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegrain.functions import rules
from tidegrain.operators import tables, windows
from tidegrain.plans.facts import AS_OF, fact
from tidegrain.plans.kit import registrar

QUERIES, SQL, query = registrar()
KEY = ["product", "uf"]
TRAILING = "sum(preco_q) OVER t AS total, count(*) OVER t AS n, lag(preco_q) OVER (PARTITION BY product, uf ORDER BY periodo) AS previous"
NAMED = "WINDOW t AS (PARTITION BY product, uf ORDER BY periodo ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"
STATUS = "CASE WHEN n < 6 THEN 'INSUFICIENTE' WHEN preco_q * n * 100 < total * 85 THEN 'VERDE' WHEN preco_q * n * 100 > total * 115 THEN 'VERMELHO' ELSE 'AMARELO' END"


def _trailing(spark, sf_dir):
    return windows.trailing(fact(spark, sf_dir), KEY, ["periodo"], "preco_q")


def latest_status(spark, sf_dir):
    """Latest month of each series with its trailing mean and status."""
    t = _trailing(spark, sf_dir).withColumn("status", rules.mean_band(F.col("preco_q"), F.col("total"), F.col("n")))
    return windows.top_per_key(t, KEY, [F.desc("periodo")]).select("product", "uf", "ano", "mes", "preco_q", (F.col("total") / F.col("n") / 10000.0).alias("mean_price"), "status")


@query(f"WITH fact AS FACT SELECT product, uf, periodo, preco_q, CAST(total AS DOUBLE) / n / 10000.0 AS mean_price, n FROM (SELECT *, {TRAILING} FROM fact {NAMED})")
def e1_trailing_mean(spark, sf_dir):
    return _trailing(spark, sf_dir).select("product", "uf", "periodo", "preco_q", (F.col("total") / F.col("n") / 10000.0).alias("mean_price"), "n")


@query(f"WITH fact AS FACT SELECT product, uf, periodo, n, n >= 6 AS enough FROM (SELECT *, {TRAILING} FROM fact {NAMED})")
def e2_history_count(spark, sf_dir):
    return _trailing(spark, sf_dir).select("product", "uf", "periodo", "n", (F.col("n") >= 6).alias("enough"))


@query(f"WITH fact AS FACT SELECT product, uf, periodo, previous, (preco_q::DOUBLE / nullif(previous, 0) - 1.0::DOUBLE) * 100 AS mom_pct FROM (SELECT *, {TRAILING} FROM fact {NAMED})")
def e3_month_over_month(spark, sf_dir):
    mom = (F.col("preco_q").cast("double") / F.nullif(F.col("previous").cast("double"), F.lit(0.0)) - 1.0) * 100
    return _trailing(spark, sf_dir).select("product", "uf", "periodo", "previous", mom.alias("mom_pct"))


@query(
    f"""WITH fact AS FACT, s AS (SELECT *, {STATUS} AS status FROM (SELECT *, {TRAILING} FROM fact {NAMED}))
SELECT product, uf, ano, mes, preco_q, CAST(total AS DOUBLE) / n / 10000.0 AS mean_price, status FROM s QUALIFY row_number() OVER (PARTITION BY product, uf ORDER BY periodo DESC) = 1"""
)
def e4_latest_status(spark, sf_dir):
    return latest_status(spark, sf_dir)


@query("WITH fact AS FACT SELECT product, uf, periodo, preco_q, obs FROM fact QUALIFY row_number() OVER (PARTITION BY product, periodo ORDER BY (obs > 1) DESC, preco_q, uf) = 1")
def e5_preferred_row(spark, sf_dir):
    return windows.top_per_key(fact(spark, sf_dir), ["product", "periodo"], [(F.col("obs") > 1).desc(), F.asc("preco_q"), F.asc("uf")]).select("product", "uf", "periodo", "preco_q", "obs")


@query("WITH fact AS FACT SELECT product, uf, mes, ano, preco_q FROM fact QUALIFY row_number() OVER (PARTITION BY product, uf, mes ORDER BY ano DESC) = 1")
def e6_distinct_on(spark, sf_dir):
    return windows.top_per_key(fact(spark, sf_dir), ["product", "uf", "mes"], [F.desc("ano")]).select("product", "uf", "mes", "ano", "preco_q")


GRID = """k AS (SELECT DISTINCT product, uf FROM fact), p AS (SELECT unnest(range((SELECT min(periodo) FROM fact), (SELECT max(periodo) FROM fact) + 1)) AS periodo),
g AS (SELECT k.product, k.uf, CAST(p.periodo AS INTEGER) AS periodo, f.preco_q FROM k CROSS JOIN p LEFT JOIN fact f ON f.product = k.product AND f.uf = k.uf AND f.periodo = p.periodo)"""


def series_grid(df):
    """Every period between the first and the last for each series, prices null where missing."""
    ends = df.agg(F.min("periodo").alias("a"), F.max("periodo").alias("b")).select(F.sequence("a", "b").alias("all")).select("all").scalar()
    keys = df.select(*KEY).distinct().withColumn("all", ends).select(*KEY, F.explode("all").alias("periodo"))
    return keys.join(df.select(*KEY, "periodo", "preco_q"), [*KEY, "periodo"], "left")


@query(f"WITH fact AS FACT, {GRID} SELECT product, uf, periodo, preco_q, last_value(preco_q IGNORE NULLS) OVER (PARTITION BY product, uf ORDER BY periodo ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM g")
def e7_carried_forward(spark, sf_dir):
    return windows.carried_forward(series_grid(fact(spark, sf_dir)), KEY, "periodo", "preco_q", "filled")


FILLED = """a AS (SELECT *, last_value(preco_q IGNORE NULLS) OVER (PARTITION BY product, uf ORDER BY periodo ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f,
  first_value(preco_q IGNORE NULLS) OVER (PARTITION BY product, uf ORDER BY periodo ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM g)"""


@query(f"WITH fact AS FACT, {GRID}, {FILLED} SELECT product, uf, periodo, coalesce(f, b) AS filled, CASE WHEN preco_q IS NOT NULL THEN 'REAL' WHEN f IS NOT NULL THEN 'LOCF' ELSE 'NOCB' END AS method FROM a")
def e8_carried_back(spark, sf_dir):
    g = windows.carried_back(windows.carried_forward(series_grid(fact(spark, sf_dir)), KEY, "periodo", "preco_q", "f"), KEY, "periodo", "preco_q", "b")
    method = F.when(F.col("preco_q").isNotNull(), "REAL").when(F.col("f").isNotNull(), "LOCF").otherwise("NOCB")
    return g.select("product", "uf", "periodo", F.coalesce("f", "b").alias("filled"), method.alias("method"))


@query("WITH fact AS FACT SELECT *, obs::DOUBLE / total AS share FROM (SELECT *, CAST(sum(obs) OVER (PARTITION BY product) AS BIGINT) AS total FROM (SELECT product, uf, CAST(sum(obs) AS BIGINT) AS obs FROM fact GROUP BY ALL))")
def e9_shares(spark, sf_dir):
    g = fact(spark, sf_dir).groupBy("product", "uf").agg(F.sum("obs").alias("obs")).withColumn("total", F.sum("obs").over(Window.partitionBy("product")))
    return g.select("product", "uf", "obs", "total", (F.col("obs").cast("double") / F.col("total")).alias("share"))


RANK = "CASE {} WHEN 'VERDE' THEN 0 WHEN 'AMARELO' THEN 1 WHEN 'VERMELHO' THEN 2 ELSE 3 END"


@query(
    f"""WITH fact AS FACT, s AS (SELECT product, uf, periodo, {STATUS} AS status FROM (SELECT *, {TRAILING} FROM fact {NAMED})),
l AS (SELECT *, lag(status) OVER (PARTITION BY product, uf ORDER BY periodo) AS p FROM s)
SELECT product, uf, periodo, status, CASE WHEN p IS NULL THEN 'ESTAVEL' WHEN {RANK.format("status")} > {RANK.format("p")} THEN 'ALTA' WHEN {RANK.format("status")} < {RANK.format("p")} THEN 'QUEDA' ELSE 'ESTAVEL' END AS trend FROM l"""
)
def e10_status_trend(spark, sf_dir):
    t = _trailing(spark, sf_dir).select("product", "uf", "periodo", rules.mean_band(F.col("preco_q"), F.col("total"), F.col("n")).alias("status"))
    return windows.changes(t, KEY, "periodo", "status", "trend")


@query("WITH fact AS FACT SELECT region, product, uf AS master, obs FROM (SELECT region, product, uf, CAST(sum(obs) AS BIGINT) AS obs FROM fact GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY region, product ORDER BY obs DESC, length(uf), uf) = 1")
def e11_master_election(spark, sf_dir):
    g = fact(spark, sf_dir).groupBy("region", "product", "uf").agg(F.sum("obs").alias("obs"))
    return windows.top_per_key(g, ["region", "product"], [F.desc("obs"), F.length("uf").asc(), F.asc("uf")]).select("region", "product", F.col("uf").alias("master"), "obs")


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey) = 1")
def e12_source_priority(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    return windows.top_per_key(o, ["o_custkey"], [F.asc("o_orderpriority"), F.desc("o_orderdate"), F.asc("o_orderkey")]).drop("o_orderdate")


@query("WITH fact AS FACT SELECT product, uf, periodo, CAST(dense_rank() OVER (PARTITION BY product, uf ORDER BY ano DESC, mes DESC) AS INTEGER) AS age FROM fact")
def e13_dense_rank(spark, sf_dir):
    return fact(spark, sf_dir).select("product", "uf", "periodo", F.dense_rank().over(Window.partitionBy(*KEY).orderBy(F.desc("ano"), F.desc("mes"))).alias("age"))


@query(
    f"""WITH fact AS FACT, {GRID}, {FILLED}, t AS (SELECT *, max(CASE WHEN preco_q IS NOT NULL THEN periodo END) OVER (PARTITION BY product, uf ORDER BY periodo ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t0,
  min(CASE WHEN preco_q IS NOT NULL THEN periodo END) OVER (PARTITION BY product, uf ORDER BY periodo ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1 FROM a)
SELECT product, uf, periodo, coalesce(preco_q, CASE WHEN t1 - t0 - 1 <= 2 THEN f + CAST(trunc(((b - f) * (periodo - t0))::DOUBLE / nullif(t1 - t0, 0)) AS BIGINT) END) AS filled FROM t"""
)
def e14_interpolated(spark, sf_dir):
    return windows.interpolated(series_grid(fact(spark, sf_dir)), KEY, "periodo", "preco_q", "filled").select("product", "uf", "periodo", "filled")


@query("WITH fact AS FACT, t AS (SELECT DISTINCT product, uf, mes FROM fact) SELECT t.product, t.uf, t.mes, a.ano, a.preco_q FROM t LEFT JOIN LATERAL (SELECT ano, preco_q FROM fact f WHERE f.product = t.product AND f.uf = t.uf AND f.mes = t.mes AND f.ano BETWEEN 1999 AND 2001 ORDER BY ano DESC LIMIT 1) a ON true")
def c11_asof_year_window(spark, sf_dir):
    f = fact(spark, sf_dir)
    year = AS_OF[0]
    best = windows.top_per_key(f.filter(F.col("ano").between(year - 2, year)), ["product", "uf", "mes"], [F.desc("ano")])
    return f.select("product", "uf", "mes").distinct().join(best.select("product", "uf", "mes", "ano", "preco_q"), ["product", "uf", "mes"], "left")


@query("WITH fact AS FACT, b AS (SELECT product, uf, max_by(preco_q, periodo) AS last_q, max(periodo) AS last_p FROM fact WHERE periodo < 2001 * 12 + 1 GROUP BY ALL) SELECT f.product, f.uf, f.periodo, b.last_q, b.last_p FROM fact f LEFT JOIN b ON b.product = f.product AND b.uf = f.uf WHERE f.ano = 2001")
def c12_strictly_before(spark, sf_dir):
    f = fact(spark, sf_dir)
    b = f.filter(F.col("periodo") < 2001 * 12 + 1).groupBy(*KEY).agg(F.max_by("preco_q", "periodo").alias("last_q"), F.max("periodo").alias("last_p"))
    return f.filter("ano = 2001").select(*KEY, "periodo").join(b, KEY, "left")


@query("WITH fact AS FACT SELECT a.product, a.uf, a.periodo, CAST(sum(b.preco_q) AS DOUBLE) / nullif(count(b.preco_q), 0) / 10000.0 AS reference, count(b.preco_q) AS n FROM fact a LEFT JOIN fact b ON a.product = b.product AND a.uf = b.uf AND b.periodo BETWEEN a.periodo - 12 AND a.periodo - 1 GROUP BY a.product, a.uf, a.periodo")
def c13_range_mean(spark, sf_dir):
    t = windows.calendar_trailing(fact(spark, sf_dir), KEY, "periodo", "preco_q", -12, -1)
    return t.select("product", "uf", "periodo", (F.col("total") / F.nullif(F.col("n"), F.lit(0)) / 10000.0).alias("reference"), "n")


@query("WITH fact AS FACT, m AS (SELECT product, uf, max(periodo) AS top FROM fact GROUP BY ALL) SELECT f.product, f.uf, CAST(sum(preco_q) AS DOUBLE) / count(*) / 10000.0 AS mean_price, count(*) AS n FROM fact f JOIN m ON m.product = f.product AND m.uf = f.uf WHERE f.periodo > top - 12 GROUP BY f.product, f.uf HAVING count(*) >= 3")
def c14_last_year_mean(spark, sf_dir):
    f = fact(spark, sf_dir).withColumn("top", F.max("periodo").over(Window.partitionBy(*KEY)))
    g = f.filter(F.col("periodo") > F.col("top") - 12).groupBy(*KEY).agg(F.sum("preco_q").alias("s"), F.count("*").alias("n")).filter("n >= 3")
    return g.select(*KEY, (F.col("s") / F.col("n") / 10000.0).alias("mean_price"), "n")


@query("WITH fact AS FACT SELECT a.product, a.uf, a.periodo, a.preco_q, b.preco_q AS previous FROM fact a LEFT JOIN fact b ON b.product = a.product AND b.uf = a.uf AND b.periodo = a.periodo - 1")
def c16_previous_period(spark, sf_dir):
    return windows.previous_period(fact(spark, sf_dir).select(*KEY, "periodo", "preco_q"), KEY, "periodo", "preco_q")


@query("WITH fact AS FACT SELECT product, uf, periodo, preco_q FROM fact ORDER BY preco_q DESC NULLS LAST, product, uf, periodo LIMIT 25 OFFSET 25")
def f2_page(spark, sf_dir):
    f = fact(spark, sf_dir).select("product", "uf", "periodo", "preco_q")
    return tables.page(f, [F.desc_nulls_last("preco_q"), F.asc("product"), F.asc("uf"), F.asc("periodo")], 2, 25)


@query("WITH fact AS FACT, k AS (SELECT DISTINCT product FROM fact ORDER BY product LIMIT 5 OFFSET 5) SELECT product, uf, mes, ano, preco_q FROM fact WHERE product IN (SELECT product FROM k)")
def f3_entity_page(spark, sf_dir):
    return tables.entity_page(fact(spark, sf_dir).select("product", "uf", "mes", "ano", "preco_q"), "product", 2, 5)


@query(f"WITH fact AS FACT SELECT product, uf, periodo, preco_q - previous AS change FROM (SELECT *, {TRAILING} FROM fact {NAMED}) WHERE previous IS NOT NULL ORDER BY abs(preco_q - previous) DESC, product, uf, periodo LIMIT 100")
def f5_largest_changes(spark, sf_dir):
    t = _trailing(spark, sf_dir).filter("previous is not null").select("product", "uf", "periodo", (F.col("preco_q") - F.col("previous")).alias("change"))
    return t.orderBy(F.abs("change").desc(), "product", "uf", "periodo").limit(100)


@query("WITH fact AS FACT SELECT uf, count(*) AS months FROM fact WHERE product = 'Brand#11' GROUP BY uf ORDER BY months DESC, uf LIMIT 10")
def f7_most_common(spark, sf_dir):
    return fact(spark, sf_dir).filter("product = 'Brand#11'").groupBy("uf").agg(F.count("*").alias("months")).orderBy(F.desc("months"), "uf").limit(10)


@query("WITH fact AS FACT, l AS (SELECT * FROM fact QUALIFY row_number() OVER (PARTITION BY product, uf ORDER BY periodo DESC) = 1) SELECT product, uf, preco_q FROM l QUALIFY row_number() OVER (PARTITION BY product ORDER BY preco_q, uf) <= 10")
def f8_cheapest_places(spark, sf_dir):
    latest = windows.top_per_key(fact(spark, sf_dir), KEY, [F.desc("periodo")]).filter("preco_q is not null")
    return windows.top_per_key(latest, ["product"], [F.asc("preco_q"), F.asc("uf")], 10).select("product", "uf", "preco_q")
