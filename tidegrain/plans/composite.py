"""Composite pipelines: seasonality, baselines, projections, anchors, national and regional tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrain.functions import rules
from tidegrain.operators import stats, tables, windows
from tidegrain.plans.basic import FLOWS, VOLATILITY, flows
from tidegrain.plans.facts import AS_OF, FACT, fact, table
from tidegrain.plans.kit import registrar
from tidegrain.plans.rules_queries import SENSITIVE
from tidegrain.plans.window_queries import FILLED, GRID, NAMED, STATUS, TRAILING, series_grid
from tidegrain.sources import folders

QUERIES, SQL, query = registrar()
KEY = ["product", "uf"]
YEAR, MONTH = AS_OF
PERIOD = YEAR * 12 + MONTH


def seasonality(df: DataFrame) -> DataFrame:
    """Every month of each series with trailing mean, index, change and the live status.

    Under six observations, or with a contaminated series, the status is
    yellow; else the sensitive band around the trailing mean decides.
    """
    t = stats.with_volatility(windows.trailing(df, KEY, ["periodo"], "preco_q"), KEY, "preco_q")
    price, mean = F.col("preco_q") / F.lit(10000.0), F.col("total") / F.col("n") / F.lit(10000.0)
    status = F.when((F.col("n") < 6) | F.coalesce("contaminated", F.lit(False)) | F.col("deviation").isNull(), rules.YELLOW).otherwise(F.coalesce(rules.sensitive(price, mean, F.col("cv")), F.lit(rules.YELLOW)))
    return t.withColumn("status", status)


LIVE = f"""s AS (SELECT *, {TRAILING} FROM fact {NAMED}), {VOLATILITY},
x AS (SELECT s.*, s.preco_q / 10000.0::DOUBLE AS p, s.total / s.n::DOUBLE / 10000.0::DOUBLE AS r, vol.cv, vol.cv > 0.40 AS bad FROM s LEFT JOIN vol ON vol.product = s.product AND vol.uf = s.uf),
y AS (SELECT *, greatest(coalesce(cv, 0), CASE WHEN r <= 5 THEN 0.02 WHEN r <= 20 THEN 0.05 ELSE 0.08 END::DOUBLE) AS w FROM x),
live AS (SELECT product, uf, region, ano, mes, periodo, preco_q, CASE WHEN n < 6 OR coalesce(bad, false) THEN 'AMARELO' ELSE {SENSITIVE} END AS status FROM y)"""


@query(f"WITH fact AS FACT, {LIVE} SELECT product, uf, periodo, preco_q, status FROM live")
def j1_seasonality(spark, sf_dir):
    return seasonality(fact(spark, sf_dir)).select(*KEY, "periodo", "preco_q", "status")


def one_per_month(rows: DataFrame) -> DataFrame:
    """Of a series' rows in a month the one in kg, else one with a factor to kg, else another (then by unit)."""
    rank = F.when(F.col("unit") == "kg", 0).when(F.col("factor").isNotNull(), 1).otherwise(2)
    return windows.top_per_key(rows.filter("preco_q is not null"), [*KEY, "ano", "mes"], [rank, F.col("unit")])


#: Units of the query's prices by size, and the factors to kg that are known.
_UNIT = "CASE p_size % 4 WHEN 0 THEN 'kg' WHEN 1 THEN 'cx' WHEN 2 THEN 'dz' ELSE 'un' END"
_FACTORS = {"cx": 20, "dz": 12}


@query(
    f"""WITH per AS (SELECT *, row_number() OVER (PARTITION BY product, uf, ano, mes ORDER BY CASE WHEN unit = 'kg' THEN 0 WHEN unit IN {tuple(_FACTORS)} THEN 1 ELSE 2 END, unit) AS k FROM (
  SELECT split_part(product, '|', 1) AS product, split_part(product, '|', 2) AS unit, uf, region, ano, mes, periodo, preco_q FROM {FACT.replace("p_brand AS product", "p_brand || '|' || " + _UNIT + " AS product")})),
fact AS (SELECT * FROM per WHERE k = 1), {LIVE.replace("SELECT product, uf, region, ano, mes, periodo, preco_q,", "SELECT product, uf, unit, periodo, preco_q, n,")} SELECT product, uf, unit, periodo, preco_q, n, status FROM live"""
)
def j1_unit_priority(spark, sf_dir):
    """Seasonality of months that have prices in several units."""
    f = fact(spark, sf_dir, f"p_brand || '|' || {_UNIT}")
    factor = F.create_map(*[F.lit(x) for kv in _FACTORS.items() for x in kv])
    rows = f.withColumns({"unit": F.split_part("product", F.lit("|"), F.lit(2)), "product": F.split_part("product", F.lit("|"), F.lit(1))}).withColumn("factor", F.try_element_at(factor, F.col("unit")))
    return seasonality(one_per_month(rows)).select(*KEY, "unit", "periodo", "preco_q", "n", "status")


BASELINE = "b AS (SELECT product, uf, CAST(sum(preco_q) AS BIGINT) AS s, count(*) AS n, 'ano' AS how FROM fact WHERE ano = 2000 GROUP BY ALL), l AS (SELECT f.product, f.uf, CAST(sum(preco_q) AS BIGINT) AS s, count(*) AS n FROM fact f JOIN (SELECT product, uf, max(periodo) AS top FROM fact GROUP BY ALL) m ON m.product = f.product AND m.uf = f.uf WHERE periodo > top - 12 GROUP BY ALL HAVING count(*) >= 3), last AS (SELECT product, uf, arg_max(preco_q, periodo) AS p FROM fact GROUP BY ALL)"


@query(f"WITH fact AS FACT, {BASELINE}, r AS (SELECT last.product, last.uf, p, coalesce(b.s, l.s) AS s, coalesce(b.n, l.n) AS n, CASE WHEN b.n IS NOT NULL THEN 'ano' WHEN l.n IS NOT NULL THEN '12m' ELSE 'nenhum' END AS method FROM last LEFT JOIN b ON b.product = last.product AND b.uf = last.uf LEFT JOIN l ON l.product = last.product AND l.uf = last.uf) SELECT product, uf, method, CASE WHEN n IS NULL THEN 'INSUFICIENTE' WHEN p * n * 100 < s * 85 THEN 'VERDE' WHEN p * n * 100 > s * 115 THEN 'VERMELHO' ELSE 'AMARELO' END AS status FROM r")
def j2_hybrid_baseline(spark, sf_dir):
    """The base year's mean, else the last twelve months', against the newest price."""
    f = fact(spark, sf_dir)
    b = f.filter(F.col("ano") == YEAR - 1).groupBy(*KEY).agg(F.sum("preco_q").alias("bs"), F.count("*").alias("bn"))
    top = f.groupBy(*KEY).agg(F.max("periodo").alias("top"), F.max_by("preco_q", "periodo").alias("p"))
    last = f.join(top.select(*KEY, "top"), KEY).filter("periodo > top - 12").groupBy(*KEY).agg(F.sum("preco_q").alias("ls"), F.count("*").alias("ln")).filter("ln >= 3")
    r = top.join(b, KEY, "left").join(last, KEY, "left").withColumns({"s": F.coalesce("bs", "ls"), "n": F.coalesce("bn", "ln")})
    method = F.when(F.col("bn").isNotNull(), "ano").when(F.col("ln").isNotNull(), "12m").otherwise("nenhum")
    return r.select(*KEY, method.alias("method"), rules.mean_band(F.col("p"), F.col("s"), F.coalesce("n", F.lit(0)), 15, 1).alias("status"))


def modal_baseline(df: DataFrame, years: tuple[int, ...]) -> DataFrame:
    """Most frequent status of each calendar month over years, with its share in percent."""
    m = stats.mode_share(df.filter(F.col("ano").isin(*years)), [*KEY, "mes"], "status")
    return m.select(*KEY, "mes", "status", (F.col("freq") * 100.0 / F.col("total")).alias("confidence"))


def modal_pair(df: DataFrame, first: tuple[int, ...], second: tuple[int, ...]) -> DataFrame:
    """modal_baseline() over two sets of years at once: product, uf, mes, s1, c1, s2 and c2, for months that either has."""
    counts = df.filter(F.col("ano").isin(*first, *second) & F.col("status").isNotNull()).groupBy(*KEY, "mes", "status").agg(*[F.count_if(F.col("ano").isin(*y)).alias(k) for y, k in ((first, "k1"), (second, "k2"))])
    best = lambda k: F.min(F.when(F.col(k) > 0, F.struct((-F.col(k)).alias("k"), "status")))
    both = counts.groupBy(*KEY, "mes").agg(best("k1").alias("b1"), F.sum("k1").alias("t1"), best("k2").alias("b2"), F.sum("k2").alias("t2"))
    return both.select(*KEY, "mes", *[c for i in (1, 2) for c in (F.col(f"b{i}.status").alias(f"s{i}"), (F.col(f"b{i}.k") * -100.0 / F.nullif(F.col(f"t{i}"), F.lit(0))).alias(f"c{i}"))])


MODAL = "SELECT product, uf, mes, status, k * 100.0::DOUBLE / t AS confidence FROM (SELECT *, CAST(sum(k) OVER (PARTITION BY product, uf, mes) AS BIGINT) AS t FROM (SELECT product, uf, mes, status, count(*) AS k FROM live WHERE ano IN ({}) GROUP BY ALL)) QUALIFY row_number() OVER (PARTITION BY product, uf, mes ORDER BY k DESC, status) = 1"


@query(f"WITH fact AS FACT, {LIVE} {MODAL.format('1999, 2000')}")
def j6_modal_baseline(spark, sf_dir):
    return modal_baseline(seasonality(fact(spark, sf_dir)), (1999, 2000))


@query(f"WITH fact AS FACT, {LIVE}, a AS ({MODAL.format('1998, 1999')}), b AS ({MODAL.format('1999, 2000')}) SELECT coalesce(a.product, b.product) AS product, coalesce(a.uf, b.uf) AS uf, coalesce(a.mes, b.mes) AS mes, CASE WHEN a.status <> b.status THEN 'AMARELO' ELSE coalesce(b.status, a.status) END AS status, round(CASE WHEN a.status IS NOT NULL AND b.status IS NOT NULL THEN least(a.confidence * 0.6 + b.confidence * 0.4, CASE WHEN a.status = b.status THEN 100 ELSE 40 END) WHEN b.status IS NOT NULL THEN b.confidence ELSE a.confidence * 0.5 END, 4) AS confidence FROM a FULL JOIN b ON a.product = b.product AND a.uf = b.uf AND a.mes = b.mes")
def j8_weighted_baseline(spark, sf_dir):
    j = modal_pair(seasonality(fact(spark, sf_dir)), (1998, 1999), (1999, 2000))
    s1, c1, s2, c2 = (F.col(x) for x in ("s1", "c1", "s2", "c2"))
    return j.select(*KEY, "mes", rules.agreement(s1, s2).alias("status"), F.round(rules.agreement_confidence(s1, c1, s2, c2), 4).alias("confidence"))


# The methods of the weighted baseline.
ANCHORED, BY_CATEGORY, BY_LAST = "ANCHOR_2024_MARGIN_2025", "PROXY_CATEGORIA_UF", "LOCF_MES_ANTERIOR"


def weighted_baseline(s: DataFrame, products: DataFrame, year: int, period: int) -> DataFrame:
    """product, uf, mes, status, diverges, confidence and method of all months of every pair with a history, and of products without any.

    s is seasonality()'s result; products has product and category of all
    products there are.  A product without history stands in one place of each
    region, the one with most rows of its category.  The two baselines decide
    (see rules.agreement()); else the category's most frequent status in that
    place and month, surer the more products it has; else the last status
    before that month of the year, which is hardly sure, or yellow.

    The rows with their categories are written once, as they are read five
    times.  Files of such rows are far smaller than the rows, and a join that
    Spark plans by the size of files sends one side through the driver, even
    if it is grouped before and turns out to be large; so all joins merge.
    """
    merge = lambda df: df.hint("merge")
    s = folders.stored(s.join(merge(products), "product"))
    pair = modal_pair(s, (year - 3, year - 2), (year - 2, year - 1))
    now = s.filter((F.col("ano") == year) & (F.col("periodo") <= period))
    pairs = pair.select(*KEY).unionByName(now.select(*KEY)).distinct()
    places = windows.top_per_key(s.groupBy("category", "region", "uf").agg(F.count("*").alias("n")), ["category", "region"], [F.desc("n"), F.asc("uf")])
    fresh = tables.without(products, merge(pairs), ["product"]).join(merge(places.select("category", "uf")), "category")
    grid = tables.month_grid(pairs.join(merge(products), "product").unionByName(fresh.select(*KEY, "category")))
    proxy = s.groupBy("uf", "category", "mes").agg(F.mode("status", deterministic=True).alias("near"), F.least(F.lit(25.0), F.count_distinct("product") * 5.0).alias("near_sure"))
    x = grid.join(merge(pair), [*KEY, "mes"], "left").join(merge(proxy), ["uf", "category", "mes"], "left").withColumn("at", F.lit(year * 12) + F.col("mes"))
    x = windows.asof_before(x, s, KEY, "at", "periodo", "status", "last")
    s1, c1, s2, c2 = (F.col(c) for c in ("s1", "c1", "s2", "c2"))
    own = rules.agreement(s1, s2)
    status = F.coalesce(own, "near", "last", F.lit(rules.YELLOW))
    sure = F.when(own.isNotNull(), F.round(rules.agreement_confidence(s1, c1, s2, c2), 4)).when(F.col("near").isNotNull(), F.col("near_sure")).when(F.col("last").isNotNull(), 15.0).otherwise(5.0)
    method = F.when(own.isNotNull(), ANCHORED).when(F.col("near").isNotNull(), BY_CATEGORY).otherwise(BY_LAST)
    return x.select(*KEY, "mes", status.alias("status"), F.coalesce(s1 != s2, F.lit(False)).alias("diverges"), sure.alias("confidence"), method.alias("method"))


#: Products of the tiers' query: a name and brand, its name the category; those of one brand have no history.
TIERED = "p_name || ' ' || p_brand"
UNSOLD = "%Brand#7"


@query(
    f"""WITH raw AS {FACT.replace("p_brand AS product", TIERED + " AS product")}, fact AS (SELECT * FROM raw WHERE product NOT LIKE '{UNSOLD}'), {LIVE},
pr AS (SELECT DISTINCT {TIERED} AS product, p_name AS category FROM part), a AS ({MODAL.format(f"{YEAR - 3}, {YEAR - 2}")}), b AS ({MODAL.format(f"{YEAR - 2}, {YEAR - 1}")}),
pairs AS (SELECT product, uf FROM a UNION SELECT product, uf FROM b UNION SELECT product, uf FROM live WHERE ano = {YEAR} AND periodo <= {PERIOD}),
lc AS (SELECT *, category FROM live JOIN pr USING (product)),
rep AS (SELECT category, region, uf FROM (SELECT category, region, uf, count(*) AS n FROM lc GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY category, region ORDER BY n DESC, uf) = 1),
grid AS (SELECT product, uf, category, CAST(m AS INTEGER) AS mes FROM (SELECT product, uf, category FROM pairs JOIN pr USING (product) UNION ALL SELECT product, uf, category FROM pr JOIN rep USING (category) WHERE product NOT IN (SELECT product FROM pairs)), range(1, 13) r(m)),
near AS (SELECT uf, category, mes, mode(status ORDER BY status) AS near, least(25.0, count(DISTINCT product) * 5.0)::DOUBLE AS near_sure FROM lc GROUP BY ALL),
last AS (SELECT g.product, g.uf, g.mes, arg_max(l.status, l.periodo) AS last FROM grid g JOIN live l ON l.product = g.product AND l.uf = g.uf AND l.periodo < {YEAR * 12} + g.mes GROUP BY ALL),
xx AS (SELECT grid.*, a.status AS s1, a.confidence AS c1, b.status AS s2, b.confidence AS c2, near, near_sure, last FROM grid LEFT JOIN a USING (product, uf, mes) LEFT JOIN b USING (product, uf, mes) LEFT JOIN near USING (uf, category, mes) LEFT JOIN last USING (product, uf, mes))
SELECT product, uf, mes, CASE WHEN s1 <> s2 THEN 'AMARELO' ELSE coalesce(s2, s1, near, last, 'AMARELO') END AS status, coalesce(s1 <> s2, false) AS diverges,
  CASE WHEN s1 IS NOT NULL AND s2 IS NOT NULL THEN round(least(c1 * 0.6 + c2 * 0.4, CASE WHEN s1 = s2 THEN 100 ELSE 40 END), 4) WHEN s2 IS NOT NULL THEN round(c2, 4) WHEN s1 IS NOT NULL THEN round(c1 * 0.5, 4) WHEN near IS NOT NULL THEN near_sure WHEN last IS NOT NULL THEN 15 ELSE 5 END::DOUBLE AS confidence,
  CASE WHEN s1 IS NOT NULL OR s2 IS NOT NULL THEN '{ANCHORED}' WHEN near IS NOT NULL THEN '{BY_CATEGORY}' ELSE '{BY_LAST}' END AS method FROM xx"""
)
def j8_weighted_tiers(spark, sf_dir):
    """The whole grid, products without any sale included."""
    f = fact(spark, sf_dir, TIERED).filter(~F.col("product").like(UNSOLD))
    products = table(spark, sf_dir, "part").select(F.expr(TIERED).alias("product"), F.col("p_name").alias("category")).distinct()
    return weighted_baseline(seasonality(f).select(*KEY, "region", "ano", "mes", "periodo", "status"), products, YEAR, PERIOD)


def _mean(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum("preco_q") / F.count("*")).alias("v"))


HISTORY = "h AS (SELECT * FROM fact WHERE ano IN (1999, 2000)), g AS (SELECT product, uf, CAST(m AS INTEGER) AS mes FROM (SELECT DISTINCT product, uf FROM fact), range(1, 13) r(m)), l1 AS (SELECT product, uf, mes, CAST(sum(preco_q) AS DOUBLE) / count(*) AS v FROM h GROUP BY ALL), l2 AS (SELECT product, uf, CAST(sum(preco_q) AS DOUBLE) / count(*) AS v FROM h GROUP BY ALL), l3 AS (SELECT product, mes, CAST(sum(preco_q) AS DOUBLE) / count(*) AS v FROM h GROUP BY ALL), l4 AS (SELECT product, CAST(sum(preco_q) AS DOUBLE) / count(*) AS v FROM h GROUP BY ALL)"
FALLBACK = "SELECT g.product, g.uf, g.mes, coalesce(l1.v, l2.v, l3.v, l4.v) / 10000.0 AS price, CASE WHEN l1.v IS NOT NULL THEN 100 WHEN l2.v IS NOT NULL THEN 30 WHEN l3.v IS NOT NULL THEN 20 WHEN l4.v IS NOT NULL THEN 10 END AS confidence FROM g LEFT JOIN l1 ON l1.product = g.product AND l1.uf = g.uf AND l1.mes = g.mes LEFT JOIN l2 ON l2.product = g.product AND l2.uf = g.uf LEFT JOIN l3 ON l3.product = g.product AND l3.mes = g.mes LEFT JOIN l4 ON l4.product = g.product"


@query(f"WITH fact AS FACT, {HISTORY} {FALLBACK}")
def j10_price_fallback(spark, sf_dir):
    """Series and month, series, product and month, product: the first level with a history decides."""
    f = fact(spark, sf_dir)
    h = f.filter(F.col("ano").isin(YEAR - 2, YEAR - 1))
    levels = [(_mean(h, k), k) for k in ([*KEY, "mes"], KEY, ["product", "mes"], ["product"])]
    g = tables.cascade(tables.month_grid(f.select(*KEY).distinct()), levels, "v", "price_q", "level")
    sure = F.when(F.col("level") == 1, 100).when(F.col("level") == 2, 30).when(F.col("level") == 3, 20).when(F.col("level") == 4, 10)
    return g.select(*KEY, "mes", (F.col("price_q") / 10000.0).alias("price"), sure.alias("confidence"))


@query("WITH fact AS FACT, a AS (SELECT product, uf, CAST(sum(preco_q) AS DOUBLE) / count(*) AS v FROM fact WHERE ano = 2001 GROUP BY ALL), b AS (SELECT product, uf, CAST(sum(preco_q) AS DOUBLE) / count(*) AS v FROM fact WHERE ano IN (1999, 2000) GROUP BY ALL) SELECT k.product, k.uf, coalesce(a.v, b.v) / 10000.0 AS base FROM (SELECT DISTINCT product, uf FROM fact) k LEFT JOIN a ON a.product = k.product AND a.uf = k.uf LEFT JOIN b ON b.product = k.product AND b.uf = k.uf")
def j11_base_price(spark, sf_dir):
    f = fact(spark, sf_dir)
    levels = [(_mean(f.filter(F.col("ano") == YEAR), KEY), KEY), (_mean(f.filter(F.col("ano").isin(YEAR - 2, YEAR - 1)), KEY), KEY)]
    return tables.cascade(f.select(*KEY).distinct(), levels, "v", "q", "level").select(*KEY, (F.col("q") / 10000.0).alias("base"))


#: The years whose prices make seasonal factors.
FACTOR_YEARS = (YEAR - 2, YEAR - 1)


def _factor(level: str, keys: str) -> str:
    """The rule for each key and month: the month's mean is within half and double the median of all the key's prices, which have six calendar months."""
    return f"""{level} AS (SELECT {keys}, mes, (CAST(s AS HUGEINT) * tn * 20000 + n * ts) // (2 * n * ts) / 10000.0::DOUBLE - 1 AS v FROM
  (SELECT {keys}, mes, CAST(sum(preco_q) AS BIGINT) AS s, count(*) AS n FROM fact WHERE ano IN {FACTOR_YEARS} AND preco_q > 0 GROUP BY ALL) m JOIN
  (SELECT {keys}, CAST(sum(preco_q) AS HUGEINT) AS ts, count(*) AS tn, quantile_cont(preco_q, 0.5) AS md FROM fact WHERE ano IN {FACTOR_YEARS} AND preco_q > 0 GROUP BY ALL HAVING count(DISTINCT mes) >= 6) t USING ({keys})
  WHERE s >= 0.5 * md * n AND s <= 2.0 * md * n)"""


def seasonal_factor(df: DataFrame, keys: list[str], years: tuple[int, ...] = FACTOR_YEARS) -> DataFrame:
    """A month's mean over the mean of all months, less one, to four digits, of the prices of some years.

    Only keys with six calendar months, and only months whose mean is within
    half and double the key's median, so that mistyped prices make no factor.
    """
    known = df.filter(F.col("ano").isin(*years) & (F.col("preco_q") > 0))
    m = known.groupBy(*keys, "mes").agg(F.sum("preco_q").alias("s"), F.count("*").alias("n"))
    t = known.groupBy(*keys).agg(F.sum("preco_q").alias("ts"), F.count("*").alias("tn"), F.percentile("preco_q", 0.5).alias("md"), F.count_distinct("mes").alias("k")).filter("k >= 6")
    ratio = F.expr("(cast(s as decimal(38,0)) * tn * 20000 + cast(n as decimal(38,0)) * ts) div (2 * cast(n as decimal(38,0)) * ts)")
    near = (F.col("s") >= F.lit(0.5) * F.col("md") * F.col("n")) & (F.col("s") <= F.lit(2.0) * F.col("md") * F.col("n"))
    return m.join(t, keys).filter(near).select(*keys, "mes", (ratio / F.lit(10000.0) - 1).alias("v"))


@query(f"WITH fact AS FACT, {_factor('l1', 'product, uf')}, {_factor('l2', 'product, region')}, {_factor('l3', 'product')}, g AS (SELECT product, uf, region, CAST(m AS INTEGER) AS mes FROM (SELECT DISTINCT product, uf, region FROM fact), range(1, 13) r(m)) SELECT g.product, g.uf, g.mes, coalesce(l1.v, l2.v, l3.v) AS factor FROM g LEFT JOIN l1 ON l1.product = g.product AND l1.uf = g.uf AND l1.mes = g.mes LEFT JOIN l2 ON l2.product = g.product AND l2.region = g.region AND l2.mes = g.mes LEFT JOIN l3 ON l3.product = g.product AND l3.mes = g.mes")
def j12_seasonal_factor(spark, sf_dir):
    f = fact(spark, sf_dir)
    g = tables.month_grid(f.select(*KEY, "region").distinct())
    levels = [(seasonal_factor(f, k), [*k, "mes"]) for k in (KEY, ["product", "region"], ["product"])]
    return tables.cascade(g, levels, "v", "factor", "level").select(*KEY, "mes", "factor")


@query(f"WITH fact AS FACT, {LIVE}, b AS ({MODAL.format('1999, 2000')}), c AS (SELECT mes, product, status, count(*) AS k FROM b GROUP BY ALL), a AS (SELECT product, mes, CAST(sum(CAST(round(confidence * 10000) AS BIGINT)) AS DOUBLE) / count(*) / 10000.0 AS confidence, count(*) AS ufs FROM b GROUP BY ALL) SELECT a.product, a.mes, c.status, a.ufs, a.confidence FROM a JOIN (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY product, mes ORDER BY k DESC, status) = 1) c ON c.product = a.product AND c.mes = a.mes")
def j16_national_baseline(spark, sf_dir):
    b = modal_baseline(seasonality(fact(spark, sf_dir)), (1999, 2000))
    sure = F.sum(F.round(F.col("confidence") * 10000).cast("long")) / F.count("*") / 10000.0
    return b.groupBy("product", "mes").agg(F.mode("status", deterministic=True).alias("status"), F.count("*").alias("ufs"), sure.alias("confidence"))


@query(f"WITH fact AS FACT, {LIVE}, b AS ({MODAL.format('1999, 2000')}), last AS (SELECT product, uf, arg_max(preco_q, periodo) AS preco_q FROM fact WHERE periodo <= {PERIOD} GROUP BY ALL) SELECT b.product, b.uf, b.mes, last.preco_q, b.status FROM b JOIN last ON last.product = b.product AND last.uf = b.uf WHERE NOT EXISTS (SELECT 1 FROM fact f WHERE f.product = b.product AND f.uf = b.uf AND f.mes = b.mes AND f.ano = {YEAR} AND f.periodo <= {PERIOD})")
def j17_projection(spark, sf_dir):
    """Months of the current year without a price get the baseline's status and the last price."""
    f = fact(spark, sf_dir)
    b = modal_baseline(seasonality(f), (YEAR - 2, YEAR - 1))
    known = f.filter(F.col("periodo") <= PERIOD)
    last = known.groupBy(*KEY).agg(F.max_by("preco_q", "periodo").alias("preco_q"))
    return tables.without(b, known.filter(F.col("ano") == YEAR), [*KEY, "mes"]).join(last, KEY).select(*KEY, "mes", "preco_q", "status")


def anchored(df: DataFrame, year: int) -> DataFrame:
    """The newest price of each series and month in three years, its age, and the mean of the twelve periods before it."""
    ref = windows.calendar_trailing(df, KEY, "periodo", "preco_q", -12, -1)
    ref = stats.with_volatility(ref, KEY, "preco_q")
    best = windows.top_per_key(ref.filter(F.col("ano").between(year - 2, year)), [*KEY, "mes"], [F.desc("ano")])
    status = F.when(F.col("n") >= 6, rules.sensitive(F.col("preco_q") / F.lit(10000.0), F.col("total") / F.col("n") / F.lit(10000.0), F.col("cv")))
    kind = F.when(F.col("ano") == year, "REAL_ATUAL").otherwise("HISTORICO_BASE")
    return best.select(*KEY, "mes", "ano", "preco_q", (F.lit(year) - F.col("ano")).alias("age"), kind.alias("kind"), "n", status.alias("status"))


ANCHOR = f"""{VOLATILITY}, ref AS (SELECT a.product, a.uf, a.mes, a.ano, a.periodo, a.preco_q, count(b.preco_q) AS n, CAST(sum(b.preco_q) AS BIGINT) AS s FROM fact a LEFT JOIN fact b ON a.product = b.product AND a.uf = b.uf AND b.periodo BETWEEN a.periodo - 12 AND a.periodo - 1 GROUP BY a.product, a.uf, a.mes, a.ano, a.periodo, a.preco_q),
best AS (SELECT * FROM ref WHERE ano BETWEEN {YEAR - 2} AND {YEAR} QUALIFY row_number() OVER (PARTITION BY product, uf, mes ORDER BY ano DESC) = 1),
z AS (SELECT best.*, preco_q / 10000.0::DOUBLE AS p, s / nullif(best.n, 0)::DOUBLE / 10000.0::DOUBLE AS r, cv FROM best LEFT JOIN vol ON vol.product = best.product AND vol.uf = best.uf),
zz AS (SELECT *, greatest(coalesce(cv, 0), CASE WHEN r <= 5 THEN 0.02 WHEN r <= 20 THEN 0.05 ELSE 0.08 END::DOUBLE) AS w FROM z),
anchor AS (SELECT product, uf, mes, ano, preco_q, {YEAR} - ano AS age, CASE WHEN ano = {YEAR} THEN 'REAL_ATUAL' ELSE 'HISTORICO_BASE' END AS kind, n, CASE WHEN n >= 6 THEN {SENSITIVE} END AS status FROM zz)"""


@query(f"WITH fact AS FACT, {ANCHOR} SELECT * FROM anchor")
def j19_anchor(spark, sf_dir):
    return anchored(fact(spark, sf_dir), YEAR)


def serving(df: DataFrame, year: int) -> DataFrame:
    """One row for each series and month of the complete products: real, anchored or a fallback.

    A product is complete if it has all twelve months in one of the two years
    before.  Real rows are the year's own; anchored rows show an older price;
    the rest take last year's status, else the baseline's, else yellow.
    """
    months = df.filter(F.col("ano").isin(year - 2, year - 1)).groupBy("product", "ano").agg(F.count_distinct("mes").alias("k")).filter("k = 12")
    rows = df.join(months.select("product").distinct(), "product", "left_semi")
    a = anchored(rows, year)
    shown = a.select(*KEY, "mes", "preco_q", F.coalesce("status", F.lit(rules.YELLOW)).alias("status"), "kind")
    base = modal_baseline(seasonality(rows), (year - 2, year - 1)).select(*KEY, "mes", F.col("status").alias("base"))
    rest = tables.missing(tables.month_grid(rows.select(*KEY).distinct()), shown, [*KEY, "mes"]).join(base, [*KEY, "mes"], "left")
    deep = rest.select(*KEY, "mes", F.lit(None).cast("long").alias("preco_q"), F.coalesce("base", F.lit(rules.YELLOW)).alias("status"), F.lit("FALLBACK").alias("kind"))
    return shown.unionByName(deep)


SERVING = f"""full_ AS (SELECT DISTINCT product FROM (SELECT product, ano FROM fact0 WHERE ano IN ({YEAR - 2}, {YEAR - 1}) GROUP BY ALL HAVING count(DISTINCT mes) = 12)), fact AS (SELECT * FROM fact0 WHERE product IN (SELECT product FROM full_))"""


@query(
    f"""WITH fact0 AS FACT, {SERVING}, {ANCHOR}, {LIVE.replace(VOLATILITY + ",", "")}, base AS ({MODAL.format(f"{YEAR - 2}, {YEAR - 1}")}), g AS (SELECT product, uf, CAST(m AS INTEGER) AS mes FROM (SELECT DISTINCT product, uf FROM fact), range(1, 13) r(m))
SELECT product, uf, mes, preco_q, coalesce(status, 'AMARELO') AS status, kind FROM anchor UNION ALL
SELECT g.product, g.uf, g.mes, NULL, coalesce(base.status, 'AMARELO'), 'FALLBACK' FROM g LEFT JOIN base ON base.product = g.product AND base.uf = g.uf AND base.mes = g.mes WHERE NOT EXISTS (SELECT 1 FROM anchor a WHERE a.product = g.product AND a.uf = g.uf AND a.mes = g.mes)"""
)
def j18_serving(spark, sf_dir):
    return serving(fact(spark, sf_dir), YEAR)


@query(f"WITH fact0 AS FACT, {SERVING} SELECT product FROM full_")
def j21_complete_products(spark, sf_dir):
    f = fact(spark, sf_dir).filter(F.col("ano").isin(YEAR - 2, YEAR - 1))
    return f.groupBy("product", "ano").agg(F.count_distinct("mes").alias("k")).filter("k = 12").select("product").distinct()


@query("WITH fact AS FACT SELECT product, uf FROM fact GROUP BY product, uf HAVING count(*) < 24 OR count(DISTINCT mes) < 12")
def j22_sparse_series(spark, sf_dir):
    g = fact(spark, sf_dir).groupBy(*KEY).agg(F.count("*").alias("n"), F.count_distinct("mes").alias("m"))
    return g.filter("n < 24 or m < 12").select(*KEY)


@query("WITH fact AS FACT, a AS (SELECT product, uf, CAST(sum(preco_q) AS DOUBLE) / count(*) AS v FROM fact WHERE ano = 2000 GROUP BY ALL), b AS (SELECT product, uf, mes, preco_q / v AS ratio FROM fact JOIN a USING (product, uf) WHERE ano = 2001) SELECT product, quantile_cont(ratio, 0.5) AS factor, count(*) AS n FROM b GROUP BY product HAVING count(*) >= 5")
def j25_median_factor(spark, sf_dir):
    f = fact(spark, sf_dir)
    b = f.filter("ano = 2001").join(_mean(f.filter("ano = 2000"), KEY), KEY).select("product", (F.col("preco_q") / F.col("v")).alias("ratio"))
    return b.groupBy("product").agg(F.percentile("ratio", 0.5).alias("factor"), F.count("*").alias("n")).filter("n >= 5")


@query("WITH fact AS FACT, m AS (SELECT product, quantile_cont(preco_q, 0.5) AS md FROM fact GROUP BY ALL) SELECT f.product, f.uf, f.periodo, CASE WHEN preco_q > 1.2::DOUBLE * md THEN 'cx' WHEN preco_q < 0.8::DOUBLE * md THEN 'un' ELSE 'kg' END AS unit FROM fact f JOIN m ON m.product = f.product")
def j26_inferred_unit(spark, sf_dir):
    f = fact(spark, sf_dir)
    m = f.groupBy("product").agg(F.percentile("preco_q", 0.5).alias("md"))
    unit = F.when(F.col("preco_q") > F.lit(1.2) * F.col("md"), "cx").when(F.col("preco_q") < F.lit(0.8) * F.col("md"), "un").otherwise("kg")
    return f.join(m, "product").select(*KEY, "periodo", unit.alias("unit"))


@query(f"WITH fact AS FACT, {GRID}, {FILLED} SELECT product, uf, periodo, coalesce(f, b) AS healed, preco_q IS NULL AS estimated FROM a")
def j27_healed_grid(spark, sf_dir):
    g = windows.carried_back(windows.carried_forward(series_grid(fact(spark, sf_dir)), KEY, "periodo", "preco_q", "f"), KEY, "periodo", "preco_q", "b")
    return g.select(*KEY, "periodo", F.coalesce("f", "b").alias("healed"), F.col("preco_q").isNull().alias("estimated"))


@query(f"WITH {FLOWS}, b AS (SELECT product, destino AS uf, CAST(sum(n) AS BIGINT) AS n, string_agg(DISTINCT origem, ', ' ORDER BY origem) AS origins FROM flows WHERE origem <> destino GROUP BY ALL) SELECT product, uf, n, origins, CASE WHEN n >= 10 THEN 'forte' ELSE 'fraco' END AS label FROM b")
def j31_supply_flows(spark, sf_dir):
    f = flows(spark, sf_dir).filter("origem <> destino").groupBy("product", F.col("destino").alias("uf")).agg(F.sum("n").alias("n"), stats.distinct_text(F.col("origem")).alias("origins"))
    return f.withColumn("label", F.when(F.col("n") >= 10, "forte").otherwise("fraco"))


@query(f"WITH fact AS FACT, {FLOWS}, last AS (SELECT product, uf, arg_max(preco_q, periodo) AS preco_q FROM fact GROUP BY ALL), b AS (SELECT product, destino AS uf, count(*) AS routes FROM flows WHERE origem <> destino GROUP BY ALL), g AS (SELECT p.product, u.uf FROM (SELECT DISTINCT product FROM fact) p, (SELECT DISTINCT uf FROM fact) u) SELECT g.product, g.uf, preco_q, coalesce(routes, 0) AS routes, CASE WHEN preco_q IS NOT NULL THEN 'REAL' WHEN routes IS NOT NULL THEN 'PROXY' ELSE 'AUSENTE' END AS coverage FROM g LEFT JOIN last ON last.product = g.product AND last.uf = g.uf LEFT JOIN b ON b.product = g.product AND b.uf = g.uf")
def j32_supply_map(spark, sf_dir):
    f = fact(spark, sf_dir)
    places = f.agg(F.array_sort(F.collect_set("uf")).alias("ufs")).select("ufs").scalar()
    g = f.select("product").distinct().withColumn("ufs", places).select("product", F.explode("ufs").alias("uf"))
    last = f.groupBy(*KEY).agg(F.max_by("preco_q", "periodo").alias("preco_q"))
    b = flows(spark, sf_dir).filter("origem <> destino").groupBy("product", F.col("destino").alias("uf")).agg(F.count("*").alias("routes"))
    cover = F.when(F.col("preco_q").isNotNull(), "REAL").when(F.col("routes").isNotNull(), "PROXY").otherwise("AUSENTE")
    return g.join(last, KEY, "left").join(b, KEY, "left").select(*KEY, "preco_q", F.coalesce("routes", F.lit(0)).cast("long").alias("routes"), cover.alias("coverage"))


def national(df: DataFrame, least_ufs: int = 5) -> DataFrame:
    """Quorum status, weighted price and states of each product and period."""
    u = df.groupBy("product", "periodo", "uf").agg(F.mode("status", deterministic=True).alias("status"), F.sum("preco_q").alias("s"), F.count("*").alias("w"))
    g = u.groupBy("product", "periodo").agg(F.count_if(F.col("status") == rules.RED).alias("red"), F.count_if(F.col("status") == rules.GREEN).alias("green"), F.count("*").alias("ufs"), (F.sum("s") / F.sum("w") / 10000.0).alias("price"))
    return g.filter(F.col("ufs") >= least_ufs).select("product", "periodo", "ufs", "price", rules.quorum(F.col("red"), F.col("green"), F.col("ufs")).alias("status"))


@query(f"WITH fact AS FACT, {LIVE}, g AS (SELECT product, periodo, count(*) AS ufs, CAST(sum(preco_q) AS DOUBLE) / count(*) / 10000.0 AS price, count(*) FILTER (WHERE status = 'VERMELHO') AS r, count(*) FILTER (WHERE status = 'VERDE') AS v FROM live GROUP BY ALL) SELECT product, periodo, ufs, price, CASE WHEN r * 100 >= ufs * 40 THEN 'VERMELHO' WHEN v * 100 >= ufs * 40 THEN 'VERDE' ELSE 'AMARELO' END AS status FROM g WHERE ufs >= 5")
def j33_national(spark, sf_dir):
    return national(seasonality(fact(spark, sf_dir)))


@query(f"WITH fact AS FACT, {LIVE}, l AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY product, uf ORDER BY periodo DESC) = 1), c AS (SELECT region, product, status, count(*) AS k FROM l GROUP BY ALL), g AS (SELECT region, product, count(*) AS ufs, CAST(sum(preco_q) AS DOUBLE) / count(*) / 10000.0 AS price FROM l GROUP BY ALL HAVING count(*) >= 2) SELECT g.region, g.product, g.ufs, g.price, c.status FROM g JOIN (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY region, product ORDER BY k DESC, status) = 1) c ON c.region = g.region AND c.product = g.product")
def j34_regional_snapshot(spark, sf_dir):
    latest = windows.top_per_key(seasonality(fact(spark, sf_dir)), KEY, [F.desc("periodo")])
    g = latest.groupBy("region", "product").agg(F.count("*").alias("ufs"), (F.sum("preco_q") / F.count("*") / 10000.0).alias("price"), F.mode("status", deterministic=True).alias("status"))
    return g.filter("ufs >= 2")


@query(f"WITH fact AS FACT, {GRID} SELECT product, uf, count(*) FILTER (WHERE preco_q IS NULL) AS gaps, string_agg(CAST(periodo AS VARCHAR), ', ' ORDER BY periodo) FILTER (WHERE preco_q IS NULL) AS missing FROM g GROUP BY product, uf")
def j45_gap_report(spark, sf_dir):
    g = series_grid(fact(spark, sf_dir))
    miss = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("preco_q").isNull(), F.col("periodo")))), lambda p: p.cast("string")), ", ")
    return g.groupBy(*KEY).agg(F.count_if(F.col("preco_q").isNull()).alias("gaps"), F.nullif(miss, F.lit("")).alias("missing"))


@query(f"WITH fact AS FACT, {LIVE}, l AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY product, uf ORDER BY periodo DESC) = 1) SELECT uf, count(*) AS series, count(*) FILTER (WHERE status = 'VERDE') AS green, count(*) FILTER (WHERE status = 'VERMELHO') AS red, count(*) FILTER (WHERE periodo >= {PERIOD} - 3) * 100.0::DOUBLE / count(*) AS fresh_pct FROM l GROUP BY uf")
def j50_state_coverage(spark, sf_dir):
    latest = windows.top_per_key(seasonality(fact(spark, sf_dir)), KEY, [F.desc("periodo")])
    return latest.groupBy("uf").agg(F.count("*").alias("series"), F.count_if(F.col("status") == rules.GREEN).alias("green"), F.count_if(F.col("status") == rules.RED).alias("red"), (F.count_if(F.col("periodo") >= PERIOD - 3) * 100.0 / F.count("*")).alias("fresh_pct"))


@query(f"WITH fact AS FACT, {LIVE}, a AS (SELECT product, uf, periodo, status FROM live), b AS (SELECT product, uf, periodo, {STATUS} AS status FROM (SELECT *, {TRAILING} FROM fact {NAMED})) SELECT a.product, a.uf, a.periodo, a.status AS live_rule, b.status AS old_rule FROM a JOIN b ON a.product = b.product AND a.uf = b.uf AND a.periodo = b.periodo WHERE a.status IS DISTINCT FROM b.status")
def j41_rule_change(spark, sf_dir):
    s = seasonality(fact(spark, sf_dir))
    old = rules.mean_band(F.col("preco_q"), F.col("total"), F.col("n"))
    return s.select(*KEY, "periodo", F.col("status").alias("live_rule"), old.alias("old_rule")).filter(~F.col("live_rule").eqNullSafe(F.col("old_rule")))


def snapshot(df: DataFrame, uf: str | None = None, product: str | None = None, status: str | None = None, page: int = 1, size: int = 50) -> DataFrame:
    """The newest row of each series that passes the filters, a page at a time."""
    rows = tables.filtered(df, uf=uf.upper() if uf else None)
    latest = windows.top_per_key(tables.contains(rows, "product", product), KEY, [F.desc("periodo")])
    return tables.page(tables.filtered(latest, status=status), [F.asc("product"), F.asc("uf")], page, size)


@query(f"WITH fact AS FACT, {LIVE}, l AS (SELECT * FROM live WHERE uf = 'NATION_1' QUALIFY row_number() OVER (PARTITION BY product, uf ORDER BY periodo DESC) = 1) SELECT product, uf, periodo, preco_q, status FROM l WHERE product ILIKE '%brand#1%' ORDER BY product, uf LIMIT 3 OFFSET 0")
def k1_snapshot(spark, sf_dir):
    return snapshot(seasonality(fact(spark, sf_dir)), "nation_1", "brand#1", None, 1, 3).select(*KEY, "periodo", "preco_q", "status")


@query("WITH fact AS FACT SELECT a.product, a.uf, a.preco_q, b.preco_q AS previous, c.confidence FROM fact a LEFT JOIN fact b ON b.product = a.product AND b.uf = a.uf AND b.periodo = a.periodo - 1 LEFT JOIN (SELECT product, uf, count(DISTINCT ano) * 100.0::DOUBLE / 7 AS confidence FROM fact WHERE mes = 8 GROUP BY ALL) c ON c.product = a.product AND c.uf = a.uf WHERE a.ano = 2001 AND a.mes = 8")
def k3_with_prices(spark, sf_dir):
    f = fact(spark, sf_dir)
    sure = f.filter("mes = 8").groupBy(*KEY).agg((F.count_distinct("ano") * 100.0 / 7).alias("confidence"))
    now = windows.previous_period(f.filter("ano = 2001 and mes in (7, 8)").select(*KEY, "periodo", "mes", "preco_q"), KEY, "periodo", "preco_q").filter("mes = 8")
    return now.join(sure, KEY, "left").select(*KEY, "preco_q", "previous", "confidence")
