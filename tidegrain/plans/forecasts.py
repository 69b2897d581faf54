"""Forecasts and loads: projected prices, weighted forecasts, hybrid and predictive baselines, cold starts, the full load."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrain.functions import rules
from tidegrain.operators import stats, tables, windows
from tidegrain.plans.composite import ANCHORED, BY_CATEGORY, BY_LAST, HISTORY, KEY, LIVE, MODAL, MONTH, PERIOD, YEAR, _factor, modal_baseline, modal_pair, seasonal_factor, seasonality
from tidegrain.plans.facts import FACT, fact
from tidegrain.plans.kit import registrar
from tidegrain.plans.rules_queries import anomalies
from tidegrain.sources import folders

QUERIES, SQL, query = registrar()

# The names of the projection's methods.
BY_MEAN, BY_FACTOR, BY_PROXY = "SANDUICHE_MEDIA_24_25", "SANDUICHE_FATOR_SAZONAL", "PROXY_HIERARQUICO"
#: New products of the queries: their rows before the current year are left out.
NEW = "% ring"


def _first_word(name: str):
    return F.split(F.lower(F.col(name)), " ")[0]


def projected(f: DataFrame, year: int, month: int, kg: DataFrame | None = None, forecast: DataFrame | None = None) -> DataFrame:
    """product, uf, mes, price_q, reference_q, method and confidence of the year's months without a price.

    f holds observed months up to the given one.  Past months get the mean of
    two years (by the first of four levels that has one) moved by the change
    between them; months to come the base price times the seasonal factor.

    kg has product, uf and factor: prices are per factor units and come out
    per one (0 and none count as 1).  forecast has product, uf, mes, method,
    confidence and base_confidence of months that were forecast before: of
    past ones the method stays, and the surer of both confidences counts; of
    those to come the surer of the level's and base_confidence.
    """
    past, now = f.filter(F.col("ano").isin(year - 2, year - 1)), f.filter(F.col("ano") == year)
    mean = lambda df, keys: df.groupBy(*keys).agg((F.sum("preco_q") / F.count("*")).alias("v"))
    grid = tables.without(tables.month_grid(past.select(*KEY, "region").distinct()), now, [*KEY, "mes"])
    x = tables.cascade(grid, [(mean(past, k), k) for k in ([*KEY, "mes"], KEY, ["product", "mes"], ["product"])], "v", "history", "level")
    x = tables.cascade(x, [(mean(now, KEY), KEY), (mean(past, KEY), KEY)], "v", "own_base", "base_level")
    x = tables.cascade(x, [(seasonal_factor(past, k, (year - 2, year - 1)), [*k, "mes"]) for k in (KEY, ["product", "region"], ["product"])], "v", "factor", "factor_level")
    in_year = lambda y: F.max(F.when(F.col("ano") == y, F.col("preco_q")))
    change = past.groupBy(*KEY, "mes").agg(in_year(year - 2).alias("p0"), in_year(year - 1).alias("p1")).select(*KEY, "mes", F.expr("(p1 * 20000 + p0) div (2 * p0)").alias("ratio"))
    x = x.join(change, [*KEY, "mes"], "left")
    base, retro = F.coalesce("own_base", "history"), F.col("mes") <= month
    price = F.when(retro, F.col("history") * F.coalesce(F.col("ratio"), F.lit(10000)) / F.lit(10000.0)).otherwise(base * (F.lit(1.0) + F.coalesce(F.col("factor"), F.lit(0.0))))
    sure = F.when(F.col("level") == 1, 100.0).when(F.col("level") == 2, 30.0).when(F.col("level") == 3, 20.0).otherwise(10.0)
    method = F.when(~retro & F.col("factor").isNotNull(), BY_FACTOR).otherwise(BY_MEAN)
    if forecast is not None:
        x = x.join(forecast.select(*KEY, "mes", F.col("method").alias("old_method"), F.col("confidence").alias("old_sure"), "base_confidence"), [*KEY, "mes"], "left")
        method = F.when(retro & F.col("old_method").isin(ANCHORED, BY_CATEGORY, BY_LAST), F.col("old_method")).otherwise(method)
        sure = F.greatest(sure, F.coalesce(F.when(retro, F.col("old_sure")).otherwise(F.col("base_confidence")), F.lit(0.0)))
    per = F.lit(1)
    if kg is not None:
        x = x.join(kg.select(*KEY, F.col("factor").alias("kg")), KEY, "left")
        per = F.coalesce(F.nullif("kg", F.lit(0)), F.lit(1))
    reference = F.when(retro, F.col("history")).otherwise(base)
    return x.select(*KEY, "mes", (price / per).alias("price_q"), (reference / per).alias("reference_q"), method.alias("method"), sure.alias("confidence"))


def _best_parent(children: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each child (and month, if among keys) another product with the same first word: one with a factor first, then the shortest name.

    A word's two best products suffice, as a child can be one of them.
    """
    c = rows.groupBy(F.col("product").alias("parent"), *keys).agg(F.max((F.col("method") == BY_FACTOR).cast("int")).alias("has")).withColumn("_word", _first_word("parent"))
    order = [F.desc("has"), F.length("parent"), F.col("parent")]
    two = windows.top_per_key(c, ["_word", *keys], order, 2)
    pairs = children.withColumn("_word", _first_word("product")).join(two, ["_word", *keys]).filter("product != parent")
    return windows.top_per_key(pairs, ["product", *keys], order).select("product", *keys, "parent")


def with_proxies(forecasts: DataFrame, f: DataFrame, year: int, month: int) -> DataFrame:
    """forecasts, and rows of products that have none: those of a parent at the ratio of both products' prices this year.

    A proxy without movement of its own is projected again with the movement
    of the best parent of its month.
    """
    now = f.filter(F.col("ano") == year)
    following = forecasts.filter(F.col("mes") == month + 1)
    orphans = tables.without(now.select("product").distinct(), following, ["product"])
    parent = _best_parent(orphans, following, [])
    own = now.select("product", "uf", "mes", F.col("preco_q").alias("own_q")).join(parent, "product")
    theirs = now.select(F.col("product").alias("parent"), "uf", "mes", F.col("preco_q").alias("parent_q"))
    ratio = own.join(theirs, ["parent", "uf", "mes"]).groupBy("product", "uf").agg((F.sum(F.round(F.col("own_q") / F.col("parent_q") * 1_000_000).cast("long")) / F.count("*") / F.lit(1_000_000.0)).alias("r"))
    of = forecasts.filter(F.col("mes") > month).withColumnsRenamed({"product": "parent", "price_q": "parent_price", "reference_q": "parent_reference"}).drop("method")
    proxy = of.join(parent, "parent").join(ratio, KEY, "left")
    r = F.coalesce(F.col("r"), F.lit(1.0))
    proxy = proxy.select(*KEY, "mes", (F.col("parent_price") * r).alias("price_q"), (F.col("parent_reference") * r).alias("reference_q"), "confidence")
    flat = F.abs(F.col("price_q") - F.col("reference_q")) < 1
    best = _best_parent(proxy.filter(flat).select("product", "mes").distinct(), forecasts, ["mes"])
    moved = proxy.join(best, ["product", "mes"], "left").join(of.drop("confidence"), ["parent", "uf", "mes"], "left")
    again = F.col("reference_q") * (F.col("parent_price") / F.col("parent_reference"))
    price = F.when(flat & (F.abs(again - F.col("reference_q")) >= 1), again).otherwise(F.col("price_q"))
    return forecasts.unionByName(moved.select(*KEY, "mes", price.alias("price_q"), "reference_q", F.lit(BY_PROXY).alias("method"), "confidence"))


def _observed(spark, sf_dir) -> DataFrame:
    f = fact(spark, sf_dir, "p_name").filter(F.col("periodo") <= PERIOD)
    return f.filter((F.col("ano") == YEAR) | ~F.col("product").like(NEW))


#: Factors to kg of the projection's query; a factor of 0 is none.
_KG = "CASE WHEN product LIKE '% widget' AND (uf LIKE '%0' OR uf LIKE '%5') THEN 2 WHEN product LIKE '% rod' THEN 0 END"
_MEANS = HISTORY.split(", g AS")[0] + ", l1 AS" + HISTORY.split(", l1 AS")[1]


@query(
    f"""WITH raw AS {FACT.replace("p_brand", "p_name")}, fact AS (SELECT * FROM raw WHERE periodo <= {PERIOD} AND (ano = {YEAR} OR product NOT LIKE '{NEW}')), {LIVE},
{_MEANS}, {_factor("f1", "product, uf")}, {_factor("f2", "product, region")}, {_factor("f3", "product")},
now AS (SELECT * FROM fact WHERE ano = {YEAR}), g AS (SELECT product, uf, region, CAST(m AS INTEGER) AS mes FROM (SELECT DISTINCT product, uf, region FROM h), range(1, 13) r(m)),
miss AS (SELECT * FROM g ANTI JOIN now USING (product, uf, mes)),
a1 AS (SELECT product, uf, CAST(sum(preco_q) AS DOUBLE) / count(*) AS v FROM now GROUP BY ALL),
t AS (SELECT product, uf, mes, (max(preco_q) FILTER (ano = {YEAR - 1}) * 20000 + max(preco_q) FILTER (ano = {YEAR - 2})) // (2 * max(preco_q) FILTER (ano = {YEAR - 2})) AS ratio FROM h GROUP BY ALL),
m1 AS ({MODAL.format(f"{YEAR - 3}, {YEAR - 2}")}), m2 AS ({MODAL.format(f"{YEAR - 2}, {YEAR - 1}")}),
w AS (SELECT product, uf, mes, m2.confidence AS c2, round(CASE WHEN m1.status IS NOT NULL AND m2.status IS NOT NULL THEN least(m1.confidence * 0.6 + m2.confidence * 0.4, CASE WHEN m1.status = m2.status THEN 100 ELSE 40 END) WHEN m2.status IS NOT NULL THEN m2.confidence ELSE m1.confidence * 0.5 END, 4) AS wc FROM m1 FULL JOIN m2 USING (product, uf, mes)),
px AS (SELECT miss.*, wc, c2, coalesce(nullif({_KG}, 0), 1) AS kg, coalesce(l1.v, l2.v, l3.v, l4.v) AS hq, CASE WHEN l1.v IS NOT NULL THEN 100 WHEN l2.v IS NOT NULL THEN 30 WHEN l3.v IS NOT NULL THEN 20 ELSE 10 END AS confidence, coalesce(a1.v, l2.v, l1.v, l3.v, l4.v) AS base, coalesce(f1.v, f2.v, f3.v) AS factor, coalesce(ratio, 10000) AS ratio
  FROM miss LEFT JOIN l1 USING (product, uf, mes) LEFT JOIN l2 USING (product, uf) LEFT JOIN l3 USING (product, mes) LEFT JOIN l4 USING (product) LEFT JOIN a1 USING (product, uf)
  LEFT JOIN f1 USING (product, uf, mes) LEFT JOIN f2 USING (product, region, mes) LEFT JOIN f3 USING (product, mes) LEFT JOIN t USING (product, uf, mes) LEFT JOIN w USING (product, uf, mes)),
fc AS (SELECT product, uf, mes, CASE WHEN mes <= {MONTH} THEN hq * ratio / 10000.0 ELSE base * (1.0 + coalesce(factor, 0)) END / kg AS p, CASE WHEN mes <= {MONTH} THEN hq ELSE base END / kg AS r,
  CASE WHEN mes <= {MONTH} AND wc IS NOT NULL THEN '{ANCHORED}' WHEN mes > {MONTH} AND factor IS NOT NULL THEN '{BY_FACTOR}' ELSE '{BY_MEAN}' END AS method, greatest(confidence, coalesce(CASE WHEN mes <= {MONTH} THEN wc ELSE c2 END, 0))::DOUBLE AS confidence FROM px),
nxt AS (SELECT product, max(CAST(method = '{BY_FACTOR}' AS INTEGER)) AS has FROM fc WHERE mes = {MONTH + 1} GROUP BY ALL),
parent AS (SELECT o.product, c.product AS parent FROM (SELECT DISTINCT product FROM now ANTI JOIN nxt USING (product)) o JOIN nxt c ON split_part(o.product, ' ', 1) = split_part(c.product, ' ', 1) QUALIFY row_number() OVER (PARTITION BY o.product ORDER BY has DESC, length(c.product), c.product) = 1),
ratio AS (SELECT p.product, a.uf, CAST(sum(CAST(round(a.preco_q::DOUBLE / b.preco_q * 1000000) AS BIGINT)) AS DOUBLE) / count(*) / 1000000.0 AS k FROM parent p JOIN now a ON a.product = p.product JOIN now b ON b.product = p.parent AND b.uf = a.uf AND b.mes = a.mes GROUP BY ALL),
proxy AS (SELECT p.product, fc.uf, fc.mes, fc.p * coalesce(k, 1) AS p, fc.r * coalesce(k, 1) AS r, fc.confidence FROM parent p JOIN fc ON fc.product = p.parent AND fc.mes > {MONTH} LEFT JOIN ratio ON ratio.product = p.product AND ratio.uf = fc.uf),
cand AS (SELECT product AS parent, mes, max(CAST(method = '{BY_FACTOR}' AS INTEGER)) AS has FROM fc GROUP BY ALL),
best AS (SELECT q.product, q.mes, parent FROM (SELECT DISTINCT product, mes FROM proxy WHERE abs(p - r) < 1) q JOIN cand ON cand.mes = q.mes AND split_part(q.product, ' ', 1) = split_part(parent, ' ', 1) AND q.product <> parent QUALIFY row_number() OVER (PARTITION BY q.product, q.mes ORDER BY has DESC, length(parent), parent) = 1),
again AS (SELECT y.*, y.r * (fc.p / fc.r) AS z FROM proxy y LEFT JOIN best USING (product, mes) LEFT JOIN fc ON fc.product = best.parent AND fc.uf = y.uf AND fc.mes = y.mes),
every AS (SELECT * FROM fc UNION ALL SELECT product, uf, mes, CASE WHEN abs(p - r) < 1 AND abs(z - r) >= 1 THEN z ELSE p END, r, '{BY_PROXY}', confidence FROM again)
SELECT product, uf, mes, p / 10000.0 AS price, r / 10000.0 AS reference, CASE WHEN p * 100 < r * 75 THEN 'VERDE' WHEN p * 100 > r * 125 THEN 'VERMELHO' ELSE 'AMARELO' END AS status, method, confidence FROM every"""
)
def j14_sandwich_projection(spark, sf_dir):
    """Projected prices of every month without one, products without history by a parent; status by 25 %."""
    f = folders.stored(_observed(spark, sf_dir))
    pair = modal_pair(seasonality(f), (YEAR - 3, YEAR - 2), (YEAR - 2, YEAR - 1))
    sure = F.round(rules.agreement_confidence(F.col("s1"), F.col("c1"), F.col("s2"), F.col("c2")), 4)
    before = pair.select(*KEY, "mes", F.lit(ANCHORED).alias("method"), sure.alias("confidence"), F.col("c2").alias("base_confidence"))
    kg = f.select(*KEY).distinct().select(*KEY, F.expr(_KG).alias("factor")).filter("factor is not null")
    out = with_proxies(folders.stored(projected(f, YEAR, MONTH, kg, before)), f, YEAR, MONTH)
    p, r = F.col("price_q"), F.col("reference_q")
    return out.select(*KEY, "mes", (p / F.lit(10000.0)).alias("price"), (r / F.lit(10000.0)).alias("reference"), F.coalesce(rules.band(p, r, 25), F.lit(rules.YELLOW)).alias("status"), "method", "confidence")


def weighted_forecast(s: DataFrame, year: int, period: int) -> DataFrame:
    """All twelve months of the year: observed statuses, else the agreement of two overlapping baselines, with the trend along the year.

    s is seasonality()'s result.  An observed month always beats its forecast.
    """
    # One grouping by series and month has both baselines and the observed status; the months come from one row for each series.
    early, late = F.col("ano").isin(year - 3, year - 2), F.col("ano").isin(year - 2, year - 1)
    now = (F.col("ano") == year) & (F.col("periodo") <= period)
    counts = s.filter(early | late | now).groupBy(*KEY, "mes", "status").agg(F.count_if(early).alias("k1"), F.count_if(late).alias("k2"), F.count_if(now).alias("k3"))
    best = lambda k: F.min(F.when((F.col(k) > 0) & F.col("status").isNotNull(), F.struct((-F.col(k)).alias("k"), "status")))
    share = lambda k, b: (F.col(f"{b}.k") * -100.0 / F.nullif(F.col(k), F.lit(0)))
    m = counts.groupBy(*KEY, "mes").agg(best("k1").alias("b1"), F.sum("k1").alias("t1"), best("k2").alias("b2"), F.sum("k2").alias("t2"), F.max(F.when(F.col("k3") > 0, F.struct("status"))).alias("real"))
    s1, s2, c1, c2 = F.col("b1.status"), F.col("b2.status"), share("t1", "b1"), share("t2", "b2")
    there = F.struct("mes", F.coalesce("real.status", rules.agreement(s1, s2), F.lit(rules.YELLOW)).alias("status"), F.when(F.col("real").isNotNull(), 100.0).otherwise(F.coalesce(F.round(rules.agreement_confidence(s1, c1, s2, c2), 4), F.lit(0.0))).alias("confidence"), F.col("real").isNull().alias("is_forecast"))
    series = m.groupBy(*KEY).agg(F.collect_list(there).alias("known"), F.bool_or(F.col("b1").isNotNull() | F.col("b2").isNotNull()).alias("has_base"))
    known = F.map_from_entries(F.transform("known", lambda x: F.struct(x["mes"], x)))
    none = F.struct(F.lit(None).cast("int").alias("mes"), F.lit(rules.YELLOW).alias("status"), F.lit(0.0).alias("confidence"), F.lit(True).alias("is_forecast"))
    # A series without a baseline has its observed months only.
    months = F.when(F.col("has_base"), F.sequence(F.lit(1), F.lit(12))).otherwise(F.map_keys("by_month"))
    rows = series.withColumn("by_month", known).select(*KEY, "by_month", F.explode(months).alias("mes")).withColumn("x", F.coalesce(F.try_element_at("by_month", F.col("mes")), none))
    return windows.changes(rows.select(*KEY, "mes", "x.status", "x.confidence", "x.is_forecast"), KEY, "mes", "status", "trend")


_RANK = lambda x: f"CASE {x} WHEN 'VERDE' THEN 0 WHEN 'AMARELO' THEN 1 WHEN 'VERMELHO' THEN 2 ELSE 3 END"
_WEIGHTED = f"""m1 AS ({MODAL.format(f"{YEAR - 3}, {YEAR - 2}")}), m2 AS ({MODAL.format(f"{YEAR - 2}, {YEAR - 1}")}),
w AS (SELECT product, uf, mes, CASE WHEN a.status <> b.status THEN 'AMARELO' ELSE coalesce(b.status, a.status) END AS status, round(CASE WHEN a.status IS NOT NULL AND b.status IS NOT NULL THEN least(a.confidence * 0.6 + b.confidence * 0.4, CASE WHEN a.status = b.status THEN 100 ELSE 40 END) WHEN b.status IS NOT NULL THEN b.confidence ELSE a.confidence * 0.5 END, 4) AS confidence FROM m1 a FULL JOIN m2 b USING (product, uf, mes)),
g AS (SELECT product, uf, CAST(m AS INTEGER) AS mes FROM (SELECT DISTINCT product, uf FROM w), range(1, 13) r(m)),
real AS (SELECT product, uf, mes, status, 100.0::DOUBLE AS confidence, false AS is_forecast FROM live WHERE ano = {YEAR} AND periodo <= {PERIOD}),
u AS (SELECT * FROM real UNION ALL SELECT g.product, g.uf, g.mes, coalesce(w.status, 'AMARELO'), coalesce(w.confidence, 0.0)::DOUBLE, true FROM g LEFT JOIN w USING (product, uf, mes) ANTI JOIN real USING (product, uf, mes)),
l AS (SELECT *, lag(status) OVER (PARTITION BY product, uf ORDER BY mes) AS b FROM u),
forecast AS (SELECT product, uf, mes, status, confidence, is_forecast, CASE WHEN b IS NULL THEN 'ESTAVEL' WHEN {_RANK("status")} > {_RANK("b")} THEN 'ALTA' WHEN {_RANK("status")} < {_RANK("b")} THEN 'QUEDA' ELSE 'ESTAVEL' END AS trend FROM l)"""


@query(f"WITH fact AS FACT, {LIVE}, {_WEIGHTED} SELECT * FROM forecast")
def j7_weighted_forecast(spark, sf_dir):
    return weighted_forecast(seasonality(fact(spark, sf_dir)), YEAR, PERIOD)


def full_load(prices: DataFrame, cap: int, year: int, period: int) -> dict[str, DataFrame]:
    """All tables of a load: quarantine (with the reason), seasonality, forecast and serving rows.

    serving has a row for each series and month of the year: the observed
    price and status, or the forecast's status with the last price known.
    """
    judged = anomalies(prices, cap)
    good = judged.filter("reason is null").select(prices.columns)
    s = seasonality(good)
    forecast = weighted_forecast(s, year, period)
    known = good.filter(F.col("periodo") <= period)
    last = known.groupBy(*KEY).agg(F.max_by("preco_q", "periodo").alias("last_q"))
    own = known.filter(F.col("ano") == year).select(*KEY, "mes", "preco_q")
    serving = forecast.join(own, [*KEY, "mes"], "left").join(last, KEY, "left")
    serving = serving.select(*KEY, "mes", F.coalesce("preco_q", "last_q").alias("preco_q"), "status", "is_forecast", "trend")
    return {"quarantine": judged.filter("reason is not null"), "seasonality": s, "forecast": forecast, "serving": serving}


_KEPT = """raw AS FACT, judged AS (SELECT *, sum(preco_q) OVER (PARTITION BY product, uf) - preco_q AS ot, count(*) OVER (PARTITION BY product, uf) - 1 AS n1, sum(preco_q) OVER (PARTITION BY product) - preco_q AS rest, count(*) OVER (PARTITION BY product) - 1 AS n2 FROM raw),
fact AS (SELECT product, uf, region, ano, mes, periodo, preco_q, obs FROM judged WHERE NOT (n1 > 0 AND preco_q * n1 > ot * 5) AND NOT (preco_q > 18000000 AND NOT (n1 >= 3 AND preco_q * n1 <= ot * 3) AND NOT (n2 >= 3 AND preco_q * n2 <= rest * 3)))"""


@query(f"WITH {_KEPT}, {LIVE}, {_WEIGHTED}, last AS (SELECT product, uf, arg_max(preco_q, periodo) AS last_q FROM fact WHERE periodo <= {PERIOD} GROUP BY ALL), own AS (SELECT product, uf, mes, preco_q FROM fact WHERE ano = {YEAR} AND periodo <= {PERIOD}) SELECT product, uf, mes, coalesce(preco_q, last_q) AS preco_q, status, is_forecast, trend FROM forecast LEFT JOIN own USING (product, uf, mes) LEFT JOIN last USING (product, uf)")
def j43_full_load(spark, sf_dir):
    return full_load(fact(spark, sf_dir), 18_000_000, YEAR, PERIOD)["serving"]


@query(f"WITH fact AS FACT, b AS (SELECT product, uf, CAST(sum(preco_q) AS BIGINT) AS s, count(*) AS n FROM fact WHERE ano = {YEAR - 1} GROUP BY ALL HAVING count(*) >= 6), l AS (SELECT *, lag(preco_q) OVER (PARTITION BY product, uf ORDER BY periodo) AS prev, CAST(sum(preco_q) OVER w AS BIGINT) AS ls, count(*) OVER w AS ln FROM fact WINDOW w AS (PARTITION BY product, uf ORDER BY periodo RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING) QUALIFY row_number() OVER (PARTITION BY product, uf ORDER BY periodo DESC) = 1) SELECT product, uf, CASE WHEN b.n IS NOT NULL THEN 'MEDIA_ANO' WHEN ln >= 3 THEN 'MEDIA_12M' WHEN prev IS NOT NULL THEN 'MOM' ELSE 'INSUFICIENTE' END AS method, CASE WHEN b.n IS NOT NULL THEN CASE WHEN preco_q * b.n * 100 < b.s * 85 THEN 'VERDE' WHEN preco_q * b.n * 100 > b.s * 115 THEN 'VERMELHO' ELSE 'AMARELO' END WHEN ln >= 3 THEN CASE WHEN preco_q * ln * 100 < ls * 85 THEN 'VERDE' WHEN preco_q * ln * 100 > ls * 115 THEN 'VERMELHO' ELSE 'AMARELO' END WHEN prev IS NOT NULL THEN CASE WHEN preco_q * 100 < prev * 90 THEN 'VERDE' WHEN preco_q * 100 > prev * 110 THEN 'VERMELHO' ELSE 'AMARELO' END ELSE 'INSUFICIENTE' END AS status FROM l LEFT JOIN b USING (product, uf)")
def j3_hybrid_cascade(spark, sf_dir):
    """The newest price against the base year's mean (6 months), the twelve months before (3), or the month before."""
    f = fact(spark, sf_dir)
    b = f.filter(F.col("ano") == YEAR - 1).groupBy(*KEY).agg(F.sum("preco_q").alias("s"), F.count("*").alias("k")).filter("k >= 6")
    t = windows.calendar_trailing(windows.trailing(f, KEY, ["periodo"], "preco_q").drop("total", "n"), KEY, "periodo", "preco_q", -12, -1)
    x = windows.top_per_key(t, KEY, [F.desc("periodo")]).join(b, KEY, "left")
    p, year, months, before = F.col("preco_q"), F.col("k").isNotNull(), F.col("n") >= 3, F.col("previous").isNotNull()
    method = F.when(year, "MEDIA_ANO").when(months, "MEDIA_12M").when(before, "MOM").otherwise(rules.UNKNOWN)
    status = F.when(year, rules.mean_band(p, F.col("s"), F.col("k"), 15, 1)).when(months, rules.mean_band(p, F.col("total"), F.col("n"), 15, 1)).otherwise(rules.month_over_month(p, F.col("previous")))
    return x.select(*KEY, method.alias("method"), status.alias("status"))


@query("WITH fact AS FACT, b AS (SELECT product, uf, CAST(sum(preco_q) AS BIGINT) AS s, count(*) AS n FROM fact WHERE preco_q > 0 AND obs > 1 GROUP BY ALL), u AS (SELECT product, uf, arg_max(preco_q, periodo) AS p FROM fact WHERE preco_q > 0 GROUP BY ALL), x AS (SELECT product, uf, p, coalesce(s, p) AS s, coalesce(n, 1) AS n, n AS k FROM u LEFT JOIN b USING (product, uf)) SELECT product, uf, CASE WHEN k > 1 THEN 'alpha_sazonal' WHEN k = 1 THEN 'beta_media_disponivel' ELSE 'gamma_cold_start' END AS method, CASE WHEN p * n * 100 < s * 85 THEN 'VERDE' WHEN p * n * 100 > s * 115 THEN 'VERMELHO' ELSE 'AMARELO' END AS status, (p * n * 20000 + s) // (2 * s) - 10000 AS variation_bp FROM x")
def j4_predictive(spark, sf_dir):
    """The last price against all history: several months, one, or none (curated prices have more than one observation)."""
    f = fact(spark, sf_dir).filter("preco_q > 0")
    b = f.filter("obs > 1").groupBy(*KEY).agg(F.sum("preco_q").alias("s0"), F.count("*").alias("k"))
    x = f.groupBy(*KEY).agg(F.max_by("preco_q", "periodo").alias("p")).join(b, KEY, "left").withColumns({"s": F.coalesce("s0", "p"), "n": F.coalesce("k", F.lit(1))})
    method = F.when(F.col("k") > 1, "alpha_sazonal").when(F.col("k") == 1, "beta_media_disponivel").otherwise("gamma_cold_start")
    return x.select(*KEY, method.alias("method"), rules.mean_band(F.col("p"), F.col("s"), F.col("n"), 15, 1).alias("status"), F.expr("(p * n * 20000 + s) div (2 * s) - 10000").alias("variation_bp"))


#: Months of the base year that make it reliable, and rows that a fallback over twelve months needs.
RELIABLE_MONTHS, FALLBACK_ROWS = 6, 3


def time_series(f: DataFrame, year: int) -> DataFrame:
    """Every price of the base year and later against one reference of its series, with the change to the one before.

    f has product, uf, ano, mes, periodo, preco_q and curated, which counts
    instead of preco_q where there is one.  The reference is the base year's
    mean if the year is reliable, else the mean of the twelve periods up to
    the newest price, else the price itself.
    """
    p = f.withColumn("p", F.coalesce("curated", "preco_q")).filter("p > 0")
    top = Window.partitionBy(*KEY)
    x = p.withColumn("top", F.max("periodo").over(top))
    base, last = F.col("ano") == year, F.col("periodo") > F.col("top") - 12
    one = lambda c: (F.sum(F.when(c, F.col("p"))).over(top), F.count_if(c).over(top))
    (bs, bn), (ls, ln) = one(base), one(last)
    x = x.withColumns({"bs": bs, "bn": bn, "ls": ls, "ln": ln}).filter(F.col("ano") >= year)
    x = x.withColumn("before", F.lag("p").over(Window.partitionBy(*KEY).orderBy("periodo")))
    alpha, beta = F.col("bn") >= RELIABLE_MONTHS, F.col("ln") >= FALLBACK_ROWS
    method = F.when(alpha, "alpha_sazonal").when(beta, "beta_media_disponivel").otherwise("gamma_cold_start")
    x = x.withColumns({"s": F.when(alpha, F.col("bs")).when(beta, F.col("ls")).otherwise(F.col("p")), "n": F.when(alpha, F.col("bn")).when(beta, F.col("ln")).otherwise(F.lit(1))})
    return x.select(*KEY, "periodo", F.col("p").alias("price_q"), method.alias("method"), rules.mean_band(F.col("p"), F.col("s"), F.col("n"), 15, 1).alias("status"), F.expr("(p * n * 20000 + s) div (2 * s) - 10000").alias("variation_bp"), F.expr("(p * 20000 + before) div (2 * before) - 10000").alias("mom_bp"))


#: Curated prices of the query: single observations of every sixth month.
_CURATED = "CASE WHEN obs = 1 AND mes % 6 = 0 THEN preco_q - 100 END"


@query(
    f"""WITH fact AS {FACT.replace("p_brand AS product", "p_name || ' ' || p_brand AS product")}, c AS (SELECT product, uf, ano, periodo, coalesce({_CURATED}, preco_q) AS p FROM fact),
t AS (SELECT product, uf, max(periodo) AS top FROM c WHERE p > 0 GROUP BY ALL),
r AS (SELECT product, uf, CAST(sum(p) FILTER (ano = {YEAR - 1}) AS BIGINT) AS bs, count(*) FILTER (ano = {YEAR - 1}) AS bn, CAST(sum(p) FILTER (periodo > top - 12) AS BIGINT) AS ls, count(*) FILTER (periodo > top - 12) AS ln FROM c JOIN t USING (product, uf) WHERE p > 0 GROUP BY ALL),
x AS (SELECT c.*, lag(p) OVER (PARTITION BY product, uf ORDER BY periodo) AS before, CASE WHEN bn >= {RELIABLE_MONTHS} THEN bs WHEN ln >= {FALLBACK_ROWS} THEN ls ELSE p END AS s, CASE WHEN bn >= {RELIABLE_MONTHS} THEN bn WHEN ln >= {FALLBACK_ROWS} THEN ln ELSE 1 END AS n,
  CASE WHEN bn >= {RELIABLE_MONTHS} THEN 'alpha_sazonal' WHEN ln >= {FALLBACK_ROWS} THEN 'beta_media_disponivel' ELSE 'gamma_cold_start' END AS method FROM c JOIN r USING (product, uf) WHERE p > 0 AND ano >= {YEAR - 1})
SELECT product, uf, periodo, p AS price_q, method, CASE WHEN p * n * 100 < s * 85 THEN 'VERDE' WHEN p * n * 100 > s * 115 THEN 'VERMELHO' ELSE 'AMARELO' END AS status, (p * n * 20000 + s) // (2 * s) - 10000 AS variation_bp, (p * 20000 + before) // (2 * before) - 10000 AS mom_bp FROM x"""
)
def j4_time_series(spark, sf_dir):
    return time_series(fact(spark, sf_dir, "p_name || ' ' || p_brand").withColumn("curated", F.expr(_CURATED)), YEAR - 1)


@query(f"WITH fact AS FACT, b AS (SELECT product, uf, mes, CAST(sum(preco_q) AS BIGINT) AS s, count(*) AS n FROM fact WHERE ano IN ({YEAR - 2}, {YEAR - 1}) GROUP BY ALL), c AS (SELECT product, uf, mes, preco_q, prev FROM (SELECT *, lag(preco_q) OVER (PARTITION BY product, uf ORDER BY periodo) AS prev FROM fact) WHERE ano = {YEAR} AND periodo <= {PERIOD}) SELECT product, uf, mes, CASE WHEN preco_q IS NULL THEN 'BASELINE' WHEN n IS NULL THEN 'SEM_BASE' ELSE 'REAL' END AS kind, CASE WHEN preco_q IS NULL THEN 'AMARELO' WHEN n IS NULL THEN 'INSUFICIENTE' WHEN preco_q * n * 100 < s * 85 THEN 'VERDE' WHEN preco_q * n * 100 > s * 115 THEN 'VERMELHO' ELSE 'AMARELO' END AS status, (preco_q * 20000 + prev) // (2 * prev) - 10000 AS mom_bp FROM b FULL JOIN c USING (product, uf, mes)")
def j5_two_year_baseline(spark, sf_dir):
    """Each calendar month's price against the mean of that month in two years, with the change to the month before."""
    f = fact(spark, sf_dir)
    b = f.filter(F.col("ano").isin(YEAR - 2, YEAR - 1)).groupBy(*KEY, "mes").agg(F.sum("preco_q").alias("s"), F.count("*").alias("k"))
    c = windows.trailing(f, KEY, ["periodo"], "preco_q").filter((F.col("ano") == YEAR) & (F.col("periodo") <= PERIOD)).select(*KEY, "mes", "preco_q", "previous")
    x = b.join(c, [*KEY, "mes"], "full")
    kind = F.when(F.col("preco_q").isNull(), "BASELINE").when(F.col("k").isNull(), "SEM_BASE").otherwise("REAL")
    status = F.when(F.col("preco_q").isNull(), rules.YELLOW).otherwise(rules.mean_band(F.col("preco_q"), F.col("s"), F.coalesce("k", F.lit(0)), 15, 1))
    return x.select(*KEY, "mes", kind.alias("kind"), status.alias("status"), F.expr("(preco_q * 20000 + previous) div (2 * previous) - 10000").alias("mom_bp"))


#: Months of a calendar that make a product's shape reliable, under which it is sparse, and what a proxy keeps of the confidence.
SHAPE_MONTHS, SPARSE_MONTHS, PENALTY = 8, 6, 0.7


def cold_start_proxies(base: DataFrame, places: DataFrame) -> DataFrame:
    """Rows (product, uf, mes, status, confidence) for the missing months of sparse products, from the shape of products with their root word.

    A shape is, of each month, the most frequent status (ties: the smallest)
    and the mean confidence of all products with that root, if it has enough
    months.  places names the states of each product.
    """
    word = base.withColumn("root", _first_word("product"))
    sure = word.groupBy("root", "mes").agg((F.sum(F.round(F.col("confidence") * 10000).cast("long")) / F.count("*") / F.lit(10000.0)).alias("sure"))
    shape = stats.mode_share(word, ["root", "mes"], "status").select("root", "mes", "status").join(sure, ["root", "mes"])
    solid = shape.groupBy("root").agg(F.count("*").alias("months")).filter(F.col("months") >= SHAPE_MONTHS).select("root")
    sparse = base.groupBy("product").agg(F.count_distinct("mes").alias("months")).filter(F.col("months") < SPARSE_MONTHS).select("product", _first_word("product").alias("root"))
    wanted = tables.without(sparse.join(shape.join(solid, "root", "left_semi"), "root"), base, ["product", "mes"])
    return wanted.join(places.select("product", "uf").distinct(), "product").select(*KEY, "mes", "status", (F.col("sure") * PENALTY).alias("confidence"))


@query(
    f"""WITH raw AS {FACT.replace("p_brand", "p_name")}, fact AS (SELECT * FROM raw WHERE product NOT LIKE '{NEW}' OR mes <= 4), {LIVE}, b AS ({MODAL.format("1999, 2000")}),
k AS (SELECT split_part(product, ' ', 1) AS root, mes, status, count(*) AS k FROM b GROUP BY ALL), top AS (SELECT root, mes, status FROM k QUALIFY row_number() OVER (PARTITION BY root, mes ORDER BY k DESC, status) = 1),
sure AS (SELECT split_part(product, ' ', 1) AS root, mes, CAST(sum(CAST(round(confidence * 10000) AS BIGINT)) AS DOUBLE) / count(*) / 10000.0 AS sure FROM b GROUP BY ALL),
shape AS (SELECT * FROM top JOIN sure USING (root, mes) WHERE root IN (SELECT root FROM top GROUP BY root HAVING count(*) >= {SHAPE_MONTHS})),
sparse AS (SELECT product, split_part(product, ' ', 1) AS root FROM b GROUP BY ALL HAVING count(DISTINCT mes) < {SPARSE_MONTHS})
SELECT product, uf, mes, status, sure * 0.7::DOUBLE AS confidence FROM sparse JOIN shape USING (root) ANTI JOIN b USING (product, mes) JOIN (SELECT DISTINCT product, uf FROM fact) f USING (product)"""
)
def j15_cold_start_proxy(spark, sf_dir):
    f = fact(spark, sf_dir, "p_name").filter(~F.col("product").like(NEW) | (F.col("mes") <= 4))
    return cold_start_proxies(modal_baseline(seasonality(f), (YEAR - 2, YEAR - 1)), f)


@query(f"WITH fact AS FACT, m AS (SELECT product, uf, mes, CAST(sum(preco_q) AS BIGINT) AS s, count(*) AS n FROM fact WHERE ano BETWEEN {YEAR - 3} AND {YEAR - 1} GROUP BY ALL), g AS (SELECT product, uf, CAST(k AS INTEGER) AS mes FROM (SELECT DISTINCT product, uf FROM fact), range(1, 13) r(k)), x AS (SELECT g.*, s, n FROM g ANTI JOIN (SELECT product, uf, mes FROM fact WHERE ano = {YEAR - 2}) USING (product, uf, mes) JOIN m USING (product, uf, mes)) SELECT product, uf, mes, s // n AS mean_q, (s // n) * (9000 + CAST('0x' || substr(md5(concat_ws('|', product, uf, mes)), 1, 8) AS BIGINT) % 2001) // 10000 AS synthetic_q FROM x")
def j42_backfill(spark, sf_dir):
    """Months a year lacks, from the neighbouring years' mean of that month, and moved by up to 10 % by a hash of the key."""
    f = fact(spark, sf_dir)
    m = f.filter(F.col("ano").between(YEAR - 3, YEAR - 1)).groupBy(*KEY, "mes").agg(F.sum("preco_q").alias("s"), F.count("*").alias("n"))
    gaps = tables.missing(tables.month_grid(f.select(*KEY).distinct()), f.filter(F.col("ano") == YEAR - 2), [*KEY, "mes"])
    x = gaps.join(m, [*KEY, "mes"]).withColumn("mean_q", F.expr("s div n")).withColumn("h", F.conv(F.substring(F.md5(F.concat_ws("|", "product", "uf", "mes")), 1, 8), 16, 10).cast("long"))
    return x.select(*KEY, "mes", "mean_q", F.expr("mean_q * (9000 + h % 2001) div 10000").alias("synthetic_q"))
