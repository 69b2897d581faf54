"""Status rules, anomaly tests and quality gates over the price fact."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrain.functions import period, rules
from tidegrain.operators import stats, windows
from tidegrain.plans.basic import VOLATILITY
from tidegrain.plans.facts import fact, table
from tidegrain.plans.kit import registrar
from tidegrain.plans.window_queries import NAMED, STATUS, TRAILING

QUERIES, SQL, query = registrar()
KEY = ["product", "uf"]
SERIES = f"s AS (SELECT *, {TRAILING} FROM fact {NAMED})"


def _series(spark, sf_dir):
    return windows.trailing(fact(spark, sf_dir), KEY, ["periodo"], "preco_q")


def _band(p, r, pct):
    return f"CASE WHEN {p} * 100 < {r} * {100 - pct} THEN 'VERDE' WHEN {p} * 100 > {r} * {100 + pct} THEN 'VERMELHO' ELSE 'AMARELO' END"


@query(f"WITH fact AS FACT, {SERIES} SELECT product, uf, periodo, {STATUS} AS status FROM s")
def i1_mean_band(spark, sf_dir):
    return _series(spark, sf_dir).select(*KEY, "periodo", rules.mean_band(F.col("preco_q"), F.col("total"), F.col("n")).alias("status"))


@query(f"WITH fact AS FACT, {SERIES} SELECT product, uf, periodo, {_band('preco_q', 'coalesce(previous, preco_q)', 15)} AS s15, {_band('preco_q', 'coalesce(previous, preco_q)', 25)} AS s25 FROM s")
def i2_fixed_bands(spark, sf_dir):
    p, r = F.col("preco_q"), F.col("previous")
    return _series(spark, sf_dir).select(*KEY, "periodo", rules.band(p, r, 15).alias("s15"), rules.band(p, r, 25).alias("s25"))


@query(f"WITH fact AS FACT, {SERIES} SELECT product, uf, periodo, CASE WHEN previous IS NULL OR previous <= 0 THEN 'INSUFICIENTE' ELSE {_band('preco_q', 'previous', 10)} END AS status FROM s")
def i4_month_over_month(spark, sf_dir):
    return _series(spark, sf_dir).select(*KEY, "periodo", rules.month_over_month(F.col("preco_q"), F.col("previous")).alias("status"))


@query(f"WITH fact AS FACT, {VOLATILITY} SELECT f.product, f.uf, f.periodo, CASE WHEN sigma IS NULL OR sigma <= 0 THEN NULL WHEN preco_q < total::DOUBLE / n - sigma THEN 'VERDE' WHEN preco_q > total::DOUBLE / n + sigma THEN 'VERMELHO' ELSE 'AMARELO' END AS status FROM fact f JOIN vol ON vol.product = f.product AND vol.uf = f.uf")
def i5_sigma_band(spark, sf_dir):
    f = fact(spark, sf_dir)
    v = stats.volatility(f, KEY, "preco_q")
    return f.join(v, KEY).select(*KEY, "periodo", rules.sigma_band(F.col("preco_q"), F.col("total") / F.col("n"), F.col("sigma")).alias("status"))


SENSITIVE = "CASE WHEN w > 0.40 THEN 'AMARELO' WHEN p < r * (1 - w) THEN 'VERDE' WHEN p > r * (1 + w) THEN 'VERMELHO' ELSE 'AMARELO' END"


@query(
    f"""WITH fact AS FACT, {SERIES}, {VOLATILITY}, x AS (SELECT s.product, s.uf, s.periodo, s.preco_q / 10000.0::DOUBLE AS p, s.total / s.n::DOUBLE / 10000.0::DOUBLE AS r, vol.cv FROM s JOIN vol ON vol.product = s.product AND vol.uf = s.uf),
y AS (SELECT *, greatest(coalesce(cv, 0), CASE WHEN r <= 5 THEN 0.02 WHEN r <= 20 THEN 0.05 ELSE 0.08 END::DOUBLE) AS w FROM x)
SELECT product, uf, periodo, {SENSITIVE} AS status FROM y"""
)
def i6_sensitive_band(spark, sf_dir):
    s = _series(spark, sf_dir)
    v = stats.volatility(fact(spark, sf_dir), KEY, "preco_q").select(*KEY, "cv")
    price, ref = F.col("preco_q") / F.lit(10000.0), F.col("total") / F.col("n") / F.lit(10000.0)
    return s.join(v, KEY).select(*KEY, "periodo", rules.sensitive(price, ref, F.col("cv")).alias("status"))


@query(
    """WITH fact AS FACT, g AS (SELECT product, uf, count(*) AS n, CAST(sum(preco_q) AS DOUBLE) / count(*) AS m, round(stddev_samp(preco_q::DOUBLE), 6) AS s, arg_max(preco_q, periodo) AS p FROM fact GROUP BY ALL)
SELECT product, uf, CASE WHEN n < 2 THEN 'INSUFICIENTE' WHEN coalesce(s, 0) = 0 THEN CASE WHEN p < m THEN 'OFERTA' WHEN p > m THEN 'ALTA' ELSE 'EQUILIBRADO' END WHEN (p - m) / s <= -1 THEN 'OFERTA' WHEN (p - m) / s >= 1 THEN 'ALTA' ELSE 'EQUILIBRADO' END AS offer FROM g"""
)
def i7_offer(spark, sf_dir):
    g = fact(spark, sf_dir).groupBy(*KEY).agg(F.count("*").alias("n"), (F.sum("preco_q") / F.count("*")).alias("m"), F.round(F.stddev_samp(F.col("preco_q").cast("double")), 6).alias("s"), F.max_by("preco_q", "periodo").alias("p"))
    return g.select(*KEY, rules.offer(F.col("p"), F.col("m"), F.col("s"), F.col("n")).alias("offer"))


@query("WITH fact AS FACT, a AS (SELECT product, uf, mes, CAST(sum(preco_q) AS BIGINT) AS s, count(*) AS n FROM fact GROUP BY ALL), y AS (SELECT product, uf, CAST(sum(s) AS BIGINT) AS ts, CAST(sum(n) AS BIGINT) AS tn FROM a GROUP BY ALL) SELECT a.product, a.uf, a.mes, CASE WHEN s * tn * 100 < ts * n * 90 THEN 'VERDE' WHEN s * tn * 100 > ts * n * 110 THEN 'VERMELHO' ELSE 'AMARELO' END AS status FROM a JOIN y ON y.product = a.product AND y.uf = a.uf")
def i8_month_against_year(spark, sf_dir):
    a = fact(spark, sf_dir).groupBy(*KEY, "mes").agg(F.sum("preco_q").alias("s"), F.count("*").alias("n"))
    y = a.groupBy(*KEY).agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    return a.join(y, KEY).select(*KEY, "mes", rules.band(F.col("s") * F.col("tn"), F.col("ts") * F.col("n"), 10).alias("status"))


@query(f"WITH fact AS FACT, {SERIES} SELECT product, uf, periodo, CASE WHEN previous IS NULL OR previous <= 0 THEN 'AMARELO' WHEN preco_q * 100 < previous * 75 THEN 'VERDE' WHEN preco_q * 100 > previous * 130 THEN 'VERMELHO' ELSE 'AMARELO' END AS status FROM s")
def i9_cold_start(spark, sf_dir):
    return _series(spark, sf_dir).select(*KEY, "periodo", rules.cold_start(F.col("preco_q"), F.col("previous")).alias("status"))


def anomalies(df, cap):
    """Reason to reject a price, null if there is none.

    Over 5 times the mean of the state's other months; or over cap without
    three other observations of the state or of all states within 3 times.
    """
    df = stats.leave_out(df, ["product", "uf"], ["periodo"], "preco_q", "own")
    df = stats.leave_out(df, ["product"], ["uf", "periodo"], "preco_q", "all")
    p = F.col("preco_q")
    over = lambda side, k: (F.col(f"{side}_n") > 0) & (p * F.col(f"{side}_n") > F.col(f"{side}_total") * k)
    solid = lambda side: (F.col(f"{side}_n") >= 3) & ~over(side, 3)
    reason = F.when(over("own", 5), "EXCEDE_500PCT_MEDIA_UF").when((p > cap) & ~solid("own") & ~solid("all"), "HARD_CAP_SEM_HISTORICO")
    return df.withColumn("reason", reason)


@query(
    """WITH fact AS FACT, u AS (SELECT *, sum(preco_q) OVER (PARTITION BY product, uf) - preco_q AS ot, count(*) OVER (PARTITION BY product, uf) - 1 AS n1, sum(preco_q) OVER (PARTITION BY product) - preco_q AS rest, count(*) OVER (PARTITION BY product) - 1 AS n2 FROM fact)
SELECT product, uf, periodo, CASE WHEN n1 > 0 AND preco_q * n1 > ot * 5 THEN 'EXCEDE_500PCT_MEDIA_UF' WHEN preco_q > 18000000 AND NOT (n1 >= 3 AND preco_q * n1 <= ot * 3) AND NOT (n2 >= 3 AND preco_q * n2 <= rest * 3) THEN 'HARD_CAP_SEM_HISTORICO' END AS reason FROM u"""
)
def i10_anomalies(spark, sf_dir):
    return anomalies(fact(spark, sf_dir), 18_000_000).select(*KEY, "periodo", "reason")


YEARLY = "y AS (SELECT product, uf, ano, CASE WHEN count(*) < 6 THEN NULL WHEN max(preco_q) * 100 > min(preco_q) * 200 THEN 'VERMELHO' ELSE 'VERDE' END AS status, CAST(count(*) * 8 AS DOUBLE) AS c FROM fact GROUP BY ALL), a AS (SELECT * FROM y WHERE ano = 1999), b AS (SELECT * FROM y WHERE ano = 2000)"


@query(
    f"""WITH fact AS FACT, {YEARLY}, j AS (SELECT coalesce(a.product, b.product) AS product, coalesce(a.uf, b.uf) AS uf, a.status AS s1, b.status AS s2, a.c AS c1, b.c AS c2 FROM a FULL JOIN b ON a.product = b.product AND a.uf = b.uf)
SELECT product, uf, CASE WHEN s1 IS NOT NULL AND s2 IS NOT NULL AND s1 <> s2 THEN 'AMARELO' ELSE coalesce(s2, s1) END AS status, round(CASE WHEN s1 IS NOT NULL AND s2 IS NOT NULL THEN least(c1 * 0.6 + c2 * 0.4, CASE WHEN s1 = s2 THEN 100 ELSE 40 END) WHEN s2 IS NOT NULL THEN c2 WHEN s1 IS NOT NULL THEN c1 * 0.5 END, 4) AS confidence FROM j"""
)
def i12_agreement(spark, sf_dir):
    y = fact(spark, sf_dir).groupBy(*KEY, "ano").agg(F.when(F.count("*") < 6, F.lit(None)).when(F.max("preco_q") * 100 > F.min("preco_q") * 200, "VERMELHO").otherwise("VERDE").alias("s"), (F.count("*") * 8).cast("double").alias("c"))
    one = lambda k, i: y.filter(F.col("ano") == k).select(*KEY, F.col("s").alias(f"s{i}"), F.col("c").alias(f"c{i}"))
    j = one(1999, 1).join(one(2000, 2), KEY, "full")
    s1, c1, s2, c2 = (F.col(x) for x in ("s1", "c1", "s2", "c2"))
    return j.select(*KEY, rules.agreement(s1, s2).alias("status"), F.round(rules.agreement_confidence(s1, c1, s2, c2), 4).alias("confidence"))


@query("WITH fact AS FACT, c AS (SELECT product, uf, count(DISTINCT mes) AS months FROM fact WHERE ano = 2001 GROUP BY ALL) SELECT product, uf, months, CASE WHEN months >= 12 THEN 'COMPLETO' WHEN months >= 9 THEN 'PARCIAL' WHEN months >= 6 THEN 'CRÍTICO' ELSE 'GRAVE' END AS grade, CASE WHEN months <= 2 THEN 'GRAVE' WHEN months <= 6 THEN 'MEDIO' ELSE 'OK' END AS gap FROM c")
def i13_coverage_grade(spark, sf_dir):
    c = fact(spark, sf_dir).filter("ano = 2001").groupBy(*KEY).agg(F.count_distinct("mes").alias("months"))
    return c.select(*KEY, "months", rules.coverage_grade(F.col("months")).alias("grade"), rules.gap_severity(F.col("months")).alias("gap"))


@query(f"WITH fact AS FACT, {SERIES}, c AS (SELECT *, count(*) OVER (PARTITION BY product, uf) AS k FROM s) SELECT product, uf, periodo, CASE WHEN k < 24 OR previous IS NULL THEN NULL WHEN preco_q * 100 < previous * 95 THEN 'QUEDA' WHEN preco_q * 100 > previous * 105 THEN 'ALTA' ELSE 'ESTAVEL' END AS trend FROM c")
def i15_trend(spark, sf_dir):
    k = fact(spark, sf_dir).groupBy(*KEY).agg(F.count("*").alias("k"))
    return _series(spark, sf_dir).join(k, KEY).select(*KEY, "periodo", rules.trend(F.col("preco_q"), F.col("previous"), F.col("k")).alias("trend"))


@query("SELECT rule, CAST(n AS BIGINT) AS n FROM (WITH fact AS FACT SELECT 'month' AS rule, count(*) FILTER (WHERE mes NOT BETWEEN 1 AND 12) AS n FROM fact UNION ALL SELECT 'price', count(*) FILTER (WHERE preco_q <= 0) FROM fact UNION ALL SELECT 'unique', (SELECT count(*) FROM (SELECT product, uf, periodo FROM fact GROUP BY ALL HAVING count(*) > 1)) UNION ALL SELECT 'orphan', (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)))")
def n1_violations(spark, sf_dir):
    f = fact(spark, sf_dir)
    checks = f.agg(F.count_if(~F.col("mes").between(1, 12)).alias("month"), F.count_if(F.col("preco_q") <= 0).alias("price"))
    twice = f.groupBy(*KEY, "periodo").count().filter("count > 1").agg(F.count("*").alias("n")).select(F.lit("unique").alias("rule"), "n")
    orphans = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").agg(F.count("*").alias("n")).select(F.lit("orphan").alias("rule"), "n")
    return checks.unpivot([], ["month", "price"], "rule", "n").union(twice).union(orphans)


@query("WITH fact AS FACT SELECT product, uf, periodo, ano, CAST(CASE WHEN obs % 7 = 0 THEN mes % 12 + 1 ELSE mes END AS INTEGER) AS mes FROM fact WHERE obs % 7 = 0")
def n4_period_coherence(spark, sf_dir):
    """Rows whose written period is not their year and month (every seventh number of observations has the month after)."""
    f = fact(spark, sf_dir).withColumn("p", period.text(F.col("ano"), F.col("mes")))
    f = f.withColumn("mes", F.when(F.col("obs") % 7 == 0, F.col("mes") % 12 + 1).otherwise(F.col("mes")))
    return f.filter(~period.coherent(F.col("p"), F.col("ano"), F.col("mes"))).select(*KEY, "periodo", "ano", "mes")


@query("WITH fact AS FACT, g AS (SELECT product, uf, count(DISTINCT mes) AS months, max(periodo) - min(periodo) + 1 - count(*) AS gaps FROM fact GROUP BY ALL) SELECT product, uf, months = 12 AS dense, gaps = 0 AS gapless FROM g")
def n7_series_validator(spark, sf_dir):
    g = fact(spark, sf_dir).groupBy(*KEY).agg(F.count_distinct("mes").alias("months"), (F.max("periodo") - F.min("periodo") + 1 - F.count("*")).alias("gaps"))
    return g.select(*KEY, (F.col("months") == 12).alias("dense"), (F.col("gaps") == 0).alias("gapless"))


