"""What users are shown: serving rows with their provenance, requests and their answers, partial refreshes, the load from raw files, the change log."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrain.functions import objects, period, rules
from tidegrain.operators import stats, tables, windows
from tidegrain.plans.composite import KEY, LIVE, MODAL, MONTH, PERIOD, YEAR, modal_baseline, seasonality
from tidegrain.plans.facts import fact, table
from tidegrain.plans.forecasts import _KEPT, _WEIGHTED, weighted_forecast
from tidegrain.plans.kit import registrar
from tidegrain.plans.loads import negated
from tidegrain.plans.rules_queries import SENSITIVE, anomalies
from tidegrain.sources import files, folders, versions
from tidegrain.sources.answers import Answers
from tidegrain.sources.steps import Steps
from tidegrain.streaming import ingest

QUERIES, SQL, query = registrar()

# Kinds, sources and messages of the data model.
REAL, PAST, DIMENSION = "REAL_ATUAL", "HISTORICO_BASE", "FALLBACK_DIMENSAO"
PROXY_SOURCE = "FLUXO_PROXY"
BY_HISTORY, BY_BASELINE = "Projecao sazonal baseada no historico de ", "Projecao sazonal sem historico real (baseline de dimensao)"
#: Ids of derived rows: shown ones are negated, those of dimensions are that much lower still.
SHIFT = 1_000_000_000


def mart(f: DataFrame, source: Column, identity: Column, year: int) -> DataFrame:
    """Seasonality rows with id, fonte, kind and their own provenance."""
    own = seasonality(f).withColumns({"id": identity.cast("long"), "fonte": source, "kind": F.when(F.col("ano") == year, REAL).otherwise(PAST)})
    return own.withColumn("made", objects.fields(fonte_dado=F.col("fonte"), procedencia=F.col("kind"), data_referencia=period.text(F.col("ano"), F.col("mes"))))


def anchors(m: DataFrame, year: int) -> DataFrame:
    """The newest row of each series and month in three years, its age, the mean of the twelve months before, and a status by that; rows without one are no anchor."""
    real = m.filter(F.col("fonte") != PROXY_SOURCE)
    ref = stats.with_volatility(windows.calendar_trailing(real.drop("total", "n", "previous", "cv", "contaminated", "deviation", "status"), KEY, "periodo", "preco_q", -12, -1), KEY, "preco_q")
    best = windows.top_per_key(ref.filter(F.col("ano").between(year - 2, year)), [*KEY, "mes"], [F.desc("ano")])
    mean = F.col("total") / F.col("n") / F.lit(10000.0)
    status = F.when(F.col("n") >= 6, rules.sensitive(F.col("preco_q") / F.lit(10000.0), mean, F.col("cv")))
    made = objects.fields(fonte_dado=F.lit("ANCORA"), procedencia=F.col("kind"), data_referencia=period.text(F.col("ano"), F.col("mes")))
    return best.select("id", *KEY, "mes", "ano", "preco_q", mean.alias("reference"), status.alias("status"), "kind", (F.lit(year) - F.col("ano")).alias("age"), made.alias("made")).filter("status is not null")


SHOWN = ("id", *KEY, "ano", "mes", "preco_q", "reference", "status", "kind", "reference_year", "age", "made", "message")


def serving_rows(m: DataFrame, year: int, month: int) -> DataFrame:
    """The rows of the serving view: id, place in time, price and status shown, and where they come from.

    Real rows show their month's anchor if there is one.  Anchors of earlier
    years stand for the year's own months, under negated ids.  Series and
    months without an anchor show their newest row, a real one before a proxy,
    under ids below the negated ones; from the as-of month on their status is
    that of last year's real row, else the two years' most frequent one, else
    yellow.  Only products with all twelve months in one of the two years
    before are shown.
    """
    full = m.filter(F.col("ano").isin(year - 2, year - 1)).groupBy("product", "ano").agg(F.count_distinct("mes").alias("k")).filter("k = 12").select("product").distinct()
    m = m.join(full, "product", "left_semi").filter(F.col("status").isin(*rules.STATUSES))
    a = anchors(m, year)
    real = m.filter(F.col("fonte") != PROXY_SOURCE)
    null = lambda t: F.lit(None).cast(t)

    of = a.select(*KEY, "mes", *[F.col(c).alias(f"a_{c}") for c in ("ano", "preco_q", "reference", "status", "kind", "age", "made")])
    one = real.join(of, [*KEY, "mes"], "left")
    or_own = lambda c, own: F.coalesce(f"a_{c}", own)
    mean = F.col("total") / F.col("n") / F.lit(10000.0)
    first = one.select("id", *KEY, "ano", "mes", or_own("preco_q", F.col("preco_q")).alias("preco_q"), or_own("reference", mean).alias("reference"), or_own("status", F.col("status")).alias("status"), or_own("kind", F.col("kind")).alias("kind"), or_own("ano", F.col("ano")).alias("reference_year"), or_own("age", F.lit(year) - F.col("ano")).alias("age"), or_own("made", F.col("made")).alias("made"), null("string").alias("message"))

    second = negated(a.filter(F.col("ano") < year), "id").select("id", *KEY, F.lit(year).alias("ano"), "mes", "preco_q", "reference", "status", "kind", F.col("ano").alias("reference_year"), "age", "made", null("string").alias("message"))

    rest = tables.without(m, a, [*KEY, "mes"])
    newest = negated(windows.top_per_key(rest, [*KEY, "mes"], [(F.col("fonte") == PROXY_SOURCE).asc(), F.desc("periodo")]), "id")
    word = F.when(F.col("fonte") == PROXY_SOURCE, "sem_historico_real_uso_proxy").otherwise("sem_historico_real")
    made = objects.fields(fonte_dado=F.col("fonte"), procedencia=word, data_referencia=period.text(F.col("ano"), F.col("mes")))
    before = real.filter(F.col("ano") == year - 1).select(*KEY, "mes", F.col("status").alias("last_status"), F.col("ano").alias("last_year"))
    base = modal_baseline(real, (year - 2, year - 1)).select(*KEY, "mes", F.col("status").alias("base"))
    deep = newest.withColumn("made", made).join(before, [*KEY, "mes"], "left").join(base, [*KEY, "mes"], "left")
    ahead = F.col("mes") >= month
    message = F.when(F.col("last_year").isNotNull(), F.concat(F.lit(BY_HISTORY), F.col("last_year").cast("string"))).otherwise(BY_BASELINE)
    over = objects.fields(fonte_dado=F.lit("PROJECAO_HISTORICA"), procedencia=F.lit("DEEP_FALLBACK"), ano_referencia=F.col("last_year"), mensagem_transparencia=message)
    third = deep.select(
        (F.col("id") - SHIFT).alias("id"), *KEY, F.lit(year).alias("ano"), "mes", F.nullif("preco_q", F.lit(0)).alias("preco_q"), null("double").alias("reference"),
        F.when(ahead, F.coalesce("last_status", "base", F.lit(rules.YELLOW))).otherwise(F.col("status")).alias("status"), F.lit(DIMENSION).alias("kind"), F.when(ahead, F.col("last_year")).alias("reference_year"), null("int").alias("age"),
        F.when(ahead, objects.merged(F.col("made"), over)).otherwise(F.col("made")).alias("made"), F.when(ahead, message).alias("message"),
    )
    return first.select(*SHOWN).unionByName(second.select(*SHOWN)).unionByName(third.select(*SHOWN))


#: Rule of the queries: single old observations of some months count as proxies; ids come from the numbers in the names.
_SOURCE = f"CASE WHEN obs = 1 AND ano < {YEAR - 2} AND mes % 5 = 0 THEN '{PROXY_SOURCE}' ELSE 'MENSAL' END"
_ID = "CAST(split_part(product, '#', 2) AS BIGINT) * 100000 + CAST(split_part(uf, '_', 2) AS BIGINT) * 1000 + periodo - 23880"
_AT = "CAST({0}ano AS VARCHAR) || '-' || lpad(CAST({0}mes AS VARCHAR), 2, '0')"
_MADE = """'{{"data_referencia":"' || {0} || '","fonte_dado":"' || {1} || '","procedencia":"' || {2} || '"}}'"""

#: The anchors of real rows: spread of each series, mean of the twelve months before each row, newest row of each month.
_ANCHORS = f"""aq AS (SELECT product, uf, quantile_cont(preco_q, 0.25) AS q1, quantile_cont(preco_q, 0.5) AS md, quantile_cont(preco_q, 0.75) AS q3 FROM real GROUP BY ALL),
av AS (SELECT product, uf, round(stddev_samp(preco_q::DOUBLE), 6) AS sigma, CAST(sum(preco_q) AS BIGINT)::DOUBLE / count(*) AS mean FROM real JOIN aq USING (product, uf) WHERE preco_q BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AND preco_q >= 0.25 * md GROUP BY ALL),
aref AS (SELECT x.product, x.uf, x.mes, x.ano, x.periodo, x.preco_q, count(t.preco_q) AS n, CAST(sum(t.preco_q) AS BIGINT) AS total FROM real x LEFT JOIN real t ON x.product = t.product AND x.uf = t.uf AND t.periodo BETWEEN x.periodo - 12 AND x.periodo - 1 GROUP BY ALL),
abest AS (SELECT * FROM aref WHERE ano BETWEEN {YEAR - 2} AND {YEAR} QUALIFY row_number() OVER (PARTITION BY product, uf, mes ORDER BY ano DESC) = 1),
az AS (SELECT abest.*, preco_q / 10000.0::DOUBLE AS p, total / nullif(n, 0)::DOUBLE / 10000.0::DOUBLE AS r, round(sigma / mean, 6) AS cv FROM abest LEFT JOIN av USING (product, uf)),
azz AS (SELECT *, greatest(coalesce(cv, 0), CASE WHEN r <= 5 THEN 0.02 WHEN r <= 20 THEN 0.05 ELSE 0.08 END::DOUBLE) AS w FROM az)"""

_ROWS = f"""WITH raw AS FACT, full_ AS (SELECT DISTINCT product FROM (SELECT product, ano FROM raw WHERE ano IN ({YEAR - 2}, {YEAR - 1}) GROUP BY ALL HAVING count(DISTINCT mes) = 12)),
fact AS (SELECT * FROM raw), {LIVE},
mart AS (SELECT y.product, y.uf, y.ano, y.mes, y.periodo, y.preco_q, r, CASE WHEN n < 6 OR coalesce(bad, false) THEN 'AMARELO' ELSE {SENSITIVE} END AS status, {_SOURCE} AS fonte, {_ID} AS id,
  CASE WHEN ano = {YEAR} THEN '{REAL}' ELSE '{PAST}' END AS kind FROM y WHERE product IN (SELECT product FROM full_)),
real AS (SELECT * FROM mart WHERE fonte <> '{PROXY_SOURCE}'), {_ANCHORS},
a AS (SELECT product, uf, mes, ano, preco_q, r AS reference, {YEAR} - ano AS age, CASE WHEN ano = {YEAR} THEN '{REAL}' ELSE '{PAST}' END AS kind, CASE WHEN n >= 6 THEN {SENSITIVE} END AS status, {_ID} AS id,
  {_MADE.format(_AT.format(""), "'ANCORA'", f"CASE WHEN ano = {YEAR} THEN '{REAL}' ELSE '{PAST}' END")} AS made FROM azz WHERE n >= 6),
base AS ({MODAL.format(f"{YEAR - 2}, {YEAR - 1}").replace("FROM live", "FROM real")}),
rest AS (SELECT * FROM mart ANTI JOIN a USING (product, uf, mes) QUALIFY row_number() OVER (PARTITION BY product, uf, mes ORDER BY (fonte = '{PROXY_SOURCE}'), periodo DESC) = 1),
deep AS (SELECT rest.*, h.status AS hs, h.ano AS hy, base.status AS bs, {_MADE.format(_AT.format("rest."), "rest.fonte", f"CASE WHEN rest.fonte = '{PROXY_SOURCE}' THEN 'sem_historico_real_uso_proxy' ELSE 'sem_historico_real' END")} AS made,
  CASE WHEN h.ano IS NOT NULL THEN '{BY_HISTORY}' || CAST(h.ano AS VARCHAR) ELSE '{BY_BASELINE}' END AS msg, {_AT.format("rest.")} AS ym
  FROM rest LEFT JOIN real h ON h.product = rest.product AND h.uf = rest.uf AND h.mes = rest.mes AND h.ano = {YEAR - 1} LEFT JOIN base ON base.product = rest.product AND base.uf = rest.uf AND base.mes = rest.mes),
shown AS (
SELECT s.id, s.product, s.uf, s.ano, s.mes, coalesce(a.preco_q, s.preco_q) AS preco_q, coalesce(a.reference, s.r) AS reference, coalesce(a.status, s.status) AS status, coalesce(a.kind, s.kind) AS kind, coalesce(a.ano, s.ano) AS reference_year, coalesce(a.age, {YEAR} - s.ano) AS age,
  coalesce(a.made, {_MADE.format(_AT.format("s."), "s.fonte", "s.kind")}) AS made, NULL AS message FROM real s LEFT JOIN a ON a.product = s.product AND a.uf = s.uf AND a.mes = s.mes
UNION ALL SELECT -id, product, uf, {YEAR}, mes, preco_q, reference, status, kind, ano, age, made, NULL FROM a WHERE ano < {YEAR}
UNION ALL SELECT -id - {SHIFT}, product, uf, {YEAR}, mes, nullif(preco_q, 0), NULL, CASE WHEN mes >= {MONTH} THEN coalesce(hs, bs, 'AMARELO') ELSE status END, '{DIMENSION}', CASE WHEN mes >= {MONTH} THEN hy END, NULL,
  CASE WHEN mes >= {MONTH} THEN '{{"ano_referencia":' || coalesce('"' || CAST(hy AS VARCHAR) || '"', 'null') || ',"data_referencia":"' || ym || '","fonte_dado":"PROJECAO_HISTORICA","mensagem_transparencia":"' || msg || '","procedencia":"DEEP_FALLBACK"}}' ELSE made END,
  CASE WHEN mes >= {MONTH} THEN msg END FROM deep)"""


def _mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folders.stored(mart(fact(spark, sf_dir), F.expr(_SOURCE), F.expr(_ID), YEAR).drop("region", "obs"))


@query(f"{_ROWS} SELECT * FROM shown")
def j18_serving_rows(spark, sf_dir):
    m = _mart(spark, sf_dir)
    return serving_rows(m, YEAR, MONTH).withColumn("made", objects.as_json(F.col("made")))


@query(f"{_ROWS} SELECT CASE WHEN reference_year IS NOT NULL THEN 'historico' WHEN status = 'AMARELO' THEN 'neutro' ELSE 'baseline' END AS source, status, uf, count(*) AS n FROM shown WHERE kind = '{DIMENSION}' AND mes >= {MONTH} GROUP BY ALL")
def j20_deep_fallback(spark, sf_dir):
    """Of the months to come without an anchor: where their status is from, by state."""
    rows = serving_rows(_mart(spark, sf_dir), YEAR, MONTH).filter((F.col("kind") == DIMENSION) & (F.col("mes") >= MONTH))
    source = F.when(F.col("reference_year").isNotNull(), "historico").when(F.col("status") == rules.YELLOW, "neutro").otherwise("baseline")
    return rows.groupBy(source.alias("source"), "status", "uf").agg(F.count("*").alias("n"))


def answer(s: DataFrame, regions: DataFrame, request: dict[str, Any], least_ufs: int = 5) -> DataFrame:
    """Rows (product, place, periodo, price, status, ufs) of a request for a region, the country, a month or the newest rows.

    s is seasonality()'s result; regions has region and ufs, how many states
    it has.  With a region or uf "BR" states are merged: a region shows
    products of at least three quarters of its states (two), the most frequent
    status and the mean price; the country shows products of least_ufs states
    by quorum.  Else rows are those of the month (year and month), or of each
    series' newest period, filtered by uf, product (a part of it) and status.
    """
    region, uf, year, month = (request.get(k) for k in ("region", "uf", "year", "month"))
    by_month = year is not None and month is not None
    country = region is None and (uf or "").upper() == "BR"
    rows = s.filter(F.col("periodo") == year * 12 + month) if by_month else s
    if region is not None:
        rows = rows.filter(F.col("region") == region)
    elif uf and not country:
        rows = rows.filter(F.col("uf") == uf.upper())
    if not (region is not None or country):
        rows = tables.contains(rows, "product", request.get("product"))
    latest = rows if by_month else windows.top_per_key(rows, KEY, [F.desc("periodo")])
    price = (F.sum("preco_q") / F.count("*") / 10000.0).alias("price")
    if region is not None:
        g = latest.groupBy("region", "product").agg(F.max("periodo").alias("periodo"), price, F.mode("status", deterministic=True).alias("status"), F.count_distinct("uf").alias("n"))
        least = F.greatest(F.lit(2), F.ceil(F.col("ufs") * 3 / 4))
        return g.join(F.broadcast(regions), "region").filter(F.col("n") >= least).select("product", F.col("region").alias("place"), "periodo", "price", "status", F.col("n").alias("ufs"))
    if country:
        votes = [F.count_if(F.col("status") == x).alias(x) for x in (rules.RED, rules.GREEN)]
        g = latest.groupBy("product").agg(F.max("periodo").alias("periodo"), price, F.count_distinct("uf").alias("ufs"), *votes).filter(F.col("ufs") >= least_ufs)
        return g.select("product", F.lit("BR").alias("place"), "periodo", "price", rules.quorum(F.col(rules.RED), F.col(rules.GREEN), F.col("ufs")).alias("status"), "ufs")
    return tables.filtered(latest, status=request.get("status")).select("product", F.col("uf").alias("place"), "periodo", (F.col("preco_q") / F.lit(10000.0)).alias("price"), "status", F.lit(1).cast("long").alias("ufs"))


#: Requests of the query: a region by month and newest, the country likewise, a month with filters, newest rows with filters.
REQUESTS = (
    {"region": "ASIA", "year": YEAR, "month": 3}, {"region": "EUROPE"}, {"uf": "br", "year": YEAR, "month": 4}, {"uf": "BR"},
    {"year": YEAR, "month": 5, "status": "VERDE"}, {"uf": "nation_1", "product": "brand#1"}, {"region": "NOWHERE"},
)
PAGE = 10
_MERGED = "max(periodo) AS periodo, CAST(sum(preco_q) AS DOUBLE) / count(*) / 10000.0 AS price"
_NEWEST = "(SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY product, uf ORDER BY periodo DESC) = 1)"
_OF_REGION = "SELECT product, region AS place, " + _MERGED + ", mode(status ORDER BY status) AS status, count(DISTINCT uf) AS ufs FROM {rows} JOIN (SELECT r_name AS region, greatest(2, ceil(count(*) * 3 / 4)) AS least FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY ALL) USING (region) WHERE region = '{region}' GROUP BY product, region, least HAVING count(DISTINCT uf) >= least"
_OF_COUNTRY = "SELECT product, 'BR' AS place, " + _MERGED + ", CASE WHEN count(*) FILTER (status = 'VERMELHO') * 100 >= count(DISTINCT uf) * 40 THEN 'VERMELHO' WHEN count(*) FILTER (status = 'VERDE') * 100 >= count(DISTINCT uf) * 40 THEN 'VERDE' ELSE 'AMARELO' END AS status, count(DISTINCT uf) AS ufs FROM {rows} GROUP BY product HAVING count(DISTINCT uf) >= 5"
_OF_ROWS = "SELECT product, uf AS place, periodo, preco_q / 10000.0 AS price, status, 1 AS ufs FROM {rows} WHERE {where}"
_IN = f"(SELECT * FROM live WHERE periodo = {YEAR * 12} + " + "{})"


def _k1_sql() -> str:
    parts = [
        _OF_REGION.format(rows=_IN.format(3), region="ASIA"), _OF_REGION.format(rows=_NEWEST, region="EUROPE"), _OF_COUNTRY.format(rows=_IN.format(4)), _OF_COUNTRY.format(rows=_NEWEST),
        _OF_ROWS.format(rows=_IN.format(5), where="status = 'VERDE'"), _OF_ROWS.format(rows=_NEWEST, where="uf = 'NATION_1' AND product ILIKE '%brand#1%'"),
    ]
    each = " UNION ALL ".join(f"SELECT {i} AS request, * FROM ({p})" for i, p in enumerate(parts))
    ranked = f"SELECT *, count(*) OVER (PARTITION BY request) AS total, row_number() OVER (PARTITION BY request ORDER BY product, place) AS k FROM ({each})"
    return f"WITH fact AS FACT, {LIVE} SELECT request, total, product, place, periodo, price, status, CAST(ufs AS BIGINT) AS ufs FROM ({ranked}) WHERE k <= {PAGE}"


@query(_k1_sql())
def k1_requests(spark, sf_dir):
    """The first page of each of the requests, and how many rows each has."""
    s = folders.stored(seasonality(fact(spark, sf_dir)).select(*KEY, "region", "ano", "mes", "periodo", "preco_q", "status"))
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    regions = places.groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("ufs"))
    kept, pages = Answers(spark, folders.work_folder(spark)), None
    for i, request in enumerate(REQUESTS):
        total, rows = kept.page(request, 1, lambda request=request: answer(s, regions, request), ["product", "place"], 1, PAGE)
        one = rows.select(F.lit(i).alias("request"), F.lit(total).cast("long").alias("total"), "product", "place", "periodo", "price", "status", "ufs")
        pages = one if pages is None else pages.unionByName(one)
    return pages


@query(f"WITH fact AS FACT, {LIVE} SELECT uf, product, count(*) AS months, count(*) FILTER (WHERE status = 'VERDE') AS green, CAST(sum(preco_q) AS BIGINT) AS total_q, CASE WHEN uf = 'NATION_1' THEN 2 ELSE 1 END AS version FROM live GROUP BY uf, product")
def a12_partial_refresh(spark, sf_dir):
    """A summary refreshed after one state got its newest months, with the version that holds each row."""
    s = folders.stored(seasonality(fact(spark, sf_dir)).select(*KEY, "periodo", "preco_q", "status"))
    summary = lambda rows: rows.groupBy("uf", "product").agg(F.count("*").alias("months"), F.count_if(F.col("status") == rules.GREEN).alias("green"), F.sum("preco_q").alias("total_q"))
    folder = folders.work_folder(spark)
    versions.refresh(summary(s.filter((F.col("uf") != "NATION_1") | (F.col("periodo") <= PERIOD - 6))), folder, "uf")
    versions.refresh(summary(s), folder, "uf")
    return versions.read(spark, folder, places=True).select("uf", "product", "months", "green", "total_q", F.col("table_version").cast("int").alias("version"))


def full_load_steps(spark: SparkSession, raw: str, folder: str, regions: DataFrame, cap: int, year: int, period_: int) -> Steps:
    """The load from a folder of raw files to serving rows, in steps that a later run takes over.

    regions has code (two letters), uf and region of each state.  A price that
    several files have counts once.  Tables: rejected (raw rows with the
    reason), prices, quarantine (with the reason), seasonality, forecast and
    serving (see full_load()).
    """
    steps = Steps(spark, folder, folders.fingerprint(spark, raw))
    steps.add("landed", [], lambda: files.read_raw(spark, raw))
    steps.add("rejected", ["landed"], lambda landed: files.cleaned(landed)[1])

    def prices(landed: DataFrame) -> DataFrame:
        good = files.cleaned(landed)[0].select(F.col("produto").alias("product"), F.col("uf").alias("code"), "ano", "mes", (F.col("preco_medio") * 10000).cast("long").alias("preco_q"))
        # Of different prices for a month the highest counts.
        once = good.groupBy("product", "code", "ano", "mes").agg(F.max("preco_q").alias("preco_q"))
        return once.join(F.broadcast(regions), "code").select(*KEY, "region", "ano", "mes", period.number(F.col("ano"), F.col("mes")).alias("periodo"), "preco_q")

    steps.add("prices", ["landed"], prices)
    steps.add("judged", ["prices"], lambda p: anomalies(p, cap), cap=cap)
    steps.add("quarantine", ["judged"], lambda j: j.filter("reason is not null").select(*KEY, "periodo", "preco_q", "reason"))
    steps.add("good", ["judged", "prices"], lambda j, p: j.filter("reason is null").select(p.columns))
    steps.add("seasonality", ["good"], lambda good: seasonality(good).select(*KEY, "region", "ano", "mes", "periodo", "preco_q", "status"))
    steps.add("forecast", ["seasonality"], lambda s: weighted_forecast(s, year, period_), year=year, period=period_)

    def serving(good: DataFrame, forecast: DataFrame) -> DataFrame:
        known = good.filter(F.col("periodo") <= period_)
        last = known.groupBy(*KEY).agg(F.max_by("preco_q", "periodo").alias("last_q"))
        own = known.filter(F.col("ano") == year).select(*KEY, "mes", "preco_q")
        out = forecast.join(own, [*KEY, "mes"], "left").join(last, KEY, "left")
        return out.select(*KEY, "mes", F.coalesce("preco_q", "last_q").alias("preco_q"), "status", "is_forecast", "trend")

    steps.add("serving", ["good", "forecast"], serving, year=year, period=period_)
    return steps


#: Most observations of a month whose raw price is a number in the query's files.
_READABLE = 3


def _raw_load(spark: SparkSession, sf_dir: str) -> Steps:
    """Raw files of the fact (prices with a decimal comma, two files for January, unreadable prices), and the load that reads them."""
    f = fact(spark, sf_dir)
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    regions = n.select(F.concat(F.lit("N"), F.char(F.lit(65) + F.col("n_nationkey"))).alias("code"), F.col("n_name").alias("uf"), F.col("r_name").alias("region"))
    price = F.when(F.col("obs") > _READABLE, "n/d").otherwise(F.concat(F.expr("preco_q div 10000").cast("string"), F.lit(","), F.lpad((F.col("preco_q") % 10000).cast("string"), 4, "0")))
    rows = f.join(F.broadcast(regions.select("uf", "code")), "uf").select(F.col("product").alias("Produto"), F.col("code").alias("UF"), F.col("ano").alias("Ano"), F.col("mes").alias("Mes"), price.alias("Valor Produto-KG"))
    raw = folders.work_folder(spark)
    for part, name in ((rows, "csv"), (rows.filter("Mes = 1"), "csv")):
        part.write.mode("append").option("sep", ";").option("header", True).csv(raw)
    return full_load_steps(spark, raw, folders.work_folder(spark), regions, 18_000_000, YEAR, PERIOD)


_LOADED = _KEPT.replace("raw AS FACT", f"raw AS (SELECT * FROM FACT WHERE obs <= {_READABLE})")


@query(f"WITH raw AS FACT SELECT product AS produto, ano, mes, 'PRECO_INVALIDO' AS motivo, CASE WHEN mes = 1 THEN 2 ELSE 1 END * count(*) AS n FROM raw WHERE obs > {_READABLE} GROUP BY product, ano, mes")
def j43_rejected(spark, sf_dir):
    return _raw_load(spark, sf_dir).table("rejected").groupBy("produto", "ano", "mes", "motivo").agg(F.count("*").alias("n"))


@query(f"WITH {_LOADED} SELECT product, uf, periodo, preco_q, CASE WHEN n1 > 0 AND preco_q * n1 > ot * 5 THEN 'EXCEDE_500PCT_MEDIA_UF' ELSE 'HARD_CAP_SEM_HISTORICO' END AS reason FROM judged WHERE (n1 > 0 AND preco_q * n1 > ot * 5) OR (preco_q > 18000000 AND NOT (n1 >= 3 AND preco_q * n1 <= ot * 3) AND NOT (n2 >= 3 AND preco_q * n2 <= rest * 3))")
def j43_quarantine(spark, sf_dir):
    return _raw_load(spark, sf_dir).table("quarantine")


@query(f"WITH {_LOADED}, {LIVE} SELECT product, uf, region, ano, mes, periodo, preco_q, status FROM live")
def j43_seasonality(spark, sf_dir):
    return _raw_load(spark, sf_dir).table("seasonality")


@query(f"WITH {_LOADED}, {LIVE}, {_WEIGHTED} SELECT * FROM forecast")
def j43_forecast(spark, sf_dir):
    return _raw_load(spark, sf_dir).table("forecast")


@query(f"WITH {_LOADED}, {LIVE}, {_WEIGHTED}, last AS (SELECT product, uf, arg_max(preco_q, periodo) AS last_q FROM fact WHERE periodo <= {PERIOD} GROUP BY ALL), own AS (SELECT product, uf, mes, preco_q FROM fact WHERE ano = {YEAR} AND periodo <= {PERIOD}) SELECT product, uf, mes, coalesce(preco_q, last_q) AS preco_q, status, is_forecast, trend FROM forecast LEFT JOIN own USING (product, uf, mes) LEFT JOIN last USING (product, uf)")
def j43_serving(spark, sf_dir):
    return _raw_load(spark, sf_dir).table("serving")


#: Newest month of each batch of the queries over the change log; the first holds all months before the year.
BATCHES = (YEAR * 12, YEAR * 12 + 3, YEAR * 12 + 6, PERIOD)


def _logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log of an ingest of seasonality's rows in batches, the newest status of each series in its table."""
    s = folders.stored(seasonality(fact(spark, sf_dir)).select(*KEY, "periodo", "preco_q", "status"))
    folder, low = folders.work_folder(spark), 0
    for number, high in enumerate(BATCHES):
        batch = s.filter((F.col("periodo") > low) & (F.col("periodo") <= high))
        ingest.apply_batch(batch, number, folder, KEY, ["periodo"], lambda b: (b.filter("preco_q > 0"), b.filter("preco_q <= 0")), F.col("uf"), "status")
        low = high
    return ingest.change_log(spark, folder)


_LOG = f"""b AS (SELECT k - 1 AS batch, h FROM (SELECT unnest([{", ".join(map(str, BATCHES))}]) AS h, unnest(range(1, {len(BATCHES) + 1})) AS k)),
st AS (SELECT product, uf, batch, arg_max(status, periodo) AS after FROM live JOIN b ON periodo <= h GROUP BY ALL),
log AS (SELECT * FROM (SELECT product, uf, lag(after) OVER (PARTITION BY product, uf ORDER BY batch) AS before, after, batch FROM st) WHERE before <> after)"""


@query(f"WITH fact AS FACT, {LIVE}, {_LOG} SELECT product, uf, before, after, batch FROM log")
def l4_change_log(spark, sf_dir):
    return _logged(spark, sf_dir).select(*KEY, "before", "after", "batch")


@query(f"WITH fact AS FACT, {LIVE}, {_LOG} SELECT before, after, count(*) AS changes, min(batch) AS first_batch, max(batch) AS last_batch FROM log GROUP BY ALL")
def j46_transitions(spark, sf_dir):
    return ingest.transitions(_logged(spark, sf_dir))
