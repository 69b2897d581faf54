"""Further pipelines: forecasts, master data, proxies, audits and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrain.functions import rules, text
from tidegrain.operators import stats, tables, windows
from tidegrain.plans.basic import FLOWS, flows
from tidegrain.plans.composite import LIVE, MODAL, PERIOD, YEAR, anchored, modal_baseline, seasonality
from tidegrain.plans.facts import fact, table
from tidegrain.plans.kit import registrar
from tidegrain.plans.rules_queries import anomalies

QUERIES, SQL, query = registrar()
KEY = ["product", "uf"]


@query(f"WITH fact AS FACT, {LIVE}, m AS (SELECT product, mes, CASE WHEN ano = 2001 THEN status END AS now, CASE WHEN ano < 2001 THEN status END AS old FROM live WHERE ano >= 1999), a AS (SELECT product, mes, now AS s FROM m WHERE now IS NOT NULL GROUP BY product, mes, now QUALIFY row_number() OVER (PARTITION BY product, mes ORDER BY count(*) DESC, now) = 1), b AS (SELECT product, mes, old AS s FROM m WHERE old IS NOT NULL GROUP BY product, mes, old QUALIFY row_number() OVER (PARTITION BY product, mes ORDER BY count(*) DESC, old) = 1) SELECT k.product, k.mes, coalesce(a.s, b.s) AS status FROM (SELECT DISTINCT product, mes FROM m) k LEFT JOIN a ON a.product = k.product AND a.mes = k.mes LEFT JOIN b ON b.product = k.product AND b.mes = k.mes")
def d9_conditional_mode(spark, sf_dir):
    """Mode of this year's statuses, else of the two years before."""
    s = seasonality(fact(spark, sf_dir)).filter("ano >= 1999")
    now, old = F.when(F.col("ano") == YEAR, F.col("status")), F.when(F.col("ano") < YEAR, F.col("status"))
    return s.groupBy("product", "mes").agg(F.coalesce(F.mode(now, deterministic=True), F.mode(old, deterministic=True)).alias("status"))


@query("SELECT c_nationkey, list_sort(list(DISTINCT c_mktsegment)) AS segments, '[' || string_agg('\"' || c_mktsegment || '\"', ',' ORDER BY c_mktsegment) || ']' AS as_json FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) GROUP BY c_nationkey")
def d20_json_arrays(spark, sf_dir):
    s = F.array_sort(F.collect_set("c_mktsegment"))
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(s.alias("segments"), F.to_json(s).alias("as_json"))


@query("SELECT s_suppkey, row_number() OVER (ORDER BY nullif(s_nationkey, 3) NULLS FIRST, s_suppkey) AS a FROM supplier")
def f4_null_order(spark, sf_dir):
    """The place of each row in the whole order: within its key, after the rows of smaller keys."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.nullif("s_nationkey", F.lit(3)).alias("k"))
    sizes = s.groupBy("k").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("k").alias("key"), (F.sum("n").over(Window.orderBy(F.asc_nulls_first("k"))) - F.col("n")).alias("before"))
    placed = s.select("s_suppkey", "k", F.row_number().over(Window.partitionBy("k").orderBy("s_suppkey")).cast("long").alias("own"))
    return placed.join(F.broadcast(before), F.col("k").eqNullSafe(F.col("key"))).select("s_suppkey", (F.col("own") + F.col("before")).alias("a"))


CLASSES = (("widget", "MAQUINARIO"), ("gear|rod", "INSUMO"), ("plate", "ALIMENTO"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'widget', 'i') THEN 'MAQUINARIO' WHEN regexp_matches(p_name, 'gear|rod', 'i') THEN 'INSUMO' WHEN regexp_matches(p_name, 'plate', 'i') THEN 'ALIMENTO' ELSE 'MATERIA_PRIMA' END AS class FROM part")
def h17_product_class(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.by_rules(F.col("p_name"), CLASSES, F.lit("MATERIA_PRIMA")).alias("class"))


@query("WITH fact AS FACT SELECT product, uf, periodo, preco_q, preco_q * (9000 + CAST('0x' || substr(md5(concat_ws('|', product, uf, periodo)), 1, 8) AS BIGINT) % 2001) // 10000 AS moved FROM fact")
def h23_jitter(spark, sf_dir):
    """Prices moved by up to 10 % either way, by a hash of the key, so that a rerun gives the same."""
    part = F.conv(F.substring(F.md5(F.concat_ws("|", *KEY, "periodo")), 1, 8), 16, 10).cast("long")
    return fact(spark, sf_dir).withColumn("h", part).select(*KEY, "periodo", "preco_q", F.expr("preco_q * (9000 + h % 2001) div 10000").alias("moved"))


@query(f"WITH {FLOWS} SELECT f.product, a.n_nationkey AS from_key, b.n_nationkey AS to_key, f.destino = 'NATION_1' AS incoming FROM flows f JOIN nation a ON a.n_name = f.origem JOIN nation b ON b.n_name = f.destino WHERE 'NATION_1' IN (f.origem, f.destino) AND f.origem <> f.destino")
def h29_arcs(spark, sf_dir):
    """Routes of a state between known points, without self loops."""
    points = table(spark, sf_dir, "nation").select("n_name", "n_nationkey")
    f = flows(spark, sf_dir).filter("'NATION_1' in (origem, destino) and origem <> destino")
    a = points.select(F.col("n_name").alias("origem"), F.col("n_nationkey").alias("from_key"))
    b = points.select(F.col("n_name").alias("destino"), F.col("n_nationkey").alias("to_key"))
    return f.join(a, "origem").join(b, "destino").select("product", "from_key", "to_key", (F.col("destino") == "NATION_1").alias("incoming"))


@query(f"WITH fact AS FACT, {LIVE}, b AS ({MODAL.format('1999, 2000')}), real AS (SELECT DISTINCT product, uf, mes FROM fact WHERE ano = {YEAR} AND periodo <= {PERIOD}), miss AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM real r WHERE r.product = b.product AND r.uf = b.uf AND r.mes = b.mes)), t AS (SELECT *, lag(status) OVER (PARTITION BY product, uf ORDER BY mes) AS p FROM miss) SELECT product, uf, mes, status, CASE WHEN p IS NULL THEN 'ESTAVEL' WHEN CASE status WHEN 'VERDE' THEN 0 WHEN 'AMARELO' THEN 1 ELSE 2 END > CASE p WHEN 'VERDE' THEN 0 WHEN 'AMARELO' THEN 1 ELSE 2 END THEN 'ALTA' WHEN CASE status WHEN 'VERDE' THEN 0 WHEN 'AMARELO' THEN 1 ELSE 2 END < CASE p WHEN 'VERDE' THEN 0 WHEN 'AMARELO' THEN 1 ELSE 2 END THEN 'QUEDA' ELSE 'ESTAVEL' END AS trend FROM t")
def j9_forecast(spark, sf_dir):
    """Baseline statuses for months without a price, with the trend along those months alone."""
    f = fact(spark, sf_dir)
    b = modal_baseline(seasonality(f), (YEAR - 2, YEAR - 1))
    miss = tables.without(b, f.filter((F.col("ano") == YEAR) & (F.col("periodo") <= PERIOD)), [*KEY, "mes"])
    return windows.changes(miss, KEY, "mes", "status", "trend").select(*KEY, "mes", "status", "trend")


@query("WITH p AS (SELECT p_partkey, p_name, split_part(p_name, ' ', 1) AS w, length(p_name) AS k FROM part), c AS (SELECT a.p_partkey, b.p_partkey AS parent FROM p a JOIN (SELECT w, p_partkey FROM p QUALIFY row_number() OVER (PARTITION BY w ORDER BY k, p_partkey) = 1) b ON b.w = a.w WHERE a.p_partkey <> b.p_partkey) SELECT * FROM c")
def j13_parents(spark, sf_dir):
    """The product with the same first word and the shortest name, for all others at once."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ")[0].alias("w"), F.length("p_name").alias("k"))
    best = windows.top_per_key(p, ["w"], [F.asc("k"), F.asc("p_partkey")]).select("w", F.col("p_partkey").alias("parent"))
    return p.join(best, "w").filter("p_partkey <> parent").select("p_partkey", "parent")


@query("WITH p AS (SELECT p_partkey, p_name, p_brand, upper(trim(p_name)) AS key FROM part) SELECT p_partkey, key, min(p_partkey) OVER (PARTITION BY key) AS master, count(*) OVER (PARTITION BY key) AS members FROM p")
def j23_master_data(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", text.name_key(F.col("p_name")).alias("key"))
    g = p.groupBy("key").agg(F.min("p_partkey").alias("master"), F.count("*").alias("members"))
    return p.join(g, "key").select("p_partkey", "key", "master", "members")


@query("WITH m AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name) AS master FROM part), r AS (SELECT master, l_suppkey, year(l_shipdate)::INTEGER AS ano, max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem JOIN m ON m.p_partkey = l_partkey GROUP BY ALL) SELECT master, ano, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM r GROUP BY ALL")
def j24_consolidated_products(spark, sf_dir):
    """Facts of products with one name under the lowest id, one row for each key."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    m = p.join(p.groupBy("p_name").agg(F.min("p_partkey").alias("master")), "p_name").select(F.col("p_partkey").alias("l_partkey"), "master")
    r = table(spark, sf_dir, "lineitem").join(m, "l_partkey").groupBy("master", "l_suppkey", F.year("l_shipdate").alias("ano")).agg(F.max(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    return r.groupBy("master", "ano").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query("WITH fact AS FACT, g AS (SELECT p.product, u.uf, u.region FROM (SELECT DISTINCT product FROM fact) p, (SELECT DISTINCT uf, region FROM fact) u), miss AS (SELECT g.* FROM g WHERE NOT EXISTS (SELECT 1 FROM fact f WHERE f.product = g.product AND f.uf = g.uf AND f.periodo = 24010)), a AS (SELECT product, region, CAST(sum(preco_q) AS DOUBLE) / count(*) AS v FROM fact WHERE periodo = 24010 GROUP BY ALL), b AS (SELECT product, CAST(sum(preco_q) AS DOUBLE) / count(*) AS v FROM fact WHERE periodo = 24010 GROUP BY ALL), c AS (SELECT product, CAST(sum(preco_q) AS DOUBLE) / count(*) AS v FROM fact GROUP BY ALL) SELECT m.product, m.uf, coalesce(a.v, b.v, c.v) AS proxy_q, CASE WHEN a.v IS NOT NULL THEN 1 WHEN b.v IS NOT NULL THEN 2 WHEN c.v IS NOT NULL THEN 3 END AS level FROM miss m LEFT JOIN a ON a.product = m.product AND a.region = m.region LEFT JOIN b ON b.product = m.product LEFT JOIN c ON c.product = m.product")
def j28_missing_states(spark, sf_dir):
    """Prices for states without one in a period: the region's mean, the country's, the whole history's."""
    f = fact(spark, sf_dir)
    now = f.filter("periodo = 24010")
    mean = lambda d, k: d.groupBy(*k).agg((F.sum("preco_q") / F.count("*")).alias("v"))
    places = f.agg(F.collect_set(F.struct("uf", "region")).alias("all")).select("all").scalar()
    g = f.select("product").distinct().withColumn("all", places).select("product", F.explode("all").alias("x")).select("product", "x.uf", "x.region")
    miss = tables.missing(g, now, KEY)
    return tables.cascade(miss, [(mean(now, ["product", "region"]), ["product", "region"]), (mean(now, ["product"]), ["product"]), (mean(f, ["product"]), ["product"])], "v", "proxy_q", "level").select(*KEY, "proxy_q", "level")


@query("SELECT s_suppkey AS place, canonical, n_facts FROM (SELECT s.s_suppkey, s.s_nationkey, count(l_orderkey) AS n_facts, first_value(s.s_suppkey) OVER (PARTITION BY s.s_nationkey ORDER BY count(l_orderkey) DESC, s.s_suppkey) AS canonical FROM supplier s LEFT JOIN lineitem ON l_suppkey = s.s_suppkey GROUP BY s.s_suppkey, s.s_nationkey)")
def j36_canonical_places(spark, sf_dir):
    """Of places with one key the one with most facts, the lowest id if several have as many."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(n, "s_suppkey", "left").withColumn("n_facts", F.coalesce("n", F.lit(0)).cast("long"))
    best = windows.top_per_key(s, ["s_nationkey"], [F.desc("n_facts"), F.asc("s_suppkey")]).select("s_nationkey", F.col("s_suppkey").alias("canonical"))
    return s.join(best, "s_nationkey").select(F.col("s_suppkey").alias("place"), "canonical", "n_facts")


@query("WITH fact AS FACT, u AS (SELECT *, sum(preco_q) OVER (PARTITION BY product, uf) - preco_q AS ot, count(*) OVER (PARTITION BY product, uf) - 1 AS n1 FROM fact), k AS (SELECT * FROM u WHERE NOT (n1 > 0 AND preco_q * n1 * 10 > ot * 12)) SELECT product, uf, periodo, preco_q - lag(preco_q) OVER (PARTITION BY product, uf ORDER BY periodo) AS change FROM k")
def j38_purged_changes(spark, sf_dir):
    """Changes once prices over 1.2 times the mean of the series' other months are gone."""
    o = stats.leave_out(fact(spark, sf_dir), KEY, ["periodo"], "preco_q", "own")
    kept = o.filter(~((F.col("own_n") > 0) & (F.col("preco_q") * F.col("own_n") * 10 > F.col("own_total") * 12)))
    return kept.select(*KEY, "periodo", (F.col("preco_q") - F.lag("preco_q").over(Window.partitionBy(*KEY).orderBy("periodo"))).alias("change"))


@query(f"WITH fact AS FACT SELECT product, uf, periodo, CASE WHEN ano = {YEAR} THEN 'REAL_ATUAL' ELSE 'HISTORICO_BASE' END AS kind, {YEAR} - ano AS age, '{{\"fonte\":\"coleta\",\"ano_referencia\":' || ano || '}}' AS meta FROM fact")
def j40_provenance_backfill(spark, sf_dir):
    kind = F.when(F.col("ano") == YEAR, "REAL_ATUAL").otherwise("HISTORICO_BASE")
    meta = F.to_json(F.struct(F.lit("coleta").alias("fonte"), F.col("ano").alias("ano_referencia")))
    return fact(spark, sf_dir).select(*KEY, "periodo", kind.alias("kind"), (F.lit(YEAR) - F.col("ano")).alias("age"), meta.alias("meta"))


@query("SELECT p_type AS category, count(DISTINCT p_brand) AS products, count(*) AS parts FROM part GROUP BY p_type")
def j44_categories(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("category")).agg(F.count_distinct("p_brand").alias("products"), F.count("*").alias("parts"))


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'events', count(*) FROM events")
def j46_health(spark, sf_dir):
    count = lambda t: table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
    return count("orders").union(count("customer")).union(count("part")).union(count("events"))


@query("WITH e AS (SELECT event_type, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY ALL), w AS (SELECT min(d) AS a, max(d) AS b FROM e), g AS (SELECT t.event_type, CAST(x AS DATE) AS d FROM (SELECT DISTINCT event_type FROM e) t, w, unnest(generate_series(w.a, w.b, INTERVAL 1 DAY)) s(x)) SELECT g.event_type, count(*) AS days, count(*) FILTER (WHERE e.n IS NULL) AS missing, CAST(coalesce(sum(e.n), 0) AS BIGINT) AS n FROM g LEFT JOIN e ON e.event_type = g.event_type AND e.d = g.d GROUP BY g.event_type")
def j48_window_report(spark, sf_dir):
    """Of each type the days of the whole window and those without events."""
    e = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    days = e.agg(F.sequence(F.min("d"), F.max("d")).alias("days")).select("days").scalar()
    g = e.select("event_type").distinct().withColumn("days", days).select("event_type", F.explode("days").alias("d"))
    return g.join(e, ["event_type", "d"], "left").groupBy("event_type").agg(F.count("*").alias("days"), F.count_if(F.col("n").isNull()).alias("missing"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query("SELECT p_name AS name, string_agg(CAST(p_partkey AS VARCHAR), ', ' ORDER BY p_partkey) AS members, min(p_partkey) AS canonical, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def j51_duplicate_names(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.array_sort(F.collect_list("p_partkey")).alias("m"))
    return g.filter(F.size("m") > 1).select("name", F.array_join(F.transform("m", lambda x: x.cast("string")), ", ").alias("members"), F.col("m")[0].alias("canonical"), F.size("m").cast("long").alias("n"))


@query(f"WITH fact AS FACT, {LIVE} SELECT product, uf, preco_q, status FROM live WHERE ano = 2001 AND mes = 6 AND status = 'VERDE' ORDER BY product, uf LIMIT 100")
def k2_by_month(spark, sf_dir):
    s = seasonality(fact(spark, sf_dir))
    rows = tables.filtered(s, ano=2001, mes=6, status=rules.GREEN)
    return tables.page(rows, [F.asc("product"), F.asc("uf")], 1, 100).select(*KEY, "preco_q", "status")


@query(f"WITH fact AS FACT, {LIVE}, u AS (SELECT product, mes, count(*) AS ufs, count(*) FILTER (WHERE status = 'VERMELHO') AS r, count(*) FILTER (WHERE status = 'VERDE') AS v FROM live WHERE ano = 2000 GROUP BY ALL), nat AS (SELECT *, CASE WHEN r * 100 >= ufs * 40 THEN 'VERMELHO' WHEN v * 100 >= ufs * 40 THEN 'VERDE' ELSE 'AMARELO' END AS status FROM u) SELECT product, list(status ORDER BY mes) AS statuses, max(ufs) AS total_ufs FROM nat WHERE product IN (SELECT DISTINCT product FROM nat ORDER BY product LIMIT 10) GROUP BY product")
def k4_year_grid(spark, sf_dir):
    """A page of products, each with its twelve national statuses."""
    s = tables.entity_page(seasonality(fact(spark, sf_dir)).filter("ano = 2000"), "product", 1, 10)
    u = s.groupBy("product", "mes").agg(F.count("*").alias("ufs"), rules.quorum(F.count_if(F.col("status") == rules.RED), F.count_if(F.col("status") == rules.GREEN), F.count("*")).alias("status"))
    g = u.groupBy("product").agg(F.sort_array(F.collect_list(F.struct("mes", "status"))).alias("m"), F.max("ufs").alias("total_ufs"))
    return g.select("product", F.col("m.status").alias("statuses"), "total_ufs")


@query("SELECT n_name AS uf FROM nation UNION ALL SELECT 'BR'")
def k7_states(spark, sf_dir):
    return spark.createDataFrame([("BR",)], "uf string").union(table(spark, sf_dir, "nation").select("n_name").distinct())


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def n2_duplicate_keys(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


def quarantine(df: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows of a batch."""
    judged = anomalies(df, cap)
    return judged.filter("reason is null").select(*df.columns), judged.filter("reason is not null").select(*df.columns, "reason")


@query(f"WITH fact AS FACT, a AS (SELECT DISTINCT product, uf, mes FROM fact WHERE ano BETWEEN {YEAR - 2} AND {YEAR}) SELECT uf, count(*) AS anchored, count(DISTINCT product) AS products FROM a GROUP BY uf")
def j20_anchor_coverage(spark, sf_dir):
    return anchored(fact(spark, sf_dir), YEAR).groupBy("uf").agg(F.count("*").alias("anchored"), F.count_distinct("product").alias("products"))
