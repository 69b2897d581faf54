"""Scans, filters, joins, aggregations and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegrain.functions import period
from tidegrain.operators import stats, tables
from tidegrain.plans.facts import fact, table
from tidegrain.plans.kit import registrar

QUERIES, SQL, query = registrar()
KEY = ["product", "uf"]


@query("SELECT r_name AS region, n_name AS uf, CAST(greatest(2, ceil(0.75 * count(*) OVER (PARTITION BY r_name))) AS INTEGER) AS min_ufs FROM nation JOIN region ON n_regionkey = r_regionkey")
def a5_region_members(spark, sf_dir):
    """Regions as arrays of states, exploded again with the least number of states."""
    r = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("region")).agg(F.collect_list("n_name").alias("ufs"))
    return r.select("region", F.explode("ufs").alias("uf"), F.greatest(F.lit(2), F.ceil(F.size("ufs") * 0.75)).cast("int").alias("min_ufs"))


@query("SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'view' AND json_extract_string(props, '$.k') IS NOT NULL")
def a6_landing_json(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type <> 'view'").select("event_id", "event_type", F.from_json("props", "k bigint").alias("p"))
    return e.select("event_id", "event_type", F.col("p.k").alias("k")).filter("k is not null")


#: Labels of order states as an inline relation, which reads the same in both engines.
_LABELS = "(VALUES ('F', 'VERDE', 1), ('P', 'AMARELO', 2), ('X', 'VERMELHO', 3)) AS v(code, status, place)"


@query(f"SELECT v.place, v.status, count(o_orderkey) AS orders FROM {_LABELS} LEFT JOIN orders ON o_orderstatus = v.code GROUP BY ALL")
def a7_inline_values(spark, sf_dir):
    """Orders of each state that an inline relation names."""
    labels = spark.sql(f"SELECT * FROM {_LABELS}")
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("code")).agg(F.count("*").alias("n"))
    return labels.join(n, "code", "left").select("place", "status", F.coalesce("n", F.lit(0)).alias("orders"))


@query("WITH fact AS FACT, s AS (SELECT product, min(periodo) AS a, max(periodo) AS b FROM fact GROUP BY ALL) SELECT product, CAST(p AS INTEGER) AS periodo FROM s, LATERAL (SELECT unnest(range(a, b + 1)) AS p)")
def a8_series(spark, sf_dir):
    """Every period from a product's first to its last."""
    s = fact(spark, sf_dir).groupBy("product").agg(F.min("periodo").alias("a"), F.max("periodo").alias("b"))
    return s.select("product", F.explode(F.sequence("a", "b")).alias("periodo"))


@query("WITH fact AS FACT SELECT product, uf, ano, mes, preco_q FROM fact WHERE uf = 'NATION_1' AND ano = 2000")
def b1_optional_filters(spark, sf_dir):
    return tables.filtered(fact(spark, sf_dir), uf="nation_1".upper(), ano=2000, mes=None, product=None).select("product", "uf", "ano", "mes", "preco_q")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%re%'")
def b2_contains(spark, sf_dir):
    return tables.contains(table(spark, sf_dir, "part"), "p_name", "RE").select("p_partkey", "p_name")


@query("WITH fact AS FACT SELECT product, uf, periodo FROM fact WHERE uf IN ('NATION_1', 'NATION_2', 'NATION_3')")
def b4_membership(spark, sf_dir):
    return tables.filtered(fact(spark, sf_dir), uf=["NATION_1", "NATION_2", "NATION_3"]).select("product", "uf", "periodo")


@query("SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'O') IS DISTINCT FROM 'F'")
def b6_distinct_from(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(~F.nullif("o_orderstatus", F.lit("O")).eqNullSafe(F.lit("F"))).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_type, '^(standard|small)', 'i') AND NOT regexp_matches(p_name, 'blue', 'i')")
def b7_regex(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.col("p_type").rlike("(?i)^(standard|small)") & ~F.col("p_name").rlike("(?i)blue")).select("p_partkey")


@query("WITH fact AS FACT SELECT product, uf, periodo FROM fact WHERE periodo > 2001 * 12 + 8 - 24 AND periodo <= 2001 * 12 + 8")
def b8_last_two_years(spark, sf_dir):
    return fact(spark, sf_dir).filter(period.within_last(F.col("periodo"), 2001 * 12 + 8, 24)).select("product", "uf", "periodo")


@query("SELECT p_partkey, p_brand FROM part WHERE (nullif(p_brand, 'Brand#11') IS NULL OR nullif(p_brand, 'Brand#11') NOT IN ('Brand#12', 'Brand#13')) AND p_size > 5")
def b10_visible(spark, sf_dir):
    """A blacklist that lets nulls through."""
    brand = F.nullif("p_brand", F.lit("Brand#11"))
    return table(spark, sf_dir, "part").filter((brand.isNull() | ~brand.isin("Brand#12", "Brand#13")) & (F.col("p_size") > 5)).select("p_partkey", "p_brand")


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') NOT LIKE '1%'")
def b11_json_predicate(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(~F.get_json_object("props", "$.k").like("1%")).select("event_id")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'REAL' WHEN o_totalprice > 100000 THEN 'PROJETADO' ELSE 'PROXY' END AS kind, coalesce(nullif(o_orderpriority, '5-LOW'), 'padrao') AS origin FROM orders")
def b12_case_projection(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "REAL").when(F.col("o_totalprice") > 100000, "PROJETADO").otherwise("PROXY")
    return table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"), F.coalesce(F.nullif("o_orderpriority", F.lit("5-LOW")), F.lit("padrao")).alias("origin"))


@query("WITH fact AS FACT SELECT uf, product, periodo, preco_q FROM fact WHERE preco_q > 0 AND mes >= 1 AND mes <= 12 AND length(uf) > 2")
def b15_valid_rows(spark, sf_dir):
    f = fact(spark, sf_dir).filter((F.col("preco_q") > 0) & F.col("mes").between(1, 12) & (F.length("uf") > 2))
    return f.select("uf", "product", "periodo", "preco_q")


@query("WITH fact AS FACT, a AS (SELECT * FROM fact WHERE ano = 2000), b AS (SELECT * FROM fact WHERE ano = 2001) SELECT coalesce(a.product, b.product) AS product, coalesce(a.uf, b.uf) AS uf, coalesce(a.mes, b.mes) AS mes, a.preco_q AS p2000, b.preco_q AS p2001 FROM a FULL JOIN b ON a.product = b.product AND a.uf = b.uf AND a.mes = b.mes")
def c3_full_outer(spark, sf_dir):
    f = fact(spark, sf_dir)
    a = f.filter("ano = 2000").select("product", "uf", "mes", F.col("preco_q").alias("p2000"))
    b = f.filter("ano = 2001").select("product", "uf", "mes", F.col("preco_q").alias("p2001"))
    return a.join(b, ["product", "uf", "mes"], "full")


@query("WITH fact AS FACT SELECT product, uf, CAST(m AS INTEGER) AS mes FROM (SELECT DISTINCT product, uf FROM fact), range(1, 13) r(m)")
def c4_month_grid(spark, sf_dir):
    return tables.month_grid(fact(spark, sf_dir).select(*KEY).distinct())


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def c5_not_exists(spark, sf_dir):
    return tables.without(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey")


@query("WITH fact AS FACT, g AS (SELECT product, uf, CAST(m AS INTEGER) AS mes FROM (SELECT DISTINCT product, uf FROM fact), range(1, 13) r(m)) SELECT g.* FROM g LEFT JOIN (SELECT DISTINCT product, uf, mes FROM fact WHERE ano = 2001) f ON f.product = g.product AND f.uf = g.uf AND f.mes = g.mes WHERE f.mes IS NULL")
def c6_missing_months(spark, sf_dir):
    f = fact(spark, sf_dir)
    return tables.missing(tables.month_grid(f.select(*KEY).distinct()), f.filter("ano = 2001"), [*KEY, "mes"])


@query("WITH k AS (SELECT nullif(s_suppkey, 1) AS k FROM supplier), a AS (SELECT s_suppkey AS v FROM supplier WHERE s_suppkey % 3 = 0), b AS (SELECT nullif(v, 3) AS v FROM a) SELECT 'plain' AS kind, k FROM k WHERE k NOT IN (SELECT v FROM a) UNION ALL SELECT 'null inside', k FROM k WHERE k NOT IN (SELECT v FROM b) UNION ALL SELECT 'none', k FROM k WHERE k NOT IN (SELECT v FROM a WHERE v < 0)")
def c7_not_in(spark, sf_dir):
    """NOT IN with a null key on the left, with a null among the values (no rows), and without values (all rows)."""
    s = table(spark, sf_dir, "supplier")
    k = s.select(F.nullif(F.col("s_suppkey"), F.lit(1)).alias("k"))
    a = s.filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("k"))
    b = a.select(F.nullif(F.col("k"), F.lit(3)).alias("k"))
    parts = (("plain", a), ("null inside", b), ("none", a.filter("k < 0")))
    out = [tables.not_in(k, v, "k").select(F.lit(name).alias("kind"), "k") for name, v in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)")
def c8_exists(spark, sf_dir):
    return table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem").filter("l_discount > 0.09"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query("SELECT p_partkey, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R') AS returned FROM part")
def c9_exists_column(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).distinct()
    return table(spark, sf_dir, "part").join(r, F.col("p_partkey") == F.col("k"), "left").select("p_partkey", F.col("k").isNotNull().alias("returned"))


@query("WITH b AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS base FROM part) SELECT p_partkey, base FROM part JOIN b ON starts_with(lower(p_name), lower(base))")
def c10_prefix_join(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return tables.prefix_join(p, p.select(F.split("p_name", " ")[0].alias("base")).distinct(), "p_name", "base").select("p_partkey", "base")


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'F'")
def c17_conditional_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return table(spark, sf_dir, "orders").join(c, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_orderstatus") == "F"), "left").select("o_orderkey", "c_name")


@query("SELECT DISTINCT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON lower(substr(a.n_name, 1, 3)) = lower(substr(b.n_name, 1, 3)) AND a.n_nationkey < b.n_nationkey")
def c18_function_key(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lower(F.substring("n_name", 1, 3)).alias("k"))
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b")).distinct()


@query("SELECT c_custkey, CAST((SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS BIGINT) AS n_orders FROM customer")
def c19_scalar_aggregate(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"))


@query("WITH fact AS FACT SELECT product, uf, mes, preco_q FROM fact WHERE ano = (SELECT max(ano) FROM fact)")
def c20_newest_year(spark, sf_dir):
    f = fact(spark, sf_dir)
    return f.filter(F.col("ano") == f.agg(F.max("ano").alias("m")).select("m").scalar()).select("product", "uf", "mes", "preco_q")


@query("WITH fact AS FACT, n AS (SELECT product, uf, periodo, preco_q + 1 AS preco_q FROM fact WHERE ano = 2001) SELECT f.product, f.uf, f.periodo, coalesce(n.preco_q, f.preco_q) AS preco_q FROM fact f LEFT JOIN n ON n.product = f.product AND n.uf = f.uf AND n.periodo = f.periodo")
def c22_update_from(spark, sf_dir):
    f = fact(spark, sf_dir).select("product", "uf", "periodo", "preco_q")
    return tables.updated(f, f.filter("periodo > 2001 * 12").withColumn("preco_q", F.col("preco_q") + 1), ["product", "uf", "periodo"], ["preco_q"])


@query("WITH fact AS FACT, m AS (SELECT * FROM (VALUES ('Brand#11', 'Brand#11 A', 90), ('Brand#11', 'Brand#11 B', 120), ('Brand#12', 'Brand#12 A', 75)) v(product, variety, percent)) SELECT variety, uf, periodo, (preco_q * percent) // 100 AS preco_q FROM fact JOIN m ON m.product = fact.product")
def c23_varieties(spark, sf_dir):
    m = spark.createDataFrame([("Brand#11", "Brand#11 A", 90), ("Brand#11", "Brand#11 B", 120), ("Brand#12", "Brand#12 A", 75)], "product string, variety string, percent int")
    return fact(spark, sf_dir).join(F.broadcast(m), "product").select("variety", "uf", "periodo", F.expr("preco_q * percent div 100").alias("preco_q"))


@query("WITH fact AS FACT, a AS (SELECT product, uf, mes, max(preco_q) AS q FROM fact WHERE ano = 2001 GROUP BY ALL), b AS (SELECT product, uf, mes, max(preco_q) AS q FROM fact WHERE ano = 2000 GROUP BY ALL) SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.product = b.product AND a.uf = b.uf AND a.mes = b.mes)")
def c24_priority_merge(spark, sf_dir):
    one = lambda y: fact(spark, sf_dir).filter(F.col("ano") == y).groupBy("product", "uf", "mes").agg(F.max("preco_q").alias("q"))
    return tables.prefer(one(2001), one(2000), ["product", "uf", "mes"], [F.asc("q")])


@query("WITH k AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS key FROM part) SELECT p_partkey, CASE WHEN p_name IN (SELECT key FROM k) THEN p_name WHEN split_part(p_name, ' ', 2) IN (SELECT key FROM k) THEN split_part(p_name, ' ', 2) WHEN split_part(p_name, ' ', 1) IN (SELECT key FROM k) THEN split_part(p_name, ' ', 1) END AS found FROM part")
def c25_candidate_keys(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    known = p.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("key"))
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    return tables.candidates(p, known, "key", {1: F.col("p_name"), 2: word(2), 3: word(1)}).select("p_partkey", "found")


@query("WITH fact AS FACT SELECT product, count(*) AS n, CAST(sum(preco_q) AS BIGINT) AS total, min(preco_q) AS low, max(preco_q) AS high, count(DISTINCT uf) AS ufs, CAST(sum(preco_q) AS DOUBLE) / count(*) / 10000.0 AS mean_price FROM fact GROUP BY product")
def d1_group_totals(spark, sf_dir):
    g = fact(spark, sf_dir).groupBy("product").agg(F.count("*").alias("n"), F.sum("preco_q").alias("total"), F.min("preco_q").alias("low"), F.max("preco_q").alias("high"), F.count_distinct("uf").alias("ufs"))
    return g.withColumn("mean_price", F.col("total") / F.col("n") / 10000.0)


@query("WITH fact AS FACT SELECT product, count(DISTINCT (ano, mes)) AS periods, count(DISTINCT CASE WHEN ano = 2000 THEN mes END) AS months_2000 FROM fact GROUP BY product HAVING count(DISTINCT uf) >= 5")
def d3_distinct_tuples(spark, sf_dir):
    g = fact(spark, sf_dir).groupBy("product").agg(F.count_distinct(F.struct("ano", "mes")).alias("periods"), F.count_distinct(F.when(F.col("ano") == 2000, F.col("mes"))).alias("months_2000"), F.count_distinct("uf").alias("ufs"))
    return g.filter("ufs >= 5").drop("ufs")


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_totalprice > 200000) AS large, bool_or(o_totalprice > 400000) AS any_huge FROM orders GROUP BY o_orderpriority")
def d6_filtered_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_totalprice") > 200000).alias("large"), F.bool_or(F.col("o_totalprice") > 400000).alias("any_huge"))


@query("SELECT c_nationkey, c_mktsegment AS segment, n AS freq, CAST(t AS BIGINT) AS total FROM (SELECT *, sum(n) OVER (PARTITION BY c_nationkey) AS t FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) = 1")
def d10_mode_share(spark, sf_dir):
    return stats.mode_share(table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_mktsegment").alias("segment")), ["c_nationkey"], "segment")


@query("SELECT c_nationkey, m AS segment FROM (SELECT c_nationkey, c_mktsegment AS m, count(*) AS n FROM customer GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, m) = 1")
def d8_mode(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.mode("c_mktsegment", deterministic=True).alias("segment"))


@query("WITH fact AS FACT SELECT product, uf, quantile_cont(preco_q, 0.25) AS q1, quantile_cont(preco_q, 0.5) AS median, quantile_cont(preco_q, 0.75) AS q3 FROM fact GROUP BY product, uf")
def d11_quartiles(spark, sf_dir):
    g = fact(spark, sf_dir).groupBy(*KEY).agg(F.percentile("preco_q", [0.25, 0.5, 0.75]).alias("q"))
    return g.select(*KEY, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


VOLATILITY = """q AS (SELECT product, uf, quantile_cont(preco_q, 0.25) AS q1, quantile_cont(preco_q, 0.5) AS md, quantile_cont(preco_q, 0.75) AS q3 FROM fact GROUP BY ALL),
fenced AS (SELECT f.* FROM fact f JOIN q ON q.product = f.product AND q.uf = f.uf WHERE preco_q >= q1 - 1.5 * (q3 - q1) AND preco_q <= q3 + 1.5 * (q3 - q1) AND preco_q >= 0.25 * md),
v AS (SELECT product, uf, count(*) AS n, CAST(sum(preco_q) AS BIGINT) AS total, round(stddev_samp(preco_q::DOUBLE), 6) AS sigma FROM fenced GROUP BY ALL),
vol AS (SELECT *, round(sigma / (total::DOUBLE / n), 6) AS cv FROM v)"""


@query(f"WITH fact AS FACT, {VOLATILITY} SELECT product, uf, n, total, round(sigma, 2) AS sigma, round(cv, 4) AS cv, cv > 0.40 AS contaminated FROM vol")
def d14_fenced_volatility(spark, sf_dir):
    v = stats.volatility(fact(spark, sf_dir), KEY, "preco_q")
    return v.select(*KEY, "n", "total", F.round("sigma", 2).alias("sigma"), F.round("cv", 4).alias("cv"), "contaminated")


@query("WITH fact AS FACT, z AS (SELECT product, uf, round(stddev_samp(preco_q::DOUBLE), 6) AS s, CAST(sum(preco_q) AS DOUBLE) / count(*) AS m FROM fact GROUP BY ALL) SELECT f.product, f.uf, f.periodo FROM fact f JOIN z ON z.product = f.product AND z.uf = f.uf WHERE s IS NULL OR s = 0 OR abs(preco_q - m) <= 3 * s")
def d15_zscore_kept(spark, sf_dir):
    w = Window.partitionBy(*KEY)
    f = fact(spark, sf_dir).withColumns({"s": F.round(F.stddev_samp(F.col("preco_q").cast("double")).over(w), 6), "m": F.sum("preco_q").over(w).cast("double") / F.count("*").over(w)})
    return f.filter("s is null or s = 0 or abs(preco_q - m) <= 3 * s").select(*KEY, "periodo")


@query("WITH fact AS FACT, u AS (SELECT product, uf, CAST(sum(preco_q) AS BIGINT) AS s, count(*) AS w FROM fact WHERE ano = 2000 GROUP BY ALL) SELECT product, count(*) AS ufs, CAST(sum(s) AS DOUBLE) / nullif(CAST(sum(w) AS BIGINT), 0) / 10000.0 AS national FROM u GROUP BY product HAVING count(*) >= 5")
def d16_two_levels(spark, sf_dir):
    """The state level's mean, weighted by its rows, is the quotient of sums."""
    u = fact(spark, sf_dir).filter("ano = 2000").groupBy(*KEY).agg(F.sum("preco_q").alias("s"), F.count("*").alias("w"))
    return u.groupBy("product").agg(F.count("*").alias("ufs"), (F.sum("s") / F.nullif(F.sum("w"), F.lit(0)) / 10000.0).alias("national")).filter("ufs >= 5")


@query("WITH fact AS FACT SELECT product, string_agg(DISTINCT uf, ', ' ORDER BY uf) FILTER (WHERE ano = 1998) AS ufs, list_sort(list(DISTINCT mes)) AS months FROM fact GROUP BY product")
def d19_distinct_text(spark, sf_dir):
    return fact(spark, sf_dir).groupBy("product").agg(F.nullif(stats.distinct_text(F.when(F.col("ano") == 1998, F.col("uf"))), F.lit("")).alias("ufs"), F.array_sort(F.collect_set("mes")).alias("months"))


@query("WITH fact AS FACT, m AS (SELECT product, uf, ano, max(mes) AS mes FROM fact GROUP BY ALL) SELECT product, uf, max(ano) AS ano, arg_max(mes, ano) AS mes FROM m GROUP BY product, uf")
def d23_newest_month(spark, sf_dir):
    """Year and month of one row, not the largest of each."""
    return fact(spark, sf_dir).groupBy(*KEY).agg(F.max(F.struct("ano", "mes")).alias("x")).select(*KEY, "x.ano", "x.mes")


@query("WITH fact AS FACT SELECT product, uf, mes, count(DISTINCT ano)::DOUBLE / 7 * 100 AS confidence FROM fact GROUP BY product, uf, mes")
def d24_confidence(spark, sf_dir):
    return fact(spark, sf_dir).groupBy(*KEY, "mes").agg((F.count_distinct("ano").cast("double") / 7 * 100).alias("confidence"))


@query("WITH fact AS FACT SELECT product, uf, list_sort(list(preco_q))[len(list(preco_q)) // 2 + 1] AS median_q FROM fact GROUP BY product, uf")
def d25_upper_median(spark, sf_dir):
    return fact(spark, sf_dir).groupBy(*KEY).agg(stats.upper_median("preco_q").alias("median_q"))


@query("WITH fact AS FACT SELECT product, count(*)::DOUBLE / (count(DISTINCT uf) * count(DISTINCT periodo)) AS occupancy FROM fact GROUP BY product")
def d26_occupancy(spark, sf_dir):
    return fact(spark, sf_dir).groupBy("product").agg((F.count("*").cast("double") / (F.count_distinct("uf") * F.count_distinct("periodo"))).alias("occupancy"))


@query("WITH fact AS FACT, m AS (SELECT product, mes, count(DISTINCT uf) AS ufs FROM fact WHERE ano = 2000 GROUP BY ALL) SELECT product, list(mes ORDER BY mes) AS meses, max(ufs) AS total_ufs, count(*) = 12 AS complete FROM m GROUP BY product")
def d27_nested_months(spark, sf_dir):
    m = fact(spark, sf_dir).filter("ano = 2000").groupBy("product", "mes").agg(F.count_distinct("uf").alias("ufs"))
    g = m.groupBy("product").agg(F.sort_array(F.collect_list(F.struct("mes", "ufs"))).alias("s"))
    return g.select("product", F.col("s.mes").alias("meses"), F.array_max("s.ufs").alias("total_ufs"), (F.size(F.array_intersect("s.mes", F.sequence(F.lit(1), F.lit(12)))) == 12).alias("complete"))


FLOWS = """flows AS (SELECT p_brand AS product, a.n_name AS origem, b.n_name AS destino, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey GROUP BY ALL)"""


def flows(spark, sf_dir):
    """Units of trade by product from a seller's to a buyer's state."""
    n = table(spark, sf_dir, "nation")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")  # noqa: E741
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("destino")), "c_nationkey")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey").join(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("origem")), "s_nationkey")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("product"))
    return l.join(o, "l_orderkey").join(c, "o_custkey").join(s, "l_suppkey").join(p, "l_partkey").groupBy("product", "origem", "destino").agg(F.count("*").alias("n"))


@query(f"WITH {FLOWS} SELECT uf, count(*) AS routes, count(DISTINCT product) AS products, count(*) FILTER (WHERE side = 'o') AS origins, count(*) FILTER (WHERE side = 'd') AS destinations FROM (SELECT product, origem AS uf, 'o' AS side FROM flows UNION ALL SELECT product, destino, 'd' FROM flows) GROUP BY uf")
def d28_route_summary(spark, sf_dir):
    ends = flows(spark, sf_dir).select("product", F.explode(F.array(F.struct(F.col("origem").alias("uf"), F.lit("o").alias("side")), F.struct(F.col("destino").alias("uf"), F.lit("d").alias("side")))).alias("e")).select("product", "e.*")
    return ends.groupBy("uf").agg(F.count("*").alias("routes"), F.count_distinct("product").alias("products"), F.count_if(F.col("side") == "o").alias("origins"), F.count_if(F.col("side") == "d").alias("destinations"))


@query(f"WITH {FLOWS} SELECT direction, counterpart, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN origem = destino THEN 'local' WHEN destino = 'NATION_1' THEN 'in' ELSE 'out' END AS direction, CASE WHEN destino = 'NATION_1' THEN origem ELSE destino END AS counterpart, n FROM flows WHERE 'NATION_1' IN (origem, destino)) GROUP BY ALL")
def d31_flow_directions(spark, sf_dir):
    f = flows(spark, sf_dir).filter("'NATION_1' in (origem, destino)")
    way = F.when(F.col("origem") == F.col("destino"), "local").when(F.col("destino") == "NATION_1", "in").otherwise("out")
    return f.groupBy(way.alias("direction"), F.when(F.col("destino") == "NATION_1", F.col("origem")).otherwise(F.col("destino")).alias("counterpart")).agg(F.sum("n").alias("n"))


@query("WITH fact AS FACT, c AS (SELECT *, preco_q - lag(preco_q) OVER (PARTITION BY product, uf ORDER BY periodo) AS d FROM fact) SELECT product, CAST(sum(preco_q) AS DOUBLE) / count(*) AS mean_q, min(preco_q) AS low, max(preco_q) AS high, CAST(sum(d) AS DOUBLE) / count(d) AS mean_change FROM c GROUP BY product")
def d30_series_summary(spark, sf_dir):
    c = fact(spark, sf_dir).withColumn("d", F.col("preco_q") - F.lag("preco_q").over(Window.partitionBy(*KEY).orderBy("periodo")))
    return c.groupBy("product").agg((F.sum("preco_q") / F.count("*")).alias("mean_q"), F.min("preco_q").alias("low"), F.max("preco_q").alias("high"), (F.sum("d") / F.count("d")).alias("mean_change"))


@query("WITH fact AS FACT SELECT 'real' AS kind, product, uf, periodo FROM fact WHERE ano < 2001 UNION ALL SELECT 'atual', product, uf, periodo FROM fact WHERE ano = 2001")
def g1_union_all(spark, sf_dir):
    f = fact(spark, sf_dir).select("product", "uf", "periodo", "ano")
    return f.filter("ano < 2001").withColumn("kind", F.lit("real")).unionByName(f.filter("ano = 2001").withColumn("kind", F.lit("atual"))).drop("ano")


@query("SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def g2_union(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).union(table(spark, sf_dir, "customer").select("c_nationkey")).distinct()


@query("SELECT DISTINCT p_type FROM part")
def g3_distinct(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_type").distinct()


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_totalprice DESC NULLS LAST, o_orderkey")
def f9_status_order(spark, sf_dir):
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return table(spark, sf_dir, "orders").orderBy(rank, F.desc_nulls_last("o_totalprice"), "o_orderkey").select("o_orderkey", "o_orderstatus")
