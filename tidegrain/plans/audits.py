"""Audits: completeness, runs of missing months, entities without facts, reconciliation, rule changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrain.functions import text
from tidegrain.operators import tables, windows
from tidegrain.plans.composite import LIVE, MONTH, PERIOD, YEAR, seasonality
from tidegrain.plans.facts import FACT, fact, table
from tidegrain.plans.kit import registrar
from tidegrain.plans.window_queries import NAMED, STATUS, TRAILING

QUERIES, SQL, query = registrar()

KEY = ["product", "uf"]
#: A finer product for audits, so that gaps occur: name and brand.
NAMED_PRODUCT = "concat_ws(' ', p_name, p_brand)"
_FINE = FACT.replace("p_brand AS product", "p_name || ' ' || p_brand AS product")

# Verdicts of the audits.
NO_BASE, VANISHED, PARTLY, COMPLETE = "SEM BASE", "SUMIU", "COBERTURA PARCIAL", "OK"


def completeness(f: DataFrame, entities: DataFrame, year: int, month: int) -> DataFrame:
    """Of each entity (keys of entities) the months with a price in the year before and in the year so far, and a verdict.

    Entities without any price are there, with zeros.
    """
    months = f.filter((F.col("ano") == year - 1) | ((F.col("ano") == year) & (F.col("mes") <= month)))
    wide = months.groupBy(*entities.columns).pivot("ano", [year - 1, year]).agg(F.count_distinct("mes"))
    x = entities.join(wide, entities.columns, "left").select(*entities.columns, F.coalesce(F.col(f"`{year - 1}`"), F.lit(0)).alias("base_months"), F.coalesce(F.col(f"`{year}`"), F.lit(0)).alias("months"))
    verdict = F.when(F.col("base_months") == 0, NO_BASE).when(F.col("months") == 0, VANISHED).when(F.col("months") < F.col("base_months"), PARTLY).otherwise(COMPLETE)
    return x.withColumn("verdict", verdict)


@query(
    f"""WITH fact AS {_FINE}, e AS (SELECT product, uf FROM (SELECT DISTINCT p_name || ' ' || p_brand AS product FROM part), (SELECT n_name AS uf FROM nation)),
m AS (SELECT product, uf, count(DISTINCT mes) FILTER (ano = {YEAR - 1}) AS base_months, count(DISTINCT mes) FILTER (ano = {YEAR} AND mes <= {MONTH}) AS months FROM fact GROUP BY ALL),
x AS (SELECT product, uf, coalesce(base_months, 0) AS base_months, coalesce(months, 0) AS months FROM e LEFT JOIN m USING (product, uf))
SELECT *, CASE WHEN base_months = 0 THEN '{NO_BASE}' WHEN months = 0 THEN '{VANISHED}' WHEN months < base_months THEN '{PARTLY}' ELSE '{COMPLETE}' END AS verdict FROM x"""
)
def j45_completeness(spark, sf_dir):
    """Every product and state; the states are few and go with each product as an array, so there is no cross join."""
    states = table(spark, sf_dir, "nation").agg(F.collect_set("n_name").alias("all")).select("all").scalar()
    entities = table(spark, sf_dir, "part").select(F.expr(NAMED_PRODUCT).alias("product")).distinct().select("product", F.explode(states).alias("uf"))
    return completeness(_fine(spark, sf_dir), entities, YEAR, MONTH)


def _fine(spark, sf_dir) -> DataFrame:
    return fact(spark, sf_dir, NAMED_PRODUCT)


def missing_runs(f: DataFrame, keys: list[str], last: int) -> DataFrame:
    """Runs of periods without a row between a key's first row and last: where each begins and how long it is."""
    w = Window.partitionBy(*keys).orderBy("periodo")
    following = F.coalesce(F.lead("periodo").over(w), F.lit(last + 1))
    rows = f.filter(F.col("periodo") <= last).select(*keys, "periodo").distinct()
    gap = rows.withColumn("length", following - F.col("periodo") - 1).filter("length > 0")
    return gap.select(*keys, (F.col("periodo") + 1).alias("first"), "length")


@query(f"WITH fact AS FACT, g AS (SELECT product, uf, CAST(p AS INTEGER) AS p FROM (SELECT product, uf, min(periodo) AS a FROM fact WHERE periodo <= {PERIOD} GROUP BY ALL), LATERAL (SELECT unnest(range(a, {PERIOD} + 1)) AS p)), m AS (SELECT g.*, p - row_number() OVER (PARTITION BY product, uf ORDER BY p) AS island FROM g WHERE NOT EXISTS (SELECT 1 FROM fact f WHERE f.product = g.product AND f.uf = g.uf AND f.periodo = g.p)) SELECT product, uf, min(p) AS first, CAST(count(*) AS INTEGER) AS length FROM m GROUP BY product, uf, island")
def j45_missing_runs(spark, sf_dir):
    return missing_runs(fact(spark, sf_dir), KEY, PERIOD)


#: Names that explain why a product was never seen, as patterns in order.
REASONS = (("ring|gear", "Provável produto de nicho"), ("red|cold", "Produto importado: coleta mais rara"))


@query(f"SELECT p_partkey, p_name, CASE " + " ".join(f"WHEN regexp_matches(p_name, '{p}') THEN '{r}'" for p, r in REASONS) + f" ELSE 'Suspeito: verificar a coleta' END AS reason FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND year(l_shipdate) = {YEAR})")
def j45_never_collected(spark, sf_dir):
    """Products without any price in the year, and what may explain it."""
    seen = table(spark, sf_dir, "lineitem").filter(F.year("l_shipdate") == YEAR).select(F.col("l_partkey").alias("p_partkey"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return tables.without(p, seen, ["p_partkey"]).withColumn("reason", text.by_rules(F.col("p_name"), REASONS, F.lit("Suspeito: verificar a coleta")))


# Verdicts of the reconciliation.
OK, UNREADABLE, OTHER_PRICE, OTHER_PERIOD, RETAIL_MISSING, NOT_FOUND = "OK_PRECO_E_ANO", "PRECO_NAO_PARSEAVEL", "DIVERGENCIA_PRECO", "DIVERGENCIA_ANO", "AUSENTE_B2C", "NAO_ENCONTRADO"


def audited(raw: DataFrame, known: DataFrame, stored: DataFrame) -> DataFrame:
    """Raw rows with the stored name that they go by and a verdict.

    raw has produto, classificacao, uf, ano, mes and valor as text.  known has
    name and retail of the products there are, stored has name, uf, ano, mes
    and preco_q.  A row goes by "PRODUTO - CLASSIFICACAO" if there is such a
    price in its month, else by "PRODUTO"; without a price in the month, by
    one in another (a difference of the period), else it is missing.
    """
    plain = text.collapsed(F.col("produto"))
    full = F.when(text.first_filled(F.col("classificacao")).isNotNull(), F.concat(plain, F.lit(" - "), text.collapsed(F.col("classificacao"))))
    x = raw.withColumn("_row", windows.content_key(raw)).withColumns({"_uf": F.upper(F.trim("uf")), "_ano": F.col("ano").try_cast("int"), "_mes": F.col("mes").try_cast("int"), "_q": (text.decimal_price(F.col("valor")) * 10000).cast("long")})
    tries = x.dropDuplicates(["_row"]).select("_row", "_uf", "_ano", "_mes", F.posexplode(F.array(full, plain)).alias("_try", "name")).filter("name is not null")
    of = stored.select("name", F.col("uf").alias("_uf"), F.col("ano").alias("s_ano"), F.col("mes").alias("s_mes"), "preco_q")
    same = (F.col("_ano") == F.col("s_ano")) & (F.col("_mes") == F.col("s_mes"))
    hit = tries.join(of, ["name", "_uf"]).withColumn("_same", same)
    distance = F.abs((F.col("_ano") - F.col("s_ano")) * 12 + F.col("_mes") - F.col("s_mes"))
    best = hit.groupBy("_row").agg(F.min_by(F.struct("name", "_same", "preco_q"), F.struct(~F.col("_same"), "_try", distance, "s_ano", "s_mes", "preco_q")).alias("hit"))
    sold = tries.join(known.select("name", "retail"), "name").groupBy("_row").agg(F.min_by("retail", "_try").alias("retail"))
    out = x.join(best, "_row", "left").join(sold, "_row", "left")
    incomplete = plain.isNull() | (plain == "") | F.col("_uf").isNull() | (F.col("_uf") == "") | F.col("_ano").isNull() | F.col("_mes").isNull()
    verdict = (
        F.when(incomplete, NOT_FOUND)
        .when(F.col("hit").isNull(), F.when(F.coalesce("retail", F.lit(False)), RETAIL_MISSING).otherwise(NOT_FOUND))
        .when(~F.col("hit._same"), OTHER_PERIOD)
        .when(F.col("_q").isNull(), UNREADABLE)
        .when(F.abs(F.col("_q") - F.col("hit.preco_q")) > 1, OTHER_PRICE)
        .otherwise(OK)
    )
    return out.select(*raw.columns, F.col("hit.name").alias("found"), verdict.alias("verdict"))


#: The query's raw rows: the fact with some prices unreadable, changed, or of months and states that the store lacks.
_NAME = "upper(product) || CASE WHEN mes % 2 = 0 THEN ' - GRANEL' ELSE '' END"
_VALUE = "CASE WHEN mes = 5 THEN 'n/d' ELSE CAST((preco_q + CASE WHEN mes = 7 THEN 500 ELSE 0 END) // 10000 AS VARCHAR) || ',' || lpad(CAST((preco_q + CASE WHEN mes = 7 THEN 500 ELSE 0 END) % 10000 AS VARCHAR), 4, '0') END"


@query(
    f"""WITH fact AS FACT, raw AS (SELECT product AS produto, CASE WHEN mes % 2 = 0 THEN 'granel' ELSE '' END AS classificacao, uf, ano, CASE WHEN mes = 11 THEN 99 ELSE mes END AS mes, {_VALUE} AS valor, preco_q + CASE WHEN mes = 7 THEN 500 ELSE 0 END AS q FROM fact WHERE ano >= {YEAR - 1}),
st AS (SELECT {_NAME} AS name, uf, ano, mes, preco_q FROM (SELECT *, upper(product) AS pu FROM fact) WHERE ano >= {YEAR - 1} AND obs % 4 <> 3 AND NOT (uf LIKE 'NATION_1%' AND upper(product) LIKE 'BRAND#1%')),
n AS (SELECT *, row_number() OVER () AS id FROM raw), t AS (SELECT n.*, unnest([CASE WHEN classificacao <> '' THEN upper(produto) || ' - GRANEL' END, upper(produto)]) AS name, unnest([0, 1]) AS k FROM n),
h AS (SELECT t.id, t.name, st.ano = t.ano AND st.mes = t.mes AS same, st.preco_q, row_number() OVER (PARTITION BY t.id ORDER BY (st.ano = t.ano AND st.mes = t.mes) DESC, t.k, abs((t.ano - st.ano) * 12 + t.mes - st.mes), st.ano, st.mes, st.preco_q) AS r FROM t JOIN st ON st.name = t.name AND st.uf = t.uf)
SELECT produto, classificacao, n.uf, CAST(n.ano AS VARCHAR) AS ano, CAST(n.mes AS VARCHAR) AS mes, valor, h.name AS found,
  CASE WHEN h.id IS NULL THEN CASE WHEN produto LIKE 'Brand#11%' THEN '{NOT_FOUND}' ELSE '{RETAIL_MISSING}' END WHEN NOT same THEN '{OTHER_PERIOD}' WHEN valor = 'n/d' THEN '{UNREADABLE}' WHEN abs(q - h.preco_q) > 1 THEN '{OTHER_PRICE}' ELSE '{OK}' END AS verdict
FROM n LEFT JOIN h ON h.id = n.id AND h.r = 1"""
)
def j49_verdicts(spark, sf_dir):
    """All raw rows of two years against the stored ones."""
    f = fact(spark, sf_dir).filter(F.col("ano") >= YEAR - 1)
    shown = F.col("preco_q") + F.when(F.col("mes") == 7, 500).otherwise(0)
    value = F.when(F.col("mes") == 5, "n/d").otherwise(F.concat(F.floor(shown / 10000).cast("string"), F.lit(","), F.lpad((shown % 10000).cast("string"), 4, "0")))
    loose = F.col("mes") % 2 == 0
    raw = f.select(F.col("product").alias("produto"), F.when(loose, "granel").otherwise("").alias("classificacao"), "uf", F.col("ano").cast("string").alias("ano"), F.when(F.col("mes") == 11, 99).otherwise(F.col("mes")).cast("string").alias("mes"), value.alias("valor"))
    name = F.concat(F.upper("product"), F.when(loose, " - GRANEL").otherwise(""))
    there = (F.col("obs") % 4 != 3) & ~(F.col("uf").startswith("NATION_1") & F.upper("product").startswith("BRAND#1"))
    known = f.select(F.upper("product").alias("name"), (~F.col("product").startswith("Brand#11")).alias("retail")).distinct()
    return audited(raw, known, f.filter(there).select(name.alias("name"), "uf", "ano", "mes", "preco_q"))


#: Share of rows, in hundredths, that a rule change may alter.
GATE = 25


def gate(compared: DataFrame, old: str, new: str, groups: list[str], percent: int = GATE) -> DataFrame:
    """Of each group the rows, those whose status would change, and whether that many may."""
    n, changed = F.count("*"), F.count_if(~F.col(old).eqNullSafe(F.col(new)))
    return compared.groupBy(*groups).agg(n.alias("rows"), changed.alias("changed")).withColumn("passes", F.col("changed") * 100 <= F.col("rows") * percent)


def require(gates: DataFrame) -> DataFrame:
    """The gates, or the end of the job if one does not pass."""
    stop = F.raise_error(F.concat(F.lit("a rule change alters "), F.col("changed").cast("string"), F.lit(" of "), F.col("rows").cast("string"), F.lit(" rows"))).cast("boolean")
    return gates.withColumn("passes", F.when(F.col("passes"), True).otherwise(stop))


@query(f"WITH fact AS FACT, {LIVE}, o AS (SELECT product, uf, periodo, {STATUS} AS status FROM (SELECT *, {TRAILING} FROM fact {NAMED})) SELECT live.region, live.ano, count(*) AS rows, count(*) FILTER (live.status IS DISTINCT FROM o.status) AS changed, count(*) FILTER (live.status IS DISTINCT FROM o.status) * 100 <= count(*) * {GATE} AS passes FROM live JOIN o USING (product, uf, periodo) GROUP BY ALL")
def j41_gate(spark, sf_dir):
    from tidegrain.functions import rules

    s = seasonality(fact(spark, sf_dir))
    old = rules.mean_band(F.col("preco_q"), F.col("total"), F.col("n"))
    return gate(s.select("region", "ano", F.col("status").alias("new"), old.alias("old")), "old", "new", ["region", "ano"])


# What injected prices are called.
PROXY_SOURCE, EVERYWHERE = "FLUXO_PROXY", "GERAL"


def lacking(f: DataFrame, flows: DataFrame, products: DataFrame, states: list[str]) -> DataFrame:
    """The dry run: product, uf and suppliers (of the flows, joined) of every product that one of the states has no price of."""
    grid = products.select("product").distinct().select("product", F.explode(F.array(*map(F.lit, states))).alias("uf"))
    gaps = tables.without(grid, f, KEY)
    names = flows.groupBy("product", F.col("destino").alias("uf")).agg(F.array_join(F.array_sort(F.collect_set("origem")), ", ").alias("suppliers"))
    return gaps.join(names, KEY, "left").withColumn("suppliers", F.coalesce("suppliers", F.lit("sem_fluxo")))


def injected(f: DataFrame, flows: DataFrame, products: DataFrame, states: list[str], years: list[int], spread: int = 10) -> DataFrame:
    """Proxy prices of all months of some years for what lacking() lists: product, uf, supplier, mean_q, ano, mes and preco_q.

    A price is the mean of the supplier with most units of the flow, else of
    the state with most prices of the product (ties: by name), else of all
    prices, moved by up to spread percent by a hash of the key, so that a run
    that is repeated gives the same prices.  Products without any price get
    none.
    """
    gaps = lacking(f, flows, products, states).select(*KEY)
    by_flow = windows.top_per_key(flows.filter("origem <> destino").select("product", F.col("destino").alias("uf"), "origem", "n"), KEY, [F.desc("n"), F.asc("origem")]).select(*KEY, F.col("origem").alias("by_flow"))
    own = f.groupBy("product", F.col("uf").alias("origem")).agg(F.sum("preco_q").alias("s"), F.count("*").alias("k"))
    # A lacking state has no price of the product, so the best state is another one.
    most = windows.top_per_key(own, ["product"], [F.desc("k"), F.asc("origem")]).select("product", F.col("origem").alias("by_rows"))
    overall = f.groupBy("product").agg((F.sum("preco_q") / F.count("*")).alias("overall"))
    x = gaps.join(by_flow, KEY, "left").join(most, "product", "left").withColumn("origem", F.coalesce("by_flow", "by_rows"))
    x = x.join(own, ["product", "origem"], "left").join(overall, "product").withColumn("mean_q", F.coalesce(F.col("s") / F.col("k"), F.col("overall")))
    x = x.withColumn("supplier", F.when(F.col("s").isNotNull(), F.col("origem")).otherwise(EVERYWHERE))
    months = x.select(*KEY, "supplier", "mean_q", F.explode(F.array(*map(F.lit, years))).alias("ano")).select("*", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("mes"))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "product", "uf", "ano", "mes")), 1, 8), 16, 10).cast("long")
    parts = spread * 200 + 1
    return months.withColumn("preco_q", F.floor(F.col("mean_q") * (F.lit(10000 - spread * 100) + h % parts) / 10000).cast("long"))


#: States of the query that lack prices.
NEEDY = ["NATION_1", "NATION_4", "NATION_7", "NATION_15"]
_FINE_FLOWS = """flows AS (SELECT p_name || ' ' || p_brand AS product, a.n_name AS origem, b.n_name AS destino, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey GROUP BY ALL)"""
_GAPS = f"""fact AS {_FINE}, {_FINE_FLOWS}, pr AS (SELECT DISTINCT p_name || ' ' || p_brand AS product FROM part), gaps AS (SELECT product, uf FROM (SELECT product, uf FROM pr, (SELECT unnest({NEEDY}) AS uf)) ANTI JOIN fact USING (product, uf))"""


def _gap_tables(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")  # noqa: E741
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    at = lambda t, key, of, name: table(spark, sf_dir, t).select(key, F.col(of).alias("n_nationkey")).join(n, "n_nationkey").select(key, F.col("n_name").alias(name))
    buyers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")).join(at("customer", "c_custkey", "c_nationkey", "destino"), "c_custkey")
    products = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.expr(NAMED_PRODUCT).alias("product"))
    sellers = at("supplier", "s_suppkey", "s_nationkey", "origem").withColumnRenamed("s_suppkey", "l_suppkey")
    flows = l.join(buyers, "l_orderkey").join(sellers, "l_suppkey").join(products, "l_partkey").groupBy("product", "origem", "destino").agg(F.count("*").alias("n"))
    return _fine(spark, sf_dir), flows, products


@query(f"WITH {_GAPS} SELECT product, uf, coalesce(s, 'sem_fluxo') AS suppliers FROM gaps LEFT JOIN (SELECT product, destino AS uf, string_agg(DISTINCT origem, ', ' ORDER BY origem) AS s FROM flows GROUP BY ALL) USING (product, uf)")
def j28_dry_run(spark, sf_dir):
    return lacking(*_gap_tables(spark, sf_dir), NEEDY)


@query(
    f"""WITH {_GAPS}, bf AS (SELECT product, destino AS uf, origem AS by_flow FROM flows WHERE origem <> destino QUALIFY row_number() OVER (PARTITION BY product, destino ORDER BY n DESC, origem) = 1),
own AS (SELECT product, uf AS origem, CAST(sum(preco_q) AS BIGINT) AS s, count(*) AS k FROM fact GROUP BY ALL), br AS (SELECT product, origem AS by_rows FROM own QUALIFY row_number() OVER (PARTITION BY product ORDER BY k DESC, origem) = 1),
o AS (SELECT product, CAST(sum(preco_q) AS BIGINT)::DOUBLE / count(*) AS overall FROM fact GROUP BY ALL),
x AS (SELECT gaps.product, gaps.uf, coalesce(by_flow, by_rows) AS origem, overall FROM gaps LEFT JOIN bf USING (product, uf) LEFT JOIN br USING (product) JOIN o USING (product)),
y AS (SELECT x.product, x.uf, CASE WHEN own.s IS NULL THEN '{EVERYWHERE}' ELSE x.origem END AS supplier, coalesce(own.s::DOUBLE / own.k, overall) AS mean_q FROM x LEFT JOIN own ON own.product = x.product AND own.origem = x.origem)
SELECT product, uf, supplier, mean_q, CAST(a AS INTEGER) AS ano, CAST(m AS INTEGER) AS mes, CAST(floor(mean_q * (9000 + CAST('0x' || left(md5(product || '|' || uf || '|' || a || '|' || m), 8) AS BIGINT) % 2001) / 10000) AS BIGINT) AS preco_q FROM y, range({YEAR - 1}, {YEAR + 1}) r(a), range(1, 13) q(m)"""
)
def j28_injected(spark, sf_dir):
    return injected(*_gap_tables(spark, sf_dir), NEEDY, [YEAR - 1, YEAR])
