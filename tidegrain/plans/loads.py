"""Imports, merges, purges, reconciliation, rankings and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrain.functions import rules
from tidegrain.operators import stats, tables, windows
from tidegrain.plans.basic import FLOWS, flows
from tidegrain.plans.composite import KEY, LIVE, PERIOD, YEAR, seasonality
from tidegrain.plans.facts import fact, table
from tidegrain.plans.kit import registrar
from tidegrain.plans.window_queries import NAMED, STATUS, TRAILING

QUERIES, SQL, query = registrar()


@query(f"WITH fact AS FACT SELECT product, uf, ano, mes, preco_q FROM fact WHERE ano < {YEAR} OR ano = {YEAR} AND mes <= 3")
def b9_up_to_period(spark, sf_dir):
    return fact(spark, sf_dir).filter(F.col("periodo") <= YEAR * 12 + 3).select(*KEY, "ano", "mes", "preco_q")


@query(f"WITH fact AS FACT, s AS (SELECT product, uf, max(periodo) AS newest FROM fact WHERE periodo <= {PERIOD} - 2 GROUP BY ALL) SELECT product, uf, CAST(p AS INTEGER) AS periodo FROM s, LATERAL (SELECT unnest(range(newest + 1, {PERIOD} + 1)) AS p)")
def c15_lateral_periods(spark, sf_dir):
    """Each series once for every period after its newest one, as a set per row."""
    s = fact(spark, sf_dir).filter(F.col("periodo") <= PERIOD - 2).groupBy(*KEY).agg(F.max("periodo").alias("newest"))
    return s.select(*KEY, F.explode(F.sequence(F.col("newest") + 1, F.lit(PERIOD))).alias("periodo"))


@query("SELECT c_custkey, s_suppkey FROM customer c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier WHERE s_acctbal > 0) s ON s_nationkey = c_nationkey AND k = 1")
def c21_first_match(spark, sf_dir):
    """Each customer with one seller of the own state: the first by balance, null where there is none."""
    first = windows.top_per_key(table(spark, sf_dir, "supplier").filter("s_acctbal > 0"), ["s_nationkey"], [F.desc("s_acctbal"), F.col("s_suppkey")])
    return table(spark, sf_dir, "customer").join(first, F.col("c_nationkey") == F.col("s_nationkey"), "left").select("c_custkey", "s_suppkey")


@query("WITH fact AS FACT, a AS (SELECT product, uf, CAST(sum(preco_q) AS DOUBLE) / count(*) AS v FROM fact WHERE ano = 2000 GROUP BY ALL), b AS (SELECT product, mes, preco_q / v * 1.55::DOUBLE AS ratio FROM fact JOIN a USING (product, uf) WHERE ano = 2001) SELECT product, mes, quantile_cont(ratio, 0.5) AS factor, count(*) AS n FROM b GROUP BY ALL HAVING count(*) >= 5 AND quantile_cont(ratio, 0.5) > 1.5")
def d22_median_over_floor(spark, sf_dir):
    """Median ratios of five observations and more, if over 1.5 (ratios are raised so that some are)."""
    f = fact(spark, sf_dir)
    a = f.filter("ano = 2000").groupBy(*KEY).agg((F.sum("preco_q") / F.count("*")).alias("v"))
    b = f.filter("ano = 2001").join(a, KEY).select("product", "mes", (F.col("preco_q") / F.col("v") * 1.55).alias("ratio"))
    return b.groupBy("product", "mes").agg(F.percentile("ratio", 0.5).alias("factor"), F.count("*").alias("n")).filter("n >= 5 and factor > 1.5")


_PRIORITY = "CASE WHEN new = 'VERMELHO' THEN 0 WHEN new = 'VERDE' THEN 1 ELSE 2 END"


@query(f"WITH fact AS FACT, {LIVE}, t AS (SELECT product, uf, periodo, preco_q, total, n, {STATUS} AS old FROM (SELECT *, {TRAILING} FROM fact {NAMED})), j AS (SELECT t.*, live.status AS new FROM t JOIN live USING (product, uf, periodo)) SELECT product, uf, periodo, old, new FROM j ORDER BY (old <> new) DESC, {_PRIORITY}, abs(preco_q * n - total) DESC, product, uf, periodo LIMIT 1000")
def f6_critical_rows(spark, sf_dir):
    """The thousand rows to look at first: status changed by the new rule, then dear ones, then the distance to the mean."""
    s = seasonality(fact(spark, sf_dir)).withColumn("old", rules.mean_band(F.col("preco_q"), F.col("total"), F.col("n"))).withColumnRenamed("status", "new")
    order = F.when(F.col("new") == rules.RED, 0).when(F.col("new") == rules.GREEN, 1).otherwise(2)
    return s.orderBy(F.desc(F.col("old") != F.col("new")), order, F.desc(F.abs(F.col("preco_q") * F.col("n") - F.col("total"))), *KEY, "periodo").limit(1000).select(*KEY, "periodo", "old", "new")


# Fixed values of the query: a keyword's macro-category, and the order in which categories are shown.
_MACRO = {"ring": "joias", "widget": "pecas", "bolt": "ferragens", "nut": "ferragens"}
_ORDER = ("ferragens", "pecas", "joias", "ausente", "outros")


def grouped_in_order(df: DataFrame, category: Column, name: str, order: tuple[str, ...] = _ORDER) -> DataFrame:
    """position, category and name, a row for each name, in the fixed order of categories; those without names have no row."""
    places = F.create_map(*[F.lit(x) for i, c in enumerate(order, 1) for x in (c, i)])
    rows = df.select(category.alias("category"), F.col(name).alias("name")).distinct()
    return rows.select(places[F.col("category")].alias("position"), "category", "name").orderBy("position", "name")


@query(f"WITH c AS (SELECT p_name, coalesce(map_extract(MAP {{{', '.join(f'{k!r}: {v!r}' for k, v in _MACRO.items())}}}, split_part(p_name, ' ', -1))[1], 'outros') AS category FROM part) SELECT list_position([{', '.join(map(repr, _ORDER))}], category)::INTEGER AS position, category, p_name AS name FROM c GROUP BY category, p_name ORDER BY position, name")
def h15_category_groups(spark, sf_dir):
    word = F.element_at(F.split("p_name", " "), -1)
    known = F.create_map(*[F.lit(x) for pair in _MACRO.items() for x in pair])
    return grouped_in_order(table(spark, sf_dir, "part"), F.coalesce(known[word], F.lit("outros")), "p_name")


@query("WITH fact AS FACT SELECT product, uf, periodo, preco_q, preco_q * (count(*) OVER w - 1) * 2 > (sum(preco_q) OVER w - preco_q) * 3 AS rejected FROM fact WINDOW w AS (PARTITION BY product, uf)")
def i11_own_mean(spark, sf_dir):
    """Prices over so many times the mean of the series' other months (the rule's factor is 5, here 1.5)."""
    return over_own_mean(fact(spark, sf_dir), 3, 2).select(*KEY, "periodo", "preco_q", "rejected")


def over_own_mean(df: DataFrame, times: int = 5, of: int = 1) -> DataFrame:
    """Adds rejected: over times / of the mean of the series' other rows; a row without others stays."""
    df = stats.leave_out(df, KEY, ["periodo"], "preco_q", "own")
    return df.withColumn("rejected", F.col("preco_q") * F.col("own_n") * of > F.col("own_total") * times).drop("own_n", "own_total")


_PAYLOAD = f"""{FLOWS}, months AS (SELECT p_brand AS product, a.n_name AS origem, b.n_name AS destino, CAST(month(o_orderdate) AS INTEGER) AS mes, o_orderpriority AS src FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey)"""


@query(f"WITH {_PAYLOAD} SELECT product, origem, destino, arg_max(src, struct_pack(k := k, s := src)) AS source, string_agg(DISTINCT mes, ',' ORDER BY mes) AS months FROM (SELECT *, count(*) OVER (PARTITION BY product, origem, destino, src) AS k FROM months) GROUP BY ALL")
def j30_flow_import(spark, sf_dir):
    """Flows from JSON documents of several sources: names are matched when normalised, the source with most data wins, months merge."""
    n = table(spark, sf_dir, "nation")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")  # noqa: E741
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.month("o_orderdate").alias("mes"), "o_orderpriority")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("destino")), "c_nationkey")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey").join(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("origem")), "s_nationkey")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    raw = l.join(o, "l_orderkey").join(c, "o_custkey").join(s, "l_suppkey").join(p, "l_partkey")
    # The documents as sources write them: names in any case and with spaces around them.
    name = F.concat(F.lit(" "), F.when(F.col("mes") % 2 == 0, F.upper("p_brand")).otherwise(F.lower("p_brand")), F.lit(" "))
    documents = raw.groupBy(name.alias("produto"), "origem", "destino", F.col("o_orderpriority").alias("fonte")).agg(F.collect_list("mes").alias("meses"))
    return imported_flows(documents.select(F.to_json(F.struct("*")).alias("payload")), table(spark, sf_dir, "part").select("p_brand").distinct(), "p_brand")


def imported_flows(documents: DataFrame, products: DataFrame, name: str) -> DataFrame:
    """product, origem, destino, source (that with most entries, then the last by name) and the distinct months of all sources."""
    key = lambda c: F.upper(F.trim(c))
    rows = documents.select(F.from_json("payload", "produto string, origem string, destino string, fonte string, meses array<int>").alias("d")).select("d.*")
    matched = rows.withColumn("_key", key(F.col("produto"))).join(products.select(F.col(name).alias("product"), key(F.col(name)).alias("_key")), "_key")
    keys = ["product", "origem", "destino"]
    parts = matched.groupBy(*keys, "fonte").agg(F.sum(F.size("meses")).alias("k"), F.array_distinct(F.flatten(F.collect_set("meses"))).alias("m"))
    out = parts.groupBy(*keys).agg(F.max_by("fonte", F.struct("k", "fonte")).alias("source"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("m")))).alias("m"))
    return out.select(*keys, "source", F.array_join("m", ",").alias("months"))


_UNITS = "CASE p_size % 3 WHEN 0 THEN '5 kg' WHEN 1 THEN 'cx' ELSE 'kg' END"


@query(f"WITH q AS (SELECT p_brand AS product, s_nationkey AS place, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS periodo, l_returnflag AS source, {_UNITS} AS unit, l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey) SELECT product, place, periodo, source, unit, CASE WHEN unit = '5 kg' THEN cents * 100 // 5 WHEN unit = 'cx' THEN cents * 100 // 20 ELSE cents * 100 END AS kg_q FROM q QUALIFY row_number() OVER (PARTITION BY product, place, periodo ORDER BY CASE source WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END, l_orderkey DESC, l_linenumber) = 1")
def j35_price_per_kg(spark, sf_dir):
    """One quotation for each product, place and month, by the priority of its source, as a price for a kilogram."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", F.col("l_returnflag").alias("source"))  # noqa: E741
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("product"), F.expr(_UNITS).alias("unit"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("place"))
    q = l.join(p, "l_partkey").join(s, "l_suppkey").withColumn("periodo", F.year("l_shipdate") * 12 + F.month("l_shipdate")).withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("long"))
    rank = F.when(F.col("source") == "N", 0).when(F.col("source") == "R", 1).otherwise(2)
    best = windows.top_per_key(q, ["product", "place", "periodo"], [rank, F.desc("l_orderkey"), F.col("l_linenumber")])
    kilograms = F.coalesce(F.regexp_extract("unit", r"^([0-9]+) kg", 1).try_cast("int"), F.when(F.col("unit") == "cx", 20), F.lit(1))
    return best.withColumn("k", kilograms).select("product", "place", "periodo", "source", "unit", F.expr("cents * 100 div k").alias("kg_q"))


def merged_and_kept(stored: DataFrame, landed: DataFrame, keys: list[str], order: list[str], cutoff: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The table after a merge, the landed rows to keep, and a dry run's counts.

    The newest landed row of a key replaces the stored one; landed rows that
    were merged before cutoff (done is true) go.
    """
    newest = windows.top_per_key(landed.filter("not done"), keys, [F.desc(c) for c in order])
    after = tables.prefer(newest.select(stored.columns), stored, keys, [])
    old = F.col("done") & (F.col("ts") < cutoff)
    known = newest.join(stored.select(*keys), keys, "left_semi").agg(F.count("*").alias("updated"))
    report = newest.agg(F.count("*").alias("merged")).join(known).join(landed.agg(F.count_if(old).alias("expired"), F.count_if(~old).alias("stays")))
    return after, landed.filter(~old), report


@query(
    """WITH e AS (SELECT user_id, event_type, event_id, ts, value, event_id % 3 = 0 AS done FROM events), cut AS (SELECT max(ts) - INTERVAL 20 DAY AS c FROM events),
newest AS (SELECT * FROM e WHERE NOT done QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1),
stored AS (SELECT user_id, event_type, max(value) AS value FROM e WHERE done GROUP BY ALL)
SELECT (SELECT count(*) FROM newest) AS merged, (SELECT count(*) FROM newest SEMI JOIN stored USING (user_id, event_type)) AS updated, (SELECT count(*) FROM e, cut WHERE done AND ts < c) AS expired, (SELECT count(*) FROM e, cut WHERE NOT (done AND ts < c)) AS stays,
(SELECT count(*) FROM (SELECT user_id, event_type FROM newest UNION SELECT user_id, event_type FROM stored)) AS rows_after"""
)
def j37_merge_and_retention(spark, sf_dir):
    """Dry run of a merge of landed rows by key, and of the removal of merged ones after twenty days."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value", (F.col("event_id") % 3 == 0).alias("done"))
    stored = e.filter("done").groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    cutoff = F.lit(e.agg(F.max("ts") - F.expr("INTERVAL 20 DAY")).scalar())
    after, _, report = merged_and_kept(stored, e, ["user_id", "event_type"], ["ts", "event_id"], cutoff)
    return report.join(after.agg(F.count("*").alias("rows_after")))


@query(
    f"""WITH fact AS FACT, legacy AS (SELECT product, uf, ano, mes, CASE WHEN obs % 4 = 0 THEN NULL ELSE preco_q END AS preco_q, 1 AS id FROM fact UNION ALL SELECT product, uf, ano, mes, preco_q + 1, 2 FROM fact WHERE mes = 6),
one AS (SELECT * FROM legacy QUALIFY row_number() OVER (PARTITION BY product, uf, ano, mes ORDER BY id) = 1),
more(product, uf, ano, mes, preco_q) AS (VALUES ('Brand#1', 'NATION_X', 2001, 1, 1000000), ('Brand#1', 'NATION_X', 2001, 2, 1100000))
SELECT product, uf, ano, mes, coalesce(o.preco_q, f.preco_q) AS preco_q, CASE WHEN o.preco_q IS NULL THEN 'PATCH' ELSE 'LEGADO' END AS origin FROM one o LEFT JOIN fact f USING (product, uf, ano, mes) UNION ALL SELECT *, 'BACKFILL' FROM more m WHERE NOT EXISTS (SELECT 1 FROM one o WHERE o.product = m.product AND o.uf = m.uf AND o.ano = m.ano AND o.mes = m.mes)"""
)
def j39_purge_and_patch(spark, sf_dir):
    """Duplicates of a month go (the oldest id stays), missing prices come from the fact, a fixed list fills what no row has."""
    f = fact(spark, sf_dir)
    month = [*KEY, "ano", "mes"]
    price = F.when(F.col("obs") % 4 == 0, F.lit(None)).otherwise(F.col("preco_q")).alias("preco_q")
    legacy = f.select(*month, price, F.lit(1).alias("id")).unionByName(f.filter("mes = 6").select(*month, (F.col("preco_q") + 1).alias("preco_q"), F.lit(2).alias("id")))
    one = windows.top_per_key(legacy, month, [F.col("id")]).drop("id")
    origin = one.withColumn("origin", F.when(F.col("preco_q").isNull(), "PATCH").otherwise("LEGADO"))
    patched = tables.updated(origin, f.select(*month, "preco_q").join(origin.filter("origin = 'PATCH'").select(*month), month), month, ["preco_q"])
    more = spark.createDataFrame([("Brand#1", "NATION_X", 2001, 1, 1000000, "BACKFILL"), ("Brand#1", "NATION_X", 2001, 2, 1100000, "BACKFILL")], "product string, uf string, ano int, mes int, preco_q long, origin string")
    return patched.unionByName(tables.without(more, one, month))


def reconciled(raw: DataFrame, stored: DataFrame, keys: list[str], value: str, size: int, seed: str, tolerance: int = 0) -> DataFrame:
    """A sample of raw rows (the first size by a seeded hash of the key) with the stored value and a verdict."""
    chosen = raw.withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), *keys))).orderBy("_h", *keys).limit(size).drop("_h")
    both = chosen.join(stored.select(*keys, F.col(value).alias("stored")), keys, "left")
    near = F.abs(F.col(value) - F.col("stored")) <= tolerance
    return both.select(*keys, F.col(value).alias("raw"), "stored", F.when(F.col("stored").isNull(), "AUSENTE").when(near, "OK").otherwise("DIVERGENTE").alias("verdict"))


@query("WITH fact AS FACT, db AS (SELECT product, uf, periodo, CASE WHEN mes = 7 THEN preco_q + 5 ELSE preco_q END AS preco_q FROM fact WHERE obs % 5 <> 0), pick AS (SELECT product, uf, periodo, preco_q FROM fact ORDER BY md5(concat_ws('|', 'audit', product, uf, periodo)), product, uf, periodo LIMIT 500) SELECT product, uf, periodo, pick.preco_q AS raw, db.preco_q AS stored, CASE WHEN db.preco_q IS NULL THEN 'AUSENTE' WHEN abs(pick.preco_q - db.preco_q) <= 2 THEN 'OK' ELSE 'DIVERGENTE' END AS verdict FROM pick LEFT JOIN db USING (product, uf, periodo)")
def j49_reconciliation(spark, sf_dir):
    """A sample, as the feature is one: five hundred raw rows by a seeded hash against the stored ones."""
    f = fact(spark, sf_dir)
    stored = f.filter("obs % 5 <> 0").select(*KEY, "periodo", F.when(F.col("mes") == 7, F.col("preco_q") + 5).otherwise(F.col("preco_q")).alias("preco_q"))
    return reconciled(f.select(*KEY, "periodo", "preco_q"), stored, [*KEY, "periodo"], "preco_q", 500, "audit", 2)


@query("WITH q AS (SELECT n_name AS uf, s_name AS place, p_brand AS product, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS periodo, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, sum(CAST(l_quantity AS BIGINT)) AS qty FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL) SELECT place, product, periodo, CAST(cents * 100 // qty AS BIGINT) AS preco_q FROM q WHERE uf = 'NATION_1' AND place ILIKE '%supplier#00000000%' QUALIFY row_number() OVER (PARTITION BY place, product ORDER BY periodo DESC) = 1")
def k5_place(spark, sf_dir):
    """The newest price of every product of the places of a state whose name has a part."""
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")  # noqa: E741
    n = tables.filtered(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("uf")), uf="NATION_1")
    s = tables.contains(table(spark, sf_dir, "supplier"), "s_name", "supplier#00000000").join(n, "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("place"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("product"))
    q = l.join(s, "l_suppkey").join(p, "l_partkey").groupBy("place", "product", (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("periodo"))
    q = q.agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.sum(F.col("l_quantity").cast("long")).alias("qty"))
    return windows.top_per_key(q, ["place", "product"], [F.desc("periodo")]).select("place", "product", "periodo", F.expr("cents * 100 div qty").alias("preco_q"))


@query(f"WITH {FLOWS}, w AS (SELECT product, origem, destino, n, count(*) OVER () AS total FROM flows WHERE destino = 'NATION_2' AND product ILIKE '%#1%') SELECT * FROM w ORDER BY n DESC, product, origem LIMIT 20 OFFSET 20")
def k6_flow_page(spark, sf_dir):
    """The second page of flows to a state, with the number of all that pass the filters."""
    f = tables.contains(tables.filtered(flows(spark, sf_dir), destino="NATION_2", origem=None), "product", "#1")
    page = tables.page(f, [F.desc("n"), F.col("product"), F.col("origem")], 2, 20)
    return page.join(F.broadcast(f.agg(F.count("*").alias("total")))).select("product", "origem", "destino", "n", "total")


def negated(df: DataFrame, column: str, most: int = 1_000_000_000) -> DataFrame:
    """The id with its sign turned, for derived rows; an id from most on would collide and ends the job."""
    checked = F.when(F.col(column).between(0, most - 1), -F.col(column)).when(F.col(column).isNotNull(), F.raise_error(F.lit("an id is too large to be negated")).cast("long"))
    return df.withColumn(column, checked)


@query("SELECT -o_orderkey AS id, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
def n5_negated_ids(spark, sf_dir):
    return negated(table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), "o_orderstatus"), "id")


def proofs(prices: DataFrame, states: DataFrame) -> DataFrame:
    """Of each rule that a migration must leave true: its name and how many rows break it."""
    rules_ = {
        "month_in_range": ~F.col("mes").between(1, 12),
        "period_coherent": F.col("ano") * 12 + F.col("mes") != F.col("periodo"),
        "positive_price": F.col("preco_q").isNull() | (F.col("preco_q") <= 0),
    }
    counts = prices.agg(*[F.count_if(c).alias(n) for n, c in rules_.items()])
    each = counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("broken")) for n in rules_])).alias("r")).select("r.*")
    twice = prices.groupBy(*KEY, "periodo").count().filter("count > 1").agg(F.lit("unique_month").alias("rule"), F.count("*").alias("broken"))
    lost = tables.without(prices, states, ["uf"]).agg(F.lit("known_state").alias("rule"), F.count("*").alias("broken"))
    return each.unionByName(twice).unionByName(lost)


def required(report: DataFrame) -> DataFrame:
    """The report of proofs(); a broken rule ends the job when it is read."""
    message = F.format_string("%s is broken by %d rows", "rule", "broken")
    return report.withColumn("broken", F.when(F.col("broken") == 0, F.col("broken")).otherwise(F.raise_error(message).cast("long")))


@query("WITH fact AS FACT SELECT 'month_in_range' AS rule, count(*) FILTER (NOT mes BETWEEN 1 AND 12) AS broken FROM fact UNION ALL SELECT 'period_coherent', count(*) FILTER (ano * 12 + mes <> periodo) FROM fact UNION ALL SELECT 'positive_price', count(*) FILTER (preco_q IS NULL OR preco_q <= 0) FROM fact UNION ALL SELECT 'unique_month', count(*) FROM (SELECT 1 FROM fact GROUP BY product, uf, periodo HAVING count(*) > 1) UNION ALL SELECT 'known_state', count(*) FROM fact WHERE uf NOT IN (SELECT n_name FROM nation)")
def n6_proofs(spark, sf_dir):
    return required(proofs(fact(spark, sf_dir), table(spark, sf_dir, "nation").select(F.col("n_name").alias("uf"))))


def with_varieties(prices: DataFrame, varieties: DataFrame) -> DataFrame:
    """prices, and rows (derived) of varieties at a percentage of their base product's price; a variety's own row stays.

    varieties has base, product and percent, and each product once.
    """
    rows = prices.select(*KEY, "periodo", "preco_q")
    made = rows.withColumnRenamed("product", "base").join(varieties, "base").select(*KEY, "periodo", F.expr("preco_q * percent div 100").alias("preco_q"), F.lit(True).alias("derived"))
    return tables.prefer(rows.withColumn("derived", F.lit(False)), made, [*KEY, "periodo"], [])


@query("WITH fact AS FACT, m(base, product, percent) AS (VALUES ('Brand#1', 'Brand#2', 110), ('Brand#1', 'Brand#1 MINI', 90), ('Brand#3', 'Brand#3 MINI', 80)), v AS (SELECT m.product, uf, periodo, preco_q * percent // 100 AS preco_q FROM fact JOIN m ON m.base = fact.product) SELECT product, uf, periodo, preco_q, false AS derived FROM fact UNION ALL SELECT *, true FROM v ANTI JOIN fact USING (product, uf, periodo)")
def j29_varieties(spark, sf_dir):
    varieties = spark.createDataFrame([("Brand#1", "Brand#2", 110), ("Brand#1", "Brand#1 MINI", 90), ("Brand#3", "Brand#3 MINI", 80)], "base string, product string, percent int")
    return with_varieties(fact(spark, sf_dir), varieties)
