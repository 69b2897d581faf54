"""Master data: election, consolidation of products and places over several tables, search by an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrain.functions import text
from tidegrain.operators import rekey
from tidegrain.plans.facts import table
from tidegrain.plans.kit import registrar
from tidegrain.sources import folders

QUERIES, SQL, query = registrar()

#: Categories of the queries in order of preference, and spellings of names by id, as the driver's names are all lower case.
CATEGORIES = ("STANDARD", "PROMO", "ECONOMY", "LARGE")
_SPELT = "CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name ELSE upper(left(p_name, 1)) || substr(p_name, 2) END"
_RANK = "CASE p_type " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CATEGORIES, 1)) + f" ELSE {len(CATEGORIES) + 1} END"


def _products(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.expr(_SPELT).alias("name"), "p_type", "p_brand").withColumn("key", F.concat_ws(" ", text.name_key(F.col("name")), "p_brand"))


@query(
    f"""WITH n AS (SELECT p_partkey, {_SPELT} AS name, p_type, upper(p_name) || ' ' || p_brand AS key, {_RANK} AS cat FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY cat, CASE WHEN name = upper(name) THEN 3 WHEN name = lower(name) THEN 2 ELSE 1 END, p_partkey) AS k FROM n)
SELECT r.p_partkey, r.name, r.key, m.p_partkey AS master, m.name AS master_name, m.p_type AS master_p_type FROM r JOIN r m ON m.key = r.key AND m.k = 1"""
)
def j23_election(spark, sf_dir):
    """Each product with the master of its key: preferred category, then legible spelling, then lowest id."""
    order = [rekey.category_rank(F.col("p_type"), CATEGORIES), rekey.legibility(F.col("name"))]
    return rekey.elected(_products(spark, sf_dir), "key", "p_partkey", order, ["name", "p_type"]).select("p_partkey", "name", "key", "master", "master_name", "master_p_type")


def _tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Prices by product, seller and month, and sources by product and return flag: two tables that refer to products and sellers."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    prices = l.groupBy("l_partkey", "l_suppkey", (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("periodo")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.count("*").alias("obs"))
    sources = l.groupBy("l_partkey", "l_returnflag").agg(F.count("*").alias("seen"))
    return prices, sources


_PRICES = """prices AS (SELECT l_partkey, l_suppkey, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS periodo, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS obs FROM lineitem GROUP BY ALL),
sources AS (SELECT l_partkey, l_returnflag, count(*) AS seen FROM lineitem GROUP BY ALL)"""
_MOST = """np AS (SELECT p.p_partkey, upper(p_name) || ' ' || p_brand AS key, count(prices.l_partkey) AS n FROM part p LEFT JOIN prices ON l_partkey = p_partkey GROUP BY ALL),
km AS (SELECT p_partkey AS old, first_value(p_partkey) OVER (PARTITION BY key ORDER BY n DESC, p_partkey) AS new, key FROM np)"""


def with_counts(records: DataFrame, key: str, facts: DataFrame, fact_key: str) -> DataFrame:
    """records with n_facts, how many rows of facts refer to each."""
    n = facts.groupBy(F.col(fact_key).alias(key)).agg(F.count("*").alias("n_facts"))
    return records.join(n, key, "left").withColumn("n_facts", F.coalesce("n_facts", F.lit(0)))


def consolidation(products: DataFrame, prices: DataFrame, sources: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Products of one key become the one with most prices (then the lowest id), in both tables that refer to them.

    Gives the judged tables (see rekey.fates()) by name, and the products that
    stay, named by their key.  Of prices that meet in a month the master's own
    stays, else that of the lowest id's.
    """
    election = rekey.elected(with_counts(products, "p_partkey", prices, "l_partkey"), "key", "p_partkey", [F.desc("n_facts")])
    mapping = folders.stored(rekey.key_map(election, "p_partkey"))
    judged = {
        "prices": rekey.fates(prices.withColumn("was", F.col("l_partkey")), mapping, "l_partkey", ["l_partkey", "l_suppkey", "periodo"], [F.asc("was")]),
        "sources": rekey.fates(sources.withColumn("was", F.col("l_partkey")), mapping, "l_partkey", ["l_partkey", "l_returnflag"], [F.asc("was")]),
    }
    stay = election.filter(F.col("p_partkey") == F.col("master"))
    gone = election.withColumn("fate", F.when(F.col("p_partkey") != F.col("master"), "DELETED").when(F.col("name") != F.col("key"), "RENAMED").otherwise(rekey.KEPT))
    return judged | {"products": gone}, stay.select("p_partkey", F.col("key").alias("name"))


_JUDGED = f"""{_PRICES}, {_MOST},
jp AS (SELECT new AS l_partkey, l_suppkey, periodo, cents, old, row_number() OVER (PARTITION BY new, l_suppkey, periodo ORDER BY (old <> new), old) AS k FROM prices JOIN km ON old = l_partkey),
js AS (SELECT new AS l_partkey, l_returnflag, seen, old, row_number() OVER (PARTITION BY new, l_returnflag ORDER BY (old <> new), old) AS k FROM sources JOIN km ON old = l_partkey)"""


@query(
    f"""WITH {_JUDGED}, a AS (SELECT 'prices' AS "table", CASE WHEN k > 1 THEN 'DROPPED' WHEN old <> l_partkey THEN 'MOVED' ELSE 'KEPT' END AS fate, cents AS v FROM jp
UNION ALL SELECT 'sources', CASE WHEN k > 1 THEN 'DROPPED' WHEN old <> l_partkey THEN 'MOVED' ELSE 'KEPT' END, seen FROM js
UNION ALL SELECT 'products', CASE WHEN old <> new THEN 'DELETED' WHEN {_SPELT} || ' ' <> key THEN 'RENAMED' ELSE 'KEPT' END, NULL FROM km JOIN part ON p_partkey = old)
SELECT "table", fate, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM a GROUP BY ALL"""
)
def j24_dry_run(spark, sf_dir):
    """What a consolidation of products would do to each table."""
    prices, sources = _tables(spark, sf_dir)
    judged, _ = consolidation(_products(spark, sf_dir), prices, sources)
    return rekey.report(judged["prices"], "prices", "cents").unionByName(rekey.report(judged["sources"], "sources", "seen")).unionByName(rekey.report(judged["products"], "products"))


@query(f"WITH {_JUDGED} SELECT l_partkey, l_suppkey, periodo, cents, old AS was FROM jp WHERE k = 1")
def j24_consolidated_prices(spark, sf_dir):
    prices, sources = _tables(spark, sf_dir)
    return rekey.moved(consolidation(_products(spark, sf_dir), prices, sources)[0]["prices"]).select("l_partkey", "l_suppkey", "periodo", "cents", "was")


def _place_map(spark, sf_dir, prices) -> DataFrame:
    """Sellers of one state and tenth of the balance become the one with most prices."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat_ws("|", F.col("s_nationkey").cast("string"), (F.col("s_suppkey") % 3).cast("string")).alias("place"))
    return folders.stored(rekey.key_map(rekey.elected(with_counts(s, "s_suppkey", prices, "l_suppkey"), "place", "s_suppkey", [F.desc("n_facts")]), "s_suppkey"))


_PLACES = f"""{_PRICES}, ns AS (SELECT s_suppkey, s_nationkey, s_suppkey % 3 AS part, count(prices.l_suppkey) AS n FROM supplier LEFT JOIN prices ON l_suppkey = s_suppkey GROUP BY ALL),
pm AS (SELECT s_suppkey AS old, first_value(s_suppkey) OVER (PARTITION BY s_nationkey, part ORDER BY n DESC, s_suppkey) AS new FROM ns),
jq AS (SELECT prices.*, new, row_number() OVER (PARTITION BY l_partkey, new, periodo ORDER BY (old <> new), old) AS k FROM prices JOIN pm ON old = l_suppkey)"""


@query(f"WITH {_PLACES} SELECT l_partkey, new AS l_suppkey, periodo, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(obs) AS BIGINT) AS obs FROM jq GROUP BY ALL")
def j36_pooled_prices(spark, sf_dir):
    """Prices under canonical places, those that meet added up."""
    prices, _ = _tables(spark, sf_dir)
    return rekey.pooled(prices, _place_map(spark, sf_dir, prices), "l_suppkey", ["l_partkey", "l_suppkey", "periodo"], ["cents", "obs"])


@query(f"WITH {_PLACES} SELECT 'prices' AS \"table\", CASE WHEN k > 1 THEN 'DROPPED' WHEN l_suppkey <> new THEN 'MOVED' ELSE 'KEPT' END AS fate, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM jq GROUP BY ALL")
def j36_dry_run(spark, sf_dir):
    """What the move to canonical places would do to prices if the first of those that meet stayed."""
    prices, _ = _tables(spark, sf_dir)
    judged = rekey.fates(prices.withColumn("was", F.col("l_suppkey")), _place_map(spark, sf_dir, prices), "l_suppkey", ["l_partkey", "l_suppkey", "periodo"], [F.asc("was")])
    return rekey.report(judged, "prices", "cents")


#: Dice similarity, in hundredths, that a name must exceed to be found by it.
LEAST = 40


def bigram_index(names: DataFrame, name: str) -> DataFrame:
    """A row for each bigram of each distinct name: name, folded, bigram, size, and its rank among the name's (the rarest first); the first has all bigrams."""
    own = names.select(F.col(name).alias("name")).filter("name is not null").distinct().withColumn("folded", text.fold(F.trim("name")))
    rows = own.withColumn("bigrams", text.bigrams(F.col("folded"))).select("name", "folded", "bigrams", F.size("bigrams").alias("size"), F.explode("bigrams").alias("bigram"))
    often = rows.groupBy("bigram").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy("often", "bigram"))
    return rows.join(often, "bigram").withColumn("rank", rank).withColumn("bigrams", F.when(F.col("rank") == 1, F.col("bigrams")))


def _reach(size: Column) -> Column:
    """How many of a set's rarest bigrams must hold one that a similar set shares: all but the fewest that both share, plus one.

    Similarity over LEAST needs more than LEAST / 200 of both sizes in common,
    and the other size is more than LEAST / (200 - LEAST) of this one.
    """
    fewest = F.floor(size * (LEAST * (200 - LEAST) + LEAST * LEAST) / F.lit(200 * (200 - LEAST))) + 1
    return size - fewest + 1


def searched(queries: DataFrame, index: DataFrame) -> DataFrame:
    """query, name and score of every name that each query finds (see text.search_score()); queries of one character find none.

    A similar name shares one of both sides' rarest bigrams, a name that holds
    the query has the query's rarest one; only such names are scored.
    """
    often = index.groupBy("bigram").agg(F.count("*").alias("often"))
    q = queries.select("query").filter("query is not null").distinct().withColumn("asked", text.fold(F.trim("query"))).withColumn("bigrams", text.bigrams(F.col("asked")))
    rows = q.select("query", "asked", F.size("bigrams").alias("q_size"), F.explode("bigrams").alias("bigram")).join(often, "bigram", "left")
    rows = rows.withColumn("q_rank", F.row_number().over(Window.partitionBy("query").orderBy(F.coalesce("often", F.lit(0)), "bigram")))
    both = rows.join(index, "bigram")
    sizes = (200 - LEAST) * F.least("size", "q_size") > LEAST * F.greatest("size", "q_size")
    similar = (F.col("q_rank") <= _reach(F.col("q_size"))) & (F.col("rank") <= _reach(F.col("size"))) & sizes
    holding = (F.col("q_rank") == 1) & (F.col("size") >= F.col("q_size")) & F.col("folded").contains(F.col("asked"))
    found = both.filter(similar | holding).select("query", "name").distinct()
    names = index.filter("rank = 1").select("name", "folded", F.col("bigrams").alias("theirs"))
    x = found.join(q, "query").join(names, "name")
    dice = F.lit(2.0) * F.size(F.array_intersect("bigrams", "theirs")) / (F.size("bigrams") + F.size("theirs"))
    score = F.when(F.col("folded") == F.col("asked"), 4.0).when(F.col("folded").startswith(F.col("asked")), 3.0).when(F.col("folded").contains(F.col("asked")), 2.0).when(dice > LEAST / 100, dice)
    return x.select("query", "name", score.alias("score")).filter("score is not null")


_MISSPELT = "substr(p_name, 1, 2) || substr(p_name, 4)"


@query(
    f"""WITH n AS (SELECT DISTINCT p_name || ' ' || p_brand AS name FROM part), q AS (SELECT DISTINCT {_MISSPELT} AS query FROM part UNION SELECT DISTINCT p_name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', -1) FROM part),
b AS (SELECT query, name, upper(query) AS u, upper(name) AS v, list_distinct(list_transform(range(1, length(query)), lambda i: substr(upper(query), i, 2))) AS x, list_distinct(list_transform(range(1, length(name)), lambda i: substr(upper(name), i, 2))) AS y FROM q, n),
s AS (SELECT query, name, CASE WHEN u = v THEN 4.0::DOUBLE WHEN starts_with(v, u) THEN 3.0::DOUBLE WHEN contains(v, u) THEN 2.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y)) END AS score FROM b)
SELECT query, name, score FROM s WHERE score > 0.4"""
)
def h32_index_search(spark, sf_dir):
    """Every product name and brand that product names, misspelt ones and single words find."""
    p = table(spark, sf_dir, "part").select("p_name", F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    asked = p.select(F.explode(F.array(F.expr(_MISSPELT), F.col("p_name"), F.element_at(F.split("p_name", " "), -1))).alias("query"))
    return searched(asked, folders.stored(bigram_index(p, "name")))
