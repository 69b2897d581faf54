"""Scalar functions on names, units and raw fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrain.functions import period, rules, text
from tidegrain.operators import windows
from tidegrain.plans.facts import fact, table
from tidegrain.plans.kit import registrar

QUERIES, SQL, query = registrar()

#: Fixed values for the queries: base products and retail categories by name pattern.
BASES = (("^(blue|new)", "BLUE"), ("plate$", "PLATE"), ("^(red|hot)", "RED"), ("gear", "GEAR"))
CATEGORIES = (("promo|small", "INSUMO"), ("standard|large", "MAQUINARIO"))
UNITS = {"f": ("kg", 1.0), "o": ("cx", 20.0), "p": ("un", 0.25)}
KEYWORDS = {"frutas": ("plate", "cup", "rod"), "verdes": ("widget", "gear")}


def _case(column, pairs, otherwise="NULL"):
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}', 'i') THEN '{v}'" for p, v in pairs) + f" ELSE {otherwise} END"


@query("SELECT l_orderkey, l_linenumber, TRY_CAST(nullif(replace(trim(replace(CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS VARCHAR), '.', ',')), ',', '.'), '') AS DECIMAL(14,4)) AS price FROM lineitem")
def h1_decimal_price(spark, sf_dir):
    raw = F.replace(F.col("l_extendedprice").cast("decimal(14,2)").cast("string"), F.lit("."), F.lit(","))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.decimal_price(raw).alias("price"))


@query("WITH fact AS FACT SELECT DISTINCT CAST(ano AS VARCHAR) || '-' || lpad(CAST(mes AS VARCHAR), 2, '0') AS period, ano, mes FROM fact")
def h2_period_text(spark, sf_dir):
    p = fact(spark, sf_dir).select(period.text(F.col("ano"), F.col("mes")).alias("period")).distinct()
    y, m = period.split(F.col("period"))
    return p.select("period", y.alias("ano"), m.alias("mes"))


@query(
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(upper(trim(replace(text, 'ß', 'ss'))), 'ÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇ', 'AAAAAEEEEIIIIOOOOOUUUUC'), '\s+', ' ', 'g'), '\s+-\s+', ' ', 'g'), '([A-Z])-([A-Z])', '\1 \2', 'g'), '([A-Z])-([A-Z])', '\1 \2', 'g'), '\*+', '', 'g'), ' -') AS key
FROM documents"""
)
def h4_name_key(spark, sf_dir):
    """Keys of whole texts of all languages; upper case of a sharp s is two letters, which DuckDB leaves out."""
    return table(spark, sf_dir, "documents").select("doc_id", text.name_key(F.col("text")).alias("key"))


@query(f"SELECT p_partkey, coalesce({_case('p_name', BASES)}, p_name) AS base FROM part")
def h5_base_product(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.by_rules(F.col("p_name"), BASES, F.col("p_name")).alias("base"))


@query(
    "SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name || ' de massa-fina'), ' '), lambda w, i: CASE WHEN i > 1 AND w = 'de' THEN w ELSE array_to_string(list_transform(string_split(w, '-'), lambda p: upper(p[1:1]) || p[2:]), '-') END), ' ') AS title FROM part"
)
def h6_title_case(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.title_case(F.concat("p_name", F.lit(" de massa-fina"))).alias("title"))


@query("SELECT s_suppkey, trim(regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9à-ÿ ]', '', 'g'), ' +', ' ', 'g')) AS key FROM supplier")
def h7_match_key(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.match_key(F.col("s_name")).alias("key"))


@query("SELECT o_orderkey, CASE lower(o_orderstatus) WHEN 'f' THEN 'kg' WHEN 'o' THEN 'cx' WHEN 'p' THEN 'un' ELSE lower(o_orderstatus) END AS unit, CASE lower(o_orderstatus) WHEN 'f' THEN 1.0::DOUBLE WHEN 'o' THEN 20.0::DOUBLE WHEN 'p' THEN 0.25::DOUBLE END AS factor FROM orders")
def h8_unit(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.unit(F.col("o_orderstatus"), UNITS).alias("u")).select("o_orderkey", "u.unit", "u.factor")


@query("SELECT n_nationkey, sha256(n_name || '|' || CAST(n_regionkey AS VARCHAR)) AS row_hash, md5(n_name || '|' || CAST(n_regionkey AS VARCHAR)) AS dedup_key FROM nation")
def h9_row_hash(spark, sf_dir):
    c = (F.col("n_name"), F.col("n_regionkey"))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.row_hash(*c).alias("row_hash"), text.dedup_key(*c).alias("dedup_key"))


@query("SELECT p_partkey, upper(trim(regexp_replace(p_type, '\\s+', ' ', 'g'))) AS name, split_part(upper(p_name), ' ', 1) AS root FROM part")
def h11_collapsed(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.collapsed(F.col("p_type")).alias("name"), text.root_word(F.col("p_name")).alias("root"))


#: Words of varieties that are no root.
STOP = ("RED", "OLD", "COLD", "RING")


@query("SELECT p_partkey, split_part(trim(regexp_replace(upper(p_name), '\\b(RED|OLD|COLD|RING)\\b', ' ', 'g')), ' ', 1) AS root FROM part")
def h12_root_word(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.root_word(F.col("p_name"), STOP).alias("root"))


@query("SELECT p_partkey, CASE p_size % 6 WHEN 2 THEN p_name || '-HORTI' WHEN 4 THEN 'a b ' || p_name WHEN 5 THEN '' ELSE p_name END AS shown FROM part")
def h13_display_name(spark, sf_dir):
    """Names with a category suffix in several spellings, with pipes, with a hyphen of their own, with odd spaces, and empty before the pipe."""
    n, kind = F.col("p_name"), F.col("p_size") % 6
    noisy = F.when(kind == 0, F.concat(n, F.lit("  -  HORTI | x"))).when(kind == 1, F.concat(n, F.lit(" - horti  "))).when(kind == 2, F.concat(n, F.lit("-HORTI"))).when(kind == 3, F.concat(n, F.lit("  |  y | z")))
    noisy = noisy.when(kind == 4, F.concat(F.lit(" a\t b  "), n)).otherwise(F.concat(F.lit("|"), n))
    return table(spark, sf_dir, "part").select("p_partkey", text.display_name(noisy, ["HORTI"]).alias("shown"))


@query("SELECT p_partkey, CASE WHEN list_has_any(regexp_split_to_array(lower(p_name), '[^a-zà-ÿ0-9]+'), ['plate', 'cup', 'rod']) THEN 'frutas' WHEN list_has_any(regexp_split_to_array(lower(p_name), '[^a-zà-ÿ0-9]+'), ['widget', 'gear']) THEN 'verdes' WHEN p_brand = 'Brand#11' THEN 'marca' ELSE 'outros' END AS category FROM part")
def h14_keyword_category(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.keyword_category(F.col("p_name"), KEYWORDS, F.col("p_brand"), {"Brand#11": "marca"}).alias("category"))


@query(f"SELECT category, count(*) AS n FROM (SELECT {_case('p_type', CATEGORIES, chr(39) + 'ALIMENTO' + chr(39))} AS category FROM part) GROUP BY category")
def h16_categories(spark, sf_dir):
    return table(spark, sf_dir, "part").select(text.by_rules(F.col("p_type"), CATEGORIES, F.lit("ALIMENTO")).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(ts - INTERVAL 30 DAY AS DATE) AS cutoff, year(ts)::INTEGER AS ano FROM events")
def h19_cutoff(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", period.before(F.col("ts"), 30).cast("date").alias("cutoff"), F.year("ts").alias("ano"))


@query("WITH fact AS FACT SELECT product, len(list(DISTINCT mes)) AS n, list_sort(list_distinct(list_concat(list(mes) FILTER (WHERE ano = 1996), [1, 12]))) AS months FROM fact GROUP BY product")
def h20_arrays(spark, sf_dir):
    own = F.collect_list(F.when(F.col("ano") == 1996, F.col("mes")))
    g = fact(spark, sf_dir).groupBy("product").agg(F.size(F.collect_set("mes")).cast("long").alias("n"), F.array_sort(F.array_distinct(F.concat(own, F.array(F.lit(1), F.lit(12))))).alias("months"))
    return g.select("product", "n", "months")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, '{\"regra\":\"v2\",\"tipo\":\"' || event_type || '\"}' AS meta FROM events")
def h21_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.to_json(F.struct(F.lit("v2").alias("regra"), F.col("event_type").alias("tipo"))).alias("meta"))


@query("SELECT s_suppkey, abs(CAST(round(s_acctbal) AS BIGINT)) AS a, greatest(s_nationkey, 7) AS g, least(s_nationkey, 7) AS l, 100 // nullif(s_nationkey, 0) AS d FROM supplier")
def h22_math(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.abs(F.round("s_acctbal").cast("long")).alias("a"), F.greatest("s_nationkey", F.lit(7)).alias("g"), F.least("s_nationkey", F.lit(7)).alias("l"), F.expr("cast(100 div nullif(s_nationkey, 0) as int)").alias("d"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'fechado' WHEN 'O' THEN 'aberto' ELSE 'outro' END AS label, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS code FROM orders")
def h25_labels(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.labels(F.col("o_orderstatus"), {"F": "fechado", "O": "aberto"}, "outro").alias("label"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("code"))


@query("WITH fact AS FACT, m AS (SELECT product, uf, max(ano) AS y FROM fact GROUP BY ALL) SELECT product, uf, y < 2001 AS legacy, CASE WHEN y = 2001 THEN 'Preço coletado no ano corrente' WHEN 2001 - y = 1 THEN 'Preço real de ' || y || ' (há 1 ano)' ELSE 'Preço real de ' || y || ' (há ' || (2001 - y) || ' anos)' END AS message FROM m")
def h26_provenance(spark, sf_dir):
    m = fact(spark, sf_dir).groupBy("product", "uf").agg(F.max("ano").alias("y"))
    kind = F.when(F.col("y") == 2001, "REAL_ATUAL").otherwise("HISTORICO_BASE")
    return m.select("product", "uf", rules.is_legacy(F.col("y"), 2001).alias("legacy"), rules.provenance(kind, F.col("y"), F.lit(2001) - F.col("y")).alias("message"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'VERDE' ELSE 'AMARELO' END AS status FROM orders")
def h28_known_status(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.known_status(F.when(F.col("o_orderstatus") == "F", " verde ").otherwise(F.col("o_orderstatus"))).alias("status"))


@query("WITH fact AS FACT SELECT product, uf, ano, len(list(DISTINCT mes)) = 12 AS complete FROM fact GROUP BY product, uf, ano")
def h30_complete_grid(spark, sf_dir):
    g = fact(spark, sf_dir).groupBy("product", "uf", "ano").agg(F.collect_set("mes").alias("m"))
    return g.select("product", "uf", "ano", (F.size(F.array_intersect("m", F.sequence(F.lit(1), F.lit(12)))) == 12).alias("complete"))


DICE = """b AS (SELECT n_name AS a, list_distinct(list_transform(range(1, length(n_name)), lambda i: substr(n_name, i, 2))) AS x FROM nation),
d AS (SELECT p.a AS a, q.a AS b, 2.0::DOUBLE * len(list_intersect(p.x, q.x)) / (len(p.x) + len(q.x)) AS dice FROM b p JOIN b q ON p.a < q.a AND left(p.a, 1) = left(q.a, 1))"""


@query(f"WITH {DICE} SELECT a, b, dice FROM d")
def h31_dice(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("a"), F.left("n_name", F.lit(1)).alias("k"))
    both = n.join(n.withColumnRenamed("a", "b"), "k").filter("a < b")
    return both.select("a", "b", text.dice(F.col("a"), F.col("b")).alias("dice"))


@query("WITH s AS (SELECT p_name AS name, p_type, CASE WHEN upper(p_name) = 'RED' THEN 4.0::DOUBLE WHEN starts_with(upper(p_name), 'RED') THEN 3.0::DOUBLE WHEN contains(upper(p_name), 'RED') THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM part), b AS (SELECT name, max(score) AS score FROM s WHERE score > 0 GROUP BY name) SELECT name, score FROM b ORDER BY score DESC, name LIMIT 12")
def h32_search(spark, sf_dir):
    s = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), text.search_score(F.lit("red"), F.col("p_name"), 2.0).alias("score")).filter("score > 0")
    return windows.top_per_key(s, ["name"], [F.desc("score")]).orderBy(F.desc("score"), "name").limit(12)


FUZZY = "red wigdet"


@query(f"""WITH n AS (SELECT DISTINCT p_name AS name, upper(trim(p_name)) AS u, upper('{FUZZY}') AS q FROM part),
g AS (SELECT name, u, q, list_distinct(list_transform(range(1, length(u)), lambda i: substr(u, i, 2))) AS x, list_distinct(list_transform(range(1, length(q)), lambda i: substr(q, i, 2))) AS y FROM n),
d AS (SELECT name, u, q, CASE WHEN len(x) + len(y) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y)) END AS dice FROM g),
s AS (SELECT name, CASE WHEN u = q THEN 4.0::DOUBLE WHEN starts_with(u, q) THEN 3.0::DOUBLE WHEN contains(u, q) THEN 2.0::DOUBLE WHEN dice > 0.4 THEN dice ELSE 0.0::DOUBLE END AS score FROM d)
SELECT name, score FROM s WHERE score > 0""")
def h32_fuzzy_search(spark, sf_dir):
    """Every name that a misspelt query finds, by all levels of the search."""
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return n.select("name", text.search_score(F.lit(FUZZY), F.col("name")).alias("score")).filter("score > 0")
