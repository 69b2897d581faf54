"""Sources and sinks over files that Spark writes from the driver's tables and the library reads back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrain.functions import text
from tidegrain.operators import stats
from tidegrain.plans.composite import KEY, YEAR
from tidegrain.plans.facts import fact, table
from tidegrain.plans.kit import registrar
from tidegrain.sources import files, folders
from tidegrain.streaming import ingest

QUERIES, SQL, query = registrar()

#: Names with letters that the two encodings write differently.
_ACCENTED = "replace(replace(p_name, 'e', 'é'), 'a', 'ã')"


def _named(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("Id Produto"), F.expr(_ACCENTED).alias("Produto"), F.col("p_retailprice").cast("decimal(14,2)").cast("string").alias("Valor-KG"))


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS id_produto, {_ACCENTED} AS produto, CAST(CAST(p_retailprice AS DECIMAL(14,2)) AS VARCHAR) AS valor_kg FROM part")
def a1_delimited_scan(spark, sf_dir):
    """Files with a header, some in UTF-8 and some in ISO-8859-1, found out file by file."""
    folder, rows = folders.work_folder(spark), _named(spark, sf_dir)
    for rest, encoding in ((0, "UTF-8"), (1, "ISO-8859-1")):
        rows.filter(F.col("Id Produto").cast("long") % 2 == rest).write.mode("append").option("sep", ";").option("header", True).option("encoding", encoding).csv(folder)
    return files.read_delimited(spark, f"{folder}/*.csv").select("id_produto", "produto", "valor_kg")


@query("SELECT n_name AS uf, s_suppkey AS id, s_name AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def a2_json_arrays_scan(spark, sf_dir):
    """A file for each state that holds an array of its sellers."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    arrays = rows.groupBy("n_name").agg(F.to_json(F.collect_list(F.struct(F.col("n_name").alias("uf"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))).alias("value"))
    folder = folders.work_folder(spark)
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(folder)
    return files.read_json_array(spark, folder, T._parse_datatype_string("uf string, id long, name string")).select("uf", "id", "name")


@query("SELECT n_name || '.csv' AS file, count(*) AS n, min(s_suppkey) AS first FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL")
def a3_file_lineage(spark, sf_dir):
    """Rows of each of many files, by the name of the file they are from."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", "n_name", F.col("n_name").alias("part"))
    folder = folders.work_folder(spark)
    rows.repartition("part").write.option("header", True).option("sep", ";").partitionBy("part").csv(folder)
    found = files.read_delimited(spark, f"{folder}/*/*.csv", encoding="UTF-8", schema=T._parse_datatype_string("s_suppkey long, n_name string"))
    # The writer names files itself; a state is one file, so its name stands for the file's.
    return found.groupBy("_arquivo", "n_name").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("first")).select(F.concat("n_name", F.lit(".csv")).alias("file"), "n", "first")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_name WHEN p_partkey % 2 = 0 THEN p_brand END AS produto FROM part")
def a4_field_pick(spark, sf_dir):
    """The first filled of several columns, whatever their case."""
    blank = F.when(F.col("p_partkey") % 3 == 0, F.lit("  ")).otherwise(F.col("p_name"))
    df = table(spark, sf_dir, "part").select("p_partkey", blank.alias("NOME_Produto"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("Product"))
    return df.select("p_partkey", files.pick(df, "nome_produto", "produto", "product").alias("produto"))


@query("WITH fact AS FACT SELECT product, uf, periodo, preco_q FROM fact WHERE ano = 2001")
def a9_snapshot(spark, sf_dir):
    rows = fact(spark, sf_dir).filter(F.col("ano") == YEAR).select(*KEY, "periodo", "preco_q")
    return spark.read.parquet(files.write_snapshot(rows, folders.work_folder(spark), "precos", YEAR, 8, [*KEY, "periodo"]))


@query("SELECT n_name AS uf, count(*) AS written, count(*) AS read_back FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_nationkey < 5 GROUP BY ALL UNION ALL SELECT 'TODOS', count(*), count(*) FROM lineitem")
def a10_csv_sink(spark, sf_dir):
    """What the sink counted on the way, and what is in its files."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).filter("n_nationkey < 5")
    folder = folders.work_folder(spark)
    files.write_csv(s.select("s_suppkey", "n_name"), f"{folder}/s")
    n = files.write_csv(table(spark, sf_dir, "lineitem"), f"{folder}/l")
    read = lambda p: spark.read.option("header", True).csv(f"{folder}/{p}")
    by_state = read("s").groupBy(F.col("n_name").alias("uf")).agg(F.count("*").alias("written"), F.count("s_suppkey").alias("read_back"))
    return by_state.unionByName(read("l").agg(F.count("*").alias("read_back")).select(F.lit("TODOS").alias("uf"), F.lit(n).cast("long").alias("written"), "read_back"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def a11_backup(spark, sf_dir):
    """Rows kept aside before a purge: the copy has them, the purged table has not."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    copy = files.backup(orders.filter("o_orderstatus = 'P'"), f"{folders.work_folder(spark)}/copy")
    purged = orders.join(copy, "o_orderkey", "left_anti")
    return copy.join(purged, "o_orderkey", "left_anti")


@query("WITH fact AS FACT SELECT 'v2' AS version, uf, count(*) AS n FROM fact GROUP BY uf")
def a13_refresh_ledger(spark, sf_dir):
    """The version that the ledger names last."""
    n = fact(spark, sf_dir).groupBy("uf").agg(F.count("*").alias("n"))
    folder = folders.work_folder(spark)
    for version, rows in (("v1", n.filter("n < 0")), ("v2", n)):
        files.refresh(rows.select(F.lit(version).alias("version"), "uf", "n"), folder, version)
    return files.latest(spark, folder)


@query("SELECT p_partkey AS id_produto, p_name AS nome_do_produto, p_retailprice AS valor_kg FROM part")
def b16_column_names(spark, sf_dir):
    """Headers in any case, with spaces and hyphens."""
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias(" ID Produto"), F.col("p_name").alias("Nome do-Produto "), F.col("p_retailprice").alias("Valor-KG"))
    return df.toDF(*[text.column_key(c) for c in df.columns])


@query(f"SELECT p_partkey, {_ACCENTED} AS name FROM part")
def h10_mojibake(spark, sf_dir):
    """Every other name was once read in the wrong encoding."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(_ACCENTED).alias("name"))
    broken = F.when(F.col("p_partkey") % 2 == 0, F.decode(F.encode("name", "UTF-8"), "ISO-8859-1")).otherwise(F.col("name"))
    return p.select("p_partkey", text.repaired(broken).alias("name"))


@query("""WITH fact AS FACT, u AS (SELECT uf, region, CAST(sum(preco_q) // count(*) AS BIGINT) AS uf_mean_q, count(*) AS uf_rows FROM fact GROUP BY ALL),
r AS (SELECT region, CAST(sum(uf_mean_q * uf_rows) AS BIGINT)::DOUBLE / sum(uf_rows) AS region_mean_q FROM u GROUP BY ALL), a AS (SELECT CAST(sum(uf_mean_q * uf_rows) AS BIGINT)::DOUBLE / sum(uf_rows) AS mean_q FROM u)
SELECT u.*, region_mean_q, mean_q FROM u JOIN r USING (region), a""")
def d17_weighted_levels(spark, sf_dir):
    """Means of states, and those of regions and of all, in which a state counts by its rows."""
    u = fact(spark, sf_dir).groupBy("uf", "region").agg(F.expr("sum(preco_q) div count(*)").alias("uf_mean_q"), F.count("*").alias("uf_rows"))
    by_rows = stats.weighted_mean(F.col("uf_mean_q"), F.col("uf_rows"))
    everywhere = u.agg(by_rows.alias("mean_q")).select("mean_q").scalar()
    return u.join(u.groupBy("region").agg(by_rows.alias("region_mean_q")), "region").withColumn("mean_q", everywhere).select("uf", "region", "uf_mean_q", "uf_rows", "region_mean_q", "mean_q")


@query("WITH fact AS FACT SELECT product, uf, max(periodo) AS periodo, arg_max(preco_q, periodo) AS preco_q FROM fact WHERE obs <= 3 GROUP BY ALL")
def l3_stream_ingest(spark, sf_dir):
    """The newest price of each series as a stream of the years leaves it, month rows with many observations rejected."""
    folder, rows = folders.work_folder(spark), fact(spark, sf_dir).select(*KEY, "ano", "periodo", "preco_q", "obs")
    for years in (("ano <= 1998"), ("ano in (1999, 2000)"), ("ano >= 2001")):
        rows.filter(years).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    check = lambda b: (b.filter("obs <= 3"), b.filter("obs > 3"))
    ingest.start(stream, f"{folder}/out", f"{folder}/checkpoint", KEY, ["periodo"], check, part=F.col("uf")).awaitTermination()
    return ingest.current(spark, f"{folder}/out", rows.schema).select(*KEY, "periodo", "preco_q")
