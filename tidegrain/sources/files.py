"""Raw files in and snapshots out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrain.functions.text import column_key, decimal_price, first_filled

#: Raw quotations as agencies publish them: all text, so that nothing is lost on load.
RAW_PRICES = T.StructType([T.StructField(c, T.StringType()) for c in ("produto", "classificacao_produto", "id_produto", "uf", "regiao", "ano", "mes", "dsc_nivel_comercializacao", "valor_produto_kg")])

#: Other names under which files have a field.
RAW_NAMES = {"produto": ("nome_produto", "product"), "valor_produto_kg": ("preco", "preco_medio", "valor"), "uf": ("estado",)}


def _is_utf8(spark: SparkSession, path: str) -> DataFrame:
    """file and utf8 (every line is valid) of each file below path that has lines."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("good"))
    return lines.groupBy("file").agg(F.bool_and("good").alias("utf8"))


def _put_right(name: str) -> str:
    """A header that was read byte by byte, as UTF-8 if it is that."""
    try:
        return name.encode("latin-1").decode()
    except UnicodeError:
        return name


def read_delimited(spark: SparkSession, path: str, sep: str = ";", encoding: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Delimited text with a header, all columns text, headers normalised, and the file each row is from.

    Rows that do not fit keep what they have.  Without an encoding each file
    is read as UTF-8 if it is that, else as ISO-8859-1: all are read byte by
    byte, which loses nothing, and the texts of UTF-8 files are put right by a
    join with the table of files, so no list of files goes to the driver.
    """
    reader = spark.read.option("sep", sep).option("header", True).option("encoding", encoding or "ISO-8859-1").option("mode", "PERMISSIVE")
    df = (reader.schema(schema) if schema else reader).csv(path)
    rows = df.select("*", F.col("_metadata.file_name").alias("_arquivo"), F.col("_metadata.file_path").alias("_file"))
    names = {c: column_key(c if encoding or schema else _put_right(c)) for c in df.columns}
    if not encoding:
        rows = rows.join(_is_utf8(spark, path), F.col("_file") == F.col("file"), "left")
    as_utf8 = lambda c: c if encoding else F.when(F.col("utf8"), F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")).otherwise(c)
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return rows.select(*[(as_utf8(F.col(f"`{c}`")) if c in texts else F.col(f"`{c}`")).alias(names[c]) for c in df.columns], "_arquivo")


def read_raw(spark: SparkSession, folder: str) -> DataFrame:
    """All raw quotations of a folder, delimited (*.txt, *.csv) and JSON arrays (*.json), under the names of RAW_PRICES, with the file each row is from.

    Fields are found under any of their names, whatever their case; a folder without files gives no rows.
    """
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda pattern: any(x.getLen() for x in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")) or [])
    sources = [read_delimited(spark, f"{folder}/{p}") for p in ("*.txt", "*.csv") if there(p)]
    if there("*.json"):
        sources.append(spark.read.option("multiLine", True).option("primitivesAsString", True).json(f"{folder}/*.json").withColumn("_arquivo", F.col("_metadata.file_name")))
    rows = [df.select(*[pick(df, c, *RAW_NAMES.get(c, ())).alias(c) for c in RAW_PRICES.names], "_arquivo") for df in sources]
    empty = spark.createDataFrame([], T.StructType([*RAW_PRICES.fields, T.StructField("_arquivo", T.StringType())]))
    return reduce(DataFrame.unionByName, rows, empty)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files that each hold an array of objects, with the file each row is from."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("_arquivo", F.col("_metadata.file_name"))


def pick(df: DataFrame, *names: str) -> Column:
    """The first filled of the columns that df has under these names, whatever their case."""
    have = {c.lower(): c for c in df.columns}
    found = [F.col(have[n.lower()]).cast("string") for n in names if n.lower() in have]
    return first_filled(*found) if found else F.lit(None).cast("string")


def region_members(spark: SparkSession, path: str) -> DataFrame:
    """region, uf and min_ufs (three quarters of the states, two at least) from a JSON array of regions."""
    schema = "id string, nome string, papel string, ufs array<string>"
    r = spark.read.schema(schema).option("multiLine", True).json(path)
    return r.select(F.col("id").alias("region"), F.explode("ufs").alias("uf"), F.greatest(F.lit(2), F.ceil(F.size("ufs") * 0.75)).cast("int").alias("min_ufs"))


def landing(df: DataFrame, payload: str, schema: str) -> DataFrame:
    """Parsed payloads of rows not yet processed; a payload that is no JSON gives nulls."""
    return df.filter(~F.col("processado")).withColumn(payload, F.from_json(payload, schema))


def cleaned(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid monthly prices, and the rejected rows with the reason.

    Valid: a price above 0, a state of two letters, a month of 1 to 12.
    """
    x = raw.select(
        F.col("produto"),
        F.upper(F.trim("uf")).alias("uf"),
        F.col("ano").try_cast("int").alias("ano"),
        F.col("mes").try_cast("int").alias("mes"),
        decimal_price(F.col("valor_produto_kg")).alias("preco_medio"),
    )
    reason = (
        F.when(F.col("preco_medio").isNull() | (F.col("preco_medio") <= 0), "PRECO_INVALIDO")
        .when(F.col("uf").isNull() | ~F.col("uf").rlike("^[A-Z]{2}$"), "UF_INVALIDA")
        .when(F.col("mes").isNull() | ~F.col("mes").between(1, 12) | F.col("ano").isNull(), "PERIODO_INVALIDO")
    )
    judged = x.withColumn("motivo", reason)
    return judged.filter("motivo is null").drop("motivo"), judged.filter("motivo is not null")


def write_snapshot(df: DataFrame, folder: str, table: str, year: int, month: int, keys: Sequence[str] = ()) -> str:
    """A Parquet snapshot named table_yyyy_mm, ordered by keys over all its files."""
    path = f"{folder}/{table}_{year:04d}_{month:02d}"
    (df.orderBy(*keys) if keys else df).write.mode("overwrite").parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> int:
    """Write rows as CSV with a header; gives the number of rows, counted on the way."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("header", True).csv(path)
    return seen.get["rows"]


def backup(df: DataFrame, path: str) -> DataFrame:
    """Rows written aside before they are changed; gives back the copy."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def refresh(df: DataFrame, folder: str, version: str) -> DataFrame:
    """Write a version of a serving table beside the older ones, then note it in the ledger."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{folder}/versions/{version}")
    spark.createDataFrame([(version,)], "version string").withColumn("refreshed_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{folder}/ledger")
    return spark.read.parquet(f"{folder}/versions/{version}")


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The version of a serving table that the ledger has last."""
    row = spark.read.parquet(f"{folder}/ledger").orderBy(F.desc("refreshed_at"), F.desc("version")).first()
    return spark.read.parquet(f"{folder}/versions/{row['version']}")
