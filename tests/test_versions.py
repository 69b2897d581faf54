"""Partial refresh, step ledger, and the change log of an ingest."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrain.plans import source_queries
from tidegrain.sources import folders, steps, versions
from tidegrain.streaming import ingest

SF = "/root/testdata/sf0.001"
SCHEMA = "k long, state string, status string, t long"


def rows_of(df):
    return sorted(map(tuple, df.select("k", "state", "status", "t").collect()), key=repr)


def files_of(tmp_path, version):
    return sorted(p.name for p in (tmp_path / f"table/table_version={version}").glob("part_key=*"))


def test_a_refresh_writes_the_parts_that_changed(spark, tmp_path):
    out = str(tmp_path)
    assert versions.read(spark, out) is None
    first = [(i, s, "VERDE", 1) for i, s in enumerate(["SP", "SP", "RJ", "MG/x", None])]
    assert versions.refresh(spark.createDataFrame(first, SCHEMA), out, "state") == (1, ["k_", "k_MG/x", "k_RJ", "k_SP"])
    reader = versions.read(spark, out)
    second = [(0, "SP", "VERMELHO", 2), *first[1:]]
    assert versions.refresh(spark.createDataFrame(second, SCHEMA), out, "state") == (2, ["k_SP"])
    assert files_of(tmp_path, 2) == ["part_key=k_SP"]
    assert rows_of(versions.read(spark, out)) == sorted(second, key=repr)
    assert rows_of(reader) == rows_of(versions.read(spark, out, 1)) == sorted(first, key=repr)
    # The same rows in another order are no change.
    assert versions.refresh(spark.createDataFrame(second[::-1], SCHEMA).repartition(3), out, "state") == (2, [])
    # A part that is gone is in no later version; its files, and those of a part two versions old, go with the next one.
    third = [r for r in second if r[1] != "RJ"]
    assert versions.refresh(spark.createDataFrame(third, SCHEMA), out, "state") == (3, [])
    assert rows_of(versions.read(spark, out)) == sorted(third, key=repr)
    assert files_of(tmp_path, 1) == ["part_key=k_", "part_key=k_MG%2Fx", "part_key=k_RJ", "part_key=k_SP"]
    fourth = [*third, third[0]]
    assert versions.refresh(spark.createDataFrame(fourth, SCHEMA), out, "state") == (4, ["k_SP"])
    assert rows_of(versions.read(spark, out)) == sorted(fourth, key=repr)
    assert versions.numbers(spark, out) == [3, 4] and files_of(tmp_path, 1) == ["part_key=k_", "part_key=k_MG%2Fx"]
    assert versions.refresh(spark.createDataFrame([], SCHEMA), out, "state") == (5, [])
    assert versions.read(spark, out) is None


def test_a_version_without_manifest_is_written_over(spark, tmp_path):
    out = str(tmp_path)
    one = spark.createDataFrame([(1, "SP", "VERDE", 1)], SCHEMA)
    versions.refresh(one, out, "state")
    one.withColumn("part_key", F.lit("k_XX")).write.partitionBy("part_key").parquet(f"{out}/table/table_version=2")
    (tmp_path / "manifest/version=2").mkdir()
    assert rows_of(versions.read(spark, out)) == [(1, "SP", "VERDE", 1)]
    two = spark.createDataFrame([(2, "SP", "VERDE", 1)], SCHEMA)
    assert versions.refresh(two, out, "state") == (2, ["k_SP"])
    assert files_of(tmp_path, 2) == ["part_key=k_SP"] and rows_of(versions.read(spark, out)) == [(2, "SP", "VERDE", 1)]


def test_a_load_goes_on_where_it_stopped(spark, tmp_path):
    calls = []

    def load(broken, cap=5, source="a"):
        s = steps.Steps(spark, str(tmp_path), source)

        def noted(name, f):
            def make(*tables):
                calls.append(name)
                return f(*tables)

            return make

        s.add("raw", [], noted("raw", lambda: spark.range(10)))
        s.add("good", ["raw"], noted("good", lambda raw: raw.filter(F.col("id") < cap)), cap=cap)
        s.add("twice", ["good"], noted("twice", lambda good: good.select((F.col("id") * (F.raise_error(F.lit("lost")).cast("long") if broken else 2)).alias("id"))))
        s.add("all", ["good", "twice"], noted("all", lambda a, b: a.unionByName(b)))
        return s

    with pytest.raises(Exception, match="lost"):
        load(True).table("all").count()
    assert calls == ["raw", "good", "twice"]
    again = load(False)
    assert again.table("all").count() == 10 and again.ran == ["twice", "all"]
    assert calls == ["raw", "good", "twice", "twice", "all"]
    assert {r.step: r.rows for r in again.ledger().collect()} == {"raw": 10, "good": 5, "twice": 5, "all": 10}
    # Another parameter is another version of its step and of those that read it; another source of all.
    other = load(False, 3)
    assert other.table("all").count() == 6 and other.ran == ["good", "twice", "all"]
    assert load(False).table("all").count() == 10 and len(calls) == 8
    fresh = load(False, source="b")
    fresh.table("good")
    assert fresh.ran == ["raw", "good"]
    with pytest.raises(ValueError, match="unknown"):
        again.add("x", ["y"], lambda: None)


def test_a_batch_is_logged_once_however_often_it_runs(spark, tmp_path):
    out = str(tmp_path / "out")
    check = lambda b: (b.filter("status is not null"), b.filter("status is null"))
    batches = [
        [(1, "SP", "VERDE", 1), (2, "SP", "AMARELO", 1), (3, "RJ", "VERDE", 2)],
        [(1, "SP", "VERMELHO", 2), (3, "RJ", "VERDE", 3), (4, "RJ", "VERDE", 3), (9, "SP", None, 3)],
        [(1, "SP", "VERDE", 3), (3, "RJ", "AMARELO", 4)],
    ]
    assert ingest.change_log(spark, out) is None
    for number, rows in enumerate(batches):
        for _ in range(2):  # as after a failure
            ingest.apply_batch(spark.createDataFrame(rows, SCHEMA), number, out, ["k"], ["t"], check, F.col("state"), "status")
    assert sorted(map(tuple, ingest.change_log(spark, out).select("batch", "k", "before", "after").collect())) == [(1, 1, "VERDE", "VERMELHO"), (2, 1, "VERMELHO", "VERDE"), (2, 3, "VERDE", "AMARELO")]
    assert rows_of(ingest.current(spark, out)) == [(1, "SP", "VERDE", 3), (2, "SP", "AMARELO", 1), (3, "RJ", "AMARELO", 4), (4, "RJ", "VERDE", 3)]
    assert sorted(map(tuple, ingest.transitions(ingest.change_log(spark, out)).collect())) == [("VERDE", "AMARELO", 1, 2, 2), ("VERDE", "VERMELHO", 1, 1, 1), ("VERMELHO", "VERDE", 1, 2, 2)]
    assert spark.read.parquet(f"{out}/rejected").count() == 1


def test_a_stream_in_parts_by_month_is_audited(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    check = lambda b: (b, b.limit(0))
    for number, rows in enumerate([[(k, "SP", "VERDE", k % 4) for k in range(40)], [(3, "SP", "VERMELHO", 3)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        ingest.start(spark.readStream.schema(SCHEMA).parquet(source), out, str(tmp_path / "cp"), ["k"], ["t"], check, part=F.col("k") % 4, audit="status").awaitTermination()
        assert files_of(tmp_path / "out", number) == [f"part_key=k_{p}" for p in ([0, 1, 2, 3] if number == 0 else [3])]
    assert list(map(tuple, ingest.change_log(spark, out).select("k", "before", "after", "batch").collect())) == [(3, "VERDE", "VERMELHO", 1)]


def test_a_stream_whose_rows_are_all_rejected_leaves_an_empty_table(spark, tmp_path):
    out, schema = str(tmp_path / "out"), T._parse_datatype_string(SCHEMA)
    check = lambda b: (b.filter("t > 9"), b.filter("t <= 9"))
    assert ingest.current(spark, out, schema).collect() == []
    for number, rows in enumerate([[(1, "SP", "VERDE", 1)], [(2, "SP", "VERDE", 2)], [(3, "SP", "VERDE", 10)]]):
        ingest.apply_batch(spark.createDataFrame(rows, schema), number, out, ["k"], ["t"], check, F.col("state"))
        assert rows_of(ingest.current(spark, out, schema)) == ([(3, "SP", "VERDE", 10)] if number == 2 else [])
    assert spark.read.parquet(f"{out}/rejected").count() == 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_the_ingest_query_gives_no_rows_where_all_months_are_rejected(spark, tmp_path):
    for name in ("region", "nation", "supplier", "part"):
        os.symlink(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    # Each row four times, so every month of a series has four observations at least.
    items.withColumn("copy", F.explode(F.array(*[F.lit(i) for i in range(4)]))).drop("copy").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = source_queries.QUERIES["l3_stream_ingest"](spark, str(tmp_path))
    assert got.columns == ["product", "uf", "periodo", "preco_q"] and got.collect() == []


def test_small_files_are_whole(spark, tmp_path):
    folders.write_text(spark, f"{tmp_path}/a/x.json", "one")
    folders.write_text(spark, f"{tmp_path}/a/x.json", "zwei é")
    assert (tmp_path / "a/x.json").read_text() == "zwei é"
    assert [n for n in folders.names(spark, f"{tmp_path}/a") if not n.startswith(".")] == ["x.json"]
    before = folders.fingerprint(spark, f"{tmp_path}/a")
    (tmp_path / "a/y.txt").write_text("more")
    assert folders.fingerprint(spark, f"{tmp_path}/a") != before and folders.fingerprint(spark, f"{tmp_path}/none") == ""
