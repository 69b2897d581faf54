"""Rules, names, windows, files and streams on small golden cases."""

import json

import pytest
from pyspark.sql import functions as F

from tidegrain.functions import period, rules, text
from tidegrain.operators import stats, tables, windows
from tidegrain.sources import files
from tidegrain.streaming import ingest


def one(spark, value):
    return spark.range(1).select(value.alias("x")).first().x


@pytest.mark.parametrize(("raw", "price"), [("6,50", "6.5000"), (" 12.30 ", "12.3000"), ("abc", None), ("", None), ("500000,0", "500000.0000")])
def test_decimal_price(spark, raw, price):
    got = one(spark, text.decimal_price(F.lit(raw)))
    assert (str(got) if got is not None else None) == price


@pytest.mark.parametrize(("name", "key"), [("  Batata-doce ", "BATATA DOCE"), ("CRAY-O-VA", "CRAY O VA"), ("00-18-18", "00-18-18"), ("Açaí  -  polpa*", "ACAI POLPA"), ("- x -", "X")])
def test_name_key(spark, name, key):
    assert one(spark, text.name_key(F.lit(name))) == key


def test_other_names(spark):
    assert one(spark, text.title_case(F.lit("COUVE-FLOR DE MINAS"))) == "Couve-Flor de Minas"
    assert one(spark, text.match_key(F.lit("TOMATE  (kg)"))) == "tomate kg"
    assert one(spark, text.display_name(F.lit("Banana  - HORTI | sp"), ["HORTI"])) == "Banana"
    assert one(spark, text.repaired(F.lit("aÃ§aÃ­"))) == "açaí" and one(spark, text.repaired(F.lit("maçã"))) == "maçã"
    assert one(spark, text.unit(F.lit("20 kg"), {"cx": ("cx", 20.0)})).asDict() == {"unit": "kg", "factor": 20.0, "known": True}
    assert one(spark, text.dice(F.lit("NIGHT"), F.lit("NACHT"))) == 0.25


@pytest.mark.parametrize(("price", "ref", "cv", "status"), [(10, 8, 0.1, "VERMELHO"), (8, 8, 0.1, "AMARELO"), (6, 8, 0.1, "VERDE"), (6, 8, 0.41, "AMARELO"), (0, 8, 0.1, None), (8, None, 0.1, None), (4.05, 4.0, 0.0, "AMARELO"), (4.2, 4.0, None, "VERMELHO")])
def test_sensitive_band(spark, price, ref, cv, status):
    c = lambda v: F.lit(v).cast("double")
    assert one(spark, rules.sensitive(c(price), c(ref), c(cv))) == status


def test_bands(spark):
    b = lambda p, r, k: one(spark, rules.band(F.lit(p), F.lit(r).cast("int"), k))
    assert [b(84, 100, 15), b(85, 100, 15), b(115, 100, 15), b(116, 100, 15), b(7, None, 15)] == ["VERDE", "AMARELO", "AMARELO", "VERMELHO", "AMARELO"]
    assert one(spark, rules.mean_band(F.lit(8), F.lit(50), F.lit(5))) == "INSUFICIENTE"
    assert [one(spark, rules.quorum(F.lit(r), F.lit(g), F.lit(10))) for r, g in ((4, 6), (3, 4), (3, 3))] == ["VERMELHO", "VERDE", "AMARELO"]
    assert one(spark, rules.sigma_band(F.lit(8.0), F.lit(8.0), F.lit(0.0))) is None


def test_provenance(spark):
    m = lambda k, y, a: one(spark, rules.provenance(F.lit(k), F.lit(y), F.lit(a)))
    assert m("REAL_ATUAL", 2026, 0) == "Preço coletado no ano corrente"
    assert m("HISTORICO_BASE", 2025, 1) == "Preço real de 2025 (há 1 ano)"
    assert m("HISTORICO_BASE", 2024, 2) == "Preço real de 2024 (há 2 anos)"


def series(spark, values):
    return spark.createDataFrame([("p", "u", i, v) for i, v in enumerate(values)], "product string, uf string, periodo int, preco_q long")


def test_gap_filling(spark):
    s = series(spark, [None, 10, None, None, 40, None, None, None, 80, None])
    by = lambda d, c: [r[c] for r in d.orderBy("periodo").collect()]
    f = windows.carried_forward(s, ["product", "uf"], "periodo", "preco_q", "f")
    assert by(f, "f") == [None, 10, 10, 10, 40, 40, 40, 40, 80, 80]
    again = windows.carried_forward(f.withColumn("preco_q", F.col("f")), ["product", "uf"], "periodo", "preco_q", "g")
    assert by(again, "g") == by(f, "f")
    assert by(windows.carried_back(s, ["product", "uf"], "periodo", "preco_q", "b"), "b")[0] == 10
    assert by(windows.interpolated(s, ["product", "uf"], "periodo", "preco_q", "i"), "i") == [None, 10, 20, 30, 40, None, None, None, 80, None]


def test_trailing_rows_and_calendar(spark):
    s = spark.createDataFrame([("p", "u", p, 10) for p in (1, 2, 20)], "product string, uf string, periodo int, preco_q long")
    rows = windows.trailing(s, ["product", "uf"], ["periodo"], "preco_q").orderBy("periodo").collect()
    assert [r.n for r in rows] == [1, 2, 3] and rows[2].previous == 10
    assert [r.n for r in windows.calendar_trailing(s, ["product", "uf"], "periodo", "preco_q", -12, -1).orderBy("periodo").collect()] == [0, 1, 0]


def test_outliers_and_leave_out(spark):
    s = series(spark, [10] * 20 + [1000])
    assert stats.fenced(s, ["product", "uf"], "preco_q").count() == 20
    o = stats.leave_out(series(spark, [10, 20, 30]), ["product"], ["uf", "periodo"], "preco_q", "o").orderBy("periodo").collect()
    assert [(r.o_total, r.o_n) for r in o] == [(50, 2), (40, 2), (30, 2)]
    v = stats.volatility(series(spark, [10]), ["product", "uf"], "preco_q").first()
    assert v.sigma is None and v.deviation == 1.0


def test_mode_ties_and_upper_median(spark):
    d = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c")], "k int, v string")
    assert {r.k: (r.v, r.freq, r.total) for r in stats.mode_share(d, ["k"], "v").collect()} == {1: ("a", 1, 2), 2: ("c", 1, 1)}
    assert spark.range(4).agg(stats.upper_median("id").alias("m")).first().m == 2


def test_merges(spark):
    a = spark.createDataFrame([(1, "new")], "k int, v string")
    b = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")
    assert sorted(map(tuple, tables.prefer(a, b, ["k"], [F.asc("v")]).collect())) == [(1, "new"), (2, "old")]
    assert sorted(map(tuple, tables.updated(b, a, ["k"], ["v"]).collect())) == [(1, "new"), (2, "old")]
    assert tables.contains(b, "v", "%").count() == 0 and tables.contains(b, "v", "OL").count() == 2
    n = spark.createDataFrame([("x y", 1), ("x", 2), ("xy", 3)], "name string, i int")
    p = spark.createDataFrame([("x",)], "base string")
    assert sorted(r.i for r in tables.prefix_join(n, p, "name", "base").collect()) == [1, 2]


def test_periods(spark):
    assert one(spark, period.text(F.lit(2024), F.lit(3))) == "2024-03"
    assert one(spark, period.coherent(F.lit("2024-13"), F.lit(2024), F.lit(13))) is False


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Produto;UF; Ano;Mes;Valor Produto-KG\nmaçã;SP;2024;1;2,27\npera;SP--;2024;2;3,0\nuva;RJ;2024;13;4,0\nfigo;RJ;2024;1;abc\n".encode("latin-1"))
    raw = files.read_delimited(spark, str(tmp_path / "a.txt"))
    assert raw.columns == ["produto", "uf", "ano", "mes", "valor_produto_kg", "_arquivo"]
    good, bad = files.cleaned(raw)
    assert [(r.produto, str(r.preco_medio)) for r in good.collect()] == [("maçã", "2.2700")]
    assert sorted(r.motivo for r in bad.collect()) == ["PERIODO_INVALIDO", "PRECO_INVALIDO", "UF_INVALIDA"]
    assert raw.select(files.pick(raw, "x", "PRODUTO").alias("p")).first().p == "maçã"
    (tmp_path / "r.json").write_text(json.dumps([{"id": "sul", "nome": "Sul", "papel": "p", "ufs": ["PR", "SC", "RS"]}]))
    assert sorted(map(tuple, files.region_members(spark, str(tmp_path / "r.json")).collect())) == [("sul", u, 3) for u in ("PR", "RS", "SC")]
    path = files.write_snapshot(good, str(tmp_path), "t", 2024, 1, ["produto"])
    assert path.endswith("t_2024_01") and spark.read.parquet(path).count() == 1
    files.refresh(good, str(tmp_path / "mv"), "v1")
    files.refresh(good.union(good), str(tmp_path / "mv"), "v2")
    assert files.latest(spark, str(tmp_path / "mv")).count() == 2


def test_raw_folder_of_both_formats_and_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Produto;UF;Ano;Mes;Valor Produto-KG\nmaçã;SP;2024;1;2,27\n".encode("latin-1"))
    (tmp_path / "b.txt").write_bytes("Produto;UF;Ano;Mes;Valor Produto-KG\naçaí;PA;2024;2;9,5\n".encode())
    (tmp_path / "c.json").write_text(json.dumps([{"Nome_Produto": "uva", "Estado": "RJ", "ano": 2024, "mes": 3, "preco": "4,0"}]))
    raw = files.read_raw(spark, str(tmp_path))
    assert sorted((r.produto, r.uf, r.ano, r.valor_produto_kg, r._arquivo) for r in raw.collect()) == [("açaí", "PA", "2024", "9,5", "b.txt"), ("maçã", "SP", "2024", "2,27", "a.txt"), ("uva", "RJ", "2024", "4,0", "c.json")]
    assert files.cleaned(raw)[0].count() == 3
    (tmp_path / "none").mkdir()
    assert files.read_raw(spark, str(tmp_path / "none")).count() == 0
    assert files.write_csv(raw, str(tmp_path / "out")) == 3
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3
    copy = files.backup(raw.filter("uf = 'SP'"), str(tmp_path / "copy"))
    assert copy.count() == 1
    schema = "nome string, n int"
    (tmp_path / "d.json.arr").write_text(json.dumps([{"nome": "x", "n": 1}, {"nome": "y"}]))
    from pyspark.sql import types as T

    got = files.read_json_array(spark, str(tmp_path / "d.json.arr"), T._parse_datatype_string(schema))
    assert sorted((r.nome, r.n, r._arquivo) for r in got.collect()) == [("x", 1, "d.json.arr"), ("y", None, "d.json.arr")]
    landed = spark.createDataFrame([(1, '{"a": 5}', False), (2, "no", False), (3, '{"a": 7}', True)], "id int, body string, processado boolean")
    assert sorted((r.id, r.body.a if r.body else None) for r in files.landing(landed, "body", "a int").collect()) == [(1, 5), (2, None)]


def test_encodings_are_found_file_by_file(spark, tmp_path):
    text = "Código;Descrição;n\nÅ1;à vista  ção;1\nx;;2\n"
    (tmp_path / "a.csv").write_bytes(text.replace(" ", "").encode("latin-1"))
    (tmp_path / "b.csv").write_bytes(text.replace(" ", "").encode())
    got = files.read_delimited(spark, str(tmp_path))
    assert sorted((r["código"], r["descrição"] or "", r.n, r._arquivo) for r in got.collect()) == [(k, v, n, f) for k, v, n in (("x", "", "2"), ("Å1", "à vista ção", "1")) for f in ("a.csv", "b.csv")]
    forced = files.read_delimited(spark, str(tmp_path / "a.csv"), encoding="ISO-8859-1")
    assert forced.columns == ["código", "descrição", "n", "_arquivo"] and forced.count() == 2


def test_null_aware_lookups(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    some, null, none = (spark.createDataFrame(x, "k int") for x in ([(1,)], [(1,), (None,)], []))
    got = lambda v: sorted((r.k for r in tables.not_in(left, v, "k").collect()), key=lambda x: (x is None, x))
    assert got(some) == [2] and got(null) == [] and got(none) == [1, 2, None]
    rows = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, "x", None)], "k int, note string, c string")
    known = spark.createDataFrame([("a",), ("z",)], "name string")
    found = tables.candidates(rows, known, "name", {0: F.col("note"), 1: F.col("c")})
    assert sorted((r.k, r.found) for r in found.select("k", "found").collect()) == [(1, "a"), (1, "a"), (2, None)]
    right = spark.createDataFrame([(1, 5, "old"), (1, 7, "new"), (1, 9, "late")], "k int, t int, v string")
    asof = windows.asof_latest(rows, right, ["k"], F.col("t") >= 0, F.col("t") <= 8, [F.desc("t")])
    assert asof.columns == ["k", "note", "c", "t", "v"] and sorted(r.v or "" for r in asof.collect()) == ["", "new", "new"]


def test_a_broken_proof_ends_the_job(spark):
    from tidegrain.plans import loads

    schema = "product string, uf string, ano int, mes int, periodo int, preco_q long"
    rows = [("p", "A", 2000, 1, 24001, 5), ("p", "A", 2000, 1, 24001, 5), ("p", "B", 2000, 13, 24013, None)]
    report = loads.proofs(spark.createDataFrame(rows, schema), spark.createDataFrame([("A",)], "uf string"))
    assert {r.rule: r.broken for r in report.collect()} == {"month_in_range": 1, "period_coherent": 0, "positive_price": 1, "unique_month": 1, "known_state": 1}
    with pytest.raises(Exception, match="is broken by 1 rows"):
        loads.required(report).collect()


def test_negated_ids_refuse_large_ones(spark):
    from tidegrain.plans import loads

    assert [r.id for r in loads.negated(spark.createDataFrame([(5,), (None,)], "id long"), "id").collect()] == [-5, None]
    with pytest.raises(Exception, match="too large"):
        loads.negated(spark.createDataFrame([(10**9,)], "id long"), "id").collect()


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "a", 1), (2, "b", 1), (1, "c", 2), (3, "bad", 1), (2, "d", 3)]
    schema = "k int, v string, t int"
    check = lambda d: (d.filter("v <> 'bad'"), d.filter("v = 'bad'"))
    source = str(tmp_path / "in")
    seen = []
    for i in range(0, 5, 2):
        spark.createDataFrame(rows[i : i + 2], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        ingest.start(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], ["t"], check, seen.append).awaitTermination()
    got = sorted(map(tuple, ingest.current(spark, str(tmp_path / "out")).select("k", "v", "t").collect()))
    batch = sorted(map(tuple, ingest.merged(None, check(spark.createDataFrame(rows, schema))[0], ["k"], ["t"]).select("k", "v", "t").collect()))
    assert got == batch == [(1, "c", 2), (2, "d", 3)] and seen == [0, 1, 2]
    assert spark.read.parquet(str(tmp_path / "out/rejected")).count() == 1


def test_ingest_rewrites_touched_parts_only(spark, tmp_path):
    schema = "k long, v string, t long"
    source, out, done = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    check = lambda b: (b.filter("v is not null"), b.filter("v is null"))
    assert ingest.current(spark, out) is None
    batches = [[(k, f"a{k}", 1) for k in range(200)], [(7, "b7", 2), (7, None, 3)], [(7, "c7", 4)], [(7, "old", 0), (8, "d8", 5)], [(7, "e7", 6)]]
    expected = {}
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        ingest.start(spark.readStream.schema(schema).parquet(str(source)), out, done, ["k"], ["t"], check, parts=8).awaitTermination()
        for k, v, t in rows:
            if v is not None:
                expected[k] = (k, v, t)
        assert sorted(map(tuple, ingest.current(spark, out).collect())) == sorted(expected.values())
    versions = {int(p.name.split("=")[1]): len(list(p.glob("part_key=*"))) for p in (tmp_path / "out/table").glob("table_version=*")}
    assert versions[0] == 7 or versions[0] == 8  # the touched part of the first version goes, the others are still current
    assert sum(versions.values()) <= 8 + 2
    assert spark.read.parquet(f"{out}/rejected").count() == 1


def test_status_changes(spark):
    a = spark.createDataFrame([(1, "VERDE"), (2, None), (3, "AMARELO"), (4, None)], "k long, status string")
    b = spark.createDataFrame([(1, "VERMELHO"), (2, "VERDE"), (3, "AMARELO"), (4, None), (5, "VERDE")], "k long, status string")
    assert sorted(map(tuple, ingest.status_changes(a, b, ["k"]).collect())) == [(1, "VERDE", "VERMELHO"), (2, None, "VERDE")]


def test_windowed_totals(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "b", 4.0)]
    spark.createDataFrame(rows, "s string, event_type string, value double").selectExpr("cast(s as timestamp) ts", "event_type", "value").write.parquet(str(tmp_path / "e"))
    events = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    ingest.windowed_totals(events).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.event_type, r.n, r.total) for r in spark.table("totals").collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]
