"""Serving rows, kept answers, and the load from raw files that goes on where it stopped."""

import pytest
from pyspark.sql import functions as F

from tidegrain.functions import objects
from tidegrain.plans import serving
from tidegrain.sources import folders, steps
from tidegrain.sources.answers import Answers

FACT = "product string, uf string, region string, ano int, mes int, periodo int, preco_q long, obs long"


def prices(spark, rows):
    return spark.createDataFrame([(p, u, "R", y, m, y * 12 + m, q, 1) for p, u, y, m, q in rows], FACT)


def year_of(product, uf, year, price=20000):
    return [(product, uf, year, m, price + 10 * m) for m in range(1, 13)]


def shown(spark, rows, source="'MENSAL'"):
    f = prices(spark, rows)
    m = serving.mart(f, F.expr(source), F.col("periodo") * 10 + F.length("uf"), 2001)
    return [r.asDict() for r in serving.serving_rows(m, 2001, 8).withColumn("made", objects.as_json(F.col("made"))).collect()]


def test_kinds_of_serving_rows(spark):
    rows = year_of("p", "A", 1999) + year_of("p", "A", 2000) + [("p", "A", 2001, m, 30000) for m in range(1, 5)]
    # B: last year's single row has no twelve months before it; C: rows too old for an anchor; gap: never complete.
    rows += [("p", "BB", 2000, 9, 21000), ("p", "CCC", 1997, 9, 22000), ("p", "CCC", 1997, 2, 22000), ("gap", "A", 2000, 1, 20000)]
    got = shown(spark, rows)
    assert {r["product"] for r in got} == {"p"}
    own = [r for r in got if r["uf"] == "A"]
    # 1999 has no year before it, so its own rows show what an anchor of 2000 or 2001 says.
    assert len([r for r in own if r["id"] > 0]) == 28
    behind = [r for r in own if r["id"] < 0]
    assert sorted(r["mes"] for r in behind) == [5, 6, 7, 8, 9, 10, 11, 12] and all(-serving.SHIFT < r["id"] and r["ano"] == 2001 and r["reference_year"] == 2000 and r["age"] == 1 and r["kind"] == serving.PAST for r in behind)
    dear = next(r for r in own if r["ano"] == 2001 and r["mes"] == 1 and r["id"] > 0)
    assert (dear["status"], dear["kind"], dear["preco_q"]) == ("VERMELHO", serving.REAL, 30000)
    (b,) = [r for r in got if r["uf"] == "BB" and r["id"] < 0]
    assert b["id"] == -(2000 * 12 + 9) * 10 - 2 - serving.SHIFT and b["kind"] == serving.DIMENSION and b["reference_year"] == 2000
    assert b["made"] == '{"ano_referencia":"2000","data_referencia":"2000-09","fonte_dado":"PROJECAO_HISTORICA","mensagem_transparencia":"Projecao sazonal baseada no historico de 2000","procedencia":"DEEP_FALLBACK"}'
    c = {r["mes"]: r for r in got if r["uf"] == "CCC" and r["id"] < 0}
    # From the as-of month on the fallback decides, before it the row's own status and provenance stay.
    assert c[9]["reference_year"] is None and c[9]["status"] == "AMARELO" and '"ano_referencia":null' in c[9]["made"] and c[9]["message"] == serving.BY_BASELINE
    assert c[2]["message"] is None and c[2]["made"] == '{"data_referencia":"1997-02","fonte_dado":"MENSAL","procedencia":"sem_historico_real"}'
    assert len({r["id"] for r in got}) == len(got)


def test_real_rows_come_before_proxies(spark):
    rows = year_of("p", "A", 2000) + [("p", "BB", 1996, 3, 21000), ("p", "BB", 1997, 3, 22000), ("p", "CCC", 1997, 3, 0)]
    got = {(r["uf"], r["mes"]): r for r in shown(spark, rows, "CASE WHEN ano = 1997 THEN 'FLUXO_PROXY' ELSE 'MENSAL' END") if r["id"] < -serving.SHIFT}
    assert got["BB", 3]["preco_q"] == 21000 and '"procedencia":"sem_historico_real"' in got["BB", 3]["made"]
    assert got["CCC", 3]["preco_q"] is None and '"procedencia":"sem_historico_real_uso_proxy"' in got["CCC", 3]["made"]


def test_all_kinds_and_sources_occur(spark):
    rows = serving.QUERIES["j18_serving_rows"](spark, "/root/testdata/sf0.001").groupBy("kind", (F.col("id") > 0).alias("real"), (F.col("id") < -serving.SHIFT).alias("low")).count().collect()
    assert {(r["kind"], r["real"], r["low"]) for r in rows} >= {("REAL_ATUAL", True, False), ("HISTORICO_BASE", True, False), ("HISTORICO_BASE", False, False), ("FALLBACK_DIMENSAO", False, True)}
    assert {r.source for r in serving.QUERIES["j20_deep_fallback"](spark, "/root/testdata/sf0.001").collect()} >= {"historico", "neutro"}


def test_objects_merge_to_the_right(spark):
    a, b = "map('x', '1', 'y', null)", "map('x', null, 'z', '3')"
    row = spark.sql(f"select {a} a, {b} b, cast(null as map<string,string>) n")
    assert row.select(objects.as_json(objects.merged(F.col("a"), F.col("b")))).first()[0] == '{"x":null,"y":null,"z":"3"}'
    assert row.select(objects.as_json(objects.merged(F.col("n"), F.col("a")))).first()[0] == '{"x":"1","y":null}'
    assert row.select(objects.as_json(objects.merged(F.col("n"), F.col("n")))).first()[0] == "{}"


def test_a_second_page_reads_no_fact(spark, tmp_path):
    kept, made = Answers(spark, str(tmp_path / "answers")), []

    def make():
        made.append(1)
        return spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit("v").alias("v")).repartition(5)

    page = lambda n, version=1, **more: kept.page({"uf": "SP", **more}, version, make, ["k"], n, 30)
    seen = []
    for n in range(1, 36):
        total, rows = page(n)
        assert total == 1000
        seen += [r.k for r in rows.collect()]
        if n == 2:
            assert made == [1] and all("/answers/version=1/" in f for f in rows.inputFiles())
    assert seen == list(range(1000)) and made == [1]
    assert page(1, status="VERDE")[0] == 1000 and len(made) == 2
    total, rows = kept.page({"uf": "SP"}, 1, make, ["k"], 2, 30, F.col("k") % 10 == 3)
    assert total == 100 and [r.k for r in rows.collect()] == [303 + 10 * i for i in range(30)] and len(made) == 2
    # A newer version drops what was made of the older one.
    page(1, 2)
    assert len(made) == 3 and folders.names(spark, str(tmp_path / "answers")) == ["version=2"]
    none = kept.page({"uf": "XX"}, 2, lambda: spark.range(0).select(F.col("id").alias("k")), ["k"])
    assert none[0] == 0 and none[1].count() == 0


def raw_folder(tmp_path):
    lines = ["Produto;UF;Ano;Mes;Valor Produto-KG"]
    lines += [f"maçã;SP;{y};{m};{2 + m / 100:.4f}".replace(".", ",") for y in (1999, 2000) for m in range(1, 13)]
    lines += ["maçã;SP;2001;1;3,0000", "maçã;SP;2001;2;99,0000", "maçã;SP;2001;3;n/d", "maçã;SPX;2001;3;2,0000"]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/a.csv").write_bytes("\n".join(lines).encode("latin-1"))
    (tmp_path / "raw/b.csv").write_bytes("\n".join(lines[:5]).encode("latin-1"))
    return str(tmp_path / "raw")


def test_a_load_from_raw_files_is_resumed(spark, tmp_path, monkeypatch):
    raw, out = raw_folder(tmp_path), str(tmp_path / "out")
    regions = spark.createDataFrame([("SP", "São Paulo", "Sudeste")], "code string, uf string, region string")
    load = lambda: serving.full_load_steps(spark, raw, out, regions, 18_000_000, 2001, 24018)
    with monkeypatch.context() as broken:
        broken.setattr(serving, "weighted_forecast", lambda s, year, period: s.select(F.raise_error(F.lit("executor lost"))))
        with pytest.raises(Exception, match="executor lost"):
            load().table("serving")
    again = load()
    rows = {r.mes: r for r in again.table("serving").collect()}
    assert again.ran == ["forecast", "serving"] and len(rows) == 12
    assert (rows[1].preco_q, rows[1].is_forecast, rows[5].preco_q, rows[5].is_forecast) == (30000, False, 30000, True)
    assert [(r.periodo, r.reason) for r in again.table("quarantine").collect()] == [(24014, "EXCEDE_500PCT_MEDIA_UF")]
    assert sorted(r.motivo for r in again.table("rejected").collect()) == ["PRECO_INVALIDO", "UF_INVALIDA"]
    assert again.table("prices").count() == 26 and again.table("seasonality").count() == 25
    done = load()
    done.table("serving"), done.table("quarantine"), done.table("rejected"), done.table("seasonality")
    assert done.ran == []
    # A new file is another source: everything is made again.
    (tmp_path / "raw/c.csv").write_text("Produto;UF;Ano;Mes;Valor Produto-KG\nuva;SP;2001;1;5,0\n")
    fresh = load()
    assert fresh.table("prices").count() == 27 and fresh.ran == ["landed", "prices"]
    assert isinstance(fresh, steps.Steps)
