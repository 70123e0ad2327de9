from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from meterlake.functions.calendar import day_literal
from meterlake.operators import quality as Q
from meterlake.operators import readings as R
from meterlake.operators import weather as W
from meterlake.operators.latest import latest_by_end, latest_open_first
from meterlake.operators.registry import registry, smart_flag
from meterlake.operators.sampling import median_of, spread_sample
from meterlake.operators.topology import join_colliding, join_prefixed, topology, with_pole_position
from meterlake.schemas import CHANNELS, MEASURES, channel_schema


def day(text):
    return date.fromisoformat(text) if text else None


REGISTRY = {
    "rel_equip_uc": ("cod_un_cons_reu bigint, num_eqip_reu string, dta_ins_reu date, dta_reti_reu date", [
        (1, "41000001", day("2020-01-01"), None), (2, "77", day("2020-01-01"), None), (3, "78", day("2020-01-01"), day("2021-01-01")), (4, "x9", None, None)]),
    "cad_uc_ee": ("cod_un_cons_uee bigint, cod_loc_uee int, cod_situ_uee string, dta_situ_uee date, cod_tipo_fase_uee string, cod_gru_tens_fat_uee string, cod_sub_gru_fat_uee string, cod_clas_cons_uee string, cod_tipo_entg_uee string, cod_tipo_tar_fat_uee string, num_cli_uee bigint, qtd_tens_lig_uee int, cod_tipo_disj_uee string, num_pste_uee bigint", [
        (1, 5, "LG", day("2024-01-02"), "3", "B", None, "9109", "a", "05", 11, 127, "d", 900), (2, 5, "LG", None, "1", "B", "1", "1", "a", "01", None, 127, "d", 901), (3, 5, "LG", None, "1", "B", "1", "1", "a", "01", 13, 127, "d", None), (4, 6, "LG", None, "1", None, None, "1", "a", "01", 14, 127, "d", None)]),
    "tab_localidade": ("cod_loc_loc int, cod_mun_loc int", [(5, 50), (6, 60)]),
    "tab_municipio": ("cod_mun_mun int, nom_mun_mun string", [(50, "Riverton"), (60, "Other")]),
    "cad_equip_med": ("num_eqip_emd string, cod_sub_tipo_eqip_emd string", [("41000001", "A"), ("77", "B")]),
    "tab_sub_tipo_equip": ("cod_sub_tipo_eqip_ste string, des_sub_tipo_eqip_ste string", [("A", "quali x"), ("B", "Inteligente")]),
    "cad_coordenada_uc_ee": ("cod_un_cons_xxx bigint, num_coory_xxx double, num_coorx_xxx double", [(1, -25.5, -49.4)]),
    "cad_pste_sist_extn": ("num_pste_psx bigint, cod_situ_psx string, num_coorx_psx double, num_coory_psx double", [(900, "AT", 6.6e5, 7.17e6), (900, "XX", 1.0, 1.0), (900, "AT", 6.7e5, 7.17e6)]),
    "cad_uc_ger_energia": ("cod_un_cons_utg bigint, cod_modl_dis_utg string, dta_fim_vign_utg date, cod_situ_utg string, qtd_pot_ger_utg int", [
        (1, "A", None, None, 100), (1, "C", None, "AT", 25000), (1, "Z", None, "AT", 25001), (2, "B", None, "CA", 1), (2, "B", day("2020-01-01"), "AT", 1)]),
    "rel_classif_mmgd": ("cod_un_cons_kcg bigint, num_seq_kcg bigint, dta_inic_vign_kcg date, dta_fim_vign_kcg date", [(1, 1, day("2020-01-01"), day("2030-01-01")), (1, 2, day("2019-01-01"), None), (2, 3, None, day("2020-01-01")), (2, 4, day("2010-01-01"), day("2021-01-01"))]),
    "rel_det_classif_mmgd": ("num_seq_kcd bigint, cod_tipo_css_ger_kcd string", [(2, "two"), (4, "four")]),
    "rel_micro_ger_benef": ("cod_un_cons_ben_xbg bigint, num_cli_ben_xbg bigint, con_val_xbg string, dta_inic_vign_xbg date, dta_fim_vign_xbg date", [
        (1, 11, "AT", day("2024-01-01"), day("2024-02-29")), (1, 11, "AT", day("2023-01-01"), None), (1, 11, "AT", day("2024-03-02"), None), (1, 12, "AT", day("2023-01-01"), None)]),
}


def tables(spark, spec):
    return {k: spark.createDataFrame(rows, schema) for k, (schema, rows) in spec.items()}


def test_registry(spark):
    t = tables(spark, REGISTRY)
    got = {r["UC"]: r for r in registry(t, "2024-02-15", "riverton").collect()}
    assert set(got) == {1, 2} and len(next(iter(got.values()))) == 29
    one, two = got[1], got[2]
    assert (one["SMART"], two["SMART"]) == (0, 1)  # the kind rules the first out, and names the second
    assert (one["SUB_GRUPO"], two["SUB_GRUPO"], one["TARIFA_BRANCA"], one["BAIXA_RENDA"], two["BAIXA_RENDA"]) == ("B", "B1", "S", "S", "N")
    assert (one["MODALIDADE_GERACAO"], one["GERACAO_PROPRIA"], two["GERACAO_PROPRIA"]) == ("C", "S", "N")
    assert (one["TIPO_GD"], two["TIPO_GD"], two["DATA_FIM_GD"]) == ("two", "four", "2021-01-01")
    assert (one["BENEFICIARIA_GD"], one["INICIO_BENEFICIARIA"], one["FIM_BENEFICIARIA"], two["BENEFICIARIA_GD"]) == ("S", "2023-01-01", None, "N")
    assert registry(t, "2024-02-15").count() == 3  # every town; one removed meter is out
    poles = registry(t, "2024-02-15", "RIVERTON", with_poles=True)
    assert poles.filter("UC = 1").count() == 2 and "LAT_POSTE_WGS84" in with_pole_position(poles).columns


def test_smart_numbers(spark):
    rows = spark.createDataFrame([("41000000", None), ("46000000", "x"), ("46000001", None), ("x", "intel"), ("42000000", "QualI")], "n string, k string")
    assert [r[0] for r in rows.select(smart_flag(F.col("n"), F.col("k"))).collect()] == [1, 1, 0, 1, 0]


NETWORK = {
    "UC_ENERGIA": ("ISN_UC bigint, TIPO_SIT_UC string, NUMERO_POSTO_UC string", [(1, "LG", "P1"), (2, "CR", "P2"), (3, "XX", "P1"), (4, "DS", "9PTMUN"), (5, "LG", "P9"), (1, "LG", "P1")]),
    "POSTO_TRANSFORMADOR": ("NUM_OPER_POSTO string, POT_INST_POSTO double, NUM_GEO_TRECHO_PRIM_POSTO bigint", [("P1", 45.0, 10), ("P2", 75.0, None)]),
    "TRECHO_PRIMARIO": ("NUM_SEQ_GEO bigint, NUM_GEO_ALIM_TRPRIM bigint", [(10, 20)]),
    "ALIMENTADOR_GEO": ("NUM_SEQ_GEO bigint, NUM_GEDIS_ALIMG bigint, NUM_ALIM_ALIMG bigint", [(20, 30, 40)]),
    "ALIMENTADOR": ("NUM_GEDIS_ALIM bigint, NUM_SEQ_ALIM bigint, NOME_ALIM string, TENSAO_OPER_ALIM double, NUM_SEQ_SE_ALIM bigint", [(30, 41, "wrong", 1.0, 50), (30, 40, "F1", 13.8, 50)]),
    "SUBESTACAO": ("NUM_SEQ_SE bigint, NOME_SE string, SIGLA_SE string, TENSAO_NOM_SE double, CAR_SE string, COD_MUN_SE int", [(50, "Sub", "S", 138.0, "c", 60)]),
    "MUNICIPIO": ("COD_MUN int, NOME_MUN string", [(60, "Town")]),
}


def test_topology(spark):
    t = tables(spark, NETWORK)
    got = {r["UC"]: r for r in topology(t).collect()}
    assert set(got) == {1, 2} and len(got[1]) == 13 and (got[1]["ALIMENTADOR"], got[1]["MUNICIPIO_SE"], got[2]["ALIMENTADOR"]) == ("F1", "Town", None)
    keys = spark.createDataFrame([("0002",), (None,), ("000",)], "uc string")
    assert [r["UC"] for r in topology(t, keys).collect()] == [2]
    assert [r["UC"] for r in topology(t, feeders=[30]).collect()] == [1]


def test_joins_keep_names_apart(spark):
    left = spark.createDataFrame([("1", "a"), ("2", "b")], "UC string, NAME string")
    right = spark.createDataFrame([("01", "x", 1)], "UC string, NAME string, POWER int")
    assert join_prefixed(left, right.limit(0), "UC").count() == left.count()  # nothing to join with changes no rows
    assert join_prefixed(left, right, "UC").count() == 0 and join_prefixed(left, right.drop("UC"), "UC").columns == left.columns
    assert join_prefixed(left, right, "UC", how="left").columns == ["UC", "NAME", "GEO_NAME", "GEO_POWER"]
    met = join_colliding(left, right, "UC", "GEO_")
    assert met.columns == ["UC", "NAME", "GEO_NAME", "POWER"] and sorted(map(tuple, met.collect())) == [("1", "a", "x", 1), ("2", "b", None, None)]
    with pytest.raises(Exception, match="repeated keys: 1 .2 rows"):
        join_colliding(left, right.union(right), "UC", "GEO_").collect()


def test_latest_orders_nulls(spark):
    rows = spark.createDataFrame([(1, day("2020-01-01"), day("2030-01-01"), "a"), (1, None, None, "b"), (1, day("2021-01-01"), None, "c")], "k int, s date, e date, v string")
    assert latest_open_first(rows, ["k"], "s", "e").first()["v"] == "b" and latest_by_end(rows, ["k"], "s", "e").first()["v"] == "b"


def channels(spark):
    t0, t1, off = datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 5), datetime(2024, 1, 1, 0, 7)
    d = Decimal
    rows = {
        "biz_pub_data_f_energy_c": [(1, t0, d("0")), (2, t0, d("1.5")), (1, off, d("9")), (1, t1, None), (3, t1, d("4"))],
        "biz_pub_data_current": [(1, t1, d("2"), None, d("3"))],
        "biz_pub_data_f_energy_d": [(1, t0, d("100"), None, None, None, None)],
    }
    made = {k: spark.createDataFrame(rows.get(k, []), channel_schema(k)) for k in CHANNELS}
    catalogue = spark.createDataFrame([(1, "00123"), (2, "123"), (3, "0000"), (4, "77")], "data_id bigint, meter_asset_no string")
    return made, catalogue


def test_measures():
    assert len(MEASURES) == 33 and len(set(MEASURES)) == 33 and MEASURES[0] == "fa_interval" and "i_instant_l1" in MEASURES


def test_daily_table_and_back(spark):
    made, catalogue = channels(spark)
    daily = R.daily_table(made, catalogue)
    rows = daily.collect()
    assert len(rows) == 1 and len(daily.columns) == 35
    r = rows[0]
    assert (r["nio"], r["fa_interval"], r["i_l1_avg"], r["fa_total"], r["ra_interval"]) == ("123", '{"00:00":1.500}', '{"00:05":2.000}', '{"00:00":100.000}', "{}")
    back = {(x["measure"], x["hhmi"], x["value"]) for x in R.series_rows(daily, ["nio"], MEASURES).collect()}
    slots = R.slot_values(R.with_meter(R.united_channels(made), catalogue), ["nio"], MEASURES)
    want = {(m, s["hhmi"], s[m]) for s in slots.collect() for m in MEASURES if s[m] is not None}
    assert back == want
    snapped = R.slot_values(R.with_meter(R.united_channels(made, snap=True), catalogue), ["nio"], MEASURES)
    assert snapped.filter("hhmi = '00:05'").first()["fa_interval"] == Decimal("9")
    keys = spark.createDataFrame([("77",)], "k string")
    assert R.daily_table(made, catalogue, keys).count() == 0


def test_long_table_equals_the_join_form(spark):
    made, catalogue = channels(spark)
    one = R.time_grid(made, catalogue)
    two = R.long_table_by_joins(made, catalogue).select(*one.columns)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.count() == 3


def test_daily_series_plan_has_no_python_and_few_exchanges(spark):
    made, catalogue = channels(spark)
    plan = R.daily_table(made, catalogue)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_weather(spark):
    rows = spark.createDataFrame(
        [(day("2024-01-01"), 1.0, 2.0, (["2024-01-01T00:00", "2024-01-01T13:00", "x"], [1.5, None], [9.0, 8.0, 7.0]))],
        W.payload_schema(["t", "p"]),
    )
    hours = W.hourly_rows(rows, ["t", "p"])
    assert sorted(map(str, (tuple(r)[1:] for r in hours.collect()))) == sorted(map(str, [(0, 1.5, 9.0), (13, None, 8.0), (None, None, 7.0)]))
    daily = W.daily_weather(hours.filter("hour IS NOT NULL"), ["t", "p"])
    text = daily.first()["t"]
    assert text.startswith('{"00:00":1.5,"01:00":null') and text.count(":00") == 24
    slots = spark.createDataFrame([(day("2024-01-01"), 13, 1), (day("2024-01-02"), 13, 2)], "day date, hour int, k int")
    got = {r["k"]: r["weather_p"] for r in W.onto_slots(slots, hours).collect()}
    assert got == {1: 8.0, 2: None} and W.onto_slots(slots.drop("hour"), hours).columns == ["day", "k"]
    meters = spark.createDataFrame([("1",), ("2",)], "NIO string")
    assert W.for_meters(meters, daily).count() == 2
    points = spark.createDataFrame([(1.0, 5.0), (3.0, None), (None, 7.0), (10.0, 9.0)], "LAT double, LONG double")
    assert tuple(W.median_point(points).first()) == (3.0, 7.0)


@pytest.mark.parametrize("size, want", [(0, []), (1, [50]), (3, [0, 50, 99]), (100, list(range(100))), (200, list(range(100)))])
def test_spread_sample(spark, size, want):
    got = spread_sample(spark.range(100), size, [F.col("id")])
    assert sorted(r["id"] for r in got.collect()) == want


def test_spread_sample_prefers(spark):
    got = sorted(r["id"] for r in spread_sample(spark.range(100), 12, [F.col("id")], F.col("id") % 10 == 0).collect())
    assert set(range(0, 100, 10)) <= set(got) and len(got) == 12
    assert [r["id"] for r in spread_sample(spark.range(100), 2, [F.col("id")], F.col("id") % 10 == 0).orderBy("id").collect()] == [0, 90]


def files(spark, sizes):
    return spark.createDataFrame([(f"meter_cis_202606{n:02d}.csv", s) for n, s in enumerate(sizes, 1)], "name string, size_bytes bigint")


def test_sizes(spark):
    dated = Q.named_files(files(spark, [100, 200, 300]))
    s = Q.size_stats(dated).first()
    assert (s["count"], s["mean_bytes"], s["std_bytes"], s["median_bytes"], s["min_date"], s["max_date"]) == (3, 200.0, 100.0, 200.0, day("2026-06-01"), day("2026-06-03"))
    assert Q.size_stats(Q.named_files(files(spark, [5]))).first()["std_bytes"] == 0
    assert Q.size_outliers(files(spark, [1000] * 10 + [1_000_000])).count() == 1 and Q.size_outliers(files(spark, [7] * 5)).count() == 0


def test_size_days_skip_files_without_a_day(spark):
    dated = files(spark, [100, 300]).union(spark.createDataFrame([("nameless.csv", 1), ("other.csv", 900)], files(spark, [1]).schema))
    s = Q.size_stats(Q.named_files(dated)).first()
    assert (s["min_bytes"], s["max_bytes"], s["median_bytes"]) == (1, 900, 200.0) and (s["min_date"], s["max_date"]) == (day("2026-06-01"), day("2026-06-02"))
    assert tuple(Q.size_stats(Q.named_files(dated.limit(0))).first())[:2] == (0, None)


def test_median(spark):
    import statistics

    values = [5.0, 1.0, 1.0, 9.5, None, 2.0] * 7 + [3.0]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    assert median_of(df, "x").first()[0] == statistics.median(v for v in values if v is not None)
    assert median_of(df.filter("x > 100"), "x").first()[0] is None


def test_coverage(spark):
    def got(days, first=None, last=None):
        df = spark.createDataFrame([(day(d),) for d in days], "day date")
        return tuple(Q.coverage(df, first and day_literal(first), last and day_literal(last)).first())

    assert got(["2026-06-01", "2026-06-03"]) == (3, 2, 66.7, False, "2026-06-02")
    assert got(["2026-06-01", "2026-06-05"])[0::4] == (5, "2026-06-02,2026-06-03,2026-06-04")
    assert got([]) == (0, 0, 0.0, True, "")
    assert got([], "2026-06-01", "2026-06-09") == (0, 0, 0.0, True, "")
    assert got(["2026-06-02"], "2026-06-01", "2026-06-02") == (2, 1, 50.0, False, "2026-06-01")


def test_names_and_days(spark):
    df = spark.createDataFrame([("meter_cis_20260615.csv",), ("cis_20260615.csv",), (".hidden.csv",), ("_x.csv",), ("a.txt",), ("meter_geo_99999999.csv",)], "name string")
    got = {r["name"]: r["valid"] for r in Q.named_files(df).collect()}
    assert got == {"meter_cis_20260615.csv": True, "cis_20260615.csv": False, "meter_geo_99999999.csv": False}
    said = {r["name"]: r["message"] for r in Q.days_back_consistent(df, day_literal("2026-06-15")).collect()}
    assert said["meter_cis_20260615.csv"] == "as expected" and said["a.txt"] == "no day in the name"


def test_unique_keys(spark):
    df = spark.createDataFrame([("a",), ("a",), ("",), ("",), (None,), (None,), ("b",)], "k string")
    assert [tuple(r) for r in Q.duplicate_keys(df, ["k"]).collect()] == [("a", 2)]
    with pytest.raises(ValueError, match="a"):
        Q.require_unique(df, ["k"])


def test_verify_output(spark):
    df = spark.createDataFrame([("1", "a"), (" 1", "A"), ("2", None)], "uc string, nio string")
    got = {r["check"]: r["passed"] for r in Q.verify_output(df, ["UC", "NIO"], 3).collect()}
    assert got == {"has_header": True, "key_columns_present": True, "no_nulls_in_keys": False, "row_count_coherent": True, "no_duplicates": False}
    assert not {r["check"]: r["passed"] for r in Q.verify_output(df.drop("nio"), ["UC", "NIO"], 30).collect()}["key_columns_present"]
    assert Q.verify_output(df.limit(0), ["UC"], 1).count() == 5


def test_integrity(spark):
    good = files(spark, [100] * 30)
    snaps = spark.createDataFrame([(day("2026-06-29"),)], "day date")
    report = Q.integrity_report(good, snaps, "2026-07-01", 29)
    assert tuple(Q.summary(report).first()) == (4, 4, 0, True)
    bad = Q.integrity_report(good.union(spark.createDataFrame([("x.csv", 1), ("meter_cis_20260615.csv", 9_000_000)], good.schema)), snaps, "2026-07-09")
    assert {r["check"]: r["passed"] for r in bad.collect()} == {"file_naming": False, "period_coverage": False, "file_sizes": False, "ucs_file": False}
    other = spark.createDataFrame([("meter_geo_20260701.csv", 9_000_000)], good.schema)
    hidden = Q.integrity_report(good.union(other), snaps, "2026-07-02", 30)  # a file of another kind neither fills a day nor stands out
    assert {r["check"]: r["passed"] for r in hidden.collect()} == {"file_naming": True, "period_coverage": False, "file_sizes": True, "ucs_file": True}
    none = Q.integrity_report(good.limit(0), snaps.limit(0), "2026-07-01")
    assert {r["check"]: r["passed"] for r in none.collect()} == {"file_naming": True, "period_coverage": True, "file_sizes": True, "ucs_file": False}
