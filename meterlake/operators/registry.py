"""The customer registry: which unit has which meter, with flags."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.calendar import day_literal
from meterlake.functions.keys import joined_text
from meterlake.operators.latest import latest_by_end, latest_open_first, valid_in_month

#: Classes of consumption with a social tariff.
LOW_INCOME = ("9109", "9111", "9113", "9114", "9116", "9115")


def smart_flag(meter: Column, kind: Column) -> Column:
    """1 for meters whose number lies in the smart range or whose kind says so, unless the kind rules it out."""
    named = F.upper(F.coalesce(kind, F.lit(" ")))
    number = meter.try_cast("bigint")
    smart = F.coalesce(number.between(41000000, 46000000), F.lit(False)) | named.like("%INTEL%")
    return F.when(smart & ~named.like("%QUALI%"), 1).otherwise(0)


def yes_no(condition: Column) -> Column:
    return F.when(condition, "S").otherwise("N")


def active_meters(links: DataFrame, units: DataFrame, places: DataFrame, towns: DataFrame, town: str | None = None) -> DataFrame:
    """Meters in place now (not removed), with their unit's town; ``town`` keeps one, in any case."""
    met = (
        links.filter(F.col("dta_reti_reu").isNull())
        .join(units, links["cod_un_cons_reu"] == units["cod_un_cons_uee"])
        .join(places, units["cod_loc_uee"] == places["cod_loc_loc"])
        .join(towns, places["cod_mun_loc"] == towns["cod_mun_mun"])
    )
    return met.filter(F.upper("nom_mun_mun") == town.upper()) if town else met


def own_generation(generation: DataFrame, population: DataFrame) -> DataFrame:
    """The highest mode of generation of each unit: in force, active or unmarked, up to the power limit."""
    g = generation.filter(
        F.col("dta_fim_vign_utg").isNull()
        & ((F.col("cod_situ_utg") == "AT") | F.col("cod_situ_utg").isNull())
        & (F.col("qtd_pot_ger_utg") <= 25000)
    )
    rows = g.join(population, g["cod_un_cons_utg"] == population["uc"], "left_semi")
    return rows.groupBy(F.col("cod_un_cons_utg").alias("uc")).agg(F.max("cod_modl_dis_utg").alias("modalidade_geracao"))


def generation_class(classes: DataFrame, details: DataFrame, population: DataFrame) -> DataFrame:
    """The latest class of generation of each unit."""
    rows = classes.join(population, classes["cod_un_cons_kcg"] == population["uc"], "left_semi")
    rows = rows.join(details, rows["num_seq_kcg"] == details["num_seq_kcd"], "left").select(
        F.col("cod_un_cons_kcg").alias("uc"),
        F.col("cod_tipo_css_ger_kcd").alias("tipo_gd"),
        F.col("dta_inic_vign_kcg").alias("data_inicio_gd"),
        F.col("dta_fim_vign_kcg").alias("data_fim_gd"),
    )
    return latest_open_first(rows, ["uc"], "data_inicio_gd", "data_fim_gd", [F.col("tipo_gd").asc_nulls_last()])


def beneficiaries(benefits: DataFrame, population: DataFrame, as_of: date | str) -> DataFrame:
    """The latest benefit in force in the month of ``as_of``, of each (unit, client)."""
    month = F.trunc(day_literal(as_of), "MM").cast("date")
    b = benefits.filter((F.col("con_val_xbg") == "AT") & valid_in_month(F.col("dta_inic_vign_xbg"), F.col("dta_fim_vign_xbg"), month))
    met = (b["cod_un_cons_ben_xbg"] == population["uc"]) & (b["num_cli_ben_xbg"] == population["cliente"])
    rows = b.join(population, met, "left_semi").select(
        F.col("cod_un_cons_ben_xbg").alias("uc"),
        F.col("num_cli_ben_xbg").alias("cliente"),
        F.col("dta_inic_vign_xbg").alias("inicio_beneficiaria"),
        F.col("dta_fim_vign_xbg").alias("fim_beneficiaria"),
    )
    return latest_by_end(rows, ["uc", "cliente"], "inicio_beneficiaria", "fim_beneficiaria")


def registry(t: Mapping[str, DataFrame], as_of: date | str, town: str | None = None, with_poles: bool = False) -> DataFrame:
    """The registry's 29 columns, from its twelve tables by name. Poles can repeat meters, so they join only when asked for."""
    rows = active_meters(t["rel_equip_uc"], t["cad_uc_ee"], t["tab_localidade"], t["tab_municipio"], town)
    rows = rows.join(t["cad_equip_med"], F.col("num_eqip_emd") == F.col("num_eqip_reu"), "left")
    rows = rows.join(t["cad_coordenada_uc_ee"], F.col("cod_un_cons_xxx") == F.col("cod_un_cons_uee"), "left")
    rows = rows.join(t["tab_sub_tipo_equip"], F.col("cod_sub_tipo_eqip_ste") == F.col("cod_sub_tipo_eqip_emd"), "left")
    if with_poles:
        poles = t["cad_pste_sist_extn"].filter(F.col("cod_situ_psx") == "AT")
        rows = rows.join(poles, F.col("num_pste_psx") == F.col("num_pste_uee"), "left")
    base = rows.withColumnsRenamed({"cod_un_cons_reu": "uc", "num_eqip_reu": "nio", "num_cli_uee": "cliente"})
    population = base.select("uc").distinct()
    clients = base.select("uc", "cliente").filter("cliente IS NOT NULL").distinct()
    own = own_generation(t["cad_uc_ger_energia"], population).withColumn("own", F.lit(True))
    kind = generation_class(t["rel_classif_mmgd"], t["rel_det_classif_mmgd"], population)
    ben = beneficiaries(t["rel_micro_ger_benef"], clients, as_of).withColumn("ben", F.lit(True))
    met = base.join(own, "uc", "left").join(kind, "uc", "left").join(ben, ["uc", "cliente"], "left")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    poles_out = [F.col("num_coorx_psx").alias("COORD_X_POSTE"), F.col("num_coory_psx").alias("COORD_Y_POSTE")] if with_poles else []
    return met.select(
        smart_flag(F.col("nio"), F.col("des_sub_tipo_eqip_ste")).alias("SMART"),
        F.col("uc").alias("UC"),
        F.col("nio").alias("NIO"),
        F.col("cliente").alias("CLIENTE"),
        F.col("qtd_tens_lig_uee").alias("QTD_TENS_LIG_UEE"),
        F.col("cod_tipo_disj_uee").alias("DISJUNTOR"),
        F.col("num_coory_xxx").alias("LAT"),
        F.col("num_coorx_xxx").alias("LONG"),
        F.col("nom_mun_mun").alias("MUNICIPIO"),
        F.col("des_sub_tipo_eqip_ste").alias("TIPO_MEDIDOR"),
        F.col("cod_sub_tipo_eqip_emd").alias("COD_SUBTIPO_MEDIDOR"),
        F.col("cod_situ_uee").alias("SITUACAO_UC"),
        iso("dta_situ_uee").alias("DATA_SITUACAO_UC"),
        iso("dta_ins_reu").alias("DATA_INSTALACAO_MEDIDOR"),
        iso("dta_reti_reu").alias("DATA_RETIRADA_MEDIDOR"),
        F.col("cod_tipo_fase_uee").alias("TIPO_FASE"),
        joined_text(F.col("cod_gru_tens_fat_uee"), F.col("cod_sub_gru_fat_uee")).alias("SUB_GRUPO"),
        F.col("cod_clas_cons_uee").alias("CLASSE_CONSUMO"),
        F.col("cod_tipo_entg_uee").alias("TIPO_ENTREGA"),
        yes_no(F.col("cod_tipo_tar_fat_uee") == "05").alias("TARIFA_BRANCA"),
        yes_no(F.col("cod_clas_cons_uee").isin(*LOW_INCOME)).alias("BAIXA_RENDA"),
        F.col("modalidade_geracao").alias("MODALIDADE_GERACAO"),
        yes_no(F.col("own").isNotNull()).alias("GERACAO_PROPRIA"),
        F.col("tipo_gd").alias("TIPO_GD"),
        iso("data_inicio_gd").alias("DATA_INICIO_GD"),
        iso("data_fim_gd").alias("DATA_FIM_GD"),
        yes_no(F.col("ben").isNotNull()).alias("BENEFICIARIA_GD"),
        iso("inicio_beneficiaria").alias("INICIO_BENEFICIARIA"),
        iso("fim_beneficiaria").alias("FIM_BENEFICIARIA"),
        *poles_out,
    )
