"""Network topology: from consumer units to substations, and joins that keep names apart."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions.geo import reproject
from meterlake.functions.keys import collision_names, key_of, normalize_key, prefix_all
from meterlake.operators.quality import unique_rows

#: States of a unit that count as connected.
CONNECTED = ("LG", "CR", "DS")


def topology(t: Mapping[str, DataFrame], keys: DataFrame | None = None, feeders: Sequence[str] | None = None) -> DataFrame:
    """Transformer, feeder and substation of each unit; ``keys`` (one column) and ``feeders`` narrow the units."""
    units = t["UC_ENERGIA"].filter(~F.col("NUMERO_POSTO_UC").like("%PTMUN") & F.col("TIPO_SIT_UC").isin(*CONNECTED))
    if keys is not None:
        wanted = keys.select(normalize_key(keys[keys.columns[0]].cast("string"), "zeros_only_null").alias("__key")).filter("__key IS NOT NULL").distinct()
        units = units.join(wanted, key_of(units, "ISN_UC", "zeros_only_null") == wanted["__key"], "left_semi")
    met = (
        units.join(t["POSTO_TRANSFORMADOR"], F.col("NUMERO_POSTO_UC") == F.col("NUM_OPER_POSTO"))
        .join(t["TRECHO_PRIMARIO"].withColumnRenamed("NUM_SEQ_GEO", "TR_SEQ"), F.col("NUM_GEO_TRECHO_PRIM_POSTO") == F.col("TR_SEQ"), "left")
        .join(t["ALIMENTADOR_GEO"].withColumnRenamed("NUM_SEQ_GEO", "AG_SEQ"), F.col("NUM_GEO_ALIM_TRPRIM") == F.col("AG_SEQ"), "left")
        .join(t["ALIMENTADOR"], (F.col("NUM_GEDIS_ALIM") == F.col("NUM_GEDIS_ALIMG")) & (F.col("NUM_ALIM_ALIMG") == F.col("NUM_SEQ_ALIM")), "left")
        .join(t["SUBESTACAO"], F.col("NUM_SEQ_SE_ALIM") == F.col("NUM_SEQ_SE"), "left")
        .join(t["MUNICIPIO"], F.col("COD_MUN_SE") == F.col("COD_MUN"), "left")
    )
    if feeders is not None:
        met = met.filter(F.col("NUM_GEDIS_ALIMG").isin(*feeders))
    return met.select(
        F.col("ISN_UC").alias("UC"),
        F.col("TIPO_SIT_UC").alias("SITUACAO"),
        F.col("NUMERO_POSTO_UC").alias("POSTO_OPERACIONAL"),
        F.col("POT_INST_POSTO").alias("POT_INST_KVA"),
        F.col("NUM_GEDIS_ALIMG").alias("GEDIS_ALIMENTADOR"),
        F.col("NOME_ALIM").alias("ALIMENTADOR"),
        F.col("TENSAO_OPER_ALIM").alias("TENSAO_ALIMENTADOR"),
        F.col("NOME_SE").alias("SUBESTACAO"),
        "SIGLA_SE",
        F.col("TENSAO_NOM_SE").alias("TENSAO_SE"),
        "CAR_SE",
        F.col("NOME_MUN").alias("MUNICIPIO_SE"),
        F.col("COD_MUN").alias("COD_MUN_SE"),
    ).distinct()


def with_pole_position(df: DataFrame, x: str = "COORD_X_POSTE", y: str = "COORD_Y_POSTE", srid: int = 29192) -> DataFrame:
    return reproject(df, x, y, "LAT_POSTE_WGS84", "LONG_POSTE_WGS84", srid)


def join_prefixed(left: DataFrame, right: DataFrame, key: str, prefix: str = "GEO_", how: str = "inner") -> DataFrame:
    """Join on ``key`` with all other columns of the right side prefixed.

    A right side without ``key`` leaves the left as it is. One without rows keeps all rows of the left, whatever ``how`` says,
    with nulls in the prefixed columns, so that the schema does not depend on the data.
    """
    if key not in left.columns or key not in right.columns:
        return left
    named = prefix_all(right, [key], prefix)
    if how != "inner":
        return left.join(named, key, how)
    some = right.limit(1).agg((F.count(F.lit(1)) > 0).alias("__some"))
    met = left.join(named.withColumn("__hit", F.lit(True)), key, "left").join(F.broadcast(some), F.lit(True))  # one row
    return met.filter(F.col("__hit").isNotNull() | ~F.col("__some")).drop("__hit", "__some")


def join_colliding(left: DataFrame, right: DataFrame, key: str, prefix: str, mode: str = "digits_keep_zero") -> DataFrame:
    """Left join on the normalised key; the right side's keys must be unique (reading the result fails otherwise), and only its colliding names are prefixed."""
    names = collision_names(left.columns, right.columns, [key], prefix)
    keyed = right.select(key_of(right, key, mode).alias("__key"), *(right[c].alias(n) for c, n in names.items()))
    unique = unique_rows(keyed.filter("__key <> ''"), ["__key"])
    met = left.withColumn("__left", key_of(left, key, mode)).join(unique, F.col("__left") == F.col("__key"), "left")
    return met.drop("__left", "__key")
