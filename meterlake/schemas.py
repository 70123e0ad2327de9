"""Names and types of source tables and measures."""

from __future__ import annotations

from pyspark.sql import types as T

MEASURE = T.DecimalType(18, 3)

#: Channel tables and their measures, as (column, name in the output).
CHANNELS = {
    "biz_pub_data_f_energy_c": (("fa_interval", "fa_interval"),),
    "biz_pub_data_r_energy_c": (("ra_interval", "ra_interval"),),
    "biz_pub_data_current": (("i_l1_avg", "i_l1_avg"), ("i_l2_avg", "i_l2_avg"), ("i_l3_avg", "i_l3_avg")),
    "biz_pub_data_voltage": (("u_l1_avg", "u_l1_avg"), ("u_l2_avg", "u_l2_avg"), ("u_l3_avg", "u_l3_avg")),
    "biz_pub_data_voltage_instant": (("u_l1", "u_l1"), ("u_l2", "u_l2"), ("u_l3", "u_l3")),
    "biz_pub_data_current_instant": (("i_l1", "i_instant_l1"), ("i_l2", "i_instant_l2"), ("i_l3", "i_instant_l3")),
    "biz_pub_data_q_energy_c": tuple((f"r_q{k}_interval", f"r_q{k}_interval") for k in range(1, 5)),
    "biz_pub_data_f_energy_d": (("fa", "fa_total"), *((f"fa_t{k}", f"fa_t{k}_total") for k in range(1, 5))),
    "biz_pub_data_r_energy_d": (("ra", "ra_total"), *((f"ra_t{k}", f"ra_t{k}_total") for k in range(1, 5))),
    "biz_pub_data_f_md_d": (("fa_md", "fa_md"), *((f"fa_md_t{k}", f"fa_md_t{k}") for k in range(1, 5))),
}

#: All measures, in the order of the output.
MEASURES = tuple(name for measures in CHANNELS.values() for _, name in measures)

CATALOGUE = T.StructType([T.StructField("data_id", T.LongType()), T.StructField("meter_asset_no", T.StringType())])


def channel_schema(table: str) -> T.StructType:
    """A channel table: ``data_id``, ``tv`` and its measures."""
    keys = [T.StructField("data_id", T.LongType()), T.StructField("tv", T.TimestampType())]
    return T.StructType(keys + [T.StructField(c, MEASURE) for c, _ in CHANNELS[table]])
