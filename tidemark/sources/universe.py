"""Universes of instruments, and what class each is of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Liquid exchange-traded funds by asset class.
FUNDS = {
    "us_sector_tech": "XLK", "us_sector_fin": "XLF", "us_sector_energy": "XLE", "us_sector_health": "XLV", "us_sector_staples": "XLP", "us_sector_discr": "XLY", "us_sector_ind": "XLI", "us_sector_utility": "XLU", "us_sector_mat": "XLB",
    "us_broad": "SPY QQQ IWM VTI IWB", "us_style_lg_value": "IWD", "us_style_lg_growth": "IWF", "us_style_sm_value": "IWN", "us_style_sm_growth": "IWO",
    "intl_developed": "EFA VEA", "intl_japan": "EWJ", "intl_germany": "EWG", "intl_uk": "EWU", "intl_australia": "EWA", "intl_canada": "EWC", "intl_hongkong": "EWH", "intl_italy": "EWI", "intl_spain": "EWP", "intl_france": "EWQ", "intl_switzerland": "EWL", "intl_taiwan": "EWT", "intl_singapore": "EWS", "intl_korea": "EWY", "intl_eurozone": "EZU", "intl_asiapac_exjp": "EPP",
    "em_broad": "EEM VWO", "em_india": "INDA", "em_china": "FXI", "em_brazil": "EWZ", "em_mexico": "EWW", "em_poland": "EPOL", "em_safrica": "EZA", "em_turkey": "TUR",
    "bonds_lg_treasury": "TLT", "bonds_md_treasury": "IEF", "bonds_sh_treasury": "SHY", "bonds_ig_corp": "LQD", "bonds_hy_corp": "HYG", "bonds_aggregate": "AGG", "bonds_tips": "TIP", "bonds_em": "EMB",
    "commodity_gold": "GLD", "commodity_silver": "SLV", "commodity_oil": "USO", "commodity_natgas": "UNG", "commodity_ag": "DBA", "commodity_broad": "DBC", "fx_usd": "UUP", "fx_eur": "FXE",
    "reit_us": "VNQ IYR", "preferred_stock": "PFF",
}


def funds(spark: SparkSession) -> DataFrame:
    """ticker, asset_class of each fund."""
    rows = F.array(*[F.struct(F.lit(t).alias("ticker"), F.lit(c).alias("asset_class")) for c, ts in FUNDS.items() for t in ts.split()])
    return spark.range(1).select(F.inline(rows))


def classed(rows: DataFrame, classes: DataFrame, default: str = "unknown") -> DataFrame:
    """rows (ticker, ...) with asset_class; ``default`` for a ticker that ``classes`` (a ticker once) doesn't name."""
    named = classes.select(F.col("ticker").alias("__t"), F.col("asset_class").alias("__c"))
    return rows.join(named, F.col("ticker") == F.col("__t"), "left").withColumn("asset_class", F.coalesce("__c", F.lit(default))).drop("__t", "__c")
