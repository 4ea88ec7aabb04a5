"""One vessel type per vessel, and vessel classes on windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wakeline.functions.vessel import vessel_class


def vessel_type_lookup(segments: DataFrame) -> DataFrame:
    """Most frequent type code per vessel (the lowest of equals) and its class.

    Counting per (vessel, code) first keeps the shuffle at one row per pair and task.
    """
    code = F.col("vessel_type").try_cast("double").try_cast("int")
    counts = segments.filter(F.col("mmsi").isNotNull()).groupBy("mmsi", code.alias("code")).agg(
        F.count(F.lit(1)).alias("c")
    )
    best = F.min(F.when(F.col("code").isNotNull(), F.struct((-F.col("c")).alias("c"), "code")))
    return counts.groupBy("mmsi").agg(best["code"].alias("vessel_type_code")).withColumn(
        "vessel_class", vessel_class(F.col("vessel_type_code"))
    )


def attach_class(windows: DataFrame, lookup: DataFrame) -> DataFrame:
    """Class by vessel, 0 where the vessel is unknown. Spark broadcasts the lookup when its measured size allows."""
    return windows.join(lookup.select("mmsi", "vessel_class"), "mmsi", "left").withColumn(
        "vessel_class", F.coalesce("vessel_class", F.lit(0))
    )
