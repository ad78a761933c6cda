"""The tables behind frames and rasters of signals; drawing itself is left to others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A
from .rolling import to_samples

PAIR = ("t", "r")


def frame_table(groups: DataFrame, start: int, length: int, keys=PAIR, deviations: float | None = None, individual: bool = False) -> DataFrame:
    """keys, member, data, limit: each key's signals (keys, member, dstart, data) cut to a window and equalised by the key's (or their own) peak; limit is the largest peak a frame shows, or their mean and so many deviations."""
    cut = groups.withColumn("data", A.dense(F.col("data"), F.col("dstart"), start, length))
    peak = F.array_max(A.magnitude(F.col("data")))
    top = F.col("_peak") if individual else F.max("_peak").over(W.partitionBy(*keys))
    rows = cut.withColumn("_peak", peak).withColumn("_top", top)
    rows = rows.withColumn("data", F.when(F.col("_top") > 0, A.divide(F.col("data"), F.col("_top"))).otherwise(F.col("data")))
    own = F.array_max(A.magnitude(F.col("data")))
    by = W.partitionBy(*keys)
    limit = F.max("_own").over(by) if deviations is None else F.avg("_own").over(by) + deviations * F.stddev_pop("_own").over(by)
    return rows.withColumn("_own", own).select(*keys, "member", "data", limit.alias("limit"))


def image_table(waves: DataFrame, start: int, length: int, keys=PAIR, scale: str = "linear", floor_db: float = -60.0) -> DataFrame:
    """row, s, v: a raster with one row a signal, in key order; scale 'linear' or 'log' (decibels under the raster's peak, cut at floor_db)."""
    from .rolling import numbered

    rows = numbered(waves.select(*keys, A.dense(F.col("data"), F.col("dstart"), start, length).alias("data")), list(keys))
    samples = to_samples(rows.select(F.col("_k").alias("row"), "data"), keys=("row",))
    if scale == "linear":
        return samples.select("row", "s", "v")
    if scale != "log":
        raise ValueError(f"no scale {scale!r}")
    top = samples.agg(F.max(F.abs("v")).alias("_top"))
    rows = samples.crossJoin(F.broadcast(top))  # one row
    level = 20 * F.log10(F.abs("v") / F.col("_top"))
    return rows.select("row", "s", F.greatest(F.when(F.col("v") != 0, level).otherwise(F.lit(floor_db)), F.lit(floor_db)).alias("v"))
