"""Rolling and ordered operators on samples (keys..., s, v): window functions over each signal.

The rows of a signal are one window partition; signals are bounded by their number of
samples, so partitions stay small however many signals there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAIR = ("t", "r")


def to_samples(waves: DataFrame, keys=PAIR, data: str = "data", start: str = "dstart") -> DataFrame:
    """One row a sample."""
    return waves.select(*keys, F.posexplode(data).alias("pos", "v"), *([F.col(start).alias("at")] if start in waves.columns else [])).select(
        *keys, (F.col("pos") + (F.col("at") if start in waves.columns else F.lit(0))).cast("long").alias("s"), F.col("v").cast("double").alias("v")
    )


def to_waves(samples: DataFrame, keys=PAIR) -> DataFrame:
    """The arrays again, in sample order."""
    held = samples.groupBy(*keys).agg(F.min("s").alias("dstart"), F.array_sort(F.collect_list(F.struct("s", "v"))).alias("p"))
    return held.select(*keys, "dstart", F.transform("p", lambda p: p["v"]).alias("data"))


def _frame(keys, lo: int, hi: int) -> W:
    return W.partitionBy(*keys).orderBy("s").rowsBetween(lo, hi)


def padded_power(samples: DataFrame, before: int, after: int, keys=PAIR, edges: str | float = "rms") -> DataFrame:
    """(keys, s, v, pw) with rows added before and after each signal.

    edges: 'rms' repeats the mean power, 'wrap' the signal itself, a negative number the peak
    power that many dB down.
    """
    power = samples.withColumn("pw", F.col("v") * F.col("v"))
    if edges == "wrap":
        whole = power.groupBy(*keys).agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
        rows = whole.select(*keys, "lo", (F.col("hi") - F.col("lo") + 1).alias("n"), F.explode(F.concat(F.sequence(F.col("lo") - before, F.col("lo") - 1), F.sequence(F.col("hi") + 1, F.col("hi") + after))).alias("s"))
        rows = rows.withColumn("source", F.col("lo") + F.pmod(F.col("s") - F.col("lo"), F.col("n")))
        source = power.select(*keys, F.col("s").alias("source"), "pw")
        pads = rows.join(source, [*keys, "source"]).select(*keys, "s", F.lit(None).cast("double").alias("v"), "pw")
    else:
        level = F.avg("pw") if edges == "rms" else F.max("pw") * _down(edges)
        whole = power.groupBy(*keys).agg(level.alias("pw"), F.min("s").alias("lo"), F.max("s").alias("hi"))
        parts = [F.sequence(F.col("lo") - before, F.col("lo") - 1)] + ([F.sequence(F.col("hi") + 1, F.col("hi") + after)] if after else [])
        pads = whole.select(*keys, F.explode(F.concat(*parts)).alias("s"), F.lit(None).cast("double").alias("v"), "pw")
    return power.unionByName(pads)


def _down(edges) -> float:
    if not isinstance(edges, (int, float)) or edges >= 0:
        raise ValueError("edges must be 'rms', 'wrap' or a negative number")
    return 10.0 ** (edges / 10)


def energy_ratio(samples: DataFrame, prewin: int, postwin: int | None = None, vpwin: int = 0, keys=PAIR, edges: str | float = "rms") -> DataFrame:
    """(keys, s, v, ner, fer): mean power from a sample on against that before it, near and far (fer null without vpwin)."""
    postwin = postwin or prewin
    if prewin <= 0 or postwin <= 0 or vpwin < 0:
        raise ValueError("windows must be positive")
    rows = padded_power(samples, prewin + vpwin, max(postwin - 1, 0), keys, edges)
    after = F.avg("pw").over(_frame(keys, 0, postwin - 1))
    near = F.avg("pw").over(_frame(keys, -prewin, -1))
    far = F.avg("pw").over(_frame(keys, -prewin - vpwin, -prewin - 1)) if vpwin else F.lit(None).cast("double")
    return rows.select(*keys, "s", "v", (after / near).alias("ner"), (after / far).alias("fer")).where("v is not null")


def modified_ratio(ratios: DataFrame, erpow: float = 3, sigpow: float = 3, level: Column | None = None) -> DataFrame:
    """nmer and fmer added: ratio ** erpow * |v| ** sigpow (or of an envelope column)."""
    size = F.pow(F.abs(level if level is not None else F.col("v")), F.lit(sigpow))
    return ratios.withColumn("nmer", F.pow("ner", F.lit(erpow)) * size).withColumn("fmer", F.pow("fer", F.lit(erpow)) * size)


def imer(ratios: DataFrame, avgwin: int = 0, keys=PAIR) -> DataFrame:
    """imer added: centred moving average of far less near; the ends repeat the nearest average."""
    by = W.partitionBy(*keys).orderBy("s")
    if avgwin > 1:
        half = (avgwin - 1) // 2
        for c in ("nmer", "fmer"):
            # the first full frame ends avgwin - 1 samples in; earlier frames grow from the start
            ratios = ratios.withColumn(c, F.avg(c).over(by.rowsBetween(-(avgwin - 1 - half), half)))
        left = F.row_number().over(by.rowsBetween(W.unboundedPreceding, 0))
        size = F.count("*").over(W.partitionBy(*keys))
        # beyond the last full frame its value stands
        ratios = ratios.withColumn("_k", left).withColumn("_n", size)
        for c in ("nmer", "fmer"):
            held = F.last(F.when(F.col("_k") <= F.col("_n") - half, F.col(c)), True).over(by.rowsBetween(W.unboundedPreceding, 0))
            ratios = ratios.withColumn(c, held)
        ratios = ratios.drop("_k", "_n")
    return ratios.withColumn("imer", F.col("fmer") - F.col("nmer"))


def rolling_level(samples: DataFrame, width: int, keys=PAIR) -> DataFrame:
    """rms of the width samples before each; the first width samples repeat the first full value."""
    full = F.count("*").over(_frame(keys, -width, -1)) == width
    rows = samples.withColumn("_r", F.when(full, F.sqrt(F.avg(F.col("v") * F.col("v")).over(_frame(keys, -width, -1)))))
    by = W.partitionBy(*keys).orderBy("s").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return rows.withColumn("rms", F.coalesce("_r", F.first("_r", True).over(by))).drop("_r")


def rolling_snr(samples: DataFrame, width: int, keys=PAIR, level: str = "v") -> DataFrame:
    """snr added: 20 log10 of a level (an envelope, or |v|) over the noise before it; -inf of no level, inf over no noise, NaN of none over none."""
    top, rms = F.abs(F.col(level)).cast("double"), F.col("rms")
    least, most = (F.lit(x).cast("double") for x in ("-Infinity", "Infinity"))
    # top * inf is computed, so its NaN has the sign of a division of 0 by 0
    ratio = F.when(rms == 0, top * most).otherwise(top / F.when(rms != 0, rms))
    return rolling_level(samples, width, keys).withColumn("snr", F.when(ratio == 0, least).otherwise(20 * F.log10(ratio)))


def noise_floor(samples: DataFrame, width: int, keys=PAIR, least: float = 2.220446049250313e-16) -> DataFrame:
    """keys, floor: 20 log10 of the smallest standard deviation of width samples."""
    frame = _frame(keys, -(width - 1), 0)
    rows = samples.select(*keys, F.stddev_pop("v").over(frame).alias("sd"), F.count("v").over(frame).alias("n")).where(F.col("n") == width)
    return rows.groupBy(*keys).agg((20 * F.log10(F.greatest(F.min("sd"), F.lit(least)))).alias("floor"))


def peak_snr(samples: DataFrame, width: int, keys=PAIR, level: str = "v") -> DataFrame:
    """keys, snr: peak level in dB over the noise floor."""
    top = samples.groupBy(*keys).agg((20 * F.log10(F.max(F.abs(F.col(level))))).alias("peak"))
    return top.join(noise_floor(samples, width, keys), list(keys)).select(*keys, (F.col("peak") - F.col("floor")).alias("snr"))


def extremum(samples: DataFrame, keys=PAIR, largest: bool = True) -> DataFrame:
    """keys, value, s of the first largest or smallest sample."""
    pick = F.max(F.struct("v", (-F.col("s")).alias("k"))) if largest else F.min(F.struct("v", F.col("s").alias("k")))
    at = -F.col("p.k") if largest else F.col("p.k")
    return samples.groupBy(*keys).agg(pick.alias("p")).select(*keys, F.col("p.v").alias("value"), at.alias("s"))


def first_crossing(rows: DataFrame, value: str, threshold: float = 1.0, keys=PAIR) -> DataFrame:
    """keys, s: the first sample where value reaches threshold times its mean."""
    mean = F.avg(value).over(W.partitionBy(*keys))
    return rows.withColumn("_m", mean).where(F.col(value) >= threshold * F.col("_m")).groupBy(*keys).agg(F.min("s").alias("s"))


def breakaway(rows: DataFrame, value: str, crossings: DataFrame, width: int, deviations: float, keys=PAIR) -> DataFrame:
    """keys, s: the crossing moved back to where value last lay below its running mean + deviations * sd."""
    frame = _frame(keys, -(width - 1), 0)
    base = rows.withColumn("_b", F.avg(value).over(frame) + deviations * F.stddev_pop(value).over(frame))
    back = base.join(crossings.withColumnRenamed("s", "dl"), list(keys)).where("s < dl")
    back = back.groupBy(*keys, "dl").agg(F.max(F.when(F.col(value) < F.col("_b"), F.col("s"))).alias("b"))
    early = crossings.join(back.select(*keys, "b"), list(keys), "left")
    return early.select(*keys, F.when(F.col("b") + 1 < F.col("s"), F.col("b") + 1).otherwise(F.col("s")).alias("s"))


def energy_leak(samples: DataFrame, arrivals: DataFrame, keys=PAIR) -> DataFrame:
    """keys, leak: share of a signal's energy before its arrival (column at, in samples)."""
    running = F.sum(F.col("v") * F.col("v"))
    rows = samples.join(arrivals, list(keys))
    before = F.sum(F.when(F.col("s") < F.floor("at"), F.col("v") * F.col("v")).otherwise(0.0))
    return rows.groupBy(*keys).agg((before / running).alias("leak"))


def running_energy(samples: DataFrame, keys=PAIR) -> DataFrame:
    return samples.withColumn("energy", F.sum(F.col("v") * F.col("v")).over(W.partitionBy(*keys).orderBy("s").rowsBetween(W.unboundedPreceding, 0)))


def every_nth(rows: DataFrame, order: list[str], start: int, stride: int, within: list[str] | None = None) -> DataFrame:
    """Every stride-th row in order, from start on; within keys, or over all rows by two passes."""
    if within:
        k = F.row_number().over(W.partitionBy(*within).orderBy(*order)) - 1
        return rows.withColumn("_k", k).where((F.col("_k") >= start) & ((F.col("_k") - start) % stride == 0)).drop("_k")
    return numbered(rows, order).where((F.col("_k") >= start) & ((F.col("_k") - start) % stride == 0)).drop("_k")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """_k: rank of each row among all (0 first), without bringing all rows to one task.

    Rows are dealt into ranges of the first key; counts of the ranges give each its offset.
    """
    from .tomography import written

    sliced = rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("_p", F.spark_partition_id())
    sliced = sliced.withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy(*order)) - 1)
    sliced = written(sliced, "numbered")  # the ranges are drawn from a sample, so they must not be drawn twice
    sizes = sliced.groupBy("_p").agg(F.count("*").alias("_c"))
    offsets = sizes.select("_p", (F.coalesce(F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("_o"))
    return sliced.join(F.broadcast(offsets), "_p").withColumn("_k", F.col("_o") + F.col("_i")).drop("_p", "_i", "_o")
