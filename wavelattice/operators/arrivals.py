"""Arrival times from signals, as one job: conditioning, gates, delay, leaks, neighbourhoods, outliers, times."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import spectral as S
from . import pairs
from .tomography import written

PAIR = ["t", "r"]


def neighbourhood_average(waves: DataFrame, near: DataFrame) -> DataFrame:
    """Each pair's signal averaged with those of the pairs around it (near: e, n), over the whole signal."""
    around = pairs.neighbours(waves, near)
    samples = waves.select(F.col("t").alias("nt"), F.col("r").alias("nr"), "nsamp", F.posexplode("data").alias("p", "v"), "dstart").withColumn("s", F.col("p") + F.col("dstart"))
    sums = around.join(samples, ["nt", "nr"]).groupBy(*PAIR, "s").agg(F.sum("v").alias("v"), F.max("nsamp").alias("nsamp"))
    counts = around.groupBy(*PAIR).agg(F.count("*").alias("n"))
    held = sums.groupBy(*PAIR).agg(F.max("nsamp").alias("nsamp"), F.min("s").alias("dstart"), F.max("s").alias("last"), F.map_from_entries(F.collect_list(F.struct("s", "v"))).alias("m"))
    data = F.transform(F.sequence("dstart", "last"), lambda s: F.coalesce(F.element_at("m", s), F.lit(0.0)) / F.col("n"))
    return held.join(counts, PAIR).select(*PAIR, "nsamp", F.col("dstart").cast("long").alias("dstart"), data.alias("data"))


def _conditioned(x: np.ndarray, d: int, n: int, band, window, tail: int, square: bool) -> tuple[np.ndarray, int]:
    """Without its mean and limited to a band (start, end, tail), cut to a window (start, length) with Hann tails, squared with its sign."""
    if band is not None:
        x, d = K.bandpass(x - x.mean() if len(x) else x, d, n, *band), 0
    if window is not None:
        start = max(d, window[0])
        x, d = K.spread(x, d, start, max(0, min(d + len(x), window[0] + window[1]) - start)), start
        if tail:
            if 2 * tail > len(x):
                raise ValueError("the window is shorter than its tails")
            x = x * np.concatenate((K.hann(2 * tail)[:tail], np.ones(len(x) - 2 * tail), K.hann(2 * tail)[tail:]))
    return (x * np.abs(x) if square else x), d


def arrival_delays(waves: DataFrame, reference: tuple[list[float], int] | None = None, imer: dict | None = None, osamp: int = 1, band=None, window=None, tail: int = 0, square: bool = False, minsnr: tuple[float, int] | None = None, denoise: dict | None = None, peaks: dict | None = None, negative: bool = False, leak: float | None = None) -> DataFrame:
    """t, r, delay (samples) and status of every signal.

    The delay is the first crossing of the improved ratio (imer: its options) or that against a
    reference (samples, start).  Columns ``hint``, ``win_start`` and ``win_length`` of waves, if
    any, tell where to look for a peak and override the window.  A signal without a delay says
    why: low-snr (minsnr: decibels, noise window), failed-IMER, missing-peak, out-of-bounds,
    leaky (a share of the energy came before), or what was wrong with it.
    """
    if (reference is None) == (imer is None):
        raise ValueError("delays are against a reference or by the improved ratio")
    extra = [c for c in ("hint", "win_start", "win_length") if c in waves.columns]

    def delay(x: np.ndarray, d: int, hint) -> float:
        if imer is not None:
            try:
                return K.arrival_sample(x, d, osamp=osamp, **imer)
            except IndexError:
                raise ValueError("failed-IMER") from None
        if peaks is not None:
            options = {k: v for k, v in peaks.items() if k != "window"}
            try:
                peak = K.choose_peak(x, d, hint, **options)
            except ValueError:
                raise ValueError("missing-peak") from None
            lo, hi = K.peak_window(x, d, d + len(x), peak, peaks.get("window"))
            x, d = K.spread(x, d, lo, hi - lo), lo
        return K.find_delay(x, d, np.asarray(reference[0], float), reference[1], osamp, negative)[0]

    def kernel(n, d, x, *given):
        own = dict(zip(extra, given, strict=True))
        span = (own["win_start"], own["win_length"]) if own.get("win_start") is not None and own.get("win_length") is not None else window
        x, d = _conditioned(x, d, n, band, span, tail, square)
        if minsnr is not None:
            peak = K.envelope(x).max(initial=0)
            if 20 * np.log10(max(peak, np.finfo(float).tiny)) - K.noise_floor_db(x, minsnr[1]) < minsnr[0]:
                raise ValueError("low-snr")
        if denoise is not None:
            x = K.denoise(x, **denoise)
        at = delay(x, d, own.get("hint"))
        if leak is not None:
            energy, last = np.cumsum(x * x), int(at) - d - 1
            if not 0 <= last < len(energy):
                raise ValueError("out-of-bounds")
            if energy[last] >= leak * energy[-1]:
                raise ValueError("leaky")
        return (float(at),)

    rows = S.apply(waves, [*S.WAVE, *extra], {"delay": "double"}, kernel)
    return rows.withColumn("status", F.when(F.col("status") == "ok", "valid").otherwise(F.col("status")))


def arrival_times(waves: DataFrame, dt: float, t0: float, elements: DataFrame | None = None, near: DataFrame | None = None, cache: DataFrame | None = None, reach: float | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(t, r, time of every usable signal; status, n): delays as times delay * dt + t0.

    Pairs of the cache (t, r, delay) are not computed again.  With neighbourhoods (near: e, n)
    a pair is kept if its slowness is no outlier among those around it, without with ``reach``
    if it is none among all; both need the elements' positions (e, x, y, z).  A negative time
    is an error.
    """
    todo = waves if cache is None else pairs.uncached(waves, cache)
    made = arrival_delays(todo, **options)
    if cache is not None:
        made = made.unionByName(cache.select(*PAIR, "delay", F.lit("cached").alias("status")))
    made = written(made, "delays")
    good = made.where("delay is not null")
    if near is not None or reach is not None:
        if elements is None:
            raise TypeError("outliers are told by slowness, which takes the elements' positions")
        slow = pairs.with_endpoints(good, elements, elements).withColumn("_s", F.col("delay") / pairs.distance())
        if near is not None:
            kept = pairs.neighbourhood_outliers(slow.where("t <> r").select(*PAIR, "_s"), near, "_s").where("keep").select(*PAIR)
        else:
            kept = pairs.within_quartiles(written(slow.where("t <> r").select(*PAIR, "_s"), "slowness"), "_s", reach=reach).select(*PAIR)
        good = good.join(kept, PAIR, "left_semi")
    time = F.col("delay") * dt + t0
    times = good.select(*PAIR, F.when(time >= 0, time).otherwise(F.raise_error(F.lit("a negative arrival time")).cast("double")).alias("time"))
    return times, made.groupBy("status").agg(F.count("*").alias("n"))


def target_times(tables: list[DataFrame]) -> DataFrame:
    """t, r, times: the pairs that every target's table (t, r, time) has; none is an error."""
    rows = written(pairs.common_arrivals(tables), "targets")
    if not rows.limit(1).count():
        raise ValueError("no pair has a time for every target")
    return rows


def arrival_columns(files: list[DataFrame], columns: list[int] | None = None, freq: float = 1.0) -> DataFrame:
    """t, r, times: the values (t, r, values) of some files put together in file order, for the pairs that have most; some of their columns, times freq."""
    rows = reduce(DataFrame.unionByName, [f.select(*PAIR, F.lit(k).alias("file"), "values") for k, f in enumerate(files)])
    held = rows.groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct("file", "values"))).alias("p")).withColumn("v", F.flatten(F.transform("p", lambda p: p["values"])))
    most = held.agg(F.max(F.size("v")).alias("most"))
    held = held.join(F.broadcast(most), F.size("v") == F.col("most"))  # one row
    picked = F.col("v") if columns is None else F.array(*(F.element_at("v", c + 1 if c >= 0 else c) for c in columns))
    return held.select(*PAIR, F.transform(picked, lambda v: v * freq).alias("times"))
