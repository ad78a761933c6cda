"""Positions from travel times: arrival finding, trilateration of reflectors and of elements."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rays
from .tomography import least_squares, written


def element_times(arrivals: DataFrame, iterations: int = 100) -> DataFrame:
    """e, time: the values of which the mean of both ends gives each pair's time (the element's own where t = r)."""
    row = F.struct("t", "r")
    ends = F.when(F.col("t") == F.col("r"), F.array(F.struct(F.col("t").alias("col"), F.lit(1.0).alias("w")))).otherwise(F.array(F.struct(F.col("t").alias("col"), F.lit(0.5).alias("w")), F.struct(F.col("r").alias("col"), F.lit(0.5).alias("w"))))
    matrix = arrivals.select(row.alias("row"), F.explode(ends).alias("p")).select("row", "p.col", "p.w")
    return least_squares(matrix, arrivals.select(row.alias("row"), F.col("time").alias("b")), iterations).select(F.col("col").alias("e"), F.col("x").alias("time"))


def distance_residual(positions: np.ndarray, centers: np.ndarray, pair: tuple[np.ndarray, np.ndarray], times: np.ndarray, speed: float, radius: float, with_speed: bool, with_radius: bool):
    """Residual function of radius + speed * time / 2 - distance for positions (and speed, radius)."""
    n = positions.size

    def residual(x):
        pos = x[:n].reshape(-1, 3)
        c = x[n] if with_speed else speed
        r = x[n + with_speed] if with_radius else radius
        d = pos[pair[0]] - centers[pair[1]]
        size = np.maximum(np.linalg.norm(d, axis=1), 1e-12)
        jac = np.zeros((len(times), len(x)))
        rows = np.arange(len(times))
        for k in range(3):
            jac[rows, 3 * pair[0] + k] = -d[:, k] / size
        if with_speed:
            jac[:, n] = times / 2
        if with_radius:
            jac[:, n + with_speed] = 1
        return r + c * times / 2 - size, jac

    return residual


def _solve(positions, centers, pair, times, speed, radius, with_speed, with_radius, plane_weight: float = 0.0):
    start = np.concatenate((positions.ravel(), [speed] * with_speed, [radius] * with_radius))
    base = distance_residual(positions, centers, pair, times, speed, radius, with_speed, with_radius)
    if not plane_weight or len(positions) < 4:
        return rays.newton_fit(base, start)

    def residual(x):
        f, jac = base(x)
        pos = x[: positions.size].reshape(-1, 3)
        n = rays.plane_normal(pos)
        flat = np.zeros((len(pos), len(x)))
        for k in range(3):
            flat[:, k : positions.size : 3] = -plane_weight * n[k] / len(pos)
            flat[np.arange(len(pos)), 3 * np.arange(len(pos)) + k] += plane_weight * n[k]
        return np.concatenate((f, plane_weight * (pos - pos.mean(axis=0)) @ n)), np.concatenate((jac, flat))

    return rays.newton_fit(residual, start)


def locate_targets(times: DataFrame, elements: DataFrame, guesses: DataFrame, speed: float, radius: float = 0.0, with_speed: bool = False, with_radius: bool = False) -> DataFrame:
    """target, x, y, z, c, radius, rms from times (target, e, time) at known elements; a group is one target."""
    rows = times.join(elements.select("e", *(F.col(c).alias(f"c{c}") for c in "xyz")), "e").join(guesses.select(F.col("e").alias("target"), "x", "y", "z"), "target")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pos = pdf[["x", "y", "z"]].iloc[:1].to_numpy(float)
        centers, t = pdf[["cx", "cy", "cz"]].to_numpy(float), pdf["time"].to_numpy(float)
        pair = (np.zeros(len(t), int), np.arange(len(t)))
        x = _solve(pos, centers, pair, t, speed, radius, with_speed, with_radius)
        f = distance_residual(pos, centers, pair, t, speed, radius, with_speed, with_radius)(x)[0]
        c, r = x[3] if with_speed else speed, x[3 + with_speed] if with_radius else radius
        return pd.DataFrame({"target": [pdf["target"].iloc[0]], "x": x[:1], "y": x[1:2], "z": x[2:3], "c": [c], "radius": [r], "rms": [np.sqrt(np.mean(f**2))]})

    return rows.groupBy("target").applyInPandas(solve, "target long, x double, y double, z double, c double, radius double, rms double")


def locate_elements(times: DataFrame, elements: DataFrame, targets: DataFrame, facet_size: int, plane_weight: float = 0.0) -> DataFrame:
    """e, x, y, z from times (target, e, time) to known targets (with c and radius); a group is one facet, kept flat by plane_weight."""
    known = targets.select("target", *(F.col(c).alias(f"c{c}") for c in "xyz"), "c", "radius")
    rows = times.join(known, "target").join(elements.select("e", "x", "y", "z"), "e").withColumn("facet", F.floor(F.col("e") / facet_size))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.drop_duplicates("e").sort_values("e")
        place = {e: k for k, e in enumerate(own["e"])}
        # each target's speed and radius go into its times, so that all share speed 2 and radius 0
        t = pdf["radius"].to_numpy() + pdf["c"].to_numpy() * pdf["time"].to_numpy() / 2
        pair = (pdf["e"].map(place).to_numpy(), np.arange(len(pdf)))
        x = _solve(own[["x", "y", "z"]].to_numpy(float), pdf[["cx", "cy", "cz"]].to_numpy(float), pair, t, 2.0, 0.0, False, False, plane_weight).reshape(-1, 3)
        return pd.DataFrame({"e": own["e"].to_numpy(), "x": x[:, 0], "y": x[:, 1], "z": x[:, 2]})

    return rows.groupBy("facet").applyInPandas(solve, "e long, x double, y double, z double")


def trilaterate(times: DataFrame, elements: DataFrame, guesses: DataFrame, speed: float, radius: float = 0.0, facet_size: int = 64, with_speed: bool = False, with_radius: bool = False, plane_weight: float = 0.0, stop: float = 1e-6, rounds: int = 10) -> tuple[DataFrame, DataFrame, list[tuple[float, float]]]:
    """(targets, elements, mean and deviation of the elements' shifts a round): both located in turn until neither moves."""
    log = []
    for _ in range(rounds):
        targets = written(locate_targets(times, elements, guesses, speed, radius, with_speed, with_radius), "targets")
        moved = written(locate_elements(times, elements, targets, facet_size, plane_weight), "elements")
        pairs = moved.join(elements.select("e", *(F.col(c).alias(f"o{c}") for c in "xyz")), "e")
        shift = F.sqrt(sum(((F.col(c) - F.col(f"o{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
        mean, sd, top = pairs.agg(F.avg(shift), F.stddev_pop(shift), F.max(shift)).first()
        log.append((mean, sd))
        elements, guesses = moved, targets.select(F.col("target").alias("e"), "x", "y", "z")
        if top is not None and top < stop:
            break
    return targets, elements, log
