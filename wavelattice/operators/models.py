"""Times that a slowness model predicts: tracers and interpolators by name, paths between elements and targets, eikonal fields."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config, ConfigError
from ..functions import rays
from .geometry import MAX_GRID, polylines, spread

PAIR = ("t", "r")


def _nearest(grid: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.clip(np.rint(points), 0, np.array(grid.shape) - 1).astype(int)
    return grid[tuple(at.T)], np.zeros((len(points), 3))


#: Values and gradients of a grid at points in voxel units, by name.
INTERPOLATORS: dict[str, Callable] = {"linear": rays.trilinear, "nearest": _nearest, "cubic": rays.tricubic}


def _shifted(grid: np.ndarray, step: tuple[int, int, int]) -> np.ndarray:
    at = [np.clip(np.arange(n) + s, 0, n - 1) for n, s in zip(grid.shape, step, strict=True)]
    return grid[np.ix_(*at)]


def median_filter(grid: np.ndarray, reach: int = 1) -> np.ndarray:
    """Median over the cube around each voxel; the edge repeats."""
    steps = np.ndindex(*(2 * reach + 1,) * 3)
    return np.median([_shifted(grid, tuple(k - reach for k in s)) for s in steps], axis=0)


def gaussian_filter(grid: np.ndarray, sigma: float = 1.0, trunc: float = 4.0) -> np.ndarray:
    """Gaussian weights along each axis; the edge repeats."""
    reach = int(trunc * sigma + 0.5)
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight /= weight.sum()
    for axis in range(3):
        grid = sum(w * _shifted(grid, tuple(k - reach if a == axis else 0 for a in range(3))) for k, w in enumerate(weight))
    return grid


#: Filters of a grid before it is traced, by name.
PREFILTERS: dict[str, Callable] = {"median": median_filter, "gaussian": gaussian_filter, "tv": lambda grid, weight=0.1, steps=50: rays.denoise_tv(grid, weight, steps)}


def interpolator(name: str, prefilter: dict | None = None) -> Callable[[np.ndarray], Callable]:
    """grid -> (points -> values and gradients), after a filter {'method', 'args', 'kwargs'}."""
    if name not in INTERPOLATORS:
        raise ConfigError(f"no interpolator {name!r}")
    if prefilter is not None and prefilter.get("method") not in PREFILTERS:
        raise ConfigError(f"no filter {prefilter.get('method')!r}")

    def make(grid: np.ndarray) -> Callable:
        if prefilter is not None:
            args = prefilter.get("args", ())
            grid = PREFILTERS[prefilter["method"]](grid, *(args if isinstance(args, (list, tuple)) else (args,)), **prefilter.get("kwargs", {}))
        return lambda points: INTERPOLATORS[name](grid, points)

    return make


def _straight(grid, points, options):
    return rays.path_integral(grid, points, options["sample"])[0]


def _straight_pairs(ends: np.ndarray, sample: Callable) -> np.ndarray:
    """``_straight`` of many paths of two points at once."""
    d = ends[:, 1] - ends[:, 0]
    at = ends[:, None, 0] + rays.NODES[None, :, None] * d[:, None]
    return sample(at.reshape(-1, 3))[0].reshape(len(ends), len(rays.NODES)) @ rays.WEIGHTS * np.linalg.norm(d, axis=1)


def _bent(grid, points, options):
    return rays.bent_path(grid, points, options["segments"], options["ptol"], options["sample"])[1]


def _fresnel(grid, points, options):
    vid, w = rays.fresnel_weights(points, options["wavelength"], grid.shape)
    if not len(w):
        return None
    return float(np.linalg.norm(np.diff(points, axis=0), axis=1).sum() * (w @ grid.ravel()[vid]) / w.sum())


def _compensated(grid, points, options):
    return rays.compensated_integral(grid, points[0], points[-1], options["panels"], 1.0, options["max_angle"])[0]


#: What a path's time is, by name of the tracer, and the options of each with their defaults.
TRACERS: dict[str, tuple[Callable, dict[str, Any]]] = {
    "straight": (_straight, {}),
    "bent": (_bent, {"segments": 16, "ptol": 1e-6}),
    "fresnel": (_fresnel, {"wavelength": 1.0}),
    "compensated": (_compensated, {"panels": 8, "max_angle": None}),
}


class Tracer:
    """Times along paths in a grid of ``ncell`` voxels between the corners ``lo`` and ``hi``; a path that leaves the grid has none."""

    def __init__(self, instance: str = "straight", lo=(0.0, 0.0, 0.0), hi=None, ncell=None, interpolator: str = "linear", prefilter: dict | None = None, **options):
        if instance not in TRACERS:
            raise ConfigError(f"no tracer {instance!r}")
        self.time, known = TRACERS[instance]
        if odd := set(options) - set(known):
            raise ConfigError(f"tracer {instance!r} has no option {sorted(odd)[0]!r}")
        if ncell is None or hi is None:
            raise ConfigError("a grid has lo, hi and ncell")
        self.lo, self.hi, self.ncell = np.asarray(lo, float), np.asarray(hi, float), tuple(ncell)
        self.options, self.make = known | options, globals()["interpolator"](interpolator, prefilter)
        if np.prod(self.ncell) > MAX_GRID:
            raise ConfigError("the grid is too large to send to every worker; trace over march() instead")

    @classmethod
    def from_config(cls, config: Config, section: str = "tracer") -> Tracer:
        """A tracer of options ``instance``, ``grid`` {lo, hi, ncell}, ``interpolator``, ``prefilter`` and its own; any other is an error."""
        options = {k: config.get(section, k) for k in config.options(section)}
        grid = options.pop("grid", {})
        if odd := set(grid) - {"lo", "hi", "ncell"}:
            raise ConfigError(f"a grid has no {sorted(odd)[0]!r}")
        return cls(**options, **grid)

    def times(self, paths: DataFrame, slowness: np.ndarray, keys=PAIR) -> DataFrame:
        """keys, time of paths (points array<array<double>> in world units); null where there is none."""
        if slowness.shape != self.ncell:
            raise ValueError(f"the slowness must have shape {self.ncell}")
        held = paths.sparkSession.sparkContext.broadcast(np.asarray(slowness, float))
        kinds = ", ".join(f"{k} {paths.schema[k].dataType.simpleString()}" for k in keys)
        lo, hi, size, make, time, options = self.lo, self.hi, (self.hi - self.lo) / self.ncell, self.make, self.time, self.options

        def run(batches):
            options["sample"] = make(held.value)
            for batch in batches:
                if time is _straight and set(batch.column("points").value_lengths().to_pylist()) == {2}:
                    value = np.full(len(batch), np.nan)
                    for own, ends in polylines(batch.column("points")):
                        good = np.all((ends >= lo) & (ends <= hi), axis=(1, 2))
                        value[own[good]] = _straight_pairs((ends[good] - lo) / size - 0.5, options["sample"]) * size[0]
                    yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(value, pa.float64(), from_pandas=True)], names=[*keys, "time"])
                    continue
                out = []
                for points in batch.column("points").to_pylist():
                    p = np.asarray(points, float)
                    inside = np.all((p >= lo) & (p <= hi)) and np.isfinite(p).all()
                    # voxel centres stand at whole numbers; lengths are in world units
                    try:
                        value = time(held.value, (p - lo) / size - 0.5, options) if inside else None
                    except ValueError:
                        value = None
                    out.append(None if value is None else value * float(size[0]))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(out, pa.float64())], names=[*keys, "time"])

        if not np.allclose(size, size[0]):
            raise ConfigError("voxels must be cubes")
        return paths.select(*keys, "points").mapInArrow(run, f"{kinds}, time double")


def paths_between(sources: DataFrame, targets: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """t, r, points of the wanted pairs (t, r), or of every source with every target (whose number is checked); tables of e, x, y, z."""
    point = lambda d, k: d.select(F.col("e").alias(k), F.array("x", "y", "z").alias(f"_{k}"))
    if wanted is not None:
        rows = wanted.join(point(sources, "t"), "t").join(point(targets, "r"), "r")
    else:
        if targets.count() > 100_000:
            raise ValueError("too many targets to pair with every source; list the pairs")
        rows = point(sources, "t").join(F.broadcast(point(targets, "r")))
    return rows.select("t", "r", F.array("_t", "_r").alias("points"))


def path_times(tracer: Tracer, slowness: np.ndarray, sources: DataFrame, targets: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """t, r, time; NaN where a path cannot be traced."""
    return tracer.times(paths_between(sources, targets, wanted), slowness).withColumn("time", F.coalesce("time", F.lit(float("nan"))))


#: Voxels of the fields that a task computes at once: about 16 fields of 4,096 voxels, one of a large grid.
FIELD_CELLS = 64 << 10


def eikonal_times(sources: DataFrame, targets: DataFrame, slowness: np.ndarray, lo=(0.0, 0.0, 0.0), size: float = 1.0) -> DataFrame:
    """t, r, time: first arrivals from the field of each source, computed once a source, at every target (whose number is checked)."""
    if slowness.size > MAX_GRID:
        raise ValueError("the grid is too large to send to every worker")
    places = targets.select("e", "x", "y", "z").limit(100_001).collect()
    if len(places) > 100_000:
        raise ValueError("too many targets")
    sc = targets.sparkSession.sparkContext
    held = sc.broadcast((np.asarray(slowness, float), np.array([[p.x, p.y, p.z] for p in places], float).reshape(-1, 3), [p.e for p in places]))
    corner, some = np.asarray(lo, float), max(1, FIELD_CELLS // slowness.size)

    def run(batches):
        grid, points, names = held.value
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in "xyz"], axis=-1)
            for k in range(0, len(batch), some):
                fields = rays.first_arrivals_of(grid, (place[k : k + some] - corner) / size - 0.5) * size
                value = np.concatenate([rays.trilinear(field, (points - corner) / size - 0.5)[0] for field in fields])
                t = batch.column("e").slice(k, some).cast(pa.int64()).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(t, len(names))), pa.array(names * len(t), pa.int64()), pa.array(value)], names=["t", "r", "time"])

    return spread(sources.select("e", "x", "y", "z")).mapInArrow(run, "t long, r long, time double")


def model_times(tracer: Tracer, slowness: np.ndarray, sources: DataFrame, targets: DataFrame, eikonal: bool = False) -> DataFrame:
    """t, r, time of every source and target, traced or from eikonal fields."""
    if eikonal:
        return eikonal_times(sources, targets, slowness, tuple(tracer.lo), float((tracer.hi[0] - tracer.lo[0]) / tracer.ncell[0]))
    return tracer.times(paths_between(sources, targets), slowness)
