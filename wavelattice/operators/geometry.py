"""Facets, reflector paths, surfaces and path-surface intersections."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rays
from .tomography import voxel_id


def norm(*parts: Column) -> Column:
    return F.sqrt(sum((p * p for p in parts), F.lit(0.0)))


def facet_normals(corners: DataFrame, all_points: bool = False, flat: float | None = 1e-12) -> DataFrame:
    """facet, nx, ny, nz: outward unit normals of facets (facet, place, x, y, z), of three corners or of the best plane.

    A facet has few elements; one group is one facet.  Corners whose cross product is no more
    than flat times the square of the largest coordinate lie in a line, and the mean stands for
    their normal; with flat None the cross product stands whatever its size, NaN where it is 0.
    """
    if not all_points:
        return _corner_normals(corners, flat)

    def normal(rows: pd.DataFrame) -> pd.DataFrame:
        points = rows.sort_values("place")[["x", "y", "z"]].to_numpy(float)
        n = rays.plane_normal(points)
        return pd.DataFrame({"facet": [rows["facet"].iloc[0]], "nx": n[:1], "ny": n[1:2], "nz": n[2:]})

    return corners.groupBy("facet").applyInPandas(normal, f"facet {corners.schema['facet'].dataType.simpleString()}, nx double, ny double, nz double")


def _corner_normals(corners: DataFrame, flat: float | None) -> DataFrame:
    """``rays.facet_normal`` of each facet, by column functions."""
    rows = corners.groupBy("facet").agg(F.array_sort(F.collect_list(F.struct("place", *(F.col(c).cast("double").alias(c) for c in "xyz")))).alias("p"))
    first, second, last = (F.element_at("p", k) for k in (1, F.when(F.size("p") > 1, 2).otherwise(1), -1))
    total = lambda c: F.aggregate(F.col("p"), F.lit(0.0), lambda s, x: s + x[c])
    rows = rows.select("facet", "p", *((second[c] - first[c]).alias(f"a{c}") for c in "xyz"), *((last[c] - first[c]).alias(f"b{c}") for c in "xyz"), *((total(c) / F.size("p")).alias(f"m{c}") for c in "xyz"))
    product = [F.col(f"a{p}") * F.col(f"b{q}") - F.col(f"a{q}") * F.col(f"b{p}") for p, q in ("yz", "zx", "xy")]
    rows = rows.withColumns({f"c{c}": v for c, v in zip("xyz", product, strict=True)})
    cross, mean = [F.col(f"c{c}") for c in "xyz"], [F.col(f"m{c}") for c in "xyz"]
    length = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    good = F.size("p") >= 3
    if flat is not None:
        most = F.aggregate(F.col("p"), F.lit(1.0), lambda s, x: F.greatest(s, *(F.abs(x[c]) for c in "xyz")))
        good &= length(cross) > flat * most * most
    rows = rows.withColumn("good", good)
    rows = rows.select("facet", *mean, *(F.when(F.col("good"), v).otherwise(m).alias(f"v{c}") for v, m, c in zip(cross, mean, "xyz", strict=True)))
    v = [F.col(f"v{c}") for c in "xyz"]
    size, out = length(v), F.when(v[0] * mean[0] + v[1] * mean[1] + v[2] * mean[2] >= 0, 1).otherwise(-1)
    return rows.select("facet", *(F.when(size != 0, x / F.when(size != 0, size) * out).otherwise(F.lit("NaN").cast("double")).alias(f"n{c}") for x, c in zip(v, "xyz", strict=True)))


def wave_paths(elements: DataFrame, reflectors: DataFrame, radius: float = 0.0) -> DataFrame:
    """e, f, distance, angle between the direction to a reflector and the element's inward normal (nx, ny, nz).

    Reflectors are few (checked); they are broadcast.
    """
    if reflectors.count() > 100_000:
        raise ValueError("too many reflectors")
    rows = elements.join(F.broadcast(reflectors.select(F.col("e").alias("f"), *(F.col(c).alias(f"f{c}") for c in "xyz"))))
    d = [F.col(f"f{c}") - F.col(c) for c in "xyz"]
    length = norm(*d)
    cosine = -sum((p * F.col(f"n{c}") for p, c in zip(d, "xyz", strict=True)), F.lit(0.0)) / length
    return rows.select("e", "f", (length - radius).alias("distance"), F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))).alias("angle"))


def surface_points(arrivals: DataFrame, elements: DataFrame, reflectors: DataFrame, speed: float, reach: float | None = 1.5, group: int | None = None, radius: float | None = None, use_miss: bool = False, at_least_radius: bool = False) -> DataFrame:
    """e, f, x, y, z, depth: the point where the ray from a reflector to an element meets the surface.

    depth is the distance from the reflector's centre, distance - time * speed / 2 (a reflector's
    own ``c`` and ``radius`` stand first); points beyond the element are left out, and outliers
    of depth by reflector (and group of elements).  With use_miss an element without a time has
    its point at the radius; with at_least_radius no point lies within it.
    """
    from .pairs import within_quartiles

    own = lambda name, value: F.coalesce(name, F.lit(value)) if name in reflectors.columns else F.lit(value)
    far = reflectors.select(F.col("e").alias("f"), *(F.col(c).alias(f"f{c}") for c in "xyz"), own("c", speed).cast("double").alias("_c"), own("radius", radius).cast("double").alias("_r"))
    times = arrivals.select(F.col("t").alias("e"), F.col("r").alias("f"), "time")
    if use_miss:
        if reflectors.count() > 100_000:
            raise ValueError("too many reflectors to pair with every element")
        rows = elements.join(F.broadcast(far)).join(times, ["e", "f"], "left")
    else:
        rows = times.join(elements, "e").join(far, "f")
    d = [F.col(f"f{c}") - F.col(c) for c in "xyz"]
    rows = rows.withColumn("ll", norm(*d))
    depth = F.col("ll") - F.col("time") * F.col("_c") / 2
    if at_least_radius:
        depth = F.when(F.col("time").isNotNull(), F.greatest(depth, F.col("_r")))
    rows = rows.withColumn("depth", F.coalesce(depth, F.col("_r")) if use_miss else depth).where("depth <= ll and depth >= 0 and ll > 0")
    place = [F.col(f"f{c}") - (F.col(f"f{c}") - F.col(c)) * F.col("depth") / F.col("ll") for c in "xyz"]
    rows = rows.select("e", "f", *(p.alias(c) for p, c in zip(place, "xyz", strict=True)), "depth")
    by = [F.col("f")] + ([F.floor(F.col("e") / group)] if group else [])
    return rows if reach is None else within_quartiles(rows, "depth", by, reach)


def flattened(points: DataFrame, flat: float = 1e-8) -> DataFrame:
    """Points (e, f, x, y, z) with u, v, their places in a plane: x and y of a flat surface, else seen from above its middle, from as far over it as it is high."""
    sums = points.groupBy(F.col("f").alias("_f")).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.min("z").alias("lo"), F.max("z").alias("hi"))
    rows = points.join(sums, F.col("f") == F.col("_f"))
    eye = 2 * F.col("hi") - F.col("lo")
    even = F.col("hi") - F.col("lo") <= flat * (1 + F.abs("hi"))
    scale = (F.col("lo") - eye) / (F.col("z") - eye)
    place = lambda c, m: F.when(even, F.col(c)).otherwise(F.col(m) + scale * (F.col(c) - F.col(m)))
    return rows.select(*points.columns, place("x", "mx").alias("u"), place("y", "my").alias("v"))


def triangulate(points: DataFrame, key: str = "f") -> DataFrame:
    """key, a, b, c: Delaunay triangles of each target's points in the plane (u, v, e); one group is one target's surface."""

    def mesh(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("e")
        tri = rays.delaunay(rows[["u", "v"]].to_numpy(float))
        e = rows["e"].to_numpy()
        return pd.DataFrame({key: [rows[key].iloc[0]] * len(tri), "a": e[tri[:, 0]], "b": e[tri[:, 1]], "c": e[tri[:, 2]]})

    return points.groupBy(key).applyInPandas(mesh, f"{key} long, a long, b long, c long")


_CORNERS = [f"{p}{c}" for p in "abc" for c in "xyz"]
_ENDS = [f"{p}{c}" for p in "se" for c in "xyz"]


def _box_range(d: int, lo, size: float, shape, beyond: bool = False) -> tuple[Column, Column]:
    """First and last voxel of a triangle's bounding box along an axis, inside the grid; first > last where it is outside.

    With beyond the voxels at the edge of the grid reach outwards without end, and boxes are a little wider, for hits within rounding of a voxel.
    """
    corners = [F.col(f"{p}{'xyz'[d]}") for p in "abc"]
    least, most = F.least(*corners), F.greatest(*corners)
    room = 1e-6 * size + 1e-8 * (most - least) if beyond else F.lit(0.0)
    first, last = F.greatest(F.floor((least - room - lo[d]) / size), F.lit(0)), F.least(F.floor((most + room - lo[d]) / size), F.lit(shape[d] - 1))
    return (F.least(first, F.lit(shape[d] - 1)), F.greatest(last, F.lit(0))) if beyond else (first, last)


def triangle_cells(tris: DataFrame, lo, size: float, shape, axes: str = "ijk", beyond: bool = False) -> DataFrame:
    """tri, corners, i, j, k: the voxels (or columns of voxels) of each triangle's bounding box, inside the grid or beyond it too."""
    out = tris
    for axis in axes:
        first, last = _box_range("ijk".index(axis), lo, size, shape, beyond)
        out = out.withColumn(axis, F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    return out


def depth_map(tris: DataFrame, lo, size: float, shape) -> DataFrame:
    """i, j, depth: the least k of a voxel that a triangle's box overlaps."""
    first, last = _box_range(2, lo, size, shape)
    return triangle_cells(tris.where(last >= first), lo, size, shape, "ij").groupBy("i", "j").agg(F.min(first).alias("depth"))


def depth_mask(spark, depths: DataFrame, shape, top: int | None = None) -> DataFrame:
    """vid, free: voxels at or below the depth of their column, and not above top."""
    grid = spark.range(shape[0] * shape[1] * shape[2]).select(F.col("id").alias("vid"), F.floor(F.col("id") / (shape[1] * shape[2])).alias("i"), F.pmod(F.floor(F.col("id") / shape[2]), F.lit(shape[1])).alias("j"), F.pmod("id", F.lit(shape[2])).alias("k"))
    rows = grid.join(depths, ["i", "j"], "left")
    inside = F.coalesce(F.col("k") >= F.col("depth"), F.lit(False))
    return rows.select("vid", (inside & (F.col("k") <= top) if top is not None else inside).alias("free"))


def _crossed(segments: DataFrame, tris: DataFrame, lo, size: float, shape, kinds: str, summed) -> DataFrame:
    """A row of kinds a piece of a path in a voxel (or more, or none): summed makes them of t, r, first of the pieces, their sorted hits and numbers of hits.

    Paths carry their ends along, so no table of all paths is broadcast to join them again.
    """

    def pieces(batches):
        for batch in batches:
            for k in range(0, len(batch), TOGETHER):
                part = batch.slice(k, TOGETHER)
                ends = np.stack([part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in _ENDS], axis=-1).reshape(-1, 2, 3)
                own, vid, first, last = rays.segment_pieces(ends, lo, size, shape)
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays([pa.array(vid), *(part.column(c).take(take) for c in ("t", "r", *_ENDS)), pa.array(first), pa.array(last)], names=["vid", "t", "r", *_ENDS, "first", "last"])

    longs = [F.col(c).cast("long").alias(c) for c in ("t", "r")]
    cells = segments.where("t is not null and r is not null").select(*longs, *(F.col(c).cast("double").alias(c) for c in _ENDS)).mapInArrow(pieces, "vid long, t long, r long, " + ", ".join(f"{c} double" for c in [*_ENDS, "first", "last"]))
    boxes = triangle_cells(tris, lo, size, shape, beyond=True).select(*(F.col(c).cast("double").alias(c) for c in _CORNERS), voxel_id(F.col("i"), F.col("j"), F.col("k"), shape).alias("vid"))

    def meet(paths: pa.Table, near: pa.Table) -> pa.Table:
        ends = np.stack([paths.column(c).to_numpy() for c in _ENDS], axis=-1).reshape(-1, 2, 3)
        tri = np.stack([near.column(c).to_numpy() for c in _CORNERS], axis=-1).reshape(-1, 3, 3)
        t, r, first, last = (paths.column(c).to_numpy() for c in ("t", "r", "first", "last"))
        made = [summed(t[own], r[own], first[own], found, count) for own, found, count in rays.crossings_of(ends, first, last, tri)]
        return pa.concat_tables(made) if made else summed(t[:0], r[:0], first[:0], np.full((0, 1), np.inf), np.zeros(0, np.int64))

    return cells.groupBy("vid").cogroup(boxes.groupBy("vid")).applyInArrow(meet, f"t long, r long, {kinds}")


def path_crossings(segments: DataFrame, tris: DataFrame, lo, size: float, shape) -> DataFrame:
    """t, r, at: sorted parameters where each segment (sx.. to ex..) meets the surface.

    Triangles and paths meet in the voxels that both touch, and only hits leave them, each from
    the voxel of its place; hits on shared edges count once.  Where there are many hits a path,
    crossing_sums is what path_media needs of them.
    """

    def summed(t, r, first, found, count):
        return pa.table([np.repeat(t, count), np.repeat(r, count), found[np.isfinite(found)]], names=["t", "r", "at"])

    hits = _crossed(segments, tris, lo, size, shape, "at double", summed)
    hits = hits.groupBy("t", "r").agg(F.array_sort(F.collect_set("at")).alias("at"))
    apart = F.filter("at", lambda x, k: (k == 0) | (x - F.get("at", k - 1) > rays.SAME_HIT))
    found = hits.select("t", "r", apart.alias("at"))
    return segments.select("t", "r").distinct().join(found.hint("merge"), ["t", "r"], "left").withColumn("at", F.coalesce("at", F.array().cast("array<double>")))


def crossing_sums(segments: DataFrame, tris: DataFrame, lo, size: float, shape) -> DataFrame:
    """t, r, hits, first, inside: of path_crossings the number, the first, and the share of a segment between odd and even ones; paths without hits have no row.

    A voxel gives a row a path, whatever its hits: their number, first, last and sum with signs
    in turn.  Rows of a path are put together in its order; a hit that is the last of the row
    before it again is left out, which turns the signs of those after it.
    """

    def summed(t, r, first, found, count):
        n, one, end, share = rays.crossing_sums(found, count)
        some = count > 0
        return pa.table([c[some] for c in (t, r, first, n, one, end, share)], names=["t", "r", "piece", "n", "first", "last", "share"])

    rows = _crossed(segments, tris, lo, size, shape, "piece double, n long, first double, last double, share double", summed)
    rows = rows.groupBy("t", "r").agg(F.array_sort(F.collect_set(F.struct("piece", "n", "first", "last", "share"))).alias("p"))

    def add(s, x):
        again = x["first"] - s["last"] <= rays.SAME_HIT
        share = F.when(again, -x["share"] - x["first"]).otherwise(x["share"])
        return F.struct(
            (s["n"] + x["n"] - again.cast("long")).alias("n"), x["last"].alias("last"),
            (s["share"] + F.when(s["n"] % 2 == 1, -share).otherwise(share)).alias("share"),
        )

    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit("-Infinity").cast("double").alias("last"), F.lit(0.0).alias("share"))
    rows = rows.select("t", "r", F.get("p", F.lit(0))["first"].alias("first"), F.aggregate("p", none, add).alias("p"))
    return rows.select("t", "r", F.col("p.n").alias("hits"), "first", F.col("p.share").alias("inside"))


def path_media(segments: DataFrame, crossings: DataFrame) -> DataFrame:
    """t, r, exlen, inlen: lengths outside and inside a closed surface, by path_crossings or crossing_sums; odd numbers of crossings are left out.

    Backscatter (t = r) goes to its first hit and back: exterior twice that, no interior.
    """
    if "at" in crossings.columns:
        inside = F.expr("aggregate(sequence(0, size(at) div 2), 0D, (s, k) -> s + if(2 * k + 1 < size(at), at[2 * k + 1] - at[2 * k], 0D))")
        crossings = crossings.select("t", "r", F.size("at").alias("hits"), F.get("at", F.lit(0)).alias("first"), inside.alias("inside"))
    length = norm(*(F.col(f"e{c}") - F.col(f"s{c}") for c in "xyz"))
    rows = segments.withColumn("length", length).join(crossings.hint("merge"), ["t", "r"], "left")
    rows = rows.withColumn("hits", F.coalesce("hits", F.lit(0))).withColumn("inside", F.coalesce("inside", F.lit(0.0)))
    back = F.col("t").eqNullSafe(F.col("r"))
    rows = rows.where(back | (F.col("hits") % 2 == 0)).where(~back | (F.col("hits") > 0))
    exlen = F.when(back, 2 * F.col("first") * F.col("length")).otherwise((1 - F.col("inside")) * F.col("length"))
    return rows.select("t", "r", exlen.alias("exlen"), F.when(back, F.lit(0.0)).otherwise(F.col("inside") * F.col("length")).alias("inlen"))


def fresnel_paths(paths: DataFrame, wavelength: float, shape, keys=("t", "r")) -> DataFrame:
    """keys, vid, len: a path's length spread over its Fresnel zone by weight (points in voxel units)."""
    kinds = [f"{k} {paths.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches):
        for batch in batches:
            row, vids, lens = [], [], []
            for n, points in enumerate(batch.column("points").to_pylist()):
                p = np.asarray(points, float)
                vid, w = rays.fresnel_weights(p, wavelength, shape)
                total = np.linalg.norm(np.diff(p, axis=0), axis=1).sum()
                row += [n] * len(vid)
                vids.append(vid)
                lens.append(total * w / w.sum() if len(w) else w)
            take = pa.array(row, pa.int64())
            join = lambda v, t: pa.array(np.concatenate(v) if v else [], t)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in keys), join(vids, pa.int64()), join(lens, pa.float64())], names=[*keys, "vid", "len"])

    return paths.select(*keys, "points").mapInArrow(run, ", ".join([*kinds, "vid long", "len double"]))


#: Paths that a task works on at once.
TOGETHER = 512


def spread(rows: DataFrame) -> DataFrame:
    """Rows that cost much each, dealt evenly over all cores: a small file is one partition otherwise."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def polylines(column: pa.ListArray, most: int = TOGETHER):
    """Row numbers and points (n, m, 3) of the polylines of a batch, those of as many points together, at most so many."""
    points = column.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
    size = column.value_lengths().to_numpy()
    first = np.cumsum(size) - size
    for m in np.unique(size):
        rows = np.flatnonzero(size == m)
        for k in range(0, len(rows), most):
            own = rows[k : k + most]
            yield own, points[first[own][:, None] + np.arange(m)]


#: Cells of a grid that may be sent to every worker (32 MB).
MAX_GRID = 4 << 20


def bent_rays(paths: DataFrame, grid: np.ndarray, segments: int = 8, keys=("t", "r")) -> DataFrame:
    """keys, straight, bent: integrals of a grid along straight and optimised paths (points in voxel units)."""
    if grid.size > MAX_GRID:
        raise ValueError("the grid is too large to send to every worker; trace over march() instead")
    held = paths.sparkSession.sparkContext.broadcast(np.asarray(grid, float))
    kinds = [f"{k} {paths.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches):
        for batch in batches:
            out = np.empty((2, len(batch)))
            for own, points in polylines(batch.column("points")):
                out[0, own], out[1, own] = rays.path_integrals(held.value, points)[0], rays.bent_integrals(held.value, points, segments)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *map(pa.array, out)], names=[*keys, "straight", "bent"])

    return spread(paths.select(*keys, "points")).mapInArrow(run, ", ".join([*kinds, "straight double", "bent double"]))


def compensated_times(paths: DataFrame, grid: np.ndarray, panels: int = 8, weight: float = 1.0, max_angle: float | None = None, keys=("t", "r")) -> DataFrame:
    """keys, compensated, straight, error, nx, ny, nz: straight-ray times with the turn of the wavefront, and without.

    error is the change of the compensated time from half as many panels; null beyond max_angle.
    """
    if grid.size > MAX_GRID:
        raise ValueError("the grid is too large to send to every worker")
    held = paths.sparkSession.sparkContext.broadcast(np.asarray(grid, float))
    kinds = [f"{k} {paths.schema[k].dataType.simpleString()}" for k in keys]
    names = ["compensated", "straight", "error", "nx", "ny", "nz"]

    def run(batches):
        for batch in batches:
            out = np.full((6, len(batch)), np.nan)
            for own, points in polylines(batch.column("points")):
                ends = points[:, [0, -1]]
                out[0, own], out[1, own], normal = rays.compensated_integrals(held.value, ends, panels, weight, max_angle)
                half = rays.compensated_integrals(held.value, ends, max(1, panels // 2), weight, max_angle)[0]
                out[2, own], out[3:, own] = np.abs(out[0, own] - half), normal.T
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(c, from_pandas=True) for c in out)], names=[*keys, *names])

    return spread(paths.select(*keys, "points")).mapInArrow(run, ", ".join([*kinds, *(f"{n} double" for n in names)]))


def plausible_times(times: DataFrame, least: float) -> DataFrame:
    """Rows of which the compensated time is no longer than the straight one, nor shorter than a share of it."""
    return times.where((F.col("straight") >= F.col("compensated")) & (F.col("compensated") >= least * F.col("straight")))


def rytov_paths(paths: DataFrame, wavelength: float, slowness: float, shape, width: float = 1.0, keys=("t", "r")) -> DataFrame:
    """keys, vid, w: the first-order phase kernel of each two-point path over its widened Fresnel zone."""
    kinds = [f"{k} {paths.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches):
        for batch in batches:
            row, vids, values = [], [], []
            for n, points in enumerate(batch.column("points").to_pylist()):
                vid, w = rays.rytov_kernel(np.asarray(points, float), wavelength, slowness, shape, width)
                row += [n] * len(vid)
                vids.append(vid)
                values.append(w)
            take = pa.array(row, pa.int64())
            join = lambda v, t: pa.array(np.concatenate(v) if v else [], t)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in keys), join(vids, pa.int64()), join(values, pa.float64())], names=[*keys, "vid", "w"])

    return paths.select(*keys, "points").mapInArrow(run, ", ".join([*kinds, "vid long", "w double"]))


def first_hits(rows: DataFrame, n: int = 1) -> DataFrame:
    """The n hits nearest a path's start (t, r, tri, at)."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy("t", "r").orderBy("at", "tri"))).where(F.col("_k") <= n).drop("_k")


DEGREES = 180 / math.pi
