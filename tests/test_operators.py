import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelattice.functions import arrays as A
from wavelattice.functions import kernels as K
from wavelattice.functions import rays
from wavelattice.functions import spectral as S
from wavelattice.operators import decode, geometry, locate, models, pairs, rolling, tomography


def waves(spark, rows):
    return spark.createDataFrame(rows, "t long, r long, nsamp long, dstart long, data array<double>")


def test_energy_ratios_agree_with_the_kernel(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=40)
    w = waves(spark, [(0, 1, 40, 0, x.tolist())])
    for edges in ("rms", "wrap", -20.0):
        got = rolling.energy_ratio(rolling.to_samples(w), 4, 6, 3, edges=edges).orderBy("s").collect()
        near, far = K.energy_ratios(x, 4, 6, 3, edges)
        assert np.allclose([r.ner for r in got], near) and np.allclose([r.fer for r in got], far)
    ratios = rolling.imer(rolling.modified_ratio(rolling.energy_ratio(rolling.to_samples(w), 4, 6, 3)), 5).orderBy("s").collect()
    assert np.allclose([r.imer for r in ratios][2:], K.improved_ratio(x, 5, prewin=4, postwin=6, vpwin=3)[0][2:])
    with pytest.raises(ValueError):
        rolling.energy_ratio(rolling.to_samples(w), 0)


def test_samples_are_arrays_again(spark):
    w = waves(spark, [(0, 1, 9, 3, [1.0, 2.0, 3.0]), (2, 2, 9, 0, [4.0])])
    assert sorted(map(tuple, rolling.to_waves(rolling.to_samples(w)).collect())) == [(0, 1, 3, [1.0, 2.0, 3.0]), (2, 2, 0, [4.0])]
    assert decode.empty_like(w).schema == w.schema and decode.empty_like(w).count() == 0


def test_strict_numbers_and_keys_refuse(spark):
    one = spark.createDataFrame([(1.5, 70000, 1)], "x double, t long, r long")
    for c in (A.strict_int(F.col("x")), A.pack_key(F.col("t"), F.col("r"))):
        with pytest.raises(Exception):  # noqa: B017
            one.select(c).collect()


def test_records_are_changed_and_decoded(spark):
    rng = np.random.default_rng(2)
    clean = rng.normal(size=(4, 16))
    coded = K.walsh_hadamard(clean)
    rows = [(7, k, 0, 0, 0.0, 0.0, 0.0, 0, 16, coded[k].tolist()) for k in range(4)]
    records = spark.createDataFrame(rows, "rid long, row long, li long, gi long, px double, py double, pz double, ws long, wl long, data array<double>")
    got = decode.hadamard_decode(records, 4, 16).orderBy("l").collect()
    assert np.allclose([r["re"] for r in got], clean)
    with pytest.raises(Exception, match="not whole"):
        decode.hadamard_decode(records.where("row < 3"), 4, 16).collect()
    with pytest.raises(ValueError):
        decode.hadamard_decode(records, 3, 16)
    new = records.withColumn("data", F.lit(None).cast("array<double>"))
    assert decode.upsert_records(records, new, 16).where("data[0] = 0").count() == 4
    with pytest.raises(Exception, match="does not fit"):
        decode.upsert_records(records, new.withColumn("wl", F.lit(20).cast("long")), 16).collect()
    picked = decode.select_record(records, 7, [2, 0], -1, 5).collect()
    assert [r.row for r in picked] == [2, 0] and picked[0].data[0] == 0 and len(picked[0].data) == 5


def test_delays_and_alignment(spark):
    x = np.exp(-0.5 * ((np.arange(64) - 20) / 3) ** 2)
    rows = waves(spark, [(0, 1, 64, 0, np.roll(x, 6).tolist())]).withColumns({"ref": F.array(*map(F.lit, x.tolist())), "ref_start": F.lit(0)})
    assert S.delay(rows).first().delay == 6.0
    assert np.allclose(S.align(rows).first()["data"], x, atol=1e-6)
    bad = S.isolate_peak(waves(spark, [(0, 0, 8, 0, [0.0] * 8)])).first()
    assert bad.status == "no peak" and bad.data is None


def test_outliers_go_and_planted_rows_only(spark):
    rows = [(k, 100 + k, float(k % 10)) for k in range(100)] + [(200 + k, 0, 1e3) for k in range(3)]
    table = spark.createDataFrame(rows, "t long, r long, time double")
    assert pairs.within_quartiles(table, "time").count() == 100


def test_homogeneous_traces_and_speeds(spark):
    points = [(0, k, [[0.5, 0.5, 0.5], [7.5, float(k), 6.0]]) for k in range(1, 6)]
    rows = spark.createDataFrame(points, "t long, r long, points array<array<double>>")
    paths = tomography.march(rows, (0.0, 0.0, 0.0), 1.0, (8, 8, 8))
    voxels = spark.range(512).select(F.col("id").alias("vid"), F.lit(2.0).alias("v"))
    for r in tomography.trace(paths, voxels).collect():
        assert np.isclose(r.time, 2 * np.linalg.norm(np.subtract(*points[r.r - 1][2])))
    media = spark.createDataFrame([(10.0, 0.0, 10 / 1.5), (8.0, 0.0, 8 / 1.5), (6.0, 4.0, 6 / 1.5 + 4 / 1.6)], "exlen double, inlen double, time double")
    one = tomography.two_medium_speeds(media).first()
    assert np.isclose(one.exspd, 1.5) and np.isclose(one.inspd, 1.6)


def test_inversions_lower_the_cost(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k // 6), int(k % 6), int(v), float(rng.random())) for k in range(24) for v in rng.choice(12, 4, replace=False)]
    paths = spark.createDataFrame(rows, "t long, r long, vid long, len double")
    voxels = spark.range(12).select(F.col("id").alias("vid"), F.lit(1.0).alias("v"))
    true = spark.range(12).select(F.col("id").alias("vid"), (1 + F.col("id") / 20).alias("v"))
    observed = tomography.trace(paths, true)
    change, log = tomography.sgd(paths, observed, voxels, tomography.free_everywhere(voxels), epochs=2, updates=3)
    assert log[-1][1] < 0.5 * log[0][1]
    fitted = tomography.straight_ray_inversion(paths, observed, voxels, iterations=30)
    left = tomography.cost(tomography.residuals(paths, tomography.perturb(voxels, fitted), observed)).first()
    assert left.cost < 1e-6


def test_positions_are_recovered(spark):
    rng = np.random.default_rng(6)
    angle = rng.random(24) * 2 * np.pi
    elements = [(k, float(10 * np.cos(a)), float(10 * np.sin(a)), float(rng.normal())) for k, a in enumerate(angle)]
    target = np.array([1.0, -2.0, 0.5])
    times = [(0, e, 2 * float(np.linalg.norm(np.array(p) - target) - 0.3) / 1.5) for e, *p in elements]
    table = spark.createDataFrame(elements, "e long, x double, y double, z double")
    guess = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "e long, x double, y double, z double")
    held = spark.createDataFrame(times, "target long, e long, time double")
    found = locate.locate_targets(held, table, guess, 1.4, 0.3, with_speed=True).first()
    assert np.allclose([found.x, found.y, found.z, found.c], [*target, 1.5], atol=1e-5)
    pairs_ = spark.createDataFrame([(t, r, (t + r) / 2.0 if t != r else float(t)) for t in range(4) for r in range(4)], "t long, r long, time double")
    assert np.allclose([r.time for r in locate.element_times(pairs_).orderBy("e").collect()], [0, 1, 2, 3], atol=1e-6)


def test_a_slab_splits_paths(spark):
    tris = [(0, 3.0, -50.0, -50.0, 3.0, 50.0, -50.0, 3.0, 0.0, 90.0), (1, 6.0, -50.0, -50.0, 6.0, 50.0, -50.0, 6.0, 0.0, 90.0)]
    table = spark.createDataFrame(tris, "tri long, " + ", ".join(f"{p}{c} double" for p in "abc" for c in "xyz"))
    segments = spark.createDataFrame([(0, 1, 0.0, 4.0, 4.0, 8.0, 4.0, 4.0), (2, 2, 0.0, 4.0, 4.0, 8.0, 4.0, 4.0)], "t long, r long, sx double, sy double, sz double, ex double, ey double, ez double")
    hits = geometry.path_crossings(segments, table, (0.0, 0.0, 0.0), 1.0, (8, 8, 8))
    got = {r.t: (r.exlen, r.inlen) for r in geometry.path_media(segments, hits).collect()}
    assert np.allclose(got[0], (5, 3)) and np.allclose(got[2], (6, 0))


def test_batches_merge_and_members_shift(spark):
    reps = spark.createDataFrame([(s, g, k, float(k)) for s in range(2) for g in range(3) for k in range(7)], "src long, grp long, pos long, re double")
    cut = pairs.near_equal_batches(reps, 3, ["src", "grp"], "pos")
    assert sorted(r["count"] for r in cut.where("src = 0 and grp = 0").groupBy("batch").count().collect()) == [2, 2, 3]
    local = cut.withColumn("pos", F.col("pos") - F.expr("min(pos) over (partition by src, grp, batch)"))
    back = pairs.merge_batches(local).where("re <> pos")
    assert back.count() == 0 and pairs.group_sizes(pairs.regroup(reps)).where("n = 7").count() == 6
    groups = spark.createDataFrame([(0, 1, [[1.0], [2.0]]), (0, 2, [[3.0]])], "t long, r long, members array<array<double>>")
    times = spark.createDataFrame([(0, 1, [5.0, 7.5])], "t long, r long, times array<double>")
    got = {(r.r, r.member): r["shift"] for r in pairs.shifted_members(groups, times).collect()}
    assert got == {(1, 0): 0.0, (1, 1): -2.5, (2, 0): 0.0} and pairs.shifted_members(groups, times, False).count() == 2


def test_medians_go_by_cubes(spark, monkeypatch):
    monkeypatch.setattr(tomography, "CUBE", 4)
    rng, shape, reach = np.random.default_rng(7), (9, 5, 6), 2
    grid = rng.integers(0, 40, shape).astype(float)
    rows = [(int(k), None if k % 11 == 0 else float(v)) for k, v in enumerate(grid.ravel()) if k % 7]
    known = dict(rows)
    got = {r.vid: r.v for r in tomography.median_filter(spark.createDataFrame(rows, "vid long, v double"), shape, reach).collect()}
    assert set(got) == set(known)
    for vid, v in got.items():
        near = [np.clip(np.array(np.unravel_index(vid, shape)) + s, 0, np.array(shape) - 1) for s in np.array(list(np.ndindex(5, 5, 5))) - reach]
        values = [known[k] for k in (int(np.ravel_multi_index(tuple(p), shape)) for p in near) if known.get(k) is not None]
        assert v == np.median(values)


def test_crossings_are_found_by_voxel(spark):
    rng = np.random.default_rng(11)
    tri, ends = rng.random((400, 1, 3)) * 3.4 + rng.random((400, 3, 3)), rng.random((20, 2, 3)) * 4
    tri[1] = tri[0]  # one hit, not two
    segments = spark.createDataFrame([(k, 100 + k, *map(float, e.ravel())) for k, e in enumerate(ends)], "t long, r long, sx double, sy double, sz double, ex double, ey double, ez double")
    tris = spark.createDataFrame([(k, *map(float, p.ravel())) for k, p in enumerate(tri)], "tri long, " + ", ".join(f"{p}{c} double" for p in "abc" for c in "xyz"))
    rows = geometry.path_crossings(segments, tris, (0.0, 0.0, 0.0), 1.0, (5, 5, 5))
    got = {r.t: r["at"] for r in rows.collect()}
    assert all(np.allclose(got[k], rays.crossings(*e, tri)) for k, e in enumerate(ends)) and sum(map(len, got.values())) > 20
    # pairs of paths and triangles are not rows
    assert "FlatMapCoGroupsInArrow" in rows._jdf.queryExecution().toString()


def test_a_voxel_sums_its_hits(spark):
    from wavelattice.plans import catalog

    rng = np.random.default_rng(12)
    tri, ends = rng.random((300, 1, 3)) * 5 - 2 + 2 * rng.random((300, 3, 3)), rng.random((30, 2, 3)) * 7 - 1.5  # some lie beyond the grid
    flat = [[[x, -9.0, -9.0], [x, 9.0, -9.0], [x, 0.0, 30.0]] for x in (1.0, 2.0, 2.0 + 4e-8, 2.0 + 8e-8)]  # at the sides of voxels, three of them one hit
    tri = np.concatenate([tri, flat, tri[:2]])
    ends[:3] = [[[-1, 0.5, 0.5], [5, 0.5, 0.5]], [[0, 1, 1], [4, 1, 1]], [[1, 1, 1], [1, 1, 1]]]
    segments = spark.createDataFrame([(k, 100 + k, *map(float, e.ravel())) for k, e in enumerate(ends)], "t long, r long, sx double, sy double, sz double, ex double, ey double, ez double")
    tris = spark.createDataFrame([(k, *map(float, p.ravel())) for k, p in enumerate(tri)], "tri long, " + ", ".join(f"{p}{c} double" for p in "abc" for c in "xyz"))
    hits = {k: rays.crossings(*e, tri) for k, e in enumerate(ends)}
    at = {r.t: r["at"] for r in geometry.path_crossings(segments, tris, (0.0, 0.0, 0.0), 1.0, (4, 4, 4)).collect()}
    assert len(at) == 30 and all(np.allclose(at[k], h) for k, h in hits.items()) and sum(map(len, hits.values())) > 60
    rows = geometry.crossing_sums(segments, tris, (0.0, 0.0, 0.0), 1.0, (4, 4, 4))
    got = {r.t: r for r in rows.collect()}
    assert set(got) == {k for k, h in hits.items() if len(h)}
    for k, h in hits.items():
        assert not len(h) or got[k].hits == len(h) and np.isclose(got[k].inside, h[1::2].sum() - h[::2].sum()) and np.isclose(got[k]["first"], h[0])
    # neither paths nor their hits are held by the driver, or by one row
    plan = catalog.QUERIES["path_media"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and "collect_set(at" not in plan
    # a path may be there twice, or have no key
    one = segments.where("t = 5")
    odd = segments.unionByName(one).unionByName(one.withColumn("r", F.lit(None).cast("long")).withColumn("ey", F.lit(None).cast("double")))
    rows = geometry.path_media(odd, geometry.crossing_sums(odd, tris, (0.0, 0.0, 0.0), 1.0, (4, 4, 4))).collect()
    even = sum(len(h) % 2 == 0 for h in hits.values())
    assert len(rows) == even + (len(hits[5]) % 2 == 0) + 1 and [r.exlen for r in rows if r.r is None] == [None]


def test_paths_are_bent_together(spark):
    i = np.indices((9, 9, 9))
    grid = 1.5 + 0.5 * np.sin(i[0] / 2) * np.cos(i[1] / 3 + i[2] / 5)
    points = np.random.default_rng(3).random((40, 3, 3)) * 8
    each = [rays.bent_path(grid, p, 8)[1] for p in points]
    assert np.allclose(rays.bent_integrals(grid, points, 8), each, atol=1e-3)
    rows = [(k, 0, p[: 2 + k % 2].tolist()) for k, p in enumerate(points)]
    got = geometry.bent_rays(spark.createDataFrame(rows, "t long, r long, points array<array<double>>").coalesce(1), grid, 4)
    for r in got.collect():
        p = np.array(rows[r.t][2])
        assert np.isclose(r.straight, rays.path_integral(grid, p)[0]) and np.isclose(r.bent, rays.bent_path(grid, p, 4)[1], atol=1e-3)
    # rows of one partition are dealt out
    assert got.rdd.getNumPartitions() > 1


def test_fields_of_many_sources_are_computed_together(spark):
    slowness = 0.3 + np.random.default_rng(4).random((7, 6, 5))
    places = [(k, 0.7 * k, k % 5 + 0.3, k % 3 + 0.2) for k in range(9)]
    fields = [rays.first_arrivals(slowness, np.array(p[1:]) - 0.5) for p in places]
    assert np.allclose(rays.first_arrivals_of(slowness, np.array(places)[:, 1:] - 0.5), fields)
    ends = spark.createDataFrame(places, "e long, x double, y double, z double").coalesce(1)
    times = models.eikonal_times(ends, ends, slowness)
    assert times.rdd.getNumPartitions() > 1 and times.count() == 81
    for r in times.collect():
        assert np.isclose(r.time, rays.trilinear(fields[r.t], np.array([places[r.r][1:]]) - 0.5)[0][0])


def test_compensated_times_of_many_paths(spark):
    grid = 1 + np.random.default_rng(6).random((7, 7, 7))
    points = np.random.default_rng(8).random((30, 2, 3)) * 6
    points[3, 1] = points[3, 0]
    rows = spark.createDataFrame([(k, 0, p.tolist()) for k, p in enumerate(points)], "t long, r long, points array<array<double>>").coalesce(1)
    got = geometry.compensated_times(rows, grid, max_angle=20.0)
    assert got.rdd.getNumPartitions() > 1
    for r in got.collect():
        a, b = points[r.t]
        u = (np.arange(8)[:, None] + rays.NODES).ravel() / 8
        value, slope = rays.trilinear(grid, a + u[:, None] * (b - a))
        length, normal, last, cosine = np.linalg.norm(b - a), b - a, 0.0, []
        ray = normal = (b - a) / (length or 1)
        for v, s, at in zip(value, slope, u, strict=True):
            normal = normal + (at - last) / ((ray @ normal) or 1) * length * s / v
            normal = normal / (np.linalg.norm(normal) or 1)
            cosine.append(normal @ ray)
            last = at
        part = np.tile(rays.WEIGHTS / 8, 8) * value * length
        assert np.isclose(r.straight, part.sum()) and np.allclose((r.nx, r.ny, r.nz), normal)
        assert (r.compensated is None) if length and min(cosine) < np.cos(np.radians(20)) else np.isclose(r.compensated, part @ cosine)


def test_wide_keys_run_into_each_other_on_request(spark):
    pairs_ = [(1, 2), (3, 70000), (70000, 5), (2, 65536 * 2 + 9)]
    key = A.pack_key(F.col("t"), F.col("r"), strict=False)
    rows = spark.createDataFrame(pairs_, "t long, r long").select("t", "r", key.alias("key"), *(c.alias(n) for c, n in zip(A.unpack_key(key), ("t2", "r2"), strict=True))).collect()
    assert {tuple(r) for r in rows} == {(t, r, t << 16 | r, (t << 16 | r) >> 16, (t << 16 | r) & 65535) for t, r in pairs_}
    with pytest.raises(Exception, match="outside"):
        spark.createDataFrame(pairs_, "t long, r long").select(A.pack_key(F.col("t"), F.col("r"))).collect()


def test_levels_and_noise_of_zero_have_ratios(spark):
    samples = spark.createDataFrame([(0, k, v) for k, v in enumerate([0.0, 0.0, 0.0, 2.0, 0.0, 1.0])] + [(1, 0, 1.0), (1, 1, 0.0), (1, 2, 1.0), (1, 3, 0.0)], "ch long, s long, v double")
    got = {(r.ch, r.s): r.snr for r in rolling.rolling_snr(samples, 2, ("ch",)).collect()}
    assert all(np.isnan(got[0, k]) for k in (0, 1, 2)) and got[0, 3] == np.inf and got[0, 4] == -np.inf and np.isclose(got[0, 5], 20 * np.log10(1 / np.sqrt(2)))
    assert got[1, 1] == got[1, 3] == -np.inf and np.isfinite(got[1, 2])


def test_normals_of_corners_in_a_line(spark):
    line = [(0, k, 8.0 + 0.1 * k, 3.0 + 0.3 * k, 1.0 + 0.7 * k) for k in range(4)]
    exact = [(1, k, 1.0 + k, 2.0, 3.0) for k in range(3)]
    others = [(2, 0, 1.0, 0.0, 0.0), (2, 1, 0.0, 1.0, 0.0), (2, 2, 0.0, 0.0, 1.0), (3, 0, 3.0, 0.0, 4.0)]
    rows = spark.createDataFrame(line + exact + others, "facet long, place long, x double, y double, z double")
    points = {f: np.array([r[2:] for r in [*line, *exact, *others] if r[0] == f]) for f in range(4)}
    for r in geometry.facet_normals(rows).collect():
        assert np.allclose((r.nx, r.ny, r.nz), rays.facet_normal(points[r.facet]))
    got = {r.facet: (r.nx, r.ny, r.nz) for r in geometry.facet_normals(rows, flat=None).collect()}
    p = points[0]
    n = np.cross(p[1] - p[0], p[-1] - p[0])
    assert n.any() and np.allclose(np.abs(got[0]), np.abs(n / np.linalg.norm(n)))
    assert np.isnan(got[1]).all() and np.allclose(got[2], 3**-0.5) and np.allclose(got[3], (0.6, 0, 0.8))
