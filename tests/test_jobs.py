"""Jobs and kernels without SQL, by analytic cases, invariants and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelattice.config import Config, ConfigError
from wavelattice.functions import kernels as K
from wavelattice.functions import rays
from wavelattice.operators import arrivals, models, pairs, tomography
from wavelattice.plans import bindings as B
from wavelattice.plans import catalog

DATA = "/root/testdata/sf0.001"


def pulse(at, n=128, width=4.0):
    return np.exp(-0.5 * ((np.arange(n) - at) / width) ** 2) * np.cos((np.arange(n) - at) * 0.9)


def waves(spark, rows):
    return spark.createDataFrame([(t, r, len(x), 0, [float(v) for v in x]) for t, r, x in rows], "t long, r long, nsamp long, dstart long, data array<double>")


def test_ranks_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(pairs, "BINS", 16)
    monkeypatch.setattr(pairs, "FEW", 20)
    for values in (rng.normal(size=500), np.repeat([1.0, 2.0, 1e300], 200), rng.integers(0, 5, 300).astype(float), 1e15 + rng.integers(0, 3, 100)):
        table = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        ranks = [0, 7, len(values) // 2, len(values) - 1]
        assert pairs.values_at(table, "v", ranks) == np.sort(values)[ranks].tolist()
        assert np.allclose(pairs.exact_quantiles(table, "v", [0.25, 0.5, 0.9]), np.quantile(values, [0.25, 0.5, 0.9]))
    assert pairs.exact_quantiles(table.limit(0), "v", [0.5]) is None
    drawn = spark.createDataFrame([(k % 9, k // 9) for k in range(90)], "t long, r long")
    assert pairs.random_pairs(drawn, 33, 1).distinct().count() == 33 and pairs.random_pairs(drawn.unionByName(drawn), 0.5, 1).count() == 90


def test_arrivals_against_a_reference(spark):
    rng = np.random.default_rng(1)
    noise = lambda s: rng.normal(size=128) * s
    rows = waves(spark, [(0, 1, pulse(60) + noise(0.01)), (0, 2, -pulse(70) + noise(0.01)), (0, 3, noise(1.0)), (0, 4, pulse(50) + 0.9 * pulse(90) + noise(0.01)), (0, 5, np.zeros(128))])
    made = {r.r: r for r in arrivals.arrival_delays(rows, reference=(pulse(20).tolist(), 0), band=(5, 40, 3), minsnr=(20.0, 20), negative=True, osamp=4).collect()}
    assert abs(made[1].delay - 40) < 0.3 and abs(made[2].delay - 50) < 0.3 and made[3].status == "low-snr" and made[5].status == "low-snr"
    hinted = rows.where("r = 4").withColumn("hint", F.lit(91.0))
    assert abs(arrivals.arrival_delays(hinted, reference=(pulse(20).tolist(), 0), peaks={"minprom": 0.3, "window": (-12, 24)}).first().delay - 70) < 1
    assert arrivals.arrival_delays(rows.where("r = 4"), reference=(pulse(20).tolist(), 0), peaks={"minprom": 99.0}).first().status == "missing-peak"
    cut = rows.where("r = 4").withColumns({"win_start": F.lit(75), "win_length": F.lit(40)})
    assert abs(arrivals.arrival_delays(cut, reference=(pulse(20).tolist(), 0), tail=4).first().delay - 70) < 1
    leaky = arrivals.arrival_delays(rows.where("r = 1"), imer={"prewin": 10, "postwin": 10, "vpwin": 5}, leak=1e-9).first()
    assert leaky.status in ("leaky", "out-of-bounds") and leaky.delay is None
    with pytest.raises(ValueError):
        arrivals.arrival_delays(rows)


def test_arrival_job_drops_outliers_of_its_neighbourhood(spark):
    n = 6
    elements = spark.createDataFrame([(k, float(k), float(k * k % 5), 0.0) for k in range(n)], "e long, x double, y double, z double")
    place = {r.e: np.array([r.x, r.y]) for r in elements.collect()}
    far = lambda a, b: np.linalg.norm(place[a] - place[b])
    rows = waves(spark, [(a, b, pulse(20 + 6 * far(a, b) + (40 if (a, b) == (2, 4) else 0))) for a in range(n) for b in range(n) if a != b])
    near = spark.createDataFrame([(k, j) for k in range(n) for j in range(n) if abs(j - k) <= 2], "e long, n long")
    times, counts = arrivals.arrival_times(rows, 0.5, 2.0, elements, near=near, reference=(pulse(20).tolist(), 0), osamp=4)
    got = {(r.t, r.r): r.time for r in times.collect()}
    assert (2, 4) not in got and len(got) > 20 and all(abs(v - 2 - 3 * far(*k)) < 0.3 for k, v in got.items())
    assert {r.status: r.n for r in counts.collect()} == {"valid": 30}
    both = arrivals.target_times([times, times.withColumn("time", F.col("time") + 1)])
    assert both.where(F.abs(F.col("times")[1] - F.col("times")[0] - 1) > 1e-9).count() == 0 and both.count() == len(got)
    with pytest.raises(ValueError, match="no pair"):
        arrivals.target_times([times, times.where("t < 0")])
    with pytest.raises(Exception, match="negative"):
        arrivals.arrival_times(rows, 0.5, -500.0, reference=(pulse(20).tolist(), 0))[0].collect()


def test_both_directions_are_aligned(spark):
    rows = waves(spark, [(1, 2, pulse(50)), (2, 1, pulse(56)), (1, 1, pulse(3)), (3, 4, pulse(9))])
    (r,) = pairs.aligned_average(rows, 8).collect()
    assert (r.t, r.r) == (1, 2) and np.allclose(r["data"], pulse(53), atol=1e-6)
    cut = rows.select("t", "r", "nsamp", F.lit(40).cast("long").alias("dstart"), F.slice("data", 41, 40).alias("data"))
    (r,) = pairs.aligned_average(cut, 8, clip=True).collect()
    assert r.dstart == 40 and len(r["data"]) == 40


def test_peaks_are_chosen_by_every_rule():
    x = np.concatenate((np.zeros(40), pulse(30, 80), 0.4 * pulse(30, 80)))
    big, small = K.choose_peak(x, 10), K.choose_peak(x, 10, index=165)
    assert abs(big[0] - 80) <= 1 and abs(small[0] - 160) <= 1 and big[1] > small[1] > 0.3
    assert K.choose_peak(x, 10, 165, minprom=0.5)[0] == big[0] and K.choose_peak(x, 10, 165, 0.5, "relative")[0] == big[0]
    assert K.choose_peak(x + 1e-3 * np.sin(np.arange(200) * 2.1), 10, 165, 3, "rolling_snr", 20)[0] in (big[0], small[0])
    assert K.choose_peak(x, 10, minprom=99, relaxed=True)[0] == big[0]
    for bad in ({"minprom": 99}, {"index": 0, "maxshift": 5, "minprom": 0.3}, {"mode": "other"}, {"minwidth": 500}):
        with pytest.raises(ValueError):
            K.choose_peak(x, 10, **bad)
    lo, hi = K.peak_window(x, 10, 210, small, "tight")
    assert big[0] < lo < small[0] < hi


def test_registered_queries_without_sql_hold_their_invariants(spark):
    rows = {name: catalog.QUERIES[name](spark, DATA).collect() for name in ("peak_isolation", "denoise", "plane_normals", "delaunay", "bent_ray", "compensated_times", "sgd_inversion")}
    assert set(catalog.QUERIES) - set(catalog.SQL) == set(rows)
    signal = {(r.t, r.r): np.array(r["data"]) for r in B.waves(spark, DATA).collect()}

    assert len(rows["peak_isolation"]) == len(signal)
    for r in rows["peak_isolation"][::7]:
        env = K.envelope(signal[r.t, r.r])
        tops = [k for k in range(1, 63) if env[k - 1] < env[k] > env[k + 1]]
        top = max(tops, key=lambda k: env[k])
        assert r.peak in tops and r.prominence <= env[r.peak] + 1e-6 and r.dstart <= r.peak < r.dstart + r.n
        if env[top] == env.max():
            assert r.peak == top and np.isclose(r.prominence, env[top], atol=1e-6)
        assert not any(r.dstart < k < r.dstart + r.n - 1 for k in tops if k != r.peak)

    size = {}
    for r in rows["denoise"]:
        size[r.t, r.r] = size.get((r.t, r.r), 0) + r.v**2
    assert set(size) == set(signal) and sum(size[k] <= 1.01 * (signal[k] ** 2).sum() for k in size) == len(size)

    points = {}
    for r in B.receivers(spark, DATA).collect():
        points.setdefault(r.e // 4, []).append((r.x, r.y, r.z))
    for r in rows["plane_normals"]:
        p = np.array(points[r.facet])
        n = np.array([r.nx, r.ny, r.nz])
        spread = np.linalg.svd(p - p.mean(axis=0))[1]
        assert np.isclose(n @ n, 1, atol=1e-4) and n @ p.mean(axis=0) >= -1e-4
        assert len(p) < 3 or np.linalg.norm((p - p.mean(axis=0)) @ n) <= spread[-1] + 1e-3

    place = {r.e: (r.x + r.e % 97 / 1000, r.y) for r in B.receivers(spark, DATA).collect()}
    for t in rows["delaunay"][::5]:
        c, radius = rays._circle(np.array([place[e] for e in (t.a, t.b, t.c)]))
        others = np.array([v for e, v in place.items() if e // 64 == t.f])
        assert (((others - c) ** 2).sum(axis=1) >= radius * (1 - 1e-9)).all()

    lines = {(r.t, r.r): np.array([[r.sx, r.sy, r.sz], [r.ex, r.ey, r.ez]]) for r in B.segments(spark, DATA).collect()}
    assert len(rows["bent_ray"]) == len(lines)
    for r in rows["bent_ray"]:
        a, b = lines[r.t, r.r]
        length = np.linalg.norm(b - a)
        assert np.isclose(r.straight, length * (1 + 0.1 * (a[0] + b[0]) / 2), atol=1e-4) and length * (1 + 0.1 * min(a[0], b[0])) * 0.9 <= r.bent <= r.straight + 1e-4
    for r in rows["compensated_times"]:
        a, b = lines[r.t, r.r]
        assert np.isclose(r.straight, np.linalg.norm(b - a) * (1 + 0.02 * (a[0] + b[0]) / 2), atol=1e-5) and 0.9 * r.straight <= r.compensated <= r.straight
    # the fit moves the voxels of the slower slab up more than the others
    change = {r.vid: r.v for r in rows["sgd_inversion"]}
    assert np.mean([v for k, v in change.items() if k % 64 > 31]) > np.mean([v for k, v in change.items() if k % 64 <= 31])


def test_interpolators_filters_and_quadrature():
    rng = np.random.default_rng(2)
    i, j, k = np.indices((9, 8, 7)).astype(float)
    plane = 2 + 0.5 * i - 0.25 * j + 0.125 * k
    p = rng.random((50, 3)) * [4, 3, 2] + 2
    for f in (rays.trilinear, rays.tricubic):
        value, slope = f(plane, p)
        assert np.allclose(value, 2 + p @ [0.5, -0.25, 0.125]) and np.allclose(slope, [0.5, -0.25, 0.125])
    bumpy = np.sin(i / 2) * np.cos(j / 3) + k / 5
    exact = np.sin(p[:, 0] / 2) * np.cos(p[:, 1] / 3) + p[:, 2] / 5
    assert np.abs(rays.tricubic(bumpy, p)[0] - exact).max() < np.abs(rays.trilinear(bumpy, p)[0] - exact).max()
    step = 1e-6
    moved = [(rays.tricubic(bumpy, p + step * np.eye(3)[d])[0] - rays.tricubic(bumpy, p)[0]) / step for d in range(3)]
    assert np.allclose(np.array(moved).T, rays.tricubic(bumpy, p)[1], atol=1e-4)
    total, error = rays.adaptive_integral(lambda q: np.exp(-((q[:, 0] - 3) ** 2) * 40) + q[:, 1], np.array([0.0, 0, 0]), np.array([8.0, 4, 0]), 1e-9, 1e-9)
    length = np.linalg.norm([8, 4])
    assert np.isclose(total, length * (np.sqrt(np.pi / 40) / 8 + 2), atol=1e-7) and error < 1e-6
    flat = np.full((6, 6, 6), 3.0)
    assert np.allclose(models.gaussian_filter(flat), 3) and np.allclose(models.median_filter(flat), 3)
    spiky = flat.copy()
    spiky[2, 3, 4] = 99
    assert np.allclose(models.median_filter(spiky), 3)
    noisy = np.where(i > 4, 1.0, 0.0) + rng.normal(size=i.shape) * 0.1
    clean = rays.denoise_tv(noisy, 0.15)
    assert np.abs(clean - np.where(i > 4, 1.0, 0.0)).mean() < 0.6 * np.abs(noisy - np.where(i > 4, 1.0, 0.0)).mean()


def test_tracers_are_made_from_a_configuration(spark):
    grid = {"lo": [0, 0, 0], "hi": [16, 16, 16], "ncell": [8, 8, 8]}
    make = lambda **o: models.Tracer.from_config(Config({"tracer": {"interpolator": "linear", "grid": dict(grid), **o}}))
    ends = spark.createDataFrame([(0, 2.0, 3.0, 2.0), (1, 14.0, 9.0, 12.0), (2, 99.0, 0.0, 0.0)], "e long, x double, y double, z double")
    wanted = spark.createDataFrame([(0, 1), (0, 2), (1, 1)], "t long, r long")
    length = np.linalg.norm([12, 6, 10])
    for options in ({}, {"instance": "bent", "segments": 4}, {"instance": "fresnel", "wavelength": 3.0}, {"instance": "compensated"}, {"prefilter": {"method": "gaussian", "args": 0.8}}, {"interpolator": "nearest"}):
        got = {(r.t, r.r): r.time for r in models.path_times(make(**options), np.full((8, 8, 8), 0.5), ends, ends, wanted).collect()}
        assert np.isclose(got[0, 1], 0.5 * length) and np.isnan(got[0, 2]) and not got[1, 1] > 0
    assert models.path_times(make(), np.full((8, 8, 8), 0.5), ends, ends).count() == 9
    for bad in ({"instance": "other"}, {"segments": 4}, {"interpolator": "other"}, {"prefilter": {"method": "other"}}, {"grid": grid | {"more": 1}}):
        with pytest.raises(ConfigError):
            make(**bad)
    with pytest.raises(ValueError):
        make().times(models.paths_between(ends, ends), np.ones((3, 3, 3)))


def test_fields_of_first_arrivals():
    even = np.full((15, 15, 15), 0.8)
    field = rays.first_arrivals(even, np.array([7.0, 7.0, 7.0]))
    distance = np.linalg.norm(np.indices(even.shape).reshape(3, -1).T - 7, axis=1).reshape(even.shape)
    assert np.abs(field - 0.8 * distance).max() < 0.12 * 0.8 * distance.max() and np.allclose(field[7, 7], 0.8 * np.abs(np.arange(15) - 7))
    # a fast layer is worth the detour
    layered = np.full((21, 3, 21), 2.0)
    layered[:, :, 10] = 0.2
    field = rays.first_arrivals(layered, np.array([0.0, 1, 8]))
    assert field[20, 1, 8] < 20 * 2 * 0.5


def test_epochs_are_smoothed_and_saved(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(k // 8, k % 8, int(v), float(rng.random())) for k in range(64) for v in rng.choice(27, 5, replace=False)]
    paths = spark.createDataFrame(rows, "t long, r long, vid long, len double")
    voxels = spark.range(27).select(F.col("id").alias("vid"), F.lit(1.0).alias("v"))
    observed = tomography.trace(paths, voxels.withColumn("v", F.when(F.col("vid") >= 9, 1.2).otherwise(1.0)))
    smooth = lambda change: tomography.denoised(change, (3, 3, 3), 0.01)
    change = tomography.straight_ray_inversion(paths, observed, voxels, epochs=2, iterations=25, smooth=smooth, save=str(tmp_path / "e"))
    saved = spark.read.parquet(str(tmp_path / "e"))
    assert {r.epoch for r in saved.select("epoch").distinct().collect()} == {0, 1} and saved.count() == 54
    fitted = {r.vid: r.v for r in change.collect()}
    assert np.abs([fitted[k] - (0.2 if k >= 9 else 0) for k in range(27)]).max() < 0.08
    with pytest.raises(ValueError):
        tomography.denoised(change, (1 << 10, 1 << 10, 1 << 10))
    media = spark.createDataFrame([(1, 2, 10.0, 0.0, 10 / 1.5), (1, 3, 6.0, 4.0, 6 / 1.5 + 4 / 1.6)], "t long, r long, exlen double, inlen double, time double")
    speeds = tomography.two_medium_speeds(media, background=1.4, fixed=True)
    assert speeds.first().exspd == 1.4 and tomography.two_medium_speeds(media).first().misses == 1
    tomography.save_speeds(str(tmp_path / "s"), speeds, media)
    assert spark.read.parquet(str(tmp_path / "s/paths")).where("hit = 'true'").count() == 1 and spark.read.json(str(tmp_path / "s/speeds")).first().hits == 1


def test_levels_like_the_noise_keep_the_sign_of_their_sql(spark, tmp_path):
    import datetime

    import duckdb

    values = [0.0] * 8 + [0.45] * 9 + [3.3] * 9 + [1.7]
    rows = [(k, datetime.datetime(2024, 1, 1, 0, k), 1, v) for k, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = {r[1]: r[2] for r in con.sql(catalog.SQL["snr_rolling"]).fetchall()}
    got = {r.s: r.snr for r in catalog.QUERIES["snr_rolling"](spark, str(tmp_path)).collect()}
    assert {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, v in want.items()}
    assert "-0.0" in map(repr, got.values()) and "nan" in map(repr, got.values())
