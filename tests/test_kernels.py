import numpy as np
import pytest

from wavelattice.functions import kernels as K
from wavelattice.functions import rays


@pytest.fixture
def rng():
    return np.random.default_rng(3)


def test_shift_and_delay_undo_each_other(rng):
    x = np.exp(-0.5 * ((np.arange(128) - 50) / 4) ** 2)
    assert np.allclose(K.delay_by(K.delay_by(x, 0, 128, 3.3, True), 0, 128, -3.3, True), x)
    assert K.find_delay(K.delay_by(x, 0, 128, 7.25), 0, x, 0, 8) == (7.25, 1)
    assert K.find_delay(-x, 5, x, 0, negative=True) == (5.0, -1)
    assert K.find_delay(np.zeros(8), 0, x, 0) == (0.0, 1)
    assert np.array_equal(K.delay_by(x, 0, 128, 0), x)


def test_transforms(rng):
    x = rng.normal(size=64)
    assert np.isclose((np.abs(np.fft.fft(x)) ** 2).sum() / 64, (x**2).sum())
    assert np.allclose(K.walsh_hadamard(K.walsh_hadamard(x)), 64 * x)
    win = np.hanning(11)[1:-1]
    assert np.allclose(K.istft(K.stft(x, win), win), x)
    assert np.allclose(K.resample(x, 3)[::3], x)
    assert [K.regular_size(n) for n in (1, 7, 11, 13, 121)] == [1, 8, 12, 15, 125]
    with pytest.raises(ValueError):
        K.walsh_hadamard(np.zeros(6))


def test_arrival_is_near_the_onset(rng):
    x = np.concatenate((rng.normal(size=200) * 0.01, np.sin(np.arange(100) * 0.6)))
    options = {"prewin": 20, "postwin": 20, "vpwin": 20, "avgwin": 5}
    assert abs(K.arrival_sample(x, **options) - 200) < 12
    assert abs(K.arrival_sample(x, interpolate=8, **options) - 200) < 12
    assert abs(K.arrival_sample(x, breakaway=2.0, breaklen=20, **options) - 200) < 25
    assert abs(K.arrival_sample(x, merpeak=5, **options) - 200) < 15


def test_peaks_and_floor(rng):
    peaks = K.find_peaks(np.array([0, 2, 1, 5, 1, 3, 0.0]))
    assert [(p["index"], p["key"], p["sub"]) for p in peaks] == [(1, (2, 1.0), None), (3, None, None), (5, (4, 1.0), None)]
    x = np.exp(-0.5 * ((np.arange(200) - 90) / 5) ** 2) * np.cos(np.arange(200))
    i, prom, width = K.choose_peak(x, 0)
    assert abs(i - 90) <= 1 and prom > 0.9
    with pytest.raises(ValueError):
        K.noise_floor_db(x, 500)
    rate, amp = K.prony(3 * np.exp(-0.2 * np.arange(40)), 1)
    assert np.allclose([rate[0], amp[0]], [-0.2, 3])


def test_denoise_keeps_the_tone(rng):
    t = np.arange(400)
    clean = np.where((t > 200) & (t < 300), np.sin(t * 0.8), 0)
    out = K.denoise(clean + rng.normal(size=400) * 0.05, band=(0.08, 0.2), noisewin=(0, 150), pfa=1e-3, sigma=6)
    assert np.abs(out - clean)[30:-30].mean() < 0.06


def test_lengths_are_conserved(rng):
    a, b = rng.random(3) * 8, rng.random(3) * 8
    vid, length = rays.polyline_voxels(np.array([a, b]), np.zeros(3), 1.0, (8, 8, 8))
    assert np.isclose(length.sum(), np.linalg.norm(b - a)) and len(set(vid.tolist())) == len(vid)
    grid = np.full((9, 9, 9), 1.5)
    assert np.isclose(rays.path_integral(grid, np.array([a, b]))[0], 1.5 * np.linalg.norm(b - a))


def test_bent_paths_are_no_longer_than_straight_ones():
    grid = 1 + np.indices((10, 10, 10))[0] * 0.2
    ends = np.array([[6.0, 1, 5], [6.0, 8, 5]])
    points, value = rays.bent_path(grid, ends, 8)
    assert value < rays.path_integral(grid, ends)[0] and np.allclose(points[[0, -1]], ends)
    walk, why = rays.descent_walk(np.indices((10, 10, 10)).astype(float).sum(axis=0), [8, 8, 8], [0, 0, 0], 0.5)
    assert why in ("destination", "boundary") and len(walk) > 5


def test_geometry(rng):
    square = np.array([[2.0, -1, -1], [2, 1, -1], [2, 1, 1], [2, -1, 1]])
    assert np.allclose(rays.facet_normal(square), [1, 0, 0]) and np.allclose(rays.plane_normal(square), [1, 0, 0])
    assert np.allclose(rays.facet_normal(square[:2]), square[:2].mean(axis=0) / np.linalg.norm(square[:2].mean(axis=0)))
    cube = np.array([[[3.0, -9, -9], [3, 9, -9], [3, 0, 9]], [[6.0, -9, -9], [6, 9, -9], [6, 0, 9]]])
    assert np.allclose(rays.crossings(np.zeros(3), np.array([10.0, 0, 0]), cube), [0.3, 0.6])
    points = rng.random((40, 2))
    tri = rays.delaunay(points)
    for t in tri:
        c, r = rays._circle(points[t])
        assert (((points - c) ** 2).sum(axis=1) >= r * (1 - 1e-9)).all()
    vid, w = rays.fresnel_weights(np.array([[1.0, 4, 4], [7, 4, 4]]), 1.0, (8, 8, 8))
    assert w.max() <= 1 and ((vid // 8) % 8 == 4).any()


def test_wavefronts_do_not_turn_in_even_media():
    flat = np.full((9, 9, 9), 2.0)
    comp, straight, normal = rays.compensated_integral(flat, [1, 1, 1], [7, 4, 5])
    length = np.linalg.norm([6, 3, 4])
    assert np.isclose(comp, 2 * length) and np.isclose(straight, 2 * length) and np.allclose(normal, np.array([6, 3, 4]) / length)
    tilted = 1 + np.indices((9, 9, 9))[0] * 0.05
    comp, straight, normal = rays.compensated_integral(tilted, [4, 1, 4], [4, 7, 4])
    assert comp < straight and normal[0] > 0 and rays.compensated_integral(tilted, [4, 1, 4], [4, 7, 4], max_angle=1)[0] is None
