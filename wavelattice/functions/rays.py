"""Numpy kernels on points, segments, grids and triangles."""

from __future__ import annotations

import numpy as np


def polyline_voxels(points: np.ndarray, lo: np.ndarray, size: float, shape) -> tuple[np.ndarray, np.ndarray]:
    """Voxel numbers and lengths of a polyline in a grid of cubes; parts outside are left out.

    A segment is cut at all the grid planes it crosses; the middle of each part tells its voxel.
    """
    vids, lengths = [], []
    for a, b in zip(points[:-1], points[1:], strict=True):
        u, v = (a - lo) / size, (b - lo) / size
        cuts = [np.array([0.0, 1.0])]
        for p, q in zip(u, v, strict=True):
            if p != q:
                planes = np.arange(np.ceil(min(p, q)), np.floor(max(p, q)) + 1)
                cuts.append((planes - p) / (q - p))
        at = np.unique(np.concatenate(cuts))
        at = at[(at >= 0) & (at <= 1)]
        part = np.diff(at) * np.linalg.norm(b - a)
        cell = np.floor(u + ((at[:-1] + at[1:]) / 2)[:, None] * (v - u)).astype(np.int64)
        good = np.all((cell >= 0) & (cell < np.asarray(shape)), axis=1) & (part > 0)
        cell, part = cell[good], part[good]
        vids.append((cell[:, 0] * shape[1] + cell[:, 1]) * shape[2] + cell[:, 2])
        lengths.append(part)
    return np.concatenate(vids) if vids else np.zeros(0, np.int64), np.concatenate(lengths) if lengths else np.zeros(0)


def trilinear(grid: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and gradients of a grid at points in voxel units; beyond the edge the nearest value."""
    top = np.array(grid.shape) - 1
    p = np.clip(points, 0, top)
    base = np.minimum(np.floor(p).astype(int), np.maximum(top - 1, 0))
    fx, fy, fz = (p - base).T
    flat, (nx, ny, nz) = grid.ravel(), grid.shape
    at = (base[:, 0] * ny + base[:, 1]) * nz + base[:, 2]
    i, j, k = ny * nz * (nx > 1), nz * (ny > 1), int(nz > 1)
    near, far = [[flat[at + s + y] for y in (0, j)] for s in (0, k)], [[flat[at + i + s + y] for y in (0, j)] for s in (0, k)]
    # along x, then along y, then along z
    dx = [[q - p for p, q in zip(a, b, strict=True)] for a, b in zip(near, far, strict=True)]
    vx = [[p + fx * d for p, d in zip(a, b, strict=True)] for a, b in zip(near, dx, strict=True)]
    dy = [b - a for a, b in vx]
    vy = [a + fy * d for (a, _), d in zip(vx, dy, strict=True)]
    sx = [a + fy * (b - a) for a, b in dx]
    dz = vy[1] - vy[0]
    value = vy[0] + fz * dz
    slope = np.stack((sx[0] + fz * (sx[1] - sx[0]), dy[0] + fz * (dy[1] - dy[0]), dz), axis=-1)
    slope[(points < 0) | (points > top)] = 0
    return value, slope


#: Nodes and weights of 15-point Gauss-Legendre on [0, 1].
_GAUSS = tuple(np.array(x) for x in np.polynomial.legendre.leggauss(15))
NODES, WEIGHTS = (_GAUSS[0] + 1) / 2, _GAUSS[1] / 2


def tricubic(grid: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and gradients by cubic convolution (Catmull-Rom) along each axis; beyond the edge the nearest value."""
    top = np.array(grid.shape) - 1
    p = np.clip(points, 0, top)
    base = np.minimum(np.floor(p).astype(int), np.maximum(top - 1, 0))
    f = (p - base)[:, :, None] ** np.arange(4)
    # weights of the samples at -1, 0, 1, 2 as polynomials of the fraction
    basis = np.array([[0, -0.5, 1, -0.5], [1, 0, -2.5, 1.5], [0, 0.5, 2, -1.5], [0, 0, -0.5, 0.5]])
    w = f @ basis.T
    dw = (f[:, :, :3] * np.arange(1, 4)) @ basis[:, 1:].T
    value, slope = np.zeros(len(p)), np.zeros((len(p), 3))
    for step in np.ndindex(4, 4, 4):
        at = np.clip(base + np.array(step) - 1, 0, top)
        v = grid[at[:, 0], at[:, 1], at[:, 2]]
        own = [w[:, d, step[d]] for d in range(3)]
        value += v * own[0] * own[1] * own[2]
        for d in range(3):
            slope[:, d] += v * dw[:, d, step[d]] * own[(d + 1) % 3] * own[(d + 2) % 3]
    slope[(points < 0) | (points > top)] = 0
    return value, slope


def denoise_tv(grid: np.ndarray, weight: float = 0.1, steps: int = 200, tol: float = 2e-4) -> np.ndarray:
    """Total-variation denoising of a volume by projections of the dual field (Chambolle 2004)."""
    grid = np.asarray(grid, float)
    dual, before = np.zeros((grid.ndim, *grid.shape)), None
    out = grid
    for step in range(steps):
        flow = np.zeros_like(grid)
        for axis in range(grid.ndim):
            part = np.moveaxis(dual[axis], axis, 0)
            inward = np.moveaxis(flow, axis, 0)
            inward -= part
            inward[1:] += part[:-1]
        out = grid + flow
        grad = np.zeros_like(dual)
        for axis in range(grid.ndim):
            np.moveaxis(grad[axis], axis, 0)[:-1] = np.diff(np.moveaxis(out, axis, 0), axis=0)
        norm = np.sqrt((grad**2).sum(axis=0))
        energy = ((flow**2).sum() + weight * norm.sum()) / grid.size
        rate = 1 / (2 * grid.ndim)
        dual = (dual - rate * grad) / (1 + rate * norm / weight)
        if before is not None and abs(before - energy) < tol * max(first, 1e-300):
            break
        first, before = (energy if step == 0 else first), energy
    return out


def first_arrivals(slowness: np.ndarray, source: np.ndarray, tol: float = 1e-9, rounds: int = 10_000) -> np.ndarray:
    """Field of first-arrival times from a point (voxel units): the upwind eikonal equation, all voxels at once until nothing changes."""
    near = np.indices(slowness.shape).reshape(3, -1).T - np.asarray(source, float)
    time = np.full(slowness.shape, np.inf)
    # around the source the medium is taken as even
    close = np.abs(near).max(axis=1) <= 1.5
    local = trilinear(slowness, np.asarray(source, float)[None])[0][0]
    time.reshape(-1)[close] = np.linalg.norm(near[close], axis=1) * (local + slowness.reshape(-1)[close]) / 2
    fixed = close.reshape(slowness.shape)
    for _ in range(rounds):
        padded = np.pad(time, 1, constant_values=np.inf)
        low = np.sort([np.minimum(*(padded[tuple(slice(1 + (s if a == d else 0), padded.shape[a] - 1 + (s if a == d else 0)) for a in range(3))] for s in (-1, 1))) for d in range(3)], axis=0)
        with np.errstate(invalid="ignore"):
            new = low[0] + slowness
            for k in (2, 3):
                mean = low[:k].sum(axis=0) / k
                root = mean**2 - ((low[:k] ** 2).sum(axis=0) - slowness**2) / k
                candidate = mean + np.sqrt(np.maximum(root, 0))
                new = np.where((root >= 0) & (new > low[k - 1]), np.minimum(new, candidate), new)
        new = np.where(fixed, time, np.minimum(time, new))
        changed = new < time - tol
        time = new
        if not changed.any():
            break
    return time


def first_arrivals_of(slowness: np.ndarray, sources: np.ndarray, tol: float = 1e-9, rounds: int = 10_000) -> np.ndarray:
    """``first_arrivals`` of many sources (n, 3) at once: the same rounds, but only at voxels of which a neighbour has changed."""
    n, shape = len(sources), slowness.shape
    wide = tuple(k + 2 for k in shape)
    inner = (slice(None), *[slice(1, -1)] * 3)
    sources = np.asarray(sources, float)
    near = np.indices(shape).reshape(3, -1).T - sources[:, None]
    close = np.abs(near).max(axis=2) <= 1.5
    local = trilinear(slowness, sources)[0]
    start = np.where(close, np.linalg.norm(near, axis=2) * (local[:, None] + slowness.reshape(-1)) / 2, np.inf)
    time, free = np.full((n, *wide), np.inf), np.zeros((n, *wide), bool)
    time[inner], free[inner] = start.reshape(n, *shape), ~close.reshape(n, *shape)
    slow = np.pad(slowness, 1).ravel()
    time, free, cells = time.reshape(-1), free.reshape(-1), len(slow)
    steps = (wide[1] * wide[2], wide[2], 1)
    moved = np.flatnonzero(np.isfinite(time))
    for _ in range(rounds):
        mark = np.zeros(len(time), bool)
        for k in steps:
            mark[moved - k] = mark[moved + k] = True
        at = np.flatnonzero(mark & free)
        a, b, c = (np.minimum(time[at - k], time[at + k]) for k in steps)
        a, b = np.minimum(a, b), np.maximum(a, b)
        b, c = np.minimum(b, c), np.maximum(b, c)
        a, b = np.minimum(a, b), np.maximum(a, b)
        s = slow[at % cells]
        with np.errstate(invalid="ignore"):
            new, total, square = a + s, a, a**2
            for k, low in ((2, b), (3, c)):
                total, square = total + low, square + low**2
                mean = total / k
                root = mean**2 - (square - s**2) / k
                new = np.where((root >= 0) & (new > low), np.minimum(new, mean + np.sqrt(np.maximum(root, 0))), new)
            old = time[at]
            better = new < old
            going = np.zeros(n, bool)
            going[at[new < old - tol] // cells] = True
        moved = at[better]
        time[moved] = new[better]
        moved = moved[going[moved // cells]]
        if not len(moved):
            break
    return time.reshape(n, *wide)[inner]


def path_integral(grid: np.ndarray, points: np.ndarray, sample=None) -> tuple[float, np.ndarray]:
    """Integral of a grid along a polyline (voxel units) and its derivative by the points; sample: points -> values and gradients, if not linear."""
    a, b = points[:-1], points[1:]
    d = b - a
    length = np.linalg.norm(d, axis=1)
    at = a[:, None, :] + NODES[None, :, None] * d[:, None, :]
    value, slope = trilinear(grid, at.reshape(-1, 3)) if sample is None else sample(at.reshape(-1, 3))
    value, slope = value.reshape(len(a), -1), slope.reshape(len(a), -1, 3)
    mean = value @ WEIGHTS
    unit = d / np.maximum(length, 1e-300)[:, None]
    grad = np.zeros_like(points)
    grad[:-1] += -unit * mean[:, None] + length[:, None] * np.einsum("snd,n->sd", slope, WEIGHTS * (1 - NODES))
    grad[1:] += unit * mean[:, None] + length[:, None] * np.einsum("snd,n->sd", slope, WEIGHTS * NODES)
    return float((length * mean).sum()), grad


def minimise(f, x: np.ndarray, steps: int = 60, memory: int = 8, tol: float = 1e-9) -> tuple[np.ndarray, float]:
    """Limited-memory quasi-Newton descent with backtracking; f gives value and gradient."""
    value, g = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, alphas = g.copy(), []
        for s, y in reversed(pairs):
            alphas.append((s @ q) / (s @ y))
            q -= alphas[-1] * y
        if pairs:
            q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1])
        for (s, y), alpha in zip(pairs, reversed(alphas), strict=True):
            q += s * (alpha - (y @ q) / (s @ y))
        slope, step = g @ q, 1.0
        if slope <= 0:
            q, slope, pairs = g, g @ g, []
        if slope <= tol * tol:
            break
        while step > 1e-12:
            new = x - step * q
            after, h = f(new)
            if after <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        if (new - x) @ (h - g) > 1e-14:
            pairs = [*pairs[-memory + 1 :], (new - x, h - g)]
        done = value - after <= tol * abs(value)
        x, value, g = new, after, h
        if done:
            break
    return x, value


def path_integrals(grid: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``path_integral`` of many polylines (n, m, 3) at once."""
    a, b = points[:, :-1], points[:, 1:]
    d = b - a
    length = np.linalg.norm(d, axis=2)
    at = a[:, :, None] + NODES[:, None] * d[:, :, None]
    value, slope = trilinear(grid, at.reshape(-1, 3))
    value, slope = value.reshape(at.shape[:3]), slope.reshape(at.shape)
    mean = value @ WEIGHTS
    unit = d / np.maximum(length, 1e-300)[..., None] * mean[..., None]
    grad = np.zeros_like(points)
    grad[:, :-1] += length[..., None] * np.einsum("psnd,n->psd", slope, WEIGHTS * (1 - NODES)) - unit
    grad[:, 1:] += length[..., None] * np.einsum("psnd,n->psd", slope, WEIGHTS * NODES) + unit
    return (length * mean).sum(axis=1), grad


def minimise_many(f, x: np.ndarray, steps: int = 60, memory: int = 8, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """``minimise`` of many vectors (n, d), each by itself; f gives values and gradients of the rows that it is given by number and place."""
    x = x.copy()
    value, g = f(np.arange(len(x)), x)
    count = np.zeros(len(x), int)  # of the pairs that a row has; the newest is last
    s, y = np.zeros((2, memory, *x.shape))
    sy = np.ones((memory, len(x)))
    dot = lambda a, b: np.einsum("nd,nd->n", a, b)
    live = np.arange(len(x))
    for _ in range(steps):
        q, alphas, used = g[live], [], [k for k in range(memory) if (count[live] >= memory - k).any()]
        for k in reversed(used):
            alphas.append(np.where(count[live] >= memory - k, dot(s[k, live], q) / sy[k, live], 0))
            q = q - alphas[-1][:, None] * y[k, live]
        if used:
            size = dot(y[-1, live], y[-1, live])
            q *= np.where(count[live] > 0, sy[-1, live] / np.where(size > 0, size, 1), 1)[:, None]
        for k, alpha in zip(used, reversed(alphas), strict=True):
            q += s[k, live] * np.where(count[live] >= memory - k, alpha - dot(y[k, live], q) / sy[k, live], 0)[:, None]
        slope = dot(g[live], q)
        up = slope <= 0
        q[up], count[live[up]] = g[live[up]], 0
        slope[up] = dot(q[up], q[up])
        go = slope > tol * tol
        live, q, slope = live[go], q[go], slope[go]
        new, after, h = np.empty_like(q), np.empty(len(q)), np.empty_like(q)
        step, todo = 1.0, np.arange(len(live))
        while len(todo) and step > 1e-12:
            own = live[todo]
            new[todo] = x[own] - step * q[todo]
            after[todo], h[todo] = f(own, new[todo])
            todo = todo[~(after[todo] <= value[own] - 1e-4 * step * slope[todo])]
            step /= 2
        found = np.ones(len(live), bool)
        found[todo] = False
        live, new, after, h = live[found], new[found], after[found], h[found]
        ds, dy = new - x[live], h - g[live]
        curve = dot(ds, dy)
        good = curve > 1e-14
        own = live[good]
        for kept, last in ((s, ds), (y, dy), (sy, curve)):
            kept[:-1, own] = kept[1:, own]
            kept[-1, own] = last[good]
        count[own] = np.minimum(count[own] + 1, memory)
        done = value[live] - after <= tol * np.abs(value[live])
        x[live], value[live], g[live] = new, after, h
        live = live[~done]
        if not len(live):
            break
    return x, value


def bent_integrals(grid: np.ndarray, points: np.ndarray, segments: int = 16, tol: float = 1e-6) -> np.ndarray:
    """The integrals of ``bent_path`` of many polylines (n, m, 3) at once."""
    out = path_integrals(grid, points)[0]
    best, live = out.copy(), np.arange(len(points))
    while len(live) and points.shape[1] - 1 < segments:
        points = np.insert(points, np.arange(1, points.shape[1]), (points[:, :-1] + points[:, 1:]) / 2, axis=1)

        def f(rows, x, points=points):
            whole = points[rows]
            whole[:, 1:-1] = x.reshape(len(x), -1, 3)
            value, g = path_integrals(grid, whole)
            return value, g[:, 1:-1].reshape(len(x), -1)

        inner, value = minimise_many(f, points[:, 1:-1].reshape(len(points), -1))
        points[:, 1:-1] = inner.reshape(len(points), -1, 3)
        out[live] = np.minimum(best, value)
        more = best - value >= tol * np.abs(best)
        out[live[more]] = value[more]
        points, live, best = points[more], live[more], value[more]
    return out


def adaptive_integral(f, start: np.ndarray, end: np.ndarray, atol: float = 1e-6, rtol: float = 1e-6, depth: int = 30) -> tuple[float, float]:
    """Integral of f (points -> values) over a segment and its error: intervals are halved until 15 points agree with the same on both halves."""
    d = np.asarray(end, float) - start
    length = float(np.linalg.norm(d))
    total = error = 0.0
    todo, level = [(0.0, 1.0)], 0
    while todo and length:
        a, b = np.array(todo).T
        values = lambda lo, hi: f(start + (lo[:, None] + (hi - lo)[:, None] * NODES).reshape(-1, 1) * d).reshape(len(lo), -1) @ WEIGHTS * (hi - lo) * length
        middle = (a + b) / 2
        whole, halves = values(a, b), values(a, middle) + values(middle, b)
        gap = np.abs(whole - halves)
        done = (gap <= np.maximum(atol * (b - a), rtol * np.abs(halves))) | (level >= depth)
        total, error = total + float(halves[done].sum()), error + float(gap[done].sum())
        todo = [x for lo, m, hi in zip(a[~done], middle[~done], b[~done], strict=True) for x in ((lo, m), (m, hi))]
        level += 1
    return total, error


def bent_path(grid: np.ndarray, points: np.ndarray, segments: int = 16, tol: float = 1e-6, sample=None) -> tuple[np.ndarray, float]:
    """A path of least integral between fixed ends: bisect all segments and optimise until that gains little."""
    points = np.asarray(points, float)
    best, _ = path_integral(grid, points, sample)
    while len(points) - 1 < segments:
        middle = (points[:-1] + points[1:]) / 2
        points = np.insert(points, np.arange(1, len(points)), middle, axis=0)
        ends = points[[0, -1]]

        def f(x, ends=ends):
            whole = np.concatenate((ends[:1], x.reshape(-1, 3), ends[1:]))
            value, g = path_integral(grid, whole, sample)
            return value, g[1:-1].ravel()

        inner, value = minimise(f, points[1:-1].ravel())
        points = np.concatenate((ends[:1], inner.reshape(-1, 3), ends[1:]))
        if best - value < tol * abs(best):
            return points, min(best, value)
        best = value
    return points, best


def descent_walk(field: np.ndarray, start, end, step: float = 1.0, tol: float = 1e-3, c: float = 1e-4, tau: float = 0.5, cycles: int = 10_000) -> tuple[np.ndarray, str]:
    """Steepest descent of a field from start, with why it ended: destination, boundary, stationary or cycle."""
    here, end, points = np.asarray(start, float), np.asarray(end, float), [np.asarray(start, float)]
    top = np.array(field.shape) - 1
    for _ in range(cycles):
        if np.linalg.norm(here - end) <= step:
            return np.array([*points, end]), "destination"
        value, g = trilinear(field, here[None])
        size = np.linalg.norm(g[0])
        if size < tol:
            return np.array(points), "stationary"
        way, length = -g[0] / size, step
        while length > 1e-6 and trilinear(field, (here + length * way)[None])[0][0] > value[0] - c * length * size:
            length *= tau
        here = here + length * way
        if np.any(here < 0) or np.any(here > top):
            return np.array(points), "boundary"
        points.append(here)
    return np.array(points), "cycle"


def fresnel_weights(points: np.ndarray, wavelength: float, shape, reach: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Voxels (centres at whole numbers) near a polyline and 1 - distance / zone radius, the largest of its segments."""
    best: dict[int, float] = {}
    for a, b in zip(points[:-1], points[1:], strict=True):
        span = np.linalg.norm(b - a)
        if not span:
            continue
        wide = reach * np.sqrt(wavelength * span) / 2
        lo = np.maximum(np.floor(np.minimum(a, b) - wide), 0).astype(int)
        hi = np.minimum(np.ceil(np.maximum(a, b) + wide), np.array(shape) - 1).astype(int)
        if np.any(hi < lo):
            continue
        cell = np.stack(np.meshgrid(*(np.arange(p, q + 1) for p, q in zip(lo, hi, strict=True)), indexing="ij"), -1).reshape(-1, 3)
        unit = (b - a) / span
        along = (cell - a) @ unit
        off = np.linalg.norm(cell - a - along[:, None] * unit, axis=1)
        good = (along > 0) & (along < span)
        radius = np.sqrt(wavelength * along[good] * (span - along[good]) / span)
        w = 1 - off[good] / np.maximum(radius, 1e-300)
        for v, x in zip(((cell[good, 0] * shape[1] + cell[good, 1]) * shape[2] + cell[good, 2]).tolist(), w.tolist(), strict=True):
            if x > 0:
                best[v] = max(best.get(v, 0.0), x)
    return np.array(list(best), np.int64), np.array(list(best.values()))


def rytov_kernel(points: np.ndarray, wavelength: float, slowness: float, shape, width: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Voxels of the widened Fresnel zone of a two-point path and the real part of the first-order phase kernel."""
    a, b = points[0], points[-1]
    vid, _ = fresnel_weights(np.array([a, b]), wavelength * width, shape)
    cell = np.stack((vid // (shape[1] * shape[2]), vid // shape[2] % shape[1], vid % shape[2]), -1)
    d1, d2, d = np.linalg.norm(cell - a, axis=1), np.linalg.norm(cell - b, axis=1), np.linalg.norm(b - a)
    k = 2 * np.pi / wavelength
    phase = np.exp(1j * k * (d1 + d2 - d)) * d / np.maximum(d1 * d2, 1e-9)
    return vid, (slowness / wavelength * phase).imag


def facet_normal(points: np.ndarray) -> np.ndarray:
    """Outward unit normal of the corners of a facet (elements lie around the origin)."""
    mean = points.mean(axis=0)
    if len(points) >= 3:
        n = np.cross(points[1] - points[0], points[-1] - points[0])
        size = np.linalg.norm(n)
        if size > 1e-12 * max(1.0, np.abs(points).max()) ** 2:
            return n / size * (1 if n @ mean >= 0 else -1)
    return mean / np.linalg.norm(mean)


def plane_normal(points: np.ndarray) -> np.ndarray:
    """Outward unit normal of the plane that fits all points best."""
    mean = points.mean(axis=0)
    n = np.linalg.svd(points - mean)[2][-1]
    return n * (1 if n @ mean >= 0 else -1)


#: Parameters no further apart are one hit.
SAME_HIT = 1e-7


def segment_pieces(ends: np.ndarray, lo, size: float, shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of segments (n, 2, 3), voxels and first and last parameters of their pieces, which leave no gap from 0 to 1.

    Voxels at the edge of the grid reach outwards without end.
    """
    start, d = ends[:, 0], ends[:, 1] - ends[:, 0]
    cuts = [np.zeros((len(ends), 1)), np.ones((len(ends), 1))]
    with np.errstate(divide="ignore", invalid="ignore"):
        for x in range(3):
            at = (lo[x] + size * np.arange(1, shape[x]) - start[:, x, None]) / d[:, x, None]
            cuts.append(np.where((at > 0) & (at < 1), at, 1.0))
        cuts = np.sort(np.concatenate(cuts, axis=1), axis=1)
        own, k = np.nonzero(cuts[:, 1:] > cuts[:, :-1])
        first, last = cuts[own, k], cuts[own, k + 1]
        cell = np.floor((start[own] + d[own] * ((first + last) / 2)[:, None] - np.asarray(lo, float)) / size)
    cell = np.clip(np.nan_to_num(cell), 0, np.asarray(shape) - 1).astype(np.int64)
    return own, (cell[:, 0] * shape[1] + cell[:, 1]) * shape[2] + cell[:, 2], first, last


#: Pairs of segments and triangles whose hits are held at once, and those that are told apart together.
PAIRS, TILE = 1 << 22, 2048


def crossings_of(ends: np.ndarray, first: np.ndarray, last: np.ndarray, tri: np.ndarray, eps: float = 1e-9):
    """Yields numbers of segments (n, 2, 3) and their hits, sorted and padded with inf: the parameters from first to below last (to 1 at the end) at which they meet triangles (m, 3, 3).

    Five numbers of a pair of a segment and a triangle, all products of a vector of either, have one
    sign if they meet.  They are told in single precision, with room for its error; pairs that
    pass are computed anew in double precision.
    """
    good = np.flatnonzero(np.isfinite(ends).all(axis=(1, 2)))
    tri = tri[np.isfinite(tri).all(axis=(1, 2))]
    if not len(good) or not len(tri):
        return
    p, e1, e2 = tri[:, 0], tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0]
    columns = [np.ascontiguousarray(v.T) for v in (p, e1, e2)]
    middle = p.mean(axis=0)
    p = p - middle
    normal, far, near = np.cross(e2, e1), np.cross(e2, p), np.cross(p, e1)
    level = (p * normal).sum(axis=1)[:, None]
    sides = [np.hstack([-far, e2]), np.hstack([-near, -e1]), np.hstack([normal + far + near, e1 - e2]), np.hstack([-normal, level]), np.hstack([normal, -level])]
    ends, first, last = ends[good], first[good], last[good]
    start, d = ends[:, 0] - middle, ends[:, 1] - ends[:, 0]
    line, one = np.hstack([d, np.cross(start, d)]), np.ones((len(good), 1))
    lines = [line, line, line, np.hstack([start + first[:, None] * d, one]), np.hstack([start + last[:, None] * d, one])]
    size = lambda v: np.sqrt((v * v).sum(axis=1).max())
    room = [2e-6 * size(a) * size(b) + 2 * eps * size(d) * size(normal) for a, b in zip(lines, sides, strict=True)]
    kind = np.float32 if max(room) < 1e24 else np.float64
    # the room is part of the products: a pair passes if all are at least 0, or with the room taken twice at most 0
    left = [np.hstack([a, one]).astype(kind) for a in lines]
    right = [np.hstack([b, np.full((len(b), 1), r)]).astype(kind).T.copy() for b, r in zip(sides, room, strict=True)]
    step = max(1, min(64, PAIRS // len(tri)))
    for k in range(0, len(good), step):
        part = slice(k, k + step)
        own = good[part]
        at = [(o, _meet(ends[part], first[part], last[part], columns, o, e, eps)) for o, e in _tiles([a[part] for a in left], right, 2 * max(room))]
        row = np.concatenate([o[h[0]] for o, h in at])
        value = np.concatenate([h[1] for _, h in at])
        if len(at) > 1:
            order = np.argsort(row.astype(np.uint8), kind="stable")
            row, value = row[order], value[order]
        count = np.bincount(row, minlength=len(own))
        found = np.full((len(own), max(1, count.max())), np.inf)
        found[row, np.arange(len(row)) - (np.cumsum(count) - count)[row]] = value
        yield own, np.sort(found, axis=1), count


def _tiles(left, right, most: float):
    """Numbers of segments and triangles of the pairs that may meet, tile by tile."""
    for j in range(0, right[0].shape[1], TILE):
        low = left[0] @ right[0][:, j : j + TILE]
        high, other = low.copy(), np.empty_like(low)
        for a, b in zip(left[1:], right[1:], strict=True):
            np.matmul(a, b[:, j : j + TILE], out=other)
            np.minimum(low, other, out=low)
            np.maximum(high, other, out=high)
        own, each = np.nonzero((low >= 0) | (high <= most))
        yield own, each + j


def _meet(ends, first, last, columns, own, each, eps) -> tuple[np.ndarray, np.ndarray]:
    """Which of these pairs meet, and where; the arithmetic is that of the SQL, term by term."""
    start, end = ends[:, 0].T.take(own, axis=1), ends[:, 1].T.take(own, axis=1)
    p, e1, e2 = (c.take(each, axis=1) for c in columns)
    cross = lambda a, b: (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    d, s = end - start, start - p
    h, q = cross(d, e2), cross(s, e1)
    det = dot(e1, h)
    with np.errstate(divide="ignore", invalid="ignore"):
        u, v, t = dot(s, h) / det, dot(d, q) / det, dot(e2, q) / det
    to = last.take(own)
    hit = np.flatnonzero((np.abs(det) > 1e-14) & (u >= -eps) & (v >= -eps) & (u + v <= 1 + eps) & (t >= first.take(own)) & ((t < to) | ((to == 1) & (t == 1))))
    return hit, t[hit]


def crossing_sums(found: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of sorted hits padded with inf: how many differ, the first, the last, and their sum with signs -, +, -, ..."""
    with np.errstate(invalid="ignore"):
        keep = np.diff(found, axis=1, prepend=-np.inf) > SAME_HIT
    keep &= np.isfinite(found)
    n = np.cumsum(keep, axis=1)
    share = np.where(keep, np.where(n % 2 == 0, found, -found), 0.0).sum(axis=1)
    return n[:, -1], found[:, 0], found[np.arange(len(found)), np.maximum(count - 1, 0)], share


def crossings(start, end, tri: np.ndarray, eps: float = 1e-9) -> np.ndarray:
    """Sorted distinct parameters at which a segment meets triangles (n, 3, 3); hits on shared edges count once."""
    d = np.asarray(end, float) - start
    e1, e2 = tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0]
    h = np.cross(d, e2)
    det = np.einsum("ij,ij->i", e1, h)
    ok = np.abs(det) > 1e-14
    inv = 1 / np.where(ok, det, 1)
    s = start - tri[:, 0]
    u = np.einsum("ij,ij->i", s, h) * inv
    q = np.cross(s, e1)
    v = np.einsum("j,ij->i", d, q) * inv
    t = np.einsum("ij,ij->i", e2, q) * inv
    hit = np.sort(t[ok & (u >= -eps) & (v >= -eps) & (u + v <= 1 + eps) & (t >= 0) & (t <= 1)])
    return hit[np.concatenate(([True], np.diff(hit) > SAME_HIT))] if len(hit) else hit


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles of points in the plane, by insertion into a triangle around them all."""
    n = len(points)
    if n < 3:
        return np.zeros((0, 3), int)
    centre, span = points.mean(axis=0), max(np.ptp(points, axis=0).max(), 1e-9) * 1e4
    all_points = np.concatenate((points, centre + span * np.array([[-1, -1], [1, -1], [0, 1.5]])))
    tris = [(n, n + 1, n + 2)]
    circles = [_circle(all_points[list(tris[0])])]
    for p in range(n):
        bad = [k for k, (c, r) in enumerate(circles) if ((all_points[p] - c) ** 2).sum() < r * (1 - 1e-12)]
        edges: dict[tuple[int, int], int] = {}
        for k in bad:
            for a, b in ((0, 1), (1, 2), (2, 0)):
                e = tuple(sorted((tris[k][a], tris[k][b])))
                edges[e] = edges.get(e, 0) + 1
        for k in reversed(bad):
            tris.pop(k)
            circles.pop(k)
        for (a, b), count in edges.items():
            if count == 1:
                tris.append((a, b, p))
                circles.append(_circle(all_points[[a, b, p]]))
    return np.array([t for t in tris if max(t) < n], int).reshape(-1, 3)


def _circle(p: np.ndarray) -> tuple[np.ndarray, float]:
    a, b = p[1] - p[0], p[2] - p[0]
    d = 2 * (a[0] * b[1] - a[1] * b[0])
    if abs(d) < 1e-300:
        return p[0], np.inf
    c = np.array([b[1] * (a @ a) - a[1] * (b @ b), a[0] * (b @ b) - b[0] * (a @ a)]) / d
    return p[0] + c, float(c @ c)


def newton_fit(residual, x: np.ndarray, maxit: int = 50, tol: float = 1e-9) -> np.ndarray:
    """Gauss-Newton with least-norm steps; residual gives values and Jacobian."""
    for _ in range(maxit):
        f, jac = residual(x)
        step = np.linalg.lstsq(jac, -f, rcond=None)[0]
        x = x + step
        if np.linalg.norm(step) < tol * max(np.linalg.norm(x), 1e-12):
            break
    return x


def compensated_integral(grid: np.ndarray, start, end, panels: int = 8, weight: float = 1.0, max_angle: float | None = None) -> tuple[float | None, float, np.ndarray]:
    """Straight-ray integral of a grid, with and without the turn of the wavefront, and the normal at the end.

    The normal starts along the ray and turns with the relative gradient as it goes; each part
    of the integral counts by the cosine between normal and ray.  The first value is None where
    the angle exceeds max_angle (degrees).  Points are in voxel units.
    """
    comp, straight, normal = compensated_integrals(grid, np.array([[start, end]], float), panels, weight, max_angle)
    return None if np.isnan(comp[0]) else float(comp[0]), float(straight[0]), normal[0]


def compensated_integrals(grid: np.ndarray, ends: np.ndarray, panels: int = 8, weight: float = 1.0, max_angle: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``compensated_integral`` of many rays (n, 2, 3) at once; NaN where the angle exceeds max_angle."""
    start, d = ends[:, 0], ends[:, 1] - ends[:, 0]
    length = np.linalg.norm(d, axis=1)
    some = length > 0
    ray = d / np.where(some, length, 1)[:, None]
    at = ((np.arange(panels)[:, None] + NODES) / panels).ravel()
    value, slope = trilinear(grid, (start[:, None] + at[:, None] * d[:, None]).reshape(-1, 3))
    value, slope = value.reshape(len(ends), -1), slope.reshape(len(ends), -1, 3)
    if np.any(value[some] == 0):
        raise ValueError("the grid vanishes on the path")
    value = np.where(some[:, None], value, 1)
    ray = np.where(some[:, None], ray, 1.0)
    turn, normal, last, cosine = weight * length[:, None, None] * slope / value[..., None], ray, 0.0, np.empty(value.shape)
    for k, u in enumerate(at):
        normal = normal + ((u - last) / np.einsum("nd,nd->n", ray, normal))[:, None] * turn[:, k]
        normal /= np.linalg.norm(normal, axis=1)[:, None]
        cosine[:, k], last = np.einsum("nd,nd->n", normal, ray), u
    part = np.tile(WEIGHTS / panels, panels) * value * length[:, None]
    comp = np.einsum("nk,nk->n", part, cosine)
    if max_angle is not None:
        comp[some & (cosine.min(axis=1) < np.cos(np.radians(max_angle)))] = np.nan
    return comp, part.sum(axis=1), np.where(some[:, None], normal, 0.0)
