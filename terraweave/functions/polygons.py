"""Polygons laid over each other: areas by slabs, validity, repair and simplification, on numpy.

A polygon is any number of rings; what an odd number of rings encloses is
inside, so holes and several parts need no marks.  Pairs are handled in
batches.  The plane is cut at every vertex and every crossing of two edges;
between two cuts no edges cross, so the length inside changes linearly and its
value in the middle times the width is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs of edges, and of slabs and edges, that are held at once.
MOST_AT_ONCE = 1 << 21


def ring_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, ring, x, y) of the points of a GEOM column; rings are numbered over the column."""
    rings = pc.struct_field(column, "rings")
    per = pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(rings)
    size = pc.fill_null(pc.list_value_length(flat), 0).to_numpy(zero_copy_only=False)
    points = pc.list_flatten(flat)
    x, y = (pc.fill_null(pc.struct_field(points, c), np.nan).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y"))
    ring = np.repeat(np.arange(len(size)), size)
    owner = np.repeat(np.repeat(np.arange(len(per)), per), size)
    return owner, ring, x, y


def edges_of(column: pa.Array) -> np.ndarray:
    """Rows (owner, x1, y1, x2, y2) of the sides of all rings; an open ring is closed, sides without length are left out."""
    owner, ring, x, y = ring_points(column)
    if not len(x):
        return np.zeros((0, 5))
    last = np.append(ring[1:] != ring[:-1], True)
    start = np.append(0, np.flatnonzero(last)[:-1] + 1)
    following = np.arange(1, len(x) + 1)
    following[last] = start
    rows = np.column_stack([owner, x, y, x[following], y[following]])
    return rows[np.isfinite(rows).all(1) & ((rows[:, 1] != rows[:, 3]) | (rows[:, 2] != rows[:, 4]))]


def _within_groups(counts: np.ndarray) -> Iterator[slice]:
    """Stretches of items whose counts add up to about MOST_AT_ONCE."""
    total = np.append(0, np.cumsum(counts))
    at = 0
    while at < len(counts):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + MOST_AT_ONCE, "right")) - 1)
        yield slice(at, stop)
        at = stop


def _pairs(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, index) for every index of the ranges begin..end."""
    size = np.maximum(end - begin, 0)
    item = np.repeat(np.arange(len(size)), size)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)


def overlay_areas(first: np.ndarray, second: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(area of the first, area of the second, area of both) of ``n`` pairs from the rows of ``edges_of`` of either side."""
    side = np.append(np.zeros(len(first), np.int64), np.ones(len(second), np.int64))
    rows = np.vstack([first, second])
    order = np.argsort(rows[:, 0], kind="stable")
    rows, side = rows[order], side[order]
    pair = rows[:, 0].astype(np.int64)
    areas = np.zeros((3, n))
    if not len(rows):
        return areas[0], areas[1], areas[2]
    # Local coordinates keep the digits of far positions.
    start = np.searchsorted(pair, np.arange(n + 1))
    some = np.flatnonzero(np.diff(start))
    low = np.zeros((n, 2))
    low[some, 0] = np.minimum.reduceat(np.minimum(rows[:, 1], rows[:, 3]), start[some])
    low[some, 1] = np.minimum.reduceat(np.minimum(rows[:, 2], rows[:, 4]), start[some])
    turned = rows[:, 1] > rows[:, 3]
    x1, y1 = np.where(turned, rows[:, 3], rows[:, 1]) - low[pair, 0], np.where(turned, rows[:, 4], rows[:, 2]) - low[pair, 1]
    x2, y2 = np.where(turned, rows[:, 1], rows[:, 3]) - low[pair, 0], np.where(turned, rows[:, 2], rows[:, 4]) - low[pair, 1]
    events_x, events_pair = [x1, x2], [pair, pair]
    index = np.arange(len(rows))
    until = start[pair + 1]
    for part in _within_groups(until - index - 1):
        i, j = _pairs(index[part] + 1, until[part])
        i = i + part.start
        near = (x1[i] < x2[j]) & (x1[j] < x2[i])
        i, j = i[near], j[near]
        rx, ry, sx, sy = x2[i] - x1[i], y2[i] - y1[i], x2[j] - x1[j], y2[j] - y1[j]
        det = rx * sy - ry * sx
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((x1[j] - x1[i]) * sy - (y1[j] - y1[i]) * sx) / det
            u = ((x1[j] - x1[i]) * ry - (y1[j] - y1[i]) * rx) / det
        hit = (det != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        events_x.append(x1[i][hit] + t[hit] * rx[hit])
        events_pair.append(pair[i[hit]])
    ex, ep = np.concatenate(events_x), np.concatenate(events_pair)
    order = np.lexsort((ex, ep))
    ex, ep = ex[order], ep[order]
    slab = np.flatnonzero((ep[1:] == ep[:-1]) & (ex[1:] > ex[:-1]))
    left, right, owner = ex[slab], ex[slab + 1], ep[slab]
    middle = (left + right) / 2
    for part in _within_groups(start[owner + 1] - start[owner]):
        s, e = _pairs(start[owner[part]], start[owner[part] + 1])
        s = s + part.start
        spans = (x1[e] < middle[s]) & (x2[e] > middle[s])
        s, e = s[spans], e[spans]
        y = y1[e] + (middle[s] - x1[e]) * (y2[e] - y1[e]) / (x2[e] - x1[e])
        order = np.lexsort((y, s))
        s, y, of = s[order], y[order], side[e[order]]
        if len(s) < 2:
            continue
        opens = np.append(True, s[1:] != s[:-1])
        head = np.maximum.accumulate(np.where(opens, np.arange(len(s)), 0))
        inside = []
        for k in (0, 1):
            count = np.cumsum(of == k)
            inside.append((count - count[head] + (of[head] == k)) % 2 == 1)
        length = np.append(np.where(s[1:] == s[:-1], y[1:] - y[:-1], 0.0), 0.0) * (right - left)[s]
        for k, where in enumerate((inside[0], inside[1], inside[0] & inside[1])):
            areas[k] += np.bincount(owner[s], length * where, n)
    return areas[0], areas[1], areas[2]


# --- one ring at a time ------------------------------------------------------


def closed_ring(points: np.ndarray) -> np.ndarray:
    return points if len(points) and (points[0] == points[-1]).all() else np.vstack([points, points[:1]])


def ring_area(points: np.ndarray) -> float:
    """Signed area of a closed ring."""
    p = points - points[0]
    return float((p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]).sum() / 2)


def crossings(points: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(side, side, point) of the proper crossings of a closed ring, in the order of the sides."""
    n = len(points) - 1
    found = []
    d = np.diff(points, axis=0)
    for i in range(n - 2):
        j = np.arange(i + 2, n if i else n - 1)
        det = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
        gap = points[j] - points[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (gap[:, 0] * d[j, 1] - gap[:, 1] * d[j, 0]) / det
            u = (gap[:, 0] * d[i, 1] - gap[:, 1] * d[i, 0]) / det
        hit = np.flatnonzero((det != 0) & (t > 1e-12) & (t < 1 - 1e-12) & (u > 1e-12) & (u < 1 - 1e-12))
        found += [(i, int(j[k]), points[i] + t[k] * d[i]) for k in hit]
    return found


def simple_parts(points: np.ndarray) -> list[np.ndarray]:
    """The simple rings a closed ring falls into when it is cut at its crossings."""
    todo, done = [points], []
    while todo:
        ring = todo.pop()
        if len(ring) < 4:
            continue
        cut = next(iter(crossings(ring)), None)
        if cut is None:
            done.append(ring)
            continue
        i, j, at = cut
        todo.append(np.vstack([at, ring[i + 1 : j + 1], at]))
        todo.append(np.vstack([ring[: i + 1], at, ring[j + 1 :]]))
    return done


def largest_part(points: np.ndarray) -> np.ndarray | None:
    """The simple part of most area of a closed ring, counter-clockwise; None without any area."""
    parts = sorted(simple_parts(points), key=lambda r: -abs(ring_area(r)))
    if not parts or abs(ring_area(parts[0])) == 0:
        return None
    return parts[0] if ring_area(parts[0]) > 0 else parts[0][::-1]


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker: the vertices that lie farther than the tolerance from what stands for them."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    # A closed ring begins from the vertex farthest from its first one.
    far = int(np.argmax(np.hypot(*(points - points[0]).T)))
    keep[far] = True
    stack = [(0, far), (far, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d = points[b] - points[a]
        inner = points[a + 1 : b] - points[a]
        length = np.hypot(*d)
        away = np.abs(inner[:, 0] * d[1] - inner[:, 1] * d[0]) / length if length else np.hypot(*inner.T)
        k = int(np.argmax(away))
        if away[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def boundary_distances(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Distance of each point from the boundary of a ring."""
    a, d = ring[:-1], np.diff(ring, axis=0)
    square = np.maximum((d**2).sum(1), 1e-300)
    gap = points[:, None, :] - a[None]
    t = np.clip((gap * d[None]).sum(2) / square, 0, 1)
    return np.sqrt(((gap - t[:, :, None] * d[None]) ** 2).sum(2)).min(1)


def along(ring: np.ndarray, n: int) -> np.ndarray:
    """``n`` points at equal steps along the boundary, from the first vertex."""
    length = np.hypot(*np.diff(ring, axis=0).T)
    reach = np.append(0, np.cumsum(length))
    at = np.arange(n) / n * reach[-1]
    return np.column_stack([np.interp(at, reach, ring[:, k]) for k in (0, 1)])


def hausdorff(a: np.ndarray, b: np.ndarray) -> float:
    """The farthest any vertex of either ring lies from the other's boundary."""
    return float(max(boundary_distances(a, b).max(), boundary_distances(b, a).max()))


def boundary_distance(a: np.ndarray, b: np.ndarray, n: int = 16) -> float:
    """Mean distance of points along the first boundary from the second one."""
    return float(boundary_distances(along(a, n), b).mean())


def turning(ring: np.ndarray, n: int = 64) -> np.ndarray:
    """Direction of the boundary at equal steps, unwrapped, about its mean."""
    p = along(ring if ring_area(ring) > 0 else ring[::-1], n)
    d = np.roll(p, -1, axis=0) - p
    angle = np.unwrap(np.arctan2(d[:, 1], d[:, 0]))
    return angle - angle.mean()


def turning_distance(a: np.ndarray, b: np.ndarray, most: float = 3.0) -> float:
    """Root mean square difference of two turning functions at the best shift of the start, by one Fourier transform."""
    n = len(a)
    product = np.fft.irfft(np.fft.rfft(a) * np.conj(np.fft.rfft(b)), n)
    square = (a @ a + b @ b - 2 * product.max()) / n
    return float(min(most, np.sqrt(max(0.0, square))))


def contains(ring: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether points lie inside a ring, by the parity of the sides to their right."""
    out = np.zeros(x.shape, bool)
    for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:]):
        if y1 != y2:
            out ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return out


def hu_moments(ring: np.ndarray, cells: int = 32) -> np.ndarray:
    """The seven invariant moments of the ring's mask on a grid, as signed logarithms over 30."""
    low, high = ring.min(0), ring.max(0)
    size = max(float((high - low).max()), 1e-9)
    at = (np.arange(cells) + 0.5) / cells
    gx, gy = np.meshgrid(low[0] + at * size, low[1] + at * size)
    mask = contains(ring, gx, gy).astype(float)
    mass = mask.sum()
    if mass == 0:
        return np.zeros(7)
    u, v = np.meshgrid(np.arange(cells, dtype=float), np.arange(cells, dtype=float))
    u, v = u - (u * mask).sum() / mass, v - (v * mask).sum() / mass
    eta = lambda p, q: (u**p * v**q * mask).sum() / mass ** (1 + (p + q) / 2)
    n20, n02, n11, n30, n03, n21, n12 = eta(2, 0), eta(0, 2), eta(1, 1), eta(3, 0), eta(0, 3), eta(2, 1), eta(1, 2)
    a, b = n30 + n12, n21 + n03
    c, d = n30 - 3 * n12, 3 * n21 - n03
    h = np.array([
        n20 + n02, (n20 - n02) ** 2 + 4 * n11**2, c**2 + d**2, a**2 + b**2, c * a * (a**2 - 3 * b**2) + d * b * (3 * a**2 - b**2),
        (n20 - n02) * (a**2 - b**2) + 4 * n11 * a * b, d * a * (a**2 - 3 * b**2) - c * b * (3 * a**2 - b**2),
    ])
    return np.where(np.abs(h) > 1e-30, -np.sign(h) * np.log10(np.maximum(np.abs(h), 1e-30)) / 30, 0.0)


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise closed hull of points (monotone chain)."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return closed_ring(p)

    def chain(rows):
        out: list = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return closed_ring(np.array(chain(p) + chain(p[::-1])))


def least_rectangle(ring: np.ndarray) -> tuple[float, float, float]:
    """(long side, short side, direction of the long side in 0..pi) of the smallest rectangle around a ring."""
    hull = convex_hull(ring)
    d = np.diff(hull, axis=0)
    angles = np.unique(np.arctan2(d[:, 1], d[:, 0]) % (np.pi / 2)) if len(d) else np.zeros(1)
    best = None
    for angle in angles:
        c, s = np.cos(angle), np.sin(angle)
        u, v = hull @ [c, s], hull @ [-s, c]
        w, h = np.ptp(u), np.ptp(v)
        if best is None or w * h < best[0] - 1e-9:
            best = w * h, max(w, h), min(w, h), (angle if w >= h else angle + np.pi / 2) % np.pi
    return best[1:]


def rectilinearity(ring: np.ndarray, degrees: float = 12.0) -> tuple[float, float]:
    """(share of the boundary that runs along or across the main direction, that direction in degrees of 0..90)."""
    d = np.diff(ring, axis=0)
    length = np.hypot(*d.T)
    angle = np.degrees(np.arctan2(d[:, 1], d[:, 0])) % 90
    # The main direction is the mean over quarter turns, weighted by length.
    main = np.degrees(np.angle((length * np.exp(4j * np.radians(angle))).sum()) / 4) % 90
    off = np.abs((angle - main + 45) % 90 - 45)
    total = length.sum()
    return (float(length[off <= degrees].sum() / total) if total else 0.0), float(main)


def squared(ring: np.ndarray, degrees: float = 12.0) -> np.ndarray | None:
    """The ring with sides near the main direction or its diagonals turned onto them and met anew; None if it falls apart."""
    _, main = rectilinearity(ring, degrees)
    a, d = ring[:-1], np.diff(ring, axis=0)
    angle = np.degrees(np.arctan2(d[:, 1], d[:, 0]))
    nearest = main + np.round((angle - main) / 45) * 45
    turned = np.radians(np.where(np.abs((angle - nearest + 180) % 360 - 180) <= degrees, nearest, angle))
    middle, unit = a + d / 2, np.column_stack([np.cos(turned), np.sin(turned)])
    out = []
    for k in range(len(a)):
        p, q, r, s = middle[k - 1], unit[k - 1], middle[k], unit[k]
        det = q[0] * s[1] - q[1] * s[0]
        out.append(p + q * ((r[0] - p[0]) * s[1] - (r[1] - p[1]) * s[0]) / det if abs(det) > 0.17 else a[k])
    new = closed_ring(np.array(out))
    moved = np.abs(new[:-1] - a).max() if len(a) else np.inf
    return new if len(new) >= 4 and not crossings(new) and moved < np.hypot(*np.ptp(ring, axis=0)) / 4 else None
