"""Plain planar geometry on nested tuples: WKB, validity, repair, pixel cover, convex hull.

A geometry is ``(kind, coordinates)`` with kind 1 point, 3 polygon (rings), 6 multipolygon (polygons).
"""

from __future__ import annotations

import struct

import numpy as np

Z, SRID = 0x80000000, 0x20000000


def from_wkb(data: bytes) -> tuple[int, object]:
    """Read WKB or EWKB, either byte order, ISO or extended Z; a Z is kept in the points."""
    def geometry(at: int):
        order = "<" if data[at] == 1 else ">"
        (code,) = struct.unpack_from(order + "I", data, at + 1)
        at += 5
        if code & SRID:
            at += 4
        dims = 3 if code & Z or (code & 0xFFFF) // 1000 == 1 else 2
        kind = (code & 0xFFFF) % 1000

        def point(at: int):
            return struct.unpack_from(f"{order}{dims}d", data, at), at + 8 * dims

        def many(at: int, read):
            (n,) = struct.unpack_from(order + "I", data, at)
            at, out = at + 4, []
            for _ in range(n):
                x, at = read(at)
                out.append(x)
            return out, at

        if kind == 1:
            coordinates, at = point(at)
        elif kind == 3:
            coordinates, at = many(at, lambda a: many(a, point))
        elif kind == 6:
            coordinates, at = many(at, lambda a: (lambda g: (g[0][1], g[1]))(geometry(a)))
        else:
            raise ValueError(f"WKB kind {kind} is not read")
        return (kind, coordinates), at

    return geometry(0)[0]


def to_wkb(geometry: tuple[int, object], srid: int | None = None) -> bytes:
    """Little-endian WKB; with ``srid`` extended WKB."""
    kind, coordinates = geometry
    first = coordinates if kind == 1 else coordinates[0][0] if kind == 3 else coordinates[0][0][0]
    dims = len(first)
    code = kind | (Z if dims == 3 else 0) | (SRID if srid is not None else 0)
    head = struct.pack("<BI", 1, code) + (struct.pack("<I", srid) if srid is not None else b"")
    ring = lambda r: struct.pack("<I", len(r)) + b"".join(struct.pack(f"<{dims}d", *p) for p in r)
    if kind == 1:
        return head + struct.pack(f"<{dims}d", *coordinates)
    if kind == 3:
        return head + struct.pack("<I", len(coordinates)) + b"".join(map(ring, coordinates))
    return head + struct.pack("<I", len(coordinates)) + b"".join(to_wkb((3, p)) for p in coordinates)


def set_dimensions(geometry: tuple[int, object], dims: int) -> tuple[int, object]:
    return mapped(geometry, lambda p: tuple(p[:2]) + ((p[2] if len(p) > 2 else 0.0,) if dims == 3 else ()))


def mapped(geometry: tuple[int, object], change) -> tuple[int, object]:
    """A geometry with ``change`` applied to every point."""
    kind, c = geometry
    deep = {1: change, 3: lambda rings: [[change(p) for p in r] for r in rings], 6: lambda ps: [[[change(p) for p in r] for r in rings] for rings in ps]}
    return kind, deep[kind](c)


def area(ring: list) -> float:
    """Signed shoelace area."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def _cross(a, b, c, d) -> tuple[float, float] | None:
    """The point where segments cross within both, if they properly do."""
    (x1, y1), (x2, y2), (x3, y3), (x4, y4) = a[:2], b[:2], c[:2], d[:2]
    den = (x1 - x2) * (y3 - y4) - (y1 - y2) * (x3 - x4)
    if den == 0:
        return None
    t = ((x1 - x3) * (y3 - y4) - (y1 - y3) * (x3 - x4)) / den
    u = ((x1 - x3) * (y1 - y2) - (y1 - y3) * (x1 - x2)) / den
    return (x1 + t * (x2 - x1), y1 + t * (y2 - y1)) if 0 < t < 1 and 0 < u < 1 else None


def crossings(ring: list) -> list[tuple[int, int, tuple[float, float]]]:
    n = len(ring) - 1
    return [(i, j, p) for i in range(n) for j in range(i + 2, n) if not (i == 0 and j == n - 1) and (p := _cross(ring[i], ring[i + 1], ring[j], ring[j + 1]))]


def polygons(geometry: tuple[int, object]) -> list[list]:
    return [geometry[1]] if geometry[0] == 3 else geometry[1] if geometry[0] == 6 else []


def is_valid(data: bytes) -> bool:
    """Rings closed, of at least four points, with area, and not crossing themselves; points are finite."""
    try:
        g = from_wkb(data)
    except (ValueError, struct.error, IndexError):
        return False
    if g[0] == 1:
        return all(np.isfinite(g[1]))
    ps = polygons(g)
    return bool(ps) and all(rings and all(len(r) >= 4 and r[0] == r[-1] and area(r) != 0 and not crossings(r) for r in rings) for rings in ps)


def repair(data: bytes) -> bytes | None:
    """Close rings and cut them where they cross themselves; the parts become a multipolygon. None if nothing is left."""
    try:
        g = from_wkb(data)
    except (ValueError, struct.error, IndexError):
        return None
    out = []
    for rings in polygons(g):
        for k, ring in enumerate(rings):
            ring = [p[:2] for p in ring]
            if ring and ring[0] != ring[-1]:
                ring = [*ring, ring[0]]
            parts, todo = [], [ring]
            while todo:
                r = todo.pop()
                found = crossings(r)
                if not found:
                    parts.append(r)
                    continue
                i, j, p = found[0]
                todo += [[p, *r[i + 1 : j + 1], p], [*r[: i + 1], p, *r[j + 1 :]]]
            good = [r for r in parts if len(r) >= 4 and area(r) != 0]
            if k == 0:
                out += [[r] for r in good]
            elif out and good:
                out[-1] += good
    if not out:
        return None
    return to_wkb((3, out[0]) if len(out) == 1 else (6, out))


def inside(rings: list, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Even-odd rule over all rings."""
    odd = np.zeros(x.shape, bool)
    for r in rings:
        for (x1, y1, *_), (x2, y2, *_) in zip(r, r[1:], strict=False):
            if y1 == y2:
                continue
            odd ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return odd


def pixels(geometry: tuple[int, object]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the unit pixels whose centres the polygons hold."""
    rows, cols = [np.zeros(0, int)], [np.zeros(0, int)]
    for rings in polygons(geometry):
        xs, ys = [p[0] for p in rings[0]], [p[1] for p in rings[0]]
        c, r = np.meshgrid(np.arange(int(np.floor(min(xs))), int(np.ceil(max(xs)))), np.arange(int(np.floor(min(ys))), int(np.ceil(max(ys)))))
        c, r = c.ravel(), r.ravel()
        held = inside(rings, c + 0.5, r + 0.5)
        rows.append(r[held])
        cols.append(c[held])
    both = np.unique(np.stack([np.concatenate(rows), np.concatenate(cols)]), axis=1)
    return both[0], both[1]


def touched(ring: list, c: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Whether a ring's line meets each unit pixel: an edge is cut to the pixel's box, what is left is its part in it."""
    out = np.zeros(c.shape, bool)
    for (x1, y1, *_), (x2, y2, *_) in zip(ring, ring[1:], strict=False):
        lo, hi, meets = np.zeros(c.shape), np.ones(c.shape), np.ones(c.shape, bool)
        for start, step, first in ((x1, x2 - x1, c), (y1, y2 - y1, r)):
            if step == 0:
                meets &= (first <= start) & (start < first + 1)
            else:
                a, b = (first - start) / step, (first + 1 - start) / step
                lo, hi = np.maximum(lo, np.minimum(a, b)), np.minimum(hi, np.maximum(a, b))
        out |= meets & (lo < hi)
    return out


def window_pixels(geometry: tuple[int, object], width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a geometry's pixels in a raster: by their centres, in small windows all that it touches."""
    parts = [ring for rings in polygons(geometry) for ring in rings]
    if not parts:
        return np.zeros(0, int), np.zeros(0, int)
    xs, ys = [p[0] for ring in parts for p in ring], [p[1] for ring in parts for p in ring]
    span = lambda lo, hi, n: (max(0, int(np.floor(lo))), min(n, int(np.floor(lo)) + int(np.ceil(hi - lo))))
    (c0, c1), (r0, r1) = span(min(xs), max(xs), width), span(min(ys), max(ys), height)
    if c0 >= c1 or r0 >= r1:
        return np.zeros(0, int), np.zeros(0, int)
    c, r = (a.ravel() for a in np.meshgrid(np.arange(c0, c1), np.arange(r0, r1)))
    held = np.zeros(c.shape, bool)
    for rings in polygons(geometry):
        held |= inside(rings, c + 0.5, r + 0.5)
    if c1 - c0 <= 2 or r1 - r0 <= 2 or not held.any():
        for ring in parts:
            held |= touched(ring, c, r)
    return r[held], c[held]


def many_window_pixels(geoms: list[bytes], width: int, height: int, limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``which, rows, cols`` of ``window_pixels`` of many polygons: those of one ring with as many points are cut together."""
    found, alike = [], {}
    for i, g in enumerate(geoms):
        simple = len(g) >= 13 and (len(g) - 13) % 16 == 0 and g[:9] == b"\x01\x03\x00\x00\x00\x01\x00\x00\x00" and int.from_bytes(g[9:13], "little") * 16 == len(g) - 13 > 0
        if simple:
            alike.setdefault(len(g), []).append(i)
        else:
            rows, cols = window_pixels(from_wkb(g), width, height)
            found.append((np.full(len(rows), i), rows, cols))
    for length, some in alike.items():
        which = np.array(some)
        points = np.frombuffer(b"".join(geoms[i][13:] for i in some), "<f8").reshape(len(some), (length - 13) // 16, 2)
        low, high = points.min(axis=1), points.max(axis=1)
        first = np.floor(low)
        end = np.minimum((width, height), first + np.ceil(high - low))
        start = np.maximum(first, 0)
        sizes = np.maximum(end - start, 0).astype(np.int64)
        start = np.where(sizes > 0, start, 0).astype(np.int64)
        n = sizes.prod(axis=1)
        batch = np.cumsum(n) // limit
        for b in np.unique(batch):
            at = np.flatnonzero((batch == b) & (n > 0))
            own, k = np.repeat(at, n[at]), np.arange(n[at].sum())
            k -= np.repeat(np.cumsum(n[at]) - n[at], n[at])
            c, r = start[own, 0] + k % sizes[own, 0], start[own, 1] + k // sizes[own, 0]
            held = np.zeros(len(own), bool)
            x, y = c + 0.5, r + 0.5
            for e in range(points.shape[1] - 1):
                x1, y1, x2, y2 = points[own, e, 0], points[own, e, 1], points[own, e + 1, 0], points[own, e + 1, 1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    held ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            none = np.bincount(own, weights=held, minlength=len(some)) == 0
            rest = np.flatnonzero(((sizes <= 2).any(axis=1) | none)[own])
            if len(rest):
                p, pc, pr = points[own[rest]], c[rest], r[rest]
                for e in range(points.shape[1] - 1):
                    held[rest] |= _edge_meets(p[:, e], p[:, e + 1], pc, pr)
            found.append((which[own[held]], r[held], c[held]))
    return tuple(np.concatenate([np.zeros(0, int), *(f[k] for f in found)]) for k in range(3))


def _edge_meets(a: np.ndarray, b: np.ndarray, c: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``touched`` for one edge from ``a`` to ``b`` per pixel."""
    lo, hi, meets = np.zeros(c.shape), np.ones(c.shape), np.ones(c.shape, bool)
    for k, first in ((0, c), (1, r)):
        start, step = a[:, k], b[:, k] - a[:, k]
        flat = step == 0
        with np.errstate(divide="ignore", invalid="ignore"):
            u, v = (first - start) / step, (first + 1 - start) / step
        lo, hi = np.where(flat, lo, np.maximum(lo, np.minimum(u, v))), np.where(flat, hi, np.minimum(hi, np.maximum(u, v)))
        meets &= ~flat | ((first <= start) & (start < first + 1))
    return meets & (lo < hi)


def hull_area(points: list[tuple[float, float]]) -> float:
    """Area of the convex hull (monotone chain)."""
    p = sorted(set(points))
    if len(p) < 3:
        return 0.0

    def chain(ps):
        out = []
        for q in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    ring = chain(p) + chain(p[::-1])
    return abs(area([*ring, ring[0]]))


def clip(subject: list, convex: list) -> list:
    """Part of a ring within a convex counter-clockwise ring; both closed."""
    out = subject[:-1]
    for a, b in zip(convex, convex[1:], strict=False):
        side = lambda p, a=a, b=b: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        done, out = out, []
        for p, q in zip(done, [*done[1:], *done[:1]], strict=True):
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if (sp > 0 > sq) or (sp < 0 < sq):
                t = sp / (sp - sq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
    return [*out, out[0]] if out else []
