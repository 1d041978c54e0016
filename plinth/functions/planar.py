"""Plane geometry kernels for one plan at a time: rings, regions, faces and hulls, without a geometry library.

A ring is a list of (x, y); regions are unions of rings under the even-odd rule. Areas come from horizontal slabs
between all vertex and crossing heights: inside a slab no edges cross, so widths are linear and the middle one is exact.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Sequence

Point = tuple[float, float]
Ring = Sequence[Point]
EPS = 1e-9


def area(ring: Ring) -> float:
    """Signed area."""
    return sum(p[0] * q[1] - p[1] * q[0] for p, q in edges(ring)) / 2


def edges(ring: Ring) -> list[tuple[Point, Point]]:
    return [(tuple(p), tuple(q)) for p, q in zip(ring, [*ring[1:], *ring[:1]]) if tuple(p) != tuple(q)]


def dist(p: Point, q: Point) -> float:
    return math.hypot(q[0] - p[0], q[1] - p[1])


def foot(p: Point, a: Point, b: Point) -> float:
    """Clamped parameter of the nearest point of a segment."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    return 0.0 if n == 0 else max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n))


def between(a: Point, b: Point, t: float) -> Point:
    return a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])


def point_segment(p: Point, a: Point, b: Point) -> float:
    return dist(p, between(a, b, foot(p, a, b)))


def turn(a: Point, b: Point, c: Point) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def crossing(a: Point, b: Point, c: Point, d: Point) -> Point | None:
    """The point two segments share if they aren't parallel, touching included."""
    det = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
    if abs(det) <= EPS * max(1.0, dist(a, b) * dist(c, d)):
        return None
    t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / det
    u = ((c[0] - a[0]) * (b[1] - a[1]) - (c[1] - a[1]) * (b[0] - a[0])) / det
    return between(a, b, t) if -EPS <= t <= 1 + EPS and -EPS <= u <= 1 + EPS else None


def segment_segment(a: Point, b: Point, c: Point, d: Point) -> float:
    if crossing(a, b, c, d):
        return 0.0
    return min(point_segment(a, c, d), point_segment(b, c, d), point_segment(c, a, b), point_segment(d, a, b))


def is_simple(ring: Ring) -> bool:
    """No two edges meet but neighbours at their common end."""
    es = edges(ring)
    n = len(es)
    for i in range(n):
        a, b = es[i]
        for j in range(i + 1, n):
            c, d = es[j]
            if j == i + 1 or (i == 0 and j == n - 1):
                joint = b if j == i + 1 else a
                far = d if j == i + 1 else c
                near = a if j == i + 1 else b
                if abs(turn(a, b, far)) <= EPS and (far[0] - joint[0]) * (near[0] - joint[0]) + (far[1] - joint[1]) * (near[1] - joint[1]) > 0:
                    return False
            elif segment_segment(a, b, c, d) <= EPS:
                return False
    return n >= 3


def contains(ring: Ring, p: Point) -> bool:
    inside = False
    for a, b in edges(ring):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            inside = not inside
    return inside


def ring_segment(ring: Ring, a: Point, b: Point) -> float:
    """Distance of a segment from a ring's boundary."""
    return min((segment_segment(p, q, a, b) for p, q in edges(ring)), default=math.inf)


def ring_ring(r: Ring, s: Ring) -> float:
    """Distance of two filled rings."""
    if contains(r, s[0]) or contains(s, r[0]):
        return 0.0
    return min((ring_segment(r, a, b) for a, b in edges(s)), default=math.inf)


def hull(points: Sequence[Point]) -> list[Point]:
    pts = sorted(set(map(tuple, points)))
    if len(pts) < 3:
        return pts

    def half(ps):
        out: list[Point] = []
        for p in ps:
            while len(out) > 1 and turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1])


def tight_box(ring: Ring) -> tuple[float, float]:
    """Longer and shorter side of the least rotated rectangle around a ring."""
    around = hull(ring)
    best = None
    for a, b in edges(around):
        n = dist(a, b)
        ux, uy = (b[0] - a[0]) / n, (b[1] - a[1]) / n
        u = [p[0] * ux + p[1] * uy for p in around]
        v = [p[1] * ux - p[0] * uy for p in around]
        w, h = max(u) - min(u), max(v) - min(v)
        if best is None or w * h < best[0]:
            best = (w * h, max(w, h), min(w, h))
    return best[1:] if best else (0.0, 0.0)


class _Edge:
    __slots__ = ("low", "high", "owner")

    def __init__(self, a: Point, b: Point, owner: int):
        self.low, self.high, self.owner = (a, b, owner) if a[1] < b[1] else (b, a, owner)

    def x(self, y: float) -> float:
        (x0, y0), (x1, y1) = self.low, self.high
        return x0 + (x1 - x0) * (y - y0) / (y1 - y0)


def _slabs(rings: Sequence[Ring]):
    """(y0, y1, edges through the slab in order of x) for each slab."""
    every = [_Edge(a, b, k) for k, r in enumerate(rings) for a, b in edges(r)]
    flat = [e for e in every if e.low[1] != e.high[1]]
    heights = {p[1] for e in every for p in (e.low, e.high)}
    for i, e in enumerate(flat):
        for f in flat[i + 1 :]:
            if e.high[1] > f.low[1] and f.high[1] > e.low[1] and (c := crossing(e.low, e.high, f.low, f.high)):
                heights.add(c[1])
    ys: list[float] = []
    for y in sorted(heights):
        if not ys or y - ys[-1] > 1e-7:
            ys.append(y)
    for y0, y1 in zip(ys, ys[1:]):
        mid = (y0 + y1) / 2
        yield y0, y1, sorted((e for e in flat if e.low[1] < mid < e.high[1]), key=lambda e: e.x(mid))


def overlap_areas(a: Sequence[Ring], b: Sequence[Ring]) -> tuple[float, float]:
    """Areas of intersection and union of two regions, each the union of its rings."""
    both = either = 0.0
    n = len(a)
    for y0, y1, row in _slabs([*a, *b]):
        mid = (y0 + y1) / 2
        odd: set[int] = set()
        last = None
        for e in row:
            x = e.x(mid)
            if last is not None and odd:
                width = (x - last) * (y1 - y0)
                either += width
                if any(k < n for k in odd) and any(k >= n for k in odd):
                    both += width
            odd ^= {e.owner}
            last = x
    return both, either


def iou(a: Sequence[Ring], b: Sequence[Ring]) -> float:
    if not a or not b:
        return 0.0
    both, either = overlap_areas(a, b)
    return both / either if either > 0 else 0.0


class Region:
    """The union of rings: its area, its interior voids, and the outer shell of its largest part."""

    def __init__(self, rings: Sequence[Ring]):
        cells: list[tuple] = []  # row, left edge or None, right edge or None, filled
        rows: list[tuple[float, float, list[int]]] = []
        for y0, y1, row in _slabs(rings):
            mine, odd, left = [], set(), None
            mid = (y0 + y1) / 2
            for k, e in enumerate(row):
                if k == 0 or e.x(mid) - row[k - 1].x(mid) > 1e-7:  # edges in one place change the state together
                    before = bool(odd)
                odd ^= {e.owner}
                if (k + 1 == len(row) or row[k + 1].x(mid) - e.x(mid) > 1e-7) and before != bool(odd):
                    mine.append(len(cells))
                    cells.append((len(rows), left, e, before))
                    left = e
            mine.append(len(cells))
            cells.append((len(rows), left, None, False))
            rows.append((y0, y1, mine))
        self.cells, self.rows = cells, rows
        parent = list(range(len(cells) + 1))
        outside = len(cells)

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def span(k, y):
            _, a, b, _ = cells[k]
            return (a.x(y) if a else -math.inf), (b.x(y) if b else math.inf)

        for r, (y0, y1, mine) in enumerate(rows):
            for k in mine:
                _, a, b, filled = cells[k]
                if not filled and (a is None or b is None or r == 0 and span(k, y0)[1] - span(k, y0)[0] > 1e-6 or r == len(rows) - 1 and span(k, y1)[1] - span(k, y1)[0] > 1e-6):
                    parent[root(k)] = root(outside)
            for k in mine:
                for j in rows[r + 1][2] if r + 1 < len(rows) else ():
                    if cells[k][3] == cells[j][3]:
                        (a, b), (c, d) = span(k, y1), span(j, y1)
                        if min(b, d) - max(a, c) > 1e-6:
                            parent[root(k)] = root(j)
        size: dict[int, float] = {}
        self.area = self.voids = 0.0
        for k, (r, a, b, filled) in enumerate(cells):
            if a is None or b is None:
                continue
            y0, y1, _ = rows[r]
            mid = (y0 + y1) / 2
            own = (b.x(mid) - a.x(mid)) * (y1 - y0)
            if filled:
                self.area += own
                size[root(k)] = size.get(root(k), 0.0) + own
            elif root(k) != root(outside):
                self.voids += own
        self.parts = len(size)
        largest = max(size, key=size.get, default=None)
        main = {k for k in range(len(cells)) if cells[k][3] and root(k) == largest}
        open_ = {k for k in range(len(cells)) if not cells[k][3] and root(k) == root(outside)}
        self.shell = self._shell(main, open_, span)

    def _shell(self, main: set[int], open_: set[int], span) -> list[tuple[Point, Point]]:
        out = []
        for r, (y0, y1, mine) in enumerate(self.rows):
            for at, k in enumerate(mine):
                if k not in main:
                    continue
                _, a, b, _ = self.cells[k]
                out += [((e.x(y0), y0), (e.x(y1), y1)) for e, other in ((a, mine[at - 1]), (b, mine[at + 1])) if other in open_]
                for y, near in ((y0, self.rows[r - 1][2] if r else None), (y1, self.rows[r + 1][2] if r + 1 < len(self.rows) else None)):
                    x0, x1 = span(k, y)
                    pieces = [(x0, x1)] if near is None else [(max(x0, span(j, y)[0]), min(x1, span(j, y)[1])) for j in near if j in open_]
                    out += [((p, y), (q, y)) for p, q in pieces if q - p > 1e-6]
        return out

    def to_shell(self, p: Point) -> float:
        return min((point_segment(p, a, b) for a, b in self.shell), default=math.inf)


def inner_point(ring: Ring) -> Point:
    """A point inside a ring: the middle of its widest slab row."""
    best = (-1.0, tuple(ring[0]))
    for y0, y1, row in _slabs([ring]):
        mid = (y0 + y1) / 2
        for a, b in zip(row[::2], row[1::2]):
            best = max(best, ((b.x(mid) - a.x(mid)) * (y1 - y0), ((a.x(mid) + b.x(mid)) / 2, mid)))
    return best[1]


def faces(segments: Sequence[tuple[Point, Point]], least_area: float = 1.0, snap: float = 1e-6) -> list[list[Point]]:
    """Bounded faces of the network of segments; dangling pieces bound nothing."""
    nodes: list[Point] = []
    grid: dict[tuple[int, int], list[int]] = {}

    def node(p: Point) -> int:
        cell = (math.floor(p[0] / (snap * 4)), math.floor(p[1] / (snap * 4)))
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                for k in grid.get((cell[0] + i, cell[1] + j), ()):
                    if dist(nodes[k], p) <= snap:
                        return k
        nodes.append(p)
        grid.setdefault(cell, []).append(len(nodes) - 1)
        return len(nodes) - 1

    near: dict[int, set[int]] = {}
    for i, (a, b) in enumerate(segments):
        if dist(a, b) <= snap:
            continue
        stops = {0.0, 1.0}
        for j, (c, d) in enumerate(segments):
            if i == j:
                continue
            if p := crossing(a, b, c, d):
                stops.add(foot(p, a, b))
            else:
                stops |= {foot(q, a, b) for q in (c, d) if point_segment(q, a, b) <= snap}
        ks = [node(between(a, b, t)) for t in sorted(stops)]
        for u, v in zip(ks, ks[1:]):
            if u != v:
                near.setdefault(u, set()).add(v)
                near.setdefault(v, set()).add(u)
    loose = [k for k, v in near.items() if len(v) == 1]
    while loose:
        k = loose.pop()
        if len(near[k]) == 1:
            (other,) = near[k]
            near[k].clear()
            near[other].discard(k)
            if len(near[other]) == 1:
                loose.append(other)
    order = {u: sorted(vs, key=lambda v: math.atan2(nodes[v][1] - nodes[u][1], nodes[v][0] - nodes[u][0])) for u, vs in near.items()}
    seen, out = set(), []
    for u in order:
        for v in order[u]:
            if (u, v) in seen:
                continue
            ring, a, b = [], u, v
            while (a, b) not in seen:
                seen.add((a, b))
                ring.append(nodes[a])
                around = order[b]
                a, b = b, around[around.index(a) - 1]  # the next edge clockwise from where we came
            if area(ring) > least_area:
                out.append(ring)
    return out


def covered(a: Point, b: Point, pieces: Sequence[tuple[Point, Point]], reach: float) -> float:
    """Length of segment a-b within `reach` of any piece: each piece's capsule cuts the line in one interval."""
    length = dist(a, b)
    spans = []
    for c, d in pieces:
        if min(c[0], d[0]) - reach > max(a[0], b[0]) or max(c[0], d[0]) + reach < min(a[0], b[0]) or min(c[1], d[1]) - reach > max(a[1], b[1]) or max(c[1], d[1]) + reach < min(a[1], b[1]):
            continue
        near = _least_at(lambda t: point_segment(between(a, b, t), c, d))
        if point_segment(between(a, b, near), c, d) > reach:
            continue
        spans.append((_edge_of(a, b, c, d, reach, near, 0.0), _edge_of(a, b, c, d, reach, near, 1.0)))
    total, upto = 0.0, 0.0
    for lo, hi in sorted(spans):
        if hi > upto:
            total += hi - max(lo, upto)
            upto = hi
    return total * length


def _least_at(f) -> float:
    """Where a convex function on [0, 1] is least, by thirds."""
    lo, hi = 0.0, 1.0
    for _ in range(60):
        p, q = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        if f(p) <= f(q):
            hi = q
        else:
            lo = p
    return (lo + hi) / 2


def _edge_of(a, b, c, d, reach, inside: float, end: float) -> float:
    """Where the distance passes `reach` between a parameter inside and an end, by halves."""
    if point_segment(between(a, b, end), c, d) <= reach:
        return end
    for _ in range(60):
        mid = (inside + end) / 2
        if point_segment(between(a, b, mid), c, d) <= reach:
            inside = mid
        else:
            end = mid
    return inside


def curve(start: Point, end: Point, curvature: float, n: int = 24) -> list[Point]:
    """The polyline of an arc whose signed height over the chord is curvature * chord / 2."""
    chord = dist(start, end)
    if chord < 1e-6 or abs(curvature) < 1e-3:
        return [tuple(start), tuple(end)]
    half = 2 * math.atan(abs(curvature))
    radius, side = chord / (2 * math.sin(half)), math.copysign(1, curvature)
    nx, ny = -(end[1] - start[1]) / chord, (end[0] - start[0]) / chord
    back = radius * math.cos(half) * side
    cx, cy = (start[0] + end[0]) / 2 - back * nx, (start[1] + end[1]) / 2 - back * ny
    first = math.atan2(start[1] - cy, start[0] - cx)
    return [(cx + radius * math.cos(first - side * 2 * half * k / n), cy + radius * math.sin(first - side * 2 * half * k / n)) for k in range(n + 1)]


def centred_arc(centre: Point, radius: float, a0: float, a1: float, step: float = 4.0) -> list[Point]:
    n = max(2, int(abs(a1 - a0) / step) + 1)
    return [(centre[0] + radius * math.cos(math.radians(a0 + (a1 - a0) * k / n)), centre[1] + radius * math.sin(math.radians(a0 + (a1 - a0) * k / n))) for k in range(n + 1)]


def footprint_corners(line: Sequence[Point], thickness: float) -> list[Point]:
    """Corners of a polyline thickened by half its thickness to either side, ends flat."""
    out, h = [], thickness / 2
    for a, b in zip(line, line[1:]):
        n = dist(a, b)
        if n:
            nx, ny = -(b[1] - a[1]) / n * h, (b[0] - a[0]) / n * h
            out += [(p[0] + s * nx, p[1] + s * ny) for p in (a, b) for s in (1, -1)]
    return out


def along_line(line: Sequence[Point], at: float) -> Point:
    """The point at an arc length; beyond the ends the ends, negative lengths count from the end."""
    total = [0.0]
    for a, b in zip(line, line[1:]):
        total.append(total[-1] + dist(a, b))
    at = max(0.0, min(total[-1], at + total[-1] if at < 0 else at))
    k = min(max(bisect_left(total, at), 1), len(line) - 1)
    span = total[k] - total[k - 1]
    return between(line[k - 1], line[k], (at - total[k - 1]) / span if span else 0.0)
