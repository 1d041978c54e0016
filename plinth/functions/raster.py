"""Raster kernels in numpy: class maps, ink, blobs, outlines, thickness, alignment."""

from __future__ import annotations

import numpy as np


def class_map(mask: np.ndarray) -> np.ndarray:
    """Height by width of whole classes, from (H, W), (1, H, W), (H, W, 1) or scores (H, W, K)."""
    mask = np.asarray(mask)
    if mask.ndim == 3:
        mask = mask[0] if mask.shape[0] == 1 else mask[..., 0] if mask.shape[-1] == 1 else mask.argmax(-1)
    return np.rint(mask).astype(np.int32)


def ink(grey: np.ndarray, below: int = 190, reach: int = 2) -> np.ndarray:
    """Dark pixels, widened by a box of `reach`; borders don't wrap."""
    dark = np.asarray(grey) < below
    padded = np.pad(dark.astype(np.int32), reach)
    sums = np.pad(padded.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    k = 2 * reach + 1
    return sums[k:, k:] - sums[:-k, k:] - sums[k:, :-k] + sums[:-k, :-k] > 0


def alignment(lines: list[np.ndarray], mask: np.ndarray, reach: list[int]) -> list[float]:
    """Per line of points, the share with ink within its reach."""
    sums = np.pad(mask.astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h, w = mask.shape
    out = []
    for points, r in zip(lines, reach):
        x, y = (np.rint(points[:, k]).astype(int) for k in (0, 1))
        x0, x1, y0, y1 = np.clip(x - r, 0, w), np.clip(x + r + 1, 0, w), np.clip(y - r, 0, h), np.clip(y + r + 1, 0, h)
        out.append(float((sums[y1, x1] - sums[y0, x1] - sums[y1, x0] + sums[y0, x0] > 0).mean()))
    return out


def wall_reach(thickness: float, factor: float = 1.0) -> int:
    return max(2, round(thickness * factor / 2) + 2)


def labels(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Connected sets of true pixels (8 neighbours), numbered from 1; by runs of rows joined where they touch."""
    h, _ = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    parent = list(range(len(row)))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    first = np.searchsorted(row, np.arange(h + 1))
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if start[i] <= end[j] and start[j] <= end[i]:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    roots = {r: n for n, r in enumerate(sorted({root(k) for k in range(len(row))}), 1)}
    out = np.zeros(mask.shape, np.int32)
    for k in range(len(row)):
        out[row[k], start[k] : end[k]] = roots[root(k)]
    return out, len(roots)


def blobs(mask: np.ndarray, least: int) -> list[tuple[float, float, float]]:
    """Centre and longer extent of each connected set of at least so many pixels."""
    numbered, n = labels(mask)
    out = []
    for k in range(1, n + 1):
        y, x = np.nonzero(numbered == k)
        if len(x) >= least:
            out.append((float(x.mean()), float(y.mean()), float(max(np.ptp(x), np.ptp(y)) + 1)))
    return out


def outlines(mask: np.ndarray, least_area: float) -> list[np.ndarray]:
    """Outer borders of connected sets as rings with few points, those of at least an area."""
    numbered, n = labels(mask)
    out = []
    for k in range(1, n + 1):
        ring = border(numbered == k)
        x, y = ring[:, 0], ring[:, 1]
        if abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2 < least_area:
            continue
        length = np.hypot(*(np.roll(ring, -1, 0) - ring).T).sum()
        ring = simplified(ring, 0.01 * length)
        if len(ring) > 2:
            out.append(ring)
    return out


def border(mask: np.ndarray) -> np.ndarray:
    """The outer border of a connected set along pixel edges, clockwise on screen, corners only."""
    padded = np.pad(mask, 1)
    y, x = (int(v[0]) for v in np.nonzero(padded))
    at, step, ring = (x, y), (1, 0), []
    start = (at, step)
    inside = lambda px, py: bool(padded[py, px])
    while True:
        ahead_right = {(1, 0): (at[0], at[1]), (0, 1): (at[0] - 1, at[1]), (-1, 0): (at[0] - 1, at[1] - 1), (0, -1): (at[0], at[1] - 1)}[step]
        ahead_left = {(1, 0): (at[0], at[1] - 1), (0, 1): (at[0], at[1]), (-1, 0): (at[0] - 1, at[1]), (0, -1): (at[0] - 1, at[1] - 1)}[step]
        turned = None
        if inside(*ahead_left):
            turned = (step[1], -step[0])
        elif not inside(*ahead_right):
            turned = (-step[1], step[0])
        if turned:
            ring.append(at)
            step = turned
            if (at, step) == start:
                break
        at = (at[0] + step[0], at[1] + step[1])
    return np.array(ring, float) - 1


def simplified(ring: np.ndarray, most: float) -> np.ndarray:
    """Ring points that keep the outline within `most` (halving at the farthest point)."""
    far = int(np.argmax(np.hypot(*(ring - ring[0]).T)))
    keep = {0, far}
    todo = [(0, far), (far, len(ring))]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        a, b = ring[i], ring[j % len(ring)]
        chord = b - a
        n = np.hypot(*chord)
        d = ring[i + 1 : j] - a
        off = np.abs(chord[0] * d[:, 1] - chord[1] * d[:, 0]) / n if n else np.hypot(*d.T)
        k = int(np.argmax(off))
        if off[k] > most:
            keep.add(i + 1 + k)
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return ring[sorted(keep)]


def to_background(mask: np.ndarray) -> np.ndarray:
    """Distance of true pixels from the nearest false one: exact squared distances, columns first, then lower envelopes
    of rows by comparison in blocks."""
    h, w = mask.shape
    far = h + w
    down = np.where(mask, far, 0).astype(np.int64)
    for y in range(1, h):
        down[y] = np.minimum(down[y], down[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        down[y] = np.minimum(down[y], down[y + 1] + 1)
    gaps = (np.arange(w)[:, None] - np.arange(w)[None]) ** 2
    return np.sqrt(np.stack([(gaps + (row**2)[None]).min(1) for row in down]))


def thickness(mask: np.ndarray, default: float = 4.0) -> float:
    """Twice the median distance of structure pixels from the background."""
    if not mask.any():
        return default
    d = to_background(mask)
    return float(2 * np.median(d[d > 0]))
