"""Seeded synthetic plans: a table-valued source whose rows pass the rule catalogue.

Every plan depends on (seed, index) alone, so partitioning and order never change a row. A plan is drawn, checked by the
rules, and drawn anew if it fails; the last attempts leave out what fails most. All coordinates lie on a coarse module,
so walls are never shorter than allowed and junctions meet exactly.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions import planar as pl
from plinth.operators import rules

SCHEMA_VERSION = "synthdata-absolute-geometry/1.1"
MODULE, LEAST_SIDE, JAMB = 600, 1800, 150
ATTEMPTS, SAFE_ATTEMPTS, EXTRA_DOORS = 20, 15, 0.22

#: Building types with weight, width and depth ranges in metres, and range of room counts.
BUILDINGS = {
    "residential_apartment": (25, (6, 18), (7, 16), (3, 9)), "residential_house": (15, (8, 16), (9, 18), (5, 13)), "office_open_plan": (10, (15, 45), (12, 35), (3, 8)),
    "office_cellular": (10, (12, 30), (10, 25), (6, 22)), "hotel_floor": (8, (20, 60), (10, 20), (8, 28)), "hospital_ward": (5, (15, 40), (8, 16), (6, 18)),
    "school_classroom_block": (5, (15, 35), (8, 14), (4, 14)), "retail_unit": (5, (8, 25), (10, 30), (2, 8)), "restaurant_cafe": (5, (8, 20), (8, 16), (3, 10)),
    "mixed_use_ground_floor": (5, (10, 30), (10, 25), (3, 9)), "industrial_unit": (4, (20, 60), (15, 40), (2, 6)), "sports_facility": (3, (20, 50), (15, 40), (3, 8)),
}
#: Room types by family of buildings.
ROOM_TYPES = {
    "residential": ("living", "kitchen", "dining", "bedroom", "master_bedroom", "bathroom", "WC", "hallway", "utility", "study", "storage"),
    "office": ("open_plan", "meeting_room", "reception", "corridor", "WC", "server_room", "breakout", "kitchen_staff", "private_office"),
    "hotel": ("guest_room", "corridor", "lift_lobby", "service_room", "linen_cupboard", "bathroom_en_suite"),
    "hospital": ("ward_bay", "nurse_station", "corridor", "single_room", "sluice", "store", "WC", "shower"),
    "school": ("classroom", "corridor", "WC", "staff_room", "store", "reception", "office"),
    "retail": ("sales_floor", "stockroom", "WC", "office", "changing_room", "loading_bay"),
    "restaurant": ("dining_area", "kitchen", "WC", "bar", "store", "office", "cold_room"),
    "mixed": ("retail_unit", "lobby", "corridor", "WC", "plant_room", "bin_store", "cycle_store"),
    "industrial": ("workshop", "warehouse", "office", "WC", "plant_room", "loading_bay"),
    "sports": ("hall", "changing_room", "WC", "shower", "store", "reception", "office", "gym"),
}
SMALL_ROOMS = {"WC", "storage", "store", "linen_cupboard", "sluice", "server_room", "bathroom", "shower", "utility", "cold_room", "plant_room", "bin_store", "cycle_store"}
#: Straight footprints and their weights; numbers of curved walls (range, weight) and the range each curved footprint may have.
FOOTPRINTS = {"rectangle": 30, "L_shape": 18, "T_shape": 8, "U_shape": 7, "irregular_polygon": 12, "rectangle_with_bay": 8}
CURVES = {"none": ((0, 0), 55), "one": ((1, 1), 25), "few": ((2, 3), 15), "many": ((4, 6), 5)}
CURVED = {"rectangle_with_curved_end": (1, 1), "fully_curved_facade": (1, 3), "organic_multi_arc": (2, 6)}
#: Wall materials with thickness range and weight.
EXTERIOR = {"CAVITY_BRICK": ((270, 340), 30), "SOLID_BRICK": ((215, 330), 15), "REINFORCED_CONCRETE": ((200, 400), 25), "TIMBER_STUD": ((89, 140), 12), "METAL_STUD": ((70, 150), 8), "RAMMED_EARTH": ((350, 600), 5), "ICF_INSULATED": ((250, 350), 5)}
INTERIOR = {"CONCRETE_BLOCK": ((100, 215), 35), "TIMBER_STUD": ((89, 140), 35), "METAL_STUD": ((70, 150), 30)}
PARTITIONS = {"GLASS_PARTITION": ((50, 100), 40), "METAL_STUD": ((70, 150), 60)}
WET_WALL, WET_THICKNESS = "WET_WALL_BLOCK", (150, 215)
#: Opening widths in millimetres, and subtypes with weights.
DOOR_WIDTHS, ENTRY_WIDTHS, WINDOW_WIDTHS = (700, 750, 800, 826, 900), (900, 1000, 1050), (600, 900, 1200, 1500, 1800, 2400)
DOOR_KINDS = {"SINGLE_HINGED": 48, "DOUBLE_HINGED": 10, "SLIDING": 14, "POCKET": 11, "BIFOLD": 8, "FRENCH": 5}
WINDOW_KINDS = {"CASEMENT": 28, "FIXED": 24, "SLIDING": 14, "BAY": 9, "AWNING": 8, "CLERESTORY": 5, "LOUVRE": 3, "CORNER": 2}

#: Weights of how much a sheet is cluttered and how far it is turned (range in degrees).
CLUTTER = {"none": 15, "light": 30, "medium": 30, "heavy": 25}
ROTATIONS = {"zero": ((0, 0), 50), "small": ((1, 5), 20), "medium": ((5, 45), 20), "large": ((45, 89), 10)}

Cell = tuple[int, int, int, int]


def pick(rng: random.Random, weights: dict):
    """A key by weight."""
    return rng.choices(list(weights), [w if isinstance(w, (int, float)) else w[-1] for w in weights.values()])[0]


def identity(index: int, seed: int) -> dict:
    """What is fixed for an index however often it is drawn."""
    rng = random.Random(f"{seed}:{index}:identity")
    kind = pick(rng, {k: v[0] for k, v in BUILDINGS.items()})
    _, wide, deep, rooms = BUILDINGS[kind]
    size = [max(2 * LEAST_SIDE, round(rng.uniform(*r) * 1000 / MODULE) * MODULE) for r in (wide, deep)]
    if max(size) <= 8000:
        size[0] = 14 * MODULE  # plans of several rooms have a wall over 8 m
    room_limit = max(2, size[0] * size[1] // (LEAST_SIDE * 2 * LEAST_SIDE))
    arcs = rng.randint(*CURVES[pick(rng, CURVES)][0])
    shape = rng.choice([k for k, (low, high) in CURVED.items() if low <= arcs <= high]) if arcs else pick(rng, FOOTPRINTS)
    return {"kind": kind, "size": size, "rooms": min(rng.randint(*rooms), room_limit), "shape": shape, "arcs": arcs, "clutter": pick(rng, CLUTTER), "rotation": round(rng.uniform(*ROTATIONS[pick(rng, ROTATIONS)][0]), 2)}


def footprint(shape: str, w: int, h: int, rng: random.Random) -> list[Cell]:
    """Rectangles that make up a footprint."""
    on = lambda n, lo, hi: round(n * rng.uniform(lo, hi) / MODULE) * MODULE
    x, y = on(w, 0.4, 0.6), on(h, 0.4, 0.6)
    if min(x, y, w - x, h - y) < 2 * LEAST_SIDE or shape not in ("L_shape", "T_shape", "U_shape"):
        return [(0, 0, w, h)]
    if shape == "L_shape":
        return [(0, 0, w, y), (0, y, x, h)]
    a = on(w, 0.25, 0.35)
    if min(a, w - 2 * a) < LEAST_SIDE:
        return [(0, 0, w, y), (0, y, x, h)]
    return [(0, 0, w, y), (a, y, w - a, h)] if shape == "T_shape" else [(0, 0, w, y), (0, y, a, h), (w - a, y, w, h)]


def split(cells: list[Cell], target: int, rng: random.Random) -> list[Cell]:
    """Halve the largest cell, across its longer side, until there are enough or nothing can be halved."""
    done: list[Cell] = []
    cells = list(cells)
    while cells and len(cells) + len(done) < target:
        cells.sort(key=lambda c: (c[2] - c[0]) * (c[3] - c[1]))
        x0, y0, x1, y1 = cells.pop()
        across = 0 if x1 - x0 >= y1 - y0 else 1
        lo, hi = ((x0, x1), (y0, y1))[across]
        if hi - lo < 2 * LEAST_SIDE:
            done.append((x0, y0, x1, y1))
            continue
        at = lo + round(rng.uniform(0.35, 0.65) * (hi - lo) / MODULE) * MODULE
        at = min(max(at, lo + LEAST_SIDE), hi - LEAST_SIDE)
        cells += [(x0, y0, at, y1), (at, y0, x1, y1)] if across == 0 else [(x0, y0, x1, at), (x0, at, x1, y1)]
    return cells + done


def outline(cells: Sequence[Cell]) -> list[list[int]] | None:
    """Outer ring of one or two adjoining rectangles, without collinear points."""
    xs, ys = sorted({c[k] for c in cells for k in (0, 2)}), sorted({c[k] for c in cells for k in (1, 3)})
    inside = lambda x, y: any(c[0] < x < c[2] and c[1] < y < c[3] for c in cells)
    nxt = {}
    for x0, x1 in zip(xs, xs[1:]):
        for y0, y1 in zip(ys, ys[1:]):
            if inside((x0 + x1) / 2, (y0 + y1) / 2):
                for a, b, probe in (((x0, y0), (x1, y0), (0, -1)), ((x1, y0), (x1, y1), (1, 0)), ((x1, y1), (x0, y1), (0, 1)), ((x0, y1), (x0, y0), (-1, 0))):
                    mx, my = (a[0] + b[0]) / 2 + probe[0], (a[1] + b[1]) / 2 + probe[1]
                    if not inside(mx, my):
                        if a in nxt:
                            return None
                        nxt[a] = b
    start = at = min(nxt)
    ring = []
    while True:
        ring.append(at)
        at = nxt[at]
        if at == start:
            break
    if len(ring) != len(nxt):
        return None
    return [list(q) for p, q, r in zip([ring[-1], *ring], ring, [*ring[1:], ring[0]]) if pl.turn(p, q, r)]


class Tiling:
    """Rooms as lists of cells, and the lines between them cut into pieces at every room corner."""

    def __init__(self, rooms: list[list[Cell]]):
        self.rings = [outline(r) for r in rooms]
        self.diagonals: list[tuple[list[int], list[int]]] = []
        cut: dict[tuple[int, int], set[int]] = {}
        sides: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
        for k, ring in enumerate(self.rings):
            for a, b in pl.edges(ring):
                axis = 0 if a[1] == b[1] else 1  # 0: along x
                lo, hi = sorted((a[axis], b[axis]))
                sides.setdefault((axis, a[1 - axis]), []).append((lo, hi, k, 1 if (a[axis] < b[axis]) else -1))
            for p in ring:
                for axis in (0, 1):
                    cut.setdefault((axis, p[1 - axis]), set()).add(p[axis])
        self.pieces: list[tuple[int, int, int, int, tuple[int, ...]]] = []  # axis, line, from, to, rooms on its sides
        for (axis, line), spans in sorted(sides.items()):
            stops = sorted(cut[axis, line])
            for lo, hi in zip(stops, stops[1:]):
                rooms_here = tuple(k for a, b, k, _ in spans if a <= lo and b >= hi)
                if rooms_here:
                    self.pieces.append((axis, line, lo, hi, rooms_here))

    def clip(self, corner: tuple[int, int], rng: random.Random) -> None:
        """Cut an outer corner off by a diagonal, if its room is a rectangle with enough outer wall on both sides."""
        here = [(k, p) for k, p in enumerate(self.pieces) if len(p[4]) == 1 and p[1] == corner[1 - p[0]] and corner[p[0]] in p[2:4]]
        owner = {p[4] for _, p in here}
        if len(here) != 2 or len(owner) != 1 or len(self.rings[here[0][1][4][0]]) != 4:
            return
        ring = self.rings[here[0][1][4][0]]
        if any(p[3] - p[2] < MODULE + LEAST_SIDE for _, p in here):
            return
        ends = {}
        for k, (axis, line, lo, hi, rooms) in here:
            cut = rng.randrange(MODULE, min(6 * MODULE, hi - lo - LEAST_SIDE) + 1, MODULE // 2)
            lo, hi = (lo + cut, hi) if lo == corner[axis] else (lo, hi - cut)
            self.pieces[k] = (axis, line, lo, hi, rooms)
            ends[axis] = at(axis, line, lo if abs(lo - corner[axis]) == cut else hi)
        self.diagonals.append((ends[0], ends[1]))
        i = ring.index(list(corner))
        before = 0 if ring[i - 1][1] == corner[1] else 1  # the axis of the edge that leads to the corner
        ring[i : i + 1] = [ends[before], ends[1 - before]]

    def walls(self) -> list[tuple[int, int, int, int, bool]]:
        """Runs of pieces: axis, line, from, to, exterior; a run along x stops where a wall goes through it."""
        ends: dict[tuple[int, int], int] = {}
        for axis, line, lo, hi, _ in self.pieces:
            if axis == 1:
                for y, way in ((lo, 1), (hi, 2)):
                    ends[line, y] = ends.get((line, y), 0) | way
        out = []
        for axis, line, lo, hi, rooms in self.pieces:
            outer = len(rooms) == 1
            last = out[-1] if out else None
            through = axis == 0 and ends.get((lo, line), 0) == 3
            if last and last[:2] == (axis, line) and last[3] == lo and last[4] == outer and not through:
                out[-1] = (axis, line, last[2], hi, outer)
            else:
                out.append((axis, line, lo, hi, outer))
        return out


def at(axis: int, line: float, along: float) -> list[int]:
    return [round(along), round(line)] if axis == 0 else [round(line), round(along)]


def draw(index: int, seed: int, attempt: int, safe: bool) -> dict | None:
    fixed = identity(index, seed)
    rng = random.Random(f"{seed}:{index}:{attempt}:{safe}")
    (w, h), shape = fixed["size"], "rectangle" if safe else fixed["shape"]
    cells = split(footprint(shape, w, h, rng), fixed["rooms"] + 1, rng)
    rooms = [[c] for c in cells]
    rng.shuffle(rooms)
    for i in range(len(rooms)):  # one room of two cells, so that not all are rectangles
        pair = next((j for j in range(len(rooms)) if j != i and (r := outline(rooms[i] + rooms[j])) and len(r) > 4), None)
        if pair is not None:
            rooms[i] += rooms.pop(pair)
            break
    tiling = Tiling(rooms)
    if any(r is None for r in tiling.rings):
        return None
    if shape == "irregular_polygon":
        for corner in rng.sample([(0, 0), (w, 0), (w, h), (0, h)], rng.randint(1, 2)):
            tiling.clip(corner, rng)
    types = _types(fixed["kind"], tiling.rings, rng)
    inner_kinds = PARTITIONS if fixed["kind"].startswith("office") else INTERIOR
    ext, inner = pick(rng, EXTERIOR), pick(rng, inner_kinds)
    wall_rows, thick = [], {True: rng.randrange(*EXTERIOR[ext][0]), False: rng.randrange(*inner_kinds[inner][0])}
    wet = rng.choice([t for t in range(*WET_THICKNESS, 5) if t not in thick.values()])
    for k, (axis, line, lo, hi, outer) in enumerate(tiling.walls(), 1):
        wall = (ext, thick[True]) if outer else (inner, thick[False]) if k % 3 else (WET_WALL, wet)
        wall_rows.append(_wall(k, at(axis, line, lo), at(axis, line, hi), outer, *wall))
    wall_rows += [_wall(k, a, b, True, ext, thick[True]) for k, (a, b) in enumerate(tiling.diagonals, len(wall_rows) + 1)]
    if len({x["thickness_mm"] for x in wall_rows}) < 3:
        inside = [x for x in wall_rows if x["type"] == "interior"]
        if not inside:
            return None
        inside[0]["thickness_mm"] = wet
    openings, used = [], set()
    if not _doors(tiling, rng, openings, used) or not _entrance(tiling, rng, openings, used):
        return None
    if not safe:
        _bend(wall_rows, tiling, openings, used, fixed["arcs"], rng)
    _windows(tiling, rng, openings, used)
    if shape == "rectangle_with_bay":
        max((o for o in openings if o["category"] == "window"), key=lambda o: o["width_mm"], default={})["subtype"] = "BAY"
    named = [{"id": f"R{k}", "name": t.replace("_", " ").title(), "room_type": t, "shape": _shape(ring), "polygon": ring} for k, (t, ring) in enumerate(zip(types, tiling.rings), 1)]
    plan = {"id": f"plan_{index:05d}", "group": "synthetic", "name": fixed["kind"], "description": f"{len(named)} rooms, {shape}", "units": "mm", "origin": [0, 0], "walls": wall_rows, "rooms": named, "openings": openings, "decoys": _decoys(tiling.rings, rng)}
    turn = 0 if safe else fixed["rotation"]
    if turn:
        rotate(plan, turn)
    if any(x["arc"] for x in wall_rows):
        _unblock(plan)
    return finish(_cluttered(plan, fixed["clutter"], rng), shape, turn)


def _wall(k: int, a: list[int], b: list[int], outer: bool, material: str, thickness: int) -> dict:
    """A straight wall with its band."""
    length = pl.dist(a, b)
    ox, oy = (a[1] - b[1]) / length * thickness / 2, (b[0] - a[0]) / length * thickness / 2
    band = [[round(p[0] + s * ox), round(p[1] + s * oy)] for p, s in ((a, -1), (b, -1), (b, 1), (a, 1))]
    return {"id": f"W{k}", "type": "exterior" if outer else "interior", "thickness_mm": thickness, "length_mm": round(length), "centerline": [a, b], "polygon": band, "arc": None, "material": material, "angle_class": "orthogonal" if 0 in (ox, oy) else "diagonal"}


def _unblock(plan: dict) -> None:
    """Windows that a wall runs through go."""
    blocked = {subject for subject, _ in rules.RULES["S10"](rules.Plan(plan))}
    plan["openings"] = [o for o in plan["openings"] if o["category"] != "window" or o["id"] not in blocked]


def _types(kind: str, rings: list, rng: random.Random) -> list[str]:
    """Room types: the smallest quarter small ones, the first over 12 square metres a master bedroom in homes."""
    pool = next(v for k, v in ROOM_TYPES.items() if kind.startswith(k))
    small, large = [t for t in pool if t in SMALL_ROOMS], [t for t in pool if t not in SMALL_ROOMS]
    by_area = sorted(range(len(rings)), key=lambda k: abs(pl.area(rings[k])))
    out = [rng.choice(large) for _ in rings]
    for k in by_area[: max(1, len(rings) // 4)]:
        out[k] = rng.choice(small)
    if "master_bedroom" in pool:
        big = next((k for k in by_area[max(1, len(rings) // 4) :] if abs(pl.area(rings[k])) > 12e6), None)
        out = ["bedroom" if t == "master_bedroom" and k != big else t for k, t in enumerate(out)]
        if big is not None:
            out[big] = "master_bedroom"
    return out


def _shape(ring: list) -> str:
    return {4: "rectangle", 6: "l_shape", 8: "t_or_u_shape"}.get(len(ring), "polygon")


def _opening(openings: list, category: str, subtype: str, width: int, axis: int, line: int, lo: int, hi: int, rng: random.Random) -> None:
    start = rng.randrange(lo + JAMB, hi - JAMB - width + 1, 1)
    p, q = at(axis, line, start), at(axis, line, start + width)
    letter = {"door": "D", "window": "W", "opening": "O"}[category]
    n = 1 + sum(o["category"] == category for o in openings)
    openings.append({"id": f"{letter}{n}", "category": category, "subtype": subtype, "width_mm": width, "p1": p, "p2": q, "center": [round((a + b) / 2) for a, b in zip(p, q)], "angle_deg": 0.0 if axis == 0 else 90.0, "height_mm": 2100 if category == "door" else 1200, "sill_mm": 0 if category == "door" else 900, "hinge": rng.choice(["left", "right"])})


def _fitting(widths: Sequence[int], room: int) -> int | None:
    return max((w for w in widths if w <= room), default=None)


def _doors(tiling: Tiling, rng: random.Random, openings: list, used: set) -> bool:
    """A door for every edge of a random spanning tree over rooms that share enough wall, and some more."""
    between: dict[tuple[int, int], list[int]] = {}
    for k, (_, _, lo, hi, rooms) in enumerate(tiling.pieces):
        if len(rooms) == 2 and _fitting(DOOR_WIDTHS, hi - lo - 2 * JAMB):
            between.setdefault(tuple(sorted(rooms)), []).append(k)
    pairs = sorted(between)
    rng.shuffle(pairs)
    part = list(range(len(tiling.rings)))
    for a, b in pairs:
        if part[a] != part[b] or rng.random() < EXTRA_DOORS:
            k = rng.choice(between[a, b])
            axis, line, lo, hi, _ = tiling.pieces[k]
            if k not in used:
                used.add(k)
                _opening(openings, "door", pick(rng, DOOR_KINDS), _fitting([w for w in DOOR_WIDTHS if w <= rng.choice(DOOR_WIDTHS)], hi - lo - 2 * JAMB), axis, line, lo, hi, rng)
                part = [part[a] if p == part[b] else p for p in part]
    return len(set(part)) == 1


def _entrance(tiling: Tiling, rng: random.Random, openings: list, used: set) -> bool:
    outer = [k for k, (_, _, lo, hi, rooms) in enumerate(tiling.pieces) if len(rooms) == 1 and _fitting(ENTRY_WIDTHS, hi - lo - 2 * JAMB)]
    if outer:
        k = rng.choice(outer)
        axis, line, lo, hi, _ = tiling.pieces[k]
        used.add(k)
        _opening(openings, "door", "SINGLE_HINGED", _fitting(ENTRY_WIDTHS, hi - lo - 2 * JAMB), axis, line, lo, hi, rng)
    return bool(outer)


def _windows(tiling: Tiling, rng: random.Random, openings: list, used: set) -> None:
    for k, (axis, line, lo, hi, rooms) in enumerate(tiling.pieces):
        width = _fitting([w for w in WINDOW_WIDTHS if w <= rng.choice(WINDOW_WIDTHS)], hi - lo - 2 * JAMB)
        if len(rooms) == 1 and k not in used and width and rng.random() < 0.8:
            _opening(openings, "window", pick(rng, WINDOW_KINDS), width, axis, line, lo, hi, rng)


def _bend(walls: list, tiling: Tiling, openings: list, used: set, count: int, rng: random.Random) -> None:
    """Outer walls without a door, as many as asked, become arcs over their chords; they get no window. Are there too few,
    the longest are cut where inner walls meet them."""
    hosts = rules.Plan({"walls": walls, "rooms": [], "openings": openings}).hosts if count else []
    free = [w for k, w in enumerate(walls) if w["type"] == "exterior" and k not in hosts and w["angle_class"] == "orthogonal"]
    while 0 < len(free) < count and (cut := _cut(max(free, key=lambda w: w["length_mm"]), tiling, len(walls) + 1)):
        old, one, two = cut
        walls[walls.index(old)] = one
        walls.append(two)
        free[free.index(old)] = one
        free.append(two)
    for w in rng.sample(free, min(count, len(free))):
        _arc(w, tiling, used, rng)


def _cut(wall: dict, tiling: Tiling, k: int) -> tuple[dict, dict, dict] | None:
    """The wall, and its two parts at the junction next to its middle."""
    a, b = wall["centerline"]
    axis = 0 if a[1] == b[1] else 1
    middle = (a[axis] + b[axis]) / 2
    stops = [hi for x, line, _, hi, _ in tiling.pieces if x == axis and line == a[1 - axis] and a[axis] < hi < b[axis]]
    if not stops:
        return None
    stop = at(axis, a[1 - axis], min(stops, key=lambda v: (abs(v - middle), v)))
    own = (True, wall["material"], wall["thickness_mm"])
    return wall, _wall(int(wall["id"][1:]), a, stop, *own), _wall(k, stop, b, *own)


def _arc(w: dict, tiling: Tiling, used: set, rng: random.Random) -> None:
    """Bend a wall outwards."""
    a, b = w["centerline"]
    chord = w["length_mm"]
    nx, ny = -(b[1] - a[1]) / chord, (b[0] - a[0]) / chord
    mid = ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2)
    if not any(pl.contains(r, (mid[0] + 10 * nx, mid[1] + 10 * ny)) for r in tiling.rings):
        nx, ny = -nx, -ny
    radius = round(chord * rng.uniform(0.8, 1.5))
    rise = math.sqrt(radius * radius - chord * chord / 4)
    centre = [round(mid[0] + nx * rise), round(mid[1] + ny * rise)]  # on the inner side
    a0, a1 = (math.degrees(math.atan2(p[1] - centre[1], p[0] - centre[0])) for p in (a, b))
    a1 = a0 + (a1 - a0 + 180) % 360 - 180
    w |= {"arc": {"center": centre, "radius": radius, "a0": round(a0, 2), "a1": round(a1, 2)}, "angle_class": "curved"}
    axis = 0 if a[1] == b[1] else 1
    used |= {k for k, (x, line, lo, hi, _) in enumerate(tiling.pieces) if x == axis and line == a[1 - axis] and min(a[axis], b[axis]) <= lo and hi <= max(a[axis], b[axis])}


def _decoys(rings: list, rng: random.Random) -> list[dict]:
    out = []
    for k, ring in enumerate(rings):
        if abs(pl.area(ring)) > 20e6 and rng.random() < 0.3:
            x, y = (round(v) for v in pl.inner_point(ring))
            out.append({"kind": "column", "geometry": {"center": [x, y], "size": rng.choice([300, 400, 500])}})
        elif rng.random() < 0.2:
            x, y = (round(v) for v in pl.inner_point(ring))
            out.append({"kind": "furniture", "geometry": {"bbox": [x - 400, y - 300, x + 400, y + 300], "room": k}})
    return out


def _cluttered(plan: dict, level: str, rng: random.Random) -> dict:
    """The plan with marks of a drawing sheet among its decoys; none is part of the building."""
    ends = [p for w in plan["walls"] for p in w["centerline"]]
    (x0, x1), (y0, y1) = ((min(v), max(v)) for v in zip(*ends))
    somewhere = lambda: [rng.randint(x0, x1), rng.randint(y0, y1)]
    add = lambda kind, **geometry: plan["decoys"].append({"kind": kind, "geometry": geometry})
    if level != "none":
        y = y0 - rng.randint(400, 900)
        add("dimension_chain", line=[[x0, y], [x1, y]], tier=1, ticks=sorted({x for w in plan["walls"] for x, _ in w["centerline"]}))
    if level in ("medium", "heavy"):
        x = x0 - rng.randint(400, 900)
        add("dimension_chain", line=[[x, y0], [x, y1]], tier=1, ticks=sorted({y for w in plan["walls"] for _, y in w["centerline"]}))
        for _ in range(rng.randint(1, 4)):
            x, y = somewhere()
            add("keynote", bubble=[x, y, 250], leader_to=[x + 300, y + 300], text=f"K{rng.randint(1, 30):02d}")
    if level == "heavy":
        add("sheet_border", rect=[x0 - 1500, y0 - 3000, x1 + 1500, y1 + 1500])
        add("title_block", rect=[x1 - 4000, y0 - 2600, x1, y0 - 200])
        for _ in range(rng.randint(1, 3)):
            x, y = somewhere()
            add("revision_cloud", around=[x, y, x + 1400, y + 1000], style="scalloped", rev=f"P{rng.randint(1, 4)}")
        for _ in range(rng.randint(2, 6)):
            x, y = somewhere()
            add("noise_line", line=[[x, y], [x + rng.randint(-200, 200), y + rng.randint(-200, 200)]])
        a, b = rng.choice(plan["walls"])["centerline"]
        off = rng.randint(2, 4)
        add("xref_ghost", line=[[v + off for v in a], [v + off for v in b]], note="wall drawn twice")
    plan["clutter"] = level
    return plan


def rotate(plan: dict, degrees: float) -> None:
    """Turn all geometry about the origin, in whole millimetres; lengths and widths follow."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    turn = lambda p: [round(p[0] * c - p[1] * s), round(p[0] * s + p[1] * c)]
    for w in plan["walls"]:
        w["centerline"], w["polygon"] = [turn(p) for p in w["centerline"]], [turn(p) for p in w["polygon"]]
        if w["arc"]:
            w["arc"] |= {"center": turn(w["arc"]["center"]), "a0": round(w["arc"]["a0"] + degrees, 2), "a1": round(w["arc"]["a1"] + degrees, 2)}
        w["length_mm"] = round(pl.dist(*w["centerline"]))
        w["angle_class"] = w["angle_class"] if degrees % 90 == 0 or w["arc"] else "oblique"
    for r in plan["rooms"]:
        r["polygon"] = [turn(p) for p in r["polygon"]]
    for o in plan["openings"]:
        o["p1"], o["p2"] = turn(o["p1"]), turn(o["p2"])
        o["center"] = [round((a + b) / 2) for a, b in zip(o["p1"], o["p2"])]
        o["width_mm"], o["angle_deg"] = round(pl.dist(o["p1"], o["p2"])), round((o["angle_deg"] + degrees) % 180, 2)
    for d in plan["decoys"]:
        if "center" in d["geometry"]:
            d["geometry"]["center"] = turn(d["geometry"]["center"])
        else:
            x0, y0, x1, y1 = d["geometry"]["bbox"]
            xs, ys = zip(*(turn(p) for p in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))))
            d["geometry"]["bbox"] = [min(xs), min(ys), max(xs), max(ys)]


def finish(plan: dict, shape: str, turned: float) -> dict:
    """Derived fields: bounding box, footprint, counts, render hints, metadata."""
    pts = [p for w in plan["walls"] for p in (*w["centerline"], *w["polygon"])] + [p for r in plan["rooms"] for p in r["polygon"]]
    box = [min(p[0] for p in pts), min(p[1] for p in pts), max(p[0] for p in pts), max(p[1] for p in pts)]
    kinds = [o["category"] for o in plan["openings"]]
    n = len(plan["rooms"])
    return plan | {
        "bbox": box,
        "footprint": {"w": box[2] - box[0], "h": box[3] - box[1]},
        "counts": {"walls": len(plan["walls"]), "rooms": n, "openings": len(kinds), "doors": kinds.count("door"), "windows": kinds.count("window"), "decoys": len(plan["decoys"])},
        "render": {"dpi": 150, "rotation_deg": turned, "scale": "1:100"},
        "metadata": {"schema": SCHEMA_VERSION, "footprint_shape": shape, "complexity": "simple" if n < 5 else "medium" if n < 12 else "complex", "curved": any(w["arc"] for w in plan["walls"]), "arcs": sum(1 for w in plan["walls"] if w["arc"]), "clutter": plan.pop("clutter", "none")},
    }


def one(index: int, seed: int = 0) -> tuple[dict, int, bool]:
    """A valid plan, the attempts it took, and whether the safe form was needed."""
    for attempt in range(ATTEMPTS + SAFE_ATTEMPTS):
        safe = attempt >= ATTEMPTS
        plan = draw(index, seed, attempt, safe)
        if plan and not rules.violations(plan) and (safe or not rules.quick_faults(plan)):
            return plan, attempt + 1, safe
    raise RuntimeError(f"no valid plan for index {index} in {ATTEMPTS + SAFE_ATTEMPTS} attempts")


def plans(spark: SparkSession, count: int, seed: int = 0, start: int = 0, partitions: int | None = None) -> DataFrame:
    """plan_id, config (JSON), attempts, fell_back for indices start to start + count."""
    schema = pa.schema([("plan_id", pa.string()), ("config", pa.string()), ("attempts", pa.int32()), ("fell_back", pa.bool_())])

    def run(batches):
        for batch in batches:
            rows = []
            for index in batch.column(0).to_pylist():
                plan, attempts, safe = one(index, seed)
                rows.append({"plan_id": plan["id"], "config": json.dumps(plan, separators=(",", ":")), "attempts": attempts, "fell_back": safe})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.range(start, start + count, 1, partitions or spark.sparkContext.defaultParallelism).mapInArrow(run, "plan_id string, config string, attempts int, fell_back boolean")


class PlanGenerator:
    """Table function: SELECT * FROM generate_plans(start, count, seed)."""

    def eval(self, start: int, count: int, seed: int) -> Iterator[tuple]:
        for index in range(start, start + count):
            plan, attempts, _ = one(index, seed)
            yield plan["id"], json.dumps(plan, separators=(",", ":")), attempts


def register(spark: SparkSession) -> None:
    from pyspark.sql.functions import udtf

    spark.udtf.register("generate_plans", udtf(PlanGenerator, returnType="plan_id string, config string, attempts int"))


def tally(generated: DataFrame) -> DataFrame:
    """Distribution report: counts by dimension and value, in one pass over exploded dimensions."""
    get = lambda p: F.get_json_object("config", p)
    kinds = F.from_json(get("$.openings"), "array<struct<category:string,subtype:string>>")
    dims = F.array(
        F.struct(F.lit("building").alias("dimension"), get("$.name").alias("value")),
        F.struct(F.lit("footprint").alias("dimension"), get("$.metadata.footprint_shape").alias("value")),
        F.struct(F.lit("complexity").alias("dimension"), get("$.metadata.complexity").alias("value")),
        F.struct(F.lit("curved").alias("dimension"), get("$.metadata.curved").alias("value")),
        F.struct(F.lit("arcs").alias("dimension"), get("$.metadata.arcs").alias("value")),
        F.struct(F.lit("clutter").alias("dimension"), get("$.metadata.clutter").alias("value")),
        F.struct(F.lit("fell_back").alias("dimension"), F.col("fell_back").cast("string").alias("value")),
    )
    subtypes = F.transform(kinds, lambda o: F.struct(o["category"].alias("dimension"), o["subtype"].alias("value")))
    return generated.select(F.explode(F.concat(dims, subtypes)).alias("d")).groupBy("d.dimension", "d.value").agg(F.count(F.lit(1)).alias("n"))
