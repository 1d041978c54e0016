"""The rule catalogue over plan configurations: 22 topological, semantic and consistency rules.

A plan is one JSON string. Its geometry is derived once and every rule looks at it; rules of one plan never need another
plan, so an audit is a map over rows without a shuffle. Histograms and percentages are ordinary aggregations on top.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions import planar as pl

#: Tolerances in millimetres and square millimetres, and bounds.
POINT_TOL, COVER_TOL, RESIDUAL_TOL, ON_WALL_TOL = 6.0, 30.0, 80.0, 40.0
INCIDENT_TOL, EXTERIOR_TOL, JAMB_TOL, AREA_TOL = 45.0, 60.0, 30.0, 2.0e4
MIN_ROOM_AREA, MAX_ASPECT, MIN_SIDE, MIN_WALL = 2.0e6, 16.0, 450.0, 300
THICKNESS, DOOR_WIDTH = (40, 600), (550, 6000)
#: Subtypes an opening may have.
DOOR_SUBTYPES = {"SINGLE_HINGED", "DOUBLE_HINGED", "SLIDING", "POCKET", "BIFOLD", "GARAGE", "FRENCH"}
WINDOW_SUBTYPES = {"CASEMENT", "SLIDING", "FIXED", "BAY", "AWNING", "LOUVRE", "CORNER", "CLERESTORY"}
OPENING_SUBTYPES = {"CASED", "GAP"}
ACCESS = ("door", "opening")
#: Keys that must be present, by level.
REQUIRED = {
    "plan": ("id", "group", "name", "units", "origin", "bbox", "footprint", "counts", "walls", "rooms", "openings", "render", "metadata"),
    "wall": ("id", "type", "thickness_mm", "length_mm", "centerline", "polygon", "arc"),
    "room": ("id", "polygon", "room_type"),
    "opening": ("id", "category", "p1", "p2", "center", "width_mm"),
}

Finding = tuple[str | None, str]


class Plan:
    """A configuration with what the rules derive from it."""

    def __init__(self, config: dict):
        self.config = config
        self.walls, self.rooms, self.openings = (config.get(k) or [] for k in ("walls", "rooms", "openings"))

    @cached_property
    def chords(self) -> list[tuple | None]:
        out = []
        for w in self.walls:
            line = w.get("centerline") or []
            out.append((tuple(line[0]), tuple(line[1])) if len(line) > 1 and pl.dist(line[0], line[1]) > 1e-6 else None)
        return out

    @cached_property
    def lines(self) -> list[list[list]]:
        """Per wall its centre lines as point lists: the chord, and the arc where there is one."""
        out = []
        for w, chord in zip(self.walls, self.chords):
            own = [list(chord)] if chord else []
            arc = w.get("arc")
            if arc and all(k in arc for k in ("center", "radius", "a0", "a1")) and float(arc["radius"]) > 0:
                own.append(pl.centred_arc(arc["center"], float(arc["radius"]), float(arc["a0"]), float(arc["a1"])))
            out.append(own)
        return out

    @cached_property
    def rings(self) -> list[list | None]:
        """Room polygons with at least three points and some area."""
        return [r["polygon"] if len(r.get("polygon") or ()) > 2 and abs(pl.area(r["polygon"])) > 0 else None for r in self.rooms]

    @cached_property
    def region(self) -> pl.Region:
        return pl.Region([r for r in self.rings if r])

    @cached_property
    def hosts(self) -> list[int | None]:
        """Host wall of each opening: both ends within tolerance of one line of it; the nearest, the last of equals."""
        out = []
        for o in self.openings:
            p, q = o.get("p1"), o.get("p2")
            if not (p and q):
                p = q = o.get("center")
            near = [(max(to_line(p, ln), to_line(q, ln)), -k) for k, own in enumerate(self.lines) for ln in own] if p else []
            d, k = min(near, default=(math.inf, 0))
            out.append(-k if d <= ON_WALL_TOL else None)
        return out

    @cached_property
    def beside(self) -> list[list[int]]:
        """Rooms whose boundary an opening touches, nearest first."""
        out = []
        for o in self.openings:
            p, q = o.get("p1"), o.get("p2")
            if not (p and q and p != q):
                p = q = o.get("center")
            near = sorted((pl.ring_segment(r, tuple(p), tuple(q)), k) for k, r in enumerate(self.rings) if r) if p else []
            out.append([k for d, k in near if d <= INCIDENT_TOL])
        return out

    def joined(self, o: int) -> list[int]:
        """The two rooms an inner opening joins: the nearest on either side of its wall."""
        rooms, host, centre = self.beside[o], self.hosts[o], self.openings[o].get("center")
        if host is None or len(rooms) < 3 or not self.chords[host] or not centre:
            return rooms[:2]
        a, b = self.chords[host]
        side = lambda k: pl.turn((0, 0), (b[0] - a[0], b[1] - a[1]), tuple(x - c for x, c in zip(pl.inner_point(self.rings[k]), centre))) >= 0
        two = [next((k for k in rooms if side(k) is s), None) for s in (True, False)]
        return [k for k in two if k is not None]

    def on_shell(self, o: dict) -> bool:
        return bool(o.get("center")) and self.region.to_shell(tuple(o["center"])) <= EXTERIOR_TOL

    @cached_property
    def access(self) -> tuple[list[tuple], dict[int, list], bool]:
        """Edges between rooms and the outside (None) through doors and openings, doors by room, and whether one leads out."""
        links, doors, entrance = [], defaultdict(list), False
        for k, o in enumerate(self.openings):
            if o.get("category") not in ACCESS:
                continue
            host = self.hosts[k]
            outer = self.walls[host].get("type") == "exterior" if host is not None else self.on_shell(o)
            rooms = self.beside[k][:1] if outer else self.joined(k)
            entrance |= outer
            for r in rooms:
                doors[r].append(o.get("id"))
            if outer and rooms:
                links.append((rooms[0], None))
            elif len(rooms) == 2:
                links.append((rooms[0], rooms[1]))
        return links, doors, entrance

    def span(self, o: int) -> tuple[float, float] | None:
        """Where an opening lies along its host wall (of a curved one, the nearer line)."""
        host, opening = self.hosts[o], self.openings[o]
        if host is None or not self.lines[host] or not (opening.get("p1") and opening.get("p2")):
            return None
        ends = [opening["p1"], opening["p2"]]
        line = min(self.lines[host], key=lambda ln: to_line(opening.get("center") or ends[0], ln))
        lo, hi = sorted(place_on(p, line) for p in ends)
        return lo, hi


def to_line(p, line) -> float:
    return min(pl.point_segment(p, a, b) for a, b in zip(line, line[1:]))


def place_on(p, line) -> float:
    """Arc length of the nearest point of a polyline."""
    upto, best = 0.0, (math.inf, 0.0)
    for a, b in zip(line, line[1:]):
        t, n = pl.foot(p, a, b), pl.dist(a, b)
        best = min(best, (pl.dist(p, pl.between(a, b, t)), upto + t * n))
        upto += n
    return best[1]


def groups(n: int, links) -> list[set]:
    """Connected sets among 0..n-1 and None."""
    label = {k: {k} for k in [*range(n), None]}
    for a, b in links:
        if label[a] is not label[b]:
            small, large = sorted((label[a], label[b]), key=len)
            large |= small
            label.update(dict.fromkeys(small, large))
    return list({id(s): s for s in label.values()}.values())


RULES: dict[str, Callable[[Plan], Iterator[Finding]]] = {}


def rule(name: str):
    def add(f):
        RULES[name] = f
        return f

    return add


@rule("T1")
def one_cluster(p: Plan):
    have = [k for k, r in enumerate(p.rings) if r]
    if not have:
        yield None, "no room polygon bounds an exterior"
        return
    links = [(i, j) for i in have for j in have if i < j and pl.ring_ring(p.rings[i], p.rings[j]) <= POINT_TOL]
    parts = sorted((len(s & set(have)) for s in groups(len(p.rings), links) if s & set(have)), reverse=True)
    if len(parts) > 1:
        yield None, f"{len(parts)} separate clusters, {sum(parts[1:])} rooms apart from the largest"


@rule("T2")
def no_free_end(p: Plan):
    for k, chord in enumerate(p.chords):
        for end in chord or ():
            others = ((c, ln) for j, (c, ln) in enumerate(zip(p.chords, p.lines)) if j != k)
            if not any((c and min(pl.dist(end, c[0]), pl.dist(end, c[1])) <= POINT_TOL) or any(to_line(end, x) <= POINT_TOL for x in ln) for c, ln in others):
                if not any(p.rings) or p.region.to_shell(end) > COVER_TOL:
                    yield p.walls[k].get("id"), f"free end at ({int(end[0])}, {int(end[1])})"


@rule("T3")
def edges_walled(p: Plan):
    pieces = [(a, b) for own in p.lines for ln in own for a, b in zip(ln, ln[1:])]
    if not pieces:
        yield None, "no wall has a centre line"
        return
    for room, ring in zip(p.rooms, p.rings):
        open_ = max((pl.dist(a, b) - pl.covered(a, b, pieces, COVER_TOL) for a, b in pl.edges(ring or []) if pl.dist(a, b) >= 1), default=0.0)
        if open_ > RESIDUAL_TOL:
            yield room.get("id"), f"{open_:.0f} mm of an edge have no wall"


@rule("T4")
def rooms_tile(p: Plan):
    rings = [r for r in p.rings if r]
    if rings:
        double = sum(abs(pl.area(r)) for r in rings) - p.region.area
        if double > AREA_TOL:
            yield None, f"rooms overlap by {double / 1e6:.2f} m2"
        if p.region.voids > AREA_TOL:
            yield None, f"voids of {p.region.voids / 1e6:.2f} m2 between rooms"


@rule("T5")
def no_degenerate_wall(p: Plan):
    earlier = []
    for w in p.walls:
        length, line = w.get("length_mm", 0), w.get("centerline") or []
        if not w.get("arc"):
            if length < MIN_WALL:
                yield w.get("id"), f"shorter than {MIN_WALL} mm"
            if length < w.get("thickness_mm", 0):
                yield w.get("id"), "shorter than thick"
        if len(line) > 1:
            ends = sorted(map(tuple, line[:2]))
            if any(pl.dist(a, ends[0]) <= POINT_TOL and pl.dist(b, ends[1]) <= POINT_TOL for a, b in earlier):
                yield w.get("id"), "duplicates another wall"
            earlier.append(ends)


@rule("T6")
def no_midspan_crossing(p: Plan):
    straight = [(k, c) for k, c in enumerate(p.chords) if c and not p.walls[k].get("arc")]
    for n, (i, a) in enumerate(straight):
        for j, b in straight[n + 1 :]:
            at = pl.crossing(*a, *b)
            if at and all(min(pl.dist(at, e) for e in ends) > POINT_TOL for ends in (a, b)):
                yield p.walls[i].get("id"), f"crosses {p.walls[j].get('id')} away from a junction"


@rule("T7")
def arcs_fit(p: Plan):
    for w in p.walls:
        arc = w.get("arc")
        if not arc:
            continue
        try:
            centre, radius, a0, a1 = arc["center"], float(arc["radius"]), float(arc["a0"]), float(arc["a1"])
        except (KeyError, TypeError, ValueError):
            yield w.get("id"), "arc lacks centre, radius or angles"
            continue
        if radius <= 0:
            yield w.get("id"), "arc without radius"
            continue
        line = w.get("centerline") or []
        if len(line) > 1:
            e, f = ((centre[0] + radius * math.cos(math.radians(a)), centre[1] + radius * math.sin(math.radians(a))) for a in (a0, a1))
            off = min(pl.dist(e, line[0]) + pl.dist(f, line[1]), pl.dist(e, line[1]) + pl.dist(f, line[0]))
            if off > max(2 * COVER_TOL, 0.02 * radius):
                yield w.get("id"), f"arc ends {off:.0f} mm off the centre line"
        if len(w.get("polygon") or ()) < 4:
            yield w.get("id"), "curved, but fewer than 4 polygon points"


@rule("T8")
def rooms_simple(p: Plan):
    for r in p.rooms:
        ring = r.get("polygon") or []
        if len(ring) < 3:
            yield r.get("id"), "fewer than 3 points"
            continue
        if abs(pl.area(ring)) <= 0:
            yield r.get("id"), "no area"
        if not pl.is_simple(ring):
            yield r.get("id"), "intersects itself"


@rule("S1")
def rooms_have_doors(p: Plan):
    for k, r in enumerate(p.rooms):
        if not p.access[1].get(k):
            yield r.get("id"), "no door"


@rule("S2")
def rooms_reachable(p: Plan):
    links, _, entrance = p.access
    if not entrance:
        yield None, "no entrance"
    if not p.rooms:
        return
    sets = groups(len(p.rooms), links)
    if any(b is None for _, b in links):
        lost = [k for k in range(len(p.rooms)) if k not in next(s for s in sets if None in s)]
        if lost:
            yield None, f"{len(lost)} rooms can't be reached ({', '.join(str(p.rooms[k].get('id', k)) for k in lost[:6])})"
    elif (parts := sum(1 for s in sets if s != {None})) > 1:
        yield None, f"{parts} parts without a way between"


def _fits(p: Plan, k: int, kind: str):
    o, host = p.openings[k], p.hosts[k]
    if host is None:
        yield o.get("id"), f"{kind} on no wall"
    elif not p.walls[host].get("arc") and o.get("width_mm", 0) > p.walls[host].get("length_mm", 0) + POINT_TOL:
        yield o.get("id"), f"{kind} wider than wall {p.walls[host].get('id')}"


@rule("S3")
def doors_placed(p: Plan):
    for k, o in enumerate(p.openings):
        if o.get("category") == "door":
            yield from _fits(p, k, "door")
            if p.hosts[k] is not None and not p.beside[k] and not p.on_shell(o):
                yield o.get("id"), "door touches no room"


@rule("S4")
def windows_placed(p: Plan):
    doors = defaultdict(list)
    for k, o in enumerate(p.openings):
        if o.get("category") == "door" and (s := p.span(k)):
            doors[p.hosts[k]].append(s)
    for k, o in enumerate(p.openings):
        if o.get("category") == "window":
            yield from _fits(p, k, "window")
            s = p.span(k)
            if s and any(min(s[1], d[1]) - max(s[0], d[0]) > POINT_TOL for d in doors[p.hosts[k]]):
                yield o.get("id"), "window overlaps a door"


@rule("S5")
def openings_apart(p: Plan):
    by_wall = defaultdict(list)
    for k, o in enumerate(p.openings):
        if s := p.span(k):
            by_wall[p.hosts[k]].append((*s, str(o.get("id"))))
    for host, spans in by_wall.items():
        spans.sort(key=lambda x: x[0])
        wall = p.walls[host]
        for a, b in zip(spans, spans[1:]):
            if min(a[1], b[1]) - max(a[0], b[0]) > POINT_TOL:
                yield b[2], f"overlaps {a[2]} on wall {wall.get('id')}"
        total = sum(hi - lo for lo, hi, _ in spans)
        if not wall.get("arc") and total > wall.get("length_mm", 0) + POINT_TOL:
            yield wall.get("id"), f"openings take {total:.0f} mm of {wall.get('length_mm', 0)} mm"


@rule("S6")
def rooms_sized(p: Plan):
    for room, ring in zip(p.rooms, p.rings):
        if ring:
            if abs(pl.area(ring)) < MIN_ROOM_AREA:
                yield room.get("id"), f"{abs(pl.area(ring)) / 1e6:.2f} m2"
            long, short = pl.tight_box(ring)
            if (long / short if short else math.inf) > MAX_ASPECT and short < MIN_SIDE:
                yield room.get("id"), f"sliver {short:.0f} mm wide"


@rule("S7")
def thickness_real(p: Plan):
    for w in p.walls:
        if not THICKNESS[0] <= w.get("thickness_mm", 0) <= THICKNESS[1]:
            yield w.get("id"), f"{w.get('thickness_mm', 0)} mm thick"


@rule("S8")
def door_width_real(p: Plan):
    for o in p.openings:
        if o.get("category") == "door" and not DOOR_WIDTH[0] <= o.get("width_mm", 0) <= DOOR_WIDTH[1]:
            yield o.get("id"), f"{o.get('width_mm', 0)} mm wide"


@rule("S9")
def counts_hold(p: Plan):
    for r in p.rooms:
        if not r.get("room_type"):
            yield r.get("id"), "no room type"
    told = p.config.get("counts") or {}
    kinds = [o.get("category") for o in p.openings]
    real = {"rooms": len(p.rooms), "walls": len(p.walls), "doors": kinds.count("door"), "windows": kinds.count("window")}
    for k, n in real.items():
        if told and told.get(k) != n and not (k in ("doors", "windows") and told.get(k) is None):
            yield None, f"counts.{k} is {told.get(k)}, not {n}"


@rule("S10")
def nothing_crosses_openings(p: Plan):
    for k, o in enumerate(p.openings):
        a, b = o.get("p1"), o.get("p2")
        if not (a and b and a != b):
            continue
        for j, own in enumerate(p.lines):
            hits = (pl.crossing(tuple(a), tuple(b), c, d) for ln in own for c, d in zip(ln, ln[1:])) if j != p.hosts[k] else ()
            if any(h and min(pl.dist(h, a), pl.dist(h, b)) > JAMB_TOL for h in hits):
                yield o.get("id"), f"wall {p.walls[j].get('id')} runs through it"


@rule("C1")
def keys_present(p: Plan):
    for key in REQUIRED["plan"]:
        if key not in p.config:
            yield None, f"plan lacks {key}"
    for level, things in (("wall", p.walls), ("room", p.rooms), ("opening", p.openings)):
        for x in things:
            if missing := next((k for k in REQUIRED[level] if k not in x), None):
                yield x.get("id"), f"{level} lacks {missing}"


@rule("C2")
def lengths_hold(p: Plan):
    for w in p.walls:
        if not w.get("arc"):
            line = w.get("centerline") or []
            if len(line) > 1 and abs(pl.dist(line[0], line[1]) - w.get("length_mm", 0)) > 2:
                yield w.get("id"), "length differs from the centre line"
            if len(w.get("polygon") or ()) < 4:
                yield w.get("id"), "fewer than 4 polygon points"


@rule("C3")
def openings_hold(p: Plan):
    for k, o in enumerate(p.openings):
        kind, sub = o.get("category"), o.get("subtype")
        if kind not in ("door", "window", "opening"):
            yield o.get("id"), f"unknown category {kind}"
        a, b, c = o.get("p1"), o.get("p2"), o.get("center")
        if not (a and b and c):
            yield o.get("id"), "lacks an end or the centre"
            continue
        if abs(pl.dist(a, b) - o.get("width_mm", -1)) > 3:
            yield o.get("id"), "width differs from its ends"
        if pl.dist(pl.between(a, b, 0.5), c) > 2:
            yield o.get("id"), "centre is not between its ends"
        if p.hosts[k] is None:
            yield o.get("id"), "on no wall"
        if kind == "door" and sub not in DOOR_SUBTYPES or kind == "window" and sub not in WINDOW_SUBTYPES:
            yield o.get("id"), f"unknown {kind} subtype {sub}"


@rule("C5")
def frame_holds(p: Plan):
    if p.config.get("units") != "mm":
        yield None, "units are not mm"
    box, foot = p.config.get("bbox"), p.config.get("footprint")
    if not isinstance(box, list) or len(box) != 4:
        yield None, "bbox is malformed"
        return
    if box[2] < box[0] or box[3] < box[1]:
        yield None, "bbox ends before it starts"
    if isinstance(foot, dict) and (abs(box[2] - box[0] - foot.get("w", -1)) > 2 or abs(box[3] - box[1] - foot.get("h", -1)) > 2):
        yield None, "footprint differs from bbox"


def violations(config: dict, only: tuple[str, ...] | None = None) -> list[tuple[str, str | None, str]]:
    """(rule, subject, message) in rule order; a rule that fails on malformed data counts as a violation of itself."""
    plan, out = Plan(config), []
    for name, check in RULES.items():
        if only is None or name in only:
            try:
                out += [(name, None if s is None else str(s), m) for s, m in check(plan)]
            except Exception as e:  # noqa: BLE001
                out.append((name, None, f"rule failed: {type(e).__name__}"))
    return out


def audit(plans: DataFrame, column: str = "config", key: str = "plan_id", only: tuple[str, ...] | None = None) -> DataFrame:
    """key, rule, seq, subject, message: a row per violation of each plan (a JSON string)."""
    schema = pa.schema([(key, pa.string()), ("rule", pa.string()), ("seq", pa.int32()), ("subject", pa.string()), ("message", pa.string())])

    def run(batches):
        for batch in batches:
            rows = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    config = json.loads(text or "")
                    found = violations(config, only) if isinstance(config, dict) else [("C1", None, "plan is no object")]
                except ValueError:
                    found = [("C1", None, "plan is no JSON")]
                rows += [{key: k, "rule": r, "seq": i, "subject": s, "message": m} for i, (r, s, m) in enumerate(found)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return plans.select(F.col(key).cast("string").alias(key), column).mapInArrow(run, f"{key} string, rule string, seq int, subject string, message string")


def report(plans: DataFrame, column: str = "config", key: str = "plan_id") -> DataFrame:
    """Per rule: occurrences, plans, first example; and on every row the number of plans and the share without violation."""
    found = audit(plans, column, key)
    total = plans.agg(F.count(F.lit(1)).alias("plans_total"))
    broken = found.agg(F.countDistinct(key).alias("plans_broken"))
    rules = found.groupBy("rule").agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct(key).alias("plans"), F.min_by("message", F.struct(key, "seq")).alias("first_example"))
    return rules.join(F.broadcast(total.crossJoin(broken)), F.lit(True)).withColumn("valid_pct", F.round(100 * (1 - F.col("plans_broken") / F.greatest("plans_total", F.lit(1))), 1)).drop("plans_broken")


def quick_faults(config: dict) -> list[str]:
    """The fast gate of a generator: schema and diversity only."""
    walls, rooms, openings = (config.get(k) or [] for k in ("walls", "rooms", "openings"))
    whole = lambda pts: all(isinstance(p, list) and len(p) == 2 and all(isinstance(x, int) for x in p) for p in pts)
    out = [f"lacks {k}" for k in REQUIRED["plan"][:11] if k != "counts" and k not in config]
    out += ["units are not mm"] * (config.get("units") != "mm") + ["no walls"] * (not walls) + ["no rooms"] * (not rooms)
    for w in walls:
        line = w.get("centerline") or []
        out += [f"wall {w.get('id')} has no thickness"] * (w.get("thickness_mm", 0) <= 0) + [f"wall {w.get('id')} is short"] * (w.get("length_mm", 0) < MIN_WALL)
        out += ["wall polygon too small"] * (len(w.get("polygon") or ()) < 4) + ["wall polygon is not whole"] * (not whole(w.get("polygon") or ()))
        if not w.get("arc") and (len(line) < 2 or abs(pl.dist(line[0], line[1]) - w.get("length_mm", 0)) > 2):
            out.append(f"wall {w.get('id')} length differs")
    out += ["fewer than 3 thicknesses"] * (len({w.get("thickness_mm") for w in walls}) < 3)
    out += ["no room but rectangles"] * all(r.get("shape") == "rectangle" for r in rooms)
    out += [f"room {r.get('id')} is malformed" for r in rooms if len(r.get("polygon") or ()) < 3 or not whole(r["polygon"])]
    out += ["no wall over 8 m"] * (len(rooms) > 3 and max((w.get("length_mm", 0) for w in walls), default=0) <= 8000)
    allowed = {"door": DOOR_SUBTYPES, "window": WINDOW_SUBTYPES, "opening": OPENING_SUBTYPES}
    for o in openings:
        if o.get("subtype") not in allowed.get(o.get("category"), (o.get("subtype"),)):
            out.append(f"unknown subtype {o.get('subtype')}")
        ends = [o.get("p1"), o.get("p2"), o.get("center")]
        if not whole(ends):
            out.append(f"opening {o.get('id')} is not whole")
        elif abs(pl.dist(*ends[:2]) - o.get("width_mm", -9)) > 3 or pl.dist(pl.between(*ends[:2], 0.5), ends[2]) > 2:
            out.append(f"opening {o.get('id')} doesn't fit its ends")
    return out


def engine_faults(config: dict) -> list[str]:
    """Faults of an engine configuration, whose openings name their wall and a position from 0 to 1."""
    walls = {w.get("id") for w in config.get("walls") or ()}
    out = ["no walls"] * (not walls)
    scale = str(config.get("scale", "1:100")).split(":")
    out += ["malformed scale"] * (len(scale) != 2 or not scale[1].isdigit() or int(scale[1]) <= 0)
    for o in config.get("openings") or ():
        out += [f"opening {o.get('id')} has an unknown type"] * (o.get("type") not in ("door", "window", "opening"))
        if not o.get("rooflight"):
            out += [f"opening {o.get('id')} is on no wall"] * (o.get("wall_id") not in walls)
            out += [f"opening {o.get('id')} is off its wall"] * (not 0 <= o.get("position_along_wall", -1) <= 1)
    return out


def matrix_faults(plans: list[dict]) -> list[str]:
    """Faults of a group of hand-made scenarios: equal footprints, few thicknesses, no long or no short wall."""
    out, seen = [], {}
    for p in plans:
        foot = (p.get("group"), json.dumps(p.get("footprint"), sort_keys=True))
        out += [f"{p.get('id')} has the footprint of {seen.get(foot)}"] * (foot in seen)
        seen.setdefault(foot, p.get("id"))
        lengths = [w.get("length_mm", 0) for w in p.get("walls") or ()]
        out += [f"{p.get('id')} has fewer than 3 thicknesses"] * (len({w.get("thickness_mm") for w in p.get("walls") or ()}) < 3)
        out += [f"{p.get('id')} has no wall over 8 m"] * (max(lengths, default=0) <= 8000)
    return out


def label_leaks(entities: DataFrame, layers: tuple[str, ...] = ("DOOR", "WINDOW", "OPENING")) -> DataFrame:
    """Text entities on component layers, which would give labels away."""
    return entities.where(F.col("type").isin("TEXT", "MTEXT") & F.upper("layer").rlike("|".join(layers)))
