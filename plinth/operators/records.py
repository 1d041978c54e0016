"""Plan records: raw annotations, canonical form, minified targets, tolerant parsing.

An annotation has walls {id, start, end, thickness, curvature, openings {type, center, width}} and rooms {label, walls}.
A canonical plan lives on the grid [0, GRID] of the padded square: walls {cl, th, cv, op {t, c, w}} in reading order.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import planar as pl

#: The grid, the reading band, the least curvature that is written, and tolerances in pixels.
GRID, BAND, LEAST_CURVE = 1000, 0.04, 0.02
CORNER_DEGREES, ARC_LEAST, JOIN_PIXELS = 35.0, 0.08, 2.0


def clamp(value: float, grid: int = GRID) -> int:
    return max(0, min(grid, round(value)))


def canonical(walls: Sequence[dict], width: float, height: float, rooms: Sequence[dict] = (), grid: int = GRID) -> tuple[list[dict], list[dict]]:
    """Scale to the grid, drop what has no length, order ends (mirroring offsets and curvature), sort in reading order,
    and give rooms the new wall numbers, clockwise around the room; rooms of fewer than three walls go."""
    scale = grid / (max(width, height) or 1)
    out = []
    for k, w in enumerate(walls):
        ends = [w.get("start"), w.get("end")]
        if not all(isinstance(e, (list, tuple)) and len(e) == 2 for e in ends):
            continue
        a, b = (tuple(clamp(x * scale, grid) for x in e) for e in ends)
        if a == b:
            continue
        flip = a > b
        length, cv = pl.dist(a, b), float(w.get("curvature") or 0)
        openings = []
        for o in w.get("openings") or ():
            c = clamp((o.get("center") or 0) * scale, grid)
            openings.append({"t": "window" if str(o.get("type", "door")).lower().startswith("w") else "door", "c": clamp(length - c, grid) if flip else c, "w": max(1, round((o.get("width") or 0) * scale))})
        a, b = sorted((a, b))
        out.append((w.get("id", k), {"cl": [*a, *b], "th": max(1, round(max(w.get("thickness") or 1, 1) * scale)), "cv": -cv if flip and cv else cv, "op": openings}))
    out.sort(key=lambda x: reading_key(x[1]["cl"], grid))
    number = {src: i for i, (src, _) in enumerate(out, 1)}
    final = [w for _, w in out]
    named = []
    for r in rooms or ():
        refs = sorted({number[s] for s in r.get("walls") or () if s in number})
        if len(refs) > 2:
            mids = {i: ((final[i - 1]["cl"][0] + final[i - 1]["cl"][2]) / 2, (final[i - 1]["cl"][1] + final[i - 1]["cl"][3]) / 2) for i in refs}
            cx, cy = (sum(m[k] for m in mids.values()) / len(mids) for k in (0, 1))
            refs.sort(key=lambda i: (math.atan2(mids[i][0] - cx, cy - mids[i][1]) % (2 * math.pi), i))
            named.append({"t": r.get("label") or r.get("room_type") or "room", "w": refs})
    return final, named


def reading_key(cl: Sequence[int], grid: int = GRID) -> tuple:
    top, left = min(cl[1], cl[3]), min(cl[0], cl[2])
    return int(top // (BAND * grid)), left, top, max(cl[0], cl[2]), max(cl[1], cl[3])


_SHORT = {"n": "n", "cl": "cl", "th": "th", "cv": "cv", "op": "op", "t": "t", "c": "c", "w": "w", "rt": "t", "rw": "w"}
_LONG = {"n": "total_walls", "cl": "centerline", "th": "thickness", "cv": "curvature", "op": "openings", "t": "type", "c": "center", "w": "width", "rt": "type", "rw": "walls"}


def encode(walls: Sequence[dict], rooms: Sequence[dict] = (), short: bool = True, count: bool = True, nest: bool = True) -> str:
    """One minified line; curvature and openings appear only where there are any, rooms only if given."""
    k = _SHORT if short else _LONG
    items = []
    for i, w in enumerate(walls, 1):
        item = {"id": i, k["cl"]: [int(v) for v in w["cl"]], k["th"]: int(w["th"])}
        if abs(w.get("cv") or 0) >= LEAST_CURVE:
            item[k["cv"]] = round(w["cv"], 3)
        if nest and w.get("op"):
            item[k["op"]] = [{k["t"]: o["t"], k["c"]: int(o["c"]), k["w"]: int(o["w"])} for o in w["op"]]
        items.append(item)
    doc: dict = {k["n"]: len(items)} if count else {}
    doc["walls"] = items
    if rooms:
        doc["rooms"] = [{k["rt"]: r["t"], k["rw"]: [int(i) for i in r["w"]]} for r in rooms]
    return json.dumps(doc, separators=(",", ":"))


def loads(text: str | None) -> dict | None:
    """An object from text: as it is, else its outermost braces, else the complete walls of a truncated one."""
    return whole(text) or salvage(text or "")


def whole(text: str | None) -> dict | None:
    """An object from text: as it is, else its outermost braces."""
    text = (text or "").strip()
    outer = re.search(r"\{.*\}", text, re.S)
    for candidate in (text, outer[0] if outer else ""):
        try:
            found = json.loads(candidate)
            return found if isinstance(found, dict) else None
        except ValueError:
            pass
    return None


def salvage(text: str) -> dict | None:
    """The complete objects of a `walls` array that breaks off."""
    start = re.search(r'"walls"[^\[]*\[', text)
    if not start:
        return None
    decoder, at, walls = json.JSONDecoder(), start.end(), []
    while m := re.compile(r"[^{\]]*\{").match(text, at):
        try:
            wall, at = decoder.raw_decode(text, m.end() - 1)
            walls.append(wall)
        except ValueError:
            closed = _closing(text, m.end() - 1)
            if closed is None:
                break
            at = closed
    return {"walls": walls} if walls else None


def _closing(text: str, at: int) -> int | None:
    """Just after the brace that closes the one at `at`."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return None


def decode(text: str | None) -> list[dict]:
    """Canonical walls from a target or prediction with short or long keys; malformed walls go, and a truncated text has none."""
    doc = whole(text) or {}
    pick = lambda d, k, default=None: d.get(k, d.get(_LONG[k], default))
    out = []
    for w in doc.get("walls") or ():
        cl = pick(w, "cl") if isinstance(w, dict) else None
        if isinstance(cl, list) and len(cl) == 4:
            ops = [{k: pick(o, k, d) for k, d in (("t", "door"), ("c", 0), ("w", 0))} for o in pick(w, "op") or ()]
            out.append({"cl": [round(v) for v in cl], "th": round(pick(w, "th", 1)), "cv": float(pick(w, "cv") or 0), "op": ops})
    return out


def verbose(walls: Sequence[dict]) -> list[dict]:
    """Canonical walls with the keys of annotations, for scores that read those."""
    return [{"id": i, "start": w["cl"][:2], "end": w["cl"][2:], "thickness": w["th"], "curvature": w["cv"], "openings": [{"type": o["t"], "center": o["c"], "width": o["w"]} for o in w["op"]]} for i, w in enumerate(walls, 1)]


def assign_openings(walls: list[dict], openings: Sequence[dict], reach) -> None:
    """Give each opening {type, at, width} to its nearest wall, the first of equals, if within reach(wall, opening)."""
    lines = [pl.curve(w["start"], w["end"], w.get("curvature") or 0) for w in walls]
    from plinth.operators.rules import place_on, to_line

    for o in openings:
        d, k = min(((to_line(o["at"], ln), i) for i, ln in enumerate(lines)), default=(math.inf, -1))
        if k >= 0 and d < reach(walls[k], o):
            walls[k]["openings"].append({"type": o["type"], "center": round(place_on(o["at"], lines[k])), "width": o["width"]})


def corner_runs(ring: Sequence, degrees: float = CORNER_DEGREES) -> list[list]:
    """A ring split where it turns by more than `degrees`; a run keeps both its corners. A ring without corners is one run."""
    n = len(ring)
    turns = []
    for i in range(n):
        (ax, ay), (bx, by), (cx, cy) = ring[i - 1], ring[i], ring[(i + 1) % n]
        angle = math.degrees(math.atan2((bx - ax) * (cy - by) - (by - ay) * (cx - bx), (bx - ax) * (cx - bx) + (by - ay) * (cy - by)))
        if abs(angle) > degrees:
            turns.append(i)
    if not turns:
        return [[*ring, ring[0]]]
    return [[ring[k % n] for k in range(i, j + 1)] for i, j in zip(turns, [*turns[1:], turns[0] + n])]


def walls_of_rooms(rooms: Sequence[tuple[str, Sequence]], thickness: float, arcs: bool = False) -> tuple[list[dict], list[dict]]:
    """Room rings (label, points) to walls shared by their rooms: an edge, or a run bent enough for an arc, is one wall
    however many rooms it bounds; ids in the order first seen."""
    walls, where, named = [], {}, []
    for label, ring in rooms:
        ids = []
        pieces = []
        for run in corner_runs(ring) if arcs else [[*ring, ring[0]]]:
            k = _fitted(run)
            if arcs and len(run) > 2 and abs(k) >= ARC_LEAST and run[0] != run[-1]:
                pieces.append((run[0], run[-1], round(k, 3)))
            else:
                pieces += [(p, q, 0) for p, q in zip(run, run[1:])]
        for p, q, k in pieces:
            key = tuple(sorted(tuple(round(v / JOIN_PIXELS) for v in e) for e in (p, q)))
            if pl.dist(p, q) < JOIN_PIXELS:
                continue
            if key not in where:
                where[key] = f"wall_{len(walls) + 1}"
                walls.append({"id": where[key], "start": [round(v) for v in p], "end": [round(v) for v in q], "thickness": max(round(thickness), 1), "curvature": k, "openings": []})
            if where[key] not in ids:
                ids.append(where[key])
        if ids:
            named.append({"label": label, "walls": ids})
    return walls, named


def _fitted(points: Sequence) -> float:
    a, b = points[0], points[-1]
    chord = pl.dist(a, b)
    offsets = [pl.turn(a, b, p) / chord for p in points[1:-1]] if chord > 1e-6 else []
    return 2 * max(offsets, key=abs) / chord if offsets else 0.0


def walls_only(annotation: str | None) -> str | None:
    """An annotation without rooms and openings; what is no object passes."""
    try:
        doc = json.loads(annotation or "")
        keep = ("id", "start", "end", "thickness", "curvature")
        return json.dumps({"walls": [{k: w[k] for k in keep if k in w} for w in doc["walls"]]}, separators=(",", ":"))
    except (ValueError, KeyError, TypeError):
        return annotation


def targets(annotations: DataFrame, column: str = "json_annotation", width: str = "width", height: str = "height", with_rooms: bool = False) -> DataFrame:
    """All columns, and target (null where the annotation is malformed or doesn't decode to as many walls), n_walls, error."""

    def run(batches):
        for batch in batches:
            texts, ws, hs = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (column, width, height))
            rows = []
            for text, w, h in zip(texts, ws, hs):
                try:
                    doc = json.loads(text)
                    walls, rooms = canonical(doc["walls"], w or 0, h or 0, doc.get("rooms") or ())
                    target = encode(walls, rooms if with_rooms else ())
                    rows.append((target, len(walls), None) if len(decode(target)) == len(walls) else (None, len(walls), "self-check"))
                except Exception as e:  # noqa: BLE001
                    rows.append((None, None, type(e).__name__))
            more = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.string()))] if rows else [pa.array([], t) for t in (pa.string(), pa.int32(), pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "target", "n_walls", "error"])

    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    more = [StructField("target", StringType()), StructField("n_walls", IntegerType()), StructField("error", StringType())]
    schema = StructType([*annotations.schema.fields, *more])
    return annotations.mapInArrow(run, schema)


def tolerant(text: Column, schema: str) -> Column:
    """from_json of the text, else of its outermost braces."""
    return F.coalesce(F.from_json(text, schema), F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema))
