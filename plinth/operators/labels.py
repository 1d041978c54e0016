"""Engine view and labels of plan configurations: openings on walls, pixel transforms, boxes, label lines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import planar as pl
from plinth.operators.rules import Plan, place_on, to_line

#: Frame width and margins of drawings in millimetres, least box side, clamps of pixels per millimetre.
FRAME, LEAST_BOX, PPM_RANGE, EDGE_RANGE = 70.0, 0.03, (0.01, 1.0), (800, 2000)
CLASSES = {"door": 0, "opening": 0, "window": 1}


def pixels_per_mm(range_x: float, range_y: float, scale: int, dpi: int) -> float:
    """Paper scale times resolution, held so that the longer image edge stays within bounds."""
    longest = max(range_x, range_y, 1.0)
    ppm = dpi / 25.4 / scale
    return max(PPM_RANGE[0], min(PPM_RANGE[1], max(EDGE_RANGE[0] / longest, min(EDGE_RANGE[1] / longest, ppm))))


def scale_of(text: Column) -> Column:
    """The denominator of `1:100`, null where it is malformed."""
    return F.when(text.rlike(r"^\d+:\d+$"), F.element_at(F.split(text, ":"), 2).try_cast("int"))


class Frame:
    """Millimetres (y up) to pixels (y down), turned about the middle."""

    def __init__(self, box, ppm: float, turn: float = 0.0, margin: float = 500.0):
        self.ppm, self.turn = ppm, math.radians(turn)
        self.middle = ((box[0] + box[2]) / 2, (box[1] + box[3]) / 2)
        corners = [self._turned(p) for p in ((box[0], box[1]), (box[2], box[1]), (box[2], box[3]), (box[0], box[3]))]
        self.low = min(p[0] for p in corners) - margin, min(p[1] for p in corners) - margin
        high = max(p[0] for p in corners) + margin, max(p[1] for p in corners) + margin
        self.width, self.height = (math.ceil((h - lo) * ppm) for lo, h in zip(self.low, high))

    def _turned(self, p):
        dx, dy = p[0] - self.middle[0], p[1] - self.middle[1]
        return self.middle[0] + dx * math.cos(self.turn) - dy * math.sin(self.turn), self.middle[1] + dx * math.sin(self.turn) + dy * math.cos(self.turn)

    def pixel(self, p) -> tuple[float, float]:
        x, y = self._turned(p)
        return (x - self.low[0]) * self.ppm, self.height - (y - self.low[1]) * self.ppm

    def box(self, box) -> tuple[float, float, float, float]:
        """Bounding box of a turned box, clipped to the image."""
        ps = [self.pixel(p) for p in ((box[0], box[1]), (box[2], box[1]), (box[2], box[3]), (box[0], box[3]))]
        xs, ys = [p[0] for p in ps], [p[1] for p in ps]
        return max(0.0, min(xs)), max(0.0, min(ys)), min(float(self.width), max(xs)), min(float(self.height), max(ys))


def engine_view(config: dict) -> tuple[dict, list[str]]:
    """Walls as straight pieces, openings by wall and position from 0 to 1, and warnings for openings off their wall."""
    plan, warnings = Plan(config), []
    walls, pieces = [], {}
    for k, w in enumerate(plan.walls):
        line = plan.lines[k][-1] if plan.lines[k] else []
        pieces[k] = [f"{w.get('id')}_{i}" if len(line) > 2 else str(w.get("id")) for i in range(max(1, len(line) - 1))]
        walls += [{"id": name, "x1": a[0], "y1": a[1], "x2": b[0], "y2": b[1], "thickness": w.get("thickness_mm"), "wall_type": w.get("type")} for name, a, b in zip(pieces[k], line, line[1:])]
    openings = []
    for o in plan.openings:
        near = [(to_line(o["center"], [(w["x1"], w["y1"]), (w["x2"], w["y2"])]), i) for i, w in enumerate(walls)]
        d, i = min(near, default=(math.inf, -1))
        if i < 0:
            continue
        w = walls[i]
        a, b = (w["x1"], w["y1"]), (w["x2"], w["y2"])
        if d > (w["thickness"] or 0) / 2 + 50:
            warnings.append(f"opening {o.get('id')} is {d:.0f} mm off wall {w['id']}")
        openings.append({"id": o.get("id"), "type": o.get("category"), "subtype": o.get("subtype"), "wall_id": w["id"], "position_along_wall": place_on(o["center"], [a, b]) / (pl.dist(a, b) or 1.0), "clear_opening_mm": float(o.get("width_mm", 0))})
    rooms = [{"id": r.get("id"), "name": r.get("name"), "polygon": r.get("polygon")} for r in plan.rooms]
    return {"plan_id": config.get("id"), "scale": config.get("render", {}).get("scale", "1:100"), "walls": walls, "openings": openings, "rooms": rooms}, warnings


def opening_labels(config: dict, dpi: int = 150) -> dict:
    """Openings with millimetre and pixel points, boxes in both, and boxes as shares of the image."""
    render = config.get("render", {})
    box = config["bbox"]
    scale = int(str(render.get("scale", "1:100")).split(":")[1])
    frame = Frame(box, pixels_per_mm(box[2] - box[0], box[3] - box[1], scale, dpi))
    plan, out = Plan(config), []
    for k, o in enumerate(plan.openings):
        host = plan.hosts[k]
        half = ((plan.walls[host].get("thickness_mm") or 0) if host is not None else 0) / 2 + FRAME
        xs, ys = zip(o["p1"], o["p2"])
        model = (min(xs) - half, min(ys) - half, max(xs) + half, max(ys) + half)
        px = frame.box(model)
        share = ((px[0] + px[2]) / 2 / frame.width, (px[1] + px[3]) / 2 / frame.height, (px[2] - px[0]) / frame.width, (px[3] - px[1]) / frame.height)
        out.append({
            "id": o.get("id"), "type": o.get("category"), "subtype": o.get("subtype"), "clear_opening_mm": float(o.get("width_mm", 0)), "center_px": list(frame.pixel(o["center"])),
            "bbox_model": list(model), "bbox_px": list(px), "bbox_normalized": list(share), "p1_mm": list(map(float, o["p1"])), "p1_px": list(frame.pixel(o["p1"])),
            "p2_mm": list(map(float, o["p2"])), "p2_px": list(frame.pixel(o["p2"])), "angle_deg": o.get("angle_deg"), "small": share[2] < LEAST_BOX or share[3] < LEAST_BOX,
        })
    return {"plan_id": config.get("id"), "scale": render.get("scale"), "image_w": frame.width, "image_h": frame.height, "openings": out}


def label_lines(labels: dict) -> list[str]:
    """`class cx cy w h`, clamped to [0, 1], six decimals."""
    return ["%d %s" % (CLASSES.get(o["type"], 0), " ".join(f"{min(1.0, max(0.0, v)):.6f}" for v in o["bbox_normalized"])) for o in labels["openings"]]


def junctions(config: dict, reach: float = 6.0) -> int:
    """Places where walls meet or cross."""
    found: list[pl.Point] = []
    straight = [c for c in Plan(config).chords if c]
    for i, a in enumerate(straight):
        for b in straight[i + 1 :]:
            if (p := pl.crossing(*a, *b)) and all(pl.dist(p, q) > reach for q in found):
                found.append(p)
    return len(found)


def with_labels(plans: DataFrame) -> DataFrame:
    """plan_id, rich (JSON of opening labels), lines (array of label lines), junctions; a map over rows."""
    import json

    import pyarrow as pa

    schema = pa.schema([("plan_id", pa.string()), ("rich", pa.string()), ("lines", pa.list_(pa.string())), ("junctions", pa.int32())])

    def run(batches):
        for batch in batches:
            rows = []
            for plan_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                config = json.loads(text)
                rich = opening_labels(config)
                rows.append({"plan_id": plan_id, "rich": json.dumps(rich, separators=(",", ":")), "lines": label_lines(rich), "junctions": junctions(config)})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return plans.select("plan_id", "config").mapInArrow(run, "plan_id string, rich string, lines array<string>, junctions int")
