"""Hand-made plans: three fixtures, and a matrix of footprints for tests of drawing and labels."""

from __future__ import annotations

import json
import random

from pyspark.sql import DataFrame, SparkSession

from plinth.operators import generate as g

#: Room cells (x0, y0, x1, y1 in modules of 600 mm) and types of the three fixtures.
FIXTURES = {
    "simple_studio": [((0, 0, 9, 8), "living"), ((9, 0, 14, 4), "kitchen"), ((9, 4, 14, 8), "bathroom")],
    "two_bedroom_flat": [((0, 0, 8, 8), "living"), ((8, 0, 16, 8), "kitchen"), ((0, 8, 5, 16), "bedroom"), ((5, 8, 10, 16), "bathroom"), ((10, 8, 16, 16), "master_bedroom")],
    "office_wing": [((0, 0, 20, 5), "corridor"), *(((4 * k, 5, 4 * k + 4, 12), "private_office") for k in range(5))],
}


def plan(name: str, rooms: list[tuple[tuple[int, int, int, int], str]], group: str = "fixture", seed: int = 0) -> dict:
    """A plan from rooms given in modules: walls from the tiling, doors along a spanning tree, an entrance, windows."""
    rng = random.Random(f"{name}:{seed}")
    tiling = g.Tiling([[tuple(v * g.MODULE for v in cell)] for cell, _ in rooms])
    walls = []
    for k, (axis, line, lo, hi, outer) in enumerate(tiling.walls(), 1):
        t = 300 if outer else 100 if k % 2 else 150
        band = [g.at(axis, line + s * t / 2, x) for s, x in ((-1, lo), (-1, hi), (1, hi), (1, lo))]
        walls.append({"id": f"W{k}", "type": "exterior" if outer else "interior", "thickness_mm": t, "length_mm": hi - lo, "centerline": [g.at(axis, line, lo), g.at(axis, line, hi)], "polygon": band, "arc": None, "angle_class": "orthogonal"})
    openings, used = [], set()
    while not g._doors(tiling, rng, openings, used):
        openings, used = [], set()
    g._entrance(tiling, rng, openings, used)
    g._windows(tiling, rng, openings, used)
    named = [{"id": f"R{k}", "name": t.title(), "room_type": t, "shape": g._shape(ring), "polygon": ring} for k, ((_, t), ring) in enumerate(zip(rooms, tiling.rings), 1)]
    made = {"id": name, "group": group, "name": name, "description": f"{len(named)} rooms", "units": "mm", "origin": [0, 0], "walls": walls, "rooms": named, "openings": openings, "decoys": []}
    return g.finish(made, "hand", 0)


def matrix(group: str = "A", widths: tuple[int, ...] = (14, 16, 20), depths: tuple[int, ...] = (8, 12)) -> list[dict]:
    """One plan per footprint: two rooms over the full depth and one between them."""
    out = []
    for w in widths:
        for d in depths:
            third = w // 3
            rooms = [((0, 0, third, d), "living"), ((third, 0, 2 * third, d), "corridor"), ((2 * third, 0, w, d), "bedroom")]
            out.append(plan(f"{group}_{w}x{d}", rooms, group))
    return out


def table(spark: SparkSession) -> DataFrame:
    """plan_id, config of the fixtures and the matrix."""
    every = [*(plan(n, r) for n, r in FIXTURES.items()), *matrix()]
    return spark.createDataFrame([(p["id"], json.dumps(p)) for p in every], "plan_id string, config string")
