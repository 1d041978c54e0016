"""One plan that keeps all rules, and for each rule a change that breaks it; changes at the bound break nothing."""

import copy
import json

import pytest

from plinth.operators import rules


def wall(k, a, b, kind="exterior", t=200):
    (x0, y0), (x1, y1) = a, b
    nx, ny = (0, t // 2) if y0 == y1 else (t // 2, 0)
    ring = [[x0 - nx, y0 - ny], [x1 - nx, y1 - ny], [x1 + nx, y1 + ny], [x0 + nx, y0 + ny]]
    return {"id": f"W{k}", "type": kind, "thickness_mm": t, "length_mm": round(abs(x1 - x0) + abs(y1 - y0)), "centerline": [list(a), list(b)], "polygon": ring, "arc": None}


def opening(k, category, subtype, p, q):
    return {"id": f"O{k}", "category": category, "subtype": subtype, "p1": list(p), "p2": list(q), "center": [(a + b) // 2 for a, b in zip(p, q)], "width_mm": abs(p[0] - q[0]) + abs(p[1] - q[1])}


def base():
    """Two rooms of four by four metres with a door between, an entrance and a window."""
    walls = [
        wall(1, (0, 0), (8000, 0)), wall(2, (8000, 0), (8000, 4000)), wall(3, (8000, 4000), (0, 4000)), wall(4, (0, 4000), (0, 0)), wall(5, (4000, 0), (4000, 4000), "interior", 100),
    ]
    rooms = [{"id": f"R{k}", "room_type": "living", "polygon": [[x, 0], [x + 4000, 0], [x + 4000, 4000], [x, 4000]]} for k, x in ((1, 0), (2, 4000))]
    openings = [opening(1, "door", "SINGLE_HINGED", (4000, 1500), (4000, 2400)), opening(2, "door", "SINGLE_HINGED", (1000, 0), (1900, 0)), opening(3, "window", "FIXED", (5000, 0), (6200, 0))]
    return {
        "id": "p", "group": "g", "name": "n", "units": "mm", "origin": [0, 0], "bbox": [0, 0, 8000, 4000], "footprint": {"w": 8000, "h": 4000},
        "counts": {"walls": 5, "rooms": 2, "doors": 2, "windows": 1}, "walls": walls, "rooms": rooms, "openings": openings, "render": {}, "metadata": {},
    }


def change(name):
    p = base()
    w, r, o = p["walls"], p["rooms"], p["openings"]
    if name == "T1":
        r[1]["polygon"] = [[x + 1000, y] for x, y in r[1]["polygon"]]
    elif name == "T2":
        w.append(wall(6, (2000, 1000), (2000, 2000), "interior", 100))
    elif name == "T3":
        del w[4]
    elif name == "T4":
        r[1]["polygon"][0] = [3980, 0]
        r[1]["polygon"][3] = [3980, 4000]
    elif name == "T5":
        w.append(wall(6, (4004, 0), (4004, 4000), "interior", 100))
    elif name == "T6":
        w += [wall(6, (1000, 2000), (7000, 2000), "interior", 100)]
    elif name == "T7":
        w[1]["arc"] = {"center": [8000, 2000], "radius": 2200, "a0": -90.0, "a1": 90.0}
    elif name == "T8":
        r[0]["polygon"] = [[0, 0], [4000, 4000], [4000, 0], [0, 4000]]
    elif name == "S1":
        del o[0]
    elif name == "S2":
        del o[1]
    elif name == "S3":
        o[0] = opening(1, "door", "SINGLE_HINGED", (4100, 1500), (4100, 2400))
    elif name == "S4":
        o[2] = opening(3, "window", "FIXED", (1500, 0), (2700, 0))
    elif name == "S5":
        o.append(opening(4, "window", "FIXED", (6190, 0), (7000, 0)))
    elif name == "S6":
        r[0]["polygon"] = [[0, 0], [400, 0], [400, 4000], [0, 4000]]
    elif name == "S7":
        w[0]["thickness_mm"] = 39
    elif name == "S8":
        o[0] = opening(1, "door", "SINGLE_HINGED", (4000, 1500), (4000, 2049))
    elif name == "S9":
        p["counts"]["walls"] = 6
    elif name == "S10":
        w.append(wall(6, (3000, 2000), (5000, 2000), "interior", 100))
    elif name == "C1":
        del p["render"]
    elif name == "C2":
        w[0]["length_mm"] += 3
    elif name == "C3":
        o[0]["subtype"] = "HATCH"
    elif name == "C5":
        p["units"] = "cm"
    return p


def test_all_rules_are_there():
    assert list(rules.RULES) == [*(f"T{k}" for k in range(1, 9)), *(f"S{k}" for k in range(1, 11)), "C1", "C2", "C3", "C5"]


def test_base_keeps_all_rules():
    assert rules.violations(base()) == []


@pytest.mark.parametrize("name", list(rules.RULES))
def test_each_rule_finds_its_fault(name):
    assert name in {v[0] for v in rules.violations(change(name))}


def test_bounds_are_kept():
    p = base()
    p["walls"][0]["thickness_mm"], p["walls"][4]["thickness_mm"] = 600, 40
    p["openings"][0] = opening(1, "door", "SINGLE_HINGED", (4000, 1500), (4000, 2050))
    p["walls"][4]["centerline"] = [[4000, 6], [4000, 3994]]
    p["walls"][4]["length_mm"] = 3988
    assert rules.violations(p) == []
    p["openings"].append(opening(4, "window", "FIXED", (6194, 0), (7000, 0)))
    p["counts"]["windows"] = 2
    assert rules.violations(p) == []


def test_malformed_plans_are_violations():
    p = base()
    p["walls"][0]["centerline"] = "no list of points"
    assert any("failed" in m for _, _, m in rules.violations(p))


def test_audit_and_report(spark):
    plans = [("a", json.dumps(base())), ("b", json.dumps(change("C5"))), ("c", json.dumps(change("S7"))), ("d", "{"), ("e", None)]
    df = spark.createDataFrame(plans, "plan_id string, config string")
    found = {(r.plan_id, r.rule) for r in rules.audit(df).collect()}
    assert found == {("b", "C5"), ("c", "S7"), ("d", "C1"), ("e", "C1")}
    rows = {r.rule: r for r in rules.report(df).collect()}
    assert rows["C1"].plans == 2 and rows["S7"].occurrences == 1 and rows["C5"].valid_pct == 20.0
    assert rules.audit(df.limit(0)).count() == 0


def test_quick_and_engine_faults():
    p = copy.deepcopy(base())
    assert any("3 thicknesses" in f for f in rules.quick_faults(p))
    engine = {"scale": "1:100", "walls": [{"id": "w"}], "openings": [{"id": "o", "type": "door", "wall_id": "x", "position_along_wall": 2}]}
    assert len(rules.engine_faults(engine)) == 2
    assert rules.engine_faults({"scale": "1:x", "walls": []}) == ["no walls", "malformed scale"]
    assert rules.matrix_faults([p, p | {"id": "q"}])
