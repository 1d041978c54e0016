import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plinth.operators import records, scores

WALLS = [
    {"id": "a", "start": [400, 20], "end": [10, 20], "thickness": 12, "curvature": 0.25, "openings": [{"type": "Window", "center": 100, "width": 27}]},
    {"id": "b", "start": [10, 20], "end": [10, 500], "thickness": 12, "curvature": 0.019, "openings": []},
    {"id": "c", "start": [10, 500], "end": [400, 500], "thickness": 12},
    {"id": "d", "start": [7, 7], "end": [7.2, 7.1], "thickness": 1},
    {"id": "e", "start": "bad", "end": [1, 1]},
]


def test_canonical_form():
    walls, rooms = records.canonical(WALLS, 1000, 800, [{"label": "bedroom", "walls": ["a", "b", "c", "zz"]}, {"label": "x", "walls": ["a", "b"]}])
    assert [w["cl"] for w in walls] == [[10, 20, 10, 500], [10, 20, 400, 20], [10, 500, 400, 500]]
    assert walls[1]["cv"] == -0.25 and walls[1]["op"] == [{"t": "window", "c": 290, "w": 27}]
    assert rooms == [{"t": "bedroom", "w": [2, 3, 1]}]


def test_canonical_is_idempotent_and_order_free():
    walls, _ = records.canonical(WALLS, 1000, 1000)
    again, _ = records.canonical(records.verbose(walls), 1000, 1000)
    assert again == walls == records.canonical(WALLS[::-1], 1000, 1000)[0]


def test_encode_and_decode():
    walls, rooms = records.canonical(WALLS, 1000, 1000, [{"label": "bedroom", "walls": ["a", "b", "c"]}])
    line = records.encode(walls, rooms)
    assert line.startswith('{"n":3,"walls":[{"id":1,"cl":[10,20,10,500],"th":12},') and '"cv":-0.25' in line and "0.019" not in line
    assert [w["cl"] for w in records.decode(f"Sure: {line} done")] == [w["cl"] for w in walls]
    assert records.decode(records.encode(walls, short=False)) == records.decode(line)
    assert records.decode(line[:-3]) == [] and len(records.loads(line[:-3])["walls"]) >= 1  # only the salvage reads a truncated text
    assert records.encode([]) == '{"n":0,"walls":[]}' and records.decode("nothing") == [] == records.decode(None)


def test_half_even_rounding():
    assert [records.clamp(v) for v in (2.5, 3.5, -4, 1000.7)] == [2, 4, 0, 1000]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 400))
def test_truncated_text_keeps_whole_walls(cut):
    line = json.dumps({"walls": [{"id": k, "start": [k, 0], "end": [k, 9], "openings": [{"type": "door"}]} for k in range(6)]})
    found = records.loads(line[:cut])
    assert found is None or [w["id"] for w in found["walls"]] == list(range(len(found["walls"])))
    if cut >= len(line):
        assert len(found["walls"]) == 6


def test_walls_of_rooms_are_shared():
    rooms = [("a", [(0, 0), (100, 0), (100, 100), (0, 100)]), ("b", [(100, 0), (200, 0), (200, 100), (100, 100)])]
    walls, named = records.walls_of_rooms(rooms, 8)
    assert len(walls) == 7 and len(named[0]["walls"]) == len(named[1]["walls"]) == 4
    assert set(named[0]["walls"]) & set(named[1]["walls"]) == {"wall_2"}


def test_targets_count_errors(spark):
    rows = [("x", json.dumps({"walls": WALLS}), 1000, 1000), ("y", "{", 1, 1), ("z", None, None, None)]
    df = spark.createDataFrame(rows, "image_path string, json_annotation string, width int, height int")
    got = {r.image_path: r for r in records.targets(df).collect()}
    assert got["x"].n_walls == 3 and got["x"].error is None and got["y"].error and got["z"].error
    assert records.walls_only(json.dumps({"walls": WALLS[:1], "rooms": []})) == '{"walls":[{"id":"a","start":[400,20],"end":[10,20],"thickness":12,"curvature":0.25}]}'
    assert records.walls_only("{") == "{"


BOX = {"walls": [{"id": k, "start": a, "end": b, "thickness": 10, "openings": [{"type": "door", "center": 50, "width": 9}]} for k, (a, b) in enumerate([([0, 0], [100, 0]), ([100, 0], [100, 100]), ([100, 100], [0, 100]), ([0, 100], [0, 0])])], "rooms": [{"label": x, "walls": [0, 1, 2, 3]} for x in "aab"]}


def test_scores_of_a_plan_with_itself():
    s = scores.pair_scores(json.dumps(BOX), json.dumps(BOX))
    assert s == {"valid": 1, "ext_iou": pytest.approx(1), "room_iou": pytest.approx(1), "room_f1": 1, "room_label_f1": 1, "opening_f1": 1, "wall_mae": 0}
    assert scores.reward(json.dumps(BOX), json.dumps(BOX)) == pytest.approx(1.0) == scores.reward(json.dumps(BOX), json.dumps(BOX), True)


def test_scores_where_nothing_applies():
    empty = scores.pair_scores("no plan", json.dumps(BOX))
    assert empty["valid"] == 0 and empty["opening_f1"] is None and empty["wall_mae"] == 4 and empty["room_label_f1"] == 0
    bare = {"walls": [{k: v for k, v in w.items() if k != "openings"} for w in BOX["walls"]]}
    s = scores.pair_scores(json.dumps(bare), json.dumps(bare))
    assert s["opening_f1"] is None and s["room_label_f1"] is None


def test_label_multiset_and_opening_reach():
    other = BOX | {"rooms": [{"label": x, "walls": []} for x in "abb"]}
    assert scores.label_f1(BOX, other) == pytest.approx(2 / 3)
    at = lambda x: {"walls": [{"start": [0, 0], "end": [500, 0], "openings": [{"type": "door", "center": x}]}]}
    assert scores.opening_f1(at(100), at(130)) == 1 and scores.opening_f1(at(100), at(130.1)) == 0


def test_gate_and_topology():
    assert [scores.gate(x) for x in (0.0, 0.3, 0.5, 0.7, 1.0)] == pytest.approx([0.1, 0.1, 0.55, 1.0, 1.0])
    assert scores.topology_ok(BOX["walls"]) and not scores.topology_ok(BOX["walls"][:3])
    assert scores.duplicate_share([]) == 1 and scores.duplicate_share([*BOX["walls"], BOX["walls"][0]]) == 0.2
    assert scores.reference_free(BOX["walls"], 1.0) == 1.0


def test_score_pairs_in_spark(spark):
    df = spark.createDataFrame([("1", json.dumps(BOX), json.dumps(BOX)), ("2", None, json.dumps(BOX))], "id string, prediction string, target string")
    row = scores.summarise(scores.score_pairs(df)).first()
    assert row.n == 2 and row.valid == 0.5 and row.opening_f1 == 1.0
