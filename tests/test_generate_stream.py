import json
import math
import random

import pytest
from pyspark.sql import functions as F

from plinth.functions import geom
from plinth.functions import planar as pl
from plinth.operators import filters, generate, incremental, labels, matching, numbering, rules, scores, sinks
from plinth.streaming import events


@pytest.fixture(scope="module")
def plans(spark):
    return generate.plans(spark, 60, seed=3).cache()


def test_plans_are_valid_and_stable(spark, plans):
    assert plans.count() == 60 and rules.audit(plans).count() == 0
    again = generate.plans(spark, 20, seed=3, start=40, partitions=7)
    mine = {r.plan_id: r.config for r in plans.collect()}
    assert all(mine[r.plan_id] == r.config for r in again.collect())
    assert all(rules.quick_faults(json.loads(c)) == [] for c in mine.values())


def test_distributions(plans):
    found = [json.loads(r.config) for r in plans.collect()]
    assert len({p["name"] for p in found}) > 6 and len({p["metadata"]["footprint_shape"] for p in found}) > 2
    assert any(p["metadata"]["curved"] for p in found) and any(p["render"]["rotation_deg"] % 90 for p in found)
    assert all(p["counts"]["doors"] >= p["counts"]["rooms"] for p in found)
    n = {r.value: r.n for r in generate.tally(plans).where("dimension = 'fell_back'").collect()}
    assert sum(n.values()) == 60


def test_identities_follow_the_tables():
    found = [generate.identity(i, 5) for i in range(4000)]
    for name, ((low, high), weight) in generate.CURVES.items():
        assert sum(low <= f["arcs"] <= high for f in found) / 4000 == pytest.approx(weight / 100, abs=0.025), name
    assert {f["shape"] for f in found} == set(generate.FOOTPRINTS) | set(generate.CURVED)
    assert all(not f["arcs"] if f["shape"] in generate.FOOTPRINTS else f["arcs"] for f in found)


def test_shapes_hold_what_they_promise():
    shapes = {}
    for index in range(400):
        shapes.setdefault(generate.identity(index, 1)["shape"], []).append(index)
    for shape in ("irregular_polygon", "rectangle_with_bay", "organic_multi_arc", "fully_curved_facade"):
        for index in shapes[shape][:4]:
            plan, _, safe = generate.one(index, 1)
            assert rules.violations(plan) == []
            if safe:
                continue
            kinds = [w["angle_class"] for w in plan["walls"]]
            if shape == "irregular_polygon":
                assert kinds.count("diagonal") + kinds.count("oblique") >= sum(len(r["polygon"]) == 5 for r in plan["rooms"])
            elif shape == "rectangle_with_bay":
                assert any(o["subtype"] == "BAY" for o in plan["openings"])
            else:
                assert kinds.count("curved") == plan["metadata"]["arcs"] >= 1


def test_a_clipped_corner_keeps_the_ring_closed():
    for corner in ((0, 0), (6000, 0), (6000, 4800), (0, 4800)):
        tiling = generate.Tiling([[(0, 0, 6000, 4800)]])
        tiling.clip(corner, random.Random(4))
        (a, b), ring = tiling.diagonals[0], tiling.rings[0]
        assert len(ring) == 5 and list(corner) not in ring and a in ring and b in ring
        assert abs(ring.index(a) - ring.index(b)) in (1, 4) and pl.is_simple(ring)
        assert abs(pl.area(ring)) == 6000 * 4800 - abs(a[0] - b[0]) * abs(a[1] - b[1]) / 2
        ends = {tuple(generate.at(x, line, v)) for x, line, lo, hi, _ in tiling.pieces for v in (lo, hi)}
        assert ends == set(map(tuple, ring))


def test_blocked_windows_go(plans):
    plan = json.loads(plans.first().config)
    window = next(o for o in plan["openings"] if o["category"] == "window")
    (x0, y0), (x1, y1) = window["p1"], window["p2"]
    mid, off = ((x0 + x1) / 2, (y0 + y1) / 2), (y1 - y0, x0 - x1)
    plan["walls"].append(plan["walls"][0] | {"id": "W99", "arc": None, "centerline": [[round(mid[0] - off[0]), round(mid[1] - off[1])], [round(mid[0] + off[0]), round(mid[1] + off[1])]]})
    generate._unblock(plan)
    assert window["id"] not in {o["id"] for o in plan["openings"]} and any(o["category"] == "door" for o in plan["openings"])


def test_table_function(spark, plans):
    generate.register(spark)
    rows = spark.sql("SELECT * FROM generate_plans(0, 3, 3)").collect()
    assert [r.plan_id for r in rows] == ["plan_00000", "plan_00001", "plan_00002"]


def test_labels(plans):
    config = json.loads(plans.first().config)
    rich = labels.opening_labels(config)
    assert len(rich["openings"]) == config["counts"]["openings"]
    for o in rich["openings"]:
        px = o["p2_px"][0] - o["p1_px"][0], o["p2_px"][1] - o["p1_px"][1]
        assert math.hypot(*px) > 0 and all(0 <= v <= 1 for v in o["bbox_normalized"])
    lines = labels.label_lines(rich)
    assert all(len(ln.split()) == 5 for ln in lines)
    view, warnings = labels.engine_view(config)
    assert warnings == [] and rules.engine_faults(view) == []
    assert labels.junctions(config) >= config["counts"]["rooms"]
    assert labels.with_labels(plans.limit(3)).count() == 3
    frame = labels.Frame((0, 0, 1000, 500), 0.5, 30)
    a, b = frame.pixel((0, 0)), frame.pixel((1000, 0))
    assert math.dist(a, b) == pytest.approx(500)


def test_curvature_columns(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 0.0, k) for k in (0.0, 0.25, -0.6, 1.0)], "x1 double, y1 double, x2 double, y2 double, k double")
    p = df.withColumn("p", geom.arc_points(*(F.col(c) for c in ("x1", "y1", "x2", "y2", "k"))))
    for r in p.select("k", geom.fit_curvature(F.col("p")).alias("f"), F.size("p").alias("n")).collect():
        assert r.f == pytest.approx(r.k, abs=1e-9) and r.n == (2 if r.k == 0 else 25)


def test_greedy_matching_equals_a_loop(spark):
    rng = random.Random(8)
    rows = [([rng.randrange(100) for _ in range(rng.randrange(6))], [rng.randrange(100) for _ in range(rng.randrange(6))]) for _ in range(300)]
    df = spark.createDataFrame(rows, "t array<int>, g array<int>")
    cost = lambda a, b: F.when((a + b) % 3 != 0, F.abs(a - b).cast("double"))
    got = df.select("t", "g", matching.greedy_matches(F.col("t"), F.col("g"), cost, 30.0).alias("m")).collect()
    for r in got:
        free, want = list(range(len(r.g))), []
        for a in r.t:
            best = min(((abs(a - r.g[k]), k) for k in free if (a + r.g[k]) % 3), default=None)
            if best and best[0] <= 30:
                want.append(best[1])
                free.remove(best[1])
        assert r.m == want


def test_feedback_and_gate_columns(spark):
    df = spark.createDataFrame([(0.1, 10, True, ["w1"], 0.9, 0.5), (0.0, 10, True, [], 0.9, 0.2)], "dup double, n int, topo boolean, weak array<string>, align double, outer double")
    rows = df.select(scores.feedback(*(F.col(c) for c in ("dup", "n", "topo", "weak", "align"))).alias("m"), scores.gate_column(F.col("outer")).alias("g")).collect()
    assert "1 of 10" in rows[0].m and "w1" in rows[0].m and rows[1].m.startswith("Refine")
    assert [r.g for r in rows] == [pytest.approx(0.55), pytest.approx(0.1)]


def test_filters_and_numbering(spark):
    df = spark.createDataFrame([(3, "a"), (9, "b"), (5, "a")], "id long, s string")
    assert filters.allow_list(df, "s", []).count() == 3 == filters.allow_list(df, "s", ["z"]).count() and filters.allow_list(df, "s", ["a"]).count() == 2
    assert sorted((r.id, r.n) for r in numbering.gapless(df, "id", "n").collect()) == [(3, 0), (5, 1), (9, 2)]
    assert numbering.gapless(df.limit(0), "id", "n").count() == 0
    rows = [(random.Random(k).choice(["a", "a", "b", None]), k) for k in range(500)]
    groups = {}
    for g, k in rows:
        groups.setdefault(g, []).append(k)
    got = numbering.within(spark.createDataFrame(rows, "g string, k long").repartition(6), "g", "k", "n", "size")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == [(g, k, groups[g].index(k), len(groups[g])) for g, k in rows]
    assert numbering.within(got.limit(0).select("g", "k"), "g", "k", "n").count() == 0


def test_annotations_are_one_array(spark, tmp_path):
    rows = spark.createDataFrame([(k, "é\n" if k % 2 else None, [k, k + 1]) for k in range(7)], "id long, note string, cl array<int>").repartition(3)
    path = tmp_path / "new" / "annotations.json"
    for df in (rows, rows, rows.limit(0)):
        sinks.annotations(df, str(path))
        want = [r.asDict() for r in df.collect()]
        assert sorted(json.loads(path.read_text("utf-8")), key=lambda r: r["id"]) == sorted(want, key=lambda r: r["id"])
    assert [f.name for f in path.parent.iterdir()] == ["annotations.json"]


def test_sinks(spark, tmp_path, plans):
    rows = spark.createDataFrame([("x/a.png", "t", "s", "train"), ("x/b.png", "u", "s", "val"), ("x/a.png", "v", "s", "train")], "image string, target string, source string, split string")
    sinks.jsonl(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).where("split = 'val'").count() == 1
    out = sinks.portable(rows)
    assert sorted(r.image for r in out.collect()) == ["images/000000.png", "images/000001.png"]
    many = spark.range(1000).selectExpr("concat('im', lpad(cast(id * 7919 % 1000 as string), 4, '0'), '.png') AS image", "id % 3 AS k")
    assert [r.image for r in sinks.portable(many.unionAll(many)).orderBy("k", "image").select("image").distinct().orderBy("image").collect()] == [f"images/{k:06d}.png" for k in range(1000)]
    sinks.shards(plans.withColumn("index", F.regexp_extract("plan_id", r"(\d+)", 1).cast("int")), str(tmp_path / "s"), 25)
    assert sorted({r.shard_no for r in spark.read.json(str(tmp_path / "s/index")).collect()}) == [0, 1, 2]
    lab = labels.with_labels(plans.limit(2))
    sinks.rich(lab, str(tmp_path / "r"))
    sinks.label_files(lab, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2 and "nc: 2" in sinks.data_yaml("d")
    sinks.publish(lab, lab.select("plan_id"), str(tmp_path / "pl"), str(tmp_path / "pm"))
    sinks.report(lab.select("plan_id"), str(tmp_path / "rep"))
    assert spark.read.parquet(str(tmp_path / "pm")).count() == 2


def test_incremental(spark, tmp_path):
    done = []
    run = lambda: incremental.run_stage(spark, str(tmp_path / "m"), "a", lambda: done.append(1))
    assert run() and not run() and done == [1]
    tries = []

    def shaky():
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("again")

    assert incremental.run_stage(spark, str(tmp_path / "m"), "b", shaky) and len(tries) == 3
    paths = spark.createDataFrame([("r/checkpoint-9",), ("r/checkpoint-100",), ("r/checkpoint-x",)], "path string")
    assert incremental.latest_checkpoint(paths).first() == ("r/checkpoint-100", 100)
    state = spark.createDataFrame([(1, 0.2), (2, 0.95)], "id int, total double")
    out = incremental.refine(state, lambda df, k: df.withColumn("total", F.col("total") + 0.3 - 0.5 * k), 2, "total >= 0.9")
    assert {r.id: round(r.total, 2) for r in out.collect()} == {1: 0.5, 2: 0.95}


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    source = tmp_path / "in"
    table = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts").withColumn("ts", F.col("ts").cast("timestamp"))
    for k, part in enumerate(table.randomSplit([0.5, 0.5], 1)):
        part.orderBy("ts").coalesce(1).write.mode("append").parquet(str(source))
    batch = spark.read.parquet(str(source))
    stream = events.read(spark, str(source), 10)
    for name, f in (("windows", events.windowed), ("sliding", events.sliding)):
        events.run_once(f(stream), str(tmp_path / name), str(tmp_path / f"c-{name}"))
        got = {tuple(r) for r in spark.read.parquet(str(tmp_path / name)).select("window_start", "n").collect()}
        assert got <= {tuple(r) for r in f(batch).select("window_start", "n").collect()} and got
    events.run_once(events.fresh(stream), str(tmp_path / "fresh"), str(tmp_path / "c-fresh"))
    assert spark.read.parquet(str(tmp_path / "fresh")).count() == batch.select("event_id").distinct().count()
    events.run_once(events.fresh(events.read(spark, str(source), 10)), str(tmp_path / "fresh"), str(tmp_path / "c-fresh"))
    assert spark.read.parquet(str(tmp_path / "fresh")).count() == batch.count()
    assert events.sessions(batch).agg(F.sum("n")).first()[0] == batch.count()
