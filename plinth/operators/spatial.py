"""Joins between the parts of a plan: equi-joins on the plan id with distances, bands and spans as column expressions.

Walls have plan_id, idx, x1, y1, x2, y2, th, cv; openings plan_id, opening, px, py, width; rooms plan_id, room, x0, y0, x1, y1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import geom

_C = F.col


def double_line_candidates(walls: DataFrame, span: float, degrees: float = 8.0, gaps: tuple[float, float] = (0.002, 0.08), overlap: float = 0.25) -> DataFrame:
    """plan_id, i, j, gap, shared: line j may be the other face of line i: parallel, close, and alongside for a share of the
    shorter one."""
    line = walls.where("NOT (x1 = x2 AND y1 = y2)").select("plan_id", "idx", "x1", "y1", (_C("x2") - _C("x1")).cast("double").alias("dx"), (_C("y2") - _C("y1")).cast("double").alias("dy"))
    line = line.withColumn("len", F.sqrt(_C("dx") * _C("dx") + _C("dy") * _C("dy")))
    one, two = (line.select("plan_id", *(F.col(c).alias(f"{side}_{c}") for c in line.columns if c != "plan_id")) for side in "ab")
    both = one.join(two, "plan_id").where("a_idx <> b_idx")
    along = lambda ex, ey: ((_C("b_x1") + ex - _C("a_x1")) * _C("a_dx") + (_C("b_y1") + ey - _C("a_y1")) * _C("a_dy")) / _C("a_len")
    first, last = along(F.lit(0.0), F.lit(0.0)), along(_C("b_dx"), _C("b_dy"))
    shared = F.least(F.greatest(first, last), _C("a_len")) - F.greatest(F.least(first, last), F.lit(0.0))
    gap = F.abs(_C("a_dx") * (_C("b_y1") + _C("b_dy") / 2 - _C("a_y1")) - _C("a_dy") * (_C("b_x1") + _C("b_dx") / 2 - _C("a_x1"))) / _C("a_len")
    sine = F.abs(geom.cross(_C("a_dx"), _C("a_dy"), _C("b_dx"), _C("b_dy"))) / (_C("a_len") * _C("b_len"))
    rows = both.select("plan_id", _C("a_idx").alias("i"), _C("b_idx").alias("j"), gap.alias("gap"), shared.alias("shared"), sine.alias("sine"), F.least("a_len", "b_len").alias("short"))
    fits = (_C("sine") <= F.sin(F.radians(F.lit(degrees)))) & _C("gap").between(max(1.0, gaps[0] * span), gaps[1] * span) & (_C("shared") >= overlap * _C("short")) & (_C("shared") > 0)
    return rows.where(fits).select("plan_id", "i", "j", F.round("gap", 4).alias("gap"), F.round("shared", 4).alias("shared"))


def double_lines(walls: DataFrame, span: float, least: float = 0.01, **how) -> DataFrame:
    """plan_id, i, j, gap: in line order each free line pairs with its nearest free candidate (first on ties); pairs whose
    shared stretch is at most `least` of the span are used up and left out. A fold over the candidates of a plan."""
    candidates = double_line_candidates(walls, span, **how)
    lists = candidates.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("i", "gap", "j", "shared"))).alias("c"))
    none = F.array().cast("array<struct<i:int,gap:double,j:int,shared:double>>")
    busy = lambda took, c: F.exists(took, lambda t: t.i.isin(c.i, c.j) | t.j.isin(c.i, c.j))
    took = F.aggregate("c", none, lambda took, c: F.when(busy(took, c), took).otherwise(F.array_append(took, c)))
    return lists.select("plan_id", F.explode(took).alias("t")).where(_C("t.shared") > least * span).select("plan_id", "t.i", "t.j", "t.gap")


def arcs(walls: DataFrame, scale: float = 200.0) -> DataFrame:
    """plan_id, idx, th, centre (cx, cy), radius and middle point (mx, my) of curved walls; curvature is cv / scale."""
    k, dx, dy = _C("cv") / F.lit(scale), (_C("x2") - _C("x1")).cast("double"), (_C("y2") - _C("y1")).cast("double")
    rows = walls.where("cv <> 0 AND NOT (x1 = x2 AND y1 = y2)").select("plan_id", "idx", "th", k.alias("k"), dx.alias("dx"), dy.alias("dy"), ((_C("x1") + _C("x2")) / 2.0).alias("ax"), ((_C("y1") + _C("y2")) / 2.0).alias("ay"))
    back = (1 - _C("k") * _C("k")) / (4 * _C("k"))  # from the chord's middle to the centre, in chords
    return rows.select(
        "plan_id", "idx", "th", "k", (_C("ax") + _C("dy") * back).alias("cx"), (_C("ay") - _C("dx") * back).alias("cy"),
        (_C("ax") - _C("dy") * _C("k") / 2).alias("mx"), (_C("ay") + _C("dx") * _C("k") / 2).alias("my"),
        (F.sqrt(_C("dx") * _C("dx") + _C("dy") * _C("dy")) * (1 + _C("k") * _C("k")) / (4 * F.abs("k"))).alias("radius"),
    )


def arc_openings(walls: DataFrame, openings: DataFrame, slack: float = 60.0) -> DataFrame:
    """plan_id, opening, arc: openings in the band of an arc (radius within half a thickness and slack, angle within the
    sweep); each is taken by one arc, the first in wall order."""
    both = openings.join(arcs(walls), "plan_id")
    x, y = _C("px") - _C("cx"), _C("py") - _C("cy")
    far = F.sqrt(x * x + y * y)
    inside = x * (_C("mx") - _C("cx")) + y * (_C("my") - _C("cy")) >= far * _C("radius") * F.cos(2 * F.atan(F.abs("k"))) - 1e-6
    band = F.abs(far - _C("radius")) <= _C("th") / 2.0 + slack + 1e-5
    return both.where(band & inside).groupBy("plan_id", "opening").agg(F.min("idx").alias("arc"))


def incident_rooms(walls: DataFrame, openings: DataFrame, rooms: DataFrame, reach: float = 45.0) -> DataFrame:
    """plan_id, opening, left_room, right_room: of rooms within reach of an opening, the nearest on either side of its wall
    (walls.idx = opening); rooms whose middle is on the line count right."""
    host = walls.select("plan_id", _C("idx").alias("opening"), (_C("x2") - _C("x1")).alias("dx"), (_C("y2") - _C("y1")).alias("dy"))
    both = openings.select("plan_id", "opening", "px", "py").join(host, ["plan_id", "opening"]).join(rooms.select("plan_id", "room", "x0", "y0", "x1", "y1"), "plan_id")
    away = F.greatest(_C("x0") - _C("px"), _C("px") - _C("x1"), F.lit(0)) + F.greatest(_C("y0") - _C("py"), _C("py") - _C("y1"), F.lit(0))
    side = geom.cross(_C("dx"), _C("dy"), _C("x0") + _C("x1") - 2 * _C("px"), _C("y0") + _C("y1") - 2 * _C("py"))
    best = lambda wanted: F.min(F.when(wanted, F.struct(away.alias("d"), _C("room"))))["room"]
    return both.where(away <= reach).groupBy("plan_id", "opening").agg(best(side > 0).alias("left_room"), best(side <= 0).alias("right_room"))


def opening_overlaps(placed: DataFrame, slack: float = 6.0) -> DataFrame:
    """plan_id, wall, a, b, overlap: every two openings of a wall (place along it, width) that overlap by more than slack."""
    span = placed.select("plan_id", "wall", "opening", (_C("place") - _C("width") / 2).alias("lo"), (_C("place") + _C("width") / 2).alias("hi"))
    one, two = (span.select("plan_id", "wall", *(F.col(c).alias(f"{c}_{k}") for c in ("opening", "lo", "hi"))) for k in "ab")
    shared = F.least("hi_a", "hi_b") - F.greatest("lo_a", "lo_b")
    return one.join(two, ["plan_id", "wall"]).where((_C("opening_a") < _C("opening_b")) & (shared > slack)).select("plan_id", "wall", _C("opening_a").alias("a"), _C("opening_b").alias("b"), shared.alias("overlap"))


def tally(plans: DataFrame, **dimensions: Column) -> DataFrame:
    """dimension, bucket, n, walls: counts of plans by each dimension in one aggregation."""
    pairs = F.array(*(F.struct(F.lit(name).alias("dimension"), value.cast("string").alias("bucket")) for name, value in dimensions.items()))
    return plans.select(F.explode(pairs).alias("d"), "walls").groupBy("d.dimension", "d.bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("walls").alias("walls"))


def violations(rows: DataFrame, **rules: Column) -> DataFrame:
    """rule, plan_id, idx: a row for each rule that a row breaks."""
    broken = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items())), lambda r: r.isNotNull())
    return rows.select(F.explode(broken).alias("rule"), "plan_id", "idx")


def histogram(broken: DataFrame, plans: int) -> DataFrame:
    """rule, occurrences, plans, first_example, valid_pct."""
    return broken.groupBy("rule").agg(
        F.count(F.lit(1)).alias("occurrences"), F.count_distinct("plan_id").alias("plans"), F.min(_C("plan_id") * 1000 + _C("idx")).alias("first_example"),
    ).withColumn("valid_pct", F.round(100.0 * (1 - _C("plans") * 1.0 / plans), 4))
