"""Queries of the joins between the parts of a plan, and of the reports over whole plans (plinth.operators.spatial)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.operators import spatial
from plinth.planview import table, view, with_views
from plinth.plans.geometry import nearest_wall_assign, recursive
from plinth.registry import oracle_sql_of, query

_C = F.col
#: Stretches that two lines share, in SQL for the oracle.
_PAIRS = """s AS (SELECT plan_id, idx, x1, y1, CAST(x2 - x1 AS DOUBLE) AS dx, CAST(y2 - y1 AS DOUBLE) AS dy, sqrt(CAST((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS DOUBLE)) AS len FROM walls WHERE NOT (x1 = x2 AND y1 = y2)),
    p AS (SELECT a.plan_id, a.idx AS i, b.idx AS j, a.len, least(a.len, b.len) AS short, abs(a.dx * b.dy - a.dy * b.dx) / (a.len * b.len) AS sine,
        abs(a.dx * (b.y1 + b.dy / 2 - a.y1) - a.dy * (b.x1 + b.dx / 2 - a.x1)) / a.len AS gap,
        ((b.x1 - a.x1) * a.dx + (b.y1 - a.y1) * a.dy) / a.len AS t0, ((b.x1 + b.dx - a.x1) * a.dx + (b.y1 + b.dy - a.y1) * a.dy) / a.len AS t1
        FROM s a JOIN s b ON a.plan_id = b.plan_id AND a.idx <> b.idx),
    q AS (SELECT *, least(greatest(t0, t1), len) - greatest(least(t0, t1), 0.0) AS stretch FROM p),
    c AS (SELECT plan_id, i, j, round(gap, 4) AS gap, round(stretch, 4) AS shared FROM q WHERE sine <= sin(radians(8)) AND gap BETWEEN 2 AND 80 AND stretch >= 0.25 * short AND stretch > 0)"""


@query("double_line_candidates", with_views(f"WITH {_PAIRS} SELECT * FROM c"))
def double_line_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.double_line_candidates(view(spark, sf_dir, "walls"), 1000)


@query(
    "double_lines",
    recursive(f"""{_PAIRS}, l AS (SELECT plan_id, list({{'i': i, 'gap': gap, 'j': j, 'shared': shared}} ORDER BY i, gap, j) AS c FROM c GROUP BY plan_id),
    f AS (SELECT plan_id, c, 1 AS k, CAST([] AS STRUCT(i INT, gap DOUBLE, j INT, shared DOUBLE)[]) AS took FROM l
        UNION ALL SELECT plan_id, c, k + 1, CASE WHEN len([t FOR t IN took IF t.i = c[k].i OR t.i = c[k].j OR t.j = c[k].i OR t.j = c[k].j]) = 0 THEN list_append(took, c[k]) ELSE took END FROM f WHERE k <= len(c))
    SELECT plan_id, t.i AS i, t.j AS j, t.gap AS gap FROM (SELECT plan_id, unnest(took) AS t FROM f WHERE k = len(c) + 1) AS u WHERE t.shared > 10"""),
)
def double_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.double_lines(view(spark, sf_dir, "walls"), 1000)


@query(
    "arc_band_members",
    with_views("""WITH a AS (SELECT plan_id, idx, th, cv / 200.0 AS k, CAST(x2 - x1 AS DOUBLE) AS dx, CAST(y2 - y1 AS DOUBLE) AS dy, (x1 + x2) / 2.0 AS ax, (y1 + y2) / 2.0 AS ay FROM walls WHERE cv <> 0 AND NOT (x1 = x2 AND y1 = y2)),
    b AS (SELECT *, ax + dy * ((1 - k * k) / (4 * k)) AS cx, ay - dx * ((1 - k * k) / (4 * k)) AS cy, sqrt(dx * dx + dy * dy) * (1 + k * k) / (4 * abs(k)) AS radius, ax - dy * k / 2 AS mx, ay + dx * k / 2 AS my FROM a),
    d AS (SELECT o.plan_id, o.opening, b.*, px - cx AS x, py - cy AS y, sqrt((px - cx) * (px - cx) + (py - cy) * (py - cy)) AS far FROM openings o JOIN b ON o.plan_id = b.plan_id)
    SELECT plan_id, opening, min(idx) AS arc FROM d WHERE abs(far - radius) <= th / 2.0 + 60.00001 AND x * (mx - cx) + y * (my - cy) >= far * radius * cos(2 * atan(abs(k))) - 0.000001 GROUP BY plan_id, opening"""),
)
def arc_band_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.arc_openings(view(spark, sf_dir, "walls"), view(spark, sf_dir, "openings"))


@query(
    "incident_rooms",
    with_views("""WITH d AS (SELECT o.plan_id, o.opening, r.room, greatest(r.x0 - px, px - r.x1, 0) + greatest(r.y0 - py, py - r.y1, 0) AS d,
        (w.x2 - w.x1) * (r.y0 + r.y1 - 2 * py) - (w.y2 - w.y1) * (r.x0 + r.x1 - 2 * px) > 0 AS is_left
        FROM openings o JOIN walls w ON o.plan_id = w.plan_id AND o.opening = w.idx JOIN rooms r ON o.plan_id = r.plan_id),
    k AS (SELECT *, row_number() OVER (PARTITION BY plan_id, opening, is_left ORDER BY d, room) AS k FROM d WHERE d <= 200)
    SELECT plan_id, opening, max(CASE WHEN is_left AND k = 1 THEN room END) AS left_room, max(CASE WHEN NOT is_left AND k = 1 THEN room END) AS right_room FROM k GROUP BY plan_id, opening"""),
)
def incident_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.incident_rooms(view(spark, sf_dir, "walls"), view(spark, sf_dir, "openings"), view(spark, sf_dir, "rooms"), 200)


@query(
    "opening_overlap",
    f"""WITH n AS ({oracle_sql_of("nearest_wall_assign")}), s AS (SELECT n.plan_id, n.wall, n.opening, n.place - o.l_width / 2.0 AS lo, n.place + o.l_width / 2.0 AS hi
        FROM n JOIN (SELECT l_orderkey AS plan_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS INT) AS opening, 20 + CAST(floor(l_extendedprice) AS BIGINT) % 61 AS l_width FROM lineitem) AS o
        ON n.plan_id = o.plan_id AND n.opening = o.opening)
    SELECT a.plan_id, a.wall, a.opening AS a, b.opening AS b, least(a.hi, b.hi) - greatest(a.lo, b.lo) AS overlap FROM s a JOIN s b ON a.plan_id = b.plan_id AND a.wall = b.wall AND a.opening < b.opening
    WHERE least(a.hi, b.hi) - greatest(a.lo, b.lo) > 6""",
)
def opening_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings on their nearest walls, every two of a wall that overlap."""
    placed = nearest_wall_assign(spark, sf_dir).join(view(spark, sf_dir, "openings").select("plan_id", "opening", "width"), ["plan_id", "opening"])
    return spatial.opening_overlaps(placed)


_DIMENSIONS = {
    "walls": "n", "doors": "doors", "windows": "windows", "openings": "doors + windows", "curved": "CASE WHEN curved > 0 THEN 'yes' ELSE 'no' END",
    "thicknesses": "thicknesses", "size": "CASE WHEN n <= 2 THEN 'small' WHEN n <= 5 THEN 'medium' ELSE 'large' END", "axis_parallel": "straight",
    "widest_opening": "CASE WHEN widest IS NULL THEN 'none' WHEN widest < 50 THEN 'narrow' ELSE 'wide' END", "split": "CASE WHEN plan_id % 20 < 3 THEN 'val' ELSE 'train' END", "thickest": "thickest",
}


@query(
    "source_histograms",
    with_views("""WITH plans AS (SELECT plan_id, count(*) AS n, count(CASE WHEN kind = 'door' THEN 1 END) AS doors, count(CASE WHEN kind = 'window' THEN 1 END) AS windows, count(CASE WHEN cv <> 0 THEN 1 END) AS curved,
        count(DISTINCT th) AS thicknesses, count(CASE WHEN x1 = x2 OR y1 = y2 THEN 1 END) AS straight, max(CASE WHEN kind IS NOT NULL THEN width END) AS widest, max(th) AS thickest FROM walls GROUP BY plan_id)
    """ + " UNION ALL ".join(f"SELECT '{name}' AS dimension, CAST({value} AS VARCHAR) AS bucket, count(*) AS n, CAST(sum(n) AS BIGINT) AS walls FROM plans GROUP BY CAST({value} AS VARCHAR)" for name, value in _DIMENSIONS.items())),
)
def source_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven tallies over plans in one aggregation."""
    count = lambda c: F.count(F.when(c, 1))
    plans = view(spark, sf_dir, "walls").groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("n"), count(_C("kind") == "door").alias("doors"), count(_C("kind") == "window").alias("windows"), count(_C("cv") != 0).alias("curved"),
        F.count_distinct("th").alias("thicknesses"), count((_C("x1") == _C("x2")) | (_C("y1") == _C("y2"))).alias("straight"), F.max(F.when(_C("kind").isNotNull(), _C("width"))).alias("widest"), F.max("th").alias("thickest"),
    )
    return spatial.tally(plans.withColumn("walls", _C("n")), **{name: F.expr(value) for name, value in _DIMENSIONS.items()})


_RULES = {
    "S7": "th < 3 OR th > 18", "S8": "kind = 'door' AND (width < 25 OR width > 75)", "S3": "kind = 'door' AND width * width > len2", "S4": "kind = 'window' AND width * width > len2",
    "C2": "len2 BETWEEN (off - 20) * (off - 20) AND (off + 20) * (off + 20)", "C3": "kind IS NOT NULL AND width % 2 = 1 AND th % 2 = 0", "C5": "least(x1, x2) < 0 OR greatest(y1, y2) > 1000",
    "T5": "len2 < 900 OR len2 < th * th", "T7": "cv <> 0 AND abs(cv) > 45", "T8": "x1 = x2 AND y1 = y2", "S9": "kind IS NULL AND cv = 0 AND off = 0",
}


@query(
    "violation_histogram",
    with_views("WITH w AS (SELECT *, (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS len2 FROM walls), broken AS (" + " UNION ALL ".join(f"SELECT '{name}' AS rule, plan_id, idx FROM w WHERE {bad}" for name, bad in _RULES.items()) + """
    UNION ALL SELECT 'T6', a.plan_id, a.idx FROM walls a JOIN walls b ON a.plan_id = b.plan_id AND a.idx < b.idx AND a.cv = 0 AND b.cv = 0
    WHERE ((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1)) * CAST((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1) AS DOUBLE) < 0
    AND ((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1)) * CAST((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1) AS DOUBLE) < 0)
    SELECT rule, count(*) AS occurrences, count(DISTINCT plan_id) AS plans, min(plan_id * 1000 + idx) AS first_example,
    round(100.0 * (1 - count(DISTINCT plan_id) * 1.0 / (SELECT count(DISTINCT l_orderkey) FROM lineitem)), 4) AS valid_pct FROM broken GROUP BY rule"""),
)
def violation_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve rules: eleven over a wall alone, and crossings of two straight walls."""
    walls = view(spark, sf_dir, "walls").withColumn("len2", F.expr("(x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)"))
    alone = spatial.violations(walls, **{name: F.expr(bad) for name, bad in _RULES.items()})
    straight = walls.where("cv = 0").select("plan_id", "idx", *(_C(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))
    a, b = straight.alias("a"), straight.alias("b")
    side = lambda line, x, y: f"(({line}.x2 - {line}.x1) * ({y} - {line}.y1) - ({line}.y2 - {line}.y1) * ({x} - {line}.x1))"
    apart = lambda line, other: f"{side(line, f'{other}.x1', f'{other}.y1')} * {side(line, f'{other}.x2', f'{other}.y2')} < 0"
    crossing = f"{apart('a', 'b')} AND {apart('b', 'a')}"
    crossed = a.join(b, F.expr("a.plan_id = b.plan_id AND a.idx < b.idx") & F.expr(crossing)).select(F.lit("T6").alias("rule"), "a.plan_id", "a.idx")
    return spatial.histogram(alone.unionByName(crossed), table(spark, sf_dir, "lineitem").select("l_orderkey").distinct().count())
