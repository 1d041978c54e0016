"""Spatial joins, ordered operators and geometry over the plan view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.functions import geom
from plinth.planview import sql_query, table, view, with_views
from plinth.registry import query

_C = F.col


def recursive(text: str) -> str:
    """The oracle's SQL with recursive parts."""
    return with_views("WITH " + text).replace("WITH ", "WITH RECURSIVE ", 1)


#: Foot of an opening on each wall of its plan, in SQL for the oracle.
_FEET = """feet AS (SELECT o.plan_id, o.opening, o.kind, o.width, o.px, o.py, w.idx, w.th, w.x1, w.y1, w.x2, w.y2,
    greatest(0.0, least(1.0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) * 1.0 / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0))) AS t
    FROM openings o JOIN walls w ON o.plan_id = w.plan_id WHERE NOT (x1 = x2 AND y1 = y2)),
    near AS (SELECT *, round(sqrt((px - (x1 + t * (x2 - x1))) * (px - (x1 + t * (x2 - x1))) + (py - (y1 + t * (y2 - y1))) * (py - (y1 + t * (y2 - y1)))), 4) AS d FROM feet)"""


def _feet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each opening with each wall of its plan: an equi-join on the plan, distances as expressions."""
    walls = view(spark, sf_dir, "walls").where("NOT (x1 = x2 AND y1 = y2)").select("plan_id", "idx", "th", "x1", "y1", "x2", "y2")
    both = view(spark, sf_dir, "openings").join(walls, "plan_id")
    at = (_C("px"), _C("py"), _C("x1"), _C("y1"), _C("x2"), _C("y2"))
    return both.withColumn("t", geom.along(*at)).withColumn("d", F.round(geom.to_segment(*at), 4))


@query(
    "nearest_wall_assign",
    with_views(f"""WITH {_FEET}, best AS (SELECT plan_id, opening, kind, width, min_by(idx, d * 1000 + idx * 0.00001) AS wall FROM near GROUP BY plan_id, opening, kind, width)
    SELECT b.plan_id, b.opening, b.kind, b.wall, n.d AS distance, CAST(round_even(n.t * sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0) AS BIGINT) AS place
    FROM best b JOIN near n ON b.plan_id = n.plan_id AND b.opening = n.opening AND b.wall = n.idx WHERE n.d < 4 * n.th + b.width"""),
)
def nearest_wall_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest wall of each opening (first on ties), taken if within 4 thicknesses plus width; place along it."""
    best = _feet(spark, sf_dir).groupBy("plan_id", "opening", "kind", "width").agg(
        F.min(F.struct("d", "idx", "th", F.bround(_C("t") * geom.distance(_C("x1"), _C("y1"), _C("x2"), _C("y2")), 0).cast("long").alias("place"))).alias("b")
    )
    return best.where("b.d < 4 * b.th + width").select("plan_id", "opening", "kind", _C("b.idx").alias("wall"), _C("b.d").alias("distance"), "b.place")


@query(
    "host_wall_last_tie",
    with_views(f"""WITH {_FEET}, r AS (SELECT *, row_number() OVER (PARTITION BY plan_id, opening ORDER BY d, idx DESC) AS k FROM near WHERE d <= 120)
    SELECT o.plan_id, o.opening, r.idx AS host, r.d AS distance FROM openings o LEFT JOIN r ON o.plan_id = r.plan_id AND o.opening = r.opening AND r.k = 1"""),
)
def host_wall_last_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host wall within a tolerance, the last of equals; openings without one stay, with null."""
    near = _feet(spark, sf_dir).groupBy("plan_id", "opening").agg(F.min(F.when(_C("d") <= 120, F.struct("d", (-_C("idx")).alias("back")))).alias("b"))
    rest = view(spark, sf_dir, "openings").select("plan_id", "opening")
    return rest.join(near, ["plan_id", "opening"], "left").select("plan_id", "opening", (-_C("b.back")).alias("host"), _C("b.d").alias("distance"))


@query(
    "floating_ends",
    with_views("""WITH ends AS (SELECT plan_id, idx, 0 AS side, x1 AS x, y1 AS y FROM walls UNION ALL SELECT plan_id, idx, 1, x2, y2 FROM walls)
    SELECT e.plan_id, e.idx, e.side FROM ends e WHERE NOT EXISTS (SELECT 1 FROM walls w WHERE w.plan_id = e.plan_id AND w.idx <> e.idx AND NOT (w.x1 = w.x2 AND w.y1 = w.y2) AND
    (e.x - (w.x1 + greatest(0.0, least(1.0, ((e.x - w.x1) * (w.x2 - w.x1) + (e.y - w.y1) * (w.y2 - w.y1)) * 1.0 / ((w.x2 - w.x1) * (w.x2 - w.x1) + (w.y2 - w.y1) * (w.y2 - w.y1)))) * (w.x2 - w.x1))) ** 2
    + (e.y - (w.y1 + greatest(0.0, least(1.0, ((e.x - w.x1) * (w.x2 - w.x1) + (e.y - w.y1) * (w.y2 - w.y1)) * 1.0 / ((w.x2 - w.x1) * (w.x2 - w.x1) + (w.y2 - w.y1) * (w.y2 - w.y1)))) * (w.y2 - w.y1))) ** 2 <= 3600.5)"""),
)
def floating_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wall ends that are farther than a tolerance from every other wall of the plan."""
    walls = view(spark, sf_dir, "walls")
    one = lambda side, x, y: walls.select("plan_id", "idx", F.lit(side).alias("side"), _C(x).alias("x"), _C(y).alias("y"))
    ends = one(0, "x1", "y1").unionAll(one(1, "x2", "y2"))
    other = walls.where("NOT (x1 = x2 AND y1 = y2)").select("plan_id", _C("idx").alias("j"), "x1", "y1", "x2", "y2")
    d = geom.to_segment(_C("x"), _C("y"), _C("x1"), _C("y1"), _C("x2"), _C("y2"))
    return ends.join(other, (ends["plan_id"] == other["plan_id"]) & (_C("idx") != _C("j")) & (d * d <= 3600.5), "left_anti").select("plan_id", "idx", "side")


sql_query(
    "midspan_crossings",
    """WITH s AS (SELECT plan_id, idx, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1, CAST(x2 AS BIGINT) AS x2, CAST(y2 AS BIGINT) AS y2 FROM walls WHERE cv = 0)
    SELECT a.plan_id, a.idx AS i, b.idx AS j FROM s a JOIN s b ON a.plan_id = b.plan_id AND a.idx < b.idx
    WHERE ((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1)) * ((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) < 0
    AND ((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1)) * ((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1)) < 0""",
)
sql_query(
    "line_intersections",
    """WITH s AS (SELECT plan_id, idx, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM walls),
    p AS (SELECT a.plan_id, a.idx AS i, b.idx AS j, a.x1, a.y1, a.x2, a.y2, b.x1 AS u1, b.y1 AS v1, b.x2 AS u2, b.y2 AS v2,
        (a.x1 - a.x2) * (b.y1 - b.y2) - (a.y1 - a.y2) * (b.x1 - b.x2) AS det FROM s a JOIN s b ON a.plan_id = b.plan_id AND a.idx < b.idx)
    SELECT plan_id, i, j, round(((x1 * y2 - y1 * x2) * (u1 - u2) - (x1 - x2) * (u1 * v2 - v1 * u2)) / det, 3) AS x,
    round(((x1 * y2 - y1 * x2) * (v1 - v2) - (y1 - y2) * (u1 * v2 - v1 * u2)) / det, 3) AS y FROM p WHERE abs(det) > 1000""",
)
sql_query(
    "room_walls_within",
    """SELECT r.plan_id, r.room, count(*) AS n_walls, min(w.idx) AS first_wall, max(w.idx) AS last_wall FROM rooms r JOIN walls w ON r.plan_id = w.plan_id
    AND greatest(r.x0 - greatest(w.x1, w.x2), least(w.x1, w.x2) - r.x1, 0) <= 2 * w.th AND greatest(r.y0 - greatest(w.y1, w.y2), least(w.y1, w.y2) - r.y1, 0) <= 2 * w.th
    GROUP BY r.plan_id, r.room""",
)
sql_query(
    "id_remap_join",
    """WITH final AS (SELECT plan_id, idx AS src, row_number() OVER (PARTITION BY plan_id ORDER BY y1, x1, idx) AS id FROM walls WHERE NOT (x1 = x2 AND y1 = y2)),
    refs AS (SELECT DISTINCT plan_id, kind AS label, idx % 6 + 1 AS src FROM walls WHERE kind IS NOT NULL)
    SELECT r.plan_id, label, count(*) AS n_refs, CAST(sum(id) AS BIGINT) AS id_sum FROM refs r JOIN final f ON r.plan_id = f.plan_id AND r.src = f.src GROUP BY r.plan_id, label HAVING count(*) >= 2""",
)
sql_query(
    "room_pairs",
    """SELECT a.plan_id, a.room AS room_a, b.room AS room_b, CAST(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS BIGINT) AS overlap
    FROM rooms a JOIN rooms b ON a.plan_id = b.plan_id AND a.room < b.room""",
)
sql_query(
    "duplicate_walls",
    """WITH k AS (SELECT plan_id, idx, least(x1, x2) AS a, greatest(x1, x2) AS b, least(y1, y2) AS c FROM walls)
    SELECT DISTINCT t.plan_id, t.idx FROM k s JOIN k t ON s.plan_id = t.plan_id AND s.idx < t.idx AND abs(s.a - t.a) <= 60 AND abs(s.b - t.b) <= 60 AND abs(s.c - t.c) <= 60""",
)
sql_query(
    "rectangle_adjacency",
    """SELECT a.plan_id, a.room AS left_room, min(b.room) AS right_room FROM rooms a JOIN rooms b ON a.plan_id = b.plan_id AND a.room <> b.room
    AND abs(a.x1 - b.x0) <= 40 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0 GROUP BY a.plan_id, a.room""",
)
sql_query(
    "incidence_join",
    """WITH plane_line AS (SELECT plan_id, kind AS plane, idx AS line FROM walls WHERE kind IS NOT NULL),
    line_junction AS (SELECT plan_id, idx AS line, x1 % 10 AS junction FROM walls UNION ALL SELECT plan_id, idx, x2 % 10 FROM walls)
    SELECT p.plan_id, plane, count(DISTINCT junction) AS junctions, count(DISTINCT p.line) AS lines FROM plane_line p JOIN line_junction j ON p.plan_id = j.plan_id AND p.line = j.line GROUP BY p.plan_id, plane""",
)

# ---- ordered operators ----------------------------------------------------------------------------------------------

_ORDERED = """ordered AS (SELECT plan_id, idx, th, cv, kind, width, off,
    CASE WHEN x1 < x2 OR (x1 = x2 AND y1 <= y2) THEN x1 ELSE x2 END AS ax, CASE WHEN x1 < x2 OR (x1 = x2 AND y1 <= y2) THEN y1 ELSE y2 END AS ay,
    CASE WHEN x1 < x2 OR (x1 = x2 AND y1 <= y2) THEN x2 ELSE x1 END AS bx, CASE WHEN x1 < x2 OR (x1 = x2 AND y1 <= y2) THEN y2 ELSE y1 END AS by_,
    NOT (x1 < x2 OR (x1 = x2 AND y1 <= y2)) AS flipped, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len
    FROM walls WHERE NOT (x1 = x2 AND y1 = y2)),
    ranked AS (SELECT plan_id, idx, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY floor(least(ay, by_) / 40.0), least(ax, bx), least(ay, by_), greatest(ax, bx), greatest(ay, by_), idx) AS INT) AS id,
    ax, ay, bx, by_, th, CASE WHEN flipped THEN -cv ELSE cv END AS cv, kind, width,
    CAST(CASE WHEN flipped THEN greatest(0, least(1000, {even}(len - off))) ELSE off END AS INT) AS place FROM ordered)"""


def canonical_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walls with ordered endpoints, mirrored offsets and curvature, in reading order: bands of 4 % of the grid, then x."""
    w = view(spark, sf_dir, "walls").where("NOT (x1 = x2 AND y1 = y2)")
    first = F.struct(_C("x1").alias("x"), _C("y1").alias("y"))
    second = F.struct(_C("x2").alias("x"), _C("y2").alias("y"))
    flipped = ~(first <= second)
    length = geom.distance(_C("x1"), _C("y1"), _C("x2"), _C("y2"))
    w = w.select(
        "plan_id", "idx", "th", "kind", "width", F.least(first, second).alias("a"), F.greatest(first, second).alias("b"),
        F.when(flipped, -_C("cv")).otherwise(_C("cv")).alias("cv"), F.when(flipped, geom.clamp_grid(length - _C("off"))).otherwise(_C("off")).alias("place"),
    )
    top = F.least("a.y", "b.y")
    order = Window.partitionBy("plan_id").orderBy(F.floor(top / 40), "a.x", top, "b.x", F.greatest("a.y", "b.y"), "idx")
    return w.select("plan_id", "idx", F.row_number().over(order).alias("id"), _C("a.x").alias("ax"), _C("a.y").alias("ay"), _C("b.x").alias("bx"), _C("b.y").alias("by_"), "th", "cv", "kind", "width", "place")


_RANKED = _ORDERED.replace("{even}", "round_even").replace("round_even(len - off)", "round_even(len - off, 0)")
query("canonical_walls", with_views(f"WITH {_RANKED} SELECT * FROM ranked"))(canonical_walls)


def _target(id_, ax, ay, bx, by_, th, cv, kind, place, width):
    """Minified wall object; curvature from 0.02 on and openings appear only where there are any."""
    wall = F.struct(
        id_.alias("id"), F.array(ax, ay, bx, by_).alias("cl"), th.alias("th"), F.when(F.abs(cv) >= 20, cv / 1000.0).alias("cv"),
        F.when(kind.isNotNull(), F.array(F.struct(kind.alias("t"), place.alias("c"), width.alias("w")))).alias("op"),
    )
    return wall


@query(
    "plan_targets",
    with_views(f"""WITH {_RANKED}
    SELECT plan_id, count(*) AS n_walls, '{{"n":' || count(*) || ',"walls":[' || string_agg('{{"id":' || id || ',"cl":[' || ax || ',' || ay || ',' || bx || ',' || by_ || '],"th":' || th ||
    CASE WHEN abs(cv) >= 20 THEN ',"cv":' || CAST(cv / 1000.0 AS DOUBLE) ELSE '' END || CASE WHEN kind IS NOT NULL THEN ',"op":[{{"t":"' || kind || '","c":' || place || ',"w":' || width || '}}]' ELSE '' END || '}}', ',' ORDER BY id) || ']}}' AS target
    FROM ranked GROUP BY plan_id"""),
)
def plan_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One minified target string per plan, count first, walls in reading order."""
    w = canonical_walls(spark, sf_dir)
    wall = _target(*(_C(c) for c in ("id", "ax", "ay", "bx", "by_", "th", "cv", "kind", "place", "width")))
    plans = w.groupBy("plan_id").agg(F.array_sort(F.collect_list(wall)).alias("walls"))
    return plans.select("plan_id", F.size("walls").cast("long").alias("n_walls"), F.to_json(F.struct(F.size("walls").alias("n"), _C("walls"))).alias("target"))


@query(
    "canonical_targets",
    with_views(f"""WITH {_RANKED}, p AS (SELECT plan_id, count(*) AS n, CAST(sum(id * (ax + 3 * ay + 5 * bx + 7 * by_)) AS BIGINT) AS mark, count(kind) AS openings FROM ranked GROUP BY plan_id),
    s AS (SELECT *, CASE WHEN ('0x' || substr(md5('0:' || CAST(plan_id AS VARCHAR)), 1, 8))::BIGINT / 4294967295.0 < 0.15 THEN 'val' ELSE 'train' END AS split FROM p)
    SELECT split, count(*) AS plans, CAST(sum(n) AS BIGINT) AS walls, CAST(sum(openings) AS BIGINT) AS openings, round(avg(n), 4) AS mean_walls,
    quantile_cont(n, 0.5) AS median_walls, max(n) AS most_walls, CAST(sum(mark % 1000003) AS BIGINT) AS mark FROM s GROUP BY split"""),
)
def canonical_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship report: canonical walls to plans, hash split, sizes per split."""
    from plinth.plans.relational import split_of

    mark = _C("id") * (_C("ax") + 3 * _C("ay") + 5 * _C("bx") + 7 * _C("by_"))
    plans = canonical_walls(spark, sf_dir).groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"), F.sum(mark.cast("long")).alias("mark"), F.count("kind").alias("openings"))
    return plans.groupBy(split_of(F.concat(F.lit("0:"), _C("plan_id")), 0.15).alias("split")).agg(
        F.count(F.lit(1)).alias("plans"), F.sum("n").alias("walls"), F.sum("openings").alias("openings"), F.round(F.avg("n"), 4).alias("mean_walls"),
        F.expr("percentile(n, 0.5)").alias("median_walls"), F.max("n").alias("most_walls"), F.sum(_C("mark") % 1000003).alias("mark"),
    )


sql_query(
    "clockwise_border",
    """WITH m AS (SELECT plan_id, idx, (x1 + x2) / 2.0 AS mx, (y1 + y2) / 2.0 AS my, avg((x1 + x2) / 2.0) OVER (PARTITION BY plan_id) AS cx, avg((y1 + y2) / 2.0) OVER (PARTITION BY plan_id) AS cy FROM walls),
    a AS (SELECT plan_id, idx, round(CASE WHEN atan2(mx - cx, cy - my) < 0 THEN atan2(mx - cx, cy - my) + 2 * pi() ELSE atan2(mx - cx, cy - my) END, 9) AS angle FROM m)
    SELECT plan_id, idx, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY angle, idx) AS INT) AS turn FROM a""",
)
sql_query(
    "interval_union",
    """WITH s AS (SELECT plan_id, least(x1, x2) AS lo, greatest(x1, x2) AS hi, idx FROM walls),
    m AS (SELECT *, max(hi) OVER (PARTITION BY plan_id ORDER BY lo, hi, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
    i AS (SELECT *, sum(CASE WHEN reach >= lo THEN 0 ELSE 1 END) OVER (PARTITION BY plan_id ORDER BY lo, hi, idx ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT plan_id, min(lo) AS lo, max(hi) AS hi, count(*) AS parts FROM i GROUP BY plan_id, island""",
)
sql_query(
    "interval_intersect",
    """WITH a AS (SELECT plan_id, idx, least(x1, x2) AS lo, greatest(x1, x2) AS hi FROM walls WHERE kind = 'door'),
    b AS (SELECT plan_id, idx, least(y1, y2) AS lo, greatest(y1, y2) AS hi FROM walls WHERE kind = 'window')
    SELECT a.plan_id, a.idx AS i, b.idx AS j, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM a JOIN b ON a.plan_id = b.plan_id AND a.lo < b.hi AND b.lo < a.hi""",
)
sql_query(
    "interval_subtract",
    """WITH base AS (SELECT plan_id, min(least(x1, x2)) AS lo, max(greatest(x1, x2)) AS hi FROM walls GROUP BY plan_id),
    cuts AS (SELECT plan_id, idx, least(x1, x2) AS lo, greatest(x1, x2) AS hi FROM walls WHERE kind IS NOT NULL),
    edges AS (SELECT b.plan_id, b.lo AS at_, b.hi AS upto, CAST(-1 AS INT) AS idx FROM base b UNION ALL SELECT c.plan_id, c.hi, c.hi, c.idx FROM cuts c),
    reach AS (SELECT plan_id, idx, lo, hi, max(hi) OVER (PARTITION BY plan_id ORDER BY lo, hi, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_ FROM cuts),
    gaps AS (SELECT r.plan_id, coalesce(r.before_, b.lo) AS lo, r.lo AS hi FROM reach r JOIN base b ON r.plan_id = b.plan_id
        UNION ALL SELECT b.plan_id, coalesce(max(c.hi), b.lo), b.hi FROM base b LEFT JOIN cuts c ON b.plan_id = c.plan_id GROUP BY b.plan_id, b.lo, b.hi)
    SELECT plan_id, lo, hi FROM gaps WHERE hi > lo""",
)
sql_query(
    "consecutive_edges",
    """SELECT plan_id, idx, x1, y1, coalesce(lead(x1) OVER (PARTITION BY plan_id ORDER BY idx), first_value(x1) OVER (PARTITION BY plan_id ORDER BY idx)) AS nx,
    coalesce(lead(y1) OVER (PARTITION BY plan_id ORDER BY idx), first_value(y1) OVER (PARTITION BY plan_id ORDER BY idx)) AS ny FROM walls""",
)
sql_query(
    "corner_runs",
    """WITH v AS (SELECT plan_id, idx, atan2(y2 - y1, x2 - x1) AS a, lag(atan2(y2 - y1, x2 - x1)) OVER (PARTITION BY plan_id ORDER BY idx) AS b FROM walls),
    f AS (SELECT plan_id, idx, CASE WHEN b IS NULL OR abs(a - b) > 0.6108652381980153 THEN 1 ELSE 0 END AS corner FROM v)
    SELECT plan_id, run, count(*) AS edges, min(idx) AS first_edge FROM (SELECT plan_id, idx, sum(corner) OVER (PARTITION BY plan_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM f) AS r GROUP BY plan_id, run""",
)
sql_query(
    "rank_quantile_rooms",
    """WITH a AS (SELECT plan_id, room, (x1 - x0) * (y1 - y0) AS area, row_number() OVER (PARTITION BY plan_id ORDER BY (x1 - x0) * (y1 - y0), room) AS k, count(*) OVER (PARTITION BY plan_id) AS n FROM rooms)
    SELECT plan_id, room, CAST(area AS BIGINT) AS area, CASE WHEN k <= greatest(1, CAST(floor(n / 4.0) AS BIGINT)) THEN 'small' WHEN k = n AND area > 12 THEN 'master' ELSE 'plain' END AS role FROM a""",
)
sql_query(
    "arc_length_locate",
    """WITH s AS (SELECT plan_id, idx, round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 6) AS len FROM walls),
    c AS (SELECT *, sum(len) OVER (PARTITION BY plan_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS upto, sum(len) OVER (PARTITION BY plan_id) AS total FROM s)
    SELECT plan_id, min(idx) AS segment, round(min(total) / 2, 3) AS place FROM c WHERE upto >= total / 2 GROUP BY plan_id""",
)
sql_query("first_seen_example", "SELECT event_type, min_by(event_id, ts) AS first_event, count(*) AS n FROM events GROUP BY event_type")
sql_query(
    "best_so_far",
    """WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS round_, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best FROM events)
    SELECT user_id, min(CASE WHEN best >= 90 THEN round_ END) AS stop_round, round(max(best), 6) AS best, count(*) AS rounds FROM r GROUP BY user_id""",
)

# ---- expressions ----------------------------------------------------------------------------------------------------


@query(
    "polygon_area",
    with_views("""WITH v AS (SELECT plan_id, CAST(x1 AS BIGINT) AS x, CAST(y1 AS BIGINT) AS y, coalesce(lead(x1) OVER w, first_value(x1) OVER w) AS nx, coalesce(lead(y1) OVER w, first_value(y1) OVER w) AS ny FROM walls WINDOW w AS (PARTITION BY plan_id ORDER BY idx))
    SELECT plan_id, sum(x * ny - y * nx) / 2.0 AS area FROM v GROUP BY plan_id"""),
)
def polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rings(spark, sf_dir).select("plan_id", geom.polygon_area(_C("ring")).alias("area"))


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first endpoints of a plan's walls as one ring."""
    ring = F.array_sort(F.collect_list(F.struct("idx", _C("x1").alias("x"), _C("y1").alias("y"))))
    return view(spark, sf_dir, "walls").groupBy("plan_id").agg(ring.alias("r")).select("plan_id", F.transform("r", lambda p: F.struct(p.x.cast("long").alias("x"), p.y.cast("long").alias("y"))).alias("ring"))


@query(
    "point_in_polygon",
    with_views("""WITH v AS (SELECT plan_id, CAST(x1 AS DOUBLE) AS x, CAST(y1 AS DOUBLE) AS y, coalesce(lead(x1) OVER w, first_value(x1) OVER w) AS nx, coalesce(lead(y1) OVER w, first_value(y1) OVER w) AS ny FROM walls WINDOW w AS (PARTITION BY plan_id ORDER BY idx))
    SELECT plan_id, sum(CASE WHEN (y > 500.5) <> (ny > 500.5) AND 500.25 < (nx - x) * (500.5 - y) / (ny - y) + x THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM v GROUP BY plan_id"""),
)
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rings(spark, sf_dir).select("plan_id", geom.in_polygon(F.lit(500.25), F.lit(500.5), _C("ring")).alias("inside"))


@query(
    "segment_projection",
    with_views("""SELECT plan_id, idx, round(greatest(0.0, least(1.0, ((500 - x1) * (x2 - x1) + (500 - y1) * (y2 - y1)) * 1.0 / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))), 6) AS t FROM walls WHERE NOT (x1 = x2 AND y1 = y2)"""),
)
def segment_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = geom.along(F.lit(500), F.lit(500), _C("x1"), _C("y1"), _C("x2"), _C("y2"))
    return view(spark, sf_dir, "walls").where("NOT (x1 = x2 AND y1 = y2)").select("plan_id", "idx", F.round(t, 6).alias("t"))


@query(
    "arc_geometry",
    with_views("""SELECT plan_id, idx, round(cv / 1000.0 * 50, 4) AS bulge, round(sqrt(CAST((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS DOUBLE)) * (40000 + cv * cv) / (800.0 * abs(cv)), 1) AS radius, 25 AS points FROM walls WHERE cv <> 0 AND NOT (x1 = x2 AND y1 = y2)"""),
)
def arc_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs from endpoints and curvature; the curvature fitted to the arc's points, and the radius from chord and bulge."""
    k = _C("cv") / 1000.0 * 5
    w = view(spark, sf_dir, "walls").where("cv <> 0 AND NOT (x1 = x2 AND y1 = y2)").withColumn("p", geom.arc_points(_C("x1"), _C("y1"), _C("x2"), _C("y2"), k))
    chord2 = (_C("x2") - _C("x1")) * (_C("x2") - _C("x1")) + (_C("y2") - _C("y1")) * (_C("y2") - _C("y1"))
    radius = F.sqrt(chord2.cast("double")) * (40000 + _C("cv") * _C("cv")) / (800.0 * F.abs("cv"))  # L (1 + k^2) / 4k at k = cv / 200
    return w.select("plan_id", "idx", F.round(geom.fit_curvature(_C("p")) * 10, 4).alias("bulge"), F.round(radius, 1).alias("radius"), F.size("p").alias("points"))


@query(
    "model_px_transform",
    with_views("SELECT plan_id, idx, round((x1 * cos(radians(30)) - y1 * 0.5 + 400) * 0.25, 3) AS px, round(500 - (x1 * 0.5 + y1 * cos(radians(30)) + 100) * 0.25, 3) AS py FROM walls"),
)
def model_px_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geom.turned(_C("x1"), _C("y1"), F.lit(30.0))
    px, py = geom.to_pixel(x, y, 0.25, -400, -100, 500)
    return view(spark, sf_dir, "walls").select("plan_id", "idx", F.round(px, 3).alias("px"), F.round(py, 3).alias("py"))


@query(
    "angle_wrap",
    with_views("SELECT plan_id, idx, round(CASE WHEN a >= pi() THEN a - 2 * pi() WHEN a < -pi() THEN a + 2 * pi() ELSE a END, 9) AS angle FROM (SELECT plan_id, idx, atan2(y2 - y1, x2 - x1) * 1.5 AS a FROM walls) AS t"),
)
def angle_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "walls").select("plan_id", "idx", F.round(geom.wrap(F.atan2(_C("y2") - _C("y1"), _C("x2") - _C("x1")) * 1.5), 9).alias("angle"))


@query(
    "grid_snap",
    with_views("SELECT plan_id, idx, CAST(greatest(0, least(1000, round_even((x1 - 20) * 1024 / 1000.0, 0))) AS INT) AS clamped, CAST(round_even(y1 / 50.0, 0) * 50 AS INT) AS snapped FROM walls"),
)
def grid_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "walls").select("plan_id", "idx", geom.clamp_grid((_C("x1") - 20) * 1024 / 1000.0).alias("clamped"), geom.snap(_C("y1")).alias("snapped"))


@query(
    "affine_fit",
    with_views("""WITH s AS (SELECT plan_id, count(*) AS n, sum(x1) AS sx, sum(y1) AS sy, sum(x1 * x1) AS sxx, sum(y1 * y1) AS syy, sum(x1 * y1) AS sxy, sum(u) AS su, sum(x1 * u) AS sxu, sum(y1 * u) AS syu
    FROM (SELECT plan_id, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(2 * x1 - y1 + x2 % 50 AS DOUBLE) AS u FROM walls) AS w GROUP BY plan_id HAVING count(*) >= 3),
    d AS (SELECT *, n * (sxx * syy - sxy * sxy) - sx * (sx * syy - sxy * sy) + sy * (sx * sxy - sxx * sy) AS det FROM s)
    SELECT plan_id, round((n * (sxu * syy - sxy * syu) - su * (sx * syy - sxy * sy) + sy * (sx * syu - sxu * sy)) / det, 4) + 0.0 AS a,
        round((su * (sxx * syy - sxy * sxy) - sx * (sxu * syy - sxy * syu) + sy * (sxu * sxy - sxx * syu)) / det, 2) + 0.0 AS c,
        round((n * (sxx * syu - sxu * sxy) - sx * (sx * syu - sxu * sy) + su * (sx * sxy - sxx * sy)) / det, 4) + 0.0 AS b FROM d WHERE abs(det) > 1000000000"""),
)
def affine_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares of u = a x + b y + c from at least 3 pairs, by sums in one aggregation and a closed solution."""
    x, y = _C("x1").cast("double"), _C("y1").cast("double")
    u = (2 * _C("x1") - _C("y1") + _C("x2") % 50).cast("double")
    sums = {"n": F.lit(1.0), "sx": x, "sy": y, "sxx": x * x, "syy": y * y, "sxy": x * y, "su": u, "sxu": x * u, "syu": y * u}
    s = view(spark, sf_dir, "walls").groupBy("plan_id").agg(*(F.sum(v).alias(k) for k, v in sums.items())).where("n >= 3")
    n, sx, sy, sxx, syy, sxy, su, sxu, syu = (_C(k) for k in sums)
    det3 = lambda a, b, c, d, e, f, g, h, i: a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    det = det3(n, sx, sy, sx, sxx, sxy, sy, sxy, syy)
    solved = s.where(F.abs(det) > 1e9)
    return solved.select(
        "plan_id",
        (F.round(det3(n, su, sy, sx, sxu, sxy, sy, syu, syy) / det, 4) + 0.0).alias("a"),
        (F.round(det3(n, sx, su, sx, sxx, sxu, sy, sxy, syu) / det, 4) + 0.0).alias("b"),
        (F.round(det3(su, sx, sy, sxu, sxx, sxy, syu, sxy, syy) / det, 2) + 0.0).alias("c"),
    )


@query(
    "yolo_lines",
    with_views("""SELECT plan_id, opening, printf('%d %.6f %.6f %.6f %.6f', CASE WHEN kind = 'window' THEN 1 ELSE 0 END, least(1.0, px / 1000.0), least(1.0, py / 1000.0), least(1.0, width / 1000.0), least(1.0, greatest(0.03, width / 4000.0))) AS line,
    width / 1000.0 < 0.03 OR width / 4000.0 < 0.03 AS small FROM openings"""),
)
def yolo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines `class cx cy w h`, clamped to [0, 1] at 6 decimals, with the small-box warning."""
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    cls = F.when(_C("kind") == "window", 1).otherwise(0)
    w, h = _C("width") / 1000.0, _C("width") / 4000.0
    line = F.format_string("%d %.6f %.6f %.6f %.6f", cls, unit(_C("px") / 1000.0), unit(_C("py") / 1000.0), unit(w), unit(F.greatest(F.lit(0.03), h)))
    return view(spark, sf_dir, "openings").select("plan_id", "opening", line.alias("line"), ((w < 0.03) | (h < 0.03)).alias("small"))


@query(
    "shape_classes",
    with_views("""WITH c AS (SELECT plan_id, count(*) AS n, sum(CASE WHEN x1 = x2 OR y1 = y2 THEN 1 ELSE 0 END) AS ortho FROM walls GROUP BY plan_id)
    SELECT CASE WHEN n = 4 AND ortho = 4 THEN 'rectangle' WHEN n = 4 THEN 'quad' WHEN n = 6 AND ortho = 6 THEN 'l_shape' WHEN n = 8 AND ortho = 8 THEN 't_or_u_shape' ELSE 'polygon' END AS shape, count(*) AS n FROM c GROUP BY 1"""),
)
def shape_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "walls").groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"), F.sum(((_C("x1") == _C("x2")) | (_C("y1") == _C("y2"))).cast("int")).alias("ortho"))
    right = _C("n") == _C("ortho")
    shape = F.when((_C("n") == 4) & right, "rectangle").when(_C("n") == 4, "quad").when((_C("n") == 6) & right, "l_shape").when((_C("n") == 8) & right, "t_or_u_shape").otherwise("polygon")
    return c.groupBy(shape.alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "greedy_nearest_match",
    recursive("""t AS (SELECT plan_id AS pair, list({'kind': kind, 'x': px, 'y': py} ORDER BY opening) AS truth FROM openings GROUP BY plan_id),
    g AS (SELECT plan_id + 1 AS pair, list({'kind': kind, 'x': px, 'y': py} ORDER BY opening) AS guess FROM openings GROUP BY plan_id),
    f AS (SELECT pair, truth, guess, 1 AS k, CAST([] AS BIGINT[]) AS used FROM t JOIN g USING (pair)
        UNION ALL SELECT pair, truth, guess, k + 1, CASE WHEN best.d <= 60 THEN list_append(used, best.i) ELSE used END
        FROM (SELECT *, list_sort([{'d': sqrt((guess[i].x - truth[k].x) ** 2 + (guess[i].y - truth[k].y) ** 2), 'i': i} FOR i IN range(1, len(guess) + 1) IF guess[i].kind = truth[k].kind AND NOT list_contains(used, i)])[1] AS best FROM f WHERE k <= len(truth)) AS s)
    SELECT pair, CAST(len(truth) AS INT) AS n_true, CAST(len(guess) AS INT) AS n_pred, CAST(len(used) AS INT) AS tp FROM f WHERE k = len(truth) + 1"""),
)
def greedy_nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings matched one to one with those of the next plan, in order, each to the nearest free one of its kind within 60."""
    from plinth.operators.matching import greedy_matches

    o = view(spark, sf_dir, "openings")
    side = lambda name, key: o.select(key.alias("pair"), "opening", "kind", "px", "py").groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("opening", "kind", "px", "py"))).alias(name))
    pairs = side("truth", _C("plan_id")).join(side("guess", _C("plan_id") + 1), "pair")
    cost = lambda t, p: F.when(t.kind == p.kind, F.hypot((t.px - p.px).cast("double"), (t.py - p.py).cast("double")))
    used = greedy_matches(_C("truth"), _C("guess"), cost, 60.0)
    return pairs.select("pair", F.size("truth").alias("n_true"), F.size("guess").alias("n_pred"), F.size(used).alias("tp"))
