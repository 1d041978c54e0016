"""Text, JSON, graph, incremental and event queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.operators import incremental, labels, records
from plinth.planview import sql_query, table, view, with_views
from plinth.registry import query
from plinth.streaming import events as stream

_C = F.col


@query(
    "json_tolerant_parse",
    """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k, event_id % 3 <> 2 AS parsed FROM events""",
)
def json_tolerant_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON as it is, inside other text, or broken off: parsed, parsed by its outermost braces, null."""
    e = table(spark, sf_dir, "events")
    noisy = F.when(_C("event_id") % 3 == 0, _C("props")).when(_C("event_id") % 3 == 1, F.concat(F.lit("answer: "), "props", F.lit(" end."))).otherwise(F.expr("substr(props, 1, length(props) - 1)"))
    found = F.coalesce(F.try_parse_json(noisy), F.try_parse_json(F.nullif(F.regexp_extract(noisy, r"(?s)\{.*\}", 0), F.lit(""))))
    return e.select("event_id", F.try_variant_get(found, "$.k", "long").alias("k"), found.isNotNull().alias("parsed"))


@query(
    "markup_extract",
    """SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(html, '<a href="([^"]*)"')) AS links,
    regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages""",
)
def markup_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    count = lambda pattern: F.size(F.regexp_extract_all("html", F.lit(pattern), F.lit(0))).cast("long")
    return p.select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), count("<p>").alias("paragraphs"), count('<a href="([^"]*)"').alias("links"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"))


@query(
    "chat_records",
    """SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, string_agg(role || ':' || CAST(length(text) AS VARCHAR), '|' ORDER BY turn) AS shape FROM conversations GROUP BY conv_id""",
)
def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a conversation in order of turn."""
    messages = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(messages.alias("m"))
    shape = F.array_join(F.transform("m", lambda x: F.concat(x.role, F.lit(":"), F.length(x.text))), "|")
    return c.select("conv_id", F.size("m").cast("long").alias("n_turns"), shape.alias("shape"))


@query(
    "number_list_parse",
    """SELECT doc_id, len(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda w: length(w) > 5)) AS long_words FROM documents""",
)
def number_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(words, lambda w: F.length(w) > 5)).cast("long").alias("long_words"))


@query(
    "point_list_parse",
    with_views("""SELECT plan_id, count(*) AS points, CAST(sum(x1 + y1) AS BIGINT) AS total FROM walls GROUP BY plan_id HAVING count(*) >= 3"""),
)
def point_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point lists `x,y x,y` with a bad token among them: pairs of numbers stay, at least three are needed."""
    text = F.concat_ws(" ", F.sort_array(F.collect_list(F.concat_ws(",", "x1", "y1"))), F.lit("x,?"), F.lit(""))
    lists = view(spark, sf_dir, "walls").groupBy("plan_id").agg(text.alias("t"))
    pairs = F.filter(F.transform(F.split("t", " "), lambda p: F.transform(F.split(p, ","), lambda v: v.try_cast("double"))), lambda p: (F.size(p) == 2) & F.forall(p, lambda v: v.isNotNull()))
    total = F.aggregate(F.flatten(pairs), F.lit(0.0), lambda a, v: a + v)
    return lists.where(F.size(pairs) >= 3).select("plan_id", F.size(pairs).cast("long").alias("points"), total.cast("long").alias("total"))


@query("scale_parse", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(doc_id % 500 + 1 AS INT) END AS scale FROM documents")
def scale_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(_C("doc_id") % 4 == 0, F.lit("1-100")).otherwise(F.concat(F.lit("1:"), _C("doc_id") % 500 + 1))
    return table(spark, sf_dir, "documents").select("doc_id", labels.scale_of(text).alias("scale"))


@query(
    "string_helpers",
    """SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS file_no, upper(substr(p_type, 1, 1)) || lower(substr(split_part(p_type, ' ', 1), 2)) AS title, split_part(p_name, ' ', 1) AS first_word, md5(p_brand) AS mark,
    CASE WHEN contains(lower(p_type), 'small') THEN 'window' ELSE 'door' END AS kind FROM part""",
)
def string_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.lower("p_type").contains("small"), "window").otherwise("door")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.format_string("%07d", "p_partkey").alias("file_no"), F.initcap(F.element_at(F.split("p_type", " "), 1)).alias("title"),
        F.substring_index("p_name", " ", 1).alias("first_word"), F.md5("p_brand").alias("mark"), kind.alias("kind"),
    )


sql_query(
    "refine_feedback",
    """SELECT user_id, CASE WHEN m = '' THEN 'fine' ELSE m END AS said FROM (SELECT user_id, concat_ws(' ', CASE WHEN count(*) > 12 THEN 'many' END, CASE WHEN avg(value) < 50 THEN 'low' END, CASE WHEN count(DISTINCT event_type) < 3 THEN 'uniform' END) AS m FROM events GROUP BY user_id) AS t""",
)


@query(
    "room_components",
    with_views("""WITH RECURSIVE e AS (SELECT DISTINCT plan_id, x1 % 8 AS a, x2 % 8 AS b FROM walls), u AS (SELECT * FROM e UNION SELECT plan_id, b, a FROM e), n AS (SELECT DISTINCT plan_id, a FROM u),
    r(plan_id, a, b) AS (SELECT plan_id, a, a FROM n UNION SELECT r.plan_id, r.a, u.b FROM r JOIN u ON r.plan_id = u.plan_id AND r.b = u.a)
    SELECT plan_id, count(DISTINCT c) AS components, count(*) AS nodes FROM (SELECT plan_id, a, min(b) AS c FROM r GROUP BY plan_id, a) AS t GROUP BY plan_id""").replace("WITH walls", "WITH RECURSIVE walls").replace(", RECURSIVE e", ", e"),
)
def room_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected sets of a plan's small graph, by folding its edges into labels inside a row."""
    edges = view(spark, sf_dir, "walls").groupBy("plan_id").agg(F.collect_set(F.struct((_C("x1") % 8).alias("a"), (_C("x2") % 8).alias("b"))).alias("e"))
    start = F.map_from_entries(F.array_distinct(F.flatten(F.transform("e", lambda x: F.array(F.struct(x.a.alias("k"), x.a.alias("v")), F.struct(x.b.alias("k"), x.b.alias("v")))))))
    merged = F.aggregate("e", start, lambda m, x: F.transform_values(m, lambda k, v: F.when(v == F.greatest(m[x.a], m[x.b]), F.least(m[x.a], m[x.b])).otherwise(v)))
    labelled = edges.select("plan_id", F.map_values(merged).alias("l"))
    return labelled.select("plan_id", F.size(F.array_distinct("l")).cast("long").alias("components"), F.size("l").cast("long").alias("nodes"))


@query(
    "reachability",
    """WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 40 AS b FROM nation WHERE n_nationkey % 4 <> 3), r(a) AS (SELECT 0 UNION SELECT e.b FROM r JOIN e ON r.a = e.a)
    SELECT n_nationkey, n_nationkey IN (SELECT a FROM r) AS reached FROM nation""",
)
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be reached from a start, by rounds over the frontier until it is empty; each round's plan is cut where the
    session names a checkpoint folder."""
    cut = (lambda df: df.checkpoint()) if spark.sparkContext.getCheckpointDir() else (lambda df: df)
    nation = table(spark, sf_dir, "nation")
    edges = nation.where("n_nationkey % 4 <> 3").select(_C("n_nationkey").alias("a"), ((_C("n_nationkey") * 3 + 1) % 40).alias("b"))
    reached = frontier = spark.range(1).select(_C("id").cast("int").alias("a"))
    while True:
        frontier = cut(frontier.join(edges, "a").select(_C("b").alias("a")).distinct().join(reached, "a", "left_anti"))
        if frontier.isEmpty():
            break
        reached = cut(reached.unionAll(frontier))
    return nation.join(reached.withColumnRenamed("a", "n_nationkey").withColumn("hit", F.lit(True)), "n_nationkey", "left").select("n_nationkey", F.coalesce("hit", F.lit(False)).alias("reached"))


sql_query("degree_report", "SELECT c_nationkey, count(*) AS degree, min(c_custkey) AS first_customer FROM customer GROUP BY c_nationkey")
sql_query("isolated_nodes", "SELECT n_nationkey FROM nation n WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000)")


@query("latest_checkpoint", "SELECT 'run/checkpoint-' || max(doc_id) AS path, max(doc_id) AS step FROM documents")
def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "documents").select(F.concat(F.lit("run/checkpoint-"), "doc_id").alias("path"))
    return incremental.latest_checkpoint(paths.unionAll(spark.range(1).select(F.lit("run/checkpoint-final").alias("path"))))


@query("resume_antijoin", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")


@query(
    "event_windows",
    "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.windowed(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query(
    "event_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.sessions(table(spark, sf_dir, "events"))


sql_query(
    "event_as_of",
    """WITH p AS (SELECT user_id, ts, value, event_id, max(CASE WHEN event_type = 'purchase' THEN NULL ELSE event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_event, event_type FROM events)
    SELECT event_id, before_event FROM p WHERE event_type = 'purchase'""",
)


@query("walls_only_projection", "SELECT doc_id, '{\"walls\":[{\"id\":' || doc_id || ',\"start\":[0,0]}]}' AS kept FROM documents")
def walls_only_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations cut down to wall keys, by a typed parse and print."""
    text = F.concat(F.lit('{"walls":[{"id":'), "doc_id", F.lit(',"start":[0,0],"openings":[1]}],"rooms":[]}'))
    schema = "walls array<struct<id:bigint,start:array<int>,`end`:array<int>,thickness:int,curvature:double>>"
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.to_json(records.tolerant(text, schema)), text).alias("kept"))
