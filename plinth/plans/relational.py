"""Reports, lookups, limits and set operations over plans (aggregation, sort and set rows of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.functions import taxonomy
from plinth.operators.numbering import gapless, within
from plinth.planview import sql_query, table, view, with_views
from plinth.registry import query

_C = F.col



@query(
    "report_merge_equals_oneshot",
    """SELECT count(*) AS plans, CAST(sum(n) AS BIGINT) AS walls, round(sum(n) * 1.0 / greatest(count(*), 1), 2) AS mean_walls,
    round(100.0 * sum(CASE WHEN curved > 0 THEN 1 ELSE 0 END) / greatest(count(*), 1), 1) AS pct_curved
    FROM (SELECT l_orderkey, count(*) AS n, sum(CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END) AS curved FROM lineitem GROUP BY l_orderkey) AS t""",
)
def report_merge_equals_oneshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial reports per shard of plans, merged, then finalised with a denominator of at least 1."""
    per_plan = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("l_partkey") % 5 == 0).cast("int")).alias("curved"))
    partial = per_plan.groupBy(F.pmod(F.xxhash64("l_orderkey"), F.lit(64)).alias("shard")).agg(F.count(F.lit(1)).alias("plans"), F.sum("n").alias("walls"), F.sum("curved").alias("curved"))
    merged = partial.agg(F.sum("plans").alias("plans"), F.sum("walls").alias("walls"), F.sum("curved").alias("curved"))
    share = lambda a, scale: F.col(a) * scale / F.greatest(F.col("plans"), F.lit(1))
    return merged.select("plans", "walls", F.round(share("walls", 1.0), 2).alias("mean_walls"), F.round(share("curved", 100.0), 1).alias("pct_curved"))



sql_query(
    "nan_safe_means",
    """SELECT event_type, count(*) AS n, round(coalesce(avg(CASE WHEN value > 20 THEN value END), -1), 6) AS mean_kept,
    sum(CASE WHEN value > 20 THEN 0 ELSE 1 END) AS dropped FROM events GROUP BY event_type""",
)


@query(
    "metric_means",
    """SELECT toxic, count(*) AS n, round(avg(m), 6) AS mean_metric, count(m) AS scored FROM
    (SELECT toxic, CASE WHEN quality = 1 THEN (doc_id % 17) / 16.0 END AS m FROM labels) AS t GROUP BY toxic""",
)
def metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means where NaN stands for not applicable: NaN becomes null, so it neither counts nor spreads."""
    metric = F.when(F.col("quality") == 1, (F.col("doc_id") % 17) / 16.0).otherwise(F.lit(float("nan")))
    m = F.nullif(metric, F.lit(float("nan")))
    return table(spark, sf_dir, "labels").groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(m), 6).alias("mean_metric"), F.count(m).alias("scored"))


@query(
    "median_upper_vs_mid",
    """SELECT o_orderpriority, count(*) AS n, round(quantile_cont(o_totalprice, 0.5), 4) AS mid_median,
    round(list_sort(list(o_totalprice))[count(*) // 2 + 1], 4) AS upper_median, round(max(o_totalprice), 4) AS top FROM orders GROUP BY o_orderpriority""",
)
def median_upper_vs_mid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle-pair median, and the upper one as the row of rank n div 2 (by rank, never by a collected list)."""
    orders = table(spark, sf_dir, "orders")
    sizes = orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.expr("percentile(o_totalprice, 0.5)"), 4).alias("mid_median"), F.max("o_totalprice").alias("_top"))
    counted = orders.groupBy("o_orderpriority", "o_totalprice").agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(Window.partitionBy("o_orderpriority").orderBy("o_totalprice"))
    ranked = counted.withColumn("upto", upto).join(F.broadcast(sizes), "o_orderpriority").where(F.col("upto") > F.expr("n div 2"))
    return ranked.groupBy("o_orderpriority", "n", "mid_median", F.round("_top", 4).alias("top")).agg(F.round(F.min("o_totalprice"), 4).alias("upper_median"))


sql_query(
    "distinct_dimensions",
    """SELECT plan_id, count(DISTINCT th) AS thicknesses, count(DISTINCT CASE WHEN kind = 'door' THEN width END) AS door_widths,
    count(DISTINCT CASE WHEN kind = 'window' THEN width END) AS window_widths FROM walls GROUP BY plan_id
    HAVING count(DISTINCT th) >= 3""",
)

sql_query(
    "status_counts",
    """SELECT split, status, count(*) AS n, sum(doors) AS doors, sum(windows) AS windows FROM (
    SELECT plan_id, CASE WHEN plan_id % 20 < 3 THEN 'val' ELSE 'train' END AS split,
        CASE WHEN count(*) = 1 THEN 'skipped' WHEN max(th) > 19 THEN 'failed' ELSE 'rendered' END AS status,
        sum(CASE WHEN kind = 'door' THEN 1 ELSE 0 END) AS doors, sum(CASE WHEN kind = 'window' THEN 1 ELSE 0 END) AS windows
    FROM walls GROUP BY plan_id) AS t GROUP BY split, status""",
)

sql_query(
    "global_bbox",
    """SELECT plan_id, min(least(x1, x2)) AS x0, min(least(y1, y2)) AS y0, max(greatest(x1, x2)) AS x1, max(greatest(y1, y2)) AS y1,
    round(avg((x1 + x2) / 2.0), 4) AS cx, round(avg((y1 + y2) / 2.0), 4) AS cy FROM walls GROUP BY plan_id""",
)

sql_query(
    "label_multiset_f1",
    """WITH p AS (SELECT l_orderkey AS plan_id, p_size % 7 AS label, count(*) AS k FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, p_size % 7),
    g AS (SELECT l_orderkey AS plan_id, p_size * 3 % 7 AS label, count(*) AS k FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, p_size * 3 % 7),
    j AS (SELECT coalesce(p.plan_id, g.plan_id) AS plan_id, coalesce(p.k, 0) AS pk, coalesce(g.k, 0) AS gk FROM p FULL OUTER JOIN g ON p.plan_id = g.plan_id AND p.label = g.label)
    SELECT plan_id, CAST(sum(least(pk, gk)) AS BIGINT) AS tp, CAST(sum(pk) AS BIGINT) AS n_pred, CAST(sum(gk) AS BIGINT) AS n_true,
    round(2.0 * sum(least(pk, gk)) / greatest(sum(pk) + sum(gk), 1), 6) AS f1 FROM j GROUP BY plan_id""",
)

sql_query(
    "duplicate_segments",
    """SELECT plan_id, count(*) AS n, round((count(*) - count(DISTINCT least(x1, x2) * 1000000 + greatest(x1, x2) * 1000 + th)) * 1.0 / count(*), 6) AS dup_fraction
    FROM (SELECT plan_id, CAST(floor(x1 / 50) AS BIGINT) AS x1, CAST(floor(x2 / 50) AS BIGINT) AS x2, CAST(floor(th / 5) AS BIGINT) AS th FROM walls) AS t GROUP BY plan_id""",
)

sql_query(
    "opening_totals",
    """SELECT plan_id, count(*) AS openings, CAST(sum(width) AS BIGINT) AS total_width, CAST(max(off + width) AS BIGINT) AS reach,
    sum(width) > 300 AS too_wide FROM walls WHERE kind IS NOT NULL GROUP BY plan_id""",
)

sql_query(
    "generation_summary",
    """SELECT count(*) AS plans, round(100.0 * sum(CASE WHEN attempts = 1 THEN 1 ELSE 0 END) / greatest(count(*), 1), 4) AS first_try_pct,
    CAST(sum(CASE WHEN attempts > 5 THEN 1 ELSE 0 END) AS BIGINT) AS fallbacks, round(avg(attempts), 6) AS mean_attempts, max(attempts) AS max_attempts
    FROM (SELECT plan_id, max(idx) AS attempts FROM walls GROUP BY plan_id) AS t""",
)

sql_query("weak_wall_count", "SELECT plan_id, count(*) AS n, sum(CASE WHEN off / 400.0 < 0.5 THEN 1 ELSE 0 END) AS weak FROM walls GROUP BY plan_id")


@query("taxonomy_lookup_default", taxonomy.ORACLE)
def taxonomy_lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw labels to the unified vocabulary by a map literal, `room` where unknown."""
    return table(spark, sf_dir, "part").groupBy(taxonomy.part_label(F.col("p_type")).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_part"))


sql_query(
    "three_way_id_join",
    """SELECT d.doc_id, l.quality, length(p.url) AS url_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id JOIN pages p ON d.doc_id = p.page_id""",
)
sql_query("id_intersection", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
sql_query("unlabelled_anti_join", "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
sql_query("labelled_semi_join", "SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
sql_query(
    "tagged_union",
    """SELECT source_name, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM (
    SELECT 'documents' AS source_name, length(text) AS chars FROM documents UNION ALL SELECT 'pages', length(html) FROM pages
    UNION ALL SELECT 'benchmark', length(text) FROM benchmark UNION ALL SELECT 'conversations', length(text) FROM conversations) AS t GROUP BY source_name""",
)
sql_query(
    "undirected_edge_dedup",
    """SELECT plan_id, a, b, min(idx) AS first_idx, count(*) AS n FROM (
    SELECT plan_id, idx, least(x1 % 40, x2 % 40) AS a, greatest(x1 % 40, x2 % 40) AS b FROM walls) AS t GROUP BY plan_id, a, b""",
)
sql_query("unreached_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")


@query(
    "label_jaccard",
    """WITH d AS (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS slot, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS s FROM documents),
    b AS (SELECT item_id, row_number() OVER (ORDER BY item_id, text) - 1 AS slot, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS s FROM benchmark)
    SELECT doc_id, item_id, CAST(len(list_intersect(d.s, b.s)) AS INT) AS both_n,
    round(len(list_intersect(d.s, b.s)) * 1.0 / greatest(len(d.s) + len(b.s) - len(list_intersect(d.s, b.s)), 1), 6) AS jaccard FROM d JOIN b ON d.slot = b.slot""",
)
def label_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set likeness of the words of every document and of its reference item: items are numbered and dealt out by turns."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))
    items = table(spark, sf_dir, "benchmark")
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % items.count()).alias("slot"), words(F.col("text")).alias("a"))
    order = Window.orderBy("item_id", "text")  # the benchmark alone
    b = items.select("item_id", (F.row_number().over(order) - 1).cast("long").alias("slot"), words(F.col("text")).alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return d.join(b, "slot").select("doc_id", "item_id", both.alias("both_n"), F.round(both / F.greatest(F.size("a") + F.size("b") - both, F.lit(1)), 6).alias("jaccard"))


@query(
    "required_keys",
    """SELECT event_id, CASE WHEN json_extract(props, '$.k') IS NULL THEN 'k' WHEN json_extract(props, '$.user') IS NULL THEN 'user' END AS first_missing FROM events""",
)
def required_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the required keys that a JSON object lacks."""
    keys = F.json_object_keys("props")
    missing = F.array_except(F.array(F.lit("k"), F.lit("user")), keys)
    return table(spark, sf_dir, "events").select("event_id", F.get(missing, 0).alias("first_missing"))


sql_query("ordered_ids", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS position, source FROM documents")
sql_query(
    "limit_per_source",
    "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) AS t WHERE k <= 5",
)
sql_query("top_one_of_n", "SELECT user_id, max_by(event_id, value * 1000000 + event_id) AS best_event, count(*) AS n FROM events GROUP BY user_id")
sql_query("top_k_worst", "SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 10")
sql_query(
    "longest_first",
    """SELECT plan_id, idx, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) DESC, idx) AS INT) AS length_rank FROM walls""",
)

@query(
    "strided_sample",
    "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS slot FROM documents) AS t WHERE slot % 7 = 0",
)
def strided_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh document of a language, in id order."""
    return within(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", "slot").where("slot % 7 = 0").select("doc_id")


sql_query(
    "shard_index",
    """SELECT o_orderkey, CAST(floor((o_orderkey - 1) / 500) AS BIGINT) AS shard_no, count(*) OVER (PARTITION BY CAST(floor((o_orderkey - 1) / 500) AS BIGINT)) AS in_shard FROM orders""",
)


@query(
    "hash_split",
    """SELECT split, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id,
    CASE WHEN ('0x' || substr(md5('7:plan_' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT / 4294967295.0 < 0.15 THEN 'val' ELSE 'train' END AS split FROM documents) AS t GROUP BY split""",
)
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split that depends on the id alone: stable under any partitioning or order."""
    return table(spark, sf_dir, "documents").groupBy(split_of(F.concat(F.lit("7:plan_"), F.col("doc_id")), 0.15).alias("split")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


def split_of(key, share: float):
    return F.when(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / 4294967295.0 < share, "val").otherwise("train")



@query(
    "seeded_holdout",
    """SELECT doc_id, source, CASE WHEN k <= greatest(1, CAST(floor(n * 0.03) AS BIGINT)) THEN 'val' ELSE 'train' END AS split FROM (
    SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(concat('0|', CAST(doc_id AS VARCHAR(20)))), doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents) AS t""",
)
def seeded_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact share of each source, at least one row, by rank of a seeded hash."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat_ws("|", F.md5(F.concat(F.lit("0|"), F.col("doc_id"))), F.col("doc_id")).alias("mark"))
    ranked = within(docs, "source", "mark", "k", "n")
    return ranked.select("doc_id", "source", F.when(_C("k") < F.greatest(F.lit(1), F.floor(_C("n") * 0.03)), "val").otherwise("train").alias("split"))


sql_query(
    "weighted_choice",
    """WITH u AS (SELECT doc_id, (doc_id * 7919 % 1000) / 1000.0 AS u FROM documents),
    w AS (SELECT * FROM (VALUES ('apartment', 0.0, 0.45), ('house', 0.45, 0.75), ('office', 0.75, 0.9), ('clinic', 0.9, 1.0)) AS v(kind, lo, hi))
    SELECT kind, count(*) AS n, min(doc_id) AS first_doc FROM u JOIN w ON u >= lo AND u < hi GROUP BY kind""",
)
sql_query(
    "negative_rows",
    """SELECT source, count(*) AS positives, CAST(floor(count(*) * 0.05 / (1 - 0.05)) AS BIGINT) AS negatives FROM documents GROUP BY source""",
)


@query(
    "catalogue_step_down",
    with_views(
        """SELECT plan_id, idx, (SELECT max(w) FROM (VALUES (20), (30), (40), (50), (60), (70), (80)) AS c(w) WHERE w <= least(width, round_even(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0))) AS fits
        FROM walls WHERE kind = 'door'"""
    ),
)
def catalogue_step_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest catalogue width that neither exceeds the preferred one nor the wall."""
    length = F.bround(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), 0).cast("int")
    sizes = F.array(*(F.lit(w) for w in (80, 70, 60, 50, 40, 30, 20)))
    fits = F.get(F.filter(sizes, lambda w: w <= F.least("width", length)), 0)
    return view(spark, sf_dir, "walls").where("kind = 'door'").select("plan_id", "idx", fits.alias("fits"))


sql_query(
    "size_caps",
    """SELECT source, count(*) AS n, sum(CASE WHEN length(text) <= 4000 THEN 1 ELSE 0 END) AS kept, sum(CASE WHEN length(text) > 4000 THEN 1 ELSE 0 END) AS dropped FROM documents GROUP BY source""",
)
sql_query("min_element_filter", "SELECT plan_id, count(*) AS n FROM walls WHERE NOT (x1 = x2 AND y1 = y2) GROUP BY plan_id HAVING count(*) >= 4")


@query(
    "allow_list_or_all",
    """SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src3') OR NOT EXISTS (SELECT 1 FROM documents WHERE source IN ('src1', 'src3'))""",
)
def allow_list_or_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of allowed sources; an empty list, or one that matches nothing, keeps all."""
    from plinth.operators.filters import allow_list

    return allow_list(table(spark, sf_dir, "documents"), "source", ["src1", "src3"]).select("doc_id", "source")


@query(
    "dedup_relabel_export",
    """SELECT doc_id, lpad(CAST(k - 1 AS VARCHAR), 6, '0') || '.txt' AS file FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM (SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(text)) AS u) AS t""",
)
def dedup_relabel_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat, gapless names in id order without one global task: ranks by range, offset by the counts before."""

    firsts = table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return gapless(firsts, "doc_id", "slot").select("doc_id", F.format_string("%06d.txt", "slot").alias("file"))
