"""A plan view over the star schema: every order is a plan, its lines are walls and openings, all integers.

The view is plain SQL that Spark and DuckDB read alike, so operators on plans run on any scale of the driver's tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from plinth import registry

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Walls of plans on the grid [0, 1000]: endpoints, thickness, curvature in thousandths. The plan id is named before it
#: partitions the window, so that later windows, joins and groups on it need no further exchange.
WALLS = """walls AS (
SELECT plan_id, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS INT) AS idx,
    x1, y1, x2, y2, th, cv, kind, off, width
FROM (SELECT l_orderkey AS plan_id, l_linenumber, l_partkey, l_suppkey, l_quantity,
    CAST((l_partkey * 37) % 1001 AS INT) AS x1,
    CAST((l_suppkey * 53 + l_linenumber * 91) % 1001 AS INT) AS y1,
    CAST((l_partkey * 91 + l_linenumber * 17) % 1001 AS INT) AS x2,
    CAST((l_suppkey * 29 + CAST(l_quantity AS BIGINT) * 7) % 1001 AS INT) AS y2,
    CAST(1 + CAST(l_quantity AS BIGINT) % 20 AS INT) AS th,
    CAST(CASE WHEN l_partkey % 5 = 0 THEN l_partkey % 101 - 50 ELSE 0 END AS INT) AS cv,
    CASE WHEN l_returnflag = 'R' THEN 'door' WHEN l_returnflag = 'A' THEN 'window' END AS kind,
    CAST(CAST(round(l_discount * 100) AS BIGINT) * 37 % 400 AS INT) AS off,
    CAST(20 + CAST(floor(l_extendedprice) AS BIGINT) % 61 AS INT) AS width
    FROM lineitem) AS lines)"""

#: Openings as free points, before they are given to a wall.
OPENINGS = """openings AS (
SELECT plan_id, idx AS opening, kind, width, CAST((x1 * 3 + y2 * 5 + off) % 1001 AS INT) AS px, CAST((y1 * 7 + x2 * 2 + width) % 1001 AS INT) AS py
FROM walls WHERE kind IS NOT NULL)"""

#: Rooms of plans: one per part brand among its lines, with a bounding rectangle.
ROOMS = """rooms AS (
SELECT plan_id, p_brand AS room, min(p_type) AS label, CAST(count(*) AS BIGINT) AS n_lines,
    CAST(min(x) AS BIGINT) AS x0, CAST(max(x) + 1 AS BIGINT) AS x1, CAST(min(y) AS BIGINT) AS y0, CAST(max(y) + 1 AS BIGINT) AS y1
FROM (SELECT l_orderkey AS plan_id, p_brand, p_type, (l_partkey * 37) % 1001 AS x, (l_suppkey * 53) % 1001 AS y FROM lineitem JOIN part ON l_partkey = p_partkey) AS placed
GROUP BY plan_id, p_brand)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run SQL over the driver's tables."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


def with_views(text: str) -> str:
    """Put the view definitions that a query names in front of it."""
    need = [v for k, v in (("walls", WALLS), ("openings", OPENINGS), ("rooms", ROOMS)) if re.search(rf"\b{k}\b", text)]
    if OPENINGS in need and WALLS not in need:
        need.insert(0, WALLS)
    if not need:
        return text
    body = text.strip()
    rest = ", " + body[5:] if body.upper().startswith("WITH ") else "\n" + body
    return "WITH " + ",\n".join(need) + rest


def sql_query(name: str, text: str, oracle: str | None = None, native: dict[str, str] | None = None) -> None:
    """Register SQL text; where the engines differ, native maps words of the Spark text to those of the oracle."""
    spark_text = with_views(text)
    other = with_views(oracle or text)
    for a, b in (native or {}).items():
        other = other.replace(a, b)
    registry.query(name, other)(lambda spark, sf_dir: run_sql(spark, sf_dir, spark_text))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_sql(spark, sf_dir, with_views(f"SELECT * FROM {name}"))
