"""The corpus build: annotations of several sources to target rows with negatives, a split, and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.operators import records
from plinth.settings import Settings

#: The words a model is told with every plan.
SYSTEM = "You turn drawings of floor plans into structured data."
KEYS = {"n": "number of walls", "id": "1 to n in reading order", "cl": "ends [x1,y1,x2,y2]", "th": "thickness", "cv": "curvature, left out where 0", "op": "openings, left out where there are none", "t": "type", "c": "offset from the first end", "w": "width"}


def schema_text(grid: int = records.GRID, short: bool = True) -> str:
    """What a target looks like, in words that follow encode()."""
    sample = records.encode([{"cl": [0, 0, grid, 0], "th": 12, "cv": 0, "op": [{"t": "door", "c": 120, "w": 27}]}], short=short)
    said = "; ".join(f"{records._LONG[k] if not short and k in records._LONG else k}: {v}" for k, v in KEYS.items())
    return f"Answer with one line of JSON such as {sample}. {said}. Coordinates are whole numbers in [0,{grid}], the longer edge of the image being {grid}. For an image without a plan answer {records.encode([], short=short)}."


def negatives(rows: DataFrame, share: float) -> DataFrame:
    """As many rows with the empty target as make up a share of all."""
    n = int(rows.count() * share / (1 - share))
    kinds = F.array(F.lit("blank"), F.lit("noise"), F.lit("solid"))
    return rows.sparkSession.range(n).select(
        F.format_string("negative/%06d.png", "id").alias("image"), F.lit(records.encode([])).alias("target"), F.concat(F.lit("negative:"), F.get(kinds, (F.col("id") % 3).cast("int"))).alias("source")
    )


def split(rows: DataFrame, holdout: float, seed: int = 0, parts: int | None = None) -> DataFrame:
    """Seeded holdout of an exact share, at least one row: ranks by hash within hash ranges, plus the counts before."""
    parts = parts or max(64, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), "image", "target"))
    ranked = rows.withColumn("_mark", mark).withColumn("_part", (F.conv(F.substring("_mark", 1, 8), 16, 10).cast("long") * parts / 4294967296).cast("int"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))  # `parts` rows
    total = counts.agg(F.sum("_n")).first()[0] or 0
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_mark", "image")) + F.col("_before")
    return ranked.join(F.broadcast(counts), "_part").withColumn("split", F.when(rank <= max(1, int(total * holdout)), "val").otherwise("train")).drop("_mark", "_part", "_n", "_before")


def build(annotations: list[DataFrame], settings: Settings = Settings()) -> DataFrame:
    """image, target, source, n_walls, split from annotation tables; malformed, oversized and failed rows go."""
    every = annotations[0]
    for a in annotations[1:]:
        every = every.unionByName(a, allowMissingColumns=True)
    fits = every.where(F.col("json_annotation").isNotNull() & (F.length("json_annotation") <= settings.max_json_chars))
    rows = records.targets(fits, with_rooms=settings.rooms).where("target IS NOT NULL").select(F.col("image_path").alias("image"), "target", "source", "n_walls")
    extra = negatives(rows, settings.negatives).withColumn("n_walls", F.lit(0))
    return split(rows.unionByName(extra), settings.holdout, settings.seed)


def statistics(rows: DataFrame) -> DataFrame:
    """Rows, mean, upper median and most walls, mean characters, per split and source."""
    upper = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n_walls DESC)")
    return rows.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_walls"), 2).alias("mean_walls"), upper.alias("median_walls"), F.max("n_walls").alias("most_walls"), F.round(F.avg(F.length("target")), 1).alias("mean_chars"))


def chat(rows: DataFrame, user: str = "Give the plan of this image.") -> DataFrame:
    """messages {role, content {type, text}} and images of each row."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    said = lambda role, *parts: F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))
    messages = F.array(
        said("system", part("text", F.lit(f"{SYSTEM} {schema_text()}"))),
        said("user", part("image", F.lit(None).cast("string")), part("text", F.lit(user))),
        said("assistant", part("text", F.col("target"))),
    )
    return rows.select(messages.alias("messages"), F.array("image").alias("images"), *(c for c in ("source", "split") if c in rows.columns))


def derived(plans: DataFrame, column: str = "config") -> DataFrame:
    """plan_id, counts and bounding box recomputed from a configuration's parts."""
    get = lambda p, t: F.from_json(F.get_json_object(column, p), t)
    kinds = get("$.openings", "array<struct<category:string>>")["category"]
    points = F.flatten(get("$.rooms", "array<struct<polygon:array<array<int>>>>")["polygon"])
    x, y = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return plans.select(
        "plan_id", F.json_array_length(F.get_json_object(column, "$.walls")).alias("walls"), F.json_array_length(F.get_json_object(column, "$.rooms")).alias("rooms"),
        F.size(F.filter(kinds, lambda k: k == "door")).alias("doors"), F.size(F.filter(kinds, lambda k: k == "window")).alias("windows"),
        F.array(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)).alias("bbox"),
    )
