"""Writers of the forms that plan corpora leave in."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators.numbering import gapless


def jsonl(rows: DataFrame, path: str, split: str = "split") -> None:
    """image, target, source as JSON lines, a folder per split."""
    rows.write.mode("errorifexists").partitionBy(split).json(path)


def annotations(rows: DataFrame, path: str) -> None:
    """All rows as one JSON array in a local file, for readers of that form; rows pass the driver a partition at a time."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    lines = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()
    with open(f"{path}.part", "w", encoding="utf-8") as out:
        out.write("[")
        out.writelines(("" if k == 0 else ",\n") + r[0] for k, r in enumerate(lines))
        out.write("]\n")
    os.replace(f"{path}.part", path)


def shards(plans: DataFrame, path: str, per_shard: int = 500, index: str = "index") -> None:
    """Plans in folders of `per_shard`, and a narrow index in order of id."""
    sharded = plans.withColumn("shard_no", F.floor(F.col(index) / per_shard))
    sharded.repartition("shard_no").write.mode("errorifexists").partitionBy("shard_no").json(f"{path}/plans")
    sharded.select("plan_id", index, "shard_no").orderBy(index).write.mode("errorifexists").json(f"{path}/index")


def rich(labels: DataFrame, path: str) -> None:
    labels.select("plan_id", "rich").write.mode("errorifexists").json(path)


def label_files(labels: DataFrame, path: str) -> None:
    """Label lines as text, a folder per plan; a plan without openings has no line."""
    labels.select("plan_id", F.explode_outer("lines").alias("value")).select("plan_id", F.coalesce("value", F.lit("")).alias("value")).write.mode("errorifexists").partitionBy("plan_id").text(path)


def data_yaml(path: str, classes: Sequence[str] = ("door", "window")) -> str:
    """Dataset descriptor."""
    names = "".join(f"  {i}: {c}\n" for i, c in enumerate(classes))
    return f"path: {path}\ntrain: images/train\nval: images/val\nnc: {len(classes)}\nnames:\n{names}"


def portable(rows: DataFrame, image: str = "image") -> DataFrame:
    """One row per image under a flat relative name in image order, `NNNNNN.ext`."""
    first = rows.groupBy(image).agg(F.min_by(F.struct(*(c for c in rows.columns if c != image)), F.struct(*(F.col(c).cast("string") for c in rows.columns if c != image))).alias("r"))
    ranked = gapless(first, image, "slot")
    extension = F.regexp_extract(image, r"(\.\w+)$", 1)
    return ranked.select(F.concat(F.format_string("images/%06d", "slot"), extension).alias(image), "r.*")


def publish(labels: DataFrame, manifest: DataFrame, labels_path: str, manifest_path: str) -> None:
    """Labels first, then the manifest: what the manifest names has its labels."""
    labels.write.mode("append").parquet(labels_path)
    manifest.write.mode("append").parquet(manifest_path)


def report(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").json(path)
