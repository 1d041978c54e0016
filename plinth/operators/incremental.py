"""Work that is taken up again: manifests, stage markers, latest checkpoints, refinement rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of wanted that the manifest lacks."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def finished(manifest: DataFrame, stage: str) -> bool:
    return not manifest.where((F.col("stage") == stage) & (F.col("status") == "FINISHED")).isEmpty()


def latest_checkpoint(paths: DataFrame, column: str = "path") -> DataFrame:
    """The path with the largest number at its end."""
    number = F.regexp_extract(column, r"checkpoint-(\d+)$", 1).try_cast("long")
    return paths.where(number.isNotNull()).agg(F.max_by(column, number).alias(column), F.max(number).alias("step"))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def run_stage(spark: SparkSession, manifest_path: str, stage: str, work: Callable[[], None], attempts: int = 3) -> bool:
    """Run a stage unless the manifest has it, again after a failure; False if it was done before."""
    if exists(spark, manifest_path) and finished(spark.read.parquet(manifest_path), stage):
        return False
    for attempt in range(attempts):
        try:
            work()
            break
        except Exception:
            if attempt + 1 == attempts:
                raise
    spark.createDataFrame([(stage, "FINISHED")], "stage string, status string").write.mode("append").parquet(manifest_path)
    return True


def refine(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], rounds: int, enough: str) -> DataFrame:
    """Rounds of step(state, round) over rows that aren't good enough yet; each id keeps its best `total` so far."""
    best = state
    for k in range(rounds):
        better = step(best.where(f"NOT ({enough})"), k)
        both = best.unionByName(better.select(*best.columns))
        best = both.groupBy("id").agg(F.max_by(F.struct(*best.columns), F.struct("total")).alias("s")).select("s.*")
    return best
