"""Queries over generated plans: rules, labels, scores and generation reports (fixtures and properties test them)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.operators import generate, labels, records, rules, scores
from plinth.planview import table
from plinth.registry import query

PLANS_PER_SUPPLIER = 1


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many plans as there are suppliers, so that the work follows the scale of the tables."""
    return generate.plans(spark, table(spark, sf_dir, "supplier").count() * PLANS_PER_SUPPLIER)


@query("generated_plans")
def generated_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plans(spark, sf_dir).select("plan_id", F.md5("config").alias("mark"), "attempts", "fell_back")


@query("generation_tally")
def generation_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.tally(_plans(spark, sf_dir))


@query("rule_audit")
def rule_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans broken on purpose, one way in four, and what the rules say of them."""
    k = F.regexp_extract("plan_id", r"(\d+)", 1).cast("int") % 4
    broken = (
        F.when(k == 1, F.regexp_replace("config", '"units":"mm"', '"units":"cm"'))
        .when(k == 2, F.regexp_replace("config", '"room_type":"[^"]*"', '"room_type":""'))
        .when(k == 3, F.regexp_replace("config", '"thickness_mm":\\d+', '"thickness_mm":39'))
        .otherwise(F.col("config"))
    )
    return rules.audit(_plans(spark, sf_dir).withColumn("config", broken))


@query("opening_label_lines")
def opening_label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.with_labels(_plans(spark, sf_dir)).select("plan_id", F.explode("lines").alias("line"), "junctions")


def verbose_annotations(plans: DataFrame) -> DataFrame:
    """plan_id, json_annotation, width, height: configurations as annotations in millimetres."""
    wall = "array<struct<id:string,centerline:array<array<int>>,thickness_mm:int>>"
    walls = F.transform(F.from_json(F.get_json_object("config", "$.walls"), wall), lambda w: F.struct(w["id"].alias("id"), w["centerline"][0].alias("start"), w["centerline"][1].alias("end"), w["thickness_mm"].alias("thickness")))
    box = F.from_json(F.get_json_object("config", "$.bbox"), "array<int>")
    shift = F.transform(walls, lambda w: F.struct(w["id"].alias("id"), F.array(w["start"][0] - box[0], w["start"][1] - box[1]).alias("start"), F.array(w["end"][0] - box[0], w["end"][1] - box[1]).alias("end"), w["thickness"].alias("thickness")))
    return plans.select("plan_id", F.to_json(F.struct(shift.alias("walls"))).alias("json_annotation"), (box[2] - box[0]).alias("width"), (box[3] - box[1]).alias("height"))


@query("corpus_targets")
def corpus_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.targets(verbose_annotations(_plans(spark, sf_dir))).select("plan_id", "target", "n_walls", "error")


@query("evaluation_report")
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each plan scored against itself without one wall."""
    a = verbose_annotations(_plans(spark, sf_dir)).withColumn("truth", F.col("json_annotation"))
    guess = F.regexp_replace("json_annotation", r'\{"id":"W1",[^}]*\},', "")
    return scores.summarise(scores.score_pairs(a.withColumn("guess", guess), "guess", "truth", "plan_id"))
