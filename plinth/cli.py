"""Commands over plan folders: audit, generate, score. Exit codes: 0 all valid, 1 violations, 2 nothing to read."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession


def audit(spark: SparkSession, path: str, limit: int | None = None, out: str | None = None) -> int:
    """One plan file, or a folder of them: violations of the one, the histogram of the other."""
    from plinth.operators import rules
    from plinth.sources import files

    if path.endswith(".json"):
        plans = spark.read.text(path, wholetext=True).selectExpr("'plan' AS plan_id", "value AS config")
    else:
        plans = files.configs(spark, path, limit)
    if plans.isEmpty():
        return 2
    found = rules.audit(plans) if path.endswith(".json") else rules.report(plans)
    rows = [r.asDict() for r in found.collect()]  # violations of one plan, or a row a rule
    for r in rows:
        print(json.dumps(r))
    if out:
        with open(out, "w") as f:
            json.dump(rows, f)
    return int(bool(rows))


def generate(spark: SparkSession, count: int, seed: int, path: str, per_shard: int = 500) -> int:
    """Generate plans into shards with an index; indices that are there already are left alone."""
    from pyspark.sql import functions as F

    from plinth.operators import generate as g
    from plinth.operators import incremental

    number = F.regexp_extract("plan_id", r"(\d+)", 1).cast("int")
    plans = g.plans(spark, count, seed).withColumn("shard_no", F.floor(number / per_shard))
    try:
        plans = incremental.pending(plans, spark.read.json(path), "plan_id")
    except Exception:  # noqa: BLE001  nothing there yet
        pass
    plans.write.mode("append").partitionBy("shard_no").json(path)
    return 0


def score(spark: SparkSession, guesses: str, truths: str) -> int:
    """Means of the metrics over prediction files and a table of true plans (id, target)."""
    from plinth.operators import scores
    from plinth.sources import files

    pairs = files.predictions(spark, guesses).join(spark.read.json(truths).select("id", "target"), "id")
    print(json.dumps(scores.summarise(scores.score_pairs(pairs)).first().asDict()))
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="plinth")
    commands = parser.add_subparsers(dest="command", required=True)
    a = commands.add_parser("audit")
    a.add_argument("path")
    a.add_argument("--limit", type=int)
    a.add_argument("--out")
    g = commands.add_parser("generate")
    g.add_argument("path")
    g.add_argument("--count", type=int, default=100)
    g.add_argument("--seed", type=int, default=0)
    s = commands.add_parser("score")
    s.add_argument("guesses")
    s.add_argument("truths")
    args = parser.parse_args(argv)
    if args.command == "audit" and "://" not in args.path and not os.path.exists(args.path):
        return 2
    spark = SparkSession.builder.appName("plinth").getOrCreate()
    if args.command == "audit":
        return audit(spark, args.path, args.limit, args.out)
    if args.command == "generate":
        return generate(spark, args.count, args.seed, args.path)
    return score(spark, args.guesses, args.truths)


if __name__ == "__main__":
    raise SystemExit(main())
