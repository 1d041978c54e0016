import json

from pyspark.sql import functions as F

from plinth import cli
from plinth.operators import corpus, generate, records
from plinth.plans.domain import verbose_annotations
from plinth.settings import Settings


def test_settings():
    s = Settings.of({"PLINTH_LIMIT": "900", "PLINTH_SMOKE": "yes", "PLINTH_SOURCES": "a, b", "PLINTH_HOLDOUT": "0.1"})
    assert (s.limit, s.sources, s.holdout, s.grid) == (40, ("a", "b"), 0.1, 1000)
    assert Settings.of({"PLINTH_LIMIT": "none"}).limit is None


def test_build(spark):
    good = verbose_annotations(generate.plans(spark, 40)).select(F.col("plan_id").alias("image_path"), "json_annotation", "width", "height", F.lit("synthetic").alias("source"))
    bad = spark.createDataFrame([("x", "{", 1, 1, "broken"), ("y", None, 1, 1, "broken"), ("z", '{"walls":[' + " " * 200_000 + "]}", 1, 1, "broken")], good.schema)
    rows = corpus.build([good, bad], Settings(negatives=0.2, holdout=0.1)).cache()
    n = {r.source.split(":")[0]: r.n for r in rows.groupBy(F.substring_index("source", ":", 1).alias("source")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == {"synthetic": 40, "negative": 10}
    assert rows.where("split = 'val'").count() == 5
    assert all(len(records.decode(r.target)) == r.n_walls for r in rows.collect())
    stats = corpus.statistics(rows).collect()
    assert sum(r.n for r in stats) == 50 and max(r.most_walls for r in stats) > 4
    chat = corpus.chat(rows).first()
    assert [m.role for m in chat.messages] == ["system", "user", "assistant"] and len(chat.images) == 1
    assert "centerline" in corpus.schema_text(short=False) and '"cl"' in corpus.schema_text()


def test_holdout_has_at_least_one_row(spark):
    one = spark.createDataFrame([("i", "t")], "image string, target string")
    assert corpus.split(one, 0.03).first().split == "val"


def test_derived(spark):
    plans = generate.plans(spark, 5)
    for r in corpus.derived(plans).join(plans, "plan_id").collect():
        told = json.loads(r.config)
        assert all(told["counts"][k] == r[k] for k in ("walls", "rooms", "doors", "windows"))
        assert told["bbox"][0] <= r.bbox[0] and told["bbox"][2] >= r.bbox[2]


def test_commands(spark, tmp_path):
    (tmp_path / "plans").mkdir()
    plan, _, _ = generate.one(1)
    (tmp_path / "plans/plan_00001.json").write_text(json.dumps(plan))
    assert cli.audit(spark, str(tmp_path / "plans")) == 0
    (tmp_path / "plans/plan_00002.json").write_text(json.dumps(plan | {"units": "cm"}))
    assert cli.audit(spark, str(tmp_path / "plans"), out=str(tmp_path / "r.json")) == 1
    assert cli.audit(spark, str(tmp_path / "plans/plan_00002.json")) == 1
    assert json.loads((tmp_path / "r.json").read_text())[0]["rule"] == "C5"
    for _ in range(2):
        assert cli.generate(spark, 6, 0, str(tmp_path / "g")) == 0
    assert spark.read.json(str(tmp_path / "g")).count() == 6
    assert cli.main(["audit", str(tmp_path / "nowhere")]) == 2


def test_hand_made_plans(spark):
    from plinth.operators import rules, scenarios

    plans = scenarios.table(spark)
    assert plans.count() == 9 and rules.audit(plans).collect() == []
    assert rules.matrix_faults(scenarios.matrix()) == []
