"""The pipeline's stages, each against a brute-force version on its own input."""

import math
import re

import corpus_pipeline
from plinth.llm import common, toxicity
from tests.llm.test_documents import brute_components, brute_matches, brute_repeats, brute_votes


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def brute_score(model, text):
    """The linear score from votes counted word by word."""
    spoken = {j for _, j in brute_votes([text], model.voters)}
    words = re.findall("[a-z0-9\u0080-\U0010ffff]+", text.lower())
    hits = sum(any(w.startswith(s) for s, _ in model.voters) for w in words)
    z = model.bias + sum(model.weights[j] for j in spoken) + model.weights[-3:] @ [math.log1p(len(spoken)), math.log1p(hits), min(1, 10 * hits / max(1, len(words)))]
    return 1 / (1 + math.exp(-z))


def test_stages(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    columns, stages = docs.columns, corpus_pipeline.STAGES
    assert [n for n, _ in stages] == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "packing"]
    step = lambda k, d: common.cut(stages[k][1](spark, d, sf_dir), "test-stage")

    clean = step(0, docs)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert clean.columns == columns
    assert sorted(rows_of(clean)) == sorted(r for r in rows_of(docs) if brute_score(model, r[1] or "") < 0.5)

    apart = step(1, clean)
    assert apart.columns == columns
    assert sorted(r[0] for r in rows_of(apart)) == [i for i, _, _, kept in brute_components(rows_of(clean), 80) if kept]

    cut = step(2, apart)
    assert cut.columns == columns and cut.count() == apart.count()
    removed = {r[0]: r[2] for r in brute_repeats(rows_of(apart))}
    before = dict(rows_of(apart))
    for r in cut.collect():
        assert (r.text == before[r.doc_id]) == (removed[r.doc_id] == 0) and r.n_chars == len(r.text)

    safe = step(3, cut)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hits = {i for i, _ in brute_matches(rows_of(cut), items)}
    assert safe.columns == columns and sorted(rows_of(safe)) == sorted(r for r in rows_of(cut) if r[0] not in hits)

    packed = step(4, safe).collect()
    assert {r.doc_id for r in packed} == {r[0] for r in rows_of(safe)}


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    bins = {}
    for r in rows:
        bins[r.sequence_id] = bins.get(r.sequence_id, 0) + r.length
    assert max(bins.values()) <= 2048 and len(bins) <= -(-sum(bins.values()) // 2048) * 1.02 + 1


def test_stages_of_nothing(spark, sf_dir):
    docs = common.documents(spark, sf_dir).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0
