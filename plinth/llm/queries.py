"""Queries over the driver's tables, one per training-data operator, each with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import archives, common, decontaminate, fingerprint, minhash, packing, repeats, sharding, sstable, toxicity, urlfilter


def op1_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write_shards(common.documents(spark, sf_dir), common.scratch(spark, "sstable"))
    return sstable.read_shards(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = common.cut(packing.pieces(common.documents(spark, sf_dir)), "pieces")
    return packing.place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    arcs = archives.write_arcs(pages, common.scratch(spark, "arc"))
    warcs = archives.convert(spark, arcs, common.scratch(spark, "warc"))
    return archives.read_pages(spark, warcs)


def op4_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(common.documents(spark, sf_dir), percent=85)


def op5_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_url_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_bounded_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(common.documents(spark, sf_dir)).withColumn("grown_shard", F.lit(None).cast("int"))


def op8_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare(common.documents(spark, sf_dir))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(common.documents(spark, sf_dir))


def op10_weak_supervision_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_sstable": op1_token_sstable,
    "op2_best_two_fit_packing": op2_best_two_fit_packing,
    "op3_arc_to_warc": op3_arc_to_warc,
    "op4_minhash_near_duplicates": op4_minhash_near_duplicates,
    "op5_simhash_decontamination": op5_simhash_decontamination,
    "op6_url_automaton": op6_url_automaton,
    "op7_bounded_ring_shards": op7_bounded_ring_shards,
    "op8_chunk_fingerprints": op8_chunk_fingerprints,
    "op9_repeated_passages": op9_repeated_passages,
    "op10_weak_supervision_toxicity": op10_weak_supervision_toxicity,
}
ORACLES: dict[str, str] = {"op6_url_automaton": urlfilter.ORACLE}
