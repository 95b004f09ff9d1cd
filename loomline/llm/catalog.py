"""Queries of this subpackage, one an operator, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import ann, bpe, collocations, crf, lines, merkle, packing, quotes, rules, shards, simhash, sketches, warc
from loomline.llm.common import table


def op1_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_facts(spark, table(spark, sf_dir, "pages"))


def op2_three_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(spark, table(spark, sf_dir, "documents"))


def op3_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(spark, table(spark, sf_dir, "conversations"))


def op4_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(spark, table(spark, sf_dir, "documents"))


def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark, table(spark, sf_dir, "embeddings"))


def op6_kneser_ney_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verdicts(spark, table(spark, sf_dir, "documents"))


def op7_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"))


def op8_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(spark, table(spark, sf_dir, "documents"))


def op10_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_scaled_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprints(spark, table(spark, sf_dir, "documents"))


def op12_pair_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spark, table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(spark, table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_content_addressed_warc, op2_three_line_windows, op3_quotation_links, op4_size_tiered_shards, op5_cross_polytope, op6_kneser_ney_rules, op7_forced_boundary_bpe, op8_minimum_bin_slack, op9_simhash_bk_trees, op10_line_crf, op11_scaled_sketches, op12_pair_naming, op13_merkle_manifest)}
ORACLES: dict[str, str] = {"op1_content_addressed_warc": warc.ORACLE, "op2_three_line_windows": lines.ORACLE, "op12_pair_naming": collocations.ORACLE, "op13_merkle_manifest": merkle.ORACLE}
