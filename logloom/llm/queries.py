"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from logloom.llm import (
    bytebpe,
    codes,
    decontaminate,
    jaccard,
    lexical,
    quality_rules,
    quality_trees,
    rendering,
    repair,
    simhash,
    substring,
    toxicity,
    warc,
)
from logloom.llm.sql import ORACLE_SQL as ORACLE_SQL

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Token that ends each document in the files of codes.
END_ID = 2


def warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to dictionary-compressed archives and read back from them."""
    pages = table(spark, sf_dir, "pages")
    read = warc.read_archives(warc.write_archives(pages), pages.schema["page_id"].dataType.simpleString())
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents contain windows of benchmark items, and how much of them."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text and what they decode to, as digests."""
    return bytebpe.digests(table(spark, sf_dir, "documents"), RANK_FILE, public_tokenizers.PATTERN)


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that windows of earlier documents cover, removed."""
    return substring.digests(table(spark, sf_dir, "documents"))


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all texts by boosted trees over their statistics."""
    return quality_trees.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of texts whose sets of three-word runs are similar."""
    return jaccard.joined(table(spark, sf_dir, "documents"))


def toxicity_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all texts by classifiers learned from toxic and unlabelled texts."""
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of all texts and the verdict of rules with limited false rejections."""
    return quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all texts written to files of codes in order of doc_id, read back from them."""
    return codes.read_files(codes.write_files(table(spark, sf_dir, "documents"), WORD_BPE, END_ID))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of all pages, laid out."""
    return rendering.rendered(table(spark, sf_dir, "pages"))


def structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of damaged conversations and their cheapest repair."""
    return repair.audited(table(spark, sf_dir, "conversations"))


def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest-scoring documents of every benchmark item."""
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how many are near."""
    return simhash.compared(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_archives": warc_archives,
    "op2_decontamination": decontamination,
    "op3_byte_bpe": byte_bpe,
    "op4_quality_classifier": quality_classifier,
    "op5_jaccard_join": jaccard_join,
    "op6_toxicity": toxicity_classifier,
    "op7_risk_controlled_rules": risk_controlled_rules,
    "op8_substring_dedup": substring_dedup,
    "op9_addressable_codes": addressable_codes,
    "op10_page_text": page_text,
    "op11_structure_repair": structure_repair,
    "op12_lexical_search": lexical_search,
    "op13_simhash": document_fingerprints,
}
