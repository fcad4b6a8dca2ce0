"""Registered queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpishift.session import scratch_path

from .common import table
from .compress import compress
from .conversations import damage, repair
from .decontaminate import contaminated
from .language import languages
from .licenses import digest, scan_licenses
from .lines import line_classes
from .minhash import near_duplicates
from .oracles import ORACLES
from .packing import pack
from .quality import quality_scores
from .records import read_records, with_starts, write_records
from .repetition import repetition_rules
from .search import bm25_search, build_index
from .toxicity import toxicity_scores


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan_licenses(table(spark, sf_dir, "documents")))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_classes(table(spark, sf_dir, "documents"), max_edits=1, min_bytes=20, exact_bytes=1)
    return lines.select("doc_id", F.col("number").alias("line"), "class_doc", F.col("class_number").alias("class_line"),
                        F.col("is_first").alias("kept"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op8_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, f"records-{uuid.uuid4().hex}")
    index = write_records(table(spark, sf_dir, "documents"), out, tokenizer_path(), end_id=0)
    return (with_starts(read_records(spark, out), index)
            .select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_path(), size=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=75).drop("text_hash")


def op2_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    queries = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return bm25_search(build_index(docs), queries, k=10)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(table(spark, sf_dir, "conversations")))


def op12_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings")).drop("label")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_search": op2_search,
    "op3_licenses": op3_licenses,
    "op4_lines": op4_lines,
    "op5_decontaminate": op5_decontaminate,
    "op6_quality": op6_quality,
    "op7_language": op7_language,
    "op8_records": op8_records,
    "op9_packing": op9_packing,
    "op10_minhash": op10_minhash,
    "op11_conversations": op11_conversations,
    "op12_repetition": op12_repetition,
    "op13_codes": op13_codes,
}

__all__ = ["ORACLES", "QUERIES", "tokenizer_path"]
