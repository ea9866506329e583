"""Queries of the training-data operators: name -> (spark, directory) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import credentials, docpairs, generated, invalid, leakage, prose, residue, spans, split, tokens
from .common import code_records, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    return generated.not_handwritten(table(spark, directory, "detailed_files")).select("file_id")


def p1_kinds(spark: SparkSession, directory: str) -> DataFrame:
    return generated.not_handwritten(table(spark, directory, "detailed_files"))


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return spans.SharedSpans(table(spark, directory, "detailed_files")).record_pairs()


def p2_shared(spark: SparkSession, directory: str) -> DataFrame:
    return spans.SharedSpans(table(spark, directory, "detailed_files")).shared_characters()


def p2_classes(spark: SparkSession, directory: str) -> DataFrame:
    return spans.SharedSpans(table(spark, directory, "detailed_files")).linked_classes()


def p2_groups(spark: SparkSession, directory: str) -> DataFrame:
    return spans.SharedSpans(table(spark, directory, "detailed_files")).span_groups()


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return credentials.find_credentials(table(spark, directory, "detailed_files"))


def p3_masked(spark: SparkSession, directory: str) -> DataFrame:
    return credentials.mask_credentials(table(spark, directory, "detailed_files"))


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return docpairs.doc_lines(table(spark, directory, "detailed_files"))


def p4_pairs(spark: SparkSession, directory: str) -> DataFrame:
    return docpairs.doc_pairs(table(spark, directory, "detailed_files"))


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return prose.file_languages(table(spark, directory, "detailed_files")).select("file_id", "lang")


def p5_shares(spark: SparkSession, directory: str) -> DataFrame:
    return prose.file_languages(table(spark, directory, "detailed_files"))


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    return invalid.invalid_files(table(spark, directory, "detailed_files"))


def p6_rates(spark: SparkSession, directory: str) -> DataFrame:
    return invalid.invalid_rates(table(spark, directory, "detailed_files"))


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    return split.split_oversized(code_records(table(spark, directory, "detailed_files")))


def p7_bisected(spark: SparkSession, directory: str) -> DataFrame:
    return split.bisect_oversized(code_records(table(spark, directory, "detailed_files")))


def p8_ids(spark: SparkSession, directory: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, directory, "documents"))


def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    return leakage.find_leaks(table(spark, directory, "documents"), table(spark, directory, "benchmark"))


def p9_edited(spark: SparkSession, directory: str) -> DataFrame:
    return leakage.find_leaks(table(spark, directory, "documents"), table(spark, directory, "benchmark"), edits=2)


def p10_found(spark: SparkSession, directory: str) -> DataFrame:
    return residue.find_residue(table(spark, directory, "documents")).select("doc_id")


def p10_kinds(spark: SparkSession, directory: str) -> DataFrame:
    return residue.find_residue(table(spark, directory, "documents"))


def p10_kept(spark: SparkSession, directory: str) -> DataFrame:
    return residue.without_residue(table(spark, directory, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_kinds, p2_found, p2_shared, p2_classes, p2_groups, p3_found, p3_masked, p4_found, p4_pairs, p5_found, p5_shares, p6_found, p6_rates, p7_found, p7_bisected, p8_ids, p9_found, p9_edited, p10_found, p10_kinds, p10_kept)}
