"""The checked queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .language_mixture import identify_held_out
from .license_scan import license_labels, license_sql
from .passage_chaining import repeated_passages
from .pattern_packing import pack_documents
from .piece_encoding import encoding_digests
from .pii_boosting import KINDS, find_personal_data, written
from .presence_masks import search_documents, search_sql
from .quality_bands import quality_report
from .radix_windows import repeat_digests
from .seekable_frames import fill_in_middle_digests, fill_in_middle_sql
from .simhash_index import near_duplicate_classes
from .string_tiling import leaked_items
from .token_transducer import token_counts

MODEL, BYTES = "piece_bpe_32k.model", "byte_bpe_50k.json"


def op1_passage_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir))


def op2_simhash_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(table(spark, sf_dir))


def op4_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir))


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_held_out(table(spark, sf_dir))


def op6_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = leaked_items(table(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "n_words", "n_covered", "coverage", F.size("tiles").cast("long").alias("n_tiles"))


def op7_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir), public_tokenizers.path(MODEL))


def op8_radix_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(table(spark, sf_dir))


def op9_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS[:4]), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op10_token_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir), public_tokenizers.path(MODEL))


def op11_presence_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_documents(table(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op12_seekable_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle_digests(table(spark, sf_dir))


def op13_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir), public_tokenizers.path(BYTES))


QUERIES = {f.__name__: f for f in (
    op1_passage_chaining, op2_simhash_index, op3_license_scan, op4_quality_bands, op5_language_mixture, op6_string_tiling,
    op7_piece_encoding, op8_radix_windows, op9_pii_boosting, op10_token_transducer, op11_presence_masks, op12_seekable_frames, op13_pattern_packing)}
#: The others have no SQL form (hashes, compression, fitted models, piece tables) and are tested by brute force.
SQL = {"op3_license_scan": license_sql(), "op11_presence_masks": search_sql(), "op12_seekable_frames": fill_in_middle_sql()}
