"""Logos: look-alikes of a company by the Hamming distance of their hashes, and a branding record's logo."""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.common import text_array
from ..functions.text import hash_bits
from ..session import cut_lineage
from .groups import connected

BITS = 64


def malformed_hashes(logos: DataFrame, column: str = "perceptual_hash") -> DataFrame:
    """Logos whose hash is given but isn't 16 hexadecimal digits; they are compared with nothing."""
    return logos.filter(F.col(column).isNotNull() & hash_bits(column).isNull())


def similar_logos(
    a: DataFrame, b: DataFrame, threshold: float = 0.85, known_bad: DataFrame | None = None,
    column: str = "perceptual_hash", owner: str = "company_id",
) -> DataFrame:
    """Pairs of distinct hashes of one company with similarity >= ``threshold``, and how many logos have each.

    Exact: hashes with at most r differing bits agree on one of r + 1 runs of bits, so each hash
    goes out once per run, with its company. Copies are counted first and only distinct hashes
    of a company are compared; the logos behind a pair follow by joining on company and hash.
    """
    differing = floor((1 - threshold) * BITS + 1e-9)
    edges = [round(i * BITS / (differing + 1)) for i in range(differing + 2)]
    masks = [((1 << (high - low)) - 1) << low for low, high in zip(edges, edges[1:])]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]

    def keyed(df: DataFrame, name: str) -> DataFrame:
        if known_bad is not None:
            df = df.join(known_bad.select(column).distinct(), column, "left_anti")
        bits = F.col(f"bits_{name}")
        counted = df.withColumn(f"bits_{name}", hash_bits(column)).filter(bits.isNotNull()).groupBy(
            owner, F.col(column).alias(f"hash_{name}"), f"bits_{name}").agg(F.count("*").alias(f"logos_{name}"))
        return counted.select("*", F.posexplode(F.array(*(bits.bitwiseAND(F.lit(m)) for m in signed))).alias("run", "key"))

    met = keyed(a, "a").join(keyed(b, "b"), [owner, "run", "key"])
    apart = F.col("bits_a").bitwiseXOR(F.col("bits_b"))
    # A pair may agree on several runs; it is taken at the lowest one.
    agree = F.transform(F.array(*(F.lit(m) for m in signed)), lambda m: apart.bitwiseAND(m) == 0)
    lowest = F.array_position(agree, F.lit(True)) == F.col("run") + 1
    return met.filter((F.bit_count(apart) <= differing) & lowest).select(
        owner, "hash_a", "hash_b", (F.lit(1.0) - F.bit_count(apart) / F.lit(float(BITS))).alias("similarity"),
        "logos_a", "logos_b")


def logo_classes(
    logos: DataFrame, threshold: float = 0.85, known_bad: DataFrame | None = None, column: str = "perceptual_hash", owner: str = "company_id",
) -> DataFrame:
    """``column, class, logos, companies`` for each distinct hash of all companies: the class it looks like.

    Hashes with at most r differing bits agree on one of r + 1 runs of bits. Under each value of a run
    the commonest hash (of equal ones the smallest) stands for the others; a hash is linked to those that
    stand for its runs and are similar enough, and a class is what links connect, named by its
    smallest hash. So a hash makes r + 1 candidates however many others are like it.
    """
    differing = floor((1 - threshold) * BITS + 1e-9)
    edges = [round(i * BITS / (differing + 1)) for i in range(differing + 2)]
    masks = [((1 << (high - low)) - 1) << low for low, high in zip(edges, edges[1:])]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    if known_bad is not None:
        logos = logos.join(known_bad.select(column).distinct(), column, "left_anti")
    hashes = cut_lineage(logos.withColumn("bits", hash_bits(column)).filter(F.col("bits").isNotNull()).groupBy(column, "bits").agg(
        F.count("*").alias("logos"), F.count_distinct(owner).alias("companies")))
    runs = hashes.select(F.col(column).alias("hash"), "bits", "logos", F.posexplode(F.array(*(F.col("bits").bitwiseAND(F.lit(m)) for m in signed))).alias("run", "key"))
    stands = runs.groupBy("run", "key").agg(F.min(F.struct((-F.col("logos")).alias("n"), "hash", "bits")).alias("s")).select(
        "run", "key", F.col("s.hash").alias("stand"), F.col("s.bits").alias("stand_bits"))
    near = runs.join(stands, ["run", "key"]).filter(
        (F.col("hash") != F.col("stand")) & (F.bit_count(F.col("bits").bitwiseXOR(F.col("stand_bits"))) <= differing))
    roots = connected(near.select(F.col("hash").alias("a"), F.col("stand").alias("b"))).withColumnRenamed("node", column)
    return hashes.join(roots, column, "left").select(column, F.coalesce("root", column).alias("class"), "logos", "companies")


def branding_logo(branding: str = "branding") -> Column:
    """The logo of a branding record: its logo, else the logo, card or icon among its images."""
    own = F.col(f"{branding}.logo")
    images = F.transform(text_array(("logo", "og_image", "favicon")),
                         lambda k: F.try_element_at(F.col(f"{branding}.images"), k))

    def good(url: Column) -> Column:
        foreign = F.exists(text_array(fixed.FOREIGN_LOGO_URLS), lambda p: F.contains(F.lower(url), p))
        return F.coalesce((F.trim(url) != "") & ~foreign, F.lit(False))

    return F.get(F.filter(F.concat(F.array(own), F.coalesce(images, F.array().cast("array<string>"))), good), F.lit(0))
