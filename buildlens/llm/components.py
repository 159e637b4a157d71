"""Connected components of an edge table (a, b), a < b."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.session import cut_lineage


def _smallest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node number that can be reached; edges without repeats.

    Alternates the large-star and small-star steps (Kiveris et al., SoCC 2014): every step only
    re-points edges, so the edge count never grows and the rounds are logarithmic.
    """
    stars = edges.select("a", "b")
    before = None
    while True:
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            stars.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = _smallest(both).select("u", F.least("u", "m").alias("m"))
        large = (
            both.filter(F.col("v") > F.col("u"))
            .join(low, "u")
            .filter(F.col("v") != F.col("m"))
            .select(F.col("m").alias("a"), F.col("v").alias("b"))
            .distinct()
        )
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = _smallest(down)
        small = (
            down.join(low, "u")
            .select(F.explode(F.array("u", "v")).alias("n"), "m")
            .filter(F.col("n") != F.col("m"))
            .select(F.col("m").alias("a"), F.col("n").alias("b"))
            .distinct()
        )
        stars = cut_lineage(small)
        after = _signature(stars)
        if after == before:
            break
        before = after
    roots = stars.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return roots.unionByName(stars.select(F.col("b").alias("node"), F.col("a").alias("component")))
