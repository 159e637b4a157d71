"""SimHash near-dedup with multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.llm.bytesops import utf8
from buildlens.llm.components import connected_components
from buildlens.session import cut_lineage

SEED = 42
BLOCK = 1 << 16
SEGMENTS, SEGMENT_BITS = 4, 16


def fingerprint(text: bytes, words: int) -> int:
    """SimHash of the shingles of ``words`` words; a bit is set if over half the hashes have it."""
    parts = text.lower().split()
    n = max(1, len(parts) - words + 1) if parts else 0
    if not n:
        return 0
    width = min(words, len(parts))
    counts = np.zeros(64, np.int64)
    hashed = xxhash.xxh64_intdigest
    for lo in range(0, n, BLOCK):
        some = parts[lo : lo + BLOCK + width - 1]
        joined = b" ".join(some)
        sizes = np.fromiter(map(len, some), np.int64, len(some)) + 1
        ends = np.cumsum(sizes) - 1
        starts = (ends + 1 - sizes)[: len(some) - width + 1].tolist()
        ends = ends[width - 1 :].tolist()
        h = np.array([hashed(joined[s:e], SEED) for s, e in zip(starts, ends)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n)
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """All columns of ``docs`` but the text, and fp, of every row; A-Z are lower-cased, words end at ASCII blanks."""
    rest = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            view = data.tobytes()
            fps = [fingerprint(view[a:b], words) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield batch.select(rest).append_column("fp", pa.array(fps, pa.int64()))

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in rest)
    return docs.mapInArrow(run, f"{schema}, fp long")


def _without(fp: Column, segment: int) -> Column:
    """The fingerprint with one segment cleared: the key of that segment's table."""
    mask = ((1 << SEGMENT_BITS) - 1) << (SEGMENT_BITS * segment)
    signed = (~mask) & ((1 << 64) - 1)
    return fp.bitwiseAND(F.lit(signed - (1 << 64) if signed >> 63 else signed).cast("long"))


def _bit(i: int) -> Column:
    return F.lit(-(1 << 63) if i == 63 else 1 << i).cast("long")


def near_links(prints: DataFrame) -> DataFrame:
    """(a, b), a < b: fingerprints of ``prints`` (fp, no repeats) that differ in one or two bits.

    The 64 bits are four segments. A table holds each fingerprint under what is left when one
    segment is cleared. Differences of a pair lie in one segment (then the tables of that segment
    agree as they are) or, one bit each, in two segments i < j: in the table without j the keys
    differ in one bit of i, so the one that has this bit finds the other by a ball of radius 1
    around segment i. A table key fixes 48 bits, hence only fingerprints of nearly the same value
    share a key; matches are then verified over all 64 bits.
    """
    fp = F.col("fp")
    table = prints.select(
        "fp",
        F.explode(
            F.array(
                *[F.struct(F.lit(j).alias("t"), _without(fp, j).alias("k")) for j in range(SEGMENTS)]
            )
        ).alias("e"),
    ).select(F.col("e.t").alias("t"), F.col("e.k").alias("k"), F.col("fp").alias("b"))
    probes = []
    for j in range(SEGMENTS):
        key = _without(fp, j)
        probes.append(F.struct(F.lit(j).alias("t"), key.alias("k"), F.lit(False).alias("ball")))
        for i in range(SEGMENT_BITS * j):
            one = _bit(i)
            probes.append(
                F.when(
                    fp.bitwiseAND(one) != 0,
                    F.struct(F.lit(j).alias("t"), key.bitwiseXOR(one).alias("k"), F.lit(True).alias("ball")),
                )
            )
    asked = (
        prints.select(F.col("fp").alias("a"), F.explode(F.array(*probes)).alias("e"))
        .filter(F.col("e").isNotNull())
        .select("a", F.col("e.t").alias("t"), F.col("e.k").alias("k"), F.col("e.ball").alias("ball"))
    )
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    found = asked.join(table, ["t", "k"]).filter((F.col("a") != F.col("b")) & (apart <= 2))
    once = found.filter(F.col("ball") | (F.col("a") < F.col("b")))
    return once.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _placed(prints: DataFrame, row: Column) -> DataFrame:
    """(fp, first): for every fingerprint the smallest ``row`` of its component.

    Equal fingerprints are one node however many rows have them. A node makes 52 lookups, so the
    few bytes of the nodes are dealt to all tasks first.
    """
    spark = prints.sparkSession
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min(row).alias("least")))
    dealt = nodes.select("fp").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fp")
    groups = connected_components(cut_lineage(near_links(dealt)))
    placed = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    least = placed.groupBy("component").agg(F.min("least").alias("first"))
    return placed.select("fp", "component").join(least, "component").select("fp", "first")


def near_components(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text).

    Fingerprints that differ in at most two bits are linked; component_id is the smallest doc_id
    that links can reach (null only if no document of the component has an id). Texts without words
    (null, empty, blank) have fingerprint 0. Repeated rows get the same answer each. Other columns
    are not read. An empty table gives an empty result.
    """
    prints = cut_lineage(fingerprints(docs.select("doc_id", "text"), words))
    answer = _placed(prints, F.col("doc_id")).withColumnRenamed("first", "component_id")
    return prints.join(answer, "fp").select("doc_id", "fp", "component_id")


def _text_key() -> Column:
    """Tells texts with the same doc_id apart; null is as empty."""
    return F.md5(F.coalesce("text", F.lit("")))


def keep_one(docs: DataFrame, words: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns, without those that near_components puts behind another row.

    One row stays per component, the one with the smallest doc_id; documents without words (null,
    empty, blank) are copies of each other. Rows without an id stay, as they can't be named. Of
    repeated rows (id and text) one stays; different texts with the same id are documents of their
    own. An empty table stays empty.
    """
    row = ["doc_id", "_text_key"]
    named = docs.filter("doc_id is not null").withColumn("_text_key", _text_key())
    prints = cut_lineage(fingerprints(named.select(*row, "text"), words))
    placed = prints.join(_placed(prints, F.struct(*row)), "fp")
    gone = placed.filter("doc_id <> first.doc_id or _text_key <> first._text_key").select(*row).distinct()
    # The texts move once, by their row, for both: what is joined here is dealt as the next step needs it.
    kept = named.join(cut_lineage(gone), row, "left_anti").dropDuplicates(row)
    return kept.select(*docs.columns).unionByName(docs.filter("doc_id is null"))
