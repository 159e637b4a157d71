"""Sketches of texts: which tags can match at all, told without reading the texts.

A sketch is a bitmap of the hashed three-byte pieces of a text, stored once beside it. A tag's needle is a
text that every match contains, so a text whose sketch lacks a piece of the needle has no match. The test may
let a text through in vain, but never hides one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.catalog import Tag

PIECE = 3
# Bits of a sketch: about eight for each piece of the text, as a power of two between these.
LEAST_BITS, MOST_BITS = 10, 18
CHUNK = 1 << 22
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all three-byte pieces; the first bits are those that sketches of every size use."""
    part = data.astype(np.uint64)
    value = (part[:-2] << np.uint64(16)) | (part[1:-1] << np.uint64(8)) | part[2:]
    value = (value + np.uint64(1)) * _FACTOR
    return (value ^ (value >> np.uint64(29))) * _FACTOR


def sketch_of(text: bytes) -> bytes:
    """The sketch of one text; a text of a gigabyte is taken in parts."""
    bits = min(MOST_BITS, max(LEAST_BITS, int(8 * len(text)).bit_length()))
    held = np.zeros(1 << bits, bool)
    data = np.frombuffer(text, np.uint8)
    for lo in range(0, max(0, len(data) - PIECE + 1), CHUNK):
        held[_hashes(data[lo : lo + CHUNK + PIECE - 1]) >> np.uint64(64 - bits)] = True
    return np.packbits(held).tobytes()


def add_sketches(texts: DataFrame, text: str) -> DataFrame:
    """All columns but ``text``, with its sketch; null texts have none."""
    rest = [c for c in texts.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text).cast(pa.large_binary())
            made = [None if not x.is_valid else sketch_of(x.as_py()) for x in column]
            yield batch.select(rest).append_column("sketch", pa.array(made, pa.binary()))

    schema = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in rest)
    return texts.mapInArrow(run, f"{schema}, sketch binary")


def possible_tags(sketches: DataFrame, tags: list[Tag]) -> DataFrame:
    """The rows of ``sketches`` (..., sketch) that some tag may match, with ``asked``, the ids of these tags.

    Tags without a needle, or with one shorter than a piece, may match every text.
    """
    rest = [c for c in sketches.columns if c != "sketch"]
    needles = [(t.tag_id, _hashes(np.frombuffer((t.needle or "").encode(), np.uint8))) for t in tags]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = []
            for sketch in batch.column("sketch"):
                if not sketch.is_valid:
                    asked.append([])
                    continue
                held = np.frombuffer(sketch.as_buffer(), np.uint8)
                shift = np.uint64(64 - (len(held).bit_length() + 2))
                asked.append([i for i, h in needles if _all_set(held, h >> shift)])
            some = batch.select(rest).append_column("asked", pa.array(asked, pa.list_(pa.int64())))
            yield some.filter(pa.array([bool(a) for a in asked], pa.bool_()))

    schema = ", ".join(f"`{c}` {sketches.schema[c].dataType.simpleString()}" for c in rest)
    return sketches.mapInArrow(run, f"{schema}, asked array<long>")


def _all_set(held: np.ndarray, at: np.ndarray) -> bool:
    byte, bit = (at >> np.uint64(3)).astype(np.int64), (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)
    return bool(((held[byte] >> bit) & np.uint8(1)).all())


def sketched_hits(texts: DataFrame, sketches: DataFrame, keys: list[str], text: str, tags: list[Tag]) -> DataFrame:
    """(keys, tag_id) for every tag whose pattern occurs in ``text``; only texts that can match are searched.

    ``sketches`` has the keys and a sketch for each text that is not null. Other texts go no further than the
    join with those that are asked for, which Spark broadcasts where they are few.
    """
    asked = possible_tags(sketches.select(*keys, "sketch"), tags)
    searched = texts.select(*keys, text).join(asked, keys)
    # Only the tags that are asked for are searched for.
    tests = [
        F.struct(
            F.lit(t.tag_id).cast("long").alias("tag_id"),
            F.when(F.array_contains("asked", t.tag_id), F.rlike(F.col(text), F.lit(t.regex))).alias("hit"),
        )
        for t in tags
    ]
    return searched.select(*keys, F.inline(F.array(*tests))).filter("hit").drop("hit")
