"""Importance resampling towards a target distribution, by hashed runs of words."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.llm.bytesops import pieces, utf8
from buildlens.llm.regular_sampling import first_ranks, sorted_runs

BUCKETS = 10_000
PIECE = 1 << 22
BLOCK = 1 << 18
LONG_WORD = 64

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of every word: runs of ASCII letters and digits and of all that is not ASCII."""
    is_word = _WORD[data]
    first, last = is_word.copy(), is_word.copy()
    first[1:] &= ~is_word[:-1]
    last[:-1] &= ~is_word[1:]
    filled = offsets[:-1] < offsets[1:]
    first[offsets[:-1][filled]] = is_word[offsets[:-1][filled]]
    last[offsets[1:][filled] - 1] = is_word[offsets[1:][filled] - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, side="right") - 1


def _fed(crc: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes of one word each; all words take a byte at a time, long ones go alone."""
    crc, sizes = crc.copy(), ends - starts
    left = np.flatnonzero(sizes <= LONG_WORD)
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        crc[i] = ~np.uint32(zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(~crc[i])))
    at = 0
    left = left[sizes[left] > 0]
    while len(left):
        now = crc[left]
        crc[left] = _CRC[(now ^ data[starts[left] + at]) & 255] ^ (now >> np.uint32(8))
        at += 1
        left = left[sizes[left] > at]
    return crc


def features(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (text, bucket) of all runs of 1 to ``longest`` words, joined by a space."""
    data = lowered(data)
    starts, ends, text = word_spans(data, offsets)
    for lo in range(0, len(starts), BLOCK):
        hi = min(len(starts), lo + BLOCK)
        crc, at = np.full(hi - lo, 0xFFFFFFFF, np.uint32), np.arange(lo, hi)
        for run in range(longest):
            if run:
                going = at + run < len(starts)
                going[going] = text[at[going] + run] == text[at[going]]
                crc, at = crc[going], at[going]
                crc = _CRC[(crc ^ np.uint32(32)) & 255] ^ (crc >> np.uint32(8))
            crc = _fed(crc, data, starts[at + run], ends[at + run])
            yield text[at], (~crc % np.uint32(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket.

    Each task adds up its own array and hands on its filled buckets; the driver gets one row a bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in pieces(batches, "text", PIECE):
            for _, bucket in features(*utf8(batch.column("text")), longest, buckets):
                total += np.bincount(bucket, minlength=buckets)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(total[filled])], ["bucket", "n"])

    parts = docs.select("text").mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight: floor of 1000 times the smoothed log ratio."""
    buckets = len(source)
    all_source, all_target = float(source.sum() + buckets), float(target.sum() + buckets)
    ratio = ((t + 1.0) * all_source / ((s + 1.0) * all_target) for s, t in zip(source.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row: the sum of the gains of its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            data, offsets = utf8(batch.column("text"))
            n = len(offsets) - 1
            words, found, weight = (np.zeros(n, np.int64) for _ in range(3))
            words += np.bincount(word_spans(data, offsets)[2], minlength=n)
            for text, bucket in features(data, offsets, longest, len(gain)):
                found += np.bincount(text, minlength=n)
                weight += np.bincount(text, gain[bucket], minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c) for c in (words, found, weight))],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long"
    )


def gumbel(doc_id: Column, seed: int) -> Column:
    """Floor of 1000 times a Gumbel number that depends on the id alone."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8)
    even = (F.conv(digits, 16, 10).cast("long") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(even)))


def resample(
    docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, least_words: int = 20,
    percent: int = 10, seed: int = 2024,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of ``docs`` (doc_id, text).

    Documents are drawn without replacement with a chance that follows how much more likely their
    features are in ``target`` (text) than in ``docs``: Gumbel noise on the weights, the highest scores
    win. Of N documents with ``least_words`` words, floor(percent * N / 100) are drawn; ties go to the
    smaller doc_id. rank is their place in that order, null for the others. Memory of a task is about ten
    times its longest text, or 40 MB.

    Null and empty texts have no features and weight 0. A row without a doc_id has no score, isn't
    counted in N and never drawn. Repeated rows get the same score and follow each other; different texts
    of one id with equal scores go by weight, then by features. Empty tables give an empty result or
    count as no features. Other columns aren't read.
    """
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    scored = weighed(docs, gain, longest).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    takes_part = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    runs = sorted_runs(scored.withColumn("key", F.when(takes_part, F.col("score"))).drop("n_words"), "key", "doc_id")
    most = runs.filter("key is not null").count() * percent // 100
    ranked = first_ranks(runs, "key", "doc_id", most, ["weight", "n_features"])
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")
