"""Language identification with bit-sliced Bloom filters of n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.llm.bytesops import mixed, pieces, utf8
from buildlens.llm.resampling import lowered
from buildlens.session import cut_lineage

# Bytes of a gram; a gram is its bytes and its length in one number, so no two grams are the same.
SIZES = (3, 4)
SAMPLE = 4_000
GRAMS = 60_000
# A language holds a gram if it uses it at least this often, compared with the language that does so most.
SHARE = 0.3
PROBES = 4
PIECE = 1 << 21
STEP = 1 << 18
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (text, gram) of all runs of SIZES bytes in the texts, words set off by one blank.

    A-Z are lower-cased; what is neither an ASCII letter nor beyond ASCII is a blank, and a text begins
    and ends with one.
    """
    # A blank in front of every text and one behind the last.
    n = len(offsets) - 1
    shifted = offsets + np.arange(n + 1)
    spread = np.full(len(data) + n + 1, 32, np.uint8)
    place = np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))
    spread[place] = np.where(_LETTER[data], lowered(data), 32)
    # Of blanks in a row the last one stays. A text's closing blank is the next text's first.
    keep = np.ones(len(spread), bool)
    keep[:-1] = (spread[:-1] != 32) | (spread[1:] != 32)
    text = np.repeat(np.arange(n + 1), np.append(np.diff(shifted), 1))[keep]
    chars = spread[keep].astype(np.uint64)
    first = np.append(True, text[1:] != text[:-1])
    closing = np.append(np.flatnonzero(first)[1:], len(chars) - 1)
    room = closing[np.cumsum(first) - 1] - np.arange(len(chars))
    packed = chars
    for size in range(2, max(SIZES) + 1):
        packed = (packed[:-1] << np.uint64(8)) | chars[size - 1 :]
        if size in SIZES:
            whole = np.flatnonzero(room[: len(packed)] >= size - 1)
            for lo in range(0, len(whole), STEP):
                at = whole[lo : lo + STEP]
                yield text[at], packed[at] | np.uint64(size << 56)


def positions(gram: np.ndarray, bits: int) -> list[np.ndarray]:
    """Where a gram's PROBES bits are in a filter of 2 ** ``bits``."""
    h = mixed(gram)
    step = (h >> np.uint64(32)) | np.uint64(1)
    mask = np.uint64((1 << bits) - 1)
    return [((h + np.uint64(i) * step) & mask).astype(np.int64) for i in range(PROBES)]


@dataclass
class LanguageFilters:
    """One Bloom filter a language, bit-sliced: row p of ``table`` has bit p of all filters side by side."""

    languages: list[str]
    bits: int
    table: np.ndarray

    def holders(self, gram: np.ndarray) -> np.ndarray:
        """Which languages hold each gram, as bitmasks: one look-up a probe answers for all languages."""
        found = None
        for at in positions(gram, self.bits):
            rows = self.table[at]
            found = rows if found is None else found & rows
        return found

    def false_rate(self) -> np.ndarray:
        """The chance that a language seems to hold a gram it doesn't: the filled share of its filter, PROBES times."""
        filled = np.unpackbits(self.table, axis=1, bitorder="little")[:, : len(self.languages)].mean(axis=0)
        return filled**PROBES


def build_filters(held: list[tuple[str, np.ndarray]]) -> LanguageFilters:
    """Filters of the grams of each language."""
    most = max((len(g) for _, g in held), default=1)
    bits = max(10, int(most * 16 - 1).bit_length())
    table = np.zeros((1 << bits, -(-max(1, len(held)) // 8)), np.uint8)
    for i, (_, gram) in enumerate(held):
        for at in positions(gram, bits):
            np.bitwise_or.at(table[:, i // 8], at, np.uint8(1 << i % 8))
    return LanguageFilters([name for name, _ in held], bits, table)


def _sampled(learn: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows of each language, by the md5 of their ids: reruns take the same.

    The driver sees a count per language, as it later sees each language's grams; texts are drawn where they lie.
    """
    sizes = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not sizes:
        return learn
    share = F.create_map(*[c for r in sizes for c in (F.lit(r["lang"]), F.lit(most / r["n"]))])
    drawn = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 12), 16, 10).cast("double")
    return learn.filter(drawn < F.lit(float(16**12)) * share[F.col("lang")])


def _counts(learn: DataFrame) -> DataFrame:
    """(lang, gram, n): how often the texts of a language use a gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            codes = batch.column("lang").dictionary_encode()
            for text, gram in grams(*utf8(batch.column("text"))):
                lang = codes.indices.to_numpy()[text]
                for code, name in enumerate(codes.dictionary.to_pylist()):
                    value, n = np.unique(gram[lang == code], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(value), pa.string()), pa.array(value.view(np.int64)), pa.array(n)],
                        ["lang", "gram", "n"],
                    )

    parts = learn.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit_languages(docs: DataFrame, sample: int = SAMPLE, most: int = GRAMS) -> LanguageFilters:
    """Filters of the languages of ``docs`` (doc_id, text, lang); null texts and languages are not used.

    The grams of about ``sample`` texts a language are counted. Each language takes the grams that it
    uses at least SHARE times as often as the language that uses them most, the ``most`` most frequent of
    them; these are all that reaches the driver.
    """
    learn = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).dropna(subset=["text", "lang"])
    counts = cut_lineage(_counts(_sampled(learn, sample)))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    used = counts.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total"))
    best = used.groupBy("gram").agg(F.max("rate").alias("best"))
    typical = used.join(best, "gram").filter((F.col("rate") >= SHARE * F.col("best")) & (F.col("n") > 1))
    ranked = typical.groupBy("lang").agg(
        F.slice(F.sort_array(F.collect_list(F.struct(-F.col("n"), "gram"))), 1, most)["gram"].alias("grams")
    )
    rows = ranked.orderBy("lang").collect()
    return build_filters([(r["lang"], np.array(r["grams"], np.int64).view(np.uint64)) for r in rows])


def votes(filters: LanguageFilters, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text and language, the grams that the language holds, without those it is expected to hold by mistake."""
    n, wide = len(offsets) - 1, len(filters.languages)
    asked, found = np.zeros(n), np.zeros((n, wide))
    for text, gram in grams(data, offsets):
        masks = filters.holders(gram)
        asked += np.bincount(text, minlength=n)
        for i in range(wide):
            holds = masks[:, i // 8] >> np.uint8(i % 8) & np.uint8(1)
            found[:, i] += np.bincount(text, holds, minlength=n)
    wrong = filters.false_rate()
    return np.maximum(0.0, (found - asked[:, None] * wrong) / (1.0 - wrong))


def predict_languages(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs`` (doc_id, text).

    Every n-gram of the whole text is looked up, repeats included; the language that holds most of them,
    after the filters' false positives are taken off, is predicted (of equals the first by name). score is
    its lead over the next one as a share of its own count: 0 for a tie, 1 if no other language holds any.
    A text that is null or has no letter is ``und`` with score 0, as is every text if nothing was learned.
    Repeated rows get the same answer. Other columns aren't read. Memory of a task is about 50 times
    its longest text, or 100 MB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            count = votes(filters, *utf8(batch.column("text")))
            order = np.argsort(-count, axis=1, kind="stable")
            best = np.take_along_axis(count, order[:, :1], 1)[:, 0]
            next_ = np.take_along_axis(count, order[:, 1:2], 1)[:, 0] if count.shape[1] > 1 else np.zeros(len(best))
            score = np.divide(best - next_, best, out=np.zeros(len(best)), where=best > 0)
            lang = pa.array(filters.languages).take(pa.array(order[:, 0]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lettered"), lang, pa.array(score)], names)

    names = ["doc_id", "lettered", "lang_pred", "score"]
    lettered: Column = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    base = docs.select("doc_id", "text", lettered.alias("lettered"))
    if filters.languages:
        kind = docs.schema["doc_id"].dataType.simpleString()
        said = base.mapInArrow(run, f"doc_id {kind}, lettered boolean, lang_pred string, score double")
    else:
        said = base.select("doc_id", F.lit(False).alias("lettered"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return said.select(
        "doc_id",
        F.when(F.col("lettered"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("lettered"), F.col("score")).otherwise(0.0).alias("score"),
    )
