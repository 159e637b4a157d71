"""Compression classifier of text quality."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.bytesops import utf8
from buildlens.llm.sampling import smallest

PIECE = 1024


@dataclass(frozen=True)
class CompressionModel:
    """Two dictionaries and the curve that turns their size difference into a probability."""

    good: bytes
    bad: bytes
    level: int
    slope: float
    offset: float


class _Sizer:
    """Compressed sizes of texts, piece by piece, so that every piece leans on the dictionary."""

    def __init__(self, model: CompressionModel):
        self.packers = []
        for raw in (model.good, model.bad):
            if raw:
                book = zstd.ZstdCompressionDict(raw)
                book.precompute_compress(level=model.level)
            else:
                book = None
            self.packers.append(
                zstd.ZstdCompressor(
                    level=model.level, dict_data=book, write_content_size=False, write_dict_id=False
                )
            )

    def difference(self, text: bytes) -> float:
        """(size by the bad dictionary - size by the good one) / length; 0 for an empty text."""
        if not text:
            return 0.0
        good, bad = (
            sum(len(p.compress(text[i : i + PIECE])) for i in range(0, len(text), PIECE))
            for p in self.packers
        )
        return (bad - good) / len(text)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps, with a little shrinkage."""
    scale = float(np.std(x)) or 1.0
    design = np.stack([x / scale, np.ones(len(x))], axis=1)
    beta = np.zeros(2)
    ridge = np.diag([1e-3, 1e-6]) * max(1, len(x)) ** 0.5
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (y - p) - ridge @ beta
        curve = (design * (p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(curve, slope)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def _dictionary(texts: list[bytes], size: int) -> bytes:
    samples = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    if len(samples) < 16:
        return b"".join(samples)[-size:]
    room = min(size, max(1024, sum(map(len, samples)) // 8))
    try:
        return zstd.train_dictionary(room, samples).as_bytes()
    except zstd.ZstdError:  # too little variety to train on: the text itself serves
        return b"".join(samples)[-room:]


def fit_quality(
    labelled: DataFrame,
    most_docs: int = 1500,
    most_bytes: int = 20_000,
    dictionary_bytes: int = 112_640,
    level: int = 3,
) -> CompressionModel:
    """Model from rows (doc_id, text, label 0 or 1); rows with a null among them are not used.

    The sample is bounded: per class the ``most_docs`` rows of the smallest md5(doc_id) among texts
    of at most ``most_bytes`` bytes. Two thirds build the dictionaries, the others place the curve,
    so that it sees no text a dictionary has seen. Without rows of a class its dictionary is empty.
    The curve weighs rows as the sample of all labels does, not as the classes were drawn.
    """
    usable = labelled.filter(
        F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("label").isin(0, 1)
    ).select("doc_id", "text", "label")
    shares = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts: dict[int, list[bytes]] = {}
    for label in (0, 1):
        rows = (
            usable.filter((F.col("label") == label) & (F.octet_length("text") <= most_bytes))
            .select(F.md5(F.col("doc_id").cast("string")).alias("order"), "text")
        )
        texts[label] = [r["text"].encode() for r in smallest(rows, most_docs)]
    build = {k: [t for i, t in enumerate(v) if i % 3] for k, v in texts.items()}
    model = CompressionModel(
        _dictionary(build[1], dictionary_bytes), _dictionary(build[0], dictionary_bytes), level, 0.0, 0.0
    )
    sizer = _Sizer(model)
    x, y, w = [], [], []
    for label, rows in texts.items():
        held = rows[::3]
        x += [sizer.difference(t) for t in held]
        y += [label] * len(held)
        w += [shares.get(label, 0) / max(1, len(held))] * len(held)
    if len(set(y)) < 2:
        share = (shares.get(1, 0) + 0.5) / (sum(shares.values()) + 1)
        return CompressionModel(model.good, model.bad, level, 0.0, float(np.log(share / (1 - share))))
    slope, offset = _logistic(np.array(x), np.array(y, float))
    # The classes were drawn alike often; their real odds move the offset.
    drawn = sum(1 for v in y if v) / max(1, sum(1 for v in y if not v))
    offset += float(np.log(shares[1] / shares[0] / drawn))
    return CompressionModel(model.good, model.bad, level, slope, offset)


def score_quality(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """(doc_id, score): the probability of label 1 for every row of ``docs`` (doc_id, text).

    Whole texts are compressed, in pieces of 1 KB, once per dictionary. Null and empty texts have a
    difference of 0 and so the score of the curve's offset. Ids pass through as they are, repeated
    rows are scored alike, other columns aren't read. The model holds two dictionaries of at most
    110 KB each and travels with the function.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = _Sizer(model)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            view = data.tobytes()
            at = offsets.tolist()
            x = np.array([sizer.difference(view[a:b]) for a, b in zip(at[:-1], at[1:])], float)
            score = 1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
