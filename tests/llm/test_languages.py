"""Language filters: exact grams, filters against sets, held-out accuracy, awkward rows."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np

from buildlens.llm.languages import SIZES, build_filters, fit_languages, grams, predict_languages, votes
from buildlens.llm.queries import QUERIES
from tests.compare import DATA


def column(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])


def plain_grams(text):
    raw = re.sub(rb"[^a-z\x80-\xff]+", b" ", b" " + text.lower().encode() + b" ")
    return Counter(raw[i : i + n] for n in SIZES for i in range(len(raw) - n + 1))


def test_grams_equal_plain_python():
    for texts in (["Ab  c!", "", "é1", "x", "...", "", "last  word of"], ["", ""], [], ["a"], ["", "end.", ""]):
        got = Counter()
        for text, gram in grams(*column(texts)):
            got.update((int(t), int(g).to_bytes(8, "big")[8 - (int(g) >> 56) :]) for t, g in zip(text, gram))
        assert got == Counter({(i, g): n for i, t in enumerate(texts) for g, n in plain_grams(t).items()})


def test_filters_hold_all_and_few_others():
    rng = np.random.default_rng(0)
    held = [(f"l{i}", rng.integers(0, 2**62, 3000).astype(np.uint64)) for i in range(11)]
    filters = build_filters(held)
    for i, (_, gram) in enumerate(held):
        assert (filters.holders(gram)[:, i // 8] >> (i % 8) & 1).all()
    strange = filters.holders(rng.integers(0, 2**62, 200_000).astype(np.uint64))
    seen = np.unpackbits(strange, axis=1, bitorder="little")[:, :11].mean(axis=0)
    assert np.allclose(seen, filters.false_rate(), rtol=0.2, atol=2e-4)


def test_false_positives_are_taken_off():
    filters = build_filters([("a", np.zeros(0, np.uint64)), ("b", np.zeros(0, np.uint64))])
    filters.table[::2] = 2  # half of b's bits are set, though it holds nothing
    count = votes(filters, *column(["some words of no language at all " * 200]))
    asked = sum(plain_grams("some words of no language at all " * 200).values())
    assert count[0, 0] == 0 and filters.false_rate()[1] == 1 / 16 and count[0, 1] < asked / 4


def test_languages_of_held_out_documents(spark):
    rows = duckdb.execute(f"SELECT doc_id, lang, text FROM read_parquet('{DATA}/documents.parquet')").fetchall()
    got = {r["doc_id"]: r for r in QUERIES["op12_language_filters"](spark, DATA).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d, _, _ in rows}
    assert {d: r["held_out"] for d, r in got.items()} == held
    right = [got[d]["lang_pred"] == lang for d, lang, text in rows if held[d]]
    assert sum(right) >= 0.97 * len(right) and all(0 <= r["score"] <= 1 for r in got.values())


def test_awkward_rows(spark):
    learn = [(i, f"the cat and the dog number {i}", "en") for i in range(20)]
    learn += [(100 + i, f"der hund und die katze nummer {i}", "de") for i in range(20)]
    learn += [(200, None, "fr"), (201, "le chat et le chien", None)]
    filters = fit_languages(spark.createDataFrame(learn, "doc_id long, text string, lang string"))
    assert filters.languages == ["de", "en"]
    long = "der hund und die katze " * 200_000
    rows = [(1, "The dog", 5), (2, "die Katze", 5), (3, None, 5), (4, "", 5), (5, "12 !?", 5), (6, long, 5), (None, "the cat", 5), (1, "The dog", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = Counter((r["doc_id"], r["lang_pred"]) for r in predict_languages(docs, filters).collect())
    assert got == Counter({(1, "en"): 2, (2, "de"): 1, (3, "und"): 1, (4, "und"): 1, (5, "und"): 1, (6, "de"): 1, (None, "en"): 1})
    assert predict_languages(docs.limit(0), filters).count() == 0
    nothing = fit_languages(docs.limit(0).selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r["lang_pred"] for r in predict_languages(docs, nothing).collect()} == {"und"}
