"""Secret scans: fixed patterns and sliding-window entropy, in DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EntropyClass:
    """Candidates of one character class: maximal runs that hold a window of high entropy."""

    kind: str
    letters: str
    pattern: str
    window: int
    bits: float


# The base patterns.
ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

BASE_KINDS = ("assign", "access", "hex")
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    EntropyClass("hex_entropy", f"{DIGITS}ABCDEFabcdef", r"[0-9A-Fa-f]{20,}", 20, 3.0),
    EntropyClass("base64_entropy", f"{UPPER}{LOWER}{DIGITS}+/=_-", r"[A-Za-z0-9+/=_-]{24,}", 24, 4.0),
)
# Windows that touch one of these are documentation, not secrets.
ALLOW = r"(?i)example|sample|placeholder|changeme|dummy|x{6}|0{12}|(?:deadbeef){2}|0123456789abcdef"
SCALE = 1 << 20


def _parts(text: Column, pattern: str) -> Column:
    """[(gap before the match, match)] in text order, empty when nothing matches."""
    # A match at the very start leaves an empty first gap; the last gap has no match.
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(
        F.regexp_like(text, F.lit(pattern)),
        F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, m: F.struct(
            F.char_length(g).alias("gap"), m.alias("hit")
        )),
    )


def _high_entropy(run: Column, c: EntropyClass) -> Column:
    """Whether some window of ``c.window`` letters of a run of the class reaches ``c.bits`` of entropy.

    With f(n) = n log2 n the entropy is log2 w - sum f(count) / w. Counts per letter and the sum are
    kept while the window slides: the leaving and the entering letter change one count each. The sum is
    held in whole units of 2^-20, so that the same window always gives the same sum.
    """
    table = F.array(*[F.lit(round(n * math.log2(n) * SCALE) if n else 0).cast("long") for n in range(c.window + 2)])
    most = math.floor((math.log2(c.window) - c.bits) * c.window * SCALE)
    letters = F.array(*[F.lit(x) for x in c.letters])
    codes = F.transform(F.split(run, ""), lambda x: F.array_position(letters, x).cast("int"))
    # Each letter beside the one that leaves the window when it enters, 0 while the window fills.
    before = F.concat(F.array_repeat(F.lit(0), c.window), codes)
    steps = F.zip_with(codes, F.slice(before, 1, F.char_length(run)), lambda a, b: F.struct(a.alias("enters"), b.alias("leaves")))
    f = lambda n: F.element_at(table, n + 1)

    def step(state: Column, x: Column) -> Column:
        counts, enters, leaves = state["counts"], x["enters"], x["leaves"]
        was = F.when(leaves > 0, F.element_at(counts, F.greatest(leaves, F.lit(1)))).otherwise(0)
        now = F.element_at(counts, enters) - F.when(leaves == enters, 1).otherwise(0)
        freed = F.when(leaves > 0, f(was) - f(was - 1)).otherwise(F.lit(0).cast("long"))
        total = state["total"] - freed + f(now + 1) - f(now)
        slid = F.transform(
            counts,
            lambda n, i: n + F.when(i + 1 == enters, 1).otherwise(0) - F.when(i + 1 == leaves, 1).otherwise(0),
        )
        seen = state["seen"] + 1
        low = F.when(seen >= c.window, F.least(state["low"], total)).otherwise(state["low"])
        return F.struct(slid.alias("counts"), total.alias("total"), low.alias("low"), seen.alias("seen"))

    zero = F.struct(
        F.array_repeat(F.lit(0), len(c.letters)).alias("counts"),
        F.lit(0).cast("long").alias("total"),
        F.lit(2**62).cast("long").alias("low"),
        F.lit(0).alias("seen"),
    )
    return F.aggregate(steps, zero, step, lambda state: state["low"]) <= most


def _is_secret(kind: Column, hit: Column) -> Column:
    """Whether a match counts: it is long enough, or a window beside all allow-listed words is random."""
    keep = F.when(kind == "assign", F.char_length(F.regexp_extract(hit, ASSIGN, 2)) >= 8)
    keep = keep.when(kind.isin(*BASE_KINDS), F.lit(True))
    for c in CLASSES:
        parts = F.filter(F.split(hit, ALLOW, -1), lambda x: F.char_length(x) >= c.window)  # noqa: B023
        keep = keep.when(kind == c.kind, F.exists(parts, lambda x: _high_entropy(x, c)))  # noqa: B023
    return keep


def secret_spans(docs: DataFrame) -> DataFrame:
    """(rk, doc_id, kind, start, end) of every secret; places count code points, the end is exclusive.

    rk is xxhash64(doc_id, text) of the row. A null text holds none. Matches are judged where the text is
    read; only their lengths and the gaps between them are shuffled.
    """
    text = F.col("text")
    kinds = [(k, p) for k, p in zip(BASE_KINDS, (ASSIGN, ACCESS, HEX))]
    kinds += [(c.kind, c.pattern) for c in CLASSES]
    found = docs.select(
        F.xxhash64("doc_id", "text").alias("rk"),
        "doc_id",
        F.array(
            *[F.struct(F.lit(k).alias("kind"), _parts(text, p).alias("parts")) for k, p in kinds]
        ).alias("all"),
    ).filter(F.exists("all", lambda x: x["parts"].isNotNull()))
    by_kind = found.select("rk", "doc_id", F.inline("all")).filter(F.col("parts").isNotNull())
    rows = by_kind.select("rk", "doc_id", "kind", F.posexplode("parts").alias("i", "part"))
    judged = rows.select(
        "rk",
        "doc_id",
        "kind",
        "i",
        "part.gap",
        F.char_length("part.hit").alias("size"),
        _is_secret(F.col("kind"), F.col("part.hit")).alias("keep"),
    ).distinct()
    upto = Window.partitionBy("rk", "doc_id", "kind").orderBy("i")
    placed = judged.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto))
    return placed.filter("keep").select("rk", "doc_id", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans: array of (start, order, kind, end)) for every row of ``docs`` (doc_id, text).

    Base kinds: assignments, access keys, long hexadecimal strings. The entropy kinds add runs of
    one character class in which a sliding window is as random as a key; windows that touch an
    allow-listed word do not count, while base spans always stay. Null and empty texts have an
    empty array; repeated rows each get their own; null ids stay null. Other columns are not read.

    Only the matches' lengths are shuffled; the places of a document's matches are summed in one task, a
    document's own matches at most. Rows meet by doc_id and a hash of the row, texts stay where they are.
    """
    order = F.array(*[F.lit(k) for k in (*BASE_KINDS, *[c.kind for c in CLASSES])])
    spans = (
        secret_spans(docs)
        .groupBy("rk", F.struct("doc_id").alias("d"))
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "start",
                        F.array_position(order, F.col("kind")).alias("order"),
                        "kind",
                        "end",
                    )
                )
            ).alias("spans")
        )
    )
    ids = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rk"))
    empty = F.array().cast(spans.schema["spans"].dataType)
    spans = spans.select(F.col("rk").alias("of"), F.col("d.doc_id").alias("of_id"), "spans")
    same = (F.col("rk") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("of_id"))
    return ids.join(spans, same, "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))
