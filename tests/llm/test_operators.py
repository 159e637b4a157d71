"""Operators against plain Python on small tables with awkward rows."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from buildlens.llm import contamination, queries, suffixes
from buildlens.llm.contamination import drop_contaminated, find_contamination
from buildlens.llm.lines import drop_repeated_lines
from buildlens.llm.mixing import mix_sources
from buildlens.llm.quality import fit_quality, score_quality
from buildlens.llm.secrets import CLASSES, scan_secrets
from buildlens.llm.simhash import fingerprint, keep_one, near_components, near_links
from buildlens.llm.suffixes import remove_repeats, repeated_spans, suffix_array, common_prefixes
from buildlens.llm.topk import block_top, exact_top_k
from buildlens.llm.toxicity import drop_toxic, fit_chain, score_chain
from buildlens.llm.urls import judge_urls, page_edges

DOCS = "doc_id long, text string"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def words(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return [f"w{i}x" for i in rng.integers(0, vocabulary, n)]


# --- URL filter

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"))


def judge(spark, urls, edges=()):
    rows = judge_urls(
        frame(spark, [(u,) for u in urls], "url string"),
        frame(spark, list(edges), "url string, other string"),
        RULES,
    ).collect()
    return {r["url"]: r for r in rows}


def test_longest_rule_wins_and_odd_urls_have_no_host(spark):
    got = judge(
        spark,
        ["http://A.Example.com/en/1?q", "http://www.example.com/en/x", "http://b.org#net/es/", "plain", None, ""],
    )
    assert (got["http://A.Example.com/en/1?q"]["rule"], got["http://A.Example.com/en/1?q"]["verdict"]) == ("example.com/en/", "block")
    assert got["http://A.Example.com/en/1?q"]["host"] == "a.example.com"
    assert got["http://www.example.com/en/x"]["verdict"] == "allow"
    assert (got["http://b.org#net/es/"]["host"], got["http://b.org#net/es/"]["path"]) == ("b.org", "")
    for odd in ("plain", None, ""):
        assert (got[odd]["host"], got[odd]["path"], got[odd]["rule"], got[odd]["verdict"]) == ("", "", None, "allow")


def test_blocks_reach_aliases_over_chains_but_not_allowed_urls(spark):
    edges = [
        ("http://a.org/1", "http://b.org/2"),
        ("http://b.org/2", "http://c.net/es/3"),
        ("http://www.example.com/en/4", "http://a.org/1"),
        ("http://d.org/", None),
    ]
    got = judge(
        spark,
        ["https://a.org/1/#top", "http://b.org/2?utm_source=f", "http://www.example.com/en/4", "http://d.org/", "http://b.org/2?page=2"],
        edges,
    )
    assert got["https://a.org/1/#top"]["verdict"] == "block"
    assert got["http://b.org/2?utm_source=f"]["verdict"] == "block"
    assert got["http://www.example.com/en/4"]["verdict"] == "allow"
    assert got["http://d.org/"]["verdict"] == got["http://b.org/2?page=2"]["verdict"] == "allow"


def test_links_of_pages(spark):
    rows = [
        ("http://a.org/x", '<link href="/y" rel="canonical"><meta http-equiv="refresh" content="0; url=http://z.net/">'),
        ("http://b.org/", "<link rel=stylesheet href=/s>"),
        (None, '<link rel="canonical" href="/q">'),
        ("http://c.org/", None),
    ]
    got = {tuple(r) for r in page_edges(frame(spark, rows, "url string, html string")).collect()}
    assert got == {("http://a.org/x", "http://a.org/y"), ("http://a.org/x", "http://z.net/")}


@pytest.mark.parametrize("to,want", [
    ("q", "http://a.org/x/q"), ("../q", "http://a.org/q"), ("?id=3", "http://a.org/x/y?id=3"),
    ("./", "http://a.org/x/"), ("..", "http://a.org/"), ("../../../z?u=http://b.org/", "http://a.org/z?u=http://b.org/"),
    ("/m/./n/../o?a=1&amp;b=2", "http://a.org/m/o?a=1&b=2"), ("//c.org/p", "http://c.org/p"), ("#part", "http://a.org/x/y?s=1#part"),
    ("https://d.org/?a&#38;b", "https://d.org/?a&b"), ("mailto:me@a.org", None), ("", None),
])
def test_links_are_resolved(spark, to, want):
    pages = frame(spark, [("http://A.org/x/y?s=1#f", f'<link rel="canonical" href="{to}">')], "url string, html string")
    assert [r["other"] for r in page_edges(pages).collect()] == ([want] if want else [])


def test_blocks_reach_a_relative_alias(spark):
    pages = frame(spark, [("http://a.org/x/1", '<link rel="canonical" href="../2?a=1&amp;b=2">'),
                          ("http://a.org", '<meta http-equiv="refresh" content="0; url=y">')], "url string, html string")
    edges = page_edges(pages)
    got = judge_urls(frame(spark, [("http://a.org/x/1",), ("http://a.org/2?b=2&a=1",), ("http://a.org/y",), ("http://a.org/",)], "url string"),
                     edges, (("block", "a.org/2"),)).collect()
    assert {r["url"]: r["verdict"] for r in got} == {
        "http://a.org/x/1": "block", "http://a.org/2?b=2&a=1": "block", "http://a.org/y": "allow", "http://a.org/": "allow"}


# --- toxicity


def labelled(spark, n=160):
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        text = words(i, 60) + (["grobian"] * 2 if bad else [])
        rows.append((i, " ".join(text), int(bad and i % 8 == 0), int(bad)))
    return frame(spark, rows, "doc_id long, text string, rude int, toxic int")


def test_chain_learns_and_drops_whole_rows(spark):
    rows = labelled(spark)
    model = fit_chain(rows, ["rude", "toxic"])
    assert model.links[1, 0] != 0 and model.links[0].any() == False  # noqa: E712
    late = " ".join(words(1, 3000) + ["grobian"] * 60)
    fresh = [(1, " ".join(words(900, 60)), 5), (2, " ".join(words(901, 60) + ["grobian", "grobian"]), 5),
             (3, None, None), (4, "", 1), (5, late, 1), (None, "x", 1), (2, " ".join(words(901, 60) + ["grobian", "grobian"]), 5)]
    docs = frame(spark, fresh, "doc_id long, text string, p_toxic int")
    got = [(r["doc_id"], r["p_toxic"] >= 0.5) for r in score_chain(docs, model).collect()]
    assert Counter(got) == Counter([(1, False), (2, True), (2, True), (3, False), (4, False), (5, True), (None, False)])
    kept = drop_toxic(docs, model, 0.5)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 3, 4, None}
    assert score_chain(docs.limit(0), model).count() == 0


def test_chain_without_labels(spark):
    model = fit_chain(labelled(spark).limit(0), ["rude", "toxic"])
    assert score_chain(frame(spark, [(1, "text")]), model).count() == 1


# --- mixing


def test_mix_meets_targets(spark):
    rows = [(i, " ".join(words(i, 1 + i % 37)), ["b", "a", None][i % 3] if i < 900 else "big") for i in range(1800)]
    rows += [(9000, None, "a"), (9001, "", None), (None, "one two", "a"), (5, "again", "b"), (5, "again", "b")]
    got = mix_sources(frame(spark, rows, DOCS + ", source string")).collect()
    assert len(got) == len(rows)
    size = Counter()
    for r in got:
        size[r["source"]] += r["size"]
    total, taken, target = sum(size.values()), Counter(), {}
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["source_size"] == size[r["source"]]
    # a, b, big, null weigh 1, 2, 3, 1; b and the null source are capped at three times their size.
    open_, left, want = {"a": 1, "b": 2, "big": 3, None: 1}, total, {}
    while True:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in share if share[s] > 3 * size[s]]
        if not over:
            want.update(share)
            break
        for s in over:
            want[s] = 3.0 * size[s]
            left -= want[s]
            del open_[s]
    assert target == pytest.approx(want)
    for s in want:
        assert abs(taken[s] - want[s]) <= 40
    again = mix_sources(frame(spark, rows[::-1], DOCS + ", source string")).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def pareto(rows, rest):
    """Places of ``rows`` (doc_id, size) that a Pareto order sample of ``rest`` words takes."""
    certain, words = set(), rest
    by_size = sorted({n for _, n in rows if n})
    for n in by_size:
        unit = sum(math.floor(m * 1000 / math.sqrt(m + 1.0)) for _, m in rows if m >= n)
        m = words / unit
        if m * 1000 / math.sqrt(n + 1.0) < 1:
            break
        certain |= {i for i, (_, k) in enumerate(rows) if k == n}
        words -= sum(k for _, k in rows if k == n)
    else:
        return certain
    ranked = []
    for i, (d, k) in enumerate(rows):
        if k >= n and words >= 0.5:
            p = min(0.999999, m * 1000 / math.sqrt(k + 1.0))
            u = (int(hashlib.md5(str(d).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            ranked.append((u / (1 - u) * (1 - p) / p, d, k, i))
    before = 0
    for _, _, k, i in sorted(ranked):
        if before + k - k / 2 <= words:
            certain.add(i)
        before += k
    return certain


@pytest.mark.parametrize("share", [0.05, 0.6, 0.98])
def test_the_sample_equals_plain_python(spark, share):
    """One source of two, whose share of the words leaves ``share`` of its size to the sample."""
    rng = np.random.default_rng(int(share * 100))
    sizes = [int(n) for n in rng.choice([0, 1, 2, 5, 40, 40, 300, 2000], 400)]
    one = [(i, n) for i, n in enumerate(sizes)]
    size = sum(sizes)
    # a and b weigh 1 and 2: a gets (size + other) / 3, once its size and ``share`` more.
    other = round(3 * (1 + share) * size) - size
    rows = [(i, " ".join(["w"] * n), "a") for i, n in one] + [(1000, " ".join(["w"] * other), "b")]
    got = mix_sources(frame(spark, rows, DOCS + ", source string")).collect()
    rest = next(r["target"] for r in got if r["source"] == "a") - size
    taken = pareto(one, rest)
    assert {r["doc_id"]: r["copies"] for r in got if r["source"] == "a"} == {i: 1 + (i in taken) for i, _ in one}
    words = sum(n for i, n in one if i in taken)
    assert abs(words - rest) <= 2000 and 0 < len(taken) < 400


def test_mix_of_nothing(spark):
    assert mix_sources(frame(spark, [], DOCS + ", source string")).count() == 0
    only = mix_sources(frame(spark, [(1, "", "a"), (2, None, None)], DOCS + ", source string")).collect()
    assert [r["taken"] for r in only] == [0, 0] and all(r["target"] == 0 for r in only)


# --- SimHash


def test_links_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    values = {int(v) for v in base} | {0, -1, -(2**63), 1}
    for v in base[:20].tolist():
        for _ in range(30):
            x = v
            for bit in rng.integers(0, 64, rng.integers(1, 4)).tolist():
                x ^= -(1 << 63) if bit == 63 else 1 << bit
            values.add(int(x))
    values = sorted(values)
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    got = {tuple(r) for r in near_links(frame(spark, [(v,) for v in values], "fp long")).collect()}
    assert got == want and len(want) > 100


def test_components_of_odd_rows(spark):
    text = " ".join(words(5, 300))
    rows = [(7, text), (3, text.upper()), (9, None), (4, " \t\n"), (8, ""), (6, "one two"), (6, "one two"), (None, text)]
    got = {(r["doc_id"], r["component_id"]) for r in near_components(frame(spark, rows)).collect()}
    assert got == {(7, 3), (3, 3), (None, 3), (9, 4), (8, 4), (4, 4), (6, 6)}
    assert fingerprint(b"", 3) == 0 and near_components(frame(spark, [])).count() == 0


def test_blocks_of_a_long_text_add_up(monkeypatch):
    text = " ".join(words(2, 500)).encode()
    whole = fingerprint(text, 3)
    monkeypatch.setattr("buildlens.llm.simhash.BLOCK", 7)
    assert fingerprint(text, 3) == whole


def test_one_row_of_each_component_stays(spark):
    rows = []
    for i in range(60):
        text = words(i, 600, 5000)
        rows.append((i, " ".join(text), "x"))
        text[300] = "changed"
        rows.append((100 + i, " ".join(text), "y"))
    rows += [(0, rows[0][1], "x"), (None, rows[0][1], None), (500, None, None), (501, "", "z")]
    docs = frame(spark, rows, DOCS + ", node string")
    fps = {r[0]: fingerprint((r[1] or "").encode(), 3) % 2**64 for r in rows if r[0] is not None}
    first = {d: min(o for o in fps if (fps[o] ^ fps[d]).bit_count() <= 2) for d in fps}
    while (again := {d: min(first[o] for o in fps if (fps[o] ^ fps[d]).bit_count() <= 2) for d in fps}) != first:
        first = again
    kept = keep_one(docs)
    got = Counter(r["doc_id"] for r in kept.collect())
    assert kept.columns == docs.columns and got == Counter({*first.values(), None})
    assert sum(first[100 + i] == i for i in range(60)) >= 20 and all(first[i] == i for i in range(60))


def test_different_texts_of_one_id_are_told_apart(spark):
    copied, alone, other = (" ".join(words(i, 40, 5000)) for i in (1, 2, 3))
    rows = [(1, copied), (2, copied), (2, alone), (3, other), (3, alone.upper()), (3, other)]
    got = Counter(tuple(r) for r in keep_one(frame(spark, rows)).collect())
    assert got == Counter([(1, copied), (2, alone), (3, other)])


# --- top k


def test_top_k_equals_all_products(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 24)]) for i in range(300)]
    rows += [(301, rows[5][1]), (302, rows[5][1]), (40, rows[7][1]), (400, None), (420, [1.0, None]), (440, [float("nan")] * 24)]
    rows += [(460, [float("inf")] * 24), (480, [1.0, 2.0]), (481, [3.0, 4.0]), (500, []), (None, rows[1][1]), (303, [1e15] * 24), (320, [1e9] * 24)]
    docs = frame(spark, rows, "vec_id long, embedding array<double>")
    good = [
        (i, [math.floor(64 * x) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    want = set()
    for q, v in {i: v for i, v in reversed(good) if i % 20 == 0}.items():
        if q == 40:
            continue  # two different vectors of one id: either may ask
        scores = sorted((-min(sum(a * b for a, b in zip(v, c)), 2**63 - 1), i) for i, c in good if i != q and len(c) == len(v))
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:5])}
    got = [tuple(r) for r in exact_top_k(docs, 5, 20, 4, 64).collect()]
    assert {g for g in got if g[0] != 40} == want and len([g for g in got if g[0] == 40]) == 5
    assert exact_top_k(docs.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [40, 1 << 20, 1 << 28, 1 << 40])
@pytest.mark.parametrize("dim", [0, 1, 7, 48])
def test_top_k_of_many_tiles(scale, dim):
    rng = np.random.default_rng(dim)
    centres = rng.normal(0, 1, (30, dim))
    c = np.floor(scale * (centres[rng.integers(0, 30, 5000)] + rng.normal(0, 0.2, (5000, dim)))).astype(np.int64)
    c[1000:1100] = c[0]  # ties
    ids = rng.permutation(5000)
    q = np.flatnonzero(ids % 100 == 0)
    rows, got, scores = block_top(ids[q], c[q], ids, c, 20)
    ends = np.iinfo(np.int64)
    products = c[q].astype(object) @ c.T.astype(object) if dim else np.zeros((len(q), 5000), object)
    for n, at in enumerate(q):
        clipped = [min(max(int(x), ends.min), ends.max) for x in products[n]]
        best = sorted((-s, i) for s, i in zip(clipped, ids.tolist()) if i != ids[at])[:20]
        assert list(zip((-scores[rows == n]).tolist(), got[rows == n].tolist())) == best


# --- lines


def brute_lines(rows, chars, most):
    key = lambda s: re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", s).translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= chars:
                holders.setdefault(key(line), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = [
            len(h := holders.get(key(x), ())) >= most and d != max(y for y in h if y is not None) for x in lines
        ]
        kept = None if t is None else "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((d, kept, len(lines), sum(gone)))
    return Counter(out)


def test_lines_equal_plain_python(spark):
    long_line, other = "A Line That Repeats É", "  another line, often seen\t"
    rows = [(i, f"own {i}\n{long_line}\r\n\n{other if i % 2 else long_line.lower()}") for i in range(12)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (None, long_line), (23, long_line + "\n" + long_line), (23, "x"), (3, rows[3][1])]
    docs = frame(spark, [(*r, 1, "z") for r in rows], DOCS + ", pos int, n_lines string")
    got = drop_repeated_lines(docs, 10, 5)
    assert got.columns == ["doc_id", "text", "pos", "n_lines", "n_dropped"]
    have = Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect())
    assert have == brute_lines(rows, 10, 5)
    assert drop_repeated_lines(docs.limit(0)).count() == 0


# --- decontamination


def brute_matches(text, item, least):
    tok = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    a, b = tok(text), tok(item)
    if not b or not a:
        return None
    if len(b) < 5:
        return 1.0 if any(a[i : i + len(b)] == b for i in range(len(a))) else None
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    want, best = grams(b), 0.0
    n = min(len(a), len(b))
    for s in range(max(1, len(a) - n + 1)):
        have = grams(a[s : s + n])
        common = sum((have & want).values())
        best = max(best, common / max(1, sum((have | want).values())))
    return best if best >= least else None


def test_windows_equal_plain_python(spark):
    items = [(i, " ".join(words(i + 50, 20 + i)) + ".") for i in range(8)]
    items += [(20, "Only these words"), (21, "..."), (22, None), (None, "no id"), (0, items[0][1]), (23, "alpha beta gamma"), (24, "Zeta")]
    rows = []
    for i in range(60):
        own, put = words(1000 + i, 150), items[i % 8][1].split()
        if i % 3 == 0:
            own[40:40] = [w.upper() for w in put]
        elif i % 3 == 1:
            own[60:60] = put[: len(put) - 1 - i % 5]
        rows.append((i, " ".join(own)))
    rows += [(70, "only THESE, words!"), (71, "only these words too"), (75, "say alpha beta gamma now ..."), (76, "alpha, beta"), (77, "zeta " + rows[0][1] + " ZETA"), (72, None), (73, ""), (74, items[3][1]), (None, items[3][1]), (74, items[3][1])]
    docs = frame(spark, [(*r, "c") for r in rows], DOCS + ", item_id string")
    bench = frame(spark, items, "item_id long, text string")
    want = Counter()
    for d, t in rows:
        for i, item in {x for x in items if x[0] is not None}:
            if (s := brute_matches(t, item, 0.8)) is not None:
                want[(d, i, round(s, 9))] += 1
    for block in (1000, 3):
        got = find_contamination(docs, bench, radius=24, block_items=block).collect()
        assert Counter((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in got) == want
    clean = drop_contaminated(docs, bench, radius=24)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows} - {d for d, _, _ in want}
    assert find_contamination(docs, bench.limit(0)).count() == 0


def test_shipped_radius_finds_a_window_of_least_similarity(spark):
    item = words(6837, 22, 5000)  # 21 bits from the text below: 16 of 20 shingles are the same
    docs, bench = frame(spark, [(1, " ".join(item[:-2] + ["new", "end"]))]), frame(spark, [(1, " ".join(item))], "item_id long, text string")
    assert [(r["doc_id"], r["similarity"]) for r in find_contamination(docs, bench).collect()] == [(1, 0.8)]


def test_lookup_finds_every_item_within_the_radius():
    index = contamination.Index(list(range(300)), [" ".join(words(i, 12)) for i in range(300)], 11)
    entry = index.lengths[12]
    asked = np.random.default_rng(0).integers(0, 2**64 - 1, 50, np.uint64)
    asked = np.concatenate([asked, entry.fps[:20] ^ np.uint64(0b10110111)])
    w, i = index._near(asked, entry)
    want = {(x, y) for x in range(len(asked)) for y in range(300) if int(asked[x] ^ entry.fps[y]).bit_count() <= 11}
    assert set(zip(w.tolist(), i.tolist())) == want and want


# --- secrets


def entropy(s):
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def test_secrets_equal_plain_python(spark):
    rng = np.random.default_rng(5)
    pick = lambda letters, n: "".join(letters[i] for i in rng.integers(0, len(letters), n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows = [
        (1, 'é PassWord = "s3cr3tvalue" and token:short'),
        (2, "xAKIAABCDEFGHIJKL AKIA123"),
        (3, "0123456789abcdef" * 2 + " " + pick("0123456789abcdef", 40)),
        (4, pick(b64, 60) + " example" + pick(b64, 40)),
        (5, "a" * 5000 + pick(b64, 30)),
        (6, None), (7, ""), (None, "api_key=abcdefgh1"), (1, 'é PassWord = "s3cr3tvalue" and token:short'),
        (8, "secret: token = abcdefghijk password=token=abcdefgh"),
        (9, "/sample/" + pick(b64[:62], 32)), (10, "example_key=" + pick(b64[:62], 32)), (11, pick(b64[:62], 12) + "dummy" + pick(b64[:62], 12)),
        (12, pick("0123456789ABCDEFabcdef", 400)), (13, "ab" * 40), (14, "abc " + pick(b64, 24) + " é " + pick(b64, 23)),
    ]
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    allow = re.compile(r"example|sample|placeholder|changeme|dummy|x{6}|0{12}|(?:deadbeef){2}|0123456789abcdef", re.I)
    want = Counter()
    for d, t in rows:
        t = t or ""
        spans = [(m.start(), 1, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), 2, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 3, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        for n, c in enumerate(CLASSES):
            for m in re.finditer(c.pattern, t):
                parts = [x for x in allow.split(m[0]) if len(x) >= c.window]
                best = max((entropy(x[i : i + c.window]) for x in parts for i in range(len(x) - c.window + 1)), default=0)
                if best >= c.bits:
                    spans.append((m.start(), 4 + n, c.kind, m.end()))
        want[(d, tuple(sorted(spans)))] += 1
    docs = frame(spark, [(*r, "q") for r in rows], DOCS + ", kind string")
    got = Counter((r["doc_id"], tuple(tuple(s) for s in r["spans"])) for r in scan_secrets(docs).collect())
    assert got == want
    kinds = {r["doc_id"]: [x["kind"] for x in r["spans"]] for r in scan_secrets(docs).collect()}
    assert kinds[9] == kinds[10] == ["base64_entropy"] and kinds[11] == [] and kinds[13] == ["hex"]
    assert scan_secrets(docs.limit(0)).count() == 0


# --- suffix arrays


@pytest.mark.parametrize("data", [b"banana", b"", b"a", b"\0\0\0\0\0\0\0\0\0\0", b"abcabcabcabcabcabcxabcabc" * 3, bytes(range(256)) * 2])
def test_suffix_array_and_prefixes(data):
    text = np.frombuffer(data, np.uint8)
    order, _ = suffix_array(text)
    want = sorted(range(len(data)), key=lambda i: data[i:])
    assert order.tolist() == want
    prefix = common_prefixes(text, order)
    for a, b in zip(want, want[1:]):
        n = 0
        while max(a, b) + n < len(data) and data[a + n] == data[b + n]:
            n += 1
        assert prefix[b] == n


def brute_repeats(rows, size):
    seen, out = {}, {}
    for d, t in sorted(set(rows), key=lambda r: (-(2**63) if r[0] is None else r[0])):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen.setdefault(b[i : i + size], (d, i)) != (d, i):
                gone[i : i + size] = b"\1" * size
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[(d, t)] = (len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g))
    return Counter((d, *out[(d, t)]) for d, t in rows)


def repeat_rows():
    passage, line = " ".join(words(1, 60)), "a line of more than forty letters, é " * 3
    rows = [(i, " ".join(words(100 + i, 30)) + (passage if i % 3 else line) + " ".join(words(200 + i, 10))) for i in range(40)]
    rows += [(50, rows[4][1]), (51, rows[4][1]), (60, "z" * 700), (61, None), (62, ""), (63, "z" * 99), (64, passage * 3)]
    return rows + [(4, rows[4][1]), (None, passage), (65, "\0" * 300 + passage[5:])]


def test_repeats_equal_plain_python(spark):
    rows = repeat_rows()
    docs = frame(spark, [(*r, 1) for r in rows], DOCS + ", rk int").repartition(5)
    got = Counter(
        (r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove_repeats(docs).collect()
    )
    assert got == brute_repeats(rows, 100)
    assert remove_repeats(docs.limit(0)).count() == 0


def test_hot_grams(spark):
    """Grams dealt window by window give the same spans."""
    rows = sorted({r for r in repeat_rows() if r[0] is not None and r[1]})
    docs = frame(spark, rows).withColumn("rk", F.xxhash64("doc_id", "text"))
    read = lambda df: {r["rk"]: covered(r["spans"]) for r in df.collect()}
    plain = read(repeated_spans(docs))
    assert read(repeated_spans(docs, most=2)) == plain
    assert any(plain.values())


def covered(spans):
    return frozenset(i for s in spans for i in range(s["start"], s["stop"]))


def test_cut_texts_have_the_same_anchors(monkeypatch):
    import pyarrow as pa

    rows = repeat_rows()
    texts = [t or "" for _, t in rows]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["rk", "text"]
    )

    def windows():
        out = set()
        for piece, hashes, owner, spots in suffixes._anchored([batch], 100):
            for h, rk, spot in zip(hashes.tolist(), piece["rk"].to_numpy()[owner].tolist(), spots.tolist()):
                lo, n, off = spot >> 14, (spot >> 7) & 127, spot & 127
                out |= {(rk, lo + i, lo + off, h) for i in range(n + 1)}
        return out

    whole = windows()
    monkeypatch.setattr(suffixes, "CHUNK", 150)
    monkeypatch.setattr(suffixes, "STEP", 150)
    assert windows() == whole


# --- quality


def test_quality_scores_held_out_texts(spark):
    rows = []
    for i in range(240):
        good = " ".join(words(i, 120))
        junk = " ".join(["!!" + w.upper() for w in words(i, 12)] * 8)
        rows.append((i, good if i % 2 else junk, i % 2))
    data = frame(spark, rows, DOCS + ", label int")
    model = fit_quality(data.filter("doc_id < 180"))
    extra = [(300, None, 1), (301, "", 0), (None, rows[1][1], None), (302, rows[201][1] * 200, 1)]
    fresh = frame(spark, rows[180:] + extra, DOCS + ", score int")
    got = {r["doc_id"]: r["score"] for r in score_quality(fresh, model).collect()}
    assert sum((got[i] >= 0.5) == bool(i % 2) for i in range(180, 240)) >= 57
    assert got[300] == got[301] and 0 <= got[301] <= 1 and got[None] >= 0.5 and got[302] >= 0.5
    assert score_quality(fresh.limit(0), model).count() == 0


def test_labels_that_disagree_are_left_out(spark):
    labels = frame(spark, [(1, 1), (1, 1), (2, 0), (2, 1), (3, None), (4, 0), (4, None), (None, 1)], "doc_id long, toxic int")
    got = {tuple(r) for r in queries._known(labels, "toxic").collect()}
    assert got == {(1, 1), (4, 0)}


def test_quality_without_labels(spark):
    model = fit_quality(frame(spark, [(1, "a", None), (None, "b", 1)], DOCS + ", label int"))
    assert [r["score"] for r in score_quality(frame(spark, [(1, "text")]), model).collect()] == [0.5]
