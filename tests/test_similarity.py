"""Pairs and groups against brute force."""

import hashlib
import math
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from buildlens.functions.text import common_start, edit_ratio, similarity
from buildlens.operators import graph, similarity as sim, snippet_index
from buildlens.session import scratch_path


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def close(a, b, threshold):
    d, m = edits(a, b), max(len(a), len(b))
    return 0.0 if d >= m else math.exp(-d / (m - d))


def greedy(texts, linked):
    groups = []
    for t in texts:
        home = next((g for g in groups if all(linked(t, o) for o in g)), None)
        groups.append([t]) if home is None else home.append(t)
    return groups


def family(rng, base, size):
    """Texts a few edits away from a base, letters beyond ASCII included."""
    out = set()
    while len(out) < size:
        text = list(base)
        for _ in range(rng.randint(0, max(2, len(base) // 9))):
            place = rng.randrange(len(text))
            kind = rng.random()
            if kind < 0.6:
                text[place] = rng.choice("abcé0123456789")
            elif kind < 0.8:
                text.insert(place, rng.choice("xyzü"))
            elif len(text) > 8:
                del text[place]
        out.add("".join(text))
    return sorted(out, key=lambda _: rng.random())


def snippets(seed):
    rng = random.Random(seed)
    out = []
    for length in (6, 11, 12, 21, 22, 33, 60, 130):
        base = "".join(rng.choice("abcdefghijklmnop :/.") for _ in range(length))
        out += family(rng, base, 7)
    out += ["build 12:03:44 failed on node 17", "build 12:03:59 failed on node 18", "build 13:13:59 failed on node 18"]
    out = list(dict.fromkeys(out))
    rng.shuffle(out)
    return out


def issue_table(spark, texts):
    rows = [(f"{i:05d}", i, 1, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "issue_id string, run_id long, tag_id long, snippet string")


@pytest.mark.parametrize("threshold", [0.9, 0.8, 0.95])
def test_pairs_equal_brute_force(spark, threshold):
    texts = snippets(7)
    nodes = sim.distinct_snippets(issue_table(spark, texts))
    pairs = sim.similar_pairs(nodes, threshold)
    named = pairs.join(nodes.select(F.col("node").alias("a"), F.col("snippet").alias("x")), "a").join(
        nodes.select(F.col("node").alias("b"), F.col("snippet").alias("y")), "b"
    )
    got = {(r.x, r.y): r.distance for r in named.collect()}
    want = {
        (x, y): edits(x, y)
        for i, x in enumerate(texts)
        for y in texts[i + 1 :]
        if close(x, y, threshold) > threshold
    }
    assert got == want and len(want) > 5


@pytest.mark.parametrize("texts", [snippets(7), None])
def test_links_equal_brute_force(spark, texts):
    texts = texts or _numbered(random.Random(5))
    nodes = sim.distinct_snippets(issue_table(spark, texts))
    text_of = {r.node: r.snippet for r in nodes.collect()}
    got = {text_of[r.node]: (r.n_similar, text_of.get(r.first_similar)) for r in sim.similar_links(nodes, 0.9).collect()}
    near = {x: [y for y in texts if y != x and close(x, y, 0.9) > 0.9] for x in texts}
    want = {x: (len(near[x]), next((y for y in texts[: texts.index(x)] if y in near[x]), None)) for x in texts}
    assert got == want and sum(n for n, _ in got.values()) > 10


def test_links_of_a_family_are_not_compared(spark):
    texts = [f"worker {i:04d} gave up waiting for an answer from the other side of the wire today" for i in range(2000)]
    rows = sim.similar_links(sim.distinct_snippets(issue_table(spark, texts)), 0.9).collect()
    assert len(rows) == 2000 and {r.n_similar for r in rows} == {1999} and sum(r.first_similar is None for r in rows) == 1


@pytest.mark.parametrize("few", [0, 16])
def test_links_of_open_families_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(sim, "FEW_MEMBERS", few)
    texts = [f"worker {i:04d} gave up waiting for an answer from the other side of the wire today" for i in range(0, 700, 29)]
    texts += [f"worker {i:04d} gave up waiting for an answer from the other hand, if any, today" for i in (0, 58, 7777)]
    texts += [f"worker {i:04d} gave up waiting for an answer from the xyzzy side of the wire today" for i in (29, 9999)]
    nodes = sim.distinct_snippets(issue_table(spark, texts))
    text_of = {r.node: r.snippet for r in nodes.collect()}
    got = {text_of[r.node]: r.n_similar for r in sim.similar_links(nodes, 0.9).collect()}
    want = {x: sum(y != x and close(x, y, 0.9) > 0.9 for y in texts) for x in texts}
    assert got == want and len({*want.values()}) > 2


def test_one_text_beside_a_family_is_compared_without_pieces(spark, monkeypatch):
    """Its members are as many as the pairs; they would be cut into a hundred pieces each."""
    cut, found = [], sim.candidate_pairs

    def counted(longer, shorter, threshold):
        cut.append(longer.count() + shorter.count())
        return found(longer, shorter, threshold)

    monkeypatch.setattr(sim, "candidate_pairs", counted)
    texts = [f"worker {i:04d} gave up waiting for an answer from the other side of the wire today" for i in range(300)]
    texts.append("worker 0007 gave up waiting for an answer from the xyzzy side of the wire today")
    nodes = sim.distinct_snippets(issue_table(spark, texts))
    rows = sim.similar_links(nodes, 0.9).collect()
    near = sum(close(texts[-1], x, 0.9) > 0.9 for x in texts[:-1])
    assert 0 < near < 300 and sorted(r.n_similar for r in rows) == sorted([near] + [299] * (300 - near) + [300] * near)
    assert sum(cut) < 20


def test_nights_find_the_pairs_of_a_full_run(spark):
    texts = snippets(7)
    root = scratch_path(spark, "index")
    frame = lambda some: spark.createDataFrame([(t,) for t in some], "snippet string")
    for night, some in enumerate((texts[:20], texts[10:45], texts[:5], texts[45:])):
        before = {str(f) for f in Path(root.removeprefix("file:")).rglob("*.parquet")}
        snippet_index.add_snippets(spark, frame(some), root, night, 0.9)
        after = {str(f) for f in Path(root.removeprefix("file:")).rglob("*.parquet")}
        assert before <= after and all(f"night={night}" in f for f in after - before)
        assert (after == before) == (night == 2)  # nothing new, nothing written
    # Each snippet was stored and cut once, and every pair is there once.
    kept = [r.snippet for r in snippet_index.stored(spark, root, "snippets").collect()]
    assert sorted(kept) == sorted(texts)
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    want = sorted(
        (*sorted((md5(x), md5(y))), edits(x, y))
        for i, x in enumerate(texts) for y in texts[i + 1 :] if close(x, y, 0.9) > 0.9
    )
    assert sorted((r.a, r.b, r.distance) for r in snippet_index.all_pairs(spark, root).collect()) == want
    # A candidate's text is read from its own slot.
    asked = spark.createDataFrame([(md5(texts[0]), md5(texts[0])[:2])], "node string, slot string")
    read = snippet_index.old_texts(spark, root, 3, asked)
    assert [r.snippet for r in read.collect()] == [texts[0]]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*slot#\d+ = " + md5(texts[0])[:2], plan), plan


def test_members_equal_brute_force(spark):
    base = snippets(11)
    texts = [t for t in base for _ in range(1 + len(t) % 3)]
    random.Random(3).shuffle(texts)
    members = sim.group_members(issue_table(spark, texts), 0.9).collect()
    got = {}
    for r in members:
        got.setdefault(r.group_id, set()).add(int(r.issue_id))
    linked = lambda i, j: texts[i] == texts[j] or close(texts[i], texts[j], 0.9) > 0.9
    want = [set(g) for g in greedy(range(len(texts)), linked) if len(g) > 1]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def _numbered(rng):
    """Families that differ in digits, near families, and texts a few letters away from them."""
    texts = []
    for word in ("alpha", "beta", "gamma delta"):
        base = f"the {word} worker stopped after waiting for the answer of its peer on the long way home at step "
        texts += [f"{base}{rng.randrange(10**width)}" for width in (1, 2, 3, 5) for _ in range(6)]
        texts += [f"{base}{n} sec" for n in (1, 22, 333, 4444)] + [base + "x", base.upper()]
    texts += [f"node {rng.randrange(10**6)} of {rng.randrange(10**6)} left" for _ in range(12)]
    texts += [f"at 12:{m:02d}:{s:02d} the agent {n} went away from the build in the middle of the night, sadly, and did not return for {h} hours"
              for m, s, n, h in [tuple(rng.randrange(60) for _ in range(4)) for _ in range(25)]]
    texts = list(dict.fromkeys(texts))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_number_families_change_no_group(spark, seed):
    texts = _numbered(random.Random(seed))
    nodes = sim.distinct_snippets(issue_table(spark, texts))
    groups = sim.snippet_groups(nodes, 0.9).select("node", "seed").collect()
    text_of = {r.node: r.snippet for r in nodes.collect()}
    got = sorted((text_of[r.node], text_of[r.seed]) for r in groups)
    linked = lambda x, y: close(x, y, 0.9) > 0.9
    want = sorted((t, g[0]) for g in greedy(texts, linked) for t in g)
    assert got == want


def test_a_family_is_compared_once(spark):
    texts = [f"worker {i:04d} gave up waiting for an answer from the other side of the wire today" for i in range(2000)]
    told = sim._number_families(sim.distinct_snippets(issue_table(spark, texts)), 0.9)
    edges, placed = sim._family_edges(told, 0.9)
    assert edges.count() == 0 and placed.select("unit").distinct().count() == 1
    members = sim.group_members(issue_table(spark, texts), 0.9)
    assert members.count() == 2000 and members.select("group_id").distinct().count() == 1


def test_group_id_depends_on_members_only(spark):
    table = issue_table(spark, ["the same text of some length"] * 3 + ["another text altogether here"] * 2)
    ids = lambda df: sorted({r.group_id for r in sim.group_members(df, 0.9).collect()})
    assert ids(table) == ids(table.orderBy(F.desc("issue_id"))) and len(ids(table)) == 2


def _random_edges(seed, nodes, share):
    rng = random.Random(seed)
    return [(i, j) for i in range(nodes) for j in range(i + 1, nodes) if rng.random() < share]


def _greedy_seeds(edges):
    linked = set(edges)
    ends = sorted({n for e in edges for n in e})
    groups = greedy(ends, lambda x, y: (min(x, y), max(x, y)) in linked)
    return sorted((n, g[0]) for g in groups for n in g)


@pytest.mark.parametrize("seed,nodes,share,prefix", [
    (1, 9, 0.5, graph.PREFIX), (2, 14, 0.25, 2), (3, 12, 0.85, 2), (4, 40, 0.4, 4), (4, 40, 0.4, graph.PREFIX)])
def test_rounds_equal_greedy(spark, monkeypatch, seed, nodes, share, prefix):
    monkeypatch.setattr(graph, "PREFIX", prefix)
    monkeypatch.setattr(graph, "SPAN_BITS", 1)
    edges = _random_edges(seed, nodes, share)
    df = spark.createDataFrame(edges, "a long, b long")
    assert sorted(map(tuple, graph.complete_linkage(df).collect())) == _greedy_seeds(edges)


def _counting(monkeypatch):
    """Counts the tables that the grouping writes."""
    written = []
    cut = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: written.append(1) or cut(df))
    return written


def test_a_chain_does_not_take_a_round_per_node(spark, monkeypatch):
    written = _counting(monkeypatch)
    edges = [(i, i + k) for i in range(100) for k in (1, 2, 3)] + [(200 + i, 201 + i) for i in range(100)]
    got = graph.complete_linkage(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == _greedy_seeds(edges) and len(written) <= 14


def test_a_group_of_many_is_counted_in_spans(spark, monkeypatch):
    """Spokes of one hub that form two groups beside it; no exchange is by the group alone but that of the spans."""
    n = 20_000
    marks = spark.range(n).select(
        F.lit(7).cast("long").alias("seed"), F.col("id").alias("node"),
        F.when(F.col("id") % 2 == 0, 1).otherwise(0).alias("counts"), (F.col("id") % 2 == 1).alias("asks"))
    counted = graph._count_before(marks)
    assert {(r.node, r.before) for r in counted.collect()} == {(i, (i + 1) // 2) for i in range(1, n, 2)}
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line]
    assert len(windows) == 2 and sum("span" in w.split("], [")[1] for w in windows if "], [" in w) >= 1


def test_a_large_clique_is_settled_in_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "PREFIX", 50)
    written = _counting(monkeypatch)
    edges = [(i, j) for i in range(400) for j in range(i + 1, 400)] + [(399, 900), (900, 901)]
    got = dict(map(tuple, graph.complete_linkage(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(400), 0), 900: 900, 901: 900} and len(written) <= 12


def test_components(spark):
    edges = [(1, 2), (2, 3), (7, 9), (9, 11), (4, 11), (20, 30)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 7: 4, 9: 4, 11: 4, 20: 20, 30: 20}


def test_similarity_values(spark):
    rows = [("", ""), ("abc", "abc"), ("abc", "xyz"), ("", "abc"), ("é" * 20, "é" * 19 + "e")]
    df = spark.createDataFrame(rows, "l string, r string").select(similarity(F.col("l"), F.col("r")).alias("s"))
    got = [r.s for r in df.collect()]
    assert got[0] is None and got[1] == 1.0 and got[2] == 0.0 and got[3] == 0.0
    assert got[4] == pytest.approx(math.exp(-1 / 19))


def test_pieces_and_written_tables_are_not_broadcast(spark, tmp_path):
    """Spark takes exploded or compressed rows for few bytes, however many there are."""
    texts = [(i, f"worker {i:04d} gave no answer after {i * 7:05d} ms, letter {chr(97 + i % 5)}") for i in range(40)]
    spark.createDataFrame(texts, "node long, snippet string").write.parquet(f"{tmp_path}/nodes")
    nodes = spark.read.parquet(f"{tmp_path}/nodes")
    told = sim._number_families(nodes, 0.9)
    for df in (sim.candidate_pairs(nodes, nodes, 0.9), sim.similar_pairs(nodes, 0.9), sim.similar_links(nodes, 0.9), told):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "BroadcastHashJoin" not in plan


def test_few_texts_are_cut_by_many_tasks(spark):
    nodes = spark.range(200).select(F.col("id").alias("node"), F.concat(F.lit("some words "), F.md5(F.col("id").cast("string"))).alias("snippet"))
    assert sim.probed_pieces(nodes.coalesce(1), 0.9).select(F.spark_partition_id()).distinct().count() == 8


def test_only_texts_near_a_family_in_length_are_cut_for_it(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    texts = [f"worker {i} of the pool gave no answer" for i in (3, 4, 5)] + ["worker x of the pool gave no answer"]
    texts += [word(n) for n in (5, 9, 12, 200, 300, 400, 900)]
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, snippet string")
    cut = []
    for name in ("offered_pieces", "probed_pieces"):
        real = getattr(sim, name)
        monkeypatch.setattr(sim, name, lambda df, t, real=real: cut.extend(r.node for r in df.select("node").collect()) or real(df, t))
    judged = sim._judged_units(sim._number_families(nodes, 0.9), 0.9)
    assert [(r.a, r.b, r.sure) for r in judged.collect()] == [(0, 3, True)]
    assert set(cut) == {0, 3}


@pytest.mark.parametrize("step", [-1, 1])
def test_near_lengths_keep_every_possible_partner(spark, step):
    """Of a longer text all shorter ones within its budget, and the other way around."""
    budget = lambda n: math.floor(n * edit_ratio(0.9) + 1e-9)
    nodes = spark.createDataFrame([(n, "x" * n) for n in range(400)] + [(400, None)], "node long, snippet string")
    for n in (1, 20, 21, 57, 210):
        kept = {r.node for r in sim._of_near_length(nodes, nodes.filter(F.col("node") == n), 0.9, step).collect()}
        want = {m for m in range(1, 400) if (0 <= n - m <= budget(n) if step < 0 else 0 <= m - n <= budget(m))}
        assert want <= kept and 0 not in kept and 400 not in kept and len(kept) < 80


def _loosely_numbered(rng):
    """Texts with more digits than a family may have, beside unnumbered ones and one of another wording."""
    texts = [f"lib/heap.c:{rng.randrange(10 ** rng.randint(1, 5))}: warning: cast drops bits" for _ in range(60)]
    texts += [f"at {rng.randrange(10**4)} of é{rng.randrange(10**3)} rows, then none" for _ in range(20)]
    for n in rng.sample(range(300), 40):
        texts.append(f"not ok 2 - table of {n} rows\n  rows: want {n}" + (" or more" if n % 5 == 0 else ""))
    texts += ["lib/heap.c:1234: warning: cast drop bits", "lib/heap.c:: warning: cast drops bits", "12.34.56.78", "12.34.56.79"]
    return list(dict.fromkeys(texts))


def test_texts_of_one_wording_are_compared_without_pieces(spark):
    texts = _loosely_numbered(random.Random(3))
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, snippet string")
    want = {(i, j): edits(texts[i], texts[j]) for j in range(len(texts)) for i in range(j) if close(texts[i], texts[j], 0.9) > 0.9}
    assert {(r.a, r.b): r.distance for r in sim.similar_pairs(nodes, 0.9).collect()} == want and len(want) > 100
    # By pieces there come few: those across wordings, and of texts that may offer nothing but digits.
    left = sim.worded_pairs(sim.worded_texts(nodes, 0.9)).collect()
    assert {(r.a, r.b) for r in left} <= {*want} and len(left) > len(want) / 2
    by_pieces = sim.paired_pieces(sim.offered_pieces(nodes, 0.9), sim.probed_pieces(nodes, 0.9), worded=False)
    assert by_pieces.count() < 100 < sim.candidate_pairs(nodes, nodes, 0.9).count()


def test_nights_compare_texts_of_one_wording(spark):
    texts = _loosely_numbered(random.Random(4))
    root = scratch_path(spark, "index")
    for night, some in enumerate((texts[::2], texts[1::4], texts)):
        snippet_index.add_snippets(spark, spark.createDataFrame([(t,) for t in some], "snippet string"), root, night, 0.9)
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    want = sorted((*sorted((md5(x), md5(y))), edits(x, y)) for i, x in enumerate(texts) for y in texts[i + 1 :] if close(x, y, 0.9) > 0.9)
    assert sorted((r.a, r.b, r.distance) for r in snippet_index.all_pairs(spark, root).collect()) == want


def test_a_pair_is_measured_once(spark):
    """Filters on a distance would each measure it again."""
    nodes = spark.createDataFrame([(1, "some words of a log"), (2, "some words of a dog")], "node long, snippet string")
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    found = sim.measured_pairs(pairs, nodes, 0.9).filter("distance < 9 and distance + longer > 0 and distance <> 7")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("levenshtein(") == 1
    assert [tuple(r) for r in found.collect()] == [(1, 2, 1, 19)]


def test_common_starts(spark):
    pairs = [("", "a"), ("abc", "abd"), ("abc", "abcd"), ("x" * 300 + "a", "x" * 300 + "b"), ("é😀x", "é😀y"), ("😀", "😁")]
    df = spark.createDataFrame(pairs, "l string, r string").select("l", "r", common_start("l", "r").alias("n"))
    assert [r.n for r in df.collect()] == [0, 2, 3, 300, 2, 0]


@pytest.mark.parametrize("threshold", [0.9, 0.8, 0.5])
def test_long_pairs_equal_plain_distances(spark, threshold):
    """Edits anywhere, at the ends too, up to and beyond the budget."""
    rng = random.Random(17)
    word = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    texts = []
    for length in (60, 130, 260):
        base = word(length)
        for share in (0.02, 0.05, 0.09, 0.12, 0.2, 0.4):
            n = int(length * share)
            at = rng.randrange(length - n)
            texts += [word(n) + base[n:], base[:-n] + word(n), base[n:], base[:-n], word(n) + base, base[:at] + word(n) + base[at + n :],
                      base[n // 2 :] + word(n // 2), "".join(c if rng.random() > share else "x" for c in base)]
        texts += [base, word(length)]
    texts = list(dict.fromkeys(texts))
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, snippet string")
    want = {}
    for j in range(len(texts)):
        for i in range(j):
            budget = math.floor(max(len(texts[i]), len(texts[j])) * edit_ratio(threshold) + 1e-9)
            if abs(len(texts[i]) - len(texts[j])) <= budget and (d := edits(texts[i], texts[j])) <= budget:
                want[i, j] = d
    every = nodes.select(F.col("node").alias("a")).crossJoin(nodes.select(F.col("node").alias("b"))).filter("a < b")
    assert {(r.a, r.b): r.distance for r in sim.measured_pairs(every, nodes, threshold).collect()} == want and len(want) > 100
