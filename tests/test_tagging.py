"""Stock patterns, spans and the tagging job on small texts."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from buildlens.catalog import STOCK_TAGS, Tag, check_tags, fingerprint, fingerprint_df, number_tags, tags_df
from buildlens.functions.text import byte_slice
from buildlens.operators import sketch, tagging
from buildlens.plans import queries
from buildlens.schemas import RUNS
from buildlens.session import cut_lineage, in_buckets

RUNS_SCHEMA = "run_id long, url string, status string, display_name string, log string, tag_schema string, build_id long"

TAP = """not ok 12 - sorted list keeps order
  want: 1 2 3
# got: 3 2 1
## seed 99
ok 13 - empty list"""

# Tag name -> (text with a match, text without one).
GOLDEN = {
    "cc_emit": ("a\nsrc/x.c:12:3: error: bad\n  int y;\n\nsrc/x.c:9: note: seen\n  here\nend", "src/x.c:12:3: warning: bad"),
    "cc_warn": ("lib.c:1:2: warning: unused\n   int z;\n   ^\nnext line", "lib.c: error: x"),
    "nvcxx_emit": ('"src/a.c", line 12: fatal error: no\n   body\n"src/a.c", line 13: note: x\ny', '"src/a.c", line 12: warning: no'),
    "nvcxx_bail": ("NVRTC Internal compiler error. kernel 7 gave up\nz", "NVC++ ok"),
    "out_of_space": ("tar: x/y: Cannot write: No space left on device\n", "No space left on device"),
    "jenkins_agent_offline": ("x\nAgent went offline during the build\ny", "xAgent went offline during the build"),
    "java_stack_trace": ("SEVERE: no answer\norg.sample.Timeout: 30 s\n    at org.sample.Poll.once(Poll.java:8)\nlater", "FATAL: x\nat y"),
    "mpi_abort": ("Abort(5) on node 8: no route\nroute_find(17): empty\nroute_open(2)..: gave up\nno", "Abort on node 3: x"),
    "python_traceback": ('Traceback (most recent call last):\n  File "x", line 2, in f\n    raise E\nmy.BuildException: test error\nrest', "Traceback (most recent call last):\nException: first line only"),
    "ld_error": ("./a.out: error while loading shared libraries: libx.so: gone", "error while loading shared libraries: x"),
    "cpi_failed_assert": ("cpi: src/x.c:12: int f(): Assertion `a == b' failed.", "cpi: Assertion `a' failed."),
    "mpir_assert_failed": ("Assertion failed in file src/a.c at line 7: p != NULL", "Assertion failed in file src/a.c"),
    "tap_failure": (TAP, "ok 1 - fine\n# x"),
    "perl_syntax_error": ('syntax error at a/b.pl line 7, near "foo"', "syntax error at a/b.pl line 7"),
    "bsd": ("x-freebsd64-y", "freebsd"),
    "linux": ("gcc-ubuntu22.04-x", "windows"),
    "osx": ("a-osx", "mac"),
    "aarch64": ("aarch64", "x86_64"),
    "gnu": ("gcc12", "clang"),
    "clang": ("clang", "gcc"),
    "intel": ("intel-oneapi", "amd"),
    "nvidia": ("nvidia", "amd"),
    "ch3-tcp": ("ch3-nemesis-tcp", "ch3"),
    "ch3-sock": ("ch3-sock", "ch3"),
    "ch4-ofi": ("ch4-ofi-vci", "ch4"),
    "ch4-ucx": ("ucx-global", "ch4"),
}


def golden(tag):
    if tag.name in GOLDEN:
        return GOLDEN[tag.name]
    node = tag.needle.removeprefix("Building remotely on ")
    return f"x\nBuilding remotely on {node} (label) in y\nz", f"Building on {node}"


def test_stock_catalog_covers_43_tags(spark):
    assert len(check_tags(spark, STOCK_TAGS)) == 43
    count = lambda key: {v: sum(getattr(t, key) == v for t in STOCK_TAGS) for v in {getattr(t, key) for t in STOCK_TAGS}}
    assert count("field") == {"Console": 29, "RunName": 12, "Artifact": 2}
    assert count("severity") == {"Error": 8, "Warning": 3, "Info": 3, "Metadata": 29}


def test_golden_snippets(spark):
    """The scanned forms find exactly what the given patterns find in a linear-time engine."""
    con = duckdb.connect()
    texts = [golden(t) for t in STOCK_TAGS]
    found = lambda text, tag: F.regexp_extract_all(F.lit(text), F.lit(tag.regex), F.lit(0))
    good = spark.range(1).select(*[found(g, t) for t, (g, _) in zip(STOCK_TAGS, texts)]).first()
    bad = spark.range(1).select(*[found(b, t) for t, (_, b) in zip(STOCK_TAGS, texts)]).first()
    for tag, (text, _), hits, misses in zip(STOCK_TAGS, texts, good, bad):
        want = con.execute("SELECT regexp_extract_all(?, ?, 0)", [text, tag.pattern]).fetchone()[0]
        assert hits == want and len(want) == 1, tag.name
        assert misses == [], tag.name
        assert tag.needle is None or tag.needle in text


@pytest.mark.parametrize("name", ["cc_emit", "nvcxx_emit", "mpi_abort", "java_stack_trace", "python_traceback", "tap_failure"])
def test_long_matches_do_not_recurse(spark, name):
    tag = next(t for t in STOCK_TAGS if t.name == name)
    lines = 50_000
    text = {
        "cc_emit": "a.c:1: error: x" + "\n  more" * lines,
        "nvcxx_emit": '"a.c", line 1: error: x' + "\n  more" * lines,
        "mpi_abort": "Abort(1) on node 2: x" + "\nfn(1)..: y" * lines,
        "java_stack_trace": "FATAL: x\na.b.C" + "\n\tat d(E.java)" * lines,
        "python_traceback": "Traceback (most recent call last):" + "\n  line" * lines + "\nValueError: x",
        "tap_failure": "not ok 1 - x\n" + "  more\n" * lines,
    }[name]
    got = spark.createDataFrame([(text,)], "t string").select(
        F.regexp_extract_all("t", F.lit(tag.regex), F.lit(0)).alias("m")
    ).first().m
    assert got == [text.rstrip("\n") if name == "tap_failure" else text]


def test_other_line_ends_do_not_end_a_line(spark):
    tag = Tag("x", "a.*", "Console", "Info")
    df = spark.createDataFrame([("a\rb\u0085c\nd",)], "t string")
    assert df.select(F.regexp_extract_all("t", F.lit(tag.regex), F.lit(0))).first()[0] == ["a\rb\u0085c"]


def test_bad_tags_are_rejected(spark):
    for tag in (
        Tag("x", "(", "Console", "Info"),
        Tag("x", "a*", "Console", "Info"),
        Tag("x", "a", "Nowhere", "Info"),
        Tag("x", "a", "Console", "Fatal"),
    ):
        with pytest.raises(ValueError):
            check_tags(spark, [tag])
    with pytest.raises(ValueError):
        check_tags(spark, [Tag("x", "a", "Console", "Info")] * 2)


def test_fingerprint_ignores_description_and_severity(spark):
    a = number_tags([Tag("x", "a", "Console", "Info"), Tag("y", "b", "Console", "Info")])
    b = number_tags([Tag("x", "a", "Console", "Error", "d"), Tag("y", "b", "Console", "Info")])
    c = number_tags([Tag("x", "a", "RunName", "Info"), Tag("y", "b", "Console", "Info")])
    assert fingerprint(a) == fingerprint(b) != fingerprint(c)
    assert fingerprint(a) != fingerprint(a[::-1])
    assert fingerprint_df(tags_df(spark, a)).first().tag_schema == fingerprint(a)


def _runs(spark, rows):
    full = [(i, f"u{i}", "FAILURE", name, log, schema, 1) for i, name, log, schema in rows]
    return spark.createDataFrame(full, RUNS)


def test_spans_and_duplicates(spark):
    text = "é1 x22 é1 ß x22 x22"
    tags = number_tags([Tag("num", r"[a-z]?[0-9]+", "Console", "Info"), Tag("name", "r", "RunName", "Info")])
    issues = tagging.console_issues(_runs(spark, [(1, "run", text, None)]), tags)
    got = {r.snippet: (r.snippet_start, r.snippet_end, r.duplicates) for r in issues.collect()}
    raw = text.encode()
    assert {s: d for s, (_, _, d) in got.items()} == {"1": 1, "x22": 2}
    for snippet, (start, end, _) in got.items():
        assert raw[start:end].decode() == snippet
        assert start == min(m.start() for m in re.finditer(snippet.encode(), raw))
    cut = issues.select("snippet", byte_slice(F.lit(text), F.col("snippet_start"), F.col("snippet_end")).alias("cut"))
    assert all(r.snippet == r.cut for r in cut.collect())


def test_only_untagged_runs_are_scanned(spark):
    tags = number_tags([Tag("a", "a+", "Console", "Info")])
    runs = _runs(spark, [(1, "x", "aa", None), (2, "x", "aaa", "old")])
    none = spark.createDataFrame([], "artifact_id long, path string, contents binary, run_id long")
    fresh = tagging.all_issues(runs, none, tags)
    assert [r.snippet for r in fresh.collect()] == ["aa"]
    stored = fresh.withColumn("run_id", F.lit(2).cast("long")).withColumn("snippet", F.lit("kept"))
    both = tagging.all_issues(runs, none, tags, stored)
    assert sorted(r.snippet for r in both.collect()) == ["aa", "kept"]


def test_broken_utf8_artifacts_are_skipped(spark):
    tags = number_tags([Tag("a", "a+", "Artifact", "Info")])
    rows = [(1, "x", bytearray(b"aa\xff"), 1), (2, "x", bytearray(b"aaa"), 1)]
    artifacts = spark.createDataFrame(rows, "artifact_id long, path string, contents binary, run_id long")
    assert [(r.artifact_id, r.snippet) for r in tagging.artifact_issues(artifacts, tags).collect()] == [(2, "aaa")]


def test_stock_issues_hold_those_of_artifacts(spark, monkeypatch):
    texts = ["a.c:3: warning: unused x", "not ok 4 - sum\n  got 1\n"]
    rows = spark.createDataFrame([(i, 1, bytearray(t, "utf-8")) for i, t in enumerate(texts)], "artifact_id long, run_id long, contents binary")
    runs = spark.createDataFrame([(1, "run", None, None)], "run_id long, display_name string, log string, tag_schema string")
    monkeypatch.setattr(queries.ci, "runs_stock", lambda *_: runs)
    monkeypatch.setattr(queries.ci, "artifacts_stock", lambda *_: rows)
    names = {t.tag_id: t.name for t in STOCK_TAGS}
    got = {names[r["tag_id"]] for r in queries.stock_issues(spark, "").collect()}
    assert got == {"cc_warn", "tap_failure"}


def test_spans_come_to_logs_in_buckets(spark):
    """Logs laid out by run once are not exchanged again by the joins with them."""
    logs = [(i, f"u{i}", "FAILURE", f"name{i}", f"line\nboom {i}!\né boom {i}", None, 1) for i in range(50)]
    runs = spark.createDataFrame(logs, RUNS_SCHEMA).select(*RUNS.names)
    laid_out = in_buckets(runs, "run_id")
    tags = number_tags([Tag("boom", r"boom [0-9]+", "Console", "Error"), Tag("name", r"e[0-9]+", "RunName", "Info")])
    none = spark.createDataFrame([], "artifact_id long, path string, contents binary, run_id long")
    issues = cut_lineage(tagging.all_issues(runs, none, tags))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        cut = tagging.issue_snippets(issues, tags_df(spark, tags), laid_out, none)
        plan = cut._jdf.queryExecution().executedPlan().toString()
        got = {r.issue_id: r.snippet for r in cut.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == {r.issue_id: r.snippet for r in issues.collect()} and len(got) == 100
    # Indentation tells what stands above what: no exchange between the scan with the log and its join.
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "Scan parquet" in line and "log" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-|"))
    above, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            above.append(line)
            if "Join" in line:
                break
    assert "Join" in above[-1] and not any("Exchange" in line for line in above), plan


def test_sketches_hide_no_match_and_spare_most_texts(spark):
    rows = [(i, golden(t)[0] * (1 if i % 3 else 3000)) for i, t in enumerate(STOCK_TAGS) if t.field == "Console"]
    rows += [(1000 + i, f"nothing of note in line {i}\n" * 50) for i in range(200)] + [(2000, ""), (2001, "é"), (2002, None)]
    texts = spark.createDataFrame(rows, "run_id long, log string")
    console = [t for t in STOCK_TAGS if t.field == "Console"]
    sketches = cut_lineage(sketch.add_sketches(texts, "log"))
    got = {tuple(r) for r in sketch.sketched_hits(texts, sketches, ["run_id"], "log", console).collect()}
    plain = {tuple(r) for r in tagging.tag_hits(texts, ["run_id"], "log", console).collect()}
    assert got == plain and len(plain) >= len(console)
    # An added tag reads the sketches, and of the texts those that can match.
    for tag in console:
        if tag.needle and len(tag.needle) > 5:
            asked = {r.run_id for r in sketch.possible_tags(sketches, [tag]).collect()}
            assert {i for i, x in rows if x and tag.needle in x} <= asked and len(asked) <= 40
    assert {r.asked[0] for r in sketch.possible_tags(sketches, [Tag("free", "x", "Console", "Info", tag_id=9)]).collect()} == {9}


def test_matches_are_placed_in_as_many_partitions_as_shuffles_have(spark):
    """Rows that compress well are not merged into few tasks, whose memory would grow with the table."""
    runs = spark.range(400).select(F.col("id").alias("run_id"), F.lit("ECONOMY BRASS").alias("display_name"))
    found = tagging.run_name_issues(runs, number_tags([Tag("economy", "ECONOMY", "RunName", "Error")]))
    assert found.count() == 400
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
