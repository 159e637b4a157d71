"""Ingest edges, artifacts, plans, streams and the nightly run."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from buildlens.catalog import Config, Tag, number_tags
from buildlens.functions.labels import time_label
from buildlens.functions.text import blob_format
from buildlens.operators import artifacts as art, ingest, stats
from buildlens.plans import nightly
from buildlens.plans.queries import QUERIES
from buildlens.schemas import RUN_DETAILS
from buildlens.session import scratch_path, shared_dir
from buildlens.sources import ci_tables as ci
from buildlens.sources.tables import alive, append, appended, compact, empty_store, read_store, run_state
from buildlens.streaming import incremental
from tests.compare import DATA


def _payload(spark, jobs):
    path = scratch_path(spark, "payload")
    spark.createDataFrame([(json.dumps({"jobs": jobs, "extra": 1}),)], "value string").write.text(path)
    return ingest.read_payload(spark, path)


def _build(number, runs, result="FAILURE"):
    return {"number": number, "url": f"b{number}", "timestamp": number, "result": result, "runs": runs, "more": 0}


def _run(build, name, number=None):
    return {"url": f"r{build}{name}", "number": number or build}


JOBS = [
    {"name": "one", "url": "j1", "builds": [
        _build(9, [_run(9, "x"), _run(9, "old", 8)]), _build(7, None, None), _build(5, [_run(5, "x")])]},
    {"name": "empty", "url": "j2", "builds": []},
    {"name": "blocked", "url": "j3", "builds": [_build(1, [_run(1, "x")])]},
]


def test_ingest_edges(spark):
    jobs = ingest.payload_jobs(_payload(spark, JOBS))
    floors = {r.name: r.retention_floor for r in ingest.job_rows(jobs, 2).collect()}
    assert floors == {"one": 7, "empty": None, "blocked": 1}
    kept = ingest.kept_jobs(jobs, ["blocked"])
    builds = ingest.build_rows(kept, 2)
    assert [(r.number, r.status) for r in builds.orderBy("number").collect()] == [(7, None), (9, "FAILURE")]
    assert [r.url for r in ingest.own_runs(builds).collect()] == ["r9x"]


def test_build_number_zero_drops_the_job(spark):
    builds = spark.createDataFrame(
        [(1, 1, 0, "SUCCESS"), (2, 2, 0, "FAILURE"), (3, 2, 4, "SUCCESS")],
        "build_id long, job_id long, number long, status string",
    )
    assert [tuple(r) for r in stats.latest_builds(builds).collect()] == [(2, 3, 4, "SUCCESS")]


def test_blob_formats(spark):
    cases = {b"": "Null", b"\x89PNG\r\n\x1a\n..": "Png", b"a<svg>": "Svg", b"text": "Utf8", b"\xff<svg": "Unknown", b"\x89PNG": "Unknown"}
    df = spark.createDataFrame([(bytearray(k),) for k in cases], "c binary").select(blob_format(F.col("c")).alias("f"))
    assert [r.f for r in df.collect()] == list(cases.values())


def test_first_rule_wins_and_is_unanchored(spark):
    df = spark.createDataFrame([("logs/top.txt",), ("graph_top.txt.svg",), ("graph_1.svg",), ("other",)], "path string")
    got = [r.rule for r in df.select(art.rule_match(F.col("path"), [r"top.txt", r"graph_.*.svg"]).alias("rule")).collect()]
    assert got == [0, 0, 1, None]


def test_top_and_junit_from_raw_files(spark):
    block = "top - 12:00:01 up 1 day\nTasks\n%Cpu(s):  1.0 us,  2.0 sy,  0.0 ni, 90.5 id,  0.0 wa\nMiB Mem :  2000.0 total,   500.0 free\n" + "x\n" * 16
    xml = ('<testsuites><testsuite failures="2" errors="0" tests="3"><testcase name="a"><failure message="m">one</failure>'
           "<failure>two</failure></testcase><system-out>no</system-out><testcase/></testsuite></testsuites>")
    rows = [(1, "top.txt", block + "\n" + block.replace("12:00:01", "12:01:01"), 1), (2, "top.txt", block, 2),
            (3, "summary.junit.xml", xml, 1), (4, "summary.junit.xml", "<broken", 1)]
    artifacts = spark.createDataFrame([(a, p, bytearray(c.encode()), r) for a, p, c, r in rows],
                                      "artifact_id long, path string, contents binary, run_id long")
    runs = spark.createDataFrame([(1, "linux"), (2, "freebsd64")], "run_id long, display_name string")
    usage = art.of_readable_runs(art.usage_samples(artifacts), runs).orderBy("sample").collect()
    assert [(r.run_id, r.time, r.cpu, r.mem) for r in usage] == [(1, "12:00:01", 9.5, 75.0), (1, "12:01:01", 9.5, 75.0)]
    suites = art.junit_suites(artifacts).collect()
    assert [(r.artifact_id, r.failures, r.skipped, r.tests) for r in suites] == [(3, 2, None, 3)]
    assert [(r.case, r.failure) for r in art.junit_failures(artifacts).collect()] == [(0, "one"), (0, "two")]


def test_time_label_ignores_the_session_zone(spark):
    df = spark.createDataFrame([(1704067200999,)], "ts long").select(time_label(F.col("ts"), -5).alias("l"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert df.first().l == "Dec 31, 2023 07:00:00 PM UTC-5"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_statistics_do_not_read_logs(spark):
    plan = _plan(stats.status_counts(ci.runs_a(spark, DATA), ci.builds_a(spark, DATA)))
    assert "text" not in plan and "Cartesian" not in plan


def test_newest_builds_are_limited_before_the_shuffle(spark):
    plan = _plan(ingest.newest_builds(ci.builds_b(spark, DATA), 5))
    assert plan.count("WindowGroupLimit") == 2


def test_stream_replay_adds_nothing(spark):
    path = scratch_path(spark, "replay")
    ci.payload_a(spark, DATA).repartition(2).write.json(f"{path}/inbox")
    details = ci.details_a(spark, DATA)
    run = lambda: incremental.stream_ingest(spark, f"{path}/inbox", f"{path}/store", details, [], 2).awaitTermination()
    rows = lambda: sorted((r.run_id, r.url) for r in incremental.ingested_runs(spark, f"{path}/store").collect())
    run()
    first = rows()
    run()
    assert rows() == first and len({u for _, u in first}) == len(first)
    # The same snapshots once more, in new files: known runs are not taken in again.
    ci.payload_a(spark, DATA).repartition(1).write.mode("append").json(f"{path}/inbox")
    run()
    assert rows() == first
    # A batch that is repeated leaves the same rows.
    payload = ingest.read_payload(spark, f"{path}/inbox")
    incremental.ingest_batch(payload, 1, f"{path}/store", details, [], 2)
    assert sorted(r.url for r in incremental.ingested_runs(spark, f"{path}/store").collect()) == [u for _, u in sorted(first, key=lambda r: r[1])]


def test_a_batch_reads_as_many_files_however_many_came_before(spark, monkeypatch):
    monkeypatch.setattr(incremental, "COMPACT", 3)
    monkeypatch.setattr(incremental, "BASE_FILES", 2)
    read = []
    earlier = incremental._earlier
    def counted(spark, path, schema, batch_id):
        rows = earlier(spark, path, schema, batch_id)
        read.append((path.rsplit("/", 1)[1], batch_id, len(rows.inputFiles())))
        return rows
    monkeypatch.setattr(incremental, "_earlier", counted)
    details = spark.createDataFrame([(f"r{b}x", None, "x", "FAILURE", "log") for b in range(1, 20)], RUN_DETAILS)
    root = scratch_path(spark, "batches")
    status = lambda n: "ABORTED" if n % 2 else "FAILURE"
    for n in range(11):
        # Every batch changes build 1 and brings a build of its own.
        builds = [_build(n + 2, [_run(n + 2, "x")]), _build(1, [_run(1, "x")], status(n))]
        payload = _payload(spark, [{"name": "one", "url": "j", "builds": builds}])
        incremental.ingest_batch(payload, n, root, details, [], 5)
    state = {r.number: (r.build_id, r.status) for r in incremental.ingested_builds(spark, root).collect()}
    assert len(state) == 12 and state[1][1] == status(10) and len({i for i, _ in state.values()}) == 12
    runs = incremental.ingested_runs(spark, root).collect()
    assert sorted(r.url for r in runs) == sorted(f"r{b}x" for b in range(1, 13)) and len({r.run_id for r in runs}) == 12
    most = lambda lo, hi: max(n for _, batch, n in read if lo <= batch < hi)
    assert most(9, 11) <= most(3, 6)
    # A batch that is repeated, the one that compacts too, leaves the same.
    incremental.ingest_batch(payload, 10, root, details, [], 5)
    assert {r.number: (r.build_id, r.status) for r in incremental.ingested_builds(spark, root).collect()} == state


def test_statistics_place_no_snippets(spark):
    for name in ("issues_found", "unknown_runs", "run_issue_panel"):
        assert "Window" not in _plan(QUERIES[name](spark, DATA)), name


def test_nightly_twice(spark):
    tags = number_tags([
        Tag("boom", r"boom [0-9]+ in the middle of a long message", "Console", "Error"),
        Tag("name", r"x", "RunName", "Metadata"),
        Tag("unused", r"never", "Console", "Info"),
    ])
    config = Config(tags=tags, blocklist=["blocked"], last_n_history=2, artifact_rules=["top.txt"])
    details = spark.createDataFrame(
        [(f"r{b}x", None, f"x{b}", "FAILURE", f"log\nboom {b} in the middle of a long message") for b in (3, 5, 7, 9, 11)],
        RUN_DETAILS,
    )
    files = spark.createDataFrame([(f"r{b}x", p, bytearray(b"t")) for b in (5, 9) for p in ("a/top.txt", "core")],
                                  "url string, path string, contents binary")
    root = scratch_path(spark, "nightly")
    night = lambda store, jobs, v, c=config: nightly.nightly(store, _payload(spark, jobs), details, files, c, root, v)
    jobs = [{"name": "one", "url": "j", "builds": [_build(9, [_run(9, "x")]), _build(5, [_run(5, "x")])]}]
    scopes = lambda: {str(p) for p in Path(shared_dir(spark).removeprefix("file:")).glob("scope-*")}
    before = scopes()
    store = night(empty_store(spark), jobs, 0)
    assert scopes() == before  # no scratch is left
    assert sorted(r.snippet for r in store["issues"].collect() if "boom" in r.snippet) == [
        f"boom {b} in the middle of a long message" for b in (5, 9)]
    assert sorted(r.name for r in store["tags"].collect()) == ["boom", "name"]
    assert store["similarities"].count() == 2 and store["artifacts"].count() == 2

    # Nothing new: the store stays as it is, and no log, artifact or issue is written.
    files_of = lambda *names: {str(f) for n in names for f in Path(root, n).rglob("*.parquet")}
    large = ("runs", "artifacts", "issues", "similarities", "run_state")
    written = files_of(*large)
    again = night(store, jobs, 1)
    assert files_of(*large) == written and files_of("builds") > files_of("builds/v=0")
    for name in ("runs", "issues", "similarities", "builds"):
        assert sorted(map(str, again[name].collect())) == sorted(map(str, store[name].collect())), name

    # A newer build moves the floor: the oldest build goes with its run, issues and artifacts.
    jobs[0]["builds"].insert(0, _build(11, [_run(11, "x")]))
    third = night(again, jobs, 2)
    assert {f.split("/")[-2] for f in files_of("runs", "artifacts", "issues") - written} == {"night=2"}
    # Of the issues only those of the new run are written.
    new_run = third["runs"].filter("url = 'r11x'").first().run_id
    assert {r.run_id for r in spark.read.parquet(f"{root}/issues/night=2").collect()} == {new_run}
    plan = _plan(third["runs"].filter("tag_schema is null").select("log"))
    assert "dynamicpruning" in plan.lower() and "ReadSchema: struct<run_id:bigint,log:string>" in plan
    # What a night leaves that was never published is not seen.
    append(third["runs"], root, "runs", 3)
    assert read_store(spark, root)["runs"].count() == 2
    # Earlier nights can still be read.
    assert sorted(r.url for r in read_store(spark, root, 0)["runs"].collect()) == ["r5x", "r9x"]
    assert sorted(r.number for r in third["builds"].collect()) == [9, 11]
    assert sorted(r.url for r in third["runs"].collect()) == ["r11x", "r9x"]
    assert third["artifacts"].count() == 1 and third["similarities"].count() == 2
    assert third["issues"].join(third["runs"], "run_id", "left_anti").isEmpty()

    # Another catalog: all runs are tagged anew.
    other = Config(tags=tags[:1], last_n_history=2)
    fourth = night(third, jobs, 3, other)
    assert {r.snippet[:4] for r in fourth["issues"].collect()} == {"boom"}
    assert fourth["runs"].select("tag_schema").distinct().count() == 1

    # Compacted, everything lies in one night.
    rows = lambda store, name: sorted(str(r) for r in store[name].drop("night", "tagged").collect())
    # The issues of the old catalog are still in their folders, and passed over.
    assert spark.read.parquet(f"{root}/issues").count() > fourth["issues"].count()
    fifth = compact(spark, root, 4)
    assert spark.read.parquet(f"{root}/issues/night=4").count() == fifth["issues"].count()
    for name in ("runs", "artifacts", "issues"):
        assert rows(fifth, name) == rows(fourth, name)
    assert [r.night for r in fifth["runs"].select("night").distinct().collect()] == [4]
    assert alive(appended(spark, root, "artifacts", F.col("night") < 4), run_state(fifth["runs"])).isEmpty()


def test_repeated_reports(spark):
    """A job, build or run listed again is one row; the later report counts, at equal times too."""
    def job(result):
        build = _build(4, [_run(4, "x"), _run(4, "x")], result)
        return {"name": "one", "url": "j", "builds": [build]}

    path = scratch_path(spark, "reports")
    for result in (None, "UNSTABLE", "SUCCESS"):
        lines = [(json.dumps({"jobs": [job("FAILURE")]}),), (json.dumps({"jobs": [job(result)]}),)]
        spark.createDataFrame(lines, "value string").coalesce(1).write.mode("append").text(path)
    details = spark.createDataFrame([("r4x", None, "x", "FAILURE", "log")], RUN_DETAILS)
    files = spark.createDataFrame([("r4x", "top.txt", bytearray(b"t"))], "url string, path string, contents binary")
    config = Config(tags=[], artifact_rules=["top.txt"])
    store = nightly.nightly(
        empty_store(spark), ingest.read_payload(spark, path), details, files, config, scratch_path(spark, "twice"), 0
    )
    assert [(r.run_id, r.url) for r in store["runs"].collect()] == [(1, "r4x")]
    assert store["artifacts"].count() == 1 and store["jobs"].count() == 1
    assert [(r.number, r.status) for r in store["builds"].collect()] == [(4, "SUCCESS")]

    root = scratch_path(spark, "stream")
    incremental.stream_ingest(spark, path, root, details, [], 2).awaitTermination()
    assert [r.url for r in incremental.ingested_runs(spark, root).collect()] == ["r4x"]
    assert [r.status for r in incremental.ingested_builds(spark, root).collect()] == ["SUCCESS"]
    # The next batch appends the rows it changes; the ids stay, the last change counts.
    more = {"jobs": [job("ABORTED"), {"name": "two", "url": "j2", "builds": [_build(7, [_run(7, "x")])]}]}
    spark.createDataFrame([(json.dumps(more),)], "value string").coalesce(1).write.mode("append").text(path)
    incremental.stream_ingest(spark, path, root, details, [], 2).awaitTermination()
    assert sorted((r.build_id, r.number, r.status) for r in incremental.ingested_builds(spark, root).collect()) == [
        (1, 4, "ABORTED"), (2, 7, "FAILURE")]
    assert sorted((r.job_id, r.name) for r in incremental.ingested_jobs(spark, root).collect()) == [(1, "one"), (2, "two")]
    more["jobs"].pop(0)
    spark.createDataFrame([(json.dumps(more),)], "value string").coalesce(1).write.mode("append").text(path)
    incremental.stream_ingest(spark, path, root, details, [], 2).awaitTermination()
    assert spark.read.parquet(f"{root}/builds/batch=2").count() == 1
    assert incremental.ingested_builds(spark, root).count() == 2


def test_empty_nights(spark):
    root = scratch_path(spark, "nights")
    details = spark.createDataFrame([], RUN_DETAILS)
    files = spark.createDataFrame([], "url string, path string, contents binary")
    with pytest.raises(ValueError):
        read_store(spark, root)
    store = empty_store(spark)
    for n in range(2):
        store = nightly.nightly(store, _payload(spark, []), details, files, Config(), root, n)
        assert all(store[name].isEmpty() for name in ("jobs", "builds", "runs", "artifacts", "issues"))


def test_config_file(spark, tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('blocklist = ["a"]\nthreshold = 0.8\ntimezone = 2\n[[artifact]]\npath = "x.txt"\n'
                    '[[tag]]\nname = "t"\ndesc = "d"\npattern = "p+"\nfrom = "Console"\nseverity = "Error"\n')
    config = Config.load(str(path))
    assert (config.blocklist, config.threshold, config.last_n_history, config.utc_offset_hours) == (["a"], 0.8, 5, 2)
    assert config.tags[0].tag_id == 1 and config.artifact_rules == ["x.txt"]
