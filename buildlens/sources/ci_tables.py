"""Continuous-integration tables derived from the driver's Parquet tables.

Every derivation works row by row or groups by a key whose groups are bounded by how it is built,
so the derived tables grow with the given ones and no hot source, user or customer ends in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.catalog import NODE_TAGS, Tag, number_tags
from buildlens.functions.labels import is_bad
from buildlens.session import dealt
from buildlens.sources.tables import read_table

EPOCH_MS = 1704067200000
DAY_MS = 86400000
# Build ids are job * JOB_SPAN + number.
JOB_SPAN = 10**10

# Tags over the texts of set A.
TEXT_TAGS = number_tags(
    [
        # Whole lines only: starting at line starts gives the same matches without retrying each place.
        Tag(
            "license",
            r"(?i)[^\n]*(license|copyright)[^\n]*",
            "Console",
            "Error",
            scan=r"(?im)^[^\n]*(license|copyright)[^\n]*",
        ),
        Tag("secret", r'token = "[0-9a-f]{40}"', "Console", "Error", needle='token = "'),
        Tag("ip_addr", r"[0-9]{1,3}(\.[0-9]{1,3}){3}", "Console", "Warning"),
        Tag("shout", r"[^\n]*!![^\n]*", "Console", "Info", scan=r"(?m)^[^\n]*!![^\n]*", needle="!!"),
        Tag("headline", r"^[^\n]{20,}", "Console", "Warning"),
        Tag("junk", r"[#$&%*]{3}", "Console", "Metadata"),
        Tag("gnu", r"(gnu)|(gcc[0-9]*)", "RunName", "Metadata"),
        Tag("clang", r"clang", "RunName", "Metadata"),
        Tag("intel", r"intel(-oneapi)?", "RunName", "Metadata"),
        Tag("nvidia", r"nvidia", "RunName", "Metadata"),
        Tag("linux", r"ubuntu([0-9]{1,2}.[0-9]{1,2})?", "RunName", "Metadata"),
        Tag("bsd", r"freebsd64", "RunName", "Metadata"),
        Tag("osx", r"osx", "RunName", "Metadata"),
        Tag("xml_failure", r"<failure>[^<]*</failure>", "Artifact", "Warning", needle="<failure>"),
    ]
)

# Tags over the run names of set B.
NAME_TAGS = number_tags(
    [
        Tag("economy", r"ECONOMY", "RunName", "Error"),
        Tag("promo", r"PROMO", "RunName", "Warning"),
        Tag("small", r"SMALL", "RunName", "Info"),
        Tag("teens", r"Brand#1[0-9]", "RunName", "Metadata"),
        Tag("twenties", r"Brand#2[0-9]", "RunName", "Metadata"),
        Tag("absent", r"Brand#99", "RunName", "Error"),
    ]
)


def _div(column: str, by: int) -> Column:
    """Whole-number division, exact for ids of any size."""
    return F.expr(f"{column} div {by}")


def _millis(ts: Column) -> Column:
    """Milliseconds since the epoch of a zoneless timestamp, whatever the session time zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MILLISECOND", epoch, ts)


def _pick(col: Column, values: dict[int, str]) -> Column:
    out = None
    for key, value in values.items():
        out = F.when(col == key, value) if out is None else out.when(col == key, value)
    return out


# ---- set A: texts as logs -----------------------------------------------------------------------


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc_id = F.col("doc_id")
    job_id = F.substring("source", 4, 20).cast("long")
    number = _div("doc_id", 100) + 1
    compiler = _pick(doc_id % 4, {0: "gcc12", 1: "clang", 2: "intel-oneapi", 3: "nvidia"})
    system = _pick(doc_id % 3, {0: "ubuntu22.04", 1: "freebsd64", 2: "osx"})
    status = F.when((number + job_id) % 3 == 0, "SUCCESS").otherwise(
        _pick(doc_id % 6, {0: "SUCCESS", 1: "FAILURE", 2: "UNSTABLE", 3: "ABORTED", 4: "NOT_BUILT"})
    )
    return read_table(spark, sf_dir, "documents").select(
        doc_id.alias("run_id"),
        "source",
        job_id.alias("job_id"),
        number.alias("number"),
        (job_id * JOB_SPAN + number).alias("build_id"),
        status.alias("status"),
        F.concat("source", F.lit("/"), compiler, F.lit("-"), system, F.lit("-"), "lang").alias(
            "display_name"
        ),
        "text",
    )


def jobs_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("source").distinct()
    return docs.select(
        F.substring("source", 4, 20).cast("long").alias("job_id"),
        F.col("source").alias("name"),
        F.concat(F.lit("job/"), "source").alias("url"),
    )


def builds_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    worst = F.min(
        F.coalesce(_rank_of(F.col("status")), F.lit(4))
    )
    grouped = _documents(spark, sf_dir).groupBy("build_id", "job_id", "number").agg(worst.alias("worst"))
    return grouped.select(
        "build_id",
        F.concat(F.lit("build/"), F.col("build_id").cast("string")).alias("url"),
        _pick(
            F.col("worst"),
            {0: "FAILURE", 1: "UNSTABLE", 2: "ABORTED", 3: "SUCCESS", 4: "NOT_BUILT"},
        ).alias("status"),
        "number",
        (F.lit(EPOCH_MS) + F.col("number") * DAY_MS).alias("ts_ms"),
        "job_id",
    )


def _rank_of(status: Column) -> Column:
    return (
        F.when(status == "FAILURE", 0)
        .when(status == "UNSTABLE", 1)
        .when(status == "ABORTED", 2)
        .when(status == "SUCCESS", 3)
    )


def _runs(docs: DataFrame, log: Column) -> DataFrame:
    return docs.select(
        "run_id",
        F.concat(F.lit("run/"), F.col("run_id").cast("string")).alias("url"),
        "status",
        "display_name",
        F.when(is_bad(F.col("status")), log).alias("log"),
        F.lit(None).cast("string").alias("tag_schema"),
        "build_id",
    )


def runs_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(_documents(spark, sf_dir), F.col("text"))


# Console lines added to set A for the stock catalog, by run_id div 6 % 12, so that each meets
# every kind of status; {n} is the run id.
STOCK_MESSAGES = {
    0: "lib/queue.c:{n}:3: error: no member called 'tail'\n   q->tail = 0;\n\nlib/queue.h:21: note: declared there\n   struct q;",
    1: '"lib/ring.c", line 40: error: too few arguments\n      ring_push(r, {n});',
    2: "NVRTC Internal compiler error. register allocation gave up in kernel {n}",
    3: "rsync: logs/part{n}.txt: No space left on device",
    4: "Agent went offline during the build",
    5: "SEVERE: worker {n} gave no answer\norg.sample.net.Timeout: 30 s\n    at org.sample.net.Poll.once(Poll.java:8)\n    at org.sample.Main.main(Main.java:{n})",
    6: "Abort({n}) on node 12: no route between ranks\nroute_find(17): table is empty\nroute_open(230)..: gave up",
    7: 'Traceback (most recent call last):\n  File "report.py", line {n}, in collect\n    rows = load(path)\nValueError: column {n} is missing',
    8: "./ring: error while loading shared libraries: libring.so.{n}: not there",
    9: "cpi: lib/heap.c:{n}: void grow(void): Assertion `size > 0' failed.",
    10: "Assertion failed in file lib/table.c at line {n}: slots == used",
    11: 'syntax error at tools/list.pl line {n}, near "my $"',
}

# Text after "Building remotely on " in the first log line, by run_id % 17.
STOCK_NODES = [t.needle.removeprefix("Building remotely on ") for t in NODE_TAGS]


# Added to the run names, by run_id div 12 % 6, so that each meets every system and compiler.
STOCK_SUFFIXES = {0: "", 1: "-aarch64", 2: "-ch3-nemesis-tcp", 3: "-ch3-sock", 4: "-ch4-ofi-vci", 5: "-ch4-ucx"}

# Texts of the build logs kept as artifacts, by run_id % 3; {n} is the run id.
STOCK_LOGS = {
    0: "lib/heap.c:{n}:9: warning: comparison is always true\n   if (size >= 0)\n      ^\nlib/heap.h:4: note: size is declared here\ndone",
    1: "ok 1 - empty table\nnot ok 2 - table of {n} rows\n  rows: want {n}\n# rows: got 0\nok 3 - full table",
    2: "lib/heap.c:{n}: warning: cast drops bits\nnot ok {n} - heap\n# at line {n}\nlib/list.c:3:1: warning: unused name\n   n",
}
# Ids beyond those of the other artifacts.
STOCK_ARTIFACTS = 10**15


def runs_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set A with more in its run names, a build-node line before and a tool message after every log."""
    run_id = F.col("run_id")
    node = F.element_at(F.array(*[F.lit(n) for n in STOCK_NODES]), (run_id % 17).cast("int") + 1)
    message = F.replace(
        _pick(F.expr("run_id div 6") % 12, STOCK_MESSAGES), F.lit("{n}"), run_id.cast("string")
    )
    log = F.concat(
        F.lit("Building remotely on "), node, F.lit(" in workspace\n"), "text", F.lit("\n"), message
    )
    suffix = _pick(F.expr("run_id div 12") % 6, STOCK_SUFFIXES)
    docs = _documents(spark, sf_dir).withColumn("display_name", F.concat("display_name", suffix))
    return _runs(docs, log)


def artifacts_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The artifacts of set A and, for every third hundred of runs, its text and a tool's log as a file."""
    run_id = F.col("run_id")
    log = F.replace(_pick(run_id % 3, STOCK_LOGS), F.lit("{n}"), run_id.cast("string"))
    logs = _documents(spark, sf_dir).filter(F.expr("run_id div 100") % 3 == 0).select(
        (run_id + STOCK_ARTIFACTS).alias("artifact_id"),
        F.lit("build.log").alias("path"),
        F.encode(F.concat("text", F.lit("\n"), log), "UTF-8").alias("contents"),
        "run_id",
    )
    return artifacts_a(spark, sf_dir).unionByName(logs)


# ---- artifacts ----------------------------------------------------------------------------------


def junit_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per conversation and hundred turns: a case per turn."""
    turn = F.col("turn")
    fails = (F.col("role") == "assistant") & (turn % 3 == 1)
    case = F.concat(
        F.lit('<testcase name="t'),
        turn.cast("string"),
        F.lit('">'),
        F.when(fails, F.concat(F.lit("<failure>case "), turn.cast("string"), F.lit("</failure>"))).otherwise(""),
        F.lit("</testcase>"),
    )
    part = _div("turn", 100)
    reports = (
        read_table(spark, sf_dir, "conversations")
        .select("conv_id", "turn", part.alias("part"), fails.alias("fails"), case.alias("case"))
        .groupBy("conv_id", "part")
        .agg(
            F.count_if("fails").alias("failures"),
            F.count_if(turn % 4 == 3).alias("skipped"),
            F.count(F.lit(1)).alias("tests"),
            F.array_sort(F.collect_list(F.struct("turn", "case"))).alias("cases"),
        )
    )
    attribute = lambda name, col: F.concat(F.lit(f' {name}="'), F.col(col).cast("string"), F.lit('"'))
    text = F.concat(
        F.lit("<testsuites><testsuite"),
        attribute("failures", "failures"),
        F.lit(' errors="0"'),
        attribute("skipped", "skipped"),
        attribute("tests", "tests"),
        F.lit(">"),
        F.array_join("cases.case", ""),
        F.lit("</testsuite></testsuites>"),
    )
    return reports.select(
        ((F.col("conv_id") * 10000 + F.col("part")) * 3).alias("artifact_id"),
        F.lit("summary.junit.xml").alias("path"),
        F.encode(text, "UTF-8").alias("contents"),
        (F.col("conv_id") * 5).alias("run_id"),
    )


def top_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One usage log per user and thousand events: a 20-line sample and a blank line per event."""
    event_id = F.col("event_id")
    block = F.concat(
        F.lit("top - "),
        F.date_format("ts", "HH:mm:ss"),
        F.lit(" up 1 day\nTasks: 1 total\n%Cpu(s): 1.0 us, 1.0 sy, 0.0 ni, "),
        (event_id % 101).cast("string"),
        F.lit(" id,\nMiB Mem : 1000.0 total, "),
        (event_id % 1001).cast("string"),
        F.lit(" free,\n" + "-\n" * 16),
    )
    logs = (
        read_table(spark, sf_dir, "events")
        .select(
            "user_id", "ts", "event_id", _div("event_id", 1000).alias("part"), block.alias("block")
        )
        .groupBy("user_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "block"))).alias("blocks"))
    )
    return logs.select(
        ((F.col("part") * 10**9 + F.col("user_id")) * 3 + 1).alias("artifact_id"),
        F.lit("top.txt").alias("path"),
        F.encode(F.array_join("blocks.block", "\n"), "UTF-8").alias("contents"),
        F.col("user_id").alias("run_id"),
    )


def blob_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as png, svg, empty, text and broken blobs."""
    kind = F.col("page_id") % 5
    contents = (
        F.when(kind == 0, F.concat(F.unhex(F.lit("89504E470D0A1A0A")), F.encode("url", "UTF-8")))
        .when(kind == 1, F.encode(F.lit("<svg/>"), "UTF-8"))
        .when(kind == 2, F.unhex(F.lit("")))
        .when(kind == 3, F.encode("html", "UTF-8"))
        .otherwise(F.unhex(F.lit("FF")))
    )
    path = F.when(kind == 1, F.concat(F.lit("graph_"), F.col("page_id").cast("string"), F.lit(".svg"))).otherwise(
        F.concat(F.lit("blob/"), F.col("page_id").cast("string"))
    )
    return read_table(spark, sf_dir, "pages").select(
        (F.col("page_id") * 3 + 2).alias("artifact_id"),
        path.alias("path"),
        contents.alias("contents"),
        F.col("page_id").alias("run_id"),
    )


def artifacts_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        junit_artifacts(spark, sf_dir)
        .unionByName(top_artifacts(spark, sf_dir))
        .unionByName(blob_artifacts(spark, sf_dir))
    )


# ---- project snapshots --------------------------------------------------------------------------

BLOCKED_JOB = "src3/0"


def payload_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot per job: a job is a source and a stretch of 500 documents, five builds at most.

    Builds come newest first; every second build also lists a run of the number before it. Jobs of
    src4 list no builds.
    """
    docs = _documents(spark, sf_dir).withColumn("block", _div("run_id", 500))
    name = F.concat("source", F.lit("/"), F.col("block").cast("string"))
    run_url = F.concat(F.lit("run/"), F.col("run_id").cast("string"))
    listed = docs.select(
        name.alias("name"),
        "number",
        "build_id",
        "status",
        F.struct(run_url.alias("url"), F.col("number").alias("number")).alias("run"),
        F.when(
            F.col("number") % 2 == 0,
            F.struct(F.concat(run_url, F.lit("/before")).alias("url"), (F.col("number") - 1).alias("number")),
        ).alias("foreign_run"),
    )
    builds = listed.groupBy("name", "number", "build_id").agg(
        F.min(F.coalesce(_rank_of(F.col("status")), F.lit(4))).alias("worst"),
        F.array_sort(F.concat(F.collect_list("run"), F.collect_list("foreign_run"))).alias("runs"),
    )
    build = F.struct(
        F.col("number"),
        F.concat(F.lit("build/"), F.col("build_id").cast("string")).alias("url"),
        (F.lit(EPOCH_MS) + F.col("number") * DAY_MS).alias("timestamp"),
        _pick(
            F.col("worst"),
            {0: "FAILURE", 1: "UNSTABLE", 2: "ABORTED", 3: "SUCCESS", 4: "NOT_BUILT"},
        ).alias("result"),
        F.col("runs"),
    )
    jobs = builds.groupBy("name").agg(F.sort_array(F.collect_list(build), asc=False).alias("builds"))
    none = F.filter("builds", lambda b: F.lit(False))
    return jobs.select(
        F.array(
            F.struct(
                F.col("name"),
                F.concat(F.lit("job/"), "name").alias("url"),
                F.when(F.col("name").startswith("src4/"), none).otherwise(F.col("builds")).alias("builds"),
            )
        ).alias("jobs")
    )


def details_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the server tells of each run; every third run has no full name."""
    return _documents(spark, sf_dir).select(
        F.concat(F.lit("run/"), F.col("run_id").cast("string")).alias("url"),
        F.when(F.col("run_id") % 3 != 0, F.col("display_name")).alias("full_display_name"),
        F.concat(F.lit("#"), F.col("number").cast("string")).alias("display_name"),
        "status",
        F.col("text").alias("log"),
    )


# ---- set B: orders as builds, line items as runs ------------------------------------------------


def jobs_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("job_id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("job/"), "c_name").alias("url"),
    )


def builds_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("build_id"),
        F.concat(F.lit("build/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.when(F.col("o_orderstatus") == "F", "FAILURE")
        .when(F.col("o_orderstatus") == "O", "SUCCESS")
        .otherwise("UNSTABLE")
        .alias("status"),
        F.col("o_orderkey").alias("number"),
        _millis(F.col("o_orderdate")).alias("ts_ms"),
        F.col("o_custkey").alias("job_id"),
    )


def runs_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items without their repeats; tag schema missing, old or current by status."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    items = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus"
    )
    flags = F.min(F.concat("l_returnflag", "l_linestatus"))
    # The least text is found by sorting, so the rows are dealt first and sorted in small partitions only.
    grouped = (
        dealt(items.join(part, items.l_partkey == part.p_partkey), "l_orderkey", "l_linenumber")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(
            flags.alias("flags"),
            F.concat(F.min("p_type"), F.lit("/"), F.min("p_brand")).alias("display_name"),
        )
    )
    run_id = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    status = (
        F.when(F.col("flags") == "AF", "FAILURE")
        .when(F.col("flags") == "AO", "ABORTED")
        .when(F.col("flags") == "NF", "UNSTABLE")
        .when(F.col("flags") == "NO", "SUCCESS")
        .when(F.col("flags") == "RF", "NOT_BUILT")
    )
    schema = F.when(F.col("flags") == "AF", None).when(F.col("flags") == "NO", "old").otherwise("current")
    return grouped.select(
        run_id.alias("run_id"),
        F.concat(F.lit("run/"), run_id.cast("string")).alias("url"),
        status.alias("status"),
        "display_name",
        F.lit(None).cast("string").alias("log"),
        schema.alias("tag_schema"),
        F.col("l_orderkey").alias("build_id"),
    )


def artifacts_b(runs: DataFrame) -> DataFrame:
    """One small text artifact per run."""
    return runs.select(
        F.col("run_id").alias("artifact_id"),
        F.lit("summary.txt").alias("path"),
        F.encode("display_name", "UTF-8").alias("contents"),
        "run_id",
    )


def groups_b(issues: DataFrame) -> DataFrame:
    """Equal snippets of a stretch of 64 run ids as one group."""
    block = _div("run_id", 64).cast("string")
    return issues.select(F.md5(F.concat("snippet", F.lit("/"), block)).alias("group_id"), "issue_id")
