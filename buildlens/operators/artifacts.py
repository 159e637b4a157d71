"""Analytics over artifact contents: blob formats, resource usage samples, test reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.functions.text import blob_format, utf8_text

# A usage sample starts every 21 lines; run names whose samples look different.
SAMPLE_LINES = 21
HEAD_LINES = 4
OTHER_TOP_FORMATS = "bsd|aarch64|xpmem"

TOP_PATH = "top.txt"
JUNIT_PATH = "summary.junit.xml"

JUNIT_SCHEMA = (
    "testsuite array<struct<_name: string, _failures: long, _errors: long, _skipped: long, "
    "_tests: long, testcase: array<struct<_name: string, failure: array<string>>>>>"
)


def rule_match(path: Column, rules: list[str]) -> Column:
    """Position of the first rule that matches somewhere in the path, else null."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        out = F.when(path.rlike("(?d)" + rule), F.lit(i)).otherwise(out)
    return out


def matching_artifacts(artifacts: DataFrame, rules: list[str]) -> DataFrame:
    """Artifacts that a rule asks for, with the rule's position."""
    matched = artifacts.withColumn("rule", rule_match(F.col("path"), rules))
    return matched.filter(F.col("rule").isNotNull())


def format_census(artifacts: DataFrame) -> DataFrame:
    formats = artifacts.select(blob_format(F.col("contents")).alias("format"))
    return formats.groupBy("format").agg(F.count(F.lit(1)).alias("n_artifacts"))


def _word(lines: Column, line: int, word: int) -> Column:
    """Word number ``word`` of a line; null beyond the ends."""
    return F.get(F.split(F.trim(F.get(lines, F.lit(line))), r"\s+"), F.lit(word))


def usage_samples(artifacts: DataFrame) -> DataFrame:
    """(run_id, artifact_id, sample, time, cpu, mem) from the usage logs, in percent.

    Samples are cut out of each text in place: no text is shuffled, and a sample's row holds its own
    first lines only.
    """
    texts = artifacts.filter(F.col("path") == TOP_PATH).select(
        "run_id", "artifact_id", F.split(utf8_text(F.col("contents")), "\n", -1).alias("lines")
    )
    starts = F.sequence(F.lit(1), F.size("lines"), F.lit(SAMPLE_LINES))
    heads = F.transform(starts, lambda at: F.slice("lines", at, HEAD_LINES))
    samples = texts.select("run_id", "artifact_id", F.posexplode(heads).alias("sample", "lines"))
    lines = F.col("lines")
    number = lambda line, word: _word(lines, line, word).try_cast("double")
    parsed = samples.select(
        "run_id",
        "artifact_id",
        "sample",
        _word(lines, 0, 2).alias("time"),
        (F.lit(100.0) - number(2, 7)).alias("cpu"),
        (F.lit(100.0) - F.try_divide(number(3, 5), number(3, 3)) * 100).alias("mem"),
    )
    return parsed.filter(F.col("time").isNotNull())


def of_readable_runs(usage: DataFrame, runs: DataFrame) -> DataFrame:
    """Logs, samples or summaries of the runs whose system writes them in the known form."""
    readable = runs.filter(~F.col("display_name").rlike(OTHER_TOP_FORMATS)).select("run_id")
    return usage.join(readable, "run_id", "left_semi")


def usage_summary(usage: DataFrame) -> DataFrame:
    """Samples, peaks and means per run."""
    return usage.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("samples"),
        F.max("cpu").alias("cpu_peak"),
        F.round(F.avg("cpu"), 6).alias("cpu_mean"),
        F.max("mem").alias("mem_peak"),
        F.round(F.avg("mem"), 6).alias("mem_mean"),
    )


def _suites(artifacts: DataFrame) -> DataFrame:
    reports = artifacts.filter(F.col("path") == JUNIT_PATH).select(
        "run_id",
        "artifact_id",
        F.from_xml(utf8_text(F.col("contents")), JUNIT_SCHEMA).alias("report"),
    )
    return reports.select("run_id", "artifact_id", F.posexplode("report.testsuite").alias("suite", "s"))


def junit_suites(artifacts: DataFrame) -> DataFrame:
    """Counts of every suite; unreadable reports give no rows, missing counts are null."""
    return _suites(artifacts).select(
        "run_id",
        "artifact_id",
        "suite",
        F.col("s._failures").alias("failures"),
        F.col("s._errors").alias("errors"),
        F.col("s._skipped").alias("skipped"),
        F.col("s._tests").alias("tests"),
    )


def junit_failures(artifacts: DataFrame) -> DataFrame:
    """Text of every failure of every case."""
    cases = _suites(artifacts).select(
        "run_id", "artifact_id", "suite", F.posexplode("s.testcase").alias("case", "c")
    )
    return cases.select(
        "run_id", "artifact_id", "suite", "case", F.explode("c.failure").alias("failure")
    )
