"""Regex scan of text columns into issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildlens.catalog import Tag
from buildlens.functions.ids import issue_key
from buildlens.functions.text import byte_slice, utf8_text
from buildlens.schemas import FIELDS
from buildlens.session import dealt


def _of_field(tags: list[Tag], field: str) -> list[Tag]:
    return [t for t in tags if t.field == field]


def _guard(text: Column, tag: Tag, value: Column) -> Column:
    """``value``, evaluated only for texts that can match."""
    return F.when(text.contains(tag.needle), value) if tag.needle else value


def tag_hits(df: DataFrame, keys: list[str], text: str, tags: list[Tag]) -> DataFrame:
    """(keys, tag_id) for every tag whose pattern occurs in ``text``."""
    col = F.col(text)
    tests = [
        F.struct(
            F.lit(t.tag_id).cast("long").alias("tag_id"),
            _guard(col, t, F.rlike(col, F.lit(t.regex))).alias("hit"),
        )
        for t in tags
    ]
    if not tags:
        return df.select(*keys, F.lit(None).cast("long").alias("tag_id")).limit(0)
    return df.select(*keys, F.inline(F.array(*tests))).filter("hit").drop("hit")


def _matches(df: DataFrame, keys: list[str], text: str, tags: list[Tag]) -> DataFrame:
    """(keys, text, tag_id, regex, matches): all matches of every tag that occurs in the text."""
    col = F.col(text)
    found = [
        F.struct(
            F.lit(t.tag_id).cast("long").alias("tag_id"),
            F.lit(t.regex).alias("regex"),
            _guard(col, t, F.regexp_extract_all(col, F.lit(t.regex), F.lit(0))).alias("matches"),
        )
        for t in tags
    ]
    return df.select(*keys, text, F.inline(F.array(*found))).filter(F.size("matches") > 0)


def _no_issues(df: DataFrame, keys: list[str]) -> DataFrame:
    empty = df.select(*keys).limit(0)
    return empty.select(
        *keys,
        F.lit(None).cast("long").alias("tag_id"),
        F.lit(None).cast("string").alias("snippet"),
        F.lit(None).cast("long").alias("duplicates"),
        F.lit(None).cast("long").alias("snippet_start"),
        F.lit(None).cast("long").alias("snippet_end"),
    )


def scan_text(
    df: DataFrame, keys: list[str], text: str, tags: list[Tag], spans: bool = True
) -> DataFrame:
    """Distinct snippets per (keys, tag) with their extra occurrences and first byte span.

    One pass over the texts for all tags; only the snippets are shuffled, never the texts. Without
    spans the count is combined before the shuffle.
    """
    if not tags:
        out = _no_issues(df, keys)
        return out if spans else out.drop("snippet_start", "snippet_end")
    found = _matches(df, keys, text, tags)
    duplicates = (F.count(F.lit(1)) - 1).alias("duplicates")
    if not spans:
        exploded = found.select(*keys, "tag_id", F.explode("matches").alias("snippet"))
        exploded = exploded.filter(F.col("snippet") != "")
        return exploded.groupBy(*keys, "tag_id", "snippet").agg(duplicates)

    # The pieces between the matches: a match starts after all earlier pieces and matches.
    pieces = F.split(F.col(text), F.col("regex"), -1)
    parts = found.select(
        *keys, "tag_id", F.posexplode(F.arrays_zip(F.col("matches").alias("m"), pieces.alias("p")))
    ).filter(F.col("col.m").isNotNull())
    sized = parts.select(
        *keys,
        "tag_id",
        "pos",
        F.col("col.m").alias("snippet"),
        F.octet_length("col.m").cast("long").alias("size"),
        F.octet_length("col.p").cast("long").alias("gap"),
    )
    # One text's matches of one tag: as many as fit into a single row of the input.
    order = Window.partitionBy(*keys, "tag_id").orderBy("pos")
    placed = dealt(sized, *keys, "tag_id").withColumn("start", F.sum(F.col("gap") + F.col("size")).over(order) - F.col("size"))
    # A pattern such as \b also matches between characters; that is no issue.
    return (
        placed.filter(F.col("size") > 0)
        .groupBy(*keys, "tag_id", "snippet")
        .agg(duplicates, F.min("start").alias("snippet_start"))
        .withColumn("snippet_end", F.col("snippet_start") + F.octet_length("snippet"))
    )


def _finish(df: DataFrame, field: str) -> DataFrame:
    """Issue rows with their key."""
    artifact = F.col("artifact_id") if "artifact_id" in df.columns else F.lit(None).cast("long")
    return df.withColumn("artifact_id", artifact).select(
        issue_key(
            F.col("run_id"),
            F.lit(FIELDS.index(field)),
            F.col("artifact_id"),
            F.col("tag_id"),
            F.col("snippet_start"),
        ).alias("issue_id"),
        "run_id",
        "artifact_id",
        "tag_id",
        "snippet",
        "snippet_start",
        "snippet_end",
        "duplicates",
    )


def run_name_issues(runs: DataFrame, tags: list[Tag]) -> DataFrame:
    """Issues in the display names of all runs."""
    return _finish(
        scan_text(runs, ["run_id"], "display_name", _of_field(tags, "RunName")), "RunName"
    )


def console_issues(runs: DataFrame, tags: list[Tag]) -> DataFrame:
    """Issues in the logs of the runs that have one."""
    logs = runs.filter(F.col("log").isNotNull())
    return _finish(scan_text(logs, ["run_id"], "log", _of_field(tags, "Console")), "Console")


def artifact_texts(artifacts: DataFrame) -> DataFrame:
    """(run_id, artifact_id, text) of the artifacts that are valid UTF-8."""
    texts = artifacts.select("run_id", "artifact_id", utf8_text(F.col("contents")).alias("text"))
    return texts.filter(F.col("text").isNotNull())


def run_hits(runs: DataFrame, artifacts: DataFrame, tags: list[Tag]) -> DataFrame:
    """(run_id, tag_id): the tags of every field that occur in a run's name, log or artifacts."""
    texts = artifact_texts(artifacts).join(runs.select("run_id"), "run_id", "left_semi")
    return (
        tag_hits(runs, ["run_id"], "display_name", _of_field(tags, "RunName"))
        .unionByName(tag_hits(runs, ["run_id"], "log", _of_field(tags, "Console")))
        .unionByName(tag_hits(texts, ["run_id"], "text", _of_field(tags, "Artifact")).distinct())
    )


def artifact_issues(artifacts: DataFrame, tags: list[Tag]) -> DataFrame:
    """Issues in the contents of text artifacts, deduplicated per artifact."""
    texts = artifact_texts(artifacts)
    return _finish(
        scan_text(texts, ["run_id", "artifact_id"], "text", _of_field(tags, "Artifact")), "Artifact"
    )


def run_snippets(runs: DataFrame, artifacts: DataFrame, tags: list[Tag]) -> DataFrame:
    """(run_id, artifact_id, tag_id, snippet, duplicates) of every field, without keys and spans.

    For counts and panels: no piece of a text is placed, and equal snippets of a text are combined
    before anything is shuffled.
    """
    texts = artifact_texts(artifacts)
    names = scan_text(runs, ["run_id"], "display_name", _of_field(tags, "RunName"), spans=False)
    logs = scan_text(runs.filter("log is not null"), ["run_id"], "log", _of_field(tags, "Console"), spans=False)
    found = scan_text(texts, ["run_id", "artifact_id"], "text", _of_field(tags, "Artifact"), spans=False)
    found = found.join(runs.select("run_id"), "run_id", "left_semi")
    own = names.unionByName(logs).withColumn("artifact_id", F.lit(None).cast("long"))
    return own.unionByName(found).select("run_id", "artifact_id", "tag_id", "snippet", "duplicates")


def untagged_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("tag_schema").isNull())


def all_issues(
    runs: DataFrame, artifacts: DataFrame, tags: list[Tag], stored: DataFrame | None = None
) -> DataFrame:
    """Fresh issues of the runs not tagged yet, plus the stored issues of the other runs.

    Beside a store few runs are new: their artifacts are picked first, then scanned. Without one
    all artifacts are scanned where they lie and only their issues meet the runs.
    """
    todo = untagged_runs(runs)
    ids = todo.select("run_id")
    fresh = run_name_issues(todo, tags).unionByName(console_issues(todo, tags))
    if stored is None:
        found = artifact_issues(artifacts, tags)
        return fresh.unionByName(found.join(ids, "run_id", "left_semi").select(*found.columns))
    fresh = fresh.unionByName(
        artifact_issues(artifacts.join(ids, "run_id", "left_semi"), tags)
    )
    done = runs.filter(F.col("tag_schema").isNotNull()).select("run_id")
    return fresh.unionByName(stored.join(done, "run_id", "left_semi").select(*fresh.columns))


def stamp(runs: DataFrame, tag_schema: str) -> DataFrame:
    """Mark the untagged runs of this batch as tagged with ``tag_schema``."""
    return runs.withColumn("tag_schema", F.coalesce("tag_schema", F.lit(tag_schema)))


def with_tags(issues: DataFrame, tags: DataFrame) -> DataFrame:
    """Issues with name, description, field and severity of their tag."""
    return issues.join(tags.select("tag_id", "name", "desc", "field", "severity"), "tag_id")


def not_metadata(issues: DataFrame, tags: DataFrame) -> DataFrame:
    return with_tags(issues, tags).filter(F.col("severity") != "Metadata")


def issue_snippets(
    issues: DataFrame, tags: DataFrame, runs: DataFrame, artifacts: DataFrame
) -> DataFrame:
    """Cut every snippet out of its text again by byte span."""
    spans = issues.join(tags.select("tag_id", "field"), "tag_id").select(
        "issue_id", "run_id", "artifact_id", "field", "snippet_start", "snippet_end"
    )
    cut = byte_slice(F.col("text"), F.col("snippet_start"), F.col("snippet_end")).alias("snippet")
    in_runs = (
        spans.filter(F.col("field") != "Artifact")
        .join(runs.select("run_id", "log", "display_name"), "run_id")
        .withColumn("text", F.when(F.col("field") == "Console", F.col("log")).otherwise(F.col("display_name")))
        .select("issue_id", cut)
    )
    in_artifacts = (
        spans.filter(F.col("field") == "Artifact")
        .drop("run_id")
        .join(artifact_texts(artifacts).drop("run_id"), "artifact_id")
        .select("issue_id", cut)
    )
    return in_runs.unionByName(in_artifacts)
