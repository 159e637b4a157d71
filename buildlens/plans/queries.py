"""The registered queries: every operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens import catalog
from buildlens.functions.labels import is_bad
from buildlens.functions.text import similarity
from buildlens.operators import (
    artifacts as art,
    ingest,
    marts,
    similarity as sim,
    sketch,
    snippet_index,
    stats,
    store as st,
    tagging,
    views,
)
from buildlens.schemas import PAYLOAD
from buildlens.session import cut_lineage, merged, scratch_path
from buildlens.sources import ci_tables as ci
from buildlens.sources.tables import read_table
from buildlens.streaming import incremental

THRESHOLD = 0.9
LAST_N = 3
BLOCKLIST = [ci.BLOCKED_JOB]
UTC_OFFSET = -5

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _refs(tags: list[catalog.Tag]) -> list[views.TagRef]:
    return [views.TagRef(t.tag_id, t.name, t.severity) for t in tags]


# ---- ingest -------------------------------------------------------------------------------------


def _payload(spark, sf):
    """The snapshots as the JSON reader gives them."""
    text = ci.payload_a(spark, sf).select(F.to_json(F.struct("jobs")).alias("line"))
    return text.select(F.from_json("line", PAYLOAD).alias("p")).select("p.jobs")


def _kept(spark, sf):
    return ingest.kept_jobs(ingest.payload_jobs(_payload(spark, sf)), BLOCKLIST)


def _listed(spark, sf):
    return ingest.own_runs(ingest.build_rows(_kept(spark, sf), LAST_N))


def _stored(spark, sf):
    """Runs known from an earlier night: those that ended well."""
    return ci.runs_a(spark, sf).filter(F.col("status") == "SUCCESS")


@query
def ingest_flatten(spark, sf):
    return ingest.build_rows(ingest.payload_jobs(_payload(spark, sf))).drop("runs")


@query
def ingest_jobs(spark, sf):
    return _kept(spark, sf).select("name", "url", F.size("builds").cast("long").alias("n_builds"))


@query
def ingest_last_n_builds(spark, sf):
    return ingest.build_rows(_kept(spark, sf), LAST_N).drop("runs")


@query
def job_retention_floor(spark, sf):
    return ingest.job_rows(ingest.payload_jobs(_payload(spark, sf)), LAST_N)


@query
def newest_builds(spark, sf):
    return ingest.newest_builds(ci.builds_b(spark, sf), 5).select("job_id", "build_id", "number")


@query
def retention_floors(spark, sf):
    return ingest.retention_floors(ci.builds_b(spark, sf), 5)


@query
def ingest_own_runs(spark, sf):
    return _listed(spark, sf)


@query
def ingest_runs(spark, sf):
    return ingest.run_rows(_listed(spark, sf), ci.details_a(spark, sf))


@query
def new_runs(spark, sf):
    return ingest.new_runs(_listed(spark, sf), _stored(spark, sf)).select("url", "build_url")


@query
def cached_runs(spark, sf):
    return ingest.cached_runs(_listed(spark, sf), _stored(spark, sf)).select("url", "run_id")


@query
def artifact_rules(spark, sf):
    found = art.matching_artifacts(ci.artifacts_a(spark, sf), catalog.ARTIFACT_RULES)
    return found.select("artifact_id", "path", "rule")


# ---- store --------------------------------------------------------------------------------------


def _split_builds(spark, sf):
    """Builds before 1999 as stored, builds from 1998 on as reported again with a new status."""
    start = lambda year: int(datetime(year, 1, 1, tzinfo=timezone.utc).timestamp()) * 1000
    builds = ci.builds_b(spark, sf)
    fresh = builds.withColumn("status", F.when(F.col("status") == "SUCCESS", "FAILURE"))
    return builds.filter(F.col("ts_ms") < start(1999)), fresh.filter(F.col("ts_ms") >= start(1998))


@query
def upsert_jobs(spark, sf):
    old_builds, new_builds = _split_builds(spark, sf)
    jobs = ci.jobs_b(spark, sf)
    old = jobs.join(ingest.retention_floors(old_builds, 5), "job_id")
    change = (
        jobs.join(ingest.retention_floors(new_builds, 5), "job_id")
        .withColumn("url", F.concat(F.lit("moved/"), "url"))
        .drop("job_id")
    )
    return st.upsert_jobs(old, change)


@query
def upsert_builds(spark, sf):
    old, change = _split_builds(spark, sf)
    return st.upsert_builds(old, change.drop("build_id"))


@query
def upsert_runs(spark, sf):
    runs = cut_lineage(ci.runs_b(spark, sf))
    old = runs.filter(F.coalesce(F.col("status") != "SUCCESS", F.lit(True)))
    change = (
        runs.filter(F.col("status").isin("SUCCESS", "FAILURE"))
        .withColumn("display_name", F.lower("display_name"))
        .withColumn("tag_schema", F.lit(None).cast("string"))
        .drop("run_id")
    )
    return st.upsert_runs(old, change).drop("log")


def _part_tags(parts: DataFrame, desc: str) -> DataFrame:
    """A tag per brand and type."""
    name = F.concat_ws("-", "p_brand", "p_type")
    return parts.select(name.alias("name"), "p_type").distinct().select(
        F.lit(0).alias("ord"),
        "name",
        F.lit(desc).alias("desc"),
        F.col("p_type").alias("pattern"),
        F.lit("RunName").alias("field"),
        F.lit("Info").alias("severity"),
    )


@query
def upsert_tags(spark, sf):
    parts = read_table(spark, sf, "part")
    old = _part_tags(parts.filter(F.col("p_size") <= 10), "old")
    old = st.assign_ids(old, "name", "tag_id")
    return st.upsert_tags(old, _part_tags(parts.filter(F.col("p_size") >= 5), "new"))


def _store_b(spark, sf):
    """A store as the maintenance jobs find it: runs and issues are written tables."""
    builds = ci.builds_b(spark, sf)
    runs = cut_lineage(ci.runs_b(spark, sf))
    issues = cut_lineage(tagging.run_name_issues(runs, ci.NAME_TAGS))
    floors = ingest.retention_floors(builds, 5)
    return {
        "jobs": ci.jobs_b(spark, sf).join(floors, "job_id", "left"),
        "builds": builds,
        "runs": runs,
        "artifacts": ci.artifacts_b(runs),
        "issues": issues,
        "similarities": ci.groups_b(issues),
    }


_KEYS = {
    "jobs": ["job_id"],
    "builds": ["build_id"],
    "runs": ["run_id"],
    "issues": ["issue_id"],
    "artifacts": ["artifact_id"],
    "similarities": ["group_id", "issue_id"],
}

BLOCKED_CUSTOMERS = ["Customer#000000003", "Customer#000000007", "Customer#000000011"]


def _purges(prefix: str, purge: Callable, tables: list[str]) -> None:
    for table in tables:
        name = f"{prefix}_{'groups' if table == 'similarities' else table}"
        QUERIES[name] = lambda spark, sf, t=table: purge(_store_b(spark, sf))[t].select(*_KEYS[t])


_purges("purge_blocklist", lambda s: st.purge_blocklist(s, BLOCKED_CUSTOMERS), list(_KEYS))
_purges("purge_retention", st.purge_retention, [t for t in _KEYS if t != "jobs"])
_purges("invalidate", lambda s: st.invalidate(s, "current"), ["issues", "similarities"])


@query
def invalidate_runs(spark, sf):
    return st.invalidate(_store_b(spark, sf), "current")["runs"].select("run_id", "tag_schema")


@query
def purge_orphan_tags(spark, sf):
    tags = catalog.tags_df(spark, ci.NAME_TAGS)
    return st.purge_orphan_tags(tags, _store_b(spark, sf)["issues"]).select("tag_id", "name")


@query
def stamp_schema(spark, sf):
    return tagging.stamp(ci.runs_b(spark, sf), "current").select("run_id", "tag_schema")


@query
def untagged_runs(spark, sf):
    return tagging.untagged_runs(ci.runs_b(spark, sf)).select("run_id")


# ---- tagging ------------------------------------------------------------------------------------


def _tags_a(spark):
    return catalog.tags_df(spark, ci.TEXT_TAGS)


def _issues_a(spark, sf):
    return tagging.all_issues(ci.runs_a(spark, sf), ci.artifacts_a(spark, sf), ci.TEXT_TAGS)


def _hits_a(spark, sf):
    return tagging.run_hits(ci.runs_a(spark, sf), ci.artifacts_a(spark, sf), ci.TEXT_TAGS)


SHOWN_TAGS = [t for t in ci.TEXT_TAGS if t.severity != "Metadata"]


def _snippets_a(spark, sf):
    """Snippets of the tags other than Metadata; the others are not searched for."""
    return tagging.run_snippets(ci.runs_a(spark, sf), ci.artifacts_a(spark, sf), SHOWN_TAGS)


@query
def tag_catalog(spark, sf):
    used = _hits_a(spark, sf).groupBy("tag_id").agg(F.count(F.lit(1)).alias("n_runs"))
    return _tags_a(spark).join(used, "tag_id", "left").select(
        "tag_id", "name", "pattern", "field", "severity", F.coalesce("n_runs", F.lit(0)).alias("n_runs")
    )


@query
def tag_schema(spark, sf):
    stamped = tagging.stamp(ci.runs_a(spark, sf), catalog.fingerprint(ci.TEXT_TAGS))
    return stamped.groupBy("tag_schema").agg(F.count(F.lit(1)).alias("n_runs"))


@query
def tag_hits(spark, sf):
    return _hits_a(spark, sf)


@query
def sketched_hits(spark, sf):
    """Console tags of set A's logs by way of their stored sketches."""
    logs = ci.runs_a(spark, sf).filter("log is not null").select("run_id", "log")
    sketches = cut_lineage(sketch.add_sketches(logs, "log"))
    console = [t for t in ci.TEXT_TAGS if t.field == "Console"]
    return sketch.sketched_hits(logs, sketches, ["run_id"], "log", console)


@query
def issues_console(spark, sf):
    runs = ci.runs_a(spark, sf).filter(F.col("log").isNotNull())
    console = [t for t in ci.TEXT_TAGS if t.field == "Console"]
    return tagging.scan_text(runs, ["run_id"], "log", console, spans=False)


@query
def issue_spans(spark, sf):
    issues = tagging.console_issues(ci.runs_a(spark, sf), ci.TEXT_TAGS)
    return issues.select("run_id", "tag_id", "snippet", "snippet_start", "snippet_end")


@query
def issues_runname(spark, sf):
    return tagging.run_name_issues(ci.runs_a(spark, sf), ci.TEXT_TAGS).drop("artifact_id")


@query
def issues_artifact(spark, sf):
    return tagging.artifact_issues(ci.artifacts_a(spark, sf), ci.TEXT_TAGS)


@query
def issues_all(spark, sf):
    return _issues_a(spark, sf)


@query
def issue_snippets(spark, sf):
    runs, artifacts = ci.runs_a(spark, sf), ci.artifacts_a(spark, sf)
    return tagging.issue_snippets(_issues_a(spark, sf), _tags_a(spark), runs, artifacts)


@query
def issues_not_metadata(spark, sf):
    found = tagging.not_metadata(_issues_a(spark, sf), _tags_a(spark))
    return found.select("issue_id", "name", "severity", "snippet", "duplicates")


@query
def run_issues(spark, sf):
    found = tagging.with_tags(_issues_a(spark, sf), _tags_a(spark))
    return found.select("run_id", "name", "field", "severity", "snippet", "duplicates")


@query
def artifact_formats(spark, sf):
    return art.format_census(ci.artifacts_a(spark, sf))


def _stock_issues(spark, sf):
    return tagging.all_issues(ci.runs_stock(spark, sf), ci.artifacts_stock(spark, sf), catalog.STOCK_TAGS)


@query
def stock_issues(spark, sf):
    return _stock_issues(spark, sf).select(
        "run_id", "artifact_id", "tag_id", "snippet", "snippet_start", "snippet_end", "duplicates"
    )


@query
def stock_catalog(spark, sf):
    """The 43 stock tags and the number of runs that have each."""
    hits = tagging.run_hits(ci.runs_stock(spark, sf), ci.artifacts_stock(spark, sf), catalog.STOCK_TAGS)
    used = hits.groupBy("tag_id").agg(F.count(F.lit(1)).alias("n_runs"))
    return catalog.tags_df(spark, catalog.STOCK_TAGS).join(used, "tag_id", "left").select(
        "tag_id", "name", "field", "severity", F.coalesce("n_runs", F.lit(0)).alias("n_runs")
    )


# ---- similarity ---------------------------------------------------------------------------------


def _fuzzy_issues(spark, sf):
    """Stored issues other than Metadata."""
    found = tagging.all_issues(ci.runs_a(spark, sf), ci.artifacts_a(spark, sf), SHOWN_TAGS)
    return cut_lineage(found.select("issue_id", "run_id", "tag_id", "snippet"))


def _named_runs(spark, sf):
    """Run names beside the first run name of their build."""
    runs = ci.runs_a(spark, sf).select("run_id", "build_id", "display_name")
    first = runs.groupBy("build_id").agg(F.min("display_name").alias("first_name"))
    return runs.join(first, "build_id")


@query
def snippet_distance(spark, sf):
    return _named_runs(spark, sf).select(
        "run_id", F.levenshtein("display_name", "first_name").cast("long").alias("distance")
    )


@query
def snippet_similarity(spark, sf):
    value = similarity(F.col("display_name"), F.col("first_name"))
    return _named_runs(spark, sf).select("run_id", F.round(value, 9).alias("similarity"))


@query
def similar_pairs(spark, sf):
    nodes = sim.distinct_snippets(_fuzzy_issues(spark, sf))
    first = lambda node, name: nodes.select(F.col("node").alias(node), F.col("first_issue").alias(name))
    return (
        sim.similar_pairs(nodes, THRESHOLD)
        .join(merged(first("a", "a_issue")), "a")
        .join(merged(first("b", "b_issue")), "b")
        .select(
            "a_issue",
            "b_issue",
            F.col("distance").cast("long").alias("distance"),
            F.round("similarity", 9).alias("similarity"),
        )
    )


@query
def similar_pairs_by_night(spark, sf):
    """The pairs of three nights, each of which looks its new snippets up in the index of those before."""
    issues = _fuzzy_stock(spark, sf)
    root = scratch_path(spark, "snippets")
    for night in range(3):
        tonight = issues.filter(F.col("run_id") % 3 == night).select("snippet")
        snippet_index.add_snippets(spark, tonight, root, night, THRESHOLD)
    return snippet_index.all_pairs(spark, root).select(
        "a", "b", F.col("distance").cast("long").alias("distance"), F.round("similarity", 9).alias("similarity")
    )


def _links(issues: DataFrame) -> DataFrame:
    nodes = sim.distinct_snippets(issues)
    first = lambda node, name: nodes.select(F.col("node").alias(node), F.col("first_issue").alias(name))
    return (
        sim.similar_links(nodes, THRESHOLD)
        .join(merged(first("node", "issue_id")), "node")
        .join(merged(first("first_similar", "first_similar_issue")), "first_similar", "left")
        .select("issue_id", "n_similar", "first_similar_issue")
    )


@query
def similar_links(spark, sf):
    return _links(_fuzzy_issues(spark, sf))


STOCK_SHOWN = [t for t in catalog.STOCK_TAGS if t.severity != "Metadata"]


def _fuzzy_stock(spark, sf):
    """Tool messages of the stock catalog: many differ in numbers only."""
    found = tagging.all_issues(ci.runs_stock(spark, sf), ci.artifacts_stock(spark, sf), STOCK_SHOWN)
    return cut_lineage(found.select("issue_id", "run_id", "tag_id", "snippet"))


@query
def stock_similar_links(spark, sf):
    return _links(_fuzzy_stock(spark, sf))


@query
def stock_similarity_members(spark, sf):
    return sim.group_members(_fuzzy_stock(spark, sf), THRESHOLD)


@query
def similarity_groups(spark, sf):
    nodes = sim.distinct_snippets(_fuzzy_issues(spark, sf))
    groups = sim.snippet_groups(nodes, THRESHOLD).select("node", "seed")
    first = nodes.select("node", F.col("first_issue").alias("issue_id"))
    seed = nodes.select(F.col("node").alias("seed"), F.col("first_issue").alias("seed_issue"))
    return groups.join(merged(first), "node").join(merged(seed), "seed").select("issue_id", "seed_issue")


def _members(spark, sf):
    return sim.group_members(_fuzzy_issues(spark, sf), THRESHOLD)


def _grouped(spark, sf):
    """Members, issues and latest runs."""
    issues = _fuzzy_issues(spark, sf)
    latest = stats.latest_runs(ci.runs_a(spark, sf), ci.builds_a(spark, sf))
    return sim.group_members(issues, THRESHOLD), issues, latest


@query
def similarity_members(spark, sf):
    return _members(spark, sf)


@query
def similarity_runs(spark, sf):
    return sim.group_runs(*_grouped(spark, sf))


@query
def similarity_summary(spark, sf):
    return sim.group_summary(*_grouped(spark, sf), _tags_a(spark))


@query
def similarity_by_severity(spark, sf):
    return sim.groups_by_severity(sim.group_summary(*_grouped(spark, sf), _tags_a(spark)))


# ---- statistics ---------------------------------------------------------------------------------


@query
def latest_builds(spark, sf):
    return stats.latest_builds(ci.builds_b(spark, sf))


@query
def run_status_counts(spark, sf):
    return stats.status_counts(ci.runs_a(spark, sf), ci.builds_a(spark, sf))


@query
def latest_runs_by_status(spark, sf):
    return stats.runs_by_status(ci.runs_b(spark, sf), ci.builds_b(spark, sf))


@query
def job_health(spark, sf):
    return stats.job_health(ci.jobs_b(spark, sf), ci.builds_b(spark, sf))


@query
def run_totals(spark, sf):
    return stats.run_totals(ci.runs_b(spark, sf), ci.builds_b(spark, sf))


@query
def issues_found(spark, sf):
    return stats.issues_found(
        _snippets_a(spark, sf), _tags_a(spark), ci.runs_a(spark, sf), ci.builds_a(spark, sf)
    )


@query
def unknown_runs(spark, sf):
    runs, builds = ci.runs_a(spark, sf), ci.builds_a(spark, sf)
    hits = tagging.run_hits(runs.filter(is_bad(F.col("status"))), ci.artifacts_a(spark, sf), SHOWN_TAGS)
    return stats.unknown_runs(hits, _tags_a(spark), runs, builds)


@query
def deployment_totals(spark, sf):
    issues = _fuzzy_issues(spark, sf)
    members = sim.group_members(issues, THRESHOLD)
    return stats.deployment_totals(ci.builds_a(spark, sf), issues, _tags_a(spark), members)


# ---- views --------------------------------------------------------------------------------------


def _tagged_a(spark, sf):
    latest = stats.latest_runs(ci.runs_a(spark, sf), ci.builds_a(spark, sf))
    return views.run_tag_ids(_hits_a(spark, sf), latest)


VIEWS = {
    "view_tag": views.Tag("clang|gnu"),
    "view_severity": views.Severity("Warning"),
    "view_tag_set": views.TagSet("n"),
    "view_severity_set": views.SeveritySet("Metadata"),
    "view_not_tag": ~views.Tag("headline"),
    "view_not_set": ~views.TagSet("l|u"),
    "view_and": views.TagSet("^(clang|gnu|intel|nvidia)$") & views.TagSet("^(linux|bsd|osx)$"),
    "view_or": views.Severity("Error") | views.TagSet("^(junk|shout)$"),
    "view_matches": ~(views.Tag("clang") & ~views.TagSet("x")) | views.Tag("junk"),
}


def _register_view(name: str, view: views.View) -> None:
    QUERIES[name] = lambda spark, sf: views.show(view, _refs(ci.TEXT_TAGS), _tagged_a(spark, sf))


for _name, _view in VIEWS.items():
    _register_view(_name, _view)


def _tagged_stock(spark, sf, tags):
    """Latest runs with those of their tags that a view asks for."""
    runs = ci.runs_stock(spark, sf)
    hits = tagging.run_hits(runs, ci.artifacts_stock(spark, sf), tags)
    return views.run_tag_ids(hits, stats.latest_runs(runs, ci.builds_a(spark, sf)))


def _register_stock_view(name: str, view: views.View) -> None:
    refs = _refs(catalog.STOCK_TAGS)
    asked = [t for t in catalog.STOCK_TAGS if t.tag_id in view.reads(refs)]
    QUERIES[name] = lambda spark, sf: views.show(view, refs, _tagged_stock(spark, sf, asked))


for _title, _view in views.stock_views(catalog.AGENT_NAMES).items():
    _register_stock_view(
        "view_" + _title.lower().replace("jenkins ", "").replace(" ", "_"), _view
    )


# ---- report tables ------------------------------------------------------------------------------


@query
def job_builds(spark, sf):
    return marts.job_builds_sorted(marts.job_builds(ci.jobs_b(spark, sf), ci.builds_b(spark, sf)))


@query
def build_runs(spark, sf):
    return marts.build_runs_sorted(marts.build_runs(ci.runs_b(spark, sf)))


@query
def run_tags(spark, sf):
    return marts.run_tags(ci.runs_a(spark, sf), _hits_a(spark, sf), _tags_a(spark))


@query
def run_issue_panel(spark, sf):
    return marts.run_issue_panel(ci.runs_a(spark, sf), _snippets_a(spark, sf), _tags_a(spark))


@query
def run_artifacts(spark, sf):
    return marts.run_artifacts(ci.runs_a(spark, sf), ci.artifacts_a(spark, sf))


@query
def run_links(spark, sf):
    runs, builds = ci.runs_b(spark, sf), ci.builds_b(spark, sf)
    return marts.run_links(stats.runs_by_status(runs, builds), runs)


@query
def build_time_labels(spark, sf):
    return marts.build_time_labels(ci.builds_b(spark, sf), UTC_OFFSET)


# ---- artifact analytics -------------------------------------------------------------------------


@query
def top_usage(spark, sf):
    rounded = lambda c: F.round(c, 6).alias(c)
    logs = art.of_readable_runs(ci.top_artifacts(spark, sf), ci.runs_a(spark, sf))
    return art.usage_samples(logs).select(
        "run_id", "artifact_id", "sample", "time", rounded("cpu"), rounded("mem")
    )


@query
def top_usage_summary(spark, sf):
    logs = art.of_readable_runs(ci.top_artifacts(spark, sf), ci.runs_a(spark, sf))
    summary = art.usage_summary(art.usage_samples(logs))
    return summary.withColumn("mem_peak", F.round("mem_peak", 6))


@query
def junit_suites(spark, sf):
    return art.junit_suites(ci.junit_artifacts(spark, sf))


@query
def junit_failures(spark, sf):
    return art.junit_failures(ci.junit_artifacts(spark, sf))


# ---- streams ------------------------------------------------------------------------------------


@query
def stream_ingest(spark, sf):
    """Snapshots arrive in several files; the stored runs after the stream has drained."""
    return incremental.replay_ingest(
        ci.payload_a(spark, sf), ci.details_a(spark, sf), BLOCKLIST, LAST_N
    ).select("url", "status", "display_name")


@query
def stream_tagging(spark, sf):
    """Runs and artifacts arrive in several files; the stored issues after the streams have drained."""
    return incremental.replay_tagging(ci.runs_a(spark, sf), ci.artifacts_a(spark, sf), ci.TEXT_TAGS)
