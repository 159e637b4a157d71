"""Table schemas, enumerations and their ranks."""

from __future__ import annotations

from pyspark.sql import types as T

# Build results, log-carrying results, text fields, severities (lowest first).
STATUSES = ("SUCCESS", "FAILURE", "UNSTABLE", "NOT_BUILT", "ABORTED")
BAD_STATUSES = ("FAILURE", "UNSTABLE", "ABORTED")
FIELDS = ("Console", "RunName", "Artifact")
SEVERITIES = ("Metadata", "Info", "Warning", "Error")

# Display order of runs inside a build; NOT_BUILT and a missing status share the last place.
STATUS_ORDER = {"FAILURE": 0, "UNSTABLE": 1, "ABORTED": 2, "SUCCESS": 3}
STATUS_ORDER_LAST = 4


_TYPES = {
    "int": T.IntegerType(),
    "long": T.LongType(),
    "string": T.StringType(),
    "binary": T.BinaryType(),
}


def _struct(columns: str, **nested: T.DataType) -> T.StructType:
    """Struct of ``name type`` pairs, then the nested fields."""
    out = T.StructType()
    for column in columns.split(", "):
        name, kind = column.split(" ")
        out = out.add(name, _TYPES[kind])
    for name, kind in nested.items():
        out = out.add(name, kind)
    return out


JOBS = _struct("job_id long, name string, url string, retention_floor long")
BUILDS = _struct("build_id long, url string, status string, number long, ts_ms long, job_id long")
RUNS = _struct(
    "run_id long, url string, status string, display_name string, log string, "
    "tag_schema string, build_id long"
)
ARTIFACTS = _struct("artifact_id long, path string, contents binary, run_id long")
TAGS = _struct(
    "ord int, tag_id long, name string, desc string, pattern string, field string, severity string"
)
ISSUES = _struct(
    "issue_id string, run_id long, artifact_id long, tag_id long, snippet string, "
    "snippet_start long, snippet_end long, duplicates long"
)
SIMILARITIES = _struct("group_id string, issue_id string")

TABLES = {
    "jobs": JOBS,
    "builds": BUILDS,
    "runs": RUNS,
    "artifacts": ARTIFACTS,
    "tags": TAGS,
    "issues": ISSUES,
    "similarities": SIMILARITIES,
}

# One project snapshot: every job with its builds, newest first, and the runs of each build.
_RUN_REF = _struct("url string, number long")
_BUILD_REF = _struct(
    "number long, url string, timestamp long, result string", runs=T.ArrayType(_RUN_REF)
)
_JOB_REF = _struct("name string, url string", builds=T.ArrayType(_BUILD_REF))
PAYLOAD = T.StructType().add("jobs", T.ArrayType(_JOB_REF))

# What the server returns for one run: joined to the snapshot by url.
RUN_DETAILS = _struct(
    "url string, full_display_name string, display_name string, status string, log string"
)
