"""Display labels for statuses, severities, formats and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from buildlens.schemas import BAD_STATUSES, SEVERITIES, STATUS_ORDER, STATUS_ORDER_LAST

# Report wording and the style class of each status, severity and blob format.
STATUS_LABELS = {
    "SUCCESS": "good",
    "FAILURE": "bad",
    "UNSTABLE": "unstable",
    "NOT_BUILT": "not built",
    "ABORTED": "aborted",
}
NO_STATUS_LABEL = "no build"
STATUS_CLASSES = {"FAILURE": "error", "UNSTABLE": "warning", "ABORTED": "info"}
SEVERITY_CLASSES = {"Error": "error", "Warning": "warning", "Info": "info"}
FORMAT_LABELS = {"Png": "image", "Svg": "image", "Utf8": "text", "Unknown": "can't display", "Null": "no data"}


def _lookup(col: Column, table: dict, default=None) -> Column:
    out = None
    for key, value in table.items():
        out = F.when(col == key, value) if out is None else out.when(col == key, value)
    return out.otherwise(F.lit(default))


def status_label(status: Column) -> Column:
    return _lookup(status, STATUS_LABELS, NO_STATUS_LABEL)


def status_class(status: Column) -> Column:
    return _lookup(status, STATUS_CLASSES)


def status_order(status: Column) -> Column:
    return _lookup(status, STATUS_ORDER, STATUS_ORDER_LAST)


def severity_class(severity: Column) -> Column:
    return _lookup(severity, SEVERITY_CLASSES)


def severity_rank(severity: Column) -> Column:
    return _lookup(severity, {s: i for i, s in enumerate(SEVERITIES)})


def format_label(blob: Column) -> Column:
    return _lookup(blob, FORMAT_LABELS)


def is_bad(status: Column) -> Column:
    """True for the statuses that carry a log; false when the status is missing."""
    return F.coalesce(status.isin(*BAD_STATUSES), F.lit(False))


def time_label(ts_ms: Column, utc_offset_hours: int) -> Column:
    """``Jan 02, 2024 03:04:05 PM UTC-5``, whatever the session time zone."""
    seconds = (ts_ms - F.pmod(ts_ms, F.lit(1000))) / 1000 + F.lit(utc_offset_hours * 3600)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    local = epoch + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    text = F.date_format(local, "MMM dd, yyyy hh:mm:ss a")
    return F.concat(text, F.lit(f" UTC{utc_offset_hours:+d}"))
