"""SQL that DuckDB runs on the same tables to check the registered queries."""

from __future__ import annotations

import re

from buildlens import catalog
from buildlens.plans.queries import BLOCKED_CUSTOMERS, STOCK_SHOWN, UTC_OFFSET
from buildlens.sources import ci_tables as ci


def _quote(text: str) -> str:
    """A SQL literal; line breaks and tabs go through chr()."""
    out = "'" + text.replace("'", "''") + "'"
    return out.replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '")


def _tags_cte(tags: list[catalog.Tag]) -> str:
    rows = ", ".join(
        f"({i}, {t.tag_id}, {_quote(t.name)}, {_quote(t.pattern)}, '{t.field}', '{t.severity}')"
        for i, t in enumerate(tags, 1)
    )
    return f"""tags AS (SELECT ord, CAST(tag_id AS BIGINT) AS tag_id, name, pattern, field, severity
  FROM (VALUES {rows}) AS v(ord, tag_id, name, pattern, field, severity))"""


DOCS = """docs AS (SELECT doc_id AS run_id, source, job_id, number, job_id * 10000000000 + number AS build_id,
    CASE WHEN (number + job_id) % 3 = 0 THEN 'SUCCESS' ELSE
      CASE run_id % 6 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'FAILURE' WHEN 2 THEN 'UNSTABLE'
                      WHEN 3 THEN 'ABORTED' WHEN 4 THEN 'NOT_BUILT' END END AS status,
    concat(source, '/',
      CASE run_id % 4 WHEN 0 THEN 'gcc12' WHEN 1 THEN 'clang' WHEN 2 THEN 'intel-oneapi' ELSE 'nvidia' END, '-',
      CASE run_id % 3 WHEN 0 THEN 'ubuntu22.04' WHEN 1 THEN 'freebsd64' ELSE 'osx' END, '-', lang) AS display_name,
    text
  FROM (SELECT *, CAST(substr(source, 4) AS BIGINT) AS job_id, doc_id // 100 + 1 AS number FROM documents))"""

_WORST = """CASE min(CASE status WHEN 'FAILURE' THEN 0 WHEN 'UNSTABLE' THEN 1 WHEN 'ABORTED' THEN 2
                         WHEN 'SUCCESS' THEN 3 ELSE 4 END)
      WHEN 0 THEN 'FAILURE' WHEN 1 THEN 'UNSTABLE' WHEN 2 THEN 'ABORTED' WHEN 3 THEN 'SUCCESS'
      ELSE 'NOT_BUILT' END"""

SET_A = f"""{DOCS},
runs AS (SELECT run_id, 'run/' || run_id AS url, build_id, status, display_name,
    CASE WHEN status IN ('FAILURE', 'UNSTABLE', 'ABORTED') THEN text END AS log FROM docs),
builds AS (SELECT build_id, job_id, number, {_WORST} AS status FROM docs GROUP BY build_id, job_id, number),
jobs AS (SELECT DISTINCT job_id, source AS name FROM docs)"""

SET_B = """jobs AS (SELECT c_custkey AS job_id, c_name AS name, 'job/' || c_name AS url FROM customer),
builds AS (SELECT o_orderkey AS build_id, 'build/' || o_orderkey AS url,
    CASE o_orderstatus WHEN 'F' THEN 'FAILURE' WHEN 'O' THEN 'SUCCESS' ELSE 'UNSTABLE' END AS status,
    o_orderkey AS number, epoch_ms(o_orderdate) AS ts_ms, o_custkey AS job_id FROM orders),
runs AS (SELECT run_id, 'run/' || run_id AS url, display_name, build_id,
    CASE flags WHEN 'AF' THEN 'FAILURE' WHEN 'AO' THEN 'ABORTED' WHEN 'NF' THEN 'UNSTABLE'
               WHEN 'NO' THEN 'SUCCESS' WHEN 'RF' THEN 'NOT_BUILT' END AS status,
    CASE flags WHEN 'AF' THEN NULL WHEN 'NO' THEN 'old' ELSE 'current' END AS tag_schema
  FROM (SELECT l_orderkey * 8 + l_linenumber AS run_id, l_orderkey AS build_id,
      min(concat(l_returnflag, l_linestatus)) AS flags, concat(min(p_type), '/', min(p_brand)) AS display_name
    FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey, l_linenumber))"""

LATEST = """latest AS (SELECT b.* FROM builds b JOIN
    (SELECT job_id, max(number) AS top FROM builds GROUP BY job_id HAVING max(number) <> 0) t
    ON t.job_id = b.job_id AND t.top = b.number)"""

LATEST_RUNS = f"{LATEST}, latest_runs AS (SELECT r.* FROM runs r WHERE build_id IN (SELECT build_id FROM latest))"


def _floors(builds: str = "builds") -> str:
    return f"""SELECT job_id, min(number) AS retention_floor FROM
      (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY number DESC) AS rn FROM {builds})
      WHERE rn <= 5 GROUP BY job_id"""


def _issue_id(field: int) -> str:
    return f"""concat_ws('-', lpad(CAST(run_id AS VARCHAR), 19, '0'), '{field}',
      lpad(CAST(coalesce(artifact_id, 0) AS VARCHAR), 19, '0'), lpad(CAST(tag_id AS VARCHAR), 19, '0'),
      lpad(CAST(snippet_start AS VARCHAR), 10, '0'))"""


def _scan(source: str, text: str, field: int, tags: list[catalog.Tag], artifact: str) -> str:
    """Issues with spans: a match starts after all earlier pieces and matches."""
    parts = " UNION ALL ".join(
        f"""SELECT run_id, {artifact} AS artifact_id, CAST({t.tag_id} AS BIGINT) AS tag_id,
        regexp_extract_all({text}, {_quote(t.pattern)}, 0) AS m, string_split_regex({text}, {_quote(t.pattern)}) AS p
        FROM {source} WHERE {text} IS NOT NULL"""
        for t in tags
    )
    return f"""SELECT {_issue_id(field)} AS issue_id, * FROM (
    SELECT run_id, artifact_id, tag_id, snippet, min(start) AS snippet_start,
      min(start) + strlen(snippet) AS snippet_end, count(*) - 1 AS duplicates
    FROM (SELECT run_id, artifact_id, tag_id, snippet,
        CAST(sum(strlen(gap) + strlen(snippet)) OVER (PARTITION BY run_id, artifact_id, tag_id ORDER BY i) AS BIGINT)
          - strlen(snippet) AS start
      FROM (SELECT run_id, artifact_id, tag_id, unnest(m) AS snippet, unnest(p[1:len(m)]) AS gap,
          generate_subscripts(m, 1) AS i FROM ({parts}) WHERE len(m) > 0))
    GROUP BY run_id, artifact_id, tag_id, snippet)"""


def _of(tags: list[catalog.Tag], field: str) -> list[catalog.Tag]:
    return [t for t in tags if t.field == field]


_NULL = "CAST(NULL AS BIGINT)"
_COLUMNS = "issue_id, run_id, artifact_id, tag_id, snippet, snippet_start, snippet_end, duplicates"
CONSOLE = _scan("runs", "log", 0, _of(ci.TEXT_TAGS, "Console"), _NULL)
RUN_NAME = _scan("runs", "display_name", 1, _of(ci.TEXT_TAGS, "RunName"), _NULL)

JUNIT = """junit AS (SELECT (conv_id * 10000 + turn // 100) * 3 AS artifact_id, conv_id * 5 AS run_id,
    CAST(count_if(role = 'assistant' AND turn % 3 = 1) AS BIGINT) AS failures,
    CAST(count_if(turn % 4 = 3) AS BIGINT) AS skipped, count(*) AS tests,
    '<testsuites>' || string_agg(CASE WHEN role = 'assistant' AND turn % 3 = 1
      THEN '<failure>case ' || turn || '</failure>' ELSE '' END, '' ORDER BY turn) AS text
  FROM conversations GROUP BY conv_id, turn // 100)"""

# The real report repeats attributes and case names around the failures; the bytes before each
# failure are counted here from their parts.
JUNIT_TEXT = """junit_text AS (SELECT (conv_id * 10000 + turn // 100) * 3 AS artifact_id, conv_id * 5 AS run_id,
    '<testsuites><testsuite failures="' || count_if(role = 'assistant' AND turn % 3 = 1) || '" errors="0" skipped="'
      || count_if(turn % 4 = 3) || '" tests="' || count(*) || '">'
      || string_agg('<testcase name="t' || turn || '">' || CASE WHEN role = 'assistant' AND turn % 3 = 1
        THEN '<failure>case ' || turn || '</failure>' ELSE '' END || '</testcase>', '' ORDER BY turn)
      || '</testsuite></testsuites>' AS text
  FROM conversations GROUP BY conv_id, turn // 100)"""

ARTIFACT = _scan("junit_text", "text", 2, _of(ci.TEXT_TAGS, "Artifact"), "artifact_id")
# Only artifacts of known runs are tagged with the runs.
ARTIFACT_OF_RUNS = _scan(
    "(SELECT * FROM junit_text WHERE run_id IN (SELECT run_id FROM runs))",
    "text",
    2,
    _of(ci.TEXT_TAGS, "Artifact"),
    "artifact_id",
)
TAGS_A = _tags_cte(ci.TEXT_TAGS)
ISSUES_A = f"""{SET_A}, {TAGS_A}, {JUNIT_TEXT}, issues AS (SELECT {_COLUMNS} FROM ({CONSOLE})
  UNION ALL SELECT {_COLUMNS} FROM ({RUN_NAME}) UNION ALL SELECT {_COLUMNS} FROM ({ARTIFACT_OF_RUNS}))"""

TOP = """top_blocks AS (SELECT user_id AS run_id, (event_id // 1000 * 1000000000 + user_id) * 3 + 1 AS artifact_id,
    CAST(row_number() OVER (PARTITION BY user_id, event_id // 1000 ORDER BY ts, event_id) - 1 AS INTEGER) AS sample,
    strftime(ts, '%H:%M:%S') AS time, 100.0 - event_id % 101 AS cpu, 100.0 - (event_id % 1001) / 1000.0 * 100 AS mem
  FROM events WHERE user_id IN (SELECT run_id FROM runs WHERE NOT regexp_matches(display_name, 'bsd|aarch64|xpmem')))"""

ARTIFACTS = f"""artifacts AS (
  SELECT artifact_id, run_id, 'summary.junit.xml' AS path, 'Utf8' AS format FROM junit_text
  UNION ALL SELECT DISTINCT (event_id // 1000 * 1000000000 + user_id) * 3 + 1, user_id, 'top.txt', 'Utf8' FROM events
  UNION ALL SELECT page_id * 3 + 2, page_id,
    CASE page_id % 5 WHEN 1 THEN 'graph_' || page_id || '.svg' ELSE 'blob/' || page_id END,
    CASE page_id % 5 WHEN 0 THEN 'Png' WHEN 1 THEN 'Svg' WHEN 2 THEN 'Null'
      WHEN 3 THEN CASE WHEN html = '' THEN 'Null' WHEN contains(html, '<svg') THEN 'Svg' ELSE 'Utf8' END
      ELSE 'Unknown' END FROM pages)"""

ORACLE: dict[str, str] = {}

# ---- ingest -------------------------------------------------------------------------------------

PAYLOAD = f"""{DOCS},
listed AS (SELECT source || '/' || (run_id // 500) AS job_name, number, build_id, 'build/' || build_id AS url,
    {_WORST} AS status, 1704067200000 + number * 86400000 AS ts_ms
  FROM docs WHERE source <> 'src4' GROUP BY source, run_id // 500, number, build_id),
payload_jobs AS (SELECT DISTINCT source || '/' || (run_id // 500) AS name FROM docs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY job_name ORDER BY number DESC) AS rn FROM listed),
kept AS (SELECT * FROM ranked WHERE rn <= 3 AND job_name <> 'src3/0'),
own AS (SELECT k.url AS build_url, 'run/' || d.run_id AS url, d.run_id, d.status, d.number, d.display_name, d.text
  FROM kept k JOIN docs d ON d.build_id = k.build_id AND d.source || '/' || (d.run_id // 500) = k.job_name)"""

ORACLE["ingest_flatten"] = f"WITH {PAYLOAD} SELECT job_name, number, url, status, ts_ms FROM listed"
ORACLE["ingest_jobs"] = f"""WITH {PAYLOAD} SELECT job_name AS name, 'job/' || job_name AS url, count(*) AS n_builds
FROM listed WHERE job_name <> 'src3/0' GROUP BY job_name"""
ORACLE["ingest_last_n_builds"] = f"WITH {PAYLOAD} SELECT job_name, number, url, status, ts_ms FROM kept"
ORACLE["job_retention_floor"] = f"""WITH {PAYLOAD} SELECT p.name, 'job/' || p.name AS url, min(r.number) AS retention_floor
FROM payload_jobs p LEFT JOIN ranked r ON r.job_name = p.name AND r.rn <= 3 GROUP BY p.name"""
ORACLE["newest_builds"] = f"""WITH {SET_B} SELECT job_id, build_id, number FROM
(SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY number DESC) AS rn FROM builds) WHERE rn <= 5"""
ORACLE["retention_floors"] = f"WITH {SET_B} {_floors()}"
ORACLE["ingest_own_runs"] = f"WITH {PAYLOAD} SELECT build_url, url FROM own"
_INGESTED = """url, status, CASE WHEN run_id % 3 <> 0 THEN display_name ELSE '#' || number END AS display_name"""
ORACLE["ingest_runs"] = f"""WITH {PAYLOAD} SELECT {_INGESTED},
CASE WHEN status IN ('FAILURE', 'UNSTABLE', 'ABORTED') THEN text END AS log, CAST(NULL AS VARCHAR) AS tag_schema, build_url FROM own"""
ORACLE["new_runs"] = f"WITH {PAYLOAD} SELECT url, build_url FROM own WHERE status IS NULL OR status <> 'SUCCESS'"
ORACLE["cached_runs"] = f"WITH {PAYLOAD} SELECT url, run_id FROM own WHERE status = 'SUCCESS'"
ORACLE["artifact_rules"] = f"""WITH {JUNIT_TEXT}, {ARTIFACTS}
SELECT artifact_id, path, CASE WHEN path = 'top.txt' THEN 0 WHEN path LIKE 'graph%' THEN 1 ELSE 2 END AS rule
FROM artifacts WHERE path NOT LIKE 'blob%'"""

# ---- store --------------------------------------------------------------------------------------

_SPLIT = f"""{SET_B},
old_builds AS (SELECT * FROM builds WHERE ts_ms < epoch_ms(TIMESTAMP '1999-01-01')),
new_builds AS (SELECT * REPLACE (CASE WHEN status = 'SUCCESS' THEN 'FAILURE' END AS status) FROM builds
  WHERE ts_ms >= epoch_ms(TIMESTAMP '1998-01-01'))"""


def _new_id(key: str, top: str) -> str:
    return f"(SELECT coalesce({top}, 0) FROM old) + row_number() OVER (ORDER BY substr(md5({key}), 1, 3), {key})"


ORACLE["upsert_jobs"] = f"""WITH {_SPLIT},
old AS (SELECT j.job_id, name, url, retention_floor FROM jobs j JOIN ({_floors('old_builds')}) f ON f.job_id = j.job_id),
change AS (SELECT name, 'moved/' || url AS url, retention_floor FROM jobs j JOIN ({_floors('new_builds')}) f ON f.job_id = j.job_id)
SELECT old.job_id, old.name, old.url, CASE WHEN c.name IS NULL THEN old.retention_floor ELSE c.retention_floor END AS retention_floor
FROM old LEFT JOIN change c ON c.name = old.name
UNION ALL SELECT {_new_id('name', 'max(job_id)')}, name, url, retention_floor FROM change WHERE name NOT IN (SELECT name FROM old)"""
ORACLE["upsert_builds"] = f"""WITH {_SPLIT}, old AS (SELECT * FROM old_builds), change AS (SELECT * FROM new_builds)
SELECT old.build_id, old.url, CASE WHEN c.url IS NULL THEN old.status ELSE c.status END AS status,
  old.number, old.ts_ms, old.job_id
FROM old LEFT JOIN change c ON c.url = old.url
UNION ALL SELECT {_new_id('url', 'max(build_id)')}, url, status, number, ts_ms, job_id FROM change WHERE url NOT IN (SELECT url FROM old)"""
ORACLE["upsert_runs"] = f"""WITH {SET_B}, old AS (SELECT * FROM runs WHERE status IS DISTINCT FROM 'SUCCESS'),
change AS (SELECT * REPLACE (lower(display_name) AS display_name, NULL AS tag_schema) FROM runs WHERE status IN ('SUCCESS', 'FAILURE'))
SELECT old.run_id, old.url, old.status, CASE WHEN c.url IS NULL THEN old.display_name ELSE c.display_name END AS display_name,
  CASE WHEN c.url IS NULL THEN old.tag_schema END AS tag_schema, old.build_id
FROM old LEFT JOIN change c ON c.url = old.url
UNION ALL SELECT {_new_id('url', 'max(run_id)')}, url, status, display_name, CAST(NULL AS VARCHAR), build_id
FROM change WHERE url NOT IN (SELECT url FROM old)"""
ORACLE["upsert_tags"] = f"""WITH
old AS (SELECT row_number() OVER (ORDER BY substr(md5(name), 1, 3), name) AS tag_id, * FROM
  (SELECT DISTINCT p_brand || '-' || p_type AS name, p_type FROM part WHERE p_size <= 10)),
change AS (SELECT DISTINCT p_brand || '-' || p_type AS name, p_type FROM part WHERE p_size >= 5)
SELECT 0 AS ord, name, CASE WHEN name IN (SELECT name FROM change) THEN 'new' ELSE 'old' END AS "desc",
  p_type AS pattern, 'RunName' AS field, 'Info' AS severity, tag_id FROM old
UNION ALL SELECT 0, name, 'new', p_type, 'RunName', 'Info', {_new_id('name', 'max(tag_id)')} FROM change
WHERE name NOT IN (SELECT name FROM old)"""

STORE_B = f"""{SET_B}, floors AS ({_floors()}),
issues AS (SELECT {_COLUMNS} FROM ({_scan('runs', 'display_name', 1, ci.NAME_TAGS, _NULL)})),
similarities AS (SELECT md5(snippet || '/' || (run_id // 64)) AS group_id, issue_id FROM issues)"""
_LOST = """doomed_runs AS (SELECT run_id FROM runs WHERE build_id IN (SELECT build_id FROM doomed)),
broken AS (SELECT DISTINCT group_id FROM similarities s JOIN issues i ON i.issue_id = s.issue_id
  WHERE i.run_id IN (SELECT run_id FROM doomed_runs))"""
_BLOCKED = f"""doomed AS (SELECT build_id FROM builds WHERE job_id IN
  (SELECT job_id FROM jobs WHERE name IN ({', '.join(_quote(n) for n in BLOCKED_CUSTOMERS)})))"""
_BELOW = """doomed AS (SELECT build_id FROM builds b JOIN floors f ON f.job_id = b.job_id WHERE number < retention_floor)"""
for _prefix, _doomed in (("purge_blocklist", _BLOCKED), ("purge_retention", _BELOW)):
    _with = f"WITH {STORE_B}, {_doomed}, {_LOST}"
    ORACLE[f"{_prefix}_builds"] = f"{_with} SELECT build_id FROM builds WHERE build_id NOT IN (SELECT build_id FROM doomed)"
    ORACLE[f"{_prefix}_runs"] = f"{_with} SELECT run_id FROM runs WHERE build_id NOT IN (SELECT build_id FROM doomed)"
    ORACLE[f"{_prefix}_issues"] = f"{_with} SELECT issue_id FROM issues WHERE run_id NOT IN (SELECT run_id FROM doomed_runs)"
    ORACLE[f"{_prefix}_artifacts"] = f"{_with} SELECT run_id AS artifact_id FROM runs WHERE run_id NOT IN (SELECT run_id FROM doomed_runs)"
    ORACLE[f"{_prefix}_groups"] = f"{_with} SELECT group_id, issue_id FROM similarities WHERE group_id NOT IN (SELECT group_id FROM broken)"
ORACLE["purge_blocklist_jobs"] = f"""WITH {SET_B} SELECT job_id FROM jobs
WHERE name NOT IN ({', '.join(_quote(n) for n in BLOCKED_CUSTOMERS)})"""

_STALE = f"""WITH {STORE_B}, doomed_runs AS (SELECT run_id FROM runs WHERE tag_schema <> 'current'),
broken AS (SELECT DISTINCT group_id FROM similarities s JOIN issues i ON i.issue_id = s.issue_id
  WHERE i.run_id IN (SELECT run_id FROM doomed_runs))"""
ORACLE["invalidate_issues"] = f"{_STALE} SELECT issue_id FROM issues WHERE run_id NOT IN (SELECT run_id FROM doomed_runs)"
ORACLE["invalidate_groups"] = f"{_STALE} SELECT group_id, issue_id FROM similarities WHERE group_id NOT IN (SELECT group_id FROM broken)"
ORACLE["invalidate_runs"] = f"WITH {SET_B} SELECT run_id, CASE WHEN tag_schema = 'current' THEN 'current' END AS tag_schema FROM runs"
ORACLE["purge_orphan_tags"] = f"""WITH {STORE_B}, {_tags_cte(ci.NAME_TAGS)}
SELECT tag_id, name FROM tags t WHERE EXISTS (SELECT 1 FROM issues i WHERE i.tag_id = t.tag_id)"""
ORACLE["stamp_schema"] = f"WITH {SET_B} SELECT run_id, coalesce(tag_schema, 'current') AS tag_schema FROM runs"
ORACLE["untagged_runs"] = f"WITH {SET_B} SELECT run_id FROM runs WHERE tag_schema IS NULL"

# ---- tagging ------------------------------------------------------------------------------------


def _hits(tags: list[catalog.Tag]) -> str:
    return " UNION ALL ".join(
        f"""SELECT run_id, CAST({t.tag_id} AS BIGINT) AS tag_id FROM runs
        WHERE regexp_matches({'log' if t.field == 'Console' else 'display_name'}, {_quote(t.pattern)})"""
        for t in tags
        if t.field != "Artifact"
    ) + "".join(
        f""" UNION ALL SELECT DISTINCT run_id, CAST({t.tag_id} AS BIGINT) FROM junit_text
        WHERE run_id IN (SELECT run_id FROM runs) AND regexp_matches(text, {_quote(t.pattern)})"""
        for t in _of(tags, "Artifact")
    )


HITS_A = f"{SET_A}, {TAGS_A}, {JUNIT_TEXT}, hits AS ({_hits(ci.TEXT_TAGS)})"
ORACLE["tag_hits"] = f"WITH {HITS_A} SELECT run_id, tag_id FROM hits"
ORACLE["sketched_hits"] = f"WITH {SET_A}, hits AS ({_hits(_of(ci.TEXT_TAGS, 'Console'))}) SELECT run_id, tag_id FROM hits"
ORACLE["tag_catalog"] = f"""WITH {HITS_A} SELECT t.tag_id, name, pattern, field, severity, count(run_id) AS n_runs
FROM tags t LEFT JOIN hits h ON h.tag_id = t.tag_id GROUP BY ALL"""
ORACLE["tag_schema"] = f"""WITH {TAGS_A} SELECT (SELECT md5(string_agg(concat(name, chr(1), pattern, chr(1), field),
chr(10) ORDER BY ord)) FROM tags) AS tag_schema, count(*) AS n_runs FROM documents"""
ORACLE["issues_console"] = f"WITH {SET_A} SELECT run_id, tag_id, snippet, duplicates FROM ({CONSOLE})"
ORACLE["issue_spans"] = f"WITH {SET_A} SELECT run_id, tag_id, snippet, snippet_start, snippet_end FROM ({CONSOLE})"
ORACLE["issues_runname"] = f"""WITH {SET_A} SELECT issue_id, run_id, tag_id, snippet, snippet_start, snippet_end, duplicates
FROM ({RUN_NAME})"""
ORACLE["issues_artifact"] = f"WITH {JUNIT_TEXT} SELECT {_COLUMNS} FROM ({ARTIFACT})"
ORACLE["issues_all"] = f"WITH {ISSUES_A} SELECT {_COLUMNS} FROM issues"
ORACLE["issue_snippets"] = f"WITH {ISSUES_A} SELECT issue_id, snippet FROM issues"
ORACLE["issues_not_metadata"] = f"""WITH {ISSUES_A} SELECT issue_id, name, severity, snippet, duplicates
FROM issues JOIN tags USING (tag_id) WHERE severity <> 'Metadata'"""
ORACLE["run_issues"] = f"""WITH {ISSUES_A} SELECT run_id, name, field, severity, snippet, duplicates
FROM issues JOIN tags USING (tag_id)"""
ORACLE["artifact_formats"] = f"""WITH {JUNIT_TEXT}, {ARTIFACTS}
SELECT format, count(*) AS n_artifacts FROM artifacts GROUP BY format"""

_NODE = " ".join(f"WHEN {i} THEN {_quote(n)}" for i, n in enumerate(ci.STOCK_NODES))
_MESSAGE = " ".join(
    f"WHEN {i} THEN replace({_quote(m)}, '{{n}}', CAST(run_id AS VARCHAR))" for i, m in ci.STOCK_MESSAGES.items()
)
SET_STOCK = SET_A.replace(
    "THEN text END AS log",
    f"""THEN 'Building remotely on ' || CASE run_id % 17 {_NODE} END || ' in workspace' || chr(10) || text || chr(10)
      || CASE (run_id // 6) % 12 {_MESSAGE} END END AS log""",
)
_SUFFIX = " ".join(f"WHEN {i} THEN '{x}'" for i, x in ci.STOCK_SUFFIXES.items())
SET_STOCK = SET_STOCK.replace(
    "build_id, status, display_name,", f"build_id, status, display_name || CASE (run_id // 12) % 6 {_SUFFIX} END AS display_name,", 1
)
_LOGS = " ".join(f"WHEN {i} THEN replace({_quote(m)}, '{{n}}', CAST(run_id AS VARCHAR))" for i, m in ci.STOCK_LOGS.items())
# All artifacts that are text: reports, usage logs, pages, build logs.
STOCK_TEXTS = f"""{JUNIT_TEXT},
texts AS MATERIALIZED (SELECT artifact_id, run_id, text FROM junit_text
  UNION ALL SELECT (part * 1000000000 + user_id) * 3 + 1, user_id, string_agg(block, chr(10) ORDER BY ts, event_id) FROM (
    SELECT user_id, event_id // 1000 AS part, ts, event_id, 'top - ' || strftime(ts, '%H:%M:%S') || ' up 1 day' || chr(10)
      || 'Tasks: 1 total' || chr(10) || '%Cpu(s): 1.0 us, 1.0 sy, 0.0 ni, ' || event_id % 101 || ' id,' || chr(10)
      || 'MiB Mem : 1000.0 total, ' || event_id % 1001 || ' free,' || chr(10) || repeat('-' || chr(10), 16) AS block FROM events)
    GROUP BY user_id, part
  UNION ALL SELECT page_id * 3 + 2, page_id, CASE page_id % 5 WHEN 1 THEN '<svg/>' WHEN 2 THEN '' ELSE html END FROM pages
    WHERE page_id % 5 IN (1, 2, 3)
  UNION ALL SELECT run_id + {ci.STOCK_ARTIFACTS}, run_id, text || chr(10) || CASE run_id % 3 {_LOGS} END FROM docs
    WHERE (run_id // 100) % 3 = 0),
run_texts AS MATERIALIZED (SELECT * FROM texts WHERE run_id IN (SELECT run_id FROM runs))"""
_STOCK = catalog.STOCK_TAGS


def _stock_issues(tags: list[catalog.Tag]) -> str:
    sources = (("runs", "log", "Console", _NULL), ("runs", "display_name", "RunName", _NULL), ("run_texts", "text", "Artifact", "artifact_id"))
    return " UNION ALL ".join(
        f"SELECT {_COLUMNS} FROM ({_scan(source, text, i, _of(tags, field), artifact)})"
        for i, (source, text, field, artifact) in enumerate(sources)
        if _of(tags, field)
    )


ORACLE["stock_issues"] = f"""WITH {SET_STOCK}, {STOCK_TEXTS}
SELECT run_id, artifact_id, tag_id, snippet, snippet_start, snippet_end, duplicates FROM ({_stock_issues(_STOCK)})"""


def _stock_hits(tags: list[catalog.Tag]) -> str:
    hits = _hits(tags).replace("FROM junit_text", "FROM run_texts")
    return f"{SET_STOCK}, {_tags_cte(_STOCK)}, {STOCK_TEXTS}, hits AS MATERIALIZED ({hits})"


ORACLE["stock_catalog"] = f"""WITH {_stock_hits(_STOCK)} SELECT t.tag_id, name, field, severity, count(run_id) AS n_runs
FROM tags t LEFT JOIN hits h ON h.tag_id = t.tag_id GROUP BY ALL"""

# ---- similarity ---------------------------------------------------------------------------------

# DuckDB's levenshtein counts bytes: the letters beyond ASCII in the test texts become single bytes.
_LETTERS = "ÍéèÑÈóÓöüÖäÜêÉßíçÇñÊÄ"
_SINGLE = " || ".join(f"chr({i})" for i in [1, 2, 3, 4, 5, 6, 7, 8, 11, 12, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24])
_NAMED = f"""{SET_A}, named AS (SELECT run_id, display_name, min(display_name) OVER (PARTITION BY build_id) AS first_name FROM runs)"""
ORACLE["snippet_distance"] = f"WITH {_NAMED} SELECT run_id, levenshtein(display_name, first_name) AS distance FROM named"
ORACLE["snippet_similarity"] = f"""WITH {_NAMED} SELECT run_id, round(CASE WHEN d = m THEN 0 ELSE exp(-d / (m - d)) END, 9) AS similarity
FROM (SELECT run_id, CAST(levenshtein(display_name, first_name) AS DOUBLE) AS d,
  CAST(greatest(length(display_name), length(first_name)) AS DOUBLE) AS m FROM named)"""

_PAIRS = f"""fuzzy AS MATERIALIZED (SELECT issue_id, run_id, tag_id, snippet FROM issues JOIN tags USING (tag_id) WHERE severity <> 'Metadata'),
nodes AS MATERIALIZED (SELECT min(issue_id) AS issue_id, snippet, translate(snippet, '{_LETTERS}', {_SINGLE}) AS flat,
    length(snippet) AS n FROM fuzzy GROUP BY snippet),
pairs AS MATERIALIZED (SELECT a_issue, b_issue, d AS distance, exp(-d / (m - d)) AS similarity FROM (
    SELECT a.issue_id AS a_issue, b.issue_id AS b_issue, CAST(levenshtein(a.flat, b.flat) AS DOUBLE) AS d,
      CAST(greatest(a.n, b.n) AS DOUBLE) AS m
    FROM nodes a JOIN nodes b ON a.issue_id < b.issue_id AND abs(a.n - b.n) < 0.0954 * greatest(a.n, b.n))
  WHERE d < m AND exp(-d / (m - d)) > 0.9)"""
PAIRS = f"{ISSUES_A}, {_PAIRS}"
STOCK_PAIRS = f"{SET_STOCK}, {_tags_cte(_STOCK)}, {STOCK_TEXTS}, issues AS (SELECT * FROM ({_stock_issues(STOCK_SHOWN)})), {_PAIRS}"
_LINKS = """ SELECT n.issue_id, count(near) AS n_similar, min(near) FILTER (near < n.issue_id) AS first_similar_issue
FROM nodes n LEFT JOIN (SELECT a_issue AS issue_id, b_issue AS near FROM pairs UNION ALL SELECT b_issue, a_issue FROM pairs) p
  USING (issue_id) GROUP BY n.issue_id"""
ORACLE["similar_links"] = f"WITH {PAIRS}{_LINKS}"
ORACLE["stock_similar_links"] = f"WITH {STOCK_PAIRS}{_LINKS}"
ORACLE["similar_pairs_by_night"] = f"""WITH {STOCK_PAIRS} SELECT least(x, y) AS a, greatest(x, y) AS b, CAST(distance AS BIGINT) AS distance,
round(similarity, 9) AS similarity FROM (SELECT md5(l.snippet) AS x, md5(r.snippet) AS y, distance, similarity
  FROM pairs JOIN nodes l ON l.issue_id = a_issue JOIN nodes r ON r.issue_id = b_issue)"""
ORACLE["similar_pairs"] = f"""WITH {PAIRS} SELECT a_issue, b_issue, CAST(distance AS BIGINT) AS distance,
round(similarity, 9) AS similarity FROM pairs"""

# One step per linked snippet, in order: the first group all of whose members are near takes it.
_GROUPS = """near AS (SELECT b_issue AS issue_id, list(a_issue) AS near FROM pairs GROUP BY b_issue),
linked AS (SELECT issue_id, coalesce(near, []) AS near, row_number() OVER (ORDER BY issue_id) AS i FROM
  (SELECT DISTINCT unnest([a_issue, b_issue]) AS issue_id FROM pairs) LEFT JOIN near USING (issue_id)),
step(i, groups) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[][]) UNION ALL
  SELECT l.i, CASE WHEN spot IS NULL THEN list_append(groups, [l.issue_id])
    ELSE list_transform(groups, lambda g, j: CASE WHEN j = spot THEN list_append(g, l.issue_id) ELSE g END) END
  FROM (SELECT s.groups, l.*, list_position(list_transform(s.groups, lambda g: list_has_all(l.near, g)), true) AS spot
    FROM step s JOIN linked l ON l.i = s.i + 1) l),
final AS (SELECT unnest(groups) AS g FROM (SELECT groups FROM step ORDER BY i DESC LIMIT 1)),
seeds AS (SELECT unnest(g) AS issue_id, g[1] AS seed_issue FROM final),
placed AS (SELECT n.issue_id, n.snippet, coalesce(s.seed_issue, n.issue_id) AS seed_issue
  FROM nodes n LEFT JOIN seeds s USING (issue_id))"""
GROUPS = f"WITH RECURSIVE {PAIRS}, {_GROUPS}"
ORACLE["similarity_groups"] = f"{GROUPS} SELECT issue_id, seed_issue FROM placed"

_MEMBERS = """in_group AS (SELECT p.seed_issue, f.* FROM fuzzy f JOIN placed p USING (snippet)),
named AS (SELECT seed_issue, md5(concat_ws('-', count(*),
    bit_xor(CAST('0x' || substr(md5(issue_id), 1, 15) AS BIGINT)), bit_xor(CAST('0x' || substr(md5(issue_id), 17, 15) AS BIGINT)))) AS group_id
  FROM in_group GROUP BY seed_issue HAVING count(*) > 1),
members AS (SELECT group_id, issue_id, run_id, tag_id, snippet FROM in_group JOIN named USING (seed_issue))"""
MEMBERS = f"{GROUPS}, {_MEMBERS}"
ORACLE["stock_similarity_members"] = f"WITH RECURSIVE {STOCK_PAIRS}, {_GROUPS}, {_MEMBERS} SELECT group_id, issue_id FROM members"
ORACLE["similarity_members"] = f"{MEMBERS} SELECT group_id, issue_id FROM members"
LIVE = f"""{MEMBERS}, {LATEST_RUNS}, live AS (SELECT * FROM members WHERE group_id IN
  (SELECT group_id FROM members WHERE run_id IN (SELECT run_id FROM latest_runs)))"""
ORACLE["similarity_runs"] = f"{LIVE} SELECT DISTINCT group_id, run_id FROM live"
SUMMARY = f"""{LIVE}, summary AS (SELECT group_id, name, severity, example, n_runs FROM
  (SELECT group_id, arg_min(tag_id, issue_id) AS tag_id, arg_min(snippet, issue_id) AS example,
    count(DISTINCT run_id) AS n_runs FROM live GROUP BY group_id) JOIN tags USING (tag_id) WHERE n_runs > 1)"""
ORACLE["similarity_summary"] = f"{SUMMARY} SELECT * FROM summary"
ORACLE["similarity_by_severity"] = f"{SUMMARY} SELECT severity, count(*) AS n_groups FROM summary GROUP BY severity"

# ---- statistics ---------------------------------------------------------------------------------

ORACLE["latest_builds"] = f"WITH {SET_B}, {LATEST} SELECT job_id, build_id, number, status FROM latest"
ORACLE["run_status_counts"] = f"""WITH {SET_A}, {LATEST_RUNS} SELECT status, count(*) AS n_runs FROM latest_runs
WHERE status IS NOT NULL GROUP BY status"""
ORACLE["latest_runs_by_status"] = f"""WITH {SET_B}, {LATEST_RUNS} SELECT status, run_id FROM latest_runs WHERE status IS NOT NULL"""
ORACLE["job_health"] = f"""WITH {SET_B}, {LATEST} SELECT count_if(l.status = 'SUCCESS')::BIGINT AS successful_jobs,
count(*) AS total_jobs, count_if(l.status = 'SUCCESS') / count(*)::DOUBLE AS health FROM jobs j LEFT JOIN latest l ON l.job_id = j.job_id"""
ORACLE["run_totals"] = f"""WITH {SET_B}, {LATEST_RUNS} SELECT count_if(status = 'FAILURE')::BIGINT AS failures,
count_if(status = 'UNSTABLE')::BIGINT AS unstable, count_if(status = 'SUCCESS')::BIGINT AS successful,
count_if(status = 'ABORTED')::BIGINT AS aborted, count_if(status = 'NOT_BUILT')::BIGINT AS not_built,
count(status) AS total_runs FROM latest_runs"""
ORACLE["issues_found"] = f"""WITH {ISSUES_A}, {LATEST_RUNS} SELECT count(*) AS issues_found FROM issues JOIN tags USING (tag_id)
WHERE severity <> 'Metadata' AND run_id IN (SELECT run_id FROM latest_runs)"""
ORACLE["unknown_runs"] = f"""WITH {ISSUES_A}, {LATEST_RUNS} SELECT run_id, status FROM latest_runs
WHERE status IN ('FAILURE', 'UNSTABLE', 'ABORTED')
  AND run_id NOT IN (SELECT run_id FROM issues JOIN tags USING (tag_id) WHERE severity <> 'Metadata')"""
ORACLE["deployment_totals"] = f"""{MEMBERS}
SELECT 'builds_analyzed' AS metric, count(*) AS value FROM builds
UNION ALL SELECT 'identified_issues', count(*) FROM fuzzy
UNION ALL SELECT 'unique_issues', count(DISTINCT snippet) FROM fuzzy
UNION ALL SELECT 'similarity_groupings', count(DISTINCT group_id) FROM members"""

# ---- views --------------------------------------------------------------------------------------


def _views(prefix: str) -> str:
    return f"""WITH {prefix}, {LATEST_RUNS}, held AS (SELECT h.run_id, t.name, t.severity FROM hits h JOIN tags t USING (tag_id)),
pairs AS (SELECT r.run_id, t.name AS label, EXISTS (SELECT 1 FROM held h WHERE h.run_id = r.run_id
    AND regexp_matches(h.name, t.name)) AS hit, t.severity FROM latest_runs r, tags t)"""


def _has(pattern: str) -> str:
    return f"run_id IN (SELECT run_id FROM held WHERE regexp_matches(name, {_quote(pattern)}))"


_A = _views(HITS_A)
ORACLE["view_tag"] = f"{_A} SELECT 'clang|gnu' AS label, run_id FROM latest_runs WHERE {_has('clang|gnu')}"
ORACLE["view_severity"] = f"""{_A} SELECT 'Warning' AS label, run_id FROM latest_runs
WHERE run_id IN (SELECT run_id FROM held WHERE severity = 'Warning')"""
ORACLE["view_tag_set"] = f"{_A} SELECT label, run_id FROM pairs WHERE hit AND regexp_matches(label, 'n')"
ORACLE["view_severity_set"] = f"{_A} SELECT label, run_id FROM pairs WHERE hit AND severity = 'Metadata'"
ORACLE["view_not_tag"] = f"{_A} SELECT '!headline' AS label, run_id FROM latest_runs WHERE NOT {_has('headline')}"
ORACLE["view_not_set"] = f"{_A} SELECT label, run_id FROM pairs WHERE hit AND NOT regexp_matches(label, 'l|u')"
ORACLE["view_and"] = f"""{_A} SELECT l.label || ' && ' || r.label AS label, l.run_id FROM pairs l JOIN pairs r ON r.run_id = l.run_id
WHERE l.hit AND r.hit AND l.label IN ('clang', 'gnu', 'intel', 'nvidia') AND r.label IN ('linux', 'bsd', 'osx')"""
ORACLE["view_or"] = f"""{_A} SELECT 'Error || ' || label AS label, run_id FROM pairs WHERE label IN ('junk', 'shout')
AND (hit OR run_id IN (SELECT run_id FROM held WHERE severity = 'Error'))"""
ORACLE["view_matches"] = f"""{_A} SELECT '!clang || ' || label || ' || junk' AS label, run_id FROM pairs
WHERE regexp_matches(label, 'x') AND (NOT {_has('clang')} OR hit OR {_has('junk')})"""

_AGENTS = _quote(catalog.AGENT_NAMES)
_SHOWN = [t for t in _STOCK if t.severity != "Metadata"]
_NODE_NAMES = [t for t in _STOCK if re.search(catalog.AGENT_NAMES, t.name)]
_OFFLINE = [t for t in _STOCK if "jenkins_agent_offline" in t.name]


def _stock_views(tags: list[catalog.Tag]) -> str:
    """Runs beside the rows they belong to; only the tags that the view asks about are searched for."""
    return f"""WITH {_stock_hits(tags)}, {LATEST_RUNS},
held AS (SELECT h.run_id, t.name FROM hits h JOIN tags t USING (tag_id) WHERE run_id IN (SELECT run_id FROM latest_runs)),
pairs AS (SELECT DISTINCT run_id, l.name AS label, l.severity FROM held h JOIN tags l ON regexp_matches(h.name, l.name))"""


ORACLE["view_by_tag"] = f"{_stock_views(_SHOWN)} SELECT label, run_id FROM pairs WHERE severity <> 'Metadata'"
ORACLE["view_by_metadata"] = f"""{_stock_views([t for t in _STOCK if t.severity == 'Metadata'])}
SELECT '!' || {_AGENTS} || ' && ' || label AS label, run_id FROM pairs
WHERE severity = 'Metadata' AND NOT {_has(catalog.AGENT_NAMES)}"""
ORACLE["view_by_agent"] = f"{_stock_views(_NODE_NAMES)} SELECT label, run_id FROM pairs WHERE regexp_matches(label, {_AGENTS})"
ORACLE["view_failures_by_platform"] = f"""{_stock_views(_NODE_NAMES + _OFFLINE)}
SELECT 'jenkins_agent_offline && ' || label AS label, run_id FROM pairs
WHERE regexp_matches(label, {_AGENTS}) AND {_has('jenkins_agent_offline')}"""

# ---- report tables ------------------------------------------------------------------------------

_STATUS_LABEL = """CASE status WHEN 'SUCCESS' THEN 'good' WHEN 'FAILURE' THEN 'bad' WHEN 'UNSTABLE' THEN 'unstable'
WHEN 'NOT_BUILT' THEN 'not built' WHEN 'ABORTED' THEN 'aborted' ELSE 'no build' END"""
_STATUS_CLASS = "CASE status WHEN 'FAILURE' THEN 'error' WHEN 'UNSTABLE' THEN 'warning' WHEN 'ABORTED' THEN 'info' END"
_BAD = "status IN ('FAILURE', 'UNSTABLE', 'ABORTED')"
ORACLE["job_builds"] = f"""WITH {SET_B} SELECT j.job_id, name, build_id, number, coalesce(number = newest, false) AS is_latest,
  coalesce(number = newest AND {_BAD}, false) AS is_open, CASE WHEN build_id IS NOT NULL THEN {_STATUS_LABEL} END AS status_label
FROM jobs j LEFT JOIN (SELECT *, max(number) OVER (PARTITION BY job_id) AS newest FROM builds) b ON b.job_id = j.job_id"""
ORACLE["build_runs"] = f"""WITH {SET_B} SELECT build_id, run_id, display_name,
CAST(CASE status WHEN 'FAILURE' THEN 0 WHEN 'UNSTABLE' THEN 1 WHEN 'ABORTED' THEN 2 WHEN 'SUCCESS' THEN 3 ELSE 4 END AS INTEGER) AS place,
{_STATUS_LABEL} AS status_label, {_STATUS_CLASS} AS status_class FROM runs"""
ORACLE["run_tags"] = f"""WITH {HITS_A} SELECT r.run_id, coalesce(name, 'untagged!') AS tag
FROM runs r LEFT JOIN (SELECT run_id, name FROM hits JOIN tags USING (tag_id)) t ON t.run_id = r.run_id"""
ORACLE["run_issue_panel"] = f"""WITH {ISSUES_A}, shown AS (SELECT * FROM issues JOIN tags USING (tag_id) WHERE severity <> 'Metadata')
SELECT r.run_id, {_STATUS_CLASS} AS status_class, name AS tag, CASE WHEN severity IS NOT NULL THEN lower(severity) END AS severity_class,
  snippet, duplicates, snippet IS NULL AS unknown
FROM runs r LEFT JOIN shown s ON s.run_id = r.run_id WHERE snippet IS NOT NULL OR {_BAD}"""
ORACLE["run_artifacts"] = f"""WITH {SET_A}, {JUNIT_TEXT}, {ARTIFACTS}
SELECT run_id, artifact_id, path, format, CASE format WHEN 'Utf8' THEN 'text' WHEN 'Unknown' THEN 'can''t display'
  WHEN 'Null' THEN 'no data' ELSE 'image' END AS shown_as
FROM artifacts WHERE run_id IN (SELECT run_id FROM runs)"""
ORACLE["run_links"] = f"""WITH {SET_B}, {LATEST_RUNS} SELECT run_id, status, display_name, url FROM latest_runs
WHERE status IS NOT NULL"""
ORACLE["build_time_labels"] = f"""WITH {SET_B} SELECT build_id, ts_ms,
strftime(make_timestamp(CAST(ts_ms // 1000 AS BIGINT) * 1000000) - INTERVAL {-UTC_OFFSET} HOUR, '%b %d, %Y %I:%M:%S %p')
  || ' UTC{UTC_OFFSET:+d}' AS label FROM builds"""

# ---- artifact analytics -------------------------------------------------------------------------

ORACLE["top_usage"] = f"""WITH {SET_A}, {TOP} SELECT run_id, artifact_id, sample, time,
round(CAST(cpu AS DOUBLE), 6) AS cpu, round(CAST(mem AS DOUBLE), 6) AS mem FROM top_blocks"""
ORACLE["top_usage_summary"] = f"""WITH {SET_A}, {TOP} SELECT run_id, count(*) AS samples, CAST(max(cpu) AS DOUBLE) AS cpu_peak,
round(avg(CAST(cpu AS DOUBLE)), 6) AS cpu_mean, round(CAST(max(mem) AS DOUBLE), 6) AS mem_peak,
round(avg(CAST(mem AS DOUBLE)), 6) AS mem_mean FROM top_blocks GROUP BY run_id"""
ORACLE["junit_suites"] = f"""WITH {JUNIT} SELECT run_id, artifact_id, 0 AS suite, failures, CAST(0 AS BIGINT) AS errors, skipped, tests
FROM junit"""
ORACLE["junit_failures"] = """SELECT conv_id * 5 AS run_id, artifact_id, 0 AS suite, "case", 'case ' || turn AS failure FROM
(SELECT *, (conv_id * 10000 + turn // 100) * 3 AS artifact_id,
  CAST(row_number() OVER (PARTITION BY conv_id, turn // 100 ORDER BY turn) - 1 AS INTEGER) AS "case" FROM conversations)
WHERE role = 'assistant' AND turn % 3 = 1"""

# ---- streams ------------------------------------------------------------------------------------

ORACLE["stream_ingest"] = f"WITH {PAYLOAD} SELECT {_INGESTED} FROM own"
ORACLE["stream_tagging"] = f"WITH {ISSUES_A} SELECT {_COLUMNS} FROM issues"
