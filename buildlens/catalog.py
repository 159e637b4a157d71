"""Tags, the stock catalog, artifact rules and run configuration."""

from __future__ import annotations

import hashlib
import tomllib
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from buildlens.schemas import FIELDS, SEVERITIES, TAGS


@dataclass(frozen=True)
class Tag:
    """One rule: the parts of ``field`` matching ``pattern`` become issues of ``severity``.

    ``scan`` is an equal pattern that the JVM matches without recursion, needed for patterns that
    repeat a group over many lines. ``needle`` is a text every match contains; texts without it are
    not scanned.
    """

    name: str
    pattern: str
    field: str
    severity: str
    desc: str = ""
    scan: str | None = None
    needle: str | None = None
    tag_id: int = 0

    @property
    def regex(self) -> str:
        """Pattern as passed to Spark: only a line feed ends a line."""
        return "(?d)" + (self.scan or self.pattern)


def number_tags(tags: list[Tag]) -> list[Tag]:
    """Give tags without an id the ids 1, 2, ... in order."""
    return [t if t.tag_id else replace(t, tag_id=i) for i, t in enumerate(tags, 1)]


def check_tags(spark: SparkSession, tags: list[Tag]) -> list[Tag]:
    """Reject unknown fields and severities, repeated names, patterns that do not compile or match ''."""
    for t in tags:
        if t.field not in FIELDS or t.severity not in SEVERITIES:
            raise ValueError(f"tag {t.name}: unknown field {t.field} or severity {t.severity}")
    names = [t.name for t in tags]
    if len(set(names)) != len(names):
        raise ValueError("tag names must be unique")

    def match_empty(some: list[Tag]):
        return spark.range(1).select(*[F.rlike(F.lit(""), F.lit(t.regex)) for t in some]).first()

    try:
        empty = match_empty(tags)
    except Exception:
        for t in tags:
            try:
                match_empty([t])
            except Exception as err:
                raise ValueError(f"tag {t.name}: bad pattern {t.pattern!r}") from err
        raise
    for t, matched in zip(tags, empty):
        if matched:
            raise ValueError(f"tag {t.name}: the pattern matches the empty text")
    return tags


def tags_df(spark: SparkSession, tags: list[Tag]) -> DataFrame:
    """The tags as a table. From Arrow it is a local relation whose size the optimizer knows."""
    rows = [
        (i, t.tag_id, t.name, t.desc, t.pattern, t.field, t.severity) for i, t in enumerate(tags, 1)
    ]
    columns = [
        pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(TAGS.fields)
    ]
    return spark.createDataFrame(pa.table(columns, names=TAGS.names))


def fingerprint(tags: list[Tag]) -> str:
    """Hash of (name, pattern, field) in order; description and severity do not count."""
    lines = "\n".join(f"{t.name}\x01{t.pattern}\x01{t.field}" for t in tags)
    return hashlib.md5(lines.encode()).hexdigest()


def fingerprint_df(tags: DataFrame) -> DataFrame:
    """The same hash from a tags table, whose size the configuration bounds."""
    line = F.concat_ws("\x01", "name", "pattern", "field")
    ordered = F.array_sort(F.collect_list(F.struct("ord", line.alias("line"))))
    return tags.agg(F.md5(F.array_join(ordered["line"], "\n")).alias("tag_schema"))


# The stock patterns. The rewritten ``scan`` forms are ours.
_PATH = r"[a-zA-Z0-9_\-\./ ]+"
_POS = r"([\.\-:][0-9]+){0,4}"
_INDENTED = r"(?:\n\s++.*+)*+"

ERROR_TAGS = [
    Tag(
        "cc_emit",
        r"(?m)^[a-zA-Z0-9_\-\./ ]+([\.\-:][0-9]+){0,4}: (fatal )?error: .*(\n\s+.*)*(\n[a-zA-Z0-9_\-\./ ]+([\.\-:][0-9]+){0,4}: [a-z]+: .*(\n\s+.*)*)*$",
        "Console",
        "Error",
        "CC Compiler Error",
        scan=rf"(?m)^{_PATH}{_POS}: (?:fatal )?error: .*+{_INDENTED}(?:\n{_PATH}{_POS}: [a-z]+: .*+{_INDENTED})*+$",
        needle="error: ",
    ),
    Tag(
        "cc_warn",
        r"(?m)^[a-zA-Z0-9_\-\./ ]+([\.\-:][0-9]+){0,4}: warning: .*(\n\s+.*)*(\n[a-zA-Z0-9_\-\./ ]+([\.\-:][0-9]+){0,4}: [a-z]+: .*(\n\s+.*)*)*$",
        "Artifact",
        "Warning",
        "CC Compiler Warning",
        scan=rf"(?m)^{_PATH}{_POS}: warning: .*+{_INDENTED}(?:\n{_PATH}{_POS}: [a-z]+: .*+{_INDENTED})*+$",
        needle=": warning: ",
    ),
    Tag(
        "nvcxx_emit",
        r'(?m)^"[a-zA-Z0-9_\-\./ ]+", line [0-9]+: (fatal )?error: .*(\n\s+.*)*(\n"[a-zA-Z0-9_\-\./ ]+", line [0-9]+: [a-z]+: .*(\n\s+.*)*)*$',
        "Console",
        "Error",
        "NVC++ Compiler Error",
        scan=rf'(?m)^"{_PATH}", line [0-9]+: (?:fatal )?error: .*+{_INDENTED}(?:\n"{_PATH}", line [0-9]+: [a-z]+: .*+{_INDENTED})*+$',
        needle='", line ',
    ),
    Tag(
        "nvcxx_bail",
        r"(?m)^NV.*Internal compiler error. .*$",
        "Console",
        "Error",
        "NVC++ Internal Compiler Error",
        needle="Internal compiler error",
    ),
    Tag(
        "out_of_space",
        r"(?m)^[a-zA-Z0-9_\-\./ ]+(: .*)?: No space left on device$",
        "Console",
        "Info",
        "No space left on device",
        needle=": No space left on device",
    ),
    Tag(
        "jenkins_agent_offline",
        r"(?m)^Agent went offline during the build$",
        "Console",
        "Info",
        "Jenkins Build Agent went offline during the build",
        needle="Agent went offline during the build",
    ),
    Tag(
        "java_stack_trace",
        r"(?m)^([a-zA-Z]+: .*\n([a-z]+\.)+[a-zA-Z]+(: .*)?(\n\s+at .*)+)+$",
        "Console",
        "Info",
        "Java Exception Stack Trace",
        scan=r"(?m)^[a-zA-Z]+: .*+\n(?:[a-z]++\.)++[a-zA-Z]++(?:: .*+)?+(?:\n\s++at .*+)++$",
        needle="at ",
    ),
    Tag(
        "mpi_abort",
        r"(?m)^Abort\([0-9]+\) on node [0-9]+: .*(\n[a-zA-Z_][a-zA-Z0-9_]+\([0-9]+\)\.*: .*)*$",
        "Console",
        "Error",
        "Generic MPI failure conditions",
        scan=r"(?m)^Abort\([0-9]+\) on node [0-9]+: .*+(?:\n[a-zA-Z_][a-zA-Z0-9_]++\([0-9]++\)\.*+: .*+)*+$",
        needle=" on node ",
    ),
    Tag(
        "python_traceback",
        r"(?m)^Traceback \(most recent call last\):(?:\n.*)+?\n(.*?(?:Exception|Error):)\s*(.+)$",
        "Console",
        "Warning",
        "Python Exception Traceback",
        scan=r"(?m)^Traceback \(most recent call last\):\n.*+(?:\n(?!.*?(?:Exception|Error):\s*.).*+)*+\n.*?(?:Exception|Error):\s*.+$",
        needle="Traceback (most recent call last):",
    ),
    Tag(
        "ld_error",
        r"(?m)^.+: error while loading shared libraries: .*$",
        "Console",
        "Error",
        "Program can't find shared library",
        needle=": error while loading shared libraries: ",
    ),
    Tag(
        "cpi_failed_assert",
        r"(?m)^cpi: [a-zA-Z0-9_\-\./ ]+([\.\-:][0-9]+){0,4}: .*: Assertion `.*' failed.$",
        "Console",
        "Error",
        "Failed assertion from cpi",
        needle="cpi: ",
    ),
    Tag(
        "mpir_assert_failed",
        r"(?m)^Assertion failed in file [a-zA-Z0-9_\-\./ ]+ at line [0-9]+: .*$",
        "Console",
        "Error",
        "Failure from MPIR_Assert",
        needle="Assertion failed in file ",
    ),
    Tag(
        "tap_failure",
        r"(?m)^not ok [0-9]+ - .*\n([\s#]{2}.*)*$",
        "Artifact",
        "Warning",
        "TAP failure from Testsuite",
        scan=r"(?m)^not ok [0-9]+ - .*+\n(?:[\s#]{2}.*+)*+$",
        needle="not ok ",
    ),
    Tag(
        "perl_syntax_error",
        r'(?m)^syntax error at [a-zA-Z0-9_\-\./ ]+ line [0-9]+, near ".*"$',
        "Console",
        "Error",
        "Perl syntax error message",
        needle="syntax error at ",
    ),
]

# Fixed values: (name, description, pattern) of the run-name tags.
_RUN_NAME = [
    ("bsd", "FreeBSD Build", r"freebsd64"),
    ("linux", "Linux Build", r"(ubuntu([0-9]{1,2}.[0-9]{1,2})?)|(debian([0-9]+)?)|(centos([0-9]+)?)|(opensuse(-(leap)|(tumbleweed))?)"),
    ("osx", "macOS Build", r"osx"),
    ("aarch64", "aarch64 Build", r"aarch64"),
    ("gnu", "gcc Build", r"(gnu)|(gcc[0-9]*)"),
    ("clang", "clang Build", r"clang"),
    ("intel", "Intel OneAPI Build", r"intel(-oneapi)?"),
    ("nvidia", "NVC++ Build", r"nvidia"),
    ("ch3-tcp", "netmod=ch3-tcp", r"ch3(-nemesis)?-tcp"),
    ("ch3-sock", "netmod=ch3-sock", r"ch3-sock"),
    ("ch4-ofi", "netmod=ch4-ofi", r"(ch4-)?ofi(-(global)|(vci)|(sepctx)|(domain))?"),
    ("ch4-ucx", "netmod=ch4-ucx", r"(ch4-)?ucx(-(global)|(vci))?"),
]
RUN_NAME_TAGS = [Tag(n, p, "RunName", "Metadata", d) for n, d, p in _RUN_NAME]

# Fixed values: (tag name, text after "Building remotely on ") of the build-node tags.
# The macOS node goes without its site's domain; its lines match all the same.
_NODES = [
    ("pmrs-freebsd64-240-01", "pmrs-freebsd64-240-01"),
    ("pmrs-freebsd64-240-02", "pmrs-freebsd64-240-02"),
    ("pmrs-gpu-240-01", "pmrs-gpu-240-01"),
    ("pmrs-gpu-240-02", "pmrs-gpu-240-02"),
    ("pmrs-linux-240-01", "pmrs-linux-240-01"),
    ("pmrs-linux-240-02", "pmrs-linux-240-02"),
    ("pmrs-linux-240-03", "pmrs-linux-240-03"),
    ("pmrs-linux-240-04", "pmrs-linux-240-04"),
    ("pmrs-linux-240-05", "pmrs-linux-240-05"),
    ("pmrs-linux-240-06", "pmrs-linux-240-06"),
    ("pmrs-macos-240-01", "pmrs-macos-240-01"),
    ("softiron-1", "softiron-1"),
    ("softiron-2", "softiron-2"),
    ("tiger", "tiger"),
    ("yuzu", "yuzu (xpmem)"),
    ("built-in", "built-in node"),
    ("aws", "aws"),
]


def node_tag(name: str, node: str) -> Tag:
    """Metadata tag for the console line naming the build node."""
    literal = node.replace("(", r"\(").replace(")", r"\)")
    return Tag(
        name,
        rf"(?m)^Building remotely on {literal}.*$",
        "Console",
        "Metadata",
        f"{name} Build Node",
        needle=f"Building remotely on {node}",
    )


NODE_TAGS = [node_tag(name, node) for name, node in _NODES]
STOCK_TAGS = number_tags(ERROR_TAGS + RUN_NAME_TAGS + NODE_TAGS)

# The stock artifact rules, first match wins.
ARTIFACT_RULES = [r"top.txt", r"graph_.*.svg", r"(summary.junit.xml)|(summary.txt)"]

# Fixed value: names of build-node tags in the stock views.
AGENT_NAMES = r"(pmrs-.*)|(built-in)|(aws)|(tiger)|(yuzu)|(softiron-[0-9]+)"


@dataclass(frozen=True)
class Config:
    """Settings of one nightly run; the defaults are the stock ones."""

    tags: list[Tag] = field(default_factory=lambda: list(STOCK_TAGS))
    artifact_rules: list[str] = field(default_factory=lambda: list(ARTIFACT_RULES))
    blocklist: list[str] = field(default_factory=list)
    last_n_history: int = 5
    threshold: float = 0.9
    utc_offset_hours: int = -5

    @staticmethod
    def load(path: str) -> "Config":
        """Read a TOML file with blocklist, last_n_history, threshold, timezone, [[artifact]], [[tag]]."""
        with open(path, "rb") as handle:
            raw = tomllib.load(handle)
        known = {t.pattern: t for t in STOCK_TAGS}
        tags = []
        for t in raw.get("tag", []):
            stock = known.get(t["pattern"])
            tags.append(
                Tag(
                    t["name"],
                    t["pattern"],
                    t["from"],
                    t["severity"],
                    t.get("desc", ""),
                    scan=stock and stock.scan,
                    needle=stock and stock.needle,
                )
            )
        return Config(
            tags=number_tags(tags),
            artifact_rules=[a["path"] for a in raw.get("artifact", [])],
            blocklist=list(raw.get("blocklist", [])),
            last_n_history=raw.get("last_n_history", 5),
            threshold=raw.get("threshold", 0.9),
            utc_offset_hours=raw.get("timezone", 0),
        )
