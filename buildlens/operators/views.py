"""Boolean tag views: expression objects over the tags each run has.

``Tag`` and ``Severity`` test a run; ``TagSet`` and ``SeveritySet`` stand for one row per tag.
Combine them with ``~``, ``&`` and ``|``::

    show(~TagSet("x") & Severity("Error"), tags, run_tag_ids)
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TagRef:
    """What a view needs to know of a tag."""

    tag_id: int
    name: str
    severity: str


def tag_refs(tags: DataFrame) -> list[TagRef]:
    """The tags table as a list; its size is that of the configuration."""
    return [TagRef(*row) for row in tags.select("tag_id", "name", "severity").orderBy("ord").collect()]


def _labels(labels: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in labels]).cast("array<string>")


def _combined(left: Column, sign: str, right: Column) -> Column:
    """Every left label with every right one."""
    return F.flatten(F.transform(right, lambda r: F.transform(left, lambda l: F.concat(l, F.lit(f" {sign} "), r))))


class View:
    """A view expression: ``labels`` names its rows, ``matched`` gives those that hold for a run's ``tag_ids``.

    The size of the column that ``matched`` builds follows that of the expression and the catalog; a
    product of two sets has a row, but no column, for every pair.
    """

    def __invert__(self) -> "View":
        return _Not(self)

    def __and__(self, other: "View") -> "View":
        return _Both(self, other, "&&")

    def __or__(self, other: "View") -> "View":
        return _Both(self, other, "||")

    def labels(self, tags: list[TagRef], negated: bool = False) -> list[str]:
        raise NotImplementedError

    def matched(self, tags: list[TagRef], negated: bool = False) -> Column:
        raise NotImplementedError

    def reads(self, tags: list[TagRef], negated: bool = False) -> set[int]:
        """The ids of the tags that decide: no text need be searched for the others."""
        raise NotImplementedError


class _Predicate(View):
    """One row: whether the run has one of some tags."""

    def _label(self) -> str:
        raise NotImplementedError

    def _holds(self, tag: TagRef) -> bool:
        raise NotImplementedError

    def labels(self, tags, negated=False):
        return [f"!{self._label()}" if negated else self._label()]

    def reads(self, tags, negated=False):
        return {t.tag_id for t in tags if self._holds(t)}

    def matched(self, tags, negated=False):
        ids = sorted(self.reads(tags))
        known = F.arrays_overlap(F.col("tag_ids"), F.array(*[F.lit(i).cast("long") for i in ids])) if ids else F.lit(False)
        return F.when(~known if negated else known, _labels(self.labels(tags, negated))).otherwise(_labels([]))


@dataclass(frozen=True)
class Tag(_Predicate):
    """Run has a tag whose name contains a match of ``pattern``."""

    pattern: str

    def _label(self):
        return self.pattern

    def _holds(self, tag):
        return re.search(self.pattern, tag.name) is not None


@dataclass(frozen=True)
class Severity(_Predicate):
    """Run has a tag of this severity."""

    severity: str

    def _label(self):
        return self.severity

    def _holds(self, tag):
        return tag.severity == self.severity


class _TagRows(View):
    """One row per chosen tag; the complement is the rows of the other tags, not a negation.

    A row's tag name is used as a pattern in its turn, so a row also covers longer names.
    """

    def _chosen(self, tag: TagRef) -> bool:
        raise NotImplementedError

    def labels(self, tags, negated=False):
        return [t.name for t in tags if self._chosen(t) is not negated]

    def _rows_of(self, tags, negated) -> dict[int, list[str]]:
        """For each tag the rows it belongs to."""
        rows = self.labels(tags, negated)
        covers = {t.tag_id: [row for row in rows if re.search(row, t.name)] for t in tags}
        return {tag_id: names for tag_id, names in covers.items() if names}

    def reads(self, tags, negated=False):
        return set(self._rows_of(tags, negated))

    def matched(self, tags, negated=False):
        rows = self._rows_of(tags, negated)
        if not rows:
            return _labels([])
        of = F.create_map(*[c for i, names in rows.items() for c in (F.lit(i).cast("long"), _labels(names))])
        return F.flatten(F.transform("tag_ids", lambda i: F.coalesce(F.try_element_at(of, i), _labels([]))))


@dataclass(frozen=True)
class TagSet(_TagRows):
    """One row per tag whose name contains a match of ``pattern``."""

    pattern: str

    def _chosen(self, tag):
        return re.search(self.pattern, tag.name) is not None


@dataclass(frozen=True)
class SeveritySet(_TagRows):
    """One row per tag of this severity."""

    severity: str

    def _chosen(self, tag):
        return tag.severity == self.severity


@dataclass(frozen=True)
class _Not(View):
    inner: View

    def labels(self, tags, negated=False):
        return self.inner.labels(tags, not negated)

    def matched(self, tags, negated=False):
        return self.inner.matched(tags, not negated)

    def reads(self, tags, negated=False):
        return self.inner.reads(tags, not negated)


@dataclass(frozen=True)
class _Both(View):
    left: View
    right: View
    sign: str

    def _sign(self, negated):
        return {"&&": "||", "||": "&&"}[self.sign] if negated else self.sign

    def labels(self, tags, negated=False):
        sign = self._sign(negated)
        left = self.left.labels(tags, negated)
        return [f"{l} {sign} {r}" for r in self.right.labels(tags, negated) for l in left]

    def matched(self, tags, negated=False):
        sign = self._sign(negated)
        sides = (self.left, self.right)
        left, right = (side.matched(tags, negated) for side in sides)
        if sign == "&&":
            return _combined(left, sign, right)
        every_left, every_right = (_labels(side.labels(tags, negated)) for side in sides)
        return F.array_union(_combined(left, sign, every_right), _combined(every_left, sign, right))

    def reads(self, tags, negated=False):
        return self.left.reads(tags, negated) | self.right.reads(tags, negated)


def run_tag_ids(issues: DataFrame, latest: DataFrame) -> DataFrame:
    """(run_id, tag_ids) of every run in ``latest``; the array holds at most one entry per tag."""
    held = issues.groupBy("run_id").agg(F.collect_set("tag_id").alias("tag_ids"))
    none = F.array().cast("array<long>")
    return (
        latest.select("run_id")
        .join(held, "run_id", "left")
        .select("run_id", F.coalesce("tag_ids", none).alias("tag_ids"))
    )


def show(view: View, tags: list[TagRef], tagged_runs: DataFrame) -> DataFrame:
    """(label, run_id) of every row of the view, all rows in one pass over the runs."""
    out = tagged_runs.select("run_id", F.explode(F.array_distinct(view.matched(tags))).alias("label"))
    return out.select("label", "run_id")


def summarize(matches: DataFrame) -> DataFrame:
    """Number of runs per row; rows without a run do not appear."""
    return matches.groupBy("label").agg(F.count(F.lit(1)).alias("n_runs"))


def stock_views(agents: str) -> dict[str, View]:
    """The stock views, given the pattern of the build-node tag names."""
    return {
        "By Tag": ~SeveritySet("Metadata"),
        "By Metadata": ~Tag(agents) & SeveritySet("Metadata"),
        "By Agent": TagSet(agents),
        "Jenkins Failures By Platform": Tag("jenkins_agent_offline") & TagSet(agents),
    }
