"""View expressions: rows, labels, matches."""

import itertools

import pytest
from pyspark.sql import functions as F

from buildlens.catalog import AGENT_NAMES
from buildlens.operators.views import Severity, SeveritySet, Tag, TagRef, TagSet, show, stock_views, summarize

TAGS = [
    TagRef(1, "linux", "Metadata"),
    TagRef(2, "pmrs-linux-01", "Metadata"),
    TagRef(3, "cc_emit", "Error"),
    TagRef(4, "out_of_space", "Info"),
]
RUNS = {10: [1], 11: [2, 3], 12: [], 13: [3, 4]}


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame(list(RUNS.items()), "run_id long, tag_ids array<long>")


def matches(view, runs):
    out = {}
    for r in show(view, TAGS, runs).collect():
        out.setdefault(r.label, set()).add(r.run_id)
    return out


def labels(view):
    return view.labels(TAGS)


def test_predicates(runs):
    assert matches(Tag("cc_"), runs) == {"cc_": {11, 13}}
    assert matches(~Tag("cc_"), runs) == {"!cc_": {10, 12}}
    assert matches(Severity("Info"), runs) == {"Info": {13}}
    assert matches(~Severity("Metadata"), runs) == {"!Metadata": {12, 13}}


def test_sets_and_complements(runs):
    assert labels(TagSet("linux")) == ["linux", "pmrs-linux-01"]
    assert labels(~SeveritySet("Metadata")) == ["cc_emit", "out_of_space"]
    # A row's name is a pattern: linux also covers the longer name.
    assert matches(SeveritySet("Metadata"), runs) == {"linux": {10, 11}, "pmrs-linux-01": {11}}


def test_products_and_labels():
    both = TagSet("linux") & ~SeveritySet("Metadata")
    assert labels(both) == [
        "linux && cc_emit",
        "pmrs-linux-01 && cc_emit",
        "linux && out_of_space",
        "pmrs-linux-01 && out_of_space",
    ]
    assert labels(Tag("a") | Tag("b") & ~Tag("c")) == ["a || b && !c"]


def test_rows_without_match_are_hidden(runs):
    assert matches(Tag("nothing"), runs) == {}
    assert matches(TagSet("nothing"), runs) == {}
    assert {r.label: r.n_runs for r in summarize(show(Tag("cc"), TAGS, runs)).collect()} == {"cc": 2}


def test_boolean_laws(runs):
    a, b = Tag("linux"), Severity("Error")
    rows = lambda v: set().union(*matches(v, runs).values()) if matches(v, runs) else set()
    assert matches(~~a, runs) == matches(a, runs)
    assert rows(~(a & b)) == rows(~a | ~b) and labels(~(a & b)) == ["!linux || !Error"]
    assert rows(~(a | b)) == rows(~a & ~b) and labels(~(a | b)) == ["!linux && !Error"]
    everything = set(RUNS)
    for v in (a, b, a & b, a | b):
        assert rows(v) | rows(~v) == everything and not rows(v) & rows(~v)


def test_stock_views():
    views = stock_views(AGENT_NAMES)
    assert labels(views["By Tag"]) == ["cc_emit", "out_of_space"]
    assert labels(views["By Agent"]) == ["pmrs-linux-01"]
    assert len(labels(views["By Metadata"])) == 2
    assert labels(views["Jenkins Failures By Platform"]) == ["jenkins_agent_offline && pmrs-linux-01"]


def test_a_product_of_two_large_sets_has_no_column_per_pair(spark):
    tags = [TagRef(i, f"name{i:02d}", "Info") for i in range(1, 44)]
    runs = spark.createDataFrame([(1, [1, 2, 43]), (2, []), (3, [7])], "run_id long, tag_ids array<long>")
    for view, sign in ((TagSet("name") & TagSet("name"), "&&"), (TagSet("name") | TagSet("name"), "||")):
        found = show(view, tags, runs)
        held = {1: {1, 2, 43}, 2: set(), 3: {7}}
        both = (lambda a, b, h: a in h and b in h) if sign == "&&" else (lambda a, b, h: a in h or b in h)
        want = {
            (f"name{a:02d} {sign} name{b:02d}", run)
            for run, h in held.items() for a in range(1, 44) for b in range(1, 44) if both(a, b, h)
        }
        got = [tuple(r) for r in found.collect()]
        assert set(got) == want and len(got) == len(want) and len(view.labels(tags)) == 43 * 43
        assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 40_000


def test_views_name_the_tags_that_decide(runs):
    assert (Tag("cc_") & TagSet("linux")).reads(TAGS) == {1, 2, 3}
    assert (~SeveritySet("Metadata")).reads(TAGS) == {3, 4} and (~Severity("Info")).reads(TAGS) == {4}
