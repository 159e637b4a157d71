"""URL filters with block decisions that reach redirect and canonical aliases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.llm.lines import ascii_lower
from buildlens.llm.components import connected_components
from buildlens.session import cut_lineage

Rule = tuple[str, str]  # verdict ("allow" or "block"), host with path prefix

LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*http-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
GOES = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty without ``://`` or for null."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits the host or a parent domain and the path, as (rule, verdict)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, prefix = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(
            path, F.lit(slash + prefix)
        )
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_key(url: Column) -> Column:
    """The form that equal addresses share: no scheme, fragment, tracking or last slash."""
    host, path = host_and_path(url)
    query = F.regexp_extract(url, r"\A[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(
        F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.regexp_like(x, F.lit(r"(?i)\A(utm_[a-z]+|ref|fbclid|gclid)=")))
    )
    plain = F.regexp_replace(path, r"(/index\.html?|/)\z", "")
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.locate("://", url) > 0, F.concat(host, plain, tail)).otherwise(url)


def _target(page: Column, tag: str, attribute: str) -> Column:
    return F.regexp_extract(F.regexp_extract(page, tag, 0), attribute, 1)


def _plain_attribute(value: Column) -> Column:
    """An attribute's value without character references for the characters that addresses hold."""
    for pattern, char in ((r"(?i)&(quot|#34|#x22);", '"'), (r"(?i)&(apos|#39|#x27);", "'"), (r"(?i)&(amp|#38|#x26);", "&")):
        value = F.regexp_replace(value, pattern, char)
    return value


def _without_dots(path: Column) -> Column:
    """A path from the root with its ``.`` and ``..`` segments resolved; ``..`` does not leave the root."""
    segments = F.split(F.substr(path, F.lit(2)), "/")
    # A last segment of dots names a folder.
    folder = F.when(F.regexp_like(path, F.lit(r"/\.{1,2}\z")), F.concat(segments, F.array(F.lit("")))).otherwise(segments)
    none = F.array().cast("array<string>")
    kept = F.aggregate(
        folder,
        none,
        lambda done, x: F.when(x == ".", done)
        .when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(x))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def resolved(base: Column, to: Column) -> Column:
    """The address that a link ``to`` on the page ``base`` names; null for links that are no address.

    Full addresses stay as they are. Other links take scheme, host, path or query from the page, as far as
    they do not name them; ``.`` and ``..`` segments are resolved. A fragment alone names the page itself.
    """
    scheme = F.regexp_extract(base, r"\A([^:/?#]+)://", 1)
    host, path = host_and_path(base)
    site = F.concat(scheme, F.lit("://"), host)
    rooted = F.when(F.startswith(path, F.lit("/")), path).otherwise("/")
    query = F.regexp_extract(base, r"\A[^?#]*(\?[^#]*)", 1)
    own = F.regexp_extract(to, r"\A([^?#]*)", 1)
    rest = F.regexp_extract(to, r"\A[^?#]*(.*)", 1)
    beside = F.concat(F.regexp_extract(rooted, r"\A(.*/)", 1), own)
    return (
        F.when(F.regexp_like(to, F.lit(r"\A[A-Za-z][A-Za-z0-9+.\-]*://")), to)
        .when(F.regexp_like(to, F.lit(r"\A[A-Za-z][A-Za-z0-9+.\-]*:")), F.lit(None).cast("string"))
        .when(F.startswith(to, F.lit("//")), F.concat(scheme, F.lit(":"), to))
        .when(F.startswith(to, F.lit("/")), F.concat(site, _without_dots(own), rest))
        .when(F.startswith(to, F.lit("?")), F.concat(site, rooted, rest))
        .when(F.startswith(to, F.lit("#")), F.concat(site, rooted, query, rest))
        .otherwise(F.concat(site, _without_dots(beside), rest))
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """(url, other): canonical links and meta refreshes that pages declare, resolved against the page's url.

    Links of pages whose url is null or has no ``://``, empty links and links such as ``mailto:`` give no edge.
    """
    html, url = F.col("html"), F.col("url")
    targets = F.array(_target(html, LINK, HREF), _target(html, REFRESH, GOES))
    found = pages.filter((F.locate("://", url) > 0) & F.regexp_like(html, F.lit(f"{LINK}|{REFRESH}"))).select(
        "url", F.explode(targets).alias("to")
    )
    other = resolved(url, _plain_attribute(F.col("to")))
    return found.filter("to <> ''").select("url", other.alias("other")).filter("other is not null")


def judge_urls(urls: DataFrame, edges: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows of ``urls`` (url, ...) with host, path, rule, verdict and alias_blocked.

    ``edges`` (url, other) are redirects and canonical links. Addresses with the same form (see
    url_key) and addresses joined by edges are one component. A url takes the verdict of the longest
    rule that fits it: an explicit allow always wins for the url itself. A url without a rule is
    blocked when a url of its component, edge targets included, has a block rule; else allowed.

    Null urls and urls without ``://`` have empty host and path, no rule and verdict allow; they
    have no aliases. Null ends of edges are ignored, repeated rows are judged alike, columns of
    ``urls`` with the names of new ones are replaced. Without edges or rows the result is the
    rules' alone, or empty.

    Only components with an edge between different forms need the graph; equal forms meet in one
    aggregate that combines before the shuffle, so a url repeated by a third of the rows is one
    node. A node is a 63-bit hash of the form; texts of pages are not shuffled.
    """
    node = lambda form: F.shiftrightunsigned(F.xxhash64(form), 1)
    parts = edges.filter("url is not null and other is not null").select(
        node(url_key(F.col("url"))).alias("x"),
        node(url_key(F.col("other"))).alias("y"),
        F.col("other").alias("end"),
    )
    parts = cut_lineage(parts.distinct())
    links = parts.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    groups = connected_components(links.distinct())

    def judged(url: Column) -> Column:
        host, path = host_and_path(url)
        return rule_of(host, path, rules)

    new = ("host", "path", "rule", "verdict", "alias_blocked")
    host, path = host_and_path(F.col("url"))
    real = F.locate("://", F.col("url")) > 0
    rows = urls.select(
        F.struct("*").alias("row"),
        host.alias("host"),
        path.alias("path"),
        judged(F.col("url")).alias("own"),
        F.when(real, node(url_key(F.col("url")))).alias("node"),
    )
    blocked = (
        rows.filter("own.verdict = 'block'").select("node")
        .unionByName(
            parts.filter(judged(F.col("end"))["verdict"] == "block").select(F.col("y").alias("node"))
        )
        .distinct()
    )
    groups = cut_lineage(groups)
    of = blocked.join(groups, "node", "left").select(
        F.coalesce("component", "node").alias("component")
    ).distinct()
    aliases = (
        groups.join(of, "component").select("node")
        .unionByName(of.select(F.col("component").alias("node")))
        .distinct()
        .withColumn("hit", F.lit(True))
    )
    out = rows.join(aliases, "node", "left")
    hit = F.coalesce("hit", F.lit(False))
    names = [c for c in urls.columns if c not in new]
    return out.select(
        *[F.col(f"row.`{c}`").alias(c) for c in names],
        "host",
        "path",
        F.col("own.rule").alias("rule"),
        F.coalesce(F.col("own.verdict"), F.when(hit, F.lit("block")).otherwise("allow")).alias("verdict"),
        (hit & F.col("own").isNull()).alias("alias_blocked"),
    )
