"""Fuzzy self-join of issue snippets and complete-linkage grouping."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from buildlens.functions.ids import ordered_ids
from buildlens.functions.labels import severity_rank
from buildlens.functions.text import common_start, decay_similarity, edit_budget, edit_ratio
from buildlens.operators.graph import complete_linkage
from buildlens.session import cut_lineage, dealt, merged

# A unit of so many members is compared with all members of a unit that it may be similar to.
FEW_MEMBERS = 16
# The texts of one wording are compared in so many parts, so that no task holds all of their pairs.
WORDING_PARTS = 16


def distinct_snippets(issues: DataFrame) -> DataFrame:
    """(node, snippet, first_issue) in order of first issue; equal snippets are one node.

    Written before it is numbered as well: the range shuffle looks at its input twice.
    """
    snippets = cut_lineage(issues.groupBy("snippet").agg(F.min("issue_id").alias("first_issue")))
    return cut_lineage(ordered_ids(snippets, "first_issue", "node"))


def short_piece(threshold: float) -> int:
    """Piece length that gives each text at least twice the pieces it needs: half may be skipped."""
    return max(1, math.floor(1.0 / (2.0 * edit_ratio(threshold))))


def _long_piece(length, threshold: float):
    """Largest piece length for which every text from ``length`` on has edits + 1 pieces.

    m / (floor(c m) + 1) falls only where floor(c m) grows, and less deep each time, so the value at
    ``length`` and the one at the next such place bound all later ones.
    """
    ratio = edit_ratio(threshold)
    edits = F.floor(length * ratio + 1e-9)
    after = (edits + 1) / F.lit(ratio) / (edits + 2)
    return F.greatest(F.lit(1), F.floor(F.least(length / (edits + 1), after))).cast("int")


def _band(length, threshold: float):
    """Length band; bands are a factor 1 - c wide, so partners lie in the same one or in neighbours."""
    return F.floor(F.log(length) / F.lit(-math.log(1.0 - edit_ratio(threshold)))).cast("int")


def _piece_sizes(threshold: float):
    """The length of short pieces, and that of long pieces for the band."""
    width = -math.log(1.0 - edit_ratio(threshold))
    start = F.greatest(F.lit(1), F.floor(F.exp(F.col("band") * F.lit(width))) - 1)
    short = F.lit(short_piece(threshold))
    return short, F.greatest(short, _long_piece(start, threshold))


def _wording(threshold: float):
    """A hash of the text without its numbers, null unless the text must offer a piece without a digit.

    Such a piece is shared by all texts that differ in numbers only, so pieces would pair them all. They are
    compared as they are, see ``worded_pairs``; a clash only adds a comparison.
    """
    def stands_alone(size):
        pieces = F.regexp_extract_all("snippet", F.concat(F.lit("(?s).{"), size.cast("string"), F.lit("}")), F.lit(0))
        numbered = F.size(F.filter(pieces, lambda piece: piece.rlike("[0-9]")))
        return (numbered <= F.col("budget")) & (numbered < F.size(pieces))

    short, long = _piece_sizes(threshold)
    offered = (F.col("budget") >= 1) & F.col("snippet").rlike("[0-9]") & stands_alone(short) & stands_alone(long)
    return F.when(offered, F.xxhash64("part", F.regexp_replace("snippet", "[0-9]+", "0")))


def _texts(nodes: DataFrame, threshold: float) -> DataFrame:
    """Nodes with length, edit budget, length band and wording.

    Only nodes of the same ``part``, if there is one, are compared. Each text is cut into many pieces, so few
    bytes are much work and are dealt to all tasks.
    """
    length = F.char_length("snippet")
    part = F.col("part") if "part" in nodes.columns else F.lit(0).cast("long")
    return dealt(nodes.filter(length > 0), "node", per_core=4).select(
        "node",
        part.alias("part"),
        "snippet",
        length.alias("length"),
        edit_budget(length, threshold).alias("budget"),
        _band(length, threshold).alias("band"),
    ).withColumn("wording", _wording(threshold))


def _pieced(texts: DataFrame, threshold: float, pattern: str, group: int) -> DataFrame:
    """(..., at, key) for the matches of ``pattern`` with short and with long pieces.

    The piece length depends on the band alone, so both sides of the join cut alike. The key hashes
    piece, band and kind; a clash only adds a candidate.
    """
    sizes = F.array(*_piece_sizes(threshold))
    kinds = texts.withColumn("size", F.explode(F.array_distinct(sizes)))
    regex = F.concat(F.lit(pattern[0]), F.col("size").cast("string"), F.lit(pattern[1]))
    rest = [c for c in kinds.columns if c != "snippet"]
    cut = kinds.select(
        *rest,
        F.posexplode(F.regexp_extract_all("snippet", regex, F.lit(group))).alias("at", "piece"),
    )
    return cut.withColumn("key", F.xxhash64("part", "size", "band", "piece")).drop("piece")


def _offers(texts: DataFrame, threshold: float) -> DataFrame:
    """Of every text that may differ at all, edits + 1 disjoint pieces.

    An edit touches at most one piece, so a text within the budget keeps one of them whole, at most
    ``budget`` places away. Each text offers the rarest of its short pieces or its long pieces,
    whichever are used less in total: the former pass by common wording, the latter stand out where
    all words are common.
    """
    cut = _pieced(texts.filter(F.col("budget") >= 1), threshold, ("(?s).{", "}"), 0)
    uses = cut.groupBy("key").agg(F.count(F.lit(1)).alias("uses"))
    rarest = Window.partitionBy("node", "part", "size").orderBy("uses", "at")
    total = F.sum("uses").over(Window.partitionBy("node", "part", "size"))
    best = F.min(F.struct("total", "size")).over(Window.partitionBy("node", "part"))
    return (
        cut.join(merged(uses), "key")
        .repartition("node", "part")
        .withColumn("rank", F.row_number().over(rarest))
        .filter(F.col("rank") <= F.col("budget") + 1)
        .withColumn("total", total)
        .withColumn("best", best)
        .filter(F.col("size") == F.col("best.size"))
        .select("node", "length", "budget", "key", (F.col("at") * F.col("size")).alias("at"), "wording")
    )


def offered_pieces(nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, length, budget, key, at, wording): the few pieces of each text as the longer one of a pair."""
    return _offers(_texts(nodes, threshold), threshold)


def probed_pieces(nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, length, at, key, wording): all substrings of each text as the shorter one, cut as its partners' bands cut.

    Partners lie in the same length band or in the one above.
    """
    bands = _texts(nodes, threshold).withColumn(
        "band", F.explode(F.array(F.col("band"), F.col("band") + 1))
    )
    return _pieced(bands, threshold, ("(?s)(?=(.{", "}))"), 1).select("node", "length", "at", "key", "wording")


def paired_pieces(offers: DataFrame, probes: DataFrame, worded: bool = True) -> DataFrame:
    """(a, b) with a < b, without repeats: nodes that share a piece at places the edits can explain.

    Pairs of one wording may be left out.
    """
    near = (
        (F.col("l.key") == F.col("s.key"))
        & (F.col("s.length") <= F.col("l.length"))
        & (F.col("l.length") - F.col("s.length") <= F.col("l.budget"))
        & (F.abs(F.col("l.at") - F.col("s.at")) <= F.col("l.budget"))
        & (F.col("l.node") != F.col("s.node"))
    )
    if not worded:
        near = near & F.coalesce(F.col("l.wording") != F.col("s.wording"), F.lit(True))
    return (
        offers.alias("l").join(probes.alias("s"), near)
        .select(
            F.least("l.node", "s.node").alias("a"),
            F.greatest("l.node", "s.node").alias("b"),
        )
        .distinct()
    )


def candidate_pairs(longer: DataFrame, shorter: DataFrame, threshold: float) -> DataFrame:
    """(a, b) with a < b: a superset of the similar pairs of a longer (or as long) and a shorter text."""
    return paired_pieces(offered_pieces(longer, threshold), merged(probed_pieces(shorter, threshold)))


def _of_near_length(nodes: DataFrame, others: DataFrame, threshold: float, step: int) -> DataFrame:
    """``nodes`` in the length band of one of ``others`` or ``step`` bands from it; no other can be its partner.

    There are some hundred bands at most, however long the texts are.
    """
    band = _band(F.char_length("snippet"), threshold)
    bands = others.select(band.alias("band")).distinct()
    near = bands.select(F.explode(F.array(F.col("band"), F.col("band") + step)).alias("band")).distinct()
    return nodes.withColumn("band", band).join(F.broadcast(near), "band", "left_semi").select(*nodes.columns)


def measured_pairs(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """``pairs`` whose texts lie within the edit budget, with distance and longer length."""
    left = nodes.select(F.col("node").alias("a"), F.col("snippet").alias("left"))
    right = nodes.select(F.col("node").alias("b"), F.col("snippet").alias("right"))
    texts = (
        pairs.join(merged(left), "a")
        .join(merged(right), "b")
        .withColumn("longer", F.greatest(F.char_length("left"), F.char_length("right")))
        .withColumn("budget", edit_budget(F.col("longer"), threshold))
    )
    return _measured(texts)


def _measured(texts: DataFrame) -> DataFrame:
    """(a, b, distance, longer) of the rows (a, b, left, right, longer, budget) within the budget.

    Digits of both texts beside them, if not null, must lie within the budget too. A distance is generated, not projected: filters on it would each measure the texts again.
    """
    distance = F.expr("levenshtein(left, right, budget)")
    if "left_digits" in texts.columns:
        near = F.coalesce(F.expr("levenshtein(left_digits, right_digits, budget)"), F.lit(0)) >= 0
        distance = F.when(near, distance).otherwise(F.lit(-1))
    distance = F.explode(F.array(distance))
    measured = texts.select("a", "b", "longer", distance.alias("distance"))
    return measured.filter(F.col("distance") >= 0).select("a", "b", "distance", "longer")


def worded_texts(nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, wording, snippet, length, budget) of the nodes with a wording."""
    texts = _texts(nodes, threshold).filter(F.col("wording").isNotNull())
    return texts.select("node", "wording", "snippet", "length", "budget")


def worded_pairs(texts: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """(a, b, distance, longer) of the texts of one wording within the edit budget, a < b.

    ``texts`` are compared with each other and with ``earlier`` ones, which are not compared among themselves.
    What all texts of a wording start or end with is left out: it changes no distance. Numbers are compared
    first: without the other characters two texts are no further apart.
    """
    every = texts.withColumn("new", F.lit(True))
    if earlier is not None:
        asked = texts.select("wording").distinct()
        every = every.unionByName(earlier.join(merged(asked), "wording", "left_semi").withColumn("new", F.lit(False)))
    every = cut_lineage(every)
    turned = F.reverse("snippet")
    ends = every.groupBy("wording").agg(
        F.min("snippet").alias("least"), F.max("snippet").alias("most"),
        F.min(turned).alias("turned_least"), F.max(turned).alias("turned_most"),
        F.min("length").alias("shortest"), F.count(F.lit(1)).alias("n"),
    )
    # The least and the last text in order start alike only as far as all between them.
    ends = ends.filter("n > 1").withColumn("start", common_start("least", "most"))
    end = F.least(common_start("turned_least", "turned_most"), F.col("shortest") - F.col("start"))
    ends = cut_lineage(ends.select("wording", "start", end.alias("end")))
    core = F.substring(F.col("snippet"), F.col("start") + 1, F.col("length") - F.col("start") - F.col("end"))
    cores = every.join(merged(ends), "wording").select("node", "wording", "length", "budget", "new", core.alias("core"))
    digits = F.regexp_replace("core", "[^0-9]", "")
    few = F.char_length(digits) * 2 < F.char_length("core")
    cores = cut_lineage(cores.withColumn("digits", F.when(few, digits)))

    part = F.pmod(F.xxhash64("node"), F.lit(WORDING_PARTS)).cast("int")
    parts = F.explode(F.array(*[F.lit(p) for p in range(WORDING_PARTS)]))
    left = dealt(cores.filter("new").withColumn("part", part), "wording", "part", least=8)
    right = dealt(cores.withColumn("part", parts), "wording", "part", least=8)
    budget = F.greatest("l.budget", "s.budget")
    near = (
        (F.col("l.wording") == F.col("s.wording"))
        & (F.col("l.part") == F.col("s.part"))
        & ((F.col("s.node") < F.col("l.node")) | ~F.col("s.new"))
        & (F.abs(F.col("l.length") - F.col("s.length")) <= budget)
    )
    return _measured(
        left.alias("l").join(merged(right).alias("s"), near).select(
            F.least("l.node", "s.node").alias("a"),
            F.greatest("l.node", "s.node").alias("b"),
            F.col("l.core").alias("left"),
            F.col("s.core").alias("right"),
            F.greatest("l.length", "s.length").alias("longer"),
            F.col("l.digits").alias("left_digits"),
            F.col("s.digits").alias("right_digits"),
            budget.alias("budget"),
        )
    )


def similar_pairs(nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, distance, similarity) of all pairs of different snippets above the threshold."""
    pairs = paired_pieces(offered_pieces(nodes, threshold), merged(probed_pieces(nodes, threshold)), worded=False)
    found = measured_pairs(pairs, nodes, threshold).unionByName(worded_pairs(worded_texts(nodes, threshold)))
    return (
        found.withColumn("similarity", decay_similarity(F.col("distance"), F.col("longer")))
        .filter(F.col("similarity") > threshold)
        .select("a", "b", "distance", "similarity")
    )


def _number_families(nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, snippet, template, digits, first): texts that differ in digits only form a family.

    With few digits for its length, any two members are similar, whatever their digits are. ``first``
    is the family's first node, null for snippets without a family.
    """
    digits = F.char_length("snippet") - F.char_length(F.regexp_replace("snippet", "[0-9]", ""))
    told = nodes.select(
        "node",
        "snippet",
        F.regexp_replace("snippet", "[0-9]", "0").alias("template"),
        digits.alias("digits"),
    )
    few = decay_similarity(F.col("digits"), F.char_length("snippet")) > threshold
    told = told.withColumn("few", few & (F.col("digits") > 0))
    shared = (
        told.filter("few")
        .groupBy("template")
        .agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .select("template", "first", F.lit(True).alias("few"))
    )
    return told.join(merged(shared), ["template", "few"], "left").select(
        "node", "snippet", "template", "digits", "first"
    )


def _judged_units(told: DataFrame, threshold: float) -> DataFrame:
    """(a, b, a_first, b_first, sure) of the pairs of units, families or single snippets, that may be similar.

    Masking digits never adds edits, and taking the digits back adds at most one per digit of the
    poorer text. So the distance d of two templates bounds that of their members by d and by
    d + digits: mostly all pairs are similar (sure) or none is, and the family acts as one unit. Pairs of
    two single snippets are left out.
    """
    families = told.filter(F.col("node") == F.col("first"))
    singles = told.filter(F.col("first").isNull())
    masked = lambda df: df.select("node", F.col("template").alias("snippet"))
    units = cut_lineage(
        families.unionByName(singles).select("node", "template", "digits", "first")
    )
    few, rest = masked(units.filter(F.col("first").isNotNull())), masked(units.filter(F.col("first").isNull()))
    # Single snippets far longer or shorter than every family are not cut into pieces.
    shorter = _of_near_length(masked(units), few, threshold, -1)
    longer = _of_near_length(rest, few, threshold, 1)
    pairs = (
        candidate_pairs(few, shorter, threshold).unionByName(candidate_pairs(longer, few, threshold)).distinct()
    )
    of = lambda end: units.select(
        F.col("node").alias(end), F.col("digits").alias(f"{end}_digits"), F.col("first").alias(f"{end}_first")
    )
    most = F.col("distance") + F.least("a_digits", "b_digits")
    return cut_lineage(
        measured_pairs(pairs, masked(units), threshold)
        .filter(decay_similarity(F.col("distance"), F.col("longer")) > threshold)
        .join(merged(of("a")), "a")
        .join(merged(of("b")), "b")
        .withColumn("sure", decay_similarity(most, F.col("longer")) > threshold)
    )


def _family_edges(told: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links of and beside families: (a, b) over units, and (node, unit) of all nodes.

    Families that some neighbour leaves open are taken apart and compared member by member.
    """
    judged = _judged_units(told, threshold)
    singles = told.filter(F.col("first").isNull())
    open_ends = judged.filter(~F.col("sure")).select(F.explode(F.array("a_first", "b_first")).alias("first"))
    apart = cut_lineage(open_ends.filter(F.col("first").isNotNull()).distinct())

    members = told.filter(F.col("first").isNotNull()).select("node", "snippet", "first")
    loose = members.join(merged(apart), "first", "left_semi")
    whole = members.join(merged(apart), "first", "left_anti")
    alone = cut_lineage(singles.select("node", "snippet").unionByName(loose.select("node", "snippet")))
    placed = alone.select("node", F.col("node").alias("unit")).unionByName(
        whole.select("node", F.col("first").alias("unit"))
    )

    # A kept family's links are sure; towards a family taken apart they hold for each member.
    parts = loose.select("first", F.col("node").alias("part"))
    marked = apart.withColumn("apart", F.lit(True))
    sure = judged.filter("sure").select("a", "b", "a_first", "b_first")
    for end in ("a", "b"):
        sure = sure.join(
            merged(marked.select(F.col("first").alias(f"{end}_first"), F.col("apart").alias(f"{end}_apart"))),
            f"{end}_first",
            "left",
        )
    kept = lambda end: F.col(f"{end}_first").isNotNull() & F.col(f"{end}_apart").isNull()
    sure = sure.filter(kept("a") | kept("b"))
    for end in ("a", "b"):
        spread = parts.select(F.col("first").alias(f"{end}_first"), F.col("part").alias(f"{end}_part"))
        sure = sure.join(merged(spread), f"{end}_first", "left")
    ends = sure.select(F.coalesce("a_part", "a").alias("x"), F.coalesce("b_part", "b").alias("y"))
    family_links = ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return similar_pairs(alone, threshold).select("a", "b").unionByName(family_links), placed


def _both_ways(pairs: DataFrame) -> DataFrame:
    """(node, near) of (a, b)."""
    way = lambda node, near: F.struct(F.col(node).alias("node"), F.col(near).alias("near"))
    return pairs.select(F.inline(F.array(way("a", "b"), way("b", "a"))))


def _open_candidates(open_pairs: DataFrame, told: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """(a, b) with a < b, without repeats: a superset of the similar pairs of a member of either unit of (a, b).

    Where a unit has few members, all its pairs are taken: they are fewer than the pieces that the other
    unit's members would be cut into. Other pairs of units are parts of their own, compared by pieces.
    """
    size = lambda end: sizes.select(F.col("unit").alias(end), F.col("size").alias(f"{end}_size"))
    sized = open_pairs.join(merged(size("a")), "a").join(merged(size("b")), "b")
    few = F.least("a_size", "b_size") <= FEW_MEMBERS
    sized = cut_lineage(sized.select("a", "b", few.alias("few"), F.xxhash64("a", "b").alias("part")))
    members = told.select("node", "snippet", F.coalesce("first", "node").alias("unit"))

    of = lambda end: members.select(F.col("unit").alias(end), F.col("node").alias(f"{end}_node"))
    direct = sized.filter("few").join(merged(of("a")), "a").join(merged(of("b")), "b")
    direct = direct.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))

    ends = sized.filter(~F.col("few")).select("part", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("unit")),
                                                                        F.struct(F.lit(1).alias("side"), F.col("b").alias("unit")))).alias("e"))
    parted = cut_lineage(ends.select("part", "e.side", "e.unit").join(merged(members), "unit").drop("unit"))
    left, right = parted.filter("side = 0").drop("side"), parted.filter("side = 1").drop("side")
    pieced = candidate_pairs(left, right, threshold).unionByName(candidate_pairs(right, left, threshold)).distinct()
    return direct.unionByName(pieced)


def similar_links(nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, n_similar, first_similar): for each snippet how many others are similar, and the first earlier one.

    One row per snippet, however many pairs there are. A family that a neighbour is surely similar to
    counts with its size and its first member; where the bounds leave it open, the members are compared
    with that neighbour only. Members of one family are not compared at all.
    """
    told = cut_lineage(_number_families(nodes, threshold))
    judged = _judged_units(told, threshold)
    sizes = told.groupBy(F.coalesce("first", "node").alias("unit")).agg(F.count(F.lit(1)).alias("size"))

    # What holds for all members of a unit: their own family, and units that are surely similar.
    near = _both_ways(judged.filter("sure")).withColumnRenamed("near", "unit").join(merged(sizes), "unit")
    beside = near.groupBy(F.col("node").alias("unit")).agg(F.sum("size").alias("beside"), F.min("unit").alias("first_beside"))
    whole = sizes.join(merged(beside), "unit", "left").select(
        "unit", (F.col("size") - 1 + F.coalesce("beside", F.lit(0))).alias("sure"), "first_beside"
    )

    across = _open_candidates(judged.filter(~F.col("sure")).select("a", "b"), told, sizes, threshold)
    singles = told.filter("first is null").select("node", "snippet")
    open_found = measured_pairs(across, nodes, threshold)
    open_found = open_found.filter(decay_similarity(F.col("distance"), F.col("longer")) > threshold)
    pairs = similar_pairs(singles, threshold).select("a", "b").unionByName(open_found.select("a", "b"))
    single = _both_ways(pairs).groupBy("node").agg(F.count(F.lit(1)).alias("found"), F.min("near").alias("first_found"))

    # The first of each kind; one that is not earlier has no earlier one behind it.
    earlier = lambda c: F.when(F.col(c) < F.col("node"), F.col(c))
    placed = told.select("node", "first", F.coalesce("first", "node").alias("unit"))
    return (
        placed.join(merged(whole), "unit")
        .join(merged(single), "node", "left")
        .select(
            "node",
            (F.col("sure") + F.coalesce("found", F.lit(0))).alias("n_similar"),
            F.least(earlier("first"), earlier("first_beside"), earlier("first_found")).alias("first_similar"),
        )
    )


def snippet_groups(
    nodes: DataFrame, threshold: float
) -> DataFrame:
    """(node, snippet, seed): each snippet joins the earliest group similar throughout.

    Members of a family that acts as one unit see the same neighbours and each other, so they all
    end in the group of the first one, and only that one is compared.
    """
    families = Observation()
    told = _number_families(nodes, threshold).observe(families, F.count("first").alias("n"))
    told = cut_lineage(told)
    if not families.get.get("n"):
        edges = similar_pairs(nodes, threshold).select("a", "b")
        placed = nodes.select("node", F.col("node").alias("unit"))
    else:
        edges, placed = _family_edges(told, threshold)
    linked = complete_linkage(edges).withColumnRenamed("node", "unit")
    seeds = placed.join(merged(linked), "unit", "left").select("node", F.coalesce("seed", "unit").alias("seed"))
    return nodes.join(merged(seeds), "node").select("node", "snippet", "seed")


def _half(digits_from: int):
    part = F.substring(F.md5("issue_id"), digits_from, 15)
    return F.bit_xor(F.conv(part, 16, 10).cast("long"))


def group_members(
    issues: DataFrame, threshold: float
) -> DataFrame:
    """(group_id, issue_id) of all groups of two or more issues.

    Two issues with equal snippets are always in one group, so groups are found over distinct
    snippets. The group id depends on the set of members alone and is combined before the shuffle,
    so a group may hold any share of the issues.
    """
    groups = snippet_groups(distinct_snippets(issues), threshold)
    placed = issues.select("issue_id", "snippet").join(merged(groups.select("snippet", "seed")), "snippet")
    placed = cut_lineage(placed.select("seed", "issue_id"))
    identity = F.concat_ws("-", F.col("n"), F.col("h1"), F.col("h2"))
    names = (
        placed.groupBy("seed")
        .agg(F.count(F.lit(1)).alias("n"), _half(1).alias("h1"), _half(17).alias("h2"))
        .filter(F.col("n") > 1)
        .select("seed", F.md5(identity).alias("group_id"))
    )
    return placed.join(merged(names), "seed").select("group_id", "issue_id")


def _placed_issues(members: DataFrame, issues: DataFrame, latest_runs: DataFrame) -> DataFrame:
    """Members with their issue and whether its run belongs to a latest build.

    The runs are joined first: the rows then end up spread by issue, so that a run or group with
    most of the issues is combined before the next shuffle.
    """
    latest = latest_runs.select("run_id", F.lit(True).alias("is_live"))
    flagged = issues.select("issue_id", "run_id", "tag_id", "snippet").join(merged(latest), "run_id", "left")
    return members.join(merged(flagged), "issue_id")


def group_runs(members: DataFrame, issues: DataFrame, latest_runs: DataFrame) -> DataFrame:
    """(group_id, run_id): the related runs of the groups with an issue in a latest build."""
    placed = _placed_issues(members, issues, latest_runs)
    pairs = placed.groupBy("group_id", "run_id").agg(F.max("is_live").alias("is_live"))
    live = pairs.filter("is_live").select("group_id").distinct()
    return pairs.select("group_id", "run_id").join(merged(live), "group_id", "left_semi")


def group_summary(
    members: DataFrame, issues: DataFrame, latest_runs: DataFrame, tags: DataFrame
) -> DataFrame:
    """Tag, example and number of runs of the groups in a latest build that span several runs.

    One aggregate per group, combined before the shuffle, so a group may hold any share of the issues.
    """
    return (
        _placed_issues(members, issues, latest_runs)
        .groupBy("group_id")
        .agg(
            F.min_by("tag_id", "issue_id").alias("tag_id"),
            F.min_by("snippet", "issue_id").alias("example"),
            F.countDistinct("run_id").alias("n_runs"),
            F.max("is_live").alias("is_live"),
        )
        .filter(F.col("is_live") & (F.col("n_runs") > 1))
        .join(tags.select("tag_id", "name", "severity"), "tag_id")
        .select("group_id", "name", "severity", "example", "n_runs")
        .orderBy(F.desc("n_runs"), "group_id")
    )


def groups_by_severity(summary: DataFrame) -> DataFrame:
    """Number of groups per severity, most severe first."""
    return (
        summary.groupBy("severity")
        .agg(F.count(F.lit(1)).alias("n_groups"))
        .orderBy(severity_rank(F.col("severity")).desc())
    )
