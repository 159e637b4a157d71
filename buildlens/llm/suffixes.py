"""Exact removal of repeated byte strings with suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.bytesops import BASE, mixed, pieces, utf8
from buildlens.session import in_buckets, scratch_path

GRAM = 32
CHUNK = 1 << 21
STEP = 1 << 17
MERGED = 1 << 19
SHARD = 1 << 22
HOT = 4096


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` bytes, by doubling."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    part, width, factor = data.astype(np.uint64) + np.uint64(1), 1, BASE
    total = np.zeros(n, np.uint64)
    done = 0
    with np.errstate(over="ignore"):
        while True:
            if size & width:
                total = total * factor + part[done : done + n]
                done += width
            if width * 2 > size:
                return mixed(total)
            part = part[:-width] * factor + part[width:]
            factor, width = factor * factor, width * 2


def anchors(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, anchor, hash): runs of windows with the same anchor.

    The anchor of a window of ``size`` bytes is the place of its smallest gram hash, the first of
    equals. It depends on the window's bytes alone, so equal windows have equal anchors.
    """
    h = rolling(data, GRAM)
    n = len(data) - size + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty, empty, np.zeros(0, np.uint64)
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    low = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    width, most = 1, size - GRAM + 1
    while width * 2 <= most:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < most:
        low = np.minimum(low[: n], low[most - width :][:n])
    place = (low[:n] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    lengths = np.diff(offsets)
    text = np.repeat(np.arange(len(lengths)), lengths)[:n]
    valid = np.arange(n) + size <= offsets[1:][text]
    starts = np.flatnonzero(valid)
    if not len(starts):
        return empty, empty, empty, empty, np.zeros(0, np.uint64)
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(starts) != 1) | (np.diff(place[starts]) != 0) | (np.diff(text[starts]) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    lo, hi = starts[first], starts[last]
    return text[lo], lo, hi, place[lo], h[place[lo]]


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, rank of each) by Larsson-Sadakane refinement.

    Suffixes start out sorted by eight bytes; a round sorts only the groups that are still tied,
    by the rank of the suffix that far ahead, and doubles the distance.
    """
    n = len(data)
    keys = first_bytes(data)
    order = np.argsort(keys)
    sorted_keys = keys[order]
    # Shorter than eight bytes: the zero padding could tie with real zero bytes.
    short = np.isin(sorted_keys, keys[-7:])
    spots = np.flatnonzero(short)
    order[spots] = order[spots][np.lexsort((np.minimum(n - order[spots], 8), sorted_keys[spots]))]
    tail = np.minimum(n - order, 8)
    new = np.ones(n, bool)
    new[1:] = (sorted_keys[1:] != sorted_keys[:-1]) | (short[1:] & (tail[1:] != tail[:-1]))
    rank = np.empty(n, np.int64)
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = group
    ahead = 8
    while True:
        single = new & np.append(new[1:], True)
        spots = np.flatnonzero(~single)
        if not len(spots):
            return order, rank
        suffix = order[spots]
        far = suffix + ahead
        second = np.where(far < n, rank[np.minimum(far, n - 1)], -1)
        # Group and rank ahead in one number: a single sort orders every group.
        pair = group[spots] * (n + 1) + second + 1
        by = np.argsort(pair)
        order[spots] = suffix[by]
        pair = pair[by]
        fresh = np.ones(len(spots), bool)
        fresh[1:] = pair[1:] != pair[:-1]
        new[spots] = fresh
        group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order[spots]] = group[spots]
        ahead *= 2


def first_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place as a number, zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    n = len(data)
    out = padded[:n].copy()
    for j in range(1, 8):
        out = (out << np.uint64(8)) | padded[j : j + n]
    return out


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, by place in the text.

    Kasai's observation in its vector form: where the bytes before a suffix and before its
    predecessor agree, the length is that of the place before less one; only the other places
    are measured, eight bytes at a time.
    """
    n = len(data)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    follows = np.zeros(n, bool)
    ok = np.flatnonzero((before > 0) & (place > 0))
    follows[ok] = data[ok - 1] == data[before[ok] - 1]
    measured = np.flatnonzero(~follows & (before >= 0))
    keys = first_bytes(data)
    length = np.zeros(n, np.int64)
    a, b, at = measured.copy(), before[measured], measured
    room = n - np.maximum(a, b)
    done = np.zeros(len(at), np.int64)
    while len(at):
        inside = done < room
        x = keys[np.minimum(a + done, n - 1)] ^ keys[np.minimum(b + done, n - 1)]
        same = inside & (x == 0)
        stop = ~same
        # Leading equal bytes of the differing word.
        xs, more = x[stop], np.zeros(int(stop.sum()), np.int64)
        for j in range(8):
            more += xs >> np.uint64(8 * j) == 0
        length[at[stop]] = np.where(inside[stop], np.minimum(done[stop] + more, room[stop]), room[stop])
        a, b, at, room, done = a[same], b[same], at[same], room[same], done[same] + 8
    start = np.maximum.accumulate(np.where(follows, 0, place))
    return np.maximum(length[start] - (place - start), 0)


def repeated(data: np.ndarray, valid: np.ndarray, size: int) -> np.ndarray:
    """Class of every valid window start; starts with equal windows of ``size`` bytes share one."""
    order, _ = suffix_array(data)
    prefix = common_prefixes(data, order)
    fresh = prefix[order] < size
    out = np.empty(len(data), np.int64)
    out[order] = np.cumsum(fresh)
    return out[valid]


def _runs(starts: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start, end) of the bytes that sorted windows cover, joined where they touch."""
    if not len(starts):
        return owner, starts, starts
    new = np.ones(len(starts), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (starts[1:] > starts[:-1] + size)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return owner[first], starts[first], starts[last] + size


def _expand(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ... n numbers each, one after the other."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _anchored(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    """(rows, hash, row, spot) of the windows in slices of the batches; a spot packs start, number and offset of the gram."""
    for batch in pieces(batches, "text", CHUNK):
        data, offsets = utf8(batch.column("text"))
        found = []
        # Cuts that the processor's caches hold; each window lies in one of them.
        for lo in range(0, max(1, len(data) - size + 1), STEP):
            hi = min(len(data), lo + STEP + size - 1)
            cut = np.clip(offsets, lo, hi) - lo
            text, first, last, place, h = anchors(data[lo:hi], cut, size)
            shift = lo - offsets[text]
            found.append((h, text, ((first + shift) << 14) | ((last - first) << 7) | (place - first)))
        yield batch, *map(np.concatenate, zip(*found))


SPOTS = "h long, doc_id long, rk long, spot long"


def _spot_rows(size: int):
    """Spots of grams, to be told apart by other slices of the texts.

    A gram that occurs twice in a slice is known to repeat: its spots need no more looking up (h is null),
    one row without a spot tells the other slices. So a frequent gram has a row a slice, not one a text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, h, text, spot in _anchored(batches, size):
            value, which, n = np.unique(h, return_inverse=True, return_counts=True)
            known = n[which] > 1
            told = value[n > 1]
            none = np.ones(len(told), bool)
            mask = np.append(np.zeros(len(h), bool), none)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(h, told).view(np.int64), mask=np.append(known, ~none)),
                    pa.array(np.append(batch.column("doc_id").to_numpy()[text], np.zeros(len(told), np.int64)), mask=mask),
                    pa.array(np.append(batch.column("rk").to_numpy()[text], np.zeros(len(told), np.int64)), mask=mask),
                    pa.array(np.append(spot, np.zeros(len(told), np.int64)), mask=mask),
                ],
                ["h", "doc_id", "rk", "spot"],
            )

    return run


def _repeating(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by h, the spots whose h is null or also that of a neighbour."""
    held: pa.RecordBatch | None = None
    before: int | None = None

    def settled(rows: pa.RecordBatch, after: int | None) -> pa.RecordBatch:
        h = rows.column("h")
        sure = h.is_null().to_numpy(zero_copy_only=False)
        value = h.fill_null(0).to_numpy(zero_copy_only=False)
        near = np.zeros(len(value) + 1, bool)
        near[1:-1] = (value[1:] == value[:-1]) & ~sure[1:] & ~sure[:-1]
        near[0] = before is not None and not sure[0] and value[0] == before
        near[-1] = after is not None and not sure[-1] and value[-1] == after
        wanted = (sure | near[1:] | near[:-1]) & rows.column("spot").is_valid().to_numpy(zero_copy_only=False)
        return rows.select(["doc_id", "rk", "spot"]).filter(pa.array(wanted))

    for batch in batches:
        if not len(batch):
            continue
        if held is not None:
            yield settled(held, batch.column("h")[0].as_py())
            before = held.column("h")[-1].as_py()
        held = batch
    if held is not None:
        yield settled(held, None)


ROWS = "kind int, doc_id long, rk long, start long, stop long, off int, ctx binary"


def _rows(kind, doc_id, rk, start, stop, off=None, ctx=None) -> pa.RecordBatch:
    n = len(start)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, kind), pa.int32()),
            pa.array(doc_id, pa.int64()),
            pa.array(rk, pa.int64()),
            pa.array(start, pa.int64()),
            pa.array(stop, pa.int64()),
            pa.nulls(n, pa.int32()) if off is None else pa.array(off, pa.int32()),
            pa.nulls(n, pa.binary()) if ctx is None else ctx,
        ],
        [c.split()[0] for c in ROWS.split(", ")],
    )


def _shard_rows(size: int):
    """Repeats inside a shard (kind 0), and what other shards must still be asked for (kind 1)."""

    def shard(doc_id, rk, data, offsets, spots, counts) -> Iterator[pa.RecordBatch]:
        text = np.repeat(np.arange(len(counts)), counts)
        lo = (spots >> 14) + offsets[text]
        n = ((spots >> 7) & 127) + 1
        off = spots & 127
        by = np.lexsort((lo, rk[text], doc_id[text]))
        text, lo, n, off = text[by], lo[by], n[by], off[by]
        # Maximal regions of bytes under candidate windows, side by side in one buffer.
        new = np.ones(len(lo), bool)
        new[1:] = (text[1:] != text[:-1]) | (lo[1:] > lo[:-1] + n[:-1])
        first = np.flatnonzero(new)
        end = (lo + n + size - 1)[np.append(first[1:], len(lo)) - 1]
        long = end - lo[first]
        region = np.cumsum(new) - 1
        base = np.cumsum(long) - long
        buffer = data[_expand(lo[first], long)]
        windows = _expand(lo - lo[first][region] + base[region], n)
        owner = np.repeat(np.arange(len(lo)), n)
        classes = repeated(buffer, windows, size)
        # Windows come in the order of documents and places: the first of a class is the earliest.
        _, earliest, number = np.unique(classes, return_index=True, return_inverse=True)
        place = _expand(lo, n)
        inside = place - offsets[text[owner]]
        first_of = earliest[number]
        # Repeated rows are one document: the same place of the same row is no repeat.
        mine, earlier = text[owner], text[owner[first_of]]
        again = (doc_id[mine] != doc_id[earlier]) | (rk[mine] != rk[earlier]) | (inside != inside[first_of])
        t, s, e = _runs(place[again], text[owner[again]], size)
        yield _rows(0, doc_id[t], rk[t], s - offsets[t], e - offsets[t])
        left = np.flatnonzero(~again)
        if len(left):
            own = owner[left]
            head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            tail = np.append(head[1:], len(own)) - 1
            own, a, b = own[head], place[left[head]], place[left[tail]] + size
            at = np.append(0, np.cumsum(b - a))
            ctx = pa.Array.from_buffers(
                pa.binary(), len(a), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data[_expand(a, b - a)])]
            )
            t = text[own]
            yield _rows(1, doc_id[t], rk[t], a - offsets[t], b - offsets[t], off[own] - (a - lo[own]), ctx)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SHARD):
            data, offsets = utf8(batch.column("text"))
            lists = batch.column("spots")
            counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            yield from shard(
                batch.column("doc_id").to_numpy(),
                batch.column("rk").to_numpy(),
                data,
                offsets,
                lists.flatten().to_numpy().astype(np.int64),
                counts,
            )

    return run


def _merge_rows(size: int):
    """Windows of all shards with the same anchor gram: all but the first of equals are repeats."""

    def merge(table: pa.Table) -> pa.RecordBatch:
        data, offsets = utf8(table.column("ctx"))
        doc_id, rk = table.column("doc_id").to_numpy(), table.column("rk").to_numpy()
        start = table.column("start").to_numpy()
        n = np.diff(offsets) - size + 1
        windows = _expand(offsets[:-1], n)
        owner = np.repeat(np.arange(len(n)), n)
        hashes = rolling(data, size)[windows]
        order = np.argsort(hashes)
        ranked = hashes[order]
        heads = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        earliest = np.minimum.reduceat(order, heads)
        # Binary search for the hash of each window finds the first one that has it; its bytes must agree.
        first = np.empty(len(order), np.int64)
        first[order] = earliest[np.searchsorted(ranked[heads], ranked)]
        rest = np.flatnonzero(first != np.arange(len(windows)))
        a, b = windows[rest], windows[first[rest]]
        same = np.ones(len(rest), bool)
        keys = first_bytes(data)
        for j in [*range(0, size - 8, 8), size - 8]:
            same &= keys[a + j] == keys[b + j]
        if not same.all():  # equal hashes of different bytes: told apart one by one
            seen: dict[bytes, int] = {}
            odd = set(hashes[rest[~same]].tolist())
            again = set(rest[same].tolist())
            for i in np.flatnonzero(np.isin(hashes, list(odd))).tolist():
                word = data[windows[i] : windows[i] + size].tobytes()
                (again.add if seen.setdefault(word, i) != i else again.discard)(i)
            rest = np.array(sorted(again), np.int64)
        inside = windows - offsets[owner] + start[owner]
        mine, earlier = owner[rest], owner[first[rest]]
        rest = rest[(inside[rest] != inside[first[rest]]) | (doc_id[mine] != doc_id[earlier]) | (rk[mine] != rk[earlier])]
        place = inside[rest]
        own, s, e = _runs(place, owner[rest], size)
        return _rows(0, doc_id[own], rk[own], s, e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        total = 0
        for batch in pieces(batches, "ctx", CHUNK):
            g = batch.column("g").to_numpy()
            if held and total >= MERGED:
                # Whole groups only: the rows of the last group may go on.
                cut = int(np.searchsorted(g != held[-1].column("g")[-1].as_py(), True)) if len(g) else 0
                if cut < len(g):
                    yield merge(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                    held, total, batch = [], 0, batch.slice(cut)
            held.append(batch)
            total += batch.column("ctx").nbytes
        if held:
            yield merge(pa.Table.from_batches(held))

    return run


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROW_KEY = ["doc_id", "rk"]


def repeated_spans(docs: DataFrame, size: int = 100, most: int = HOT) -> DataFrame:
    """(doc_id, rk, spans): byte spans to remove from the texts of ``docs`` (doc_id, rk, text), one row each.

    1. Every window of ``size`` bytes has an anchor gram that its bytes alone decide. Windows whose
       gram occurs once in the corpus can't be repeated; runs of the others are candidates.
    2. Candidate regions meet their text. In each shard of documents a suffix array
       (Larsson-Sadakane) and common prefixes (Kasai) find the classes of equal windows; all but the
       earliest are repeats. A passage of many documents leaves a shard once.
    3. The windows left are dealt by their gram and shards are merged: sorted, each window finds the
       first equal one by binary search. Grams in more than ``most`` different surroundings are
       dealt window by window instead, by the whole window: no gram is gathered in one task.
    """
    rows = docs.select(*ROW_KEY, "text").mapInArrow(_spot_rows(size), SPOTS)
    dealt = rows.repartition(F.coalesce("h", "rk")).sortWithinPartitions(F.col("h").asc_nulls_first())
    often = dealt.mapInArrow(_repeating, "doc_id long, rk long, spot long")
    spots = often.groupBy(*ROW_KEY).agg(F.collect_list("spot").alias("spots"))
    shards = docs.join(spots, ROW_KEY).select("doc_id", "rk", "text", "spots")
    found = _written(shards.mapInArrow(_shard_rows(size), ROWS), "shards")

    grams = found.filter("kind = 1").withColumn(
        "g", F.xxhash64(F.substr("ctx", F.col("off") + 1, F.lit(GRAM)))
    )
    hot = grams.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("g", F.lit(True).alias("hot"))
    known = grams.join(hot, "g", "left")
    names = ["g", "doc_id", "rk", "start", "ctx"]
    windows = known.filter("hot").select(
        "doc_id",
        "rk",
        "start",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(1), F.octet_length("ctx") - size + 1),
                lambda i: F.substr("ctx", i, F.lit(size)),
            )
        ).alias("i", "ctx"),
    )
    singles = windows.groupBy("ctx").agg(
        F.min(F.struct("doc_id", "rk", F.col("start") + F.col("i"))).alias("first")
    )
    late = windows.join(singles, "ctx").filter(
        F.struct("doc_id", "rk", F.col("start") + F.col("i")) > F.col("first")
    ).select(*ROW_KEY, (F.col("start") + F.col("i")).alias("start"), (F.col("start") + F.col("i") + size).alias("stop"))
    dealt = known.filter("hot is null").select(*names).repartition("g").sortWithinPartitions(
        "g", "doc_id", "rk", "start"
    )
    merged = dealt.mapInArrow(_merge_rows(size), ROWS)
    spans = (
        found.filter("kind = 0").select(*ROW_KEY, "start", "stop")
        .unionByName(merged.select(*ROW_KEY, "start", "stop"))
        .unionByName(late)
    )
    return spans.groupBy(*ROW_KEY).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def remove_repeats(docs: DataFrame, size: int = 100) -> DataFrame:
    """(doc_id, kept: binary, n_bytes, n_removed, n_spans) for every row of ``docs`` (doc_id, text).

    A byte goes when a string of ``size`` bytes that covers it also starts earlier: in a smaller
    doc_id, or before in the same document. Strings are judged on the input and never cross
    documents; ``kept`` may cut a character. Null texts are empty. Exact copies of an earlier text
    are settled by a hash of the text (md5). A null doc_id comes first; repeated rows (id and text)
    are one document and give the same row each; different texts of one id are documents in the
    order of a hash. Other columns aren't read. An empty table gives an empty result.
    """
    texts = docs.select(
        F.col("doc_id").alias("id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("rk", F.xxhash64("doc_id", "text"))
    ids = texts.filter(F.octet_length("text") >= size).select(*ROW_KEY, F.md5("text").alias("same"))
    least = (
        ids.groupBy("same")
        .agg(F.min(F.struct(*ROW_KEY)).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("same", "first")
    )
    copies = ids.join(least, "same").filter(F.struct(*ROW_KEY) != F.col("first")).select(*ROW_KEY).distinct()
    # Copies have nothing to add: what they hold is in the first.
    marked = _written(copies.withColumn("copy", F.lit(True)), "copies")
    placed = in_buckets(texts, *ROW_KEY)
    spans = repeated_spans(placed.select(*ROW_KEY, "text").join(marked, ROW_KEY, "left_anti"), size)

    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SHARD):
            data, offsets = utf8(batch.column("text"))
            copy = batch.column("copy").to_pylist()
            out: list[tuple] = []
            for i, spans_of in enumerate(batch.column("spans")):
                mine = data[offsets[i] : offsets[i + 1]]
                gone = np.zeros(len(mine), bool)
                if copy[i]:
                    gone[:] = True
                elif spans_of.is_valid:
                    pairs = spans_of.values.flatten()
                    change = np.zeros(len(mine) + 1, np.int64)
                    np.add.at(change, pairs[0].to_numpy(), 1)
                    np.add.at(change, pairs[1].to_numpy(), -1)
                    gone = np.cumsum(change[:-1]) > 0
                edges = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((mine[~gone].tobytes(), len(mine), int(gone.sum()), edges))
            kept, n, removed, runs = zip(*out) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(kept, pa.binary())] + [pa.array(x, pa.int64()) for x in (n, removed, runs)],
                ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    marks = marked.join(spans, ROW_KEY, "full")
    joined = placed.join(marks, ROW_KEY, "left").select(F.col("id").alias("doc_id"), "text", "copy", "spans")
    return joined.mapInArrow(run, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long")
