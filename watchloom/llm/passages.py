"""Near-duplicate passages by compact windows of token min-hashes.

1. Tokens are five-word shingles (A-Z lower-cased), so a text of ``n`` words has ``n - 4``. For each of ``HASHES``
   hash functions, a token that is the smallest of a stretch has one compact window ``(l, c, r)``: every
   subsequence with ``l <= start <= c <= end <= r`` has the token at ``c`` as its min-hash. These windows are
   the nodes of the Cartesian tree over the values. Only windows of ``LEAST`` tokens or more are built; their
   ancestors in the tree are as long, so the tree over them alone is the same.
2. Windows with one min-hash in different texts collide. Which min-hashes occur in several texts is found by
   sending each shard's distinct ones to buckets of the hash range and getting the shared ones back. A text's
   windows are first compared with those of two picked texts of their group, so a group costs links, not pairs.
3. For two texts, an interval join pairs collisions of different hash functions whose windows overlap in both
   texts and leave room for ``LEAST`` tokens: subsequences there agree in at least two min-hashes.
4. Every such place is verified: the tokens around it are compared, and the longest stretch of matching
   tokens, with wide or else narrower gaps, must have ``LEAST`` tokens and a Jaccard similarity of 0.75.
   A task compares the regions of many pairs at once. Texts are read again for them only if a bitmap of asked nodes has theirs.
5. Groups whose texts are then in several components, or have pivots outside the passages found, are compared
   whole, by the min-hashes of two functions at once. Groups with one smallest region share a home; a task gets the
   regions of a home once (of a large one, two blocks) and compares the pairs in memory, so what is written and
   moved grows with the regions, not with their pairs. A task tells the spans of its texts in passages, and links
   that join the texts it found alike; :func:`find_passages` lists the pairs instead.

Equal texts (by their words) are one node; their copies share its passages, and a text with copies is a
passage as a whole if it is long enough.

Defined cases: null texts and texts under ``LEAST + 4`` words have no passages. Rows that share an id and
words are one document; null ids count as one id. Rows get the result of their text, so repeated rows get
equal results. Repeats inside one text are not reported. Hashes have 64 bits, of which verification compares 32.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm import kernel
from watchloom.llm.common import order_id, quoted, shown_id
from watchloom.llm.components import connected_components
from watchloom.llm.kernel import numbers, planes
from watchloom.session import discard, materialize

WIDTH, LEAST, HASHES = 5, 46, 4
GAPS = (12, 4, 0)  # unmatched tokens inside a stretch: first wide, then strict
SLICE, BUCKET, SPREAD = 2 << 20, 32 << 20, 4 << 20
BLOCK = 2048  # regions of a home on either side that are compared in one task
BUCKET_REGIONS = 1 << 13  # regions of small homes that lie in one bucket
STEP = 1 << 19  # pairs of windows, or tokens of regions, that are compared at once
AREA = 1 << 23  # places of pairs of regions that are marked at once
BITS = 12  # of a token, by which two regions are compared before their tokens are
FLAGS = 23  # bits of a text's hash by which texts without a place are left out early
_POS = np.uint64((1 << 28) - 1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = kernel.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * _GOLD)
_SENT = "key long, shard long, a binary, b binary, c binary, d binary, e binary, f binary"
_BACK = "shard long, bucket int, a binary, b binary, c binary, d binary, e binary, f binary"
_SHARED = "hash long, fn int, node long, l int, c int, r int, low boolean, high boolean"
_PLACE = "u long, v long, at_u int, at_v int, grid_u int, grid_v int"
_PASSAGE = "u long, v long, u_low int, u_high int, v_low int, v_high int"
_PLACED = f"{_PASSAGE}, grid_u int, grid_v int"
_FACT = "node long, low int, high int, link long"


def nodes_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of all rows with the number of shingles before each row; the rows' word counts and text hashes."""
    data, offsets = kernel.texts(column)
    starts, ends, counts = kernel.words(data, offsets)
    hashes = kernel.word_hashes(data, starts, ends, lower=True)
    sizes = np.diff(counts)
    place = (np.arange(len(hashes)) - np.repeat(counts[:-1], sizes)).astype(np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(kernel.mix(hashes + place * _GOLD), dtype=np.uint64)])
    marks = kernel.mix(total[counts[1:]] - total[counts[:-1]] + sizes.astype(np.uint64))
    tokens, _ = kernel.windows(hashes, counts, WIDTH)
    before = np.concatenate([[0], np.cumsum(np.maximum(sizes - WIDTH + 1, 0))])
    return tokens, before, sizes, marks


def compact_windows(values: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``l``, ``c`` and ``r`` (positions over all rows) of the windows of ``LEAST`` tokens or more."""
    n = len(values)
    none = np.zeros(0, np.int64)
    if n < LEAST:
        return none, none, none
    keys = np.full(-(-n // LEAST) * LEAST, ~np.uint64(0))
    keys[:n] = (values & ~_POS) | (np.arange(n, dtype=np.uint64) & _POS)
    blocks = keys.reshape(-1, LEAST)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(suffix[: n - LEAST + 1], prefix[LEAST - 1 : n])
    rows = np.repeat(np.arange(len(before) - 1), np.diff(before))
    inside = rows[: n - LEAST + 1] == rows[LEAST - 1 :]
    won = np.zeros(n, bool)
    won[(low[inside] & _POS).astype(np.int64)] = True
    pivots = np.flatnonzero(won)
    order, row = (values[pivots] & ~_POS).tolist(), rows[pivots].tolist()
    first, last = before[:-1][rows[pivots]], before[1:][rows[pivots]] - 1
    left, right, stack, spot = first.copy(), last.copy(), [], pivots.tolist()
    for i, v in enumerate(order):
        if stack and row[stack[-1]] != row[i]:
            stack.clear()
        while stack and order[stack[-1]] > v:
            right[stack.pop()] = spot[i] - 1
        if stack:
            left[i] = spot[stack[-1]] + 1
        stack.append(i)
    # Of equal values close to each other in a row (a repeated word) the first stands for all.
    same = (np.diff(values[pivots], prepend=~values[pivots[:1]]) == 0) & (np.diff(rows[pivots], prepend=-1) == 0)
    keep = ~(same & (np.diff(pivots, prepend=0) < LEAST // 2))
    return left[keep], pivots[keep], right[keep]


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in text.split(", "))])


def _sent(bits: int):
    def run(batches):
        for whole in batches:
            for batch in kernel.slices(whole, "text", SLICE):
                tokens, before, _, marks = nodes_of(batch.column("text"))
                first = np.zeros(len(marks), bool)
                first[np.unique(marks, return_index=True)[1]] = True
                rows = np.repeat(np.arange(len(marks)), np.diff(before))
                found = []
                for seed in _SEEDS:
                    values = kernel.mix(tokens ^ seed)
                    left, pivot, right = compact_windows(values, before)
                    own = first[rows[pivot]] if len(pivot) else np.zeros(0, bool)
                    found.append((values[pivot[own]], rows[pivot[own]], left[own], pivot[own], right[own], np.full(int(own.sum()), len(found), np.uint8)))
                hashes, row, left, pivot, right, fn = (np.concatenate(x) for x in zip(*found, strict=True))
                if not len(hashes):
                    continue
                order = np.lexsort((row, hashes))
                hashes, row, left, pivot, right, fn = (x[order] for x in (hashes, row, left, pivot, right, fn))
                start = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
                known, times = hashes[start], np.diff(np.append(start, len(hashes))).astype(np.uint32)
                several = (np.maximum.reduceat(row, start) != np.minimum.reduceat(row, start)).astype(np.uint8)
                shard = int(np.bitwise_xor.reduce(kernel.mix(marks + np.arange(len(marks), dtype=np.uint64)))) >> 1
                base, place = before[row], lambda x: planes(x.astype(np.uint32))
                begin = start.astype(np.uint32)
                out = [(-1 - shard, shard, planes(marks), place(row), place(left - base), place(pivot - left), place(right - pivot), fn.tobytes())]
                cuts = [*np.searchsorted(known, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist(), len(known)]
                for bucket, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if i < j:
                        out.append((bucket, shard, planes(known[i:j]), planes(times[i:j]), several[i:j].tobytes(), planes(begin[i:j]), b"", b""))
                yield pa.RecordBatch.from_pylist([dict(zip(("key", "shard", *"abcdef"), r, strict=True)) for r in out], _schema(_SENT))

    return run


def _answered(group: pa.Table) -> pa.Table:
    """Tells each shard which of its min-hashes another text has, and whether it is the picked shard for them."""
    rows = group.to_pylist()
    if rows[0]["key"] < 0:
        return pa.Table.from_pylist([{"shard": r["shard"], "bucket": -1, **{x: r[x] for x in "abcdef"}} for r in rows], _schema(_BACK))
    known = [numbers(r["a"], np.uint64) for r in rows]
    sizes = [len(h) for h in known]
    keys, back = np.unique(np.concatenate(known), return_inverse=True)
    shards = np.repeat(np.array([r["shard"] for r in rows], np.int64), sizes)
    several = np.concatenate([np.frombuffer(r["c"], np.uint8) for r in rows])
    shared = (np.bincount(back) + np.bincount(back, several))[back] > 1
    low, high = np.full(len(keys), 2**63 - 1), np.full(len(keys), -1)
    np.minimum.at(low, back, shards)
    np.maximum.at(high, back, shards)
    flags = (shared + 2 * (low[back] == shards) + 4 * (high[back] == shards)).astype(np.uint8)
    out = []
    for r, h, f in zip(rows, known, np.split(flags, np.cumsum(sizes)[:-1]), strict=True):
        keep = f & 1 == 1
        if keep.any():
            times, begin = numbers(r["b"], np.uint32)[keep], numbers(r["d"], np.uint32)[keep]
            out.append({"shard": r["shard"], "bucket": r["key"], "a": planes(h[keep]), "b": planes(times), "c": f[keep].tobytes(), "d": planes(begin), "e": b"", "f": b""})
    return pa.Table.from_pylist(out, _schema(_BACK))


def _shared(group: pa.Table) -> pa.Table:
    """A shard's windows whose min-hash another text has."""
    rows = group.to_pylist()
    own = next(r for r in rows if r["bucket"] < 0)
    marks = numbers(own["a"], np.uint64)
    row, left, to_pivot, to_right = (numbers(own[x], np.uint32).astype(np.int64) for x in "bcde")
    fn = np.frombuffer(own["f"], np.uint8)
    # Shards of equal texts have one id and get equal answers, of which one counts.
    parts = sorted({r["bucket"]: r for r in rows if r["bucket"] >= 0}.values(), key=lambda r: r["bucket"])
    if not parts:
        return pa.Table.from_batches([], _schema(_SHARED))
    known = np.concatenate([numbers(r["a"], np.uint64) for r in parts])
    times, begin = (np.concatenate([numbers(r[x], np.uint32) for r in parts]).astype(np.int64) for x in "bd")
    flags = np.concatenate([np.frombuffer(r["c"], np.uint8) for r in parts])
    index = np.repeat(begin - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    hashes, flag = np.repeat(known, times), np.repeat(flags, times)
    pivot = left[index] + to_pivot[index]
    arrays = [hashes.view(np.int64), fn[index].astype(np.int32), marks[row[index]].view(np.int64), left[index].astype(np.int32), pivot.astype(np.int32), (pivot + to_right[index]).astype(np.int32), (flag & 2) > 0, (flag & 4) > 0]
    return pa.Table.from_arrays([pa.array(x) for x in arrays], schema=_schema(_SHARED))


def _collisions(shared: DataFrame) -> DataFrame:
    """Windows of two different texts with one min-hash; one of the two is a picked text of the group."""
    low = shared.filter("low").groupBy("hash").agg(F.min("node").alias("w")).select("hash", "w")
    high = shared.filter("high").groupBy("hash").agg(F.max("node").alias("w")).select("hash", "w")
    picked = low.union(high).distinct()
    first = shared.join(picked, (shared["hash"] == picked["hash"]) & (shared["node"] == picked["w"]), "left_semi")
    first = first.groupBy("hash", F.col("node").alias("w")).agg(F.min(F.struct("c", "l", "r")).alias("p"))
    both = shared.select("hash", "fn", "node", "l", "c", "r").join(first, "hash").filter("node != w")
    mine, theirs = F.struct("node", "l", "c", "r"), F.struct(F.col("w").alias("node"), F.col("p.l").alias("l"), F.col("p.c").alias("c"), F.col("p.r").alias("r"))
    swap = F.col("node") < F.col("w")
    both = both.select("fn", F.when(swap, mine).otherwise(theirs).alias("x"), F.when(swap, theirs).otherwise(mine).alias("y"))
    return both.select(F.col("x.node").alias("u"), F.col("y.node").alias("v"), "fn", *(F.col(f"{s}.{f}").alias(f"{s}{f}") for s in "xy" for f in "lcr"))


def _seeded(group: pa.Table) -> pa.Table:
    """Places of a bucket's text pairs; windows whose pivots lie in neighbouring cells of one text are compared."""
    names = ("u", "v", "fn", "xl", "xc", "xr", "yl", "yc", "yr")
    u, v, fn, xl, xc, xr, yl, yc, yr = (group.column(n).to_numpy().astype(np.int64) for n in names)
    order = np.lexsort((yc, v, u))
    u, v, fn, xl, xc, xr, yl, yc, yr = (x[order] for x in (u, v, fn, xl, xc, xr, yl, yc, yr))
    pair = np.cumsum(np.concatenate([[False], (u[1:] != u[:-1]) | (v[1:] != v[:-1])]))
    cell = pair * (int(yc.max()) // LEAST + 3) + yc // LEAST
    first, ends = np.searchsorted(cell, cell - 1), np.searchsorted(cell, cell + 1, "right")
    room = np.zeros(len(u), bool)
    for at, to in _parts(ends - first, STEP):
        sizes = ends[at:to] - first[at:to]
        i = np.repeat(np.arange(at, to), sizes)
        j = np.arange(len(i)) + np.repeat(first[at:to] - (np.cumsum(sizes) - sizes), sizes)
        differ = fn[i] != fn[j]
        i, j = i[differ], j[differ]
        for left, pivot, right in ((xl, xc, xr), (yl, yc, yr)):
            start, end = np.maximum(left[i], left[j]), np.minimum(right[i], right[j])
            fits = (start <= np.minimum(pivot[i], pivot[j])) & (np.maximum(pivot[i], pivot[j]) <= end) & (end - start + 1 >= LEAST)
            i, j = i[fits], j[fits]
        room[i] = True
    u, v, xc, yc = u[room], v[room], xc[room], yc[room]
    order = np.lexsort((xc, yc, yc // LEAST, xc // LEAST, v, u))
    keys = np.stack([x[order] for x in (u, v, xc // LEAST, yc // LEAST)])
    one = order[np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])] if len(order) else order
    found = (u[one], v[one], xc[one], yc[one], xc[one] // LEAST, yc[one] // LEAST)
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(found, _schema(_PLACE).types, strict=True)], schema=_schema(_PLACE))


def _parts(sizes: np.ndarray, most: int):
    """Ranges of elements whose sizes add up to about ``most``; a larger element is a range of its own."""
    total, at = np.concatenate([[0], np.cumsum(sizes)]), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        yield at, to
        at = to


def _seeds(collisions: DataFrame, buckets: int) -> DataFrame:
    """Places ``(u, v, at_u, at_v)`` where windows of two hash functions leave room for a common passage; one for
    each two texts and grid cells of both."""
    return collisions.groupBy(F.pmod(F.xxhash64("u", "v"), F.lit(buckets)).alias("bucket")).applyInArrow(lambda group: _seeded(group), _PLACE)


def _room(a: str, b: str, c: str, d: str):
    """Two windows of one text, of which the columns' names begin so, leave room for ``LEAST`` tokens with both pivots."""
    start, end = F.greatest(f"{a}l", f"{b}l"), F.least(f"{a}r", f"{b}r")
    return (start <= F.least(f"{c}c", f"{d}c")) & (F.greatest(f"{c}c", f"{d}c") <= end) & (end - start + 1 >= LEAST)


def _spots(shared: DataFrame, found: DataFrame) -> DataFrame:
    """The spots of groups of texts that the picked texts may leave open.

    Two windows of one text with different hash functions that leave room for a passage are a spot. Spots with
    the same two min-hashes are a group.
    """
    inside = F.exists("spans", lambda x: (x["low"] <= F.col("c")) & (F.col("c") + WIDTH <= x["high"]))
    texts = connected_components(found.select("u", "v")).join(_spans(_sides(found)), "node", "full")
    own = shared.select("hash", "fn", "node", "l", "c", "r").distinct().join(texts, "node", "left")
    marked = own.select("hash", "fn", "node", "l", "c", "r", F.coalesce("component", "node").alias("part"), (~F.coalesce(inside, F.lit(False))).alias("bare"))
    marked = materialize(marked, "marked-windows")
    # Only groups with something left go on: those of min-hashes first, then those of spots.
    open_ = materialize(marked.join(marked.groupBy("hash").agg(_open().alias("o")).filter("o").select("hash"), "hash", "left_semi"), "open-windows")
    discard(marked)
    grid = F.floor(F.col("c") / LEAST).cast("int")
    other = open_.select("node", F.explode(F.array(grid - 1, grid, grid + 1)).alias("grid"), *(F.col(x).alias(f"o_{x}") for x in ("hash", "fn", "l", "c", "r", "bare")))
    spots = open_.withColumn("grid", grid).join(other, ["node", "grid"]).filter((F.col("fn") < F.col("o_fn")) & _room("", "o_", "", "o_"))
    spots = spots.select("hash", "o_hash", "node", "part", F.least("c", "o_c").alias("at"), (F.col("bare") | F.col("o_bare")).alias("bare"), F.floor(F.col("c") / LEAST).alias("g"))
    # Spots of one text, cell and group lead to the same places.
    spots = spots.groupBy("hash", "o_hash", "node", "part", "g").agg(F.min("at").alias("at"), F.max("bare").alias("bare"))
    spots = materialize(spots.select("hash", "o_hash", "node", "part", F.floor(F.col("at") / LEAST).cast("int").alias("grid"), "bare"), "spots")
    discard(open_)
    return spots


def _open():
    """Whether a group has pairs left: where it lies in texts of one component and in verified passages only, it has none."""
    return (F.min("part") != F.max("part")) | (F.max("bare") & (F.min("node") != F.max("node")))


def _members(spots: DataFrame) -> DataFrame:
    """The regions of open groups, each once for a home, with the groups it belongs to (at most a region's pairs of windows).

    A group's home is its smallest region; groups around one passage mostly have the same.
    """
    groups = spots.groupBy("hash", "o_hash").agg(_open().alias("o"), F.min(F.struct("node", "grid")).alias("first")).filter("o")
    groups = groups.select("hash", "o_hash", F.xxhash64("first.node", "first.grid").alias("home"))
    entry = F.struct(F.xxhash64("hash", "o_hash").alias("group"), "bare")
    return spots.join(groups, ["hash", "o_hash"]).groupBy("home", "node", "grid").agg(F.first("part").alias("part"), F.collect_set(entry).alias("groups"))


def _compared_pairs(rows: DataFrame, spots: DataFrame, listed: bool) -> DataFrame:
    """Verifies all pairs of open groups that differ in component or have a spot outside the passages: what
    :func:`_compared` tells of them, or with ``listed`` their verified places.

    The regions of a home are dealt over blocks by their hash; every two blocks meet in one task.
    """
    members = materialize(_members(spots), "members")
    regions = _regions_of(rows, members.select("node", "grid").distinct())
    wide = members.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = members.join(regions, ["node", "grid"]).join(F.broadcast(wide), "home", "left")  # at most all regions / BLOCK homes
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node", "grid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("home", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("side"), "node", "grid", "part", F.col("groups.group").alias("groups"), F.col("groups.bare").alias("bare"), "tokens")
    buckets = max(64, members.count() // BUCKET_REGIONS)
    bucket = F.pmod(F.xxhash64("home", "low", "high"), F.lit(buckets)).alias("bucket")
    found = dealt.groupBy(bucket).applyInArrow(lambda group: _compared(group, listed), _PLACED if listed else _FACT)
    found = materialize(found.distinct(), "compared")
    discard(members)
    discard(regions)
    return found


def _candidates(home: np.ndarray, side: np.ndarray, alone: np.ndarray, node: np.ndarray, part: np.ndarray, spots: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """Pairs of regions that share a group, differ in text, and differ in component or have a bare spot in it; each once.

    Regions are sorted by home and side. A spot is its region, group and whether it is bare. Regions of one side are
    compared with those of the other; those of a home that is ``alone`` in its task with each other.
    """
    region, group, bare = spots
    order = np.lexsort((region, group, home[region]))
    region, group, bare = region[order], group[order], bare[order]
    new = np.concatenate([[True], (np.diff(group) != 0) | (np.diff(home[region]) != 0)])
    ends = np.append(np.flatnonzero(new)[1:], len(region))[np.cumsum(new) - 1]
    first_two = np.cumsum(np.concatenate([[0], side[region]]))  # spots of the second side so far; they end a group
    from_ = np.where(alone[region], np.arange(len(region)) + 1, ends - (first_two[ends] - first_two[np.arange(len(region))]))
    sizes = np.where(side[region] & ~alone[region], 0, ends - np.minimum(from_, ends))
    start = np.flatnonzero(np.concatenate([[True], np.diff(home) != 0]))
    count = np.diff(np.append(start, len(home)))
    width = count.astype(np.int64)
    spot_home = np.searchsorted(start, region, "right") - 1
    for at, to in _parts(width * width, AREA):
        base = np.concatenate([[0], np.cumsum(width[at:to] ** 2)])
        marks = np.zeros(int(base[-1]), bool)
        low, high = np.searchsorted(spot_home, [at, to])
        for i0, i1 in _parts(sizes[low:high], STEP):
            n = sizes[low + i0 : low + i1]
            i = np.repeat(np.arange(low + i0, low + i1), n)
            j = np.arange(len(i)) + np.repeat(from_[low + i0 : low + i1] - (np.cumsum(n) - n), n)
            x, y = region[i], region[j]
            keep = (bare[i] | bare[j] | (part[x] != part[y])) & (node[x] != node[y])
            x, y, h = x[keep], y[keep], spot_home[i[keep]]
            marks[base[h - at] + (x - start[h]) * width[h] + y - start[h]] = True
        spot = np.flatnonzero(marks)
        h = np.searchsorted(base, spot, "right") - 1
        inside = spot - base[h]
        yield start[at + h] + inside // width[at + h], start[at + h] + inside % width[at + h]


def _sketches(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each region a bitmap of its tokens, the number of distinct tokens that its bits hide, and of repeats."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    kept = _distinct(row.astype(np.uint64) << np.uint64(32) | tokens)
    at, bit = (kept >> np.uint64(32)).astype(np.int64), (kept & np.uint64(0xFFFFFFFF)).astype(np.int64) >> 32 - BITS
    maps = np.zeros(len(sizes) << BITS - 3, np.uint8)
    np.bitwise_or.at(maps, (at << BITS - 3) + (bit >> 3), np.left_shift(1, bit & 7).astype(np.uint8))
    maps = maps.view(np.uint64).reshape(len(sizes), -1)
    distinct = np.bincount(at, minlength=len(sizes))
    return maps, distinct - np.bitwise_count(maps).sum(axis=1, dtype=np.int64), sizes - distinct


def _likely(u: np.ndarray, v: np.ndarray, maps: np.ndarray, hidden: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    """Which pairs of regions may have a verified passage, by a bound that leaves out none.

    A passage has ``LEAST`` positions in both, so at least ``LEAST`` less the repeats distinct tokens. With ``c`` of them
    common its similarity is ``c / (x + y - c)``, so ``7 c >= 3 (x + y)``. Two regions have no more common tokens than
    common bits and tokens hidden by either's bits.
    """
    common = np.empty(len(u), np.int64)
    step = max(1, STEP // maps.shape[1])
    for at in range(0, len(u), step):
        i, j = u[at : at + step], v[at : at + step]
        common[at : at + step] = np.bitwise_count(maps[i] & maps[j]).sum(axis=1, dtype=np.int64)
    return 7 * (common + np.minimum(hidden[u], hidden[v])) >= 3 * (2 * LEAST - repeats[u] - repeats[v])


def _facts(places: pa.Table, known: pa.Table) -> pa.Table:
    """What is known of texts (``_FACT``) with verified places added: each text's joined spans, and a link to the smallest
    text that it is connected to here."""
    read = lambda table, *names: [table.column(n).to_numpy() for n in names]
    u, v, u_low, u_high, v_low, v_high = read(places, *(f.name for f in _schema(_PASSAGE)))
    node, low, high, link = read(known, "node", "low", "high", "link")
    texts, ends = np.unique(np.concatenate([u, node, v, link]), return_inverse=True)
    a, b = ends[: len(ends) // 2], ends[len(ends) // 2 :]
    parts, before = np.arange(len(texts)), None
    while before is None or (parts != before).any():
        before = parts.copy()
        np.minimum.at(parts, a, before[b])
        np.minimum.at(parts, b, before[a])
        parts = parts[parts]
    at = np.concatenate([ends[: len(u)], ends[len(a) : len(a) + len(u)], ends[len(u) : len(a)]])
    low, high = np.concatenate([u_low, v_low, low]).astype(np.int64), np.concatenate([u_high, v_high, high]).astype(np.int64)
    order = np.lexsort((low, at))
    at, low, high = at[order], low[order], high[order]
    width = int(high.max(initial=0)) + 1
    reach = np.maximum.accumulate(at * width + high)  # a text's spans begin beyond the reach of the text before
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (at[1:] * width + low[1:] > reach[:-1])])[: len(at)])
    last = np.append(new[1:], len(at))[: len(new)] - 1
    found = (texts[at[new]], low[new], reach[last] - at[new] * width, texts[parts[at[new]]])
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(found, _schema(_FACT).types, strict=True)], schema=_schema(_FACT))


def _compared(group: pa.Table, listed: bool) -> pa.Table:
    """Verifies the pairs of a bucket's homes, in memory and some at once: the facts on its texts, or the verified places."""
    group = group.sort_by([(n, "ascending") for n in ("home", "low", "high", "side", "node", "grid")])
    column = lambda n: group.column(n).combine_chunks()
    key = [column(n).to_numpy() for n in ("home", "low", "high")]
    node, part, grid = (column(n).to_numpy() for n in ("node", "part", "grid"))
    home = np.cumsum(np.concatenate([[False], np.any([np.diff(x) != 0 for x in key], axis=0)]))
    side = column("side").to_numpy(zero_copy_only=False)
    tokens, sizes = _tokens(column("tokens"))
    lists = column("groups")
    region = np.repeat(np.arange(len(node)), np.diff(lists.offsets.to_numpy()))
    spots = region, lists.flatten().to_numpy(), column("bare").flatten().to_numpy(zero_copy_only=False)
    sketches = _sketches(tokens, sizes)
    names, ids = np.unique(tokens, return_inverse=True)
    wide = np.full((len(sizes), 3 * LEAST), len(names), np.int32)  # a region in each row, filled up with a name that none has
    before = np.cumsum(sizes) - sizes
    wide[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(ids)) - np.repeat(before, sizes)] = ids
    flat = lambda x: tokens[np.repeat(before[x] - (np.cumsum(sizes[x]) - sizes[x]), sizes[x]) + np.arange(sizes[x].sum())]
    step, out, known = max(1, STEP // (6 * LEAST)), [], _schema(_FACT).empty_table()  # pairs of regions
    for u, v in _candidates(home, side, key[1] == key[2], node, part, spots):
        keep = _likely(u, v, *sketches)
        swap = node[u] > node[v]
        once = (sketches[2][u] == 0) & (sketches[2][v] == 0)
        for kind in (True, False):  # regions without and with repeated tokens
            some = np.flatnonzero(keep & (once == kind))
            for at in range(0, len(some), step):
                k = some[at : at + step]
                if kind:
                    hit, bounds = verify_once(_matched(wide, u[k], v[k], len(names)))
                    bounds = np.where(swap[k], bounds[[2, 3, 0, 1]], bounds)
                i, j = np.where(swap[k], v[k], u[k]), np.where(swap[k], u[k], v[k])
                if not kind:
                    hit, bounds = verify(flat(i), sizes[i], flat(j), sizes[j])
                out.append(_passages(hit, bounds, node[i], node[j], grid[i], grid[j]))
                if not listed and len(out) == 64:
                    known, out = _facts(pa.Table.from_batches(out), known), []
    places = pa.Table.from_batches(out, _schema(_PLACED))
    return places if listed else _facts(places, known)


def _matched(wide: np.ndarray, u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For pairs of regions without repeats, sorted by ``u``: for each place in the second its token's place in the first, from 1, or 0."""
    out, place = np.empty((len(u), wide.shape[1]), np.uint8), np.zeros(n + 1, np.uint8)
    start = np.flatnonzero(np.diff(u, prepend=-1))
    for at, to in zip(start.tolist(), [*start[1:].tolist(), len(u)], strict=True):
        own = wide[u[at]]
        place[own] = np.arange(1, len(own) + 1)
        place[n] = 0
        out[at:to] = place[wide[v[at:to]]]
        place[own] = 0
    return out


def _stretches(matched: np.ndarray, row: np.ndarray, place: np.ndarray, n: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` rows the first and last position of its longest stretch of matches with gaps up to ``gap``."""
    low, high = np.zeros(n, np.int64), np.full(n, -1)
    spots = np.flatnonzero(matched)
    if not len(spots):
        return low, high
    row, place = row[spots], place[spots]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (np.diff(place) > gap + 1)])
    start, end = place[new], place[np.append(np.flatnonzero(new)[1:] - 1, len(place) - 1)]
    owner = row[new]
    order = np.lexsort((start, start - end, owner))
    order = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]
    low[owner[order]], high[owner[order]] = start[order], end[order]
    return low, high


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys, sorted; by a sort, as the hashing of ``np.unique`` takes several times as long here."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _within(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are among the known ones, which are sorted."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def verify(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of regions, whose tokens and sizes are given one after another: which have a verified passage, and its
    first and last token in both."""
    n = len(a_sizes)
    sides = []
    for tokens, sizes in ((a, a_sizes), (b, b_sizes)):
        row = np.repeat(np.arange(n), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        sides.append((row.astype(np.uint64) << np.uint64(32) | tokens, row, place))
    (a_keys, a_row, a_place), (b_keys, b_row, b_place) = sides
    in_a = _within(a_keys, _distinct(b_keys))
    open_ = np.bincount(a_row[in_a], minlength=n) >= LEAST // 2
    keep_a, keep_b = open_[a_row], open_[b_row]
    a_keys, a_row, a_place, in_a, b_keys, b_row, b_place = *(x[keep_a] for x in (a_keys, a_row, a_place, in_a)), *(x[keep_b] for x in (b_keys, b_row, b_place))
    in_b = _within(b_keys, _distinct(a_keys))
    hit, bounds = np.zeros(n, bool), np.zeros((4, n), np.int64)
    for gap in GAPS:
        a1, a2 = _stretches(in_a & open_[a_row], a_row, a_place, n, gap)
        b1, b2 = _stretches(in_b & open_[b_row], b_row, b_place, n, gap)
        open_ &= (a2 - a1 + 1 >= LEAST) & (b2 - b1 + 1 >= LEAST)
        x = _distinct(a_keys[open_[a_row] & (a1[a_row] <= a_place) & (a_place <= a2[a_row])])
        y = _distinct(b_keys[open_[b_row] & (b1[b_row] <= b_place) & (b_place <= b2[b_row])])
        count = lambda keys: np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=n)
        common = count(x[_within(x, y)])
        good = open_ & (4 * common >= 3 * (count(x) + count(y) - common))
        bounds[:, good] = np.stack([a1, a2, b1, b2])[:, good]
        hit |= good
        open_ &= ~good
    return hit, bounds


def verify_once(matched: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`verify` for pairs of regions in which no token comes twice, from their matched places (:func:`_matched`)."""
    n, width = matched.shape
    in_a = np.zeros((n, width + 1), bool)
    in_a[np.arange(n)[:, None], matched] = True
    in_a, in_b = np.ascontiguousarray(in_a[:, 1:]), matched > 0
    rows = np.flatnonzero(in_b.sum(axis=1) >= LEAST // 2)
    hit, bounds = np.zeros(n, bool), np.zeros((4, n), np.int64)
    for gap in GAPS:
        row, place = np.repeat(np.arange(len(rows)), width), np.tile(np.arange(width), len(rows))
        a1, a2 = _stretches(in_a[rows].ravel(), row, place, len(rows), gap)
        b1, b2 = _stretches(in_b[rows].ravel(), row, place, len(rows), gap)
        long = (a2 - a1 + 1 >= LEAST) & (b2 - b1 + 1 >= LEAST)
        rows, a1, a2, b1, b2 = rows[long], a1[long], a2[long], b1[long], b2[long]
        at, seen = np.arange(width), matched[rows]
        inside = (seen > a1[:, None]) & (seen <= a2[:, None] + 1) & (at >= b1[:, None]) & (at <= b2[:, None])
        good = 7 * inside.sum(axis=1) >= 3 * (a2 - a1 + b2 - b1 + 2)
        bounds[:, rows[good]] = np.stack([a1, a2, b1, b2])[:, good]
        hit[rows[good]] = True
        rows = rows[~good]
    return hit, bounds


def _regions(batches):
    for whole in batches:
        for batch in kernel.slices(whole, "text", SLICE):
            tokens, before, _, marks = nodes_of(batch.column("text"))
            short, out = tokens.astype(np.uint32), []
            for i, grids in enumerate(batch.column("grids").to_pylist()):
                own = short[before[i] : before[i + 1]]
                out += [(int(marks[i].astype(np.int64)), g, own[max(0, (g - 1) * LEAST) : (g + 2) * LEAST].tobytes()) for g in grids]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["node", "grid", "tokens"])


def _tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all regions of a column one after another, and the number of each."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint32), np.diff(offsets) // 4


def _passages(hit: np.ndarray, bounds: np.ndarray, u: np.ndarray, v: np.ndarray, grid_u: np.ndarray, grid_v: np.ndarray) -> pa.RecordBatch:
    """The verified of some places, with word spans in their texts."""
    low_u, low_v = (np.maximum(0, (g.astype(np.int64) - 1) * LEAST) for g in (grid_u, grid_v))
    a1, a2, b1, b2 = bounds
    found = (u, v, a1 + low_u, a2 + low_u + WIDTH, b1 + low_v, b2 + low_v + WIDTH, grid_u, grid_v)
    return pa.RecordBatch.from_arrays([pa.array(x[hit], t) for x, t in zip(found, _schema(_PLACED).types, strict=True)], schema=_schema(_PLACED))


def _checked(batches):
    for whole in batches:
        step = max(1, STEP // (6 * LEAST))  # pairs of regions
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            hit, bounds = verify(*_tokens(batch.column("t_u")), *_tokens(batch.column("t_v")))
            yield _passages(hit, bounds, *(batch.column(n).to_numpy() for n in ("u", "v", "grid_u", "grid_v")))


def _marked(batches):
    for whole in batches:
        for batch in kernel.slices(whole, "text", SLICE):
            _, _, sizes, marks = nodes_of(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(marks.view(np.int64)), pa.array(sizes.astype(np.int64))], ["doc_id", "node", "n_words"])


def _asked(flags: np.ndarray):
    """Texts with their nodes, without most of those that aren't asked for."""

    def run(batches):
        for whole in batches:
            for batch in kernel.slices(whole, "text", SLICE):
                marks = nodes_of(batch.column("text"))[3]
                at = (marks >> np.uint64(64 - FLAGS)).astype(np.int64)
                keep = np.flatnonzero(flags[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                yield pa.RecordBatch.from_arrays([pa.array(marks[keep].view(np.int64)), batch.column("text").take(pa.array(keep))], ["node", "text"])

    return run


def _flags(nodes: DataFrame) -> np.ndarray:
    """One bit for each value of the first ``FLAGS`` bits of a node, set if a node has it; of one size for any input."""
    top = nodes.select(F.shiftrightunsigned("node", 64 - FLAGS).cast("int").alias("top"))
    found = top.groupBy(F.shiftright("top", 5).alias("at")).agg(F.expr("bit_or(shiftleft(1L, top & 31))").alias("bits")).toArrow()
    out = np.zeros(1 << FLAGS - 5, np.uint32)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint8)


def _regions_of(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """The tokens around distinct cells ``(node, grid)``; only texts with one are read again."""
    asked = materialize(cells.groupBy("node").agg(F.collect_list("grid").alias("grids")), "asked")  # at most a text's length / LEAST
    texts = rows.select("text").mapInArrow(_asked(_flags(asked)), "node long, text string").groupBy("node").agg(F.first("text").alias("text"))
    regions = materialize(texts.join(asked, "node").select("text", "grids").mapInArrow(_regions, "node long, grid int, tokens binary"), "regions")
    discard(asked)
    return regions


def _verified(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """The passages around the seeds."""
    regions = _regions_of(rows, seeds.select(F.col("u").alias("node"), F.col("grid_u").alias("grid")).union(seeds.select("v", "grid_v")).distinct())
    side = lambda end: regions.select(F.col("node").alias(end), F.col("grid").alias(f"grid_{end}"), F.col("tokens").alias(f"t_{end}"))
    whole = seeds.join(side("u"), ["u", "grid_u"]).join(side("v"), ["v", "grid_v"])
    found = materialize(whole.mapInArrow(_checked, _PLACED).drop("grid_u", "grid_v"), "passages")
    discard(regions)
    return found


def _search(df: DataFrame, text: str, listed: bool) -> tuple[DataFrame, DataFrame]:
    """The passages around seeds, and what comparing the open groups adds to them (:func:`_compared_pairs`)."""
    rows = df.select(F.col(quoted(text)).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, int(size // BUCKET).bit_length())
    back = materialize(rows.mapInArrow(_sent(bits), _SENT).groupBy("key").applyInArrow(_answered, _BACK), "min-hashes")
    shared = materialize(back.groupBy("shard").applyInArrow(_shared, _SHARED), "windows")
    discard(back)
    seeds = materialize(_seeds(_collisions(shared), max(64, int(size // SPREAD))), "seeds")
    found = _verified(rows, seeds)
    spots = _spots(shared, found)
    discard(shared)
    more = _compared_pairs(rows, spots, listed)
    discard(spots)
    if listed:  # without the places that were verified before
        places, more = more, materialize(more.join(seeds, ["u", "v", "grid_u", "grid_v"], "left_anti").select(found.columns), "passages")
        discard(places)
    discard(seeds)
    return found, more


def find_passages(df: DataFrame, text: str = "text") -> DataFrame:
    """Verified passages of two texts: ``u``, ``v`` (text hashes) and word spans in both; ends are exclusive.

    Every pair is listed, so a group of near copies gives rows with the square of its size.
    """
    found, more = _search(df, text, True)
    return found.union(more)


def _sides(found: DataFrame) -> DataFrame:
    """The spans of passages, one row for each of their two texts (``node``)."""
    return found.select(F.col("u").alias("node"), F.col("u_low").alias("low"), F.col("u_high").alias("high")).union(found.select("v", "v_low", "v_high"))


def _spans(sides: DataFrame) -> DataFrame:
    """Per text (``node``) its ``spans`` of words in passages."""
    spans = sides.distinct()
    return spans.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("spans")).withColumn("spans", _merged(F.col("spans")))


def _merged(spans):
    """Spans joined where they touch, from a sorted array."""
    start = F.array().cast("array<struct<low:int,high:int>>")

    def add(acc, x):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["low"].alias("low"), F.greatest(last["high"], x["high"]).alias("high"))))
        return F.when(F.size(acc) == 0, F.array(x)).when(x["low"] <= last["high"], joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(spans, start, lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).otherwise(add(acc, x)))


def mark_passages(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``n_repeated`` (words in passages found elsewhere), ``spans`` of words,
    ``n_copies`` (documents with equal words) and ``component_id``, the smallest id linked by passages."""
    found, more = _search(df, text, False)
    per_node = _spans(_sides(found).union(more.select("node", "low", "high")))
    parts = connected_components(found.select("u", "v").union(more.select("node", "link")))
    rows = df.select(F.col(quoted(id_column)).cast("long").alias("doc_id"), F.col(quoted(text)).alias("text"))
    marked = materialize(rows.mapInArrow(_marked, "doc_id long, node long, n_words long"), "documents")
    own = marked.filter(F.col("n_words") >= LEAST + WIDTH - 1)
    copies = own.groupBy("node", order_id().alias("id")).agg(F.lit(1).alias("one")).groupBy("node").agg(F.count("*").alias("n_copies"), F.min("id").alias("low_id"))
    classes = copies.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    lowest = classes.groupBy("part").agg(F.min("low_id").alias("part_id"))
    facts = classes.join(lowest, "part").join(per_node, "node", "left").select("node", "n_copies", "part_id", "spans")
    out = marked.join(facts, "node", "left")
    whole = F.array(F.struct(F.lit(0).alias("low"), F.col("n_words").cast("int").alias("high")))
    spans = F.when(F.col("n_copies") > 1, whole).otherwise(F.coalesce("spans", F.array().cast("array<struct<low:int,high:int>>")))
    out = out.select("doc_id", "n_words", F.coalesce("n_copies", F.lit(1)).alias("n_copies"), shown_id(F.coalesce("part_id", order_id())).alias("component_id"), spans.alias("spans"))
    return out.withColumn("n_repeated", F.aggregate("spans", F.lit(0), lambda acc, s: acc + s["high"] - s["low"]).cast("long"))
