"""Jaccard join of documents on word shingles by adaptive multi-match prefixes.

1. Documents are handled in shards of a few megabytes of text. Each shard sends its distinct shingle hashes,
   grouped in buckets of the hash range, and gets back which of them occur in another set and in how many.
   A shingle of many documents of a shard is sent once, with a count, so no bucket grows with a hot shingle's
   documents. Shingles of one set only can't be part of an intersection.
2. Shingles are ordered from rare to frequent. Two sets of similarity ``t`` share ``l`` of their first
   ``n - ceil(t n) + l`` shingles, for every ``l``. Each document picks its ``l`` by estimated cost: a longer
   prefix reads more postings but asks for more shared ones before a pair is verified. A pair is a candidate
   if it shares as many prefix shingles as the smaller of its two levels. As the smaller set of a pair has six
   sevenths in common with the other, its part of these shingles lies in a shorter prefix still, so two sets
   whose rare shingles differ never meet in the list of a hot one.
3. Copies and large groups: sets that are equal are one node. Each posting list first links its nodes to a few
   picked ones of the list, and verified links are merged to components. Only nodes of different components
   that share enough prefix shingles remain, and all of these pairs are verified. So a group of copies costs a
   few links a document, and no link between different components is lost.

Hashes have 64 bits; two different shingles, or sets, are taken as equal with a chance of about pairs / 2**64.

Defined cases: words are maximal runs without white space, A-Z lower-cased. With fewer than five words the
whole sequence is the only shingle; null and blank texts have no set, link with nothing and are components
of their own. Null ids count as larger than all others. Rows are nodes by content, so rows with one id and
different texts are told apart, and repeated rows are linked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm import kernel
from watchloom.llm.common import columns, fresh, order_id, quoted, shown_id
from watchloom.llm.components import connected_components
from watchloom.llm.kernel import numbers, planes
from watchloom.session import materialize

WIDTH = 5
SLICE, BUCKET = 2 << 20, 2 << 20  # bytes of text in a shard, and behind a bucket
HEAVY = 16  # a shingle in so many sets of a shard keeps its list in the shard
LEVELS, VERIFY = 2, 4.0
SALTS = 8


def signatures(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles ordered by row and hash, their rows, each row's number, and a hash of its set."""
    data, offsets = kernel.texts(column)
    starts, ends, counts = kernel.words(data, offsets)
    hashes, rows = kernel.distinct(*kernel.shingles(kernel.word_hashes(data, starts, ends, lower=True), counts, WIDTH))
    n = np.bincount(rows, minlength=len(offsets) - 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(kernel.mix(hashes ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64)])
    at = np.concatenate([[0], np.cumsum(n)])
    return hashes, rows, n, kernel.mix(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64))


_SENT = "key long, shard long, a binary, b binary, c binary, d binary, e binary"
_BACK = "shard long, kind int, a binary, b binary, c binary, d binary, e binary"


def _sent(bits: int):
    """Per shard one row a bucket (hashes, counts, lists of the light ones) and one with the shard's sets."""

    def run(batches):
        for whole in batches:
            for batch in kernel.slices(whole, "text", SLICE):
                hashes, rows, n, marks = signatures(batch.column("text"))
                first = np.zeros(len(n), bool)
                first[np.unique(marks, return_index=True)[1]] = True
                first &= n > 0
                if not first.any():
                    continue
                index = np.cumsum(first) - 1
                keep = first[rows]
                hashes, docs = hashes[keep], index[rows[keep]].astype(np.uint32)
                order = np.argsort(hashes, kind="stable")
                hashes, docs = hashes[order], docs[order]
                start = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
                known, count = hashes[start], np.diff(np.append(start, len(hashes))).astype(np.uint32)
                heavy = count >= HEAVY
                each = np.repeat(heavy, count)
                marks, n = marks[first], n[first].astype(np.uint32)
                shard = int(np.bitwise_xor.reduce(kernel.mix(marks + np.arange(len(marks), dtype=np.uint64)))) >> 1
                out = [(-1 - shard, shard, planes(marks), planes(n), planes(known[heavy]), planes(count[heavy]), planes(docs[each]))]
                cuts = np.searchsorted(known, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() + [len(known)]
                light, before = docs[~each], np.concatenate([[0], np.cumsum(np.where(heavy, 0, count), dtype=np.int64)])
                for bucket, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if i < j:
                        out.append((bucket, shard, planes(known[i:j]), planes(count[i:j]), planes(light[before[i] : before[j]]), b"", b""))
                yield pa.RecordBatch.from_pylist([dict(zip("key shard a b c d e".split(), r, strict=True)) for r in out], _schema(_SENT))

    return run


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in text.split(", "))])


def _counted(group: pa.Table) -> pa.Table:
    """Sums a bucket's counts over all shards and gives each shard back its shared hashes."""
    rows = group.to_pylist()
    if rows[0]["key"] < 0:
        out = [{"shard": r["shard"], "kind": 0, **{x: r[x] for x in "abcde"}} for r in rows]
        return pa.Table.from_pylist(out, _schema(_BACK))
    known, counts = [numbers(r["a"], np.uint64) for r in rows], [numbers(r["b"], np.uint32) for r in rows]
    _, back = np.unique(np.concatenate(known), return_inverse=True)
    sets = np.bincount(back, np.concatenate(counts)).astype(np.int64)[back]
    out, at = [], 0
    for r, h, c in zip(rows, known, counts, strict=True):
        own = sets[at : at + len(h)]
        at += len(h)
        shared = own > 1
        if shared.any():
            listed = np.repeat(shared, np.where(c >= HEAVY, 0, c))
            docs = numbers(r["c"], np.uint32)[listed]
            frequency = np.minimum(own[shared], 2**32 - 1).astype(np.uint32)
            out.append({"shard": r["shard"], "kind": 1, "a": planes(h[shared]), "b": planes(c[shared]), "c": planes(docs), "d": planes(frequency), "e": b""})
    return pa.Table.from_pylist(out, _schema(_BACK))


_NODE = "node long, n int, tokens array<long>, prefix int, short int, level int"


def _nodes(group: pa.Table) -> pa.Table:
    """A shard's sets that could have a partner: shared shingles from rare to frequent, prefix and level."""
    # Shards of equal texts have one id and get equal answers, of which one counts.
    rows = list({(r["kind"], r["a"]): r for r in group.to_pylist()}.values())
    own = next(r for r in rows if r["kind"] == 0)
    marks, n = numbers(own["a"], np.uint64), numbers(own["b"], np.uint32).astype(np.int64)
    heavy, sizes, lists = numbers(own["c"], np.uint64), numbers(own["d"], np.uint32), numbers(own["e"], np.uint32)
    begin = np.cumsum(sizes, dtype=np.int64) - sizes
    hashes, docs, often = [], [], []
    for r in rows:
        if r["kind"]:
            h, c, f = numbers(r["a"], np.uint64), numbers(r["b"], np.uint32), numbers(r["d"], np.uint32)
            big = c >= HEAVY
            light = np.where(big, 0, c)
            hashes.append(np.repeat(h, light)), docs.append(numbers(r["c"], np.uint32)), often.append(np.repeat(f, light))
            for k in np.flatnonzero(big).tolist():
                at = int(np.searchsorted(heavy, h[k]))
                part = lists[begin[at] : begin[at] + sizes[at]]
                hashes.append(np.full(len(part), h[k])), docs.append(part), often.append(np.full(len(part), f[k]))
    if not hashes:
        return pa.Table.from_batches([], _node_schema())
    hashes, docs, often = np.concatenate(hashes), np.concatenate(docs).astype(np.int64), np.concatenate(often).astype(np.int64)
    shared = np.bincount(docs, minlength=len(n))
    need = (3 * n + 3) // 4
    able = shared >= need
    keep = able[docs]
    hashes, docs, often = hashes[keep], docs[keep], often[keep]
    order = np.lexsort((hashes, often, docs))
    hashes, often = hashes[order], often[order]
    marks, n, need, shared = marks[able], n[able], need[able], shared[able]
    ends = np.cumsum(shared)
    starts, read = ends - shared, np.concatenate([[0], np.cumsum(often)])
    best = np.full(len(n), np.inf)
    level, prefix = np.ones(len(n), np.int32), np.zeros(len(n), np.int32)
    for k in range(1, LEVELS + 1):
        width = np.minimum(shared, shared - need + k)  # shingles of this set alone come first in its prefix
        cost = (read[starts + width] - read[starts]) * (1.0 + VERIFY / k)
        better = (cost < best) & (k <= need)
        best, level, prefix = np.where(better, cost, best), np.where(better, k, level), np.where(better, width, prefix)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(hashes.view(np.int64)))
    # In the smaller set of a pair, which has six sevenths in common, the same number of matches ends earlier.
    short = np.clip(shared - (6 * n + 6) // 7 + level, 0, prefix)
    extra = (pa.array(x.astype(np.int32)) for x in (prefix, short, level))
    return pa.Table.from_arrays([pa.array(marks.view(np.int64)), pa.array(n.astype(np.int32)), lists, *extra], schema=_node_schema())


def _node_schema() -> pa.Schema:
    return pa.schema([("node", pa.int64()), ("n", pa.int32()), ("tokens", pa.list_(pa.int64())), ("prefix", pa.int32()), ("short", pa.int32()), ("level", pa.int32())])


def _marked(batches):
    for whole in batches:
        for batch in kernel.slices(whole, "text", SLICE):
            _, _, n, marks = signatures(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("body"), pa.array(n.astype(np.int64)), pa.array(marks.view(np.int64))], ["doc_id", "body", "n_shingles", "node"])


def _verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs ``(u, v)`` whose sets have a similarity of 0.75 or more."""
    side = lambda end: nodes.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("tokens").alias(f"t_{end}"))
    whole = pairs.join(side("u"), "u").join(side("v"), "v")
    return whole.filter(7 * F.size(F.array_intersect("t_u", "t_v")) >= 3 * (F.col("n_u") + F.col("n_v"))).select("u", "v")


def _possible(n_a: str, s_a: str, n_b: str, s_b: str):
    """Whether sets of these sizes, with so many shingles that others have, can be similar enough."""
    return 7 * F.least(s_a, s_b) >= 3 * (F.col(n_a) + F.col(n_b))


def _ordered_pair(a: str, b: str):
    return F.least(a, b).alias("u"), F.greatest(a, b).alias("v")


def _star_links(postings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Verified links of every node to the picked nodes of its posting lists.

    Nodes with few shingles of their own are picked first, the least edited ones of a group of copies.
    """
    salted = F.xxhash64("node", F.pmod("token", F.lit(SALTS)))
    own = F.floor(32 * (F.col("n") - F.col("s")) / F.col("n"))
    best = F.min(F.struct(own.alias("o"), salted.alias("h"), F.col("node").alias("w"), F.col("n").alias("n_w"), F.col("s").alias("s_w"), F.col("part").alias("part_w")))
    picked = postings.filter("short").groupBy("token").agg(best.alias("p")).select("token", "p.w", "p.n_w", "p.s_w", "p.part_w")
    pairs = postings.join(picked, "token").filter((F.col("part") != F.col("part_w")) & _possible("n", "s", "n_w", "s_w"))
    return _verified(pairs.select(*_ordered_pair("node", "w")).distinct(), nodes)


def _rest_pairs(postings: DataFrame) -> DataFrame:
    """Pairs of nodes of different components that share enough prefix shingles.

    Of a pair, the smaller set's shingles are in its short prefix, the other's in its whole prefix.
    """
    small = postings.filter("short").select("token", *(F.col(c).alias(f"{c}_w") for c in ("part", "node", "n", "s", "level", "rank")))
    once = (F.col("n_w") < F.col("n")) | (F.col("n_w") == F.col("n")) & (~F.col("short") | (F.col("node_w") < F.col("node")))
    # As both sizes are known here, so is the overlap they need, and with it how early the matches must lie and
    # how far apart their ranks may be: what is common is at most what comes before both and after both.
    need, least = F.floor((3 * (F.col("n") + F.col("n_w")) + 6) / 7), F.least("level", "level_w")
    early = (F.col("rank") < F.col("s") - need + least) & (F.col("rank_w") < F.col("s_w") - need + least)
    apart = F.col("rank") - F.col("rank_w")
    early = early & (apart <= F.col("s") - need) & (-apart <= F.col("s_w") - need)
    pairs = postings.join(small, "token").filter((F.col("part") != F.col("part_w")) & once & _possible("n", "s", "n_w", "s_w") & early)
    return pairs.groupBy(*_ordered_pair("node", "node_w")).agg(F.count("*").alias("c"), F.min(F.least("level", "level_w")).alias("l")).filter("c >= l").select("u", "v")


def _open_lists(postings: DataFrame, parts: DataFrame) -> DataFrame:
    """Postings with their node's component, of the lists that still span more than one."""
    found = parts.select("node", F.col("component").alias("found"))
    own = postings.join(found, "node", "left").withColumn("part", F.coalesce("found", "node")).drop("found")
    spans = own.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.max("short").alias("any"))
    return own.join(spans.filter("low < high AND any").select("token"), "token")


def links(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Verified links ``(u, v)`` between set hashes that join all similar sets, and their components."""
    rows = df.select(F.col(quoted(text)).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, int(size // BUCKET).bit_length())
    back = materialize(rows.mapInArrow(_sent(bits), _SENT).groupBy("key").applyInArrow(_counted, _BACK), "shared-shingles")
    found = back.groupBy("shard").applyInArrow(_nodes, _NODE).groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "tokens", "prefix", "short", "level")))
    nodes = materialize(found, "nodes")
    postings = nodes.select("node", "n", F.size("tokens").alias("s"), "level", "short", F.posexplode(F.slice("tokens", F.lit(1), F.col("prefix"))).alias("rank", "token"))
    postings = postings.select("node", "n", "s", "level", "rank", (F.col("rank") < F.col("short")).alias("short"), "token")
    lists = postings.groupBy("token").agg(F.count("*").alias("c"), F.max("short").alias("any")).filter("c > 1 AND any").select("token")
    postings = materialize(postings.join(lists, "token"), "postings")
    edges = materialize(_star_links(postings.withColumn("part", F.col("node")), nodes), "links")
    parts = connected_components(edges)
    rest = materialize(_verified(_rest_pairs(_open_lists(postings, parts)), nodes), "links")
    if rest.limit(1).count():
        parts = connected_components(rest.union(parts.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    return edges.union(rest), parts


def _classes(df: DataFrame, id_column: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Every row's id, text hash (``body``), set size and node; and for each node its component's smallest id and that one's node."""
    _, parts = links(df, text)
    rows = df.select(F.col(quoted(id_column)).cast("long").alias("doc_id"), F.xxhash64(F.col(quoted(text))).alias("body"), F.col(quoted(text)).alias("text"))
    marked = materialize(rows.mapInArrow(_marked, "doc_id long, body long, n_shingles long, node long"), "documents")
    sets = marked.filter("n_shingles > 0").groupBy("node").agg(F.min(order_id()).alias("low"))
    found = sets.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    lowest = found.groupBy("part").agg(F.min(F.struct("low", "node")).alias("first"))
    return marked, found.join(lowest, "part").select("node", F.col("first.low").alias("low"), F.col("first.node").alias("first_node"))


def join_documents(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, and ``node`` (a hash of the document's set)."""
    marked, classes = _classes(df, id_column, text)
    own = F.when(F.col("n_shingles") > 0, F.col("low")).otherwise(order_id())
    return marked.join(classes, "node", "left").select("doc_id", "n_shingles", shown_id(own).alias("component_id"), "node")


def one_of_each(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, the one with the smallest id, and all rows without words; columns as they were.

    Of rows that share this id and set, one stays.
    """
    marked, classes = _classes(df, id_column, text)
    first = marked.join(classes, "node").filter((order_id() == F.col("low")) & (F.col("node") == F.col("first_node")))
    stay = first.groupBy(order_id().alias("stay_id"), "node").agg(F.min("body").alias("stay_body"), F.count("*").alias("stay_count"))
    stay = materialize(stay, "stay")
    key, mark = fresh(df, "stay_id"), fresh(df, "stay_body")
    rows = df.withColumns({key: order_id(quoted(id_column)), mark: F.xxhash64(F.col(quoted(text)))})
    blank = ~F.rlike(F.coalesce(F.col(quoted(text)), F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
    kept = rows.filter(~blank).join(stay.select(F.col("stay_id").alias(key), F.col("stay_body").alias(mark)), [key, mark], "left_semi")
    if stay.filter("stay_count > 1").limit(1).count():
        kept = kept.dropDuplicates([key, mark])
    return kept.select(*columns(df)).union(df.filter(blank))
