r"""Spelling variants: range searches in k-d trees over letter-count vectors.

A word's vector counts its letters (``DIMENSIONS`` numbers; a-z have their own, others share the rest). One edit
moves the vector little: a replaced letter takes one count up and one down (L1 distance two), an inserted letter
takes one up, a deleted one takes one down. So for words of length ``m`` three searches find all words one edit
away: lengths ``m``, ``m + 1`` and ``m - 1``, each with its own bound on the counts up and down.

* Top of the trees: for each length, cuts at the median of the most spread letter count, from a sample of at
  most ``SAMPLE`` words, down to leaves of about ``LEAF`` words (``MAX_LEAVES`` for all lengths at most). A cut
  only decides where a word lies; every word is in exactly one leaf. A word is sent as a query to each leaf whose
  box is within its bounds. The cuts are all that tasks are given.
* A leaf with more words, or more queries, than a task should hold is dealt into blocks; each block of
  queries meets each block of words, whatever makes the leaf large.
* Inside a block a k-d tree with tight boxes is built over the words' distinct vectors. Pairs of query vectors and
  boxes are pruned level by level, in bounded parts; vectors of the boxes that are left are compared, and words
  with near vectors letter by letter in order.

Each block answers with a query's number of near words and its best one; these are combined, so pairs of words
are never listed. A word's form is its near word of largest count if that has at least twice its own count.
Counts double along forms, so roots are found by a few rounds of pointer doubling.

Words are maximal runs ``[A-Za-zÀ-ÿ]+`` with A-Z lower-cased, of ``LETTERS`` code points and ``LEAST``
occurrences or more. ``slips`` deletes one code point of an occurrence whose ``crc32("<doc_id>:<run>")`` is divisible by ``SLIP``.

Defined cases: a null text has no words. A null id counts as empty text. Repeated rows count as often as they
occur. Ties between near words go to the smallest in code-point order. Runs of any length are counted whole. Other columns are not read. Without
words the result is empty.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm import kernel
from watchloom.llm.common import quoted
from watchloom.llm.runs import byte_set, runs, strings
from watchloom.session import materialize

SLICE = 4 << 20
LETTERS, LEAST, SLIP = 5, 3, 97
DIMENSIONS, MOST, LEAF, MAX_LEAVES, SAMPLE = 32, 7, 16384, 4096, 1 << 18
BUCKET, PART = 8, 1 << 17
_LETTER, _LEAD = byte_set((65, 90), (97, 122)), 0xC3
_FIRST_LONG = 64


def _crc_table() -> np.ndarray:
    """The byte table of the CRC-32 with the reversed polynomial."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> np.uint32(1)) ^ np.uint32(0xEDB88320), x >> np.uint32(1))
    return x


_CRC = _crc_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each byte range (A-Z lower-cased), carried on from a checksum of what goes before it."""
    state, sizes = ~begun.astype(np.uint32), ends - starts
    order = np.argsort(-np.minimum(sizes, _FIRST_LONG + 1), kind="stable")
    sizes, at, out = sizes[order], starts[order], state[order]
    for k in range(int(min(sizes.max(initial=0), _FIRST_LONG))):
        n = int(np.searchsorted(-sizes, -k, "left"))
        out[:n] = _CRC[(out[:n] ^ _LOWER[data[at[:n] + k]]) & np.uint32(255)] ^ (out[:n] >> np.uint32(8))
    out = ~out
    for k in np.flatnonzero(sizes > _FIRST_LONG).tolist():
        out[k] = zlib.crc32(_LOWER[data[at[k] + _FIRST_LONG : at[k] + sizes[k]]].tobytes(), int(out[k]))
    back = np.empty(len(order), np.uint32)
    back[order] = out
    return back


def _counted(letters: int, slip: int | None):
    def run(batches):
        for whole in batches:
            for batch in kernel.slices(whole, "text", SLICE):
                data, offsets = kernel.texts(batch.column("text"))
                lead = data == _LEAD
                inside = _LETTER[data] | lead
                inside[1:] |= lead[:-1]
                starts, ends, counts = runs(inside, offsets)
                leads = np.append(0, np.cumsum(lead))
                length = (ends - starts) - (leads[ends] - leads[starts])
                slipped: list[str] = []
                if slip and len(starts):
                    begun = np.array([zlib.crc32(b":" if i is None else f"{i}:".encode()) for i in batch.column("doc_id").to_pylist()], np.uint32)
                    rows = np.searchsorted(counts, np.arange(len(starts)), "right") - 1
                    sums = checksums(data, starts, ends, begun[rows])
                    hit = sums % np.uint32(slip) == 0
                    for k in np.flatnonzero(hit & (length > letters)).tolist():
                        word = _LOWER[data[starts[k] : ends[k]]].tobytes().decode()
                        out = int(sums[k]) % len(word)
                        slipped.append(word[:out] + word[out + 1 :])
                    long = (length >= letters) & ~hit
                else:
                    long = length >= letters
                starts, ends = starts[long], ends[long]
                _, first, n = np.unique(kernel.word_hashes(data, starts, ends, lower=True), return_index=True, return_counts=True)
                known = strings(data, starts[first], ends[first])
                extra = pa.array(slipped, pa.large_string()).value_counts()
                yield pa.RecordBatch.from_arrays([
                    pa.concat_arrays([known, extra.field("values")]).cast(pa.string()), pa.concat_arrays([pa.array(n, pa.int64()), extra.field("counts")]),
                ], ["word", "n"])

    return run


def count_words(df: DataFrame, id_column: str = "doc_id", text: str = "text", letters: int = LETTERS, least: int = LEAST, slips: bool = False) -> DataFrame:
    """``word`` and ``n``, its occurrences, combined in each part of the texts before the shuffle."""
    rows = df.select(F.col(quoted(id_column)).alias("doc_id"), F.col(quoted(text)).alias("text"))
    return rows.mapInArrow(_counted(letters, SLIP if slips else None), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def letters_of(words: list[str]) -> np.ndarray:
    """Code points, all below 256, as a matrix; words of one length."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1 if words else 1)


def by_length(words: list[str]):
    """(length, places, code points) of the words of each length."""
    sizes = np.array([len(w) for w in words], np.int64)
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        yield size, own, letters_of([words[k] for k in own.tolist()])


_SLOT = np.full(256, -1, np.int64)
_SLOT[97:123] = np.arange(26)
_SLOT[0xC0:0x100] = 26 + np.arange(64) % (DIMENSIONS - 26)


def vectors(codes: np.ndarray) -> np.ndarray:
    """Letter counts of each word; counts above ``MOST`` are taken as ``MOST``, which brings no two words further apart."""
    at = np.repeat(np.arange(len(codes)), codes.shape[1]) * DIMENSIONS + _SLOT[codes.ravel()]
    return np.minimum(np.bincount(at, minlength=len(codes) * DIMENSIONS).reshape(-1, DIMENSIONS), MOST).astype(np.int16)


def packed(counts: np.ndarray) -> np.ndarray:
    """A vector as two numbers of sixteen half bytes."""
    halves = counts.astype(np.uint64).reshape(len(counts), 2, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return np.bitwise_or.reduce(halves, axis=2)


_TOP, _LOW = np.uint64(0x8888888888888888), np.uint64(0x1111111111111111)


def above(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Whether the counts of ``x`` above those of ``y`` sum to ``most`` (0 or 1) at most; packed vectors."""
    gap = (x | _TOP) - y
    over = gap & (((gap & _TOP) >> np.uint64(3)) * np.uint64(7))
    a, b = over[:, 0], over[:, 1]
    if most == 0:
        return (a | b) == 0
    one = np.uint64(1)
    return (((a & (a - one)) | (b & (b - one)) | ((a | b) & ~_LOW)) == 0) & ((a == 0) | (b == 0))


#: For each difference in length: how many counts of a near word may be above the query's, and how many below.
STEPS = {0: (1, 1), 1: (1, 0), -1: (0, 1)}


class Cuts:
    """The top of the trees: for each length a list of nodes (letter, largest count on the left, left, right) or leaves."""

    def __init__(self, words: list[str], total: int, leaf: int = LEAF, most: int = MAX_LEAVES):
        self.nodes: list[tuple[int, int, int, int]] = []
        self.roots: dict[int, int] = {}
        self.leaves = 0
        each = max(leaf, -(-total // most)) * len(words) / max(1, total)
        for size, _, codes in by_length(words):
            self.roots[size] = self._grow(vectors(codes), each)

    def _grow(self, counts: np.ndarray, each: float) -> int:
        node = len(self.nodes)
        self.nodes.append((-1, self.leaves, 0, 0))
        if len(counts) > each:
            spread = counts.std(axis=0)
            letter = int(spread.argmax())
            cut = int(np.median(counts[:, letter]))
            cut -= cut == counts[:, letter].max()
            left = counts[:, letter] <= cut
            if spread[letter] > 0 and left.any() and not left.all():
                self.nodes[node] = (letter, cut, self._grow(counts[left], each), self._grow(counts[~left], each))
                return node
        self.leaves += 1
        return node

    def _walk(self, root: int, counts: np.ndarray, up: int, down: int):
        """(leaf, rows) of all leaves whose box, as the cuts tell it, lies within the bounds."""
        stack = [(root, np.arange(len(counts)), np.zeros(len(counts), np.int16), np.zeros(len(counts), np.int16), {})]
        while stack:
            node, rows, over, under, box = stack.pop()
            letter, cut, left, right = self.nodes[node]
            if letter < 0:
                yield cut, rows
                continue
            low, high = box.get(letter, (0, 32767))
            own = counts[rows, letter]
            for child, lo, hi in ((left, low, cut), (right, cut + 1, high)):
                more = over - np.maximum(low - own, 0) + np.maximum(lo - own, 0)
                less = under - np.maximum(own - high, 0) + np.maximum(own - hi, 0)
                fits = (more <= up) & (less <= down)
                if fits.any():
                    stack.append((child, rows[fits], more[fits], less[fits], box | {letter: (lo, hi)}))

    def placed(self, size: int, counts: np.ndarray):
        """(rows, leaf, whether as queries) of words of one length: each in its own leaf, and in all it has to search.

        Words of a length without sampled words lie in leaf -1 - length.
        """
        everyone = np.arange(len(counts))
        for step, (up, down) in {None: (0, 0), **STEPS}.items():
            root = self.roots.get(size + (step or 0))
            if root is None:
                yield everyone, -1 - (size + (step or 0)), step is not None
            else:
                for leaf, rows in self._walk(root, counts, up, down):
                    yield rows, leaf, step is not None


def _dealt(cuts):
    def run(batches):
        for batch in batches:
            rows, leaves, query = [], [], []
            for size, own, codes in by_length(batch.column("word").to_pylist()):
                for found, leaf, asks in cuts.value.placed(size, vectors(codes)):
                    rows.append(own[found])
                    leaves.append(np.full(len(found), leaf))
                    query.append(np.full(len(found), asks))
            if rows:
                taken = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(leaves), pa.int64()), pa.array(np.concatenate(query)), batch.column("word").take(taken), batch.column("n").take(taken),
                ], ["leaf", "query", "word", "n"])

    return run


class Tree:
    """A k-d tree over distinct vectors, by halves: packed box bounds of every node, and the order of the vectors."""

    def __init__(self, counts: np.ndarray):
        depth = max(0, int(np.ceil(np.log2(max(1, len(counts)) / BUCKET))))
        self.order, edges = np.arange(len(counts)), np.array([0, len(counts)])
        self.points, self.levels = packed(counts), []
        for level in range(depth + 1):
            begin = edges[:-1]
            own = counts[self.order]
            filled = np.minimum(begin, max(0, len(counts) - 1))
            low, high = np.minimum.reduceat(own, filled, axis=0), np.maximum.reduceat(own, filled, axis=0)
            self.levels.append((packed(low), packed(high), edges))
            if level == depth:
                break
            letter = (high - low).argmax(axis=1)
            node = np.repeat(np.arange(len(begin)), np.diff(edges))
            self.order = self.order[np.lexsort((own[np.arange(len(own)), letter[node]], node))]
            edges = np.sort(np.concatenate([edges, (edges[:-1] + edges[1:]) // 2]))

    def near(self, queries: np.ndarray, up: int, down: int):
        """(query, vector) in bounded parts: all pairs within the bounds, found by pruning boxes."""
        stack = [(0, np.arange(len(queries)), np.zeros(len(queries), np.int64))]
        while stack:
            level, query, node = stack.pop()
            low, high, edges = self.levels[level]
            for at in range(0, len(query), PART):
                q, b = query[at : at + PART], node[at : at + PART]
                fits = above(low[b], queries[q], up) & above(queries[q], high[b], down) & (edges[b + 1] > edges[b])
                q, b = q[fits], b[fits]
                if level + 1 < len(self.levels):
                    stack.append((level + 1, np.repeat(q, 2), (2 * b[:, None] + [0, 1]).ravel()))
                    continue
                sizes = edges[b + 1] - edges[b]
                point = self.order[np.repeat(edges[b] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
                q = np.repeat(q, sizes)
                fits = above(self.points[point], queries[q], up) & above(queries[q], self.points[point], down)
                yield q[fits], point[fits]


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words are one edit apart, row by row; all of ``a`` have one length, and all of ``b``."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    if a.shape[1] > b.shape[1]:
        a, b = b, a
    same = a == b[:, :-1]
    head = np.where(same.all(axis=1), a.shape[1], np.argmin(same, axis=1))
    return ((a == b[:, 1:]) | (np.arange(a.shape[1]) < head[:, None])).all(axis=1)


def _classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct vectors, the words' places ordered by vector, and where each vector's words begin in that order."""
    keys = packed(counts)
    order = np.lexsort((np.arange(len(keys)), keys[:, 1], keys[:, 0]))
    keys = keys[order]
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if len(keys) else np.zeros(0, np.int64)
    return counts[order[first]], order, np.append(first, len(keys))


def _spread(picked: np.ndarray, order: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of each picked vector, and which pick they are of."""
    sizes = (edges[1:] - edges[:-1])[picked]
    return order[np.repeat(edges[picked] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())], np.repeat(np.arange(len(picked)), sizes)


def _searched(group: pa.Table) -> pa.Table:
    query = group.column("query").combine_chunks()
    mine, words = group.filter(query), group.filter(pc.invert(query))
    words = words.take(pc.sort_indices(words, [("n", "descending"), ("word", "ascending")]))
    names, often = words.column("word").to_pylist(), words.column("n").to_numpy()
    codes = letters_of(names)
    points, order, edges = _classes(vectors(codes))
    tree, asked = Tree(points), mine.column("word").to_pylist()
    total, best = np.zeros(len(asked), np.int64), np.full(len(asked), len(names), np.int64)
    part = max(1, 8 * PART // codes.shape[1])
    for size, own, letters in by_length(asked):
        queries, its, begins = _classes(vectors(letters))
        for qv, pv in tree.near(packed(queries), *STEPS[codes.shape[1] - size]):
            for at in range(0, len(qv), 1024):
                q, pick = _spread(qv[at : at + 1024], its, begins)
                pick = pv[at : at + 1024][pick]
                ends = np.cumsum((edges[1:] - edges[:-1])[pick])
                low = 0
                while low < len(q):
                    high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + part, "right")))
                    w, which = _spread(pick[low:high], order, edges)
                    who = q[low:high][which]
                    fits = one_edit(letters[who], codes[w])
                    who, w = own[who[fits]], w[fits]
                    total += np.bincount(who, minlength=len(total))
                    np.minimum.at(best, who, w)
                    low = high
    hit = np.flatnonzero(total)
    return pa.table({"word": mine.column("word").take(pa.array(hit)), "n_near": total[hit], "best_n": often[best[hit]], "best": pa.array([names[k] for k in best[hit].tolist()], pa.string())})


def near_words(words: DataFrame, leaf: int = LEAF) -> DataFrame:
    """For each of the distinct ``word``s with ``n`` that has near ones: ``n_near``, and ``best`` with ``best_n``. ``words`` is read several times."""
    spark, total = words.sparkSession, words.count()
    share = min(1.0, SAMPLE / 2 / max(1, total))
    sample = [r[0] for r in words.select("word").filter(F.xxhash64("word") % 1_000_000 < int(share * 1_000_000)).limit(SAMPLE).collect()] if share < 1 else [r[0] for r in words.select("word").collect()]  # SAMPLE / 2 at most
    cuts = spark.sparkContext.broadcast(Cuts(sample, total, leaf))
    dealt = materialize(words.mapInArrow(_dealt(cuts), "leaf long, query boolean, word string, n long"), "leaves")
    blocks = lambda of: F.ceil(F.count(F.when(F.col("query") == of, 1)) / F.lit(4 * leaf)).cast("int")
    shape = F.broadcast(dealt.groupBy("leaf").agg(blocks(False).alias("parts"), blocks(True).alias("turns")).filter("parts > 0 AND turns > 0"))  # a row a leaf or length
    block = F.pmod(F.xxhash64("word"), F.when(F.col("query"), F.col("turns")).otherwise(F.col("parts")))
    other = F.sequence(F.lit(0), F.when(F.col("query"), F.col("parts")).otherwise(F.col("turns")) - 1)
    placed = dealt.join(shape, "leaf").select("leaf", "query", "word", "n", block.cast("int").alias("own"), F.explode(other).alias("met"))
    placed = placed.select("leaf", F.when(F.col("query"), F.col("met")).otherwise(F.col("own")).alias("part"), F.when(F.col("query"), F.col("own")).otherwise(F.col("met")).alias("turn"), "query", "word", "n")
    found = placed.groupBy("leaf", "part", "turn").applyInArrow(_searched, "word string, n_near long, best_n long, best string")
    first = F.struct((-F.col("best_n")).alias("minus"), F.col("best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(first).alias("m")).select("word", "n_near", F.col("m.best").alias("best"), (-F.col("m.minus")).alias("best_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """Follows ``form`` (null at the end) by doubling: each round joins every word's reach with that of the word it reaches."""
    reach = materialize(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "reach")
    while True:
        ahead = reach.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = materialize(reach.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "reach")
        reach = step.select("word", "root")
        if not step.filter("moved").limit(1).count():
            return reach


def group_variants(df: DataFrame, id_column: str = "doc_id", text: str = "text", letters: int = LETTERS, least: int = LEAST, slips: bool = False, leaf: int = LEAF) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root`` of all words of the texts."""
    words = materialize(count_words(df, id_column, text, letters, least, slips), "words")
    near = near_words(words, leaf)
    joined = words.join(near, "word", "left")
    better = F.col("best_n") >= 2 * F.col("n")
    forms = materialize(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(better, F.col("best")).alias("form"), F.when(better, F.col("best_n")).alias("form_n")), "forms")
    return forms.join(_roots(forms), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
