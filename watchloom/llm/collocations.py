r"""Phrase collocations by stripes: each prefix keys an associative counter of its next words.

Texts (A-Z lower-cased) are split at ``[.,;:!?\x0A-\x0D]`` into pieces and those into words ``[^\x20\x09]+``; all
counts are per language. A part of the texts builds the stripes of its prefixes; equal stripes of all parts are
merged elementwise:

* the empty prefix: its stripe counts words, its total is the language's ``n``;
* one word: the counts of two-word phrases;
* two words: the counts of three-word phrases, and with them the maxima that subsume shorter phrases.

Stripes travel packed: a part sends, for each bucket it has cells for, the prefixes, the stripes' lengths, the
next words and the counts. A bucket is a range of the prefix's hash and is sized by the text (``BUCKET`` bytes
of text each). A word so frequent that its stripes alone could fill a bucket (more than the mean count a bucket;
there are never more such words than buckets) has each stripe dealt over up to 64 buckets by next word. So no
bucket grows with one prefix, and each cell is summed in one place.

A phrase can't be more frequent than its parts. Before stripes of longer prefixes are built, the phrases of
``least`` or more occurrences go into a blocked Bloom filter of at most ``FILTER`` words of 64 bits; it only
spares work, as all counts are exact. Beyond some 25 million frequent phrases it lets more through.

A candidate has 2 to 3 words and ``a >= least``. Cut after its first ``k`` words it has ``l``, ``r`` and the score
``floor(1000000 * a * a / (l * r))``; the lowest cut counts, ties to the smallest ``k``. Products are exact in 38
digits (an error is raised beyond, at counts above 10^16). Candidates inside a longer candidate with ``100 * f >= share * a`` are dropped.

Words are compared by 64-bit hashes of word and language.

Defined cases: a null text is empty; a null language is ``und``; a language of empty text is one of its own.
Repeated rows count as often as they occur. Ties of score go to the larger ``a``, then to the smaller phrase in
byte order. Pieces and words of any length are taken whole. Other columns are not read. Without candidates the result is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchloom.llm import kernel
from watchloom.llm.common import quoted
from watchloom.llm.kernel import numbers, planes
from watchloom.llm.runs import byte_set, runs, strings
from watchloom.session import materialize

SLICE, BUCKET = 4 << 20, 8 << 20
LEAST, SHARE, TOP = 10, 50, 2000
FILTER, SEGMENTS = 1 << 22, 64
_CUT = byte_set((0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x21, 0x21), (0x3F, 0x3F), (0x0A, 0x0D))
_GAP = _CUT | byte_set((0x20, 0x20), (0x09, 0x09))
_ODD, _ODD_TOO = np.uint64(0xD1342543DE82EF95), np.uint64(0x9E3779B97F4A7C15)
_SENT = "bucket int, first binary, second binary, sizes binary, next binary, counts binary"


class Words:
    """The words of a part of the texts: distinct keys (of word and language) in order, each token's number among them, and where pieces begin."""

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = kernel.texts(batch.column("text"))
        gap = _GAP[data]
        self.data = data
        self.starts, self.ends, counts = runs(~gap, offsets)
        self.rows = np.searchsorted(counts, np.arange(len(self.starts)), "right") - 1
        langs, edges = kernel.texts(batch.column("lang"))
        of_lang = kernel.word_hashes(langs, edges[:-1], edges[1:])
        hashes = kernel.mix(kernel.word_hashes(data, self.starts, self.ends, lower=True) + of_lang[self.rows] * _ODD)
        self.keys, self.first, self.ids, self.counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        cuts = np.append(0, np.cumsum(_CUT[data]))[self.starts]
        self.opens = np.ones(len(self.starts), bool)
        self.opens[1:] = (cuts[1:] != cuts[:-1]) | (self.rows[1:] != self.rows[:-1])


def _worded(batches):
    for whole in batches:
        for batch in kernel.slices(whole, "text", SLICE):
            w = Words(batch)
            langs = batch.column("lang")
            total = np.bincount(w.rows, minlength=batch.num_rows)
            per = pa.table({"lang": langs, "n": total}).group_by("lang").aggregate([("n", "sum")])
            words = strings(w.data, w.starts[w.first], w.ends[w.first]).cast(pa.string())
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(w.rows[w.first])), words, pa.array(w.keys.view(np.int64)), pa.array(w.counts)], ["lang", "word", "key", "n"])
            yield pa.RecordBatch.from_arrays([per["lang"].combine_chunks(), pa.nulls(len(per), pa.string()), pa.nulls(len(per), pa.int64()), per["n_sum"].combine_chunks()], ["lang", "word", "key", "n"])


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return kernel.mix(first * _ODD + second * _ODD_TOO)


class Filter:
    """A blocked Bloom filter; ``rows`` has the words of it that aren't zero."""

    def __init__(self, bits: int, rows: pa.Table):
        self.shift, self.field = np.uint64(64 - bits), np.zeros(1 << bits, np.uint64)
        self.field[rows.column("at").to_numpy()] = rows.column("mask").to_numpy().view(np.uint64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        mask = np.zeros(len(keys), np.uint64)
        for k in (0, 6, 12, 18):
            mask |= np.uint64(1) << ((keys >> np.uint64(k)) & np.uint64(63))
        return self.field[(keys >> self.shift).astype(np.int64)] & mask == mask


def _filter(keys: DataFrame, n: int) -> Filter:
    """The filter of a column ``key``: each key sets four bits of one word of 64; words are combined where the keys are."""
    bits = max(6, min(FILTER, n * 12 // 64 + 1).bit_length())
    mask = " | ".join(f"shiftleft(1L, CAST(shiftright(key, {k}) & 63 AS INT))" for k in (0, 6, 12, 18))
    rows = keys.select(F.expr(f"shiftrightunsigned(key, {64 - bits})").alias("at"), F.expr(mask).alias("mask")).groupBy("at").agg(F.bit_or("mask").alias("mask"))
    return Filter(bits, rows.toArrow())  # 2 * FILTER words at most


def _stripes(bits: int, shared, longer: bool):
    """Stripes of one-word prefixes, or of two-word prefixes, in which all parts are frequent by the filter."""

    def run(batches):
        frequent, hot = shared.value
        for whole in batches:
            for batch in kernel.slices(whole, "text", SLICE):
                w = Words(batch)
                n, goes_on = len(w.keys), ~w.opens[1:]
                if not longer:
                    usual = frequent.has(w.keys)[w.ids]
                    at = np.flatnonzero(goes_on & usual[:-1] & usual[1:])
                    heads, prefix, next_ = (w.keys, np.zeros(0, np.uint64)), w.ids[at], w.ids[at + 1]
                    hashes, is_hot = w.keys, np.isin(w.keys, hot)
                else:
                    at = np.flatnonzero(goes_on)
                    pairs, which = np.unique(w.ids[at] * n + w.ids[at + 1], return_inverse=True)
                    first, second = w.keys[pairs // n], w.keys[pairs % n]
                    hashes = _pair(first, second)
                    usual = np.full(len(w.ids), -1, np.int64)
                    usual[at] = np.where(frequent.has(hashes), np.arange(len(pairs)), -1)[which]
                    at = np.flatnonzero((usual[:-1] >= 0) & (usual[1:] >= 0))
                    heads, prefix, next_, is_hot = (first, second), usual[at], w.ids[at + 2], np.isin(first, hot)
                cells, counts = np.unique(prefix * n + next_, return_counts=True)
                prefix, next_ = cells // max(1, n), w.keys[cells % max(1, n)]
                dealt = hashes[prefix]
                split = is_hot[prefix]
                dealt[split] = kernel.mix(dealt[split] + (next_[split] % np.uint64(SEGMENTS)) * _ODD_TOO)
                bucket = (dealt >> np.uint64(64 - bits)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                bucket, prefix, next_, counts = bucket[order], prefix[order], next_[order], counts[order].astype(np.uint32)
                begins = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = [*begins[1:].tolist(), len(order)] if len(order) else []
                new = (np.diff(prefix, prepend=-1) != 0) | (np.diff(bucket, prepend=-1) != 0)
                out = []
                for i, j in zip(begins.tolist(), ends, strict=True):
                    opens = np.flatnonzero(new[i:j])
                    own = prefix[i:j][opens]
                    sizes = np.diff(opens, append=j - i).astype(np.uint32)
                    second = planes(heads[1][own]) if longer else b""
                    out.append((int(bucket[i]), planes(heads[0][own]), second, planes(sizes), planes(next_[i:j]), planes(counts[i:j])))
                kinds = [pa.int32(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(6)], ["bucket", "first", "second", "sizes", "next", "counts"])

    return run


def _merged(least: int, longer: bool):
    """Stripes of a bucket merged elementwise; cells of ``least`` or more."""

    def run(group: pa.Table) -> pa.Table:
        parts = {c: [x.as_py() for x in group.column(c)] for c in ("first", "second", "sizes", "next", "counts")}
        sizes = [numbers(x, np.uint32) for x in parts["sizes"]]
        spread = lambda c: np.concatenate([np.repeat(numbers(x, np.uint64), s) for x, s in zip(parts[c], sizes, strict=True)])
        first = spread("first")
        second = spread("second") if longer else first
        next_, counts = np.concatenate([numbers(x, np.uint64) for x in parts["next"]]), np.concatenate([numbers(x, np.uint32) for x in parts["counts"]])
        cells = _pair(_pair(first, second), next_)
        _, at, back = np.unique(cells, return_index=True, return_inverse=True)
        total = np.bincount(back, counts).astype(np.int64)
        often = np.flatnonzero(total >= least)
        at = at[often]
        words = (first, second, next_) if longer else (first, next_)
        return pa.table([*(pa.array(x[at].view(np.int64)) for x in words), pa.array(total[often])], [*(f"w{k}" for k in range(1, len(words) + 1)), "f"])

    return run


def count_phrases(df: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Merged stripes as tables: totals ``(lang, n)``, words ``(lang, word, key, f)``, two-word phrases ``(w1, w2, f)`` and
    three-word phrases ``(w1, w2, w3, f)`` by keys; counts of ``least`` or more."""
    spark = df.sparkSession
    rows = df.select(F.coalesce(F.col(quoted(lang)).cast("string"), F.lit("und")).alias("lang"), F.col(quoted(text)).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, int(size // BUCKET).bit_length())
    counted = rows.mapInArrow(_worded, "lang string, word string, key long, n long").groupBy("lang", "word", "key").agg(F.sum("n").alias("f"))
    counted = materialize(counted.filter(F.col("word").isNull() | (F.col("f") >= least)), "words")
    totals = counted.filter("word IS NULL").select("lang", F.col("f").alias("n"))
    words = counted.filter("word IS NOT NULL")
    every = totals.agg(F.sum("n")).first()[0] or 0
    hot = words.filter(F.col("f") > every >> bits).select("key").toArrow().column(0).to_numpy().view(np.uint64)  # 2 ** bits words at most
    shared = spark.sparkContext.broadcast((_filter(words, words.count()), hot))
    two = materialize(rows.mapInArrow(_stripes(bits, shared, False), _SENT).groupBy("bucket").applyInArrow(_merged(least, False), "w1 long, w2 long, f long"), "two-words")
    pairs = two.mapInArrow(_paired, "key long")
    shared = spark.sparkContext.broadcast((_filter(pairs, two.count()), hot))
    three = materialize(rows.mapInArrow(_stripes(bits, shared, True), _SENT).groupBy("bucket").applyInArrow(_merged(least, True), "w1 long, w2 long, w3 long, f long"), "three-words")
    return totals, words, two, three


def _paired(batches):
    for batch in batches:
        first, second = (batch.column(c).to_numpy().view(np.uint64) for c in ("w1", "w2"))
        yield pa.RecordBatch.from_arrays([pa.array(_pair(first, second).view(np.int64))], ["key"])


def mine_collocations(df: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: each language's ``top`` phrases."""
    totals, words, two, three = count_phrases(df, lang, text, least)
    longest = three.select("w1", "w2", "f").union(three.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "f")).groupBy("w1", "w2").agg(F.max("f").alias("longer"))
    word = lambda k: words.select(F.col("key").alias(f"w{k}"), F.col("word").alias(f"t{k}"), F.col("f").alias(f"f{k}"), *([F.col("lang")] if k == 1 else []))
    pair = lambda i, j: two.select(F.col("w1").alias(f"w{i}"), F.col("w2").alias(f"w{j}"), F.col("f").alias(f"f{i}{j}"))
    open_ = two.withColumnRenamed("f", "a").join(longest, ["w1", "w2"], "left").filter(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    pairs = open_.join(word(1), "w1").join(word(2), "w2").select("lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", F.array(F.struct(F.col("f1").alias("l"), F.col("f2").alias("r"))).alias("cuts"))
    triples = three.withColumnRenamed("f", "a").join(pair(1, 2), ["w1", "w2"]).join(pair(2, 3), ["w2", "w3"]).join(word(1), "w1").join(word(2), "w2").join(word(3), "w3")
    cuts = F.array(F.struct(F.col("f1").alias("l"), F.col("f23").alias("r")), F.struct(F.col("f12").alias("l"), F.col("f3").alias("r")))
    triples = triples.select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", cuts.alias("cuts"))
    exact = "CAST(a AS DECIMAL(20,0)) * CAST(a AS DECIMAL(20,0)) * CAST(1000000 AS DECIMAL(7,0)) DIV (CAST(c.l AS DECIMAL(20,0)) * CAST(c.r AS DECIMAL(20,0)))"
    scored = pairs.union(triples).withColumn("best", F.expr(f"array_min(transform(cuts, (c, k) -> struct({exact} AS score, k AS k, c.l AS l, c.r AS r)))"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.select("lang", "phrase", "a", "best.l", "best.r", "best.score").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
