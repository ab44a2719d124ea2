"""Language-model scores from a log-frequency Bloom filter.

Documents of the training part are cut into words; each text ends with an end token. Counts of words and of
word pairs are combined inside shards of text, sent to buckets of the hash range, and summed there. A count
``c`` is quantised to the level ``1 + floor(log2 c)``; an n-gram of level ``q`` enters the filter once for
each level from 1 to ``q``. Each bucket builds its own segment, so segments are made where the counts are; the
whole filter has at most ``MAX_BITS`` bits whatever the corpus (its false-positive rate grows beyond that),
and only it is broadcast. A reader probes levels until one is absent; a pair is at most as frequent as its
words, so pairs of unknown words cost no probe and can't be false positives. The probability of a word is

    (c(v, w) + PRIOR * p(w)) / (c(v) + PRIOR),   p(w) = (c(w) + 1) / (N + V + 1)

with counts as the filter tells them, ``N`` training tokens and ``V`` distinct ones; the first word follows
the end token. The plain score with exact counts is computed beside it: words and counts go back to the
shards, no table of words is broadcast.

Defined cases: a null text is empty and has the end token only. A null id counts as empty text for the
split. Repeated rows are counted as often as they occur and get equal scores. Words are compared by 64-bit hashes
after lower-casing A-Z. An empty table gives an empty result; without training documents N and V are 0.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm import kernel
from watchloom.llm.common import order_id, quoted
from watchloom.llm.kernel import numbers, planes
from watchloom.session import materialize

SLICE, BUCKET = 2 << 20, 4 << 20
FOLDS, HELD = 7, 2
BITS, PROBES, MAX_BITS = 10, 6, 800_000_000
LEVELS, PRIOR = 40, 8.0
_END = kernel.mix(np.array([0x5851F42D4C957F2D], np.uint64))[0]
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SENT = "key long, shard long, a binary, b binary, c binary, d binary, e binary"
_BACK = "shard long, bucket int, kind int, a binary, b binary, c binary, d binary, e binary, n long, v long"


def held_out(ids: list) -> np.ndarray:
    """The split: by the checksum of the id's decimal text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS == HELD for i in ids], bool)


def tokens(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens with end tokens, each one's row, and a hash of each row's tokens."""
    data, offsets = kernel.texts(column)
    starts, ends, counts = kernel.words(data, offsets)
    hashes = np.insert(kernel.word_hashes(data, starts, ends, lower=True), counts[1:], _END)
    sizes = np.diff(counts) + 1
    rows = np.repeat(np.arange(len(sizes)), sizes)
    place = (np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint64)
    marks = np.add.reduceat(kernel.mix(hashes + place * _GOLD), np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0, np.uint64)
    return hashes, rows, marks


def pairs(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A 48-bit hash (in the high bits) of every token with the one before it."""
    before = np.concatenate([[_END], hashes[:-1]]) if len(hashes) else hashes
    before[np.flatnonzero(np.diff(rows, prepend=-1))] = _END
    return kernel.mix(before * np.uint64(0xD1342543DE82EF95) + hashes) & ~np.uint64(0xFFFF)


def _sent(bits: int):
    """A shard is numbered by its partition and place in it, as equal texts can fill several shards. A repeated task
    may cut other shards, so what it sent is written before it is grouped."""

    def run(batches):
        task = TaskContext.get()
        shard = (task.partitionId() if task else 0) << 32
        for whole in batches:
            for batch in kernel.slices(whole, "text", SLICE):
                ids = batch.column("doc_id").to_pylist()
                hashes, rows, marks = tokens(batch.column("text"))
                train = ~held_out(ids)[rows]
                known, back = np.unique(hashes, return_inverse=True)
                count = np.bincount(back[train], minlength=len(known)).astype(np.uint32)
                both, often = np.unique(pairs(hashes, rows)[train], return_counts=True)
                own = rows.astype(np.int64) * len(known) + back
                own, times = np.unique(own, return_counts=True)
                order = batch.column("order_id").to_numpy(zero_copy_only=False).astype(np.int64)
                out = [(-1 - shard, shard, planes(order), planes(marks), planes((own // len(known)).astype(np.uint32)), planes((own % len(known)).astype(np.uint32)), planes(times.astype(np.uint32)))]
                edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
                for kind, values, numbers_ in ((0, known, count), (1, both, often.astype(np.uint32))):
                    cuts = [*np.searchsorted(values, edges).tolist(), len(values)]
                    for bucket, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        if i < j:
                            out.append(((bucket << 1) + kind, shard, planes(values[i:j]), planes(numbers_[i:j]), b"", b"", b""))
                yield pa.RecordBatch.from_pylist([dict(zip(("key", "shard", *"abcde"), r, strict=True)) for r in out], _schema(_SENT))
                shard += 1

    return run


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in text.split(", "))])


def _positions(keys: np.ndarray, level: int, bits) -> list[np.ndarray]:
    h = kernel.mix(keys + np.uint64(level * int(_GOLD) % 2**64))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [(h + np.uint64(j) * step) % bits for j in range(PROBES)]


def segment(keys: np.ndarray, counts: np.ndarray, most: int) -> tuple[bytes, int]:
    """Bits of a segment that holds each key once a level, and how many bits it has."""
    levels = np.floor(np.log2(counts)).astype(np.int64) + 1
    bits = int(max(64, min(most, BITS * int(levels.sum()))))
    field = np.zeros(bits, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for at in _positions(keys[levels >= level], level, np.uint64(bits)):
            field[at.astype(np.int64)] = True
    return np.packbits(field, bitorder="little").tobytes(), bits


def _counted(most: int):
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        key = rows[0]["key"]
        blank = {"a": b"", "b": b"", "c": b"", "d": b"", "e": b"", "n": 0, "v": 0}
        known, counts = [numbers(r["a"], np.uint64) for r in rows], [numbers(r["b"], np.uint32) for r in rows]
        keys, back = np.unique(np.concatenate(known), return_inverse=True)
        total = np.bincount(back, np.concatenate(counts)).astype(np.int64)
        seen = total > 0
        bits, size = segment(keys[seen], total[seen], most)
        out = [blank | {"shard": None, "bucket": key, "kind": 2, "a": bits, "n": size, "v": 0}]
        if key % 2 == 0:
            out.append(blank | {"shard": None, "bucket": key, "kind": 3, "n": int(total.sum()), "v": int(seen.sum())})
            at = 0
            for r, h in zip(rows, known, strict=True):
                own = total[back[at : at + len(h)]]
                at += len(h)
                out.append(blank | {"shard": r["shard"], "bucket": key, "kind": 1, "a": planes(own)})
        return pa.Table.from_pylist(out, _schema(_BACK))

    return run


def _based(n: int, v: int):
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        own = next(r for r in rows if r["kind"] == 0)
        counts = np.concatenate([numbers(r["a"], np.int64) for r in sorted((r for r in rows if r["kind"] == 1), key=lambda r: r["bucket"])])
        ids, marks = numbers(own["a"], np.int64), numbers(own["b"], np.uint64)
        docs, words, times = (numbers(own[x], np.uint32).astype(np.int64) for x in "cde")
        c = counts[words]
        logs = times * (np.log10(c + 1.0) - np.log10(n + v + 1.0))
        sums = [np.bincount(docs, w, len(ids)) for w in (times, np.where(c > 0, times, 0), logs)]
        return pa.table([pa.array(ids), pa.array(marks.view(np.int64)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2])], ["order_id", "mark", "n_tokens", "n_known", "base_score"])

    return run


class Filter:
    """The segments of all buckets in one array of bits."""

    def __init__(self, table: pa.Table, bits: int, n: int, v: int):
        self.shift, self.n, self.v = np.uint64(64 - bits), n, v
        self.sizes, self.begins = np.ones(2 << bits, np.uint64), np.full(2 << bits, -1, np.int64)
        raw, at = [], 0
        for bucket, size, part in zip(table.column("bucket").to_pylist(), table.column("n").to_pylist(), table.column("a"), strict=True):
            raw.append(np.frombuffer(part.as_buffer(), np.uint8))
            self.sizes[bucket], self.begins[bucket] = size, at
            at += 8 * len(raw[-1])
        self.raw = np.concatenate(raw) if raw else np.zeros(0, np.uint8)

    def counts(self, keys: np.ndarray, kind: int) -> np.ndarray:
        """Counts as the filter tells them: the middle of the highest level whose probes all hit."""
        bucket = ((keys >> self.shift) << np.uint64(1)).astype(np.int64) + kind
        begin, size = self.begins[bucket], self.sizes[bucket]
        levels, live = np.zeros(len(keys), np.int64), np.flatnonzero(begin >= 0)
        for level in range(1, LEVELS + 1):
            h = kernel.mix(keys[live] + np.uint64(level * int(_GOLD) % 2**64))
            step = (h >> np.uint64(32)) | np.uint64(1)
            for j in range(PROBES):
                at = begin[live] + ((h + np.uint64(j) * step) % size[live]).astype(np.int64)
                hit = (self.raw[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                live, h, step = live[hit], h[hit], step[hit]
            if not len(live):
                break
            levels[live] = level
        return np.where(levels > 0, 1.5 * 2.0 ** (levels - 1) - 0.5, 0.0)

    def scores(self, column) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability and token hash of each row."""
        hashes, rows, marks = tokens(column)
        known, back = np.unique(hashes, return_inverse=True)
        own = self.counts(known, 0)[back]
        first = np.diff(rows, prepend=-1) != 0
        before = np.concatenate([[0.0], own[:-1]]) if len(own) else own
        before[first] = self.counts(np.array([_END]), 0)[0]
        both, able = np.zeros(len(own)), (own > 0) & (before > 0)
        both[able] = self.counts(pairs(hashes, rows)[able], 1)
        both = np.minimum(both, np.minimum(own, before))
        alone = (own + 1.0) / (self.n + self.v + 1.0)
        logs = np.log10((both + PRIOR * alone) / (before + PRIOR))
        return np.bincount(rows, logs, len(marks)), marks


def _scored(model):
    def run(batches):
        for whole in batches:
            for batch in kernel.slices(whole, "text", SLICE):
                scores, marks = model.value.scores(batch.column("text"))
                ids = batch.column("doc_id")
                yield pa.RecordBatch.from_arrays([ids, batch.column("order_id"), pa.array(marks.view(np.int64)), pa.array(held_out(ids.to_pylist())), pa.array(scores)], ["doc_id", "order_id", "mark", "held_out", "score"])

    return run


def score_documents(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    rows = df.select(F.col(quoted(id_column)).cast("long").alias("doc_id"), order_id(quoted(id_column)).alias("order_id"), F.col(quoted(text)).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, int(size // BUCKET).bit_length())
    sent = materialize(rows.mapInArrow(_sent(bits), _SENT), "shards")
    back = materialize(sent.filter("key >= 0").groupBy("key").applyInArrow(_counted(MAX_BITS >> (bits + 1)), _BACK), "n-grams")
    totals = back.filter("kind = 3").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    segments = back.filter("kind = 2").select("bucket", "n", "a").toArrow()  # MAX_BITS at most
    model = df.sparkSession.sparkContext.broadcast(Filter(segments, bits, *totals))
    nothing = [F.lit(0).cast("long").alias(c) for c in ("n", "v")]
    own = sent.filter("key < 0").select("shard", F.lit(-1).alias("bucket"), F.lit(0).alias("kind"), *"abcde", *nothing)  # moved once, to meet their answers
    base = back.filter("kind = 1").unionByName(own).groupBy("shard").applyInArrow(_based(*totals), "order_id long, mark long, n_tokens long, n_known long, base_score double")
    base = base.groupBy("order_id", "mark").agg(*(F.first(c).alias(c) for c in ("n_tokens", "n_known", "base_score")))
    scored = rows.mapInArrow(_scored(model), "doc_id long, order_id long, mark long, held_out boolean, score double")
    return scored.join(base, ["order_id", "mark"]).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(totals[0])).cast("long").alias("train_tokens"), "base_score", "score")
