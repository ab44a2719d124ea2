"""BPE encoding with content-defined chunk reuse, and decoding.

Texts are cut between words where a rolling hash of the last ``SPAN`` words has ``BITS`` zero bits, so
equal passages are cut alike wherever they stand. Chunks are counted over all documents; those found in
more than one place are encoded once, and the ones that spare most (``MAX_CHUNKS`` and ``MAX_WORDS`` at
most) go to all workers as one table. Every other chunk, and every one beyond that bound, is encoded
where it stands, word by word. Where a reused chunk meets its neighbour, the words around the join are
encoded as one text; until that agrees with the two sides, more words are taken, at last both sides whole.

Defined cases: a null text is empty and has no ids. Rows are independent, so repeated rows, null ids and
ties get equal results; other columns are kept, apart from those the operator adds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm import kernel
from watchloom.llm.common import quoted
from watchloom.llm.tokenizer import encoder, gather, load

SLICE = 2 << 20
SPAN, BITS = 4, 5
MAX_CHUNKS, MAX_WORDS = 100_000, 3_000_000  # of the broadcast table: at most about 30 MB


def _chunks(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each chunk (and the total), and a hash of its words."""
    rolling, first = kernel.windows(hashes, counts, SPAN)
    cuts = first[(rolling >> np.uint64(64 - BITS)) == 0] + SPAN
    starts = np.unique(np.concatenate([counts[:-1][np.diff(counts) > 0], cuts[cuts < len(hashes)]])).astype(np.int64)
    if not len(starts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint64)
    bounds = np.append(starts, len(hashes))
    sizes = np.diff(bounds)
    place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(starts, sizes).astype(np.uint64)
    sums = np.add.reduceat(kernel.mix(hashes + place * np.uint64(0x9E3779B97F4A7C15)), starts)
    return bounds, kernel.mix(sums + sizes.astype(np.uint64))


def _cut(column):
    data, offsets = kernel.texts(column)
    starts, ends, counts = kernel.words(data, offsets)
    hashes = kernel.word_hashes(data, starts, ends)
    return data, starts, ends, counts, hashes, *_chunks(hashes, counts)


def _counted(batches):
    for whole in batches:
        for batch in kernel.slices(whole, "text", SLICE):
            *_, bounds, keys = _cut(batch.column("text"))
            found, at, n = np.unique(keys, return_index=True, return_counts=True)
            sizes = np.diff(bounds)[at] if len(keys) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n), pa.array(sizes)], ["key", "n", "words"])


def _selected(wanted):
    def run(batches):
        keys, seen = wanted.value, np.zeros(len(wanted.value), bool)
        for whole in batches:
            for batch in kernel.slices(whole, "text", SLICE):
                data, starts, ends, _, _, bounds, chunks = _cut(batch.column("text"))
                found, at = np.unique(chunks, return_index=True)
                place = np.searchsorted(keys, found)
                hit = (place < len(keys)) & ~seen[np.minimum(place, len(keys) - 1)] & (keys[np.minimum(place, len(keys) - 1)] == found)
                seen[place[hit]] = True
                at = at[hit]
                begin, end = starts[bounds[at]].tolist(), ends[bounds[at + 1] - 1].tolist()
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[hit].view(np.int64)), pa.array([raw[s:e].decode() for s, e in zip(begin, end, strict=True)], pa.string())], ["key", "text"]
                )

    return run


def _encoded_chunks(path: str):
    def run(batches):
        for batch in batches:
            ids, before = encoder(path).encode(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), lists], ["key", "ids"])

    return run


def shared_chunks(df: DataFrame, tokenizer: str, text: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (ascending), id offsets and ids of the chunks worth sharing; bounded by the limits above."""
    rows = df.select(F.col(quoted(text)).alias("text"))
    counts = rows.mapInArrow(_counted, "key long, n long, words long").groupBy("key").agg(F.sum("n").alias("n"), F.max("words").alias("words"))
    spared = (F.col("n") - 1) * F.col("words")
    best = counts.filter("n > 1").orderBy(spared.desc(), "key").limit(MAX_CHUNKS).select("key", "words").collect()
    sizes = np.cumsum([r["words"] for r in best])
    keys = np.sort(np.array([r["key"] for r, total in zip(best, sizes, strict=True) if total <= MAX_WORDS], np.int64).view(np.uint64))
    if not len(keys):
        return keys, np.zeros(1, np.int64), np.zeros(0, np.int32)
    context = df.sparkSession.sparkContext
    wanted = context.broadcast(keys)
    once = rows.mapInArrow(_selected(wanted), "key long, text string").groupBy("key").agg(F.min("text").alias("text"))
    coded = once.mapInArrow(_encoded_chunks(tokenizer), "key long, ids array<int>").toArrow().combine_chunks()
    found, lists = np.asarray(coded.column("key")).view(np.uint64), coded.column("ids").combine_chunks()
    order, offsets = np.argsort(found), np.asarray(lists.offsets, np.int64)
    sizes = np.diff(offsets)[order]
    return found[order], np.concatenate([[0], np.cumsum(sizes)]), gather(np.asarray(lists.values, np.int32), offsets[:-1][order], sizes)


def _agree(own, raw: bytes, starts, ends, join: int, low: int, high: int) -> bool:
    """Whether the texts on both sides of a join encode alone as they do together."""
    width = 1
    while True:
        a, b = max(low, join - width), min(high, join + width)
        left, right = raw[starts[a] : ends[join - 1]].decode(), raw[starts[join] : ends[b - 1]].decode()
        if own.ids(raw[starts[a] : ends[b - 1]].decode()) == own.ids(left) + own.ids(right):
            return True
        if a == low and b == high:
            return False
        width *= 4


def encode_column(column, path: str, shared) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows and the number of ids before each row."""
    own = encoder(path)
    keys, offsets, pool = shared
    data, starts, ends, counts, hashes, bounds, chunks = _cut(column)
    place = np.minimum(np.searchsorted(keys, chunks), max(0, len(keys) - 1))
    reused = keys[place] == chunks if len(keys) else np.zeros(len(chunks), bool)
    # Joins inside a row that touch a reused chunk; a chunk whose join doesn't hold is not reused.
    inner = np.flatnonzero(~np.isin(bounds[1:-1], counts)) + 1 if len(chunks) else np.zeros(0, np.int64)
    raw = data.tobytes() if reused.any() else b""
    for j in inner[reused[inner - 1] | reused[inner]].tolist():
        if not _agree(own, raw, starts, ends, int(bounds[j]), int(bounds[j - 1]), int(bounds[j + 1])):
            reused[j - 1] = reused[j] = False
    sizes = np.diff(bounds)
    alone = ~np.repeat(reused, sizes) if len(chunks) else np.zeros(0, bool)
    begin, size = own.runs(data, starts[alone], ends[alone], hashes[alone]) if alone.any() else (np.zeros(0, np.int64),) * 2
    # One unit for each word encoded here and each reused chunk, in text order.
    first = np.flatnonzero(reused)
    at = np.concatenate([np.flatnonzero(alone), bounds[first]])
    begin = np.concatenate([begin + len(pool), offsets[place[first]]])
    size = np.concatenate([size, offsets[place[first] + 1] - offsets[place[first]]])
    order = np.argsort(at, kind="stable")
    ids = gather(np.concatenate([pool, own.pool[: own.used]]), begin[order], size[order])
    before = np.concatenate([[0], np.cumsum(size[order])])
    return ids, before[np.searchsorted(at[order], counts)]


_TABLES: dict[str, tuple[list[bytes], list[bytes]]] = {}


def _strings(path: str) -> tuple[list[bytes], list[bytes]]:
    """Each id in decimal and as its token's bytes."""
    if path not in _TABLES:
        vocabulary = load(path)
        n = vocabulary.get_vocab_size(with_added_tokens=True)
        _TABLES[path] = [str(i).encode() for i in range(n)], [(vocabulary.id_to_token(i) or "").encode() for i in range(n)]
    return _TABLES[path]


def decode_ids(ids: list[int], path: str) -> bytes:
    """Text of a list of ids; a vocabulary file without a decoder joins its tokens by spaces."""
    return b" ".join(map(_strings(path)[1].__getitem__, ids))


def _apply(path: str, shared, digests: bool):
    def run(batches):
        for whole in batches:
            for batch in kernel.slices(whole, "text", SLICE):
                ids, before = encode_column(batch.column("text"), path, shared.value)
                if not digests:
                    tokens = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(ids, pa.int32()))
                    kept = [c for c in batch.schema.names if c != "text"]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), tokens], [*kept, "tokens"])
                    continue
                numbers, _ = _strings(path)
                coded, plain = [], []
                for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
                    own = ids[a:b].tolist()
                    coded.append(hashlib.sha256(b" ".join(map(numbers.__getitem__, own))).hexdigest())
                    plain.append(hashlib.sha256(decode_ids(own, path)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(before)), pa.array(coded), pa.array(plain)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_corpus(df: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """``doc_id`` and ``tokens``, or with ``digests`` the number of ids and hashes of ids and decoded text."""
    shared = df.sparkSession.sparkContext.broadcast(shared_chunks(df, tokenizer, text))
    rows = df.select(F.col(quoted(id_column)).cast("long").alias("doc_id"), F.col(quoted(text)).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, tokens array<int>"
    return rows.mapInArrow(_apply(tokenizer, shared, digests), schema)


def decode_corpus(df: DataFrame, tokenizer: str, id_column: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """``doc_id`` and the decoded ``text`` of lists of ids."""

    def run(batches):
        for batch in batches:
            texts = [decode_ids(ids, tokenizer).decode() if ids is not None else None for ids in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = df.select(F.col(quoted(id_column)).cast("long").alias("doc_id"), F.col(quoted(tokens)).alias("tokens"))
    return rows.mapInArrow(run, "doc_id long, text string")
