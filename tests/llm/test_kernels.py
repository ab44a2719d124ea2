"""Numpy kernels against plain Python."""

import math
import os
import random
import sys

import numpy as np
import pyarrow as pa

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import plain  # noqa: E402
from watchloom.llm import kernel, lm, ngram_join, passages, quality, tokenizer  # noqa: E402
from watchloom.llm.bpe_chunks import _cut, decode_ids, encode_column  # noqa: E402
from watchloom.llm.queries import word_bpe  # noqa: E402

TEXTS = [
    None, "", "  \n\t ", "one", "a b c d", "A b C d E", "a b c d e f a b c d e f", "x y\nx y\n\n\nx y\r\n z", "É ÀB ñ # $5 <a|b>",
    "don't stop <|endoftext|> Ünï ́ x ́y ﬁ \u00a0 z\x1cq", "日本語 テスト 日本語 テスト 日本語 テスト 日本語 テスト", "w " * 300,
]


def test_words_and_hashes():
    data, offsets = kernel.texts(pa.array(TEXTS))
    starts, ends, counts = kernel.words(data, offsets)
    hashes, raw = kernel.word_hashes(data, starts, ends), data.tobytes()
    assert np.diff(counts).tolist() == [len(plain.words(t)) for t in TEXTS]
    found = [raw[s:e].decode() for s, e in zip(starts, ends, strict=True)]
    assert found == [w for t in TEXTS for w in plain.words(t)]
    assert len(set(hashes.tolist())) == len(set(found))
    lowered = kernel.word_hashes(data, starts, ends, lower=True)
    assert len(set(lowered.tolist())) == len({plain.lower(w) for w in found})


def test_a_word_longer_than_a_block():
    long = "x" * (3 << 20)
    data, offsets = kernel.texts(pa.array([long + " a", long + " b " + long]))
    starts, ends, counts = kernel.words(data, offsets)
    h = kernel.word_hashes(data, starts, ends)
    assert h[0] == h[2] == h[4] and len(set(h.tolist())) == 3 and counts.tolist() == [0, 2, 5]


def test_sliced_and_null_arrays():
    data, offsets = kernel.texts(pa.array(["zz", "a b", None, "c"])[1:])
    assert data.tobytes() == b"a bc" and offsets.tolist() == [0, 3, 3, 4]
    parts = [b.column("t").to_pylist() for b in kernel.slices(pa.RecordBatch.from_arrays([pa.array(["aaaa", "b", None, "c" * 50])], ["t"]), "t", 5)]
    assert [x for p in parts for x in p] == ["aaaa", "b", None, "c" * 50] and len(parts) > 1


def test_shingle_sets():
    hashes, rows, n, marks = ngram_join.signatures(pa.array(TEXTS))
    assert n.tolist() == [len(plain.shingles(t)) for t in TEXTS] and len(hashes) == n.sum() == len(rows)
    assert marks[0] == marks[1] == marks[2] and len(set(marks[3:].tolist())) == len(TEXTS) - 3


def test_equal_shards_count_once():
    text = " ".join(f"w{k}" for k in range(300))
    batch = pa.RecordBatch.from_arrays([pa.array([text, text + " end", "a b c d e f"])], ["text"])
    for module, answered, kept in ((ngram_join, ngram_join._counted, ngram_join._nodes), (passages, passages._answered, passages._shared)):
        seen = []
        for batches in ([batch], [batch, batch]):
            sent = pa.Table.from_batches(list(module._sent(6)(iter(batches)))).to_pylist()
            keys = sorted({r["key"] for r in sent})
            back = pa.concat_tables([answered(pa.Table.from_pylist([r for r in sent if r["key"] == k], module._schema(module._SENT))) for k in keys])
            seen.append(kept(back).to_pylist())
        assert seen[0] and {r["node"] for r in seen[0]} <= {r["node"] for r in seen[1]}
        again = [r for r in seen[1] if r["node"] in {x["node"] for x in seen[0]}]
        if module is ngram_join:
            assert all(len(r["tokens"]) == len(set(r["tokens"])) for r in again)
        else:
            assert len({str(r) for r in seen[1]}) == len(seen[1])


def test_quality_counts():
    got = quality.counts_of(pa.array(TEXTS))
    for k, text in enumerate(TEXTS):
        assert tuple(int(got[c][k]) for c in quality.COUNTS[:5]) == plain.quality_counts(text)
    assert quality.counts_of(pa.array([], pa.string()))["n_words"].tolist() == []


def test_binomial_tail_is_exact():
    for k, n, p in ((0, 50, 0.02), (3, 200, 0.01), (40, 1000, 0.03), (10, 10, 0.5)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(quality.tail(k, n, p) - want) < 1e-9
    assert quality.choose(2000, 100, [0, 1, 500], [10, 90, 100], 0.004, 0.01) == 1
    assert quality.choose(2000, 100, [0, 0, 0, 1], [10, 99, 100, 100], 0.004, 0.01) == 2
    assert quality.choose(20, 100, [0, 0], [50, 60], 0.004, 0.01) is None
    assert quality.choose(2000, 100, [0], [0], 0.004, 0.01) is None


def test_compact_windows():
    rng = np.random.default_rng(3)
    values, before = rng.integers(0, 2**63, 900).astype(np.uint64), np.array([0, 300, 300, 340, 900])
    left, pivot, right = passages.compact_windows(values, before)
    want = set()
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        for c in range(a, b):
            low, high = c, c
            while low > a and values[low - 1] > values[c]:
                low -= 1
            while high < b - 1 and values[high + 1] >= values[c]:
                high += 1
            if high - low + 1 >= passages.LEAST:
                want.add((low, c, high))
    assert set(zip(left.tolist(), pivot.tolist(), right.tolist(), strict=True)) == want and want
    assert passages.compact_windows(np.ones(2000, np.uint64), np.array([0, 2000]))[1].size < 100  # ties


def test_encoding_equals_the_library():
    path = word_bpe()
    library = tokenizer.load(path)
    random.seed(5)
    many = TEXTS + [" ".join(random.choices([w for t in TEXTS for w in plain.words(t)], k=400)) for _ in range(6)]
    column = pa.array(many + many)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in many + many]
    ids, before = tokenizer.encoder(path).encode(column)
    assert [ids[a:b].tolist() for a, b in zip(before[:-1], before[1:], strict=True)] == want
    data, starts, ends, _, _, bounds, keys = _cut(column)
    known, at, n = np.unique(keys, return_index=True, return_counts=True)
    raw, at = data.tobytes(), at[n > 1]
    coded = [library.encode(raw[starts[bounds[k]] : ends[bounds[k + 1] - 1]].decode(), add_special_tokens=False).ids for k in at]
    shared = (known[n > 1], np.concatenate([[0], np.cumsum([len(c) for c in coded])]), np.array([i for c in coded for i in c], np.int32))
    assert len(coded) > 10
    ids, before = encode_column(column, path, shared)
    got = [ids[a:b].tolist() for a, b in zip(before[:-1], before[1:], strict=True)]
    assert got == want
    assert [decode_ids(g, path).decode() for g in got] == [library.decode(w, skip_special_tokens=False) for w in want]


def test_filter_never_forgets_a_count():
    rng = np.random.default_rng(1)
    keys, counts = rng.integers(0, 2**63, 3000).astype(np.uint64) << np.uint64(1), rng.integers(1, 5000, 3000)
    shift, parts = 58, []
    for bucket in range(64):
        own = (keys >> np.uint64(shift)) == bucket
        bits, size = lm.segment(keys[own], counts[own], 10**7)
        parts.append({"bucket": bucket << 1, "n": size, "a": bits})
    model = lm.Filter(pa.Table.from_pylist(parts), 6, 10, 10)
    told = model.counts(keys, 0)
    level = np.floor(np.log2(counts)) + 1
    assert (told >= 1.5 * 2 ** (level - 1) - 0.5).all()  # false positives only raise
    assert (told <= 2 * counts).mean() > 0.95
    other = rng.integers(0, 2**63, 3000).astype(np.uint64) << np.uint64(1)
    assert (model.counts(other, 0) > 0).mean() < 0.05


def _plain_verify(a, b):
    """The passage of two regions by plain loops over one pair."""
    in_a, in_b = np.isin(a, b), np.isin(b, a)
    if in_a.sum() < passages.LEAST // 2:
        return None
    for gap in passages.GAPS:
        ends = []
        for matched in (in_a, in_b):
            spots = np.flatnonzero(matched)
            cuts = np.flatnonzero(np.diff(spots) > gap + 1)
            low, high = spots[np.concatenate([[0], cuts + 1])], spots[np.append(cuts, len(spots) - 1)]
            k = int(np.argmax(high - low))
            ends += [int(low[k]), int(high[k])]
        if min(ends[1] - ends[0], ends[3] - ends[2]) + 1 < passages.LEAST:
            return None
        x, y = set(a[ends[0] : ends[1] + 1].tolist()), set(b[ends[2] : ends[3] + 1].tolist())
        if 4 * len(x & y) >= 3 * len(x | y):
            return tuple(ends)
    return None


def test_passages_of_many_pairs_are_verified_at_once():
    rng, pairs = np.random.default_rng(11), [(np.zeros(0, np.uint32), np.zeros(0, np.uint32)), (np.full(60, 7, np.uint32), np.full(50, 7, np.uint32))]
    for k in range(400):
        a = rng.integers(0, 2**32 if k % 3 else 40, rng.integers(1, 139)).astype(np.uint32)
        b = np.concatenate([rng.integers(0, 2**32, rng.integers(0, 40)).astype(np.uint32), a])[-138:]
        for at in rng.integers(0, len(b), rng.integers(0, 5)):
            b[at : at + 1 + k % 9] = rng.integers(0, 2**32, dtype=np.uint32)
        pairs.append((a, np.delete(b, rng.integers(0, len(b), k % 4))))
    side = lambda i: (np.concatenate([p[i] for p in pairs]), np.array([len(p[i]) for p in pairs]))
    hit, bounds = passages.verify(*side(0), *side(1))
    want = [_plain_verify(*p) if len(p[0]) and len(p[1]) else None for p in pairs]
    assert [tuple(bounds[:, k].tolist()) if hit[k] else None for k in range(len(pairs))] == want
    assert 50 < sum(w is not None for w in want) < 380


def test_seeds_of_a_bucket(monkeypatch):
    rng, names = np.random.default_rng(12), ("u", "v", "fn", "xl", "xc", "xr", "yl", "yc", "yr")
    n = 600
    xc, yc = rng.integers(0, 500, n), rng.integers(0, 500, n)
    wide = [rng.integers(10, 90, n) for _ in range(4)]
    rows = list(zip(*(x.tolist() for x in (rng.integers(-2, 1, n), rng.integers(1, 4, n), rng.integers(0, 4, n), xc - wide[0], xc, xc + wide[1], yc - wide[2], yc, yc + wide[3])), strict=True))
    want = {}
    for a in rows:
        for b in rows:
            near = a[:2] == b[:2] and a[2] != b[2] and abs(a[7] // passages.LEAST - b[7] // passages.LEAST) < 2
            fits = (max(a[k], b[k]) <= min(a[k + 1], b[k + 1]) and max(a[k + 1], b[k + 1]) <= min(a[k + 2], b[k + 2]) and min(a[k + 2], b[k + 2]) - max(a[k], b[k]) + 1 >= passages.LEAST for k in (3, 6))
            if near and all(fits):
                key = (*a[:2], a[4] // passages.LEAST, a[7] // passages.LEAST)
                want[key] = min(want.get(key, (a[7], a[4])), (a[7], a[4]))
    for step in (passages.STEP, 50):
        monkeypatch.setattr(passages, "STEP", step)
        got = passages._seeded(pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in rows + rows[:9]])).to_pylist()
        assert len(got) == len(want) > 20
        assert {(r["u"], r["v"], r["grid_u"], r["grid_v"]): (r["at_v"], r["at_u"]) for r in got} == want


def _regions(rng, n):
    """Regions of edited copies, unlike texts with a common line, and texts that repeat a few words."""
    base, line, out = rng.integers(0, 2**32, 138).astype(np.uint32), rng.integers(0, 2**32, 12).astype(np.uint32), []
    for k in range(n):
        own = rng.integers(0, 2**32, rng.integers(60, 139)).astype(np.uint32)
        if k % 3 == 0:
            own = np.roll(base, int(rng.integers(-20, 20)))
            for at in rng.integers(0, 138, k % 4):
                own[at : at + 5] = rng.integers(0, 2**32, len(own[at : at + 5]))
        elif k % 3 == 1:
            own[20:32] = line
        else:
            own = np.repeat(base[rng.integers(0, 6, 6)], rng.integers(10, 23, 6))
        out.append(own)
    return out


def _plain_pairs(regions, pairs):
    found = {}
    for i, j in pairs:
        if spans := _plain_verify(regions[i], regions[j]):
            low = spans[0], spans[2]
            found[i, j] = (low[0], spans[1] + passages.WIDTH, low[1], spans[3] + passages.WIDTH)
    return found


def test_open_groups_hand_on_texts_and_not_pairs(monkeypatch):
    rng, n = np.random.default_rng(13), 60
    regions = _regions(rng, n)
    node, bare, part = np.arange(n) - 20, rng.random(n) < 0.6, rng.integers(0, 3, n)
    groups = [[g for g in (1, 2, 3) if g == 1 or (k + g) % 2] for k in range(n)]  # a pair may share several groups
    own = np.arange(n) % 2
    rows = []
    for low, high in ((0, 0), (0, 1), (1, 1)):  # two blocks of one home, as three tasks get them
        for k in range(n):
            if own[k] in (low, high):
                rows.append({"home": 5, "low": low, "high": high, "side": bool(own[k] > low), "node": int(node[k]), "grid": 0, "part": int(part[k]), "groups": groups[k], "bare": [bool(bare[k])] * len(groups[k]), "tokens": regions[k].tobytes()})
    group = pa.Table.from_pylist(rows[::-1])
    group = group.append_column("key", pa.array([0] * len(rows)))
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if bare[i] or bare[j] or part[i] != part[j]]
    want = _plain_pairs(regions, pairs)
    links = {k: k for k in range(n)}
    for _ in range(n):
        for i, j in want:
            links[i] = links[j] = min(links[i], links[j])
    for step in (passages.STEP, 300, 7):
        monkeypatch.setattr(passages, "STEP", step)
        monkeypatch.setattr(passages, "AREA", step)
        listed = passages._compared(group, True).to_pylist()
        assert len(listed) == len(want) > 3 * n
        assert {(r["u"] + 20, r["v"] + 20): (r["u_low"], r["u_high"], r["v_low"], r["v_high"]) for r in listed} == want
        told = passages._compared(group, False).to_pylist()
        assert len(told) <= 2 * n  # a row for a text and span, however many pairs
        assert {r["node"] + 20: r["link"] + 20 for r in told} == {k: links[k] for ij in want for k in ij}
        inside = lambda k, at: any(r["node"] + 20 == k and r["low"] <= at < r["high"] for r in told)
        for k in range(0, n, 7):
            spans = [s[2 * (k == j) : 2 * (k == j) + 2] for (i, j), s in want.items() if k in (i, j)]
            assert [inside(k, at) for at in range(150)] == [any(a <= at < b for a, b in spans) for at in range(150)]


def test_pairs_left_out_early_have_no_passage():
    regions = _regions(np.random.default_rng(14), 90)
    sizes = np.array([len(r) for r in regions])
    u, v = (x.ravel() for x in np.meshgrid(np.arange(90), np.arange(90), indexing="ij"))
    keep = passages._likely(u, v, *passages._sketches(np.concatenate(regions), sizes))
    assert keep.sum() < 0.8 * len(u)
    assert not any(_plain_verify(regions[i], regions[j]) for i, j in zip(u[~keep], v[~keep], strict=True))
