"""Every operator on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import glob
import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import plain  # noqa: E402
from watchloom.llm import bpe_chunks, decontaminate, lines, lm, ngram_join, passages, pii, quality, token_files, tokenizer, url_cascade  # noqa: E402
from watchloom.llm.components import connected_components  # noqa: E402
from watchloom.llm.queries import URL_RULES, word_bpe  # noqa: E402
from watchloom.session import scratch_path, shared_dir  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, n_words long, row_id string, node int, pii string, `a.b` string"


def prose(seed, n):
    rng = random.Random(seed)
    return [f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    base, shared = prose(1, 220), prose(2, 60)
    near = [*base[:100], "other", *base[101:]]
    far = [w if k % 9 else f"q{k}" for k, w in enumerate(base)]
    texts = [
        (0, " ".join(base)), (1, " ".join(near)), (2, " ".join(base)), (3, " ".join(far)), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "one"),
        (9, "a b c d"), (10, " ".join([*prose(3, 90), *shared, *prose(4, 80)])), (11, " ".join([*prose(5, 70), *shared, *prose(6, 50)])),
        (12, "l one\nl two\nl three\nl four\n\nl five"), (13, "x\nl one\nl two\nl three\ny"), (14, "l one\nl two\nl three\nl one\nl two\nl three"),
        (15, "mail ann.b@x-y.org or 10.0.0.300, 10.0.0.25; card 4111 1111 1111 1111 call +1 (202) 555-0123"), (16, " ".join(prose(7, 30000))),
        (None, " ".join(near)), (None, "tail"), (17, " ".join(base)), (17, " ".join(base)), (17, "another text of the id"),
    ]
    return [(i, t, None if k % 5 == 0 else "en", 3, "z", 1, "p", "d") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=str)


def test_ngram_join(docs, empty, rows):
    got = ngram_join.join_documents(docs).collect()
    assert by(got, "doc_id", "n_shingles", "component_id") == sorted(plain.components([r[:2] for r in rows]), key=str)
    assert ngram_join.join_documents(empty).count() == 0


def test_ngram_join_on_groups_of_edited_copies(spark):
    rng, base, out = random.Random(9), prose(11, 150), []
    for i in range(260):
        share = rng.choice((0.0, 0.01, 0.03, 0.05, 0.08))
        out.append((i, " ".join(f"e{i}x{k}" if rng.random() < share else w for k, w in enumerate(base))))
    out += [(1000 + i, " ".join([*base[:70], *prose(100 + i, rng.choice((8, 20, 40)))])) for i in range(120)]
    got = ngram_join.join_documents(spark.createDataFrame(out, "doc_id long, text string").repartition(5)).collect()
    assert by(got, "doc_id", "n_shingles", "component_id") == sorted(plain.components(out), key=str)


def test_one_of_each(docs, empty, rows):
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    ids = sorted((r["doc_id"] is None, r["doc_id"], (r["text"] or "")[:20]) for r in got if r["doc_id"] is not None)
    assert {i for _, i, _ in ids} == {0, 3, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14, 15, 16, 17} - ({3} if plain.components([r[:2] for r in rows])[3][2] == 0 else set())
    assert [r["text"] for r in got if r["doc_id"] == 17] == ["another text of the id"]
    assert [r["text"] for r in got if r["doc_id"] is None] == ["tail"]
    assert ngram_join.one_of_each(empty).count() == 0


def test_line_dedup(docs, empty, rows):
    got = lines.remove_repeated_lines(docs)
    unique = [r[:2] for r in rows if r[0] is not None and r[0] != 17]
    texts = {r["doc_id"]: r["text"] for r in got.filter("doc_id != 17").collect()}
    want = plain.dedup_lines(unique)
    assert texts == want and want[13] == "x\ny" and want[14] == "" and want[8] == "" and want[2] == ""
    assert set(docs.columns) <= set(got.columns) and got.count() == len(rows)
    assert lines.remove_repeated_lines(empty).count() == 0


def test_personal_data(docs, empty, spark, rows):
    tricky = [
        "a@b.c_d@e.f x@y@z.com .@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.004", "4111-1111-1111-1111 41111111111111111111 5 4111  1111 1111 1111",
        "+1 234 567 8901 +49 (0) 30.1234-567 ++1 2345678901234567", "é 4111111111111111 ü a.b@c.de", "9" * 40000 + " " + "a" * 40000 + "@", "1 " * 20000, "a.b." * 20000,
        "iban DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 not GB82WEST12345698765433", "ssn 123-45-6789 serial 123-45-6789",
    ]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(tricky, 100)), "doc_id long, text string"))
    for r in pii.find_personal_data(table).collect():
        assert [(s["start"], s["kind"], s["end"]) for s in r["pii"] if s["kind"] < 4] == plain.personal(r["text"]), r["doc_id"]
    found = {r["doc_id"]: r["s"] for r in pii.find_personal_data(table).select("doc_id", pii.listing(F.col("pii")).alias("s")).collect()}
    assert found[108].count("iban") == 2 and found[109].count("national_id") == 1 and found[4] == ""
    assert found[15].startswith("email:5:") and "card" in found[15] and "phone" in found[15]
    whole = pii.find_personal_data(docs)
    assert set(whole.columns) == set(docs.columns) and whole.count() == len(rows) and pii.find_personal_data(empty).count() == 0


def test_quality_rules(docs, empty, spark, rows):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels).collect()
    want = [(r[0], *plain.quality_counts(r[1])) for r in rows]
    assert by(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == sorted(want, key=str)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and r["kept"] == (not r["base_failed"])
    assert quality.judge(empty, labels).count() == 0 and quality.keep_good(docs, labels).columns == docs.columns


def test_quality_cutoffs_keep_good_documents(spark):
    rng, out, marks = random.Random(4), [], []
    for i in range(5000):
        bad, lang = i % 10 == 0, ("en", "de", None)[i % 3]
        w = prose(i, 40)
        out.append((i, " ".join(x + "%%%" if bad and rng.random() < 0.7 else x for x in w), lang))
        if i % 2 == 0:
            marks.append((i, 0 if bad else 1))
    docs, labels = spark.createDataFrame(out, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    assert not [i for i in kept if i % 10 == 0] and sum(i % 10 > 0 for i in kept) >= 0.98 * 4500


def test_passages(docs, empty, rows):
    got = passages.mark_passages(docs).collect()
    assert len(got) == len(rows)
    found = {r["doc_id"]: r for r in got if r["doc_id"] is not None and r["doc_id"] != 17}
    assert {i for i, r in found.items() if r["n_repeated"]} >= {0, 1, 2, 10, 11}
    assert not any(found[i]["n_repeated"] for i in (4, 5, 6, 7, 8, 9, 12, 13, 14, 15, 16))
    assert any(s["low"] <= 90 and s["high"] >= 150 for s in found[10]["spans"]) and found[10]["component_id"] == found[11]["component_id"] == 10
    assert found[2]["component_id"] == 0 and found[2]["n_copies"] == 3 and found[2]["n_repeated"] == 220
    assert passages.mark_passages(empty).count() == 0


def test_passages_of_open_groups(spark, monkeypatch):
    line, base = prose(30, 14), prose(31, 300)
    texts = [" ".join([*prose(100 + i, 60), *line, *prose(200 + i, 60)]) for i in range(24)]
    for i in range(30):
        rng = random.Random(i)
        words = [w if rng.random() > 0.03 else f"e{i}x{k}" for k, w in enumerate(base)]
        texts.append(" ".join([*prose(300 + i, 40), *words[10 * (i % 5) :]]))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    pairs = passages.find_passages(table).collect()
    covered = {}
    for r in pairs:
        for end in "uv":
            covered.setdefault(r[end], set()).update(range(r[f"{end}_low"], r[f"{end}_high"]))
    for block in (passages.BLOCK, 8):
        monkeypatch.setattr(passages, "BLOCK", block)
        got = passages.mark_passages(table).collect()
        assert sorted(r["n_repeated"] for r in got if r["n_repeated"]) == sorted(map(len, covered.values()))
        assert not any(r["n_repeated"] for r in got if r["doc_id"] < 24) and len(covered) > 20


def test_passages_leave_no_tables_behind(spark, docs):
    folder = shared_dir(spark).removeprefix("file:")
    there = set(os.listdir(folder))
    assert passages.mark_passages(docs).count() == docs.count()
    left = {x.rpartition("-")[0] for x in set(os.listdir(folder)) - there if glob.glob(f"{folder}/{x}/part-*")}
    assert left <= {"passages", "compared", "edges", "documents"}, left  # what the result reads


def test_passages_find_what_brute_force_finds(spark):
    rng, shared, out = random.Random(6), [prose(500 + k, 55) for k in range(8)], []
    for i in range(150):
        own = prose(1000 + i, 120)
        at = rng.randrange(100)
        out.append((i, " ".join([*own[:at], *shared[i % 8], *own[at:]] if i % 3 else own)))
    got = {r["doc_id"]: r["n_repeated"] for r in passages.mark_passages(spark.createDataFrame(out, "doc_id long, text string").repartition(4)).collect()}
    assert all(got[i] >= 50 for i in range(150) if i % 3) and not any(got[i] for i in range(0, 150, 3))


def test_passages_of_variants_in_large_groups(spark):
    rng, out, kinds = random.Random(8), [], {}
    for f in range(24):
        most = prose(40 + f, 70)
        few = [*most[:30], *prose(140 + f, 10), *most[40:]]  # 52 of 66 shingles, in halves too short alone
        for i in range(20):
            at, own = rng.randrange(60), prose(5000 + 20 * f + i, 60)
            kinds[len(out)] = (f, i in (7, 13))
            out.append((len(out), " ".join([*own[:at], *(few if i in (7, 13) else most), *own[at:]])))
    got = {r["doc_id"]: r for r in passages.mark_passages(spark.createDataFrame(out, "doc_id long, text string").repartition(4)).collect()}
    assert all(got[i]["n_repeated"] >= 70 for i in kinds)
    assert {i: got[i]["component_id"] for i in kinds} == {i: min(j for j in kinds if kinds[j] == kinds[i]) for i in kinds}


def test_passages_ship_asked_texts_only(spark):
    texts = [" ".join(prose(9000 + i, 60)) for i in range(300)] + [None, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    nodes = rows.mapInArrow(passages._marked, "doc_id long, node long, n_words long").filter("doc_id % 50 = 0").select("node")
    sent = rows.select("text").mapInArrow(passages._asked(passages._flags(nodes)), "node long, text string").collect()
    assert {r["text"] for r in sent} >= {texts[i] or "" for i in range(0, 300, 50)} and len(sent) < 12


def test_bpe_codec(docs, empty, rows):
    library = tokenizer.load(word_bpe())
    coded = bpe_chunks.encode_corpus(docs, word_bpe())
    want = sorted(((r[0], library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows), key=str)
    assert by(coded.collect(), "doc_id", "tokens") == want
    texts = bpe_chunks.decode_corpus(coded, word_bpe()).collect()
    assert by(texts, "doc_id", "text") == sorted(((i, library.decode(ids, skip_special_tokens=False)) for i, ids in want), key=str)
    assert bpe_chunks.encode_corpus(docs, word_bpe(), digests=True).count() == len(rows) and bpe_chunks.encode_corpus(empty, word_bpe()).count() == 0


def test_token_files(docs, empty, spark, rows):
    library, out = tokenizer.load(word_bpe()), scratch_path(spark, "tokens")
    token_files.write_token_files(docs, out, word_bpe())
    got = sorted(token_files.read_digests(spark, out).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is None, i))
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:k]) for k in range(len(got))]
    files = {r["doc_id"]: list(r["tokens"]) for r in spark.read.parquet(out).filter("doc_id != 17").collect()}
    assert all(files[r[0]] == [*library.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows if r[0] not in (None, 17))
    assert [r["doc_id"] for r in token_files.read_tokens(spark, out, 4, 5).collect()] == [4, 5]
    none = scratch_path(spark, "tokens")
    token_files.write_token_files(empty, none, word_bpe())
    assert token_files.read_digests(spark, none).count() == 0


def test_lm_scores(docs, empty, rows):
    import math
    from collections import Counter

    tokens = [[*plain.words(plain.lower(r[1])), None] for r in rows]
    counts = Counter(w for r, t in zip(rows, tokens, strict=True) if not plain.held(r[0]) for w in t)
    n, v = sum(counts.values()), len(counts)
    want = [(r[0], plain.held(r[0]), len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for r, t in zip(rows, tokens, strict=True)]
    got = lm.score_documents(docs).collect()
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str) == sorted(want, key=str)
    assert all(r["score"] < 0 for r in got) and lm.score_documents(empty).count() == 0
    seen = [r for r in got if r["doc_id"] in (0, 2)]
    assert all(r["score"] > r["base_score"] for r in seen)  # repeated pairs are known to the model


def test_lm_scores_of_equal_shards(spark):
    long = " ".join(prose(31, 1000)) + " same" * (lm.SLICE // 5)
    some = spark.createDataFrame([(0, long), (1, long), (2, "a b"), (3, "a b"), (4, "b c")], "doc_id long, text string")
    same = spark.createDataFrame([(k, None) for k in range(10, 4010)], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in lm.score_documents(some.repartition(5).union(same)).collect()}
    assert set(got) == {0, 1, 2, 3, 4, *range(10, 4010)}
    assert got[0]["n_known"] == got[1]["n_known"] == got[0]["n_tokens"] and len({got[k]["base_score"] for k in range(10, 4010)}) == 1


def test_decontamination(docs, empty, spark, rows):
    question = "If Maria Bell buys 12 apples at 3 dollars and sells Maria Bell 12 more of them how many apples remain then for the long trip?"
    items = spark.createDataFrame([
        (7, question), (12, "What is 2 + 2"),
        (8, None), (9, "short one"), (None, " ".join(prose(2, 60))), (11, "seven words are what this has, exactly"),
    ], "item_id long, text string")
    more = spark.createDataFrame([
        (200, "intro. So if Peter Cole buys 15 apples at 4 dollars and sells Peter Cole 15 more of them how many apples remain then for the long trip, he asks"),
        (201, "if Peter Cole buys 15 apples at 4 dollars and sells John Fox 17 more of them how many apples remain then for the long trip"),
        (202, "SEVEN words are what this has: exactly!"), (203, "seven words are what this had exactly"),
        (204, "well: " + question.lower()), (205, question.upper() + " " + " ".join(prose(9, 20000))), (206, question.replace("Maria", "\n   Maria")), (207, "so, What is 2+2? said"), (208, "what is 2 + 3, he said"),
    ], "doc_id long, text string")
    got = decontaminate.mark_contaminated(docs.select("doc_id", "text").union(more), items)
    assert {r["doc_id"] for r in got.filter("contaminated").collect()} == {10, 11, 200, 202, 204, 205, 206, 207}
    whole = decontaminate.mark_contaminated(docs, items)
    assert whole.columns[: len(docs.columns)] == docs.columns and whole.count() == len(rows)
    assert decontaminate.mark_contaminated(empty, items).count() == 0 and not decontaminate.mark_contaminated(docs, items.limit(0)).filter("contaminated").count()


def test_decontamination_on_the_table(spark, sf_dir):
    """Against plain search: every verbatim copy of an item is found, and what else is found shares half of its words' windows."""
    items = {r["item_id"]: plain.words(plain.lower(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    docs = {r["doc_id"]: plain.words(plain.lower(r["text"])) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    joined = {i: f" {' '.join(w)} " for i, w in docs.items()}
    verbatim = {d for d, t in joined.items() if any(f" {' '.join(w)} " in t for w in items.values())}
    found = decontaminate.mark_contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    got = {r["doc_id"] for r in found.filter("contaminated").collect()}
    windows = [runs(w, 4) for w in items.values()]
    assert verbatim and verbatim <= got
    assert all(any(len(w & runs(docs[d], 4)) >= 0.3 * len(w) for w in windows) for d in got)


def test_decontamination_looks_at_each_occurrence(spark):
    first = "a train leaves the old station at 12 with 80 people and at 15 another one follows it with 95 people so when do both of them meet"
    second = " then ".join(f"add {k} and {k + 2}" for k in (3, 7, 20, 31, 50, 64)) + " and say what remains"
    other = lambda *n: first.replace("12", n[0]).replace("80", n[1]).replace("15", n[2]).replace("95", n[3])
    docs = [
        (1, first), (2, f"{first}. Once more: {other('31', '44', '72', '63')}"), (3, f"{other('9', '71', '22', '18')} or, as well, {other('31', '44', '72', '63')}"), (4, second),
        (5, first.replace("another one", "another quite fast one")), (6, "a train leaves the old station and nothing else of it is here"), (7, other("9", "9", "9", "9") + " again"),
    ]
    items = spark.createDataFrame([(1, first), (2, second)], "item_id long, text string")
    got = decontaminate.mark_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items)
    assert {r["doc_id"]: r["n_items"] for r in got.filter("contaminated").collect()} == dict.fromkeys((1, 2, 3, 4, 5, 7), 1)


def test_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "https://A.B.Example.COM/en/x?y#z", "http://example.com/en", "http://example.com?q", "ftp://x.net/es/1", "http://www.example.com/en/#t",
        "http://xexample.com/en/", "http://bad.org:80/p", "http://bad.org/p", "s://h\n.net/fr/", "a://b://c.com/", "http://com/", *(f"http://h{k}.org/p" for k in range(800)),
    ]
    table = spark.createDataFrame([(k, u, "h", "v") for k, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    listed = lambda host: host.rlike(r"^(bad\.org|h[0-9]*7\.org)$")
    got = url_cascade.filter_urls(table, URL_RULES, listed).orderBy("page_id").collect()
    import re

    for r in got:
        rest = r["url"].split("://", 1)[1] if r["url"] and "://" in r["url"] else ""
        host = plain.lower(re.split("[/?#]", rest, maxsplit=1)[0])
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
        fits = [(len(h + p), h + p, a) for a, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, "block" if re.fullmatch(r"bad\.org|h[0-9]*7\.org", host) else "allow")
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict), r["url"]
    hosts = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("host"), (F.col("id") % 7 == 0).alias("listed"))
    levels = url_cascade.build_cascade(hosts, "host", "listed")
    assert len(levels) > 1 and not hosts.filter(url_cascade.member(F.col("host"), levels) != F.col("listed")).count()
    assert url_cascade.filter_urls(table.limit(0), URL_RULES, listed).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (100, 102), (7, 7), (200, 200), (None, 3)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}
