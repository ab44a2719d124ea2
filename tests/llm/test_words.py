"""Licence scans, spelling variants and collocations on small tables, held against plain versions."""

import os
import random
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import plain  # noqa: E402
from watchloom.llm import collocations, licenses, spelling  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, n_words string, word string, licenses int, n long, `a.b` string"


def table(spark, rows):
    """Rows of (id, text, lang) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", "y", 1, 2, "z") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd():
    """Nulls, empty and long texts, ties and repeated rows."""
    rng = random.Random(3)
    long = " ".join(rng.choice(("alpha", "alphas", "alpba", "beta", "betaa", "gammas.", "gamma,")) for _ in range(40000))
    return [(1, None, "en"), (2, "", None), (3, " \n\t", ""), (None, "alpha beta alpha", None), (4, long, "en"), (5, "word word word", "de"), (5, "word word word", "de"), (6, "\u00c9t\u00e9s \u00e9t\u00e9s \u65e5\u672c words", None)]


def test_licenses(spark, odd):
    texts = [
        "The MIT license and the mit-license; MIT License", "mit mit license license", "General Public General Public License v3", "under terms of the GNU Lesser General Public License as published by the Software Foundation",
        "Licensed under the Apache License, Version 2.0", "licensed UNDER the apache license (version 1.1)", "Licensed by XY under CC BY-NC 4.0 terms", "CC BY 4.0", "by the cc, under no license 4 0",
        "This program is free software: you can redistribute it and / or modify it now under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License",
        "mit license " * 3000, "x" * 100000, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit\u00e9 license", "mit9 license mit",
        "pad " * 40 + "licensed under the apache license version 2 0 " + "pad " * 40 + "released under the MIT license",
    ]
    rows = odd + [(100 + k, t, "en") for k, t in enumerate(texts)] + [(100, texts[0], "en")]
    got = licenses.scan_licenses(table(spark, rows).repartition(3))
    assert got.columns == ["doc_id", "lang", "word", "n", "a.b", "n_words", "licenses"] and got.count() == len(rows)
    found = got.collect()
    base = lambda ms: (len(ms), min((m["first_word"] for m in ms), default=None), max((m["first_word"] for m in ms), default=None), ",".join(sorted({m["label"] for m in ms})))
    assert sorted(((r["doc_id"], r["n_words"], *base([m for m in r["licenses"] if m["phrase"]])) for r in found), key=str) == sorted(((i, *plain.licenses(t, licenses.PHRASES)) for i, t, _ in rows), key=str)
    own = {r["doc_id"]: {m["label"] for m in r["licenses"] if not m["phrase"]} for r in found}
    assert own[104] == {"apache-2.0"} and own[105] == set() and own[106] == {"cc-by-nc-4.0"} and own[107] == {"cc-by-4.0"} and own[108] == set()
    assert own[109] == {"gpl-3.0"} and own[112] == {"mit"} and own[103] >= {"lgpl"} and own[115] == {"apache-2.0", "mit"} and own[111] == set()
    spans = [m for r in found if r["doc_id"] == 115 for m in r["licenses"] if m["label"] == "apache-2.0"]
    assert [(m["first_word"], m["end_word"]) for m in spans] == [(40, 48)] and spans[0]["score"] > 0.99
    assert licenses.scan_licenses(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        licenses.scan_licenses(table(spark, odd), templates=[("none", "", [])])


def test_checksums_of_ranges():
    rng = random.Random(1)
    texts = [bytes(rng.choices(b"abcXYZ\xc3\xa9", k=k)) for k in (0, 1, 5, 63, 64, 65, 200, 3, 3)]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    begun = np.array([zlib.crc32(b"%d:" % k) for k in range(len(texts))], np.uint32)
    got = spelling.checksums(data, ends - [len(t) for t in texts], ends, begun)
    assert got.tolist() == [zlib.crc32(b"%d:" % k + bytes(c + 32 if 65 <= c <= 90 else c for c in t)) for k, t in enumerate(texts)]


@pytest.mark.parametrize("leaf", [4, 64, 16384])
def test_variants(spark, odd, leaf):
    rng, rows = random.Random(7), list(odd)
    stems = ["".join(rng.choices("abcde\u00e9\u00ff", k=rng.choice((4, 5, 6, 7)))) for _ in range(60)]
    for k in range(400):
        w = list(rng.choice(stems))
        for _ in range(rng.choice((0, 0, 1))):
            at = rng.randrange(len(w))
            w[at : at + rng.choice((0, 1))] = rng.choice(("", "a", "b", "\u00e9"))
        rows.append((k, " ".join(["".join(w)] * rng.choice((1, 3, 9))), "en"))
    rows += [(900 + k, "".join(rng.sample("abcdef", 6)), "en") for k in range(700)] + [(1700 + k, "q" * 3000 + "r" * (k % 2), None) for k in range(9)]
    got = spelling.group_variants(table(spark, rows).repartition(4), slips=True, leaf=leaf)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(plain.variants([r[:2] for r in rows]), key=str)


def test_variants_of_nothing(spark, odd):
    assert spelling.group_variants(table(spark, [])).count() == 0
    assert spelling.group_variants(table(spark, odd[:3])).count() == 0


def test_collocations(spark, odd):
    rng, rows = random.Random(5), list(odd)
    words = [f"w{k}" for k in range(30)] + ["the", "New", "york", "City", "\u00e9t\u00e9", "\u6771\u4eac", "\U0001f600"]
    for k in range(300):
        text = "".join(rng.choice(words) + rng.choice((" ", " ", "\t", "  ", ", ", ".", "\x0b", "\n")) for _ in range(40))
        rows.append((k, text + "new york city of the the the " + rng.choice(("salt lake city", "salt lake", "")), rng.choice(("en", "de", None, ""))))
    df = table(spark, rows).repartition(4)
    for least, share, top in ((10, 50, 2000), (3, 90, 7)):
        got = collocations.mine_collocations(df, least=least, share=share, top=top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(tuple(r) for r in got.collect()) == sorted(plain.collocations([(g, t) for _, t, g in rows], least, share, top))
    assert collocations.mine_collocations(table(spark, [])).count() == 0 and collocations.mine_collocations(table(spark, odd[:3])).count() == 0


def test_hot_prefixes_are_dealt_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BUCKET", 64)
    rng = random.Random(8)
    rows = [(k, " ".join(f"hot n{rng.randrange(40)} m{rng.randrange(3)}" for _ in range(60)), "en") for k in range(60)]
    got = collocations.mine_collocations(table(spark, rows))
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain.collocations([(g, t) for _, t, g in rows]))


def test_scores_are_exact_beyond_64_bits(spark):
    million = 10**13
    frame = spark.createDataFrame([(million, million + 1, million + 3)], "a long, l long, r long")
    got = frame.selectExpr("CAST(a AS DECIMAL(20,0)) * CAST(a AS DECIMAL(20,0)) * CAST(1000000 AS DECIMAL(7,0)) DIV (CAST(l AS DECIMAL(20,0)) * CAST(r AS DECIMAL(20,0))) AS s").first()["s"]
    assert got == 1000000 * million * million // ((million + 1) * (million + 3))
