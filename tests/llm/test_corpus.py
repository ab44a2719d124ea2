"""The registered queries on the given tables, and the pipeline against a plain run."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import corpus_pipeline  # noqa: E402
import plain  # noqa: E402
from watchloom.llm import tokenizer  # noqa: E402
from watchloom.llm.queries import ORACLES, QUERIES, word_bpe  # noqa: E402


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    want = sorted((tuple(v for _, v in sorted(zip(names, r, strict=True))) for r in found.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in sorted(names)) for r in got.collect()), key=str) == want


def test_join_on_the_table(spark, sf_dir, documents):
    got = [tuple(r) for r in QUERIES["op3_ngram_join"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(plain.components(documents))


def test_personal_data_on_the_table(spark, sf_dir, documents):
    import hashlib

    kinds = ("email", "ip", "card", "phone")
    for r in QUERIES["op4_pii"](spark, sf_dir).collect():
        spans = plain.personal(dict(documents)[r["doc_id"]])
        joined = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and r["n_ip"] == sum(k == 1 for _, k, _ in spans)


def test_licenses_on_the_table(spark, sf_dir, documents):
    from watchloom.llm.licenses import PHRASES

    got = QUERIES["op13_license_scan"](spark, sf_dir).collect()
    assert sorted((r["doc_id"], *r[1:6]) for r in got) == sorted((i, *plain.licenses(t, PHRASES)) for i, t in documents)
    assert any(r["base_labels"] for r in got)
    for r in got:
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")
        assert ("cc-by-nc-4.0" in r["labels"]) == ("Licensed under CC BY-NC 4.0." in (dict(documents)[r["doc_id"]] or ""))


def test_variants_on_the_table(spark, sf_dir, documents):
    got = [tuple(r) for r in QUERIES["op12_spelling_variants"](spark, sf_dir).select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert sorted(got, key=str) == sorted(plain.variants(documents), key=str) and sum(r[2] for r in got)


def test_codec_on_the_table(spark, sf_dir, documents):
    import hashlib

    library = tokenizer.load(word_bpe())
    texts = dict(documents)
    for r in QUERIES["op6_bpe_codec"](spark, sf_dir).collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_scores_predict_held_out_text(spark, sf_dir):
    rows = [r for r in QUERIES["op9_lm_scores"](spark, sf_dir).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_pipeline(spark, sf_dir, documents):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_copies", "decontamination", "bpe_encoding"]
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.scratch_path(spark, f"test-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append({r["doc_id"]: r for r in docs.collect()})
        assert name == "bpe_encoding" or docs.columns == corpus_pipeline.COLUMNS
    good = {i for i, t in documents for n in [plain.quality_counts(t)] if n[0] >= 10 and 100 * n[4] <= 20 * n[0]}
    assert set(seen[0]) <= good
    cut = plain.dedup_lines([(i, r["text"]) for i, r in seen[0].items()])
    assert {i: r["text"] for i, r in seen[1].items()} == cut
    classes = plain.components([(i, r["text"]) for i, r in seen[1].items()])
    assert set(seen[2]) == {i for i, n, low in classes if low == i or n == 0}
    items = [" ".join(plain.words(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaked = {i for i, r in seen[2].items() if any(x in " ".join(plain.words(r["text"])) for x in items)}
    assert leaked and not leaked & set(seen[3])
    library = tokenizer.load(word_bpe())
    assert {i: list(r["tokens"]) for i, r in seen[4].items()} == {i: library.encode(r["text"], add_special_tokens=False).ids for i, r in seen[3].items()}
