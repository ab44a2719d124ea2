"""Registered queries of the corpus operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.llm import bpe_chunks, collocations, decontaminate, licenses, lines, lm, ngram_join, passages, pii, quality, spelling, token_files, url_cascade
from watchloom.llm.common import small_batches, table
from watchloom.session import scratch_path

#: URL rules (action, host, path start) and the host labels on the block list.
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
BLOCKED_LABELS = ("casino-win", "cheap-pills", "free-bets", "spam-farm")


def word_bpe() -> str:
    """Place of the vocabulary file that the queries encode with; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.mark_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_repeated", "n_copies", "component_id", "spans")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda x: x["kind"] < 4)
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS[:4])),
        F.sha2(pii.listing(base), 256).alias("base_sha256"), pii.listing(F.col("pii")).alias("spans"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.encode_corpus(table(spark, sf_dir, "documents"), word_bpe(), digests=True)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return decontaminate.mark_contaminated(docs, items).select("doc_id", "contaminated", "n_items")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), out, word_bpe(), end_id=1)
    return token_files.read_digests(spark, out)


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    is_listed = lambda host: F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, BLOCKED_LABELS)))
    return url_cascade.filter_urls(pages, URL_RULES, is_listed).select("page_id", "host", "path", "rule", "verdict")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = spelling.group_variants(table(spark, sf_dir, "documents"), slips=True)
    return grouped.select("word", "n", "n_near", "form", "form_n", "root")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("licenses", lambda m: m["phrase"])
    starts = F.transform(base, lambda m: m["first_word"])
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda m: m["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("licenses")).alias("labels"),
        F.coalesce(F.array_max(F.transform("licenses", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )


_ALL = {
    "op1_quality_rules": op1_quality_rules, "op2_passages": op2_passages, "op3_ngram_join": op3_ngram_join, "op4_pii": op4_pii, "op5_line_dedup": op5_line_dedup, "op6_bpe_codec": op6_bpe_codec,
    "op7_decontamination": op7_decontamination, "op8_token_files": op8_token_files, "op9_lm_scores": op9_lm_scores, "op10_url_filter": op10_url_filter,
    "op11_collocations": op11_collocations, "op12_spelling_variants": op12_spelling_variants, "op13_license_scan": op13_license_scan,
}
QUERIES = {name: (lambda spark, sf_dir, f=f: f(small_batches(spark), sf_dir)) for name, f in _ALL.items()}

ORACLES = {
    "op11_collocations": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
        w AS (SELECT lang, [x for x in string_split_regex(piece, '[\x20\x09]+') if x <> ''] AS ws FROM p),
        g AS (SELECT lang, unnest(ws) AS phrase, 1 AS k FROM w
              UNION ALL SELECT lang, unnest([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]), 2 FROM w
              UNION ALL SELECT lang, unnest([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)]), 3 FROM w),
        f AS (SELECT lang, phrase, k, count(*) AS a FROM g GROUP BY ALL),
        t AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT *, string_split(phrase, ' ') AS s FROM f WHERE k > 1 AND a >= 10),
        x AS (SELECT lang, k, a, phrase, unnest(range(1, k)) AS cut, s FROM c),
        y AS (SELECT x.*, u.a AS l, v.a AS r, (1000000::HUGEINT * x.a * x.a // (u.a::HUGEINT * v.a))::BIGINT AS score FROM x
              JOIN f u ON u.lang = x.lang AND u.phrase = array_to_string(s[1:cut], ' ')
              JOIN f v ON v.lang = x.lang AND v.phrase = array_to_string(s[cut + 1:x.k], ' ')),
        z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        o AS (SELECT lang, phrase, max(a) AS longer FROM (
              SELECT lang, s[1] || ' ' || s[2] AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, s[2] || ' ' || s[3], a FROM c WHERE k = 3) GROUP BY ALL)
        SELECT z.lang, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, z.a DESC, z.phrase) AS rank, z.phrase, z.a, l, r, n, score
        FROM z JOIN t USING (lang) LEFT JOIN o ON o.lang = z.lang AND o.phrase = z.phrase AND z.k = 2
        WHERE longer IS NULL OR 100 * longer < 50 * z.a QUALIFY rank <= 2000
    """,
    "op10_url_filter": """
        WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
        r(action, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                     ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        f AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS action
              FROM b JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
        SELECT b.page_id, host, path, rule,
               coalesce(action, CASE WHEN list_has_any(string_split(host, '.'), ['casino-win', 'cheap-pills', 'free-bets', 'spam-farm'])
                                     THEN 'block' ELSE 'allow' END) AS verdict
        FROM b LEFT JOIN f USING (page_id)
    """,
    "op5_line_dedup": r"""
        WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
        e AS (SELECT doc_id, i - 1 AS pos, ls[i] AS line FROM d, range(1, len(ls) + 1) t(i)),
        c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n
              FROM e WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        w AS (SELECT doc_id, k, n, string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS win FROM c),
        v AS (SELECT *, row_number() OVER (PARTITION BY win, least(n, 3) ORDER BY doc_id, k) AS seen FROM w WHERE k <= greatest(n - 3, 0)),
        g AS (SELECT DISTINCT c.doc_id, c.pos FROM v JOIN c ON c.doc_id = v.doc_id AND c.k BETWEEN v.k AND v.k + 2 WHERE seen > 1),
        k AS (SELECT e.doc_id, string_agg(line, chr(10) ORDER BY pos) AS kept FROM e LEFT JOIN g USING (doc_id, pos) WHERE g.pos IS NULL GROUP BY e.doc_id),
        s AS (SELECT doc_id, count(*) AS n_removed FROM g GROUP BY doc_id), m AS (SELECT doc_id, count(*) AS n_lines FROM c GROUP BY doc_id)
        SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text,
               coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
        FROM d LEFT JOIN k USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN m USING (doc_id)
    """,
}
