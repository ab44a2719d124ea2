r"""Licence scans by a positional index over the rare words of licence templates.

A template is a label, a notice and the key phrases that must stand in it. One pass counts, over all texts, how
many hold each template word. From these counts every template gets its ``RARE`` rarest words, with their
positions in the notice: the postings. The second pass looks up each file's words in them; a hit votes for the
file position at which the notice would begin. Votes of one template at most ``SLACK`` words apart in one file
are an alignment. It is verified if at least half of the template's rare words agree on it, all key phrases
stand in its window, and the words found there carry ``KEEP`` or more of the template's inverse document frequency; that share
is its score. A bare phrase is looked up the same way by its rarest word, must match word by word, and scores
``MENTION``.

The postings travel with the tasks: they hold ``RARE`` words a template and are bounded by the given templates
(``MAX_WORDS`` words at most, more are refused); what is gathered from the texts is one count a template word.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z, compared by 64-bit hashes.

Defined cases: a null text is empty and has no words. Rows are independent: repeated rows, null ids, ties and
other columns pass through; equally rare words are taken in template order. Texts of any length are scanned
whole. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from watchloom.llm import kernel
from watchloom.llm.common import quoted
from watchloom.llm.runs import byte_set, places, runs

SLICE = 2 << 20
RARE, SLACK, KEEP, MENTION, MAX_WORDS = 6, 6, 0.6, 0.5, 1_000_000
_INSIDE = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))

# Phrases with their labels, and notices (label, wording, key phrases).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = [
    ("agpl-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", ["affero general public license", "version 3"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license", "version 2 0"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial 4 0"]),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike 4 0"]),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License", ["general public license", "version 2"]),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ["general public license", "version 3"]),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license", "version 3"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["lesser general public license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
]

_MATCHES = "array<struct<label:string,phrase:boolean,first_word:bigint,end_word:bigint,score:double>>"


def words(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each row the number of words before it."""
    data, offsets = kernel.texts(column)
    starts, ends, counts = runs(_INSIDE[data], offsets)
    return kernel.word_hashes(data, starts, ends, lower=True), counts


def _hashed(texts: list[str]) -> list[np.ndarray]:
    hashes, counts = words(pa.array(texts, pa.large_string()))
    return [hashes[i:j] for i, j in zip(counts[:-1], counts[1:], strict=True)]


class Index:
    """Postings of the rare words: template, position; key phrases and word weights of each template."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str, list[str]]]):
        self.phrases, self.labels = _hashed(list(phrases)), list(phrases.values())
        self.notices = _hashed([t for _, t, _ in templates])
        self.keys = [_hashed(k) for _, _, k in templates]
        self.names = [n for n, _, _ in templates]
        lists = [*self.phrases, *self.notices, *(x for k in self.keys for x in k)]
        if any(not len(x) for x in lists) or sum(map(len, lists)) > MAX_WORDS:
            raise ValueError(f"phrases and templates need a word each, and {MAX_WORDS} words at most together")
        self.vocabulary = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)

    def weigh(self, documents: int, holding: dict[int, int]) -> None:
        """Takes how many texts hold each word of the vocabulary, and makes the postings."""
        held = np.array([holding.get(k, 0) for k in range(len(self.vocabulary))], float)
        self.weights = np.log((documents + 1.0) / (held + 1.0)) + 1e-6
        weight = lambda hashes: self.weights[np.searchsorted(self.vocabulary, hashes)]
        self.rarest = [int(np.argmax(weight(p))) for p in self.phrases]
        self.key_rarest = [[int(np.argmax(weight(p))) for p in k] for k in self.keys]
        self.sets = [np.unique(n) for n in self.notices]
        self.shares = [weight(s) / weight(s).sum() for s in self.sets]
        rows = []
        for t, notice in enumerate(self.notices):
            _, first = np.unique(notice, return_index=True)
            first = np.sort(first)
            rare = first[np.argsort(-weight(notice[first]), kind="stable")][:RARE]
            rows += [(word, t, at) for word in notice[rare] for at in np.flatnonzero(notice == word)]
        rows.sort(key=lambda r: int(r[0]))
        self.words = np.array([r[0] for r in rows], np.uint64)
        self.template, self.position = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
        self.needed = [-(-min(RARE, len(s)) // 2) for s in self.sets]

    def mentions(self, hashes: np.ndarray, counts: np.ndarray):
        for phrase, rarest, label in zip(self.phrases, self.rarest, self.labels, strict=True):
            for at in places(hashes, counts, phrase, rarest).tolist():
                yield at, label, True, at, at + len(phrase), MENTION

    def alignments(self, hashes: np.ndarray, counts: np.ndarray):
        """Verified places of notices: a word of the row, label, span, score."""
        low, high = np.searchsorted(self.words, hashes, "left"), np.searchsorted(self.words, hashes, "right")
        hit = np.flatnonzero(high > low)
        sizes = (high - low)[hit]
        at = np.repeat(hit, sizes)
        posting = np.repeat(low[hit], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        template, begin = self.template[posting], at - self.position[posting]
        row = np.searchsorted(counts, at, "right") - 1
        order = np.lexsort((begin, row, template))
        template, begin, row, at = template[order], begin[order], row[order], at[order]
        new = np.ones(len(order), bool)
        new[1:] = (template[1:] != template[:-1]) | (row[1:] != row[:-1]) | (begin[1:] - begin[:-1] > SLACK)
        cluster = np.cumsum(new) - 1
        votes = np.unique(np.stack([cluster.astype(np.uint64), hashes[at]], 1), axis=0)[:, 0].astype(np.int64)
        votes = np.bincount(votes, minlength=int(new.sum()))
        edges = np.append(np.flatnonzero(new), len(order))
        found: dict[tuple[int, int], np.ndarray] = {}
        for k in np.flatnonzero(votes >= np.array(self.needed)[template[edges[:-1]]]).tolist() if len(order) else ():
            t, r = int(template[edges[k]]), int(row[edges[k]])
            first = max(int(begin[edges[k]]) - SLACK, int(counts[r]))
            end = min(int(begin[edges[k + 1] - 1]) + len(self.notices[t]) + SLACK, int(counts[r + 1]))
            share = float(self.shares[t][np.isin(self.sets[t], hashes[first:end])].sum())
            if share < KEEP:
                continue
            for j, phrase in enumerate(self.keys[t]):
                if (t, j) not in found:
                    found[t, j] = places(hashes, counts, phrase, self.key_rarest[t][j])
                nearest = np.searchsorted(found[t, j], first)
                if nearest == len(found[t, j]) or found[t, j][nearest] + len(phrase) > end:
                    break
            else:
                seen = at[edges[k] : edges[k + 1]]
                yield int(seen[0]), self.names[t], False, int(seen.min()), int(seen.max()) + 1, min(1.0, share)


def _held(vocabulary: np.ndarray):
    """Texts that hold each word of the vocabulary, and (as -1) all texts."""

    def run(batches):
        total, texts = np.zeros(len(vocabulary), np.int64), 0
        for whole in batches:
            for batch in kernel.slices(whole, "text", SLICE):
                hashes, counts = words(batch.column("text"))
                k = np.searchsorted(vocabulary, hashes)
                known = np.flatnonzero(vocabulary[np.minimum(k, len(vocabulary) - 1)] == hashes) if len(vocabulary) else np.zeros(0, np.int64)
                row = np.searchsorted(counts, known, "right") - 1
                total += np.bincount(np.unique(row * len(vocabulary) + k[known]) % max(1, len(vocabulary)), minlength=len(vocabulary))
                texts += batch.num_rows
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*seen.tolist(), -1], pa.int64()), pa.array([*total[seen].tolist(), texts], pa.int64())], ["word", "n"])

    return run


def _scanned(index: Index, schema: pa.Schema):
    def run(batches):
        for whole in batches:
            for batch in kernel.slices(whole, "text", SLICE):
                hashes, counts = words(batch.column("text"))
                found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
                for at, label, phrase, first, end, score in (*index.mentions(hashes, counts), *index.alignments(hashes, counts)):
                    r = int(np.searchsorted(counts, at, "right")) - 1
                    base = int(counts[r])
                    found[r].append({"label": label, "phrase": phrase, "first_word": first - base, "end_word": end - base, "score": score})
                for rows in found:
                    rows.sort(key=lambda m: (m["first_word"], m["end_word"], m["label"], m["phrase"]))
                others = [batch.column(k) for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*others, pa.array(np.diff(counts)), pa.array(found, schema.field(len(others) + 1).type)], schema=schema)

    return run


def scan_licenses(df: DataFrame, text: str = "text", phrases: dict[str, str] | None = None, templates: list[tuple[str, str, list[str]]] | None = None) -> DataFrame:
    """The rows without their text, with ``n_words`` and ``licenses``: label, whether a bare phrase, first word, end
    word and score of each place, in order. Columns of ``df`` with these two names are replaced."""
    index = Index(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)
    only = df.select(F.col(quoted(text)).alias("text"))
    counted = only.mapInArrow(_held(index.vocabulary), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row a template word at most
    holding = {r["word"]: r["n"] for r in counted}
    index.weigh(holding.pop(-1, 0), holding)
    kept = [c for c in df.columns if c.lower() not in ("n_words", "licenses", text.lower())]
    sent = df.select(*(F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(kept)), F.col(quoted(text)).alias("text"))
    fields = [f"{c} {kind}" for c, kind in sent.dtypes[:-1]]
    schema = df.sparkSession.createDataFrame([], ", ".join([*fields, "n_words bigint", f"licenses {_MATCHES}"])).schema
    return sent.mapInArrow(_scanned(index, to_arrow_schema(schema)), schema).toDF(*kept, "n_words", "licenses")
