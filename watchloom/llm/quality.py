"""Quality rules with risk-controlled cutoffs.

Every rule rejects a document whose signal is above a cutoff. Cutoffs are chosen for each stratum (a
language with enough labelled good documents, or all others together) on labelled holdout documents: going
from lax to strict, a cutoff is certified while an exact binomial test refutes, at the corrected level, that
it rejects more than its share of good documents (the one-sided exact upper bound stays below that share).
Testing stops at the first cutoff that fails, so a rule's whole chain costs one test; the level is divided
by the number of rules and strata. The rules share the allowed rate, so all rules together reject at most
``MAX_REJECTED`` of a stratum's good documents, in all strata at once with probability ``1 - ERROR``. Of the
certified cutoffs the laxest that still finds nearly all bad documents the strictest finds is used, or a
stricter one that finds more and rejects no more good ones, if it finds bad documents many times more often
than good ones.

Base checks come first and are not subject to this: fewer than ``MIN_WORDS`` words, or more than a fifth of
the words inside five-word windows found twice.

Defined cases: null and empty texts have no words and fail the base checks. A null language is a stratum
name of its own; a stratum with too few labels is pooled. Labels of one id count once, bad if any is bad;
rows with null ids have no label. Without enough labels no cutoff is certified and only base checks reject.
Rows are judged alone: repeated rows get equal verdicts. Columns of the input are kept, apart from those
the operator adds.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.llm import kernel
from watchloom.llm.common import columns, fresh, order_id, quoted
from watchloom.session import materialize

MIN_WORDS, MAX_REPEATED = 10, 20
MAX_REJECTED, ERROR = 0.02, 0.05
NEARLY, LIFT = 0.98, 10  # a cutoff must find that share of what the strictest finds, and bad documents that much more often than good
MAX_STRATA = 64
SLICE = 2 << 20
CUTOFFS = (0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
#: Signals from 0 to 1: a count and what it is a share of.
RULES = {
    "symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "word_chars"), "marks": ("n_marks", "word_chars"),
}
_SYMBOL, _UPPER, _MARK = np.zeros(256, np.int64), np.zeros(256, np.int64), np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_UPPER[65:91] = 1
_MARK[list(b"!?~^=_+")] = 1


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[offsets])


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Marks of values found more than once, and of all but the first of each."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    twice = again.copy()
    twice[order[:-1][same]] = True
    return twice, again


def _row_keys(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return kernel.mix(hashes + (rows.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def counts_of(column) -> dict[str, np.ndarray]:
    """The counts of every row of a string column."""
    data, offsets = kernel.texts(column)
    starts, ends, counts = kernel.words(data, offsets)
    letter = ((data & 0xC0) != 0x80) & ~kernel._SPACE[data]
    upper = _UPPER[data]
    upper[1:] += (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)  # capitals of Latin-1
    out = {
        "n_words": np.diff(counts), "word_chars": _per_row(letter, offsets), "n_symbols": _per_row(_SYMBOL[data], offsets),
        "n_upper": _per_row(upper, offsets), "n_marks": _per_row(_MARK[data], offsets),
    }
    # Lines that have a word.
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    begin = begin[begin < len(data)]
    rows = np.searchsorted(offsets, begin, "right") - 1
    end = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, begin)], offsets[rows + 1])
    sums = np.concatenate([[0], np.cumsum(letter)])
    filled = sums[end] > sums[begin]
    begin, end, rows = begin[filled], end[filled], rows[filled]
    _, again = _repeated(_row_keys(kernel.word_hashes(data, begin, end), rows))
    out["n_lines"] = np.bincount(rows, minlength=len(offsets) - 1)
    out["n_dup_lines"] = np.bincount(rows[again], minlength=len(offsets) - 1)
    # Words inside repeated five-word windows.
    hashes, first = kernel.windows(kernel.word_hashes(data, starts, ends), counts, 5)
    twice, _ = _repeated(_row_keys(hashes, np.searchsorted(counts, first, "right") - 1))
    edges = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edges, first[twice], 1)
    np.add.at(edges, first[twice] + 5, -1)
    out["n_repeat_words"] = _per_row(np.cumsum(edges[:-1]) > 0, counts)
    return out


def _measured(batches):
    for whole in batches:
        for batch in kernel.slices(whole, "measured_text", SLICE):
            found = counts_of(batch.column("measured_text"))
            kept = [c for c in batch.schema.names if c != "measured_text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], [*kept, *COUNTS]
            )


def measure(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The columns ``keep`` and the counts of each row's whole text."""
    kept = df.select(*(F.col(quoted(c)) for c in keep), F.col(quoted(text)).alias("measured_text"))
    schema = ", ".join([*(f"{quoted(c)} {kept.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} long" for c in COUNTS)])
    return kept.mapInArrow(_measured, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def signal(rule: str) -> Column:
    part, whole = RULES[rule]
    return F.coalesce(F.col(part) / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0))


def tail(k: int, n: int, p: float) -> float:
    """Probability of at most ``k`` of ``n`` at rate ``p``, summed exactly term by term."""
    if k >= n:
        return 1.0
    i = np.arange(1, k + 1)
    logs = n * math.log1p(-p) + np.concatenate([[0.0], np.cumsum(np.log((n - i + 1) / i) + math.log(p / (1 - p)))])
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def choose(good: int, bad: int, rejected: list[int], found: list[int], rate: float, level: float) -> int | None:
    """Index of the cutoff to use, or none. Lists follow the cutoffs from lax to strict."""
    certified = 0
    while certified < len(rejected) and tail(rejected[certified], good, rate) <= level:
        certified += 1
    if not certified or not found[certified - 1]:
        return None
    at = next(i for i in range(certified) if found[i] >= NEARLY * found[certified - 1])
    at = max((i for i in range(at, certified) if rejected[i] == rejected[at]), key=lambda i: (found[i], -i))
    return at if found[at] * good >= LIFT * rejected[at] * bad else None


def fit_cutoffs(counts: DataFrame, labels: DataFrame, id_column: str = "doc_id", stratum: str = "lang") -> dict[str | None, dict[str, float]]:
    """Cutoffs by stratum and rule; the key None holds those of all strata not named.

    ``counts`` has a row for each document, ``labels`` the columns ``doc_id`` and ``quality``. What reaches
    the driver has at most (MAX_STRATA + 1) x rules x cutoffs rows.
    """
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg((F.min("quality") > 0).alias("good"))

    def step(rule: str) -> Column:
        """How many cutoffs of the rule the document passes; as they fall, these are the first ones."""
        own = signal(rule)
        return F.struct(F.lit(rule).alias("rule"), F.size(F.filter(F.array(*map(F.lit, CUTOFFS)), lambda c: own <= c)).alias("passed"))

    steps = F.array(*map(step, RULES))
    rows = counts.filter(~base_failed()).select(F.col(quoted(id_column)).cast("long").alias("label_id"), F.coalesce(F.col(quoted(stratum)).cast("string"), F.lit("")).alias("stratum"), steps.alias("steps"))
    held = materialize(rows.join(marks, "label_id").select("stratum", "good", "steps"), "holdout")
    least = math.ceil(math.log(len(RULES) / ERROR) * len(RULES) / MAX_REJECTED)
    named = [r["stratum"] for r in held.filter("good").groupBy("stratum").count().filter(F.col("count") >= least).orderBy(F.desc("count"), "stratum").limit(MAX_STRATA).collect()]
    where = F.when(F.col("stratum").isin(named), F.col("stratum")) if named else F.lit(None).cast("string")
    table = held.select(where.alias("stratum"), "good", F.inline("steps")).groupBy("stratum", "good", "rule", "passed").count().collect()
    out: dict[str | None, dict[str, float]] = {}
    for name in [*named, None]:
        for rule in RULES:
            n = {g: np.zeros(len(CUTOFFS) + 1, np.int64) for g in (True, False)}
            for r in table:
                if r["stratum"] == name and r["rule"] == rule:
                    n[r["good"]][r["passed"]] += r["count"]
            # A document that passes the first i cutoffs is rejected by every stricter one.
            rejected, found = (np.cumsum(n[g])[:-1].tolist() for g in (True, False))
            at = choose(int(n[True].sum()), int(n[False].sum()), rejected, found, MAX_REJECTED / len(RULES), ERROR / (len(RULES) * (len(named) + 1)))
            if at is not None:
                out.setdefault(name, {})[rule] = CUTOFFS[at]
    return {name: out.get(name, {}) for name in [*named, None]}


def verdict(cutoffs: dict[str | None, dict[str, float]], stratum: str = "lang") -> Column:
    """Whether a measured document passes the base checks and its stratum's cutoffs."""

    def rejects(own: dict[str, float]) -> Column:
        out = F.lit(False)
        for rule, cutoff in own.items():
            out = out | (signal(rule) > cutoff)
        return out

    where, bad = F.coalesce(F.col(quoted(stratum)).cast("string"), F.lit("")), None
    for name, own in cutoffs.items():
        if name is not None:
            bad = F.when(where == name, rejects(own)) if bad is None else bad.when(where == name, rejects(own))
    rest = rejects(cutoffs.get(None, {}))
    return ~base_failed() & ~(rest if bad is None else bad.otherwise(rest))


def judge(df: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang"), text: str = "text") -> DataFrame:
    """Measured documents with ``base_failed`` and ``kept``; texts are measured once and the counts written."""
    counts = materialize(measure(df, text, keep), "measured")
    cutoffs = fit_cutoffs(counts, labels)
    return counts.withColumns({"base_failed": base_failed(), "kept": verdict(cutoffs)})


def keep_good(df: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` that are kept, with their columns. Texts are measured once; a row finds its verdict by id, language and a hash of its text."""
    mark, number, where = (fresh(df, c) for c in ("text_mark", "number_mark", "lang_mark"))
    keys = {mark: F.xxhash64(F.col(quoted(text))), number: order_id(), where: F.coalesce(F.col("lang").cast("string"), F.lit(""))}
    rows = df.withColumns(keys)
    counts = materialize(measure(rows, text, ("doc_id", "lang", *keys)), "measured")
    good = counts.filter(verdict(fit_cutoffs(counts, labels))).select(*keys).distinct()
    return rows.join(good, list(keys), "left_semi").select(*columns(df))
