"""Line dedup by overlapping windows of three consecutive lines.

A line counts if it has a word; lines without one are neither compared nor removed. Every run of three
such lines of a document is hashed. Of a window found more than once, the occurrence with the smallest
(doc_id, position) stays and the lines of all later ones are covered; a document's covered positions are
merged and removed. A document with one or two such lines has one window of all of them.

Defined cases: null or blank texts have no window and stay as they are. Null ids come last in the order.
Rows equal in id and text count as one row and are treated alike; rows that share only the id are told
apart by their text. A text whose lines are all removed becomes empty. Other columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.llm.common import computed, fresh, order_id, quoted

WINDOW = 3
_WORD = r"[^\x20\x09-\x0D]"


def _counted(lines: Column) -> Column:
    """Position and two hashes of each line that counts."""
    return F.filter(
        F.transform(lines, lambda line, i: F.struct(i.alias("at"), F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"), F.rlike(line, F.lit(_WORD)).alias("ok"))),
        lambda x: x["ok"],
    )


def _windows(counted: Column) -> Column:
    """For each window of the counted lines: two hashes, its place and its lines' positions in the text."""

    def one(first: Column, n: Column) -> Column:
        part = F.slice(counted, first + 1, n)
        return F.struct(
            F.xxhash64(F.transform(part, lambda x: x["a"])).alias("a"),
            F.xxhash64(F.transform(part, lambda x: x["b"])).alias("b"),
            first.alias("place"),
            F.transform(part, lambda x: x["at"]).alias("lines"),
        )

    n = F.size(counted)
    width = F.least(n, F.lit(WINDOW))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - width), lambda i: one(i, width))).otherwise(F.array())


def remove_repeated_lines(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The table with later occurrences of repeated windows removed from its texts.

    Adds ``n_lines`` (lines that count) and ``n_removed``.
    """
    own = {"n_lines", "n_removed"}
    base = df.select(*(F.col(quoted(c)) for c in df.columns if c.lower() not in own))
    key, mark, gone, counted = (fresh(base, n) for n in ("row_id", "row_text", "row_gone", "row_lines"))
    rows = base.withColumns({key: order_id(quoted(id_column)), mark: F.xxhash64(F.col(quoted(text)))})
    lines = F.split(F.col(quoted(text)), "\n", -1)
    windows = computed(rows.select(key, mark, lines.alias(counted)), "w", _counted(F.col(counted)))
    windows = windows.select(key, mark, _windows(F.col("w")).alias("w")).select(key, mark, F.inline("w"))
    order = F.struct(key, "place", mark)
    firsts = windows.groupBy("a", "b").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    covered = (
        windows.join(firsts, ["a", "b"]).filter(order != F.col("first"))
        .groupBy(key, mark).agg(F.array_distinct(F.flatten(F.collect_set("lines"))).alias(gone))
    )
    joined = rows.join(covered, [key, mark], "left")
    cut = fresh(joined, "row_cut")
    joined = computed(joined, cut, F.when(F.col(gone).isNotNull(), lines))
    stay = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col(gone))
    kept = F.transform(stay, lambda i: F.get(F.col(cut), i))
    n_lines = F.coalesce(F.size(F.filter(lines, lambda line: F.rlike(line, F.lit(_WORD)))), F.lit(0))
    return joined.select(
        *(F.when(F.col(gone).isNull(), F.col(quoted(c))).otherwise(F.array_join(kept, "\n")).alias(c) if c == text else F.col(quoted(c)) for c in base.columns),
        F.when(F.col(quoted(text)).isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
    )
