r"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items are rewritten to templates: numbers, names (a word with one capital after a word that
doesn't end a sentence) and units after a number become typed placeholders, the rest is lower-cased and cut
at everything but letters and digits. Windows of ``WINDOW`` template words are hashed and joined by hash. An
item is found in a document that has at least ``SHARE`` of its distinct windows, or a run of ``RUN``
consecutive ones. An item with names also has windows that keep them as lower-cased words, joined by the same hash
join: they find a copy whose names can't be told (all lower case, all capitals). Matched places lie on alignments (document place less item place), each of which is taken
alone, with its neighbours up to each number of ``REACH``, and with all others, and one that passes is enough: an
item may occur several times with other values, and a repeated template matches crosswise. Then the slots are
checked: over the matched windows of the alignment, a number, name or unit of the item
must stand for one value of the document each; re-parameterised questions pass, mere look-alikes with
changing values don't. At least ``CONSISTENT`` of the item's slot values must do so.

Everything is DataFrame operations. Bitmaps of the item windows' first and last words and of their hashes, of at most
0.5 MB each, drop most windows of the documents where they are made; those left carry their slot words along, so no text is read twice or moved.

Defined cases: null and empty texts are not contaminated. An item with fewer than ``WINDOW`` words has one window of
all of them, below ``TYPED`` words with equal slot values only; an item with fewer than ``LEAST`` is not searched, as chance would find it. Repeated rows get equal
results; null ids count as an id, and rows that share an id are told apart by their text. Null items are
skipped; items that share an id are searched as one id. No items: nothing is contaminated.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.llm.common import computed, fresh, order_id, quoted
from watchloom.session import materialize

WINDOW, TYPED, LEAST = 8, 5, 3
SHARE, RUN, CONSISTENT = 0.5, 12, 0.8
REACH = (0, 1, 4)  # words that may be added or left out between alignments taken together
MOST_WORDS = 16  # binary logarithm of the bitmap's most words of 64 bits
# Unit words that count as a unit after a number.
UNITS = (
    "percent|degrees|meters|metres|meter|metre|kilometers|kilometres|miles|feet|inches|centimeters|centimetres|millimeters|km|cm|mm|ft|kg|grams|gram|mg|pounds|ounces|lb|oz"
    "|liters|litres|liter|litre|ml|gallons|seconds|minutes|hours|days|weeks|months|years|dollars|euros|cents|usd|eur|watts|kw|volts|joules|mph|kmh|hz|mb|gb"
)
_NUMBER, _NAME, _UNIT = "0num", "0name", "0unit"


def _spaced(text: Column) -> Column:
    """Typed text before cutting: names are marked by a prefix, as their case is lost afterwards."""
    named = F.regexp_replace(text, r"(?=\p{Lu}\p{Ll})(?<=[\p{Ll}\p{Nd},;]\s{1,8})", "0name")
    return F.lower(named)


def template_words(text: Column) -> Column:
    """Lower-cased words, cut at everything but letters, digits, and points or commas between digits."""
    return F.filter(F.split(_spaced(text), r"[^\p{L}\p{Nd}.,]+|[.,](?![0-9])|(?<![0-9])[.,]"), lambda w: w != "")


def _template(words: Column) -> Column:
    return F.transform(words, lambda w, i: _placeholder(words, w, i))


def _hashes(words: Column) -> Column:
    """Hashes of the template's words."""
    return F.transform(words, lambda w, i: F.xxhash64(_placeholder(words, w, i)))


def _placeholder(words: Column, w: Column, i: Column) -> Column:
    """Stands for typed words; a unit word counts after a number only. Most words begin and follow no digit, and end at a comparison."""
    number = lambda x: F.rlike(x, F.lit(r"^[0-9][0-9.,]*$"))
    before = F.coalesce(F.get(words, i - 1), F.lit(""))
    typed = F.when(w.startswith(_NAME), F.lit(_NAME)).when(number(w), F.lit(_NUMBER)).otherwise(w)
    is_unit = (before < ":") & w.isin(UNITS.split("|")) & number(before)
    return F.when(w < ":", typed).when(is_unit, F.lit(_UNIT)).otherwise(w)


def _windows(hashes: Column, width: int | Column, likely=None) -> Column:
    """``at``, ``hash`` and ``ends`` (a hash of first and last) of all runs of ``width`` values, or of those with likely ends."""
    n, ends = F.size(hashes), lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + (width - 1)))
    one = lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(hashes, i + 1, width)).alias("hash"), ends(i).alias("ends"))
    spots = F.sequence(F.lit(0), n - width)
    if likely:
        spots = F.filter(spots, lambda i: likely(ends(i)))
    return F.when(n >= width, F.transform(spots, one)).otherwise(F.array().cast("array<struct<at:int,hash:bigint,ends:bigint>>"))


def _hashed(rows: DataFrame, body: str) -> DataFrame:
    """Adds ``words``, and ``typed``, the hashes of the template's words."""
    words = computed(rows, "words", template_words(F.col(body)))
    return computed(words, "typed", _hashes(F.col("words")))


def _unnamed() -> Column:
    """The words with names as plain words."""
    return F.transform("words", lambda w: F.when(w.startswith(_NAME), F.substring(w, len(_NAME) + 1, 2**31 - 1)).otherwise(w))


def item_windows(items: DataFrame, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id``, ``kind``, ``width``, ``place``, ``hash`` and ``ends`` of every window, its words (``theirs``) and which are slots
    (``slot``), and how many distinct ones the item has of the kind. Kind ``named`` keeps names as words; only items with names have it."""
    own = items.select(order_id(quoted(id_column)).alias("item_id"), F.col(quoted(text)).alias("body"))
    typed = _hashed(own, "body").filter(F.size("words") >= LEAST)
    named = typed.filter(F.exists("words", lambda w: w.startswith(_NAME))).withColumn("words", _unnamed())
    named = computed(named.drop("typed"), "typed", _hashes(F.col("words")))
    out = None
    for kind, rows in (("typed", typed), ("named", named)):
        rows = computed(rows, "slot", F.transform(_template(F.col("words")), lambda w: w.isin(_NUMBER, _NAME, _UNIT)))
        rows = rows.select("item_id", "words", "slot", "typed", F.least(F.size("words"), F.lit(WINDOW)).alias("width"))
        width, after = F.col("width"), F.col("at") + 1
        part = rows.select("item_id", "words", "slot", "width", F.inline(_windows(F.col("typed"), width)))
        part = part.select("item_id", F.lit(kind).alias("kind"), "width", F.col("at").alias("place"), "hash", "ends", F.slice("words", after, width).alias("theirs"), F.slice("slot", after, width).alias("slot"))
        out = part if out is None else out.union(part)
    counts = out.groupBy("item_id", "kind").agg(F.count_distinct("hash").alias("n_windows"))
    return out.join(counts, ["item_id", "kind"])


def _among(windows: DataFrame, column: str):
    """A test whether a hash may be one of the windows' column: 64 bits or more a window, up to the bitmap's most words."""
    size = 1 << max(4, min(MOST_WORDS, windows.count().bit_length()))
    at = lambda h: F.call_function("shiftrightunsigned", h, F.lit(6)).bitwiseAND(F.lit(size - 1))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    set_ = windows.groupBy(at(F.col(column)).alias("id")).agg(F.bit_or(bit(F.col(column))).alias("bits"))
    words = dict(set_.collect())  # 2 ** MOST_WORDS at most
    bitmap = F.from_json(F.lit(json.dumps([words.get(k, 0) for k in range(size)])), "array<bigint>")  # folded to one literal
    return lambda h: F.get(bitmap, at(h).cast("int")).bitwiseAND(bit(h)) != 0


def find_contamination(df: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Found pairs: ``row_id``, ``row_text`` (a hash), ``item_id``, window counts, longest run, slot agreement.

    Null ids appear as ``NO_ID``.
    """
    windows = materialize(item_windows(items, item_id, item_text), "item-windows")
    widths = sorted(r["width"] for r in windows.select("width").distinct().collect())  # six at most
    among, likely_ends, body = _among(windows, "hash"), _among(windows, "ends"), F.col(quoted(text))
    rows = df.select(order_id(quoted(id_column)).alias("row_id"), F.xxhash64(body).alias("row_text"), body.alias("body"))
    hashed = _hashed(rows, "body")
    short = [w for w in widths if w < WINDOW]  # one wrongly told name would hide a short item, so documents have these windows without names too
    if short:
        hashed = computed(hashed, "bare", _hashes(_unnamed()))

    def kept(words: str, width: int) -> Column:
        """Windows of a row that may be an item's, with their words."""
        likely = F.filter(_windows(F.col(words), width, likely_ends), lambda x: among(x["hash"]))
        return F.transform(likely, lambda x: F.struct(x["at"].alias("at"), x["hash"].alias("hash"), F.slice("words", x["at"] + 1, width).alias("own")))

    lists = [*(kept("typed", w) for w in widths), *(kept("bare", w) for w in short)]
    every = lists[0] if len(lists) == 1 else F.concat(*lists) if lists else F.array().cast("array<struct<at:int,hash:bigint,own:array<string>>>")
    seen = hashed.select("row_id", "row_text", F.inline(every))
    value = F.transform("theirs", lambda w, j: F.when(F.get("slot", j), F.struct(w.alias("theirs"), F.get("own", j).alias("own"))))
    matched = seen.join(windows.drop("ends"), "hash").withColumn("values", F.filter(value, lambda v: v.isNotNull()))
    matched = matched.filter((F.col("width") >= TYPED) | F.forall("values", lambda v: v["theirs"] == v["own"]))
    found = matched.groupBy("row_id", "row_text", "item_id", "kind", "n_windows").agg(
        F.count_distinct("hash").alias("n_found"), F.array_sort(F.collect_set(F.struct("place", "at", "width", "hash", "values"))).alias("places")
    )
    agreed = _consistent(materialize(_enough(found), "likely"))
    return agreed.groupBy("row_id", "row_text", "item_id").agg(F.max(F.struct("n_found", "longest", "agreed", "n_windows")).alias("best")).select("row_id", "row_text", "item_id", "best.*")


def _enough(found: DataFrame) -> DataFrame:
    """Rows whose ``places`` make up enough of the item, with the longest run."""
    longest = F.aggregate(
        F.array_sort(F.array_distinct(F.transform("places", lambda p: p["place"]))), F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best")),
        lambda acc, p: F.struct(
            p.alias("last"), F.when(p == acc["last"] + 1, acc["run"] + 1).otherwise(1).alias("run"),
            F.greatest(acc["best"], F.when(p == acc["last"] + 1, acc["run"] + 1).otherwise(1)).alias("best"),
        ), lambda acc: acc["best"],
    )
    return found.withColumn("longest", longest).filter((F.col("n_found") >= SHARE * F.col("n_windows")) | (F.col("longest") >= RUN))


def _alignments(likely: DataFrame) -> DataFrame:
    """Each pair once for every group of its alignments that makes up enough of the item: ``reach``, ``line``."""
    key = ["row_id", "row_text", "item_id", "kind", "n_windows"]
    single = likely.select(*key, F.explode("places").alias("p")).groupBy(*key, (F.col("p.at") - F.col("p.place")).alias("shift")).agg(F.collect_list("p").alias("p"))
    order = Window.partitionBy(*key).orderBy("shift")
    gap = F.col("shift") - F.lag("shift").over(order)
    broken = single.withColumn("gap", gap).withColumns({f"line{r}": F.sum((F.col("gap") > r).cast("int")).over(order) for r in REACH})
    lines = F.array(*(F.struct(F.lit(r).alias("reach"), F.coalesce(f"line{r}", F.lit(0)).alias("line")) for r in REACH))
    grouped = broken.select(*key, "p", F.inline(lines)).groupBy(*key, "reach", "line").agg(F.array_sort(F.flatten(F.collect_list("p"))).alias("places"))
    grouped = grouped.withColumn("n_found", F.size(F.array_distinct(F.transform("places", lambda p: p["hash"]))).cast("long"))
    whole = likely.select(*key, F.lit(-1).alias("reach"), F.lit(0).cast("long").alias("line"), "places", "n_found", "longest")
    return _enough(grouped).unionByName(whole)


def _consistent(likely: DataFrame) -> DataFrame:
    """Keeps the pairs whose slots agree: each value of the item stands for one value of the document."""
    lines, key = materialize(_alignments(likely), "alignments"), ["row_id", "row_text", "item_id", "kind", "reach", "line"]
    slot = lines.select(*key, F.explode(F.array_distinct(F.flatten(F.transform("places", lambda p: p["values"])))).alias("s"))
    values = slot.groupBy(*key, "s.theirs").agg(F.count("*").alias("n"))
    agreed = values.groupBy(*key).agg(F.avg((F.col("n") == 1).cast("double")).alias("agreed"))
    out = lines.drop("places").join(agreed, key, "left").withColumn("agreed", F.coalesce("agreed", F.lit(1.0))).filter(F.col("agreed") >= CONSISTENT)
    best = out.groupBy("row_id", "row_text", "item_id", "kind", "n_windows").agg(F.max(F.struct("n_found", "longest", "agreed")).alias("best"))
    return best.select("row_id", "row_text", "item_id", "n_windows", "best.*")


def mark_contaminated(df: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """All rows with ``contaminated`` and ``n_items``; columns of these names are replaced."""
    found = materialize(find_contamination(df, items, id_column, text, **names), "contaminated").groupBy("row_id", "row_text").agg(F.count("*").alias("found_items"))
    base = df.select(*(F.col(quoted(c)) for c in df.columns if c.lower() not in ("contaminated", "n_items")))
    key, mark, n = (fresh(base, x) for x in ("row_id", "row_text", "found_items"))
    rows = base.withColumns({key: order_id(quoted(id_column)), mark: F.xxhash64(F.col(quoted(text)))})
    out = rows.join(found.toDF(key, mark, n), [key, mark], "left")
    return out.select(*(F.col(quoted(c)) for c in base.columns), F.col(n).isNotNull().alias("contaminated"), F.coalesce(n, F.lit(0)).cast("long").alias("n_items"))
