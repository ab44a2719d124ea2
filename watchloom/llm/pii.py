r"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust the score.

Kinds: email, ip, card (Luhn), phone; and by the method iban (mod 97) and national_id (three-two-four
digits), which needs a context word beside it. A proposal starts with its kind's score, gains for a passed
checksum and for a context word within ``CONTEXT`` characters before it, and loses where a word there
speaks against it. Proposals of the first four kinds that pass their test are always kept; of the others
those with a score of ``KEEP`` or more.

Every pattern starts only where no longer match could begin, and is possessive, so that long runs of
digits or word characters take linear time and no deep recursion.

Defined cases: a null text is empty and has no spans. Rows are independent: repeated rows, null ids, ties
and other columns pass through. Offsets count code points; ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.llm.common import quoted

# Kinds in their order, the score each starts with, and the words that raise or lower it.
KINDS = ("email", "ip", "card", "phone", "iban", "national_id")
START = {"email": 0.8, "ip": 0.5, "card": 0.4, "phone": 0.5, "iban": 0.4, "national_id": 0.3}
CHECKED = {"card": 0.4, "iban": 0.4}
FOR = {
    "email": "mail|contact|write|address", "ip": "ip|host|server|address|login", "card": "card|visa|credit|debit|payment",
    "phone": "phone|call|tel|mobile|fax", "iban": "iban|account|bank|transfer", "national_id": "ssn|social security|national id|tax id",
}
AGAINST = {
    "email": "example of", "ip": "version|release", "card": "order|invoice|tracking|serial", "phone": "order|invoice|serial",
    "iban": "serial|part number", "national_id": "order|invoice|serial|part number",
}
RAISE, LOWER, CONTEXT, KEEP = 0.3, 0.3, 40, 0.6

_ADDRESS = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_ADDRESS})|\G){_ADDRESS}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}+(?: [A-Z0-9]{1,3})?+)(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Cheap tests that every text with a match passes.
NEEDS = {
    "email": lambda t: F.contains(t, F.lit("@")), "ip": lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]")), "card": lambda t: F.rlike(t, F.lit("[0-9][ -]?[0-9]")),
    "phone": lambda t: F.contains(t, F.lit("+")), "iban": lambda t: F.rlike(t, F.lit("[A-Z]{2}[0-9]{2}")), "national_id": lambda t: F.rlike(t, F.lit("[0-9]-[0-9]")),
}


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0),
        lambda acc, i: acc + _luhn_digit(F.ascii(F.substr(digits, i, F.lit(1))) - 48, (n - i) % 2 == 1),
    )
    return (n > 0) & (total % 10 == 0)


def _luhn_digit(d: Column, doubled: Column) -> Column:
    return F.when(doubled, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)


def mod97(text: Column) -> Column:
    """Whether an account number (spaces dropped) leaves 1 modulo 97, letters counting from 10."""
    plain = F.regexp_replace(text, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substr(moved, i, F.lit(1)))
        return F.when(c < 58, (acc * 10 + c - 48) % 97).otherwise((acc * 100 + c - 55) % 97)

    n = F.length(plain)
    return (n >= 15) & (n <= 34) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), step) == 1)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, r"^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substr(p, F.lit(1), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        d = _digits(m)
        return F.length(d).between(14, 19) & luhn(d)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        return mod97(m)
    return F.lit(True)


def _proposals(kind: str, text: Column, found: Column, gaps: Column) -> Column:
    """Kept matches with start, end and score; starts come from the lengths of what lies between matches."""

    def place(acc: Column, x: Column) -> Column:
        begin = acc["p"] + F.length(x["g"])
        end = begin + F.length(x["m"])
        return F.struct(end.alias("p"), F.concat(acc["o"], F.array(F.struct(begin.alias("s"), end.alias("e"), x["m"].alias("m")))).alias("o"))

    pairs = F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g"))
    start = F.struct(F.lit(0).alias("p"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("o"))
    placed = F.aggregate(pairs, start, place, lambda acc: acc["o"])

    def scored(x: Column) -> Column:
        near = F.lower(F.substr(text, F.greatest(x["s"] - CONTEXT, F.lit(0)) + 1, F.least(x["s"], F.lit(CONTEXT))))
        score = F.lit(START[kind] + CHECKED.get(kind, 0.0))
        score += F.when(F.rlike(near, F.lit(rf"\b(?:{FOR[kind]})\b")), RAISE).otherwise(0.0)
        score -= F.when(F.rlike(near, F.lit(rf"\b(?:{AGAINST[kind]})\b")), LOWER).otherwise(0.0)
        return F.struct(x["s"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["e"].alias("end"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2).alias("score"))

    spans = F.transform(F.filter(placed, lambda x: _valid(kind, x["m"])), scored)
    return spans if KINDS.index(kind) < 4 else F.filter(spans, lambda x: x["score"] >= KEEP)


def find_personal_data(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``pii``: all spans (start, kind index, end, score) ordered by start, then kind."""
    rows = df.select(*(F.col(quoted(c)) for c in df.columns if c.lower() != "pii" and not c.lower().startswith("pii_")))
    body = F.coalesce(F.col(quoted(text)), F.lit(""))
    none = F.array().cast("array<string>")
    found, gaps = {}, {}
    for kind in KINDS:
        needed = NEEDS[kind](body)
        found[f"pii_m_{kind}"] = F.when(needed, F.regexp_extract_all(body, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(none)
        gaps[f"pii_g_{kind}"] = F.when(F.size(f"pii_m_{kind}") > 0, F.split(body, PATTERNS[kind], -1)).otherwise(none)
    spans = {f"pii_s_{k}": _proposals(k, body, F.col(f"pii_m_{k}"), F.col(f"pii_g_{k}")) for k in KINDS}
    out = rows.withColumns(found).withColumns(gaps).withColumns(spans)
    return out.withColumn("pii", F.sort_array(F.concat(*spans))).drop(*found, *gaps, *spans)


def listing(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
