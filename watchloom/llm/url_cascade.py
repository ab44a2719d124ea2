"""URL filter: a rule list first, then exact membership of the host in a block list by a Bloom filter cascade.

Level 1 encodes the listed keys. The keys of the corpus that pass it by mistake are encoded in level 2,
the listed keys that pass level 2 by mistake in level 3, and so on until a level has no mistakes. As
every key of the corpus was used to build the cascade, its answer is exact for every row, without a join.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is looked
up under the empty key. Rows are independent, so repeated rows get equal answers. An empty table or an
empty list gives no levels, and nothing is listed. Columns of the input other than the url are kept.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.llm.common import fresh, quoted
from watchloom.session import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: More listed keys than this are joined instead: the levels of a list take about 20 bits a key.
MAX_LISTED = 8_000_000


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3)))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and action of the longest of ``(action, host, path)`` rules that fits; null where none does."""
    name = action = None
    for act, own, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        name = F.when(fits, own + start) if name is None else name.when(fits, own + start)
        action = F.when(fits, act) if action is None else action.when(fits, act)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, action)


class Level:
    """One Bloom filter: ``bits`` long, ``probes`` hashes a key, its set bits as 32-bit words."""

    def __init__(self, number: int, bits: int, probes: int, words: list[int]):
        self.number, self.bits, self.probes, self.words = number, bits, probes, words

    def positions(self, key: Column) -> list[Column]:
        return _positions(key, self.number, self.bits, self.probes)

    def test(self, key: Column) -> Column:
        table = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")  # folded to one literal
        found = None
        for at in self.positions(key):
            bit = F.get(table, F.floor(at / 32).cast("int")).bitwiseAND(F.pow(F.lit(2), at % 32).cast("long")) != 0
            found = bit if found is None else found & bit
        return found


def _positions(key: Column, number: int, bits: int, probes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(number), F.lit(j), key), F.lit(bits)) for j in range(probes)]


def _encode(keys: DataFrame, key: str, number: int, count: int, rate: float) -> Level:
    probes = max(1, math.ceil(-math.log2(rate)))
    bits = max(64, math.ceil(count * probes / math.log(2)))
    at = keys.select(F.explode(F.array(*_positions(F.col(key), number, bits, probes))).alias("at"))
    words = [0] * (bits // 32 + 1)  # at most about 3 bits a key and probe, MAX_LISTED keys
    rows = at.groupBy(F.floor(F.col("at") / 32).alias("word")).agg(
        F.bit_or(F.pow(F.lit(2), F.col("at") % 32).cast("long")).alias("bits")
    )
    for row in rows.toLocalIterator():
        words[row["word"]] = row["bits"]
    return Level(number, bits, probes, words)


def build_cascade(universe: DataFrame, key: str, listed: str) -> list[Level]:
    """Levels over a table of distinct keys with a boolean column ``listed``; the table is read once a level."""
    counts = {r[listed]: r["n"] for r in universe.groupBy(listed).agg(F.count("*").alias("n")).collect()}
    inside, outside = counts.get(True, 0), counts.get(False, 0)
    if not inside:
        return []
    levels: list[Level] = []
    encode, other, count = universe.filter(F.col(listed)), universe.filter(~F.col(listed)), inside
    rate = min(0.5, inside * math.sqrt(0.5) / max(1, outside))
    while count:
        level = _encode(encode, key, len(levels), count, rate)
        levels.append(level)
        passed = other.filter(level.test(F.col(key)))
        count, encode, other, rate = passed.count(), passed, encode, 0.5
    return levels


def member(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed: the first level that refuses it tells."""
    if not levels:
        return F.lit(False)
    out = None
    for level in levels:
        refused, answer = ~level.test(key), F.lit(level.number % 2 == 1)
        out = F.when(refused, answer) if out is None else out.when(refused, answer)
    return out.otherwise(F.lit(len(levels) % 2 == 1))


def filter_urls(df: DataFrame, rules: list[tuple[str, str, str]], is_listed, url: str = "url") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` (and replaces columns of these names).

    ``is_listed`` takes the host column of the corpus's distinct hosts and tells which are on the list.
    """
    host, path = host_path(F.col(quoted(url)))
    own = {"host", "path", "rule", "verdict"}
    hosts = df.select(host.alias("host")).groupBy("host").agg(F.lit(1).alias("one"))
    universe = materialize(hosts.select("host", F.coalesce(is_listed(F.col("host")), F.lit(False)).alias("listed")), "hosts")
    rule, action = longest_rule(F.col("host"), F.col("path"), rules)
    kept = [F.col(quoted(c)) for c in df.columns if c.lower() not in own]
    rows = df.select(*kept, host.alias("host"), path.alias("path"))
    if universe.filter("listed").count() > MAX_LISTED:
        mark = fresh(rows, "is_listed")
        listed = universe.filter("listed").select("host", F.lit(True).alias(mark))
        rows, inside = rows.join(listed, "host", "left"), F.coalesce(F.col(mark), F.lit(False))
    else:
        mark, inside = None, member(F.col("host"), build_cascade(universe, "host", "listed"))
    out = rows.withColumn("rule", rule).withColumn(
        "verdict", F.coalesce(action, F.when(inside, F.lit("block")).otherwise(F.lit("allow")))
    )
    return out.drop(mark) if mark else out
