"""Activity features, per-entity sequences, context joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.functions import times
from watchloom.operators.access import small
from watchloom.session import materialize
from watchloom.schemas import MOVING_AVERAGE_WINDOW


def activity_features(
    events: DataFrame, seconds: int, classes: dict[str, Column], flags: dict[str, Column] | None = None,
    entity: str = "identity",
) -> DataFrame:
    """Counts of each activity class per entity and time step, as one ``features`` array.

    ``flags`` are conditions kept per step as "any event satisfies it". One partial and one
    final aggregation: however many events an entity has, it leaves one row per step.
    """
    counted = events.groupBy(entity, times.window_floor(F.col("ts"), seconds).alias("step_start")).agg(
        F.array(*[F.count_if(c).cast("double") for c in classes.values()]).alias("features"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        *[F.max(c).alias(name) for name, c in (flags or {}).items()],
    )
    return counted


def sequences(steps: DataFrame, gap_seconds: int, entity: str = "identity") -> DataFrame:
    """Steps -> ordered sequences: ``seq_no`` splits at inactivity gaps, ``t`` counts from 1.

    Works on steps, not events, so an entity's window is as long as its elapsed steps.
    """
    in_time = Window.partitionBy(entity).orderBy("step_start")
    gap = F.unix_micros("first_ts") - F.unix_micros(F.lag("last_ts").over(in_time))
    starts = F.when(gap.isNull() | (gap > gap_seconds * 1_000_000), 1).otherwise(0)
    numbered = steps.withColumn("_starts", starts).withColumn(
        "seq_no", F.sum("_starts").over(in_time.rowsBetween(Window.unboundedPreceding, 0))
    )
    inside = Window.partitionBy(entity, "seq_no")
    return numbered.withColumns(
        {
            "t": F.row_number().over(inside.orderBy("step_start")),
            "seq_start": F.min("step_start").over(inside),
        }
    ).drop("_starts", "first_ts", "last_ts")


def benign_only(seqs: DataFrame, flag: str, entity: str = "identity") -> DataFrame:
    """Sequences in which no step carries the flag."""
    bad = seqs.filter(flag).select(entity, "seq_no").distinct()
    return seqs.join(bad, [entity, "seq_no"], "left_anti")


def moving_average(seqs: DataFrame, size: int = MOVING_AVERAGE_WINDOW, entity: str = "identity") -> DataFrame:
    """Mean of a step's features over the last ``size`` steps of the sequence."""
    level = F.aggregate("features", F.lit(0.0), lambda a, x: a + x) / F.size("features")
    frame = Window.partitionBy(entity, "seq_no").orderBy("t").rowsBetween(1 - size, 0)
    return seqs.withColumn("level", level).withColumn("moving_avg", F.avg("level").over(frame))


def standard_scaler(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``z_<column>`` = (x - mean) / population deviation; a constant column gives 0.

    Mean and deviation are scalar subqueries over one aggregation: nothing is joined.
    """
    stats = rows.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    )
    scaled = {}
    for c in columns:
        mean, std = stats.select(f"m_{c}").scalar(), stats.select(f"s_{c}").scalar()
        scaled[f"z_{c}"] = F.when(std == 0, 0.0).otherwise((F.col(c) - mean) / std)
    return rows.withColumns(scaled)


def attach_labels(events: DataFrame, scenarios: DataFrame, run: str = "scenario_run_id") -> DataFrame:
    """Label and technique of the scenario run each event belongs to; outside any run: benign."""
    labelled = events.join(small(scenarios), run, "left")
    return labelled.withColumn("label", F.coalesce("label", F.lit("benign")))


def identity_context(sequence_rows: DataFrame, attributes: DataFrame, at: str, entity: str = "identity") -> DataFrame:
    """Role, privilege and credential age of the entity joined to its action rows."""
    joined = sequence_rows.join(small(attributes), entity, "left")
    return joined.withColumn("credential_age_days", F.datediff(F.col(at), F.col("credential_issued")))


def static_rule(rows: DataFrame, max_privilege: int, max_age_days: int) -> DataFrame:
    """Rule baseline: alert on high privilege or an old credential."""
    return rows.withColumn(
        "rule",
        F.when(F.col("privilege") >= max_privilege, "privilege")
        .when(F.col("credential_age_days") > max_age_days, "credential_age")
        .otherwise("none"),
    )


def unseen_category(rows: DataFrame, vocabulary: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose category combination never occurred in training."""
    known = materialize(vocabulary.select(*columns).distinct(), "vocabulary")  # counted and joined
    return rows.join(small(known), columns, "left_anti")


_NOT_LETTERS = r"[^\p{L}]+"


def _phrase_pattern(phrases: list[tuple[str, ...]]) -> str:
    """A pattern for the places where one of ``phrases`` begins, none of which is the start of another: words that
    phrases share at their start are tried once. Words are letters only, so nothing needs escaping."""
    def branches(rest: list[tuple[str, ...]]) -> str:
        heads: dict[str, list[tuple[str, ...]]] = {}
        for words in sorted(rest):
            heads.setdefault(words[0], []).append(words[1:])
        return "|".join(head + (" (?:" + branches(tails) + ")" if tails[0] else " ") for head, tails in heads.items())

    return f" (?={branches(phrases)})"


def phrase_weight(text: Column, weights: dict[str, float]) -> Column:
    """Sum of ``weights`` over all places where a phrase stands in ``text``, overlaps included, as one expression.

    Words are maximal runs of letters, lower-cased, in texts and phrases alike. Phrases of one weight are looked for in
    one pass; a phrase that begins with another one goes to a later pass. Null texts have the sum 0.
    """
    passes: dict[tuple[float, int], list[tuple[str, ...]]] = {}
    for phrase, weight in weights.items():
        words = tuple(phrase.split(" "))
        starts = sum(weights.get(" ".join(words[:n])) == weight for n in range(1, len(words)))
        passes.setdefault((weight, starts), []).append(words)
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), _NOT_LETTERS, " "), F.lit(" "))
    total = F.lit(0.0)
    for (weight, _), phrases in sorted(passes.items()):
        total = total + F.regexp_count(spaced, F.lit(_phrase_pattern(phrases))) * F.lit(weight)
    return F.coalesce(total, F.lit(0.0))


def lexicon_weight(texts: DataFrame, text_id: str, text: Column, lexicon: DataFrame, limit: int = 1_000) -> DataFrame:
    """Sum of lexicon weights over all words and phrases of each text: a soft signal, 0 without a match.

    A lexicon of at most ``limit`` phrases becomes one expression: no row is split and nothing is shuffled. A larger
    one is joined: the words of one text, and its runs as long as a phrase, are summed up where they were split,
    before the shuffle. Both give one row a text (ids are distinct) and count a place for each phrase that begins there.
    """
    joined = lambda column: F.trim(F.regexp_replace(F.lower(column), _NOT_LETTERS, " "))
    terms = lexicon.select(joined(F.col("term")).alias("term"), "weight").filter("term <> '' AND weight IS NOT NULL")
    terms = terms.groupBy("term").agg(F.sum("weight").alias("weight"))
    few = terms.limit(limit + 1).collect()
    if len(few) <= limit:
        return texts.select(text_id, phrase_weight(text, {r.term: r.weight for r in few}).alias("signal"))
    lengths = [r[0] for r in terms.select(F.size(F.split("term", " "))).distinct().collect()]  # at most the longest phrase
    words = F.filter(F.split(F.lower(text), _NOT_LETTERS), lambda w: w != "")
    runs = lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.size("_words") + 1), lambda i: i + n - 1 <= F.size("_words")), lambda i: F.array_join(F.slice("_words", i, n), " "))
    split = texts.select(text_id, F.coalesce(words, F.array().cast("array<string>")).alias("_words"))
    spread = split.select(text_id, F.explode_outer(F.concat(*[runs(n) for n in sorted(lengths)])).alias("term"))
    weighted = spread.join(small(terms), "term", "left")
    return weighted.groupBy(text_id).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("signal"))
