"""Nearest entries of a large index: inverted lists with a bound that proves the answer.

The index is cut in lists around coarse centres. A list knows the widest angle between its centre and an entry, so no
entry of it can be nearer to a vector than the angle to the centre less that width. A search reads the list with the
nearest centre, then only the lists whose bound reaches the similarity of the ``k``-th hit so far: the answer is that
of comparing with every entry.
"""

from __future__ import annotations

import dataclasses
import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLACK = 1e-9  # similarities and bounds are computed with smaller errors
PLACES = 12  # similarities are compared at so many digits, so equal vectors tie
ANGLES = 1 << 19  # angles between rows and centres that a task holds at once
PROBES = 10_000  # rows beside a list that a task hands on at once, each with its vector


@dataclasses.dataclass
class ListIndex:
    """``entries``: list, block, id, unit vector. The centres (at most ``most_lists`` of them) are on the driver."""

    entries: DataFrame
    centres: np.ndarray
    width: np.ndarray  # widest angle of each list
    blocks: np.ndarray  # blocks of each list


def _unit(vector: str) -> Column:
    doubles = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(doubles, lambda x: x / norm))


def _usable(rows: DataFrame, row_id: str, vector: str) -> DataFrame:
    """Ids and unit vectors; a row without a vector, of length 0 or with null or NaN in it has no direction."""
    rows = rows.select(F.col(row_id).alias("id"), _unit(vector).alias("unit"))
    return rows.filter(F.col("unit").isNotNull() & ~F.exists("unit", lambda x: F.coalesce(F.isnan(x), F.lit(True))))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _angles(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centres.T, -1.0, 1.0))


def build_lists(
    index: DataFrame, index_id: str, vector: str, lists: int | None = None, most_lists: int = 4096,
    sample_rows: int = 100_000, block_rows: int = 2_000,
) -> ListIndex:
    """Index every row with a direction; ids are distinct, extra columns are left out, an empty index gives no hits.

    The centres come from k-means over about ``sample_rows`` rows, picked by a hash of the id; they decide about speed
    only. There are ``lists`` of them, or the square root of the rows, and never more than ``most_lists``: a list that
    grows beyond ``block_rows`` is cut in blocks, which are joined one by one.
    """
    rows = materialize(_usable(index, index_id, vector), "units")
    spark, n = rows.sparkSession, rows.count()
    if not n:
        return ListIndex(rows.select(F.lit(0).alias("list"), F.lit(0).alias("block"), "id", "unit"), np.zeros((0, 0)), np.zeros(0), np.zeros(0, int))
    lists = max(1, min(most_lists, lists or math.isqrt(n)))
    picked = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, sample_rows / n))
    sample = rows.filter(picked).select(array_to_vector("unit").alias("v"))
    sample = sample if sample.limit(1).count() else rows.limit(1).select(array_to_vector("unit").alias("v"))
    fitted = KMeans(k=max(2, lists), seed=1, maxIter=5, featuresCol="v", distanceMeasure="cosine").fit(sample).clusterCenters()
    centres = np.array(fitted, dtype=float)
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            step = max(1, ANGLES // len(shared.value))
            for at in range(0, len(batch), step):
                part = batch.iloc[at : at + step]
                angles = _angles(_matrix(part["unit"]), shared.value)
                yield part.assign(list=angles.argmin(axis=1).astype("int32"), angle=angles.min(axis=1))

    kind = rows.schema["id"].dataType.simpleString()
    placed = materialize(rows.mapInPandas(assign, f"id {kind}, unit array<double>, list int, angle double"), "placed")
    sizes = placed.groupBy("list").agg(F.max("angle").alias("width"), F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    found = {r.list: r for r in sizes.collect()}  # one row a list
    used = sorted(found)
    number = {old: new for new, old in enumerate(used)}
    renamed = spark.createDataFrame([(old, number[old], found[old].blocks) for old in used], "list int, number int, blocks int")
    entries = placed.join(F.broadcast(renamed), "list").select(
        F.col("number").alias("list"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "unit"
    )
    return ListIndex(
        materialize(entries, "entries"), centres[used], np.array([found[i].width for i in used]), np.array([found[i].blocks for i in used]),
    )


def _pairs(part: pd.DataFrame, row: np.ndarray, which: np.ndarray) -> Iterator[pd.DataFrame]:
    """Rows beside lists, in pieces: a row may read every list, and its vector goes with each."""
    for at in range(0, len(row), PROBES):
        these = slice(at, at + PROBES)
        yield part[["id", "unit"]].iloc[row[these]].assign(list=which[these].astype("int32"))


def _probe(rows: DataFrame, index: ListIndex, first: bool) -> DataFrame:
    """Rows beside the lists they read: the nearest one, or all others that may hold a better hit than ``floor``."""
    shared = rows.sparkSession.sparkContext.broadcast((index.centres, index.width))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, width = shared.value
        step = max(1, ANGLES // len(centres))
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.iloc[at : at + step]
                angles = _angles(_matrix(part["unit"]), centres)
                nearest = angles.argmin(axis=1)
                if first:
                    yield part[["id", "unit"]].assign(list=nearest.astype("int32"))
                    continue
                best = np.cos(np.maximum(angles - width, 0.0))
                may = best >= part["floor"].to_numpy()[:, None] - SLACK
                may[np.arange(len(part)), nearest] = False
                row, which = np.nonzero(may)
                yield from _pairs(part, row, which)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(work, f"id {kind}, unit array<double>, list int")


def _compare(probes: DataFrame, index: ListIndex, k: int, part_rows: int) -> DataFrame:
    """The best ``k`` hits of each row in each block it reads. A list with many readers is repeated, so that a group has
    one block and about ``part_rows`` rows; a group is compared in pieces."""
    probes = materialize(probes, "probes")
    kind, entry_kind = probes.schema["id"].dataType.simpleString(), index.entries.schema["id"].dataType.simpleString()
    readers = probes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts"))
    blocks = probes.sparkSession.createDataFrame([(i, int(b)) for i, b in enumerate(index.blocks)], "list int, blocks int")
    plan = materialize(readers.join(F.broadcast(blocks), "list"), "readers")  # one row a list
    left = probes.join(F.broadcast(plan), "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "unit"
    )
    right = index.entries.join(F.broadcast(plan.drop("blocks")), "list").select(
        "list", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("entry"), "unit"
    )

    def work(rows: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        done = []
        if len(rows) and len(entries):
            entries = entries.sort_values("entry", kind="stable")
            names, units = entries["entry"].to_numpy(), _matrix(entries["unit"])
            for at in range(0, len(rows), 500):
                piece = rows.iloc[at : at + 500]
                near = np.round(_matrix(piece["unit"]) @ units.T, PLACES)
                order = np.argsort(-near, axis=1, kind="stable")[:, :k]
                done.append(pd.DataFrame({
                    "id": np.repeat(piece["id"].to_numpy(), order.shape[1]), "entry": names[order].ravel(),
                    "similarity": np.take_along_axis(near, order, axis=1).ravel(), "compared": len(names),
                }))
        return pd.concat(done) if done else pd.DataFrame({"id": [], "entry": [], "similarity": [], "compared": []})

    key = ["list", "block", "part"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(
        work, f"id {kind}, entry {entry_kind}, similarity double, compared long"
    )


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each row; a row has at most ``k`` hits a block read."""
    kept = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("neg"), "entry"))), 1, k)
    return hits.groupBy("id").agg(kept.alias("hits"))


def nearest_in_lists(
    rows: DataFrame, row_id: str, vector: str, index: ListIndex, k: int, index_id: str = "entry", part_rows: int = 20_000
) -> DataFrame:
    """The ``k`` entries nearest to each row by cosine similarity, ties by entry: (row id, entry, similarity, rank).

    ``row_id`` is distinct. Rows without a direction have no hits, as have all rows with an empty index; an index
    with fewer than ``k`` entries gives all of them.
    """
    usable = _usable(rows, row_id, vector)
    if not len(index.centres):
        none = usable.filter("false").join(index.entries.select(F.col("id").alias("entry")), F.lit(False))
        return none.select(F.col("id").alias(row_id), F.col("entry").alias(index_id), F.lit(0.0).alias("similarity"), F.lit(1).alias("rank"))
    units = materialize(usable, "searches")
    near = materialize(_compare(_probe(units, index, True), index, k, part_rows), "near")
    floors = _best(near, k).select("id", F.when(F.size("hits") >= k, -F.col("hits")[k - 1]["neg"]).otherwise(F.lit(-2.0)).alias("floor"))
    more = _compare(_probe(units.join(floors, "id"), index, False), index, k, part_rows)
    best = _best(near.unionByName(more), k)
    return best.select(F.col("id").alias(row_id), F.posexplode("hits").alias("place", "hit")).select(
        row_id, F.col("hit.entry").alias(index_id), (-F.col("hit.neg")).alias("similarity"), (F.col("place") + 1).alias("rank")
    )
