"""Nearest entries by lists against comparing with every entry."""

import numpy as np
import pandas as pd
import pytest

from watchloom.operators import retrieval


def frame(spark, vectors, first=0):
    data = [(first + i, None if v is None else [None if x is None else float(x) for x in v], "x") for i, v in enumerate(vectors)]
    return spark.createDataFrame(data, "id long, v array<double>, entry string")


def plain(rows, entries, k):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    near = np.round(unit(rows) @ unit(entries).T, 9)
    order = np.lexsort((np.broadcast_to(np.arange(len(entries)), near.shape), -near))[:, :k]
    return {(i, int(e), r + 1) for i, row in enumerate(order) for r, e in enumerate(row)}


def found(hits):
    return {(r.id, r.hit, r["rank"]) for r in hits.collect()}


def clustered(seed, n, width=8, groups=12, spread=0.05):
    rng = np.random.default_rng(seed)
    middles = np.random.default_rng(7).normal(size=(groups, width))
    return middles[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, width))


@pytest.mark.parametrize("settings", [{}, {"lists": 30, "block_rows": 20}, {"lists": 3, "sample_rows": 10}])
def test_same_hits_as_comparing_with_all(spark, settings):
    entries, rows = clustered(1, 900), np.vstack([clustered(2, 60), np.random.default_rng(3).normal(size=(20, 8))])
    index = retrieval.build_lists(frame(spark, entries), "id", "v", **settings)
    hits = retrieval.nearest_in_lists(frame(spark, rows), "id", "v", index, 4, "hit", part_rows=15)
    assert found(hits) == plain(rows, entries, 4)


def test_a_search_reads_a_fraction_of_the_entries(spark):
    entries, rows = clustered(1, 3000, groups=40), clustered(2, 100, groups=40)
    index = retrieval.build_lists(frame(spark, entries), "id", "v", lists=40)
    units = retrieval._usable(frame(spark, rows), "id", "v")
    first = retrieval._compare(retrieval._probe(units, index, True), index, 3, 1000)
    floors = retrieval._best(first, 3).selectExpr("id", "-hits[2].neg as floor")
    more = retrieval._compare(retrieval._probe(units.join(floors, "id"), index, False), index, 3, 1000)
    read = first.unionByName(more).agg({"compared": "sum"}).first()[0] / 3  # a block gives three hits
    assert read < 0.25 * len(entries) * len(rows)


def test_equal_entries_tie_by_id_and_a_hot_list_is_whole(spark):
    entries = np.vstack([np.ones((300, 4)), -np.ones((5, 4))])
    index = retrieval.build_lists(frame(spark, entries), "id", "v", block_rows=50)
    hits = retrieval.nearest_in_lists(frame(spark, np.ones((70, 4)) * 2), "id", "v", index, 3, "hit", part_rows=10)
    assert found(hits) == {(i, e, e + 1) for i in range(70) for e in range(3)}
    assert {round(r.similarity, 9) for r in hits.collect()} == {1.0}


def test_rows_without_a_direction_and_empty_tables(spark):
    odd = frame(spark, [None, [0, 0], [1, None], [float("nan"), 1], [3, 4]])
    index = retrieval.build_lists(odd, "id", "v")
    assert found(retrieval.nearest_in_lists(odd, "id", "v", index, 2, "hit")) == {(4, 4, 1)}
    empty = retrieval.build_lists(odd.filter("false"), "id", "v")
    assert found(retrieval.nearest_in_lists(odd, "id", "v", empty, 2, "hit")) == set()
    assert found(retrieval.nearest_in_lists(odd.filter("false"), "id", "v", index, 2, "hit")) == set()


def test_pairs_of_rows_and_lists_leave_in_pieces():
    part = pd.DataFrame({"id": range(300), "unit": [[1.0, 0.0]] * 300})
    row, which = np.nonzero(np.ones((300, 200), dtype=bool))
    pieces = [*retrieval._pairs(part, row, which)]
    assert max(map(len, pieces)) <= retrieval.PROBES < len(row)
    whole = pd.concat(pieces)
    assert whole["id"].tolist() == row.tolist() and whole["list"].tolist() == which.tolist()
