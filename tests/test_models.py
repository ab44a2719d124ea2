"""The recurrent model on fixed weights against a plain loop; out-of-fold scores."""

import numpy as np
from pyspark.sql import functions as F

from watchloom.operators import models


def plain_errors(x, w):
    """The cell equations one step after another, for one sequence."""
    def layer(steps, name):
        h, c, out = np.zeros(w[f"{name}.state"].shape[0]), np.zeros(w[f"{name}.state"].shape[0]), []
        for step in steps:
            i, f, g, o = np.split(step @ w[f"{name}.input"] + h @ w[f"{name}.state"] + w[f"{name}.bias"], 4)
            c = c / (1 + np.exp(-f)) + np.tanh(g) / (1 + np.exp(-i))
            h = np.tanh(c) / (1 + np.exp(-o))
            out.append(h)
        return out

    code = layer(layer(x, "encoder0"), "encoder1")[-1]
    rebuilt = np.array(layer(layer([code] * len(x), "decoder0"), "decoder1"))
    return ((rebuilt - x) ** 2).mean(axis=0)


def test_weights_survive_a_table(spark, tmp_path):
    weights = models.random_weights(3, 4, seed=5)
    models.weights_table(spark, weights).write.parquet(str(tmp_path / "w"))
    back = models.weights_of(spark.read.parquet(str(tmp_path / "w")))
    assert back.keys() == weights.keys() and all(np.array_equal(back[k], weights[k]) for k in weights)


def test_recurrent_errors_equal_the_plain_loop(spark):
    rng = np.random.default_rng(1)
    lengths = [1, 1, 2, 5, 5, 5, 64, 65, 700, 3, 1]
    seqs = {(f"u{k % 4}", k): rng.normal(size=(n, 3)) for k, n in enumerate(lengths)}
    rows = [(who, k, t, step.tolist()) for (who, k), x in seqs.items() for t, step in enumerate(x)]
    df = spark.createDataFrame(rows, "identity string, seq_no long, t int, features array<double>").orderBy(F.rand(3))
    weights = models.random_weights(3, 4, seed=2)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for rows_a_batch in (7, 64, 10000):  # sequences end at, before and behind the ends of batches
            spark.conf.set(size, rows_a_batch)
            got = models.recurrent_errors(df, models.weights_table(spark, weights)).collect()
            assert {(r["identity"], r["seq_no"]): r["length"] for r in got} == {k: len(x) for k, x in seqs.items()}
            for r in got:
                want = plain_errors(seqs[r["identity"], r["seq_no"]], weights)
                assert np.allclose(r["errors"], want) and np.isclose(r["mse"], min(1.0, want.mean()))
    finally:
        spark.conf.set(size, before)


def test_a_long_sequence_is_not_gathered(spark):
    n = 60_000
    df = spark.range(n).select(F.lit("u").alias("identity"), F.lit(0).alias("seq_no"), F.col("id").alias("t"), F.array(F.sin("id"), F.cos(F.col("id") * 3)).alias("features"))
    weights = models.random_weights(2, 3, seed=4)
    got = models.recurrent_errors(df, models.weights_table(spark, weights)).first()
    t = np.arange(n)
    assert got["length"] == n and np.allclose(got["errors"], plain_errors(np.stack([np.sin(t), np.cos(t * 3)], 1), weights))
    assert models.recurrent_errors(df.limit(0), models.weights_table(spark, weights)).count() == 0


def test_every_row_gets_a_score_from_a_model_that_never_saw_it(spark):
    texts = {1: "powershell -enc {0} | iex http://10.0.0.{0}/a", 0: "please send the report {0} to the team"}
    rows = [(k, texts[k % 3 == 0].format(k), None if k % 10 == 7 else float(k % 3 == 0)) for k in range(240)] + [(500, None, None), (501, "", 0.0), (None, "cmd /c del C:\\\\x\\\\y", 1.0)]
    df = spark.createDataFrame(rows, "id long, text string, label double")
    got = models.cross_fitted(df, "id", "text", "label", F.coalesce(F.col("text").contains("iex"), F.lit(False)), folds=3, buckets=256)
    found = got.collect()
    assert len(found) == len(rows) and len({r["fold"] for r in found}) == 3
    assert all(0 <= r["score"] <= 1 for r in found)
    assert sum((r["score"] > 0.5) == (r["label"] == 1) for r in found if r["label"] is not None) > 0.95 * 218
    # A label changed in one fold changes the scores of the other folds only.
    first = next(r for r in found if r["label"] is not None and r["id"] is not None)
    turned = df.withColumn("label", F.when(F.col("id") == first["id"], 1 - F.col("label")).otherwise(F.col("label")))
    again = {r["id"]: r["score"] for r in models.cross_fitted(turned, "id", "text", "label", F.lit(False), folds=3, buckets=256).collect()}
    assert all(again[r["id"]] == r["score"] for r in found if r["fold"] == first["fold"])
    assert any(again[r["id"]] != r["score"] for r in found if r["fold"] != first["fold"])
    unlabelled = models.cross_fitted(df.withColumn("label", F.lit(None).cast("double")), "id", "text", "label", F.lit(False))
    assert {r["score"] for r in unlabelled.collect()} == {None}
