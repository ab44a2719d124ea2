"""Fitted models: linear autoencoder, recurrent autoencoder inference, text classifier, retrieval."""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, HashingTF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.session import materialize

# Executors need not have this package installed: the functions here travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# --- linear autoencoder --------------------------------------------------------------------


def fit_linear_autoencoder(benign: DataFrame, vector: str, k: int):
    """Mean and principal directions of benign vectors.

    Both are of the vector's width, so the driver holds width x k numbers.
    """
    width = benign.select(F.size(vector)).first()[0]
    means = benign.agg(*[F.avg(F.col(vector)[i]).alias(str(i)) for i in range(width)]).first()
    mean = [float(m) for m in means]
    centred = F.zip_with(vector, F.array(*[F.lit(m) for m in mean]), lambda x, m: x - m)
    model = PCA(k=k, inputCol="_v", outputCol="_code").fit(benign.select(array_to_vector(centred).alias("_v")))
    return mean, model


def reconstruct_linear(rows: DataFrame, vector: str, mean: list[float], model) -> DataFrame:
    """Project each vector to its code and back; ``mse`` is the error over the vector."""
    means = F.array(*[F.lit(m) for m in mean])
    matrix = model.pc.toArray()
    back = F.array(*[F.array(*[F.lit(float(x)) for x in line]) for line in matrix])
    centred = rows.withColumn("_c", F.zip_with(vector, means, lambda x, m: x - m))
    coded = model.transform(centred.withColumn("_v", array_to_vector("_c")))
    coded = coded.withColumn("_k", vector_to_array("_code"))
    dot = lambda a, b: F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v
    )
    rebuilt = F.transform(back, lambda line: dot(line, F.col("_k")))
    error = F.aggregate(
        F.zip_with("_c", rebuilt, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v
    ) / len(mean)
    return coded.withColumn("mse", error).drop("_c", "_v", "_code", "_k")


# --- recurrent autoencoder -----------------------------------------------------------------


def random_weights(width: int, hidden: int, seed: int = 0) -> dict[str, np.ndarray]:
    """Untrained weights of a two-layer encoder and decoder, uniform in +-1/sqrt(units)."""
    rng = np.random.default_rng(seed)
    weights = {}
    for part, inputs, units in (("encoder", width, hidden), ("decoder", hidden, width)):
        for layer in (0, 1):
            fan_in = inputs if layer == 0 else units
            bound = 1.0 / np.sqrt(units)
            weights[f"{part}{layer}.input"] = rng.uniform(-bound, bound, (fan_in, 4 * units))
            weights[f"{part}{layer}.state"] = rng.uniform(-bound, bound, (units, 4 * units))
            weights[f"{part}{layer}.bias"] = rng.uniform(-bound, bound, 4 * units)
    return weights


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def weights_table(spark: SparkSession, weights: dict[str, np.ndarray]) -> DataFrame:
    """Weights as a table keyed by layer: one row a matrix row (``layer``, ``part``, ``row``, ``values``); a bias is one row."""
    rows = [(*name.split("."), k, line.tolist()) for name, w in weights.items() for k, line in enumerate(np.atleast_2d(w))]
    return spark.createDataFrame(rows, "layer string, part string, row int, values array<double>")


def weights_of(table: DataFrame | dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The weights of a table, or as given; the model's size, whatever the data's."""
    if isinstance(table, dict):
        return table
    parts: dict[str, list] = {}
    for r in table.orderBy("layer", "part", "row").collect():
        parts.setdefault(f"{r['layer']}.{r['part']}", []).append(r["values"])
    return {name: np.array(rows[0] if name.endswith(".bias") else rows) for name, rows in parts.items()}


def _run_layer(x: np.ndarray, weights: dict[str, np.ndarray], name: str, state: tuple | None = None) -> tuple[np.ndarray, tuple]:
    """One recurrent layer over ``(batch, time, inputs)``, from a state (hidden, cell) on; gate order input, forget, cell, output."""
    units = weights[f"{name}.state"].shape[0]
    h, c = state or (np.zeros((x.shape[0], units)), np.zeros((x.shape[0], units)))
    out = np.empty((x.shape[0], x.shape[1], units))
    for t in range(x.shape[1]):
        gates = x[:, t] @ weights[f"{name}.input"] + h @ weights[f"{name}.state"] + weights[f"{name}.bias"]
        i, f, g, o = np.split(gates, 4, axis=1)
        c = _sigmoid(f) * c + _sigmoid(i) * np.tanh(g)
        h = _sigmoid(o) * np.tanh(c)
        out[:, t] = h
    return out, (h, c)


def _encode(x: np.ndarray, code, weights: dict[str, np.ndarray], states: list | None) -> tuple[np.ndarray, list]:
    """The hidden state after the steps ``x``, and the states to go on from."""
    first, s0 = _run_layer(x, weights, "encoder0", states and states[0])
    _, s1 = _run_layer(first, weights, "encoder1", states and states[1])
    return s1[0], [s0, s1]


def _decode(x: np.ndarray, code: np.ndarray, weights: dict[str, np.ndarray], states: list | None) -> tuple[np.ndarray, list]:
    """Squared errors of the decoded steps, summed by feature, and the states to go on from."""
    first, s0 = _run_layer(np.repeat(code[:, None, :], x.shape[1], axis=1), weights, "decoder0", states and states[0])
    rebuilt, s1 = _run_layer(first, weights, "decoder1", states and states[1])
    return ((rebuilt - x) ** 2).sum(axis=1), [s0, s1]


def rebuild_batch(x: np.ndarray, weights: dict[str, np.ndarray]) -> np.ndarray:
    """Encode to the last hidden state, repeat it over time, decode to the input's width."""
    code, _ = _encode(x, None, weights, None)
    first, _ = _run_layer(np.repeat(code[:, None, :], x.shape[1], axis=1), weights, "decoder0")
    return _run_layer(first, weights, "decoder1")[0]


def _stepped(shared, run, add: bool, value: str):
    """Runs rows in order of sequence and time: whole sequences of a batch together by length, the last one of a
    batch with its states carried into the next. Memory holds one batch, whatever a sequence's length."""

    def matrix(column) -> np.ndarray:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
        return flat.reshape(len(column), -1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, carried = shared.value, None  # (key, length, value, states)
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float64())]
        table = lambda done: pa.RecordBatch.from_arrays(
            [pa.array([key[0] for key, *_ in done], kinds[0]), pa.array([key[1] for key, *_ in done], kinds[1]), pa.array([n for _, n, *_ in done], kinds[2]), pa.array([list(map(float, v)) for *_, v, _ in done], kinds[3])],
            ["entity", "seq_no", "length", value],
        )
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(batch.column("entity").to_pylist(), batch.column("seq_no").to_pylist(), strict=True))
            x, codes = matrix(batch.column("features")), matrix(batch.column("code")) if "code" in batch.schema.names else None
            starts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1])]
            parts, done = list(zip(starts, [*starts[1:], len(keys)], strict=True)), []
            if carried and carried[0] != keys[0]:
                done.append(carried)
                carried = None
            alone = {0, len(parts) - 1}  # the first may go on from the batch before, the last into the next
            same: dict[int, list[int]] = {}
            for k, (i, j) in enumerate(parts):
                if k not in alone:
                    same.setdefault(j - i, []).append(k)
            for length, group in same.items():
                at = [parts[k][0] for k in group]
                values, _ = run(np.stack([x[i : i + length] for i in at]), None if codes is None else codes[at], weights, None)
                done += [(keys[i], length, v, None) for i, v in zip(at, values, strict=True)]
            for k in sorted(alone):
                i, j = parts[k]
                values, states = run(x[None, i:j], None if codes is None else codes[i : i + 1], weights, carried[3] if carried else None)
                total = values[0] + carried[2] if carried and add else values[0]
                carried = (keys[i], j - i + (carried[1] if carried else 0), total, states)
                if k < len(parts) - 1:
                    done.append(carried)
                    carried = None
            if done:
                yield table(done)
        if carried:
            yield table([carried])

    return work


def recurrent_errors(seqs: DataFrame, weights: DataFrame | dict[str, np.ndarray], entity: str = "identity") -> DataFrame:
    """Error per feature and overall (at most 1) of each sequence under the recurrent model of a weights table.

    Steps are sorted by sequence and time inside the tasks and run in two passes: the first encodes, the second decodes each
    sequence's code and compares it with the steps. A sequence is a chain of steps and so stays in one task, but is never gathered.
    """
    shared = seqs.sparkSession.sparkContext.broadcast(weights_of(weights))
    steps = seqs.select(F.col(entity).alias("entity"), F.col("seq_no").cast("long").alias("seq_no"), "t", F.col("features").cast("array<double>").alias("features"))
    in_order = lambda rows: rows.repartition("entity", "seq_no").sortWithinPartitions("entity", "seq_no", "t").drop("t")
    coded = in_order(steps).mapInArrow(_stepped(shared, _encode, False, "code"), "entity string, seq_no long, length long, code array<double>")
    coded = materialize(coded.select("entity", "seq_no", "code"), "codes")
    summed = in_order(steps.join(coded, ["entity", "seq_no"])).mapInArrow(_stepped(shared, _decode, True, "sums"), "entity string, seq_no long, length long, sums array<double>")
    errors = F.transform("sums", lambda s: s / F.col("length"))
    mean = F.aggregate(errors, F.lit(0.0), lambda a, e: a + e) / F.size("sums")
    return summed.select(F.col("entity").alias(entity), "seq_no", "length", errors.alias("errors"), F.least(mean, F.lit(1.0)).alias("mse"))


# --- text classifier -----------------------------------------------------------------------


def command_features(text: Column, weight: float = 1.0) -> Column:
    """Signs of a command line rather than prose, as numbers from 0 to about ``weight``: length, symbols, digits,
    capitals, options, paths, addresses, encoded runs."""
    plain = F.coalesce(text, F.lit(""))
    length = F.greatest(F.length(plain), F.lit(1))
    share = lambda pattern: F.regexp_count(plain, F.lit(pattern)) / length
    seen = lambda pattern: F.least(F.regexp_count(plain, F.lit(pattern)), F.lit(5)) / 5.0
    values = [
        F.log1p(length) / 10.0, share(r"[|&;<>$`{}()*%^=]") * 10, share("[0-9]") * 5, share(r"\p{Lu}") * 5, seen(r"(^|\s)(--?|/)[A-Za-z]"),
        seen(r"[\\/][\w.-]+[\\/]"), seen(r"\b[a-z]+://|\b\d{1,3}(\.\d{1,3}){3}\b"), seen(r"[A-Za-z0-9+/=]{24,}"),
    ]
    return F.array(*[F.least(v, F.lit(1.0)) * weight for v in values])


def _features(rows: DataFrame, text: str, buckets: int, weight: float) -> DataFrame:
    words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}]+").transform(rows.withColumn("_text", F.coalesce(text, F.lit(""))))
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=buckets).transform(words)
    counts = counts.withColumn("_signs", array_to_vector(command_features(F.col(text), weight)))
    return VectorAssembler(inputCols=["_counts", "_signs"], outputCol="_features").transform(counts).drop("_text", "_words", "_counts", "_signs")


def cross_fitted(rows: DataFrame, row_id: str, text: str, label: str, rule: Column, folds: int = 3, buckets: int = 1 << 12, weight: float = 3.0) -> DataFrame:
    """Every row with ``fold``, model ``score`` and the verdict of a plain ``rule``; no row is scored by a model that saw it.

    Rows fall into folds by a hash of their id, so copies of an id stay together. Each fold's model is fitted on the
    labelled rows of all others: hashed words and weighted command features, logistic regression. Rows without a label
    are scored by their fold's model too. Features are computed once. If the others have no label, the score is null.
    """
    placed = rows.select(row_id, label, F.pmod(F.xxhash64(row_id), F.lit(folds)).cast("int").alias("fold"), rule.alias("rule"), text)
    ready = materialize(_features(placed, text, buckets, weight).drop(text), "features")
    scored = []
    for fold in range(folds):
        own, others = ready.filter(F.col("fold") == fold), ready.filter((F.col("fold") != fold) & F.col(label).isNotNull())
        if not others.limit(1).count():
            scored.append(own.withColumn("score", F.lit(None).cast("double")))
            continue
        model = LogisticRegression(featuresCol="_features", labelCol=label, maxIter=10, regParam=0.01, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_v").fit(others.select(F.col(label).cast("double").alias(label), "_features"))
        score = vector_to_array("_p")[1] if model.numClasses > 1 else F.lit(0.0)  # one class: no positive label was seen
        score = F.round(score, 12)  # the last digits depend on the order in which the tasks of a sum end
        scored.append(model.transform(own).withColumn("score", score).drop("_p", "_r", "_v"))
    return functools.reduce(DataFrame.unionByName, scored).select(row_id, label, "fold", "score", "rule")


# --- retrieval -----------------------------------------------------------------------------


def class_index(vectors: DataFrame, label: str, vector: str, width: int) -> DataFrame:
    """Curated index: the mean vector of each label."""
    return vectors.groupBy(label).agg(
        F.array(*[F.avg(F.col(vector)[i].cast("double")) for i in range(width)]).alias("entry")
    )


def nearest_entries(
    rows: DataFrame, row_id: str, vector: str, index: DataFrame, index_id: str, k: int, block: int = 10_000
) -> DataFrame:
    """The ``k`` index entries nearest to each row by cosine similarity.

    The index is a static, curated list. It travels in blocks of ``block`` entries as values inside the plan,
    each with its norm; each row keeps only its best ``k`` of every block and then of all: no row pairs are
    ever formed.
    """
    dot = lambda a, b: F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v
    )
    numbered = index.select(F.col(index_id).alias("id"), F.col("entry").alias("v"), F.sqrt(dot(F.col("entry"), F.col("entry"))).alias("norm"))
    blocks = -(-index.count() // block)
    norm = F.sqrt(dot(F.col(vector), F.col(vector).cast("array<double>")))
    found = []
    for number in range(max(1, blocks)):
        part = numbered.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, blocks))) == number)
        entries = part.agg(F.collect_list(F.struct("id", "v", "norm"))).scalar()
        scored = F.transform(
            "_entries", lambda e: F.struct((-dot(F.col(vector), e["v"]) / (F.col("_norm") * e["norm"])).alias("neg"), e["id"].alias("id"))
        )
        near = rows.select(row_id, vector, norm.alias("_norm")).withColumn("_entries", entries)
        found.append(near.select(row_id, F.slice(F.array_sort(scored), 1, k).alias("_best")))
    best = found[0]
    if blocks > 1:
        best = functools.reduce(DataFrame.unionByName, found).groupBy(row_id).agg(
            F.slice(F.array_sort(F.flatten(F.collect_list("_best"))), 1, k).alias("_best")  # k a block
        )
    return best.select(row_id, F.posexplode("_best").alias("place", "hit")).select(
        row_id, F.col("hit.id").alias(index_id), (-F.col("hit.neg")).alias("similarity"), (F.col("place") + 1).alias("rank")
    )
