"""Privacy attacks: nearest-neighbour reconstruction and membership inference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadweave.functions import vectors as V
from loadweave.operators.ordering import shuffle_positions, value_ranks


def _stated(outliers: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the stated set, whose size is checked before it travels to the tasks."""
    rows = outliers.select("id", V.as_double(F.col("v")).alias("v")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} outliers; ask them in parts")
    return np.array([r["id"] for r in rows], dtype="int64"), np.array([r["v"] for r in rows], dtype=float)


def _blocks(samples: DataFrame, o: np.ndarray, emit, schema: str, block: int = 512) -> DataFrame:
    """Distances of blocks of samples to all stated rows, in NumPy; emit(distances, sample ids) makes the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            for i in range(0, len(ids), block):
                part = x[i : i + block]
                yield emit(np.sqrt(np.stack([((part - row) ** 2).sum(1) for row in o], axis=1)), ids[i : i + block])

    return samples.where("v is not null").select(F.col("id").cast("long"), V.as_double(F.col("v"))).mapInArrow(run, schema)


def distances(outliers: DataFrame, samples: DataFrame, most: int = 10_000) -> DataFrame:
    """real_outlier, synthetic_output, euc_dist, norm, ratio of every stated outlier against all samples.

    The outliers are a stated set of at most `most` rows; a larger one raises and is to be asked in parts. Both inputs
    are (id, v) with whole vectors. A norm of 0 gives a null ratio.
    """
    key, o = _stated(outliers, most)
    schema = "real_outlier long, synthetic_output long, euc_dist double, norm double"
    if not len(key):
        return samples.sparkSession.createDataFrame([], schema + ", ratio double")
    norm = np.linalg.norm(o, axis=1)

    def emit(d: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        n = len(ids)
        return pa.RecordBatch.from_arrays([pa.array(np.tile(key, n)), pa.array(np.repeat(ids, len(key))), pa.array(d.ravel()), pa.array(np.tile(norm, n))], names=["real_outlier", "synthetic_output", "euc_dist", "norm"])

    return _blocks(samples, o, emit, schema).withColumn("ratio", F.try_divide("euc_dist", "norm"))


def nearest_ratio(outliers: DataFrame, samples: DataFrame, most: int = 10_000) -> DataFrame:
    """Least distance ratio per outlier; each block of samples sends one minimum per outlier."""
    key, o = _stated(outliers, most)
    if not len(key):
        return samples.sparkSession.createDataFrame([], "real_outlier long, ratio double")
    norm = np.linalg.norm(o, axis=1)

    def emit(d: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(d.min(0)), pa.array(norm)], names=["real_outlier", "d", "norm"])

    least = _blocks(samples, o, emit, "real_outlier long, d double, norm double").groupBy("real_outlier").agg(F.min("d").alias("d"), F.max("norm").alias("norm"))
    return least.select("real_outlier", F.try_divide("d", "norm").alias("ratio"))


def under_threshold(nearest: DataFrame, threshold: float = 0.3) -> DataFrame:
    return nearest.agg(F.avg((F.col("ratio") <= threshold).cast("int")).alias("share"), F.count("*").alias("n"))


def attack_train_set(holdout: DataFrame, synthetic: DataFrame) -> DataFrame:
    """(id, v, target): synthetic 1, holdout 0."""
    return holdout.select("id", "v", F.lit(0).alias("target")).unionByName(synthetic.select("id", "v", F.lit(1).alias("target")))


def attack_set(seen: DataFrame, unseen_same: DataFrame, unseen_diff: DataFrame) -> DataFrame:
    """(id, v, target, type): seen outliers 1, unseen ones 0."""
    parts = [("seen", seen, 1), ("unseen_same", unseen_same, 0), ("unseen_diff", unseen_diff, 0)]
    out = None
    for name, df, target in parts:
        one = df.select("id", "v", F.lit(target).alias("target"), F.lit(name).alias("type"))
        out = one if out is None else out.unionByName(one)
    return out


def rank_predictions(scores: DataFrame, score: str, label: str, key: str) -> DataFrame:
    """rank_pred 1 for the P highest scores (ties by key), P the number of true positives, else 0."""
    positives = scores.agg(F.sum(label)).first()[0] or 0
    return value_ranks(scores, score, key, "_lw_rank").withColumn("rank_pred", (F.col("_lw_rank") <= positives).cast("int")).drop("_lw_rank")


def attack_metrics(ranked: DataFrame, label: str) -> DataFrame:
    """n, positives, tp, fp, precision, f1, accuracy, random_precision, interval (1.96 standard errors over all rows)."""
    t, p = F.col(label), F.col("rank_pred")
    one = ranked.agg(
        F.count("*").alias("n"),
        F.sum(t).alias("positives"),
        F.sum(((t == 1) & (p == 1)).cast("int")).alias("tp"),
        F.sum(((t == 0) & (p == 1)).cast("int")).alias("fp"),
        F.avg((t == p).cast("int")).alias("accuracy"),
    )
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", "positives")
    out = one.withColumn("precision", precision).withColumn("f1", F.try_divide(2 * F.col("precision") * recall, F.col("precision") + recall)).withColumn("random_precision", F.try_divide("positives", "n"))
    return out.withColumn("interval", F.lit(1.96) * F.sqrt(F.try_divide(F.col("precision") * (1 - F.col("precision")), F.col("n"))))


def discriminator(train: DataFrame, attack: DataFrame, width: int = 48, rounds: int = 100, seed: int = 100) -> DataFrame:
    """Scores of the attack set by a small perceptron: attack columns plus pred_proba and pred_label."""
    model = MultilayerPerceptronClassifier(layers=[width, 32, 16, 4, 2], maxIter=rounds, seed=seed, featuresCol="_x", labelCol="target").fit(train.withColumn("_x", array_to_vector(V.as_double(F.col("v")))))
    out = model.transform(attack.withColumn("_x", array_to_vector(V.as_double(F.col("v")))))
    return out.withColumn("pred_proba", vector_to_array("probability")[1]).withColumn("pred_label", F.col("prediction").cast("int")).drop("_x", "rawPrediction", "probability", "prediction")


def pca_2d(fit_on: DataFrame, project: DataFrame) -> DataFrame:
    """id, pc1, pc2 of centred vectors; the sign of a component makes its largest loading positive."""
    real = fit_on.withColumn("_x", array_to_vector(V.as_double(F.col("v"))))
    centre = StandardScaler(withMean=True, withStd=False, inputCol="_x", outputCol="_c").fit(real)
    model = PCA(k=2, inputCol="_c", outputCol="_p").fit(centre.transform(real))
    load = model.pc.toArray()
    sign = [1.0 if load[abs(load[:, i]).argmax(), i] > 0 else -1.0 for i in range(2)]
    out = model.transform(centre.transform(project.withColumn("_x", array_to_vector(V.as_double(F.col("v")))))).withColumn("_a", vector_to_array("_p"))
    return out.select("id", (F.col("_a")[0] * sign[0]).alias("pc1"), (F.col("_a")[1] * sign[1]).alias("pc2"))


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return shuffle_positions(df, key, seed)


def accuracy(pred: Column, label: Column) -> Column:
    return F.avg((pred == label).cast("int"))
