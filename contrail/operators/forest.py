"""Isolation forest (Liu, Ting and Zhou, 2008) as Spark jobs.

Sub-samples are drawn with hashes, trees are grown in parallel, one group per
tree, and rows are scored in Arrow batches against the small forest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contrail.functions import vectors

# Model inputs.
MODEL_FEATURES = (
    "velocity_mean",
    "velocity_std",
    "velocity_max_delta",
    "altitude_std",
    "altitude_range",
    "max_climb_rate",
    "max_descent_rate",
    "max_turn_rate",
    "max_implied_speed",
    "speed_consistency_error",
    "msg_rate",
    "msg_interval_std",
    "max_acceleration",
)

_NODE_DDL = "tree int, node int, feature int, threshold double, length double"


def average_path(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3)
    usual = 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, usual))


def _grow(tree: int, x: np.ndarray, depth: int, seed: int) -> pd.DataFrame:
    """One tree as heap-numbered nodes; feature -1 marks a leaf, ``length`` its path length."""
    rng = np.random.default_rng([seed, tree])
    rows, stack = [], [(0, 0, np.arange(len(x)))]
    while stack:
        node, level, index = stack.pop()
        part = x[index]
        low, high = (part.min(axis=0), part.max(axis=0)) if len(index) else (None, None)
        usable = np.flatnonzero(high > low) if len(index) > 1 else np.empty(0, int)
        if level >= depth or len(usable) == 0:
            rows.append((tree, node, -1, 0.0, level + float(average_path(len(index)))))
            continue
        feature = int(rng.choice(usable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        left = part[:, feature] <= threshold
        rows.append((tree, node, feature, threshold, 0.0))
        stack += [(2 * node + 1, level + 1, index[left]), (2 * node + 2, level + 1, index[~left])]
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "length"]).astype(
        {"tree": "int32", "node": "int32", "feature": "int32"}
    )


@dataclass
class IsolationForest:
    """A fitted forest: its node table (at most trees × 2·sample rows), sample size and threshold."""

    nodes: pd.DataFrame
    sample: int
    columns: tuple[str, ...]
    threshold: float | None = None

    def score(self, df: DataFrame, name: str = "ml_score") -> DataFrame:
        """Add the anomaly score in 0..1, higher is worse, and ``is_outlier`` against the threshold."""
        trees = int(self.nodes["tree"].max()) + 1
        size = int(self.nodes["node"].max()) + 1
        feature = np.full((trees, size), -1, dtype=np.int32)
        threshold, length = np.zeros((trees, size)), np.zeros((trees, size))
        at = (self.nodes["tree"].to_numpy(), self.nodes["node"].to_numpy())
        feature[at], threshold[at], length[at] = (
            self.nodes[c].to_numpy() for c in ("feature", "threshold", "length")
        )
        steps = int(np.ceil(np.log2(max(self.sample, 2)))) + 1
        scale = float(average_path(self.sample)) or 1.0
        # the forest's size is fixed by its parameters, not by the data
        shared = df.sparkSession.sparkContext.broadcast((feature, threshold, length))

        @F.pandas_udf("double")
        def run(v: pd.Series) -> pd.Series:
            feature, threshold, length = shared.value
            if len(v) == 0:
                return pd.Series([], dtype=float)
            x = np.stack(v.to_numpy())
            total = np.zeros(len(x))
            rows = np.arange(len(x))
            for tree in range(len(feature)):
                node = np.zeros(len(x), dtype=np.int64)
                for _ in range(steps):
                    f = feature[tree, node]
                    inner = f >= 0
                    if not inner.any():
                        break
                    right = x[rows, np.where(inner, f, 0)] > threshold[tree, node]
                    node = np.where(inner, 2 * node + 1 + right, node)
                total += length[tree, node]
            return pd.Series(2.0 ** (-total / len(feature) / scale))

        d = df.withColumn(name, run(vectors.feature_vector(list(self.columns))))
        if self.threshold is not None:
            d = d.withColumn("is_outlier", F.col(name) > self.threshold)
        return d

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, _NODE_DDL).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        meta = [(self.sample, list(self.columns), self.threshold)]
        spark.createDataFrame(meta, "sample int, columns array<string>, threshold double").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsolationForest:
        meta = spark.read.parquet(f"{path}/model").first()
        nodes = spark.read.parquet(f"{path}/nodes").toPandas()
        return cls(nodes, meta["sample"], tuple(meta["columns"]), meta["threshold"])


def fit(
    df: DataFrame,
    ids: list[str],
    columns: tuple[str, ...] = MODEL_FEATURES,
    trees: int = 100,
    sample: int = 256,
    contamination: float = 0.01,
    seed: int = 42,
) -> IsolationForest:
    """Grow a forest on ``df``; ``ids`` identify a row, so sampling is reproducible.

    The rows with the lowest hashes form a pool of at most trees × sample rows;
    every tree takes its own ``sample`` of them by a second hash. A bound on
    the hash, from the number of rows, keeps some four times the pool before
    any row moves, so no task sorts more than that.
    """
    rows = df.count()
    if rows < 10:
        raise ValueError("at least 10 rows are needed")
    slim = df.select(*ids, vectors.feature_vector(list(columns)).alias("_v"))
    pool = slim.withColumn("_h", F.xxhash64(F.lit(seed), *ids))
    share = 4 * trees * sample / rows
    if share < 1:
        pool = pool.filter(F.col("_h") <= int(-(2**63) + share * 2**64))
    pool = pool.orderBy("_h", *ids).limit(trees * sample)
    spread = pool.repartition(trees, "_h")
    copies = spread.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    copies = copies.withColumn("_g", F.xxhash64(F.lit(seed), F.col("tree"), *ids))
    w = Window.partitionBy("tree").orderBy("_g", *ids)
    drawn = copies.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= sample)
    depth = int(np.ceil(np.log2(max(sample, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_r")
        return _grow(int(pdf["tree"].iloc[0]), np.stack(pdf["_v"].to_numpy()), depth, seed)

    nodes = drawn.select("tree", "_r", "_v").groupBy("tree").applyInPandas(build, _NODE_DDL).toPandas()
    size = min(sample, rows)
    forest = IsolationForest(nodes, size, tuple(columns))
    if contamination:
        scored = forest.score(df)
        forest.threshold = scored.agg(
            F.percentile_approx("ml_score", 1 - contamination, 100000).alias("t")
        ).first()["t"]
    return forest


def standardize(df: DataFrame, columns: tuple[str, ...] = MODEL_FEATURES) -> DataFrame:
    """Add ``scaled``: the model inputs as a standardised vector."""
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    d = df.withColumn("_raw", array_to_vector(vectors.feature_vector(list(columns))))
    return StandardScaler(inputCol="_raw", outputCol="scaled", withMean=True, withStd=True).fit(d).transform(d).drop("_raw")
