"""Isolation forest (Liu, Ting, Zhou, ICDM 2008) as Spark jobs.

Fitting draws a bounded sub-sample per tree and builds the trees in parallel,
one group per tree. Scoring is a walk over the broadcast node table, batch by
batch. Every random choice is a number made from the seed, the tree and what is
chosen, so samples, splits and scores do not depend on partitioning, and a plain
SQL engine can make the same ones.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog import fixed_values as fixed
from emberlog.operators.quantiles import percentile_of_counts

NODES = "tree int, node int, feature int, threshold double, size int, depth int"
# Room above the wanted sample size, so that chance cannot leave a tree short.
SPARE = 2.0
# Features count to so many places, whatever computed them.
PLACES = 6


def number(text: str) -> float:
    """A number in 0..1 that stands for a text: the first 52 bits of its MD5."""
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52


def _number(*parts: Column) -> Column:
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / 2**52


def average_depth(n: np.ndarray | int) -> np.ndarray:
    """Mean depth of an unsuccessful search in a tree over ``n`` rows."""
    n = np.asarray(n, dtype=float)
    big = np.where(n > 2, n, 3.0)
    deep = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, deep, np.where(n == 2, 1.0, 0.0))


def draw(df: DataFrame, key: str, trees: int, sample: int, seed: int) -> DataFrame:
    """``sample`` distinct keys for each tree, as ``(tree, key)``.

    A tree takes the rows with the smallest numbers of seed, tree and key among
    those that a number of seed and key lets through; a row in so many that all
    trees find enough, which is checked. Keys have to be unique.
    """
    n = df.count()
    if n == 0:
        raise ValueError("cannot fit a forest on no rows")
    sample = min(sample, n)
    share = min(1.0, SPARE * trees * sample / n)
    pool = df.select(F.col(key).alias("key")).filter(_number(F.lit(seed), F.col("key")) < share)
    numbered = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    kept = min(1.0, max(SPARE * sample, sample + 64) / (share * n))
    ranked = numbered.withColumn("_at", _number(F.lit(seed), F.col("tree"), F.col("key"))).filter(F.col("_at") < kept)
    rank = F.row_number().over(W.partitionBy("tree").orderBy("_at", "key"))
    return ranked.withColumn("_rank", rank).filter(F.col("_rank") <= sample).select("tree", "key")


def _grow(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Build one tree from its rows. Nodes are numbered as in a heap, from 1."""
    tree = int(pdf["tree"].iloc[0])
    rows = np.stack(pdf["features"].to_numpy())
    limit = math.ceil(math.log2(max(len(rows), 2)))
    nodes, todo = [], [(1, np.arange(len(rows)), 0)]
    while todo:
        node, members, depth = todo.pop()
        low, high = rows[members].min(axis=0), rows[members].max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= limit or len(members) < 2 or len(varying) == 0:
            nodes.append((tree, node, -1, 0.0, len(members), depth))
            continue
        feature = min(varying, key=lambda f: (number(f"{seed}|{tree}|{node}|{f}"), f))
        cut = low[feature] + number(f"{seed}|{tree}|{node}|cut") * (high[feature] - low[feature])
        nodes.append((tree, node, int(feature), float(cut), len(members), depth))
        left = rows[members, feature] <= cut
        todo += [(2 * node, members[left], depth + 1), (2 * node + 1, members[~left], depth + 1)]
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "size", "depth"])


def grow(sampled: DataFrame, seed: int) -> DataFrame:
    """The node table of all trees; every group holds one bounded sample."""
    return sampled.groupBy("tree").applyInPandas(lambda pdf: _grow(pdf, seed), NODES)


def _path_score(arrays: dict[str, np.ndarray], matrix: np.ndarray) -> np.ndarray:
    """Minus the anomaly score of the paper, for a matrix of rows."""
    total, rows = np.zeros(len(matrix)), np.arange(len(matrix))
    column, threshold = arrays["column"], arrays["threshold"]
    left, right = arrays["left"], arrays["right"]
    for start in arrays["starts"]:
        at = np.full(len(matrix), start)
        for _ in range(int(arrays["steps"])):
            at = np.where(matrix[rows, column[at]] <= threshold[at], left[at], right[at])
        total += arrays["length"][at]
    with np.errstate(invalid="ignore", divide="ignore"):
        depth = np.where(arrays["scale"] > 0, total / arrays["scale"], 1.0)
    return -np.exp2(-depth)


@dataclass
class Forest:
    """Node table as arrays (a few tens of thousands of rows) and the offset."""

    nodes: pd.DataFrame
    trees: int
    sample: int
    offset: float = 0.0
    # Of a forest just fitted: the training rows' path scores, ``v``, and how many rows have each, ``n``.
    counts: DataFrame | None = field(default=None, compare=False, repr=False)

    def training_scores(self) -> DataFrame:
        """The training rows' decision scores, ``anomaly_score``, each ``n`` times."""
        return self.counts.select((F.col("v") - F.lit(self.offset)).alias("anomaly_score"), "n")

    def training_range(self) -> tuple[float, float]:
        low, high = self.training_scores().agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
        return low, high

    def arrays(self) -> dict[str, np.ndarray]:
        """The walk as plain arrays. Leaves point at themselves, so that every
        walk can take the same number of steps."""
        n = self.nodes
        tree, node, leaf = n["tree"].to_numpy(), n["node"].to_numpy(), n["feature"].to_numpy() < 0
        # Rows are in order of (tree, node), which is how a child is found.
        order, wide = tree.astype(np.int64) << 32 | node, np.int64(1) << 32
        child = lambda side: np.searchsorted(order, tree * wide + 2 * node + side)
        here = np.arange(len(n))
        return {
            "starts": np.searchsorted(tree, np.arange(self.trees)),
            "column": np.where(leaf, 0, n["feature"].to_numpy()),
            "threshold": n["threshold"].to_numpy(),
            "left": np.where(leaf, here, child(0)),
            "right": np.where(leaf, here, child(1)),
            "length": n["depth"].to_numpy() + average_depth(n["size"].to_numpy()),
            "steps": np.asarray(n["depth"].max()),
            "scale": self.trees * average_depth(self.sample),
        }

    def path_score(self, matrix: np.ndarray) -> np.ndarray:
        return _path_score(self.arrays(), matrix)

    def add_score(self, df: DataFrame, features: str = "features", out: str = "anomaly_score") -> DataFrame:
        """Add the decision score; below zero means anomalous."""
        shared = df.sparkSession.sparkContext.broadcast(self.arrays())
        offset = self.offset

        @F.arrow_udf("double")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                if len(batch) == 0:
                    yield pa.array([], pa.float64())
                    continue
                # The lists' values lie one after the other.
                matrix = batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                yield pa.array(_path_score(shared.value, matrix.round(PLACES)) - offset)

        return df.withColumn(out, score(F.col(features)))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, NODES).write.mode("errorifexists").parquet(f"{path}/nodes")
        meta = [(self.trees, self.sample, float(self.offset))]
        spark.createDataFrame(meta, "trees int, sample int, offset double").write.mode("errorifexists").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        meta = spark.read.parquet(f"{path}/meta").first()
        nodes = spark.read.schema(NODES).parquet(f"{path}/nodes").orderBy("tree", "node").toPandas()
        return cls(nodes, meta["trees"], meta["sample"], meta["offset"])


def distinct_features(df: DataFrame, features: str = "features") -> DataFrame:
    """``features``, and how many rows have them."""
    return df.groupBy(F.col(features).alias("features")).agg(F.count("*").alias("copies"))


def fit(
    df: DataFrame,
    key: str,
    features: str = "features",
    trees: int = fixed.TREES,
    sample: int = fixed.SUBSAMPLE,
    contamination: float = fixed.CONTAMINATION,
    seed: int = fixed.SEED,
    distinct: DataFrame | None = None,
) -> Forest:
    """Fit on ``features`` (an array of doubles); ``key`` must be unique.

    The offset is the contamination quantile of the training rows' own scores.
    Rows of equal features score alike, so the ``distinct`` ones are walked;
    those of ``distinct_features`` may be given.
    """
    from emberlog.session import stage

    drawn = draw(df, key, trees, sample, seed)
    # At most trees * sample keys; features are attached to them, not carried along.
    rounded = F.transform(features, lambda x: F.round(x, PLACES)).alias("features")
    rows = df.select(F.col(key).alias("key"), rounded)
    nodes = grow(rows.join(F.broadcast(drawn), "key"), seed).toPandas().sort_values(["tree", "node"], ignore_index=True)
    sizes = nodes.loc[nodes["node"] == 1, "size"]
    if len(sizes) < trees or sizes.nunique() > 1:
        raise ValueError(f"of {trees} trees {(sizes == sizes.max()).sum()} found their {sizes.max()} rows")
    forest = Forest(nodes, trees, int(sizes.max()))
    distinct = distinct_features(df, features) if distinct is None else distinct
    # Staged, so that a filter on the score walks nothing again.
    scores = stage(forest.add_score(distinct, out="v").select("v", "copies"), "training-scores")
    forest.counts = stage(scores.groupBy("v").agg(F.sum("copies").alias("n")), "training-counts")
    forest.offset = percentile_of_counts(forest.counts, contamination)
    return forest
