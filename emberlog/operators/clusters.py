"""Root-cause clusters of anomaly messages."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog import fixed_values as fixed
from emberlog.operators.grouping import attach, group_counts
from emberlog.operators.scoring import anomalies
from emberlog.operators.tfidf import Vectorizer, fit_vocabulary, long_form
from emberlog.session import stage

# Of the distinct points, and how many lie in one at least; part of what makes a run repeatable.
PARTITIONS, POINTS = 64, 1000

# Weights of centres and distances are compared to so many places.
PLACES = 9
CENTRES = "cluster int, place int, weight double"
CLUSTER_META = "k int, strip_accents boolean, costs array<double>"
SUMMARY = (
    "cluster_id int, size long, top_keywords array<string>, sample_msgs array<string>, "
    "dominant_severity string, summary string"
)


def temporary_vectorizer(rows: DataFrame) -> Vectorizer:
    """Used when no fitted one is at hand: no row minimum, no accent folding."""
    return Vectorizer.of(fit_vocabulary(rows, min_df=1, strip_accents=False), strip_accents=False)


@dataclass
class Clustering:
    """Fitted centres over a vocabulary's terms: k lists of at most MAX_TERMS numbers."""

    vectorizer: Vectorizer
    centres: list[list[float]]
    # What each run of the fit cost, in its order; the centres are those of the least.
    costs: list[float] = field(default_factory=list)

    def distances(self, dense: str) -> Column:
        """Squared distances of the points ``dense`` from all centres, to nine places."""
        apart = lambda centre: F.aggregate(
            F.zip_with(dense, F.array(*[F.lit(float(x)) for x in centre]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda x, y: x + y)
        return F.array(*[F.round(apart(centre), PLACES) for centre in self.centres])

    def assign(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the ``cluster`` of their message, the nearest centre, the first one of equals, and the ``distance``.

        Weights depend on the message alone, so the distinct messages are
        looked at and the result is joined back.
        """
        text = rows.withColumn("message", F.coalesce("message", F.lit("")))
        points = self.vectorizer.add(group_counts(text, "message", "copies"), "key").withColumn("far", self.distances("tfidf"))
        nearest = F.array_min("far")
        placed = points.select("key", "copies", (F.array_position("far", nearest) - 1).cast("int").alias("cluster"), nearest.alias("distance"))
        return attach(text, "message", stage(placed, "clusters"), "copies").drop("copies")

    def keywords(self, n: int = 8) -> list[list[str]]:
        return [_keywords(self.vectorizer.terms, centre, n) for centre in self.centres]

    def save(self, spark: SparkSession, path: str) -> None:
        """As tables: the centres' places other than 0, the vocabulary, the costs."""
        places = [(c, i, float(x)) for c, centre in enumerate(self.centres) for i, x in enumerate(centre) if x]
        spark.createDataFrame(places, CENTRES).coalesce(1).write.mode("errorifexists").parquet(f"{path}/centres")
        terms = [(i, t, float(x)) for i, (t, x) in enumerate(zip(self.vectorizer.terms, self.vectorizer.idf))]
        spark.createDataFrame(terms, "idx int, term string, idf double").coalesce(1).write.mode("errorifexists").parquet(f"{path}/vocabulary")
        meta = [(len(self.centres), self.vectorizer.strip_accents, [float(x) for x in self.costs])]
        spark.createDataFrame(meta, CLUSTER_META).coalesce(1).write.mode("errorifexists").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Clustering:
        meta = spark.read.schema(CLUSTER_META).parquet(f"{path}/meta").first()
        terms = spark.read.parquet(f"{path}/vocabulary").orderBy("idx").collect()
        centres = [[0.0] * len(terms) for _ in range(meta["k"])]
        for r in spark.read.schema(CENTRES).parquet(f"{path}/centres").collect():
            centres[r["cluster"]][r["place"]] = r["weight"]
        return cls(Vectorizer([r["term"] for r in terms], [r["idf"] for r in terms], meta["strip_accents"]), centres, list(meta["costs"]))


def fit_clusters(
    scored: DataFrame,
    vectorizer: Vectorizer | None = None,
    k: int = fixed.CLUSTERS,
    restarts: int = fixed.KMEANS_RESTARTS,
    seed: int = fixed.SEED,
) -> Clustering | None:
    """Centres of the anomalies' messages: the best of ``restarts`` runs. None when there is too little to cluster.

    The distinct points are clustered with their counts as weights; messages
    that differ in words beyond the vocabulary only, such as ids, are one point,
    so points are far fewer than rows. The start of a run depends on how the
    points lie in partitions, so they are put in order into a number of them
    that follows from theirs. Runs are independent jobs and go side by side.
    """
    rows = stage(anomalies(scored).withColumn("message", F.coalesce("message", F.lit(""))), "cluster-input")
    k = min(k, rows.limit(k).count())
    if k < 2:
        return None
    vectorizer = vectorizer or temporary_vectorizer(rows)
    distinct = vectorizer.add(group_counts(rows, "message", "copies"), "key")
    distinct = stage(distinct.groupBy("tfidf").agg(F.sum("copies").cast("double").alias("weight")), "cluster-distinct")
    parts = max(1, min(PARTITIONS, distinct.count() // POINTS))
    points = distinct.withColumn("point", array_to_vector("tfidf")).repartitionByRange(parts, "tfidf").sortWithinPartitions("tfidf")
    points = stage(points, "cluster-points").persist()

    def run(n: int):
        return KMeans(k=k, maxIter=300, seed=seed + n, featuresCol="point", weightCol="weight").fit(points)

    with ThreadPoolExecutor(4) as pool:
        runs = list(pool.map(run, range(restarts)))
    points.unpersist()
    best = min(runs, key=lambda model: model.summary.trainingCost)
    return Clustering(vectorizer, [[float(x) for x in c] for c in best.clusterCenters()], [float(m.summary.trainingCost) for m in runs])


def mean_centres(rows: DataFrame, vectorizer: Vectorizer, by: str) -> Clustering:
    """The mean weights of each group as centres, in order of the groups; a few groups are meant."""
    means = stage(_means(rows, vectorizer, by), "mean-centres").collect()
    centres = {g: [0.0] * len(vectorizer.terms) for g in sorted({r[by] for r in means})}
    for r in means:
        centres[r[by]][r["idx"]] = r["weight"]
    return Clustering(vectorizer, list(centres.values()))


def _means(rows: DataFrame, vectorizer: Vectorizer, by: str) -> DataFrame:
    """Mean weight per group and term, ``by, idx, weight``: that over the distinct messages with their counts."""
    distinct = rows.groupBy(by, F.coalesce("message", F.lit("")).alias("text")).agg(F.count("*").alias("copies"))
    sizes = distinct.groupBy(by).agg(F.sum("copies").alias("size"))
    weights = long_form(vectorizer.add(distinct, "text"), "tfidf", by, "copies")
    sums = weights.groupBy(by, F.col("place").alias("idx")).agg(F.sum(F.col("value") * F.col("copies")).alias("w"))
    return sums.join(sizes, by).select(by, "idx", F.round(F.col("w") / F.col("size"), PLACES).alias("weight"))


def keywords_by(rows: DataFrame, vectorizer: Vectorizer, by: str, n: int = 8) -> DataFrame:
    """The ``n`` terms with the highest mean weight per group: ``by, rank, term, weight``."""
    terms = rows.sparkSession.createDataFrame(list(enumerate(vectorizer.terms)), "idx int, term string")  # the vocabulary
    means = _means(rows, vectorizer, by).join(F.broadcast(terms), "idx")
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.col("weight").desc(), "term"))
    return means.withColumn("rank", rank).filter(F.col("rank") <= n).select(by, "rank", "term", "weight")


def verify(scored: DataFrame, vectorizer: Vectorizer, path: str, restarts: int = fixed.KMEANS_RESTARTS) -> DataFrame:
    """Properties that a clustering has whatever its start: ``name, ok``.

    Sizes add up to the anomalies; each cluster has eight keywords of the
    vocabulary; every run's cost is listed and the centres have the least; the
    rows' distances from their centres add up to it; no row lies nearer to
    another centre; saved to ``path`` and loaded, the centres are the same.
    """
    spark = scored.sparkSession
    made = fit_clusters(scored, vectorizer, restarts=restarts)
    rows = stage(made.assign(anomalies(scored)), "clustered")
    checked = stage(made.vectorizer.add(rows).select("cluster", "tfidf"), "cluster-checked").withColumn("far", made.distances("tfidf"))
    total = rows.agg(F.count("*").alias("n"), F.sum("distance").alias("cost")).first()
    own = F.element_at("far", F.col("cluster") + 1)
    made.save(spark, path)
    loaded = Clustering.load(spark, path)
    checks = [
        ("sizes", total["n"] == anomalies(scored).count()),
        ("keywords", all(len(w) == 8 and set(w) <= set(made.vectorizer.terms) for w in made.keywords())),
        ("cost", len(made.costs) == restarts and abs(min(made.costs) - total["cost"]) <= 1e-6 * max(1.0, total["cost"])),
        # Counted, because a filter would be pushed below the distances and work them out for each mention.
        ("nearest", checked.agg(F.count_if(own > F.array_min("far"))).first()[0] == 0),
        ("saved", loaded == made),
    ]
    return spark.createDataFrame(checks, "name string, ok boolean")


def _keywords(terms: list[str], centre, n: int = 8) -> list[str]:
    ranked = sorted(range(len(terms)), key=lambda i: (-centre[i], terms[i]))
    return [terms[i] for i in ranked[:n]]


def dominant_severity(rows: DataFrame, by: str) -> DataFrame:
    """Size and most frequent severity per group; the first in the alphabet on
    a tie, UNKNOWN where there is none."""
    levels = rows.groupBy(by, F.coalesce("severity", F.lit("UNKNOWN")).alias("s")).agg(F.count("*").alias("n"))
    # One entry per severity and group, so the array is short.
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("rank"), "s")))
    return levels.groupBy(by).agg(F.sum("n").alias("size"), ranked[0]["s"].alias("dominant_severity"))


def sample_messages(rows: DataFrame, by: str, k: int = 3, order: tuple[str, ...] = ("ts", "message")) -> DataFrame:
    """The first ``k`` messages of each group, cut to ``k`` before the shuffle."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(*order))
    first = rows.withColumn("_rank", rank).filter(F.col("_rank") <= k)
    listed = F.array_sort(F.collect_list(F.struct("_rank", "message")))
    return first.groupBy(by).agg(F.transform(listed, lambda x: x["message"]).alias("sample_msgs"))


def cluster_summaries(
    scored: DataFrame,
    vectorizer: Vectorizer | None = None,
    k: int = fixed.CLUSTERS,
    restarts: int = fixed.KMEANS_RESTARTS,
    order: tuple[str, ...] = ("ts", "message"),
    clustering: Clustering | None = None,
) -> DataFrame:
    """Size, keywords, first messages, dominant severity and text per cluster of the anomalies.

    Cluster numbers follow size, largest first, so they are stable. Centres
    that are given are taken as they are; ones without a row do not appear.
    """
    spark = scored.sparkSession
    clustering = clustering or fit_clusters(scored, vectorizer, k, restarts)
    if clustering is None:
        return spark.createDataFrame([], SUMMARY)
    rows = clustering.assign(anomalies(scored))
    level = F.col("severity") if "severity" in rows.columns else F.lit(None).cast("string")
    rows = stage(rows.withColumn("severity", level), "clustered")
    words = spark.createDataFrame(list(enumerate(clustering.keywords())), "cluster int, top_keywords array<string>")
    # At most k rows from here on.
    table = dominant_severity(rows, "cluster").join(sample_messages(rows, "cluster", 3, order), "cluster").join(words, "cluster")
    listed = table.agg(
        F.array_sort(F.collect_list(F.struct(
            -F.col("size"), "top_keywords", "cluster", "size", "sample_msgs", "dominant_severity"))).alias("c")
    )
    rows = listed.select(F.posexplode("c").alias("cluster_id", "c"))
    five = F.array_join(F.slice("c.top_keywords", 1, 5), ", ")
    return rows.select(
        "cluster_id", "c.size", "c.top_keywords", "c.sample_msgs", "c.dominant_severity",
        F.format_string(fixed.CLUSTER_SUMMARY, "cluster_id", "c.size", five, "c.dominant_severity").alias("summary"),
    )
