"""Training and prediction from end to end."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog import fixed_values as fixed
from emberlog.operators import forest, registry, scoring, tfidf
from emberlog.operators.features import basic_features
from emberlog.schemas import require_columns
from emberlog.session import stage


@dataclass
class Model:
    vectorizer: tfidf.Vectorizer
    trees: forest.Forest
    profile: str = "full"
    # Range of the training scores; severities then do not depend on a batch.
    bounds: tuple[float, float] | None = None

    def add_features(self, logs: DataFrame) -> DataFrame:
        return feature_matrix(basic_features(logs, self.profile), self.vectorizer, self.profile)

    def score(self, logs: DataFrame) -> DataFrame:
        """Logs with numeric features and the decision score."""
        return self.trees.add_score(self.add_features(logs)).drop("features")

    def predict(self, logs: DataFrame, slot: str | None = None) -> DataFrame:
        """Logs with label, scores and severity.

        Scores are staged, because walking the forest again costs more than a
        write. They are normalised by the range of the training scores and cut
        off at its ends, or by the batch's own range where none was learned.
        """
        scored = scoring.label(stage(self.score(logs), "predicted", slot))
        if self.profile == "narrow":
            return scoring.normalize(scored, orientation="low", bounds=self.bounds)
        return scoring.with_severity(scoring.normalize(scored, bounds=self.bounds))

    def with_bounds(self, logs: DataFrame | None = None) -> Model:
        """This model with the range of its scores over ``logs``, or over its training rows if just fitted."""
        if logs is None:
            return replace(self, bounds=self.trees.training_range())
        low, high = self.score(logs).agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
        return replace(self, bounds=None if low is None else (low, high))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, t, None, None, w) for i, (t, w) in enumerate(zip(self.vectorizer.terms, self.vectorizer.idf))]
        spark.createDataFrame(rows, tfidf.VOCABULARY).write.mode("errorifexists").parquet(f"{path}/vocabulary")
        self.trees.save(spark, f"{path}/forest")
        ends = [self.bounds] if self.bounds else []
        spark.createDataFrame(ends, "low double, high double").write.mode("errorifexists").parquet(f"{path}/bounds")

    @classmethod
    def load(cls, spark: SparkSession, path: str, profile: str = "full") -> Model:
        vectorizer = tfidf.Vectorizer.load(spark, f"{path}/vocabulary")
        ends = spark.read.schema("low double, high double").parquet(f"{path}/bounds").first()
        return cls(vectorizer, forest.Forest.load(spark, f"{path}/forest"), profile, tuple(ends) if ends else None)


def feature_matrix(df: DataFrame, vectorizer: tfidf.Vectorizer, profile: str = "full") -> DataFrame:
    """Add ``features``: the numeric columns and the term weights, nulls as 0."""
    names = fixed.FEATURES[profile]
    require_columns(df, *names)
    numeric = F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names])
    return vectorizer.add(df).withColumn("features", F.concat(numeric, "tfidf")).drop("tfidf")


@dataclass
class Training:
    """What versions trained on the same logs share: the vocabulary and the rows' features, kept."""

    vectorizer: tfidf.Vectorizer
    rows: DataFrame
    distinct: DataFrame
    profile: str


def prepare(logs: DataFrame, profile: str = "full") -> Training:
    """Vocabulary and features of de-duplicated logs.

    Features are staged, because fitting and scoring read them several times.
    """
    rows = stage(basic_features(logs, profile), "training")
    vectorizer = tfidf.Vectorizer.of(tfidf.fit_vocabulary(rows))
    key = F.md5(F.concat_ws("|", "@timestamp", "message").cast("binary"))
    keyed = feature_matrix(rows, vectorizer, profile).select(key.alias("_key"), "features")
    keyed = stage(keyed, "training-features")
    return Training(vectorizer, keyed, stage(forest.distinct_features(keyed), "training-distinct"), profile)


def fit(training: Training, **forest_options) -> Model:
    trees = forest.fit(training.rows, "_key", distinct=training.distinct, **forest_options)
    return Model(training.vectorizer, trees, training.profile)


def train(logs: DataFrame, profile: str = "full", **forest_options) -> Model:
    """Fit vocabulary and forest on de-duplicated logs."""
    return fit(prepare(logs, profile), **forest_options)


def retrain(logs: DataFrame, path: str, tag: str, registry_path: str, training: Training | None = None, **forest_options) -> bool:
    """Train, validate, and publish only what passes.

    A version lives in its own folder and is entered in the registry with the
    verdict. A rejected one never comes into use, so there is nothing to
    restore. Its rows are scored once, for the offset, the range of the scores
    and the verdict. ``training`` spares the features where they are at hand.
    """
    spark = logs.sparkSession
    training = training or prepare(logs)
    model = fit(training, **forest_options)
    model = model.with_bounds()
    model.save(spark, f"{path}/{tag}")
    verdict = registry.validation_gate(scoring.label(model.trees.training_scores()), size="n")
    entry = stage(verdict.select(F.lit(tag).alias("tag"), F.lit(f"{path}/{tag}").alias("path"), "ok", "rate", "reason"), "verdict")
    registry.publish(entry, registry_path)
    return bool(entry.first()["ok"])


def load_published(spark: SparkSession, registry_path: str, tag: str | None = None, profile: str = "full") -> Model:
    """The model in use, or the accepted one with the given tag."""
    chosen = registry.select_version(registry.read(spark, registry_path), tag) if tag else registry.current(spark, registry_path)
    chosen = chosen.first()
    if chosen is None:
        raise LookupError("no accepted model version")
    return Model.load(spark, chosen["path"], profile)
