"""The registered queries: each takes (spark, folder of tables).

Log documents are derived from ``events`` once per session and folder and kept
in the shared folder, as are the flat log table and the scored table; queries
further down read those tables, as the programs they stand for read each
other's. Nothing is cut down: every query covers its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog import fixed_values as fixed
from emberlog import schemas
from emberlog.functions import severity, text, times
from emberlog.operators import (
    alerts, assistant, checks, clean, clusters, documents, evaluation, features,
    forest, grouping, quantiles, registry, report, scoring, search, security, tfidf, trends,
)
from emberlog.plans import detector
from emberlog.session import prepare, scratch, spread, stage
from emberlog.sources import scan, tables
from emberlog.sources.event_logs import source_documents
from emberlog.streaming import cooldown, pipeline, windows

# Row order where the input has none of its own.
ORDER = ("host", "log_file", "event_id")
TIES = ("event_id",)
# How far behind the newest row the query of a scan from a mark begins.
SCAN_SPAN = timedelta(days=20)
IDS = ("event_id", "copy")
CHUNKS = 4
# Rows of a view in the query whose cap binds at every scale.
VIEW_FIRST = 3
# Shares of the time range at which the batches of the merge query overlap.
MERGE_FROM, MERGE_TO = 0.3, 0.6

_kept: dict[tuple[str, str, str], object] = {}


class Inputs:
    """Tables of one folder, and those derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def texts(self, name: str) -> DataFrame:
        """A table whose rows are costly to work on; dealt out where the session asks for it."""
        partitions = self.spark.conf.get("spark.emberlog.spread", None)
        return spread(self.table(name), int(partitions) if partitions else None)

    def _once(self, name: str, build: Callable[[], object]):
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _kept:
            _kept[key] = build()
        return _kept[key]

    @property
    def sources(self) -> DataFrame:
        """As ingested: with the parsed time, kept by day."""
        return self._once("sources", lambda: by_day(source_documents(self.texts("events")), "sources"))

    @property
    def now(self) -> datetime:
        """Time of the newest source document; what the scan queries call now."""
        return self._once("now", lambda: scan.newest(self.sources))

    @property
    def start(self) -> datetime:
        return self._once("start", lambda: self.sources.agg(F.min("ts")).first()[0])

    def at(self, share: float) -> datetime:
        """The midnight nearest below a share of the time range."""
        return datetime.combine((self.start + (self.now - self.start) * share).date(), datetime.min.time())

    @property
    def logs(self) -> DataFrame:
        return self._once("logs", lambda: by_day(clean.logs_from(self.sources, order=ORDER), "logs"))

    @property
    def chunks(self) -> str:
        """The sources as files that a stream reads in order of time: CHUNKS batches of two files."""

        def build() -> str:
            path = scratch(self.spark, "source-files")
            edges = [self.at(k / CHUNKS) for k in range(1, CHUNKS)]
            part = sum(F.coalesce((F.col("ts") >= F.lit(e)).cast("int"), F.lit(0)) for e in edges)
            for k in range(CHUNKS):
                rows = self.sources.drop("day").filter(part == k)
                rows.repartition(2, "event_id").write.mode("append").parquet(path)
            return path

        return self._once("chunks", build)

    def stand_in(self, live: bool = False) -> StandIn:
        """Trained, so to speak, on all logs as the given path cleans them."""

        def build() -> StandIn:
            rows = self.logs if not live else stage(clean.logs_from(self.sources, live=True, order=ORDER), "live-logs")
            return StandIn.of(rows)

        return self._once(f"stand-in-{live}", build)

    @property
    def labelled(self) -> DataFrame:
        """All logs with a stand-in score, so that labels and all that follows
        can be checked against SQL. Takes no features."""
        return self._once("labelled", lambda: scoring.label_by_contamination(self.logs.withColumn("anomaly_score", -F.col("value"))))

    @property
    def scored(self) -> DataFrame:
        """The labelled logs with features, norm and severity, worked out and written in one go."""

        def build() -> DataFrame:
            given = ("anomaly_score", "anomaly")
            rows = features.basic_features(self.labelled)
            rows = rows.select(*[c for c in rows.columns if c not in given], *given)
            # From the labelled rows, which have the same scores: features would be worked out twice.
            low, high = self.labelled.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
            normed = scoring.normalize(rows, bounds=None if low is None else (low, high))
            return by_day(scoring.with_severity(normed), "scored")

        return self._once("scored", build)

    @property
    def documents(self) -> DataFrame:
        return self._once("documents", lambda: stage(documents.most_anomalous_per_key(documents.to_documents(self.scored)), "documents"))

    @property
    def model(self) -> detector.Model:
        return self._once("model", lambda: detector.train(self.logs))

    @property
    def log_vectorizer(self) -> tfidf.Vectorizer:
        """That of the model, whose vocabulary is fitted on the same messages; it takes no training."""
        return self._once("log-vectorizer", lambda: tfidf.Vectorizer.of(tfidf.fit_vocabulary(self.logs)))

    @property
    def vocabulary(self) -> DataFrame:
        """That of the documents table, saved."""
        return self._once("vocabulary", lambda: stage(tfidf.fit_vocabulary(self.texts("documents"), "text"), "vocabulary"))

    @property
    def vectorizer(self) -> tfidf.Vectorizer:
        return self._once("vectorizer", lambda: tfidf.Vectorizer.of(self.vocabulary))

    def monitored(self, live: bool = False) -> str:
        """The folder that the monitoring loop leaves, with the stand-in model, run once per path."""

        def build() -> str:
            out = scratch(self.spark, "monitored")
            model = self.stand_in(live)
            stream = pipeline.read_stream(self.spark, self.chunks, self.sources.drop("day").schema, "parquet", files_per_batch=2)
            pipeline.start_pipeline(stream, model, out, f"{out}/checkpoint", live, ORDER, availableNow=True).awaitTermination()
            return out

        return self._once(f"monitored-{live}", build)

    @property
    def plain_vectorizer(self) -> tfidf.Vectorizer:
        """Vocabulary of the scored messages, as clusters make one where none is given."""
        return self._once("plain-vectorizer", lambda: clusters.temporary_vectorizer(self.scored.select("event_id", "message")))

    @property
    def retrieved(self) -> DataFrame:
        """What each question finds among the anomaly documents, or the first ones if nothing."""

        def build() -> DataFrame:
            found = search.search(self.documents, self.questions, "qid", "text", keep=("timestamp", "severity", "message"))
            found = stage(found, "found")
            return stage(assistant.render(search.with_fallback(found, self.questions, self.documents, "qid")), "retrieved")

        return self._once("retrieved", build)

    @property
    def questions(self) -> DataFrame:
        asked = assistant.questions(self.table("conversations"))
        return asked.withColumn("qid", F.concat_ws("-", "conv_id", "turn"))


def by_day(rows: DataFrame, name: str) -> DataFrame:
    rows = scan.with_time(rows)
    return stage(rows.withColumn("day", F.to_date("ts")), name, by="day")


@dataclass
class StandIn:
    """A model whose score SQL can follow: the event's value, cut and scaled as in training."""

    cut: float
    bounds: tuple[float, float]

    @classmethod
    def of(cls, logs: DataFrame) -> StandIn:
        rows = logs.select((-F.col("value")).alias("score"))
        low, high = rows.agg(F.min("score"), F.max("score")).first()
        return cls(quantiles.exact_percentile(rows, "score", fixed.CONTAMINATION), (low, high))

    def predict(self, logs: DataFrame, slot: str | None = None) -> DataFrame:
        rows = features.basic_features(logs).withColumn("anomaly_score", -F.col("value"))
        rows = rows.withColumn("anomaly", F.when(F.col("anomaly_score") < self.cut, -1).otherwise(1))
        return scoring.with_severity(scoring.normalize(rows, bounds=self.bounds))


def comparable(df: DataFrame) -> DataFrame:
    """Plain types: long, double to six places, text for times and arrays."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.BooleanType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, "\n")
        out.append(c.alias(f.name))
    return df.select(*out)


QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}


def query(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def _scratch(i: Inputs, name: str) -> str:
    return scratch(i.spark, name)


def _stamp(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("@timestamp", "stamp")


# Sources and cleaning ------------------------------------------------------

@query
def log_sources(i: Inputs) -> DataFrame:
    rows = _stamp(i.sources)
    return rows.select("event_id", "copy", "stamp", "message", F.col("host.name").alias("host"),
                       F.col("log.original").alias("original"), F.col("log.file.path").alias("log_file"))


@query
def message_clean(i: Inputs) -> DataFrame:
    rows = _stamp(clean.flatten(i.sources))
    return rows.select("event_id", "copy", "stamp", "message", "message_short", "host", "log_file", "input_type", "agent_name")


@query
def message_clean_live(i: Inputs) -> DataFrame:
    return clean.flatten(i.sources, live=True).select("event_id", "copy", "message")


@query
def noise_filter(i: Inputs) -> DataFrame:
    return clean.scan_tally(i.sources)


@query
def dedupe_logs(i: Inputs) -> DataFrame:
    return _stamp(clean.logs_from(i.sources, order=ORDER)).select("event_id", "stamp", "message", "host", "log_file")


@query
def incremental_scan(i: Inputs) -> DataFrame:
    rows = scan.incremental_scan(i.sources, i.now - SCAN_SPAN, i.now)
    return _stamp(rows).select("event_id", "copy", "stamp", "message")


def _pages(i: Inputs) -> DataFrame:
    """All sources as a capped scan reads them, from the oldest row on."""
    return i._once("pages", lambda: stage(scan.paged(i.sources, i.start, i.now, fixed.SCAN_LIMIT, IDS), "pages"))


@query
def scan_pages(i: Inputs) -> DataFrame:
    return _stamp(_pages(i)).select("event_id", "copy", "stamp", "page")


@query
def scan_cursors(i: Inputs) -> DataFrame:
    """Where each page ends, as the state table has it after two scans, the second from the first one's cursor."""
    state, pages = _scratch(i, "scan-state"), _pages(i)
    half = pages.agg(F.floor(F.max("page") / 2)).first()[0]
    scan.save_cursors(scan.page_ends(pages.filter(F.col("page") <= half), IDS), state)
    cursor = scan.load_cursor(i.spark, state, IDS)
    rest = scan.paged(i.sources, i.start, i.now, fixed.SCAN_LIMIT, IDS, cursor, half + 1)
    scan.save_cursors(scan.page_ends(rest, IDS), state)
    return i.spark.read.parquet(state).select("step", "ts", *IDS)


@query
def scan_lookback(i: Inputs) -> DataFrame:
    rows = scan.incremental_scan(i.sources, None, i.now)
    return _stamp(rows).select("event_id", "copy", "stamp")


@query
def next_mark(i: Inputs) -> DataFrame:
    """Over all rows read, whatever cleaning drops of them."""
    return scan.next_mark(scan.incremental_scan(i.sources, i.start, i.now))


@query
def recent_scan(i: Inputs) -> DataFrame:
    return _stamp(scan.recent_scan(i.sources, i.now)).select("event_id", "copy", "stamp")


@query
def recent_windows(i: Inputs) -> DataFrame:
    """Every live view, one each 15 seconds, of all sources."""
    return scan.recent_windows(i.sources, i.start, i.now, IDS).select("event_id", "copy", "view")


@query
def recent_windows_capped(i: Inputs) -> DataFrame:
    """The same with the watcher's cap on the rows of a view."""
    return scan.recent_windows(i.sources, i.start, i.now, IDS, fixed.LIVE_LIMIT).select("event_id", "copy", "view")


@query
def recent_windows_first(i: Inputs) -> DataFrame:
    """The oldest few of each view: a cap that most views exceed."""
    return scan.recent_windows(i.sources, i.start, i.now, IDS, VIEW_FIRST).select("event_id", "copy", "view")


# Features ------------------------------------------------------------------

@query
def log_features(i: Inputs) -> DataFrame:
    return features.basic_features(i.logs).select("event_id", *fixed.FEATURES["full"])


@query
def time_fallback(i: Inputs) -> DataFrame:
    """Hour and weekday from the other time column, and zeros where there is neither."""
    named = features.time_features(i.logs.drop("ts").withColumnRenamed("@timestamp", "timestamp"))
    none = features.time_features(i.logs.drop("ts", "@timestamp"))
    rows = named.select("event_id", F.lit("timestamp").alias("source"), "hour", "day_of_week")
    return rows.unionByName(none.select("event_id", F.lit("none").alias("source"), "hour", "day_of_week"))


@query
def narrow_features(i: Inputs) -> DataFrame:
    return features.basic_features(i.logs, "narrow").select("event_id", *fixed.FEATURES["narrow"])


@query
def document_features(i: Inputs) -> DataFrame:
    rows = features.text_features(i.texts("documents"), col="text")
    return rows.select("doc_id", *fixed.FEATURES["full"][:7])


@query
def document_frequency(i: Inputs) -> DataFrame:
    docs = i.texts("documents").withColumnRenamed("text", "message")
    return features.frequency_feature(docs).select("doc_id", "message_frequency")


@query
def message_frequency(i: Inputs) -> DataFrame:
    return features.frequency_feature(i.logs).select("event_id", "message_frequency")


# Labels and severity -------------------------------------------------------

@query
def label_contamination(i: Inputs) -> DataFrame:
    rows = i.table("events").withColumn("anomaly_score", -F.col("value"))
    return scoring.label_by_contamination(rows).select("event_id", "anomaly")


@query
def label_distribution(i: Inputs) -> DataFrame:
    return evaluation.label_distribution(i.scored)


@query
def score_norm(i: Inputs) -> DataFrame:
    rows = i.scored.drop("anomaly_score_norm")
    both = scoring.normalize(scoring.normalize(rows), out="low_norm", orientation="low")
    return both.select("event_id", "anomaly_score_norm", "low_norm")


@query
def severity_bands(i: Inputs) -> DataFrame:
    rows = scoring.with_severity(i.scored.drop("severity"))
    return rows.select("event_id", "severity", severity.symbol(F.col("severity")).alias("symbol"))


@query
def severity_legacy(i: Inputs) -> DataFrame:
    flags = [F.col(c) for c in ("contains_error", "contains_login", "contains_warning")]
    # The stand-in score is rescaled to the range its cut-offs are made for.
    level = severity.from_raw(F.col("anomaly_score") / 1000, *flags)
    return i.scored.select("event_id", level.alias("severity"))


# Trends and evaluation -----------------------------------------------------

@query
def hourly_counts(i: Inputs) -> DataFrame:
    return trends.hourly_counts(i.scored)


@query
def weekday_counts(i: Inputs) -> DataFrame:
    return trends.weekday_counts(i.scored)


@query
def peak_hour(i: Inputs) -> DataFrame:
    return trends.peak(trends.hourly_counts(i.scored), "hour")


@query
def peak_day(i: Inputs) -> DataFrame:
    return trends.peak(trends.weekday_counts(i.scored), "day_name")


@query
def trend_direction(i: Inputs) -> DataFrame:
    rows = trends.trend_direction(i.scored)
    return rows.withColumn("arrow", severity.arrow(F.col("trend")))


@query
def off_hours(i: Inputs) -> DataFrame:
    return trends.off_hours(i.scored)


@query
def trend_insights(i: Inputs) -> DataFrame:
    return trends.insights(i.scored)


@query
def basic_stats(i: Inputs) -> DataFrame:
    return evaluation.basic_stats(i.scored)


@query
def score_stats(i: Inputs) -> DataFrame:
    return evaluation.score_stats(i.scored, quantile=False)


@query
def score_p95(i: Inputs) -> DataFrame:
    return i.spark.createDataFrame([(evaluation.norm_p95(i.scored),)], "norm_score_p95 double")


@query
def confusion(i: Inputs) -> DataFrame:
    return evaluation.confusion(i.scored)


@query
def confusion_labels(i: Inputs) -> DataFrame:
    return evaluation.confusion(i.table("labels"), ("toxic",), F.col("quality") == 0)


@query
def feature_diff(i: Inputs) -> DataFrame:
    return evaluation.feature_diff(i.scored)


@query
def score_histogram(i: Inputs) -> DataFrame:
    return evaluation.histogram(scoring.anomalies(i.scored), "anomaly_score")


@query
def severity_counts(i: Inputs) -> DataFrame:
    return evaluation.severity_bars(i.scored)


@query
def severity_share(i: Inputs) -> DataFrame:
    return report.severity_share(i.scored)


@query
def heatmap_24(i: Inputs) -> DataFrame:
    return report.heatmap(i.scored)


@query
def validation_gate(i: Inputs) -> DataFrame:
    return registry.validation_gate(i.labelled)


@query
def top_anomalies(i: Inputs) -> DataFrame:
    return report.top_table(i.scored, 20, TIES)


@query
def first_anomalies(i: Inputs) -> DataFrame:
    return _stamp(report.first_anomalies(i.scored, 10, ("ts", "event_id"))).select("event_id", "stamp", "severity", "message")


@query
def html_escape(i: Inputs) -> DataFrame:
    escaped = text.escape_html(F.col("html"))
    return i.texts("pages").select("page_id", F.md5(escaped).alias("digest"), F.length(escaped).alias("length"))


# Documents and alerts ------------------------------------------------------

@query
def anomaly_docs(i: Inputs) -> DataFrame:
    return documents.most_anomalous_per_key(documents.to_documents(i.scored))


@query
def legacy_docs(i: Inputs) -> DataFrame:
    rows = documents.to_legacy_documents(i.scored)
    return documents.most_anomalous_per_key(rows)


@query
def alert_rows(i: Inputs) -> DataFrame:
    """The older alert path over all scored rows, its clock at the newest row."""
    return documents.to_alert_rows(i.scored.withColumn("anomaly_score", F.col("anomaly_score") / 1000), i.now)


@query
def upsert_docs(i: Inputs) -> DataFrame:
    """Two overlapping batches put into one table, the second one last."""
    docs = i.documents
    path = _scratch(i, "upsert")
    first, last = (F.lit(i.at(x).isoformat()) for x in (MERGE_FROM, MERGE_TO))
    documents.upsert(docs.filter(F.col("timestamp") < last).withColumn("batch", F.lit(1)), path)
    merged = documents.upsert(docs.filter(F.col("timestamp") >= first).withColumn("batch", F.lit(2)), path)
    return merged.select("doc_id", "timestamp", "message", "batch")


@query
def upsert_tally(i: Inputs) -> DataFrame:
    return documents.tally(i.scored)


@query
def rejected_rows(i: Inputs) -> DataFrame:
    return _stamp(documents.rejected(i.scored)).select("event_id", "stamp", "message")


@query
def alert_cooldown(i: Inputs) -> DataFrame:
    """Cooldown over every document of the log table, so that it has work."""
    docs = documents.most_anomalous_per_key(documents.to_documents(i.scored.withColumn("anomaly", F.lit(-1))))
    due = alerts.candidates(docs)
    return alerts.cooldown(due).select("severity", "second", "doc_id")


@query
def alert_text(i: Inputs) -> DataFrame:
    return alerts.alert_text(alerts.actionable(i.documents)).select("doc_id", "text")


# Security and health -------------------------------------------------------

@query
def bruteforce_10m(i: Inputs) -> DataFrame:
    return security.bruteforce(i.logs)


@query
def login_sources(i: Inputs) -> DataFrame:
    return security.login_sources(i.logs)


@query
def port_scan(i: Inputs) -> DataFrame:
    return security.port_scan(i.logs)


@query
def blocked_sources(i: Inputs) -> DataFrame:
    return security.blocked_sources(i.logs)


@query
def health_categories(i: Inputs) -> DataFrame:
    return security.health_categories(i.logs)


@query
def template_patterns(i: Inputs) -> DataFrame:
    return security.template_patterns(i.logs)


@query
def day_over_day(i: Inputs) -> DataFrame:
    return security.day_over_day(i.scored)


@query
def cycle_delta(i: Inputs) -> DataFrame:
    return security.cycle_counts(i.scored)


@query
def sliding_5m_15s(i: Inputs) -> DataFrame:
    return security.sliding_counts(i.logs)


@query
def last_hour_summary(i: Inputs) -> DataFrame:
    return security.summary_between(i.scored)


@query
def critical_today(i: Inputs) -> DataFrame:
    """On a scale where there are some each day: the label aside, what is above the mean is critical."""
    mean = i.scored.agg(F.avg("anomaly_score_norm")).first()[0]
    rows = i.scored.withColumn("anomaly", F.lit(-1)).withColumn("severity", F.when(F.col("anomaly_score_norm") > mean, "CRITICAL"))
    return _stamp(security.critical_today(rows)).select("event_id", "stamp", "message", "anomaly_score_norm")


@query
def most_severe_per_day(i: Inputs) -> DataFrame:
    return _stamp(security.most_severe_per_day(i.scored, TIES)).select("date", "event_id", "severity", "anomaly_score_norm")


@query
def severity_today(i: Inputs) -> DataFrame:
    return security.summary_between(i.scored, "24 hours")


@query
def impact(i: Inputs) -> DataFrame:
    return security.impact(i.scored)


@query
def next_bucket(i: Inputs) -> DataFrame:
    return security.next_bucket(i.scored)


# Text, retrieval, assistant ------------------------------------------------

@query
def tfidf_vocab(i: Inputs) -> DataFrame:
    return tfidf.fit_vocabulary(i.texts("documents"), "text")


@query
def tfidf_vocab_plain(i: Inputs) -> DataFrame:
    return tfidf.fit_vocabulary(i.texts("documents"), "text", min_df=1, strip_accents=False)


@query
def tfidf_weights(i: Inputs) -> DataFrame:
    return i.vectorizer.weights(i.texts("documents"), "doc_id", "text")


@query
def bm25_search(i: Inputs) -> DataFrame:
    return search.search(i.texts("documents"), i.questions, "qid", "text", fields=("text", "lang"),
                         keep=("doc_id",), tie_break=("doc_id",))


@query
def search_fallback(i: Inputs) -> DataFrame:
    """Questions of the conversations put to the anomaly documents."""
    return i.retrieved.select("qid", "rank", "score", "line")


@query
def intent_class(i: Inputs) -> DataFrame:
    return i.table("conversations").select("conv_id", "turn", severity.intent(F.col("text")).alias("intent"))


@query
def log_intents(i: Inputs) -> DataFrame:
    return i.logs.select("event_id", severity.intent(F.col("message")).alias("intent"))


@query
def small_talk(i: Inputs) -> DataFrame:
    return i.table("conversations").select("conv_id", "turn", severity.is_small_talk(F.col("text")).alias("small_talk"))


@query
def last3_memory(i: Inputs) -> DataFrame:
    return assistant.last_n_memory(assistant.questions(i.table("conversations"))).select("conv_id", "turn", "memory")


@query
def prompt_table(i: Inputs) -> DataFrame:
    return assistant.prompt_table(i.table("conversations"), i.scored, tie_break=TIES)


@query
def retrieval_prompt(i: Inputs) -> DataFrame:
    """Every question with what it retrieved; those that ask for logs get the list itself."""
    return assistant.retrieval_prompts(i.questions, i.retrieved, assistant.direct_logs(i.scored, tie_break=TIES))


@query
def direct_logs(i: Inputs) -> DataFrame:
    return assistant.direct_logs(i.scored, tie_break=TIES)


# Models --------------------------------------------------------------------

@query
def iforest_scores(i: Inputs) -> DataFrame:
    return i.model.predict(i.logs).select("event_id", "anomaly", "anomaly_score", "anomaly_score_norm", "severity")


@query
def iforest_embeddings(i: Inputs) -> DataFrame:
    rows = i.table("embeddings").withColumn("features", F.col("embedding").cast("array<double>"))
    fitted = forest.fit(rows, "vec_id")
    return scoring.finish(stage(fitted.add_score(rows).drop("features", "embedding"), "embedding-scores"))


@query
def cluster_summaries(i: Inputs) -> DataFrame:
    return clusters.cluster_summaries(i.scored, i.log_vectorizer, order=("ts", "event_id"))


@query
def cluster_keywords(i: Inputs) -> DataFrame:
    """The host as a stand-in cluster: its eight terms of the highest mean weight."""
    return clusters.keywords_by(i.scored.select("event_id", "host", "message"), i.plain_vectorizer, "host")


@query
def cluster_checks(i: Inputs) -> DataFrame:
    """What must hold of any clustering, whatever the start: all true."""
    return clusters.verify(i.scored, i.log_vectorizer, _scratch(i, "clustering"))


def _host_centres(i: Inputs) -> clusters.Clustering:
    """Stand-in centres that SQL can work out as well, through their saved form: the hosts' mean weights."""

    def build() -> clusters.Clustering:
        rows, path = i.scored.select("event_id", "host", "message"), _scratch(i, "host-centres")
        clusters.mean_centres(rows, i.plain_vectorizer, "host").save(i.spark, path)
        return clusters.Clustering.load(i.spark, path)

    return i._once("host-centres", build)


@query
def cluster_assignment(i: Inputs) -> DataFrame:
    """Every row at its nearest centre, with the squared distance."""
    return _host_centres(i).assign(i.scored).select("event_id", "cluster", "distance")


@query
def cluster_summaries_given(i: Inputs) -> DataFrame:
    """Summaries of the anomalies around centres that are given."""
    return clusters.cluster_summaries(i.scored, order=("ts", "event_id"), clustering=_host_centres(i))


@query
def retrained(i: Inputs) -> DataFrame:
    """Seven versions trained and judged with their verdicts; the newest five stay listed, the last is in use."""
    path = _scratch(i, "models")
    training = detector.prepare(i.logs)
    for n in range(7):
        detector.retrain(i.logs, path, f"2024010{n + 1}_000000", f"{path}/registry", training)
    listed = registry.retain_newest(registry.versions(registry.read(i.spark, f"{path}/registry")))
    used = registry.current(i.spark, f"{path}/registry").select("tag", F.lit(True).alias("in_use"))
    return listed.join(used, "tag", "left").select("tag", "ok", "rate", "reason", "latest", F.coalesce("in_use", F.lit(False)).alias("in_use"))


@query
def rollback_history(i: Inputs) -> DataFrame:
    """The days' versions published, rolled back, published on and rolled back to the first: what was in use when."""
    path, entries = _scratch(i, "rollbacks"), stage(_daily_versions(i.scored), "daily-versions")
    newest = F.col("tag") >= F.lit(entries.orderBy(F.col("tag").desc()).limit(2).agg(F.min("tag")).first()[0])
    registry.publish(entries.filter(~newest), path)
    registry.rollback(i.spark, path)
    registry.publish(entries.filter(newest), path)
    registry.rollback(i.spark, path, entries.filter("ok").agg(F.min("tag")).first()[0])
    used = registry.current(i.spark, path).select("tag", F.lit(True).alias("in_use"))
    return registry.pointer(i.spark, path).join(used, "tag", "left").select("seq", "action", "tag", F.coalesce("in_use", F.lit(False)).alias("in_use"))


@query
def dominant_severity(i: Inputs) -> DataFrame:
    return clusters.dominant_severity(i.scored, "host")


@query
def sample_messages(i: Inputs) -> DataFrame:
    return clusters.sample_messages(i.scored, "host", 3, ("ts", "event_id"))


def _daily_versions(scored: DataFrame) -> DataFrame:
    """Each day's batch judged by the gate, as a registry would list them."""
    days = scored.filter("ts IS NOT NULL").groupBy(F.date_format("ts", "yyyyMMdd_000000").alias("tag")).agg(
        F.count("*").alias("total"), F.count_if(F.col("anomaly") == -1).alias("anomalies"))
    verdict = registry.gate_columns(F.col("total"), F.col("anomalies"), fixed.GATE_LOW, fixed.GATE_HIGH)
    return days.select("tag", F.concat(F.lit("models/"), F.col("tag")).alias("path"), *[c.alias(n) for n, c in verdict.items()])


@query
def model_versions(i: Inputs) -> DataFrame:
    return registry.retain_newest(registry.versions(_daily_versions(i.scored)))


@query
def rollback_target(i: Inputs) -> DataFrame:
    return registry.select_version(_daily_versions(i.scored)).select("tag", "path")


@query
def readiness_checks(i: Inputs) -> DataFrame:
    return _readiness(i)


@query
def readiness_overall(i: Inputs) -> DataFrame:
    return checks.overall(_readiness(i))


def _readiness(i: Inputs) -> DataFrame:
    """Everything a run depends on: sources, logs, scored rows, documents, vocabulary and registry."""
    asked = [
        (i.sources, "sources", ["@timestamp", "message", "host"]), (i.logs, "logs", ["@timestamp", "message", "host"]),
        (i.scored, "scored", ["anomaly", "anomaly_score_norm", "severity"]), (i.documents, "documents", ["doc_id", "timestamp"]),
        (i.vocabulary, "vocabulary", ["term", "idf"]), (_daily_versions(i.scored).filter("ok"), "accepted versions", ["tag", "path"]),
    ]
    found = [checks.readiness(*one) for one in asked]
    return reduce(DataFrame.unionByName, found)


# Tables written and read back ------------------------------------------------

@query
def scored_batches(i: Inputs) -> DataFrame:
    """Scored rows appended in two batches, the second one written twice."""
    path, late = _scratch(i, "batches"), F.coalesce(F.col("ts") >= F.lit(i.at(0.5)), F.lit(False))
    rows = i.scored.drop("day")
    for batch, part in ((0, ~late), (1, late), (1, late)):
        tables.write_batch(rows.filter(part), path, batch)
    return i.spark.read.parquet(path).select("event_id", "batch_id", "anomaly_score")


@query
def anomaly_table(i: Inputs) -> DataFrame:
    path = _scratch(i, "anomalies")
    tables.write_anomalies(i.scored, path)
    return _stamp(i.spark.read.parquet(path)).select("event_id", "stamp", "message", "anomaly", "severity")


@query
def log_table_csv(i: Inputs) -> DataFrame:
    """The log table through CSV and back, quotes and all."""
    path = _scratch(i, "logs-csv")
    tables.write_logs(i.logs.select(*[f.name for f in schemas.LOG.fields]), path, "csv")
    return _stamp(tables.read_logs(i.spark, path, "csv")).select("stamp", "message", "host", "log_file")


@query
def vocabulary_saved(i: Inputs) -> DataFrame:
    """Weights by a vocabulary that was saved and loaded."""
    path = _scratch(i, "vocabulary")
    tfidf.fit_vocabulary(i.texts("documents"), "text").write.parquet(path)
    return tfidf.Vectorizer.load(i.spark, path).weights(i.texts("documents"), "doc_id", "text")


@query
def feature_matrix(i: Inputs) -> DataFrame:
    """Every non-zero place of the rows a model is given."""
    rows = features.basic_features(i.logs)
    rows = detector.feature_matrix(rows, i.log_vectorizer)
    return tfidf.long_form(rows, "features", "event_id")


@query
def frequency_of_repeats(i: Inputs) -> DataFrame:
    """How often each text of the conversations occurs, looked up row by row."""
    rows = i.table("conversations")
    return grouping.attach_count(rows, "text", "n").select("conv_id", "turn", "n")


@query
def no_trend(i: Inputs) -> DataFrame:
    """What is said of a table without anomalies."""
    return trends.insights(i.scored.filter("anomaly = 0"))


# Streams -------------------------------------------------------------------

def _source_stream(i: Inputs) -> DataFrame:
    """The source documents in CHUNKS batches."""
    return pipeline.read_stream(i.spark, i.chunks, i.sources.drop("day").schema, "parquet", files_per_batch=2)


def _changes(i: Inputs, counts: DataFrame, name: str) -> DataFrame:
    out = _scratch(i, name)
    windows.write_changes(counts, f"{out}/counts", f"{out}/checkpoint", availableNow=True).awaitTermination()
    return i.spark.read.parquet(f"{out}/counts")


@query
def stream_replay(i: Inputs) -> DataFrame:
    """Counts per cycle from a stream of the source documents."""
    counts = windows.tumbling_counts(clean.flatten(_source_stream(i)), delay="1 day")
    return windows.latest(_changes(i, counts, "stream-replay"), "cycle")


@query
def stream_sliding(i: Inputs) -> DataFrame:
    """The live view's windows from a stream's panes."""
    panes = windows.latest(_changes(i, windows.live_panes(clean.flatten(_source_stream(i)), "1 day"), "stream-panes"), "pane")
    return security.windows_of_panes(panes)


@query
def stream_late(i: Inputs) -> DataFrame:
    """Batches whose first one comes again at the end, too late to count.

    A batch is filtered by the mark known when the one before it began, so two
    others lie between.
    """
    path, ts, x, y = _scratch(i, "late-files"), F.col("ts"), F.lit(i.at(1 / 3)), F.lit(i.at(2 / 3))
    for part in (ts < x, (ts >= x) & (ts < y), ts >= y, ts < x):
        i.sources.drop("day").filter(part).repartition(2, "event_id").write.mode("append").parquet(path)
    stream = pipeline.read_stream(i.spark, path, i.sources.drop("day").schema, "parquet", files_per_batch=2)
    counts = windows.tumbling_counts(stream, delay="0 seconds")
    return windows.latest(_changes(i, counts, "stream-late"), "cycle")


@query
def stream_repeats(i: Inputs) -> DataFrame:
    """Repeated documents dropped across batches."""
    out = _scratch(i, "stream-repeats")
    rows = windows.drop_repeats(clean.flatten(_source_stream(i)).filter("ts IS NOT NULL"), "1 day")
    _stamp(rows).select("stamp", "message").writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(
        availableNow=True).start(f"{out}/rows", format="parquet").awaitTermination()
    return i.spark.read.parquet(f"{out}/rows").select("stamp", "message")


@query
def stream_upsert(i: Inputs) -> DataFrame:
    """Documents after all batches: those of one run over everything."""
    return documents.read(i.spark, f"{i.monitored()}/documents").drop("day")


@query
def stream_alerts(i: Inputs) -> DataFrame:
    """Alerts of all batches; the cooldown carries over from one to the next."""
    return i.spark.read.parquet(f"{i.monitored()}/alerts").select("severity", "second", "doc_id")


@query
def stream_cooldown(i: Inputs) -> DataFrame:
    """Cooldown as keyed state of a stream, stopped after each batch and started again from its checkpoint.

    The same documents as those of ``alert_cooldown``, in CHUNKS batches by
    time; a last row long after all others closes their windows. A batch is
    all files written since the one before, as many as its rows take.
    """
    out, end, ts = _scratch(i, "stream-cooldown"), i.now + timedelta(days=1), F.col("ts")
    docs = documents.most_anomalous_per_key(documents.to_documents(i.scored.withColumn("anomaly", F.lit(-1))))
    docs = docs.withColumn("ts", F.to_timestamp("timestamp"))
    part = sum((ts >= F.lit(i.at(k / CHUNKS))).cast("int") for k in range(1, CHUNKS))
    docs = stage(docs.withColumn("part", part), "cooldown-documents", by="part")
    last = docs.limit(1).withColumns({"ts": F.lit(end), "severity": F.lit("NONE")})
    for k in range(CHUNKS):
        rows = docs.filter(F.col("part") == k)
        (rows.unionByName(last) if k == CHUNKS - 1 else rows).drop("part").write.mode("append").parquet(f"{out}/in")
        stream = pipeline.read_stream(i.spark, f"{out}/in", docs.drop("part").schema, "parquet")
        cooldown.start_cooldown(stream, f"{out}/sent", f"{out}/checkpoint", availableNow=True).awaitTermination()
    return i.spark.read.parquet(f"{out}/sent").filter("severity <> 'NONE'").select("severity", "second", "doc_id")


@query
def stream_live_top(i: Inputs) -> DataFrame:
    """The live path's five highest scores of each batch."""
    return i.spark.read.parquet(f"{i.monitored(live=True)}/top").select("batch_id", "rank", "doc_id", "severity")


@query
def stream_monitor(i: Inputs) -> DataFrame:
    """The whole monitoring loop over a stream; the documents it leaves."""
    out = _scratch(i, "stream-monitor")
    model = i.model.with_bounds()
    pipeline.start_pipeline(_source_stream(i), model, out, f"{out}/checkpoint", order=ORDER, availableNow=True).awaitTermination()
    return documents.read(i.spark, f"{out}/documents").drop("day")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(build):
        return lambda spark, folder: comparable(build(Inputs(spark, folder)))

    return {name: bound(build) for name, build in QUERIES.items()}
