"""Hand-made frames for the corners of each definition."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberlog import fixed_values as fixed
from emberlog import schemas, session
from emberlog.functions import folding, severity, text, times
from emberlog.operators import (
    alerts, assistant, checks, clean, documents, evaluation, features, quantiles, registry, report, scoring, trends,
)
from emberlog.operators.grouping import attach_count
from emberlog.operators.quantiles import exact_percentile
from emberlog.plans import registered
from emberlog.sources import scan, snapshots, tables


def one(df):
    (row,) = df.collect()
    return row


def column(df, name):
    return [r[name] for r in df.collect()]


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, message string")


def scored(spark, rows, schema="hour int, day_of_week int, severity string, anomaly int"):
    return spark.createDataFrame(rows, schema)


# Cleaning ------------------------------------------------------------------

def sources(spark, *docs):
    import json

    return spark.read.schema(schemas.SOURCE).json(spark.sparkContext.parallelize([json.dumps(d) for d in docs]))


def test_message_falls_back_and_missing_objects_are_safe(spark):
    df = sources(
        spark,
        {"@timestamp": "t1", "message": " \t", "log": {"original": "  from log "}},
        {"@timestamp": "t2", "event": {"original": "from event"}, "log": None, "host": None},
        {"@timestamp": "t3", "message": "  "},
        {"message": "kept", "host": {"name": "h"}, "agent": {"name": "a"}, "input": {"type": "x"}},
    )
    rows = {r["message"]: r for r in clean.flatten(df).collect()}
    assert set(rows) == {"from log", "from event", "kept"}
    assert rows["kept"]["@timestamp"] == "" and rows["kept"]["host"] == "h"
    assert rows["from event"]["host"] == "" and rows["from event"]["log_file"] == ""


def test_noise_is_case_sensitive(spark):
    df = sources(spark, {"message": "x libbeat y"}, {"message": "x LIBBEAT y"}, {"message": 'a "monitoring" b'})
    assert column(clean.flatten(df), "message") == ["x LIBBEAT y"]


def test_prefix_strips(spark):
    stamp = "2024-01-05T10:00:00.123456+05:30 node-7 "
    df = sources(
        spark,
        {"message": stamp + "sshd[88]: hello"},
        {"message": stamp + "sshd[88]:"},
        {"message": "2024-01-05T10:00:00+05:30 node-7 cron: tick"},
    )
    assert column(clean.flatten(df), "message") == ["hello", stamp + "sshd[88]:", "tick"]
    live = column(clean.flatten(df, live=True), "message")
    assert live == ["sshd[88]: hello", "sshd[88]:", "2024-01-05T10:00:00+05:30 node-7 cron: tick"]


def test_dedupe_keeps_first_in_order(spark):
    df = spark.createDataFrame(
        [("t", "m", "b", "2"), ("t", "m", "a", "9"), ("t", "n", "z", "1"), ("u", "m", "c", "1")],
        "`@timestamp` string, message string, host string, log_file string")
    rows = sorted((r["@timestamp"], r["message"], r["host"]) for r in clean.dedupe(df).collect())
    assert rows == [("t", "m", "a"), ("t", "n", "z"), ("u", "m", "c")]


def test_scan_bounds_are_inclusive_and_cap_is_exact(spark):
    df = spark.createDataFrame(
        [(i, f"2024-01-01T00:00:0{s}+00:00") for i, s in enumerate([0, 1, 1, 1, 2, 3])], "i int, `@timestamp` string")
    rows = scan.incremental_scan(df, "2024-01-01 00:00:01", "2024-01-01 00:00:02")
    assert sorted(column(rows, "i")) == [1, 2, 3, 4]
    capped = scan.incremental_scan(df, "2024-01-01 00:00:01", "2024-01-01 00:00:02", 2, ("i",))
    assert column(capped, "i") == [1, 2]
    assert sorted(column(scan.incremental_scan(df, None, "2024-01-01 00:10:00"), "i")) == [0, 1, 2, 3, 4, 5]


# Features ------------------------------------------------------------------

@pytest.mark.parametrize("value", ["", None, "  a  b\xa0c\x1cd ", "ABⒶǅ \U0001f600", "١٢ 3", "tab\tnew\nline\u2003x"])
def test_text_features(spark, value):
    row = one(features.text_features(texts(spark, value)))
    value = value or ""
    assert row["msg_length"] == len(value)
    assert row["digit_count"] == sum(c.isdecimal() for c in value)
    assert row["word_count"] == len(value.split())
    assert row["uppercase_ratio"] == pytest.approx(sum(c.isupper() for c in value) / max(len(value), 1))


def test_keyword_profiles(spark):
    df = texts(spark, "An EXCEPTION", "authorised", "warn only", "Critical WARNING")
    full, narrow = (features.text_features(df, p).orderBy("i").collect() for p in ("full", "narrow"))
    flags = ("contains_error", "contains_login", "contains_warning")
    assert [tuple(r[f] for f in flags) for r in full] == [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1)]
    assert [tuple(r[f] for f in flags) for r in narrow] == [(0, 0, 0), (0, 0, 0), (0, 0, 0), (1, 0, 1)]


def test_time_features_parse_each_row(spark):
    df = spark.createDataFrame([(s,) for s in (
        "2024-01-01T05:30:00+05:30", "2024-01-07 23:00:00", "nonsense", "", None)], "`@timestamp` string")
    rows = features.time_features(df).collect()
    assert [(r["hour"], r["day_of_week"]) for r in rows] == [(0, 0), (23, 6), (0, 0), (0, 0), (0, 0)]
    bare = one(features.time_features(spark.range(1)))
    assert (bare["hour"], bare["day_of_week"]) == (0, 0)


def test_day_names(spark):
    df = spark.createDataFrame([(-1,), (0,), (6,), (7,)], "d int").select(times.day_name(F.col("d")).alias("n"))
    assert column(df, "n") == ["Unknown", "Monday", "Sunday", "Unknown"]


def test_group_count_with_hot_keys(spark):
    rng = np.random.default_rng(7)
    keys = ["hot"] * 500 + [None] * 20 + [f"k{x}" for x in rng.integers(0, 300, 480)]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string").repartition(6)
    # With so few parts hot and cold keys both take part in the join.
    for parts in (2, 256, 10_000):
        got = {r["i"]: r["n"] for r in attach_count(df, "k", "n", parts).collect()}
        expected = pd.Series(keys).map(pd.Series(keys).value_counts()).fillna(1).astype(int).to_dict()
        assert got == expected


def test_group_count_without_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        test_group_count_with_hot_keys(spark)
        # What is shuffled for the join is the hash of the key, not the key.
        rows = attach_count(spark.range(10).withColumn("k", F.col("id") % 2), "k", "n")
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(_at#" in plan and "SortMergeJoin [_at#" in plan
        # Hot rows are answered from the broadcast and not shuffled again.
        assert "BroadcastHashJoin [_at#" in plan and "LeftAnti" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


# Quantiles, labels, scores -------------------------------------------------

@pytest.mark.parametrize("values", [
    [3.0], [1.0, 2.0], [5.0] * 50, [0.0] * 40 + [1.0] * 3, list(np.random.default_rng(1).normal(size=997)),
    [1e-300, 1e300, 5.0, 5.0, 7.0], list(np.repeat(np.arange(20.0), 30)),
])
@pytest.mark.parametrize("p", [0.0, 0.02, 0.5, 0.95, 1.0])
def test_exact_percentile(spark, values, p):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3)
    assert exact_percentile(df, "v", p) == pytest.approx(np.quantile(values, p), rel=1e-12)


@pytest.mark.parametrize("accuracy", [1, 3, 10_000])
def test_exact_percentile_with_infinities_and_missed_brackets(spark, monkeypatch, accuracy):
    values = [float("-inf")] * 3 + sorted(np.random.default_rng(2).normal(size=500)) + [float("inf")] * 20
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(4)
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    for p in (0.0, 0.3, 0.97, 1.0):
        at = p * (len(values) - 1)
        low, high = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
        expected = low if low == high else low + (high - low) * (at - int(at))
        assert exact_percentile(df, "v", p) == pytest.approx(expected, rel=1e-12)


def test_percentile_of_nothing(spark):
    assert exact_percentile(spark.createDataFrame([], "v double"), "v", 0.5) is None


def test_band_edges_are_strict(spark):
    df = spark.createDataFrame([(x,) for x in (0.86, 0.85, 0.65, 0.45, 0.25, 1.0)], "x double")
    got = column(df.select(severity.from_norm(F.col("x")).alias("s")), "s")
    assert got == ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", "CRITICAL"]


def test_constant_batch_is_all_critical(spark):
    df = spark.createDataFrame([(0.3,), (0.3,)], "anomaly_score double")
    rows = scoring.finish(df).collect()
    assert [(r["anomaly_score_norm"], r["severity"], r["anomaly"]) for r in rows] == [(1.0, "CRITICAL", 1)] * 2
    low = scoring.normalize(df, orientation="low").collect()
    assert [r["anomaly_score_norm"] for r in low] == [None, None]


def test_norm_with_given_bounds(spark):
    df = spark.createDataFrame([(0.0,), (1.0,)], "anomaly_score double")
    assert column(scoring.normalize(df, bounds=(-1.0, 1.0)), "anomaly_score_norm") == [0.5, 0.0]


# Trends and evaluation -----------------------------------------------------

def hours(*counts):
    return [(h, 0, "HIGH", -1) for h, n in counts for _ in range(n)]


@pytest.mark.parametrize("counts, trend", [
    ([(1, 1), (5, 100)], "Stable"),
    ([(2, 1), (9, 2), (23, 3)], "Increasing"),
    ([(2, 3), (9, 2), (23, 1)], "Decreasing"),
    ([(2, 2), (9, 3), (23, 3)], "Stable"),
])
def test_trend_uses_present_hours(spark, counts, trend):
    assert one(trends.trend_direction(scored(spark, hours(*counts))))["trend"] == trend


def test_peak_ties(spark):
    rows = hours((7, 2), (3, 2)) + [(5, 1, "LOW", -1), (5, 6, "LOW", 1)]
    df = scored(spark, rows)
    row = one(trends.trends(df))
    assert (row["peak_hour"]["key"], row["peak_hour"]["n"]) == (3, 2)
    assert one(trends.peak(trends.hourly_counts(df), "hour"))["hour"] == 3
    tie = scored(spark, [(1, 2, "LOW", -1), (1, 0, "LOW", -1), (1, 4, "LOW", -1)])
    assert one(trends.trends(tie))["peak_day"]["key"] == "Friday"


def test_no_anomalies(spark):
    df = scored(spark, [(1, 1, "LOW", 1)])
    row = one(trends.trends(df))
    assert row["trend"] == "Stable" and row["peak_hour"] is None and row["peak_day"] is None
    assert column(trends.insights(df), "text") == [fixed.INSIGHT_EMPTY]
    assert [r["n"] for r in report.severity_share(df).collect()] == [0] * 5
    assert [r["share"] for r in report.heatmap(df).collect()] == [0.0] * 24


def test_everything_counts_when_nothing_is_labelled(spark):
    df = scored(spark, hours((1, 3))).drop("anomaly")
    assert one(trends.off_hours(df))["anomalies"] == 3


def test_confusion_zero_denominators(spark):
    df = spark.createDataFrame([(1, 0, 0, 0)] * 3, "anomaly int, contains_error int, contains_login int, contains_warning int")
    row = one(evaluation.confusion(df))
    assert (row["tn"], row["precision"], row["recall"], row["f1"]) == (3, 0.0, 0.0, 0.0)


def test_histogram(spark):
    values = [0.0, 0.1, 0.3, 0.6, 0.7, 1.0, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = sorted(evaluation.histogram(df, "v").collect())
    counts, edges = np.histogram(values, bins=np.linspace(0, 1, 11))
    assert [r["n"] for r in rows] == list(counts)
    assert [r["edge"] for r in rows] == pytest.approx(list(edges[:-1]))
    same = evaluation.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v").collect()
    assert [(r["bin"], r["n"], r["edge"]) for r in same] == [(1, 2, 2.0)]
    assert evaluation.histogram(spark.createDataFrame([], "v double"), "v").collect() == []


def test_score_stats_of_small_classes(spark):
    df = spark.createDataFrame([(-1, -0.5, 1.0)], "anomaly int, anomaly_score double, anomaly_score_norm double")
    row = one(evaluation.score_stats(df))
    assert row["score_anom_std"] is None and row["score_norm_mean"] == 0.0 and row["score_norm_std"] == 0.0
    assert row["norm_score_p95"] == 1.0


@pytest.mark.parametrize("hits, total, ok", [(5, 1000, True), (150, 1000, True), (4, 1000, False), (151, 1000, False), (0, 0, False)])
def test_gate(spark, hits, total, ok):
    df = spark.range(total).select(F.when(F.col("id") < hits, -1).otherwise(1).alias("anomaly"))
    assert one(registry.validation_gate(df))["ok"] is ok


def test_versions(spark):
    df = spark.createDataFrame([(f"t{i}", f"p{i}", i != 7, 0.01, "") for i in range(8)], registry.REGISTRY)
    assert sorted(column(registry.retain_newest(df), "tag")) == ["t3", "t4", "t5", "t6", "t7"]
    assert one(registry.select_version(df))["tag"] == "t6"
    assert one(registry.select_version(df, "t2"))["tag"] == "t2"
    assert [r["tag"] for r in registry.versions(df).filter("latest").collect()] == ["t6"]


# Documents and alerts ------------------------------------------------------

def test_iso_rendering(spark):
    df = spark.createDataFrame([("2024-01-01T05:30:00+05:30",), ("2024-01-01T00:00:00.000100",)], "s string")
    got = column(df.select(times.iso_utc(times.parse(F.col("s"))).alias("x")), "x")
    assert got == ["2024-01-01T00:00:00+00:00", "2024-01-01T00:00:00.000100+00:00"]


def test_documents_default_missing_fields(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z", "m" * 250, -1), ("", "x", -1), (None, "y", -1), ("2024-01-01", "z", 1)],
                               "timestamp string, message string, anomaly int")
    docs = documents.to_documents(df)
    assert docs.schema.simpleString() == schemas.ANOMALY_DOC.simpleString()
    row = one(docs)
    assert row["severity"] == "INFO" and row["word_count"] == 0 and len(row["message_short"]) == 200
    assert one(documents.tally(df)).asDict() == {"uploaded": 1, "skipped": 2}
    with pytest.raises(ValueError):
        documents.to_documents(df.drop("anomaly"))


def test_host_can_widen_the_key(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z", "m", "a", -1), ("2024-01-01T00:00:00Z", "m", "b", -1)],
                               "`@timestamp` string, message string, host string, anomaly int")
    assert documents.most_anomalous_per_key(documents.to_documents(df)).count() == 1
    assert documents.most_anomalous_per_key(documents.to_documents(df, ("host",))).count() == 2


def test_upsert_replaces_only_matching_days(spark, tmp_path):
    schema = "doc_id string, timestamp string, anomaly_score double, message string"
    first = spark.createDataFrame([("a", "2024-01-01T01", 0.1, "old"), ("b", "2024-01-01T02", 0.1, "old"), ("c", "2024-01-02T00", 0.1, "old")], schema)
    second = spark.createDataFrame([("a", "2024-01-01T01", 0.2, "new"), ("a", "2024-01-01T01", 0.3, "later"), ("d", "2024-01-03T00", 0.1, "new")], schema)
    path = str(tmp_path / "docs")
    documents.upsert(first, path)
    for _ in range(2):
        got = {r["doc_id"]: r["message"] for r in documents.upsert(second, path).collect()}
        assert got == {"a": "new", "b": "old", "c": "old", "d": "new"}


def test_upsert_changes_all_days_or_none(spark, tmp_path, monkeypatch):
    """Lost while the days are written or before the commit: the old table stays; the next attempt is whole."""
    schema = "doc_id string, timestamp string, anomaly_score double, message string"
    made = lambda text: spark.createDataFrame([(d, f"2024-01-0{d}T00", 0.1, text) for d in "1234"], schema)
    path = str(tmp_path / "docs")
    read = lambda **k: sorted((r["doc_id"], r["message"], r["day"]) for r in snapshots.read(spark, path, schema, **k).collect())
    of = lambda text, days="1234": [(d, text, f"2024-01-0{d}") for d in days]
    assert read() == []
    documents.upsert(made("old"), path)
    for step in ("commit", "folders"):
        with monkeypatch.context() as lost:
            real, calls = getattr(snapshots, step), []

            def fail(*args, **kwargs):
                calls.append(args)
                if step == "commit" or len(calls) > 1:
                    raise RuntimeError("lost")
                return real(*args, **kwargs)

            lost.setattr(snapshots, step, fail)
            with pytest.raises(RuntimeError):
                documents.upsert(made("new"), path)
        assert read() == of("old")
    documents.upsert(made("new").filter("doc_id > '2'"), path)
    assert read() == of("old", "12") + of("new", "34") and read(number=0) == of("old") and read(days=["2024-01-03", "2099-01-01"]) == of("new", "3")
    documents.upsert(made("none").limit(0), path)
    assert snapshots.numbers(spark, path) == [0, 1]
    # The folders of the two lost attempts; then that of the first snapshot is still in use.
    assert snapshots.vacuum(spark, path, keep=1) == 2 and read() == of("old", "12") + of("new", "34")
    with pytest.raises(RuntimeError):
        monkeypatch.setattr(snapshots, "numbers", lambda *a: [0])
        snapshots.commit(spark, path, {})


def send_times(spark, seconds, gap=60, key="HIGH"):
    base = pd.Timestamp("2024-01-01T00:00:00")
    rows = [(key, (base + pd.Timedelta(seconds=float(s))).isoformat(), f"d{i:05d}", 0.5) for i, s in enumerate(seconds)]
    df = spark.createDataFrame(rows, "severity string, timestamp string, doc_id string, anomaly_score_norm double")
    start = int(base.timestamp())
    return sorted(r["second"] - start for r in alerts.cooldown(alerts.candidates(df), seconds=gap).collect())


def greedy(seconds, gap):
    sent = []
    for s in sorted({int(x) for x in seconds}):
        if not sent or s - sent[-1] >= gap:
            sent.append(s)
    return sent


def test_cooldown(spark):
    assert send_times(spark, [0, 30, 59, 60, 100, 121]) == [0, 60, 121]
    assert send_times(spark, [0.5, 60.2, 60.8]) == [0, 60]


@pytest.mark.parametrize("gap", [1, 60, 7000, 86_400])
def test_cooldown_over_days(spark, gap):
    seconds = np.random.default_rng(3).integers(0, 5 * 86_400, 3000)
    seconds = np.concatenate([seconds, np.arange(86_400 - 100, 86_400 + 100, 7), [9 * 86_400, 9 * 86_400 + 59]])
    assert send_times(spark, seconds, gap) == greedy(seconds, gap)


def test_alert_text(spark):
    df = spark.createDataFrame([("HIGH", "", "m" * 500, 0.98765)], "severity string, timestamp string, message string, anomaly_score_norm double")
    lines = one(alerts.alert_text(df))["text"].split("\n")
    assert lines[2:4] == ["Score: 0.9877", "Time: N/A"] and len(lines[4]) == len("Message: ") + 400


# Text helpers, assistant, checks, tables -----------------------------------

def test_escape_and_template(spark):
    df = texts(spark, "<a href=\"x\">'&amp;</a>", "from 10.0.0.1 port 22 at 0xFF")
    rows = df.select(text.escape_html(F.col("message")).alias("e"), text.template(F.col("message")).alias("t")).collect()
    import html

    assert rows[0]["e"] == html.escape("<a href=\"x\">'&amp;</a>")
    assert rows[1]["t"] == "from <ip> port <n> at <hex>"


def test_intent_order(spark):
    asked = texts(spark, "show logs of ssh error trend", "ssh error trend", "SSH errors", "ssh", "overview", "How many", "critical", "x")
    got = column(asked.select("i", severity.intent(F.col("message")).alias("x")).orderBy("i"), "x")
    assert got == ["logs", "trend", "error", "security", "summary", "count", "critical", "general"]
    small = texts(spark, " Hello\n", "hello there", "What's up")
    assert column(small.select("i", severity.is_small_talk(F.col("message")).alias("x")).orderBy("i"), "x") == [True, False, True]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 100])
def test_memory_in_blocks(spark, block):
    rng = np.random.default_rng(block)
    rows = [(c, int(t), f"{c}/{t}") for c in range(4) for t in sorted(rng.choice(40, 15, replace=False))]
    df = spark.createDataFrame(rows, "conv_id int, turn int, text string")
    got = {(r["conv_id"], r["turn"]): r["memory"] for r in assistant.last_n_memory(df, 3, block).collect()}
    for c in range(4):
        mine = [r for r in rows if r[0] == c]
        for at, (_, turn, _) in enumerate(mine):
            assert got[c, turn] == [r[2] for r in mine[max(0, at - 3):at]]


def test_readiness(spark):
    empty = checks.readiness(spark.createDataFrame([], "a string"), "t", ["a", "b"])
    assert {r["name"]: r["ok"] for r in empty.collect()} == {"t not empty": False, "t columns": False, "t newest": False}
    assert one(checks.overall(empty))["ok"] is False


def test_csv_round_trip_keeps_line_breaks_and_literal_na(spark, tmp_path):
    rows = [("t", 'two\nlines, "quoted"', "s", "h", "f", "i", "a"), ("t", "NA", "s", "h", "f", "i", "a")]
    df = spark.createDataFrame(rows, schemas.LOG)
    tables.write_logs(df, str(tmp_path / "logs"), "csv")
    assert sorted(map(tuple, tables.read_logs(spark, str(tmp_path / "logs"), "csv").collect())) == sorted(rows)


def test_scan_of_table_by_day_prunes(spark, tmp_path):
    path = str(tmp_path / "logs")
    days = spark.range(10).withColumn("@timestamp", F.format_string("2024-01-%02dT12:00:00Z", F.col("id") + 1))
    tables.write_logs(scan.with_time(days), path)
    rows = scan.incremental_scan(spark.read.parquet(path), "2024-01-03 12:00:00", "2024-01-05 11:59:59")
    assert sorted(column(rows, "id")) == [2, 3]
    assert len(rows.inputFiles()) > 0
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters: [IsNotNull(ts)" in plan


def test_anomalies_alone_are_written(spark, tmp_path):
    tables.write_anomalies(spark.createDataFrame([(1, -1), (2, 1)], "i int, anomaly int"), str(tmp_path / "a"))
    assert column(spark.read.parquet(str(tmp_path / "a")), "i") == [1]


def test_batches_append_and_repeat(spark, tmp_path):
    path = str(tmp_path / "scored")
    for batch, n in [(0, 3), (1, 4), (1, 2)]:
        tables.write_batch(spark.range(n).withColumn("anomaly", F.lit(-1)), path, batch)
    assert {r["batch_id"]: r["count"] for r in spark.read.parquet(path).groupBy("batch_id").count().collect()} == {0: 3, 1: 2}


# Dirty rows ------------------------------------------------------------------

def test_report_tables_with_nulls(spark):
    rows = spark.createDataFrame([(-1, None, None, 1), (-1, "HIGH", 3, 1), (-1, "HIGH", 3, 2), (1, "LOW", 5, 0)],
                                 "anomaly int, severity string, hour int, day_of_week int")
    share = {r["severity"]: (r["n"], r["pct"]) for r in report.severity_share(rows).collect()}
    assert share["HIGH"] == (2, 100.0) and share["LOW"] == (0, 0.0)
    heat = {r["hour"]: r["anomalies"] for r in report.heatmap(rows).collect()}
    assert len(heat) == 24 and heat[3] == 2 and sum(heat.values()) == 2


def test_memory_keeps_rows_with_nulls_and_ties(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 1, "w"), ("a", None, "n"), (None, 2, "q"), (None, None, "p"), ("a", 250, "z")],
                                 "conv_id string, turn long, text string")
    got = {r["text"]: r["memory"] for r in assistant.last_n_memory(rows, 3, 100).collect()}
    assert got == {"n": [], "w": ["n"], "x": ["n", "w"], "z": ["n", "w", "x"], "p": [], "q": ["p"]}


def test_only_a_missing_table_counts_as_none(spark, tmp_path):
    assert not documents.exists(spark, str(tmp_path / "none"))
    with pytest.raises(Exception):
        documents.exists(spark, "nosuchscheme://somewhere/table")


def test_last_write_wins(spark, tmp_path):
    schema = "doc_id string, timestamp string, anomaly_score double, message string, seq int"
    rows = [("a", "2024-01-01T01", 0.1, "first", 1), ("a", "2024-01-01T01", 0.9, "second", 2)]
    got = documents.upsert(spark.createDataFrame(rows, schema), str(tmp_path / "d"), written="seq").collect()
    assert [r["message"] for r in got] == ["second"]


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    class Elsewhere:
        conf = type("Conf", (), {"get": lambda self, key, default=None: {"spark.master": "yarn"}.get(key, default)})()

    with pytest.raises(ValueError):
        session.shared_dir(Elsewhere())


def test_pages_tell_rows_of_one_time_apart(spark, tmp_path):
    base = pd.Timestamp("2024-01-01").to_pydatetime()
    rows = [(base + pd.Timedelta(seconds=k // 7), k % 7, k) for k in range(40)]
    df = spark.createDataFrame(rows, "ts timestamp, event_id long, n long").repartition(3)
    seen, cursor, state = [], None, str(tmp_path / "state")
    for step in range(20):
        page = scan.next_page(df, scan.load_cursor(spark, state, ("event_id",)), base, base + pd.Timedelta(days=1), 6, ("event_id",))
        cursor = scan.cursor_after(page, ("event_id",))
        if cursor is None:
            break
        seen += column(page, "n")
        scan.save_cursor(spark, state, cursor, ("event_id",), step)
    assert seen == sorted(seen) == list(range(40)) and step == 7


def test_all_pages_at_once(spark):
    """What the pages read one after the other hold, also from a kept cursor on."""
    base = pd.Timestamp("2024-01-01").to_pydatetime()
    rows = [(base + pd.Timedelta(seconds=k // 7), k % 7, k) for k in range(100)] + [(None, 1, 999)]
    df = spark.createDataFrame(rows, "ts timestamp, event_id long, n long").repartition(5)
    end, ids = base + pd.Timedelta(seconds=13), ("event_id",)
    pages = scan.paged(df, base, end, 6, ids)
    assert {r["n"]: r["page"] for r in pages.collect()} == {k: k // 6 for k in range(98)}
    ends = {r["step"]: (r["ts"], r["event_id"], r["rows"]) for r in scan.page_ends(pages, ids).collect()}
    assert ends[0] == (base, 5, 6) and ends[16][2] == 2 and len(ends) == 17
    rest = scan.paged(df, base, end, 6, ids, after=ends[3][:2], first=4)
    assert {r["n"]: r["page"] for r in rest.collect()} == {k: k // 6 for k in range(24, 98)}
    assert scan.paged(df.limit(0), base, end, 6, ids).count() == 0


@pytest.mark.parametrize("limit", [None, 1, 4, 1000])
def test_live_views_show_the_oldest_rows(spark, limit):
    rng = np.random.default_rng(3)
    base = pd.Timestamp("2024-01-01")
    seconds = sorted([*rng.integers(0, 1200, 60).tolist(), *rng.integers(600, 640, 60).tolist(), 0, 15, 300, 300, 300])
    rows = [((base + pd.Timedelta(seconds=int(s))).to_pydatetime(), k) for k, s in enumerate(seconds)] + [(None, 1000)]
    df = spark.createDataFrame(rows, "ts timestamp, event_id long").repartition(3)
    found = scan.recent_windows(df, base.to_pydatetime(), (base + pd.Timedelta(hours=1)).to_pydatetime(), ("event_id",), limit).collect()
    expected = set()
    for end in range(15, 1600, 15):
        inside = [k for k, s in enumerate(seconds) if end - 300 <= s < end]
        expected |= {(k, str(base + pd.Timedelta(seconds=end))) for k in inside[:limit]}
    assert len(found) == len(expected) and {(r["event_id"], str(r["view"])) for r in found} == expected


def test_row_numbers_over_many_parts(spark):
    from emberlog.operators.ranking import with_row_number

    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit(None).cast("int").alias("number")).repartition(9)
    assert {r["k"]: r["place"] for r in with_row_number(df, ("k",), "place").collect()} == {k: k for k in range(1000)}
    assert with_row_number(df.limit(0), ("k",), "place").count() == 0


def test_time_filters_are_pushed_down_and_pruned(spark, tmp_path):
    rows = spark.range(200).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), "id").withColumn("day", F.to_date("ts"))
    rows.write.partitionBy("day").parquet(str(tmp_path / "t"))
    found = scan.incremental_scan(spark.read.parquet(str(tmp_path / "t")), "1970-01-03 00:00:00", "1970-01-03 05:00:00")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThanOrEqual(ts" in plan
    assert found.count() == 6


def test_folding_without_python_equals_folding_with(spark):
    import sys

    codes = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    words = ["".join(map(chr, codes[i:i + 97])) for i in range(0, len(codes), 97)]
    got = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").select("i", folding.fold(F.col("w")).alias("f")).collect()
    assert {r["i"]: r["f"] for r in got} == {i: folding.fold_text(w) for i, w in enumerate(words)}


def test_range_of_training_bounds_the_norm(spark):
    df = spark.createDataFrame([(-3.0,), (0.0,), (1.0,), (9.0,), (None,)], "anomaly_score double")
    got = column(scoring.normalize(df, bounds=(-1.0, 3.0)), "anomaly_score_norm")
    assert got == [1.0, 0.75, 0.5, 0.0, None]


def test_tables_by_day_have_few_files(spark, tmp_path):
    """A file for each day, not one for each day and task."""
    rows = spark.range(600, numPartitions=8).selectExpr(
        "date_add(date'2024-01-01', CAST(id % 30 AS INT)) AS day", "CAST(date_add(date'2024-01-01', CAST(id % 30 AS INT)) AS timestamp) AS ts", "id")
    places = [session.stage(rows, "few-files", by="day").inputFiles()]
    tables.write_logs(rows.drop("day"), str(tmp_path / "logs"))
    places.append(spark.read.parquet(str(tmp_path / "logs")).inputFiles())
    snapshots.write_days(rows, str(tmp_path / "days"), snapshots.days_of(rows))
    places.append(list((tmp_path / "days").rglob("*.parquet")))
    assert [len(files) for files in places] == [30, 30, 30]
    assert spark.read.parquet(str(tmp_path / "logs")).count() == 600


def test_gate_takes_labels_alone(spark, tmp_path, monkeypatch):
    """The gate counts labels; it needs no features and no table of them."""
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(tmp_path / "events.parquet"))
    i = registered.Inputs(spark, str(tmp_path))
    with monkeypatch.context() as without:
        without.setattr(registered.features, "basic_features", None)
        got = registered.validation_gate(i).collect()
    assert got == registry.validation_gate(i.scored).collect() and got[0].ok
