"""Streams give what the same rows give in one batch."""

import shutil

import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberlog.operators import clean, documents
from emberlog.plans import detector, registered
from emberlog.sources.event_logs import source_documents
from emberlog.streaming import cooldown, pipeline, windows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Source documents in three files, in order of time."""
    path = str(tmp_path_factory.mktemp("sources"))
    sources = source_documents(spark.read.parquet(f"{FOLDER}/events.parquet"))
    for n in range(3):
        sources.filter((F.col("event_id") * 3 / 1000).cast("int") == n).coalesce(1).write.mode("append").parquet(path)
    return path, sources.schema


def stream(spark, parts):
    path, schema = parts
    return pipeline.read_stream(spark, path, schema, "parquet", files_per_batch=1)


def batches_of(query):
    query.awaitTermination()
    assert query.exception() is None


def test_pipeline_over_several_batches(spark, parts, tmp_path):
    model = detector.train(registered.Inputs(spark, FOLDER).logs, trees=20)
    out = str(tmp_path)
    batches_of(pipeline.start_pipeline(stream(spark, parts), model, out, f"{out}/checkpoint", availableNow=True))
    scored = spark.read.parquet(f"{out}/scored")
    assert scored.select("batch_id").distinct().count() == 3
    docs = documents.read(spark, f"{out}/documents").toPandas()
    assert len(docs) > 0 and docs["doc_id"].is_unique
    # Exactly the keyable anomalies of the scored batches are there.
    keyed = scored.filter("anomaly = -1 AND try_to_timestamp(`@timestamp`) IS NOT NULL").select("@timestamp", "message").distinct()
    assert keyed.count() == len(docs)
    rows = scored.count()
    sent = spark.read.parquet(f"{out}/alerts").toPandas().sort_values(["severity", "second"])
    assert len(sent) > 0
    gaps = sent.groupby("severity")["second"].diff().dropna()
    assert (gaps >= 60).all()
    # A repeated batch leaves everything as it is.
    first = spark.read.schema(parts[1]).parquet(parts[0]).filter("event_id * 3 / 1000 >= 2")
    pipeline.process_batch(first, 2, model, out)
    assert documents.read(spark, f"{out}/documents").count() == len(docs)
    assert spark.read.parquet(f"{out}/scored").count() == rows


class Lost(Exception):
    pass


def failing(call, lose):
    """``call``, which raises once, before it does anything or after it is done."""
    left = [True]

    def attempt(*args, **kwargs):
        if left and lose == "before":
            left.pop()
            raise Lost
        done = call(*args, **kwargs)
        if left:
            left.pop()
            raise Lost
        return done

    return attempt


def state(spark, out):
    """All that a batch leaves, as comparable rows."""
    tables = {name: spark.read.parquet(f"{out}/{name}") for name in ("scored", "alerts", "last_sent", "top")}
    tables["documents"] = documents.read(spark, f"{out}/documents")
    return {name: sorted(map(str, df.select(*sorted(df.columns)).collect())) for name, df in tables.items()}


def test_half_written_batches_are_repeated(spark, parts, tmp_path, monkeypatch):
    """Whatever write a batch is lost before or after, repeating it leaves what an undisturbed run does."""
    from emberlog.sources import snapshots

    model = registered.Inputs(spark, FOLDER).stand_in(live=True)
    rows = spark.read.schema(parts[1]).parquet(parts[0])
    batches = [rows.filter(F.col("event_id") % 2 == k) for k in (0, 1)]
    pipeline.process_batch(batches[0], 0, model, str(tmp_path / "whole"), live=True)
    shutil.copytree(tmp_path / "whole", tmp_path / "first")
    pipeline.process_batch(batches[1], 1, model, str(tmp_path / "whole"), live=True)
    expected = state(spark, str(tmp_path / "whole"))
    assert all(expected.values())
    places = [(pipeline, "write_batch"), (snapshots, "commit"), (pipeline, "_put"), (pipeline, "_carry_over")]
    for module, name in places:
        for lose in ("before", "after"):
            out = str(tmp_path / f"{name}-{lose}")
            shutil.copytree(tmp_path / "first", out)
            with monkeypatch.context() as lost:
                lost.setattr(module, name, failing(getattr(module, name), lose))
                with pytest.raises(Lost):
                    pipeline.process_batch(batches[1], 1, model, out, live=True)
            pipeline.process_batch(batches[1], 1, model, out, live=True)
            assert state(spark, out) == expected, (name, lose)


def test_empty_batch_does_nothing(spark, parts, tmp_path):
    nothing = spark.createDataFrame([], parts[1])
    pipeline.process_batch(nothing, 0, None, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_tumbling_counts_over_batches(spark, parts, tmp_path):
    counts = windows.tumbling_counts(clean.flatten(stream(spark, parts)), "31 days")
    out = str(tmp_path)
    batches_of(windows.write_changes(counts, f"{out}/counts", f"{out}/checkpoint", availableNow=True))
    got = windows.latest(spark.read.parquet(f"{out}/counts"), "cycle").toPandas()
    path, schema = parts
    flat = clean.flatten(spark.read.schema(schema).parquet(path)).toPandas()
    ts = pd.to_datetime(flat["@timestamp"], errors="coerce", utc=True, format="ISO8601").dropna().dt.floor("5min").dt.tz_localize(None)
    assert dict(zip(got["cycle"], got["n"])) == ts.value_counts().to_dict()


def test_documents_derived_on_the_stream(spark, tmp_path):
    """Log documents can be made from a stream of events as from a table."""
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    made = source_documents(spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(FOLDER))
    query = (clean.flatten(made).writeStream.option("checkpointLocation", str(tmp_path / "c"))
             .trigger(availableNow=True).format("parquet").start(str(tmp_path / "out")))
    batches_of(query)
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = clean.flatten(source_documents(events))
    assert got.count() == 851
    assert got.select(*batch.columns).exceptAll(batch).count() == 0


def test_live_panes_and_late_rows(spark, tmp_path):
    """With no delay allowed, rows older than the mark are not counted.

    The mark a batch is filtered by is the one known when the batch before it
    began, hence the batch in between.
    """
    for stamps in [["2024-01-01T00:10:00"], ["2024-01-01T00:10:01"], ["2024-01-01T00:00:00", "2024-01-01T00:10:02"]]:
        spark.createDataFrame([(s,) for s in stamps], "`@timestamp` string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    rows = spark.readStream.schema("`@timestamp` string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = str(tmp_path)
    view = windows.live_panes(rows, "0 seconds", "5 minutes")
    batches_of(windows.write_changes(view, f"{out}/view", f"{out}/checkpoint", availableNow=True))
    got = windows.latest(spark.read.parquet(f"{out}/view"), "pane").collect()
    assert [(str(r["pane"]), r["n"]) for r in got] == [("2024-01-01 00:10:00", 3)]


def test_repeats_are_dropped_across_batches(spark, tmp_path):
    for rows in ([("2024-01-01T00:00:00", "a")], [("2024-01-01T00:00:00", "a"), ("2024-01-01T00:00:00", "b")]):
        spark.createDataFrame(rows, "`@timestamp` string, message string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    rows = spark.readStream.schema("`@timestamp` string, message string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = (windows.drop_repeats(rows).writeStream.option("checkpointLocation", str(tmp_path / "c"))
             .trigger(availableNow=True).format("parquet").start(str(tmp_path / "out")))
    batches_of(query)
    assert sorted(r["message"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_stateful_cooldown_carries_over_batches(spark, tmp_path):
    """Second batch falls into the first one's cooldown; a last row closes all windows."""
    base = pd.Timestamp("2024-01-01")
    schema = "severity string, ts timestamp, timestamp string, doc_id string, message string, anomaly_score_norm double"
    for n, seconds in enumerate([[0, 0.4, 30], [59, 60, 100], [121, 5000]]):
        rows = [("HIGH", (base + pd.Timedelta(seconds=s)).to_pydatetime(), str(s), f"d{s}", "m", 0.5 + (s == 0.4)) for s in seconds]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (cooldown.stream_cooldown(docs, "1 second").writeStream.outputMode("append")
             .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
             .format("parquet").start(str(tmp_path / "out")))
    batches_of(query)
    sent = spark.read.parquet(str(tmp_path / "out")).orderBy("second").collect()
    assert [r["second"] - int(base.timestamp()) for r in sent] == [0, 60, 121]
    assert sent[0]["doc_id"] == "d0.4"


def test_cooldown_state_has_no_more_parts_than_tasks(spark, tmp_path):
    """However many partitions a shuffle has; those of state cost each batch the same, full or empty."""
    base, schema = pd.Timestamp("2024-01-01"), "severity string, ts timestamp, timestamp string, doc_id string, message string, anomaly_score_norm double"
    batches = [range(0, 300, 7), range(301, 500, 3), [5000]]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        for seconds in batches:
            rows = [("HIGH", (base + pd.Timedelta(seconds=s)).to_pydatetime(), str(s), f"d{s}", "m", 0.5) for s in seconds]
            spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
            docs = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            batches_of(cooldown.start_cooldown(docs, str(tmp_path / "out"), str(tmp_path / "c"), availableNow=True))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    sent = sorted(r["second"] - int(base.timestamp()) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    expected = []
    for s in sorted({*batches[0], *batches[1]}):
        if not expected or s - expected[-1] >= 60:
            expected.append(s)
    assert sent == expected
    for operator in (tmp_path / "c" / "state").iterdir():
        assert 0 < sum(p.name.isdigit() for p in operator.iterdir()) <= 8


def test_monitoring_keeps_the_first_of_equal_rows(spark, tmp_path):
    """Rows alike but for their id and value, the later ids first in the file: the loop keeps those one run keeps."""
    events = spark.read.parquet(f"{FOLDER}/events.parquet").withColumn("value", F.col("event_id") + 1000.0)
    # A shift that changes neither stamp nor message of a failed login.
    later = events.withColumns({"event_id": F.col("event_id") + 60_000 * 97 * 89, "value": F.lit(0.0)})
    later.unionByName(events).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    i = registered.Inputs(spark, str(tmp_path))
    got, wanted = registered.stream_upsert(i), registered.anomaly_docs(i)
    assert wanted.count() > 5
    assert got.select(*wanted.columns).exceptAll(wanted).isEmpty() and wanted.exceptAll(got.select(*wanted.columns)).isEmpty()
