"""Properties of the fitted models, and retrieval against brute force."""

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberlog.operators import clusters, forest, registry, search, tfidf
from emberlog.plans import detector, registered

FOLDER = "/root/testdata/sf0.001"


# Term weights --------------------------------------------------------------

def python_tokens(text, strip_accents=True):
    text = text.lower()
    if strip_accents:
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.findall(r"\b\w\w+\b", text)


CORPUS = ["Éclair éclair ECLAIR", "ﬁne ½ eclair x", "Straße strasse ΆΛΦΑ αλφα", "", None, "aa aa bb", "bb aa_1 가나", "naïve   cafés"]


@pytest.mark.parametrize("strip_accents", [True, False])
def test_tokens(spark, strip_accents):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CORPUS)], "i int, message string")
    got = {r["i"]: r["t"] for r in df.select("i", tfidf.tokens(F.col("message"), strip_accents).alias("t")).collect()}
    assert got == {i: python_tokens(t or "", strip_accents) for i, t in enumerate(CORPUS)}


def test_weights_by_hand(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CORPUS)], "i int, message string")
    vocabulary = tfidf.fit_vocabulary(df, max_terms=3)
    tokens = [python_tokens(t or "") for t in CORPUS]
    tf, rows = Counter(t for x in tokens for t in x), Counter(t for x in tokens for t in set(x))
    best = sorted((t for t in tf if rows[t] >= 2), key=lambda t: (-tf[t], t))[:3]
    assert [r["term"] for r in vocabulary.orderBy("idx").collect()] == sorted(best)
    vectorizer = tfidf.Vectorizer.of(vocabulary)
    for row in vectorizer.add(df).collect():
        counts = Counter(tokens[row["i"]])
        raw = [(1 + math.log(counts[t])) * (math.log((1 + len(CORPUS)) / (1 + rows[t])) + 1) if counts[t] else 0.0 for t in vectorizer.terms]
        norm = math.sqrt(sum(w * w for w in raw)) or 1.0
        assert row["tfidf"] == pytest.approx([w / norm for w in raw])


def test_long_form_equals_vectors(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    vectorizer = tfidf.Vectorizer.of(tfidf.fit_vocabulary(docs, "text"))
    dense = {r["doc_id"]: r["tfidf"] for r in vectorizer.add(docs, "text").select("doc_id", "tfidf").collect()}
    for r in vectorizer.weights(docs, "doc_id", "text").collect():
        assert dense[r["doc_id"]][vectorizer.terms.index(r["term"])] == r["weight"]
        dense[r["doc_id"]][vectorizer.terms.index(r["term"])] = 0.0
    assert not any(any(v) for v in dense.values())


def test_missing_vocabulary_fails(spark, tmp_path):
    with pytest.raises(Exception):
        tfidf.Vectorizer.load(spark, str(tmp_path / "none"))


# Isolation forest ----------------------------------------------------------

@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    rows = np.vstack([rng.normal(size=(3000, 6)), rng.normal(size=(20, 6)) * 0.2 + 9])
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, features array<double>")


def test_forest_finds_planted_outliers_at_any_partitioning(spark, points):
    results = []
    for parts in (1, 7):
        fitted = forest.fit(points.repartition(parts), "id", trees=60)
        scored = fitted.add_score(points.repartition(parts)).select("id", "anomaly_score").orderBy("id").toPandas()
        results.append(scored["anomaly_score"].to_numpy())
    assert np.array_equal(*results)
    score = results[0]
    assert set(np.argsort(score)[:20]) == set(range(3000, 3020))
    assert (score < 0).mean() == pytest.approx(0.02, abs=0.001)
    assert (score + fitted.offset > -1).all() and (score + fitted.offset < 0).all()


def test_forest_sampling_large_input(spark):
    """The thinned branch: every tree has its full sample, no row twice."""
    df = spark.range(20_000).select("id", F.array(F.col("id").cast("double")).alias("features"))
    drawn = forest.draw(df, "id", trees=20, sample=64, seed=1).toPandas()
    assert drawn.groupby("tree").size().eq(64).all() and drawn["tree"].nunique() == 20
    assert not drawn.duplicated(["tree", "key"]).any()
    again = forest.draw(df.repartition(5), "id", trees=20, sample=64, seed=1).toPandas()
    both = [set(zip(d["tree"], d["key"])) for d in (drawn, again)]
    assert both[0] == both[1]


def walk(nodes, tree, row):
    mine = nodes[nodes["tree"] == tree].set_index("node")
    at = 1
    while mine.at[at, "feature"] >= 0:
        at = 2 * at + (row[mine.at[at, "feature"]] > mine.at[at, "threshold"])
    size = mine.at[at, "size"]
    tail = 0 if size <= 1 else 1 if size == 2 else 2 * (math.log(size - 1) + np.euler_gamma) - 2 * (size - 1) / size
    return mine.at[at, "depth"] + tail


def test_score_equals_plain_walk(spark, points, tmp_path):
    fitted = forest.fit(points, "id", trees=10, sample=64)
    sample = points.limit(30).toPandas()
    got = fitted.path_score(np.stack(sample["features"].to_numpy()))
    norm = 2 * (math.log(63) + np.euler_gamma) - 2 * 63 / 64
    for score, row in zip(got, sample["features"]):
        depth = np.mean([walk(fitted.nodes, t, row) for t in range(10)])
        assert score == pytest.approx(-(2 ** (-depth / norm)))
    fitted.save(spark, str(tmp_path / "f"))
    loaded = forest.Forest.load(spark, str(tmp_path / "f"))
    assert np.array_equal(loaded.path_score(np.stack(sample["features"].to_numpy())), got)


def test_forest_rejects_nothing_and_survives_constants(spark, points):
    with pytest.raises(ValueError):
        forest.fit(points.filter("false"), "id")
    flat = spark.range(5).select("id", F.array(F.lit(1.0)).alias("features"))
    fitted = forest.fit(flat, "id", trees=3)
    assert {r["anomaly_score"] for r in fitted.add_score(flat).collect()} == {0.0}


# Detector ------------------------------------------------------------------

@pytest.fixture(scope="module")
def logs(spark):
    return registered.Inputs(spark, FOLDER).logs


def test_retrain_publishes_only_what_passes(spark, logs, tmp_path):
    path, entries = str(tmp_path / "models"), str(tmp_path / "registry")
    assert detector.retrain(logs, path, "20240101_000000", entries, trees=20)
    # Half of all rows under the offset cannot pass the gate.
    assert not detector.retrain(logs, path, "20240102_000000", entries, trees=20, contamination=0.5)
    table = registry.read(spark, entries)
    assert {r["tag"]: r["ok"] for r in table.collect()} == {"20240101_000000": True, "20240102_000000": False}
    model = detector.load_published(spark, entries)
    predicted = model.predict(logs).toPandas()
    assert len(predicted) == 835 and predicted["anomaly_score_norm"].between(0, 1).all()
    assert ((predicted["anomaly"] == -1) == (predicted["anomaly_score"] < 0)).all()
    with pytest.raises(LookupError):
        detector.load_published(spark, entries, "20240102_000000")


def test_rollback_lasts_until_the_next_version(spark, tmp_path):
    path = str(tmp_path / "registry")
    entry = lambda tag, ok=True: spark.createDataFrame([(tag, f"models/{tag}", ok, 0.01, "")], registry.REGISTRY)
    used = lambda: [r["tag"] for r in registry.current(spark, path).collect()]
    assert used() == []
    with pytest.raises(LookupError):
        registry.rollback(spark, path)
    for tag in ("t1", "t2", "t3"):
        registry.publish(entry(tag), path)
    assert used() == ["t3"]
    assert registry.rollback(spark, path) == "t2" and used() == ["t2"] and used() == ["t2"]
    assert registry.rollback(spark, path) == "t1" and used() == ["t1"]
    with pytest.raises(LookupError):
        registry.rollback(spark, path)
    registry.publish(entry("t4", ok=False), path)  # rejected: what is in use stays so
    assert used() == ["t1"]
    with pytest.raises(LookupError):
        registry.rollback(spark, path, "t4")
    registry.publish(entry("t5"), path)
    assert used() == ["t5"] and registry.rollback(spark, path, "t3") == "t3" and used() == ["t3"]
    log = [tuple(r) for r in registry.pointer(spark, path).orderBy("seq").collect()]
    assert log == [(k, a, t) for k, (a, t) in enumerate([
        ("publish", "t1"), ("publish", "t2"), ("publish", "t3"), ("rollback", "t2"), ("rollback", "t1"), ("publish", "t5"), ("rollback", "t3")])]


def test_publishing_again_after_a_lost_pointer(spark, tmp_path, monkeypatch):
    """A driver lost between registry and pointer: the old version stays in use; publishing again takes effect once."""
    path = str(tmp_path / "registry")
    entry = lambda tag, rate: spark.createDataFrame([(tag, f"models/{tag}", True, rate, "")], registry.REGISTRY)
    registry.publish(entry("t1", 0.01), path)
    with monkeypatch.context() as lost:
        lost.setattr(registry, "_point", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            registry.publish(entry("t2", 0.02), path)
    assert registry.current(spark, path).first()["tag"] == "t1"
    registry.publish(entry("t2", 0.03), path)
    assert [(r["tag"], r["rate"]) for r in registry.read(spark, path).orderBy("tag").collect()] == [("t1", 0.01), ("t2", 0.03)]
    assert registry.current(spark, path).first()["tag"] == "t2"


def test_narrow_profile_has_its_own_model(spark, logs):
    model = detector.train(logs, "narrow", trees=10)
    predicted = model.predict(logs)
    assert "severity" not in predicted.columns and "hour" not in predicted.columns
    assert predicted.filter("anomaly_score_norm between 0 and 1").count() == 835


# Clusters ------------------------------------------------------------------

def test_clusters(spark):
    words = ["disk full", "login failed", "cpu hot"]
    rows = [(f"{w} {w} n{i % 2}", "HIGH" if i % 2 else "CRITICAL", f"2024-01-01T00:00:{i:02d}", -1)
            for k, w in enumerate(words) for i in range(4 * (k + 1))]
    df = spark.createDataFrame(rows + [("normal", "INFO", "x", 1)], "message string, severity string, ts string, anomaly int")
    got = clusters.cluster_summaries(df, k=3, restarts=3).orderBy("cluster_id").collect()
    assert [r["size"] for r in got] == [12, 8, 4]
    assert [set(r["top_keywords"][:2]) for r in got] == [{"cpu", "hot"}, {"failed", "login"}, {"disk", "full"}]
    assert got[0]["sample_msgs"] == ["cpu hot cpu hot n0", "cpu hot cpu hot n1", "cpu hot cpu hot n0"]
    # One of each per pair: the tie goes to the first in the alphabet.
    assert {r["dominant_severity"] for r in got} == {"CRITICAL"}
    assert got[2]["summary"].startswith("group 2 of 4 rows about ")


def test_restarts_never_hurt(spark, logs):
    df = logs.withColumn("anomaly", F.lit(-1)).withColumn("severity", F.lit("LOW"))
    def spread(restarts):
        made = clusters.fit_clusters(df, restarts=restarts)
        assert len(made.costs) == restarts
        rows = made.assign(df)
        assert rows.count() == logs.count()
        vectorizer = clusters.temporary_vectorizer(df)
        points = vectorizer.add(rows).select("cluster", "tfidf").toPandas()
        total = 0.0
        for _, group in points.groupby("cluster"):
            matrix = np.stack(group["tfidf"].to_numpy())
            total += ((matrix - matrix.mean(axis=0)) ** 2).sum()
        return total
    assert spread(4) <= spread(1) + 1e-9


def test_saved_centres_assign_as_before(spark, tmp_path):
    texts = ["aa bb", "bb cc cc", None, "", "dd", "aa bb"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "event_id int, message string")
    made = clusters.Clustering(tfidf.Vectorizer(["aa", "bb", "cc", "dd"], [1.0, 1.0, 2.0, 1.5], False),
                               [[0.0] * 4, [0.0] * 4, [0.7, 0.7, 0.0, 0.0], [0.0, 0.1, 0.9, 0.0]], [3.0, 2.5])
    made.save(spark, str(tmp_path / "m"))
    loaded = clusters.Clustering.load(spark, str(tmp_path / "m"))
    assert loaded == made
    got = {r["event_id"]: (r["cluster"], r["message"]) for r in loaded.assign(df).collect()}
    # Rows without a known term are nearest to the first of two equal centres.
    assert got == {0: (2, "aa bb"), 1: (3, "bb cc cc"), 2: (0, ""), 3: (0, ""), 4: (0, "dd"), 5: (2, "aa bb")}
    assert [w[:2] for w in made.keywords()] == [["aa", "bb"], ["aa", "bb"], ["aa", "bb"], ["cc", "bb"]]
    assert loaded.assign(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1])
def test_too_few_to_cluster(spark, n):
    df = spark.createDataFrame([("m", "LOW", "t", -1)] * n, "message string, severity string, ts string, anomaly int")
    assert clusters.cluster_summaries(df).collect() == []


# Search --------------------------------------------------------------------

def brute_force(docs, asked, k):
    fields = [[re.findall(r"\w+", (d[f] or "").lower()) for d in docs] for f in ("message", "severity")]
    out = {}
    for qid, text in asked:
        best = []
        for i, d in enumerate(docs):
            per_field = []
            for lists in fields:
                mean = sum(map(len, lists)) / len(lists)
                total = 0.0
                for term in re.findall(r"\w+", text.lower()):
                    tf, df = lists[i].count(term), sum(term in x for x in lists)
                    idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                    total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(lists[i]) / mean)) if tf else 0.0
                per_field.append(total)
            if max(per_field) > 0:
                best.append((-round(max(per_field), 6), d["doc_id"]))
        out[qid] = [x for _, x in sorted(best)[:k]]
    return out


@pytest.mark.parametrize("bits", [1, 8])
def test_search_against_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(search, "BLOCK_BITS", bits)
    rng = np.random.default_rng(2)
    words = ["disk", "full", "login", "failed", "error", "high", "root", "user"]
    docs = [{"doc_id": f"d{i:03d}", "message": " ".join(rng.choice(words, rng.integers(0, 9))), "severity": str(rng.choice(["HIGH", "LOW"]))}
            for i in range(150)] + [{"doc_id": f"e{i:03d}", "message": "same same error", "severity": "HIGH"} for i in range(60)]
    asked = [("a", "disk error error"), ("b", "HIGH login"), ("c", "same"), ("d", "nothing here"), ("e", "")]
    table = spark.createDataFrame(docs, "doc_id string, message string, severity string").repartition(5)
    questions = spark.createDataFrame(asked, "qid string, text string")
    options = dict(keep=("doc_id",), tie_break=("doc_id",))
    found = search.search(table, questions, "qid", "text", **options)
    expected = brute_force(docs, asked, 10)
    got = {}
    for r in found.orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["doc_id"])
    assert got == {q: ids for q, ids in expected.items() if ids}
    filled = search.with_fallback(found, questions, table, "qid", **options).orderBy("qid", "rank").toPandas()
    assert filled[filled["qid"] == "d"]["doc_id"].tolist() == [f"d{i:03d}" for i in range(5)]
    assert set(filled["qid"]) == set("abcde")


def test_search_keeps_ties_and_repeated_rows(spark):
    docs = [(f"d{i:02d}", t) for i, t in enumerate(["a b", "a b", "b", None, "", "a a a", "c"] * 4)] + [("d00", "a b"), ("d00", "a b")]
    table = spark.createDataFrame(docs, "doc_id string, message string").repartition(4)
    asked = spark.createDataFrame([(1, "a"), (2, "A b b"), (3, None), (4, "zzz"), (5, "c c")], "qid int, text string")
    found = search.search(table, asked, "qid", "text", fields=("message",), keep=("doc_id", "message"), tie_break=("doc_id",), k=7).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r["qid"], r["rank"])):
        by.setdefault(r["qid"], []).append(r["doc_id"])
    assert set(by) == {1, 2, 5} and by[5] == ["d06", "d13", "d20", "d27"]
    assert by[1] == ["d05", "d12", "d19", "d26", "d00", "d00", "d00"] and by[2] == ["d00", "d00", "d00", "d01", "d07", "d08", "d14"]
    assert search.search(table.limit(0), asked, "qid", "text", fields=("message",), keep=("doc_id",), tie_break=("doc_id",)).count() == 0
    assert search.search(table, asked.limit(0), "qid", "text", fields=("message",), keep=("doc_id",), tie_break=("doc_id",)).count() == 0


def test_search_keeps_no_pairs(spark, monkeypatch):
    """What is kept grows with the documents and the questions, not with their product; copies are compared once."""
    kept, keep = {}, search.stage
    monkeypatch.setattr(search, "stage", lambda df, name, *more: kept.setdefault(name, keep(df, name, *more)))
    words = ["disk", "full", "login", "failed", "error", "high", "root", "user"]
    docs = [(n, f"{words[n % 8]} {words[n // 8 % 8]} {words[n // 64 % 8]} same") for n in range(1024)]
    table = spark.createDataFrame(docs, "doc_id int, message string").repartition(5)
    asked = spark.createDataFrame([(n, f"same {words[n % 8]}") for n in range(200)], "qid int, text string")
    found = search.search(table, asked, "qid", "text", fields=("message",), keep=("doc_id",), tie_break=("doc_id",)).collect()
    assert len(found) == 2000 and {r["doc_id"] for r in found if r["qid"] == 0 and r["rank"] <= 2} == {0, 512}
    assert max(df.count() for df in kept.values()) <= 1024
    assert kept["search-found"].count() == 8 * 10


@pytest.mark.parametrize("short, few", [(200, 100), (1, 2)])
def test_search_keeps_nothing_by_questions_and_blocks(spark, monkeypatch, short, few):
    """However many blocks there are, a question keeps its best so far, and blocks are not copied for each other."""
    rng, words = np.random.default_rng(5), [f"w{n}" for n in range(40)]
    docs = [(n, " ".join(rng.choice(words, rng.integers(1, 12), p=np.arange(40, 0, -1) / 820)), str(rng.choice(["w0", "w1"]))) for n in range(600)]
    table = spark.createDataFrame(docs, "doc_id int, message string, severity string").repartition(2)
    asked = spark.createDataFrame([(n, " ".join(rng.choice(words, rng.integers(1, 8)))) for n in range(60)], "qid int, text string")
    options = dict(keep=("doc_id",), tie_break=("doc_id",), k=5)
    expected = search.search(table, asked, "qid", "text", **options).collect()
    kept, keep = {}, search.stage
    monkeypatch.setattr(search, "stage", lambda df, name, *more: kept.setdefault(name, keep(df, name, *more)))
    monkeypatch.setattr(search, "BLOCK_BITS", 5)
    monkeypatch.setattr(search, "ASKED", 16)
    for name, value in {"TOGETHER": 64, "SHORT": short, "FEW": few}.items():
        monkeypatch.setattr(search, name, value, raising=False)
    found = search.search(table, asked, "qid", "text", **options).collect()
    assert sorted(found) == sorted(expected) and len(found) > 250
    assert kept["search-found"].count() <= 2 * 60 * 4 * 5
    wanted = brute_force([{"doc_id": d, "message": m, "severity": s} for d, m, s in docs], [(r["qid"], r["text"]) for r in asked.collect()[:20]], 5)
    for qid, ids in wanted.items():
        assert [r["doc_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["qid"] == qid] == ids


def test_messages_of_one_point_are_clustered_once(spark, monkeypatch):
    """Ids beyond the vocabulary make no points; the same vocabulary without a model, and nothing is filtered by distances."""
    kept, keep = {}, clusters.stage
    monkeypatch.setattr(clusters, "stage", lambda df, name, *more: kept.setdefault(name, keep(df, name, *more)))
    texts = ["disk full on worker", "login failed for user", "service error status"]
    rows = [(f"{texts[n % 3]} x{n}", -1, "HIGH") for n in range(300)]
    table = spark.createDataFrame(rows, "message string, anomaly int, severity string")
    vectorizer = tfidf.Vectorizer.of(tfidf.fit_vocabulary(table, min_df=2))
    made = clusters.fit_clusters(table, vectorizer, k=3, restarts=2)
    assert kept["cluster-points"].count() == 3 and len(made.centres) == 3 and min(made.costs) < 1e-9
    i = registered.Inputs(spark, "/root/testdata/sf0.001")
    assert i.log_vectorizer == i.model.vectorizer


def test_training_rows_of_equal_features_are_scored_once(spark):
    rows = [(n, [float(n % 5), float(n % 3)]) for n in range(600)]
    fitted = forest.fit(spark.createDataFrame(rows, "id int, features array<double>"), "id", trees=10, sample=32)
    scores = fitted.training_scores().toPandas()
    assert len(scores) <= 15 and scores["n"].sum() == 600
    whole = np.repeat(fitted.path_score(np.array([r[1] for r in rows[:15]])), 40)
    assert abs(np.quantile(whole, 0.02) - fitted.offset) < 1e-12
