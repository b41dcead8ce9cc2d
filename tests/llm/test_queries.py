"""Every registered query against plain code over the same whole table."""

from collections import Counter

import brute
import numpy as np
import pytest
from compare import connect, differences

import __spark_entry__ as contract
import corpus_pipeline
from emberlog.llm import language, lines, packing, phrases, queries, tokens

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.fixture(scope="module")
def documents(con):
    return con.execute("SELECT doc_id, text, lang FROM documents ORDER BY doc_id").df()


@pytest.fixture(scope="module")
def texts(documents):
    return list(zip(documents.doc_id.tolist(), documents.text.tolist()))


def run(spark, name):
    return queries.queries()[name](spark, FOLDER).toPandas()


def test_all_operators_are_registered():
    found = contract.queries()
    assert [n for n in range(1, 14) if sum(k.startswith(f"op{n}_") for k in found) != 1] == []
    assert "pipeline" in found and [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "near_dedup", "decontamination", "packing"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, con, name):
    assert differences(run(spark, name), con.execute(queries.oracle_sql()[name]).df()) == []


def test_minhash(spark, texts):
    expected = brute.groups(texts, 4, 80)
    found = run(spark, "op1_minhash")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.itertuples()} == expected
    assert (found.kept == (found.doc_id == found.component_id)).all() and not found.kept.all()


def test_sharding(spark, texts):
    found = run(spark, "op2_sharding").sort_values(["shard", "slot"])
    known = dict(texts)
    assert sorted(found.doc_id) == sorted(known)
    assert all(r.size == len(known[r.doc_id].encode()) + 1 and r.text_crc32 == brute.crc(known[r.doc_id]) for r in found.itertuples(index=False))
    assert found.doc_id.is_monotonic_increasing  # contiguous
    assert all(g.slot.tolist() == list(range(len(g))) for _, g in found.groupby("shard"))
    totals = found.groupby("shard")["size"].sum()
    assert len(totals) == 8 and totals.max() - totals.min() <= 2 * found["size"].max()
    assert found.grown_shard.isna().all() and set(found.law) == {"bytes"}


def test_token_counts(spark, texts):
    import tiktoken
    import base64
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.VOCABULARY, "rb"))}
    encoder = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sizes = np.array([len(encoder.encode_ordinary(t)) for _, t in texts])
    found = run(spark, "op4_token_counts")
    assert sorted(found.context_limit) == sorted(set(sizes))
    for r in found.itertuples():
        fits = sizes <= r.context_limit
        assert (r.documents, r.within, r.over) == ((sizes == r.context_limit).sum(), fits.sum(), (~fits).sum())
        assert (r.tokens_within, r.tokens_truncated, r.tokens) == (
            sizes[fits].sum(), np.minimum(sizes, r.context_limit).sum(), sizes.sum())
        assert r.share == fits.mean()


def test_language(spark, documents):
    found = run(spark, "op6_language_id").merge(documents, on="doc_id")
    assert len(found) == len(documents)
    assert (found.held_out == [brute.crc(str(i)) % 5 == 0 for i in found.doc_id]).all()
    unseen = found[found.held_out]
    assert (unseen.lang_pred == unseen.lang).mean() > 0.97
    assert found.score.between(0, 1).all() and set(found.lang_pred) <= set(documents.lang)


def test_language_model_beats_word_frequencies(spark, texts):
    found = run(spark, "op7_lm_scoring").set_index("doc_id")
    words = {i: t.lower().split() for i, t in texts}
    assert all(found.n_words[i] == len(w) for i, w in words.items())
    counts = Counter(w for said in words.values() for w in said)
    n = sum(counts.values())
    assert found.pseudo_log_likelihood.sum() / n > sum(c * np.log(c / n) for c in counts.values()) / n


def test_packing(spark, texts):
    found = run(spark, "op8_packing")
    check_packing(found, dict(texts))
    # Block by block what plain best fit gives: the same bins with the same contents.
    for _, rows in found.groupby(found.bin // (1 << 24)):
        bins = rows.groupby("bin").agg(held=("n_tokens", lambda x: sorted(x)), capacity=("capacity", "first"))
        cost, contents = brute.packed(rows.n_tokens.tolist(), packing.CAPACITIES, packing.OVERHEAD)
        assert cost == (bins.capacity + packing.OVERHEAD).sum()
        assert sorted(bins.held.tolist()) == sorted(sorted(c) for c in contents)


def check_packing(found, known):
    from emberlog.llm import packing

    for i, part in found.sort_values("piece").groupby("doc_id"):
        assert part.n_tokens.sum() == len((known[i] or "").encode().split()) + 1
        assert part.start.tolist() == [0, *part.n_tokens.cumsum().tolist()][:-1]
    assert set(found.doc_id) == set(known)
    for _, part in found.sort_values("bin_offset").groupby("bin"):
        assert part.bin_offset.tolist() == [0, *part.n_tokens.cumsum().tolist()][:-1]
        assert (part.bin_tokens == part.n_tokens.sum()).all()
        assert (part.capacity == packing.fitting(part.n_tokens.sum(), packing.CAPACITIES)).all()
    bins = found.drop_duplicates("bin")
    assert bins.bin_tokens.sum() / bins.capacity.sum() > 0.93


def test_line_dedup(spark, texts):
    expected = brute.dropped_lines(texts, lines.LEAST_WORDS)
    found = run(spark, "op9_line_dedup")
    assert {r.doc_id: r.dropped_lines for r in found.itertuples()} == {i: ",".join(map(str, d)) for i, d in expected.items()}
    assert all(r.n_lines == len(dict(texts)[r.doc_id].split("\n")) for r in found.itertuples())


def test_phrase_fingerprints(spark, texts):
    expected = brute.edited(texts)
    found = run(spark, "op10_phrase_fingerprint").set_index("doc_id")
    known = dict(texts)
    assert set(found.index) == set(known)
    for i, (n, sha, _) in expected.items():
        assert (found.n_chars[i], found.edited_sha256[i]) == (n, sha)
    marks = {i: phrases.sketch(brute.phrase_set(t)) for i, t in texts}
    for i in known:
        assert found.fingerprint[i] == phrases.as_text(marks[i])
        following = known[expected[i][2]]
        changed = phrases.fingerprint(phrases.edited(known[i], following))
        assert found.edited_fingerprint[i] == phrases.as_text(changed)
        assert found.near_edited[i] == phrases.likeness(marks[i], changed)
        assert found.near_next[i] == phrases.likeness(marks[i], marks[expected[i][2]])
    assert (found.near_edited > found.near_next).mean() > 0.95


def test_pipeline_stages(spark, documents):
    """Each stage on its own input, against plain code."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, known = docs.columns, None
    for name, apply in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        after = corpus_pipeline.stage(apply(spark, docs, FOLDER), f"test_{name}")
        if name != "packing":
            assert after.columns == columns and after.schema == docs.schema
            known = {r.doc_id: r.text for r in after.collect()}
            assert set(known) <= {i for i, _ in before}
        if name == "language_id":
            assert len(known) > 0.97 * len(before) and all(known[i] == t for i, t in before if i in known)
        if name == "line_dedup":
            gone = brute.dropped_lines(before, lines.LEAST_WORDS)
            for i, text in before:
                left = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in set(gone[i]))
                assert known.get(i) == (left if left.strip() or not gone[i] else None)
        if name == "near_dedup":
            expected = brute.groups(before, 5, 80)
            assert set(known) == {i for i, (_, c) in expected.items() if c == i}
        if name == "decontamination":
            con = connect(FOLDER)
            con.execute("CREATE OR REPLACE TEMP TABLE documents AS SELECT * FROM (VALUES " + ",".join(["(?, ?)"] * len(before)) + ") t(doc_id, text)",
                        [v for row in before for v in row])
            hit = {r[0] for r in con.execute(queries.DECONTAMINATION_SQL).fetchall()}
            assert set(known) == {i for i, _ in before} - hit
        if name == "packing":
            check_packing(after.toPandas(), dict(before))
        docs = after


def test_language_dictionaries_are_bounded(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language.fit(docs)
    assert sorted(model.dictionaries) == ["de", "en", "es", "fr"]
    assert all(len(d) <= language.DICTIONARY_BYTES for d in model.dictionaries.values())
