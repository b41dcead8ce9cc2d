"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing column names."""

import hashlib
import io
import random
import time
import zlib
from itertools import combinations

import brute
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from emberlog.llm import decontaminate, language, lines, minhash, packing, phrases, scoring, sharding, tokens, warc
from emberlog.llm.common import components
from emberlog.session import shared_dir, stage

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alder", "birch", "cedar", "dogwood", "elm", "fir", "gorse", "hazel", "ivy", "juniper", "larch", "maple", "oak", "pine"]


def prose(seed, n):
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + str(pick.randrange(40)) for _ in range(n))


LONG = prose(1, 30_000)
DIRTY = [
    (1, None, None, None, None), (None, prose(2, 60), "en", None, 5), (2, "", "en", "a", 0), (3, "   \n\t ", "de", "a", 6),
    (4, prose(3, 60), "en", "a", 1), (4, prose(3, 60), "en", "a", 1), (5, prose(3, 60), "en", "b", 1), (6, LONG, "en", "b", 1),
    (7, "x", "de", "b", 1), (None, None, None, None, None), (8, prose(4, 30) + "\n\n" + prose(4, 30), "en", "a", 1),
    (9, "ÄÖ é 😀 ende", "de", "c", 1), (None, prose(2, 60), "en", None, 5),
]


@pytest.fixture(scope="module")
def dirty(spark):
    return stage(spark.createDataFrame(DIRTY, DOCS).repartition(3), "dirty")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """Extra columns with names the operators use themselves."""
    for name in ("id", "key", "part", "row", "size", "h", "cls", "shard", "slot", "n_tokens", "score", "_key", "_gone", "_part",
                 "fingerprint", "lang_pred", "n_words", "component_id", "kept", "dropped_lines", "_prediction"):
        df = df.withColumn(name, F.lit("mine"))
    return df


OPERATORS = {
    "minhash": minhash.near_duplicates,
    "sharding": lambda d: sharding.shard_by_bytes(d, 3),
    "tokens": lambda d: tokens.context_table(tokens.histogram(tokens.with_lengths(d))),
    "language": lambda d: language.predict(d, language.fit(d)),
    "scoring": lambda d: scoring.score(d, scoring.train(d, scoring.vocabulary(d)), scoring.vocabulary(d)),
    "packing": packing.pack,
    "lines": lines.deduplicate,
    "phrases": phrases.compare_with_next,
    "fingerprints": phrases.fingerprints,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(nothing, name):
    assert OPERATORS[name](nothing).count() == 0


@pytest.mark.parametrize("name", [n for n in OPERATORS if n != "tokens"])
def test_dirty_rows_with_clashing_names(dirty, name):
    found = OPERATORS[name](clashing(dirty))
    rows = found.collect()
    assert len(rows) >= len(DIRTY) and (name == "packing" or len(rows) == len(DIRTY))


def test_minhash_dirty(dirty):
    found = [tuple(r) for r in minhash.near_duplicates(dirty).collect()]
    by_id = {r[0]: r[1:] for r in found if r[0] is not None}
    for i in (1, 2, 3):
        assert by_id[i] == (0, i, True)
    assert by_id[4][1:] == (4, True) and by_id[5][1:] == (4, False)
    assert sorted((r for r in found if r[0] is None), key=str) == [(None, 0, None, True), (None, 56, None, True), (None, 56, None, True)]


def test_minhash_links_of_a_family(spark):
    """Copies with few and many edits, a hub, and texts that share a long passage."""
    pick, passage, rows = random.Random(9), prose(50, 60).split(), []
    for family in range(6):
        base = prose(100 + family, 150).split()
        for _ in range(40):
            words = list(base)
            for _ in range(pick.randrange(0, 9)):
                words[pick.randrange(len(words))] = f"new{pick.randrange(10 ** 9)}"
            rows.append((pick.randrange(10 ** 6) * 1000 + len(rows), " ".join(words)))
    rows += [(10 ** 10 + k, " ".join(passage + prose(900 + k, 40).split())) for k in range(80)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute.groups(rows, 5, 80)


def test_minhash_of_a_large_family_of_templated_texts(spark):
    """5,000 texts that fall just short of the threshold with one another: done in seconds, nothing linked."""
    template = prose(77, 136).split()
    rows = []
    for k in range(5000):
        pick = random.Random(k)
        at = pick.randrange(10, 126)
        rows.append((k, " ".join(template[:at] + [f"own{k}x{j}" for j in range(14)] + template[at:])))
    rows += [(10_000, rows[3][1]), (10_001, rows[4][1] + " tail")]
    began = time.monotonic()
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert time.monotonic() - began < 150
    expected = {k: k for k in range(5000)} | {10_000: 3, 10_001: 4}
    sets = [brute.shingles(rows[k][1], 5) for k in (0, 1, 2, 5, 6)]
    assert all(100 * len(a & b) < 80 * len(a | b) for a, b in combinations(sets, 2)) and found == expected


@pytest.mark.parametrize("kinds", [3, 12, 60])
def test_minhash_of_templates_with_repeated_fields(spark, kinds):
    """Fields drawn from a few values, so that nothing in a text is its own; pairs lie around the threshold."""
    pick = random.Random(kinds)
    template = prose(5, 60).split()
    fields = [[f"f{i}v{v}a f{i}v{v}b f{i}v{v}c" for v in range(kinds)] for i in range(3)]
    rows = []
    for k in range(160):
        words = list(template)
        for i in range(pick.choice([1, 2, 3])):
            words.insert(20 * i + 5, pick.choice(fields[i]))
        rows.append((k, " ".join(words)))
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute.groups(rows, 5, 80)


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_pairs_across_components_lose_none(spark, percent):
    """The prefix join by itself finds every similar pair, whatever the sizes of the sets."""
    pick = random.Random(percent)
    sets = {}
    for k in range(120):
        base = set(pick.sample(range(400), pick.randrange(1, 40))) if k % 4 == 0 else set(sets[pick.randrange(k // 4 * 4, k) // 4 * 4])
        for _ in range(pick.randrange(0, 8)):
            base ^= {pick.randrange(400)}
        sets[k] = base or {1}
    rows = [(bytes([k]), bytes([k]), len(s), h) for k, s in sets.items() for h in s]
    found = minhash._across(spark.createDataFrame(rows, "cls binary, component binary, n long, h long").repartition(3), percent)
    pairs = {(r.a[0], r.b[0]) for r in found.collect()}
    similar = {(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    assert similar <= pairs and len(similar) > 5


@pytest.mark.parametrize("bound", [0, 10 ** 6])
def test_minhash_looks_texts_up_by_join_or_broadcast(spark, dirty, monkeypatch, bound):
    monkeypatch.setattr(minhash, "BROADCAST_IDS", bound)
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(dirty).collect() if r.doc_id is not None}
    assert found == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 9}


def test_components(spark):
    links = [(1, 2), (2, 3), (7, 3), (9, 8), (5, 5), (10, 11), (11, 12), (12, 10), (None, 4)] + [(k, k + 1) for k in range(100, 160)]
    found = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {**dict.fromkeys([1, 2, 3, 7], 1), 8: 8, 9: 8, 10: 10, 11: 10, 12: 10, **dict.fromkeys(range(100, 161), 100)}


def test_sharding_dirty(dirty):
    found = sharding.shard_by_bytes(dirty, 3).orderBy("shard", "slot").collect()
    ids = [r.doc_id for r in found]
    assert ids[:3] == [None] * 3 and ids[3:] == sorted(i for i, *_ in DIRTY if i is not None)
    assert [(r.size, r.text_crc32) for r in found if r.doc_id in (1, 2)] == [(1, None), (1, 0)]
    for shard in range(3):
        assert [r.slot for r in found if r.shard == shard] == list(range(sum(r.shard == shard for r in found)))


def test_sharding_of_repeated_rows_is_balanced(spark):
    rows = spark.range(900).select(F.when(F.col("id") < 300, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("abc").alias("text"))
    sizes = {r.shard: r["count"] for r in sharding.shard_by_bytes(rows, 9).groupBy("shard").count().collect()}
    assert sizes == dict.fromkeys(range(9), 100)


def test_written_shards_read_back(spark, dirty):
    path = f"{shared_dir(spark)}/shards-{random.randrange(10 ** 9)}"
    sharding.write_shards(sharding.shard_by_bytes(dirty, 3), path)
    back = spark.read.parquet(path)
    assert sorted(map(str, (r.text for r in back.collect()))) == sorted(str(r[1]) for r in DIRTY)


def test_seeds_lose_no_window():
    """Every window with the substitutions it may have is hit by a mask."""
    for length, errors in ((13, 2), (12, 1), (11, 1), (10, 0), (9, 0)):
        for wrong in combinations(range(length), errors):
            assert any(not set(wrong) & {at + i for i in mask} for mask in decontaminate.MASKS for at in range(length - max(mask)))


def test_decontamination_dirty(spark, dirty):
    items = spark.createDataFrame(
        [(1, prose(3, 20)), (2, None), (3, "!!"), (None, prose(3, 60)), (4, "ÄÖ é ende"), (5, "x"), (6, " ".join(LONG.split()[500:560])),
         (7, "completely absent words here")], "item_id long, text string").withColumn("id", F.lit(1)).withColumn("start", F.lit(1))
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(clashing(dirty), items).collect()}
    assert found == {(4, 1), (5, 1), (9, 4), (7, 5), (6, 6)}
    assert decontaminate.contaminated(dirty.limit(0), items).count() == decontaminate.contaminated(dirty, items.limit(0)).count() == 0


def test_short_items_need_the_whole_document(spark, monkeypatch):
    """A word or two as an item flags no document that merely says them."""
    docs = spark.createDataFrame([(1, "Yes"), (2, "oh yes it is"), (3, "yes!"), (4, "the answer is Paris"), (5, "the capital is Paris, of course"),
                                  (6, "a b c d e f g h i"), (7, "x a b c d e f g h i")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "yes"), (2, "The answer is: Paris"), (3, "a b c d e f g h"), (4, "a b c d e f g h i")], "item_id long, text string")
    for bound in (10 ** 6, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", bound)
        found = {(r.doc_id, r.item_id, r.matched, r.first_word) for r in decontaminate.contaminated(docs, items).collect()}
        assert found == {(1, 1, 1, 0), (3, 1, 1, 0), (4, 2, 4, 0), (6, 4, 9, 0), (7, 4, 9, 1)}


def test_decontamination_tolerates_substitutions(spark, monkeypatch):
    item = [f"w{k}" for k in range(30)]
    def edited(*at):
        return " ".join("zz" + str(k) if k in at else w for k, w in enumerate(item[:13]))
    rows = [(0, edited()), (1, edited(4)), (2, edited(0, 12)), (3, edited(3, 7)), (4, edited(2, 6, 10)), (5, " ".join(item[5:17]))]
    docs = spark.createDataFrame([(i, "before it " + t + " after") for i, t in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for bound in (10 ** 6, 0):  # broadcast and joined
        monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", bound)
        found = {r.doc_id: r.matched for r in decontaminate.contaminated(docs, bench).collect()}
        assert found == {0: 13, 1: 12, 2: 11, 3: 11, 5: 12}


def test_token_table_dirty(spark, dirty):
    table = tokens.context_table(tokens.histogram(tokens.with_lengths(dirty)))
    rows = table.orderBy("context_limit").collect()
    assert rows[0].context_limit == 0 and rows[0].documents == 3 and rows[-1].over == 0
    assert rows[-1].within == len(DIRTY) and rows[-1].tokens_truncated == rows[-1].tokens
    shares = {r.share: r.length for r in tokens.quantiles(table, [0.2, 1.0]).collect()}
    assert shares[0.2] == 0 and shares[1.0] == rows[-1].context_limit


def test_warc_round_trip(spark):
    big, other = "b" * 1500 + "ü", "c" * 2000
    rows = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (9, None, big), (9, None, big), (3, "u", "small"), (4, "u", "small"),
            (5, None, None), (6, "", ""), (None, "n", other), (None, "n", other), (None, "m", big), (7, "l", prose(1, 60_000))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("mine")).repartition(3)
    place = f"{shared_dir(spark)}/warc-{random.randrange(10 ** 9)}"
    index = stage(warc.write(warc.plan(pages), place, frame_bytes=3000, bundle_bytes=5000), "index")
    back = warc.read(spark, place, index).collect()
    key = lambda r: tuple(map(str, r))
    body = lambda t: (t or "").encode()
    expected = []
    for page, _, html in rows:
        latest = 9 if html == big else None
        refers = latest if latest and page != latest else None
        expected.append((page, len(body(html)), hashlib.sha1(body(html)).hexdigest(), "revisit" if refers else "response", refers,
                         None if refers else body(html)))
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in back]
    assert sorted(found, key=key) == sorted(expected, key=key)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(spark, place, stage(warc.write(warc.plan(empty), place), "index")).count() == 0


@pytest.mark.parametrize("bound", [0, 10 ** 6])
def test_warc_of_one_payload_on_nearly_all_pages(spark, monkeypatch, bound):
    """Most pages are one error page, many are null; each frame is read once, by several tasks."""
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", bound)
    monkeypatch.setattr(warc, "READ_BYTES", 20_000)
    hot, cold = "not found " * 150, "c" * 1200
    rows = [(k, "u", hot if k % 10 else None) for k in range(1000)] + [(2000, "v", cold), (2001, "v", cold + "x"), (2001, "w", cold), (2002, "w", "")]
    place = f"{shared_dir(spark)}/warc-{random.randrange(10 ** 9)}"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    planned = warc.plan(pages)
    assert planned.filter("refers_to IS NOT NULL").count() == 900 - 1 + 1
    index = stage(warc.write(planned, place, frame_bytes=8000, bundle_bytes=30_000), "index")
    back = warc.read(spark, place, index)
    assert back.rdd.getNumPartitions() > 3
    found = {(r.page_id, r.url): (r.payload_bytes, r.record_type, r.refers_to) for r in back.collect()}
    latest = max(k for k in range(1000) if k % 10)
    expected = {(k, "u"): (len(hot), "response", None) if k == latest else (len(hot), "revisit", latest) for k in range(1000) if k % 10}
    expected |= {(k, "u"): (0, "response", None) for k in range(0, 1000, 10)}
    expected |= {(2000, "v"): (1200, "revisit", 2001), (2001, "v"): (1201, "response", None), (2001, "w"): (1200, "response", None),
                 (2002, "w"): (0, "response", None)}
    assert found == expected


def test_pages_of_one_id_have_records_of_their_own():
    row = {"page_id": 7, "url": None, "refers_to": None, "bytes": 1}
    ids = {warc.parse_record(warc.record_bytes(row | {"body": b, "digest": hashlib.sha1(b).hexdigest()}))[0]["WARC-Record-ID"] for b in (b"a", b"b")}
    assert len(ids) == 2
    revisit = row | {"refers_to": 7, "page_id": 3, "body": b"a", "digest": hashlib.sha1(b"a").hexdigest()}
    assert warc.parse_record(warc.record_bytes(revisit))[0]["WARC-Refers-To"] in ids


def test_bundles_are_plain_zstandard_with_a_seek_table(tmp_path):
    bundle = warc.Bundle(f"file://{tmp_path}", 3)
    plain = []
    for k in range(3):
        data = f"record {k} ".encode() * 50
        bundle.add(data)
        bundle.end_frame()
        plain.append(data)
    bundle.close()
    (path,) = tmp_path.iterdir()
    with open(path, "rb") as file:
        table = warc.read_seek_table(file)
        whole = zstandard.ZstdDecompressor().stream_reader(file.seek(0) or file, read_across_frames=True).read()
        assert whole == b"".join(plain)
        for (at, size, length), data in zip(table, plain):
            file.seek(at)
            assert zstandard.ZstdDecompressor().decompress(file.read(size), max_output_size=length) == data
    with pytest.raises(ValueError):
        warc.read_seek_table(io.BytesIO(b"no table at all"))


def test_language_dirty(spark, dirty):
    rows = [(k, "der und die mit eine nicht " * 20, "de") for k in range(40)] + [(k, "the and with from this not " * 20, "en") for k in range(40, 80)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    told = {r.doc_id: (r.lang_pred, r.accepted) for r in language.predict(dirty, model).collect()}
    assert told[1] == told[2] == told[3] == ("und", False)
    new = spark.createDataFrame([(1, "und die mit der"), (2, "THIS from the and"), (3, "123 !"), (4, "qqq zzz vvv")], "doc_id long, text string")
    told = {r.doc_id: r.lang_pred for r in language.predict(new, model).collect()}
    assert (told[1], told[2], told[3]) == ("de", "en", "und")
    assert language.predict(new, language.LanguageModel({})).select("lang_pred").distinct().collect() == [("und",)]


def test_any_number_of_languages(spark):
    """Labels of more languages than one block has: the same as plain zstandard over all dictionaries."""
    pick = random.Random(8)
    syllables = ["".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(800)]
    tongues = {f"l{k:03d}": pick.sample(syllables, 25) for k in range(150)}
    say = lambda lang, n: " ".join(pick.choice(tongues[lang]) + pick.choice(tongues[lang]) for _ in range(n))
    rows = [(k * 1000 + j, say(lang, 200), lang) for k, lang in enumerate(tongues) for j in range(3)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.dictionaries) == 150
    asked = [(k, say(lang, n)) for k, (lang, n) in enumerate(zip(list(tongues)[::4], [10, 100, 900] * 99))]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert got == {i: brute.smallest(t, model) for i, t in asked}
    assert sum(got[k][0] == lang for k, lang in enumerate(list(tongues)[::4])) >= 36


def test_scoring_learns_order(spark):
    pick = random.Random(3)
    rows = [(k, " ".join(w for _ in range(120) for w in pick.choice([("red", "apple", "tree"), ("blue", "sea", "wave")]))) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    known = scoring.vocabulary(docs)
    model = scoring.train(docs, known)
    mixed = [(k, " ".join(pick.sample(t.split(), 360))) for k, t in rows[:20]]
    score = lambda r: spark.createDataFrame(r, "doc_id long, text string").transform(
        lambda d: scoring.score(d, model, known)).agg(F.avg("mean_log_likelihood")).first()[0]
    assert score(rows[:20]) > score(mixed) + 0.5


@pytest.mark.parametrize("middle", [0, 1, 200_000])
def test_scoring_tells_rare_words_apart(spark, monkeypatch, middle):
    """Words outside the most frequent ones have probabilities of their own."""
    monkeypatch.setattr(scoring, "MIDDLE", middle)
    frequent = " ".join(f"w{k} " * 9 for k in range(scoring.WORDS - scoring.RARE))
    rare = [w for w in (f"rare{k}" for k in range(4000)) if zlib.crc32(w.encode()) % scoring.RARE == 7][:3]
    learned = spark.createDataFrame([(1, frequent), (2, f"{rare[0]} " * 6 + f"{rare[1]} " * 2)], "doc_id long, text string")
    known = scoring.vocabulary(learned)
    assert known.counts.count() == scoring.WORDS - scoring.RARE + 2 and known.totals[7] == 8
    rows = [(k, f"w1 w2 {w} w3") for k, w in enumerate(rare)] + [(0, f"w1 w2 {rare[0]} w3"), (3, f"w1 w2 {rare[2]}longer w3"), (4, None)]
    found = scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), scoring.train(learned, known), known).collect()
    total = {r.doc_id: r.pseudo_log_likelihood for r in found}
    assert len(found) == len(rows) and len({r.pseudo_log_likelihood for r in found if r.doc_id == 0}) == 1
    assert total[0] - total[1] == pytest.approx(np.log(6 / 2)) and total[4] == 0.0
    length = len(rare[2]) + 1
    assert total[1] - total[2] == pytest.approx(np.log(2) - np.log(scoring.RARE) + length * np.log(257))


def test_scoring_does_not_depend_on_partitions(spark, monkeypatch):
    """The same model, but for the order of sums, from 1, 8 and 64 partitions; it beats the frequencies of words."""
    monkeypatch.setattr(scoring, "LANE_WORDS", 20_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    models = []
    for parts in (1, 8, 64):
        rows = docs.repartition(parts)
        known = scoring.vocabulary(rows)
        models.append(scoring.train(rows, known))
    assert known.words > 60_000 and all(np.allclose(models[0], m, atol=1e-5) for m in models[1:])
    assert not np.allclose(models[0], scoring.start(), atol=1e-2)
    ids = [scoring.Encoder(list(known))(r.t) for r in docs.select(F.lower("text").alias("t")).collect()]
    likely = np.concatenate([scoring.log_probabilities(scoring.unpack(models[2]), scoring.windows(x), x) for x in ids])
    shares = np.bincount(np.concatenate(ids), minlength=scoring.WORDS) / len(likely)
    assert likely.mean() > np.log(shares[np.concatenate(ids)]).mean()


def test_scores_equal_a_plain_forward_pass(spark, monkeypatch):
    """Word by word in plain numpy with the given weights, shares included, whatever tier a word is in."""
    monkeypatch.setattr(scoring, "MIDDLE", 2000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 60")
    known = scoring.vocabulary(docs)
    flat = scoring.train(docs, known)
    counts = {r.word: r.n for r in known.counts.collect()}
    assert len(counts) > 2000 + len(known)
    extra = spark.createDataFrame([(1000, "never counted thë " + list(known)[0] + " ZZZ")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    for r in scoring.score(rows, flat, known).collect():
        n, total = brute.pseudo_likelihood(r.text, flat, list(known), counts)
        assert r.n_words == n and r.pseudo_log_likelihood == pytest.approx(total, rel=1e-4)


def test_scoring_goes_over_texts_once(spark):
    """The plan that scores has no Python over texts but over what was kept of them; copies are scored alike."""
    docs = spark.createDataFrame([(0, "a b c"), (1, "c ü d"), (2, "a b c"), (3, None), (4, " ")], "doc_id long, text string")
    known = scoring.vocabulary(docs)
    coded = scoring.encode(docs, known)
    flat = scoring.train(docs, known, coded=coded)
    assert np.array_equal(flat, scoring.train(docs, known))
    found = scoring.score(docs, flat, known, coded=coded)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "PythonUDF" not in plan and "ArrowEvalPython" not in plan
    rows = {r.doc_id: (r.n_words, r.pseudo_log_likelihood) for r in found.collect()}
    assert rows[0] == rows[2] and rows[0][0] == rows[1][0] == 3 and rows[3] == rows[4] == (0, 0.0)


def test_scoring_slopes():
    """The learning step goes down the slope of the loss, measured by small differences."""
    rng = np.random.default_rng(0)
    flat = scoring.start().astype(np.float64)
    ids = rng.integers(0, scoring.WORDS, 64)
    around = scoring.windows(ids)
    loss = lambda f: -scoring.log_probabilities(scoring.unpack(f), around, ids).mean()
    after, seen = flat.copy(), np.zeros_like(flat)
    scoring.learn(after, seen, around, ids)
    slope = np.sqrt(seen) * np.sign(flat - after)
    for k in rng.choice(np.flatnonzero(np.abs(slope) > 1e-4), 25, replace=False):
        step = np.zeros_like(flat)
        step[k] = 1e-4
        assert (loss(flat + step) - loss(flat - step)) / 2e-4 == pytest.approx(slope[k], rel=0.05, abs=1e-5)


def test_scoring_dirty(dirty):
    known = scoring.vocabulary(dirty)
    found = scoring.score(dirty, scoring.train(dirty, known), known).collect()
    blank = [r for r in found if not (r.text or "").strip()]
    assert all((r.n_words, r.pseudo_log_likelihood, r.mean_log_likelihood) == (0, 0.0, None) for r in blank) and len(blank) == 4


def test_packing_dirty(dirty):
    found = packing.pack(dirty, capacities=(16, 64, 256)).toPandas()
    assert found.n_tokens.sum() == sum(len((t or "").encode().split()) + 1 for _, t, *_ in DIRTY)
    assert found.groupby("bin").n_tokens.sum().max() <= 256 and found.doc_id.isna().sum() == 3
    assert (found.capacity >= found.bin_tokens).all() and set(found.capacity) <= {16, 64, 256}


def test_packed_texts(spark):
    docs = spark.createDataFrame([(k, prose(k, k * 13)) for k in range(40)], "doc_id long, text string")
    packed = stage(packing.pack(docs, capacities=(32, 128)), "packed")
    said = " ".join(r.text for r in packing.sequences(docs, packed).collect()).split()
    assert sorted(said) == sorted(w for r in docs.collect() for w in [*r.text.split(), "<end>"])
    sizes = {r.bin: len(r.text.split()) for r in packing.sequences(docs, packed).collect()}
    assert sizes == {r.bin: r.bin_tokens for r in packed.select("bin", "bin_tokens").distinct().collect()}


def test_best_fit_is_a_packing():
    pick = random.Random(5)
    for _ in range(30):
        lengths = sorted((pick.randrange(1, 65) for _ in range(200)), reverse=True)
        placed, held = packing.cheapest(lengths, (8, 32, 64), 4)
        assert all(held[b] == sum(n for n, at in zip(lengths, placed) if at == b) <= 64 for b in range(len(held)))
        one_each = sum(packing.fitting(n, (8, 32, 64)) + 4 for n in lengths)
        assert sum(packing.fitting(t, (8, 32, 64)) + 4 for t in held) < one_each


def test_lines_dirty(spark):
    a, b = "one two three four five six seven eight", "one two three four five six seven"
    rows = [
        (2, a), (1, f"{b}\n{a} nine"), (3, "one two XX four five six seven eight"), (4, "one two XX four YY six seven eight"),
        (5, None), (None, a), (6, ""), (7, " \n \n"), (8, b), (9, "ONE two three four five six seven eight nine"), (9, b), (10, a + "\n" + a),
        (11, "two one three four five six seven eight"), (12, LONG), (13, " ".join(LONG.split()[:-1])), (14, "short"), (15, "shorT\nshort"),
    ]
    found = lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit(1)).repartition(3)).collect()
    # Both texts of document 9 are copies of earlier lines, in whichever order they come.
    expected = brute.dropped_lines([r for r in rows if r[0] not in (None, 9)], 8) | {9: [0], None: [0]}
    assert len(found) == len(rows) and all(r.dropped_lines == expected[r.doc_id] for r in found)
    assert {r.doc_id: r.text for r in found if r.doc_id in (1, 5, 7)} == {1: f"{b}\n{a} nine", 5: None, 7: " \n \n"}


def test_lines_of_repeated_rows(spark):
    """A row that is there twice keeps its first line, and that line's edited copy elsewhere goes."""
    a, edited = "one two three four five six seven eight", "one two three four five six seven XX"
    rows = [(1, a), (1, a), (2, edited), (None, "null " + a), (None, "null " + a), (None, "null " + a)]
    found = lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r.doc_id), r.dropped_lines) for r in found) == [
        ("1", []), ("1", []), ("2", [0]), ("None", [0]), ("None", [0]), ("None", [0])]
    apart = [(1, a), (1, a), (2, "zz " + edited), (None, edited), (None, edited)]
    found = lines.deduplicate(spark.createDataFrame(apart, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r.doc_id), r.dropped_lines) for r in found) == [("1", []), ("1", []), ("2", []), ("None", [0]), ("None", [0])]


def test_one_edit():
    pick = random.Random(1)
    for _ in range(4000):
        a = [pick.randrange(3) for _ in range(pick.randrange(6))]
        b = [pick.randrange(3) for _ in range(pick.randrange(6))]
        assert lines.one_edit(a, b) == (brute.edits(a, b) <= 1)


def test_line_dedup_of_random_lines(spark):
    pick = random.Random(2)
    rows = []
    for i in range(150):
        made = []
        for _ in range(pick.randrange(1, 5)):
            words = [pick.choice("abcd") for _ in range(pick.randrange(6, 12))] if pick.random() < 0.8 else prose(pick.randrange(4), 9).split()
            made.append(" ".join(words))
        rows.append((i, "\n".join(made)))
    found = lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.dropped_lines for r in found} == brute.dropped_lines(rows, lines.LEAST_WORDS)


def test_phrases_dirty(spark, dirty):
    found = phrases.compare_with_next(dirty).collect()
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[4][0].fingerprint == by_id[4][1].fingerprint == by_id[5][0].fingerprint
    assert by_id[2][0].fingerprint == "" and by_id[2][0].near_next == 1.0 and by_id[2][0].n_chars == 0
    assert by_id[9][0].n_chars == len("ÄÖ é 😀 ende")
    assert {r.edited_sha256 for r in by_id[2]} == {hashlib.sha256(b"").hexdigest()}
    one = phrases.compare_with_next(dirty.filter("doc_id = 6")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert one[0].edited_sha256 == hashlib.sha256(phrases.edited(LONG, LONG).encode()).hexdigest()


def test_phrase_order_over_many_parts(spark):
    rows = [(i * 7 % 1009, prose(i, 20)) for i in range(1009)]
    found = phrases.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    expected = brute.edited(rows)
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in found} == {i: e[:2] for i, e in expected.items()}


def test_pipeline_on_dirty_rows(spark, dirty):
    docs = dirty
    for name, apply in corpus_pipeline.STAGES[1:4]:
        after = stage(apply(spark, docs, "/root/testdata/sf0.001"), f"dirty_{name}")
        assert after.columns == dirty.columns
        docs = after
    rows = docs.collect()
    assert {r.doc_id for r in rows if r.doc_id is not None} == {1, 2, 3, 4, 6, 7, 8, 9}
    assert sum(r.doc_id == 4 for r in rows) == 1
    for name, apply in corpus_pipeline.STAGES:
        docs = stage(apply(spark, dirty.limit(0) if name == "language_id" else docs, "/root/testdata/sf0.001"), f"none_{name}")
        assert docs.count() == 0


def test_first_and_last_stage_on_dirty_rows(spark, dirty):
    """The language stage lets go what has no language and keeps the rest whole; packing places every row."""
    pick = random.Random(6)
    say = lambda words: " ".join(pick.choice(words.split()) for _ in range(300))
    rows = [(100 + k, say("the and with from this not for are you that"), "en", "a", 1) for k in range(30)]
    rows += [(200 + k, say("der und die mit eine nicht für sind das auf"), "de", None, None) for k in range(30)]
    docs = stage(dirty.unionByName(spark.createDataFrame(rows, DOCS)), "dirty_languages")
    kept = stage(corpus_pipeline.STAGES[0][1](spark, docs, "/root/testdata/sf0.001"), "kept_languages")
    assert kept.columns == docs.columns
    found = [tuple(r) for r in kept.collect()]
    assert not {1, 2, 3} & {r[0] for r in found} and all(r[1] and r[1].strip() for r in found)
    assert {r for r in found if r[0] and r[0] >= 100} == set(rows)
    given = [tuple(r) for r in docs.collect()]
    assert all(found.count(r) == given.count(r) for r in set(found))
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").toPandas()
    assert placed.n_tokens.sum() == sum(len((t or "").encode().split()) + 1 for _, t, *_ in given)
    assert (placed.groupby("bin").n_tokens.sum() <= placed.groupby("bin").capacity.first()).all()
