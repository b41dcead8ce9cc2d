"""The registered queries of this package: one per operator, each over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import (
    audit, decontaminate, language, lines, minhash, packing, phrases, prefixes, repeats, scoring, sharding, tokens, warc,
)
from emberlog.llm.common import table
from emberlog.session import shared_dir, stage

SHARDS = 8


def op1_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), width=4)


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    sharded = sharding.shard_by_bytes(table(spark, folder, "documents"), SHARDS)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                          F.lit(None).cast("int").alias("grown_shard"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = tokens.with_lengths(table(spark, folder, "documents"))
    return tokens.context_table(stage(tokens.histogram(counted), "lengths"))


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    place = f"{shared_dir(spark)}/emberlog/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex[:12]}"
    index = stage(warc.write(warc.plan(table(spark, folder, "pages")), place), "warc_index")
    return warc.read(spark, place, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", language.held_out())
    model = language.fit(docs.filter(~F.col("held_out")))
    return language.predict(docs, model).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op7_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    known = scoring.vocabulary(docs)
    coded = scoring.encode(docs, known)
    return scoring.score(docs, scoring.train(docs, known, coded=coded), known, coded=coded).select(
        "doc_id", "n_words", "pseudo_log_likelihood", "mean_log_likelihood")


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = lines.deduplicate(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_lines", F.array_join("dropped_lines", ",").alias("dropped_lines"))


def op10_phrase_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.compare_with_next(table(spark, folder, "documents"))


def op11_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefixes.trie(prefixes.rebuilt(table(spark, folder, "conversations")))


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.interactions(table(spark, folder, "documents"), table(spark, folder, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_minhash, op2_sharding, op3_decontamination, op4_token_counts, op5_warc, op6_language_id, op7_lm_scoring,
            op8_packing, op9_line_dedup, op10_phrase_fingerprint, op11_substring_dedup, op12_prefix_trie, op13_filter_audit)
    return {f.__name__: f for f in made}


WARC_SQL = """
WITH rows AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
latest AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id FROM rows)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
FROM latest
"""


# Without seeds: every two equal tokens are an alignment, and windows are summed.
DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
dt AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS i FROM d),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
bt AS (SELECT item_id, len(w) AS n, least(len(w), 13) AS k, unnest(w) AS t, unnest(range(len(w))) AS j FROM b),
same AS (SELECT doc_id, item_id, n, k, i - j AS start, j FROM dt JOIN bt USING (t) JOIN d USING (doc_id) WHERE n >= 9 OR (len(d.w) = n AND i = j)),
enough AS (
  SELECT doc_id, item_id, start, any_value(n) AS n, any_value(k) AS k, count(*) AS aligned, list(j) AS js
  FROM same GROUP BY ALL HAVING count(*) >= any_value(k) - 2),
windows AS (
  SELECT *, unnest(range(n - k + 1)) AS s FROM enough),
sums AS (
  SELECT doc_id, item_id, start, n, k, aligned, max(len(list_filter(js, lambda x: x >= s AND x < s + k))) AS matched
  FROM windows GROUP BY ALL)
SELECT doc_id, item_id, max(matched)::INT AS matched, max(aligned)::INT AS aligned, min(start)::INT AS first_word
FROM sums WHERE matched >= k - CASE WHEN n >= 13 THEN 2 WHEN n >= 11 THEN 1 ELSE 0 END
GROUP BY doc_id, item_id
"""


# All pairs that share a shingle, on their full sets.
MINHASH_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    ELSE list_transform(range(greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i + 1:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)
"""

# DuckDB has no CRC-32: the table follows from the polynomial, the sum from the bytes.
SHARDING_SQL = f"""
WITH tab AS (
  SELECT list(list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY k) AS t
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS k)),
d AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, text IS NULL AS missing, hex(encode(coalesce(text, ''))) AS h FROM documents),
crc AS (
  SELECT doc_id, size, CASE WHEN NOT missing THEN xor(list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(size - 1), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT))),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) END AS text_crc32
  FROM d, tab),
placed AS (
  SELECT *, CAST((2 * sum(size) OVER (ORDER BY doc_id) - size) * {SHARDS} // (2 * sum(size) OVER ()) AS INT) AS shard FROM crc)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot,
  CAST(NULL AS INT) AS grown_shard FROM placed
"""

LINES_SQL = r"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM split),
said AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS place,
    list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM l),
firsts AS (SELECT line, min(place) AS first, any_value(w) AS w FROM said WHERE len(w) > 0 GROUP BY line),
able AS (SELECT * FROM firsts WHERE len(w) >= 8),
shorter AS (
  SELECT first, i, array_to_string(list_concat(w[1:i], w[i + 2:]), ' ') AS v FROM (SELECT *, unnest(range(len(w))) AS i FROM able)),
whole AS (SELECT first, array_to_string(w, ' ') AS v FROM able),
near AS (
  SELECT first FROM (SELECT first, min(first) OVER (PARTITION BY v, i) AS earliest FROM shorter) WHERE earliest < first
  UNION SELECT greatest(s.first, o.first) FROM shorter s JOIN whole o ON s.v = o.v WHERE s.first <> o.first
  UNION SELECT first FROM (SELECT first, min(first) OVER (PARTITION BY v) AS earliest FROM whole) WHERE earliest < first),
gone AS (
  SELECT doc_id, line_no FROM said JOIN firsts USING (line)
  WHERE place <> firsts.first OR firsts.first IN (SELECT first FROM near))
SELECT doc_id, CAST(coalesce(len(ls), 0) AS INT) AS n_lines, coalesce(numbers, '') AS dropped_lines FROM split
LEFT JOIN (SELECT doc_id, string_agg(line_no, ',' ORDER BY line_no) AS numbers FROM gone GROUP BY doc_id) USING (doc_id)
"""


REPEATS_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, s, array_to_string(w[s + 1:s + 20], ' ') AS t FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS s FROM d)),
later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS nth FROM windows) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

# Every node by its whole path of turns, every subtree by comparing paths.
TRIE_SQL = """
WITH tab AS (
  SELECT list(list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY k) AS t
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS k)),
said AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (
  SELECT conv_id, own, xor(list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(strlen(d)), lambda i: CAST(ascii(d[i + 1]) AS BIGINT))),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM (SELECT *, CAST(conv_id AS VARCHAR) AS d FROM said), tab),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS turns
  FROM heads c LEFT JOIN said b ON b.conv_id = c.conv_id - c.conv_id % 100),
members AS (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM rebuilt),
nodes AS (
  SELECT turns[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    string_agg(CASE WHEN len(turns) = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends
  FROM members GROUP BY ALL),
related AS (
  SELECT p.path, p.depth, p.conv_id, p.n_convs, p.ends, c.depth AS below, c.n_convs AS c_convs, c.path AS c_path,
    NOT EXISTS (SELECT 1 FROM nodes x WHERE x.depth = c.depth + 1 AND x.path[1:c.depth] = c.path) AS leaf
  FROM nodes p JOIN nodes c ON c.depth >= p.depth AND c.path[1:p.depth] = p.path),
sums AS (
  SELECT path, depth, conv_id, n_convs, ends, count(*) FILTER (below = depth + 1) AS n_children, count(*) FILTER (leaf) AS n_leaves,
    sum(CASE WHEN below > 0 THEN (c_convs - 1) * length(c_path[below].text) ELSE 0 END) AS saved_tokens
  FROM related GROUP BY ALL)
SELECT s.conv_id, s.depth, CAST(p.conv_id AS BIGINT) AS parent_conv_id, s.n_convs, s.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens,
  sha256(coalesce(s.ends, '')) AS ends_sha256
FROM sums s LEFT JOIN nodes p ON p.depth = s.depth - 1 AND p.path = s.path[1:s.depth - 1]
"""

AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    min(doc_id) OVER (PARTITION BY text) AS first FROM d),
fails AS (
  SELECT doc_id, part, {'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words),
    'C': 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
    'E': first < doc_id} AS f FROM w),
letters AS (
  SELECT doc_id, part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: f[x]) AS failed,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = fails.doc_id AND quality = 1) AS good,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = fails.doc_id AND toxic = 1) AS toxic
  FROM (SELECT doc_id, part, MAP {'A': f.A, 'B': f.B, 'C': f.C, 'D': f.D, 'E': f.E} AS f FROM fails) fails),
combos AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM letters GROUP BY ALL),
one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM one a, one b, one c, one d, one e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
told AS (
  SELECT part, filter_order, step, filter_order[step] AS letter, n, good, toxic, len(failed) AS n_failed, list_contains(failed, filter_order[step]) AS own,
    len(list_intersect(failed, string_split(filter_order[1:step - 1], ''))) > 0 AS before
  FROM combos, steps),
found AS (
  SELECT part, filter_order, step, any_value(letter) AS letter,
    coalesce(sum(n) FILTER (NOT own AND NOT before), 0) AS kept, coalesce(sum(n) FILTER (own AND NOT before), 0) AS removed,
    coalesce(sum(n) FILTER (own AND before), 0) AS redundant, coalesce(sum(n) FILTER (own AND n_failed = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (own AND NOT before), 0) AS good_lost, coalesce(sum(toxic) FILTER (own AND NOT before), 0) AS toxic_lost
  FROM told GROUP BY part, filter_order, step)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM found
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": MINHASH_SQL, "op2_sharding": SHARDING_SQL, "op3_decontamination": DECONTAMINATION_SQL,
            "op5_warc": WARC_SQL, "op9_line_dedup": LINES_SQL, "op11_substring_dedup": REPEATS_SQL,
            "op12_prefix_trie": TRIE_SQL, "op13_filter_audit": AUDIT_SQL}
