"""The registered queries once more, as SQL for the correctness check.

Written from the definitions, not from the Spark code: common tables first,
then one statement per query. Column names match those of the Spark results.
"""

from __future__ import annotations

from emberlog import fixed_values as fixed
from emberlog.operators.assistant import HINTS
from emberlog.plans import registered as reg

SP = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
NSP = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def r(x: str, name: str | None = None) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) + 0.0 AS {name or x}"


def n(x: str, name: str | None = None) -> str:
    return f"CAST({x} AS BIGINT) AS {name or x}"


def ts_text(x: str, name: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f') AS {name}"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def contains_any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


SRC = r"""
src AS (
  SELECT event_id, user_id, event_type, value, c.copy,
    CASE WHEN event_id % 97 = 5 THEN 'not-a-time' WHEN event_id % 89 = 7 THEN ''
         ELSE strftime(moment, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' END AS stamp,
    CASE k
      WHEN 0 THEN 'Failed login for operator from 198.51.100.' || (user_id % 3 + 1) || ' port ' || (1024 + event_id % 60000)
      WHEN 1 THEN 'Blocked inbound packet SRC=203.0.113.' || (user_id % 3 + 1) || ' DPT=' || (20 + event_id % 400)
      WHEN 2 THEN 'Memory exhausted, terminated worker ' || event_id || ' after exception'
      WHEN 3 THEN 'CRITICAL volume nearly full on /data'
      WHEN 4 THEN 'Warning: clock drift ' || (event_id % 50) || ' ms'
      WHEN 5 THEN 'service billing exited with ERROR status 3'
      WHEN 6 THEN 'auth token refreshed for user ' || user_id
      WHEN 7 THEN 'SSH session opened'
      WHEN 8 THEN '   '
      WHEN 9 THEN NULL
      WHEN 10 THEN '{"log.level":"info","msg":"Non-zero metrics"}'
      WHEN 11 THEN '2024-01-05T10:00:00.123456+05:30 node-7 sshd[88]: Accepted key for deploy'
      ELSE 'Request ' || event_type || ' handled in ' || (event_id % 7) || ' ms' END AS message,
    CASE WHEN k = 9 AND event_id % 3 = 0 THEN 'fallback original ' || event_id END AS original,
    'host-' || (user_id % 10) AS host,
    '/var/log/app' || (event_id % 3) || '.log' AS log_file
  FROM (SELECT *, event_id % 16 AS k,
          CASE WHEN event_id % 16 IN (0, 1) THEN date_trunc('day', ts) + to_seconds(event_id % 600) ELSE ts END AS moment
        FROM events) e
  JOIN (VALUES (0), (1)) c(copy) ON c.copy = 0 OR e.event_id % 50 = 0
)"""
PARSE = "try_cast(replace(stamp, '+00:00', '') AS TIMESTAMP)"
STATE = f"""
raw AS (
  SELECT *, CASE WHEN {strip('message')} <> '' THEN {strip('message')}
                 WHEN {strip('original')} <> '' THEN {strip('original')} END AS raw FROM src
),
state AS (
  SELECT *, CASE WHEN raw IS NULL THEN 'blank' WHEN {contains_any('raw', fixed.NOISE_MARKERS)} THEN 'noise' ELSE 'kept' END AS state
  FROM raw
)"""
CUT = strip(f"regexp_replace(raw, {q(fixed.SYSLOG_PREFIX_BATCH)}, '')")
CLEAN = f"""
flat AS (
  SELECT event_id, copy, user_id, event_type, value, stamp, host, log_file,
    CASE WHEN {CUT} <> '' THEN {CUT} ELSE raw END AS message
  FROM state WHERE state = 'kept'
)"""
LOGS = f"""
logs AS (
  SELECT *, {PARSE} AS ts FROM flat
  QUALIFY row_number() OVER (PARTITION BY stamp, message ORDER BY host, log_file, event_id) = 1
)"""


def text_columns(x: str, profile: str = "full") -> str:
    flags = [n(f"regexp_matches({x}, {q(p)}, 'i')", name) for name, p in fixed.KEYWORDS[profile].items()]
    cols = [n(f"length({x})", "msg_length"), *flags, n(rf"len(regexp_extract_all({x}, '\p{{Nd}}'))", "digit_count")]
    if profile == "full":
        cols += [
            n(f"len(regexp_extract_all({x}, '{NSP}+'))", "word_count"),
            rf"CAST(len(regexp_extract_all({x}, '\p{{Lu}}')) AS DOUBLE) / greatest(length({x}), 1) AS uppercase_ratio",
        ]
    return ", ".join(cols)


FEATURED = f"""
featured AS (
  SELECT *, {text_columns('message')},
    {n('coalesce(hour(ts), 0)', 'hour')}, {n('coalesce(isodow(ts) - 1, 0)', 'day_of_week')},
    {n('count(*) OVER (PARTITION BY message)', 'message_frequency')}
  FROM logs
)"""


def bands(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} > {c} THEN {q(s)}" for c, s in fixed.SEVERITY_BANDS) + " ELSE 'INFO' END"


DAYS = "CASE day_of_week " + " ".join(f"WHEN {i} THEN {q(d)}" for i, d in enumerate(fixed.DAY_NAMES)) + " ELSE 'Unknown' END"
SCORED = f"""
labelled AS (
  SELECT *, -value AS anomaly_score,
    CASE WHEN -value < (SELECT quantile_cont(-value, {fixed.CONTAMINATION}) FROM featured) THEN -1 ELSE 1 END AS anomaly
  FROM featured
),
normed AS (
  SELECT *, 1.0 - coalesce((anomaly_score - (SELECT min(anomaly_score) FROM labelled))
      / nullif((SELECT max(anomaly_score) - min(anomaly_score) FROM labelled), 0), 0) AS anomaly_score_norm
  FROM labelled
),
scored AS (SELECT *, {bands('anomaly_score_norm')} AS severity, {DAYS} AS day_name FROM normed),
hits AS (SELECT * FROM scored WHERE anomaly = -1)"""
ISO = ("strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '.%f') = '.000000' THEN '' ELSE strftime(ts, '.%f') END"
       " || '+00:00'")


def docs_of(table: str, name: str = "docs") -> str:
    return f"""
{name}_all AS (SELECT *, {ISO} AS iso, md5({ISO} || message) AS doc_id FROM {table} WHERE ts IS NOT NULL),
{name} AS (SELECT * FROM {name}_all QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY anomaly_score, iso) = 1)"""


DOCS = docs_of("hits")
CHAIN = [SRC, STATE, CLEAN, LOGS, FEATURED, SCORED, DOCS]


def after(stage: str, body: str, *more: str) -> str:
    """``body`` behind all common tables up to ``stage``."""
    last = {"src": 1, "state": 2, "flat": 3, "logs": 4, "featured": 5, "scored": 6, "docs": 7}[stage]
    return "WITH RECURSIVE" + ",".join([*CHAIN[:last], *more]) + "\n" + body


def symbols(x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fixed.SEVERITY_SYMBOLS.items()) + f" ELSE {q(fixed.OTHER_SYMBOL)} END"


def legacy(score: str) -> str:
    cuts = " ".join(f"WHEN {score} < {c} THEN {q(s)}" for c, s in fixed.SEVERITY_RAW_BANDS)
    return (f"CASE {cuts} WHEN contains_error = 1 THEN 'HIGH' WHEN contains_login = 1 THEN 'MEDIUM' "
            "WHEN contains_warning = 1 THEN 'LOW' ELSE 'INFO' END")


def escape(x: str) -> str:
    for raw, safe in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]:
        x = f"replace({x}, {q(raw)}, {q(safe)})"
    return x


def intent(x: str) -> str:
    rules = " ".join(f"WHEN {contains_any(f'lower({x})', words)} THEN {q(name)}" for name, words in fixed.INTENTS)
    return f"CASE {rules} ELSE 'general' END"


HOURLY = "hourly AS (SELECT hour, count(*) AS anomalies FROM hits GROUP BY hour)"
DAILY = "daily AS (SELECT day_name, count(*) AS anomalies FROM hits GROUP BY day_name)"
TREND = """
slope AS (
  SELECT count(*) AS hours, CASE WHEN count(*) > 1 THEN regr_slope(anomalies, idx) END AS slope
  FROM (SELECT anomalies, row_number() OVER (ORDER BY hour) - 1 AS idx FROM hourly)
),
trend AS (
  SELECT *, CASE WHEN hours < 3 THEN 'Stable' WHEN slope > 0.5 THEN 'Increasing' WHEN slope < -0.5 THEN 'Decreasing' ELSE 'Stable' END AS trend
  FROM slope
)"""
LEVELS = "levels(ord, severity) AS (VALUES " + ", ".join(f"({i}, {q(s)})" for i, s in enumerate(fixed.SEVERITY_LEVELS)) + ")"
ASKED = f"""
asked AS (
  SELECT conv_id, turn, text, conv_id || '-' || turn AS qid, {intent('text')} AS intent,
    {strip('lower(text)')} IN ({', '.join(q(s) for s in fixed.SMALL_TALK)}) AS small_talk
  FROM conversations WHERE role = 'user'
),
remembered AS (
  SELECT *, array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn
      ROWS BETWEEN {fixed.MEMORY_TURNS} PRECEDING AND 1 PRECEDING), chr(10)) AS memory FROM asked
)"""


def bm25(docs: str, fields: list[str], tie: str) -> str:
    """Tables up to ``best(qid, row keys, score, rank)`` over ``docs``."""
    parts = [f"corpus AS (SELECT *, row_number() OVER (ORDER BY {tie}) AS rid FROM {docs})",
             r"qterm AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM asked) GROUP BY qid, term)"]
    for i, f in enumerate(fields):
        parts += [
            rf"tok{i} AS (SELECT rid, regexp_extract_all(lower(coalesce({f}, '')), '[\p{{L}}\p{{N}}_]+') AS t FROM corpus)",
            f"mean{i} AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM tok{i})",
            f"tf{i} AS (SELECT rid, term, len, count(*) AS tf FROM (SELECT rid, len(t) AS len, unnest(t) AS term FROM tok{i}) GROUP BY rid, term, len)",
            f"df{i} AS (SELECT term, count(*) AS df FROM tf{i} GROUP BY term)",
            f"""part{i} AS (
  SELECT qid, rid, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({fixed.BM25_K1} + 1)
      / (tf + {fixed.BM25_K1} * (1 - {fixed.BM25_B} + {fixed.BM25_B} * len / mean))) AS score
  FROM qterm JOIN tf{i} USING (term) JOIN df{i} USING (term), mean{i} GROUP BY qid, rid)""",
        ]
    union = " UNION ALL ".join(f"SELECT * FROM part{i}" for i in range(len(fields)))
    parts.append(f"total AS (SELECT qid, rid, round(max(score), 6) AS score FROM ({union}) GROUP BY qid, rid)")
    parts.append(f"""best AS (
  SELECT * FROM (SELECT qid, score, corpus.*, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rid) AS rank
    FROM total JOIN corpus USING (rid) WHERE score > 0) WHERE rank <= {fixed.SEARCH_K})""")
    return ",\n".join(parts)


def vocabulary(min_df: int, fold: bool) -> str:
    low = "strip_accents(lower(text))" if fold else "lower(text)"
    return rf"""
tok AS (SELECT doc_id, unnest(regexp_extract_all({low}, '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term),
vocab AS (
  SELECT *, row_number() OVER (ORDER BY term) - 1 AS idx,
    ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0 AS idf
  FROM (SELECT term, sum(tf) AS tf, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= {min_df}
        ORDER BY 2 DESC, term LIMIT {fixed.MAX_TERMS})
)"""


def with_previous(table: str, bucket: str, step: str) -> str:
    return f"""SELECT {ts_text('a.' + bucket, bucket)}, {n('a.n', 'n')}, {n('coalesce(b.n, 0)', 'previous')},
  {n('a.n - coalesce(b.n, 0)', 'change')}
FROM {table} a LEFT JOIN {table} b ON a.{bucket} = b.{bucket} + INTERVAL {step}"""


def summary(cond: str) -> str:
    levels = ", ".join(n(f"count(*) FILTER (anomaly = -1 AND severity = {q(s)})", s.lower()) for s in fixed.SEVERITY_LEVELS)
    return f"SELECT {n('count(*)', 'total')}, {n('count(*) FILTER (anomaly = -1)', 'anomalies')}, {levels} FROM scored WHERE {cond}"


TEMPLATE = (r"regexp_replace(regexp_replace(regexp_replace(message, '[0-9]{1,3}(?:\.[0-9]{1,3}){3}', '<ip>', 'g'), "
            r"'\b0[xX][0-9a-fA-F]+\b', '<hex>', 'g'), '[0-9]+', '<n>', 'g')")
IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
FAILED = rf"failed AS (SELECT *, nullif(regexp_extract(message, 'from ({IP})', 1), '') AS ip FROM logs WHERE regexp_matches(message, 'failed (?:login|password)', 'i'))"
BLOCKED = rf"""blocked AS (
  SELECT * FROM (SELECT *, regexp_extract(message, 'SRC=({IP})', 1) AS src, regexp_extract(message, 'DPT=([0-9]+)', 1) AS port
  FROM logs WHERE regexp_matches(message, '\bblock(?:ed)?\b', 'i')) WHERE src <> '' AND port <> '')"""
CELLS = """cells AS (SELECT
  count(*) FILTER (hit AND weak) AS tp, count(*) FILTER (hit AND NOT weak) AS fp,
  count(*) FILTER (NOT hit AND weak) AS fn, count(*) FILTER (NOT hit AND NOT weak) AS tn FROM pairs),
rates AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM cells)"""
RATES = (f"SELECT {n('tp')}, {n('fp')}, {n('fn')}, {n('tn')}, {r('precision')}, {r('recall')}, "
         f"{r('CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END', 'f1')} FROM rates")
VERSIONS = f"""
days AS (SELECT strftime(ts, '%Y%m%d_000000') AS tag, count(*) AS total, count(*) FILTER (anomaly = -1) AS anomalies
         FROM scored WHERE ts IS NOT NULL GROUP BY 1),
registry AS (
  SELECT tag, 'models/' || tag AS path, anomalies / total AS rate, anomalies / total BETWEEN {fixed.GATE_LOW} AND {fixed.GATE_HIGH} AS ok,
    CASE WHEN anomalies / total < {fixed.GATE_LOW} THEN printf('rate %.4f under {fixed.GATE_LOW}', anomalies / total)
         WHEN anomalies / total > {fixed.GATE_HIGH} THEN printf('rate %.4f over {fixed.GATE_HIGH}', anomalies / total)
         ELSE printf('rate %.4f (%d of %d)', anomalies / total, anomalies, total) END AS reason
  FROM days)"""


def forest(rows: str, features: str, seed: int = fixed.SEED) -> str:
    """Tables up to ``decided(key, score)``: the forest over ``rows(key, x)``, x a list of numbers.

    One table of members and one of nodes per level; every choice is the number
    of a text, as in the operator.
    """
    h = lambda *parts: f"(CAST('0x' || substr(md5({' || '.join(parts)}), 1, 13) AS BIGINT) / {2**52}.0)"
    bar = "'|'"
    parts = [f"""
pts AS MATERIALIZED (SELECT key, list_transform({features}, lambda v: round(v, 6)) AS x FROM {rows}),
total AS (SELECT count(*) AS n, least(count(*), {fixed.SUBSAMPLE}) AS sample FROM pts),
m0 AS MATERIALIZED (SELECT tree, key, 1 AS node, x FROM pts, (SELECT unnest(range({fixed.TREES})) AS tree), total
  QUALIFY row_number() OVER (PARTITION BY tree ORDER BY {h(f"'{seed}|'", 'tree', bar, 'key')}, key) <= sample)"""]
    for d in range(9):
        grows = d < 8
        parts.append(f"""
e{d} AS (SELECT tree, node, unnest(range(len(x))) AS f, unnest(x) AS v FROM m{d}),
c{d} AS (SELECT tree, node, f, min(v) AS lo, max(v) AS hi FROM e{d} GROUP BY ALL HAVING min(v) < max(v)),
p{d} AS (SELECT tree, node, f, lo + {h(f"'{seed}|'", 'tree', bar, 'node', "'|cut'")} * (hi - lo) AS cut FROM c{d}
  QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY {h(f"'{seed}|'", 'tree', bar, 'node', bar, 'f')}, f) = 1),
n{d} AS MATERIALIZED (SELECT s.tree, s.node, p.f, p.cut, s.size, {d} AS depth
  FROM (SELECT tree, node, count(*) AS size FROM m{d} GROUP BY ALL) s
  LEFT JOIN p{d} p ON p.tree = s.tree AND p.node = s.node AND {'s.size > 1 AND ' + str(d) + ' < ceil(log2(greatest((SELECT sample FROM total), 2)))' if grows else 'false'})""")
        if grows:
            parts.append(f"""
m{d + 1} AS MATERIALIZED (SELECT tree, key, 2 * node + CASE WHEN x[f + 1] <= cut THEN 0 ELSE 1 END AS node, x
  FROM m{d} JOIN n{d} USING (tree, node) WHERE f IS NOT NULL)""")
    parts.append("nodes AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM n{d}" for d in range(9)) + ")")
    parts.append("w0 AS (SELECT key, x, tree, 1 AS node FROM pts, (SELECT DISTINCT tree FROM nodes))")
    for d in range(8):
        parts.append(f"""
w{d + 1} AS MATERIALIZED (SELECT key, x, tree,
  CASE WHEN f IS NULL THEN node ELSE 2 * node + CASE WHEN x[f + 1] <= cut THEN 0 ELSE 1 END END AS node FROM w{d} JOIN nodes USING (tree, node))""")
    parts.append(f"""
lengths AS (SELECT *, depth + CASE WHEN size > 2 THEN 2 * (ln(size - 1.0) + 0.5772156649015329) - 2 * (size - 1.0) / size
  WHEN size = 2 THEN 1 ELSE 0 END AS length FROM nodes),
scale AS (SELECT {fixed.TREES} * CASE WHEN sample > 2 THEN 2 * (ln(sample - 1.0) + 0.5772156649015329) - 2 * (sample - 1.0) / sample
  WHEN sample = 2 THEN 1 ELSE 0 END AS scale FROM total),
raw_scores AS (SELECT key, -pow(2, -(sum(length) / any_value(scale))) AS raw FROM w8 JOIN lengths USING (tree, node), scale GROUP BY key),
decided AS (SELECT key, raw - (SELECT quantile_cont(raw, {fixed.CONTAMINATION}) FROM raw_scores) AS score FROM raw_scores),
told AS (SELECT *, 1.0 - coalesce((score - (SELECT min(score) FROM decided))
  / nullif((SELECT max(score) - min(score) FROM decided), 0), 0) AS norm FROM decided)""")
    return ",".join(parts)


TOLD = (f"{n('CASE WHEN score < 0 THEN -1 ELSE 1 END', 'anomaly')}, {r('score', 'anomaly_score')}, {r('norm', 'anomaly_score_norm')}, "
        f"{bands('norm')} AS severity")


def oracle_sql() -> dict[str, str]:
    full, narrow = fixed.FEATURES["full"], fixed.FEATURES["narrow"]
    features = ", ".join(r(c) if c == "uppercase_ratio" else n(c) for c in full)
    days = reg.SCAN_SPAN.days
    in_scan = f"ts BETWEEN (SELECT max(ts) FROM timed) - INTERVAL {days} DAY AND (SELECT max(ts) FROM timed)"
    timed = f"timed AS (SELECT *, {PARSE} AS ts FROM src)"
    at = lambda share: f"(SELECT CAST(date_trunc('day', min(ts) + (max(ts) - min(ts)) * {share}) AS TIMESTAMP) FROM timed)"
    out: dict[str, str] = {}

    out["log_sources"] = after("src", f"SELECT event_id, {n('copy')}, stamp, message, host, original, log_file FROM src")
    out["message_clean"] = after("flat", f"""SELECT event_id, {n('copy')}, stamp, message, substring(message, 1, 200) AS message_short,
  host, log_file, 'log' AS input_type, 'collector' AS agent_name FROM flat""")
    live = strip(f"regexp_replace(message, {q(fixed.SYSLOG_PREFIX_LIVE)}, '')")
    out["message_clean_live"] = after("src", f"SELECT * FROM (SELECT event_id, {n('copy')}, {live} AS message FROM src) WHERE message <> ''")
    out["noise_filter"] = after("state", "SELECT " + ", ".join(
        [n("count(*)", "seen")] + [n(f"count(*) FILTER (state = '{s}')", s) for s in ("blank", "noise", "kept")]) + " FROM state")
    out["dedupe_logs"] = after("logs", "SELECT event_id, stamp, message, host, log_file FROM logs")
    out["incremental_scan"] = after("src", f"SELECT event_id, {n('copy')}, stamp, message FROM timed WHERE {in_scan}", timed)
    page = f"(row_number() OVER (ORDER BY ts, event_id, copy) - 1) // {fixed.SCAN_LIMIT}"
    out["scan_pages"] = after("src", f"SELECT event_id, {n('copy')}, stamp, {n(page, 'page')} FROM timed WHERE ts IS NOT NULL", timed)
    out["scan_cursors"] = after("src", f"""SELECT {n('step')}, {ts_text('ts', 'ts')}, event_id, {n('copy')}
FROM (SELECT *, {page} AS step FROM timed WHERE ts IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY step ORDER BY ts DESC, event_id DESC, copy DESC) = 1""", timed)

    def views(limit: int | None) -> str:
        cut = f" QUALIFY row_number() OVER (PARTITION BY view ORDER BY ts, event_id, copy) <= {limit}" if limit else ""
        return after("src", f"""SELECT event_id, copy, {ts_text('view', 'view')} FROM (
  SELECT event_id, {n('copy')}, ts, time_bucket(INTERVAL 15 SECOND, ts) + to_seconds(15 * k) AS view
  FROM timed, (SELECT unnest(range(1, 21)) AS k) WHERE ts IS NOT NULL{cut})""", timed)

    for name, limit in (("recent_windows", None), ("recent_windows_capped", fixed.LIVE_LIMIT), ("recent_windows_first", reg.VIEW_FIRST)):
        out[name] = views(limit)
    out["scan_lookback"] = after("src", f"""SELECT event_id, {n('copy')}, stamp FROM timed
WHERE ts >= (SELECT max(ts) FROM timed) - INTERVAL 10 MINUTE""", timed)
    out["next_mark"] = after("src", f"SELECT {ts_text('max(ts)', 'mark')} FROM timed", timed)
    out["recent_scan"] = after("src", f"""SELECT event_id, {n('copy')}, stamp FROM timed
WHERE ts >= (SELECT max(ts) FROM timed) - INTERVAL 5 MINUTE""", timed)

    out["log_features"] = after("featured", f"SELECT event_id, {features} FROM featured")
    out["narrow_features"] = after("logs", f"SELECT event_id, {text_columns('message', 'narrow')} FROM logs")
    out["time_fallback"] = after("featured", f"""SELECT event_id, 'timestamp' AS source, {n('hour')}, {n('day_of_week')} FROM featured
UNION ALL SELECT event_id, 'none', 0, 0 FROM featured""")
    out["document_features"] = f"""SELECT doc_id, {', '.join(r(c) if c == 'uppercase_ratio' else c for c in full[:7])}
FROM (SELECT doc_id, {text_columns("coalesce(text, '')")} FROM documents)"""
    out["document_frequency"] = f"SELECT doc_id, {n('count(*) OVER (PARTITION BY text)', 'message_frequency')} FROM documents"
    out["message_frequency"] = after("featured", "SELECT event_id, message_frequency FROM featured")

    out["label_contamination"] = f"""SELECT event_id, {n(f"CASE WHEN -value < (SELECT quantile_cont(-value, {fixed.CONTAMINATION}) FROM events) THEN -1 ELSE 1 END", 'anomaly')}
FROM events"""
    out["label_distribution"] = after("scored", f"SELECT {n('anomaly')}, {n('count(*)', 'n')} FROM scored GROUP BY anomaly")
    low = "(anomaly_score - min(anomaly_score) OVER ()) / nullif(max(anomaly_score) OVER () - min(anomaly_score) OVER (), 0)"
    out["score_norm"] = after("scored", f"SELECT event_id, {r('anomaly_score_norm')}, {r(low, 'low_norm')} FROM scored")
    out["severity_bands"] = after("scored", f"SELECT event_id, severity, {symbols('severity')} AS symbol FROM scored")
    out["severity_legacy"] = after("scored", f"SELECT event_id, {legacy('(anomaly_score / 1000)')} AS severity FROM scored")

    out["hourly_counts"] = after("scored", f"SELECT {n('hour')}, {n('anomalies')} FROM hourly", HOURLY)
    out["weekday_counts"] = after("scored", f"SELECT day_name, {n('anomalies')} FROM daily", DAILY)
    out["peak_hour"] = after("scored", f"SELECT {n('hour')}, {n('anomalies')} FROM hourly ORDER BY anomalies DESC, hour LIMIT 1", HOURLY)
    out["peak_day"] = after("scored", f"SELECT day_name, {n('anomalies')} FROM daily ORDER BY anomalies DESC, day_name LIMIT 1", DAILY)
    arrows = "CASE trend " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fixed.TREND_ARROWS.items()) + f" ELSE {q(fixed.OTHER_ARROW)} END AS arrow"
    out["trend_direction"] = after("scored", f"SELECT {n('hours')}, {r('slope')}, trend, {arrows} FROM trend", HOURLY, TREND)
    out["off_hours"] = after("scored", f"SELECT {n('count(*) FILTER (hour < 6)', 'off_hours')}, {n('count(*)', 'anomalies')} FROM hits")
    lines = [
        (0, f"SELECT printf({q(fixed.INSIGHT_PEAK_HOUR)}, hour, anomalies) AS text FROM (SELECT * FROM hourly ORDER BY anomalies DESC, hour LIMIT 1)"),
        (1, f"SELECT printf({q(fixed.INSIGHT_PEAK_DAY)}, day_name, anomalies) FROM (SELECT * FROM daily ORDER BY anomalies DESC, day_name LIMIT 1)"),
        (2, f"SELECT printf({q(fixed.INSIGHT_TREND)}, trend) FROM trend"),
        *[(3 + i, f"SELECT printf({q(fixed.INSIGHT_SEVERITY)}, {q(s)}, count(*)) FROM hits WHERE severity = {q(s)} HAVING count(*) > 0")
          for i, s in enumerate(fixed.SEVERITY_LEVELS[:4])],
        (7, f"SELECT printf({q(fixed.INSIGHT_OFF_HOURS)}, count(*)) FROM hits WHERE hour < 6 HAVING count(*) > 0"),
    ]
    out["trend_insights"] = after("scored", " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS ord, text FROM ({sql}) t(text)" for i, sql in lines), HOURLY, DAILY, TREND)

    out["basic_stats"] = after("scored", f"""SELECT {n('count(*)', 'total')}, {n('count(*) FILTER (anomaly = -1)', 'anomalies')},
  {n('count(*) FILTER (anomaly <> -1)', 'normal')}, {r('count(*) FILTER (anomaly = -1) / count(*)', 'rate')} FROM scored""")
    per = lambda f, label, col="anomaly_score": f"coalesce({f}({col}) FILTER (anomaly = {label}), 0)"
    out["score_stats"] = after("scored", "SELECT " + ", ".join([
        r(per("avg", -1), "score_anom_mean"), r(per("stddev_samp", -1), "score_anom_std"),
        r(per("avg", 1), "score_norm_mean"), r(per("stddev_samp", 1), "score_norm_std"),
        r("min(anomaly_score)", "score_min"), r("max(anomaly_score)", "score_max"),
        r(per("max", -1), "score_threshold"), r(per("avg", -1, "anomaly_score_norm"), "norm_score_mean"),
        r(per("max", -1, "anomaly_score_norm"), "norm_score_max")]) + " FROM scored")
    out["score_p95"] = after("scored", f"SELECT {r('coalesce(quantile_cont(anomaly_score_norm, 0.95), 0)', 'norm_score_p95')} FROM hits")
    out["confusion"] = after("scored", RATES, """pairs AS (SELECT anomaly = -1 AS hit,
  contains_error = 1 OR contains_login = 1 OR contains_warning = 1 AS weak FROM scored)""", CELLS)
    out["confusion_labels"] = "WITH pairs AS (SELECT quality = 0 AS hit, toxic = 1 AS weak FROM labels), " + CELLS + RATES
    out["feature_diff"] = after("scored", " UNION ALL ".join(
        f"SELECT {q(c)} AS feature, {r(f'abs(avg({c}) FILTER (anomaly = -1) - avg({c}) FILTER (anomaly = 1))', 'diff')} FROM scored" for c in full))
    edge = "(i * ((hi - lo) / 10) + lo)"
    out["score_histogram"] = after("scored", f"""SELECT {n('bin')}, {r('edge')}, {n('n')},
  repeat('█', CAST(floor(n / max(n) OVER () * 32) AS BIGINT)) AS bar
FROM (SELECT i + 1 AS bin, {edge} AS edge,
    (SELECT count(*) FROM hits WHERE (anomaly_score >= {edge} OR i = 0) AND (i = 9 OR anomaly_score < ((i + 1) * ((hi - lo) / 10) + lo))) AS n
  FROM (SELECT unnest(range(10)) AS i), (SELECT min(anomaly_score) AS lo, max(anomaly_score) AS hi FROM hits))""")
    out["severity_counts"] = after("scored", f"SELECT severity, {n('count(*)', 'n')}, repeat('█', least(count(*), 40)) AS bar FROM hits GROUP BY severity")
    out["severity_share"] = after("scored", f"""SELECT {n('ord')}, severity, {n('count(hits.event_id)', 'n')},
  {r('count(hits.event_id) / greatest((SELECT count(*) FROM hits), 1) * 100', 'pct')}
FROM levels LEFT JOIN hits USING (severity) GROUP BY ord, severity""", LEVELS)
    hot, warm = fixed.HEATMAP_CUTS
    base, gain = fixed.HEATMAP_OPACITY
    out["heatmap_24"] = after("scored", f"""SELECT {n('hour')}, {n('anomalies')}, {r('share')},
  CASE WHEN share > {hot} THEN 'hot' WHEN share > {warm} THEN 'warm' ELSE 'cool' END AS shade, {r(f'{base} + share * {gain}', 'opacity')}
FROM (SELECT h AS hour, coalesce(anomalies, 0) AS anomalies, coalesce(anomalies / nullif(max(anomalies) OVER (), 0), 0) AS share
  FROM (SELECT unnest(range(24)) AS h) LEFT JOIN hourly ON h = hour)""", HOURLY)
    rate = "(count(*) FILTER (anomaly = -1) / count(*))"
    out["validation_gate"] = after("scored", f"""SELECT {n(f'{rate} BETWEEN {fixed.GATE_LOW} AND {fixed.GATE_HIGH}', 'ok')}, {r(rate, 'rate')},
  CASE WHEN {rate} < {fixed.GATE_LOW} THEN printf('rate %.4f under {fixed.GATE_LOW}', {rate})
       WHEN {rate} > {fixed.GATE_HIGH} THEN printf('rate %.4f over {fixed.GATE_HIGH}', {rate})
       ELSE printf('rate %.4f (%d of %d)', {rate}, count(*) FILTER (anomaly = -1), count(*)) END AS reason FROM scored""")
    out["top_anomalies"] = after("scored", f"""SELECT substring(stamp, 1, 19) AS timestamp, severity, {symbols('severity')} AS symbol,
  printf('%.4f', anomaly_score_norm) AS score, {escape('substring(message, 1, 120)')} AS message
FROM (SELECT * FROM hits ORDER BY anomaly_score_norm DESC, event_id LIMIT 20)""")
    out["first_anomalies"] = after("scored", """SELECT event_id, stamp, severity, substring(message, 1, 100) AS message
FROM hits ORDER BY ts NULLS FIRST, event_id LIMIT 10""")
    out["html_escape"] = f"SELECT page_id, md5(h) AS digest, {n('length(h)', 'length')} FROM (SELECT page_id, {escape('html')} AS h FROM pages)"

    doc_fields = f"""{n('msg_length')}, {n('contains_error', 'error_flag')}, {n('contains_login', 'login_flag')},
  {n('contains_warning', 'warning_flag')}, {n('digit_count')}"""
    out["anomaly_docs"] = after("docs", f"""SELECT doc_id, iso AS timestamp, message, severity, {n('anomaly')}, {r('anomaly_score')}, {r('anomaly_score_norm')},
  {doc_fields}, {n('word_count')}, {n('hour')}, {n('day_of_week')}, substring(message, 1, 200) AS message_short FROM docs""")
    out["legacy_docs"] = after("docs", f"""SELECT doc_id, iso AS timestamp, message, {doc_fields}, {n('anomaly')}, {r('anomaly_score')},
  {legacy('anomaly_score')} AS severity FROM docs""")
    out["upsert_docs"] = after("docs", f"""SELECT doc_id, iso AS timestamp, message,
  {n(f"CASE WHEN ts >= {at(reg.MERGE_FROM)} THEN 2 ELSE 1 END", 'batch')} FROM docs""", timed)
    clock = ISO.replace("(ts,", "((SELECT max(ts) FROM timed),")
    out["alert_rows"] = after("scored", f"""SELECT md5({clock} || message) AS alert_id, {clock} AS timestamp, message,
  {r('anomaly_score / 1000', 'anomaly_score')}, {legacy('(anomaly_score / 1000)')} AS severity FROM scored""", timed)
    out["upsert_tally"] = after("scored", f"SELECT {n('count(ts)', 'uploaded')}, {n('count(*) - count(ts)', 'skipped')} FROM hits")
    out["rejected_rows"] = after("scored", "SELECT event_id, stamp, message FROM hits WHERE ts IS NULL")
    out["alert_cooldown"] = after("scored", f"SELECT severity, second, doc_id FROM sent", docs_of("scored", "every"), f"""
due AS (
  SELECT severity, CAST(floor(epoch(date_trunc('second', ts))) AS BIGINT) AS second, doc_id FROM every
  QUALIFY row_number() OVER (PARTITION BY severity, date_trunc('second', ts) ORDER BY anomaly_score_norm DESC, doc_id) = 1
),
sent AS (
  SELECT severity, second, doc_id FROM due QUALIFY row_number() OVER (PARTITION BY severity ORDER BY second) = 1
  UNION ALL
  SELECT severity, second, doc_id FROM (
    SELECT due.*, row_number() OVER (PARTITION BY due.severity ORDER BY due.second) AS rn
    FROM sent JOIN due ON due.severity = sent.severity AND due.second >= sent.second + {fixed.COOLDOWN_SECONDS}) WHERE rn = 1
)""")
    out["alert_text"] = after("docs", f"""SELECT doc_id, {symbols('severity')} || ' Log alert' || chr(10) || 'Severity: ' || severity || chr(10)
  || printf('Score: %.4f', anomaly_score_norm) || chr(10) || 'Time: ' || iso || chr(10) || 'Message: ' || substring(message, 1, 400) AS text
FROM docs WHERE severity IN ('CRITICAL', 'HIGH')""")

    window = "time_bucket(INTERVAL 10 MINUTE, ts)"
    out["bruteforce_10m"] = after("logs", f"""SELECT ip, {ts_text(window, 'window_start')}, {n('count(*)', 'failures')} FROM failed
WHERE ip IS NOT NULL AND ts IS NOT NULL GROUP BY ip, {window} HAVING count(*) >= 3""", FAILED)
    out["login_sources"] = after("logs", f"""SELECT ip, {n('count(*)', 'failures')}, {ts_text('min(ts)', 'first_seen')}, {ts_text('max(ts)', 'last_seen')}
FROM failed WHERE ip IS NOT NULL GROUP BY ip""", FAILED)
    out["port_scan"] = after("logs", f"""SELECT src, {ts_text(window, 'window_start')}, {n('count(DISTINCT port)', 'ports')} FROM blocked
WHERE ts IS NOT NULL GROUP BY src, {window} HAVING count(DISTINCT port) >= 3""", BLOCKED)
    first, second = (f"CAST(split_part(src, '.', {i}) AS INT)" for i in (1, 2))
    out["blocked_sources"] = after("logs", f"""SELECT src, {n('count(*)', 'blocked')}, {n('count(DISTINCT port)', 'ports')},
  {n(f"NOT ({first} = 10 OR ({first} = 172 AND {second} BETWEEN 16 AND 31) OR ({first} = 192 AND {second} = 168))", 'external')}
FROM blocked GROUP BY src""", BLOCKED)
    health = "CASE " + " ".join(f"WHEN regexp_matches(message, {q(p.removeprefix('(?i)'))}, 'i') THEN {q(c)}" for c, p in reg.security.HEALTH) + " END"
    out["health_categories"] = after("logs", f"""SELECT category, {n('count(*)', 'n')}, {n('count(DISTINCT host)', 'hosts')}
FROM (SELECT *, {health} AS category FROM logs) WHERE category IS NOT NULL GROUP BY category""")
    out["template_patterns"] = after("logs", f"SELECT {TEMPLATE} AS template, {n('count(*)', 'n')} FROM logs GROUP BY 1")
    out["day_over_day"] = after("scored", with_previous("per", "day", "1 DAY"),
                                "per AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM hits WHERE ts IS NOT NULL GROUP BY 1)")
    out["cycle_delta"] = after("scored", with_previous("per", "cycle", "5 MINUTE"),
                               "per AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS cycle, count(*) AS n FROM hits WHERE ts IS NOT NULL GROUP BY 1)")
    out["sliding_5m_15s"] = after("logs", f"""SELECT {ts_text('w', 'window_start')}, {n('count(*)', 'n')}
FROM (SELECT time_bucket(INTERVAL 15 SECOND, ts) - to_seconds(15 * k) AS w FROM logs, (SELECT unnest(range(20)) AS k) WHERE ts IS NOT NULL)
GROUP BY w""")
    out["last_hour_summary"] = after("scored", summary("ts > (SELECT max(ts) FROM scored) - INTERVAL 1 HOUR"))
    out["severity_today"] = after("scored", summary("ts > (SELECT max(ts) FROM scored) - INTERVAL 24 HOUR"))
    out["critical_today"] = after("scored", f"""SELECT event_id, stamp, message, {r('anomaly_score_norm')} FROM scored
WHERE anomaly_score_norm > (SELECT avg(anomaly_score_norm) FROM scored) AND ts >= (SELECT date_trunc('day', max(ts)) FROM scored)""")
    out["most_severe_per_day"] = after("scored", f"""SELECT strftime(ts, '%Y-%m-%d') AS date, event_id, severity, {r('anomaly_score_norm')} FROM hits
WHERE ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY anomaly_score_norm DESC, ts, event_id) = 1""")
    out["impact"] = after("scored", f"""SELECT {n('count(*)', 'anomalies')}, {r('max(anomaly_score_norm)', 'max_score')},
  {r('avg(anomaly_score_norm)', 'avg_score')}, {r("coalesce(count(*) FILTER (severity = 'CRITICAL') * 100.0 / nullif(count(*), 0), 0)", 'critical_pct')} FROM hits""")
    out["next_bucket"] = after("scored", f"""SELECT {n('buckets')}, {r('slope')}, {r('intercept')}, {r('next')}, {r('intercept + slope * next', 'expected')}
FROM (SELECT count(*) AS buckets, regr_slope(n, x) AS slope, regr_intercept(n, x) AS intercept, max(x) + 1 AS next
  FROM (SELECT b - min(b) OVER () AS x, n FROM (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS b, count(*) AS n FROM hits WHERE ts IS NOT NULL GROUP BY 1)))""")

    vocab = f"SELECT {n('idx')}, term, {n('tf')}, {n('df')}, {r('idf')} FROM vocab"
    out["tfidf_vocab"] = "WITH " + vocabulary(fixed.MIN_DF, True) + vocab
    out["tfidf_vocab_plain"] = "WITH " + vocabulary(1, False) + vocab
    out["tfidf_weights"] = "WITH " + vocabulary(fixed.MIN_DF, True) + f"""
SELECT doc_id, term, {r('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))', 'weight')}
FROM (SELECT doc_id, term, (1 + ln(tf.tf)) * idf AS w FROM tf JOIN vocab USING (term))"""
    out["bm25_search"] = f"WITH {ASKED},\n{bm25('documents', ['text', 'lang'], 'doc_id')}\nSELECT qid, {n('rank')}, {r('score')}, doc_id FROM best"
    line = "iso || ' | ' || severity || ' | ' || message AS line"
    out["search_fallback"] = after("docs", f"""SELECT qid, {n('rank')}, {r('score')}, {line} FROM best
UNION ALL
SELECT qid, {n('rank')}, 0.0 AS score, {line} FROM asked, (SELECT *, row_number() OVER (ORDER BY iso, doc_id) AS rank FROM docs) f
WHERE rank <= {fixed.FALLBACK_K} AND qid NOT IN (SELECT qid FROM best)""", ASKED, bm25("docs", ["message", "severity"], "iso, doc_id"))
    out["intent_class"] = f"SELECT conv_id, turn, {intent('text')} AS intent FROM conversations"
    out["log_intents"] = after("logs", f"SELECT event_id, {intent('message')} AS intent FROM logs")
    out["small_talk"] = f"SELECT conv_id, turn, {n(strip('lower(text)') + ' IN (' + ', '.join(q(s) for s in fixed.SMALL_TALK) + ')', 'small_talk')} FROM conversations"
    out["last3_memory"] = f"WITH {ASKED} SELECT conv_id, turn, coalesce(memory, '') AS memory FROM remembered"
    found = f"""retrieved AS (
  SELECT qid, rank, {line} FROM best
  UNION ALL
  SELECT qid, rank, {line} FROM asked, (SELECT *, row_number() OVER (ORDER BY iso, doc_id) AS rank FROM docs) f
  WHERE rank <= {fixed.FALLBACK_K} AND qid NOT IN (SELECT qid FROM best)),
context AS (SELECT qid, string_agg(line, chr(10) ORDER BY rank) AS context FROM retrieved GROUP BY qid),
answer AS (
  SELECT string_agg(ord || '. ' || substring(message, 1, 150), chr(10) ORDER BY ord) AS answer
  FROM (SELECT *, row_number() OVER (ORDER BY anomaly_score_norm DESC, event_id) AS ord FROM hits) WHERE ord <= 5)"""
    hinted = "CASE intent " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in HINTS.items()) + " ELSE '' END"
    out["retrieval_prompt"] = after("docs", f"""SELECT qid, intent, CASE WHEN intent = 'logs' THEN (SELECT answer FROM answer) END AS answer,
  CASE WHEN intent <> 'logs' THEN 'Earlier questions:' || chr(10) || coalesce(nullif(memory, ''), 'None') || chr(10) || 'Logs:' || chr(10)
    || coalesce(context, '') || chr(10) || 'Question:' || chr(10) || text || CASE WHEN {hinted} = '' THEN '' ELSE chr(10) || {hinted} END END AS prompt
FROM remembered LEFT JOIN context USING (qid)""", ASKED, bm25("docs", ["message", "severity"], "iso, doc_id"), found)
    out["direct_logs"] = after("scored", f"""SELECT {n('ord')}, ord || '. ' || substring(message, 1, 150) AS line
FROM (SELECT *, row_number() OVER (ORDER BY anomaly_score_norm DESC, event_id) AS ord FROM hits) WHERE ord <= 5""")
    hint = "CASE intent " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in HINTS.items()) + " ELSE '' END"
    out["prompt_table"] = after("scored", f"""SELECT conv_id, turn, text, intent, {n('small_talk')}, hint, memory, context,
  'Earlier questions:' || chr(10) || memory || chr(10) || 'Logs:' || chr(10) || context || chr(10) || 'Question:' || chr(10) || text
  || CASE WHEN hint = '' THEN '' ELSE chr(10) || hint END AS prompt
FROM (SELECT conv_id, turn, text, intent, small_talk, {hint} AS hint, coalesce(nullif(memory, ''), 'None') AS memory,
  (SELECT string_agg(message, chr(10) ORDER BY anomaly_score_norm DESC, event_id) FROM (SELECT * FROM hits ORDER BY anomaly_score_norm DESC, event_id LIMIT 5)) AS context
  FROM remembered)""", ASKED)

    out["dominant_severity"] = after("scored", f"""SELECT host, {n('sum(n)', 'size')}, first(severity ORDER BY n DESC, severity) AS dominant_severity
FROM (SELECT host, severity, count(*) AS n FROM scored GROUP BY host, severity) GROUP BY host""")
    out["sample_messages"] = after("scored", """SELECT host, string_agg(message, chr(10) ORDER BY rn) AS sample_msgs
FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts NULLS FIRST, event_id) AS rn FROM scored) WHERE rn <= 3 GROUP BY host""")
    out["model_versions"] = after("scored", f"""SELECT tag, path, {n('ok')}, {r('rate')}, reason,
  {n('coalesce(tag = (SELECT max(tag) FROM registry WHERE ok), false)', 'latest')} FROM registry ORDER BY tag DESC LIMIT {fixed.KEEP_VERSIONS}""", VERSIONS)
    out["rollback_target"] = after("scored", "SELECT tag, path FROM registry WHERE ok ORDER BY tag DESC LIMIT 1", VERSIONS)
    def ready(table: str, name: str, newest: str | None) -> str:
        last = f"coalesce(CAST(max({newest}) AS VARCHAR), 'none')" if newest else "'none'"
        seen = f"CAST(max({newest}) IS NOT NULL AS BIGINT)" if newest else "CAST(0 AS BIGINT)"
        return f"""SELECT '{name} not empty' AS name, CAST(count(*) > 0 AS BIGINT) AS ok, count(*) || ' rows' AS detail, CAST(1 AS BIGINT) AS critical FROM {table}
UNION ALL SELECT '{name} columns', 1, 'all present', 1
UNION ALL SELECT '{name} newest', {seen}, {last}, 0""" + (f" FROM {table}" if newest else "")

    inputs = " UNION ALL ".join(ready(*x) for x in [
        ("timed", "sources", "ts"), ("logs", "logs", "ts"), ("scored", "scored", "ts"), ("docs", "documents", None),
        ("vocab", "vocabulary", None), ("(SELECT * FROM registry WHERE ok)", "accepted versions", None)])
    out["readiness_checks"] = after("docs", inputs, timed, VERSIONS, vocabulary(fixed.MIN_DF, True))
    out["readiness_overall"] = after("docs", f"SELECT min(ok) AS ok FROM ({inputs}) WHERE critical = 1", timed, VERSIONS, vocabulary(fixed.MIN_DF, True))

    out["scored_batches"] = after("scored", f"""SELECT event_id, {n(f'coalesce(ts >= {at(0.5)}, false)', 'batch_id')}, {r('anomaly_score')} FROM scored""", timed)
    out["anomaly_table"] = after("scored", f"SELECT event_id, stamp, message, {n('anomaly')}, severity FROM hits")
    out["log_table_csv"] = after("logs", "SELECT stamp, message, host, log_file FROM logs")
    out["vocabulary_saved"] = out["tfidf_weights"]
    terms = vocabulary(fixed.MIN_DF, True).replace("FROM documents", "FROM featured").replace("doc_id", "event_id").replace("lower(text)", "lower(message)")
    out["feature_matrix"] = after("featured", f"""SELECT event_id, {n('place')}, {r('value')} FROM (
  SELECT event_id, unnest(range({len(full)})) AS place, CAST(unnest([{', '.join(full)}]) AS DOUBLE) AS value FROM featured
  UNION ALL
  SELECT event_id, idx + {len(full)}, w / sqrt(sum(w * w) OVER (PARTITION BY event_id))
  FROM (SELECT event_id, idx, (1 + ln(tf.tf)) * idf AS w FROM tf JOIN vocab USING (term))) WHERE value <> 0""", terms)
    matrix = f"""
matrix AS (SELECT md5(concat_ws('|', stamp, message)) AS key, event_id,
  list_concat([{', '.join(f'CAST({c} AS DOUBLE)' for c in full)}], coalesce(weights, list_transform(range((SELECT count(*) FROM vocab)), lambda k: 0.0))) AS x
FROM featured LEFT JOIN (
  SELECT event_id, list(coalesce(w, 0.0) ORDER BY idx) AS weights FROM (SELECT event_id, idx FROM (SELECT DISTINCT event_id FROM tf), vocab)
  LEFT JOIN (SELECT event_id, idx, w / sqrt(sum(w * w) OVER (PARTITION BY event_id)) AS w
    FROM (SELECT event_id, idx, (1 + ln(tf.tf)) * idf AS w FROM tf JOIN vocab USING (term))) USING (event_id, idx) GROUP BY event_id) USING (event_id))"""
    out["iforest_scores"] = after("featured", f"SELECT event_id, {TOLD} FROM told JOIN matrix USING (key)", terms, matrix, forest("matrix", "x"))
    out["iforest_embeddings"] = ("WITH vectors AS (SELECT vec_id, label, CAST(vec_id AS VARCHAR) AS key, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), "
                                 + forest("vectors", "x") + f" SELECT v.* EXCLUDE (key, x), {TOLD} FROM told JOIN vectors v USING (key)")
    out["frequency_of_repeats"] = f"SELECT conv_id, turn, {n('CASE WHEN text IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY text) END', 'n')} FROM conversations"
    out["no_trend"] = f"SELECT CAST(0 AS BIGINT) AS ord, {q(fixed.INSIGHT_EMPTY)} AS text"
    plain = vocabulary(1, False).replace("FROM documents", "FROM scored").replace("doc_id", "event_id").replace("lower(text)", "lower(message)")
    out["cluster_keywords"] = after("scored", f"""SELECT host, {n('rank')}, term, {r('weight')} FROM (
  SELECT host, term, round(sum(w) / size, 9) AS weight, row_number() OVER (PARTITION BY host ORDER BY round(sum(w) / size, 9) DESC, term) AS rank
  FROM (SELECT host, term, w / sqrt(sum(w * w) OVER (PARTITION BY event_id)) AS w
        FROM (SELECT event_id, term, (1 + ln(tf.tf)) * idf AS w FROM tf JOIN vocab USING (term)) JOIN scored USING (event_id))
  JOIN (SELECT host, count(*) AS size FROM scored GROUP BY host) USING (host) GROUP BY host, size, term) WHERE rank <= 8""", plain)
    out["cluster_checks"] = "SELECT name, CAST(1 AS BIGINT) AS ok FROM (VALUES ('sizes'), ('keywords'), ('cost'), ('nearest'), ('saved')) t(name)"
    # All distances from the hosts' mean weights, by products of the sparse rows.
    near = """
unit AS (SELECT event_id, idx, term, w / sqrt(sum(w * w) OVER (PARTITION BY event_id)) AS w
  FROM (SELECT event_id, idx, term, (1 + ln(tf.tf)) * idf AS w FROM tf JOIN vocab USING (term))),
centre AS (SELECT host, idx, term, round(sum(w) / size, 9) AS c FROM unit JOIN scored USING (event_id)
  JOIN (SELECT host, count(*) AS size FROM scored GROUP BY host) USING (host) GROUP BY host, size, idx, term),
centres AS (SELECT host, row_number() OVER (ORDER BY host) - 1 AS cluster, sum(c * c) AS cc FROM centre GROUP BY host),
dots AS (SELECT event_id, host, sum(w * c) AS xy FROM unit JOIN centre USING (idx) GROUP BY event_id, host),
lengths AS (SELECT event_id, sum(w * w) AS xx FROM unit GROUP BY event_id),
placed AS (
  SELECT event_id, cluster, round(coalesce(xx, 0) + cc - 2 * coalesce(xy, 0), 9) AS distance
  FROM (SELECT DISTINCT event_id FROM scored) CROSS JOIN centres LEFT JOIN dots USING (event_id, host) LEFT JOIN lengths USING (event_id)
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY round(coalesce(xx, 0) + cc - 2 * coalesce(xy, 0), 9), cluster) = 1)"""
    out["cluster_assignment"] = after("scored", f"SELECT event_id, {n('cluster')}, {r('distance')} FROM placed", plain, near)
    summary_text = f"printf({q(fixed.CLUSTER_SUMMARY)}, cluster_id, size, array_to_string(keywords[1:5], ', '), dominant_severity)"
    out["cluster_summaries_given"] = after("scored", f"""SELECT {n('cluster_id')}, {n('size')}, array_to_string(keywords, chr(10)) AS top_keywords,
  sample_msgs, dominant_severity, {summary_text} AS summary FROM (
  SELECT *, row_number() OVER (ORDER BY size DESC, keywords, cluster) - 1 AS cluster_id
  FROM words JOIN sizes USING (cluster) JOIN samples USING (cluster))""", plain, near, """
mine AS (SELECT hits.*, cluster FROM hits JOIN placed USING (event_id)),
words AS (
  SELECT cluster, list(term ORDER BY c DESC, term)[1:8] AS keywords
  FROM (SELECT cluster, vocab.term, coalesce(c, 0) AS c FROM centres CROSS JOIN vocab LEFT JOIN centre ON centre.host = centres.host AND centre.idx = vocab.idx)
  GROUP BY cluster),
sizes AS (SELECT cluster, sum(n) AS size, first(severity ORDER BY n DESC, severity) AS dominant_severity
  FROM (SELECT cluster, severity, count(*) AS n FROM mine GROUP BY ALL) GROUP BY cluster),
samples AS (SELECT cluster, string_agg(message, chr(10) ORDER BY rn) AS sample_msgs
  FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY ts NULLS FIRST, event_id) AS rn FROM mine) WHERE rn <= 3 GROUP BY cluster)""")
    judged = f"""
judged AS (SELECT count(*) AS total, count(*) FILTER (score < 0) AS anomalies, count(*) FILTER (score < 0) / count(*) AS rate FROM told),
listed AS (SELECT '2024010' || k || '_000000' AS tag, total, anomalies, rate, rate BETWEEN {fixed.GATE_LOW} AND {fixed.GATE_HIGH} AS ok
  FROM (SELECT unnest(range(3, 8)) AS k), judged)"""
    out["retrained"] = after("featured", f"""SELECT tag, {n('ok')}, {r('rate')}, CASE WHEN ok THEN printf('rate %.4f (%d of %d)', rate, anomalies, total)
  WHEN rate < {fixed.GATE_LOW} THEN printf('rate %.4f under {fixed.GATE_LOW}', rate) ELSE printf('rate %.4f over {fixed.GATE_HIGH}', rate) END AS reason,
  {n("ok AND tag = '20240107_000000'", 'latest')}, {n("ok AND tag = '20240107_000000'", 'in_use')} FROM listed""", terms, matrix, forest("matrix", "x"), judged)
    out["rollback_history"] = after("scored", f"""SELECT {n('row_number() OVER (ORDER BY step, tag) - 1', 'seq')}, action, tag,
  {n('tag = (SELECT min(tag) FROM accepted)', 'in_use')} FROM (
  SELECT 1 AS step, 'publish' AS action, tag FROM accepted WHERE tag < (SELECT tag FROM cut)
  UNION ALL SELECT 2, 'rollback', (SELECT tag FROM accepted WHERE tag < (SELECT tag FROM cut) ORDER BY tag DESC LIMIT 1 OFFSET 1)
  UNION ALL SELECT 3, 'publish', tag FROM accepted WHERE tag >= (SELECT tag FROM cut)
  UNION ALL SELECT 4, 'rollback', min(tag) FROM accepted)""", VERSIONS, """
accepted AS (SELECT tag FROM registry WHERE ok),
cut AS (SELECT min(tag) AS tag FROM (SELECT tag FROM registry ORDER BY tag DESC LIMIT 2))""")

    out["stream_replay"] = after("flat", f"""SELECT {ts_text('cycle', 'cycle')}, {n('count(*)', 'n')}
FROM (SELECT time_bucket(INTERVAL 5 MINUTE, {PARSE}) AS cycle FROM flat WHERE {PARSE} IS NOT NULL) GROUP BY cycle""")
    out["stream_late"] = after("src", f"""SELECT {ts_text('cycle', 'cycle')}, {n('count(*)', 'n')}
FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS cycle FROM timed WHERE ts IS NOT NULL) GROUP BY cycle""", timed)
    out["stream_sliding"] = after("flat", f"""SELECT {ts_text('w', 'window_start')}, {n('count(*)', 'n')}
FROM (SELECT time_bucket(INTERVAL 15 SECOND, {PARSE}) - to_seconds(15 * k) AS w FROM flat, (SELECT unnest(range(20)) AS k) WHERE {PARSE} IS NOT NULL)
GROUP BY w""")
    out["stream_repeats"] = after("flat", f"SELECT DISTINCT stamp, message FROM flat WHERE {PARSE} IS NOT NULL")
    out["stream_upsert"] = out["anomaly_docs"]
    out["stream_alerts"] = out["alert_cooldown"].replace("FROM scored WHERE ts IS NOT NULL", "FROM hits WHERE ts IS NOT NULL AND severity IN ('CRITICAL', 'HIGH')")
    out["stream_cooldown"] = out["alert_cooldown"]
    chunk = " + ".join(f"CAST(coalesce(ts >= {at(k / reg.CHUNKS)}, false) AS BIGINT)" for k in range(1, reg.CHUNKS))
    rows = f"flat AS (SELECT * FROM (SELECT event_id, copy, user_id, event_type, value, stamp, host, log_file, {live} AS message FROM src) WHERE message <> '')"
    out["stream_live_top"] = "WITH RECURSIVE" + ",".join([SRC, rows, LOGS, FEATURED, SCORED, DOCS, timed]) + f"""
SELECT {n('chunk', 'batch_id')}, {n('rank')}, doc_id, severity FROM (
  SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY anomaly_score_norm DESC, doc_id) AS rank FROM (SELECT *, {chunk} AS chunk FROM docs)) WHERE rank <= 5"""
    return out
