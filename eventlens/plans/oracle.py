"""The registered queries in ANSI-style SQL, run by DuckDB as a check.

The statements are written independently of the operators: they spell out the
semantics with plain windows, joins and CASE expressions.
"""

from __future__ import annotations

from eventlens.functions.embedding import hash_embedder
from eventlens.plans import settings as S
from eventlens.sources.tables import DAY_MS, NOW_MS

_EV = """
ev AS (
  SELECT lpad(event_id::VARCHAR, 26, '0') AS event_id,
         'user.' || user_id AS source_id,
         event_type || CASE WHEN event_id % 10 = 0 THEN '@v2' ELSE '' END AS kind,
         (epoch_us(ts) // 1000) AS ts_ms_utc,
         props AS semantic,
         (epoch_us(ts) // 1000) + (event_id % 7) * 1000 AS ingest_ts_ms_utc
  FROM events)"""

_COPIES = """
copied AS (
  SELECT * FROM ev
  UNION ALL
  SELECT event_id, source_id, kind, ts_ms_utc, '{"copy":true}', ingest_ts_ms_utc + 60000
  FROM ev WHERE right(event_id, 1) IN ('0', '5'))"""

_VEC = """
vec AS (
  SELECT ev.event_id, source_id, kind, ts_ms_utc, embedding
  FROM embeddings JOIN ev ON ev.event_id =
    lpad((vec_id * 7919 % (SELECT count(*) FROM events))::VARCHAR, 26, '0'))"""

_SRC = f"""
src AS (
  SELECT DISTINCT user_id AS u, 'user.' || user_id AS source_id,
         CASE WHEN user_id % 3 = 0 THEN ['click', 'view', 'unheard']
              ELSE ['click', 'error', 'purchase', 'signup', 'view'] END AS kinds,
         CASE WHEN user_id % 2 = 0 THEN 'User ' || user_id ELSE '' END AS description,
         CASE WHEN user_id % 5 = 0 THEN '{{"type":"object"}}' END AS semantic_schema,
         CASE WHEN user_id % 4 = 0 THEN 'count' END AS units,
         CASE WHEN user_id % 2 = 0 THEN (user_id % 10 + 1) * {DAY_MS // 2} END AS ttl,
         CASE WHEN user_id % 7 = 0 THEN user_id % 2 = 0 END AS embed
  FROM events),
knd AS (
  SELECT DISTINCT event_type AS name, 'v1' AS version, 'Kind ' || event_type AS description,
         CASE WHEN event_type = 'error' THEN 'noisy' ELSE '' END AS caveats,
         CASE WHEN event_type = 'view' THEN '{{"required":["k"]}}' END AS semantic_schema,
         CASE WHEN event_type = 'purchase' THEN 'EUR' END AS units,
         CASE WHEN event_type IN ('click', 'view') THEN true
              WHEN event_type = 'error' THEN false END AS embed
  FROM events),
listed AS (SELECT *, unnest(kinds) AS kind FROM src),
dsc AS (
  SELECT l.source_id, l.kind, 'v1' AS kind_version,
         CASE WHEN l.description <> '' THEN l.description
              ELSE coalesce(k.description, '') END AS description,
         CASE WHEN k.name IS NULL THEN '' ELSE 'read only' END AS usage,
         coalesce(k.caveats, '') AS caveats,
         coalesce(l.semantic_schema, k.semantic_schema) AS semantic_schema,
         coalesce(l.units, k.units) AS units,
         1000::BIGINT AS sampling_hint_ms, ttl AS freshness_ttl_ms,
         NULL::VARCHAR AS location
  FROM listed l LEFT JOIN knd k ON k.name = l.kind)"""

_LATEST = """
latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY source_id, kind
             ORDER BY ts_ms_utc DESC, ingest_ts_ms_utc, event_id) AS rn FROM ev)
  WHERE rn = 1)"""

_HOT = """
hot AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY source_id, kind
             ORDER BY ingest_ts_ms_utc DESC, event_id DESC) AS rn FROM {rows})
  WHERE rn = 1)"""

_RING = f"""
ring AS (
  SELECT * EXCLUDE (rn, newest) FROM (
    SELECT *, row_number() OVER (PARTITION BY source_id, kind
                ORDER BY ingest_ts_ms_utc DESC, event_id DESC) AS rn,
           max(ingest_ts_ms_utc) OVER (PARTITION BY source_id, kind) AS newest
    FROM ev)
  WHERE rn <= {S.RING_EVENTS} AND ingest_ts_ms_utc >= newest - {S.RING_AGE_MS})"""

_STATE = (
    _EV + "," + _SRC + "," + _LATEST + ","
    + _HOT.format(rows=f"ev WHERE ingest_ts_ms_utc >= {S.RECENT_MS}")
    + f""",
st AS (
  SELECT d.source_id, d.kind, coalesce(h.event_id, c.event_id) AS event_id,
         coalesce(h.ts_ms_utc, c.ts_ms_utc) AS ts_ms_utc,
         {NOW_MS} - coalesce(h.ts_ms_utc, c.ts_ms_utc) AS age_ms,
         coalesce({NOW_MS} - coalesce(h.ts_ms_utc, c.ts_ms_utc) > freshness_ttl_ms, false)
           AS stale,
         h.event_id IS NULL AS from_cold, description, NULL::VARCHAR AS peer_id
  FROM dsc d
  LEFT JOIN hot h ON h.source_id = d.source_id AND h.kind = d.kind
  LEFT JOIN latest c ON c.source_id = d.source_id AND c.kind = d.kind
  WHERE coalesce(h.event_id, c.event_id) IS NOT NULL)"""
)

_CHECK = """
k AS (SELECT *, split_part(kind, '@', 1) AS name, (semantic->>'$.k')::INT AS v FROM ev),
checked AS (
  SELECT event_id, source_id, kind, ts_ms_utc,
         CASE WHEN CASE
           WHEN source_id = 'user.3' THEN v IS NULL OR v > 50
           WHEN kind IN ('click', 'click@v2') THEN v IS NULL OR v < 20
           WHEN kind = 'error' THEN json_extract(semantic, '$.code') IS NULL
           END THEN true END AS schema_invalid
  FROM k)"""

_LIMITS = f"""
lim AS (
  SELECT *,
    CASE WHEN bare = 'click' THEN {20 * DAY_MS} ELSE {25 * DAY_MS} END AS max_age_ms,
    CASE WHEN source_id = 'user.1' THEN 3 WHEN bare = 'click' THEN 5 END AS max_count,
    CASE WHEN source_id = 'user.2' AND bare = 'view' THEN 60 ELSE 70 END AS max_bytes,
    CASE WHEN bare = 'error' THEN {5 * DAY_MS} ELSE {15 * DAY_MS} END AS vector_max_age_ms
  FROM (SELECT *, split_part(kind, '@', 1) AS bare FROM {{rows}}))"""

_EV_LIMITS = _EV + "," + _LIMITS.format(rows="ev")

_HOT_LIMITS = (
    _EV
    + f""",
lim AS (
  SELECT * REPLACE ('user.all' AS source_id),
    CASE WHEN kind LIKE 'click%' THEN {25 * DAY_MS} ELSE {10 * DAY_MS} END AS max_age_ms,
    CASE WHEN kind LIKE 'click%' THEN 300 ELSE 400 END AS max_count,
    CASE WHEN kind LIKE 'view%' THEN 3000 ELSE 5000 END AS max_bytes
  FROM ev)"""
)

_DROPS = f""",
aged AS (SELECT *, ts_ms_utc < {NOW_MS} - max_age_ms AS by_age FROM lim),
ranked AS (
  SELECT *, row_number() OVER w AS rn FROM aged WHERE NOT by_age
  WINDOW w AS (PARTITION BY source_id, kind ORDER BY ts_ms_utc DESC, event_id DESC)),
counted AS (SELECT *, coalesce(rn > max_count, false) AS by_count FROM ranked),
sized AS (
  SELECT *, sum(length(semantic)) OVER (PARTITION BY source_id, kind
           ORDER BY ts_ms_utc DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS size
  FROM counted WHERE NOT by_count),
drops AS (
  SELECT event_id, source_id, kind, 'age' AS drop_reason FROM aged WHERE by_age
  UNION ALL SELECT event_id, source_id, kind, 'count' FROM counted WHERE by_count
  UNION ALL SELECT event_id, source_id, kind, 'bytes' FROM sized WHERE size > max_bytes),
kept AS (SELECT * FROM ev WHERE event_id NOT IN (SELECT event_id FROM drops))"""

_SWEEP = _EV_LIMITS + _DROPS

_VEC_DROPS = (
    _VEC
    + ","
    + _LIMITS.format(rows="vec").replace("lim AS", "vlim AS", 1)
    + f""",
vdrops AS (SELECT event_id, source_id, kind FROM vlim
           WHERE ts_ms_utc < {NOW_MS} - vector_max_age_ms)"""
)

_REPORT = """
SELECT source_id, kind, sum(e)::BIGINT AS events_dropped, sum(v)::BIGINT AS vectors_dropped,
       any_value(max_age_ms)::BIGINT AS max_age_ms, any_value(max_count)::BIGINT AS max_count,
       any_value(max_bytes)::BIGINT AS max_bytes,
       any_value(vector_max_age_ms)::BIGINT AS vector_max_age_ms
FROM (SELECT source_id, kind, n AS e, 0 AS v FROM dropped_events
      UNION ALL SELECT source_id, kind, 0, 1 FROM vdrops) x
JOIN (SELECT DISTINCT source_id, kind, max_age_ms, max_count, max_bytes, vector_max_age_ms
      FROM lim) l USING (source_id, kind)
GROUP BY source_id, kind HAVING sum(e) + sum(v) > 0"""

_PARSED = f"""
SELECT conv_id, turn, o.ord, 'chat.' || role AS source_id, 'message' AS kind,
       {NOW_MS} + conv_id * 400 + turn AS ts_ms_utc,
       json_object('text', text)::VARCHAR AS semantic
FROM conversations JOIN (VALUES (0, 0::BIGINT), (0, 1), (1, 0), (5, 0), (6, 0)) o(shape, ord)
  ON (conv_id + turn) % 7 = o.shape"""

_CHAT = f"""
chat AS (
  SELECT conv_id AS batch_id, turn AS ord, 'edge' || conv_id % 3 AS token_name,
         {NOW_MS} + conv_id * 400 AS at_ms,
         lpad(conv_id::VARCHAR, 20, '0') || lpad(turn::VARCHAR, 6, '0') AS event_id,
         'chat.' || role AS source_id, 'message' AS kind,
         {NOW_MS} + conv_id * 400 + turn AS ts_ms_utc,
         json_object('text', text)::VARCHAR AS semantic,
         strlen(text) + 2 + 4 + 4 + 2 AS size
  FROM conversations)"""

_ADMIT = (
    _CHAT
    + f""",
judged AS (
  SELECT *, CASE
      WHEN NOT CASE token_name WHEN 'edge0' THEN true
                 WHEN 'edge1' THEN source_id IN ('chat.user', 'chat.assistant')
                 ELSE source_id = 'chat.user' END THEN 'unauthorized'
      WHEN size > {S.HARD_CAP} THEN 'payload_too_large' END AS bad
  FROM chat),
verdict AS (
  SELECT batch_id, any_value(token_name) AS token_name, any_value(at_ms) AS at_ms,
         count(*) AS events, min(ord) FILTER (bad IS NOT NULL) AS fail_ord,
         arg_min(bad, ord) FILTER (bad IS NOT NULL) AS reason,
         arg_min(source_id, ord) FILTER (bad IS NOT NULL) AS source_id
  FROM judged GROUP BY batch_id),
audit AS (
  SELECT v.*, (SELECT count(*) FROM judged j WHERE j.batch_id = v.batch_id AND bad IS NULL
                AND size > {S.SOFT_CAP} AND (fail_ord IS NULL OR ord < fail_ord)) AS soft
  FROM verdict v)"""
)

_MSG = """
msg AS (
  SELECT event_id AS message_no, 'broker' || event_id % 2 AS broker_id, event_type AS et,
         user_id AS u, event_id % 7 = 0 AS extra, event_id, props,
         CASE event_type
           WHEN 'view' THEN user_id || ',"a""b",' || props
           WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN '{"type":42}'
                                     ELSE '{"type":"buy"}' END
           ELSE props END AS body,
         (epoch_us(ts) // 1000) AS ts_ms
  FROM events),
routed AS (
  SELECT *, CASE
      WHEN et = 'view' THEN 'ok' WHEN extra THEN 'unmatched'
      WHEN et = 'purchase' AND event_id % 3 = 0 THEN 'decode_failed' ELSE 'ok' END AS outcome
  FROM msg)"""

_HEX = "lower(hex(encode(body)))"
_B64 = "rtrim(base64(encode(body)), '=')"
_CSV = """'{"encoding":"csv","fields":' || to_json([u::VARCHAR, 'a"b', props]) || '}'"""

_WS = (
    r"[\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
    r"\x{202f}\x{205f}\x{3000}]+"
)


def _embedded(name: str, rows: str) -> str:
    """CTEs giving ``name(id, idx, value)``: normalised hash vectors of texts."""
    return f"""
{name}_tok AS (
  SELECT id, tok, strlen(tok) AS len, sha256(tok) AS h
  FROM (SELECT id, unnest(regexp_split_to_array(text, '{_WS}')) AS tok FROM ({rows}))
  WHERE tok <> ''),
{name}_sum AS (
  SELECT id, (i + len) % 64 AS idx,
         sum(2 * ('0x' || substr(h, (2 * i + 1)::INT, 2))::INT - 255)::BIGINT AS s
  FROM {name}_tok, range(32) r(i) GROUP BY ALL),
{name}_norm AS (SELECT id, sqrt(sum(s * s)::DOUBLE) AS norm FROM {name}_sum GROUP BY id),
{name} AS (
  SELECT d.id, g.idx::INT AS idx,
         CASE WHEN coalesce(norm, 0) > 0 THEN coalesce(s, 0) / norm ELSE 0 END::FLOAT AS value
  FROM ({rows}) d CROSS JOIN range(64) g(idx)
  LEFT JOIN {name}_sum USING (id, idx) LEFT JOIN {name}_norm USING (id))"""


def _utf8_prefix(column: str, n: int) -> str:
    """Longest prefix of at most n bytes: characters counted by their bytes."""
    return f"""CASE WHEN strlen({column}) <= {n} THEN {column} ELSE (
      SELECT substr({column}, 1, max(p)::INT) FROM range({n // 4}, {n + 1}) r(p)
      WHERE strlen(substr({column}, 1, p::INT)) <= {n} AND p <= length({column})) END"""


def _search(flt: str, limit: int) -> str:
    q = ", ".join(repr(float(x)) for x in hash_embedder().embed_text(S.QUERY_TEXT))
    return f"""
hits AS (
  SELECT event_id, source_id, kind, ts_ms_utc, false AS truncated,
         list_dot_product(embedding::DOUBLE[], [{q}]::DOUBLE[]) AS raw
  FROM vec WHERE {flt} ORDER BY raw DESC, event_id LIMIT {limit})"""


def _window(rows: str, order: bool, limit: int, offset: int = 0) -> str:
    tail = f"ORDER BY ts_ms_utc, event_id LIMIT {limit} OFFSET {offset}" if order else ""
    return f"WITH {_EV} SELECT * FROM ev WHERE {rows} {tail}"


_WEEK = (
    f"ts_ms_utc >= {S.WEEK.start_ms} AND ts_ms_utc < {S.WEEK.end_ms} "
    "AND source_id GLOB 'user.1*' AND kind = 'click'"
)
_GLOBBED = (
    f"ts_ms_utc >= {S.GLOBBED.start_ms} AND ts_ms_utc < {S.GLOBBED.end_ms} "
    "AND (source_id GLOB 'user.?[05]' OR source_id IN ('user.12', 'user.13')) "
    "AND (kind GLOB 'view*' OR kind = 'error')"
)

_SEQ = f"""WITH {_EV}
SELECT event_id, source_id, ingest_ts_ms_utc,
       row_number() OVER (PARTITION BY source_id ORDER BY ingest_ts_ms_utc, event_id) AS seq
FROM ev"""

_ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _ulid(label: str) -> str:
    text = (
        f"'{label}' || chr(31) || source_id || chr(31) || ts_ms_utc || chr(31) || semantic "
        "|| chr(31) || batch_id || chr(31) || ord"
    )
    return f"""(
    SELECT string_agg(substr('{_ALPHABET}', (({NOW_MS}::BIGINT >> (5 * i)::INT) & 31)::INT + 1, 1),
                      '' ORDER BY i DESC) FROM range(10) r(i)) || (
    SELECT string_agg(substr('{_ALPHABET}',
        ((('0x' || substr(sha256({text}), (5 * g + 1)::INT, 5))::BIGINT >> (5 * i)::INT)
         & 31)::INT + 1, 1), '' ORDER BY g, i DESC)
    FROM range(4) a(g), range(4) b(i))"""


ORACLE: dict[str, str] = {
    "window_scan": _window(_WEEK, True, 100),
    "window_glob": _window(_GLOBBED, True, 10_000),
    "window_page2": _window(_WEEK, True, 100, 100),
    "window_all": _window(_GLOBBED, False, 0),
    "count_events": "SELECT count(*) AS n FROM events",
    "count_pair": f"WITH {_EV} SELECT count(*) AS n FROM ev "
    "WHERE source_id = 'user.7' AND kind = 'click'",
    "distinct_pairs": f"WITH {_EV} SELECT DISTINCT source_id, kind FROM ev",
    "get_by_id": f"WITH {_EV} SELECT * FROM ev WHERE event_id IN "
    "(SELECT lpad((vec_id * 7919 % (SELECT count(*) FROM events))::VARCHAR, 26, '0') "
    "FROM embeddings)",
    "kind_refs": f"""WITH {_EV}
SELECT kind, split_part(kind, '@', 1) AS name, nullif(split_part(kind, '@', 2), '') AS version,
       count(*) AS n FROM ev GROUP BY ALL""",
    "daily_partition": f"""WITH {_EV}
SELECT strftime(make_timestamp(ts_ms_utc * 1000), '%Y-%m-%d') AS day, count(*) AS n
FROM ev GROUP BY 1""",
    "latest_event_time": f"WITH {_EV}, {_LATEST} SELECT * FROM latest",
    "hot_latest": f"WITH {_EV}, {_HOT.format(rows='ev')} SELECT * FROM hot",
    "hot_window": f"WITH {_EV}, {_RING} SELECT * FROM ring",
    "hot_snapshot_counts": f"""WITH {_EV}, {_RING}
SELECT source_id, kind, count(*) AS n,
       arg_min(event_id, (ingest_ts_ms_utc, event_id)) AS oldest,
       arg_max(event_id, (ingest_ts_ms_utc, event_id)) AS newest
FROM ring GROUP BY source_id, kind""",
    "hot_keys": f"WITH {_EV}, {_RING} SELECT DISTINCT source_id, kind FROM ring",
    "current_state": f"WITH {_STATE} SELECT * FROM st",
    "stale_sources": f"""WITH {_STATE}
SELECT source_id, count(*) AS stale_kinds, max(age_ms) AS oldest_ms
FROM st WHERE stale GROUP BY source_id""",
    "resolve_descriptors": f"WITH {_SRC} SELECT * FROM dsc",
    "describe_sources": f"""WITH {_EV}, {_SRC}, {_CHECK},
err AS (SELECT source_id, count(*) AS schema_errors, max(ts_ms_utc) AS last_error
        FROM checked WHERE schema_invalid GROUP BY source_id),
{_LIMITS.format(rows="dsc")}
SELECT source_id, kind, kind_version, description, schema_errors, last_error,
       max_age_ms::BIGINT AS max_age_ms, max_count::BIGINT AS max_count,
       max_bytes::BIGINT AS max_bytes, vector_max_age_ms::BIGINT AS vector_max_age_ms,
       NULL::VARCHAR AS peer_id
FROM lim LEFT JOIN err USING (source_id)""",
    "parse_payloads": _PARSED,
    "parse_rejects": """
SELECT CASE (conv_id + turn) % 7 WHEN 2 THEN 'invalid event' WHEN 3 THEN 'no events in payload'
       ELSE 'invalid JSON' END AS reason, count(*) AS n
FROM conversations WHERE (conv_id + turn) % 7 IN (2, 3, 4) GROUP BY 1""",
    "admit_batches": f"""WITH {_ADMIT}
SELECT batch_id, ord, event_id, source_id FROM chat
WHERE batch_id IN (SELECT batch_id FROM verdict WHERE reason IS NULL)""",
    "rejected_events": f"""WITH {_ADMIT}
SELECT batch_id, ord, event_id, reason
FROM chat JOIN (SELECT batch_id, reason FROM verdict) USING (batch_id)
WHERE reason IS NOT NULL""",
    "batch_shed_summary": f"""WITH {_ADMIT}
SELECT token_name, reason, count(*) AS batches, sum(events)::BIGINT AS events,
       sum(soft)::BIGINT AS soft_oversize FROM audit GROUP BY token_name, reason""",
    "recent_errors": f"""WITH {_ADMIT},
r AS (SELECT source_id, reason, count(*) AS n, max(at_ms) AS t FROM audit
      WHERE reason IS NOT NULL GROUP BY 1, 2)
SELECT source_id, reason, n, max(t) OVER (PARTITION BY source_id) AS last_error_ts_ms_utc
FROM r""",
    "ingest_counters": f"""WITH {_ADMIT}, {_MSG},
ok AS (SELECT * FROM chat WHERE batch_id IN (SELECT batch_id FROM verdict WHERE reason IS NULL))
SELECT 'accepted' AS counter, NULL::VARCHAR AS label, count(*)::BIGINT AS n FROM ok
UNION ALL SELECT 'accepted_by_token', token_name, count(*) FROM ok GROUP BY token_name
UNION ALL SELECT 'shed_by_reason', reason, count(*) FROM audit
  WHERE reason IS NOT NULL GROUP BY reason
UNION ALL SELECT 'shed_by_token', token_name, count(*) FROM audit
  WHERE reason IS NOT NULL GROUP BY token_name
UNION ALL SELECT 'oversized_soft', NULL, sum(soft) FROM audit
UNION ALL SELECT 'schema_invalid', NULL, 0
UNION ALL SELECT 'routed_' || outcome, broker_id, count(*) FROM routed
  GROUP BY outcome, broker_id""",
    "size_audit": f"""WITH {_CHAT}
SELECT source_id, count(*) AS events, sum(size)::BIGINT AS estimated_bytes,
       sum(strlen(semantic))::BIGINT AS json_bytes,
       count(*) FILTER (size > {S.SOFT_CAP}) AS over_soft,
       count(*) FILTER (size > {S.HARD_CAP}) AS over_hard
FROM chat GROUP BY source_id""",
    "normalize_seq": _SEQ,
    "normalize_seq_ranges": f"""WITH {_EV}
SELECT event_id, 'user.all' AS source_id, ingest_ts_ms_utc,
       row_number() OVER (ORDER BY ingest_ts_ms_utc, event_id) AS seq FROM ev""",
    "generated_ids": f"""WITH {_CHAT}
SELECT batch_id, ord, source_id,
       row_number() OVER (PARTITION BY source_id ORDER BY batch_id, ord) AS seq,
       {_ulid("event_id")} AS event_id, {_ulid("trace_id")} AS trace_id
FROM chat""",
    "validate_semantic": f"WITH {_EV}, {_CHECK} "
    "SELECT event_id, source_id, kind, schema_invalid FROM checked",
    "latest_kind_version": """
SELECT DISTINCT event_type AS name, CASE event_type WHEN 'click' THEN 'v2' ELSE 'v1' END AS version
FROM events""",
    "dedupe_first": f"""WITH {_EV}, {_COPIES}
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ingest_ts_ms_utc) AS rn FROM copied)
WHERE rn = 1""",
    "append_new": f"WITH {_EV} SELECT * FROM ev WHERE ts_ms_utc >= {S.WEEK.end_ms}",
    "upsert_last": f"""WITH {_EV}, {_VEC}
SELECT event_id, source_id,
       CASE WHEN right(event_id, 1) IN ('0', '5') THEN 'rewritten' ELSE kind END AS kind,
       right(event_id, 1) IN ('0', '5') AS truncated, len(embedding)::INT AS width
FROM vec""",
    "append_bucketed": f"WITH {_EV} SELECT *, strftime(make_timestamp(ts_ms_utc * 1000), '%Y-%m-%d') AS day FROM ev",
    "lookup_stored": f"WITH {_EV} SELECT * FROM ev WHERE event_id IN "
    "(SELECT lpad((vec_id * 7919 % (SELECT count(*) FROM events))::VARCHAR, 26, '0') "
    "FROM embeddings)",
    "sweep_execute": f"""WITH {_SWEEP}
SELECT event_id, source_id, kind, strftime(make_timestamp(ts_ms_utc * 1000), '%Y-%m-%d') AS day FROM kept""",
    "sweep_execute_counts": f"""WITH {_SWEEP}
SELECT strftime(make_timestamp(ts_ms_utc * 1000), '%Y-%m-%d') AS day, count(*) AS events, count(drops.event_id) AS dropped
FROM ev LEFT JOIN drops USING (event_id) GROUP BY day HAVING count(drops.event_id) > 0""",
    "upsert_repeated": f"""WITH {_EV}, {_VEC}
SELECT event_id, source_id, CASE WHEN right(event_id, 1) IN ('0', '5') THEN 'rewritten' ELSE kind END AS kind,
       right(event_id, 1) IN ('0', '5') AS truncated, len(embedding)::INT AS width FROM vec""",
    "sweep_vectors_execute": f"""WITH {_EV}, rewritten AS (
  SELECT event_id, source_id, CASE WHEN right(event_id, 1) IN ('0', '5') THEN 'rewritten' ELSE kind END AS kind, ts_ms_utc, embedding
  FROM (SELECT ev.event_id, source_id, kind, ts_ms_utc, embedding FROM embeddings JOIN ev ON ev.event_id =
    lpad((vec_id * 7919 % (SELECT count(*) FROM events))::VARCHAR, 26, '0'))), {_LIMITS.format(rows="rewritten")}
SELECT event_id, source_id, kind FROM lim WHERE ts_ms_utc >= {NOW_MS} - vector_max_age_ms""",
    "route_messages": f"""WITH {_MSG}
SELECT CASE et WHEN 'click' THEN 'click.' || u
         WHEN 'view' THEN 'view/user/' || u || CASE WHEN extra THEN '/extra' ELSE '' END
         WHEN 'error' THEN 'error.' || u WHEN 'signup' THEN 'user.' || u
         ELSE 'purchase.' || u END AS source_id,
       CASE et WHEN 'purchase' THEN 'buy' ELSE et END AS kind, ts_ms AS ts_ms_utc,
       CASE et WHEN 'click' THEN replace(body, ' ', '') WHEN 'view' THEN {_CSV}
         WHEN 'error' THEN '{{"encoding":"hex","hex":"' || {_HEX} || '"}}'
         WHEN 'signup' THEN '{{"bytes_base64":"' || {_B64} || '","encoding":"raw"}}'
         ELSE body END AS semantic,
       message_no, broker_id
FROM routed WHERE outcome = 'ok'""",
    "route_outcomes": f"WITH {_MSG} SELECT broker_id, outcome, count(*) AS n FROM routed "
    "GROUP BY broker_id, outcome",
    "decode_hex": f"""WITH {_MSG}
SELECT message_no, '{{"encoding":"hex","hex":"' || {_HEX} || '"}}' AS semantic FROM msg""",
    "decode_raw": f"""WITH {_MSG}
SELECT message_no, '{{"bytes_base64":"' || {_B64} || '","encoding":"raw"}}' AS semantic
FROM msg""",
    "decode_csv": f"""WITH {_MSG}
SELECT message_no, CASE WHEN et = 'view' THEN {_CSV}
  ELSE '{{"encoding":"csv","fields":' || to_json([body]) || '}}' END AS semantic FROM msg""",
    "decode_json": f"""WITH {_MSG}
SELECT message_no, CASE WHEN et <> 'view' THEN replace(body, ' ', '') END AS semantic
FROM msg""",
    "effective_retention_many": f"""WITH {_EV}, pairs AS (
  SELECT DISTINCT source_id, kind, split_part(kind, '@', 1) AS bare, split_part(source_id, '.', 2)::INT AS u FROM ev)
SELECT source_id, kind,
       (CASE WHEN u % 2 = 0 AND bare = 'view' THEN u + 1 END)::BIGINT AS max_age_ms,
       (u % 7 + 1)::BIGINT AS max_count,
       CASE WHEN bare = 'click' THEN 9 END::BIGINT AS max_bytes,
       NULL::BIGINT AS vector_max_age_ms FROM pairs""",
    "admit_many_tokens": f"""WITH {_EV}
SELECT event_id, source_id, kind FROM ev
WHERE split_part(source_id, '.', 2)::INT % 3 <> 0 AND kind LIKE 'v%'""",
    "rate_limit_turns": f"""WITH RECURSIVE passed AS (
  SELECT conv_id * 1000 + turn AS batch_id, 'edge' || conv_id % 3 AS token_name,
         {NOW_MS} + conv_id * 400 + turn // 2 * 50 AS at_ms FROM conversations),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY token_name ORDER BY at_ms, batch_id) AS n,
         CASE token_name WHEN 'edge0' THEN 1 WHEN 'edge2' THEN 2 END AS burst,
         CASE token_name WHEN 'edge0' THEN 1000000000 WHEN 'edge2' THEN 30000000000 END AS step
  FROM passed),
walk AS (
  SELECT token_name, n, batch_id, at_ms, true AS allowed, at_ms * 1000000 + step AS due
  FROM numbered WHERE n = 1 AND step IS NOT NULL
  UNION ALL
  SELECT x.token_name, x.n, x.batch_id, x.at_ms,
         greatest(w.due, x.at_ms * 1000000) + x.step - x.at_ms * 1000000 <= x.burst * x.step,
         CASE WHEN greatest(w.due, x.at_ms * 1000000) + x.step - x.at_ms * 1000000 <= x.burst * x.step
              THEN greatest(w.due, x.at_ms * 1000000) + x.step ELSE w.due END
  FROM walk w JOIN numbered x ON x.token_name = w.token_name AND x.n = w.n + 1)
SELECT batch_id, token_name, at_ms, allowed FROM walk
UNION ALL SELECT batch_id, token_name, at_ms, true FROM numbered WHERE step IS NULL""",
    "rate_limit": f"""WITH RECURSIVE {_ADMIT},
numbered AS (
  SELECT batch_id, token_name, at_ms,
         row_number() OVER (PARTITION BY token_name ORDER BY at_ms, batch_id) AS n,
         CASE token_name WHEN 'edge0' THEN 1 WHEN 'edge2' THEN 2 END AS burst,
         CASE token_name WHEN 'edge0' THEN 1000000000 WHEN 'edge2' THEN 30000000000 END AS step
  FROM audit WHERE reason IS NULL),
walk AS (
  SELECT token_name, n, batch_id, at_ms, true AS allowed, at_ms * 1000000 + step AS due
  FROM numbered WHERE n = 1 AND step IS NOT NULL
  UNION ALL
  SELECT x.token_name, x.n, x.batch_id, x.at_ms,
         greatest(w.due, x.at_ms * 1000000) + x.step - x.at_ms * 1000000 <= x.burst * x.step,
         CASE WHEN greatest(w.due, x.at_ms * 1000000) + x.step - x.at_ms * 1000000 <= x.burst * x.step
              THEN greatest(w.due, x.at_ms * 1000000) + x.step ELSE w.due END
  FROM walk w JOIN numbered x ON x.token_name = w.token_name AND x.n = w.n + 1)
SELECT batch_id, token_name, at_ms, allowed FROM walk
UNION ALL SELECT batch_id, token_name, at_ms, true FROM numbered WHERE step IS NULL""",
    "effective_retention": f"""WITH {_EV_LIMITS}
SELECT DISTINCT source_id, kind, max_age_ms::BIGINT AS max_age_ms,
       max_count::BIGINT AS max_count, max_bytes::BIGINT AS max_bytes,
       vector_max_age_ms::BIGINT AS vector_max_age_ms FROM lim""",
    "sweep_age": f"""WITH {_EV_LIMITS}
SELECT event_id, source_id, kind, ts_ms_utc, semantic, ingest_ts_ms_utc FROM lim
WHERE ts_ms_utc < {NOW_MS} - max_age_ms""",
    "sweep_count": f"""WITH {_EV_LIMITS}
SELECT event_id, source_id, kind, ts_ms_utc, semantic, ingest_ts_ms_utc FROM (
  SELECT *, row_number() OVER (PARTITION BY source_id, kind
           ORDER BY ts_ms_utc DESC, event_id DESC) AS rn FROM lim) WHERE rn > max_count""",
    "sweep_bytes": f"""WITH {_EV_LIMITS}
SELECT event_id, source_id, kind, ts_ms_utc, semantic, ingest_ts_ms_utc FROM (
  SELECT *, sum(length(semantic)) OVER (PARTITION BY source_id, kind
           ORDER BY ts_ms_utc DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS size FROM lim)
WHERE size > max_bytes""",
    "sweep_reasons": f"WITH {_SWEEP} SELECT * FROM drops",
    "sweep_reasons_ranges": f"WITH {_HOT_LIMITS}{_DROPS} SELECT * FROM drops",
    "sweep_survivors": f"WITH {_SWEEP} SELECT source_id, kind, count(*) AS n FROM kept "
    "GROUP BY source_id, kind",
    "sweep_report": f"""WITH {_SWEEP}, {_VEC_DROPS},
dropped_events AS (SELECT source_id, kind, 1 AS n FROM drops)
{_REPORT}""",
    "sweep_dry_run": f"""WITH {_EV_LIMITS}, {_VEC_DROPS},
w AS (
  SELECT *, row_number() OVER p AS rn, sum(length(semantic)) OVER p AS size FROM lim
  WINDOW p AS (PARTITION BY source_id, kind ORDER BY ts_ms_utc DESC, event_id DESC
               ROWS UNBOUNDED PRECEDING)),
dropped_events AS (
  SELECT source_id, kind, (ts_ms_utc < {NOW_MS} - max_age_ms)::INT
         + coalesce(rn > max_count, false)::INT + (size > max_bytes)::INT AS n FROM w)
{_REPORT}""",
    "sweep_warnings": f"""WITH {_EV},
{_LIMITS.format(rows="(SELECT * REPLACE ('user.all' AS source_id) FROM ev)")},
c AS (SELECT source_id, kind, max_count, max_bytes, count(*) AS rows FROM lim GROUP BY ALL)
SELECT source_id, kind, 'max_count' AS "limit", rows FROM c
WHERE max_count IS NOT NULL AND rows > 1000
UNION ALL SELECT source_id, kind, 'max_bytes', rows FROM c
WHERE max_bytes IS NOT NULL AND rows > 1000""",
    "sweep_vectors": f"WITH {_EV}, {_VEC_DROPS} SELECT * FROM vdrops",
    "orphan_vectors": f"""WITH {_SWEEP}, {_VEC}
SELECT event_id, source_id, kind FROM vec WHERE event_id NOT IN (SELECT event_id FROM kept)""",
    "select_embed": f"""WITH {_EV}, {_SRC}
SELECT e.event_id, e.source_id, e.kind
FROM ev e LEFT JOIN src s ON s.source_id = e.source_id
LEFT JOIN knd k ON k.name = split_part(e.kind, '@', 1)
WHERE coalesce(s.embed, k.embed, false)""",
    "truncate_text": f"""
SELECT doc_id, {_utf8_prefix("text", 2048)} AS text, strlen(text) > 2048 AS truncated
FROM documents""",
    "hash_embed": f"""WITH {_embedded("e", "SELECT doc_id AS id, text FROM documents")}
SELECT id AS doc_id, idx, round(value::DOUBLE, 5) AS value FROM e""",
    "embed_events": f"""WITH {_CHAT},
{_embedded("e", "SELECT event_id AS id, semantic AS text FROM chat")}
SELECT id AS event_id, false AS truncated, 'hash-sha256-64' AS model_id, idx,
       round(value::DOUBLE, 5) AS value FROM e""",
    "search_topk": f"""WITH {_EV}, {_VEC}, {_search("true", 20)}
SELECT * EXCLUDE (raw), round(raw, 5) AS score FROM hits""",
    "search_top200": f"""WITH {_EV}, {_VEC}, {_search("true", 200)}
SELECT * EXCLUDE (raw), round(raw, 5) AS score FROM hits""",
    "search_filtered": f"""WITH {_EV}, {_VEC}, {_search(
        f"ts_ms_utc >= {S.NEARBY.start_ms} AND ts_ms_utc < {S.NEARBY.end_ms} "
        "AND source_id GLOB 'user.*' AND kind IN ('click', 'view', 'view@v2')", 50)}
SELECT * EXCLUDE (raw), round(raw, 5) AS score FROM hits""",
    "search_hydrated": f"""WITH {_SWEEP}, {_VEC}, {_search("true", 50)}
SELECT k.*, round(raw, 5) AS score, truncated
FROM hits JOIN kept k USING (event_id)""",
    "search_many": f"""WITH
{_embedded("d", "SELECT doc_id AS id, text FROM documents")},
{_embedded("q", "SELECT item_id AS id, text FROM benchmark")},
dv AS (SELECT id, list(value::DOUBLE ORDER BY idx) AS v FROM d GROUP BY id),
qv AS (SELECT id, list(value::DOUBLE ORDER BY idx) AS v FROM q GROUP BY id),
s AS (SELECT qv.id AS query_id, dv.id AS doc_id, list_dot_product(qv.v, dv.v) AS raw
      FROM qv CROSS JOIN dv),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, doc_id)::INT AS rank
      FROM s)
SELECT query_id, rank, lpad(doc_id::VARCHAR, 26, '0') AS event_id, lang AS kind,
       round(raw, 5) AS score
FROM r JOIN documents USING (doc_id) WHERE rank <= 3""",
    "stream_seq": _SEQ,
    "stream_normalize": f"""WITH p AS ({_PARSED})
SELECT source_id, ts_ms_utc, semantic, {NOW_MS}::BIGINT AS ingest_ts_ms_utc,
       row_number() OVER (PARTITION BY source_id ORDER BY conv_id, turn, ord) AS seq FROM p""",
    "stream_append": f"""WITH {_EV}
SELECT event_id, source_id, kind, ts_ms_utc, semantic, ingest_ts_ms_utc,
       strftime(make_timestamp(ts_ms_utc * 1000), '%Y-%m-%d') AS day FROM ev""",
    "stream_dedupe": f"WITH {_EV} SELECT event_id, source_id, kind FROM ev",
    "stream_latest": f"WITH {_EV}, {_LATEST} SELECT * FROM latest",
    "stream_ring": f"WITH {_EV}, {_RING} SELECT * FROM ring",
    "stream_embed": f"""WITH {_EV}, {_SRC}
SELECT e.event_id, e.source_id, e.kind, false AS truncated, 64::INT AS width
FROM ev e LEFT JOIN src s ON s.source_id = e.source_id
LEFT JOIN knd k ON k.name = split_part(e.kind, '@', 1)
WHERE coalesce(s.embed, k.embed, false)""",
    "stream_forward": f"""WITH {_EV}
SELECT event_id, 'kitchen.' || source_id AS source_id, kind, ts_ms_utc, semantic FROM ev""",
    "stream_progress": f"""WITH {_EV}
SELECT sink, 2::BIGINT AS batches, (SELECT count(*) FROM ev)::BIGINT AS rows,
       0::BIGINT AS errors FROM (VALUES ('log'), ('forward')) s(sink)""",
    "federated_state": f"""WITH {_EV}, {_LATEST}
SELECT source_id, kind, event_id, ts_ms_utc, NULL::VARCHAR AS peer_id FROM latest
UNION ALL
SELECT 'site.' || source_id, kind, event_id, ts_ms_utc, 'hub' FROM latest
WHERE source_id GLOB 'user.1*'""",
    "federated_paths": f"""WITH {_EV}, {_LATEST}
SELECT source_id, kind, event_id, ts_ms_utc, NULL::VARCHAR AS peer_id FROM latest
UNION ALL
SELECT 'site.' || source_id, kind, event_id, ts_ms_utc, 'hub' FROM latest
WHERE source_id GLOB 'user.1*'""",
    "federated_status": """SELECT peer_id, status
FROM (VALUES ('hub', 'ok'), ('gone', 'error'), ('torn', 'error')) s(peer_id, status)""",
    "forward_projection": f"""WITH {_EV}
SELECT event_id, 'kitchen.' || source_id AS source_id, kind, ts_ms_utc, semantic FROM ev""",
}
ORACLE["stream_rate_limit"] = ORACLE["rate_limit_turns"]  # the same rule, whatever the micro-batches are


_INGEST = f"""
events_in AS (
  SELECT p.conv_id * 1000 + p.turn AS batch_id, p.ord, 'edge' || p.conv_id % 3 AS token_name,
         {NOW_MS} + p.conv_id * 400 + p.turn // 2 * 50 AS at_ms, p.source_id, p.kind, p.ts_ms_utc, p.semantic,
         c.text, strlen(c.text) + 12 AS size
  FROM ({_PARSED}) p JOIN conversations c USING (conv_id, turn)),
judged AS (
  SELECT *, CASE
      WHEN NOT CASE token_name WHEN 'edge0' THEN true
                 WHEN 'edge1' THEN source_id IN ('chat.user', 'chat.assistant')
                 ELSE source_id = 'chat.user' END THEN 'unauthorized'
      WHEN size > {S.HARD_CAP} THEN 'payload_too_large' END AS bad
  FROM events_in),
verdict AS (
  SELECT batch_id, any_value(token_name) AS token_name, any_value(at_ms) AS at_ms,
         arg_min(bad, ord) FILTER (bad IS NOT NULL) AS reason, arg_min(source_id, ord) FILTER (bad IS NOT NULL) AS source_id
  FROM judged GROUP BY batch_id),
turned AS (
  SELECT *, row_number() OVER (PARTITION BY token_name ORDER BY at_ms, batch_id) AS n,
         CASE token_name WHEN 'edge0' THEN 1 WHEN 'edge2' THEN 2 END AS burst,
         CASE token_name WHEN 'edge0' THEN 1000000000 WHEN 'edge2' THEN 30000000000 END AS step
  FROM verdict WHERE reason IS NULL),
walk AS (
  SELECT token_name, n, batch_id, true AS allowed, at_ms * 1000000 + step AS due FROM turned WHERE n = 1 AND step IS NOT NULL
  UNION ALL
  SELECT x.token_name, x.n, x.batch_id,
         greatest(w.due, x.at_ms * 1000000) + x.step - x.at_ms * 1000000 <= x.burst * x.step,
         CASE WHEN greatest(w.due, x.at_ms * 1000000) + x.step - x.at_ms * 1000000 <= x.burst * x.step
              THEN greatest(w.due, x.at_ms * 1000000) + x.step ELSE w.due END
  FROM walk w JOIN turned x ON x.token_name = w.token_name AND x.n = w.n + 1),
let_in AS (SELECT batch_id FROM walk WHERE allowed UNION ALL SELECT batch_id FROM turned WHERE step IS NULL),
done AS (
  SELECT e.*, at_ms AS ingest_ts_ms_utc, row_number() OVER (PARTITION BY source_id ORDER BY at_ms, batch_id, ord) AS seq,
         CASE WHEN length(text) > CASE source_id WHEN 'chat.user' THEN 100 ELSE 150 END THEN true END AS schema_invalid
  FROM events_in e WHERE batch_id IN (SELECT batch_id FROM let_in)),
errors_in AS (
  SELECT source_id, reason, at_ms FROM verdict WHERE reason IS NOT NULL
  UNION ALL SELECT source_id, 'rate_limit', at_ms FROM events_in WHERE batch_id IN (SELECT batch_id FROM walk WHERE NOT allowed)
  UNION ALL SELECT source_id, 'schema_invalid', at_ms FROM done WHERE schema_invalid)"""
_IN = "source_id, kind, ts_ms_utc, semantic, ingest_ts_ms_utc, seq, schema_invalid"

ORACLE |= {
    "ingest_chain": f"WITH RECURSIVE {_INGEST} SELECT batch_id, ord, {_IN} FROM done",
    "stream_ingest_chain": f"WITH RECURSIVE {_INGEST} SELECT {_IN} FROM done",
    "describe_errors": f"""WITH RECURSIVE {_INGEST}
SELECT source_id, reason, count(*) AS n, max(max(at_ms)) OVER (PARTITION BY source_id) AS last_error_ts_ms_utc
FROM errors_in GROUP BY source_id, reason""",
    "read_payload_files": f"SELECT source_id, kind, ts_ms_utc, semantic FROM ({_PARSED})",
}

_DESCRIBED = "kind, kind_version, description, freshness_ttl_ms"
ORACLE |= {
    "federated_describe": f"""WITH {_SRC}
SELECT source_id, {_DESCRIBED}, NULL::VARCHAR AS peer_id FROM dsc WHERE source_id GLOB 'user.1*'
UNION ALL SELECT 'site.' || source_id, {_DESCRIBED}, 'hub' FROM dsc WHERE source_id GLOB 'user.2*'""",
    "federated_describe_status": "SELECT * FROM (VALUES ('hub', 'ok'), ('gone', 'error'), ('late', 'timeout')) v(peer_id, status)",
}

ORACLE["validate_declared"] = f"""WITH {_EV},
k AS (SELECT *, substr(source_id, 6)::INT AS u, (semantic->>'$.k')::INT AS v FROM ev)
SELECT event_id, source_id, kind,
       CASE WHEN CASE WHEN u % 3 <> 0 THEN v IS NULL OR v < u % 60 WHEN u % 5 = 0 THEN false
                      WHEN kind = 'view' THEN v IS NULL ELSE false END THEN true END AS schema_invalid
FROM k"""

ORACLE["window_pages"] = f"""WITH {_EV}, seen AS (
  SELECT event_id, ts_ms_utc, row_number() OVER (ORDER BY ts_ms_utc, event_id) - 1 AS n FROM ev WHERE {_GLOBBED})
SELECT n // 200 AS page, n % 200 AS place, event_id, ts_ms_utc FROM seen"""
