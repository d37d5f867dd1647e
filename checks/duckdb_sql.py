"""Equivalent DuckDB SQL for the registered queries, written over whole sessions."""

from __future__ import annotations

EVENTS = """
ev AS (
  SELECT user_id AS session, event_id, CAST(round_even(epoch_us(ts) / 1000.0, 0) AS BIGINT) AS ts_ms, event_type,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CAST(floor(value) AS BIGINT) AS v,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq
  FROM events),
e0 AS (
  SELECT *, CASE event_type WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'C' ELSE 'S' END
                 WHEN 'view' THEN 'M' WHEN 'click' THEN 'T' WHEN 'error' THEN 'R' ELSE 'K' END AS role
  FROM ev),
e AS (
  SELECT *, CASE WHEN role IN ('S','C') THEN CAST(k % 3 AS VARCHAR) END AS eid,
         CASE WHEN role IN ('T','R') THEN CAST(k % 10 AS VARCHAR) END AS call,
         role = 'R' AND k % 4 = 0 AS failed,
         CASE WHEN role = 'K' THEN v END AS amount
  FROM e0)"""

OWNED = EVENTS + """,
o0 AS (
  SELECT *, max(CASE WHEN role = 'T' THEN seq END) OVER (PARTITION BY session, call ORDER BY seq) AS lt,
         min(seq) OVER (PARTITION BY session, call) AS f
  FROM e),
o AS (
  SELECT * EXCLUDE (lt, f), CASE WHEN call IS NOT NULL THEN coalesce(lt, f) END AS owner,
         role = 'M' OR coalesce(call IS NOT NULL AND coalesce(lt, f) = seq, false) AS creates
  FROM o0)"""

TURNS = OWNED + """,
t0 AS (
  SELECT *, creates OR role IN ('S','C') AS touch,
         coalesce(sum(CASE WHEN role = 'C' THEN 1 ELSE 0 END) OVER (
           PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg
  FROM o),
t1 AS (
  SELECT *, coalesce(sum(CASE WHEN touch THEN 1 ELSE 0 END) OVER w, 0) = 0 AS fresh,
         last_value(eid IGNORE NULLS) OVER w AS pid
  FROM t0
  WINDOW w AS (PARTITION BY session, seg ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t2 AS (
  SELECT *, coalesce(touch AND NOT fresh AND eid <> pid, false) AS split FROM t1),
t3 AS (SELECT *, split OR (touch AND fresh) AS opens FROM t2),
t AS (
  SELECT * EXCLUDE (touch, fresh, pid),
         CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS BIGINT) AS turn,
         bool_or(opens) OVER (PARTITION BY session, seg ORDER BY seq) AS live,
         CAST(sum(CASE WHEN creates THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS BIGINT) AS n
  FROM t3),
s0 AS (
  SELECT *, role IN ('M','T') AS bumpable,
         max(CASE WHEN role = 'R' THEN seq ELSE -1 END) OVER w AS last_r,
         max(CASE WHEN role IN ('M','T') THEN seq ELSE -1 END) OVER w AS last_m
  FROM t
  WINDOW w AS (PARTITION BY session, turn, live ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s1 AS (
  SELECT *, CAST(sum(CASE WHEN bumpable AND (coalesce(last_m, -1) = -1 OR last_r > last_m) THEN 1 ELSE 0 END)
    OVER (PARTITION BY session, turn, live ORDER BY seq) AS BIGINT) AS raw_step
  FROM s0),
r AS (
  SELECT * EXCLUDE (bumpable, last_r, last_m, raw_step, n, seg),
         CASE WHEN live AND raw_step > 0 THEN raw_step END AS step,
         CASE WHEN creates THEN n END AS idx
  FROM s1)"""

FOLD = """,
fold AS (
  SELECT session, owner, min(call) AS call, count(*) FILTER (role = 'R') AS results,
         min(ts_ms) AS started_ms, max(CASE WHEN role = 'R' THEN ts_ms END) AS completed_ms,
         coalesce(bool_or(failed), false) AS failed
  FROM {src} WHERE role IN ('T','R') GROUP BY session, owner),
folded AS (
  SELECT *, completed_ms - started_ms AS duration_ms,
         CASE WHEN failed THEN 'error' WHEN results > 0 THEN 'complete' ELSE 'running' END AS status,
         CASE WHEN failed THEN 'Tool result reported an error.' END AS error
  FROM fold)"""

RECORDS = TURNS + FOLD.format(src="r") + """,
rec AS (
  SELECT r.session, idx AS "index", event_id, turn, step,
         CASE WHEN role = 'M' THEN 'assistant' ELSE 'tool' END AS kind,
         CASE role WHEN 'M' THEN 'Assistant' WHEN 'T' THEN 'tool ' || r.call ELSE 'Tool result' END AS event,
         r.call, coalesce(status, 'complete') AS status, ts_ms AS started_ms,
         CASE WHEN role = 'M' THEN ts_ms ELSE completed_ms END AS completed_ms, duration_ms, error
  FROM r LEFT JOIN folded f ON f.session = r.session AND f.owner = r.seq WHERE creates),
records AS (
  SELECT * , CASE WHEN kind = 'tool' THEN event || ' · ' || status ELSE event END AS summary FROM rec)"""

SAMPLES = TURNS + """,
k0 AS (
  SELECT *, CASE WHEN role = 'K' THEN CAST(sum(CASE WHEN role = 'K' AND k % 5 <> 0 THEN amount ELSE 0 END)
      OVER (PARTITION BY session ORDER BY seq) AS BIGINT) END AS cum_total,
    CASE WHEN role = 'K' AND k % 6 = 0 THEN k END AS cum_output
  FROM r),
k1 AS (
  SELECT *, last_value(cum_total IGNORE NULLS) OVER w AS prev_total,
         last_value(cum_output IGNORE NULLS) OVER w AS prev_output
  FROM k0
  WINDOW w AS (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k2 AS (
  SELECT *, coalesce(cum_total, prev_total) AS now_total, coalesce(cum_output, prev_output) AS now_output,
         role = 'K' AND turn > 0 AS sampled,
         role = 'K' AND turn > 0 AND (k % 9 = 8 OR coalesce(cum_total <> coalesce(prev_total, 0), false)
           OR coalesce(cum_output <> coalesce(prev_output, 0), false)) AS accepted
  FROM k1),
u AS (
  SELECT *, CAST(coalesce(sum(CASE WHEN sampled THEN 1 ELSE 0 END) OVER (
      PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS interval_no,
    CASE WHEN role = 'K' THEN amount END AS last_input,
    CASE WHEN role = 'K' THEN amount // 3 END AS last_cached_input,
    CASE WHEN role = 'K' THEN k END AS last_output,
    CASE WHEN role = 'K' THEN k // 4 END AS last_reasoning_output,
    CASE WHEN role = 'K' THEN amount + k END AS last_total
  FROM k2)"""

TURN_TABLE = """,
opens_at AS (
  SELECT session, turn, role AS cut_role, ts_ms AS cut_ms FROM r WHERE split),
g AS (
  SELECT session, turn,
         arg_min(eid, seq) FILTER (live AND eid IS NOT NULL) AS id,
         coalesce(arg_max(ts_ms, seq) FILTER (live AND role = 'S'),
                  arg_min(ts_ms, seq) FILTER (live AND (creates OR role IN ('S','C')))) AS started_ms,
         bool_or(live AND role = 'C') AS done,
         max(ts_ms) FILTER (live AND role = 'C') AS end_ms,
         CAST(count(*) FILTER (creates) AS BIGINT) AS records,
         CAST(coalesce(max(step), 0) AS BIGINT) AS steps
  FROM r WHERE turn > 0 GROUP BY session, turn),
span AS (SELECT session, max(ts_ms) AS session_last FROM r GROUP BY session),
turns AS (
  SELECT g.session, g.turn, id, started_ms,
         CASE WHEN done THEN end_ms ELSE cut_ms END AS completed_ms,
         CASE WHEN done THEN end_ms ELSE coalesce(cut_ms, session_last) END - started_ms AS duration_ms,
         CASE WHEN done THEN 'complete' WHEN cut_ms IS NOT NULL THEN 'aborted' ELSE 'running' END AS status,
         CASE WHEN NOT done THEN cut_role END AS cut_by, records, steps
  FROM g LEFT JOIN opens_at o ON o.session = g.session AND o.turn = g.turn + 1
  JOIN span ON span.session = g.session)"""

TURN_SUMS = """,
sums AS (
  SELECT session, turn, CAST(count(*) AS BIGINT) AS model_calls,
         CAST(sum(last_input) AS BIGINT) AS used_input,
         CAST(sum(last_cached_input) AS BIGINT) AS used_cached_input,
         CAST(sum(last_output) AS BIGINT) AS used_output,
         CAST(sum(last_reasoning_output) AS BIGINT) AS used_reasoning_output,
         CAST(sum(last_total) AS BIGINT) AS used_total
  FROM u WHERE accepted GROUP BY session, turn)"""

# Results eight records or more behind the record of their call id add a marker (role L) before them.
LATE = """,
step AS (
  SELECT session, seq, role, k, CAST(k % 10 AS INTEGER) + 1 AS slot, role IN ('T', 'R') AS tool FROM e),
run AS (
  SELECT DISTINCT session, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS n, list_transform(range(10), lambda x: CAST(0 AS BIGINT)) AS own,
         list_transform(range(10), lambda x: CAST(0 AS BIGINT)) AS place, list_transform(range(10), lambda x: CAST(0 AS BIGINT)) AS root,
         false AS late, CAST(NULL AS BIGINT) AS late_of, CAST(NULL AS BIGINT) AS late_root FROM step
  UNION ALL
  SELECT session, seq, n + CAST(creates OR late AS BIGINT),
         CASE WHEN tool AND (creates OR late) THEN list_transform(own, lambda x, i: CASE WHEN i = slot THEN n + 1 ELSE x END) ELSE own END,
         CASE WHEN tool AND (creates OR late) THEN list_transform(place, lambda x, i: CASE WHEN i = slot THEN 2 * seq - CAST(late AS BIGINT) ELSE x END) ELSE place END,
         CASE WHEN tool AND creates THEN list_transform(root, lambda x, i: CASE WHEN i = slot THEN 2 * seq ELSE x END) ELSE root END,
         late, CASE WHEN late THEN place[slot] END, CASE WHEN late THEN root[slot] END
  FROM (
    SELECT s.session, s.seq, s.slot, s.tool, r.n, r.own, r.place, r.root,
           s.role IN ('M', 'T') OR (s.role = 'R' AND r.own[s.slot] = 0) AS creates,
           s.role = 'R' AND r.own[s.slot] > 0 AND r.n - r.own[s.slot] >= 8 AS late
    FROM run r JOIN step s ON s.session = r.session AND s.seq = r.seq + 1)),
e2 AS (
  SELECT * EXCLUDE (seq), 2 * seq AS seq, CAST(NULL AS BIGINT) AS late_of, CAST(NULL AS BIGINT) AS late_root FROM e
  UNION ALL BY NAME
  SELECT e.* EXCLUDE (seq, role), 2 * e.seq - 1 AS seq, 'L' AS role, late_of, late_root FROM e JOIN run USING (session, seq) WHERE late)"""
LATE_TURNS = EVENTS + LATE + TURNS[len(EVENTS):].replace("FROM e)", "FROM e2)").replace("role = 'T' THEN seq", "role IN ('T', 'L') THEN seq")
LATE_RECORDS = LATE_TURNS + """,
fr AS (
  SELECT session, owner, role, ts_ms, failed AND role <> 'L' AS failed FROM r WHERE role IN ('T', 'R', 'L')
  UNION ALL SELECT session, late_of, 'R', ts_ms, failed FROM r WHERE role = 'L'),
fold AS (
  SELECT session, owner, count(*) FILTER (role = 'R') AS results, min(ts_ms) AS started_ms,
         max(CASE WHEN role = 'R' THEN ts_ms END) AS completed_ms, coalesce(bool_or(failed), false) AS failed
  FROM fr GROUP BY session, owner),
whole AS (
  SELECT r.session, idx, turn, CASE r.role WHEN 'M' THEN 'assistant' ELSE 'tool' END AS kind, r.role, r.call, r.k, ts_ms, f.completed_ms,
         f.started_ms, results, first_value(r.role) OVER w AS first_role, first_value(step) OVER w AS step,
         coalesce(bool_or(f.failed) OVER w, false) AS failed
  FROM r LEFT JOIN fold f ON f.session = r.session AND f.owner = r.seq WHERE creates
  WINDOW w AS (PARTITION BY r.session, coalesce(late_root, seq) ORDER BY seq))"""

STATS = """,
stats AS (
  SELECT r.session, CAST(max(turn) AS BIGINT) AS turns, CAST(count(*) FILTER (creates) AS BIGINT) AS records,
         CAST(count(DISTINCT call) AS BIGINT) AS tool_calls,
         CAST(count(DISTINCT CASE WHEN failed THEN call END) AS BIGINT) AS failed_tools,
         CAST(0 AS BIGINT) AS compactions, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms
  FROM r GROUP BY r.session)"""

QUOTA = EVENTS + """,
q AS (
  SELECT session, seq, event_id, k, CASE WHEN k % 2 = 0 THEN 'primary' ELSE 'secondary' END AS "window",
         amount * 2 AS used_percent,
         CAST(CASE WHEN k % 7 = 0 THEN 0 WHEN k % 2 = 0 THEN 300 ELSE 10080 END AS BIGINT) AS window_minutes,
         ts_ms + 60000 * (k % 3) AS resets_ms
  FROM e WHERE role = 'K'),
ok AS (SELECT * FROM q WHERE used_percent BETWEEN 0 AND 100 AND window_minutes > 0)"""

PAGES = TURNS + """,
p AS (SELECT session, idx AS "index", event_id, turn, step FROM r WHERE creates),
newest AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY session ORDER BY "index" DESC) <= 50),
older AS (SELECT * FROM p WHERE "index" < 40
          QUALIFY row_number() OVER (PARTITION BY session ORDER BY "index" DESC) <= 50)"""

CONV = r"""
c AS (
  SELECT conv_id, turn AS pos, role, text FROM conversations),
f AS (
  SELECT conv_id, count(*) FILTER (role IN ('user','assistant')) AS records,
         CASE WHEN count(*) FILTER (role IN ('user','assistant')) > 0 THEN 1 ELSE 0 END AS turns,
         arg_min(text, pos) FILTER (role = 'user' AND text <> '') AS first_user
  FROM c GROUP BY conv_id),
flat AS (SELECT *, trim(regexp_replace(coalesce(first_user, 'Untitled task'), '\s+', ' ', 'g')) AS ft FROM f),
ov AS (
  SELECT conv_id, 'conv-' || CAST(conv_id - CASE WHEN conv_id % 10 = 1 THEN 1 ELSE 0 END AS VARCHAR) AS id,
         'log-' || lpad(CAST(conv_id AS VARCHAR), 12, '0') AS stem,
         conv_id * 1000 AS modified_ms, conv_id % 7 = 0 AS archived,
         '/work/p' || CAST(conv_id % 5 AS VARCHAR) AS cwd, 'm' || CAST(conv_id % 3 AS VARCHAR) AS model,
         CASE WHEN length(ft) <= 100 THEN ft ELSE rtrim(substr(ft, 1, 99)) || '…' END AS title,
         CAST(turns AS BIGINT) AS turns, CAST(records AS BIGINT) AS records
  FROM flat)"""


def _shortened(column: str, limit: int) -> str:
    flat = rf"trim(regexp_replace({column}, '\s+', ' ', 'g'))"
    return (f"CASE WHEN length({flat}) <= {limit} THEN {flat} "
            f"ELSE rtrim(substr({flat}, 1, {limit - 1})) || '…' END")


# Table: prefix and names of the rules its rows are held to.
CONTRACT = {
    "records": ("record", "index kind status event_length summary_length step duration running_is_open error_has_text "
                          "id turn call order usage details metadata"),
    "turns": ("turn", "index status counts duration running_is_open id first_token error_has_text usage"),
    "sessions": ("session", "id title counts failed_within_calls span tokens context_window"),
    "quotas": ("quota", "used remaining window"),
    "warnings": ("warning", "code line message"),
    "documents": ("document", "members session pagination stats records[0] turns[0]"),
}
# Members of the document's parts; [] stands for the elements of a list.
_TOKENS = "input_tokens cached_input_tokens output_tokens reasoning_output_tokens total_tokens"
PARTS = {
    "document": "schemaVersion detailLevel generatedAt session pagination stats turns records warnings recentSessions",
    "document.session": "id title cwd model effort originator sourceKind startedAt updatedAt archived parentThreadId agentPath git",
    "document.session.git": "branch commit_hash",
    "document.pagination": "firstRecord lastRecord earlierRecords laterRecords hasEarlier hasLater nextBeforeRecord",
    "document.stats": ("turns visibleTurns omittedTurns records visibleRecords omittedRecords toolCalls failedTools compactions "
                       "tokens contextWindow rateLimits"),
    "document.stats.tokens": _TOKENS, "document.stats.rateLimits": "primary secondary",
    "document.stats.rateLimits.primary": "usedPercent windowMinutes resetsAt",
    "document.stats.rateLimits.secondary": "usedPercent windowMinutes resetsAt",
    "document.turns[]": ("index id startedAt completedAt durationMs timeToFirstTokenMs status error records steps modelCalls usage "
                         "model"),
    "document.turns[].usage": _TOKENS,
    "document.records[]": ("index id turn step kind event summary startedAt completedAt durationMs status callId input output error "
                           "usage metadata"),
    "document.records[].usage": _TOKENS, "document.warnings[]": "code line message",
    "document.recentSessions[]": ("id title cwd model effort collaborationMode startedAt updatedAt turns toolCalls tokens archived "
                                  "parentThreadId agentPath git"),
    "document.recentSessions[].tokens": _TOKENS, "document.recentSessions[].git": "branch commit_hash",
}
FORMAT = ["document", *(part for part in PARTS if part.endswith("[]")),
          *(f"{part}.{name}" for part, names in PARTS.items() for name in names.split())]


def queries() -> dict[str, str]:
    with_turns = TURNS + TURN_TABLE
    with_samples = SAMPLES + TURN_TABLE + TURN_SUMS
    rollup = f"""WITH {with_samples}
        SELECT t.session, t.turn, id, started_ms, completed_ms, duration_ms, status, cut_by, records, steps,
               coalesce(model_calls, 0) AS model_calls, used_total
        FROM turns t LEFT JOIN sums s ON s.session = t.session AND s.turn = t.turn"""
    ledger = f"""WITH {RECORDS} SELECT * FROM records"""
    islands = f"WITH {TURNS} SELECT session, event_id, role, turn, opens, split, live FROM r"
    deltas = f"""WITH {SAMPLES}
        SELECT session, event_id, turn, now_total, now_output, sampled, accepted, interval_no AS "interval"
        FROM u WHERE role = 'K'"""
    attach = f"""WITH {SAMPLES},
      m AS (
        SELECT session, interval_no, turn, max(CASE WHEN role = 'M' THEN seq END) AS model,
               min(CASE WHEN role = 'T' THEN seq END) AS tool,
               max(CASE WHEN accepted THEN seq END) AS sample
        FROM u WHERE turn > 0 GROUP BY ALL)
      SELECT m.session, o.event_id, o.idx AS "index", o.turn, s.last_input AS used_input,
             s.last_output AS used_output, s.last_total AS used_total
      FROM m JOIN u s ON s.session = m.session AND s.seq = m.sample
      JOIN u o ON o.session = m.session AND o.seq = coalesce(m.model, m.tool)"""
    correlation = f"""WITH {OWNED}
        SELECT r.session, r.event_id, r.call, w.event_id AS owner_event_id, w.role AS owner_role
        FROM o r JOIN o w ON w.session = r.session AND w.seq = r.owner WHERE r.role = 'R'"""
    totals = f"""WITH {EVENTS}
        SELECT session, CAST(count(DISTINCT call) AS BIGINT) AS tool_calls,
               CAST(count(DISTINCT CASE WHEN failed THEN call END) AS BIGINT) AS failed_tools
        FROM e WHERE call IS NOT NULL GROUP BY session"""
    alerts = f"""WITH {QUOTA},
      a AS (
        SELECT *, greatest(0, 100 - used_percent) AS remaining, CAST(k % 3 AS VARCHAR) AS window_key,
               k % 4 <> 0 AS running FROM ok),
      b AS (
        SELECT *, sum(CASE WHEN remaining > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS epoch
        FROM a),
      d AS (
        SELECT *, lag(window_key) OVER (PARTITION BY session, epoch ORDER BY seq) AS prev
        FROM b WHERE remaining <= 40 AND running)
      SELECT session, event_id, remaining, window_key FROM d WHERE prev IS NULL OR prev <> window_key"""
    stats = f"WITH {TURNS}{STATS} SELECT * FROM stats"
    contract = f"""WITH {RECORDS}{TURN_TABLE}{STATS},
      out AS (
        SELECT 'record.index' AS rule, count(*) AS "rows", count(*) FILTER (NOT "index" >= 1) AS broken FROM records
        UNION ALL SELECT 'record.kind', count(*), count(*) FILTER (kind NOT IN ('user','assistant','reasoning','tool','subagent','compaction')) FROM records
        UNION ALL SELECT 'record.status', count(*), count(*) FILTER (status NOT IN ('running','complete','error','aborted')) FROM records
        UNION ALL SELECT 'record.event_length', count(*), count(*) FILTER (NOT length(event) BETWEEN 1 AND 260) FROM records
        UNION ALL SELECT 'record.summary_length', count(*), count(*) FILTER (length(summary) > 220) FROM records
        UNION ALL SELECT 'record.step', count(*), count(*) FILTER (step < 1) FROM records
        UNION ALL SELECT 'record.duration', count(*), count(*) FILTER (duration_ms < 0) FROM records
        UNION ALL SELECT 'record.running_is_open', count(*), count(*) FILTER (status = 'running' AND completed_ms IS NOT NULL) FROM records
        UNION ALL SELECT 'record.error_has_text', count(*), count(*) FILTER (status = 'error' AND error IS NULL) FROM records
        UNION ALL SELECT 'turn.index', count(*), count(*) FILTER (turn < 1) FROM turns
        UNION ALL SELECT 'turn.status', count(*), count(*) FILTER (status NOT IN ('running','complete','error','aborted')) FROM turns
        UNION ALL SELECT 'turn.counts', count(*), count(*) FILTER (records < 0 OR steps < 0) FROM turns
        UNION ALL SELECT 'turn.duration', count(*), count(*) FILTER (duration_ms < 0) FROM turns
        UNION ALL SELECT 'turn.running_is_open', count(*), count(*) FILTER (status = 'running' AND completed_ms IS NOT NULL) FROM turns
        UNION ALL SELECT 'stats.failed_within_calls', count(*), count(*) FILTER (failed_tools > tool_calls) FROM stats
        UNION ALL SELECT 'stats.calls_within_records', count(*), count(*) FILTER (tool_calls > records) FROM stats
        UNION ALL SELECT 'stats.span', count(*), count(*) FILTER (first_ms > last_ms) FROM stats)
      SELECT rule, CAST("rows" AS BIGINT) AS "rows", CAST(broken AS BIGINT) AS broken FROM out"""
    log_records = f"""WITH {RECORDS}
        SELECT 'user-' || CAST(session AS VARCHAR) AS session, "index", turn, step, kind,
               replace(event, 'tool ', 'tool.') AS event,
               CASE WHEN kind = 'tool' THEN replace(event, 'tool ', 'tool.') || ' · ' || status
                    ELSE 'said ' || CAST(k AS VARCHAR) END AS summary, status, call, started_ms,
               completed_ms, duration_ms, error
        FROM records JOIN (SELECT event_id, k FROM e) USING (event_id)"""
    quarantine = f"""WITH {EVENTS}
        SELECT 'user-' || CAST(session AS VARCHAR) AS file, seq AS line_no,
               CASE WHEN k % 8 = 2 THEN 'non_object_jsonl' ELSE 'malformed_jsonl' END AS code
        FROM e WHERE k % 8 NOT IN (0, 5)"""
    documents = f"""WITH {TURNS},
            n AS (
              SELECT session, CAST(count(*) FILTER (creates) AS BIGINT) AS records, min(ts_ms) AS a FROM r GROUP BY session)
            SELECT 'user-' || CAST(session AS VARCHAR) AS session, records, least(records, 50) AS shown,
                   CASE WHEN records > 0 THEN greatest(records - 49, 1) END AS first_index,
                   CASE WHEN records > 50 THEN records - 49 END AS next_before, CAST(1 AS BIGINT) AS first_turn,
                   CASE WHEN a % 1000 = 0 THEN strftime(make_timestamp(a * 1000), '%Y-%m-%dT%H:%M:%SZ')
                        ELSE strftime(make_timestamp(a * 1000), '%Y-%m-%dT%H:%M:%S.%fZ') END AS started_at
            FROM n"""
    desk = """m AS (
          SELECT conv_id AS c, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)"""
    found = {
        # the log row by row: records so far, and the record that each of the ten call ids points to
        "late_markers": f"""WITH RECURSIVE {EVENTS},
            step AS (
              SELECT session, event_id, seq, call, role, CAST(k % 10 AS INTEGER) + 1 AS slot, role IN ('T', 'R') AS tool FROM e),
            run AS (
              SELECT DISTINCT session, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS n, list_transform(range(10), lambda x: CAST(0 AS BIGINT)) AS own,
                     false AS late, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS call
              FROM step
              UNION ALL
              SELECT session, seq, n + CAST(creates OR late AS BIGINT),
                     CASE WHEN tool AND (creates OR late)
                          THEN list_transform(own, lambda x, i: CASE WHEN i = slot THEN n + 1 ELSE x END) ELSE own END,
                     late, event_id, call
              FROM (
                SELECT s.session, s.seq, s.event_id, s.call, s.slot, s.tool, r.n, r.own,
                       s.role IN ('M', 'T') OR (s.role = 'R' AND r.own[s.slot] = 0) AS creates,
                       s.role = 'R' AND r.own[s.slot] > 0 AND r.n - r.own[s.slot] >= 8 AS late
                FROM run r JOIN step s ON s.session = r.session AND s.seq = r.seq + 1))
            SELECT session, event_id, call, n AS marker_index FROM run WHERE late""",
        "log_metadata": f"""WITH {desk}
            SELECT 'desk-' || CAST(c AS VARCHAR) AS id, '~/p' || CAST(c % 5 AS VARCHAR) AS cwd, 'desk' AS originator,
                   CASE c % 3 WHEN 0 THEN 'cli' WHEN 1 THEN 'subagent' END AS source_kind,
                   'b' || CAST(c % 4 AS VARCHAR) AS git_branch, lpad(CAST(c AS VARCHAR), 10, 'a') AS git_commit,
                   CAST(1000 + max(n) FILTER (role = 'assistant') AS BIGINT) AS context_window, count(*) AS records,
                   count(*) FILTER (role = 'system') AS tool_calls,
                   count(*) FILTER (role = 'system' AND n % 4 = 0) AS failed_tools
            FROM m GROUP BY c""",
        "log_tool_details": f"""WITH {desk}
            SELECT 'desk-' || CAST(c AS VARCHAR) AS session, n AS "index", 's.t' || CAST(n % 3 AS VARCHAR) AS event,
                   CASE WHEN n % 4 = 0 THEN 'error' ELSE 'complete' END AS status,
                   CAST(n * 1000 + 250 AS BIGINT) AS duration_ms,
                   '{{' || chr(10) || '  "n": ' || CAST(n AS VARCHAR) || chr(10) || '}}' AS input,
                   CASE WHEN n % 4 = 0 THEN '{{' || chr(10) || '  "Err": "bad"' || chr(10) || '}}'
                        ELSE '{{' || chr(10) || '  "Ok": {{' || chr(10) || '    "v": ' || CAST(n AS VARCHAR) || chr(10) || '  }}'
                             || chr(10) || '}}' END AS output,
                   '{{"protocolType":"mcp_tool_call_end"}}' AS metadata,
                   CASE WHEN n % 4 = 0 THEN 'Tool completion event reported an error.' END AS error
            FROM m WHERE role = 'system'""",
        "log_attachments": f"""WITH {desk}
            SELECT 'desk-' || CAST(c AS VARCHAR) AS session, n AS "index", CAST(length(text) % 3 AS BIGINT) AS images,
                   CAST(n % 2 AS BIGINT) AS audio FROM m WHERE role = 'user'""",
        "log_phases": f"""WITH {desk}
            SELECT 'desk-' || CAST(c AS VARCHAR) AS session, n AS "index",
                   CASE WHEN n % 2 = 0 THEN 'Assistant · final' ELSE 'Assistant' END AS event,
                   CASE WHEN n % 2 = 0 THEN 'final' END AS phase,
                   CAST(CASE WHEN length(text) <= 12000 THEN length(text)
                        ELSE 12000 + length('xx… truncated ' || format('{{:,}}', length(text) - 12000) || ' characters') END AS BIGINT) AS chars
            FROM m WHERE role = 'assistant'""",
        "lineage_history": f"""WITH m AS (
              SELECT conv_id AS c, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n,
                     count(*) OVER (PARTITION BY conv_id) // 2 AS half FROM conversations),
            ids AS (SELECT DISTINCT c FROM m),
            parts AS (
              SELECT c AS conv_id, 2 AS part, n, role, text FROM m
              UNION ALL
              SELECT c + 1, 1, n, role, text FROM m
              WHERE n <= half AND c % 3 <> 2 AND c + 1 IN (SELECT c FROM ids)
              UNION ALL
              SELECT c + 2, 0, n, role, text FROM m
              WHERE n <= half AND c % 3 = 0 AND c + 1 IN (SELECT c FROM ids) AND c + 2 IN (SELECT c FROM ids)),
            k AS (
              SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, n) AS event_number,
                     count(*) FILTER (part < 2) OVER (PARTITION BY conv_id) AS before,
                     count(*) FILTER (part = 0) OVER (PARTITION BY conv_id) AS oldest,
                     max(part) FILTER (part < 2) OVER (PARTITION BY conv_id) AS inherits,
                     min(part) OVER (PARTITION BY conv_id) AS depth FROM parts)
            SELECT conv_id, event_number,
                   n + CASE part WHEN 0 THEN 0
                       WHEN 1 THEN CASE WHEN depth = 0 THEN oldest + 1 ELSE 0 END
                       ELSE CASE WHEN inherits IS NULL THEN 0 WHEN conv_id % 3 = 2 AND (conv_id - 2) IN (SELECT c FROM ids)
                            THEN before + 2 ELSE before + 1 END END AS ordinal,
                   CASE role WHEN 'user' THEN 'IU' WHEN 'assistant' THEN 'IM' ELSE 'X' END AS role,
                   CASE WHEN role = 'system' THEN NULL
                        WHEN text = '' THEN CASE role WHEN 'user' THEN 'User message' ELSE 'Assistant' END
                        ELSE {_shortened('text', 220)} END AS summary
            FROM k""",
        "log_documents": documents,
        "trajectory_page": documents + """
            WHERE session = (SELECT user_id FROM events GROUP BY user_id
                             ORDER BY floor(max(epoch_us(ts)) / 1000) DESC, 'user-' || CAST(user_id AS VARCHAR) LIMIT 1)""",
        "live_cursor": f"""WITH {TURNS}
            SELECT session, 'T' || CAST(turn AS VARCHAR) || ' / S' || CAST(coalesce(step, 0) AS VARCHAR) || ' / #' ||
                   CAST(idx AS VARCHAR) AS cursor
            FROM r WHERE creates QUALIFY row_number() OVER (PARTITION BY session ORDER BY idx DESC) = 1""",
        "log_records": log_records,
        "log_records_chunked": log_records,
        "contract_breaches": f"""WITH {TURNS},
            page AS (SELECT session, role FROM r WHERE creates QUALIFY row_number() OVER (PARTITION BY session ORDER BY idx DESC) <= 50),
            n AS (SELECT session, max(turn) AS turns FROM r GROUP BY session),
            m AS (SELECT n.*, (SELECT count(*) FROM page WHERE page.session = n.session AND role = 'M') AS said FROM n),
            b AS (
              SELECT CASE session % 9 WHEN 1 THEN 'document' WHEN 2 THEN 'document.schemaVersion'
                       WHEN 3 THEN 'document.pagination.nextBeforeRecord' WHEN 4 THEN 'document.records[].kind'
                       WHEN 5 THEN 'document.turns[].timeToFirstTokenMs' WHEN 6 THEN 'document.session.archived'
                       WHEN 7 THEN 'document' WHEN 8 THEN 'document.records[].event' END AS rule,
                     CASE WHEN session % 9 IN (4, 8) THEN said WHEN session % 9 = 5 THEN turns ELSE 1 END AS broken FROM m
              UNION ALL
              SELECT 'document.recentSessions[].archived', least(20, (SELECT count(*) FROM m)) FROM m WHERE session % 9 = 6)
            SELECT rule, (SELECT count(*) FROM m) AS "rows", CAST(sum(broken) AS BIGINT) AS broken FROM b
            WHERE rule IS NOT NULL GROUP BY rule HAVING sum(broken) > 0""",
        "log_compactions": f"""WITH RECURSIVE {EVENTS},
            x AS (SELECT session, seq, CASE event_type WHEN 'signup' THEN 'C' WHEN 'purchase' THEN 'P' WHEN 'click' THEN 'E' ELSE 'M' END AS kind FROM e),
            run AS (
              SELECT DISTINCT session, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS turn, false AS live, CAST(0 AS BIGINT) AS pending,
                     CAST(0 AS BIGINT) AS records, CAST(0 AS BIGINT) AS compactions FROM x
              UNION ALL
              SELECT session, seq, turn + CAST(NOT paired AND NOT live AS BIGINT), CASE WHEN kind = 'C' THEN false WHEN paired THEN live ELSE true END,
                     CASE kind WHEN 'P' THEN turn + CAST(NOT live AS BIGINT) WHEN 'E' THEN 0 ELSE pending END,
                     records + CAST(kind <> 'C' AND NOT paired AS BIGINT), compactions + CAST(kind IN ('P', 'E') AND NOT paired AS BIGINT)
              FROM (SELECT x.session, x.seq, kind, turn, live, pending, records, compactions, kind = 'E' AND pending > 0 AND pending = turn AS paired
                    FROM run JOIN x ON x.session = run.session AND x.seq = run.seq + 1))
            SELECT 'user-' || CAST(session AS VARCHAR) AS id, arg_max(turn, seq) AS turns, arg_max(records, seq) AS records,
                   arg_max(compactions, seq) AS compactions FROM run GROUP BY session""",
        "log_tool_names": f"""WITH {OWNED},
            n AS (
              SELECT *, CASE WHEN role = 'T' THEN CASE WHEN k % 2 = 0 THEN 'tool' ELSE 'find' END
                             ELSE CASE k % 3 WHEN 0 THEN 'MCP tool' WHEN 1 THEN 's.t' || CAST(k % 2 AS VARCHAR) ELSE 'u' || CAST(k % 2 AS VARCHAR) END
                        END AS label FROM o WHERE role IN ('T', 'R')),
            g AS (
              SELECT session, owner, min(call) AS call, count(*) FILTER (role = 'R') AS ends, arg_min(label, seq) AS own,
                     arg_max(label, seq) FILTER (role = 'R') AS last_any, arg_max(label, seq) FILTER (role = 'R' AND label <> 'MCP tool') AS last_named
              FROM n GROUP BY session, owner)
            SELECT 'user-' || CAST(session AS VARCHAR) AS session, row_number() OVER (PARTITION BY session ORDER BY owner) AS "index",
                   coalesce(last_named, CASE WHEN own IN ('tool', 'MCP tool') THEN last_any END, own) AS event, call,
                   CASE WHEN ends > 0 THEN 'complete' ELSE 'running' END AS status FROM g""",
        "log_late_records": f"""WITH RECURSIVE {LATE_RECORDS}
            SELECT 'user-' || CAST(session AS VARCHAR) AS session, idx AS "index", turn, step, kind,
                   CASE first_role WHEN 'M' THEN 'Assistant' WHEN 'T' THEN 'tool.' || call ELSE 'Tool result' END AS event, call,
                   CASE WHEN failed THEN 'error' WHEN kind = 'assistant' OR results > 0 THEN 'complete' ELSE 'running' END AS status,
                   ts_ms AS started_ms, CASE kind WHEN 'tool' THEN completed_ms ELSE ts_ms END AS completed_ms,
                   CASE kind WHEN 'tool' THEN completed_ms - started_ms END AS duration_ms,
                   CASE WHEN failed THEN 'Tool result reported an error.' END AS error
            FROM whole""",
        "log_late_turns": f"""WITH RECURSIVE {LATE_TURNS}{TURN_TABLE}
            SELECT 'user-' || CAST(session AS VARCHAR) AS session, turn, started_ms, completed_ms, status, records, steps FROM turns""",
        "log_turns": f"""WITH {with_turns}
            SELECT 'user-' || CAST(session AS VARCHAR) AS session, turn, id, started_ms, completed_ms,
                   duration_ms, status, CASE WHEN cut_by IS NOT NULL
                   THEN 'Turn ended without a matching completion event.' END AS error, records, steps
            FROM turns""",
        "log_sessions": f"""WITH {TURNS}{STATS}
            SELECT 'user-' || CAST(session AS VARCHAR) AS id, 'Untitled task' AS title, turns, records,
                   tool_calls, failed_tools, compactions, first_ms AS started_ms, last_ms AS updated_ms,
                   false AS archived
            FROM stats""",
        "log_warnings": f"""WITH {TURNS},
            w AS (
              SELECT session, seq, CASE WHEN role = 'R' AND creates THEN 'unmatched_tool_result'
                     WHEN split AND role = 'S' THEN 'overlapping_turn_start'
                     WHEN split THEN 'mismatched_turn_completion' END AS code FROM r)
            SELECT 'user-' || CAST(session AS VARCHAR) AS session, seq AS line, code FROM w
            WHERE code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session ORDER BY seq) <= 100""",
        "log_quota": f"""WITH {EVENTS}
            SELECT 'user-' || CAST(session AS VARCHAR) AS session, 'primary' AS "window",
                   CAST(amount * 2 AS DOUBLE) AS used_percent,
                   CAST(100 - amount * 2 AS DOUBLE) AS remaining_percent
            FROM e WHERE role = 'K' AND amount * 2 BETWEEN 0 AND 100 AND k % 7 <> 0
            QUALIFY row_number() OVER (PARTITION BY session ORDER BY seq DESC) = 1""",
        "log_record_ids": f"""WITH {TURNS}
            SELECT 'user-' || CAST(session AS VARCHAR) AS session, count(*) AS records, count(*) AS ids
            FROM r WHERE creates GROUP BY session""",
        "quarantine": quarantine,
        "quarantine_chunked": quarantine,
        "document_admission": r"""WITH d AS (
              SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS file, unnest(string_split(text, chr(10))) AS line FROM documents),
            c AS (
              SELECT file, regexp_matches(line, '^[ \t\r\v\f]*$') AS blank, coalesce(json_valid(line), false) AS valid,
                     coalesce(CASE WHEN json_valid(line) THEN json_type(line) END = 'OBJECT', false) AS obj FROM d)
            SELECT file, count(*) AS lines, count(*) FILTER (NOT blank AND obj) AS good,
                   CAST(0 AS BIGINT) AS oversized_jsonl, CAST(0 AS BIGINT) AS malformed_utf8,
                   count(*) FILTER (NOT blank AND NOT valid) AS malformed_jsonl,
                   count(*) FILTER (NOT blank AND valid AND NOT obj) AS non_object_jsonl
            FROM c GROUP BY file""",
        "record_ledger": ledger,
        "record_ledger_chunked": ledger,
        "turn_islands": islands,
        "turn_islands_chunked": islands,
        "model_steps": f'WITH {TURNS} SELECT session, event_id, turn, step, idx AS "index" FROM r',
        "turn_rollup": rollup,
        "turn_rollup_chunked": rollup,
        "superseded_turns": f"""WITH {with_turns}
            SELECT session, turn, id, CASE cut_by WHEN 'S' THEN 'overlapping_turn_start'
                   ELSE 'mismatched_turn_completion' END AS code, started_ms, completed_ms, duration_ms
            FROM turns WHERE cut_by IS NOT NULL""",
        "model_context": f"""WITH {TURNS},
            x AS (
              SELECT *, role = 'K' AND k % 4 = 1 AS ctx,
                     CASE WHEN (role = 'K' AND k % 8 = 1) OR (role = 'S' AND k % 3 = 0)
                          THEN 'm' || CAST(k % 5 AS VARCHAR) END AS model FROM r),
            y AS (
              SELECT *, arg_max(CASE WHEN ctx THEN coalesce(model, '-') END, CASE WHEN ctx THEN seq END) OVER (
                PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM x)
            SELECT session, turn, coalesce(
                arg_max(model, seq) FILTER (live AND model IS NOT NULL AND (ctx OR role = 'S')),
                nullif(max(CASE WHEN opens THEN prior END), '-')) AS model
            FROM y WHERE turn > 0 GROUP BY session, turn""",
        "tool_correlation": correlation,
        "tool_correlation_chunked": correlation,
        "tool_fold": f"""WITH {TURNS}{FOLD.format(src="r")}
            SELECT r.session, r.event_id, r.call, turn, step, idx AS "index", results, status, started_ms,
                   completed_ms, duration_ms, error
            FROM folded f JOIN r ON r.session = f.session AND r.seq = f.owner""",
        "orphan_tool_results": f"""WITH {OWNED}
            SELECT session, event_id, call, 'unmatched_tool_result' AS code FROM o WHERE role = 'R' AND creates""",
        "tool_call_totals": totals,
        "tool_latency": f"""WITH {OWNED}{FOLD.format(src="o")}
            SELECT 'tool ' || call AS event, count(*) AS calls, count(*) FILTER (failed) AS failed,
                   CAST(sum(duration_ms) AS BIGINT) AS total_ms, max(duration_ms) AS max_ms,
                   quantile_disc(duration_ms, 0.5) AS median_ms
            FROM folded WHERE duration_ms IS NOT NULL GROUP BY call""",
        "turn_tool_time": f"""WITH {with_turns}{FOLD.format(src="r")},
            w AS (
              SELECT f.session, r.turn, count(*) AS tools, CAST(sum(duration_ms) AS BIGINT) AS tool_ms
              FROM folded f JOIN r ON r.session = f.session AND r.seq = f.owner GROUP BY f.session, r.turn)
            SELECT t.session, t.turn, t.duration_ms, tools, tool_ms
            FROM turns t JOIN w ON w.session = t.session AND w.turn = t.turn""",
        "usage_deltas": deltas,
        "usage_attach": attach,
        "usage_attach_chunked": attach,
        "turn_usage": f"""WITH {SAMPLES}{TURN_SUMS}
            SELECT *, greatest(used_input - used_cached_input, 0) AS uncached_input,
                   greatest(used_output - used_reasoning_output, 0) AS visible_output,
                   CASE WHEN used_input > 0 THEN round(used_cached_input * 100 / used_input, 1) END AS cache_hit_percent
            FROM sums""",
        "session_tokens": f"""WITH {SAMPLES}
            SELECT session, arg_max(cum_output, seq) AS output, arg_max(cum_total, seq) AS total
            FROM k0 WHERE role = 'K' GROUP BY session""",
        "quota_latest": f"""WITH {QUOTA}
            SELECT session, "window", used_percent, window_minutes, resets_ms,
                   greatest(0, 100 - used_percent) AS remaining_percent
            FROM ok QUALIFY row_number() OVER (PARTITION BY session, "window" ORDER BY seq DESC) = 1""",
        "quota_alerts": alerts,
        "quota_alerts_chunked": alerts,
        "session_stats": stats,
        "newest_page": f"WITH {PAGES} SELECT * FROM newest",
        "page_before": f"WITH {PAGES} SELECT * FROM older",
        "page_header": f"""WITH {PAGES},
            h AS (SELECT session, min("index") AS a, max("index") AS b FROM older GROUP BY session),
            n AS (SELECT session, CAST(count(*) FILTER (creates) AS BIGINT) AS records FROM r GROUP BY session)
            SELECT n.session, a AS first_record, b AS last_record, coalesce(a - 1, 0) AS earlier_records,
                   coalesce(records - b, records) AS later_records, coalesce(a - 1, 0) > 0 AS has_earlier,
                   coalesce(records - b, records) > 0 AS has_later,
                   CASE WHEN a > 1 THEN a END AS next_before_record
            FROM n LEFT JOIN h ON h.session = n.session""",
        "retained_turns": f"""WITH {with_turns},
            pg AS (SELECT DISTINCT session, turn FROM r WHERE creates AND idx < 30)
            SELECT t.session, t.turn, pg.turn IS NOT NULL AS owns_page, status
            FROM turns t LEFT JOIN pg ON pg.session = t.session AND pg.turn = t.turn
            QUALIFY row_number() OVER (
              PARTITION BY t.session ORDER BY pg.turn IS NOT NULL DESC, t.turn DESC) <= 8""",
        "page_turns": f"""WITH {PAGES}{TURN_TABLE}
            SELECT t.session, t.turn, t.records, t.steps FROM turns t
            WHERE EXISTS (SELECT 1 FROM newest n WHERE n.session = t.session AND n.turn = t.turn)""",
        "page_merge": f"WITH {PAGES} SELECT * FROM newest UNION SELECT * FROM older",
        "warnings": f"""WITH {TURNS},
            w AS (
              SELECT session, seq, event_id, CASE WHEN role = 'R' AND creates THEN 'unmatched_tool_result'
                     WHEN split AND role = 'S' THEN 'overlapping_turn_start'
                     WHEN split THEN 'mismatched_turn_completion' END AS code FROM r)
            SELECT session, event_id, code FROM w WHERE code IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY session ORDER BY seq) <= 20""",
        "unique_record_ids": f"""WITH {TURNS},
            b AS (
              SELECT session, seq, event_id, idx,
                     CASE WHEN role = 'M' THEN 'assistant' ELSE 'tool-' || call END AS base FROM r WHERE creates),
            n AS (SELECT *, row_number() OVER (PARTITION BY session, base ORDER BY seq) AS nth FROM b)
            SELECT session, event_id, CASE WHEN nth = 1 THEN base ELSE substr(base, 1, 220) || '…' ||
                   substr(sha256(base || ':' || CAST(idx AS VARCHAR)), 1, 16) END AS record_id FROM n""",
        "revision": """WITH d AS (
              SELECT user_id AS session, strftime(ts, '%Y-%m-%d') AS path,
                     max(strftime(ts, '%Y-%m-%d %H:%M:%S.%f')) AS m, count(*) AS n
              FROM events GROUP BY ALL)
            SELECT session, sha256(string_agg(path || '|' || m || '|' || CAST(n AS VARCHAR), chr(10) ORDER BY path))
                   AS revision FROM d GROUP BY session""",
        "contract_report": contract,
        "overview_list": f"""WITH {CONV},
            n AS (SELECT * FROM ov WHERE NOT archived
                  QUALIFY row_number() OVER (PARTITION BY id ORDER BY modified_ms DESC, archived, stem) = 1)
            SELECT id, stem, title, turns, records, modified_ms, archived FROM n
            ORDER BY modified_ms DESC, archived, stem LIMIT 20""",
        "session_search": f"""WITH {CONV},
            n AS (SELECT * FROM ov QUALIFY row_number() OVER (PARTITION BY id ORDER BY modified_ms DESC, archived, stem) = 1)
            SELECT id, stem, title, cwd, model FROM n
            WHERE contains(lower(concat_ws(' ', id, title, cwd, model)), 'p3 m1')
            ORDER BY modified_ms DESC, archived, stem LIMIT 100""",
        "selector_resolve": f"""WITH {CONV},
            s AS (SELECT unnest(['latest','conv-20','conv-2','log-000000000005','log-00000000000','none']) AS selector),
            x AS (
              SELECT selector, min_by(stem, (-modified_ms, archived, stem)) AS stem
              FROM s JOIN ov ON selector = 'latest' OR selector = id OR selector = stem GROUP BY selector),
            ids AS (SELECT id AS name, arg_max(stem, modified_ms) AS stem FROM ov GROUP BY id
                    UNION ALL SELECT stem, stem FROM ov),
            p AS (
              SELECT selector, count(DISTINCT stem) AS files, min(stem) AS sole
              FROM s JOIN ids ON starts_with(name, selector) GROUP BY selector)
            SELECT s.selector, coalesce(x.stem, CASE WHEN files = 1 THEN sole END) AS stem,
                   CASE WHEN coalesce(x.stem, CASE WHEN files = 1 THEN sole END) IS NOT NULL THEN 'found'
                        WHEN files > 1 THEN 'ambiguous' ELSE 'not_found' END AS outcome
            FROM s LEFT JOIN x ON x.selector = s.selector LEFT JOIN p ON p.selector = s.selector""",
        "record_search": f"""WITH c AS (
              SELECT conv_id AS session, turn AS pos, role, text FROM conversations WHERE role IN ('user','assistant')),
            d AS (
              SELECT session, row_number() OVER (PARTITION BY session ORDER BY pos) AS "index", CAST(1 AS BIGINT) AS turn,
                     role AS kind, {_shortened('text', 220)} AS summary FROM c)
            SELECT * FROM d WHERE contains(lower(coalesce(summary, '')), 'the') OR contains(kind, 'the')""",
        "kind_filter": f"""WITH {RECORDS} SELECT session, "index", event, status FROM records WHERE kind = 'tool'""",
        "range_filter": f"""WITH {RECORDS}
            SELECT session, "index", started_ms, completed_ms FROM records
            WHERE started_ms <= 1705708800000 AND coalesce(completed_ms, started_ms) >= 1704844800000""",
        "summary_text": f"SELECT doc_id, {_shortened('text', 220)} AS summary FROM documents",
        "bounded_detail": """SELECT doc_id, CASE WHEN length(text) <= 12000 THEN text ELSE
              substr(text, 1, 12000) || chr(10) || chr(10) || '… truncated ' ||
              format('{:,}', length(text) - 12000) || ' characters' END AS detail FROM documents""",
        "bounded_ids": """SELECT doc_id, CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'none'
              WHEN length(text) <= 240 THEN text
              ELSE substr(text, 1, 220) || '…' || substr(sha256(text), 1, 16) END AS id FROM documents""",
        "path_redaction": r"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*', '') AS path FROM pages),
            c AS (SELECT *, regexp_replace(regexp_replace(path, '/+', '/', 'g'), '(.)/$', '\1') AS posix FROM p)
            SELECT page_id, CASE WHEN posix = '/wiki' THEN '~'
                   WHEN starts_with(posix, '/wiki/') THEN '~' || substr(posix, 6)
                   WHEN posix = '/' THEN '<absolute>'
                   WHEN starts_with(posix, '/') THEN '<absolute>/' || string_split(posix, '/')[-1]
                   ELSE posix END AS path FROM c""",
    }
    sources = {"records": "log_records", "turns": "log_turns", "sessions": "log_sessions", "quotas": "log_quota",
               "warnings": "log_warnings", "documents": "log_documents"}
    counted = [f"SELECT '{rule}' AS rule, (SELECT count(*) FROM ({found[sources[table]]})) AS \"rows\""
               for table, (part, rules) in CONTRACT.items() for rule in (f"{part}.{name}" for name in rules.split())]
    whole = [f"document.{name}" for name in CONTRACT["documents"][1].split()]
    counted += [f"SELECT '{rule}' AS rule, (SELECT count(*) FROM ({found['log_documents']})) AS \"rows\"" for rule in FORMAT
                if rule not in whole]
    found["log_contract"] = "SELECT *, CAST(0 AS BIGINT) AS broken FROM (" + " UNION ALL ".join(counted) + ")"
    return found
