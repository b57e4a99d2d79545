"""The catalog's queries in plain SQL, to compare results with. Independent of the operators:
self joins and ordinary windows over whole histories, fit for small tables only."""

from __future__ import annotations

USAGE = """
usage AS (
  SELECT ts, 'C' || (user_id % 3) AS capacity_key, 'cap-' || (user_id % 3) AS capacity_id,
    event_type AS item_id,
    CASE event_type WHEN 'signup' THEN 'Signup Model' WHEN 'view' THEN 'Page Views'
      WHEN 'click' THEN 'Click Stream' WHEN 'error' THEN 'Regulatory Errors'
      WHEN 'purchase' THEN 'Sales Purchases' END AS item_name,
    CASE event_type WHEN 'signup' THEN 'SemanticModel' WHEN 'view' THEN 'Dataset'
      WHEN 'click' THEN 'Notebook' WHEN 'error' THEN 'Pipeline'
      WHEN 'purchase' THEN 'SemanticModel' END AS item_kind,
    CASE event_type WHEN 'signup' THEN 'ws-1' WHEN 'view' THEN 'ws-1' WHEN 'click' THEN 'ws-2'
      WHEN 'error' THEN '' WHEN 'purchase' THEN 'ws-3' END AS workspace_id,
    CASE event_type WHEN 'signup' THEN 'Core' WHEN 'view' THEN 'Core' WHEN 'click' THEN 'Streams'
      ELSE '' END AS workspace_name,
    value AS cu_seconds
  FROM events),
used AS (
  SELECT capacity_key, capacity_id, item_id, item_name, item_kind, workspace_id, workspace_name,
    date_trunc('hour', ts) + INTERVAL 1 HOUR - INTERVAL 1 SECOND AS ts, sum(cu_seconds) AS amount
  FROM usage GROUP BY ALL),
"""

DAILY_USAGE = """
usage AS (
  SELECT l_shipdate AS ts, 'C' || (l_suppkey % 3) AS capacity_key, 'cap-' || (l_suppkey % 3) AS capacity_id,
    l_suppkey::VARCHAR AS item_id, 'Supplier ' || l_suppkey AS item_name, 'Dataset' AS item_kind,
    'ws-1' AS workspace_id, 'Core' AS workspace_name, l_quantity AS cu_seconds
  FROM lineitem),
used AS (
  SELECT capacity_key, capacity_id, item_id, item_name, item_kind, workspace_id, workspace_name,
    date_trunc('day', ts) + INTERVAL 1 DAY - INTERVAL 1 SECOND AS ts, sum(cu_seconds) AS amount
  FROM usage GROUP BY ALL),
"""

SNAPS = """
snaps AS (
  SELECT ts, capacity_key, capacity_id, item_id, item_name, item_kind, workspace_id, workspace_name,
    round(sum(amount) OVER (PARTITION BY capacity_key, item_id, ts::DATE ORDER BY ts
      ROWS UNBOUNDED PRECEDING), 2) AS cu_seconds_today
  FROM used),
pairs AS (
  SELECT *, lag(ts) OVER w AS prev_ts, lag(cu_seconds_today) OVER w AS prev_cu
  FROM snaps WINDOW w AS (PARTITION BY capacity_key, item_id ORDER BY ts)),
ivs AS (
  SELECT capacity_key, item_id, item_name, item_kind, workspace_id, workspace_name,
    prev_ts AS window_start, ts AS window_end,
    greatest(0.0::DOUBLE, CASE WHEN prev_ts::DATE = ts::DATE AND cu_seconds_today >= prev_cu
      THEN cu_seconds_today - prev_cu ELSE cu_seconds_today END) AS cu_seconds
  FROM pairs WHERE prev_ts < ts),
"""

POLICIES = """
pol AS (
  SELECT * FROM (VALUES
    ('C0', 'CAP-0', 'EM1', 1.0::DOUBLE, 'enforce', 60, 7, 'hour_of_day', 4, 'median', 10.0::DOUBLE,
      1.2::DOUBLE, 1.5::DOUBLE, 1.8::DOUBLE, 20.0::DOUBLE, 1, 180, 2, 3.0::DOUBLE, NULL::DOUBLE),
    ('C1', 'cap-1', 'em2', 2.0, 'enforce', 60, 28, 'hour_of_week', 2, 'p75', 10.0,
      1.2, 1.5, 1.8, 20.0, 2, 60, 1, 3.0, 4.0),
    ('C2', 'cap-2', NULL, NULL, 'observe', 60, 14, 'hour_of_day', 4, 'p90', 0.0,
      1.1, 1.5, 1.8, 20.0, 1, 60, 2, 3.0, NULL),
    ('C4', 'cap-4', 'X9', NULL, 'enforce', 60, 7, 'hour_of_day', 4, 'median', 10.0,
      1.2, 1.5, 1.8, 20.0, 1, 60, 2, 3.0, NULL)
  ) t(capacity_key, capacity_id, sku, rate, mode, target, lookback, bucket_mode, min_days, method, trim,
      alert, throttle, kill, min_cu, breaches, cooldown, max_actions, stretch, floor_pct)),
"""

DAILY_POLICIES = """
pol AS (
  SELECT 'C' || k AS capacity_key, 'enforce' AS mode, 1440 AS target, 90 AS lookback, 'hour_of_day' AS bucket_mode,
    4 AS min_days, 'median' AS method, 10.0::DOUBLE AS trim, 1.2::DOUBLE AS alert, 1.5::DOUBLE AS throttle,
    1.8::DOUBLE AS kill, 10.0::DOUBLE AS min_cu, 3.0::DOUBLE AS stretch, 2 AS breaches, 2880 AS cooldown,
    20 AS max_actions, NULL::DOUBLE AS floor_pct, NULL::DOUBLE AS rate
  FROM range(3) r(k)),
"""

SCORED = """
cad AS (
  SELECT *, CASE WHEN minutes > 0 THEN cu_seconds * (target / minutes) ELSE cu_seconds END AS normalized,
    CASE WHEN bucket_mode = 'hour_of_week'
      THEN 'd' || (isodow(window_end) - 1) || 'h' || hour(window_end) ELSE 'h' || hour(window_end) END AS bucket,
    minutes > 0 AND minutes / target >= 1.0::DOUBLE / stretch AND minutes / target <= stretch AS comparable
  FROM (SELECT i.*, p.* EXCLUDE (capacity_key, capacity_id), date_diff('second', window_start, window_end) / 60.0::DOUBLE AS minutes,
      window_end::DATE AS day
    FROM ivs i JOIN pol p USING (capacity_key))),
past AS (
  SELECT a.capacity_key, a.item_id, a.window_end, list_sort(list(h.normalized)) AS arr,
    count(*) AS samples, count(DISTINCT h.day) AS days
  FROM cad a JOIN cad h ON a.capacity_key = h.capacity_key AND a.item_id = h.item_id AND a.bucket = h.bucket
    AND a.comparable AND h.comparable AND a.day - h.day BETWEEN 1 AND a.lookback
  GROUP BY ALL),
kept AS (
  SELECT c.*, p.samples, p.days,
    CASE WHEN trim > 0 AND p.samples >= 4
      THEN p.arr[1:greatest(1, floor(p.samples * (1 - trim / 100.0::DOUBLE)))::INT] ELSE p.arr END AS arr
  FROM cad c LEFT JOIN past p USING (capacity_key, item_id, window_end) WHERE c.comparable),
based AS (
  SELECT * EXCLUDE (arr), CASE method WHEN 'mean' THEN list_avg(arr)
    WHEN 'median' THEN list_median(arr)
    WHEN 'p75' THEN arr[1 + round_even(0.75::DOUBLE * (len(arr) - 1), 0)::INT]
    WHEN 'p90' THEN arr[1 + round_even(0.9::DOUBLE * (len(arr) - 1), 0)::INT] END AS value
  FROM kept),
scored AS (
  SELECT *, CASE WHEN ratio >= kill THEN 3 WHEN ratio >= throttle THEN 2 WHEN ratio >= alert THEN 1 ELSE 0 END AS tier
  FROM (SELECT *, CASE WHEN days > 0 AND value > 0 THEN normalized / value END AS ratio FROM based)),
"""

LABELS = "['none', 'alert', 'throttle', 'kill']"

FROZEN = """CASE WHEN capacity_key = 'C1' AND isodow(window_end) <= 5 AND hour(window_end) BETWEEN 8 AND 11 THEN 'morning'
    WHEN capacity_key = 'C1' AND day(window_end) IN (29, 30) THEN 'month_end' END"""
PROTECTED = """((capacity_key = 'C1' AND (item_kind = 'Pipeline' OR regexp_matches(item_name, '^sales', 'i')))
    OR (capacity_key = 'C2' AND workspace_id = 'ws-2'))"""

GIVEN = """
given AS (
  SELECT *, (hour(window_end) % 2)::INT AS streak,
    CASE hour(window_end) % 3 WHEN 0 THEN window_end - INTERVAL 90 MINUTE WHEN 1 THEN window_end - INTERVAL 200 MINUTE END AS last_action_ts
  FROM scored),
"""

# The true state of every cycle, found by walking each capacity's cycles one after the other.
CARRIED = f"""
islands AS (
  SELECT *, sum(CASE WHEN tier = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY capacity_key, item_id ORDER BY window_end ROWS UNBOUNDED PRECEDING) AS island
  FROM scored),
runs AS (
  SELECT *, sum(CASE WHEN tier > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY capacity_key, item_id, island ORDER BY window_end ROWS UNBOUNDED PRECEDING) AS run
  FROM islands),
chained AS (
  SELECT *, lag(run, 1, 0) OVER (PARTITION BY capacity_key, item_id ORDER BY window_end)::INT AS streak,
    dense_rank() OVER (PARTITION BY capacity_key ORDER BY item_id) AS idx,
    CASE WHEN rate * max(minutes) OVER (PARTITION BY capacity_key, window_end) * 60 > 0
      THEN 100.0::DOUBLE * sum(cu_seconds) OVER (PARTITION BY capacity_key, window_end)
        / (rate * max(minutes) OVER (PARTITION BY capacity_key, window_end) * 60) END AS pct
  FROM runs),
eligible AS (
  SELECT * FROM chained WHERE tier >= 2 AND days >= min_days AND normalized >= min_cu AND mode = 'enforce' AND NOT {PROTECTED}
    AND {FROZEN} IS NULL AND streak + 1 >= breaches AND NOT coalesce(pct < floor_pct, false)),
turns AS (
  SELECT capacity_key, window_end, any_value(max_actions) AS most, any_value(cooldown) * 60 AS quiet, list(idx) AS wants,
    epoch(window_end)::BIGINT AS sec, row_number() OVER (PARTITION BY capacity_key ORDER BY window_end) AS n
  FROM eligible GROUP BY capacity_key, window_end),
walk AS (
  SELECT DISTINCT capacity_key, 0::BIGINT AS n, [NULL, NULL, NULL, NULL, NULL]::BIGINT[] AS last, []::BIGINT[] AS acts, NULL::TIMESTAMP AS moment
  FROM turns
  UNION ALL
  SELECT capacity_key, n, CASE WHEN len(acts) > most THEN last
      ELSE list_transform(range(1, 6), lambda i: CASE WHEN list_contains(acts, i) THEN sec ELSE last[i] END) END,
    CASE WHEN len(acts) > most THEN [] ELSE acts END, window_end
  FROM (SELECT t.*, w.last, list_filter(t.wants, lambda i: coalesce(t.sec - w.last[i] >= t.quiet, true)) AS acts
    FROM walk w JOIN turns t ON t.capacity_key = w.capacity_key AND t.n = w.n + 1)),
acted AS (
  SELECT capacity_key, unnest(acts) AS idx, moment FROM walk WHERE n > 0),
given AS (
  SELECT c.* EXCLUDE (island, run, idx, pct), max(a.moment) AS last_action_ts
  FROM chained c LEFT JOIN acted a ON a.capacity_key = c.capacity_key AND a.idx = c.idx AND a.moment < c.window_end
  GROUP BY ALL),
last_state AS (
  SELECT c.capacity_key, c.item_id, CASE WHEN c.tier > 0 THEN c.streak + 1 ELSE 0 END AS streak, {LABELS}[c.tier + 1] AS last_tier,
    max(a.moment) AS last_action_ts, c.window_end AS last_seen_ts
  FROM (SELECT * FROM chained QUALIFY row_number() OVER (PARTITION BY capacity_key, item_id ORDER BY window_end DESC) = 1) c
    LEFT JOIN acted a ON a.capacity_key = c.capacity_key AND a.idx = c.idx
  GROUP BY ALL),
"""

ASSESSED = f"""
held AS (
  SELECT *, cooldown > 0 AND coalesce(date_diff('second', last_action_ts, window_end) < cooldown * 60, false) AS in_cooldown,
    {FROZEN} AS frozen, {PROTECTED} AS protected
  FROM given),
reasons AS (
  SELECT *, CASE WHEN tier = 0 THEN [] WHEN days < min_days THEN ['insufficient_baseline']
    WHEN normalized < min_cu THEN ['below_min_cu']
    ELSE list_filter([CASE WHEN protected THEN 'protected' END, CASE WHEN mode <> 'enforce' THEN 'observe_mode' END,
      CASE WHEN frozen IS NOT NULL THEN 'freeze_window:' || frozen END, CASE WHEN in_cooldown THEN 'cooldown' END,
      CASE WHEN streak + 1 < breaches THEN 'awaiting_consecutive_breaches' END], lambda x: x IS NOT NULL) END AS why
  FROM held),
assessed AS (
  SELECT *, CASE WHEN tier = 0 OR days < min_days OR normalized < min_cu THEN 0
    WHEN len(why) > 0 THEN least(tier, 1) ELSE tier END AS eff
  FROM reasons),
use AS (
  SELECT capacity_key, window_end, CASE WHEN max(rate) * max(minutes) * 60 > 0
    THEN 100.0::DOUBLE * sum(cu_seconds) / (max(rate) * max(minutes) * 60) END AS utilization
  FROM scored GROUP BY ALL),
guarded AS (
  SELECT * REPLACE (CASE WHEN idle THEN list_append(why, 'capacity_utilization_below_' || floor_pct::VARCHAR) ELSE why END AS why,
    CASE WHEN idle THEN 1 ELSE eff END AS eff)
  FROM (SELECT a.*, u.utilization, coalesce(u.utilization < a.floor_pct AND a.eff >= 2, false) AS idle
    FROM assessed a JOIN use u USING (capacity_key, window_end))),
counted AS (
  SELECT *, eff >= 2 AND count(*) FILTER (eff >= 2) OVER (PARTITION BY capacity_key, window_end) > max_actions AS over
  FROM guarded),
gated AS (
  SELECT * REPLACE (CASE WHEN over THEN list_append(why, 'max_actions_per_run') ELSE why END AS why,
    CASE WHEN over THEN 1 ELSE eff END AS eff)
  FROM counted),
"""

OUTBOX = """
work AS (
  SELECT 'C' || (user_id % 3) AS capacity_key, event_type AS item_id,
    date_trunc('hour', ts) + INTERVAL 1 HOUR - INTERVAL 1 SECOND AS window_end,
    ['refresh', 'job', 'session'][(event_id % 3 + 1)::INT] AS work_kind, event_id::VARCHAR AS target,
    ['Unknown', 'InProgress', 'NotStarted', 'Completed'][(user_id % 4 + 1)::INT] AS status
  FROM events),
running AS (
  SELECT capacity_key, item_id, window_end, target, CASE WHEN work_kind = 'refresh' AND status = 'Unknown' THEN 'cancel_refresh'
    WHEN work_kind = 'job' AND status IN ('InProgress', 'NotStarted') THEN 'cancel_fabric_jobs'
    WHEN work_kind = 'session' THEN 'kill_xmla_sessions' END AS action
  FROM work),
steps AS (
  SELECT *, CASE WHEN action IN ('cancel_refresh', 'kill_xmla_sessions') AND NOT dataset THEN 'ignorado: kind=' || item_kind
      WHEN action = 'cancel_refresh' AND workspace_id = '' THEN 'workspace_id ausente no Metrics App'
      WHEN action = 'cancel_fabric_jobs' AND workspace_id = '' THEN 'workspace_id ausente'
      WHEN action = 'kill_xmla_sessions' AND workspace_name = '' THEN 'workspace_name não resolvido' END AS refused
  FROM (SELECT capacity_key, item_id, window_end, item_kind, workspace_id, workspace_name, s.step, s.action,
      item_kind IN ('Dataset', 'SemanticModel', 'Model') AS dataset
    FROM gated, (VALUES (0, 2, 'cancel_refresh'), (1, 2, 'cancel_fabric_jobs'), (2, 3, 'kill_xmla_sessions')) s(step, from_tier, action)
    WHERE gated.eff >= s.from_tier)),
plan AS (
  SELECT *, refused IS NULL OR starts_with(refused, 'ignorado') AS ok FROM steps),
results AS (
  SELECT p.capacity_key, p.item_id, p.window_end, p.step, p.action, p.ok,
    CASE WHEN refused IS NULL THEN coalesce(n, 0) ELSE 0 END AS targets,
    coalesce(refused, CASE WHEN coalesce(n, 0) = 0
      THEN ['nenhum refresh em andamento', 'nenhum job em execução', 'nenhuma sessão ativa'][step + 1]
      ELSE ['[dry-run] cancelaria ', '[dry-run] cancelaria ', '[dry-run] mataria '][step + 1] || n END) AS detail
  FROM plan p LEFT JOIN (SELECT capacity_key, item_id, window_end, action, count(*) AS n FROM running
      WHERE action IS NOT NULL GROUP BY ALL) r USING (capacity_key, item_id, window_end, action)),
done AS (
  SELECT capacity_key, item_id, window_end,
    string_agg(action || CASE WHEN ok THEN ':ok' ELSE ':fail' END, ',' ORDER BY step) AS actions,
    string_agg(detail, '; ' ORDER BY step) AS detail,
    string_agg(action || CASE WHEN ok THEN '=ok (' ELSE '=FALHOU (' END || detail || ')', ' | ' ORDER BY step) AS spoken,
    bool_or(ok AND targets > 0) AS action_taken
  FROM results GROUP BY ALL),
full_rows AS (
  SELECT g.*, coalesce(d.actions, '') AS actions, coalesce(d.detail, '') AS detail, d.spoken
  FROM gated g LEFT JOIN done d USING (capacity_key, item_id, window_end) WHERE tier > 0),
audit AS (
  SELECT window_end AS ts, 'run-1' AS run_id, capacity_key, mode, item_id, item_name, item_kind, workspace_id,
    {labels}[tier + 1] AS tier, {labels}[eff + 1] AS effective_tier, round(ratio, 6) AS ratio,
    round(cu_seconds, 6) AS cu_seconds, round(value, 6) AS baseline_cu_seconds, days::INT AS baseline_days,
    streak, array_to_string(why, ',') AS suppressions, actions, detail
  FROM full_rows),
messages AS (
  SELECT capacity_key, item_id, window_end, tier,
    CASE tier WHEN 1 THEN '⚠️' WHEN 2 THEN '🛑' WHEN 3 THEN '🔴' END || ' **[' || capacity_key || ']** `' || item_name
    || '` (' || item_kind || ') a **' || format('{{:.2f}}', ratio) || 'x** da baseline' || chr(10)
    || 'Consumo: ' || format('{{:,.0f}}', cu_seconds) || ' CU·s em ' || format('{{:.0f}}', minutes) || ' min | baseline: '
    || format('{{:,.0f}}', value) || ' CU·s | workspace: ' || CASE WHEN workspace_name = '' THEN workspace_id ELSE workspace_name END
    || chr(10) || 'Detectado: `' || {labels}[tier + 1] || '` → aplicado: `' || {labels}[eff + 1] || '` (modo `' || mode || '`)'
    || CASE WHEN len(why) > 0 THEN chr(10) || 'Contido por: ' || array_to_string(why, ', ') ELSE '' END
    || coalesce(chr(10) || 'Ações: ' || spoken, '') || chr(10) || 'Item ID: `' || item_id || '`' AS text
  FROM full_rows),
""".format(labels=LABELS)

LEGACY = """
leg AS (
  SELECT capacity_key, item_id, item_name, item_kind, ts, ts::DATE AS date, hour(ts) AS hour_bucket,
    CASE WHEN cu_seconds_today - coalesce(prev, 0) < 0 THEN cu_seconds_today ELSE cu_seconds_today - coalesce(prev, 0) END AS cu_interval
  FROM (SELECT *, lag(cu_seconds_today) OVER (PARTITION BY capacity_key, item_id, ts::DATE ORDER BY ts) AS prev FROM snaps)),
leg_base AS (
  SELECT capacity_key, item_id, hour_bucket, avg(cu_interval) AS baseline_cu_s, count(DISTINCT date) AS baseline_days
  FROM leg WHERE date BETWEEN DATE '2024-01-23' AND DATE '2024-01-29' GROUP BY ALL),
leg_now AS (
  SELECT * FROM leg WHERE date = DATE '2024-01-30' AND ts = (SELECT max(ts) FROM leg WHERE date = DATE '2024-01-30')),
leg_scored AS (
  SELECT n.*, baseline_cu_s, baseline_days, CASE WHEN baseline_cu_s <> 0 THEN cu_interval / baseline_cu_s END AS ratio
  FROM leg_now n LEFT JOIN leg_base USING (capacity_key, item_id, hour_bucket)),
"""

CALIBRATED = """
ratios AS (
  SELECT * FROM scored WHERE ratio IS NOT NULL AND days >= min_days AND normalized >= min_cu),
item_cu AS (
  SELECT capacity_key, item_id, arg_min(item_name, window_end) AS item_name, arg_min(item_kind, window_end) AS item_kind,
    count(*) AS samples, median(normalized) AS median_cu, list_sort(list(normalized)) AS arr
  FROM scored GROUP BY ALL),
item_ratio AS (
  SELECT capacity_key, item_id, max(ratio) AS max_ratio, count(*) FILTER (ratio >= alert) AS alert,
    count(*) FILTER (ratio >= throttle) AS throttle, count(*) FILTER (ratio >= kill) AS kill
  FROM ratios GROUP BY ALL),
profiles AS (
  SELECT c.capacity_key, c.item_id, item_name, item_kind, samples, median_cu,
    arr[1 + round_even(0.95::DOUBLE * (samples - 1), 0)::BIGINT] AS p95_cu, coalesce(max_ratio, 0.0) AS max_ratio,
    coalesce(alert, 0) AS alert, coalesce(throttle, 0) AS throttle, coalesce(kill, 0) AS kill
  FROM item_cu c LEFT JOIN item_ratio USING (capacity_key, item_id)),
tails AS (
  SELECT capacity_key, arr[1 + round_even(0.95::DOUBLE * (n - 1), 0)::BIGINT] AS p95,
    arr[1 + round_even(0.99::DOUBLE * (n - 1), 0)::BIGINT] AS p99, arr[1 + round_even(0.995::DOUBLE * (n - 1), 0)::BIGINT] AS p995
  FROM (SELECT capacity_key, list_sort(list(ratio)) AS arr, count(*) AS n FROM ratios GROUP BY ALL)),
suggested AS (
  SELECT *, round(greatest(s_throttle + 0.3::DOUBLE, p995), 2) AS s_kill
  FROM (SELECT *, round(greatest(s_alert + 0.2::DOUBLE, p99), 2) AS s_throttle
    FROM (SELECT *, round(greatest(1.2::DOUBLE, p95), 2) AS s_alert FROM tails))),
suggestions AS (
  SELECT capacity_key, coalesce(s_alert, alert) AS suggested_alert, coalesce(s_throttle, throttle) AS suggested_throttle,
    coalesce(s_kill, kill) AS suggested_kill
  FROM pol LEFT JOIN suggested USING (capacity_key)),
min_cus AS (
  SELECT capacity_key, round_even(arr[1 + round_even(0.5::DOUBLE * (n - 1), 0)::BIGINT], 0) AS suggested_min_cu
  FROM (SELECT capacity_key, list_sort(list(normalized)) AS arr, count(*) AS n FROM scored GROUP BY ALL)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY capacity_key ORDER BY kill * 100 + max_ratio DESC, item_id) AS rank FROM profiles),
noisy AS (
  SELECT capacity_key, string_agg(item_name, ',' ORDER BY r) AS noisy_items
  FROM (SELECT *, row_number() OVER (PARTITION BY capacity_key ORDER BY rank) AS r FROM ranked WHERE throttle >= 3)
  WHERE r <= 10 GROUP BY ALL),
report AS (
  SELECT p.capacity_key, coalesce(t.d, 0) AS days_of_history, coalesce(t.n, 0) AS total_intervals,
    coalesce(w.would_alert, 0) AS would_alert, coalesce(w.would_throttle, 0) AS would_throttle, coalesce(w.would_kill, 0) AS would_kill,
    s.suggested_alert, s.suggested_throttle, s.suggested_kill,
    CASE WHEN a.intervals IS NULL THEN p.min_cu ELSE coalesce(m.suggested_min_cu, 0) END AS suggested_min_cu,
    coalesce(n.noisy_items, '') AS noisy_items,
    concat_ws(',', CASE WHEN a.intervals IS NULL THEN 'no_history' END,
      CASE WHEN a.discarded > 0 THEN 'discarded_intervals:' || a.discarded END,
      CASE WHEN n.noisy_items IS NOT NULL THEN 'noisy_items' END,
      CASE WHEN a.intervals IS NOT NULL AND coalesce(t.d, 0) < 7 THEN 'few_days:' || coalesce(t.d, 0) END) AS notes
  FROM pol p LEFT JOIN suggestions s USING (capacity_key)
    LEFT JOIN (SELECT capacity_key, count(*) AS intervals, count(*) FILTER (NOT comparable) AS discarded FROM cad GROUP BY ALL) a USING (capacity_key)
    LEFT JOIN (SELECT capacity_key, count(*) AS n, count(DISTINCT day) AS d FROM scored GROUP BY ALL) t USING (capacity_key)
    LEFT JOIN (SELECT capacity_key, count(*) FILTER (ratio >= alert) AS would_alert, count(*) FILTER (ratio >= throttle) AS would_throttle,
      count(*) FILTER (ratio >= kill) AS would_kill FROM ratios GROUP BY ALL) w USING (capacity_key)
    LEFT JOIN min_cus m USING (capacity_key) LEFT JOIN noisy n USING (capacity_key)),
"""

STATES = """
states AS (
  SELECT capacity_key, item_id, (count(*) FILTER (tier > 0) % 3)::INT AS streak, 'alert' AS last_tier,
    max(window_end) FILTER (tier > 1) AS last_action_ts, max(window_end) AS last_seen_ts
  FROM scored GROUP BY ALL),
"""

HOURLY = USAGE + SNAPS
SCORED_HOURLY = HOURLY + POLICIES + SCORED
GATED_HOURLY = SCORED_HOURLY + GIVEN + ASSESSED
REPLAYED_HOURLY = SCORED_HOURLY + CARRIED + ASSESSED
FULL_HOURLY = GATED_HOURLY + OUTBOX
DAILY_SCORED = DAILY_USAGE + SNAPS + DAILY_POLICIES.replace("capacity_key, 'enforce'", "capacity_key, NULL AS capacity_id, 'enforce'") + SCORED

ROW = "capacity_key, item_id, window_end"
INTERVAL_COLUMNS = (
    "capacity_key, item_id, item_name, item_kind, workspace_id, workspace_name, window_start, window_end, "
    "round(cu_seconds, 6) AS cu_seconds"
)
SNAPSHOT_COLUMNS = (
    "ts, capacity_key, capacity_id, item_id, item_name, item_kind, workspace_id, workspace_name, cu_seconds_today"
)
PROFILE_COLUMNS = (
    "capacity_key, item_id, item_name, item_kind, samples, round(median_cu, 6) AS median_cu, round(p95_cu, 6) AS p95_cu, "
    "round(max_ratio, 6) AS max_ratio, alert, throttle, kill"
)


def verdicts(table: str) -> str:
    return (
        f"SELECT {ROW}, round(ratio, 6) AS ratio, tier, eff AS effective_tier, streak, "
        f"array_to_string(why, ',') AS suppressions FROM {table}"
    )


def statement(parts: str, select: str) -> str:
    return "WITH RECURSIVE " + parts.strip().rstrip(",") + "\n" + select


def hourly_samples(select: str) -> str:
    samples = """
samples AS (
  SELECT capacity_key, item_id, hour(window_end) AS hour, list_sort(list(normalized)) AS arr FROM cad WHERE comparable GROUP BY ALL),
"""
    return statement(SCORED_HOURLY + samples, f"SELECT capacity_key, item_id, hour, {select} FROM samples")


DIRTY = """
dirty AS (
  SELECT event_id, CASE minute(ts) % 10 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE event_type END AS item_id,
    CASE WHEN minute(ts) % 4 = 0 THEN '' ELSE 'Name ' || event_type END AS item_name,
    CASE WHEN minute(ts) % 5 = 0 THEN NULL ELSE 'Dataset' END AS item_kind,
    CASE WHEN minute(ts) % 6 = 0 THEN NULL ELSE 'ws-1' END AS workspace_id,
    CASE minute(ts) % 7 WHEN 0 THEN 'n/a' WHEN 1 THEN NULL WHEN 2 THEN '' ELSE value::VARCHAR END AS cu
  FROM events),
"""

LAST = """
last_of_day AS (
  SELECT * FROM snaps QUALIFY row_number() OVER (PARTITION BY capacity_key, item_id, ts::DATE ORDER BY ts DESC) = 1),
newest AS (
  SELECT * FROM snaps QUALIFY row_number() OVER (PARTITION BY capacity_key, item_id ORDER BY ts DESC) = 1),
"""

PAST_OF_LAST_DAY = """
old AS (
  SELECT * FROM cad WHERE comparable AND DATE '2024-01-30' - day BETWEEN 1 AND lookback),
old_arr AS (
  SELECT capacity_key, item_id, bucket, any_value(method) AS method, any_value(trim) AS trim, list_sort(list(normalized)) AS arr,
    count(*) AS samples, count(DISTINCT day) AS days FROM old GROUP BY capacity_key, item_id, bucket),
old_kept AS (
  SELECT * REPLACE (CASE WHEN trim > 0 AND samples >= 4
    THEN arr[1:greatest(1, floor(samples * (1 - trim / 100.0::DOUBLE)))::INT] ELSE arr END AS arr) FROM old_arr),
old_base AS (
  SELECT *, CASE method WHEN 'median' THEN list_median(arr)
    WHEN 'p75' THEN arr[1 + round_even(0.75::DOUBLE * (len(arr) - 1), 0)::INT]
    WHEN 'p90' THEN arr[1 + round_even(0.9::DOUBLE * (len(arr) - 1), 0)::INT] END AS value FROM old_kept),
"""

STREAKS = """
islands AS (
  SELECT *, sum(CASE WHEN tier = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY capacity_key, item_id ORDER BY window_end ROWS UNBOUNDED PRECEDING) AS island
  FROM scored),
runs AS (
  SELECT *, sum(CASE WHEN tier > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY capacity_key, item_id, island ORDER BY window_end ROWS UNBOUNDED PRECEDING) AS run
  FROM islands),
"""

ORACLE = {
    "daily_cumulative": statement(
        USAGE,
        "SELECT capacity_key, capacity_id, item_id, item_name, item_kind, workspace_id, workspace_name, ts::DATE::VARCHAR AS day, "
        "round(sum(cu_seconds), 2) AS cu_seconds_today FROM usage GROUP BY ALL",
    ),
    "cumulative_snapshots": statement(HOURLY, f"SELECT {SNAPSHOT_COLUMNS} FROM snaps"),
    "standardize_snapshots": statement(
        HOURLY,
        "SELECT ts, capacity_key, item_id, item_name, item_kind, workspace_id, workspace_name, cu_seconds_today FROM snaps",
    ),
    "clean_snapshots": statement(
        DIRTY,
        "SELECT event_id, item_id, coalesce(nullif(item_name, ''), item_id) AS item_name, coalesce(item_kind, 'Unknown') AS item_kind, "
        "coalesce(workspace_id, '') AS workspace_id, '' AS workspace_name, coalesce(try_cast(nullif(cu, '') AS DOUBLE), 0) AS cu_seconds_today "
        "FROM dirty WHERE item_id <> '' AND (cu IS NULL OR cu <> 'n/a')",
    ),
    "failure_isolation": statement(
        DIRTY,
        "SELECT event_id, item_id, cu AS cu_seconds_today, CASE WHEN item_id IS NULL OR item_id = '' THEN 'no_item' ELSE 'unreadable_consumption' END AS reason "
        "FROM dirty WHERE item_id IS NULL OR item_id = '' OR cu = 'n/a'",
    ),
    "pick_alias_profile": statement(
        HOURLY,
        "SELECT capacity_key, item_id, count(*) AS readings, 'fabric_metrics_v2' AS profile FROM snaps GROUP BY ALL",
    ),
    "union_capacities": statement(
        USAGE,
        "SELECT capacity_key, item_id, ts, ts::DATE::VARCHAR AS day, hour(ts) AS hour, isodow(ts) - 1 AS dow, cu_seconds FROM usage "
        "WHERE capacity_key IN ('C0', 'C1', 'C2')",
    ),
    "write_snapshots": statement(
        HOURLY,
        "SELECT * REPLACE (CASE WHEN hour(ts) >= 12 THEN cu_seconds_today + 1 ELSE cu_seconds_today END AS cu_seconds_today) "
        f"FROM (SELECT {SNAPSHOT_COLUMNS} FROM snaps)",
    ),
    "dedup_latest_by_key": statement(
        HOURLY + LAST, "SELECT capacity_key, item_id, ts::DATE::VARCHAR AS day, ts, cu_seconds_today FROM last_of_day"
    ),
    "write_intervals": statement(
        HOURLY,
        f"SELECT {ROW}, round(cu_seconds, 6) AS cu_seconds, window_end::DATE::VARCHAR AS day, hour(window_end) AS hour, "
        "isodow(window_end) - 1 AS dow FROM ivs",
    ),
    "load_intervals": statement(
        HOURLY,
        f"SELECT {ROW}, round(cu_seconds, 6) AS cu_seconds, window_end::DATE::VARCHAR AS day, hour(window_end) AS hour, "
        "isodow(window_end) - 1 AS dow FROM ivs WHERE capacity_key = 'C1' AND hour(window_end) IN (8, 14, 20) "
        "AND window_end::DATE >= DATE '2024-01-09' AND window_end::DATE < DATE '2024-01-16'",
    ),
    "write_events": statement(FULL_HOURLY, "SELECT * FROM audit"),
    "load_events": statement(
        FULL_HOURLY, "SELECT * FROM audit WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND capacity_key = 'C0'"
    ),
    "load_states": statement(SCORED_HOURLY + STATES, "SELECT * FROM states"),
    "merge_states": statement(
        SCORED_HOURLY + STATES,
        "SELECT capacity_key, item_id, CASE WHEN changed THEN streak + 10 ELSE streak END AS streak, "
        "CASE WHEN changed THEN 'kill' ELSE last_tier END AS last_tier, CASE WHEN NOT changed THEN last_action_ts END AS last_action_ts, "
        "CASE WHEN changed THEN last_seen_ts + INTERVAL 1 DAY ELSE last_seen_ts END AS last_seen_ts "
        "FROM (SELECT *, item_id IN ('view', 'signup', 'purchase') AS changed FROM states)",
    ),
    "prune_snapshots": statement(
        HOURLY, f"SELECT {SNAPSHOT_COLUMNS} FROM snaps WHERE ts >= TIMESTAMP '2024-01-12 12:00:00'"
    ),
    "events_json": statement(FULL_HOURLY, "SELECT item_id, capacity_key, tier, suppressions, streak FROM audit"),
    "collect_history_sql": statement(
        HOURLY,
        f"SELECT {ROW}, round(cu_seconds, 6) AS cu_seconds FROM ivs ORDER BY window_end DESC, capacity_key, item_id LIMIT 100",
    ),
    "is_comparable": statement(SCORED_HOURLY, f"SELECT {ROW}, comparable FROM cad"),
    "enabled_capacities": statement(
        USAGE,
        "SELECT capacity_key, count(*) AS readings, round(sum(cu_seconds), 6) AS cu_seconds FROM usage "
        "WHERE capacity_key IN ('C0', 'C2') GROUP BY ALL",
    ),
    "is_protected": statement(HOURLY, f"SELECT {ROW}, {PROTECTED} AS protected FROM ivs"),
    "freeze_window": statement(HOURLY, f"SELECT {ROW}, {FROZEN} AS frozen_by FROM ivs"),
    "min_tier_filter": statement(
        SCORED_HOURLY,
        f"SELECT {ROW}, channel, tier FROM scored, (VALUES ('console', 1), ('teams', 3)) c(channel, least_tier) WHERE tier >= least_tier",
    ),
    "legacy_anomaly_filter": statement(
        HOURLY + LEGACY,
        "SELECT capacity_key, item_id, ts, round(cu_interval, 6) AS cu_interval, round(baseline_cu_s, 6) AS baseline_cu_s, baseline_days, "
        "round(ratio, 6) AS ratio FROM leg_scored WHERE cu_interval >= 20 AND baseline_days >= 4 AND ratio >= 1.2",
    ),
    "running_refreshes": statement(
        FULL_HOURLY, "SELECT * FROM work WHERE status = 'Unknown'"
    ),
    "running_jobs": statement(
        FULL_HOURLY, "SELECT * FROM work WHERE status IN ('InProgress', 'NotStarted')"
    ),
    "legacy_current": statement(
        HOURLY + LEGACY, "SELECT capacity_key, item_id, ts, hour_bucket, round(cu_interval, 6) AS cu_interval FROM leg_now"
    ),
    "baseline_history_filter": statement(
        SCORED_HOURLY,
        f"SELECT {ROW}, bucket, round(normalized, 6) AS normalized FROM cad WHERE comparable AND DATE '2024-01-30' - day BETWEEN 1 AND lookback",
    ),
    "bucket_key": statement(SCORED_HOURLY, f"SELECT {ROW}, bucket FROM cad"),
    "interval_minutes": statement(
        HOURLY, f"SELECT {ROW}, date_diff('second', window_start, window_end) / 60.0::DOUBLE AS minutes FROM ivs"
    ),
    "normalize": statement(SCORED_HOURLY, f"SELECT {ROW}, round(normalized, 6) AS normalized FROM cad"),
    "trustworthy": statement(
        SCORED_HOURLY, f"SELECT {ROW}, coalesce(days > 0 AND value > 0, false) AS trustworthy FROM based"
    ),
    "ratio": statement(SCORED_HOURLY, f"SELECT {ROW}, round(ratio, 6) AS ratio FROM scored"),
    "classify": statement(SCORED_HOURLY, f"SELECT {ROW}, tier, {LABELS}[tier + 1] AS label FROM scored"),
    "sku_capacity": statement(
        USAGE + POLICIES,
        "SELECT capacity_key, sku, rate AS cu_per_second, round(sum(cu_seconds), 6) AS cu_seconds FROM usage JOIN pol USING (capacity_key) GROUP BY ALL",
    ),
    "utilization_pct": statement(
        GATED_HOURLY, "SELECT capacity_key, window_end, round(utilization, 6) AS utilization FROM use"
    ),
    # A fixed offset: the zone kept no summer time in the period of the tables.
    "local_clock": "SELECT event_id, date_trunc('second', ts) - INTERVAL 3 HOUR AS local_ts FROM events",
    "calendar_parts": statement(
        HOURLY, f"SELECT {ROW}, window_end::DATE::VARCHAR AS day, hour(window_end) AS hour, isodow(window_end) - 1 AS dow FROM ivs"
    ),
    "event_projection": statement(FULL_HOURLY, "SELECT * FROM audit"),
    "alert_text": statement(FULL_HOURLY, f"SELECT {ROW}, text FROM messages"),
    "legacy_reset": statement(
        HOURLY,
        "SELECT capacity_key, item_id, ts, round(CASE WHEN cu_seconds_today - coalesce(prev_cu, 0) < 0 THEN cu_seconds_today "
        "ELSE cu_seconds_today - coalesce(prev_cu, 0) END, 6) AS cu_interval FROM pairs",
    ),
    "suppressed_flag": statement(GATED_HOURLY, f"SELECT {ROW}, tier > 0 AND eff < tier AS suppressed FROM assessed"),
    "previous_snapshot": statement(
        HOURLY,
        f"SELECT {SNAPSHOT_COLUMNS} FROM snaps WHERE ts < TIMESTAMP '2024-01-30 12:00:00' "
        "QUALIFY row_number() OVER (PARTITION BY capacity_key, item_id ORDER BY ts DESC) = 1",
    ),
    "readings_as_of": statement(
        HOURLY + "asked AS (SELECT event_id, 'C' || (user_id % 3) AS capacity_key, event_type AS item_id, ts AS moment FROM events),",
        "SELECT event_id, a.capacity_key, a.item_id, moment, s.ts AS prev_ts, s.cu_seconds_today AS prev_cu FROM asked a ASOF LEFT JOIN snaps s "
        "ON a.capacity_key = s.capacity_key AND a.item_id = s.item_id AND a.moment > s.ts",
    ),
    "interval_pairing": statement(
        HOURLY + LAST,
        "SELECT s.capacity_key, s.item_id, s.item_name, s.item_kind, s.workspace_id, s.workspace_name, p.ts AS window_start, "
        "s.ts AS window_end, round(s.cu_seconds_today, 6) AS cu_seconds FROM snaps s JOIN last_of_day p ON s.capacity_key = p.capacity_key "
        "AND s.item_id = p.item_id AND s.ts::DATE - p.ts::DATE = 1",
    ),
    "baseline_join": statement(
        SCORED_HOURLY + PAST_OF_LAST_DAY,
        f"SELECT c.capacity_key, c.item_id, c.window_end, round(b.value, 6) AS baseline FROM cad c LEFT JOIN old_base b "
        "USING (capacity_key, item_id, bucket) WHERE c.comparable",
    ),
    "state_join": statement(
        SCORED_HOURLY + STATES,
        f"SELECT {ROW}, coalesce(streak, 0) AS streak, last_action_ts FROM scored LEFT JOIN states USING (capacity_key, item_id)",
    ),
    "policy_join": statement(
        HOURLY + POLICIES, "SELECT capacity_key, item_id, ts, mode, alert, method FROM snaps JOIN pol USING (capacity_key)"
    ),
    "history_range_join": statement(
        SCORED_HOURLY, f"SELECT {ROW}, coalesce(samples, 0) AS samples, coalesce(days, 0) AS days FROM scored"
    ),
    "semi_capacity": statement(
        USAGE,
        "SELECT capacity_id, item_id, count(*) AS readings FROM usage WHERE capacity_id IN ('cap-1', 'cap-2', 'cap-3') GROUP BY ALL",
    ),
    "unmatched_capacities": statement(
        USAGE,
        "SELECT capacity_key, capacity_id FROM (VALUES ('C0', 'CAP-0'), ('C1', 'cap-1'), ('C2', 'cap-2'), ('C4', 'cap-4')) "
        "c(capacity_key, capacity_id) WHERE lower(capacity_id) NOT IN (SELECT lower(capacity_id) FROM usage)",
    ),
    "action_targets": statement(
        FULL_HOURLY,
        f"SELECT {ROW}, action, target FROM plan JOIN running USING (capacity_key, item_id, window_end, action) WHERE refused IS NULL",
    ),
    "compute_baselines": statement(
        SCORED_HOURLY + PAST_OF_LAST_DAY,
        "SELECT capacity_key, item_id, bucket, round(value, 6) AS value, days, samples, method FROM old_base",
    ),
    "trim_top": hourly_samples(
        "CASE WHEN len(arr) >= 4 THEN greatest(1, floor(len(arr) * 0.75::DOUBLE))::INT ELSE len(arr) END AS kept, "
        "round(arr[CASE WHEN len(arr) >= 4 THEN greatest(1, floor(len(arr) * 0.75::DOUBLE))::INT ELSE len(arr) END], 6) AS highest"
    ),
    "agg_mean": hourly_samples("round(list_avg(arr), 9) AS value"),
    "agg_median": hourly_samples("round(list_median(arr), 6) AS value"),
    "agg_p75": hourly_samples("round(arr[1 + round_even(0.75::DOUBLE * (len(arr) - 1), 0)::INT], 6) AS value"),
    "agg_p90": hourly_samples("round(arr[1 + round_even(0.9::DOUBLE * (len(arr) - 1), 0)::INT], 6) AS value"),
    "percentile_nearest": statement(
        DAILY_USAGE
        + "arrays AS (SELECT capacity_key, list_sort(list(cu_seconds)) AS arr, count(*) AS n FROM usage GROUP BY ALL),",
        "SELECT capacity_key, n AS lines, arr[1 + round_even(0.5::DOUBLE * (n - 1), 0)::BIGINT] AS p50, "
        "arr[1 + round_even(0.95::DOUBLE * (n - 1), 0)::BIGINT] AS p95, arr[1 + round_even(0.995::DOUBLE * (n - 1), 0)::BIGINT] AS p995 FROM arrays",
    ),
    "capacity_total": statement(
        SCORED_HOURLY,
        "SELECT capacity_key, window_end, round(sum(cu_seconds), 6) AS cu_seconds FROM cad WHERE comparable GROUP BY ALL",
    ),
    "latest_per_item": statement(HOURLY + LAST, f"SELECT {SNAPSHOT_COLUMNS} FROM newest"),
    "legacy_baseline": statement(
        HOURLY + LEGACY,
        "SELECT capacity_key, item_id, hour_bucket, round(baseline_cu_s, 6) AS baseline_cu_s, baseline_days FROM leg_base",
    ),
    "latest_ts": statement(HOURLY + LEGACY, "SELECT max(ts) AS latest_ts FROM leg WHERE date = DATE '2024-01-30'"),
    "item_profile": statement(SCORED_HOURLY + CALIBRATED, f"SELECT {PROFILE_COLUMNS} FROM profiles"),
    "would_counts": statement(
        SCORED_HOURLY + CALIBRATED,
        "SELECT capacity_key, count(*) FILTER (ratio >= alert) AS would_alert, count(*) FILTER (ratio >= throttle) AS would_throttle, "
        "count(*) FILTER (ratio >= kill) AS would_kill FROM ratios GROUP BY ALL",
    ),
    "suggest_thresholds": statement(SCORED_HOURLY + CALIBRATED, "SELECT * FROM suggestions"),
    "suggest_min_cu": statement(SCORED_HOURLY + CALIBRATED, "SELECT * FROM min_cus"),
    "days_seen": statement(
        SCORED_HOURLY,
        "SELECT capacity_key, count(DISTINCT day) AS days_of_history, count(DISTINCT day) < 7 AS unstable FROM scored GROUP BY ALL",
    ),
    "events_by_tier": statement(
        FULL_HOURLY,
        "SELECT tier, count(*) AS events, count(*) FILTER (tier <> effective_tier) AS contained FROM audit GROUP BY ALL",
    ),
    "run_summary": statement(
        FULL_HOURLY,
        """SELECT s.capacity_key, s.ts AS window_end, count(*) AS items_scanned, count(*) FILTER (g.tier > 0) AS anomalies,
          count(*) FILTER (d.action_taken) AS actions_taken, count(*) FILTER (NOT c.comparable) AS skipped_intervals,
          count(c.item_id) = 0 AS bootstrap
        FROM snaps s LEFT JOIN cad c ON c.capacity_key = s.capacity_key AND c.item_id = s.item_id AND c.window_end = s.ts
          LEFT JOIN gated g ON g.capacity_key = s.capacity_key AND g.item_id = s.item_id AND g.window_end = s.ts
          LEFT JOIN done d ON d.capacity_key = s.capacity_key AND d.item_id = s.item_id AND d.window_end = s.ts
        GROUP BY ALL""",
    ),
    "enforce_readiness": statement(
        HOURLY + POLICIES,
        """SELECT p.capacity_key, count(DISTINCT i.window_end::DATE) AS history_days, p.min_days,
          count(DISTINCT i.window_end::DATE) >= p.min_days AS ready
        FROM pol p LEFT JOIN ivs i ON i.capacity_key = p.capacity_key AND DATE '2024-01-30' - i.window_end::DATE BETWEEN 0 AND p.lookback
        WHERE p.mode = 'enforce' GROUP BY p.capacity_key, p.min_days""",
    ),
    "action_taken": statement(FULL_HOURLY, f"SELECT {ROW}, action_taken FROM done"),
    "discard_count": statement(
        SCORED_HOURLY,
        "SELECT capacity_key, count(*) AS intervals, count(*) FILTER (NOT comparable) AS discarded FROM cad GROUP BY ALL",
    ),
    "empty_history_report": statement(SCORED_HOURLY + CALIBRATED, "SELECT * FROM report"),
    "derive_intervals": statement(HOURLY, f"SELECT {INTERVAL_COLUMNS} FROM ivs"),
    "derive_intervals_daily": statement(DAILY_USAGE + SNAPS, f"SELECT {INTERVAL_COLUMNS} FROM ivs"),
    "legacy_intervals": statement(
        HOURLY + LEGACY, "SELECT capacity_key, item_id, ts, date::VARCHAR AS date, hour_bucket, round(cu_interval, 6) AS cu_interval FROM leg"
    ),
    "latest_row_number": statement(HOURLY + LAST, f"SELECT {SNAPSHOT_COLUMNS} FROM newest"),
    "streak": statement(
        SCORED_HOURLY + STREAKS,
        f"SELECT {ROW}, tier, lag(run, 1, 0) OVER (PARTITION BY capacity_key, item_id ORDER BY window_end)::INT AS streak FROM runs",
    ),
    "replay_baselines": statement(
        SCORED_HOURLY, f"SELECT {ROW}, bucket, round(value, 6) AS value, coalesce(days, 0) AS days, coalesce(samples, 0) AS samples FROM scored"
    ),
    "replay_baselines_daily": statement(
        DAILY_SCORED, f"SELECT {ROW}, round(value, 6) AS value, coalesce(days, 0) AS days, tier FROM scored"
    ),
    "distinct_days_in_frame": statement(SCORED_HOURLY, f"SELECT {ROW}, coalesce(days, 0) AS days FROM scored"),
    "cooldown": statement(GATED_HOURLY, f"SELECT {ROW}, in_cooldown FROM held"),
    "run_budget": statement(
        GATED_HOURLY
        + """
budgeted AS (
  SELECT * REPLACE (CASE WHEN over THEN list_append(why, 'max_actions_per_run') ELSE why END AS why, CASE WHEN over THEN 1 ELSE eff END AS eff)
  FROM (SELECT *, eff >= 2 AND count(*) FILTER (eff >= 2) OVER (PARTITION BY capacity_key, window_end) > max_actions AS over FROM assessed)),
""",
        verdicts("budgeted"),
    ),
    "capacity_guard": statement(GATED_HOURLY, verdicts("guarded")),
    "assess": statement(GATED_HOURLY, verdicts("assessed")),
    "cycle_gates": statement(GATED_HOURLY, verdicts("gated")),
    "advance_state": statement(
        GATED_HOURLY,
        f"SELECT capacity_key, item_id, CASE WHEN tier > 0 THEN streak + 1 ELSE 0 END AS streak, {LABELS}[tier + 1] AS last_tier, "
        "CASE WHEN eff >= 2 THEN window_end ELSE last_action_ts END AS last_action_ts, window_end AS last_seen_ts FROM gated",
    ),
    "planned_actions": statement(FULL_HOURLY, f"SELECT {ROW}, step, action, ok, refused FROM plan"),
    "alert_outbox": statement(
        FULL_HOURLY,
        f"SELECT {ROW}, channel, text FROM messages, (VALUES ('console', 1), ('teams', 3)) c(channel, least_tier) WHERE tier >= least_tier",
    ),
    "legacy_escalation": statement(
        HOURLY + LEGACY,
        """SELECT capacity_key, item_id, ts, level, action, 'ENFORCE' AS mode, round(ratio, 6) AS ratio
        FROM leg_scored, (VALUES ('T1_ALERT', 'alert', 0.0), ('T2_KILL_BG', 'cancel_background', 1.5), ('T3_KILL_SESSION', 'cancel_sessions', 1.8)) l(level, action, from_ratio)
        WHERE baseline_days >= 4 AND ratio >= 1.2 AND ratio >= from_ratio AND (level = 'T1_ALERT' OR item_id <> 'error')
          AND (level <> 'T3_KILL_SESSION' OR item_kind IN ('Dataset', 'SemanticModel'))""",
    ),
    "resolve_policies": statement(
        USAGE + POLICIES,
        "SELECT capacity_key, count(*) AS readings, mode, alert, kill, method, min_days, max_actions, breaches "
        "FROM usage JOIN pol USING (capacity_key) GROUP BY ALL",
    ),
    "validate_policies": statement(
        USAGE + POLICIES,
        """SELECT capacity_key, rule FROM (
          SELECT capacity_key, unnest(list_filter([
            CASE WHEN days * 4 < 1 OR days * 4 > 90 THEN 'baseline.lookback_days' END,
            CASE WHEN top / 10 > 50 THEN 'baseline.trim_top_percent' END,
            CASE WHEN least(top / 100, throttle, kill) <= 1.0 OR top / 100 > throttle OR throttle > kill THEN 'thresholds' END
          ], lambda x: x IS NOT NULL)) AS rule
          FROM (SELECT capacity_key, max(cu_seconds) AS top, count(DISTINCT ts::DATE) AS days FROM usage GROUP BY ALL) JOIN pol USING (capacity_key))""",
    ),
    "rank_assessments": statement(GATED_HOURLY, verdicts("assessed")),
    "top_consumers": statement(
        USAGE
        + """
daily AS (SELECT capacity_key, item_id, ts::DATE AS day, round(sum(cu_seconds), 2) AS cu_seconds_today FROM usage GROUP BY ALL),
""",
        "SELECT capacity_key, day::VARCHAR AS day, item_id, cu_seconds_today, row_number() OVER (PARTITION BY capacity_key, day ORDER BY cu_seconds_today DESC, item_id) AS rank "
        "FROM daily QUALIFY rank <= 3",
    ),
    "rank_profiles": statement(SCORED_HOURLY + CALIBRATED, f"SELECT {PROFILE_COLUMNS}, rank FROM ranked WHERE rank <= 15"),
    "noisy_items": statement(SCORED_HOURLY + CALIBRATED, "SELECT * FROM noisy"),
    "recent_events": statement(FULL_HOURLY, "SELECT * FROM audit ORDER BY ts DESC, capacity_key, item_id LIMIT 50"),
    "legacy_scored": statement(
        HOURLY + LEGACY,
        "SELECT capacity_key, item_id, ts, round(cu_interval, 6) AS cu_interval, round(baseline_cu_s, 6) AS baseline_cu_s, baseline_days, "
        "round(ratio, 6) AS ratio FROM leg_scored",
    ),
    "usage_stream_cumulative": statement(
        USAGE,
        "SELECT capacity_key, item_id, ts::DATE::VARCHAR AS day, round(sum(cu_seconds), 2) AS cu_seconds_today FROM usage GROUP BY ALL",
    ),
    "stream_intervals": statement(HOURLY, f"SELECT {INTERVAL_COLUMNS} FROM ivs"),
    "bootstrap": statement(
        HOURLY,
        "SELECT s.capacity_key, s.ts AS window_end, count(*) AS items_scanned FROM snaps s LEFT JOIN ivs i ON i.capacity_key = s.capacity_key "
        "AND i.item_id = s.item_id AND i.window_end = s.ts GROUP BY ALL HAVING count(i.item_id) = 0",
    ),
    "replay_gates": statement(
        REPLAYED_HOURLY, verdicts("gated") + " WHERE tier > 0"
    ),
    "replay_state": statement(REPLAYED_HOURLY, "SELECT * FROM last_state"),
    "stream_gates": statement(REPLAYED_HOURLY, "SELECT * FROM last_state"),
    "cycle": statement(
        REPLAYED_HOURLY + OUTBOX,
        "SELECT * REPLACE (CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'batch-0' ELSE 'batch-1' END AS run_id) FROM audit",
    ),
    "action_ledger": statement(REPLAYED_HOURLY + OUTBOX, f"SELECT {ROW}, step, action, ok, detail, targets FROM results"),
    "target_ledger": statement(
        REPLAYED_HOURLY + OUTBOX,
        f"SELECT {ROW}, action, target FROM plan JOIN running USING (capacity_key, item_id, window_end, action) WHERE refused IS NULL",
    ),
    "run_log": statement(
        REPLAYED_HOURLY + OUTBOX,
        """SELECT CASE WHEN s.ts < TIMESTAMP '2024-01-16' THEN 'batch-0' ELSE 'batch-1' END AS run_id, s.capacity_key, p.mode, s.ts AS window_end,
          count(*) AS items_scanned, count(*) FILTER (g.tier > 0) AS anomalies, count(*) FILTER (d.action_taken) AS actions_taken,
          count(*) FILTER (NOT c.comparable) AS skipped_intervals, count(c.item_id) = 0 AS bootstrap, 0 AS errors
        FROM snaps s JOIN pol p USING (capacity_key) LEFT JOIN cad c ON c.capacity_key = s.capacity_key AND c.item_id = s.item_id AND c.window_end = s.ts
          LEFT JOIN gated g ON g.capacity_key = s.capacity_key AND g.item_id = s.item_id AND g.window_end = s.ts
          LEFT JOIN done d ON d.capacity_key = s.capacity_key AND d.item_id = s.item_id AND d.window_end = s.ts
        GROUP BY ALL""",
    ),
    "cycle_events": statement(
        SCORED_HOURLY
        + STATES
        + """
given AS (
  SELECT c.*, coalesce(s.streak, 0) AS streak, s.last_action_ts FROM scored c LEFT JOIN states s USING (capacity_key, item_id)
  WHERE window_end = (SELECT max(ts) FROM snaps)),
"""
        + ASSESSED,
        verdicts("gated"),
    ),
    "state_expiry": statement(
        SCORED_HOURLY
        + """
daily AS (
  SELECT capacity_key, item_id || '@' || day AS item_id, (count(*) FILTER (tier > 0) % 3)::INT AS streak,
    max(window_end) FILTER (tier > 1) AS last_action_ts, max(window_end) AS last_seen_ts FROM scored GROUP BY ALL),
""",
        "SELECT * FROM daily WHERE last_seen_ts >= (SELECT max(last_seen_ts) FROM daily) - INTERVAL 7 DAY",
    ),
    "calibrate_daily": statement(
        DAILY_SCORED + CALIBRATED, "SELECT * EXCLUDE (notes) FROM report"
    ),
}
