"""Plans on the usage log (events: user = run, event_type = tool, props = detail)."""

from __future__ import annotations

from gleanery.plans.dialect import plans

_ASKS = """
 marked AS (
  SELECT *, CASE WHEN prev IS NULL OR at_s - prev > 120 THEN 1 ELSE 0 END AS new_ask,
    CASE WHEN prev IS NULL OR at_s - prev > 5 THEN 1 ELSE 0 END AS new_round FROM (
      SELECT event_id, user_id, event_type, value, [[epoch:ts]] AS at_s,
        lag([[epoch:ts]]) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, ts FROM {events}) e),
 asks AS (
  SELECT event_id, user_id, event_type, value, at_s,
    sum(new_ask) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ask_no,
    sum(new_round) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS round_no
  FROM marked)
"""
_LEVEL = "CASE WHEN value >= 100 THEN 'strong' WHEN value >= 50 THEN 'partial' WHEN value > 0 THEN 'none' ELSE 'empty' END"

TEXTS = {
    "ask_sessions": f"""-- W4: asks (gap over 120 s) and rounds (gap over 5 s) per run
        WITH {_ASKS} SELECT user_id, CAST(ask_no AS BIGINT) AS ask_no, min(at_s) AS started, max(at_s) AS ended,
          CAST(count(*) AS BIGINT) AS n_events, CAST(count(DISTINCT round_no) AS BIGINT) AS n_rounds
        FROM asks GROUP BY user_id, ask_no""",
    "usage_summary": f"""-- A9 V28: calls, empty and weak results, exact percentiles per tool (places rounded half even)
        WITH ranked AS (
          SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn,
            count(*) OVER (PARTITION BY event_type) AS n FROM {{events}} WHERE value IS NOT NULL)
        SELECT event_type, CAST(max(n) AS BIGINT) AS n_calls, CAST(sum(CASE WHEN {_LEVEL} = 'empty' THEN 1 ELSE 0 END) AS BIGINT) AS n_empty,
          CAST(sum(CASE WHEN {_LEVEL} = 'none' THEN 1 ELSE 0 END) AS BIGINT) AS n_gaps,
          max(CASE WHEN rn = 1 + [[nth50:n]] THEN value END) AS p50, max(CASE WHEN rn = 1 + [[nth95:n]] THEN value END) AS p95
        FROM ranked GROUP BY event_type""",
    "weak_searches": f"""-- W40 L5: newest weak calls
        SELECT event_id, user_id, event_type, [[epoch:ts]] AS at_s FROM {{events}}
        WHERE {_LEVEL} IN ('none', 'empty') ORDER BY ts DESC, event_id LIMIT 50""",
    "gap_report": f"""-- A10 M15: calls per tool and level with least, median and greatest value in hundredths
        WITH r AS (SELECT event_type, {_LEVEL} AS level, value, row_number() OVER (PARTITION BY event_type, {_LEVEL} ORDER BY value, event_id) AS rn,
          count(*) OVER (PARTITION BY event_type, {_LEVEL}) AS n FROM {{events}} WHERE value IS NOT NULL)
        SELECT event_type, level, CAST(count(*) AS BIGINT) AS n, CAST(floor(min(value) * 100 + 0.5) AS BIGINT) AS low,
          CAST(floor((max(CASE WHEN rn = 1 + [[div:n - 1¦2]] THEN value END) + max(CASE WHEN rn = 1 + [[div:n¦2]] THEN value END)) * 50 + 0.5) AS BIGINT) AS median,
          CAST(floor(max(value) * 100 + 0.5) AS BIGINT) AS high FROM r GROUP BY event_type, level""",
    "ask_averages": f"""-- A10: asks, rounds and events per run
        WITH {_ASKS} SELECT user_id, CAST(count(DISTINCT ask_no) AS BIGINT) AS n_asks,
          CAST(count(DISTINCT round_no) AS BIGINT) AS n_rounds, CAST(count(*) AS BIGINT) AS n_events
        FROM asks GROUP BY user_id""",
    "domain_attribution": f"""-- A11: domain of an ask by plurality of its tools, ties keep all
        WITH {_ASKS}, n AS (SELECT user_id, ask_no, event_type, count(*) AS c FROM asks GROUP BY user_id, ask_no, event_type),
        r AS (SELECT *, rank() OVER (PARTITION BY user_id, ask_no ORDER BY c DESC) AS rk FROM n)
        SELECT user_id, CAST(ask_no AS BIGINT) AS ask_no, event_type AS domain, CAST(c AS BIGINT) AS n_hits FROM r WHERE rk = 1""",
    "json_details": """-- S16 M16: detail fields of the log up to a cutoff, in order of time
        SELECT event_id, CAST([[json:props¦'$.k']] AS BIGINT) AS k FROM {events}
        WHERE [[epoch:ts]] < 1705500000""",
    "usage_retention": """-- H8: rows a retention of 14 days before the newest event keeps
        WITH newest AS (SELECT max([[epoch:ts]]) AS m FROM {events})
        SELECT event_type, CAST(count(*) AS BIGINT) AS n_kept FROM {events} e
        JOIN newest ON [[epoch:e.ts]] >= m - 14 * 86400 GROUP BY event_type""",
    "run_lengths": """-- N3: consecutive failures per run, parked from the third on
        WITH f AS (SELECT user_id, event_id, [[epoch:ts]] AS at_s, ts, CASE WHEN value < 50 THEN 1 ELSE 0 END AS bad FROM {events}),
        g AS (SELECT *, sum(1 - bad) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM f),
        s AS (SELECT *, sum(bad) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM g)
        SELECT user_id, CAST(max(streak) AS BIGINT) AS longest, CAST(sum(CASE WHEN streak = 3 THEN 1 ELSE 0 END) AS BIGINT) AS n_parked
        FROM s GROUP BY user_id""",
    "abandoned_runs": """-- N9: a run whose next start comes before any finish is abandoned
        SELECT user_id, CAST(sum(CASE WHEN nxt IS NOT NULL AND nxt - at_s < 3600 THEN 1 ELSE 0 END) AS BIGINT) AS n_abandoned FROM (
          SELECT user_id, [[epoch:ts]] AS at_s, lead([[epoch:ts]]) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM {events}) x
        GROUP BY user_id""",
    "tumbling_counts": """-- N12: events and value sums (cents) per hour and type
        SELECT event_type, [[div:[[epoch:ts]]¦3600]] AS hour_no, CAST(count(*) AS BIGINT) AS n FROM {events}
        GROUP BY event_type, [[div:[[epoch:ts]]¦3600]]""",
    "sliding_counts": """-- N12: events per two-hour window sliding by one hour
        SELECT event_type, h AS window_end, CAST(count(*) AS BIGINT) AS n FROM (
          SELECT event_type, [[div:[[epoch:ts]]¦3600]] + o AS h FROM {events}
          CROSS JOIN (SELECT 0 AS o UNION ALL SELECT 1) s) w GROUP BY event_type, h""",
}
QUERIES, SQL = plans(TEXTS)
