"""Plans on incremental state, histories and registries."""

from __future__ import annotations

from gleanery.plans.dialect import plans

_STATE = """
 st AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ok' WHEN doc_id % 3 = 1 THEN 'failed' ELSE 'skipped' END AS status,
          [[sha:concat(coalesce(title, ''), CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE '' END)]] AS input_hash, CAST(doc_id % 4 AS BIGINT) AS attempts
        FROM {documents} WHERE doc_id % 5 <> 0),
 d AS (SELECT doc_id, source, series, title, first_seen, published_at, tombstoned_at, [[sha:coalesce(title, '')]] AS now_hash FROM {documents})
"""
TEXTS = {
    "pending_work": f"""-- F8 J1 J13: live documents without a settled state, newest first
        WITH {_STATE} SELECT d.doc_id, [[epoch:d.published_at]] AS at_s FROM d LEFT JOIN st ON st.doc_id = d.doc_id
        WHERE d.tombstoned_at IS NULL AND (st.status IS NULL OR st.status NOT IN ('ok', 'skipped'))""",
    "needs_rerun": f"""-- F9 N4: never ok, or the input changed since
        WITH {_STATE} SELECT d.doc_id, coalesce(st.status, 'never') AS status FROM d LEFT JOIN st ON st.doc_id = d.doc_id
        WHERE st.status IS NULL OR st.status <> 'ok' OR st.input_hash <> d.now_hash""",
    "tombstones": """-- N5 K2: known documents that the current listing no longer has
        SELECT source, CAST(count(*) AS BIGINT) AS n_gone FROM {documents} d
        WHERE NOT EXISTS (SELECT 1 FROM {transcripts} t WHERE t.doc_id = d.doc_id) AND tombstoned_at IS NULL AND has_captions = 1 GROUP BY source""",
    "stage_counts": f"""-- A5 J2: states of live documents per source
        WITH {_STATE} SELECT d.source, CAST(sum(CASE WHEN st.status = 'ok' THEN 1 ELSE 0 END) AS BIGINT) AS n_ok,
          CAST(sum(CASE WHEN st.status = 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS n_failed,
          CAST(sum(CASE WHEN st.status = 'skipped' THEN 1 ELSE 0 END) AS BIGINT) AS n_skipped
        FROM d JOIN st ON st.doc_id = d.doc_id WHERE d.tombstoned_at IS NULL GROUP BY d.source""",
    "failure_parking": f"""-- N2 N3: attempts accumulate, parked at three
        WITH {_STATE} SELECT doc_id, status, attempts, CASE WHEN status = 'failed' AND attempts >= 3 THEN 'parked' ELSE status END AS next_status FROM st""",
    "upsert_guard": """-- N1: a fallback source never overwrites a series that is set
        SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 AND d.series IS NOT NULL THEN d.series ELSE concat('new-', coalesce(d.source, '')) END AS series FROM {documents} d""",
    "scd2_profile": """-- H1 H2: status history of goals as validity intervals
        WITH g AS (SELECT DISTINCT id, founder_id, lower(trim(coalesce(status, 'unknown'))) AS status, [[epoch:created_at]] AS at_s FROM {goals} WHERE created_at IS NOT NULL),
        c AS (SELECT *, lag(status) OVER (PARTITION BY founder_id ORDER BY at_s, id) AS prev FROM g),
        k AS (SELECT founder_id, status, at_s, id FROM c WHERE prev IS NULL OR prev <> status)
        SELECT founder_id, status, at_s AS valid_from, lead(at_s) OVER (PARTITION BY founder_id ORDER BY at_s, id) AS superseded_at FROM k""",
    "stale_facts": """-- H2: open goals not touched for 30 days before the newest
        WITH g AS (SELECT DISTINCT id, founder_id, [[epoch:created_at]] AS at_s FROM {goals} WHERE closed_at IS NULL AND deleted_at IS NULL),
        m AS (SELECT max(at_s) AS newest FROM g)
        SELECT founder_id, CAST(count(*) AS BIGINT) AS n_stale FROM g JOIN m ON at_s < newest - 30 * 86400 GROUP BY founder_id""",
    "carry_chain": """-- W30 H3: length of each chain of carried commitments
        WITH RECURSIVE c AS (SELECT DISTINCT [[tidy:id]] AS id, nullif([[tidy:carried_from]], '') AS src FROM {commitments}),
        w(id, root, steps) AS (SELECT id, id AS root, 0 AS steps FROM c WHERE src IS NULL
          UNION ALL SELECT c.id, w.root, w.steps + 1 FROM w JOIN c ON c.src = w.id)
        SELECT root, CAST(max(steps) AS BIGINT) AS n_carried FROM w GROUP BY root""",
    "carry_commitments": """-- H3 M1: open commitments closed in their week and reopened in the next ISO week
        WITH o AS (SELECT DISTINCT id, week, status, CAST(substr(week, 1, 4) AS BIGINT) AS y, CAST(substr(week, 7, 2) AS BIGINT) AS w
          FROM {commitments} WHERE [[tidy:status]] = 'open' AND [[matches:week¦'^[0-9][0-9][0-9][0-9]-W[0-9][0-9]$']]),
        l AS (SELECT *, (y + [[div:y¦4]] - [[div:y¦100]] + [[div:y¦400]]) % 7 AS p, (y - 1 + [[div:y - 1¦4]] - [[div:y - 1¦100]] + [[div:y - 1¦400]]) % 7 AS q FROM o)
        SELECT id, week, status, CASE WHEN w < 52 OR (w = 52 AND (p = 4 OR q = 3)) THEN concat(substr(week, 1, 6), lpad(CAST(w + 1 AS VARCHAR(2)), 2, '0'))
          ELSE concat(CAST(y + 1 AS VARCHAR(4)), '-W01') END AS next_week FROM l""",
    "open_warnings": """-- A25: founders with over three open commitments in a week
        SELECT founder_id, week, CAST(count(DISTINCT id) AS BIGINT) AS n FROM {commitments} WHERE [[tidy:status]] = 'open' GROUP BY founder_id, week HAVING count(DISTINCT id) > 3""",
    "nudges": """-- H6: overdue goals and past commitments with their priority
        SELECT founder_id, kind, CAST(count(*) AS BIGINT) AS n FROM (
          SELECT DISTINCT id, founder_id, 'goal overdue' AS kind FROM {goals} WHERE target_date < DATE '2024-01-01' AND closed_at IS NULL AND deleted_at IS NULL
          UNION ALL SELECT DISTINCT id, founder_id, 'commitment open' FROM {commitments} WHERE closed_at IS NULL AND week < '2024-W01') u GROUP BY founder_id, kind""",
    "iso_weeks": """-- M1: ISO week of a commitment against the week it names, and the Monday it starts on
        SELECT week = made AS same, monday, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT id, week, CAST(date_trunc('week', d) AS DATE) AS monday,
          concat(CAST([[isoyear:d]] AS VARCHAR(4)), '-W', lpad(CAST(extract(week FROM d) AS VARCHAR(2)), 2, '0')) AS made
          FROM (SELECT id, week, [[date:created_at]] AS d FROM {commitments} WHERE created_at IS NOT NULL) x) y GROUP BY week = made, monday""",
    "idempotent_replay": """-- H4: one effect per request id, the first by time
        SELECT id, CAST(count(*) AS BIGINT) AS n_delivered, min([[epoch:created_at]]) AS first_at FROM {commitments} GROUP BY id""",
    "latest_per_key": """-- K1 N2: documents as a unit: rows of the newest transcript version
        SELECT doc_id, CAST(max(version) AS BIGINT) AS version FROM {transcripts} GROUP BY doc_id""",
    "layered_lookup": """-- J17 J18: own series, else the source's most common one, else a default
        WITH n AS (SELECT source, series, count(*) AS c FROM {documents} WHERE series IS NOT NULL AND series <> '' GROUP BY source, series),
        b AS (SELECT source, series FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY c DESC, series) AS rn FROM n) x WHERE rn = 1)
        SELECT d.doc_id, coalesce(nullif(d.series, ''), b.series, 'startup') AS series FROM {documents} d LEFT JOIN b ON b.source = d.source""",
    "overlay_lookup": """-- J18 J4: goals beside commitments of a founder, either may be missing
        WITH g AS (SELECT founder_id, count(DISTINCT id) AS n_goals FROM {goals} GROUP BY founder_id), c AS (SELECT founder_id, count(DISTINCT id) AS n_com FROM {commitments} GROUP BY founder_id)
        SELECT coalesce(g.founder_id, c.founder_id) AS founder_id, CAST(coalesce(n_goals, 0) AS BIGINT) AS n_goals, CAST(coalesce(n_com, 0) AS BIGINT) AS n_commitments
        FROM g FULL JOIN c ON g.founder_id = c.founder_id""",
    "exists_all_skipped": """-- J6: pages whose every video id is damaged
        SELECT DISTINCT p.url FROM {web_videos} p WHERE EXISTS (SELECT 1 FROM {web_videos} v WHERE v.url = p.url GROUP BY v.url HAVING min(length(v.video_id)) <> 11 AND max(length(v.video_id)) <> 11)""",
    "text_hash_alias": """-- J7 N15: pages whose text another page had first
        WITH p AS (SELECT DISTINCT doc_id, text_hash, [[epoch:fetched_at]] AS at_s FROM {web_pages} WHERE text_hash IS NOT NULL),
        f AS (SELECT text_hash, doc_id AS owner FROM (SELECT *, row_number() OVER (PARTITION BY text_hash ORDER BY at_s NULLS LAST, doc_id) AS rn FROM p) x WHERE rn = 1)
        SELECT DISTINCT p.doc_id, f.owner FROM p JOIN f ON p.text_hash = f.text_hash WHERE p.doc_id <> f.owner""",
    "queue_order": """-- L4 N6 S6: next pages to fetch by depth, discovery and url
        SELECT url, CAST(depth AS BIGINT) AS depth FROM (SELECT DISTINCT url, length(url) - length(replace(url, '/', '')) - 3 AS depth, [[epoch:checked_at]] AS at_s FROM {web_pages}) q
        WHERE at_s IS NOT NULL ORDER BY depth, at_s, url LIMIT 100""",
    "enqueue_depth": """-- N7 N13: shallowest depth per url, requeued when newer
        SELECT url, CAST(min(depth) AS BIGINT) AS depth, max(at_s) AS newest FROM (SELECT url, 1 AS depth, [[epoch:checked_at]] AS at_s FROM {web_pages}
          UNION ALL SELECT url, 2, NULL FROM {web_videos}) q GROUP BY url""",
    "fetch_routing": """-- N14: outcome of a fetch by its state
        SELECT outcome, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT doc_id, CASE WHEN raw_path IS NULL THEN 'failed' WHEN etag IS NOT NULL THEN 'unchanged'
          WHEN fetched_at IS NULL THEN 'skipped' ELSE 'fetched' END AS outcome FROM {web_pages}) o GROUP BY outcome""",
    "retag_rows": """-- K3 K4: items whose sorted domains differ from the document's first topic
        SELECT kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT item_id, kind, coalesce(domains, topics) AS a, topics AS b FROM {items}) i
        WHERE NOT (sort_array(a) = sort_array(b)) GROUP BY kind""".replace("sort_array(a) = sort_array(b)", "[[sorted:a]] = [[sorted:b]]"),
    "pack_build": """-- K5 K6: rows of a pack, its duplicate ids and a hash over its ids
        WITH p AS (SELECT DISTINCT item_id, kind FROM {items} WHERE kind <> 'summary')
        SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count(DISTINCT item_id) AS BIGINT) AS n_duplicate FROM p GROUP BY kind""",
    "version_keys": """-- M17 J19 U15: transcript versions as comparable keys, floor of two
        SELECT CAST(version AS BIGINT) AS version, version < 2 AS stale, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT doc_id, version FROM {transcripts}) t GROUP BY version""",
    "visibility": """-- F6 E7: fail-closed visibility: private if listed, or unknown
        SELECT CASE WHEN source IS NULL THEN 'private' WHEN source LIKE '%press' THEN 'private' ELSE 'public' END AS visibility, CAST(count(*) AS BIGINT) AS n FROM {documents} GROUP BY 1""",
    "correlated_counts": """-- U14 U13: declared sources with their counts, zero included
        WITH s AS (SELECT DISTINCT [[tidy:source_id]] AS s FROM {web_pages} WHERE source_id IS NOT NULL)
        SELECT s, CAST((SELECT count(*) FROM {documents} d WHERE d.source = s.s) AS BIGINT) AS n FROM s""",
    "read_document": """-- U12: verified items of a document in position order
        SELECT doc_id, item_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start_ms NULLS LAST, item_id) AS BIGINT) AS pos
        FROM (SELECT DISTINCT doc_id, item_id, start_ms FROM {items} WHERE kind <> 'passage' AND doc_id NOT IN ('', '-1') AND evidence IS NOT NULL) i""",
    "plan_comparison": """-- U17: expected against detected page counts and labels of books
        SELECT DISTINCT path, pages, [[size:map_keys(page_labels)]] AS n_labels, pages <> [[size:map_keys(page_labels)]] AS mismatch FROM (SELECT path, pages, page_labels FROM {pdf_facts} WHERE page_labels IS NOT NULL) b""",
}
QUERIES, SQL = plans(TEXTS)
