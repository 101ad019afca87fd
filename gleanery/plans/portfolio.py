"""Plans on holdings: exact cents, whole units only."""

from __future__ import annotations

from gleanery.plans.dialect import plans

_LATEST = """
 snaps AS (SELECT DISTINCT [[tidy:id]] AS id, founder_id, [[replace:[[tidy:account]]¦'[ ]+'¦' ']] AS account, as_of, imported_at, total_cents
           FROM {holdings_snapshots} WHERE deleted_at IS NULL),
 newest AS (SELECT id, founder_id, account FROM (SELECT *, row_number() OVER (PARTITION BY founder_id, account
           ORDER BY as_of DESC, [[epoch:imported_at]] DESC NULLS LAST, id DESC) AS rn FROM snaps) s WHERE rn = 1),
 pos AS (SELECT DISTINCT pos_id, [[tidy:snapshot_id]] AS snapshot_id, upper(trim(coalesce(symbol, ''))) AS symbol,
           CASE WHEN csv_class IS NULL OR trim(csv_class) = '' THEN 'unclassified' ELSE [[tidy:csv_class]] END AS class, value_cents, quantity FROM {positions}),
 held AS (SELECT n.founder_id, n.account, p.pos_id, p.symbol, p.class, p.value_cents, p.quantity FROM pos p JOIN newest n ON p.snapshot_id = n.id)
"""
TEXTS = {
    "latest_snapshot": f"""-- J15: newest snapshot of every account
        WITH {_LATEST} SELECT * FROM newest""",
    "positions_to_snapshots": f"""-- J5: positions and cents of the newest snapshots
        WITH {_LATEST} SELECT founder_id, account, CAST(count(*) AS BIGINT) AS n, CAST(sum(value_cents) AS BIGINT) AS cents FROM held GROUP BY founder_id, account""",
    "portfolio_review": f"""-- A18 M5: cents and share in hundredths of a percent per class, half up
        WITH {_LATEST}, c AS (SELECT founder_id, class, sum(value_cents) AS cents FROM held GROUP BY founder_id, class),
        t AS (SELECT *, sum(cents) OVER (PARTITION BY founder_id) AS total FROM c)
        SELECT founder_id, class, CAST(cents AS BIGINT) AS cents, CAST(CASE WHEN total > 0 THEN [[div:cents * 20000 + total¦total * 2]] END AS BIGINT) AS pct_hundredths FROM t""",
    "drift_band": f"""-- A18: drift of a class from an equal target, outside a band of five points
        WITH {_LATEST}, c AS (SELECT founder_id, class, sum(value_cents) AS cents FROM held GROUP BY founder_id, class),
        t AS (SELECT *, sum(cents) OVER (PARTITION BY founder_id) AS total, count(*) OVER (PARTITION BY founder_id) AS n FROM c)
        SELECT founder_id, class, CAST(cents * n - total AS BIGINT) AS drift_times_n, abs(cents * n - total) * 20 > total * n AS outside FROM t WHERE total > 0""",
    "concentration": f"""-- A18: symbols over a tenth of a founder's holdings
        WITH {_LATEST}, s AS (SELECT founder_id, symbol, sum(value_cents) AS cents FROM held GROUP BY founder_id, symbol),
        t AS (SELECT *, sum(cents) OVER (PARTITION BY founder_id) AS total FROM s)
        SELECT founder_id, symbol, CAST(cents AS BIGINT) AS cents, CAST(total AS BIGINT) AS total FROM t WHERE cents * 10 > total AND total > 0""",
    "target_split": """-- W39: 100000 cents over accounts by largest remainder, ties by name
        WITH a AS (SELECT DISTINCT founder_id, [[tidy:account]] AS account, total_cents FROM {holdings_snapshots} WHERE deleted_at IS NULL AND total_cents > 0),
        w AS (SELECT founder_id, account, max(total_cents) AS w FROM a GROUP BY founder_id, account),
        t AS (SELECT *, sum(w) OVER (PARTITION BY founder_id) AS total FROM w),
        f AS (SELECT *, [[div:100000 * w¦total]] AS base, (100000 * w) % total AS rest FROM t),
        r AS (SELECT *, row_number() OVER (PARTITION BY founder_id ORDER BY rest DESC, account) AS rn, 100000 - sum(base) OVER (PARTITION BY founder_id) AS spare FROM f)
        SELECT founder_id, account, CAST(base + CASE WHEN rn <= spare THEN 1 ELSE 0 END AS BIGINT) AS cents FROM r""",
    "cents_from_text": """-- M4: printed quantities as thousandths, half up; bracketed are negative, dashes null
        SELECT pos_id, CAST(floor(abs(n) * 1000 + 0.5) AS BIGINT) * CASE WHEN n < 0 THEN -1 ELSE 1 END AS milli FROM (
          SELECT pos_id, CASE WHEN q LIKE '(%' THEN -1 ELSE 1 END * [[num:[[replace:q¦'[^0-9.-]'¦'']]¦DECIMAL(20, 6)]] AS n
          FROM (SELECT DISTINCT pos_id, trim(quantity) AS q FROM {positions}) p) x""",
    "import_once": """-- H5: one import per account, date and file hash
        SELECT founder_id, account, as_of, sha256, CAST(count(DISTINCT id) AS BIGINT) AS n_rows FROM {holdings_snapshots} GROUP BY founder_id, account, as_of, sha256""",
    "holdings_nudges": """-- H7: founders whose least recent account is older than 400 days
        WITH a AS (SELECT founder_id, [[tidy:account]] AS account, max(as_of) AS newest FROM {holdings_snapshots} WHERE deleted_at IS NULL GROUP BY founder_id, [[tidy:account]]),
        o AS (SELECT founder_id, min(newest) AS oldest FROM a GROUP BY founder_id)
        SELECT founder_id, oldest FROM o WHERE oldest < DATE '2024-01-01'""",
    "target_check": """-- M6: do the class weights of a founder sum to the total within a cent
        WITH s AS (SELECT DISTINCT [[tidy:id]] AS id, total_cents FROM {holdings_snapshots}),
        p AS (SELECT [[tidy:snapshot_id]] AS id, sum(value_cents) AS cents FROM (SELECT DISTINCT pos_id, snapshot_id, value_cents FROM {positions}) d GROUP BY [[tidy:snapshot_id]])
        SELECT s.id, abs(coalesce(p.cents, 0) - total_cents) <= 1 AS sums FROM s LEFT JOIN p ON p.id = s.id WHERE total_cents IS NOT NULL""",
    "order_totals": """-- M5: order value against its lines, in cents
        SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents FROM {orders} GROUP BY o_orderstatus""",
}
QUERIES, SQL = plans(TEXTS)
