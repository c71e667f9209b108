"""Queries of the general data-preparation operators."""

from pressmill.operators.counters import p4_corrections, p4_counts, p4_found, p4_seen_counts
from pressmill.operators.instants import p2_found, p2_status

QUERIES = {
    "p2_found": p2_found,
    "p2_status": p2_status,
    "p4_found": p4_found,
    "p4_counts": p4_counts,
    "p4_corrections": p4_corrections,
    "p4_seen_counts": p4_seen_counts,
}
SQL: dict[str, str] = {
    "p4_seen_counts": """WITH f AS (SELECT * FROM timeline_data WHERE id IS NOT NULL AND retrieved_at_utc IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY retrieved_at_utc, record_id) = 1),
e AS (SELECT publisher, strptime(substr(gdelt_seendate, 1, 8), '%Y%m%d') AS d, strptime(substr(retrieved_at_utc, 1, 26), '%Y-%m-%dT%H:%M:%S.%f') AS r FROM f WHERE gdelt_seendate IS NOT NULL)
SELECT strftime(d, '%Y-%m-%d') AS day, publisher, count(*) AS n_events FROM e WHERE r <= d + INTERVAL 96 HOUR GROUP BY 1, 2""",
}
