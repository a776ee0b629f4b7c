"""For queries that SQL can express over whole tables, the statement that must give the same rows."""

from __future__ import annotations

ORACLES: dict[str, str] = {
    "p1_found": """
        SELECT DISTINCT e.chunk_id, CAST(e.text_no AS INTEGER) AS text_no
        FROM (
            SELECT chunk_id, job_id, unnest(texts) AS txt, generate_subscripts(texts, 1) - 1 AS text_no
            FROM chunks WHERE chunk_id IS NOT NULL
        ) e
        LEFT JOIN jobs j ON j.job_id = e.job_id
        LEFT JOIN dispatch_settings s ON s.settings_id = j.settings_id
        WHERE length(e.txt) > coalesce(s.max_chars, 2500)
    """,
}
