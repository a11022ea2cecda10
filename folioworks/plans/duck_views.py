"""DuckDB text of the adapter views, for the oracle statements."""

from __future__ import annotations

VIEWS = {
    "span_lines": """SELECT doc_id AS revision_id, ord // 8 AS page_index, ord % 8 AS ord, line FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents)""",
    "page_text": """SELECT revision_id, CAST(page_index AS INTEGER) AS page_index,
        string_agg(line, chr(10) ORDER BY ord) AS content FROM span_lines GROUP BY 1, 2""",
    "spans": """SELECT revision_id, CAST(page_index AS INTEGER) AS page_index, CAST(ord AS INTEGER) AS ord, line AS text,
        72.0::DOUBLE AS x0, (710 - 12 * ord)::DOUBLE AS y0, (72 + 6 * length(line))::DOUBLE AS x1,
        (720 - 12 * ord)::DOUBLE AS y1 FROM span_lines""",
    "document_pages": """SELECT revision_id, page_index, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height,
        content <> '' AS has_text, CAST(strlen(content) AS BIGINT) AS byte_size FROM page_text""",
    "revisions": """SELECT o_orderkey AS revision_id, o_custkey AS document_id, o_orderdate AS inserted_at,
        CAST(floor(o_totalprice) AS BIGINT) AS byte_size FROM orders""",
    "docs": "SELECT c_custkey AS document_id, c_custkey % 1000 AS user_id, c_name AS title FROM customer",
    "envelopes": """SELECT o_orderkey AS envelope_id, o_custkey AS owner_id,
        CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'partially_signed' ELSE 'sent' END AS status,
        CASE WHEN o_orderkey % 2 = 0 THEN 'parallel' ELSE 'sequential' END AS signing_mode,
        o_orderdate AS sent_at, o_orderdate + INTERVAL '30' DAY AS expires_at,
        CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + INTERVAL '28' DAY END AS last_reminded_at FROM orders""",
    "signers": """SELECT l_orderkey AS envelope_id, CAST(row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS signer_order,
        CASE WHEN l_linestatus = 'O' THEN 'pending' WHEN l_returnflag = 'A' THEN 'signed'
             WHEN l_returnflag = 'R' THEN 'declined' ELSE 'viewed' END AS status,
        l_suppkey % 5 <> 0 AS has_token FROM lineitem""",
    "annotations": """SELECT conv_id AS annotation_id, conv_id % 20 AS document_id, CAST(conv_id % 7 AS INT) AS page_index,
        CASE conv_id % 4 WHEN 0 THEN 'highlight' WHEN 1 THEN 'free_text_callout' WHEN 2 THEN 'measure_area'
             ELSE 'sticky_note' END AS kind,
        role AS author, text AS contents, conv_id % 3 = 0 AS resolved,
        TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL '1' HOUR AS inserted_at FROM conversations WHERE turn = 0""",
    "replies": """SELECT conv_id * 100 + turn AS reply_id, conv_id AS annotation_id, role AS author, text AS body,
        TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL '1' HOUR + turn * INTERVAL '1' MINUTE AS inserted_at
        FROM conversations WHERE turn > 0""",
    "licenses": """SELECT c_custkey AS license_id, c_custkey % 1000 AS user_id,
        CASE c_mktsegment WHEN 'BUILDING' THEN 'trial' WHEN 'AUTOMOBILE' THEN 'standard' WHEN 'MACHINERY' THEN 'premium'
             WHEN 'HOUSEHOLD' THEN 'business' ELSE 'legacy' END AS tier,
        TIMESTAMP '2024-01-01 00:00:00' + c_custkey % 60 * INTERVAL '1' DAY AS expires_at,
        TIMESTAMP '2023-01-01 00:00:00' + c_custkey * INTERVAL '1' MINUTE AS inserted_at FROM customer""",
    "operation_events": """SELECT event_id, user_id AS operation_id, ts,
        CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'progress' END AS message,
        CAST(floor(value) AS BIGINT) % 101 AS progress FROM events""",
    "edit_journal": """SELECT event_id AS op_id, user_id AS document_id, ts,
        CASE event_type WHEN 'click' THEN 'text.style' WHEN 'view' THEN 'annot.update' WHEN 'signup' THEN 'page.rotate'
             WHEN 'purchase' THEN 'undo' ELSE 'redo' END AS kind, event_id % 2 AS target FROM events""",
}

NEEDS = {"page_text": ["span_lines"], "spans": ["span_lines"], "document_pages": ["span_lines", "page_text"]}


def with_views(names: str, sql: str, recursive: bool = False) -> str:
    """A statement with the named views (blank separated) in front."""
    ordered: list[str] = []
    for name in names.split():
        for part in [*NEEDS.get(name, []), name]:
            if part not in ordered:
                ordered.append(part)
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in ordered)
    body = sql.strip()
    head = "WITH RECURSIVE " if recursive else "WITH "
    if body.upper().startswith("WITH "):
        return f"{head}{ctes},\n{body[5:]}"
    return f"{head}{ctes}\n{body}"
