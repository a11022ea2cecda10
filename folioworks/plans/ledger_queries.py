"""Ledgers, reports, translation, batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks import fixtures as fx
from folioworks.operators import access, ledger, reports
from folioworks.plans.duck_views import with_views
from folioworks.plans.ordered import ordered_columns
from folioworks.plans.record_queries import OPERATIONS, ORDERS_NOW, POINTERS, operations
from folioworks.plans.registry import query
from folioworks.streaming import feeds, sinks

# ── signing ─────────────────────────────────────────────────────────────────


@query(
    "unsigned_count",
    with_views(
        "envelopes signers",
        """SELECT envelope_id, count(signer_order) FILTER (s.status NOT IN ('signed', 'declined')) AS unsigned,
            count(signer_order) FILTER (s.status NOT IN ('signed', 'declined')) = 0 AS complete
        FROM envelopes LEFT JOIN signers s USING (envelope_id) GROUP BY 1""",
    ),
)
def unsigned_count(spark, sf_dir):
    return ledger.unsigned_count(fx.envelopes(spark, sf_dir), fx.signers(spark, sf_dir))


@query(
    "next_signers",
    with_views(
        "envelopes signers",
        """SELECT envelope_id, signer_order FROM (SELECT e.envelope_id, signer_order, signing_mode, s.status IN ('signed', 'declined') AS done,
            row_number() OVER (PARTITION BY e.envelope_id ORDER BY s.status IN ('signed', 'declined'), signer_order) AS r
            FROM envelopes e JOIN signers s USING (envelope_id)) WHERE signing_mode = 'parallel' OR (r = 1 AND NOT done)""",
    ),
)
def next_signers(spark, sf_dir):
    return ledger.next_signers(fx.envelopes(spark, sf_dir), fx.signers(spark, sf_dir))


def audit_events(spark, sf_dir) -> DataFrame:
    return fx.table(spark, sf_dir, "events").selectExpr(
        "event_id", "event_id % 2500 AS envelope_id", "event_id % 700 AS signer_id", "ts AS occurred_at",
        "CASE WHEN event_id < 2500 AND event_id % 9 <> 0 THEN 'sent' ELSE element_at(array('signed', 'completed', 'signed', 'voided', 'declined', 'signed'), "
        "CAST(event_id * 7 % 6 + 1 AS INT)) END AS event",
        "element_at(array('viewed', 'signed', 'declined', 'pending', 'viewed'), CAST(event_id * 3 % 5 + 1 AS INT)) AS signer_event",
    )


AUDIT = """audit AS (SELECT event_id, event_id % 2500 AS envelope_id, event_id % 700 AS signer_id, ts AS occurred_at,
    CASE WHEN event_id < 2500 AND event_id % 9 <> 0 THEN 'sent' ELSE ['signed', 'completed', 'signed', 'voided', 'declined', 'signed'][event_id * 7 % 6 + 1] END AS event,
    ['viewed', 'signed', 'declined', 'pending', 'viewed'][event_id * 3 % 5 + 1] AS signer_event FROM events)"""


@query(
    "audit_trail",
    f"""WITH {AUDIT} SELECT event_id, envelope_id, CAST(row_number() OVER w AS INTEGER) AS event_no,
        epoch_us(lead(occurred_at) OVER w) - epoch_us(occurred_at) AS dwell_micros FROM audit
        WINDOW w AS (PARTITION BY envelope_id ORDER BY occurred_at, event_id)""",
)
def audit_trail(spark, sf_dir):
    trail = ledger.audit_trail(audit_events(spark, sf_dir))
    return trail.select("event_id", "envelope_id", "event_no", "dwell_micros")


def _machine_sql(key: str, event: str, start: str, moves: dict[str, list[str]], extra: str) -> str:
    legal = ", ".join(f"'{a}>{b}'" for a, targets in moves.items() for b in targets)
    return f"""WITH {AUDIT}, folded AS (SELECT {key}, list_reduce(list({{'id': event_id, 'e': event, 't': target}} ORDER BY occurred_at, event_id),
            lambda a, x: {{'s': CASE WHEN list_contains([{legal}], a.s || '>' || x.t) THEN x.t ELSE a.s END,
                'out': list_append(a.out, {{'id': x.id, 'e': x.e, 'before': a.s, 'ok': list_contains([{legal}], a.s || '>' || x.t)}})}},
            {{'s': '{start}', 'out': CAST([] AS STRUCT(id BIGINT, e VARCHAR, "before" VARCHAR, ok BOOLEAN)[])}}).out AS out
            FROM (SELECT {key}, event_id, occurred_at, {event} AS event, CASE WHEN '{key}' = 'envelope_id' AND {event} = 'signed'
                THEN 'partially_signed' ELSE {event} END AS target FROM audit) GROUP BY 1),
        flat AS (SELECT {key}, unnest(out) AS o FROM folded)
        SELECT {key}, o.id AS event_id, o.before AS state_before, o.ok AS accepted{extra} FROM flat"""


_REPLAY_MOVES = {**ledger.ENVELOPE_MOVES, "partially_signed": [*ledger.ENVELOPE_MOVES["partially_signed"], "partially_signed"]}


@query(
    "envelope_replay",
    _machine_sql(
        "envelope_id", "event", "draft", _REPLAY_MOVES,
        """, CASE WHEN o.ok THEN NULL WHEN o.e = 'signed' AND o.before = 'draft' THEN 'envelope_not_sent'
            WHEN o.e = 'signed' AND o.before = 'completed' THEN 'envelope_already_completed'
            WHEN o.e = 'signed' THEN 'envelope_' || o.before ELSE 'invalid_transition' END AS reason""",
    ),
)
def envelope_replay(spark, sf_dir):
    replayed = ledger.envelope_replay(audit_events(spark, sf_dir))
    return replayed.select("envelope_id", "event_id", "state_before", "accepted", "reason")


@query("signer_replay", _machine_sql("signer_id", "signer_event", "pending", ledger.SIGNER_MOVES, ""))
def signer_replay(spark, sf_dir):
    events = audit_events(spark, sf_dir).drop("event").withColumnRenamed("signer_event", "event")
    return ledger.signer_replay(events).select("signer_id", "event_id", "state_before", "accepted")


#: Attempts of each signer: event, days after the order's date, for which signers.
SIGNER_ATTEMPTS = [
    ("viewed", "5 + l_partkey % 80", "l_suppkey % 11 > 0"),
    ("signed", "20 + l_suppkey % 70", "l_linenumber > 0"),
    ("declined", "2 + l_partkey % 60", "l_partkey % 29 = 0"),
    ("viewed", "95", "l_linenumber > 0"),
    ("signed", "100 + signer_order", "l_partkey % 13 > 0"),
    ("signed", "110 + l_partkey % 20", "l_linenumber > 0"),
]
#: The same for each envelope.
ENVELOPE_ATTEMPTS = [
    ("sent", "o_orderkey % 60", "o_orderkey % 17 > 0"),
    ("sent", "90", "o_orderkey % 5 = 0"),
    ("voided", "75 + o_custkey % 60", "o_orderkey % 7 = 0"),
    ("expired", "140", "o_orderkey % 3 = 0"),
    ("archived", "50", "o_orderkey % 19 = 0"),
]


def _signer_log(spark, sf_dir) -> DataFrame:
    """(event_id, envelope_id, signer_id, occurred_at, event): lines of an order as its signers, in line order."""
    lines = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    placed = ordered_columns(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], row_number="signer_order")
    dated = placed.join(fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS l_orderkey", "o_orderdate"), "l_orderkey")
    signer = "l_orderkey * 1000 + signer_order"
    acts = ", ".join(
        f"IF({when}, named_struct('n', {i}, 'day', CAST({day} AS INT), 'event', '{event}'), NULL)" for i, (event, day, when) in enumerate(SIGNER_ATTEMPTS)
    )
    # every 41st acts on the next order, where nobody knows them
    acting = dated.selectExpr(f"{signer} AS signer_id", "l_orderkey + IF(l_partkey % 41 = 0, 1, 0) AS envelope_id", "o_orderdate", f"explode(array_compact(array({acts}))) AS a")
    sides = fx.table(spark, sf_dir, "orders").selectExpr(
        "CAST(NULL AS BIGINT) AS signer_id", "o_orderkey AS envelope_id", "o_orderdate",
        "explode(array_compact(array(" + ", ".join(
            f"IF({when}, named_struct('n', {i}, 'day', CAST({day} AS INT), 'event', '{event}'), NULL)" for i, (event, day, when) in enumerate(ENVELOPE_ATTEMPTS)
        ) + "))) AS a",
    )
    return acting.unionByName(sides).selectExpr(
        "coalesce(signer_id, envelope_id * 1000) * 10 + a.n AS event_id", "envelope_id", "signer_id", "o_orderdate + make_dt_interval(a.day) AS occurred_at", "a.event"
    )


_ATTEMPTS_SQL = " UNION ALL ".join(
    [
        f"""SELECT (l_orderkey * 1000 + signer_order) * 10 + {i} AS event_id, l_orderkey + CASE WHEN l_partkey % 41 = 0 THEN 1 ELSE 0 END AS envelope_id,
            l_orderkey * 1000 + signer_order AS signer_id, o_orderdate + ({day}) * INTERVAL '1' DAY AS occurred_at, '{event}' AS event
            FROM placed JOIN orders ON o_orderkey = l_orderkey WHERE {when}"""
        for i, (event, day, when) in enumerate(SIGNER_ATTEMPTS)
    ]
    + [
        f"""SELECT o_orderkey * 10000 + {i}, o_orderkey, CAST(NULL AS BIGINT), o_orderdate + ({day}) * INTERVAL '1' DAY, '{event}' FROM orders WHERE {when}"""
        for i, (event, day, when) in enumerate(ENVELOPE_ATTEMPTS)
    ]
)

_OPEN = "a.e IN ('sent', 'partially_signed')"
_SIGNING_SQL = f"""WITH placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS signer_order
        FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem)),
    log AS ({_ATTEMPTS_SQL}),
    sizes AS (SELECT l_orderkey, count(*) AS n FROM placed GROUP BY 1),
    known AS (SELECT log.*, p.signer_order AS r FROM log LEFT JOIN placed p ON p.l_orderkey = log.envelope_id AND p.l_orderkey * 1000 + p.signer_order = log.signer_id),
    lists AS (SELECT envelope_id, list({{'id': event_id, 'ev': event, 'r': r}} ORDER BY occurred_at, event_id) AS evs FROM known GROUP BY 1),
    folded AS (SELECT envelope_id, list_reduce(evs, lambda a, x: list_transform([CASE
            WHEN x.ev = 'sent' THEN CASE WHEN a.e = 'draft' THEN '' ELSE 'invalid_transition' END
            WHEN x.ev IN ('voided', 'expired') THEN CASE WHEN {_OPEN} THEN '' ELSE 'invalid_transition' END
            WHEN x.ev NOT IN ('viewed', 'signed', 'declined') THEN 'invalid_transition'
            WHEN x.r IS NULL THEN 'signer_not_found'
            WHEN x.ev = 'viewed' THEN CASE WHEN a.st[x.r] = 'pending' THEN '' ELSE 'invalid_transition' END
            WHEN x.ev = 'declined' THEN CASE WHEN a.e = 'sent' AND a.st[x.r] = 'pending' THEN '' ELSE 'invalid_transition' END
            WHEN a.e = 'draft' THEN 'envelope_not_sent' WHEN a.e = 'completed' THEN 'envelope_already_completed'
            WHEN NOT {_OPEN} THEN 'envelope_' || a.e
            WHEN a.st[x.r] = 'pending' THEN 'signer_not_viewed_yet' WHEN a.st[x.r] <> 'viewed' THEN 'already_' || a.st[x.r]
            WHEN a.odd AND list_position(list_transform(a.st, lambda v: v IN ('signed', 'declined')), false) <> x.r THEN 'signer_out_of_order'
            ELSE '' END], lambda why: {{'e': CASE WHEN why <> '' OR x.ev = 'viewed' THEN a.e WHEN x.ev <> 'signed' THEN x.ev
                    WHEN len(list_filter(a.st, lambda v: v IN ('signed', 'declined'))) + 1 = len(a.st) THEN 'completed' ELSE 'partially_signed' END,
                'odd': a.odd, 'st': CASE WHEN why <> '' OR x.r IS NULL THEN a.st ELSE list_transform(a.st, lambda v, i: CASE WHEN i = x.r THEN x.ev ELSE v END) END,
                'out': list_append(a.out, {{'id': x.id, 'b': a.e, 's': a.st[x.r], 'why': why}})}})[1],
            {{'e': 'draft', 'odd': envelope_id % 2 <> 0, 'st': CAST(list_transform(range(coalesce(n, 0)), lambda i: 'pending') AS VARCHAR[]),
              'out': CAST([] AS STRUCT(id BIGINT, b VARCHAR, s VARCHAR, why VARCHAR)[])}}).out AS out
        FROM lists LEFT JOIN sizes ON l_orderkey = envelope_id)
    SELECT envelope_id, o.id AS event_id, o.b AS state_before, o.s AS signer_before, o.why = '' AS accepted, nullif(o.why, '') AS reason
    FROM (SELECT envelope_id, unnest(out) AS o FROM folded)"""


@query("signing_replay", _SIGNING_SQL)
def signing_replay(spark, sf_dir):
    signers = fx.signers(spark, sf_dir).withColumn("signer_id", F.expr("envelope_id * 1000 + signer_order"))
    replayed = ledger.signing_replay(_signer_log(spark, sf_dir), signers, fx.envelopes(spark, sf_dir))
    return replayed.select("envelope_id", "event_id", "state_before", "signer_before", "accepted", "reason")


# ── edit journals ───────────────────────────────────────────────────────────

EIGHT_HOURS = 8 * 3600 * 1_000_000


@query(
    "coalesce_edits",
    with_views(
        "edit_journal",
        """SELECT op_id, document_id, kind FROM (SELECT *, lead(kind) OVER w AS k2, lead(target) OVER w AS t2, lead(ts) OVER w AS ts2
            FROM edit_journal WINDOW w AS (PARTITION BY document_id ORDER BY ts, op_id))
        WHERE NOT coalesce(kind IN ('text.style', 'annot.update') AND kind = k2 AND target = t2 AND ts2 - ts < INTERVAL 8 HOUR, false)""",
    ),
)
def coalesce_edits(spark, sf_dir):
    kept = ledger.coalesce_edits(fx.edit_journal(spark, sf_dir), ["document_id"], EIGHT_HOURS)
    return kept.select("op_id", "document_id", "kind")


UNDO = """folded AS (SELECT document_id, list_reduce(list({'id': op_id, 'k': kind} ORDER BY ts, op_id),
        lambda a, x: CASE WHEN x.k = 'undo' AND a.d > 0 THEN {'d': a.d - 1, 'r': a.r + 1, 'out': list_append(a.out, {'id': x.id, 'ok': true, 'd': a.d - 1, 'r': a.r + 1})}
            WHEN x.k = 'redo' AND a.r > 0 THEN {'d': a.d + 1, 'r': a.r - 1, 'out': list_append(a.out, {'id': x.id, 'ok': true, 'd': a.d + 1, 'r': a.r - 1})}
            WHEN x.k IN ('undo', 'redo') THEN {'d': a.d, 'r': a.r, 'out': list_append(a.out, {'id': x.id, 'ok': false, 'd': a.d, 'r': a.r})}
            ELSE {'d': a.d + 1, 'r': 0::BIGINT, 'out': list_append(a.out, {'id': x.id, 'ok': true, 'd': a.d + 1, 'r': 0::BIGINT})} END,
        {'d': 0::BIGINT, 'r': 0::BIGINT, 'out': CAST([] AS STRUCT(id BIGINT, ok BOOLEAN, d BIGINT, r BIGINT)[])}).out AS out
        FROM edit_journal GROUP BY 1),
    steps AS (SELECT document_id, o.id AS op_id, o.ok AS ok, o.d AS journal_depth, o.r AS redo_depth, i AS seq
        FROM (SELECT document_id, unnest(out) AS o, generate_subscripts(out, 1) AS i FROM folded))"""


@query("undo_redo", with_views("edit_journal", f"WITH {UNDO} SELECT * EXCLUDE (seq) FROM steps"))
def undo_redo(spark, sf_dir):
    replayed = ledger.undo_redo(fx.edit_journal(spark, sf_dir), ["document_id"])
    return replayed.select("document_id", "op_id", "ok", "journal_depth", "redo_depth")


@query(
    "undo_redo_state",
    with_views(
        "edit_journal",
        f"""WITH {UNDO}, last AS (SELECT document_id, arg_max(journal_depth, seq) AS d, arg_max(redo_depth, seq) AS r FROM steps GROUP BY 1),
        pushes AS (SELECT s.document_id, journal_depth AS level, arg_max(op_id, seq) AS op_id FROM steps s JOIN edit_journal USING (op_id)
            WHERE kind NOT IN ('undo', 'redo') GROUP BY 1, 2)
        SELECT document_id, level, op_id, CASE WHEN level <= d THEN 'journal' ELSE 'redo' END AS stack FROM pushes JOIN last USING (document_id)
        WHERE level <= d + r""",
    ),
)
def undo_redo_state(spark, sf_dir):
    replayed = ledger.undo_redo(fx.edit_journal(spark, sf_dir), ["document_id"])
    return ledger.undo_redo_state(replayed, ["document_id"])


# ── operations and jobs ─────────────────────────────────────────────────────

PROGRESS = """SELECT operation_id, arg_max(CASE message WHEN 'progress' THEN progress ELSE 100 END, {'t': ts, 'e': event_id}) AS percent,
    coalesce(arg_max(CASE message WHEN 'completed' THEN 'success' ELSE 'error' END, {'t': ts, 'e': event_id}) FILTER (message <> 'progress'), 'running') AS status
    FROM operation_events GROUP BY 1"""


@query("latest_progress", with_views("operation_events", PROGRESS))
def latest_progress(spark, sf_dir):
    return ledger.latest_progress(fx.operation_events(spark, sf_dir))


@query(
    "progress_violations",
    with_views(
        "operation_events",
        """SELECT event_id, operation_id, progress, previous FROM (SELECT *, lag(progress) OVER (PARTITION BY operation_id ORDER BY ts, event_id) AS previous
            FROM operation_events WHERE message = 'progress') WHERE progress < previous""",
    ),
)
def progress_violations(spark, sf_dir):
    found = ledger.progress_violations(fx.operation_events(spark, sf_dir))
    return found.select("event_id", "operation_id", "progress", "previous")


@query(
    "operation_report",
    f"""WITH {OPERATIONS} SELECT kind, status, count(*) AS operations, CAST(sum(epoch_us(finished_at) - epoch_us(started_at)) AS BIGINT) AS total_micros,
        max(epoch_us(finished_at) - epoch_us(started_at)) AS longest_micros FROM operations GROUP BY 1, 2""",
)
def operation_report(spark, sf_dir):
    return ledger.operation_report(operations(spark, sf_dir))


@query(
    "failure_messages",
    f"""WITH {OPERATIONS} SELECT operation_id, CASE reason WHEN 'password_required' THEN 'The document is password-protected'
        WHEN 'invalid_pdf' THEN 'The file is not a readable PDF' WHEN 'not_found' THEN 'The document could not be found'
        WHEN 'no_pages' THEN 'The document has no pages to process' ELSE 'The conversion failed (see logs for details)' END AS failure
        FROM operations WHERE status = 'failed'""",
)
def failure_messages(spark, sf_dir):
    return ledger.operation_durations(operations(spark, sf_dir)).where("status = 'failed'").select("operation_id", "failure")


def jobs(rows: DataFrame) -> DataFrame:
    """Jobs every few minutes per (worker, args) pair."""
    return rows.selectExpr("event_id AS job_id", "event_type AS worker", "CAST(user_id % 3 AS STRING) AS args", "ts")


UNIQUE = """folded AS (SELECT event_type AS worker, CAST(user_id % 3 AS VARCHAR) AS args, list_reduce(list({'id': event_id, 't': epoch_us(ts)} ORDER BY ts, event_id),
        lambda a, x: CASE WHEN a.at IS NULL OR x.t - a.at > 3600000000 THEN {'at': x.t, 'keep': list_append(a.keep, x.id)} ELSE a END,
        {'at': CAST(NULL AS BIGINT), 'keep': CAST([] AS BIGINT[])}).keep AS keep FROM events GROUP BY 1, 2)"""


@query("unique_jobs", f"WITH {UNIQUE} SELECT worker, args, unnest(keep) AS job_id FROM folded")
def unique_jobs(spark, sf_dir):
    return ledger.unique_jobs(jobs(fx.table(spark, sf_dir, "events")), 3600).select("worker", "args", "job_id")


# ── recognition, signatures, conformance, telemetry ─────────────────────────


def ocr_words(spark, sf_dir) -> DataFrame:
    return fx.table(spark, sf_dir, "lineitem").where("l_suppkey % 10 <> 0").selectExpr(
        "l_orderkey AS document_id", "CAST(l_linenumber % 3 AS INT) AS page_index", "l_extendedprice % 101 AS conf"
    )


OCR = """pages_ocr AS (SELECT DISTINCT l_orderkey AS document_id, CAST(l_linenumber % 3 AS INTEGER) AS page_index FROM lineitem),
    words AS (SELECT l_orderkey AS document_id, CAST(l_linenumber % 3 AS INTEGER) AS page_index, l_extendedprice % 101 AS conf FROM lineitem WHERE l_suppkey % 10 <> 0)"""


@query(
    "ocr_confidence",
    f"""WITH {OCR} SELECT document_id, page_index, round(avg(conf), 6) AS avg_conf, min(conf) AS min_conf, count(conf) AS word_count,
        count(*) FILTER (conf < 80) AS low_words FROM pages_ocr LEFT JOIN words USING (document_id, page_index) GROUP BY 1, 2""",
)
def ocr_confidence(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS document_id", "CAST(l_linenumber % 3 AS INT) AS page_index").distinct()
    return reports.ocr_confidence(pages, ocr_words(spark, sf_dir)).withColumn("avg_conf", F.round("avg_conf", 6))


@query(
    "latest_ocr",
    """SELECT document_id, result_id, inserted_at, engine_version FROM (SELECT o_custkey AS document_id, o_orderkey AS result_id, o_orderdate AS inserted_at,
        o_orderpriority AS engine_version, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""",
)
def latest_ocr(spark, sf_dir):
    results = fx.table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS document_id", "o_orderkey AS result_id", "o_orderdate AS inserted_at", "o_orderpriority AS engine_version"
    )
    return reports.latest_ocr(results)


@query(
    "needs_ocr_prompt",
    with_views(
        "docs revisions document_pages",
        f"""WITH {POINTERS}, texts AS (SELECT revision_id, bool_or(has_text AND revision_id % 3 <> 0) AS t FROM document_pages GROUP BY 1)
        SELECT document_id, coalesce(t, false) AS has_any_text, current_revision_id IS NOT NULL AND NOT coalesce(t, false) AS show_prompt
        FROM docs LEFT JOIN pointers USING (document_id) LEFT JOIN texts ON revision_id = current_revision_id""",
    ),
)
def needs_ocr_prompt(spark, sf_dir):
    pointers = access.current_pointers(fx.revisions(spark, sf_dir))
    documents = fx.documents(spark, sf_dir).join(pointers, "document_id", "left")
    pages = fx.document_pages(spark, sf_dir).withColumn("has_text", F.expr("has_text AND revision_id % 3 <> 0"))
    return reports.needs_ocr_prompt(documents, pages)


@query(
    "signature_rollup",
    """WITH s AS (SELECT l_orderkey AS document_id, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_partkey % 9 <> 1 END AS br, CASE WHEN l_suppkey % 11 <> 0 THEN l_suppkey END AS subject,
            CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_suppkey % 13 <> 2 END AS imprint, l_linenumber % 2 = 0 AS has_ts,
            CASE WHEN l_linenumber % 4 = 1 THEN NULL ELSE l_partkey % 5 <> 0 END AS ts_ok FROM lineitem),
        v AS (SELECT document_id, br IS DISTINCT FROM false AND subject IS NOT NULL AND imprint IS DISTINCT FROM false
            AND (ts_ok IS DISTINCT FROM false OR NOT has_ts) AS valid FROM s)
        SELECT document_id, count(*) AS signatures, count(*) FILTER (valid) AS valid_signatures, bool_and(valid) AS all_valid FROM v GROUP BY 1""",
)
def signature_rollup(spark, sf_dir):
    signatures = fx.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS document_id", "CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_partkey % 9 <> 1 END AS byte_range_intact",
        "CASE WHEN l_suppkey % 11 <> 0 THEN concat('CN=', l_suppkey) END AS signer_cert_subject",
        "CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_suppkey % 13 <> 2 END AS message_imprint_match", "l_linenumber % 2 = 0 AS has_timestamp",
        "CASE WHEN l_linenumber % 4 = 1 THEN NULL ELSE l_partkey % 5 <> 0 END AS timestamp_valid",
    )
    return reports.signature_rollup(signatures)


def _catalogues(spark, sf_dir) -> DataFrame:
    return fx.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS document_id",
        "map_filter(map('Encrypt', CASE WHEN o_orderkey % 10 = 0 THEN 'x' END, 'OutputIntents', CASE o_orderkey % 3 WHEN 0 THEN 'sRGB' WHEN 1 THEN '' END, "
        "'Metadata', CASE o_orderkey % 4 WHEN 0 THEN 'ref' WHEN 1 THEN 'inline' END, 'MarkInfo', CASE WHEN o_orderkey % 5 < 2 THEN 'Marked=true' END, "
        "'JavaScript', CASE WHEN o_orderkey % 7 = 0 THEN 'js' END, 'OpenAction', CASE WHEN o_orderkey % 6 = 0 THEN 'go' END), (k, v) -> v IS NOT NULL) AS catalogue",
    )


RULES = """rules AS (SELECT o_orderkey AS document_id, unnest(['No encryption', 'ICC OutputIntent', 'XMP metadata', 'MarkInfo', 'No JS / actions', 'StructTreeRoot (tagged)']) AS name,
    unnest([CASE WHEN o_orderkey % 10 = 0 THEN 'fail' ELSE 'pass' END, CASE WHEN o_orderkey % 3 = 0 THEN 'pass' ELSE 'fail' END,
        CASE WHEN o_orderkey % 4 = 0 THEN 'pass' ELSE 'fail' END, CASE WHEN o_orderkey % 5 < 2 THEN 'pass' ELSE 'fail' END,
        CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 6 = 0 THEN 'fail' ELSE 'pass' END, 'not_verified']) AS status FROM orders)"""


@query("conformance_report", f"WITH {RULES} FROM rules")
def conformance_report(spark, sf_dir):
    return reports.conformance_report(_catalogues(spark, sf_dir)).select("document_id", "name", "status")


@query("conformance_summary", f"WITH {RULES} SELECT name, status, count(*) AS documents FROM rules GROUP BY 1, 2")
def conformance_summary(spark, sf_dir):
    return reports.conformance_summary(reports.conformance_report(_catalogues(spark, sf_dir)))


@query(
    "telemetry_summary",
    """SELECT event_type, count(value) AS events, round(sum(value), 2) AS total, min(value) AS lowest, round(avg(value), 6) AS mean, max(value) AS highest,
        quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1""",
)
def telemetry_summary(spark, sf_dir):
    summary = reports.telemetry_summary(fx.table(spark, sf_dir, "events"), ["event_type"])
    return summary.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 6)})


# ── translation and batches ─────────────────────────────────────────────────


def _texts(spark, sf_dir) -> DataFrame:
    return fx.page_text(spark, sf_dir).select(
        "revision_id", "page_index", F.array_join(F.transform("spans", lambda s: s["text"]), "").alias("text"),
        F.lit("en").alias("source_lang"), F.lit("de").alias("target_lang"),
    )


def _cache(spark, sf_dir) -> DataFrame:
    """Translations known so far: the first pages of two documents in three."""
    known = _texts(spark, sf_dir).where("page_index = 0 AND revision_id % 3 <> 0 AND text <> ''")
    key = reports.cache_key(F.col("text"), F.col("source_lang"), F.col("target_lang"))
    return known.select(key.alias("key"), F.upper("text").alias("output")).dropDuplicates(["key"])


def provider(text: str, source: str, target: str) -> str:
    """Reverses a text and refuses those with a question mark."""
    if "?" in text:
        raise ValueError("no questions")
    return text[::-1]


TEXTS = """texts AS (SELECT revision_id, page_index, string_agg(text, '' ORDER BY ord) AS text FROM spans GROUP BY 1, 2),
    keyed AS (SELECT *, sha256(text || '|en|de') AS key FROM texts),
    cache AS (SELECT DISTINCT key FROM keyed WHERE page_index = 0 AND revision_id % 3 <> 0 AND text <> '')"""


@query(
    "cache_misses",
    with_views("spans", f"WITH {TEXTS} SELECT DISTINCT key, length(text) AS chars FROM keyed WHERE text <> '' AND key NOT IN (FROM cache)"),
)
def cache_misses(spark, sf_dir):
    missed = reports.cache_misses(_texts(spark, sf_dir), _cache(spark, sf_dir))
    return missed.select("key", F.length("text").cast("bigint").alias("chars"))


@query(
    "translation_report",
    with_views(
        "spans",
        f"""WITH {TEXTS}, done AS (SELECT revision_id, text = '' OR key IN (FROM cache) OR NOT contains(text, '?') AS ok FROM keyed)
        SELECT revision_id, count(*) AS pages, count(*) FILTER (ok) AS done, count(*) FILTER (NOT ok) AS errors FROM done GROUP BY 1""",
    ),
)
def translation_report(spark, sf_dir):
    pages = reports.translated_pages(_texts(spark, sf_dir), _cache(spark, sf_dir), provider)
    return reports.translation_report(pages, ["revision_id"])


@query(
    "batch_plan",
    """WITH f AS (SELECT page_id AS file_id, 'page.' || page_id AS stem, page_id % 3 AS recipe_id FROM pages),
        s AS (FROM (VALUES (0, 0, 'compress', 'preset=high'), (0, 1, 'split', 'every_n=5'), (1, 0, 'pdfa', ''), (1, 1, 'sharpen', NULL),
            (1, 2, 'split', 'every_n=12'), (2, 0, 'image_to_pdf', 'contrast=auto,deskew=false')) t(recipe_id, step_no, step, options))
        SELECT file_id, recipe_id, step_no, step, options, CASE WHEN step <> 'sharpen' THEN stem || ' — ' || step END AS title,
            CASE WHEN step = 'sharpen' THEN 'unknown step: sharpen' END AS error FROM f JOIN s USING (recipe_id)""",
)
def batch_plan(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "pages").selectExpr(
        "page_id AS file_id", "concat('in/page.', page_id, '.pdf') AS filename", "page_id % 3 AS recipe_id"
    )
    # three recipes, as rows of the region table
    recipes = fx.table(spark, sf_dir, "region").where("r_regionkey <= 2").selectExpr(
        "CAST(r_regionkey AS BIGINT) AS recipe_id",
        "element_at(array("
        "array(named_struct('id', 'compress', 'options', map('preset', 'high')), named_struct('id', 'split', 'options', map('every_n', 'many'))), "
        "array(named_struct('id', 'pdfa', 'options', CAST(NULL AS MAP<STRING, STRING>)), named_struct('id', 'sharpen', 'options', map('x', 'y')), "
        "named_struct('id', 'split', 'options', map('every_n', '12'))), "
        "array(named_struct('id', 'image_to_pdf', 'options', map('deskew', 'false')))), CAST(r_regionkey + 1 AS INT)) AS steps",
    )
    plan = reports.batch_plan(pages, recipes)
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("options")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return plan.withColumn("options", listed)


# ── streams ─────────────────────────────────────────────────────────────────


def _shuffled(rows: DataFrame, time: str, name: str, closing: dict[str, str], count: int = 4) -> tuple[DataFrame, str]:
    """(stream, delay): rows dealt to micro-batches out of order, and the watermark delay that covers the disorder.

    A row is up to a tenth of the whole time span off its place. A last batch holds one row, far behind the others in
    time, whose columns `closing` gives: it moves the watermark past everything else and stays waiting itself.
    """
    micros = F.unix_micros(F.col(time))
    first, last = rows.select(F.min(micros), F.max(micros)).first()
    span = max(last - first, 1)
    noise = F.pmod(F.xxhash64(*rows.columns), F.lit(1001)) / 1000.0 - 0.5
    at = (micros - F.lit(first)) / F.lit(span) + 0.2 * noise
    number = F.greatest(F.least(F.floor(at * count), F.lit(count - 1)), F.lit(0)).cast("int")
    end = rows.limit(1).select(*[F.expr(closing.get(f.name, "NULL")).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
    end = end.withColumn(time, F.timestamp_micros(F.lit(last + span + 400 * 86_400_000_000)))
    numbered = rows.withColumn("_batch", number).unionByName(end.withColumn("_batch", F.lit(count)))
    stream = sinks.micro_batches(numbered.select(*rows.columns, "_batch"), F.col("_batch"), count + 1, name)
    return stream.drop("_batch"), f"{int(0.3 * span / 1e6) + 1} seconds"


@query("stream_progress", with_views("operation_events", PROGRESS))
def stream_progress(spark, sf_dir):
    events = sinks.file_stream(spark, f"{sf_dir}/events*.parquet").selectExpr(
        "event_id", "user_id AS operation_id", "CAST(ts AS TIMESTAMP) AS ts",
        "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'progress' END AS message",
        "CAST(floor(value) AS BIGINT) % 101 AS progress",
    )
    with sinks.rocksdb(spark):
        return sinks.run_updates(feeds.progress_stream(events), "progress", ["operation_id"])


@query("stream_unique_jobs", f"WITH {UNIQUE} SELECT worker, args, unnest(keep) AS job_id FROM folded")
def stream_unique_jobs(spark, sf_dir):
    rows = jobs(fx.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    feed, late = _shuffled(rows, "ts", "jobs-in", {"worker": "''", "args": "''", "job_id": "-1"})
    with sinks.rocksdb(spark):
        kept = sinks.run_appends(feeds.unique_jobs_stream(feed, 3600, late), "unique-jobs")
    return kept.select("worker", "args", "job_id")


def _journal(spark, sf_dir) -> DataFrame:
    return fx.edit_journal(spark, sf_dir).selectExpr("op_id", "document_id", "CAST(ts AS TIMESTAMP) AS ts", "kind")


@query("stream_edit_sessions", with_views("edit_journal", f"WITH {UNDO} SELECT * EXCLUDE (seq) FROM steps"))
def stream_edit_sessions(spark, sf_dir):
    feed = sinks.file_stream(spark, f"{sf_dir}/events*.parquet").selectExpr(
        "event_id AS op_id", "user_id AS document_id", "CAST(ts AS TIMESTAMP) AS ts",
        "CASE event_type WHEN 'click' THEN 'text.style' WHEN 'view' THEN 'annot.update' WHEN 'signup' THEN 'page.rotate' "
        "WHEN 'purchase' THEN 'undo' ELSE 'redo' END AS kind",
    )
    with sinks.rocksdb(spark):
        done = sinks.run_appends(feeds.edit_session_stream(feed, idle_ms=None), "edit-sessions")
    return done.select("document_id", "op_id", "ok", "journal_depth", "redo_depth")


@query(
    "stream_edit_sessions_idle",
    with_views(
        "edit_journal",
        f"""WITH gaps AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > {EIGHT_HOURS}, false) AS silent
                FROM edit_journal WINDOW w AS (PARTITION BY document_id ORDER BY ts, op_id)),
            sessions AS (SELECT *, count(*) FILTER (silent) OVER (PARTITION BY document_id ORDER BY ts, op_id ROWS UNBOUNDED PRECEDING) AS session FROM gaps),
            {UNDO.replace("FROM edit_journal GROUP BY 1", "FROM sessions GROUP BY document_id, session")} SELECT * EXCLUDE (seq) FROM steps""",
    ),
)
def stream_edit_sessions_idle(spark, sf_dir):
    feed, late = _shuffled(_journal(spark, sf_dir), "ts", "journal-in", {"op_id": "-1", "document_id": "-1", "kind": "'undo'"})
    with sinks.rocksdb(spark):
        done = sinks.run_appends(feeds.edit_session_stream(feed, EIGHT_HOURS // 1000, late), "edit-sessions-idle")
    return done.select("document_id", "op_id", "ok", "journal_depth", "redo_depth")


@query(
    "stream_expiry_timers",
    """SELECT o_orderkey AS envelope_id, 'expired' AS event, o_orderdate + (CASE WHEN o_orderkey % 4 = 0 THEN 50 ELSE 30 END) * INTERVAL '1' DAY AS occurred_at
        FROM orders WHERE NOT (o_orderstatus = 'F' AND o_custkey % 60 <= CASE WHEN o_orderkey % 4 = 0 THEN 50 ELSE 30 END)""",
)
def stream_expiry_timers(spark, sf_dir):
    """Each envelope is sent, every fourth gets 20 days more on its tenth day, some are completed within 60 days."""
    changes = fx.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS envelope_id",
        "explode(array_compact(array(named_struct('day', 0, 'status', 'sent', 'until', 30), "
        "IF(o_orderkey % 4 = 0, named_struct('day', 10, 'status', 'partially_signed', 'until', 50), NULL), "
        "IF(o_orderstatus = 'F', named_struct('day', CAST(o_custkey % 60 AS INT), 'status', 'completed', 'until', CAST(NULL AS INT)), NULL)))) AS c",
        "o_orderdate",
    ).selectExpr(
        "envelope_id", "c.status", "CAST(o_orderdate + make_dt_interval(c.until) AS TIMESTAMP) AS expires_at",
        "CAST(o_orderdate + make_dt_interval(c.day) AS TIMESTAMP) AS changed_at",
    )
    feed, late = _shuffled(changes, "changed_at", "envelopes-in", {"envelope_id": "-1", "status": "'draft'"})
    with sinks.rocksdb(spark):
        return sinks.run_appends(feeds.expiry_timers(feed, late), "expiry-timers")


@query(
    "stream_expiry",
    with_views(
        "envelopes",
        """SELECT envelope_id, 'expired' AS event, TIMESTAMP '1998-01-01' AS occurred_at FROM envelopes
            WHERE status IN ('sent', 'partially_signed') AND expires_at < TIMESTAMP '1998-01-01'""",
    ),
)
def stream_expiry(spark, sf_dir):
    feed = sinks.file_stream(spark, f"{sf_dir}/orders*.parquet").selectExpr(
        "o_orderkey AS envelope_id",
        "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'partially_signed' ELSE 'sent' END AS status",
        "o_orderdate + INTERVAL '30' DAY AS expires_at",
    )
    return sinks.run_appends(feeds.expiry_stream(feed, ORDERS_NOW), "expiry")
