"""Ownership, retention, licence and sweep queries."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks import fixtures as fx
from folioworks.operators import access, sweeps
from folioworks.plans.duck_views import with_views
from folioworks.plans.registry import query

ORDERS_NOW = datetime.datetime(1998, 1, 1)
LICENCE_NOW = datetime.datetime(2024, 1, 15)


@query(
    "owned_by",
    with_views(
        "docs",
        """SELECT e.event_id, e.value_id AS document_id, e.user_id, CASE WHEN d.user_id = e.user_id THEN title END AS title,
            CASE WHEN d.document_id IS NULL THEN 'not_found' WHEN d.user_id <> e.user_id THEN 'forbidden' ELSE 'ok' END AS status
        FROM (SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN user_id ELSE event_id * 7 % 2000 END AS BIGINT) AS value_id,
            user_id FROM events) e LEFT JOIN docs d ON d.document_id = e.value_id""".replace("SELECT e.event_id, ", "SELECT "),
    ),
)
def owned_by(spark, sf_dir):
    requests = fx.table(spark, sf_dir, "events").selectExpr(
        "CASE WHEN event_id % 3 = 0 THEN user_id ELSE event_id * 7 % 2000 END AS document_id", "user_id"
    )
    return access.owned_by(requests, fx.documents(spark, sf_dir))


def _documents_with_pointer(spark, sf_dir) -> DataFrame:
    pointers = access.current_pointers(fx.revisions(spark, sf_dir))
    return fx.documents(spark, sf_dir).join(pointers, "document_id", "left")


POINTERS = """pointers AS (SELECT document_id, arg_max(revision_id, {'t': inserted_at, 'r': revision_id}) AS current_revision_id
    FROM revisions GROUP BY 1)"""


@query(
    "current_revision",
    with_views(
        "docs revisions",
        f"""WITH {POINTERS} SELECT d.document_id, p.current_revision_id, r.inserted_at AS revised_at, r.byte_size,
            CASE WHEN r.revision_id IS NULL THEN 'not_found' ELSE 'ok' END AS status
        FROM docs d LEFT JOIN pointers p USING (document_id) LEFT JOIN revisions r ON r.revision_id = p.current_revision_id""",
    ),
)
def current_revision(spark, sf_dir):
    found = access.current_revision(_documents_with_pointer(spark, sf_dir), fx.revisions(spark, sf_dir))
    return found.select("document_id", "current_revision_id", "revised_at", "byte_size", "status")


def _prunable(spark, sf_dir) -> DataFrame:
    revisions = fx.revisions(spark, sf_dir)
    return access.prunable_revisions(revisions, access.current_pointers(revisions), ORDERS_NOW)


PRUNABLE = f"""{POINTERS}, prunable AS (SELECT r.* FROM revisions r LEFT JOIN pointers p ON p.current_revision_id = r.revision_id
    WHERE p.document_id IS NULL AND r.inserted_at < TIMESTAMP '1998-01-01' - INTERVAL 30 DAY)"""


@query("prunable_revisions", with_views("revisions", f"WITH {PRUNABLE} FROM prunable"))
def prunable_revisions(spark, sf_dir):
    return _prunable(spark, sf_dir)


@query(
    "retention_report",
    with_views(
        "revisions",
        f"""WITH {PRUNABLE}, t AS (SELECT count(*) AS pruned, CAST(sum(byte_size) AS BIGINT) AS b FROM prunable)
        SELECT pruned, b AS reclaimed_bytes, CASE WHEN b >= 1048576 THEN round(b / 1048576, 2) || ' MB'
            WHEN b >= 1024 THEN round(b / 1024, 1) || ' KB' ELSE b || ' B' END AS reclaimed FROM t""",
    ),
)
def retention_report(spark, sf_dir):
    return access.retention_report(_prunable(spark, sf_dir))


@query(
    "format_bytes",
    with_views(
        "revisions",
        """SELECT revision_id, CASE WHEN b >= 1048576 THEN round(b / 1048576, 2) || ' MB'
            WHEN b >= 1024 THEN round(b / 1024, 1) || ' KB' ELSE b || ' B' END AS size
        FROM (SELECT revision_id, byte_size * (revision_id % 40) AS b FROM revisions)""",
    ),
)
def format_bytes_query(spark, sf_dir):
    from folioworks.functions.text import format_bytes

    size = F.col("byte_size") * (F.col("revision_id") % 40)
    return fx.revisions(spark, sf_dir).select("revision_id", format_bytes(size).alias("size"))


def _flushes(spark, sf_dir) -> DataFrame:
    """One flush per document, every third by a user who does not own it."""
    return fx.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey + 90000000 AS revision_id", "c_custkey AS document_id",
        "(c_custkey + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END) % 1000 AS user_id",
        "c_custkey * 2 AS base_revision_id", "'autosave' AS label", "c_custkey * 10 AS byte_size",
    )


FLUSHED = """flushed AS (SELECT c_custkey + 90000000 AS revision_id, c_custkey AS document_id, c_custkey * 2 AS flush_of,
    c_custkey * 10 AS byte_size FROM customer WHERE c_custkey % 3 <> 0)"""


@query(
    "autosave_pointers",
    with_views(
        "docs revisions",
        f"""WITH {POINTERS}, {FLUSHED} SELECT document_id, coalesce(f.revision_id, current_revision_id) AS current_revision_id,
            CASE WHEN f.revision_id IS NOT NULL THEN TIMESTAMP '1998-01-01' END AS updated_at
        FROM docs LEFT JOIN pointers USING (document_id) LEFT JOIN flushed f USING (document_id)""",
    ),
)
def autosave_pointers(spark, sf_dir):
    documents = _documents_with_pointer(spark, sf_dir).withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    _, moved = access.autosave(fx.revisions(spark, sf_dir), documents, _flushes(spark, sf_dir), ORDERS_NOW)
    return moved.select("document_id", "current_revision_id", "updated_at")


@query(
    "autosave_revisions",
    with_views(
        "revisions",
        f"""WITH {FLUSHED} SELECT revision_id, document_id, inserted_at, byte_size, NULL AS label, NULL AS flush_of FROM revisions
        UNION ALL SELECT revision_id, document_id, TIMESTAMP '1998-01-01', byte_size, 'autosave', flush_of FROM flushed""",
    ),
)
def autosave_revisions(spark, sf_dir):
    documents = _documents_with_pointer(spark, sf_dir).withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    log, _ = access.autosave(fx.revisions(spark, sf_dir), documents, _flushes(spark, sf_dir), ORDERS_NOW)
    return log


# ── licences and tokens ─────────────────────────────────────────────────────


def _users(spark, sf_dir) -> DataFrame:
    return fx.table(spark, sf_dir, "customer").selectExpr("c_custkey + 200 AS user_id")


LATEST = """latest AS (SELECT user_id, arg_max(tier, {'t': inserted_at, 'i': license_id}) AS tier FROM licenses GROUP BY 1),
    tiers AS (SELECT c_custkey + 200 AS user_id, coalesce(tier, 'trial') AS tier
        FROM customer LEFT JOIN latest ON user_id = c_custkey + 200)"""


@query("latest_license", with_views("licenses", f"WITH {LATEST} FROM tiers"))
def latest_license(spark, sf_dir):
    return access.latest_license(_users(spark, sf_dir), fx.licenses(spark, sf_dir))


@query(
    "latest_one",
    with_views(
        "licenses",
        """SELECT license_id, user_id, tier, expires_at, inserted_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id
            ORDER BY inserted_at DESC, license_id DESC) AS r FROM licenses) WHERE r = 1""",
    ),
)
def latest_one(spark, sf_dir):
    return access.latest_one(fx.licenses(spark, sf_dir), ["user_id"], ["inserted_at", "license_id"])


@query(
    "feature_gate",
    with_views(
        "licenses",
        f"""WITH {LATEST}, asked AS (SELECT user_id, tier, ['edit', 'ocr', 'translate', 'audit'][user_id % 4 + 1] AS feature FROM tiers)
        SELECT user_id, tier, feature, CASE feature WHEN 'edit' THEN true WHEN 'ocr' THEN tier IN ('trial', 'premium', 'business')
            WHEN 'translate' THEN tier IN ('premium', 'business') ELSE tier = 'business' END AS allowed FROM asked""",
    ),
)
def feature_gate(spark, sf_dir):
    asked = _users(spark, sf_dir).selectExpr(
        "user_id", "element_at(array('edit', 'ocr', 'translate', 'audit'), CAST(user_id % 4 + 1 AS INT)) AS feature"
    )
    return access.feature_gate(asked, fx.licenses(spark, sf_dir))


def _accounts(spark, sf_dir) -> DataFrame:
    return fx.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS user_id", "concat('User', c_custkey, '@Example.com') AS email"
    )


@query(
    "valid_tokens",
    """WITH tokens AS (SELECT event_id AS token_id, user_id, CASE event_type WHEN 'click' THEN 'session' WHEN 'view' THEN 'login'
            WHEN 'signup' THEN 'reset_password' ELSE 'change:old@example.com' END AS context, ts AS inserted_at,
            'User' || (CASE WHEN event_id % 4 = 0 THEN 0 ELSE user_id END) || '@Example.com' AS sent_to FROM events),
        users AS (SELECT c_custkey AS user_id, 'User' || c_custkey || '@Example.com' AS email FROM customer)
        SELECT token_id, t.user_id, context FROM tokens t JOIN users USING (user_id)
        WHERE inserted_at > TIMESTAMP '2024-01-15' - CASE WHEN context = 'session' THEN INTERVAL 14 DAY
            WHEN context = 'login' THEN INTERVAL 15 MINUTE WHEN context = 'reset_password' THEN INTERVAL 60 MINUTE ELSE INTERVAL 7 DAY END
        AND (context NOT IN ('login', 'reset_password') OR sent_to = email)""",
)
def valid_tokens(spark, sf_dir):
    tokens = fx.table(spark, sf_dir, "events").selectExpr(
        "event_id AS token_id", "user_id",
        "CASE event_type WHEN 'click' THEN 'session' WHEN 'view' THEN 'login' WHEN 'signup' THEN 'reset_password' "
        "ELSE 'change:old@example.com' END AS context",
        "ts AS inserted_at",
        "concat('User', CASE WHEN event_id % 4 = 0 THEN 0 ELSE user_id END, '@Example.com') AS sent_to",
    )
    return access.valid_tokens(tokens, _accounts(spark, sf_dir), LICENCE_NOW).select("token_id", "user_id", "context")


@query(
    "case_folded_lookup",
    """SELECT 'USER' || o_orderkey || '@example.COM' AS address, c_custkey AS user_id, 'User' || c_custkey || '@Example.com' AS email
        FROM orders LEFT JOIN customer ON c_custkey = o_orderkey""",
)
def case_folded_lookup(spark, sf_dir):
    asked = fx.table(spark, sf_dir, "orders").selectExpr("concat('USER', o_orderkey, '@example.COM') AS address")
    return access.case_folded_lookup(asked, _accounts(spark, sf_dir))


@query(
    "saved_items",
    """WITH items AS (SELECT c_custkey AS user_id, i, 'item-' || i AS name, TIMESTAMP '2024-01-01' + c_custkey * i % 17 * INTERVAL 1 DAY AS created_at
            FROM customer, (SELECT unnest([1, 2, 3, 5]) AS i))
        SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, name DESC) - 1 AS INTEGER) AS position,
            name, created_at FROM items""",
)
def saved_items(spark, sf_dir):
    settings = fx.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS user_id",
        "map_from_entries(transform(array(1, 2, 3, 5), i -> struct(concat('id-', i), named_struct('name', concat('item-', i), "
        "'created_at', TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(CAST(c_custkey * i % 17 AS INT)))))) AS signatures",
    )
    return access.saved_items(settings, "signatures")


def _recents(spark, sf_dir, sort: str) -> DataFrame:
    opened = fx.table(spark, sf_dir, "orders").selectExpr(
        "o_custkey % 300 AS user_id", "o_orderkey % 700 AS document_id", "o_orderdate AS opened_at"
    )
    documents = fx.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS document_id", "c_name AS title", "CAST(c_acctbal * 100 AS BIGINT) AS byte_size",
        "lower(c_mktsegment) AS source_format", "TIMESTAMP_NTZ '2020-01-01 00:00:00' + make_dt_interval(CAST(c_custkey * 13 % 900 AS INT)) AS inserted_at",
    )
    return access.recent_documents(opened, documents, sort, 5).select("user_id", "document_id", "opened_at", "position")


def _recents_sql(order: str) -> str:
    return f"""WITH opened AS (SELECT o_custkey % 300 AS user_id, o_orderkey % 700 AS document_id, max(o_orderdate) AS opened_at
            FROM orders GROUP BY 1, 2),
        documents AS (SELECT c_custkey AS document_id, c_name AS title, CAST(trunc(c_acctbal * 100) AS BIGINT) AS byte_size,
            lower(c_mktsegment) AS source_format, TIMESTAMP '2020-01-01' + c_custkey * 13 % 900 * INTERVAL 1 DAY AS inserted_at FROM customer)
        SELECT user_id, document_id, opened_at, CAST(r AS INTEGER) AS position FROM (SELECT *, row_number() OVER (
            PARTITION BY user_id ORDER BY {order}, document_id) AS r FROM opened JOIN documents USING (document_id)) WHERE r <= 5"""


@query("recent_by_opened", _recents_sql("opened_at DESC"))
def recent_by_opened(spark, sf_dir):
    return _recents(spark, sf_dir, "last_opened")


@query("recent_by_type", _recents_sql("source_format, lower(title)"))
def recent_by_type(spark, sf_dir):
    return _recents(spark, sf_dir, "type")


@query("recent_by_size", _recents_sql("byte_size DESC"))
def recent_by_size(spark, sf_dir):
    return _recents(spark, sf_dir, "size")


# ── sweeps ──────────────────────────────────────────────────────────────────

OVERDUE = "status IN ('sent', 'partially_signed') AND expires_at < TIMESTAMP '1998-01-01'"


@query(
    "expire_envelopes",
    with_views("envelopes", f"SELECT envelope_id, CASE WHEN {OVERDUE} THEN 'expired' ELSE status END AS status FROM envelopes"),
)
def expire_envelopes(spark, sf_dir):
    updated, _ = sweeps.expire_envelopes(fx.envelopes(spark, sf_dir), ORDERS_NOW)
    return updated.select("envelope_id", "status")


@query(
    "expiry_audit_rows",
    with_views("envelopes", f"SELECT envelope_id, 'expired' AS event, TIMESTAMP '1998-01-01' AS occurred_at FROM envelopes WHERE {OVERDUE}"),
)
def expiry_audit_rows(spark, sf_dir):
    return sweeps.expire_envelopes(fx.envelopes(spark, sf_dir), ORDERS_NOW)[1]


REMIND = """due AS (SELECT * FROM envelopes WHERE status IN ('sent', 'partially_signed') AND expires_at > TIMESTAMP '1998-01-01'
        AND expires_at < TIMESTAMP '1998-01-08' AND (last_reminded_at IS NULL OR last_reminded_at < TIMESTAMP '1997-12-31')),
    sent AS (SELECT envelope_id, expires_at, signer_order FROM due JOIN (SELECT envelope_id, signer_order FROM signers
        WHERE status IN ('pending', 'viewed') AND has_token) USING (envelope_id))"""


@query("reminders", with_views("envelopes signers", f"WITH {REMIND} FROM sent"))
def reminders(spark, sf_dir):
    return sweeps.reminders(fx.envelopes(spark, sf_dir), fx.signers(spark, sf_dir), ORDERS_NOW)


@query(
    "mark_reminded",
    with_views(
        "envelopes signers",
        f"""WITH {REMIND} SELECT envelope_id, CASE WHEN envelope_id IN (SELECT envelope_id FROM sent)
            THEN TIMESTAMP '1998-01-01' ELSE last_reminded_at END AS last_reminded_at FROM envelopes""",
    ),
)
def mark_reminded(spark, sf_dir):
    envelopes = fx.envelopes(spark, sf_dir)
    sent = sweeps.reminders(envelopes, fx.signers(spark, sf_dir), ORDERS_NOW)
    return sweeps.mark_reminded(envelopes, sent, ORDERS_NOW).select("envelope_id", "last_reminded_at")


@query(
    "trial_expiry",
    with_views(
        "licenses",
        "SELECT license_id, CASE WHEN tier = 'trial' AND expires_at < TIMESTAMP '2024-01-15' THEN 'standard' ELSE tier END AS tier FROM licenses",
    ),
)
def trial_expiry(spark, sf_dir):
    return sweeps.expire_trials(fx.licenses(spark, sf_dir), LICENCE_NOW).select("license_id", "tier")


@query(
    "expiring_soon",
    with_views(
        "licenses",
        """SELECT c_custkey + 200 AS user_id FROM customer WHERE c_custkey + 200 IN (SELECT user_id FROM licenses
            WHERE expires_at > TIMESTAMP '2024-01-15' AND expires_at < TIMESTAMP '2024-01-22')""",
    ),
)
def expiring_soon(spark, sf_dir):
    return sweeps.expiring_soon(_users(spark, sf_dir), fx.licenses(spark, sf_dir), LICENCE_NOW)


def _key_licences(spark, sf_dir) -> DataFrame:
    """One licence per user; every fourth carries a key."""
    return fx.licenses(spark, sf_dir).selectExpr(
        "license_id", "license_id AS user_id", "tier", "CAST(license_id % 5 + 1 AS INT) AS seats",
        "CAST(NULL AS TIMESTAMP_NTZ) AS activated_at", "expires_at",
        "CASE WHEN license_id % 4 = 0 THEN concat('KEY-', license_id) END AS activation_key",
    )


def _activations(spark, sf_dir) -> DataFrame:
    return fx.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey * 2 AS user_id",
        "CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE concat(' KEY-', c_custkey) END AS activation_key",
    )


ACTIVATE = """held AS (SELECT license_id, license_id AS user_id, tier, CAST(license_id % 5 + 1 AS INTEGER) AS seats, expires_at,
        CASE WHEN license_id % 4 = 0 THEN 'KEY-' || license_id END AS activation_key FROM licenses),
    asked AS (SELECT c_custkey * 2 AS user_id, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'KEY-' || c_custkey END AS activation_key FROM customer),
    judged AS (SELECT a.user_id, a.activation_key, h.tier, h.seats, h.expires_at, CASE WHEN a.activation_key = '' THEN 'missing key'
        WHEN h.license_id IS NULL THEN 'invalid key' WHEN h.expires_at < TIMESTAMP '2024-01-15' THEN 'expired key'
        ELSE 'activated' END AS outcome FROM asked a LEFT JOIN held h ON h.activation_key = a.activation_key)"""


@query("activate_outcomes", with_views("licenses", f"WITH {ACTIVATE} SELECT user_id, activation_key, outcome FROM judged"))
def activate_outcomes(spark, sf_dir):
    return sweeps.activate_licenses(_activations(spark, sf_dir), _key_licences(spark, sf_dir), LICENCE_NOW)[0]


@query(
    "activate_licenses",
    with_views(
        "licenses",
        f"""WITH {ACTIVATE}, won AS (SELECT * FROM judged WHERE outcome = 'activated')
        SELECT h.license_id, coalesce(h.user_id, w.user_id) AS user_id, coalesce(w.tier, h.tier) AS tier,
            CASE WHEN h.license_id IS NULL THEN w.seats ELSE h.seats END AS seats,
            CASE WHEN w.user_id IS NOT NULL THEN TIMESTAMP '2024-01-15' END AS activated_at,
            CASE WHEN h.license_id IS NULL THEN w.expires_at ELSE h.expires_at END AS expires_at,
            coalesce(w.activation_key, h.activation_key) AS activation_key
        FROM held h FULL JOIN won w ON w.user_id = h.user_id""",
    ),
)
def activate_licenses(spark, sf_dir):
    return sweeps.activate_licenses(_activations(spark, sf_dir), _key_licences(spark, sf_dir), LICENCE_NOW)[1]


@query(
    "needs_ocr",
    with_views("document_pages", "SELECT revision_id, page_index FROM document_pages WHERE NOT (has_text AND page_index % 2 = 0)"),
)
def needs_ocr(spark, sf_dir):
    pages = fx.document_pages(spark, sf_dir).withColumn("has_text", F.expr("has_text AND page_index % 2 = 0"))
    return sweeps.needs_ocr(pages)


def operations(spark, sf_dir) -> DataFrame:
    """Operations with start, finish and status, one per order."""
    return fx.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS operation_id",
        "lower(substring(o_orderpriority, 3)) AS kind",
        "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'running' END AS status",
        "CASE WHEN o_orderstatus = 'P' THEN element_at(array('password_required', 'invalid_pdf', 'not_found', 'no_pages', 'boom'), "
        "CAST(o_orderkey % 5 + 1 AS INT)) END AS reason",
        "o_orderdate AS started_at",
        "CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + make_dt_interval(0, 0, CAST(o_orderkey % 50 AS INT), "
        "CAST(o_orderkey % 7 AS DECIMAL(18, 6))) END AS finished_at",
    )


OPERATIONS = """operations AS (SELECT o_orderkey AS operation_id, lower(substr(o_orderpriority, 3)) AS kind,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'running' END AS status,
    CASE WHEN o_orderstatus = 'P' THEN ['password_required', 'invalid_pdf', 'not_found', 'no_pages', 'boom'][o_orderkey % 5 + 1] END AS reason,
    o_orderdate AS started_at, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + o_orderkey % 50 * INTERVAL 1 MINUTE
        + o_orderkey % 7 * INTERVAL 1 SECOND END AS finished_at FROM orders)"""


@query(
    "stale_operations",
    f"""WITH {OPERATIONS} SELECT operation_id, CASE WHEN status = 'running' AND started_at < TIMESTAMP '1998-01-01' - INTERVAL 30 MINUTE
        THEN 'stuck' WHEN finished_at < TIMESTAMP '1997-12-25' THEN 'purge' END AS sweep FROM operations""",
)
def stale_operations(spark, sf_dir):
    return sweeps.stale_operations(operations(spark, sf_dir), ORDERS_NOW).select("operation_id", "sweep")
