"""Ownership, revisions, licences, tokens and the lookups around them."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.functions.text import format_bytes

# The features each tier unlocks.
TIER_FEATURES = {
    "trial": ["edit", "comment", "fill_sign", "secure", "ocr", "export"],
    "standard": ["edit", "comment", "fill_sign", "secure", "export"],
    "premium": ["edit", "comment", "fill_sign", "secure", "esign", "ocr", "translate", "export"],
    "business": [
        "edit", "comment", "fill_sign", "secure", "esign", "ocr", "translate",
        "desktop", "cloud_sync", "sso", "audit", "export",
    ],
}

# How long a token of each context is valid.
TOKEN_MINUTES = {"login": 15, "reset_password": 60, "change": 7 * 24 * 60, "session": 14 * 24 * 60}


def at(moment: datetime.datetime) -> Column:
    """A fixed clock as a timestamp without zone, in UTC."""
    return F.lit(moment).cast("timestamp_ntz")


def owned_by(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, user_id, title, status) of access requests: ok, forbidden or not_found."""
    owners = documents.select("document_id", F.col("user_id").alias("owner_id"), "title")
    status = (
        F.when(F.col("owner_id").isNull(), "not_found")
        .when(F.col("owner_id") != F.col("user_id"), "forbidden")
        .otherwise("ok")
    )
    checked = requests.join(owners, "document_id", "left").withColumn("status", status)
    return checked.select(
        "document_id", "user_id", F.when(F.col("status") == "ok", F.col("title")).alias("title"), "status"
    )


def current_pointers(revisions: DataFrame) -> DataFrame:
    """(document_id, current_revision_id): the newest revision of each document."""
    newest = F.max_by("revision_id", F.struct("inserted_at", "revision_id"))
    return revisions.groupBy("document_id").agg(newest.alias("current_revision_id"))


def current_revision(documents: DataFrame, revisions: DataFrame) -> DataFrame:
    """Documents with their current revision; a missing or dangling pointer is not_found."""
    revs = revisions.select(
        F.col("revision_id").alias("current_revision_id"), F.col("inserted_at").alias("revised_at"), "byte_size"
    ).withColumn("_found", F.lit(True))
    joined = documents.join(revs, "current_revision_id", "left")
    return joined.withColumn("status", F.when(F.col("_found"), "ok").otherwise("not_found")).drop("_found")


def prunable_revisions(revisions: DataFrame, pointers: DataFrame, now: datetime.datetime, days: int = 30) -> DataFrame:
    """Revisions older than the retention that no document points to."""
    old = revisions.where(F.col("inserted_at") < at(now - datetime.timedelta(days=days)))
    current = pointers.select(F.col("current_revision_id").alias("revision_id"))
    return old.join(current, "revision_id", "left_anti")


def retention_report(pruned: DataFrame) -> DataFrame:
    """One row: pruned revisions, bytes given back, and those bytes in words."""
    totals = pruned.agg(
        F.count(F.lit(1)).alias("pruned"),
        F.coalesce(F.sum("byte_size"), F.lit(0).cast("bigint")).alias("reclaimed_bytes"),
    )
    return totals.withColumn("reclaimed", format_bytes(F.col("reclaimed_bytes")))


def autosave(revisions: DataFrame, documents: DataFrame, flushes: DataFrame, now: datetime.datetime) -> tuple[DataFrame, DataFrame]:
    """Append a revision per flush and move the documents' current pointers.

    `flushes` holds (revision_id, document_id, user_id, base_revision_id, label,
    byte_size); flushes of unknown or foreign documents are left out. Returns
    (revisions with flush_of, documents).
    """
    owners = documents.select("document_id", "user_id")
    valid = flushes.join(owners, ["document_id", "user_id"], "left_semi")
    moment = F.date_trunc("second", at(now)).cast("timestamp_ntz")
    added = valid.select(
        "revision_id", "document_id", moment.alias("inserted_at"), "byte_size", "label",
        F.col("base_revision_id").alias("flush_of"),
    )
    log = revisions.unionByName(added, allowMissingColumns=True)
    newest = added.groupBy("document_id").agg(F.max("revision_id").alias("_new"))
    moved = documents.join(newest, "document_id", "left").withColumns(
        {
            "current_revision_id": F.coalesce("_new", "current_revision_id"),
            "updated_at": F.when(F.col("_new").isNotNull(), moment).otherwise(F.col("updated_at")),
        }
    )
    return log, moved.drop("_new")


def latest_one(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, by an aggregate that combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_r.*")


def latest_license(users: DataFrame, licenses: DataFrame) -> DataFrame:
    """Users with the tier of their newest licence, trial without one."""
    newest = licenses.groupBy("user_id").agg(
        F.max_by("tier", F.struct("inserted_at", "license_id")).alias("tier")
    )
    return users.join(newest, "user_id", "left").withColumn("tier", F.coalesce("tier", F.lit("trial")))


def tier_allows(tier: Column, feature: Column) -> Column:
    """Does a tier unlock a feature? Tiers not in the table count as standard."""
    known = F.when(tier.isin(list(TIER_FEATURES)), tier).otherwise("standard")
    allowed = F.lit(False)
    for name, features in TIER_FEATURES.items():
        allowed = allowed | ((known == name) & feature.isin(features))
    return allowed


def feature_gate(requests: DataFrame, licenses: DataFrame, deny_null_user: bool = False) -> DataFrame:
    """Add tier and `allowed` to (user_id, feature) requests.

    A null user is treated as trial, or refused where jobs run (deny_null_user).
    """
    gated = latest_license(requests, licenses).withColumn("allowed", tier_allows(F.col("tier"), F.col("feature")))
    if deny_null_user:
        gated = gated.withColumn("allowed", F.col("allowed") & F.col("user_id").isNotNull())
    return gated


def valid_tokens(tokens: DataFrame, users: DataFrame, now: datetime.datetime) -> DataFrame:
    """Tokens still valid at `now`: young enough, and sent to the user's present address.

    Contexts are login, reset_password, session and change:<old address>; the
    address is not compared for session and change tokens.
    """
    context = F.split("context", ":")[0]
    age = F.lit(None).cast("int")
    for name, minutes in TOKEN_MINUTES.items():
        age = F.when(context == name, minutes).otherwise(age)
    fresh = F.col("inserted_at") > at(now) - F.make_dt_interval(F.lit(0), F.lit(0), age)
    mailed = ~context.isin("login", "reset_password") | (F.col("sent_to") == F.col("email"))
    return tokens.where(fresh).join(users, "user_id").where(mailed)


def case_folded_lookup(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requested addresses matched to users whatever the letter case."""
    keyed = users.withColumn("_key", F.lower("email"))
    asked = requests.select(F.col("address"), F.lower("address").alias("_key"))
    return asked.join(keyed, "_key", "left").drop("_key")


def saved_items(settings: DataFrame, column: str) -> DataFrame:
    """Saved items of each user, newest first: (user_id, position, name, created_at).

    `column` is a map from item id to struct<name, created_at>.
    """
    newest_first = F.sort_array(
        F.transform(F.map_values(column), lambda i: F.struct(i["created_at"].alias("created_at"), i["name"].alias("name"))),
        asc=False,
    )
    items = settings.select("user_id", F.posexplode(newest_first).alias("position", "i"))
    return items.select("user_id", "position", "i.name", "i.created_at")


RECENT_ORDERS = {
    "last_opened": lambda: [F.col("opened_at").desc()],
    "name": lambda: [F.lower("title").asc()],
    "size": lambda: [F.col("byte_size").desc()],
    "type": lambda: [F.col("source_format").asc(), F.lower("title").asc()],
    "date": lambda: [F.col("inserted_at").desc()],
}


def recent_documents(opened: DataFrame, documents: DataFrame, sort: str = "last_opened", limit: int = 20) -> DataFrame:
    """Each user's recent documents, one row per document, the first `limit` of a sort.

    Spark limits the ranking on the map side, so a busy user costs no full sort.
    """
    from pyspark.sql import Window

    latest = opened.groupBy("user_id", "document_id").agg(F.max("opened_at").alias("opened_at"))
    spec = Window.partitionBy("user_id").orderBy(*RECENT_ORDERS[sort](), F.col("document_id"))
    ranked = latest.join(documents, "document_id").withColumn("position", F.row_number().over(spec))
    return ranked.where(F.col("position") <= limit)
