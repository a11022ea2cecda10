"""Scheduled sweeps as set operations: same input and clock, same result."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.operators.access import at

OPEN_STATES = ["sent", "partially_signed"]


def expire_envelopes(envelopes: DataFrame, now: datetime.datetime) -> tuple[DataFrame, DataFrame]:
    """(envelopes with overdue ones expired, audit rows of those just expired)."""
    overdue = F.col("status").isin(OPEN_STATES) & (F.col("expires_at") < at(now))
    updated = envelopes.withColumn("status", F.when(overdue, "expired").otherwise(F.col("status")))
    events = envelopes.where(overdue).select(
        "envelope_id", F.lit("expired").alias("event"), at(now).alias("occurred_at")
    )
    return updated, events


def reminders(
    envelopes: DataFrame, signers: DataFrame, now: datetime.datetime, window_days: int = 7, pause_hours: int = 24
) -> DataFrame:
    """Signers to remind: the envelope expires soon and was not reminded lately,
    the signer is pending or viewed and holds a token."""
    soon = at(now + datetime.timedelta(days=window_days))
    lately = at(now - datetime.timedelta(hours=pause_hours))
    due = envelopes.where(
        F.col("status").isin(OPEN_STATES)
        & (F.col("expires_at") > at(now))
        & (F.col("expires_at") < soon)
        & (F.col("last_reminded_at").isNull() | (F.col("last_reminded_at") < lately))
    )
    waiting = signers.where(F.col("status").isin("pending", "viewed") & F.col("has_token"))
    return due.select("envelope_id", "expires_at").join(
        waiting.select("envelope_id", "signer_order"), "envelope_id"
    )


def mark_reminded(envelopes: DataFrame, sent: DataFrame, now: datetime.datetime) -> DataFrame:
    """Envelopes with last_reminded_at moved where at least one reminder went out."""
    touched = sent.select("envelope_id").distinct().withColumn("_sent", F.lit(True))
    return (
        envelopes.join(touched, "envelope_id", "left")
        .withColumn("last_reminded_at", F.when(F.col("_sent"), at(now)).otherwise(F.col("last_reminded_at")))
        .drop("_sent")
    )


def expire_trials(licenses: DataFrame, now: datetime.datetime) -> DataFrame:
    """Trials past their date become standard."""
    over = (F.col("tier") == "trial") & (F.col("expires_at") < at(now))
    return licenses.withColumn("tier", F.when(over, "standard").otherwise(F.col("tier")))


def expiring_soon(users: DataFrame, licenses: DataFrame, now: datetime.datetime, days: int = 7) -> DataFrame:
    """Users with any licence that ends within the coming days."""
    ending = licenses.where(
        (F.col("expires_at") > at(now)) & (F.col("expires_at") < at(now + datetime.timedelta(days=days)))
    )
    return users.join(ending, "user_id", "left_semi")


def activate_licenses(requests: DataFrame, licenses: DataFrame, now: datetime.datetime) -> tuple[DataFrame, DataFrame]:
    """(outcome of every (user_id, activation_key) request, licences after them).

    A user's first licence takes the key's tier, seats and expiry; an existing
    one changes tier and key but keeps its own expiry and seats. `licenses`
    holds one row per user; of several requests the largest key wins.
    """
    keys = licenses.where(F.col("activation_key").isNotNull()).groupBy("activation_key").agg(
        F.min_by(F.struct("tier", "seats", "expires_at"), "license_id").alias("found")
    )
    asked = requests.withColumn("activation_key", F.trim("activation_key"))
    outcome = (
        F.when(F.coalesce(F.col("activation_key"), F.lit("")) == "", "missing key")
        .when(F.col("found").isNull(), "invalid key")
        .when(F.col("found.expires_at") < at(now), "expired key")
        .otherwise("activated")
    )
    judged = asked.join(keys, "activation_key", "left").withColumn("outcome", outcome)
    wins = judged.where("outcome = 'activated'").groupBy("user_id").agg(
        F.max_by(F.struct("activation_key", "found"), "activation_key").alias("_w")
    )
    joined = licenses.join(wins, "user_id", "full")
    new = F.col("_w").isNotNull()
    fresh = F.col("license_id").isNull()
    after = joined.select(
        "license_id",
        "user_id",
        F.when(new, F.col("_w.found.tier")).otherwise(F.col("tier")).alias("tier"),
        F.when(fresh, F.col("_w.found.seats")).otherwise(F.col("seats")).alias("seats"),
        F.when(new, at(now)).otherwise(F.col("activated_at")).alias("activated_at"),
        F.when(fresh, F.col("_w.found.expires_at")).otherwise(F.col("expires_at")).alias("expires_at"),
        F.when(new, F.col("_w.activation_key")).otherwise(F.col("activation_key")).alias("activation_key"),
    )
    return judged.select("user_id", "activation_key", "outcome"), after


def needs_ocr(pages: DataFrame, mode: str = "skip") -> DataFrame:
    """Pages to recognise: in skip mode those without text, otherwise all."""
    if mode == "skip":
        pages = pages.where(~F.coalesce(F.col("has_text"), F.lit(False)))
    return pages.select("revision_id", "page_index")


def stale_operations(operations: DataFrame, now: datetime.datetime) -> DataFrame:
    """Operations with a `sweep` column: stuck (running over 30 minutes), purge
    (finished over 7 days ago), or null."""
    stuck = (F.col("status") == "running") & (F.col("started_at") < at(now - datetime.timedelta(minutes=30)))
    old = F.col("finished_at") < at(now - datetime.timedelta(days=7))
    return operations.withColumn("sweep", F.when(stuck, "stuck").when(old, "purge"))
