"""Plans, admission of uploads and pages, and bounds of costs before a call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import next_month

# Most bytes of an upload; by plan: documents, bytes, pages a month, budget in dollars; tokens beyond which a context is long, and what it costs then.
MOST_UPLOAD = 15 * 1024 * 1024
PLANS = {"pro": (250, 2 * 1024**3, 5000, "20"), "trial": (25, 50 * 1024**2, 500, "2")}
FRAMING_TOKENS, HOUR = 1024, 3600


def with_plan(accounts: DataFrame, code: str) -> DataFrame:
    """Accounts with plan, max_documents, max_bytes, max_pages, budget: those of pro, else of trial."""
    of = lambda i, kind: F.when(F.col(code) == "pro", F.lit(PLANS["pro"][i]).cast(kind)).otherwise(F.lit(PLANS["trial"][i]).cast(kind))
    return accounts.withColumns({"plan": F.when(F.col(code) == "pro", "pro").otherwise("trial"), "max_documents": of(0, "long"), "max_bytes": of(1, "long"), "max_pages": of(2, "long"), "budget": of(3, "decimal(20,10)")})


def upload_decision(filename: Column, size: Column, head: Column, documents: Column, held: Column, max_documents: Column, max_bytes: Column) -> Column:
    """The first reason to refuse an upload, or accepted: its name, its size, its first bytes, then the plan: as many documents as allowed, or more bytes with it."""
    return (
        F.when(~F.endswith(F.lower(F.coalesce(filename, F.lit(""))), F.lit(".pdf")), "unsupported_name")
        .when((F.coalesce(size, F.lit(0)) == 0) | (size > MOST_UPLOAD), "size")
        .when(~F.startswith(F.coalesce(head, F.lit("")), F.lit("%PDF-")), "not_a_pdf")
        .when(documents >= max_documents, "document_limit")
        .when(held + size > max_bytes, "storage_limit")
        .otherwise("accepted")
    )


def pages_allowed(used: Column, pages: Column, most: Column) -> Column:
    return used + pages <= most


def ceiling(cost: Column) -> Column:
    """Ten decimals, rounded up, as a reservation must hold at least the cost."""
    return F.ceil(cost, F.lit(10)).cast("decimal(20,10)")


def request_tokens(request: Column) -> Column:
    """A bound of a text request's input tokens: its JSON's bytes and the framing."""
    return F.octet_length(request).cast("long") + FRAMING_TOKENS


def hour_window(ts: Column) -> Column:
    """The hour that an idempotency key names; a time without a zone counts as UTC, whatever the session's zone."""
    return F.floor(F.unix_timestamp(ts) / HOUR)


def expanded_id(raw: Column) -> Column:
    """The id of a reference that is a JSON object with an id, or the id itself."""
    return F.when(F.startswith(F.trim(raw), F.lit("{")), F.get_json_object(raw, "$.id")).otherwise(raw)


def conflicting(passes: DataFrame, now: Column) -> DataFrame:
    """Passes (user_id, pass_id, status, period_start, period_end) that are pending, with the status that they get: review if their user has another paid one that lasts, else paid."""
    lasting = passes.filter((F.col("status") == "paid") & (F.col("period_end") > now)).select("user_id").distinct().withColumn("lasting", F.lit(True))
    return passes.filter("status = 'pending'").join(lasting, "user_id", "left").select("user_id", "pass_id", F.when(F.col("lasting"), "review").otherwise("paid").alias("status"))


def settled_passes(orders: DataFrame, payments: DataFrame, subscriptions: DataFrame, now: Column) -> DataFrame:
    """session_id, status, period_start, period_end of pending passes whose payment is verified.

    Orders are (session_id, user_id, status, period_end), payments (session_id, event_id, place, verified, charged_at), subscriptions (user_id, status). The first verified event of a
    session decides, later ones change nothing; sessions that aren't pending stay. A pass goes to review, without a period, if its user has a paid one that lasts,
    a subscription that isn't over, or gets one that lasts before it; else it is paid for a calendar month from the charge.
    """
    first = payments.filter("verified").groupBy("session_id").agg(F.min(F.struct("place", "event_id", "charged_at")).alias("e")).select("session_id", "e.place", F.col("e.charged_at").alias("start"))
    lasting = orders.filter((F.col("status") == "paid") & (F.col("period_end") > now)).select("user_id")
    alive = subscriptions.filter(~F.coalesce(F.col("status").isin("canceled", "incomplete_expired"), F.lit(False))).select("user_id")
    held = lasting.unionByName(alive).distinct().withColumn("held", F.lit(True))
    due = orders.filter("status = 'pending'").select("session_id", "user_id").join(first, "session_id").join(held, "user_id", "left").withColumn("end", next_month(F.col("start")))
    before = F.max(F.col("end") > now).over(Window.partitionBy("user_id").orderBy("place", "session_id").rowsBetween(Window.unboundedPreceding, -1))
    due = due.withColumn("review", F.coalesce("held", F.lit(False)) | F.coalesce(before, F.lit(False)))
    return due.select("session_id", F.when(F.col("review"), "review").otherwise("paid").alias("status"), F.when(~F.col("review"), F.col("start")).alias("period_start"), F.when(~F.col("review"), F.col("end")).alias("period_end"))
