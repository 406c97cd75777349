"""Usage, allowance, periods and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers


def latest(rows: DataFrame, key: str, by: list) -> DataFrame:
    """The latest row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*by))).filter("_n = 1").drop("_n")


def usage_summary(events: DataFrame) -> DataFrame:
    """Totals of (user_id, activity, cost) by user and activity."""
    return events.groupBy("user_id", "activity").agg(F.count("*").alias("calls"), F.sum("cost").cast("decimal(20,10)").alias("cost"))


def filtered_usage(events: DataFrame, activities: list[str]) -> DataFrame:
    """One row for each user: a column of each activity's count, and the whole cost."""
    counts = [F.count(F.when(F.col("activity") == a, 1)).alias(f"n_{a}") for a in activities]
    return events.groupBy("user_id").agg(*counts, F.coalesce(F.sum("cost"), F.lit(0)).cast("decimal(20,10)").alias("cost"))


def admission(used: DataFrame, held: DataFrame, budget: float, wanted: float) -> DataFrame:
    """Per user: used and held sums, share of the budget, whether use is at its end (at the budget or over) and whether a new hold fits (up to the budget)."""
    total = lambda t, name: t.groupBy("user_id").agg(F.sum("cost").alias(name))
    rows = total(used, "used").join(total(held, "held"), "user_id", "full")
    used_, held_ = (F.coalesce(F.col(c), F.lit(0).cast("decimal(30,10)")) for c in ("used", "held"))
    limit = F.lit(budget).cast("decimal(20,10)")
    return rows.select("user_id", used_.cast("decimal(20,10)").alias("used"), held_.cast("decimal(20,10)").alias("held"), numbers.budget_percent(used_, limit).alias("percent"), (used_ >= limit).alias("blocked"), (used_ + held_ + F.lit(wanted).cast("decimal(20,10)") <= limit).alias("admitted"))


def period_usage(events: DataFrame, periods: DataFrame) -> DataFrame:
    """Cost of each user's events inside each of the user's half-open periods. Periods are dealt to the months that they touch, so an event meets only those of its month."""
    month = lambda c: F.year(c) * 12 + F.month(c)
    spread = periods.withColumn("month", F.explode(F.sequence(month("period_start"), month("period_end"))))
    inside = (F.col("ts") >= F.col("period_start")) & (F.col("ts") < F.col("period_end"))
    sums = spread.join(events.select("user_id", "cost", "ts", month("ts").alias("month")), ["user_id", "month"]).filter(inside).groupBy("user_id", "period_id").agg(F.sum("cost").alias("cost"))
    return periods.select("user_id", "period_id").distinct().join(sums, ["user_id", "period_id"], "left").select("user_id", "period_id", F.coalesce("cost", F.lit(0)).cast("decimal(20,10)").alias("cost"))


#: The state that a final event gives to what is held.
FINAL = {"completed": "settled", "missing": "uncertain", "rejected": "released", "error": "uncertain"}


def hold_state(events: Column, before: Column) -> Column:
    """The state after an ordered array of events, from the one before (null: none): held, then what the first final event gives; nothing changes that."""
    final = F.create_map(*(F.lit(x) for pair in FINAL.items() for x in pair))
    return F.aggregate(events, before, lambda s, x: F.when(s.isNull() & (x["event"] == "held"), "held").when(s == "held", F.coalesce(F.try_element_at(final, x["event"]), s)).otherwise(s))


def open_holds(events: DataFrame) -> DataFrame:
    """State of reservations from ordered events (reservation_id, seq, event): the first final event after "held" decides, repeats change nothing, uncertain holds stay open."""
    rows = events.groupBy("reservation_id").agg(F.sort_array(F.collect_list(F.struct("seq", "event"))).alias("e"))
    state = hold_state(F.col("e"), F.lit(None).cast("string"))
    return rows.select("reservation_id", state.alias("state")).filter("state IS NOT NULL").withColumn("open", F.col("state").isin("held", "uncertain"))


def purge(messages: DataFrame, conversations: DataFrame, before) -> tuple[DataFrame, DataFrame]:
    """What stays: messages from ``before`` on; conversations that are as young or still have a message."""
    kept = messages.filter(F.col("created_at") >= F.lit(before))
    return kept, conversations.join(kept.select("conversation_id").distinct().withColumn("has", F.lit(True)), "conversation_id", "left").filter((F.col("created_at") >= F.lit(before)) | F.col("has")).drop("has")


#: Subscription states that leave room for a single pass.
PASS_STATES = ["none", "canceled", "incomplete_expired"]


def billing_status(accounts: DataFrame, passes: DataFrame, periods: DataFrame, now) -> DataFrame:
    """What a user has: the latest paid pass if there is no live subscription, else the subscription with its latest period; and whether a payment is under review."""
    last = lambda on: F.max(F.when(on, F.struct("period_start", "period_end")))["period_end"]
    p = passes.groupBy("user_id").agg(last(F.col("status") == "paid").alias("paid_end"), F.some(F.col("status") == "review").alias("review"))
    s = periods.groupBy("user_id", "subscription_id").agg(last(F.lit(True)).alias("paid_to"))
    rows = accounts.join(p, "user_id", "left").join(s, ["user_id", "subscription_id"], "left")
    free = F.col("subscription_id").isNull() | F.col("subscription_status").isin(PASS_STATES)
    rows = rows.withColumn("pass_end", F.when(free, F.col("paid_end")))
    has = F.col("pass_end").isNotNull()
    return rows.select(
        "user_id", F.when(has, F.when(F.col("pass_end") > F.lit(now), "pass_active").otherwise("pass_expired")).otherwise(F.col("subscription_status")).alias("status"), F.when(has, "fpx").otherwise("subscription").alias("access_type"),
        (~has & F.col("cancel_at_period_end")).alias("cancels"), F.coalesce("pass_end", "paid_to").alias("period_end"), F.coalesce("review", F.lit(False)).alias("payment_review"),
    )
