"""Vector, money and calendar expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# USD for a million tokens (input, cached input, output) by model family; a name matches itself and, with a date behind it, its family.
RATES = {
    "gpt-6.1-sol": ("2.0", "0.10", "10.0"),
    "gpt-5.6-sol": ("4.0", "0.4", "20.0"),
    "gpt-5.6-terra": ("2.0", "0.2", "12.0"),
    "gpt-5.4-mini": ("0.75", "0.075", "4.5"),
    "gpt-5-mini": ("0.25", "0.025", "2.0"),
    "gpt-5": ("1.25", "0.125", "10.0"),
    "text-embedding-3-small": ("0.02", "0.02", "0"),
}
DATED = {"gpt-5": "gpt-5-202"}
EXACT = {"text-embedding-3-small"}
LONG_CONTEXT, LONG_FAMILIES = 272_000, ("gpt-5.6-", "gpt-6.1-sol")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a vector is null or all zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def rate(model: Column, place: int) -> Column:
    """A model's rate; null if unknown."""
    out = F.lit(None).cast("decimal(10,4)")
    for name, rates in reversed(RATES.items()):
        hit = model == name
        if name not in EXACT:
            hit = hit | F.startswith(model, F.lit(DATED.get(name, name + "-")))
        out = F.when(hit, F.lit(Decimal(rates[place])).cast("decimal(10,4)")).otherwise(out)
    return out


def token_cost(model: Column, given: Column, cached: Column, made: Column) -> Column:
    """USD of a call: cached input is part of the input; long context costs twice for input and 1.5 times for output in two families; null, never 0, if anything is unknown."""
    long = (given > LONG_CONTEXT) & (F.startswith(model, F.lit(LONG_FAMILIES[0])) | F.startswith(model, F.lit(LONG_FAMILIES[1])))
    times = lambda x: F.when(long, F.lit(Decimal(x))).otherwise(F.lit(Decimal("1.0"))).cast("decimal(2,1)")
    whole = lambda x: x.cast("decimal(12,0)")
    made = F.when(model == "text-embedding-3-small", F.lit(0)).otherwise(made)
    total = (whole(given) - whole(cached)) * rate(model, 0) * times("2.0") + whole(cached) * rate(model, 1) * times("2.0") + whole(made) * rate(model, 2) * times("1.5")
    return (total.cast("decimal(28,8)") / F.lit(Decimal("1000000"))).cast("decimal(20,10)")


def budget_percent(used: Column, budget: Column) -> Column:
    """Used share of a budget in percent, at most 100; a budget of 0 is used up."""
    return F.when(budget <= 0, F.lit(100.0)).otherwise(F.least(F.lit(100.0), F.bround(used.cast("double") / budget.cast("double") * 100, 2)))


def next_month(x: Column) -> Column:
    """A calendar month later, clamped to the month's last day."""
    return x + F.expr("INTERVAL 1 MONTH")


def month_window(x: Column) -> tuple[Column, Column]:
    first = F.date_trunc("month", x)
    return first, next_month(first)


def hourly_key(*parts: Column, at: Column) -> Column:
    """An idempotency key that holds for an hour."""
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts), F.floor(F.unix_timestamp(at) / 3600).cast("string")), 256)
