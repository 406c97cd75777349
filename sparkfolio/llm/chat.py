"""Chat formatting, in DataFrame functions only.

A declarative template names for each role the marks around its text, whether the text is under the loss, and the roles that may
follow; a finite-state machine walks the roles of a conversation in turn order. Every turn becomes segments (mark, text, mark)
with a loss flag each. Control strings inside texts get an escape character after their first character, and the escape
character itself is doubled, so that every mark in the output is a real one and texts can be read back.

Nulls: a null text or role is empty; rows with null conv_id form one conversation; null turns come first. Turns that tie are
ordered by role, then text, and repeated rows are turns of their own. Conversations that break the order are formatted too, with
valid = false and the place of the first wrong turn. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"
#: role: opening mark, closing mark, under the loss, roles that may follow; "" is the start, "*" any other role.
TEMPLATE = {
    "system": ("[SYS]", "[/SYS]", False, ["user"]),
    "user": ("[INST]", "[/INST]", False, ["assistant"]),
    "assistant": ("<s>", "</s>", True, ["user"]),
    "*": ("[ROLE]", "[/ROLE]", False, ["user"]),
    "": (None, None, None, ["system", "user"]),
}
#: Stands between the name and the text of a role that the template doesn't name.
NAMED = "[/NAME]"


def _turns(template: dict) -> dict:
    return {r: x for r, x in template.items() if r}


def marks(template: dict) -> list[str]:
    return sorted({m for x in _turns(template).values() for m in x[:2]} | {NAMED}, key=lambda m: (-len(m), m))


def escape(text: Column, template: dict = TEMPLATE) -> Column:
    """Marks must begin with a character that they don't hold elsewhere, and hold no escape character."""
    tails = "|".join(f"{re.escape(m[0])}(?={re.escape(m[1:])})" for m in marks(template))
    return F.regexp_replace(text, rf"\\|{tails}", r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _by_role(role: Column, template: dict, value) -> Column:
    named = {r: x for r, x in _turns(template).items() if r != "*"}
    out = F.lit(value(template["*"]))
    for r, x in named.items():
        out = F.when(role == r, F.lit(value(x))).otherwise(out)
    return out


def segments(role: Column, text: Column, template: dict = TEMPLATE) -> Column:
    """(text, loss, kind) of a turn's segments."""
    named = role.isin([r for r in _turns(template) if r != "*"])
    part = lambda t, loss, kind: F.struct(t.alias("text"), loss.alias("loss"), F.lit(kind).alias("kind"))
    name = F.when(named, F.lit("")).otherwise(F.concat(escape(role, template), F.lit(NAMED)))
    return F.array(
        part(F.concat(_by_role(role, template, lambda x: x[0]), name), F.lit(False), "mark"),
        part(escape(text, template), _by_role(role, template, lambda x: x[2]), "text"),
        part(_by_role(role, template, lambda x: x[1]), F.lit(False), "mark"),
    )


def first_wrong(roles: Column, template: dict = TEMPLATE) -> Column:
    """The machine's run: place (from 0) of the first turn whose role may not follow the one before; -1 if there is none."""
    step = None
    for role, (_, _, _, after) in template.items():
        state = F.lit(role)
        allowed = lambda s, r, state=state, after=after: (s == state) & r.isin(after)
        step = allowed if step is None else (lambda s, r, f=step, g=allowed: f(s, r) | g(s, r))
    names = [r for r in _turns(template) if r != "*"]
    state = lambda r: F.when(r.isin(names), r).otherwise(F.lit("*"))
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("wrong"))
    move = lambda a, r: F.struct(
        state(r).alias("state"), (a["at"] + 1).alias("at"), F.when((a["wrong"] < 0) & ~step(a["state"], r), a["at"]).otherwise(a["wrong"]).alias("wrong")
    )
    return F.aggregate(roles, start, move, lambda a: a["wrong"])


def format_chats(turns: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """conv_id, segments (text, loss, kind), formatted, wrong (place of the first wrong turn or -1), valid."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("row"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    chats = chats.select("conv_id", first_wrong(F.col("rows.role"), template).alias("wrong"), F.flatten(F.transform("rows", lambda r: segments(r["role"], r["text"], template))).alias("segments"))
    return chats.select("conv_id", "segments", F.array_join("segments.text", "").alias("formatted"), "wrong", (F.col("wrong") < 0).alias("valid"))


def read_back(formatted: Column, template: dict = TEMPLATE) -> Column:
    """(role, text, loss) of every turn in a formatted conversation, from the marks alone."""
    turn = "|".join(f"{re.escape(x[0])}(?:.*?){re.escape(x[1])}" for x in _turns(template).values())
    found = F.regexp_extract_all(formatted, F.lit(f"(?s)(?:{turn})"), F.lit(0))

    def parse(x: Column) -> Column:
        out = None
        for role, (opening, closing, loss, _) in _turns(template).items():
            inner = F.substring(x, F.lit(len(opening) + 1), F.char_length(x) - len(opening) - len(closing))
            if role == "*":
                at = F.locate(NAMED, inner) if isinstance(inner, str) else F.instr(inner, NAMED)
                name, body = F.substring(inner, F.lit(1), at - 1), F.substring(inner, at + len(NAMED), F.char_length(inner))
            else:
                name, body = F.lit(role), inner
            made = F.struct(unescape(name).alias("role"), unescape(body).alias("text"), F.lit(loss).alias("loss"))
            out = F.when(F.startswith(x, F.lit(opening)), made) if out is None else out.when(F.startswith(x, F.lit(opening)), made)
        return out

    return F.transform(found, parse)


def digest_chats(formatted: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """Digest columns of ``format_chats``' output, read back from it."""
    turns = formatted.withColumn("turns", read_back(F.col("formatted"), template))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.withColumn("lossy", F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.char_length("lossy").cast("long").alias("loss_chars"), F.sha2("lossy", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "valid", "wrong",
    )
