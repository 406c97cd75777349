"""Secret scans over trigram postings, in DataFrame functions only.

From each rule's regular expression follows a Boolean query of trigrams that every match must hold (in lower case): a disjunction
of conjunctions. The index is over the trigrams of these queries (``vocabulary``): each text's postings are the bits of the
vocabulary's trigrams that it holds, kept beside the row, so intersecting postings is an operation on bits, and no text and no posting
is shuffled. ``postings`` gives the same index inverted, a row for each trigram and document, for those who want to store it.
Candidates, whose postings complete a conjunction of a rule, are verified with the expression over their whole text. Rules without
a mandatory trigram scan all texts.

Spans are kind:start:end in code points, end exclusive, leftmost and non-overlapping inside a kind; matches that fail a rule's
least length are dropped after matching. A text of n matches is told in steps of n ** 1.5 at most. Null texts are empty and have no
spans. Rows repeated, or of null doc_id: each gives a row. Other columns are ignored. Empty table: no rows. Very long texts are
scanned whole.
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from re import _constants as K
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind: expression, group that has a least length, least length, whether the kind is one of the base kinds.
RULES = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20, True),
    "hex": (r"[0-9a-f]{24,}", 0, 24, True),
    "pem": (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1, False),
    "forge": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, False),
}
#: More strings than this are no longer enumerated exactly.
MOST_STRINGS = 64


def trigram_query(expression: str) -> list[frozenset[str]] | None:
    """Conjunctions of lower-case trigrams, one of which is in every match; None if nothing is mandatory."""
    clauses: list[list[frozenset[str]]] = []

    def flush(strings: set[str]) -> None:
        grams = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]
        if all(grams):
            clauses.append(list(dict.fromkeys(grams)))

    def exact(tree) -> set[str] | None:
        """All strings of a part, if they are few."""
        out = {""}
        for op, value in tree:
            if op is K.LITERAL:
                one = {chr(value).lower()}
            elif op is K.IN and all(k is K.LITERAL for k, _ in value):
                one = {chr(c).lower() for _, c in value}
            elif op is K.SUBPATTERN:
                one = exact(value[3])
            elif op is K.BRANCH:
                parts = [exact(x) for x in value[1]]
                one = None if any(x is None for x in parts) else set().union(*parts)
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and value[1] is not K.MAXREPEAT and value[1] <= 3:
                inner = exact(value[2])
                one = None if inner is None else {"".join(x) for n in range(value[0], value[1] + 1) for x in product(inner, repeat=n)}
            else:
                one = None
            if one is None or len(out) * len(one) > MOST_STRINGS:
                return None
            out = {a + b for a in out for b in one}
        return out

    held = {""}
    for item in parser.parse(expression):
        one = exact([item])
        if one is not None and len(held) * len(one) <= MOST_STRINGS:
            held = {a + b for a in held for b in one}
        else:
            flush(held)
            held = one or {""}
    flush(held)
    if not clauses:
        return None
    out = [frozenset()]
    for clause in clauses:  # to a disjunction of conjunctions; a clause that would make it too long is left out, which only widens it
        if len(out) * len(clause) <= MOST_STRINGS:
            out = [a | b for a in out for b in clause]
    return [x for x in out if not any(y < x for y in out)]


def vocabulary(rules: dict) -> list[str]:
    return sorted({g for x in rules.values() for c in trigram_query(x[0]) or [] for g in c})


def masks(text: Column, rules: dict = RULES) -> list[Column]:
    """The text's postings: bits of the vocabulary's trigrams in it, 63 in each number."""
    low, words = F.lower(text), vocabulary(rules)
    bits = [F.when(F.contains(low, F.lit(g)), F.lit(1 << (i % 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i, g in enumerate(words)]
    return [reduce(Column.bitwiseOR, bits[i : i + 63]) for i in range(0, len(words), 63)]


def postings(docs: DataFrame, rules: dict = RULES) -> DataFrame:
    """The inverted index: (trigram, doc_id), trigram as its place in ``vocabulary``."""
    held = docs.select("doc_id", *(m.alias(f"m{k}") for k, m in enumerate(masks(F.coalesce(F.col("text").cast("string"), F.lit("")), rules))))
    there = F.array_compact(F.array(*[F.when(F.col(f"m{i // 63}").bitwiseAND(F.lit(1 << (i % 63))) != 0, F.lit(i)) for i in range(len(vocabulary(rules)))]))
    return held.select("doc_id", F.explode(there).alias("trigram"))


def candidate(held: list[Column], kind: str, rules: dict = RULES) -> Column | None:
    """Whether postings complete a conjunction of the rule; None if it has no query."""
    if not (query := trigram_query(rules[kind][0])):
        return None
    words, full = vocabulary(rules), []
    for conjunction in query:
        need = [sum(1 << (words.index(g) % 63) for g in conjunction if words.index(g) // 63 == k) for k in range(len(held))]
        full.append(reduce(Column.__and__, [held[k].bitwiseAND(F.lit(n)) == n for k, n in enumerate(need) if n]))
    return reduce(Column.__or__, full)


SPAN = "array<struct<start:int,place:int,end:int,kind:string>>"


def spans(text: Column, found: Column, kind: str, rules: dict = RULES) -> Column:
    """start, place, end, kind of a rule's matches (``found``) in a text, in order. Places are summed up in runs of about the root of
    their number, since an array that grows by one is copied each time."""
    expression, group, least, _ = rules[kind]
    order = list(rules).index(kind)
    parts = F.zip_with(
        F.transform(found, lambda m: F.struct(F.char_length(m).alias("m"), F.char_length(F.regexp_extract(m, expression, group) if group else m).alias("g"))),
        F.transform(F.slice(F.split(text, expression, -1), F.lit(1), F.size(found)), F.char_length),
        lambda x, gap: F.struct(x["m"].alias("m"), x["g"].alias("g"), gap.alias("gap")),
    )

    def runs(x: Column) -> Column:
        each = F.ceil(F.sqrt(F.size(x))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / each).cast("int")), lambda i: F.slice(x, i * each + 1, each))

    def step(a, x):
        start = a["at"] + x["gap"]
        one = F.struct(start.alias("start"), F.lit(order).alias("place"), (start + x["m"]).alias("end"), F.lit(kind).alias("kind"))
        return F.struct((start + x["m"]).alias("at"), F.when(x["g"] >= least, F.array_append(a["out"], one)).otherwise(a["out"]).alias("out"))

    def told(x: Column) -> Column:
        lengths = F.transform(x, lambda run: F.aggregate(run, F.lit(0), lambda n, y: n + y["gap"] + y["m"]))
        before = F.aggregate(lengths, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
        begin = lambda at: F.struct(at.alias("at"), F.from_json(F.lit("[]"), SPAN).alias("out"))
        return F.flatten(F.zip_with(x, F.slice(before, F.lit(1), F.size(x)), lambda run, at: F.aggregate(run, begin(at), step, lambda a: a["out"])))

    # a run of one element, so that its expression is evaluated once
    made = F.element_at(F.transform(F.array(F.struct(parts.alias("x"))), lambda p: told(runs(p["x"]))), 1)
    return F.when(F.size(found) > 0, made).otherwise(F.from_json(F.lit("[]"), SPAN))


def scan(docs: DataFrame, rules: dict = RULES) -> DataFrame:
    """doc_id and found: the spans (start, place, end, kind) of all kinds in order of start, then of the rules."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *(m.alias(f"m{k}") for k, m in enumerate(masks(F.col("text"), rules))))
    held = [F.col(c) for c in rows.columns[2:]]
    none = F.from_json(F.lit("[]"), "array<string>")
    found = {}
    for kind, (expression, *_) in rules.items():
        all_ = F.regexp_extract_all("text", F.lit(expression), F.lit(0))
        may = candidate(held, kind, rules)
        found[f"f_{kind}"] = all_ if may is None else F.when(may, all_).otherwise(none)
    # each kind's matches are a column of their own, so that its expression runs once
    rows = rows.select("doc_id", "text", *(x.alias(c) for c, x in found.items()))
    return rows.select("doc_id", F.sort_array(F.concat(*(spans(F.col("text"), F.col(f"f_{kind}"), kind, rules) for kind in rules))).alias("found"))


def digest(found: DataFrame, rules: dict = RULES) -> DataFrame:
    """Counts, digest and text of the spans of ``scan``."""
    base = [k for k, x in rules.items() if x[3]]
    told = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: F.filter("found", lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(told(F.filter("found", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), told(F.col("found")).alias("spans"))
