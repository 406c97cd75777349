"""Text keys and matches as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a question.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "does", "for", "from", "how", "in", "is", "it", "of", "on", "or", "the", "to", "what", "when", "where", "which", "who", "with", "pdf"]


def normalize_text(x: Column) -> Column:
    """Runs of a-z and 0-9 in lower case, one space between; null gives the empty text."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def meaningful_words(x: Column) -> Column:
    """Distinct words of the normalised text without stop words and the empty word."""
    return F.array_except(F.array_distinct(F.split(normalize_text(x), " ")), F.array(*map(F.lit, [*STOP_WORDS, ""])))


def overlap(of: Column, within: Column) -> Column:
    """Share of an array's distinct values that another one holds; 0 for an empty array."""
    return F.when(F.size(of) > 0, F.size(F.array_intersect(of, within)) / F.size(F.array_distinct(of))).otherwise(F.lit(0.0))


def name_match(question: Column, name: Column) -> Column:
    """1 if the question holds the name, else the share of the name's words in it; 0 for a blank name. Both unnormalised."""
    q, n = normalize_text(question), normalize_text(name)
    return F.when(n == "", 0.0).when(F.contains(q, n), 1.0).otherwise(overlap(meaningful_words(name), meaningful_words(question)))


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def compact(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"(?U)\s+", "")


# Kinds that an address may begin with.
ADDRESS_KINDS = "PART|SECTION|CHAPTER|ARTICLE"


def base_key(x: Column) -> Column:
    """An address without its leading kind (nothing stands before that), letters and digits only."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), rf"(?i)^({ADDRESS_KINDS})\s+", "")), "[^a-z0-9]", "")


def child_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", "")), r"\.+$", "")


def identifier_key(x: Column) -> Column:
    """Letters and digits in lower case with single spaces, as whole phrases are compared."""
    return F.trim(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", " "))


def punctuated(x: Column) -> Column:
    """Whether the last character is neither letter nor digit."""
    return F.regexp_like(F.right(x, F.lit(1)), F.lit("[^A-Za-z0-9]"))


def same_number(x: Column) -> Column:
    """12. and 12 are one section number."""
    return F.regexp_replace(F.lower(x), r"^(\d+[a-z]?)\.$", "$1")


def names_phrase(question: Column, kind: Column, identifier: Column) -> Column:
    """Whether a question names "kind identifier": literally if the identifier ends in punctuation, else as whole normalised words."""
    phrase = F.concat_ws(" ", F.replace(kind, F.lit("_"), F.lit(" ")), identifier)
    whole = F.contains(F.concat(F.lit(" "), identifier_key(question), F.lit(" ")), F.concat(F.lit(" "), identifier_key(phrase), F.lit(" ")))
    return F.when(punctuated(identifier), F.contains(F.lower(question), F.lower(phrase))).otherwise(whole)


def search_text(kind: Column, identifier: Column, title: Column) -> Column:
    """What a node is found by; null if identifier and title are blank."""
    full = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.when(full(identifier).isNull() & full(title).isNull(), None).otherwise(F.concat_ws(" ", F.replace(kind, F.lit("_"), F.lit(" ")), full(identifier), full(title)))


def safe_name(x: Column, empty: str = "unknown") -> Column:
    """A name for files: each run of other characters as one _, no _ or . at the ends."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", ""), F.lit("")), F.lit(empty))


def storage_path(user: Column, document: Column, filename: Column) -> Column:
    """Where a document's file lies, by the last part of its name."""
    return F.concat_ws("/", F.lit("users"), user, F.lit("documents"), document, safe_name(F.substring_index(filename, "/", -1), "document.pdf"))


def bare_title(filename: Column) -> Column:
    """A file's name without its extension."""
    return F.regexp_replace(filename, r"(?<=.)\.[^.]*$", "")


def line_signature(x: Column) -> Column:
    """A running line's key: lower case, numbers as #."""
    return F.regexp_replace(F.lower(collapse(x)), r"\b\d+\b", "#")


def scope_text(title: Column, path: Column, body: Column) -> Column:
    label = lambda name, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(name), x))
    return F.concat_ws("\n", label("Document: ", title), label("Hierarchy: ", F.array_join(path, " > ")), body)


def tokens(x: Column) -> Column:
    """Words between white space: the tokenizer is pluggable, this is the stand-in that needs no file."""
    return F.filter(F.split(F.coalesce(x, F.lit("")), r"\s+"), lambda t: t != "")


# How sections and subsections open a line.
SECTION_OPENING, SUBSECTION_OPENING = r"(?m)^\s*(\d{1,3}[A-Z]{0,3})\.\s+\S", r"(?m)^\s*\((\d{1,2}[A-Z]?)\)\s+\S"


def section_numbers(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(SECTION_OPENING), F.lit(1))


def subsection_numbers(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(SUBSECTION_OPENING), F.lit(1))


def natural_key(identifier: Column) -> Column:
    """Sorts 2 before 10 and 67A after 67; others last."""
    plain = F.regexp_like(identifier, F.lit("^[0-9]+[A-Z]*$"))
    return F.struct(F.when(plain, F.regexp_extract(identifier, "^[0-9]+", 0).cast("long")).otherwise(F.lit(10**9)).alias("number"), F.when(plain, F.regexp_extract(identifier, "[A-Z]*$", 0)).otherwise(identifier).alias("suffix"))


def labelled_pages(x: Column) -> Column:
    """(label, text) of a text whose pages begin with a line [[PAGE_LABEL: n]]; what stands before the first one is dropped."""
    marker = r"(?m)^\[\[PAGE_LABEL:\s*(\d+)\]\][^\S\r\n]*\r?$"
    return F.zip_with(F.regexp_extract_all(x, F.lit(marker), F.lit(1)), F.slice(F.split(x, marker, -1), F.lit(2), F.size(F.regexp_extract_all(x, F.lit(marker), F.lit(1)))), lambda n, t: F.struct(n.cast("int").alias("label"), t.alias("text")))


def provision_text(body: Column, title: Column, path: Column, kind: Column) -> Column:
    """A chunk's text without its search labels, if they equal those that its title and path give."""
    first = F.concat(F.lit("Document: "), title, F.lit("\n"))
    second = F.concat(F.lit("Hierarchy: "), F.array_join(path, " > "), F.lit("\n"))
    table = F.concat(F.lit("Document: "), title, F.lit(". "))
    rest = F.substring(body, F.char_length(first) + 1, F.char_length(body))
    full = F.coalesce(title, F.lit("")) != ""
    return (
        F.when(full & F.startswith(body, first), F.when((F.size(path) > 0) & F.startswith(rest, second), F.substring(rest, F.char_length(second) + 1, F.char_length(rest))).otherwise(rest))
        .when(full & (kind == "table") & F.startswith(body, table), F.substring(body, F.char_length(table) + 1, F.char_length(body)))
        .otherwise(body)
    )


def all_matches(page: Column, anchor: Column) -> Column:
    """Offsets (from 0) of all places, overlapping ones too, where a page in lower case holds an anchor."""
    low, word = F.lower(page), F.lower(anchor)
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.char_length(low) - F.char_length(word)))
    return F.when(F.coalesce(word, F.lit("")) == "", F.array().cast("array<int>")).when(~F.contains(low, word), F.array().cast("array<int>")).otherwise(F.filter(places, lambda i: F.substring(low, i + 1, F.char_length(word)) == word))


def first_match(page: Column, anchor: Column) -> Column:
    """Offset (from 1) of the first place where a page holds an anchor, any white space for each run of it; 0 if none."""
    literal = F.regexp_replace(collapse(anchor), r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    return F.when(collapse(anchor) == "", 0).otherwise(F.regexp_instr(page, F.concat(F.lit("(?i)"), F.regexp_replace(literal, " ", r"\\s+"))))


# The causes of a failed processing in order, each with alternatives of words that a message must hold together.
ERRORS = [
    ("encrypted", [["encrypt"], ["password"]]),
    ("page_limit", [["page limit"]]),
    ("spend_limit", [["organization_spend_limit_exceeded"], ["insufficient_quota"], ["spend limit"]]),
    ("scope_boundary", [["scope boundary"], ["node scopes"]]),
    ("page_mapping", [["page mapping resolved 0"], ["page hint"]]),
    ("table_link", [["table", "matched"], ["table extraction validation failed"], ["table profile validation failed"]]),
    ("damaged", [["invalid pdf"], ["invalid xref"], ["damaged"], ["corrupt"]]),
]


def error_kind(message: Column) -> Column:
    """The first cause whose words a message holds, else unexpected."""
    low = F.lower(F.coalesce(message, F.lit("")))
    out = F
    for kind, alternatives in ERRORS:
        holds = reduce(Column.__or__, [reduce(Column.__and__, [F.contains(low, F.lit(w)) for w in words]) for words in alternatives])
        out = out.when(holds, kind)
    return out.otherwise("unexpected")


def safe_url(url: Column) -> Column:
    """Whether a return address may be used: https, or http on this machine, without user, query and fragment."""
    part = lambda name: F.try_parse_url(url, F.lit(name))
    host = F.coalesce(part("HOST"), F.lit(""))
    near = (part("PROTOCOL") == "http") & host.isin("localhost", "127.0.0.1")
    return F.coalesce((host != "") & part("USERINFO").isNull() & ((part("PROTOCOL") == "https") | near) & (F.coalesce(part("QUERY"), F.lit("")) == "") & (F.coalesce(part("REF"), F.lit("")) == ""), F.lit(False))

