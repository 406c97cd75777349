"""Hierarchies as a model returned them: what is wrong with them, how far they differ from others, and where their nodes begin in the text.

Nodes are (document_id, node_id, parent_id, sequence_no, node_type, identifier, title, start_page, opening_text) unless said otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import retrieval, trees

# Kinds of nodes; labels that own lower content; provisions; kinds that show a legal form, begin its body, end it; what a page's record may say.
TYPES = ["DOCUMENT", "PART", "CHAPTER", "ARTICLE", "SECTION", "SUBSECTION", "CLAUSE", "HEADING", "SUBHEADING", "SCHEDULE", "TABLE", "APPENDIX", "FORM"]
LABELS, CONTENT = ["HEADING", "SUBHEADING"], ["ARTICLE", "SECTION", "SUBSECTION", "CLAUSE"]
LEGAL, BODY, TERMINAL = ["PART", "CHAPTER", "ARTICLE", "SECTION", "SUBSECTION", "CLAUSE", "SCHEDULE"], ["HEADING", "PART", "CHAPTER", "ARTICLE", "SECTION"], ["SCHEDULE", "APPENDIX", "FORM"]
STARTS, NO_STARTS = "new_nodes_start_here", "no_new_nodes_start_here"
# Sections that make a tree without any implausible, sections from which half must be there, subsections likewise, examples that are told.
FEW_SECTIONS, MANY_SECTIONS, MANY_SUBSECTIONS, EXAMPLES = 5, 20, 10, 8


def _blank(name: str) -> Column:
    return F.trim(F.coalesce(name, F.lit(""))) == ""


def _union(rows: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


def ancestor_pages(nodes: DataFrame) -> DataFrame:
    """document_id, node_id and up_page, the page of the closest ancestor that has one; for nodes that a root reaches."""
    child = nodes.select("document_id", F.col("node_id").alias("child"), F.col("parent_id").alias("up"), F.col("start_page").alias("own"))
    first = nodes.filter("parent_id IS NULL").select("document_id", "node_id", F.lit(None).cast("int").alias("up_page"), F.col("start_page").alias("page"))
    step = lambda level: level.drop("up_page").withColumnRenamed("node_id", "up").join(child, ["document_id", "up"]).select("document_id", F.col("child").alias("node_id"), F.col("page").alias("up_page"), F.coalesce("own", "page").alias("page"))
    return trees.walk(first, step).select("document_id", "node_id", "up_page")


def node_problems(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, node_id, problem of returned nodes, documents giving page_count (null: pages unchecked).

    Null identifier and title are missing fields. Siblings repeat each other only if kind, identifier, title and a non-blank opening agree. Empty table: no rows.
    """
    key = ["document_id", "parent_id"]
    up = nodes.select("document_id", F.col("node_id").alias("parent_id"), F.col("node_type").alias("up_type"))
    n = nodes.join(up, key, "left").join(ancestor_pages(nodes), ["document_id", "node_id"], "left").join(documents.select("document_id", "page_count"), "document_id", "left")
    siblings = Window.partitionBy(*key).orderBy("sequence_no", "node_id")
    same = Window.partitionBy(*key, "node_type", F.trim("identifier"), F.trim("title"), text.collapse(F.col("opening_text"))).orderBy("sequence_no", "node_id")
    n = n.withColumns({"before": F.last("start_page", ignorenulls=True).over(siblings.rowsBetween(Window.unboundedPreceding, -1)), "turn": F.row_number().over(same)})
    root, kind = F.col("parent_id").isNull(), F.col("node_type")
    comparable = F.col("identifier").isNotNull() & F.col("title").isNotNull() & ~(_blank("identifier") & _blank("title")) & ~_blank("opening_text")
    rules = {
        "type": F.coalesce(~kind.isin(TYPES), F.lit(True)),
        "inner_document": ~root & (kind == "DOCUMENT"),
        "root_type": root & ~kind.eqNullSafe(F.lit("DOCUMENT")),
        "root_label": root & ~(F.col("identifier").eqNullSafe(F.lit("")) & F.col("title").eqNullSafe(F.lit(""))),
        "identifier": F.col("identifier").isNull(),
        "title": F.col("title").isNull(),
        "unnamed": ~root & (kind != "TABLE") & F.col("identifier").isNotNull() & F.col("title").isNotNull() & _blank("identifier") & _blank("title"),
        "nested_heading": (kind == "HEADING") & (F.col("up_type") == "HEADING"),
        "repeated": ~root & comparable & (F.col("turn") > 1),
        "no_page": F.col("start_page").isNull(),
        "root_page": root & ~F.col("start_page").eqNullSafe(F.lit(1)),
        "outside": ~F.col("start_page").between(F.lit(1), F.col("page_count")),
        "before_parent": F.col("start_page") < F.col("up_page"),
        "before_sibling": ~root & (F.col("start_page") < F.col("before")),
        "opening": kind.isin("DOCUMENT", "TABLE") & F.col("opening_text").isNotNull(),
    }
    told = n.select("document_id", "node_id", F.explode(F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in rules.items())))).alias("problem"))
    levels = nodes.filter("parent_id IS NOT NULL").groupBy(*key).agg(F.max(kind.isin(LABELS)).alias("labels"), F.max(kind.isin(CONTENT)).alias("content")).withColumnRenamed("parent_id", "node_id")
    mixed = levels.filter("labels AND content").select("document_id", "node_id", F.lit("mixed").alias("problem"))
    bare = nodes.filter("parent_id IS NULL").select("document_id", "node_id").join(levels, ["document_id", "node_id"], "left_anti").withColumn("problem", F.lit("no_children"))
    return _union([told, mixed, bare])


def coverage_problems(documents: DataFrame, coverage: DataFrame, nodes: DataFrame) -> DataFrame:
    """document_id, page, problem of page records (document_id, place, page_label, classification): pages 1 to page_count (documents) once and in order (page 0), a known classification, and that which the nodes' pages give. Of records of one page the last valid one counts."""
    told = coverage.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "page_label"))), lambda x: x["page_label"]).alias("labels"))
    wanted = F.when(F.col("page_count") > 0, F.sequence(F.lit(1), F.col("page_count"))).otherwise(F.array().cast("array<int>"))
    order = documents.join(told, "document_id", "left").filter(~F.coalesce("labels", F.array().cast("array<int>")).eqNullSafe(wanted)).select("document_id", F.lit(0).alias("page"), F.lit("order").alias("problem"))
    known = F.coalesce(F.col("classification").isin(STARTS, NO_STARTS), F.lit(False))
    odd = coverage.filter(F.col("page_label").isNotNull() & ~known).select("document_id", F.col("page_label").alias("page"), F.lit("classification").alias("problem"))
    begun = nodes.filter("start_page IS NOT NULL").select("document_id", F.col("start_page").alias("page"), F.lit(True).alias("begun")).distinct()
    last = coverage.filter(F.col("page_label").isNotNull() & known).groupBy("document_id", F.col("page_label").alias("page")).agg(F.max_by("classification", "place").alias("classification"))
    inside = last.join(documents, "document_id").filter("page BETWEEN 1 AND page_count").join(begun, ["document_id", "page"], "left")
    wrong = inside.filter(F.col("classification") != F.when(F.col("begun"), STARTS).otherwise(NO_STARTS)).select("document_id", "page", F.lit("nodes_differ").alias("problem"))
    return _union([order, odd, wrong])


def completeness_problems(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """document_id, problem, examples: documents (document_id, page_count, text with page labels) of legal form whose main body opens many sections or subsections of which the tree has none or, of many sections, less than half. Of pages with one label the last counts; without a page count or a legal node nothing is told."""
    kind, page = F.col("node_type"), F.col("start_page")
    key = F.upper(F.regexp_replace(F.trim(F.coalesce("identifier", F.lit(""))), r"\.+$", ""))
    tree = nodes.groupBy("document_id").agg(
        F.max(kind.isin(LEGAL)).alias("legal"), F.min(F.when(kind.isin(BODY), page)).alias("first"), F.min(F.when(kind.isin(TERMINAL), page)).alias("terminal"),
        F.collect_set(F.when((kind == "SECTION") & (key != ""), key)).alias("returned"), F.count_if(kind == "SUBSECTION").alias("subsections"),
    )
    d = documents.filter("page_count > 0").join(tree, "document_id").filter("legal").withColumn("pages", text.labelled_pages(F.coalesce("text", F.lit(""))))
    first = F.coalesce("first", F.lit(1))
    last = F.greatest(first, F.coalesce("terminal", F.col("page_count") + 1) - 1)
    body = F.array_join(F.transform(F.sequence(first, last), lambda n: F.coalesce(F.try_element_at(F.filter("pages", lambda p: p["label"] == n), F.lit(-1))["text"], F.lit(""))), "\n")
    d = d.withColumn("body", body).withColumns({"source": F.array_distinct(F.transform(text.section_numbers(F.col("body")), F.upper)), "openings": F.size(text.subsection_numbers(F.col("body")))})
    sample = lambda c: F.array_join(F.slice(F.transform(F.array_sort(F.transform(c, lambda x: F.struct(text.natural_key(x).alias("k"), x.alias("x")))), lambda s: s["x"]), 1, EXAMPLES), ",")
    n, none = F.size("source"), F.size("returned") == 0
    sections = F.when((n >= FEW_SECTIONS) & none, F.struct(F.lit("no_sections").alias("problem"), sample(F.col("source")).alias("examples"))).when(
        (n >= MANY_SECTIONS) & (F.size(F.array_intersect("source", "returned")) * 2 < n), F.struct(F.lit("few_sections").alias("problem"), sample(F.array_except("source", "returned")).alias("examples"))
    )
    below = F.when((F.col("openings") >= MANY_SUBSECTIONS) & (F.col("subsections") == 0), F.struct(F.lit("no_subsections").alias("problem"), F.col("openings").cast("string").alias("examples")))
    return d.select("document_id", F.explode(F.array_compact(F.array(sections, below))).alias("p")).select("document_id", "p.*")


def page_order_problems(nodes: DataFrame) -> DataFrame:
    """node_id, problem: nodes (node_id, parent_id, sequence_no, start_page) that begin before an ancestor, or before the latest page in the subtrees of the siblings before them."""
    page = nodes.select("node_id", "start_page")
    pairs = trees.closure(nodes.withColumn("label", F.lit("")), "label").select("ancestor_id", "node_id")
    floor = pairs.filter("ancestor_id <> node_id").join(page.withColumnRenamed("node_id", "ancestor_id"), "ancestor_id").groupBy("node_id").agg(F.max("start_page").alias("floor"))
    latest = pairs.join(page, "node_id").groupBy(F.col("ancestor_id").alias("node_id")).agg(F.max("start_page").alias("latest"))
    w = Window.partitionBy("parent_id").orderBy("sequence_no", "node_id").rowsBetween(Window.unboundedPreceding, -1)
    n = nodes.filter("parent_id IS NOT NULL").join(latest, "node_id").join(floor, "node_id", "left").withColumn("before", F.max("latest").over(w))
    kinds = F.array_compact(F.array(F.when(F.col("start_page") < F.col("floor"), F.lit("before_ancestor")), F.when(F.col("start_page") < F.col("before"), F.lit("before_sibling"))))
    return n.select("node_id", F.explode(kinds).alias("problem"))


def compared(baseline: DataFrame, generated: DataFrame, pages: DataFrame) -> DataFrame:
    """path, status, page of each baseline node (path, start_page) against generated ones of the same path: missing, ambiguous, unknown_page, invalid_page (none of pages' page_number), match or differs; and extra for generated nodes of other paths."""
    found = generated.groupBy("path").agg(F.count("*").alias("n"), F.min("start_page").alias("page"))
    there = pages.select(F.col("page_number").alias("page"), F.lit(True).alias("there")).distinct()
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").when(F.col("page").isNull(), "unknown_page").when(F.col("there").isNull(), "invalid_page").when(F.col("page").eqNullSafe(F.col("start_page")), "match").otherwise("differs")
    rows = baseline.join(found, "path", "left").join(there, "page", "left").select("path", status.alias("status"), F.when(F.col("n") == 1, F.col("page")).alias("page"))
    return rows.unionByName(generated.join(baseline.select("path"), "path", "left_anti").select("path", F.lit("extra").alias("status"), F.col("start_page").alias("page")))


def exact_bundle(nodes: DataFrame, chunks: DataFrame, question: str, k: int | None = None) -> DataFrame:
    """chunk_id, exact_anchor_id, place: all chunks (chunk_id, node_id, chunk_number) below the nodes (node_id, parent_id, sequence_no, node_type, identifier, similarity) that a question names, the most similar of each kind and identifier; by similarity, depth-first order and chunk number. k is the reader's limit, none by default."""
    roots = retrieval.identifier_anchor(nodes.filter("trim(identifier) <> ''"), question).select(F.col("node_id").alias("exact_anchor_id"), "node_id", "similarity", F.array("sequence_no").alias("order"))
    child = nodes.select(F.col("node_id").alias("child"), F.col("parent_id").alias("up"), F.col("sequence_no").alias("s"))
    step = lambda level: level.join(child, level["node_id"] == child["up"]).select("exact_anchor_id", F.col("child").alias("node_id"), "similarity", F.concat("order", F.array("s")).alias("order"))
    rows = trees.walk(roots, step).join(chunks, "node_id").withColumn("far", -F.col("similarity"))
    rows = trees.numbered(rows.select("chunk_id", "exact_anchor_id", "far", "order", "chunk_number"), ["far", "order", "chunk_number", "chunk_id"], "place")
    return (rows if k is None else rows.filter(F.col("place") <= k)).select("chunk_id", "exact_anchor_id", "place")


def chunk_order(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """chunk_id with its new number: depth-first place of its node, chunks of unknown nodes last, else as numbered before (chunk_number)."""
    rows = chunks.join(trees.dfs_order(nodes), "node_id", "left").withColumn("late", F.coalesce(F.col("position").cast("long"), F.lit(1 << 40)))
    return trees.numbered(rows.select("chunk_id", "late", "chunk_number"), ["late", "chunk_number", "chunk_id"], "number").select("chunk_id", "number")


def expired(files: DataFrame, now: Column, days: int) -> DataFrame:
    """Files (folder, name, started_at, modified) named as captures in folders of a day that began over ``days`` days ago; a start without a zone, or none, gives way to the time of modification."""
    ours = F.regexp_like("folder", F.lit(r"^\d{4}-\d{2}-\d{2}$")) & F.regexp_like("name", F.lit(r"^\d{8}-\d{6}_[0-9a-fA-F-]{36}\.json(\.tmp)?$"))
    zoned = F.regexp_like("started_at", F.lit(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$"))
    began = F.coalesce(F.when(zoned, F.col("started_at").try_cast("timestamp")), F.col("modified"))
    return files.filter(ours & (began < now - F.make_dt_interval(F.lit(days))))


def places(anchor: str, page: str, whole: bool) -> list[int]:
    """Offsets at which a page holds an anchor, whatever its case and white space; a whole one doesn't begin inside a word, nor end inside one by its last letter or digit."""
    want, kept = "".join(anchor.lower().split()), [(low, i) for i, c in enumerate(page) if not c.isspace() for low in c.lower()]
    squeezed, out, at = "".join(c for c, _ in kept), [], -1
    while want and (at := squeezed.find(want, at + 1)) >= 0:
        begin, end = kept[at][1], kept[at + len(want) - 1][1] + 1
        inner = (begin and page[begin - 1].isalnum()) or (want[-1].isalnum() and page[end : end + 1].isalnum())
        if not (whole and inner) and (not out or out[-1] != begin):
            out.append(begin)
    return out


def narrowed(domains: dict) -> set:
    """Take from ordered lists of places (in the order of their keys) those without a place before them in the next list or behind them in the previous one, until nothing changes; of neighbours that contradict each other both lose all. Returns the keys of these."""
    from bisect import bisect_left, bisect_right
    from itertools import pairwise

    lost = set()
    while True:
        size = sum(map(len, domains.values()))
        for a, b in pairwise([k for k, v in domains.items() if v]):
            x, y = domains[a], domains[b]
            x, y = x[: bisect_left(x, y[-1])], y[bisect_right(y, x[0]) :]
            if not x or not y:
                domains[a], domains[b] = [], []
                lost |= {a, b}
                break
            domains[a], domains[b] = x, y
        else:
            if size == sum(map(len, domains.values())):
                return lost


def map_candidates(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """document_id, node_id, start_page, start_character, end_page, reason: places that text and order force.

    Every node but tables is sought by title, else identifier, on all pages (document_id, page_number, text). Places that contradict the
    depth-first order go; what has one place left is there. The first titled HEADING below a single DOCUMENT root takes its first place. A range ends where the next placed sibling, or
    that of an ancestor, begins; nodes without a name and tables take their parent's. Others have a reason. A tree with repeated ids, missing parents, equal
    sequence numbers or cycles gives invalid_hierarchy for all its nodes. A document's own tree and text are one group.
    """
    out = "document_id long, node_id string, start_page int, start_character int, end_page int, reason string"

    def run(tree, leaves):
        import pandas as pd

        doc = tree["document_id"].iloc[0] if len(tree) else None
        text_ = sorted((int(p), t or "") for p, t in zip(leaves["page_number"], leaves["text"], strict=True))
        rows = {r.node_id: r for r in tree.itertuples()}
        name = lambda n, c: (getattr(rows[n], c) or "").strip()
        kind = {n: (r.node_type or "").upper() for n, r in rows.items()}
        up = {n: r.parent_id if isinstance(r.parent_id, str) else None for n, r in rows.items()}
        below = {}
        for n in sorted(rows, key=lambda n: rows[n].sequence_no):
            below.setdefault(up[n], []).append(n)
        order, stack = [], below.get(None, [])[::-1]
        while stack:
            order.append(stack.pop())
            stack += below.get(order[-1], [])[::-1]
        sound = len(rows) == len(tree) == len(order) and all(len({rows[n].sequence_no for n in s}) == len(s) for s in below.values())
        if not sound or not text_:
            return pd.DataFrame([(doc, n, None, None, None, "invalid_hierarchy" if not sound else "no_pages") for n in tree["node_id"]], columns=["document_id", "node_id", "start_page", "start_character", "end_page", "reason"])
        finish = (text_[-1][0], len(text_[-1][1]))
        named = [n for n in order if kind[n] != "TABLE" and (name(n, "title") or name(n, "identifier"))]
        domains = {n: [(p, i) for p, t in text_ for i in places(name(n, "title") or name(n, "identifier"), t, not name(n, "title")) if (p, i) < finish] for n in named}
        why = {n: "not_found" for n in named if not domains[n]}
        tops = below[None]
        head = below.get(tops[0], [None])[0] if len(tops) == 1 and kind[tops[0]] == "DOCUMENT" else None
        if head and kind[head] == "HEADING" and name(head, "title"):
            domains[head] = domains[head][:1]
        why |= dict.fromkeys(narrowed(domains), "conflict")
        why |= {n: "ambiguous" for n in named if len(domains[n]) > 1}
        at = {n: domains[n][0] for n in named if len(domains[n]) == 1}
        later = {n: s[i + 1 :] for s in below.values() for i, n in enumerate(s)}

        def boundary(n):
            while n is not None:
                for s in later[n]:
                    if s in at:
                        return at[s]
                n = up[n]
            return finish

        begin, end = {n: p[0] for n, p in at.items()}, {}
        for n in order:
            parent = up[n]
            if parent in why:
                why[n] = "parent_unresolved"
                at.pop(n, None)
                begin.pop(n, None)
            plain = n not in domains
            if plain and kind[n] != "TABLE":
                begin[n] = begin.get(parent) if parent else text_[0][0]
            if n in at:
                stop = boundary(n)
                if stop <= at[n]:
                    why[n] = "empty_range"
                    del at[n], begin[n]
                else:
                    end[n] = stop[0]
            elif plain and parent and end.get(parent) is not None:
                begin[n], end[n] = begin.get(parent), end[parent]
            elif plain and not parent:
                end[n] = finish[0]
        for n in order:
            if n not in domains and n not in end and n not in why:
                end[n] = boundary(n)[0]
        for n in order:
            if kind[n] == "TABLE" and up[n] and up[n] not in why:
                begin[n], end[n] = begin.get(up[n]), end.get(up[n])
        found = [(doc, n, begin.get(n), at[n][1] if n in at else None, end.get(n), why.get(n)) for n in order]
        return pd.DataFrame(found, columns=["document_id", "node_id", "start_page", "start_character", "end_page", "reason"]).astype({"start_page": "Int32", "start_character": "Int32", "end_page": "Int32"})

    of = F.col("document_id").cast("long").alias("document_id")
    tree = nodes.select(of, "node_id", "parent_id", F.col("sequence_no").cast("long").alias("sequence_no"), "node_type", "identifier", "title")
    leaves = pages.select(of, F.col("page_number").cast("long").alias("page_number"), "text")
    return tree.groupBy("document_id").cogroup(leaves.groupBy("document_id")).applyInPandas(run, out)


def topics(nodes: DataFrame) -> DataFrame:
    """document_id, topics: the nodes' titles (document_id, position in depth-first order, title), white space collapsed, each normalised form once, where it comes first."""
    named = nodes.select("document_id", "position", text.collapse(F.col("title")).alias("title")).filter("title <> ''").withColumn("form", text.normalize_text(F.col("title")))
    first = named.groupBy("document_id", "form").agg(F.min(F.struct("position", "title")).alias("at"))
    return first.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["title"]).alias("topics"))
