"""Hierarchies as adjacency rows (node_id, parent_id, depth, sequence_no, title): closures, order, references and flattening."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shared_folder(spark) -> str:
    """The checkpoint folder that the cluster shares, ``spark.checkpoint.dir``; a local master may go without one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through a table written to the shared folder, which also forgets what the planner has inferred about the rows."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def walk(start: DataFrame, step) -> DataFrame:
    """Rows of start, of step(start), of step of these and so on until there are none: one join for each level of the tree, however many rows."""
    out = level = cut(start)
    while not level.isEmpty():
        level = cut(step(level))
        out = out.unionByName(level)
    return out


def closure(nodes: DataFrame, label: str) -> DataFrame:
    """ancestor_id, node_id, path (labels from the ancestor down to the node) for every node and ancestor, itself included. A node that is its own ancestor is walked once."""
    child = nodes.select(F.col("node_id").alias("child"), F.col("parent_id").alias("up"), F.col(label).alias("label"))
    first = nodes.select(F.col("node_id").alias("ancestor_id"), "node_id", F.array(F.coalesce(label, F.lit(""))).alias("path"), F.array("node_id").alias("seen"))

    def step(level):
        grown = level.join(child, level["node_id"] == child["up"]).filter(~F.array_contains("seen", F.col("child")))
        return grown.select("ancestor_id", F.col("child").alias("node_id"), F.concat("path", F.array(F.coalesce("label", F.lit("")))).alias("path"), F.concat("seen", F.array("child")).alias("seen"))

    return walk(first, step).drop("seen")


def descendants(nodes: DataFrame, roots: str) -> DataFrame:
    """root_id, node_id, distance for every node under the roots (a condition), themselves included. A root that is its own descendant isn't walked again."""
    child = nodes.select(F.col("node_id").alias("child"), F.col("parent_id").alias("up"))
    step = lambda level: level.join(child, level["node_id"] == child["up"]).filter(~F.array_contains("seen", F.col("child"))).select("root_id", F.col("child").alias("node_id"), (F.col("distance") + 1).alias("distance"), F.concat("seen", F.array("child")).alias("seen"))
    return walk(nodes.filter(roots).select(F.col("node_id").alias("root_id"), "node_id", F.lit(0).alias("distance"), F.array("node_id").alias("seen")), step).drop("seen")


def paths(nodes: DataFrame) -> DataFrame:
    """node_id, order (sequence numbers from the root) and path (titles): sorting by order is depth first. Nodes that no root reaches, as those of a cycle, have none."""
    child = nodes.select(F.col("node_id").alias("child"), F.col("parent_id").alias("up"), F.col("sequence_no").alias("s"), F.col("title").alias("t"))
    step = lambda level: level.join(child, level["node_id"] == child["up"]).select(F.col("child").alias("node_id"), F.concat("order", F.array("s")).alias("order"), F.concat("path", F.array("t")).alias("path"))
    return walk(nodes.filter("parent_id IS NULL").select("node_id", F.array("sequence_no").alias("order"), F.array("title").alias("path")), step)


def numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """The rows with their number (from 1) in the order of ``by``: sorted by ranges, each range's rows counted, none brought together in one task."""
    at, part = "number in its range", "range"
    sorted_ = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id() % F.lit(1 << 33)))
    # one row for each partition
    counts = {r[part]: r["count"] for r in sorted_.groupBy(part).count().collect()}
    before, total = [], 0
    for i in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(i, 0)
    return sorted_.withColumn(name, F.get(F.array(*map(F.lit, before or [0])), F.col(part)).cast("long") + F.col(at) + 1).drop(at, part)


def dfs_order(nodes: DataFrame) -> DataFrame:
    """node_id with position from 1; nodes that no root reaches come last by depth and sequence."""
    known = paths(nodes)
    orphans = nodes.join(known, "node_id", "left_anti").select("node_id", F.lit(1).alias("late"), F.array(F.col("depth").cast("int"), F.col("sequence_no").cast("int")).alias("order"))
    rows = known.select("node_id", F.lit(0).alias("late"), F.col("order").cast("array<int>").alias("order")).unionByName(orphans)
    return numbered(rows, ["late", "order", "node_id"], "position").select("node_id", F.col("position").cast("int").alias("position"))


def problems(nodes: DataFrame) -> DataFrame:
    """node_id and problem: missing parent, duplicate sequence, wrong depth, repeated id."""
    parent = nodes.select(F.col("node_id").alias("parent_id"), F.col("depth").alias("up"))
    rows = [
        nodes.filter("parent_id IS NOT NULL").join(parent, "parent_id", "left_anti").select("node_id", F.lit("missing_parent").alias("problem")),
        nodes.join(parent, "parent_id").filter("depth <> up + 1").select("node_id", F.lit("wrong_depth").alias("problem")),
        nodes.withColumn("n", F.row_number().over(Window.partitionBy("parent_id", "sequence_no").orderBy("node_id"))).filter("n > 1").select("node_id", F.lit("duplicate_sequence").alias("problem")),
        nodes.groupBy("node_id").count().filter("count > 1").select("node_id", F.lit("repeated_id").alias("problem")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def unreachable(nodes: DataFrame) -> DataFrame:
    """node_id of nodes that no root reaches: below a missing parent, or in a cycle."""
    return nodes.select("node_id").join(paths(nodes), "node_id", "left_anti")


def resolve_references(references: DataFrame, targets: DataFrame) -> DataFrame:
    """References (source_id, key) against targets (node_id, key): linked if exactly one target, else missing or ambiguous."""
    found = targets.groupBy("key").agg(F.count("*").alias("n"), F.min("node_id").alias("target_id"))
    rows = references.join(found, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("source_id", "key", F.when(F.col("n") == 1, F.col("target_id")).alias("target_id"), F.when(F.col("n") == 1, "linked").when(F.col("n") == 0, "missing").otherwise("ambiguous").alias("status"))


def flatten(documents: DataFrame) -> DataFrame:
    """Nodes in pre-order from (document_id, hierarchy), a JSON tree of {type, identifier, title, start_page, opening_text, children}. Depth is unbounded, so each tree is walked in Python, by Arrow batches."""
    schema = "document_id long, node_id string, parent_id string, depth int, sequence_no int, position int, node_type string, identifier string, title string, start_page int, opening_text string"

    def run(frames):
        import pandas as pd

        names = [x.split()[0] for x in schema.split(", ")]
        for frame in frames:
            rows = []
            for doc, raw in zip(frame["document_id"], frame["hierarchy"], strict=True):
                tree = json.loads(raw) if raw else None
                stack, place = ([(tree, None, 0, 0)] if tree else []), 0
                while stack:
                    node, parent, depth, sequence = stack.pop()
                    me = f"{doc}:{place}"
                    rows.append((doc, me, parent, depth, sequence, place, node.get("type"), node.get("identifier"), node.get("title"), node.get("start_page"), node.get("opening_text")))
                    place += 1
                    stack += [(c, me, depth + 1, i) for i, c in reversed(list(enumerate(node.get("children") or [])))]
            yield pd.DataFrame(rows, columns=names)

    return documents.select("document_id", "hierarchy").mapInPandas(run, schema)


def map_pages_forward(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """For nodes (document_id, position, node_id, title, page_hint) in order: offset of the title on its claimed page, after the last hit; else a reason. Sequential inside a document."""
    out = "document_id long, node_id string, page int, offset int, reason string"
    both = nodes.select("document_id", "position", "node_id", "title", "page_hint", F.lit(None).cast("string").alias("text")).unionByName(
        pages.select("document_id", F.lit(None).cast("int").alias("position"), F.lit(None).cast("string").alias("node_id"), F.lit(None).cast("string").alias("title"), F.col("page_number").cast("int").alias("page_hint"), "text")
    )

    def run(frame):
        import re

        import pandas as pd

        text = {int(p): t or "" for p, t, n in zip(frame["page_hint"], frame["text"], frame["node_id"], strict=True) if n is None and p == p}
        rows, cursor = [], (0, 0)
        for r in frame[frame["node_id"].notna()].sort_values("position").itertuples():
            page = None if r.page_hint is None or r.page_hint != r.page_hint else int(r.page_hint)
            words = (r.title or "").split()
            reason, offset = None, None
            if page is None:
                reason = "no_hint"
            elif page not in text:
                reason = "out_of_range"
            elif page < cursor[0]:
                reason = "backward"
            elif not words:
                reason = "blank"
            else:
                hit = re.compile(r"\s+".join(map(re.escape, words)), re.IGNORECASE).search(text[page], cursor[1] if page == cursor[0] else 0)
                if hit:
                    offset, cursor = hit.start(), (page, hit.end())
                else:
                    reason = "not_found"
            rows.append((r.document_id, r.node_id, page, offset, reason))
        return pd.DataFrame(rows, columns=["document_id", "node_id", "page", "offset", "reason"]).astype({"page": "Int32", "offset": "Int32"})

    return both.groupBy("document_id").applyInPandas(run, out)
