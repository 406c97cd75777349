"""References between provisions: addresses under every ancestor, links of one hop in both directions, and what can't be resolved.

Nodes: node_id, parent_id, node_type, identifier. References: source_id, node_type, identifier, sub_identifier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import trees


def addresses(nodes: DataFrame) -> DataFrame:
    """node_id under each ancestor (itself too) as (kind, base, child): type and key of the ancestor, key of the identifiers from there down."""
    closure = trees.closure(nodes, "identifier")
    own = nodes.select(F.col("node_id").alias("ancestor_id"), F.col("node_type").alias("kind"), text.base_key(F.col("identifier")).alias("base"))
    return closure.join(own, "ancestor_id").select("node_id", "kind", "base", text.child_key(F.array_join(F.slice("path", 2, F.greatest(F.lit(0), F.size("path") - 1)), "")).alias("child"))


def resolved(nodes: DataFrame, references: DataFrame) -> DataFrame:
    """The references with target_id if exactly one node has the address, and status linked, missing or ambiguous."""
    found = addresses(nodes).groupBy("kind", "base", "child").agg(F.count("*").alias("n"), F.min("node_id").alias("target_id"))
    keyed = references.select("source_id", F.col("node_type").alias("kind"), "identifier", text.base_key(F.col("identifier")).alias("base"), text.child_key(F.col("sub_identifier")).alias("child"))
    status = F.when(F.col("n") == 1, "linked").when(F.col("n").isNull(), "missing").otherwise("ambiguous")
    return keyed.join(found, ["kind", "base", "child"], "left").select("source_id", "kind", "identifier", "child", F.when(F.col("n") == 1, F.col("target_id")).alias("target_id"), status.alias("status"))


def followed(nodes: DataFrame, references: DataFrame, seeds: DataFrame) -> DataFrame:
    """linked_id, direction, source_id, target_id: nodes that one reference out of the seeds and their ancestors reaches, or from which one reaches these, with all descendants."""
    closure = trees.closure(nodes, "identifier")
    scope = closure.join(seeds.select("node_id"), "node_id", "left_semi").select(F.col("ancestor_id").alias("scope_id")).distinct()
    links = resolved(nodes, references).filter("status = 'linked'").select("source_id", "target_id")
    out = links.join(scope, F.col("source_id") == F.col("scope_id"), "left_semi").select(F.lit("outgoing").alias("direction"), "source_id", "target_id", F.col("target_id").alias("root"))
    back = links.join(scope, F.col("target_id") == F.col("scope_id"), "left_semi").select(F.lit("incoming").alias("direction"), "source_id", "target_id", F.col("source_id").alias("root"))
    below = closure.select(F.col("ancestor_id").alias("root"), F.col("node_id").alias("linked_id"))
    return out.unionByName(back).join(below, "root").select("linked_id", "direction", "source_id", "target_id")


def unresolved(nodes: DataFrame, references: DataFrame, seeds: DataFrame) -> DataFrame:
    """source_id, identifier, status of references in scope (the seeds and their ancestors) that have no single target."""
    scope = trees.closure(nodes, "identifier").join(seeds.select("node_id"), "node_id", "left_semi").select(F.col("ancestor_id").alias("source_id")).distinct()
    return resolved(nodes, references).filter("status <> 'linked'").join(scope, "source_id", "left_semi").select("source_id", "identifier", "status")


def linked_chunks(ranked: DataFrame, links: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked chunks (chunk_id, place, match_types), then the chunks of linked nodes that aren't among them, tagged reference_following; those that are get the tag besides."""
    more = chunks.join(links.select(F.col("linked_id").alias("node_id")).distinct(), "node_id", "left_semi").select("chunk_id", F.lit(True).alias("linked"))
    both = ranked.join(more, "chunk_id", "full")
    tags = F.array_union(F.coalesce("match_types", F.array().cast("array<string>")), F.when(F.col("linked"), F.array(F.lit("reference_following"))).otherwise(F.array().cast("array<string>")))
    # the order is that of one answer's evidence, a list as long as top-k and its links
    return both.select("chunk_id", F.row_number().over(Window.orderBy(F.col("place").asc_nulls_last(), "chunk_id")).alias("place"), tags.alias("match_types"))


def entry_key() -> tuple:
    plain = lambda c: F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z0-9]", "")
    return plain("identifier"), plain("title")


def missing_entries(reference: DataFrame, current: DataFrame) -> DataFrame:
    """node_id, status (missing or ambiguous) of entries of a reference tree without a single equal entry under the matched parent in another tree; below an unmatched entry nothing is compared. Entries are equal by type and, where both have identifiers, these, else titles."""
    ident, title = entry_key()
    keyed = lambda t, p: t.select(*(F.col(c).alias(p + c) for c in ("node_id", "parent_id", "node_type")), ident.alias(p + "i"), title.alias(p + "t"), (F.coalesce("identifier", F.lit("")) != "").alias(p + "h"))
    old, new = keyed(reference, "o_"), keyed(current, "n_")
    pairs = trees.cut(old.filter("o_parent_id IS NULL").crossJoin(F.broadcast(new.filter("n_parent_id IS NULL").limit(1))).select("o_node_id", "n_node_id"))
    out = None
    while True:
        left = pairs.join(old, pairs["o_node_id"] == old["o_parent_id"]).select(F.col("n_node_id").alias("up"), old["o_node_id"].alias("child"), "o_node_type", "o_i", "o_t", "o_h")
        same = (F.col("up") == F.col("n_parent_id")) & (F.col("o_node_type") == F.col("n_node_type")) & F.when(F.col("o_h") & F.col("n_h"), F.col("o_i") == F.col("n_i")).otherwise(F.col("o_t") == F.col("n_t"))
        found = trees.cut(left.join(new, same, "left").groupBy("child").agg(F.count("n_node_id").alias("n"), F.min("n_node_id").alias("n_node_id")))
        lost = found.filter("n <> 1").select(F.col("child").alias("node_id"), F.when(F.col("n") == 0, "missing").otherwise("ambiguous").alias("status"))
        out = lost if out is None else out.unionByName(lost)
        pairs = found.filter("n = 1").select(F.col("child").alias("o_node_id"), "n_node_id")
        if pairs.isEmpty():
            return out
