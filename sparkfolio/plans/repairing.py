"""Queries of bounded repair; trees and answers stand as VALUES."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import repair
from .indexing import _fixture
from .queries import query

TREE = """(1, 'r', NULL, 0, 'DOCUMENT', '', '', 1), (1, 'a', 'r', 0, 'PART', 'I', 'Onne', 9), (1, 'b', 'r', 1, 'PART', 'II', 'Two', 2), (1, 'b1', 'b', 0, 'SECTION', '1', 'S', 2), (2, 'r', NULL, 0, 'DOCUMENT', '', '', 1), (2, 'a', 'r', 0, 'PART', 'I', 'One', 9), (3, 'r', NULL, 0, 'DOCUMENT', '', '', 1), (3, 'a', 'r', 0, 'PART', 'I', 'One', 1),
 (4, 'r', NULL, 0, 'DOCUMENT', '', '', 1), (4, 'a', 'r', 0, 'PART', 'I', 'One', 1), (5, 'a', NULL, 0, 'PART', 'I', 'One', 9), (6, 'a', NULL, 0, 'PART', 'I', 'One', 9)"""
FAILURES = "(1, 'a'), (2, 'a'), (5, 'a'), (6, 'a')"
MISSING = "(1, '0/1', 'r', 1, '', 'PART'), (1, '0/1', 'r', 1, '0', 'SECTION'), (1, '0/2', 'r', 1, '', 'PART'), (1, '0/3', 'b', 1, '', 'SECTION'), (3, '0/1', 'r', 1, '', 'PART'), (4, '0/1', 'r', 1, '', 'PART'), (4, '0/2', 'r', 1, '', 'PART'), (4, '0/2', 'r', 1, '0', 'SECTION')"
CORRECTIONS = "(1, 'a', 'I', 'One', 1), (2, 'a', 'I', 'One', 0), (2, 'r', '', 'x', 1), (6, 'a', 'I', 'One', 1), (6, 'a', 'I', 'Once', 1)"
INSERTIONS = "(1, '0/1', '', 'PART', 'IA', 'New', 1), (1, '0/1', '0', 'SECTION', '5', 'Below', 2), (1, '0/2', '', 'PART', 'IB', 'Newer', 2), (1, '0/3', NULL, NULL, NULL, NULL, NULL), (3, '0/1', '', 'PART', 'i', 'Other', 1), (3, '0/9', '', 'PART', 'X', 'x', 1), (4, '0/2', '', 'PART', 'II', 'Two', NULL)"


def _answers(spark):
    kinds = "document_id, candidate_id, {}entry, node_type"
    return (
        _fixture(spark, "document_id, node_id, parent_id, sequence_no, node_type, identifier, title, start_page", TREE), _fixture(spark, "document_id, node_id", FAILURES), _fixture(spark, kinds.format("parent_id, insert_index, "), MISSING),
        _fixture(spark, "document_id, node_id, identifier, title, start_page", CORRECTIONS), _fixture(spark, kinds.format("") + ", identifier, title, start_page", INSERTIONS),
    )


@query("""SELECT * FROM (VALUES (2, 'unexpected_correction'), (2, 'correction_fields'), (3, 'insertion_exists'), (3, 'unexpected_insertion'), (4, 'no_decision'), (4, 'insertion_shape'), (4, 'insertion_fields'), (5, 'no_correction'), (6, 'repeated_correction')) t(document_id, problem)""")
def repair_problems(spark, d):
    return repair.problems(*_answers(spark))


@query("""SELECT * FROM (VALUES (1, 'r', NULL, 0, '', 1), (1, 'a', 'r', 0, 'One', 1), (1, '1:new:0/1:', 'r', 1, 'New', 1), (1, '1:new:0/2:', 'r', 2, 'Newer', 2), (1, 'b', 'r', 3, 'Two', 2), (1, '1:new:0/1:0', '1:new:0/1:', 0, 'Below', 2), (1, 'b1', 'b', 0, 'S', 2), (2, 'r', NULL, 0, '', 1), (2, 'a', 'r', 0, 'One', 9),
 (3, 'r', NULL, 0, '', 1), (3, 'a', 'r', 0, 'One', 1), (4, 'r', NULL, 0, '', 1), (4, 'a', 'r', 0, 'One', 1), (5, 'a', NULL, 0, 'One', 9), (6, 'a', NULL, 0, 'One', 9)) t(document_id, node_id, parent_id, sequence_no, title, start_page)""")
def repair_applied(spark, d):
    return repair.applied(*_answers(spark))[0].select("document_id", "node_id", "parent_id", "sequence_no", "title", "start_page")


@query("SELECT * FROM (VALUES (1, 'a', 'One'), (1, 'b', ''), (1, 'c', 'Else')) t(document_id, node_id, title)")
def repair_supported_titles(spark, d):
    nodes = _fixture(spark, "document_id, node_id, title", "(1, 'a', 'One'), (1, 'b', 'Two'), (1, 'c', 'Three')")
    answers = _fixture(spark, "document_id, node_id, identifier, title, start_page", "(1, 'a', '', '', 1), (1, 'b', '', '', 1), (1, 'c', '', 'Else', 1)")
    return repair.keep_supported(answers, nodes, nodes.filter("node_id <> 'b'")).select("document_id", "node_id", F.col("title"))
