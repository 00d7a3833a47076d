"""The registered queries of the subpackage."""

from strandloom.llm.queries import QUERIES, SQL


def test_every_problem_has_its_query():
    assert {"p1_found", "p3_found", "p4_found", "p5_found", "p6_ids", "p7_containers", "p8_found"} <= set(QUERIES)
    assert set(SQL) <= set(QUERIES)
