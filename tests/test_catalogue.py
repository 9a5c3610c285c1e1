import pytest

from tesserine.plans import catalogue

from tests.oracle import same

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(catalogue.ORACLE_SQL))
def test_query_against_sql(spark, name):
    same(catalogue.QUERIES[name](spark, LARGER), catalogue.ORACLE_SQL[name], LARGER)


def test_diff_lines_agree_with_their_counts(spark):
    got = catalogue.diff_lines(spark, SF).groupBy("type").count().collect()
    assert {r["type"] for r in got} <= {"context", "added", "removed"} and got


def test_edges_end_in_nodes(spark):
    nodes = {r["id"] for r in catalogue.graph_nodes(spark, SF).collect()}
    t = catalogue.knowledge(spark, SF)
    from tesserine.operators import graph

    edges = graph.workspace_graph(t).edges.collect()
    assert all(e["source"] in nodes and e["target"] in nodes for e in edges)


def test_entry_can_be_read_without_a_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; print(len(e.queries()) >= 60, len(e.oracle_sql()) >= 60)"
    said = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert said.stdout.strip().endswith("True True")
