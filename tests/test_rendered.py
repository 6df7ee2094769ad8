"""Queries over files written from ``flow_nodes`` that read them several times."""

import pytest

from codequarry.plans import rendered

NODES = [
    (1, "lib/a", "run", "x/y.go", [2, 3, 4]), (2, "lib/a", "load", "x/y.go", [5, 6, 7]), (3, "lib/a", "keep", None, None), (4, "lib/b", "load", "z.go", [3]),
    (5, "lib/b", "read", "z.go", []), (6, "lib/b", "parse", "z.go", []), (7, "lib/b", "check", "z.go", [8]), (8, "lib/b", "sum", "z.go", None),
]


@pytest.fixture(scope="module")
def nodes(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("nodes"))
    spark.createDataFrame(NODES, "node_id long, repo string, name string, file_path string, children array<long>").write.parquet(f"{folder}/flow_nodes.parquet")
    return folder


def reads(df):
    """How often the plan reads the table and runs the extractor, and how long it is."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("parquet"), plan.count("MapInArrow"), plan.count("Join ")


def test_entry_point_order_plans_the_files_once(spark, nodes):
    e = rendered.r7_entry_point_order(spark, nodes)
    assert [(r.position, r.name, r.path) for r in e.orderBy("position").collect()] == [
        (1, "main", "lib/a/n1.go"), (2, "load", "lib/a/n2.go"), (3, "keep", "lib/a/n3.go"), (4, "parse", "lib/b/n6.go"), (5, "read", "lib/b/n5.go"), (6, "sum", "lib/b/n8.go"),
    ]
    table, extractor, joins = reads(e)
    assert (table, extractor) == (0, 0) and joins <= 5


def test_full_trace_plans_the_files_once(spark, nodes):
    t = rendered.g16_full_trace(spark, nodes)
    n1, n2, n4 = (f"lib/{x}.go" for x in ("a/n1", "a/n2", "b/n4"))
    want = {("definition", n2, 8), ("definition", n4, 8), ("caller", n1, 9), ("caller", n1, 11), ("callee", n2, 9), ("callee", n2, 10), ("callee", n2, 11), ("callee", n4, 9)}
    want |= {("reference", n1, 9), ("reference", n1, 11), *(("reference", p, line) for p, line in ((n2, 7), (n2, 8), (n2, 15), (n2, 16), (n4, 7), (n4, 8)))}
    assert {tuple(r) for r in t.collect()} == want
    assert reads(t) == (0, 0, 0)


def test_entry_points_plan_the_files_once(spark, nodes):
    e = rendered.g1_entry_points(spark, nodes)
    assert {tuple(r) for r in e.collect()} == {
        ("main", "lib/a/n1.go", 14, "main", "main"), ("load", "lib/a/n2.go", 8, "command", "load"),
        *((name, f"lib/{at}.go", 8, "handler", name) for name, at in (("keep", "a/n3"), ("parse", "b/n6"), ("read", "b/n5"), ("sum", "b/n8"))),
    }
    table, extractor, joins = reads(e)
    assert (table, extractor) == (0, 0) and joins <= 5
