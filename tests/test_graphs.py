"""Components, hierarchies and flat tables against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from codequarry.operators.components import connected_components
from codequarry.operators.flatten import entities, flatten, parse, parse_deep, tables, tightest
from codequarry.operators.hierarchy import descendants, hierarchy, reach
from codequarry.plans import graphs


def brute(edges, nodes):
    kids = {n: set() for n in nodes}
    for a, b in edges:
        kids[a].add(b)
    reach = {}
    for n in nodes:
        seen, work = set(), list(kids[n])
        while work:
            m = work.pop()
            if m not in seen:
                seen.add(m)
                work += kids[m]
        reach[n] = seen
    cyc = {n: min(m for m in reach[n] if n in reach[m]) for n in nodes if n in reach[n]}
    below = {m for c in cyc for m in reach[c]} - set(cyc)
    return kids, reach, cyc, below


def random_forest(seed, n=60, extra=4):
    r = random.Random(seed)
    edges = [(r.randrange(i), i) for i in range(1, n) if r.random() < 0.9]
    up = {b: a for a, b in edges}
    for i in r.sample(range(n), extra):  # links back to an ancestor close a cycle
        top = i
        for _ in range(r.randrange(3)):
            top = up.get(top, top)
        edges.append((i, top))
    return edges


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("most", [10**6, 3])
def test_hierarchy(spark, seed, most):
    edges, nodes = random_forest(seed), list(range(62))
    kids, reach, cyc, below = brute(edges, nodes)
    df = spark.createDataFrame([*edges, edges[0], (None, 3), (5, None), (7, 999)], "a long, b long").withColumn("node", F.lit("x"))
    nd = spark.createDataFrame([(n,) for n in [*nodes, 3]] + [(None,)], "id long")
    got = {r.node: r for r in hierarchy(df, "a", "b", nd, "id", max_component=most).collect()}
    assert set(got) == set(nodes)
    parent = {b: a for a, b in edges if b not in cyc and b not in below}
    for n in nodes:
        if n in cyc:
            assert (got[n].state, got[n].root, got[n].depth) == ("cycle", cyc[n], -1)
        elif n in below:
            assert got[n].state == "below" and got[n].root is None
        else:
            path = [n]
            while path[-1] in parent:
                path.append(parent[path[-1]])
            assert (got[n].root, got[n].depth, got[n].state) == (path[-1], len(path) - 1, "tree")
            if most > 3:
                assert got[n].path == path[::-1]


@pytest.mark.parametrize("seed", [1, 2])
def test_size_of_a_component_changes_nothing(spark, seed):
    r = random.Random(seed)
    shared = [(a, b) for b in range(101, 140) for a in r.sample(range(100, b), min(b - 100, 2))]
    df = spark.createDataFrame([*random_forest(seed), *shared, (150, 139), (151, 150), (152, 120)], "a long, b long")
    one, far = (hierarchy(df, "a", "b", max_component=most).collect() for most in (10**6, 3))
    assert sorted(far) == sorted(one)
    assert all(x.path and x.path[-1] == x.node and len(x.path) == x.depth + 1 for x in far if x.state == "tree")
    short = hierarchy(df, "a", "b", max_component=3, paths=False)
    assert sorted(tuple(x)[:6] for x in short.collect()) == sorted(tuple(x)[:6] for x in one)
    assert short.where("path is not null").isEmpty()


def test_paths_of_a_large_component(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    tree = hierarchy(chain, "a", "b", max_component=10)
    assert descendants(tree).count() == 61 * 60 // 2
    assert {(x.post - x.pre - 1) // 2 + x.depth for x in tree.collect()} == {60}


def test_reach_of_shared_nodes_and_cycles(spark):
    r = random.Random(5)
    edges = [*random_forest(3), *((a, b) for b in range(101, 140) for a in r.sample(range(100, b), min(b - 100, 2))), *((i, i + 1) for i in range(200, 237))]
    _, below, _, _ = brute(edges, {n for e in edges for n in e})
    got = {(x.ancestor, x.descendant): x.distance for x in reach(spark.createDataFrame([*edges, edges[0], (None, 1), (2, None)], "a long, b long"), "a", "b").collect()}
    assert got.keys() == {(a, b) for a in below for b in below[a]}
    assert got[200, 237] == 37 and all(d == 1 for (a, b), d in got.items() if (a, b) in edges)


def test_call_queries_give_shared_functions_to_all_callers(spark, tmp_path):
    rows = [(" a", "s"), ("b", "s "), ("a", "b"), ("s", "t"), ("x", "y"), ("y", "x"), ("y", "z"), ("", "q"), ("q", None)]
    spark.createDataFrame(rows, "caller string, callee string").write.parquet(f"{tmp_path}/call_edges.parquet")
    pairs = {tuple(x) for x in graphs.p5_call_descendants(spark, str(tmp_path)).collect()}
    want = {("a", "s", 1), ("a", "b", 1), ("a", "t", 2), ("b", "s", 1), ("b", "t", 2), ("s", "t", 1)}
    assert pairs == want | {("x", "y", 1), ("y", "x", 1), ("y", "z", 1), ("x", "z", 2), ("x", "x", 2), ("y", "y", 2)}
    got = {x.node: tuple(x)[1:] for x in graphs.p5_call_paths(spark, str(tmp_path)).collect()}
    assert got["s"] == ("a", 1, "tree", 1, "a/s") and got["b"] == ("a", 1, "tree", 2, "a/b") and got["t"] == ("a", 2, "tree", 0, "a/s/t")
    assert got["x"] == ("x", -1, "cycle", 3, "") and got["z"] == (None, None, "below", 0, "")


def test_flow_queries_have_descendants_on_and_below_cycles(spark, tmp_path):
    edges = [(1, 2), (2, 3), (3, 2), (3, 4), (4, 5), (1, 6), (7, 7), (8, 6)]
    children = {a: [y for x, y in edges if x == a] for a in range(1, 9)}
    rows = [(a, [*c, 99, None, *c[:1]]) for a, c in children.items()]
    spark.createDataFrame([*rows, rows[0]], "node_id long, children array<long>").write.parquet(f"{tmp_path}/flow_nodes.parquet")
    _, below, _, _ = brute(edges, range(1, 9))
    got = {(x.ancestor, x.descendant): x.distance for x in graphs.p5_flow_descendants(spark, str(tmp_path)).collect()}
    assert got.keys() == {(a, b) for a in below for b in below[a]}
    assert (got[1, 5], got[2, 2], got[3, 3], got[7, 7], got[2, 5]) == (4, 2, 2, 1, 3)
    paths = {x.node: tuple(x)[1:] for x in graphs.p5_flow_paths(spark, str(tmp_path)).collect()}
    assert {a: p[3] for a, p in paths.items()} == {a: len(b) for a, b in below.items()}
    assert paths[1] == (1, 0, "tree", 5, "1") and paths[2] == (2, -1, "cycle", 4, "") and paths[4] == (None, None, "below", 1, "") and paths[6] == (1, 1, "tree", 0, "1/6")


@pytest.mark.parametrize("most", [10**6, 2])
def test_only_cycles(spark, most):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "x"), ("m", "n"), ("n", "hub"), ("a", "hub"), ("p", "q"), ("q", "p"), ("q", "a")]
    df = spark.createDataFrame(edges, "s string, t string")
    got = {(r.node, r.root, r.depth) for r in hierarchy(df, "s", "t", only_cycles=True, paths=False, peel_rounds=2, max_component=most).collect()}
    assert got == {("a", "a", -1), ("b", "a", -1), ("c", "a", -1), ("x", "x", -1), ("p", "p", -1), ("q", "p", -1)}


def test_empty_and_deep(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert hierarchy(none, "a", "b").count() == 0
    assert hierarchy(none, "a", "b", only_cycles=True).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(700)], "a long, b long")
    rows = hierarchy(chain, "a", "b", paths=False).agg(F.max("depth"), F.countDistinct("root")).first()
    assert tuple(rows) == (700, 1)
    few = hierarchy(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"), "a", "b")
    assert {(r.ancestor, r.descendant, r.distance) for r in descendants(few).collect()} == {(1, 2, 1), (1, 3, 2), (2, 3, 1)}


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(0, i) for i in range(100, 140)]
    find = {}

    def top(v):
        while find.setdefault(v, v) != v:
            v = find[v]
        return v

    for a, b in edges:
        x, y = top(a), top(b)
        find[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame([*edges, (None, 1)], "a long, b long"), "a", "b").collect()}
    assert got == {v: top(v) for v in find}


def test_flatten(spark):
    flow = {"root": {"name": "a", "children": [{"name": "b", "children": [None, {"name": "c"}]}, None, {"name": "d", "children": {"name": "e", "children": None}}]}}
    cfg = {"Blocks": [{"ID": 0, "Kind": "entry"}, None, {"ID": 1}], "Edges": {"From": 0, "To": 1, "Back": True}}
    trace = {"callers": [{"caller": "x", "callerLine": 3, "callee": "y"}]}
    rows = [
        (1, json.dumps(flow)), (2, json.dumps({"data": cfg, "ok": True})), (3, json.dumps([trace])), (4, json.dumps(json.dumps(trace))),
        (5, json.dumps(cfg)[:-3]), (6, ""), (7, None), (None, json.dumps(cfg)), (1, json.dumps(flow)), (8, "{}"), (9, "null"), (10, '"text"'),
    ]
    flat = flatten(spark.createDataFrame(rows, "record_id long, payload string").withColumn("entity", F.lit("clash")), "record_id", "payload")
    got = sorted((r.id, r.entity, r.seq, r.parent_seq) for r in flat.collect())
    assert got == [
        (1, "flow_node", 1, 0), (1, "flow_node", 2, 1), (1, "flow_node", 3, 2), (1, "flow_node", 4, 1), (1, "flow_node", 5, 4),
        (2, "block", 1, 0), (2, "block", 2, 0), (2, "edge", 1, 0), (3, "caller", 1, 0), (4, "caller", 1, 0),
    ]
    by = {(r.id, r.seq): r for r in flat.where("entity = 'flow_node'").collect()}
    assert by[1, 1].pre < by[1, 2].pre < by[1, 3].post < by[1, 2].post < by[1, 4].pre < by[1, 1].post
    assert tables(flat)["edges"].first().back == "back"
    assert flatten(spark.createDataFrame([], "record_id long, payload string"), "record_id", "payload").count() == 0


def test_flatten_keeps_the_fields_of_graphs_and_blocks(spark):
    block = {"ID": 0, "Kind": "cond", "Label": "l", "Cond": "x > 1", "Code": ["a()", "b()"], "Lines": [4, None, 6]}
    cfg = {"Function": "f", "File": "a.go", "Language": "go", "start_line": 3, "EndLine": 9, "EntryID": 0, "ExitID": 2, "Parent": "T", "Notes": ["n"], "Blocks": [block, {"ID": 2}], "Edges": []}
    df = spark.createDataFrame([(1, json.dumps([cfg, {"result": cfg}]))], "record_id long, payload string")
    got = {k: v.collect() for k, v in tables(flatten(df, "record_id", "payload", headers=True)).items()}
    b, bare = sorted(got["blocks"], key=lambda r: r.seq)[:2]
    assert (b.cond, b.code, b.lines) == ("x > 1", ["a()", "b()"], [4, 6]) and (bare.cond, bare.code, bare.lines) == (None, None, None)
    assert sorted((r.block_seq, r.at, r.line) for r in got["block_lines"]) == [(1, 0, 4), (1, 1, 6), (3, 0, 4), (3, 1, 6)]
    first, second = sorted(got["graphs"], key=lambda r: r.seq)
    assert tuple(first)[6:] == ("f", "a.go", 3, 9, 0, 2, "go", "T", ["n"]) and first.parent_seq == 0
    held = [[r.seq for r in got["blocks"] if g.pre < r.pre and r.post < g.post] for g in (first, second)]
    assert [sorted(h) for h in held] == [[1, 2], [3, 4]]
    assert [[r.seq for r in sorted(got["blocks"], key=lambda r: r.seq) if r.parent_pre == g.pre] for g in (first, second)] == [[1, 2], [3, 4]]
    assert [r.pre for r in got["records"]] == [first.parent_pre] == [second.parent_pre]
    assert flatten(df, "record_id", "payload").where("entity = 'graph'").isEmpty()


def test_labels_alone_link_rows():
    r = random.Random(3)
    for _ in range(30):
        clock, pre, post, up, stack = 0, [], [], [], []
        for _ in range(60):
            clock += 1
            if stack and r.random() < 0.45:
                post[stack.pop()] = clock
            else:
                up.append(stack[-1] if stack else -1)
                stack.append(len(pre))
                pre.append(clock)
                post.append(0)
        for i in reversed(stack):
            clock += 1
            post[i] = clock
        assert tightest(pre, post) == up


def test_odd_values_in_payloads(spark):
    deep = "[" * 200_000 + "]" * 200_000
    rows = [(1, '{"blocks": [{"id": NaN}]}'), (2, '{"blocks": [{"kind": ' + deep + ', "id": 1}]}'), (3, '{"blocks": [{"id": 9000000000, "lines": [5000000000]}]}'), (4, '{"trace": 1, "callers": [{"caller": "x"}], "symbol": {"name": "s"}}'), (5, '{"root": [{"name": "a"}, {"name": "b"}], "entryPoint": "a"}')]
    got = {(r.id, r.entity, r.seq): r for r in flatten(spark.createDataFrame(rows, "record_id long, payload string"), "record_id", "payload", headers=True).collect()}
    assert not [k for k in got if k[0] == 1]
    assert got[2, "block", 1].name == deep and got[2, "block", 1].src == 1
    assert got[3, "block", 1].src == 9_000_000_000 and got[3, "block", 1].lines == [5_000_000_000]
    assert got[4, "trace", 1].name == "s" and got[4, "caller", 1].parent_pre == got[4, "trace", 1].pre
    assert got[5, "flow", 1].name == "a" and got[5, "flow_node", 2].parent_seq == 0 and got[5, "flow_node", 2].parent_pre == got[5, "flow", 1].pre


def test_deep_json():
    text = '{"root":' + '{"name":"n","children":[' * 20000 + "]}" * 20000 + "}"
    assert len(entities(parse(text))) == 20000
    for t in ('{"a": [1, 2.5e3, "x\\"y", null, true], "b": {}}', "[]", '"s"', "3", '[{"a": []}]'):
        assert parse_deep(t) == json.loads(t)
    for t in ("{", '{"a" 1}', "[1,]", "[1 2]", '{"a":1,}', "1 2", "", '{"a":}', "]"):
        with pytest.raises(ValueError):
            parse_deep(t)
