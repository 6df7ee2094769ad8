"""Parent-child links to full hierarchies: path, depth, root, descendants, cycles.

Connected components are found by distributed rounds; each component goes to one
task, where an iterative depth-first traversal with node colouring labels it. A
component above ``max_component`` links is never gathered: it is solved by
distributed rounds instead (pointer doubling for roots, depths, paths and
numbers, colour propagation for cycles), with the same columns.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.operators.components import connected_components
from codequarry.session import cut

MAX_COMPONENT = 500_000  # links of a component that one task may hold


def solve_component(children: dict) -> list[tuple]:
    """(node, root, depth, state, pre, post, path) of one component's nodes.

    ``children`` has every node. state: ``tree``, ``cycle`` or ``below``. For a
    cycle the root is its smallest node and the depth -1; below a cycle root, path
    and numbers are null. A tree node that several parents share stands below the
    smallest of them; trees and children are numbered in ascending order.
    """
    nodes = sorted(children)
    kids = {n: sorted(set(children[n])) for n in nodes}
    index, low, on_stack, stack, cycle_of = {}, {}, set(), [], {}
    for start in nodes:  # white nodes; grey ones are on the stack; black ones are done
        if start in index:
            continue
        index[start] = low[start] = len(index)
        stack.append(start)
        on_stack.add(start)
        work = [(start, iter(kids[start]))]
        while work:
            n, it = work[-1]
            for c in it:
                if c not in index:
                    index[c] = low[c] = len(index)
                    stack.append(c)
                    on_stack.add(c)
                    work.append((c, iter(kids[c])))
                    break
                if c in on_stack:  # a back edge closes a cycle
                    low[n] = min(low[n], index[c])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[n])
                if low[n] == index[n]:
                    group = []
                    while True:
                        m = stack.pop()
                        on_stack.discard(m)
                        group.append(m)
                        if m == n:
                            break
                    if len(group) > 1 or n in kids[n]:
                        least = min(group)
                        for m in group:
                            cycle_of[m] = least
    below, work = set(), list(cycle_of)
    while work:
        for c in kids[work.pop()]:
            if c not in cycle_of and c not in below:
                below.add(c)
                work.append(c)
    up: dict = {}
    for n in nodes:
        for c in kids[n]:
            up.setdefault(c, n)  # nodes ascend: the smallest parent
    out = [(n, cycle_of[n], -1, "cycle", None, None, None) for n in nodes if n in cycle_of]
    out += [(n, None, None, "below", None, None, None) for n in nodes if n in below]
    clock = 0
    for root in nodes:
        if root in up:
            continue
        path: list = []
        work = [(root, True)]
        pre: dict = {}
        while work:
            n, enter = work.pop()
            clock += 1
            if not enter:
                out.append((n, root, len(path) - 1, "tree", pre[n], clock, list(path)))
                path.pop()
                continue
            pre[n] = clock
            path.append(n)
            work.append((n, False))
            work += [(c, True) for c in reversed(kids[n]) if up[c] == n and c not in cycle_of and c not in below]
    return out


def _solver(kind: pa.DataType, paths: bool):
    schema = pa.schema([("node", kind), ("root", kind), ("depth", pa.int32()), ("state", pa.string()), ("pre", pa.int64()), ("post", pa.int64()), ("path", pa.list_(kind))])

    def rows(children):
        solved = solve_component(children)
        return [(*r[:6], r[6] if paths else None) for r in solved]

    def run(batches):
        at, children, out = None, {}, []
        for batch in batches:
            for comp, node, child in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if comp != at:
                    if children:
                        out += rows(children)
                    at, children = comp, {}
                children.setdefault(node, [])
                if child is not None:
                    children[node].append(child)
                    children.setdefault(child, [])
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if children:
            out += rows(children)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def peel(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """Drop links that cannot be part of a cycle: their parent is nobody's child or
    their child nobody's parent. Each round takes away a layer at either end; without
    ``rounds`` it goes on until a round takes nothing."""
    e, n, done = links, None, 0
    while done != rounds:
        e = cut(e.join(e.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").join(e.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select("parent", "child"))
        done += 1
        if rounds is None:
            m = e.count()
            if m == n:
                break
            n = m
    return e


def _place(e: DataFrame) -> DataFrame:
    """``(node, component)`` of every end of the links ``(parent, child)``.

    Every node steps to its smallest parent, and steps double each round, so after a few
    rounds it stands at its root, or somewhere on or near a cycle, and takes the smallest
    node seen from there. Only links between different ones of these are left for
    connected components: where a node has several parents, and what rounds left open.
    """
    up = e.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("up"))
    nodes = e.select(F.col("parent").alias("node")).union(e.select("child")).distinct().join(up, "node", "left")
    at = F.coalesce("up", "node")
    j = cut(nodes.select("node", at.alias("at"), F.least("node", at).alias("low"), F.col("up").isNull().alias("top")))
    before = None
    while (open_ := j.where("not top").count()) > 0 and open_ != before:
        far = j.select(F.col("node").alias("at"), F.col("at").alias("far"), F.col("low").alias("less"), F.col("top").alias("end"))
        # a root steps to itself; who stands at one is at the top
        j = cut(j.join(far, "at").select("node", F.col("far").alias("at"), F.least("low", "less").alias("low"), (F.col("top") | F.col("end")).alias("top")))
        before = open_
    ring = j.select(F.col("node").alias("at"), F.col("low").alias("least"))
    named = cut(j.join(ring, "at").select("node", F.when(F.col("top"), F.col("at")).otherwise(F.col("least")).alias("name")))
    between = e.join(named.toDF("parent", "a"), "parent").join(named.toDF("child", "b"), "child").where("a != b").select("a", "b").distinct()
    joined = connected_components(between, "a", "b").toDF("name", "component")
    return named.join(joined, "name", "left").select("node", F.coalesce("component", "name").alias("component"))


def _cycles_by_colour(links: DataFrame) -> DataFrame:
    """``(node, root)`` of all nodes on cycles, by distributed rounds: the largest node
    that reaches a node is its colour; a colour's own node and what reaches it within
    the colour is one cycle group; what is left is coloured again."""
    own = links.where("parent = child").select(F.col("parent").alias("node"), F.col("parent").alias("top")).distinct()
    found = None
    rest = peel(links.where("parent != child"))
    while not rest.isEmpty():
        colour = cut(rest.select(F.col("parent").alias("node")).distinct().withColumn("top", F.col("node")))
        changed = 1
        while changed:
            best = rest.join(colour, rest.parent == colour.node).groupBy("child").agg(F.max("top").alias("new")).withColumnRenamed("child", "node")
            colour = cut(colour.join(best, "node", "left").select("node", F.greatest("top", F.coalesce("new", "top")).alias("top"), (F.coalesce("new", "top") > F.col("top")).cast("int").alias("moved")))
            changed = colour.agg(F.sum("moved")).first()[0]
            colour = colour.select("node", "top")
        same = cut(rest.join(colour.toDF("parent", "pt"), "parent").join(colour.toDF("child", "ct"), "child").where("pt = ct").select("parent", "child", "pt"))
        marked = cut(colour.where("node = top"))
        size = marked.count()
        while True:
            grown = same.join(marked.select(F.col("node").alias("child")), "child", "left_semi").select(F.col("parent").alias("node"), F.col("pt").alias("top"))
            marked = cut(marked.union(grown).distinct())
            if (m := marked.count()) == size:
                break
            size = m
        group = marked.join(marked.groupBy("top").count().where("count > 1").select("top"), "top", "left_semi").select("node", "top")
        found = group if found is None else found.union(group)
        gone = marked.select("node")
        rest = peel(rest.join(gone.toDF("parent"), "parent", "left_anti").join(gone.toDF("child"), "child", "left_anti"))
    every = own if found is None else found.union(own)
    # a self-loop inside a larger group adds no group of its own
    names = every.groupBy("top").agg(F.min("node").alias("least"))
    return cut(every.join(names, "top").groupBy("node").agg(F.min("least").alias("root")))


def _solve_distributed(nodes: DataFrame, links: DataFrame, paths: bool) -> DataFrame:
    """``(node, root, depth, state, pre, post, path)`` without gathering a component.

    ``nodes`` has ``(node, component)``. A tree's nodes double their steps up: the
    node ``steps`` above, the path down from it, and the number of nodes less than
    ``steps`` below, which a node at exactly ``steps`` above takes over.
    """
    kind = nodes.schema["node"].dataType.simpleString()
    cycles = _cycles_by_colour(links)
    plain = links.where("parent != child")
    reached = cut(cycles.select("node"))
    size = reached.count()
    while size:
        more = plain.join(reached.withColumnRenamed("node", "parent"), "parent", "left_semi").select(F.col("child").alias("node"))
        reached = cut(reached.union(more).distinct())
        if (m := reached.count()) == size:
            break
        size = m
    tree = nodes.join(reached, "node", "left_anti")
    up = plain.join(reached.withColumnRenamed("node", "child"), "child", "left_anti").groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("up"))
    first = cut(tree.join(up, "node", "left"))
    trail = F.array("node") if paths else F.lit(None).cast(f"array<{kind}>")  # from below the node above to the node
    jump = first.select("node", F.coalesce("up", "node").alias("root"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.lit(1).cast("long").alias("size"), trail.alias("trail"))
    steps = 1
    while True:
        below = jump.where(F.col("depth") == steps).groupBy(F.col("root").alias("node")).agg(F.sum("size").alias("add"))
        above = jump.select(F.col("root").alias("far"), F.col("node").alias("root"), F.col("depth").alias("more"), F.col("trail").alias("head"))
        longer = F.when(F.col("more") > 0, F.concat("head", "trail")).otherwise(F.col("trail"))
        nxt = jump.join(above, "root").select("node", F.col("far").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), "size", longer.alias("trail"))
        jump = cut(nxt.join(below, "node", "left").select("node", "root", "depth", (F.col("size") + F.coalesce("add", F.lit(0))).alias("size"), "trail"))
        steps *= 2
        if jump.where(F.col("depth") >= steps).isEmpty():
            break
    # a node enters two ticks a node of its smaller siblings (a root: of the smaller trees of its component) after its parent
    beside = Window.partitionBy("component", "up").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    late = first.join(jump.select("node", "size"), "node").select("node", "up", (1 + 2 * F.coalesce(F.sum("size").over(beside), F.lit(0))).alias("pre"))
    ticks = cut(late.select("node", F.col("up").alias("far"), "pre"))
    while not ticks.where("far is not null").isEmpty():
        nxt = ticks.join(ticks.toDF("far", "further", "more"), "far", "left").select("node", F.col("further").alias("far"), (F.col("pre") + F.coalesce("more", F.lit(0))).alias("pre"))
        ticks = cut(nxt)
    path = F.when(F.col("depth") > 0, F.concat(F.array("root"), "trail")).otherwise(F.col("trail"))
    rest = [F.lit(None).cast(c) for c in ("long", "long", f"array<{kind}>")]
    return (
        jump.join(ticks.select("node", "pre"), "node").select("node", "root", F.col("depth").cast("int").alias("depth"), F.lit("tree").alias("state"), "pre", (F.col("pre") + 2 * F.col("size") - 1).alias("post"), path.alias("path"))
        .union(cycles.select("node", "root", F.lit(-1), F.lit("cycle"), *rest))
        .union(reached.join(cycles, "node", "left_anti").select("node", F.lit(None), F.lit(None), F.lit("below"), *rest))
    )


def hierarchy(links: DataFrame, parent: str, child: str, nodes: DataFrame | None = None, node: str | None = None, *, paths: bool = True, only_cycles: bool = False, peel_rounds: int = 4, max_component: int = MAX_COMPONENT) -> DataFrame:
    """``(node, root, depth, state, pre, post, path)`` of every node.

    ``state`` is ``tree``, ``cycle`` (the node is among its own descendants; root is
    the smallest node of its cycle, depth -1) or ``below`` (reachable from a cycle;
    no root). ``pre`` and ``post`` number a tree's nodes so that a node's interval
    holds those of its descendants. Links with a null end are left out, repeats
    count once, and with ``nodes`` given so are links to ids that do not exist. A
    node that several parents share stands below the smallest of them, so its path
    is one of several and intervals count it once; ``reach`` has all its ancestors.
    Empty tables give an empty result; other columns are ignored.

    ``only_cycles`` lists cycle nodes only; links that cannot close a cycle are then
    peeled off first, so hubs that call nothing never join components. The result
    does not depend on ``max_component``.
    """
    kind = links.schema[parent].dataType
    e = links.select(F.col(parent).alias("parent"), F.col(child).cast(kind).alias("child")).where("parent is not null and child is not null").distinct()
    known = None
    if nodes is not None:
        known = nodes.select(F.col(node).cast(kind).alias("node")).where("node is not null").distinct()
        e = e.join(known.toDF("parent"), "parent", "left_semi").join(known.toDF("child"), "child", "left_semi").select("parent", "child")
    e = cut(e)
    if only_cycles:
        loops = e.where("parent = child")
        e = peel(e.where("parent != child"), peel_rounds).union(loops)
        known = e.select("parent").union(e.select("child")).distinct().toDF("node")
    elif known is None:
        known = e.select("parent").union(e.select("child")).distinct().toDF("node")
    comp = cut(_place(e))
    placed = e.join(comp.toDF("parent", "component"), "parent")
    large = cut(placed.groupBy("component").count().where(F.col("count") > max_component).select("component"))
    some_large = not large.isEmpty()
    small = placed.join(large, "component", "left_anti") if some_large else placed
    ends = small.select("component", "parent", "child")
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]
    t = kind.simpleString()
    schema = f"node {t}, root {t}, depth int, state string, pre long, post long, path array<{t}>"
    solved = ends.repartition("component").sortWithinPartitions("component").mapInArrow(_solver(arrow, paths), schema)
    if some_large:
        inside = comp.join(large, "component", "left_semi").select("node", "component")
        solved = solved.union(_solve_distributed(inside, placed.join(large, "component", "left_semi").select("parent", "child"), paths))
    if only_cycles:
        return solved.where("state = 'cycle'")
    alone = known.join(comp.select("node"), "node", "left_anti")
    path = F.array("node") if paths else F.lit(None).cast(f"array<{t}>")
    return solved.union(alone.select("node", F.col("node"), F.lit(0), F.lit("tree"), F.lit(1).cast("long"), F.lit(2).cast("long"), path))


def descendants(tree: DataFrame) -> DataFrame:
    """``(ancestor, descendant, distance)`` from the paths of ``hierarchy``: the pairs of
    one spanning tree. ``reach`` has those over all links."""
    return tree.where("path is not null").select(F.posexplode("path").alias("at", "ancestor"), F.col("node").alias("descendant"), "depth").where("ancestor != descendant").select("ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))


def reach(links: DataFrame, parent: str, child: str) -> DataFrame:
    """``(ancestor, descendant, distance)``: every pair of a node and one that it reaches,
    once, by the fewest links. A node on a cycle reaches itself.

    Reached distances double each round: pairs at exactly ``far`` links are joined with
    all pairs up to ``far``, so in a tree no pair is made twice. Null ends are left out.
    """
    e = links.select(F.col(parent).alias("ancestor"), F.col(child).alias("descendant")).where("ancestor is not null and descendant is not null").distinct()
    known = cut(e.withColumn("distance", F.lit(1)))
    far = 1
    while True:
        ends = known.where(F.col("distance") == far).select("ancestor", F.col("descendant").alias("mid"), F.col("distance").alias("before"))
        on = known.select(F.col("ancestor").alias("mid"), "descendant", "distance")
        new = ends.join(on, "mid").groupBy("ancestor", "descendant").agg(F.min(F.col("before") + F.col("distance")).alias("distance"))
        new = cut(new.join(known, ["ancestor", "descendant"], "left_anti"))
        if new.isEmpty():
            return known
        known = known.union(new)
        far *= 2
