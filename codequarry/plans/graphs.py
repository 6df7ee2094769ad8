"""Queries on parent-child links and nested results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators.flatten import flatten
from codequarry.operators.hierarchy import hierarchy, reach
from codequarry.session import cut, read_table


def _flow_links(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    nodes = read_table(spark, sf, "flow_nodes")
    links = nodes.select("node_id", F.explode("children").alias("child_id"))
    return links.join(nodes.select(F.col("node_id").alias("child_id")).distinct(), "child_id", "left_semi").select("node_id", "child_id"), nodes


def _flow(spark: SparkSession, sf: str, paths: bool) -> DataFrame:
    links, nodes = _flow_links(spark, sf)
    return hierarchy(links, "node_id", "child_id", nodes, "node_id", paths=paths)


def _call_links(spark: SparkSession, sf: str) -> DataFrame:
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return read_table(spark, sf, "call_edges").select(trim("caller").alias("caller"), trim("callee").alias("callee")).where("caller != '' and callee != ''")


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy(_call_links(spark, sf), "caller", "callee", paths=False, only_cycles=True)


def _above_trees(links: DataFrame, parent: str, child: str, tree: DataFrame) -> DataFrame:
    """Pairs whose descendant is neither on nor below a cycle: all its ancestors are such nodes too."""
    inside = tree.where("state = 'tree'").select(F.col("node").alias(child))
    return reach(links.join(inside, child, "left_semi"), parent, child)


def _with_counts(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """The columns of a path query; ``n_descendants`` counts distinct nodes, however many parents they have."""
    n = pairs.groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("n"))
    count = F.coalesce("n", F.when(F.col("state") == "tree", F.lit(0).cast("long")))
    return tree.join(n, "node", "left").select("node", "root", "depth", "state", count.alias("n_descendants"), F.concat_ws("/", F.transform("path", lambda x: x.cast("string"))).alias("path"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Root and depth of every flow node not below a cycle, and all functions on call cycles."""
    flow = _flow(spark, sf, False).where("state != 'below'").select(F.lit("flow").alias("source"), F.col("node").cast("string").alias("node"), F.col("root").cast("string").alias("root"), "depth")
    return flow.union(_calls(spark, sf).select(F.lit("call"), "node", "root", "depth"))


def p5_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Full path, depth, root and number of descendants of every flow node; only descendants
    neither on nor below a cycle count. ``p5_flow_paths`` counts all."""
    links, _ = _flow_links(spark, sf)
    t = cut(_flow(spark, sf, True))
    return _with_counts(t, _above_trees(links, "node_id", "child_id", t))


def p5_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of a flow node and one of its descendants, both neither on nor below a cycle;
    ``p5_flow_descendants`` has all pairs."""
    links, _ = _flow_links(spark, sf)
    return _above_trees(links, "node_id", "child_id", cut(_flow(spark, sf, False)))


def p5_flow_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The same with all descendants counted, of every node: those on or below a cycle have no
    path, but descendants, and are some of the nodes above them."""
    links, _ = _flow_links(spark, sf)
    t = cut(_flow(spark, sf, True))
    return _with_counts(t, reach(links, "node_id", "child_id")).withColumn("n_descendants", F.coalesce("n_descendants", F.lit(0)))


def p5_flow_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of a flow node and one of its descendants, with the fewest links between them;
    a node on a cycle is among its own."""
    links, _ = _flow_links(spark, sf)
    return reach(links, "node_id", "child_id")


def p5_call_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Path (by the smallest caller at each step), depth, root and number of distinct functions
    below every function; those on or below a cycle have no path, but all their descendants count."""
    links = _call_links(spark, sf)
    return _with_counts(cut(hierarchy(links, "caller", "callee")), reach(links, "caller", "callee")).withColumn("n_descendants", F.coalesce("n_descendants", F.lit(0)))


def p5_call_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of a function and one that it calls over any number of calls, with the fewest
    calls between them; a function on a cycle calls itself."""
    return reach(_call_links(spark, sf), "caller", "callee")


def p7_flat(spark: SparkSession, sf: str) -> DataFrame:
    """All flat rows of all payloads, with a row per control-flow graph."""
    return flatten(read_table(spark, sf, "raw_results"), "record_id", "payload", headers=True).withColumnRenamed("id", "record_id")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Key and parent of every object of every payload."""
    return flatten(read_table(spark, sf, "raw_results"), "record_id", "payload").select(F.col("id").alias("record_id"), "entity", "seq", "parent_seq")


QUERIES = {f.__name__: f for f in (p5_found, p5_paths, p5_descendants, p5_flow_paths, p5_flow_descendants, p5_call_paths, p5_call_descendants, p7_found, p7_flat)}

_FLOW_REACH = """
    WITH RECURSIVE n AS (SELECT node_id, any_value(children) AS children FROM flow_nodes GROUP BY node_id),
    e AS (SELECT DISTINCT a, b FROM (SELECT node_id AS a, unnest(children) AS b FROM n) WHERE b IN (SELECT node_id FROM n)),
    r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    c AS (SELECT x.a AS node, min(x.b) AS root FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
    low AS (SELECT DISTINCT r.b AS node FROM r JOIN c ON r.a = c.node),
    up AS (SELECT r.b AS node, count(*) AS depth, min(r.a) FILTER (r.a NOT IN (SELECT b FROM e)) AS root FROM r GROUP BY r.b)"""

ORACLE_SQL = {
    "p5_found": _FLOW_REACH
    + """,
    k AS (SELECT DISTINCT trim(caller, E' \\t\\n\\r') AS a, trim(callee, E' \\t\\n\\r') AS b FROM call_edges
          WHERE trim(caller, E' \\t\\n\\r') <> '' AND trim(callee, E' \\t\\n\\r') <> ''),
    q AS (SELECT a, b FROM k WHERE b IN (SELECT a FROM k) UNION SELECT q.a, k.b FROM q JOIN k ON q.b = k.a WHERE k.b IN (SELECT a FROM k)),
    d AS (SELECT x.a AS node, min(x.b) AS root FROM q x JOIN q y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
    SELECT 'flow' AS source, node::VARCHAR AS node, root::VARCHAR AS root, -1 AS depth FROM c
    UNION ALL SELECT 'flow', n.node_id::VARCHAR, coalesce(up.root, n.node_id)::VARCHAR, coalesce(up.depth, 0)::INT
      FROM n LEFT JOIN up ON up.node = n.node_id WHERE n.node_id NOT IN (SELECT node FROM low) AND n.node_id NOT IN (SELECT node FROM c)
    UNION ALL SELECT 'call', node, root, -1 FROM d""",
    "p5_paths": _FLOW_REACH
    + """,
    w AS (SELECT node_id AS node, node_id::VARCHAR AS path FROM n WHERE node_id NOT IN (SELECT b FROM e) AND node_id NOT IN (SELECT node FROM c)
          UNION ALL SELECT e.b, w.path || '/' || e.b FROM w JOIN e ON e.a = w.node WHERE e.b NOT IN (SELECT node FROM c) AND e.b NOT IN (SELECT node FROM low)),
    k AS (SELECT r.a AS node, count(*) AS n FROM r WHERE r.b NOT IN (SELECT node FROM c) AND r.b NOT IN (SELECT node FROM low) GROUP BY r.a)
    SELECT w.node, split_part(w.path, '/', 1)::BIGINT AS root, (strlen(w.path) - strlen(replace(w.path, '/', '')))::INT AS depth, 'tree' AS state, coalesce(k.n, 0) AS n_descendants, w.path
      FROM w LEFT JOIN k USING (node)
    UNION ALL SELECT node, root, -1, 'cycle', NULL, '' FROM c
    UNION ALL SELECT node, NULL, NULL, 'below', NULL, '' FROM low WHERE node NOT IN (SELECT node FROM c)""",
    "p5_descendants": _FLOW_REACH
    + """
    SELECT r.a AS ancestor, r.b AS descendant, (coalesce(x.depth, 0) - coalesce(y.depth, 0))::INT AS distance
    FROM r LEFT JOIN up x ON x.node = r.b LEFT JOIN up y ON y.node = r.a
    WHERE r.b NOT IN (SELECT node FROM low) AND r.b NOT IN (SELECT node FROM c)""",
    "p5_flow_paths": _FLOW_REACH
    + """,
    w AS (SELECT node_id AS node, node_id::VARCHAR AS path FROM n WHERE node_id NOT IN (SELECT b FROM e) AND node_id NOT IN (SELECT node FROM c)
          UNION ALL SELECT e.b, w.path || '/' || e.b FROM w JOIN e ON e.a = w.node WHERE e.b NOT IN (SELECT node FROM c) AND e.b NOT IN (SELECT node FROM low)),
    k AS (SELECT a AS node, count(*) AS n FROM r GROUP BY a),
    t AS (SELECT node, split_part(path, '/', 1)::BIGINT AS root, (strlen(path) - strlen(replace(path, '/', '')))::INT AS depth, 'tree' AS state, path FROM w
          UNION ALL SELECT node, root, -1, 'cycle', '' FROM c
          UNION ALL SELECT node, NULL, NULL, 'below', '' FROM low WHERE node NOT IN (SELECT node FROM c))
    SELECT t.node, root, depth, state, coalesce(k.n, 0) AS n_descendants, path FROM t LEFT JOIN k ON k.node = t.node""",
    "p5_flow_descendants": """
    WITH RECURSIVE n AS (SELECT node_id, any_value(children) AS children FROM flow_nodes GROUP BY node_id),
    e AS (SELECT DISTINCT a, b FROM (SELECT node_id AS a, unnest(children) AS b FROM n) WHERE b IN (SELECT node_id FROM n)),
    s(a, b, d) USING KEY (a, b) AS (SELECT a, b, 1 FROM e UNION SELECT s.a, e.b, s.d + 1 FROM s JOIN e ON e.a = s.b
      WHERE NOT EXISTS (SELECT 1 FROM recurring.s AS o WHERE o.a = s.a AND o.b = e.b))
    SELECT a AS ancestor, b AS descendant, d AS distance FROM s""",
}
