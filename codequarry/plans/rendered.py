"""Queries over source files written from ``flow_nodes``: a Go file for every node.

A node is a function that calls its children by name. A root also has a ``main`` that calls
it, an inner node of three parts or more is run by a command, a leaf is a route's handler.
So what traces, packages and entry points must find is known from the table, and SQL says it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.functions import scalars as x
from codequarry.operators import architecture as arch
from codequarry.operators import prompting, symbols, trace
from codequarry.operators.controlflow import graph_table
from codequarry.operators.symbols import symbol_table
from codequarry.plans import pipelines
from codequarry.session import cut, read_table


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    """``(node_id, repo, name, dir, root, parts)``: parts are ``(id, name)`` of existing children in order."""
    n = read_table(spark, sf, "flow_nodes").dropDuplicates(["node_id"])
    links = n.select("node_id", F.posexplode("children").alias("pos", "child")).where("child is not null")
    named = links.join(n.select(F.col("node_id").alias("child"), F.col("name").alias("child_name")), "child")
    parts = named.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("child").alias("id"), F.col("child_name").alias("name")))).alias("parts"))
    inner = named.select(F.col("child").alias("node_id")).distinct().withColumn("inner", F.lit(True))
    none = F.array().cast("array<struct<pos:int,id:bigint,name:string>>")
    return n.join(parts, "node_id", "left").join(inner, "node_id", "left").select("node_id", "repo", "name", F.when(F.col("file_path").isNull(), "none").otherwise(x.directory(F.col("file_path"))).alias("dir"), F.col("inner").isNull().alias("root"), F.coalesce("parts", none).alias("parts"))


def files(spark: SparkSession, sf: str) -> DataFrame:
    """``(node_id, path, content)``."""
    own, name = F.col("node_id").cast("string"), F.col("name")
    calls = F.concat_ws("", F.transform("parts", lambda p: F.concat(F.lit("\t"), p["name"], F.lit("()\n"))))
    tail = (
        F.when(F.col("root"), F.concat(F.lit("\nfunc main() {\n\t"), name, F.lit("()\n}\n")))
        .when(F.size("parts") == 0, F.concat(F.lit('\nvar route = mux.HandleFunc("/n'), own, F.lit('", '), name, F.lit(")\n")))
        .when(F.size("parts") >= 3, F.concat(F.lit('\nvar cmd = &Command{\n\tUse: "'), name, F.lit(' [x]",\n\tRunE: '), name, F.lit(",\n}\n")))
        .otherwise("")
    )
    text = F.concat(F.lit("package "), F.when(F.col("root"), "main").otherwise("part"), F.lit('\n\nimport (\n\t"host/'), "dir", F.lit('"\n)\n\n// '), name, F.lit(" runs its parts\nfunc "), name, F.lit("() {\n"), calls, F.lit("}\n"), tail)
    return _nodes(spark, sf).select("node_id", F.concat("repo", F.lit("/n"), own, F.lit(".go")).alias("path"), text.alias("content"))


def _symbols(spark, sf):
    return symbol_table(files(spark, sf), "path", "content")


def _lines(spark, sf):
    return trace.lines_table(files(spark, sf), "path", "content")


def _edges(spark, sf):
    return trace.call_edges(_lines(spark, sf), _symbols(spark, sf))


def _written(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Symbols and lines of files that are written once. A query that reads them several times
    would otherwise plan the files' joins each time, and the driver has to hold that plan."""
    f = cut(files(spark, sf))
    return symbol_table(f, "path", "content"), trace.lines_table(f, "path", "content")


def _shared_name(spark: SparkSession, sf: str) -> str:
    """The name that most nodes share, the smallest of several."""
    row = read_table(spark, sf, "flow_nodes").groupBy("name").agg(F.countDistinct("node_id").alias("n")).orderBy(F.desc("n"), "name").first()
    return row.name if row else ""


def s9_lines(spark, sf):
    """Lines of every file, counted with their bytes."""
    return _lines(spark, sf).groupBy("path").agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("text")).alias("n_bytes"))


def f5_candidates(spark, sf):
    """Functions of the name that most files share."""
    return symbols.find_candidates(_symbols(spark, sf), _shared_name(spark, sf), ["function"], language="GO").select("name", "path", "start_line", "end_line")


def f8_functions(spark, sf):
    """The same among languages with control flow, by a part of the path."""
    return symbols.find_functions(_symbols(spark, sf), _shared_name(spark, sf), file_part="/n").select("path", "start_line")


def f10_functions_of_packages(spark, sf):
    s = _symbols(spark, sf).where(F.col("narrow_kind") == "function")
    return s.groupBy(x.directory(F.col("path")).alias("dir")).agg(F.count("*").alias("n_functions"))


def f9_listed_symbols(spark, sf):
    """First fifty functions with a part in their name, and how many more there are."""
    f = files(spark, sf)
    rows, more = pipelines.Tools(spark, f, f).symbols("function", "ROSTER", 50)
    return rows.select("name", "path", "start_line", F.lit(more).alias("n_more"))


def j9_call_edges(spark, sf):
    """Call sites of known functions inside known functions."""
    return _edges(spark, sf).select("caller", "caller_file", "caller_line", "callee")


def j10_resolved_calls(spark, sf):
    """Calls with the file of their callee: the only definition, or the only one of the folder."""
    return trace.resolve_names(_edges(spark, sf), _symbols(spark, sf)).select("caller_file", "caller_line", "callee", "callee_file", "callee_line")


def g13_callers_of(spark, sf):
    return trace.callers_of(_edges(spark, sf), _shared_name(spark, sf)).select("caller", "caller_file", "caller_line")


def g14_callees_of(spark, sf):
    """Distinct callees of every name that is shared most, with the first call's place."""
    return trace.callees_of(_edges(spark, sf), _shared_name(spark, sf)).select("callee", "caller_file", "caller_line")


def g16_full_trace(spark, sf):
    """Definitions, references, callers and callees of one name, as places."""
    name, (found, lines) = _shared_name(spark, sf), _written(spark, sf)
    found = cut(found)
    near = cut(trace.call_edges(lines, found).where((F.col("caller") == name) | (F.col("callee") == name)))  # callers and callees in one pass
    t = trace.full_trace(name, found, lines, near)
    rows = [t["definition"].select(F.lit("definition").alias("part"), "path", F.col("start_line").alias("line")), t["references"].select(F.lit("reference"), "path", "line")]
    rows += [t[p + "s"].select(F.lit(p), F.col("caller_file"), F.col("caller_line")) for p in ("caller", "callee")]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.distinct()


def r9_first_references(spark, sf):
    """What the trace tool lists: the first definition and the first twenty references."""
    f = files(spark, sf)
    t = pipelines.Tools(spark, f, f).trace(_shared_name(spark, sf))
    return t["definition"].select(F.lit("definition").alias("part"), "path", F.col("start_line").alias("line")).union(t["references"].select(F.lit("reference"), "path", "line"))


def a3_packages(spark, sf):
    p = arch.packages(files(spark, sf), "path", "content")
    return p.select("dir", "n_files", "n_lines", F.concat_ws(",", "files").alias("files"))


def a4_kinds_per_package(spark, sf):
    return arch.kinds_per_package(_symbols(spark, sf)).select("dir", "functions", "types", "interfaces")


def a18_reports(spark, sf):
    """A line of figures for every package."""
    f = files(spark, sf)
    p = arch.packages(f, "path", "content").join(arch.kinds_per_package(symbol_table(f, "path", "content")), "dir", "left").fillna(0, ["functions", "types", "interfaces"])
    return arch.package_report(p)


def r8_report_symbols(spark, sf):
    """First thirty functions of every package in file order."""
    return arch.report_symbols(_symbols(spark, sf))


def f12_large_packages(spark, sf):
    return arch.large_packages(arch.packages(files(spark, sf), "path", "content"), 40).select("dir", "n_files")


def i6_code_map(spark, sf):
    """Totals of the code map."""
    return pipelines.code_map(files(spark, sf))["totals"]


def g11_imports(spark, sf):
    """Imports between packages, out of import blocks."""
    return arch.import_edges(_lines(spark, sf))


def g11c_package_names(spark, sf):
    return files(spark, sf).select("path", arch.package_name(F.col("path"), F.col("content")).alias("package"))


def g1_entry_points(spark, sf):
    """Entry functions, command and route handlers."""
    return arch.entry_points(*_written(spark, sf)).select("name", "path", "line", "kind", "label")


def r7_entry_point_order(spark, sf):
    """Their order in a list."""
    e = arch.order_entry_points(arch.entry_points(*_written(spark, sf)))
    w = Window.orderBy("_i")  # the list that a report shows, already sorted
    return e.withColumn("_i", F.monotonically_increasing_id()).select("name", "path", F.row_number().over(w).alias("position"))


def j15_function_context(spark, sf):
    """Head, declarations and signatures around the function with most parts."""
    n = _nodes(spark, sf).orderBy(F.desc(F.size("parts")), "node_id").select(F.concat("repo", F.lit("/n"), F.col("node_id").cast("string"), F.lit(".go")).alias("path")).first()
    c = prompting.function_context(_symbols(spark, sf), _lines(spark, sf), n.path if n else "", 8, max_callees=1000)
    return c["header"].select(F.lit("header").alias("part"), "line", "text").union(c["callees"].select(F.lit("callee"), "start_line", "name"))


def _decided(spark, sf):
    """Functions that ask before each part: ``(node_id, source)``."""
    own = lambda p: p["id"].cast("string")
    body = F.concat_ws("", F.transform("parts", lambda p: F.concat(F.lit("\tif c"), own(p), F.lit(" {\n\t\tn"), own(p), F.lit("()\n\t}\n"))))
    return _nodes(spark, sf).select("node_id", F.concat(F.lit("f"), F.col("node_id").cast("string")).alias("name"), F.lit("go").alias("language"), F.lit(1).alias("line"), F.concat(F.lit("func f() {\n"), body, F.lit("}")).alias("source"))


def g17_graph_sizes(spark, sf):
    """Blocks, edges and paths of every function."""
    g = graph_table(_decided(spark, sf), "node_id", "name", "language", "source", "line")
    n = lambda p: F.count_if(F.col("part") == p)
    return g.groupBy(F.col("id").cast("long").alias("node_id")).agg(n("block").alias("n_blocks"), n("edge").alias("n_edges"), n("path").alias("n_paths"), F.count_if("back").alias("n_back"))


def g18_branches(spark, sf):
    """Condition and line of every branch."""
    g = graph_table(_decided(spark, sf), "node_id", "name", "language", "source", "line").where("part = 'block' and kind = 'branch'")
    return g.select(F.col("id").cast("long").alias("node_id"), "cond", F.col("lines")[0].alias("line"))


def g20_first_decisions(spark, sf):
    """Decisions along the first path of every function."""
    g = graph_table(_decided(spark, sf), "node_id", "name", "language", "source", "line").where("part = 'path' and seq = 0")
    return g.select(F.col("id").cast("long").alias("node_id"), F.concat_ws("; ", "decisions").alias("decisions"))


def i1_indexed_documents(spark, sf):
    """Documents after indexing all files into an empty store: text hash, first chunk and its line."""
    f = files(spark, sf).select("path", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("mod_time"), "content")
    docs, chunks, _ = pipelines.index_files(f, spark.createDataFrame([], pipelines.DOCUMENTS), spark.createDataFrame([], pipelines.CHUNKS))
    first = chunks.where(F.col("chunk_id") == F.concat("file_path", F.lit("_0"))).select(F.col("file_path").alias("path"), "start_line", "content_hash")
    return docs.join(first, "path").select("path", "hash", F.col("chunk_ids")[0].alias("first_chunk"), "start_line")


def a15_index_statistics(spark, sf):
    """Files indexed, skipped and removed by a second run after a third of the store went stale."""
    f = files(spark, sf).select("path", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("mod_time"), "content")
    stale = F.when(F.col("path").startswith("lib/"), F.lit("old")).otherwise(x.sha256_hex(F.col("content")))
    known = f.select("path", stale.alias("hash"), "mod_time", F.array().cast("array<string>").alias("chunk_ids"))
    gone = spark.createDataFrame([("gone.go", "x", None, [])], pipelines.DOCUMENTS)
    _, _, counts = pipelines.index_files(f, known.unionByName(gone), spark.createDataFrame([], pipelines.CHUNKS))
    return spark.createDataFrame([(counts["indexed"], counts["skipped"], counts["removed"])], "indexed long, skipped long, removed long")


QUERIES = {
    f.__name__: f
    for f in (
        s9_lines, f5_candidates, f8_functions, f9_listed_symbols, f10_functions_of_packages, j9_call_edges, j10_resolved_calls, g13_callers_of, g14_callees_of, g16_full_trace,
        r9_first_references, a3_packages, a4_kinds_per_package, a18_reports, r8_report_symbols, f12_large_packages, i6_code_map, g11_imports, g11c_package_names,
        g1_entry_points, r7_entry_point_order, j15_function_context, g17_graph_sizes, g18_branches, g20_first_decisions, i1_indexed_documents, a15_index_statistics,
    )
}

_N = r"""n0 AS (SELECT node_id, any_value(repo) AS repo, any_value(name) AS name, any_value(file_path) AS fp, any_value(children) AS children FROM flow_nodes GROUP BY node_id),
    x0 AS (SELECT node_id, unnest(children) AS child, unnest(range(1, len(children) + 1)) AS pos FROM n0),
    e0 AS (SELECT x0.node_id, n0.name AS callee, x0.child, row_number() OVER (PARTITION BY x0.node_id ORDER BY pos)::INT AS k FROM x0 JOIN n0 ON n0.node_id = x0.child),
    d0 AS (SELECT node_id, count(*)::INT AS k FROM e0 GROUP BY node_id),
    n AS (SELECT n0.node_id, repo, name, coalesce(CASE WHEN contains(fp, '/') THEN regexp_extract(fp, '^(.*)/[^/]*$', 1) WHEN fp IS NOT NULL THEN '.' END, 'none') AS dir,
          n0.node_id NOT IN (SELECT child FROM e0) AS root, coalesce(d0.k, 0) AS k, repo || '/n' || n0.node_id || '.go' AS path FROM n0 LEFT JOIN d0 ON d0.node_id = n0.node_id),
    c AS (SELECT n.node_id, 'package ' || CASE WHEN root THEN 'main' ELSE 'part' END || chr(10) || chr(10) || 'import (' || chr(10) || chr(9) || '"host/' || dir || '"' || chr(10) || ')' || chr(10) || chr(10)
          || '// ' || name || ' runs its parts' || chr(10) || 'func ' || name || '() {' || chr(10)
          || coalesce((SELECT string_agg(chr(9) || callee || '()' || chr(10), '' ORDER BY e0.k) FROM e0 WHERE e0.node_id = n.node_id), '') || '}' || chr(10)
          || CASE WHEN root THEN chr(10) || 'func main() {' || chr(10) || chr(9) || name || '()' || chr(10) || '}' || chr(10)
                  WHEN k = 0 THEN chr(10) || 'var route = mux.HandleFunc("/n' || node_id || '", ' || name || ')' || chr(10)
                  WHEN k >= 3 THEN chr(10) || 'var cmd = &Command{' || chr(10) || chr(9) || 'Use: "' || name || ' [x]",' || chr(10) || chr(9) || 'RunE: ' || name || ',' || chr(10) || '}' || chr(10) ELSE '' END AS content FROM n),
    e AS (SELECT n.name AS caller, n.path AS caller_file, 8 + e0.k AS caller_line, callee FROM e0 JOIN n USING (node_id) WHERE callee <> n.name
          UNION ALL SELECT 'main', path, 12 + k, name FROM n WHERE root),
    defs AS (SELECT name, path, repo, 8 AS line FROM n UNION ALL SELECT 'main', path, repo, 11 + k FROM n WHERE root),
    one AS (SELECT name FROM n0 GROUP BY name ORDER BY count(*) DESC, name LIMIT 1)"""
_W = f"WITH {_N} "
_REFS = "SELECT path, l.line FROM c JOIN n USING (node_id), (SELECT node_id, unnest(string_split(content, chr(10))) AS t, unnest(range(1, len(string_split(content, chr(10))) + 1))::INT AS line FROM c) l WHERE l.node_id = c.node_id AND regexp_matches(t, '\\b' || (SELECT name FROM one) || '\\b')"
_ENTRY = """first AS (SELECT name, min(path) AS path FROM defs GROUP BY name),
    ep AS (SELECT 'main' AS name, path, 11 + k AS line, 'main' AS kind, 'main' AS label FROM n WHERE root
           UNION ALL SELECT DISTINCT name, first.path, 8, 'command', name FROM n JOIN first USING (name) WHERE NOT root AND k >= 3
           UNION ALL SELECT DISTINCT name, first.path, 8, 'handler', name FROM n JOIN first USING (name) WHERE NOT root AND k = 0 AND name NOT IN (SELECT name FROM n WHERE NOT root AND k >= 3))"""
_FUNCS = "fs AS (SELECT repo AS dir, path, name, 1 AS o FROM n UNION ALL SELECT repo, path, 'main', 2 FROM n WHERE root)"

ORACLE_SQL = {
    "s9_lines": _W + "SELECT path, 1 + strlen(content) - strlen(replace(content, chr(10), '')) AS n_lines, strlen(replace(content, chr(10), '')) AS n_bytes FROM c JOIN n USING (node_id)",
    "f5_candidates": _W + "SELECT name, path, 8 AS start_line, 9 + k AS end_line FROM n WHERE name IN (SELECT name FROM one)",
    "f8_functions": _W + "SELECT path, 8 AS start_line FROM n WHERE name IN (SELECT name FROM one)",
    "f9_listed_symbols": _W + """, h AS (SELECT name, path, line AS start_line FROM defs WHERE contains(lower(name), 'roster'))
        SELECT *, greatest(0, (SELECT count(*) FROM h) - 50)::INT AS n_more FROM h ORDER BY path, start_line LIMIT 50""",
    "f10_functions_of_packages": _W + "SELECT repo AS dir, count(*) AS n_functions FROM defs GROUP BY repo",
    "j9_call_edges": _W + "SELECT caller, caller_file, caller_line, callee FROM e",
    "j10_resolved_calls": _W + """, g AS (SELECT name, count(*) AS n, min(path) AS p, min(line) AS l FROM defs GROUP BY name), h AS (SELECT name, repo, count(*) AS n, min(path) AS p, min(line) AS l FROM defs GROUP BY 1, 2)
        SELECT caller_file, caller_line, callee, CASE WHEN g.n = 1 THEN g.p ELSE h.p END AS callee_file, CASE WHEN g.n = 1 THEN g.l ELSE h.l END AS callee_line
        FROM e JOIN g ON g.name = callee LEFT JOIN h ON h.name = callee AND h.repo = regexp_extract(caller_file, '^(.*)/[^/]*$', 1) WHERE g.n = 1 OR h.n = 1""",
    "g13_callers_of": _W + "SELECT caller, caller_file, caller_line FROM e WHERE callee IN (SELECT name FROM one)",
    "g14_callees_of": _W + "SELECT callee, min_by(caller_file, (caller_file, caller_line)) AS caller_file, min_by(caller_line, (caller_file, caller_line)) AS caller_line FROM e WHERE caller IN (SELECT name FROM one) GROUP BY callee",
    "g16_full_trace": _W + f"""SELECT 'definition' AS part, path, 8 AS line FROM n WHERE name IN (SELECT name FROM one) UNION SELECT 'reference', * FROM ({_REFS})
        UNION SELECT 'caller', caller_file, caller_line FROM e WHERE callee IN (SELECT name FROM one)
        UNION SELECT 'callee', f, l FROM (SELECT min_by(caller_file, (caller_file, caller_line)) AS f, min_by(caller_line, (caller_file, caller_line)) AS l FROM e WHERE caller IN (SELECT name FROM one) GROUP BY callee)""",
    "r9_first_references": _W + f"""SELECT 'definition' AS part, min(path) AS path, 8 AS line FROM n WHERE name IN (SELECT name FROM one)
        UNION ALL SELECT 'reference', * FROM (SELECT * FROM ({_REFS}) ORDER BY path, line LIMIT 20)""",
    "a3_packages": _W + """SELECT repo AS dir, count(*) AS n_files, sum(1 + strlen(content) - strlen(replace(content, chr(10), '')))::BIGINT AS n_lines, string_agg('n' || n.node_id || '.go', ',' ORDER BY 'n' || n.node_id || '.go') AS files
        FROM n JOIN c USING (node_id) GROUP BY repo""",
    "a4_kinds_per_package": _W + "SELECT repo AS dir, count(*) AS functions, 0::BIGINT AS types, 0::BIGINT AS interfaces FROM defs GROUP BY repo",
    "a18_reports": _W + """, p AS (SELECT repo, count(*) AS f, sum(1 + strlen(content) - strlen(replace(content, chr(10), '')))::BIGINT AS l FROM n JOIN c USING (node_id) GROUP BY repo), q AS (SELECT repo, count(*) AS k FROM defs GROUP BY repo)
        SELECT repo AS dir, repo || ': ' || f || ' files, ' || l || ' lines, ' || k || ' functions' AS text FROM p JOIN q USING (repo)""",
    "r8_report_symbols": _W + f""", {_FUNCS}, r AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY path, o)::INT AS position FROM fs) SELECT dir, position, name, 'function' AS kind FROM r WHERE position <= 30""",
    "f12_large_packages": _W + "SELECT repo AS dir, count(*) AS n_files FROM n GROUP BY repo HAVING count(*) >= 40",
    "i6_code_map": _W + "SELECT count(*)::BIGINT AS n_files, sum(1 + strlen(content) - strlen(replace(content, chr(10), '')))::BIGINT AS n_lines, count(DISTINCT repo) AS n_packages FROM n JOIN c USING (node_id)",
    "g11_imports": _W + """, i AS (SELECT DISTINCT repo AS from_pkg, string_split('host/' || dir, '/') AS s FROM n)
        SELECT DISTINCT from_pkg, array_to_string(s[greatest(1, len(s) - 1):], '/') AS to_pkg FROM i WHERE from_pkg <> array_to_string(s[greatest(1, len(s) - 1):], '/')""",
    "g11c_package_names": _W + "SELECT path, CASE WHEN root THEN 'main' ELSE 'part' END AS package FROM n",
    "g1_entry_points": _W + f", {_ENTRY} SELECT * FROM ep",
    "r7_entry_point_order": _W + f", {_ENTRY} SELECT name, path, row_number() OVER (ORDER BY CASE kind WHEN 'main' THEN 0 WHEN 'command' THEN 1 ELSE 2 END, name, path)::INT AS position FROM ep",
    "j15_function_context": _W + """, me AS (SELECT * FROM n ORDER BY k DESC, node_id LIMIT 1),
        l AS (SELECT unnest(string_split(content, chr(10))) AS text, unnest(range(1, len(string_split(content, chr(10))) + 1))::INT AS line FROM c WHERE node_id IN (SELECT node_id FROM me)),
        cs AS (SELECT name, min(path) AS path FROM n WHERE name IN (SELECT callee FROM e0 JOIN me USING (node_id) WHERE callee <> me.name) GROUP BY name)
        SELECT 'header' AS part, line, text FROM l WHERE line < 8 UNION ALL SELECT 'callee', 8, name FROM cs""",
    "g17_graph_sizes": _W + "SELECT node_id, 2 + 2 * k::BIGINT AS n_blocks, 1 + 3 * k::BIGINT AS n_edges, least(64, pow(2, k))::BIGINT AS n_paths, 0::BIGINT AS n_back FROM n",
    "g18_branches": _W + "SELECT node_id, 'c' || child AS cond, 2 + 3 * (k - 1) AS line FROM e0",
    "g20_first_decisions": _W + "SELECT n.node_id, coalesce((SELECT string_agg('if c' || child || ' = true', '; ' ORDER BY e0.k) FROM e0 WHERE e0.node_id = n.node_id), '') AS decisions FROM n",
    "i1_indexed_documents": _W + "SELECT path, sha256(content) AS hash, path || '_0' AS first_chunk, 1 AS start_line FROM n JOIN c USING (node_id)",
    "a15_index_statistics": _W + "SELECT count(*) FILTER (starts_with(path, 'lib/')) AS indexed, count(*) FILTER (NOT starts_with(path, 'lib/')) AS skipped, 1::BIGINT AS removed FROM n",
}
