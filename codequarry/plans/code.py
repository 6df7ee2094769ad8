"""Queries on symbols, calls, packages, control flow and change events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.functions import scalars as x
from codequarry.operators import architecture as arch
from codequarry.operators import trace
from codequarry.operators.controlflow import graph_table
from codequarry.operators.symbols import function_table, symbol_table
from codequarry.session import read_table, shared_folder
from codequarry.streaming import watch

HUB, WORD = "emitLog", "cache"


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    """Call edges with blanks trimmed and empty names dropped."""
    e = read_table(spark, sf, "call_edges")
    return e.select(x.trim_space(F.col("caller")).alias("caller"), "caller_file", "caller_line", x.trim_space(F.col("callee")).alias("callee")).where("caller != '' and callee != ''")


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "chunk_infos").dropDuplicates(["info_id"])


def a9_distinct_calls(spark, sf):
    return trace.distinct_edges(_edges(spark, sf)).select("caller", "callee")


def g13_callers(spark, sf):
    """Every call of the function that most others call."""
    return trace.callers_of(_edges(spark, sf).distinct(), HUB).select("caller", "caller_file", "caller_line")


def g14_callees(spark, sf):
    """Distinct callees of every function, first call kept."""
    return trace.distinct_edges(_edges(spark, sf).where("caller != callee")).groupBy("caller").agg(F.sort_array(F.collect_set("callee")).alias("c")).select("caller", F.concat_ws(",", "c").alias("callees"))


def g_call_degrees(spark, sf):
    e = trace.distinct_edges(_edges(spark, sf))
    out = e.groupBy(F.col("caller").alias("name")).agg(F.count("*").alias("n_callees"))
    back = e.groupBy(F.col("callee").alias("name")).agg(F.count("*").alias("n_callers"))
    return out.join(back, "name", "full").select("name", F.coalesce("n_callees", F.lit(0)).alias("n_callees"), F.coalesce("n_callers", F.lit(0)).alias("n_callers"))


def j8_enclosing_chunk(spark, sf):
    """For the first line of every chunk: the first other chunk of its file that holds it."""
    c = read_table(spark, sf, "chunks").select("chunk_id", F.col("file_path").alias("path"), "start_line", "end_line").dropDuplicates(["chunk_id"]).where("start_line is not null and end_line is not null")
    points = c.select("path", F.col("start_line").alias("line"), F.col("chunk_id").alias("inner_chunk"))
    # a chunk holds itself, so the first two ranges are asked for and the own one left out
    w = Window.partitionBy("path").orderBy("chunk_id")
    ranges = c.select("path", "start_line", "end_line", F.col("chunk_id").alias("outer_chunk"), F.row_number().over(w).alias("ordinal"))
    first = trace.enclosing(points, ranges)
    own = first.where("inner_chunk = outer_chunk").select("path", "line", "inner_chunk")
    others = trace.enclosing(own.join(ranges.select("path", F.col("outer_chunk").alias("inner_chunk"), F.col("ordinal").alias("after")), ["path", "inner_chunk"]).select("path", "line", "inner_chunk", "after"), ranges, "ordinal > after")
    return first.where("inner_chunk != outer_chunk").select("inner_chunk", "outer_chunk").union(others.select("inner_chunk", "outer_chunk"))


def g6_called_names(spark, sf):
    """Calls in item bodies of names that are some item's symbol."""
    i = _items(spark, sf)
    known = i.where("symbol_name != ''").select(F.col("symbol_name").alias("callee")).distinct()
    calls = i.select("info_id", "symbol_name", F.explode(x.call_names(F.col("content"))).alias("callee"))
    return calls.join(known, "callee", "left_semi").where("not callee <=> symbol_name").select("info_id", "callee")


def g15_references(spark, sf):
    """Every chunk line with the whole word."""
    c = read_table(spark, sf, "chunks").dropDuplicates(["chunk_id"])
    return trace.references(trace.lines_table(c, "chunk_id", "content"), WORD).select(F.col("path").alias("chunk_id"), F.col("line").alias("line"), F.col("context").alias("context"))


def g_symbols(spark, sf):
    """Symbols of all chunks by the language of their file."""
    c = read_table(spark, sf, "chunks").dropDuplicates(["chunk_id"]).select("chunk_id", "file_path", "content")
    s = symbol_table(c.select(F.concat_ws("\u0001", "chunk_id", "file_path").alias("key"), "content"), "key", "content")
    return s.select(F.split("path", "\u0001")[0].alias("chunk_id"), "ordinal", "name", "kind", "start_line", "end_line", "parent")


def _roots(edges: DataFrame) -> DataFrame:
    """Functions that nobody calls."""
    return edges.select(F.col("caller").alias("root")).distinct().join(edges.select(F.col("callee").alias("root")).distinct(), "root", "left_anti")


def g7_call_trees(spark, sf):
    """Call tree, eight levels deep, of every function that nobody calls."""
    e = _edges(spark, sf)
    return arch.call_trees(_roots(e), e, max_depth=8)


def g7_reachable(spark, sf):
    """Functions within three calls of a function that nobody calls: the compact depth, as in its SQL."""
    e = _edges(spark, sf)
    return arch.reachable(_roots(e), e, 3).groupBy("root").agg(F.count("*").alias("n_reached"))


def g7_reachable_full(spark, sf):
    """Functions within eight calls, the default depth, of a function that nobody calls."""
    e = _edges(spark, sf)
    return arch.reachable(_roots(e), e, 8).groupBy("root").agg(F.count("*").alias("n_reached"))


def _graphs(spark, sf):
    """Control flow of every function in every item."""
    f = function_table(_items(spark, sf), "info_id", "file_path", "content", "start_line")
    return graph_table(f, "id", "name", "language", "source", "start_line")


def g17_blocks(spark, sf):
    return _graphs(spark, sf).where("part = 'block'").select("id", "seq", "kind", "label", "cond", "lines")


def g17_edges(spark, sf):
    return _graphs(spark, sf).where("part = 'edge'").select("id", "seq", "src", "dst", "label", "back")


def g19_paths(spark, sf):
    return _graphs(spark, sf).where("part = 'path'").select("id", "seq", "blocks", "decisions")


def _events(df: DataFrame) -> DataFrame:
    """Change events: a user is a path, the kind of event an operation."""
    op = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "purchase", "rename").otherwise("write")
    h = (F.floor("value") % 5).cast("string")
    return df.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), op.alias("op"), "ts", F.col("event_id").alias("seq"), h.alias("content_hash"))


def w3_suppressed(spark, sf):
    return watch.suppress_unchanged(_events(read_table(spark, sf, "events"))).select("path", "op", "seq")


def w3_suppressed_stream(spark, sf):
    """The same by a stream over the table, its state kept per path."""
    schema = read_table(spark, sf, "events").schema
    base = f"{shared_folder(spark)}/w3-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    kept = watch.suppress_unchanged_stream(_events(stream))
    q = kept.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("path", "op", "seq")


def w4_debounced(spark, sf):
    e = watch.drop_hidden(_events(read_table(spark, sf, "events")))
    return watch.debounce(e, "1 hour").select("tick_start", "path", "op", "n_events")


def a19_watch_counters(spark, sf):
    return watch.counters(_events(read_table(spark, sf, "events")))


QUERIES = {
    f.__name__: f
    for f in (
        a9_distinct_calls, g13_callers, g14_callees, g_call_degrees, j8_enclosing_chunk, g6_called_names, g15_references, g_symbols,
        g7_call_trees, g7_reachable, g7_reachable_full, g17_blocks, g17_edges, g19_paths, w3_suppressed, w3_suppressed_stream,
        w4_debounced, a19_watch_counters,
    )
}

_E = r"""e AS (SELECT trim(caller, E' \t\n\r') AS caller, caller_file, caller_line, trim(callee, E' \t\n\r') AS callee FROM call_edges
       WHERE trim(caller, E' \t\n\r') <> '' AND trim(callee, E' \t\n\r') <> '')"""
_EV = """v AS (SELECT 'u' || user_id AS path, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'remove' WHEN 'purchase' THEN 'rename' ELSE 'write' END AS op,
       ts, event_id AS seq, (floor(value) % 5)::BIGINT::VARCHAR AS content_hash FROM events)"""
_W3 = f"""WITH {_EV}, k AS (SELECT *, CASE WHEN op IN ('remove', 'rename') THEN '' ELSE content_hash END AS known FROM v),
    l AS (SELECT *, last_value(known IGNORE NULLS) OVER (PARTITION BY path ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM k)
    SELECT path, op, seq FROM l WHERE op IN ('remove', 'rename') OR content_hash IS NULL OR content_hash IS DISTINCT FROM last"""

ORACLE_SQL = {
    "a9_distinct_calls": f"WITH {_E} SELECT DISTINCT caller, callee FROM e",
    "g13_callers": f"WITH {_E} SELECT DISTINCT caller, caller_file, caller_line FROM e WHERE callee = '{HUB}' AND caller <> '{HUB}'",
    "g14_callees": f"WITH {_E} SELECT caller, string_agg(DISTINCT callee, ',' ORDER BY callee) AS callees FROM e WHERE caller <> callee GROUP BY caller",
    "g_call_degrees": f"""WITH {_E}, d AS (SELECT DISTINCT caller, callee FROM e)
        SELECT name, sum(o)::BIGINT AS n_callees, sum(i)::BIGINT AS n_callers FROM (SELECT caller AS name, 1 AS o, 0 AS i FROM d UNION ALL SELECT callee, 0, 1 FROM d) GROUP BY name""",
    "j8_enclosing_chunk": """
        WITH c AS (SELECT chunk_id, any_value(file_path) AS f, any_value(start_line) AS s, any_value(end_line) AS e FROM chunks WHERE start_line IS NOT NULL AND end_line IS NOT NULL GROUP BY chunk_id)
        SELECT a.chunk_id AS inner_chunk, min(b.chunk_id) AS outer_chunk FROM c a JOIN c b ON a.f = b.f AND a.s BETWEEN b.s AND b.e AND a.chunk_id <> b.chunk_id GROUP BY a.chunk_id""",
    "g6_called_names": r"""
        WITH i AS (SELECT info_id, any_value(symbol_name) AS symbol_name, any_value(content) AS content FROM chunk_infos GROUP BY info_id),
        c AS (SELECT DISTINCT info_id, symbol_name, unnest(regexp_extract_all(regexp_replace(content, '"[^"\n]*"|''[^''\n]*''|`[^`\n]*`', '""', 'g'), '\b([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1)) AS callee FROM i)
        SELECT info_id, callee FROM c WHERE callee IN (SELECT symbol_name FROM i WHERE symbol_name <> '') AND callee IS DISTINCT FROM symbol_name""",
    "g15_references": rf"""
        WITH c AS (SELECT chunk_id, any_value(content) AS content FROM chunks GROUP BY chunk_id),
        l AS (SELECT chunk_id, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1)::INT AS line FROM c)
        SELECT chunk_id, line, regexp_replace(t, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS context FROM l WHERE regexp_matches(t, '\b{WORD}\b')""",
    "g7_reachable": f"""
        WITH RECURSIVE {_E}, d AS (SELECT DISTINCT caller, callee FROM e), r AS (SELECT DISTINCT caller AS root FROM d WHERE caller NOT IN (SELECT callee FROM d)),
        w AS (SELECT root, root AS name, 0 AS n FROM r UNION SELECT w.root, d.callee, w.n + 1 FROM w JOIN d ON d.caller = w.name WHERE w.n < 3)
        SELECT root, count(DISTINCT name) AS n_reached FROM w GROUP BY root""",
    "g7_reachable_full": f"""
        WITH RECURSIVE {_E}, d AS (SELECT DISTINCT caller, callee FROM e), r AS (SELECT DISTINCT caller AS root FROM d WHERE caller NOT IN (SELECT callee FROM d)),
        w AS (SELECT root, root AS name, 0 AS n FROM r UNION SELECT w.root, d.callee, w.n + 1 FROM w JOIN d ON d.caller = w.name WHERE w.n < 8)
        SELECT root, count(DISTINCT name) AS n_reached FROM w GROUP BY root""",
    "w3_suppressed": _W3,
    "w3_suppressed_stream": _W3,
    "w4_debounced": f"WITH {_EV} SELECT time_bucket(INTERVAL 1 HOUR, ts) AS tick_start, path, arg_max(op, (ts, seq)) AS op, count(*) AS n_events FROM v GROUP BY 1, 2",
    "a19_watch_counters": f"WITH {_EV} SELECT op, count(*) AS n_events, max(ts) AS last_event FROM v GROUP BY op",
}
