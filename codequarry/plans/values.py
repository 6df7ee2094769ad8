"""Queries on columns, settings, change events, stored versions and call trees of ``flow_nodes``."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.config import same_vectors
from codequarry.functions import scalars as x
from codequarry.operators import architecture as arch
from codequarry.operators import prompting as pr
from codequarry.operators import store, trace
from codequarry.operators.embedding import embed, provider
from codequarry.operators.symbols import traceable
from codequarry.plans import pipelines
from codequarry.session import read_table, shared_folder
from codequarry.streaming import watch

MODULE = "host/src"


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "chunk_infos").dropDuplicates(["info_id"])


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "chunks").select("file_path").distinct()


@provider("lengths")
def lengths(texts: list[str], dim: int) -> np.ndarray:
    """For checks: every component is the last digit of the text's bytes, over ten."""
    return np.repeat(np.array([[len((t or "").encode()) % 10 / 10] for t in texts], np.float32), dim, axis=1)


def s7_traceable_files(spark, sf):
    return traceable(_paths(spark, sf), "file_path", ["scripts"])


def s10_stored_versions(spark, sf):
    """Chunks per repository as read back from a versioned store, after a second write."""
    kept = store.Versions(spark, f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}", {"chunks": ("chunk_id string, file_path string, repo string", "file_path")}, buckets=8)
    c = read_table(spark, sf, "chunks").select("chunk_id", "file_path", "repo").distinct()
    kept.replace({"chunks": c}, list(range(8)))
    half = c.withColumn("repo", F.lit("moved")).where(kept.bucket("file_path") < 4)
    kept.replace({"chunks": half}, list(range(4)))
    back = kept.read("chunks")
    return back.agg(F.count("*").alias("n_chunks"), F.countDistinct("file_path").alias("n_files"), (F.count_if(F.col("repo") == "moved") == F.count_if(kept.bucket("file_path") < 4)).alias("half_moved"))


def s15_documents(spark, sf):
    """Documents after those of the items were saved over the stored ones and tests deleted."""
    d = lambda t, source: read_table(spark, sf, t).select(F.col("file_path").alias("path")).distinct().withColumn("source", F.lit(source))
    merged = store.upsert(d("chunks", "stored"), d("chunk_infos", "saved"), "path")
    return store.delete_by(merged, merged.where(F.col("path").startswith("test/")), "path")


def s18_embedded(spark, sf):
    """Every item's vector from a provider, in batches."""
    e = embed(_items(spark, sf).select("info_id", "content"), "content", "lengths", 8)
    return e.select("info_id", F.size("vector").alias("dimensions"), F.round(F.col("vector")[7].cast("double"), 3).alias("last"))


def f13_comment_lines(spark, sf):
    c = read_table(spark, sf, "chunks").dropDuplicates(["chunk_id"])
    lines = trace.lines_table(c, "chunk_id", "content").where(arch.is_comment_line(F.col("text"), ["//", "#", "--"]))
    return lines.groupBy(F.col("path").alias("chunk_id")).agg(F.count("*").alias("n_comments"))


def f14_internal_imports(spark, sf):
    """Whether an import of each folder would be internal to a module."""
    t = _paths(spark, sf).select(F.concat(F.lit("host/"), x.directory(F.col("file_path"))).alias("target")).distinct()
    return t.select("target", arch.is_internal_import(F.col("target"), MODULE).alias("internal"), arch.last_segments(F.col("target"), 2).alias("package"))


def f15_symbol_refs(spark, sf):
    """``path:symbol`` texts of all items taken apart."""
    ref = pr.symbol_ref(F.concat_ws(":", "file_path", F.coalesce("symbol_name", F.lit("none"))))
    alone = pr.symbol_ref(F.concat(F.lit("pkg:"), F.coalesce("symbol_name", F.lit("none"))))
    return _items(spark, sf).select("info_id", ref["path"].alias("path"), ref["symbol"].alias("symbol"), alone["symbol"].alias("alone"))


def a12_identifiers(spark, sf):
    ids = x.identifiers(F.col("content"))
    return _items(spark, sf).select("info_id", F.size(ids).alias("n"), F.element_at(F.when(F.size(ids) > 0, ids), 1).alias("first"))


def _flow_tree(spark, sf):
    n = read_table(spark, sf, "flow_nodes").dropDuplicates(["node_id"])
    e = n.select(F.col("node_id").alias("a"), F.explode("children").alias("b")).join(n.select(F.col("node_id").alias("b")), "b", "left_semi").distinct()
    edges = e.select(F.col("a").cast("string").alias("caller"), F.col("b").cast("string").alias("callee"))
    roots = n.select(F.col("node_id").cast("string").alias("root")).join(edges.select(F.col("callee").alias("root")).distinct(), "root", "left_anti")
    return arch.call_trees(roots, edges, 8)


def g7_flow_trees(spark, sf):
    """Call trees of all roots, eight levels deep."""
    return _flow_tree(spark, sf).select("root", "seq", "parent_seq", "depth", "name", "marker")


def g10_tree_lines(spark, sf):
    """The trees as text, a line a node."""
    return arch.render_tree(_flow_tree(spark, sf))


def g12_directory_tree(spark, sf):
    return pipelines.directory_tree(_paths(spark, sf).withColumnRenamed("file_path", "path"))


def u2_chosen_repositories(spark, sf):
    """Repositories by each way to choose them."""
    r = read_table(spark, sf, "repos")
    one = r.agg(F.min("name")).first()[0]
    ways = {"one": {"name": one}, "every": {"every": True, "current": one}, "with_current": {"with_current": True, "current": one}, "current": {"current": one}}
    out = None
    for way, how in ways.items():
        own = pr.choose_repositories(r, **how).select(F.lit(way).alias("way"), "name", "role")
        out = own if out is None else out.union(own)
    return out.distinct()


def j19_compatible_configs(spark, sf):
    """Whether the vectors of each configuration can be compared with those of the first."""
    c = read_table(spark, sf, "embedder_configs").dropDuplicates(["config_id"])
    first = c.orderBy("config_id").first()
    names = ("provider", "model", "dimensions")
    of = F.struct(*(F.lit(first[n] if first else None).cast(c.schema[n].dataType).alias(n) for n in names))
    return c.select("config_id", F.struct(*names).alias("a"), of.alias("b")).select("config_id", same_vectors("a", "b").alias("same"))


def _events(spark, sf):
    """Change events with a path of three kinds."""
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".go"))
    path = F.when(F.col("event_type") == "view", F.concat(F.lit(".cache/"), user)).when(F.col("event_type") == "click", F.concat(F.lit("src/.tmp/"), user)).otherwise(F.concat(F.lit("src/"), user))
    op = F.when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "purchase", "rename").otherwise("write")
    return read_table(spark, sf, "events").select(path.alias("path"), op.alias("op"), "ts", F.col("event_id").alias("seq"))


def w2_visible_events(spark, sf):
    return watch.drop_hidden(_events(spark, sf)).select("path", "op", "seq")


def w5_mapped_operations(spark, sf):
    """Operations of all flags that came for a path within an hour."""
    hour = F.date_trunc("hour", "ts")
    flags = _events(spark, sf).groupBy("path", hour.alias("hour")).agg(F.collect_set("op").alias("flags"))
    return flags.select("path", "hour", watch.map_op(F.col("flags")).alias("op"))


def w6_files_after_events(spark, sf):
    """Files that are there after all events were applied: the last one of a path counts."""
    return store.last_events(_events(spark, sf)).where("op = 'write'").select("path", "seq")


def x_words_and_paths(spark, sf):
    """Words, joined and split again; folder, name and extension of a path made of the row."""
    t = x.words(F.col("text"))
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".Tar.GZ"))
    return read_table(spark, sf, "documents").select(
        "doc_id", F.size(t).alias("n_words"), F.concat_ws("+", F.slice(t, 1, 3)).alias("head"), x.directory(path).alias("dir"), x.basename(path).alias("base"), x.extension(path).alias("ext"),
        F.format_string("%.2f", F.col("doc_id") / 4).alias("quarter"), F.col("created_at").cast("timestamp_ntz").__gt__(F.lit("2024-06-01").cast("timestamp_ntz")).alias("late"),
    )


def x21_durations(spark, sf):
    return read_table(spark, sf, "events").select("event_id", pr.duration_text(F.col("event_id") / 10).alias("text"))


def x26_context_parts(spark, sf):
    """Letters and digits of every document, put together again from its parts."""
    p = pr.context_parts(read_table(spark, sf, "documents"), "doc_id", "text")
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("part_no", "text"))), lambda v: v["text"]))
    return p.groupBy(F.col("id").alias("doc_id")).agg(F.sha2(F.regexp_replace(joined, r"[^\p{L}\p{N}]+", ""), 256).alias("hash"))


def x27_limit_errors(spark, sf):
    """What responses say that quote a document's size: too long, another error, another status."""
    n = F.octet_length("text").cast("string")
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Prompt is too long: "), n, F.lit(" tokens, maximum 100"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("invalid key "), n)).otherwise(F.concat(F.lit("token limit 100, got "), n))
    status = F.when(F.col("doc_id") % 3 == 2, 500).otherwise(400)
    e = read_table(spark, sf, "documents").select("doc_id", pr.token_limit_error(status, body).alias("e"))
    return e.select("doc_id", "e.*")


def x28_clean_answers(spark, sf):
    """Answers made of a paragraph within tags and a fence, cleaned again."""
    p = x.paragraphs(F.col("text"))
    plain = F.regexp_replace(F.element_at(F.when(F.size(p) > 0, p), 1), "[`<>]", "")
    answer = F.concat(F.lit("<think>why\nnot</think>\n```md\n"), plain, F.lit("\n```\n"))
    return read_table(spark, sf, "documents").select("doc_id", F.sha2(x.trim_space(pr.clean_answer(answer)), 256).alias("hash"))


def x29_excerpts(spark, sf):
    """Heads of files that introduce a project, each a document: their kind and whether the head
    is as long as its number of bytes allows."""
    name = F.when(F.col("doc_id") % 4 == 0, "README.md").when(F.col("doc_id") % 4 == 1, "Makefile").when(F.col("doc_id") % 4 == 2, "go.mod").otherwise("a.go")
    d = read_table(spark, sf, "documents").select("doc_id", name.alias("path"), "text")
    most = F.when(pr.excerpt_kind(F.col("path")) == "readme", 3000).otherwise(1500)
    head = pr.first_bytes(F.col("text"), most)
    n, whole = F.octet_length(head), F.octet_length("text")
    kinds = pr.excerpts(d, "path", "text").groupBy("path").agg(F.first("kind").alias("kind"))
    fits = F.col("text").startswith(head) & (n <= most) & (n > F.least(whole, most) - 4)
    return d.join(F.broadcast(kinds), "path").select("doc_id", "kind", fits.alias("fits"))  # a row a name


def x31_shortened(spark, sf):
    """Texts collapsed, cut at eighty bytes, and as a diagram's label."""
    t = x.collapse_space(F.col("text"))
    return read_table(spark, sf, "documents").select("doc_id", F.sha2(x.truncate_bytes(t, 80), 256).alias("short"), x.mermaid_escape(F.substring("text", 1, 40)).alias("label"))


QUERIES = {
    f.__name__: f
    for f in (
        s7_traceable_files, s10_stored_versions, s15_documents, s18_embedded, f13_comment_lines, f14_internal_imports, f15_symbol_refs, a12_identifiers, g7_flow_trees, g10_tree_lines,
        g12_directory_tree, u2_chosen_repositories, j19_compatible_configs, w2_visible_events, w5_mapped_operations, w6_files_after_events, x_words_and_paths, x21_durations,
        x26_context_parts, x27_limit_errors, x28_clean_answers, x29_excerpts, x31_shortened,
    )
}

_EV = """v AS (SELECT CASE event_type WHEN 'view' THEN '.cache/' WHEN 'click' THEN 'src/.tmp/' ELSE 'src/' END || 'u' || user_id || '.go' AS path,
       CASE event_type WHEN 'error' THEN 'remove' WHEN 'purchase' THEN 'rename' ELSE 'write' END AS op, ts, event_id AS seq FROM events)"""
_I = """i AS (SELECT info_id, any_value(file_path) AS file_path, any_value(symbol_name) AS symbol_name, any_value(content) AS content FROM chunk_infos GROUP BY info_id)"""
_DIR = "CASE WHEN contains(file_path, '/') THEN regexp_extract(file_path, '^(.*)/[^/]*$', 1) ELSE '.' END"
_SPACE = r"[ \t\n\x0B\f\r]+"
_TREE = """RECURSIVE n AS (SELECT DISTINCT node_id, children FROM flow_nodes), e AS (SELECT DISTINCT a::VARCHAR AS a, b::VARCHAR AS b FROM (SELECT node_id AS a, unnest(children) AS b FROM n) WHERE b IN (SELECT node_id FROM n)),
    t AS (SELECT node_id::VARCHAR AS root, node_id::VARCHAR AS name, 0 AS depth, [node_id::VARCHAR] AS path, false AS stop FROM n WHERE node_id::VARCHAR NOT IN (SELECT b FROM e)
          UNION ALL SELECT root, e.b, depth + 1, list_append(path, e.b), list_contains(path, e.b) FROM t JOIN e ON e.a = t.name WHERE depth < 8 AND NOT stop),
    o AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY path)::INT AS seq,
          CASE WHEN stop THEN 'cycle' WHEN depth = 8 AND name IN (SELECT a FROM e) THEN 'cap' END AS marker FROM t)"""
_LANG = r"""f AS (SELECT DISTINCT file_path, lower(regexp_extract(file_path, '(\.[^./]*)$', 1)) AS x FROM chunks),
    l AS (SELECT file_path, CASE x WHEN '.go' THEN regexp_matches(file_path, '_test\.go$') WHEN '.py' THEN regexp_matches(file_path, 'test_|_test\.py$')
          WHEN '.js' THEN regexp_matches(file_path, '\.(test|spec)\.|__tests__') WHEN '.mjs' THEN regexp_matches(file_path, '\.(test|spec)\.|__tests__') WHEN '.ts' THEN regexp_matches(file_path, '\.(test|spec)\.|__tests__')
          WHEN '.java' THEN regexp_matches(file_path, 'Test\.java$|/test/') WHEN '.c' THEN contains(file_path, 'test') WHEN '.rs' THEN regexp_matches(file_path, 'tests/|_test\.rs$')
          WHEN '.rb' THEN regexp_matches(file_path, '_spec\.rb$|_test\.rb$') WHEN '.sql' THEN false WHEN '.sh' THEN false WHEN '.yaml' THEN false END AS is_test FROM f)"""

ORACLE_SQL = {
    "s7_traceable_files": f"WITH {_LANG} SELECT file_path FROM l WHERE NOT is_test AND NOT starts_with(file_path, 'scripts/') AND NOT contains(file_path, '/scripts/') AND NOT regexp_matches(file_path, '(^|/)\\.[^/]*/')",
    "s10_stored_versions": "SELECT count(*) AS n_chunks, count(DISTINCT file_path) AS n_files, true AS half_moved FROM (SELECT DISTINCT chunk_id, file_path, repo FROM chunks)",
    "s15_documents": "SELECT file_path AS path, CASE WHEN file_path IN (SELECT file_path FROM chunk_infos) THEN 'saved' ELSE 'stored' END AS source FROM (SELECT file_path FROM chunks UNION SELECT file_path FROM chunk_infos) WHERE NOT starts_with(file_path, 'test/')",
    "s18_embedded": f"WITH {_I} SELECT info_id, 8 AS dimensions, round(strlen(content) % 10 / 10.0, 3)::DOUBLE AS last FROM i",
    "f13_comment_lines": rf"""WITH c AS (SELECT chunk_id, any_value(content) AS content FROM chunks GROUP BY chunk_id), l AS (SELECT chunk_id, unnest(string_split(content, chr(10))) AS t FROM c)
        SELECT chunk_id, count(*) AS n_comments FROM l WHERE regexp_matches(t, '^ *(//|#|--)') GROUP BY chunk_id""",
    "f14_internal_imports": f"""WITH t AS (SELECT DISTINCT 'host/' || {_DIR} AS target FROM chunks), s AS (SELECT target, regexp_split_to_array(target, '[/.]') AS p FROM t)
        SELECT target, starts_with(target, '{MODULE}') OR contains(target, '/internal/') AS internal, array_to_string(p[greatest(1, len(p) - 1):], '/') AS package FROM s""",
    "f15_symbol_refs": f"WITH {_I} SELECT info_id, file_path AS path, coalesce(symbol_name, 'none') AS symbol, 'pkg:' || coalesce(symbol_name, 'none') AS alone FROM i WHERE coalesce(symbol_name, 'none') <> '' UNION ALL SELECT info_id, NULL, file_path || ':', 'pkg:' FROM i WHERE symbol_name = ''",
    "a12_identifiers": rf"WITH {_I}, w AS (SELECT info_id, list_sort(list_distinct(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*'))) AS w FROM i) SELECT info_id, len(w)::INT AS n, w[1] AS first FROM w",
    "g7_flow_trees": f"WITH {_TREE} SELECT o.root, o.seq, coalesce((SELECT u.seq FROM o u WHERE u.root = o.root AND u.path = o.path[1:len(o.path) - 1]), 0) AS parent_seq, depth, name, marker FROM o",
    "g10_tree_lines": f"WITH {_TREE} SELECT root, seq, repeat('│   ', depth) || '├── ' || name || CASE marker WHEN 'cycle' THEN ' (cycle)' WHEN 'cap' THEN ' (...)' ELSE '' END AS text FROM o",
    "g12_directory_tree": "WITH p AS (SELECT DISTINCT string_split(file_path, '/') AS s FROM chunks), k AS (SELECT s, unnest(range(1, len(s) + 1)) AS n FROM p) SELECT DISTINCT array_to_string(s[1:n], '/') AS path, (n - 1)::INT AS depth, n < len(s) AS is_dir FROM k",
    "u2_chosen_repositories": """WITH m AS (SELECT min(name) AS m FROM repos) SELECT DISTINCT way, name, role FROM repos, m, (VALUES ('one'), ('every'), ('with_current'), ('current')) w(way)
        WHERE CASE way WHEN 'every' THEN name <> m WHEN 'with_current' THEN true ELSE name = m END""",
    "j19_compatible_configs": """WITH c AS (SELECT config_id, any_value(provider) AS provider, any_value(model) AS model, any_value(dimensions) AS dimensions FROM embedder_configs GROUP BY config_id),
        b AS (SELECT * FROM c ORDER BY config_id LIMIT 1)
        SELECT c.config_id, c.provider IS NOT DISTINCT FROM b.provider AND c.model IS NOT DISTINCT FROM b.model AND c.dimensions IS NOT DISTINCT FROM b.dimensions AS same FROM c, b""",
    "w2_visible_events": f"WITH {_EV} SELECT path, op, seq FROM v WHERE NOT regexp_matches(path, '(^|/)\\.[^/]')",
    "w5_mapped_operations": f"""WITH {_EV}, g AS (SELECT path, date_trunc('hour', ts) AS hour, list(op) AS f FROM v GROUP BY 1, 2)
        SELECT path, hour, CASE WHEN list_contains(f, 'write') THEN 'write' WHEN list_contains(f, 'remove') THEN 'remove' ELSE 'rename' END AS op FROM g""",
    "w6_files_after_events": f"WITH {_EV} SELECT path, max_by(seq, (ts, seq)) AS seq FROM v GROUP BY path HAVING max_by(op, (ts, seq)) = 'write'",
    "x_words_and_paths": rf"""WITH w AS (SELECT *, list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda v: v <> '') AS w FROM documents)
        SELECT doc_id, len(w)::INT AS n_words, array_to_string(w[1:3], '+') AS head, source AS dir, doc_id || '.Tar.GZ' AS base, '.gz' AS ext, printf('%.2f', doc_id / 4) AS quarter, created_at > TIMESTAMP '2024-06-01' AS late FROM w""",
    "x21_durations": """WITH s AS (SELECT event_id, event_id / 10 AS s, event_id // 10 AS w FROM events)
        SELECT event_id, CASE WHEN s < 1 THEN (event_id * 100) || 'ms' WHEN s < 60 THEN printf('%.1f', s) || 's' ELSE (w // 60) || 'm' || (w % 60) || 's' END AS text FROM s""",
    "x26_context_parts": r"SELECT doc_id, sha256(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) AS hash FROM documents",
    "x27_limit_errors": "SELECT doc_id, doc_id % 3 = 0 AS is_limit, CASE WHEN doc_id % 3 = 0 THEN greatest(strlen(text), 100) ELSE 0 END::INT AS prompt, CASE WHEN doc_id % 3 = 0 THEN least(strlen(text), 100) ELSE 0 END::INT AS limit FROM documents",
    "x28_clean_answers": rf"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda v: regexp_replace(v, '^{_SPACE}|{_SPACE}$', '', 'g')), lambda v: v <> '') AS p FROM documents)
        SELECT doc_id, sha256(regexp_replace(regexp_replace(p[1], '[`<>]', '', 'g'), '^{_SPACE}|{_SPACE}$', '', 'g')) AS hash FROM p""",
    "x29_excerpts": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'readme' WHEN 1 THEN 'makefile' ELSE 'manifest' END AS kind, true AS fits FROM documents WHERE doc_id % 4 < 3",
    "x31_shortened": rf"""WITH t AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '{_SPACE}', ' ', 'g'), '^ | $', '', 'g') AS t FROM documents)
        SELECT doc_id, sha256(CASE WHEN strlen(t) > 80 THEN substr(t, 1, 80) || '...' ELSE t END) AS short,
               array_to_string(list_transform(string_split(substr(text, 1, 40), ''), lambda c: CASE c WHEN '"' THEN '#quot;' WHEN '<' THEN '#lt;' WHEN '>' THEN '#gt;' WHEN '{{' THEN '#123;' WHEN '}}' THEN '#125;' WHEN '[' THEN '#91;' WHEN ']' THEN '#93;' WHEN '(' THEN '#40;' WHEN ')' THEN '#41;' WHEN '|' THEN '#124;' ELSE c END), '') AS label FROM t""",
}
