"""Queries on chunks, documents and vectors: search, store, incremental indexing, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.functions import scalars as x
from codequarry.operators import search as s
from codequarry.operators import store
from codequarry.operators.chunking import ChunkSize, chunk_table
from codequarry.operators.embedding import embed_missing
from codequarry.operators.prompting import choose_repositories, context_text, message_tokens
from codequarry.operators.symbols import is_test_path, language_of
from codequarry.session import read_table
from codequarry.sources.scan import is_ignored, is_text_file, parse_rules

QUERY_TEXT = "cache loader token"
RULES = "*.sql\n!core/*.sql\nvendor/\ntest/*\n/build\n"
NAMES = ["node_modules", "dist"]


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return s.distinct_chunks(read_table(spark, sf, "chunks"))


def _query_vector(spark: SparkSession, sf: str) -> list[float]:
    """The vector of the smallest usable chunk id stands for an embedded question."""
    row = read_table(spark, sf, "chunks").where(F.size("vector") == 64).agg(F.min_by("vector", "chunk_id").alias("v")).first()
    return list(row.v or [])


def f1_usable_chunks(spark, sf):
    """Chunks below a path prefix that have a vector."""
    return _chunks(spark, sf).where(F.col("file_path").startswith("src/") & (F.size("vector") > 0)).select("chunk_id", "file_path")


def f3_chunks_in_order(spark, sf):
    """Chunks of every file in line order."""
    w = Window.partitionBy("file_path").orderBy(F.asc_nulls_last("start_line"), "chunk_id")
    return _chunks(spark, sf).select("file_path", "chunk_id", F.row_number().over(w).alias("position"))


def f4_files(spark, sf):
    return read_table(spark, sf, "chunks").select("file_path").distinct().orderBy("file_path")


def r1_vector_topk(spark, sf):
    top = s.vector_topk(_chunks(spark, sf), _query_vector(spark, sf), 20)
    return top.select("chunk_id", F.round("score", 6).alias("score"))


def r1_exact_neighbours(spark, sf):
    """Exact five nearest of every embedding whose id is divisible by 50, against all."""
    e = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    q = e.where(F.col("chunk_id") % 50 == 0).select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query_vector"))
    top = s.vector_topk_many(e, q, 6).where("chunk_id != query_id")
    w = Window.partitionBy("query_id").orderBy("rank")
    return top.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select(F.col("query_id").alias("vec_id"), F.col("chunk_id").alias("neighbour_id"), "rank")


def r2_keyword_topk(spark, sf):
    top = s.keyword_topk(_chunks(spark, sf), QUERY_TEXT, 60)
    return top.select("chunk_id", F.round("score", 6).alias("score"))


def j4_rank_fusion(spark, sf):
    c = _chunks(spark, sf)
    fused = s.reciprocal_rank_fusion([s.vector_topk(c, _query_vector(spark, sf), 60), s.keyword_topk(c, QUERY_TEXT, 60)])
    return fused.select("chunk_id", F.round("score", 8).alias("score"))


def j5_boosts(spark, sf):
    return read_table(spark, sf, "chunks").select("file_path").distinct().select("file_path", F.round(s.boost(F.concat(F.lit("/"), "file_path")), 6).alias("boost"))


def i3_hybrid_search(spark, sf):
    """The whole pipeline: two lists, fusion, boosts, best chunk per file, top 20."""
    out = s.search(_chunks(spark, sf), _query_vector(spark, sf), QUERY_TEXT, limit=20)
    return out.select("chunk_id", "file_path", F.round("score", 8).alias("score"))


def r4_best_keyword_chunk_per_file(spark, sf):
    scored = _chunks(spark, sf).withColumn("score", s.keyword_score(F.col("content"), F.col("file_path"), QUERY_TEXT.split())).where("score > 0")
    return s.best_per_file(scored).select("file_path", "chunk_id", F.round("score", 6).alias("score"))


def u1_federated_keyword_search(spark, sf):
    """Best ten chunks of every repository, labelled with its name and role, merged by score."""
    repos = choose_repositories(read_table(spark, sf, "repos"), every=True)
    out = s.federated_keywords(_chunks(spark, sf), repos, QUERY_TEXT, 10, 200)
    return out.select(F.col("dep_name").alias("repo"), F.col("dep_role").alias("role"), "chunk_id", F.round("score", 6).alias("score"))


def s20_result_json(spark, sf):
    out = s.search(_chunks(spark, sf), _query_vector(spark, sf), QUERY_TEXT, limit=20)
    return s.result_json(out)


def s21_result_text(spark, sf):
    return s.result_text(s.search(_chunks(spark, sf), _query_vector(spark, sf), QUERY_TEXT, limit=20))


def a1_store_stats(spark, sf):
    return store.store_stats(read_table(spark, sf, "chunks"))


def a2_chunks_per_file(spark, sf):
    files = read_table(spark, sf, "chunks").select("file_path").union(read_table(spark, sf, "chunk_infos").select("file_path"))
    return store.chunks_per_file(files, read_table(spark, sf, "chunks"))


def j1_removed_files(spark, sf):
    return store.removed_files(read_table(spark, sf, "chunks"), read_table(spark, sf, "chunk_infos"))


def j2_changed_items(spark, sf):
    infos = read_table(spark, sf, "chunk_infos").select("info_id", "chunk_id", "content").distinct()
    return store.changed(infos, read_table(spark, sf, "chunks"), "chunk_id", "content", "content_hash").select("info_id", "chunk_id")


def j3_reused_vectors(spark, sf):
    """For every chunk of the store as if new: the chunk its vector would be taken from."""
    c = _chunks(spark, sf)
    return store.reuse_vectors(c.select("chunk_id", "content"), c).select("chunk_id", "vector_from")


def s12_upsert(spark, sf):
    """Store after the items of chunk_infos were saved into it, counted per repository."""
    new = read_table(spark, sf, "chunk_infos").select("chunk_id", "repo", "file_path", "content").dropDuplicates(["chunk_id"])
    merged = store.upsert(_chunks(spark, sf).select("chunk_id", "repo", "file_path", "content"), new, "chunk_id")
    return merged.groupBy("repo").agg(F.count("*").alias("n_chunks"), F.countDistinct("file_path").alias("n_files"))


def s13_delete_by_file(spark, sf):
    """Store without the files of test folders, counted per repository."""
    c = _chunks(spark, sf)
    gone = c.where(F.col("file_path").startswith("test/")).select("file_path")
    return store.delete_by(c, gone, "file_path").groupBy("repo").agg(F.count("*").alias("n_chunks"))


def x14_cosines(spark, sf):
    """Cosine of every embedding with the one of the next id."""
    e = read_table(spark, sf, "embeddings")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(n, "vec_id").select("vec_id", F.round(x.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))


def x_text_statistics(spark, sf):
    """Byte-based text functions over all documents."""
    t = F.col("text")
    return read_table(spark, sf, "documents").select(
        "doc_id",
        F.octet_length(t).alias("n_bytes"),
        x.line_count(t).alias("n_lines"),
        x.byte_count(F.lower(t), "the").alias("n_the"),
        x.token_estimate(t).alias("n_tokens"),
        F.substring(x.sha256_hex(t), 1, 16).alias("hash"),
    )


def x24_paragraphs(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", F.posexplode(x.paragraphs(F.col("text"))).alias("at", "p"))
    return d.select("doc_id", (F.col("at") + 1).alias("paragraph"), F.octet_length("p").alias("n_bytes"))


def r11_snippets(spark, sf):
    return _chunks(spark, sf).select("chunk_id", x.snippet(F.col("content"), 3).alias("snippet"))


def s4_text_files(spark, sf):
    return read_table(spark, sf, "chunks").select("file_path").distinct().where(is_text_file(F.col("file_path")))


def s5_ignored_files(spark, sf):
    """Files that listed names or rules ignore."""
    return read_table(spark, sf, "chunks").select("file_path").distinct().where(is_ignored(F.col("file_path"), NAMES, parse_rules(RULES)))


def f16_languages(spark, sf):
    f = read_table(spark, sf, "chunks").select("file_path").distinct().withColumn("language", language_of(F.col("file_path")))
    return f.select("file_path", "language", is_test_path(F.col("file_path"), F.col("language")).alias("is_test"))


def a16_document_tokens(spark, sf):
    return message_tokens(read_table(spark, sf, "documents"), "source", "text")


def a17_context(spark, sf):
    """Context text of the twenty best chunks."""
    out = s.search(_chunks(spark, sf), _query_vector(spark, sf), QUERY_TEXT, limit=20)
    return context_text(out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id"))))


def c1_line_chunks(spark, sf):
    """All documents packed into chunks of 128 tokens with an overlap of 16."""
    d = read_table(spark, sf, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text")
    return chunk_table(d, "path", "text", ChunkSize(128, 16)).select("path", "chunk_id", "start_line", "end_line", "hash", "content_hash")


def i1_embedded_items(spark, sf):
    """Items with the vector of a stored chunk of equal text, else a new one."""
    infos = read_table(spark, sf, "chunk_infos").select("info_id", "content").dropDuplicates(["info_id"])
    done = embed_missing(store.reuse_vectors(infos, read_table(spark, sf, "chunks")), "content")
    return done.select("info_id", F.col("vector_from").isNotNull().alias("reused"), F.size("vector").alias("dimensions"))


QUERIES = {
    f.__name__: f
    for f in (
        f1_usable_chunks, f3_chunks_in_order, f4_files, r1_vector_topk, r1_exact_neighbours, r2_keyword_topk, j4_rank_fusion, j5_boosts, i3_hybrid_search,
        r4_best_keyword_chunk_per_file, u1_federated_keyword_search, s20_result_json, s21_result_text, a1_store_stats, a2_chunks_per_file, j1_removed_files, j2_changed_items,
        j3_reused_vectors, s12_upsert, s13_delete_by_file, x14_cosines, x_text_statistics, x24_paragraphs, r11_snippets, s4_text_files, s5_ignored_files,
        f16_languages, a16_document_tokens, a17_context, c1_line_chunks, i1_embedded_items,
    )
}

_C = """c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY updated_at DESC NULLS LAST, content_hash DESC NULLS LAST) = 1)"""
_Q = """qv AS (SELECT arg_min(vector, chunk_id)::DOUBLE[] AS q FROM chunks WHERE len(vector) = 64)"""
_COS = """vs AS (SELECT chunk_id, CASE WHEN len(vector) = 64 AND list_sum(list_transform(vector, lambda v: abs(v))) > 0 THEN round(list_cosine_similarity(vector::DOUBLE[], q), 9) ELSE 0 END AS score
       FROM c, qv WHERE len(vector) > 0)"""
_OCC = "((strlen({t}) - strlen(replace({t}, '{w}', ''))) // strlen('{w}'))"
_KW = "round(" + " + ".join(f"ln(1 + {_OCC.format(t='lower(content)', w=w)}) + 2.0 * {_OCC.format(t='lower(file_path)', w=w)}" for w in QUERY_TEXT.split()) + ", 9)"
_BOOST = " * ".join(f"CASE WHEN contains('/' || file_path, '{t}') THEN {f}::DOUBLE ELSE 1.0::DOUBLE END" for t, f in s.BOOST_RULES)
_TOPS = f"""WITH {_C}, {_Q}, {_COS},
    v AS (SELECT * FROM vs ORDER BY score DESC, chunk_id LIMIT 60),
    k AS (SELECT chunk_id, {_KW} AS score FROM c QUALIFY row_number() OVER (ORDER BY ({_KW}) DESC, chunk_id) <= 60),
    k2 AS (SELECT * FROM k WHERE score > 0),
    fused AS (SELECT chunk_id, sum(p) AS score FROM (
        SELECT chunk_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, chunk_id)) AS p FROM v
        UNION ALL SELECT chunk_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, chunk_id)) FROM k2) GROUP BY chunk_id)"""
_HYBRID = f"""{_TOPS},
    b AS (SELECT chunk_id, file_path, start_line, end_line, content, fused.score * ({_BOOST}) AS score FROM fused JOIN c USING (chunk_id)),
    d AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY score DESC, chunk_id) = 1),
    t AS (SELECT * FROM d ORDER BY score DESC, chunk_id LIMIT 20)"""
_TRIM = r"regexp_replace({0}, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"

ORACLE_SQL = {
    "f1_usable_chunks": "SELECT DISTINCT chunk_id, file_path FROM chunks WHERE starts_with(file_path, 'src/') AND len(vector) > 0",
    "f3_chunks_in_order": f"WITH {_C} SELECT file_path, chunk_id, row_number() OVER (PARTITION BY file_path ORDER BY start_line NULLS LAST, chunk_id)::INT AS position FROM c",
    "f4_files": "SELECT DISTINCT file_path FROM chunks ORDER BY file_path",
    "r1_vector_topk": f"WITH {_C}, {_Q}, {_COS} SELECT chunk_id, round(score, 6) AS score FROM vs ORDER BY vs.score DESC, chunk_id LIMIT 20",
    "r1_exact_neighbours": """
        WITH s AS (SELECT a.vec_id, b.vec_id AS neighbour_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS c
                   FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, neighbour_id)::INT AS rank FROM s)
        SELECT vec_id, neighbour_id, rank FROM r WHERE rank <= 5""",
    "r2_keyword_topk": f"WITH {_C}, k AS (SELECT chunk_id, {_KW} AS score FROM c) SELECT chunk_id, round(score, 6) AS score FROM k WHERE k.score > 0 ORDER BY k.score DESC, chunk_id LIMIT 60",
    "j4_rank_fusion": f"{_TOPS} SELECT chunk_id, round(score, 8) AS score FROM fused",
    "j5_boosts": f"SELECT file_path, round({_BOOST}, 6) AS boost FROM (SELECT DISTINCT file_path FROM chunks)",
    "i3_hybrid_search": f"{_HYBRID} SELECT chunk_id, file_path, round(score, 8) AS score FROM t",
    "r4_best_keyword_chunk_per_file": f"""
        WITH {_C}, k AS (SELECT file_path, chunk_id, {_KW} AS score FROM c),
        b AS (SELECT * FROM k WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY score DESC, chunk_id) = 1)
        SELECT file_path, chunk_id, round(score, 6) AS score FROM b""",
    "u1_federated_keyword_search": f"""
        WITH {_C}, k AS (SELECT repo, chunk_id, {_KW} AS score FROM c WHERE repo IN (SELECT name FROM repos)),
        r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, chunk_id)::INT AS rank FROM k WHERE score > 0)
        SELECT r.repo, p.role, r.chunk_id, round(r.score, 6) AS score FROM r JOIN (SELECT DISTINCT name, role FROM repos) p ON p.name = r.repo WHERE r.rank <= 10 ORDER BY r.score DESC, r.chunk_id LIMIT 200""",
    "s20_result_json": f"""{_HYBRID}
        SELECT '{{' || array_to_string(list_filter(['"file":' || to_json(file_path)::VARCHAR, '"start_line":' || start_line::VARCHAR, '"end_line":' || end_line::VARCHAR, '"score":"' || printf('%.4f', score) || '"', '"content":' || to_json(content)::VARCHAR], lambda v: v IS NOT NULL), ',') || '}}' AS json FROM t""",
    "s21_result_text": f"""{_HYBRID},
        h AS (SELECT *, array_to_string(list_slice(string_split({_TRIM.format('content')}, chr(10)), 1, 2), chr(10)) AS s FROM t)
        SELECT file_path || ':' || coalesce(start_line::VARCHAR, '?') || printf(' (%.4f)', score) || chr(10) || CASE WHEN strlen(s) > 100 THEN substr(s, 1, 100) || '...' ELSE s END AS text FROM h""",
    "i1_embedded_items": """
        WITH i AS (SELECT info_id, any_value(content) AS content FROM chunk_infos GROUP BY info_id),
        k AS (SELECT content, arg_min(len(vector), chunk_id) AS d FROM chunks WHERE len(vector) > 0 GROUP BY content)
        SELECT info_id, k.content IS NOT NULL AS reused, coalesce(k.d, 64)::INT AS dimensions FROM i LEFT JOIN k ON k.content = i.content""",
    "a1_store_stats": "SELECT count(DISTINCT file_path) AS n_files, count(DISTINCT chunk_id) AS n_chunks, max(updated_at) AS last_updated FROM chunks",
    "a2_chunks_per_file": """
        WITH f AS (SELECT file_path FROM chunks UNION SELECT file_path FROM chunk_infos)
        SELECT f.file_path, count(DISTINCT c.chunk_id) AS n_chunks FROM f LEFT JOIN chunks c USING (file_path) GROUP BY f.file_path""",
    "j1_removed_files": "SELECT DISTINCT file_path FROM chunks EXCEPT SELECT file_path FROM chunk_infos",
    "j2_changed_items": """
        WITH k AS (SELECT chunk_id, max(content_hash) AS h FROM chunks GROUP BY chunk_id)
        SELECT DISTINCT info_id, i.chunk_id FROM chunk_infos i LEFT JOIN k USING (chunk_id) WHERE sha256(content) IS DISTINCT FROM k.h""",
    "j3_reused_vectors": f"""
        WITH {_C}, k AS (SELECT content, min(chunk_id) AS vector_from FROM c WHERE len(vector) > 0 GROUP BY content)
        SELECT c.chunk_id, k.vector_from FROM c LEFT JOIN k ON k.content = c.content""",
    "s12_upsert": f"""
        WITH {_C}, n AS (SELECT chunk_id, any_value(repo) AS repo, any_value(file_path) AS file_path FROM chunk_infos GROUP BY chunk_id),
        m AS (SELECT chunk_id, repo, file_path FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM n) UNION ALL SELECT * FROM n)
        SELECT repo, count(*) AS n_chunks, count(DISTINCT file_path) AS n_files FROM m GROUP BY repo""",
    "s13_delete_by_file": "SELECT repo, count(DISTINCT chunk_id) AS n_chunks FROM chunks WHERE NOT starts_with(file_path, 'test/') GROUP BY repo",
    "x14_cosines": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "x_text_statistics": """
        SELECT doc_id, strlen(text)::INT AS n_bytes, CASE WHEN strlen(text) = 0 THEN 0 ELSE 1 + strlen(text) - strlen(replace(text, chr(10), '')) END::INT AS n_lines,
               ((strlen(lower(text)) - strlen(replace(lower(text), 'the', ''))) // 3)::INT AS n_the, strlen(text) // 4 AS n_tokens, substr(sha256(text), 1, 16) AS hash
        FROM documents""",
    "x24_paragraphs": f"""
        WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS p, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i FROM documents),
        t AS (SELECT doc_id, i, {_TRIM.format("p")} AS p FROM p)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i)::INT AS paragraph, strlen(p)::INT AS n_bytes FROM t WHERE p <> ''""",
    "r11_snippets": f"WITH {_C} SELECT chunk_id, array_to_string(list_slice(string_split({_TRIM.format('content')}, chr(10)), 1, 3), chr(10)) AS snippet FROM c",
    "s4_text_files": "SELECT DISTINCT file_path FROM chunks WHERE regexp_matches(lower(file_path), '\\.(go|js|ts|jsx|tsx|py|rb|rs|java|kt|c|h|cpp|hpp|cc|cs|swift|php|sh|sql|yaml|yml|json|md|html|css|toml|xml|proto|txt)$')",
    "s5_ignored_files": """
        SELECT DISTINCT file_path FROM chunks
        WHERE len(list_intersect(string_split(file_path, '/'), ['node_modules', 'dist'])) > 0 OR regexp_matches(file_path, '(^|/)vendor/')
           OR starts_with(file_path, 'test/') OR (file_path LIKE '%.sql' AND NOT regexp_matches(file_path, '^core/[^/]*\\.sql$'))""",
    "f16_languages": r"""
        WITH f AS (SELECT DISTINCT file_path, lower(regexp_extract(file_path, '(\.[^./]*)$', 1)) AS e FROM chunks),
        l AS (SELECT file_path, CASE e WHEN '.go' THEN 'go' WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.js' THEN 'javascript' WHEN '.mjs' THEN 'javascript' WHEN '.java' THEN 'java'
              WHEN '.rs' THEN 'rust' WHEN '.c' THEN 'c' WHEN '.rb' THEN 'ruby' WHEN '.sql' THEN 'sql' WHEN '.sh' THEN 'shell' WHEN '.yaml' THEN 'yaml' END AS language FROM f)
        SELECT file_path, language, coalesce(CASE language WHEN 'go' THEN regexp_matches(file_path, '_test\.go$') WHEN 'python' THEN regexp_matches(file_path, 'test_|_test\.py$')
               WHEN 'javascript' THEN regexp_matches(file_path, '\.(test|spec)\.|__tests__') WHEN 'typescript' THEN regexp_matches(file_path, '\.(test|spec)\.|__tests__')
               WHEN 'java' THEN regexp_matches(file_path, 'Test\.java$|/test/') WHEN 'c' THEN contains(file_path, 'test') WHEN 'rust' THEN regexp_matches(file_path, 'tests/|_test\.rs$')
               WHEN 'ruby' THEN regexp_matches(file_path, '_spec\.rb$|_test\.rb$') ELSE false END, false) AS is_test FROM l""",
    "a16_document_tokens": "SELECT source, sum(strlen(text))::BIGINT // 4 AS n_tokens, count(*) AS n_messages FROM documents GROUP BY source",
    "c1_line_chunks": r"""
        WITH RECURSIVE d AS (SELECT source || '/' || doc_id AS path, list_transform(string_split(text, chr(10)), lambda v, i: v || CASE WHEN i < len(string_split(text, chr(10))) THEN chr(10) ELSE '' END) AS all_lines FROM documents),
        l AS (SELECT path, list_filter(all_lines, lambda v: v <> '') AS ls FROM d),
        m AS (SELECT path, ls, len(ls) AS n, list_transform(range(0, len(ls) + 1), lambda i: coalesce(list_sum(list_transform(ls[1:i], lambda v: strlen(v))), 0)::BIGINT) AS cum FROM l WHERE len(ls) > 0 AND trim(array_to_string(ls, ''), E' \t\n\r\x0B\f') <> ''),
        w AS (SELECT path, ls, n, cum, 0::BIGINT AS q, 0 AS idx, -1::BIGINT AS s, -1::BIGINT AS e FROM m
            UNION ALL
            SELECT path, ls, n, cum, CASE WHEN NOT good THEN e2 WHEN q < back AND back < e2 THEN back ELSE e2 END, idx + good::INT, CASE WHEN good THEN q ELSE -1 END, e2
            FROM (SELECT *, CASE WHEN e2 < n THEN greatest(0, len(list_filter(cum[1:e2 + 1], lambda c: c <= cum[e2 + 1] - 64)) - 1) ELSE e2 END AS back,
                         strlen(regexp_replace(array_to_string(ls[q + 1:e2], ''), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')) >= 16 AS good
                  FROM (SELECT path, ls, n, cum, q, idx, greatest(q + 1, len(list_filter(cum, lambda c: c <= cum[q + 1] + 512)) - 1) AS e2 FROM w WHERE q < n))),
        c AS (SELECT path, path || '_' || (idx - 1) AS chunk_id, (s + 1)::INT AS start_line, array_to_string(ls[s + 1:e], '') AS t FROM w WHERE s >= 0),
        r AS (SELECT *, greatest(start_line, start_line + strlen(t) - strlen(replace(t, chr(10), '')) - CASE WHEN t LIKE '%' || chr(10) THEN 1 ELSE 0 END)::INT AS end_line FROM c)
        SELECT path, chunk_id, start_line, end_line, substr(sha256(path || ':' || start_line || ':' || end_line || ':' || t), 1, 16) AS hash, sha256(t) AS content_hash FROM r""",
    "a17_context": f"""{_HYBRID}
        SELECT string_agg('File: ' || file_path || ':' || coalesce(start_line::VARCHAR || '-', '') || coalesce(end_line::VARCHAR || chr(10), '') || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY score DESC, chunk_id) AS context FROM t
        WHERE start_line IS NOT NULL AND end_line IS NOT NULL""",
}
