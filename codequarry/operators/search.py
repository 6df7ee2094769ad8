"""Vector, keyword and hybrid search over a chunk table.

Keyword scores are row-wise columns, cosines one matrix product per Arrow batch; each
list is cut by a top-k (a heap per partition), so only a few rows meet in the fusion. Ties rank by chunk id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions.scalars import byte_count, snippet, truncate_bytes

DEFAULT_LIMIT, FUSION_K = 20, 60

#: Factors by a part of the path, penalties first.
BOOST_RULES = (
    ("/tests/", 0.5), ("/test/", 0.5), ("__tests__", 0.5), ("_test.", 0.5), (".test.", 0.5), (".spec.", 0.5), ("/mocks/", 0.4),
    ("/fixtures/", 0.4), ("/generated/", 0.4), (".md", 0.6), ("/docs/", 0.6), ("/src/", 1.1), ("/lib/", 1.1), ("/app/", 1.1),
)


#: Scores are compared to so many decimals, so that an order does not hang on the
#: sequence in which a sum was added up.
DECIMALS = 9


def fetch_size(limit: int) -> int:
    return max(3 * limit, 20)


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """One row per chunk id: the latest ``updated_at``, nulls last."""
    order = Window.partitionBy("chunk_id").orderBy(F.desc_nulls_last("updated_at"), F.desc_nulls_last("content_hash"))
    return chunks.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def _scorer(queries: list[tuple], k: int, kind: pa.DataType, query_kind: pa.DataType):
    """Cosines of a batch's vectors to all queries by one matrix product per dimension.
    Only rows that can be among a query's k best of the batch leave it, ties included."""
    by_dim: dict[int, list[tuple]] = {}
    for qid, v in queries:
        by_dim.setdefault(len(v), []).append((qid, v))
    sides = {}
    for dim, own in by_dim.items():
        q = np.array([v for _, v in own], np.float64).reshape(len(own), dim)
        n = np.sqrt((q * q).sum(1, keepdims=True))
        sides[dim] = ([i for i, _ in own], np.divide(q, n, out=np.zeros_like(q), where=n > 0))

    def run(batches):
        for batch in batches:
            col = batch.column(1)
            size = np.diff(col.offsets.to_numpy(zero_copy_only=False))
            for dim, (ids, q) in sides.items():
                rows = np.flatnonzero(size == dim)
                scores = np.zeros((len(ids), batch.num_rows))
                if len(rows) and dim:
                    x = col.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                    n = np.sqrt((x * x).sum(1, keepdims=True))
                    ok = np.isfinite(n) & (n > 0)
                    scores[:, rows] = q @ np.divide(x, n, out=np.zeros_like(x), where=ok).T
                scores = np.round(scores, DECIMALS) + 0.0
                least = np.partition(scores, -k, axis=1)[:, -k, None] if scores.shape[1] > k else np.full((len(ids), 1), -2.0)
                at, row = np.nonzero(scores >= least)
                if len(at):
                    who = pa.array([ids[i] for i in at], query_kind)
                    yield pa.RecordBatch.from_arrays([who, batch.column(0).take(pa.array(row)).cast(kind), pa.array(scores[at, row])], names=["query_id", "chunk_id", "score"])

    return run


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}


def _scores(rows: DataFrame, queries: list[tuple], k: int, query_type: str) -> DataFrame:
    kind = rows.schema["chunk_id"].dataType.simpleString()
    src = rows.where(F.size("vector") > 0).select("chunk_id", F.col("vector").cast("array<float>").alias("vector"))
    return src.mapInArrow(_scorer(queries, k, _ARROW[kind], _ARROW[query_type]), f"query_id {query_type}, chunk_id {kind}, score double")


def vector_topk(chunks: DataFrame, query: list[float], k: int, prefix: str | None = None) -> DataFrame:
    """``(chunk_id, score)`` of the k chunks nearest by exact cosine; chunks without a
    vector are left out, vectors of another length or all zero score 0."""
    rows = chunks.where(F.col("file_path").startswith(prefix)) if prefix else chunks
    return _scores(rows, [(0, query)], k, "int").select("chunk_id", "score").orderBy(F.desc("score"), "chunk_id").limit(k)


def vector_topk_many(chunks: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """As ``vector_topk`` for a stated query set ``(query_id, query_vector)``, taken in
    blocks of about ``block`` queries, each one pass over the chunks."""
    kind = queries.schema["query_id"].dataType.simpleString()
    asked = queries.where("query_id is not null and query_vector is not null").dropDuplicates(["query_id"])
    blocks = max(1, -(-asked.count() // block))
    out = None
    for b in range(blocks):
        own = [(r.query_id, r.query_vector) for r in asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()]
        part = _scores(chunks, own, k, kind)
        out = part if out is None else out.union(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def keyword_score(text: Column, path: Column, terms: list[str]) -> Column:
    """Sum over terms of log1p(occurrences in the text) + 2 x occurrences in the path."""
    low, low_path = F.lower(text), F.lower(path)
    return F.round(sum((F.log1p(byte_count(low, t).cast("double")) + 2.0 * byte_count(low_path, t) for t in terms), F.lit(0.0)), DECIMALS)


def keyword_topk(chunks: DataFrame, query: str, k: int, prefix: str | None = None) -> DataFrame:
    terms = query.lower().split()
    rows = chunks.where(F.col("file_path").startswith(prefix)) if prefix else chunks
    if not terms:
        return rows.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    scored = rows.select("chunk_id", keyword_score(F.col("content"), F.col("file_path"), terms).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), "chunk_id").limit(k)


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = FUSION_K) -> DataFrame:
    """``(chunk_id, score)``: sum of 1 / (k + rank) over the lists ``(chunk_id, score)``."""
    order = Window.orderBy(F.desc("score"), "chunk_id")  # a list holds at most fetch_size rows
    out = None
    for x in lists:
        r = x.select("chunk_id", (F.lit(1.0) / (F.lit(k) + F.row_number().over(order))).alias("part"))
        out = r if out is None else out.unionByName(r)
    return out.groupBy("chunk_id").agg(F.sum("part").alias("score"))


def boost(path: Column, rules=BOOST_RULES) -> Column:
    """Product of the factors of all rules whose text is in the path."""
    out = F.lit(1.0)
    for text, factor in rules:
        out = out * F.when(path.contains(text), F.lit(factor)).otherwise(F.lit(1.0))
    return out


def best_per_file(results: DataFrame) -> DataFrame:
    order = Window.partitionBy("file_path").orderBy(F.desc("score"), "chunk_id")
    return results.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def search(chunks: DataFrame, query_vector: list[float], query: str, *, limit: int = DEFAULT_LIMIT, hybrid: bool = True, k: int = FUSION_K, rules=BOOST_RULES, dedup: bool = True, prefix: str | None = None) -> DataFrame:
    """Ranked chunks: vector and keyword lists, fusion, boosts, best chunk per file, top
    ``limit``. Fewer rows may come back, as files are deduplicated after the fetch."""
    fetch = fetch_size(limit)
    near = vector_topk(chunks, query_vector, fetch, prefix)
    ranked = near
    if hybrid and query.split():
        words = keyword_topk(chunks, query, fetch, prefix)
        fused = reciprocal_rank_fusion([near, words], k)
        none = words.agg((F.count("*") == 0).alias("no_words"))
        # without any keyword hit the cosine scores stand
        ranked = near.withColumn("kind", F.lit(True)).unionByName(fused.withColumn("kind", F.lit(False))).crossJoin(F.broadcast(none)).where("kind = no_words").select("chunk_id", "score")
    rows = chunks.join(F.broadcast(ranked), "chunk_id")  # at most 2 x fetch rows
    rows = rows.withColumn("score", F.col("score") * boost(F.concat(F.lit("/"), F.col("file_path")), rules))
    if dedup:
        rows = best_per_file(rows)
    return rows.orderBy(F.desc("score"), "chunk_id").limit(limit)


def keyword_topk_by(chunks: DataFrame, query: str, k: int, by: str) -> DataFrame:
    """``(chunk_id, score, <by>)``: the k best of every value of a column, in one pass; a rank
    limit per partition keeps a hot value from being sorted whole."""
    terms = query.lower().split()
    scored = chunks.select(by, "chunk_id", keyword_score(F.col("content"), F.col("file_path"), terms).alias("score") if terms else F.lit(0.0).alias("score")).where("score > 0")
    order = Window.partitionBy(by).orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def federated_keywords(chunks: DataFrame, repositories: DataFrame, query: str, k: int, limit: int) -> DataFrame:
    """As ``federated`` over one table that holds all repositories: the k best chunks of each
    registered one ``(name, role)``, labelled, merged and cut again."""
    own = repositories.select(F.col("name").alias("dep_name"), F.col("role").alias("dep_role")).distinct()
    top = keyword_topk_by(chunks.join(own.select(F.col("dep_name").alias("repo")), "repo", "left_semi"), query, k, "repo")
    return top.join(own, F.col("repo") == F.col("dep_name")).drop("repo").orderBy(F.desc("score"), "chunk_id").limit(limit)


def federated(results: list[tuple[str, str, DataFrame]], limit: int) -> DataFrame:
    """Union of the results of several repositories, labelled (name, role), cut again."""
    out = None
    for name, role, df in results:
        r = df.withColumn("dep_name", F.lit(name)).withColumn("dep_role", F.lit(role))
        out = r if out is None else out.unionByName(r)
    return out.orderBy(F.desc("score"), "chunk_id").limit(limit)


def result_json(results: DataFrame) -> DataFrame:
    """One JSON text per result; scores with four digits."""
    return results.select(F.to_json(F.struct(F.col("file_path").alias("file"), "start_line", "end_line", F.format_string("%.4f", "score").alias("score"), "content")).alias("json"))


def result_text(results: DataFrame) -> DataFrame:
    """One text per result: place, score and the first two lines, cut at 100 bytes."""
    head = truncate_bytes(snippet(F.col("content"), 2), 100)
    return results.select(F.concat("file_path", F.lit(":"), F.coalesce(F.col("start_line").cast("string"), F.lit("?")), F.format_string(" (%.4f)\n", "score"), head).alias("text"))
