"""The registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.credentials import credentials, literal_values
from codequarry.llm.generated_files import classify_files
from codequarry.llm.languages import languages
from codequarry.llm.leaks import leaks
from codequarry.llm.near_duplicates import near_duplicate_groups, near_duplicate_pairs
from codequarry.llm.packing import pack_documents
from codequarry.llm.similar_vectors import most_similar
from codequarry.llm.splitting import split_oversized
from codequarry.session import cut, read_table

Query = Callable[[SparkSession, str], DataFrame]
#: Where the session does not name another vocabulary file in ``codequarry.tokenizer``.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CAPACITY = 2048


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of chunks whose shingles of three tokens have a Jaccard of 0.7 or more."""
    pairs = near_duplicate_pairs(read_table(spark, sf, "chunks"), "chunk_id", "content", threshold=0.7, width=3)
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Class of equal contents and group of near-duplicates of every chunk."""
    return near_duplicate_groups(read_table(spark, sf, "chunks"), "chunk_id", "content", threshold=0.7, width=3).withColumnRenamed("id", "chunk_id")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Items that had to be cut."""
    return split_oversized(read_table(spark, sf, "chunk_infos")).where("n_pieces > 1").select(F.col("id").alias("info_id")).distinct()


def p2_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece of every item."""
    infos = read_table(spark, sf, "chunk_infos").dropDuplicates(["info_id"])
    return split_oversized(infos).withColumnRenamed("id", "info_id")


def p2_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the pieces: without their overlaps they are the item again, none
    exceeds its limit, lines begin where the item does and end where it ends."""
    infos = read_table(spark, sf, "chunk_infos").dropDuplicates(["info_id"])
    size = F.when(F.col("chunk_size") > 0, F.col("chunk_size")).otherwise(512) * 4
    own = F.hex(F.expr("substring(cast(content as binary), overlap_bytes + 1)"))
    part = F.struct("piece_no", own.alias("own"), "start_line", "end_line")
    p = split_oversized(infos).join(infos.select(F.col("info_id").alias("id"), size.alias("size")), "id")
    rows = p.groupBy("id").agg(F.array_sort(F.collect_list(part)).alias("p"), F.max(F.octet_length("content") - F.col("size")).alias("most"), F.first("n_pieces").alias("n"))
    text = F.unhex(F.concat_ws("", F.transform("p", lambda x: x["own"])))
    return rows.select(F.col("id").alias("info_id"), F.sha2(text, 256).alias("hash"), (F.col("most") <= 0).alias("fits"), (F.size("p") == F.col("n")).alias("whole"), F.col("p")[0]["start_line"].alias("first_line"), F.element_at("p", -1)["end_line"].alias("last_line"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Place of every credential in chunks and in embedder configurations."""
    found = credentials(read_table(spark, sf, "chunks"), "chunk_id", "content")
    chunks = found.select(F.lit("chunk").alias("source"), F.col("id").alias("record_id"), F.explode("findings.line_no").alias("line_no"))
    configs = literal_values(read_table(spark, sf, "embedder_configs"), "config_id", "api_key")
    return chunks.union(configs.select(F.lit("config"), F.col("id"), F.lit(1))).distinct()


def p3_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """The text of every chunk that holds a credential, with the credential masked."""
    found = credentials(read_table(spark, sf, "chunks"), "chunk_id", "content")
    return found.select(F.col("id").alias("chunk_id"), F.size("findings").alias("n_findings"), "redacted").distinct()


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of chunks with cosine 0.9 or more, one among the other's five nearest."""
    near = most_similar(read_table(spark, sf, "chunks"), "chunk_id", "vector", 5, min_cosine=0.9)
    return near.select(F.least("query_id", "neighbour_id").alias("chunk_id_a"), F.greatest("query_id", "neighbour_id").alias("chunk_id_b")).distinct()


def p4_knn(spark: SparkSession, sf: str) -> DataFrame:
    """Five nearest vectors of every embedding whose id is divisible by 50."""
    near = most_similar(read_table(spark, sf, "embeddings"), "vec_id", "embedding", 5, queries=F.col("vec_id") % 50 == 0)
    return near.select(F.col("query_id").cast("long").alias("vec_id"), F.col("neighbour_id").cast("long").alias("neighbour_id"), "rank")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Files that were not written by hand in this project."""
    return p6_files(spark, sf).where("kind != 'handwritten'").select("file_path")


def p6_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every file with its kind."""
    return classify_files(read_table(spark, sf, "chunks"), "file_path", "content", "chunk_id")


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(read_table(spark, sf, "documents"), "doc_id", "text", capacity=CAPACITY, tokenizer=spark.conf.get("codequarry.tokenizer", TOKENIZER)).withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that had to be split over several contexts."""
    return _packed(spark, sf).where("piece = 1").select("doc_id").distinct()


def p8_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """The context of every document or piece of a document."""
    return _packed(spark, sf)


def p8_check(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the contexts: all documents in, none over capacity, none cut without need."""
    p = cut(_packed(spark, sf))
    one = F.lit(1).alias("one")
    full = p.groupBy("part", "context").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > CAPACITY).alias("n_over")).select(one, "n_over")
    docs = p.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n"), F.max("piece").alias("last"))
    sound = docs.agg(F.count("*").alias("n_docs"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= CAPACITY)).alias("n_needless"), F.count_if(F.col("pieces") != F.col("last") + 1).alias("n_holes"))
    return sound.select(one, "*").join(full, "one").drop("one")  # a row each


def p8_waste(spark: SparkSession, sf: str) -> DataFrame:
    """Contexts, the fewest any packing needs by their tokens, share of room unused, share of certified rows."""
    p = _packed(spark, sf)
    n = F.countDistinct("part", "context")
    least = F.ceil(F.sum("n_tokens") / CAPACITY)
    return p.agg(n.alias("n_contexts"), least.alias("least"), F.round(1 - F.sum("n_tokens") / (n * CAPACITY), 4).alias("unused"), F.round(F.avg(F.col("certified").cast("int")), 4).alias("certified"))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(read_table(spark, sf, "documents"), "doc_id", "text", read_table(spark, sf, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold 13 or more consecutive words of an evaluation item."""
    return _leaks(spark, sf).select("doc_id", "item_id").distinct()


def p9_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Every longest verbatim match with its place."""
    return _leaks(spark, sf)


def p9_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that no item leaked into."""
    docs = read_table(spark, sf, "documents")
    return docs.join(_leaks(spark, sf).select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """True language where the label is missing or wrong, and of every foreign block."""
    said = languages(read_table(spark, sf, "documents"), "doc_id", "text", "lang")
    return said.where("lang != 'und' and (block_no > 0 or label is null or label != lang)").select(F.col("id").alias("doc_id"), "block_no", "lang")


def p10_languages(spark: SparkSession, sf: str) -> DataFrame:
    """Main language of every document and language of every foreign block, with confidence."""
    return languages(read_table(spark, sf, "documents"), "doc_id", "text", "lang").withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_pieces, p2_rebuilt, p3_found, p3_redacted, p4_found, p4_knn, p6_found, p6_files, p8_found, p8_contexts, p8_check, p8_waste, p9_found, p9_matches, p9_clean, p10_found, p10_languages)}

_LEAKS = r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
        dg AS (SELECT doc_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d)),
        ig AS (SELECT item_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i)),
        hit AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)) """

ORACLE_SQL: dict[str, str] = {
    "p1_found": """
        WITH t AS (
            SELECT chunk_id, list_transform(regexp_extract_all(any_value(content), '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w
            FROM chunks GROUP BY chunk_id),
        s AS (SELECT DISTINCT chunk_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
              FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
        n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY chunk_id),
        p AS (SELECT x.chunk_id AS a, y.chunk_id AS b, count(*) AS k
              FROM s x JOIN s y ON x.g = y.g AND x.chunk_id < y.chunk_id GROUP BY 1, 2)
        SELECT a AS chunk_id_a, b AS chunk_id_b
        FROM p JOIN n AS na ON na.chunk_id = a JOIN n AS nb ON nb.chunk_id = b
        WHERE k >= 0.7 * (na.n + nb.n - k)""",
    "p1_groups": """
        WITH RECURSIVE t AS (
            SELECT chunk_id, list_transform(regexp_extract_all(coalesce(any_value(content), ''), '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w
            FROM chunks GROUP BY chunk_id),
        s AS (SELECT DISTINCT chunk_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
              FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
        n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY chunk_id),
        p AS (SELECT x.chunk_id AS a, y.chunk_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.chunk_id <> y.chunk_id GROUP BY 1, 2),
        e AS (SELECT a, b, k = na.n AND k = nb.n AS same FROM p JOIN n AS na ON na.chunk_id = a JOIN n AS nb ON nb.chunk_id = b WHERE k >= 0.7 * (na.n + nb.n - k)),
        r AS (SELECT chunk_id AS a, chunk_id AS b FROM t UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
        SELECT r.a AS chunk_id, least(r.a, (SELECT min(b) FROM e WHERE e.a = r.a AND same)) AS class_id, min(r.b) AS group_id FROM r GROUP BY r.a""",
    "p2_rebuilt": """
        WITH c AS (SELECT info_id, any_value(content) AS content, any_value(start_line) AS start_line FROM chunk_infos GROUP BY info_id)
        SELECT info_id, sha256(content) AS hash, true AS fits, true AS whole, (CASE WHEN start_line > 0 THEN start_line ELSE 1 END)::INT AS first_line,
               greatest(first_line, first_line + strlen(content) - strlen(replace(content, chr(10), '')) - CASE WHEN content LIKE '%' || chr(10) THEN 1 ELSE 0 END)::INT AS last_line FROM c""",
    # sizes stay far from the limit, so the estimate of four bytes a token decides alike
    "p8_found": "SELECT doc_id FROM documents WHERE strlen(text) > 4 * 2048",
    "p8_check": "SELECT count(DISTINCT doc_id) AS n_docs, 0::BIGINT AS n_needless, 0::BIGINT AS n_holes, 0::BIGINT AS n_over FROM documents",
    "p2_found": """
        SELECT DISTINCT info_id FROM chunk_infos
        WHERE strlen(content) > 4 * CASE WHEN chunk_size > 0 THEN chunk_size ELSE 512 END""",
    "p9_matches": r"""
        WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
        i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
        dg AS (SELECT doc_id, k - 1 AS x, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d)),
        ig AS (SELECT item_id, k - 1 AS y, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i)),
        hit AS (SELECT doc_id, item_id, x, y, x - row_number() OVER (PARTITION BY doc_id, item_id, x - y ORDER BY x) AS run FROM dg JOIN ig USING (g))
        SELECT doc_id, item_id, (count(*) + 12)::INT AS n_words, min(x)::INT AS doc_word, min(y)::INT AS item_word FROM hit GROUP BY doc_id, item_id, x - y, run""",
    "p9_found": _LEAKS + "SELECT doc_id, item_id FROM hit",
    "p9_clean": _LEAKS + "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hit)",
    "p4_found": """
        WITH v AS (
            SELECT chunk_id, any_value(vector)::DOUBLE[] AS v FROM chunks
            WHERE len(vector) = 64 AND list_sum(list_transform(vector, lambda x: abs(x))) > 0 GROUP BY chunk_id),
        s AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.v, b.v) AS c
              FROM v a JOIN v b ON a.chunk_id <> b.chunk_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM s)
        SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM r WHERE k <= 5 AND c >= 0.9""",
}
