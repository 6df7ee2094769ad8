"""Composite operations: indexing, change application, code map, question answering, tools."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.config import Config
from codequarry.functions.scalars import sha256_hex
from codequarry.operators import architecture as arch
from codequarry.operators import search as s
from codequarry.operators import store, trace
from codequarry.operators.chunking import ChunkSize, chunk_table
from codequarry.operators.embedding import PROVIDERS, embed_missing
from codequarry.operators.prompting import clean_text, context_text, fold_summaries, split_context, stream_sse
from codequarry.operators.symbols import symbol_table
from codequarry.session import cut

DOCUMENTS = "path string, hash string, mod_time timestamp, chunk_ids array<string>"
CHUNKS = "chunk_id string, file_path string, start_line int, end_line int, content string, vector array<float>, hash string, content_hash string, updated_at timestamp"


def index_files(files: DataFrame, documents: DataFrame, chunks: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame, dict]:
    """(documents, chunks, statistics) after indexing ``files(path, mod_time, content)``.

    Files that are gone are removed with their chunks; unchanged ones are skipped by
    hash; changed ones are cut along their symbols, take stored vectors of equal text
    and embed the rest. A changed file without chunks loses its old ones.
    """
    now = files.select("path", "mod_time", "content", sha256_hex(F.col("content")).alias("hash")).dropDuplicates(["path"])
    kept = documents.join(now.select("path"), "path", "left_semi")
    stale = now.join(kept.select("path", F.col("hash").alias("known")), "path", "left").where(~F.col("hash").eqNullSafe(F.col("known"))).drop("known")
    stale = cut(stale)
    symbols = symbol_table(stale, "path", "content").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "name"))).alias("s"))
    cut_up = stale.join(symbols, "path", "left").select("path", "content", F.transform("s", lambda x: F.struct(x["name"].alias("name"), x["start_line"].alias("start_line"), x["end_line"].alias("end_line"))).alias("symbols"))
    new = chunk_table(cut_up, "path", "content", ChunkSize(config.chunking.size, config.chunking.overlap), "symbols").withColumnRenamed("path", "file_path")
    new = embed_missing(store.reuse_vectors(new, chunks), "embed_content", config.embedding.provider, config.embedding.dimensions)
    new = cut(new.select("chunk_id", "file_path", "start_line", "end_line", "content", "vector", "hash", "content_hash", F.current_timestamp().alias("updated_at")))
    rest = chunks.join(kept.select(F.col("path").alias("file_path")), "file_path", "left_semi").join(stale.select(F.col("path").alias("file_path")), "file_path", "left_anti")
    ids = new.groupBy(F.col("file_path").alias("path")).agg(F.sort_array(F.collect_list("chunk_id")).alias("chunk_ids"))
    fresh = stale.join(ids, "path", "left").select("path", "hash", "mod_time", F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"))
    docs = store.upsert(kept, fresh, "path")
    counts = {"indexed": stale.count(), "removed": documents.join(now.select("path"), "path", "left_anti").count(), "new_chunks": new.count()}
    counts["skipped"] = now.count() - counts["indexed"]
    return docs, rest.select(*new.columns).unionByName(new), counts


def tables(spark: SparkSession, root: str) -> store.Versions:
    """The documents and chunks kept below ``root``."""
    return store.Versions(spark, root, {"documents": (DOCUMENTS, "path"), "chunks": (CHUNKS, "file_path")})


def apply_changes(root: str, config: Config = Config()) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` over ``(path, op, mod_time, content)``, with ``ts`` and
    ``seq`` where events have an order. The last event of a path counts: a write or creation
    is indexed, a removal or rename deletes. Only buckets with a touched file are read and
    written, both tables move together. A repeated batch changes nothing, as unchanged
    files are skipped."""

    def run(batch: DataFrame, batch_id: int) -> None:
        kept = tables(batch.sparkSession, root)
        events = cut(store.last_events(batch))
        touched = sorted(r.b for r in events.select(kept.bucket("path").alias("b")).distinct().collect())  # at most one a bucket
        if not touched:
            return
        docs, chunks = kept.read("documents", touched), kept.read("chunks", touched)
        named = events.where(F.col("op").isin("create", "write")).select("path", "mod_time", "content")
        at = lambda df: df.select(F.col("path").alias("file_path"))
        rest_docs, rest_chunks = docs.join(events, "path", "left_anti"), chunks.join(at(events), "file_path", "left_anti")
        own_docs, own_chunks = docs.join(named.select("path"), "path", "left_semi"), chunks.join(at(named), "file_path", "left_semi")
        new_docs, new_chunks, _ = index_files(named, own_docs, own_chunks, config)
        kept.replace({"chunks": rest_chunks.unionByName(new_chunks), "documents": rest_docs.unionByName(new_docs)}, touched)

    return run


def code_map(files: DataFrame) -> dict[str, DataFrame]:
    """Packages with their counts, import edges, symbols and totals of ``files(path, content)``."""
    symbols = symbol_table(files, "path", "content")
    packages = arch.packages(files, "path", "content").join(arch.kinds_per_package(symbols), "dir", "left").fillna(0, ["functions", "types", "interfaces"])
    return {
        "packages": packages.orderBy("dir"),
        "dependencies": arch.import_edges(trace.lines_table(files, "path", "content")).orderBy("from_pkg", "to_pkg"),
        "symbols": symbols,
        "totals": packages.agg(F.sum("n_files").alias("n_files"), F.sum("n_lines").alias("n_lines"), F.count("*").alias("n_packages")),
    }


def directory_tree(files: DataFrame) -> DataFrame:
    """``(path, depth, is_dir)`` of every folder and file, in path order."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.concat_ws("/", F.slice(parts, F.lit(1), n)).alias("path"), (n - 1).alias("depth"), (n < F.size(parts)).alias("is_dir")))
    return files.select(F.explode(above).alias("x")).select("x.*").distinct().orderBy("path")


class LimitExceeded(RuntimeError):
    """A client raises it where a model refuses a prompt as too long."""

    def __init__(self, prompt: int = 0, limit: int = 0):
        super().__init__(f"prompt of {prompt} tokens, limit {limit}")
        self.prompt, self.limit = prompt, limit


def _messages(context: str, question: str, carried: str = "") -> list[dict]:
    before = f"Findings so far:\n{carried}\n\n" if carried else ""
    return [{"role": "system", "content": "Answer from the given code only."}, {"role": "user", "content": f"{before}{context}\n\nQuestion: {question}"}]


def ask_context(context: str, question: str, client: Callable[[list[dict]], str], window: int | None = None) -> str:
    """Ask over a given context. One above ``window`` estimated tokens is split, and so is one
    that the client refuses; a summary is carried over the parts."""
    if window and len(context.encode()) // 4 > window:
        parts = split_context(context)
    else:
        try:
            return client(_messages(context, question))
        except LimitExceeded:
            parts = split_context(context)
    return fold_summaries(parts, lambda part, so_far: client(_messages(part, question, so_far)))


def ask_stream(context: str, question: str, client: Callable[[list[dict]], Iterable[str]]) -> Iterator[str]:
    """Pieces of an answer as they come: ``client`` gives the lines of an event stream."""
    yield from stream_sse(client(_messages(context, question)))


def ask(chunks: DataFrame, question: str, client: Callable[[list[dict]], str], config: Config = Config(), limit: int = 10, window: int | None = None) -> str:
    """Search, assemble the context and ask ``client(messages)`` over it."""
    vector = PROVIDERS[config.embedding.provider]([question], config.embedding.dimensions)[0].tolist()
    found = s.search(chunks, vector, question, limit=limit, hybrid=config.search.hybrid, k=config.search.k, rules=config.search.rules, dedup=config.search.dedup)
    ranked = found.withColumn("rank", F.monotonically_increasing_id())
    return ask_context(context_text(ranked).first()[0] or "", question, client, window)


def package_docs(files: DataFrame, client: Callable[[list[dict]], str], least_files: int = 3) -> list[tuple[str, str]]:
    """(package, text) for every package of at least ``least_files`` files: what ``client``
    writes from its figures and symbols, cleaned of tags and fences."""
    symbols = symbol_table(files, "path", "content")
    rolled = arch.packages(files, "path", "content").join(arch.kinds_per_package(symbols), "dir", "left").fillna(0, ["functions", "types", "interfaces"])
    large = arch.large_packages(rolled, least_files)
    names = arch.report_symbols(symbols).groupBy("dir").agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda x: x["name"])).alias("names"))
    report = arch.package_report(large).join(names, "dir", "left").orderBy("dir")
    out = []
    for r in report.toLocalIterator():
        text = client([{"role": "system", "content": "Describe the package."}, {"role": "user", "content": f"{r.text}\n{r.names or ''}"}])
        out.append((r.dir, clean_text(text)))
    return out


def repository_status(config: Config, indexed: set[str]) -> list[tuple[str, str, str, str]]:
    """(name, path, role, status) of the registered repositories: ok, missing or not indexed."""
    return [(r.name, r.path, r.role, "missing" if not os.path.isdir(r.path) else "ok" if r.name in indexed else "not indexed") for r in config.repositories]


class Tools:
    """The queries as named tools over one project's tables."""

    def __init__(self, spark: SparkSession, files: DataFrame, chunks: DataFrame, config: Config = Config()):
        self.spark, self.files, self.chunks, self.config = spark, files, chunks, config
        self.symbol_rows = symbol_table(files, "path", "content")
        self.line_rows = trace.lines_table(files, "path", "content")

    def search(self, query: str, limit: int = 10) -> DataFrame:
        vector = PROVIDERS[self.config.embedding.provider]([query], self.config.embedding.dimensions)[0].tolist()
        return s.search(self.chunks, vector, query, limit=limit, hybrid=True)

    def trace(self, name: str, most_references: int = 20) -> dict[str, DataFrame]:
        """The full trace; of the references the first ones, as an answer lists them."""
        out = trace.full_trace(name, self.symbol_rows, self.line_rows, trace.call_edges(self.line_rows, self.symbol_rows))
        return out | {"references": out["references"].orderBy("path", "line").limit(most_references), "definition": trace.first_definition(out["definition"])}

    def map(self) -> dict[str, DataFrame]:
        return code_map(self.files)

    def symbols(self, kind: str = "", part: str = "", limit: int = 50) -> tuple[DataFrame, int]:
        """(first rows, number of further ones) by kind and part of the name."""
        hit = self.symbol_rows
        if kind:
            hit = hit.where(F.col("narrow_kind") == kind)
        if part:
            hit = hit.where(F.lower("name").contains(part.lower()))
        return hit.orderBy("path", "start_line", "ordinal").limit(limit), max(0, hit.count() - limit)

    def flow(self, name: str | None = None, depth: int = 8) -> DataFrame:
        edges = trace.call_edges(self.line_rows, self.symbol_rows)
        roots = self.spark.createDataFrame([(name,)], "root string") if name else arch.entry_points(self.symbol_rows, self.line_rows).select(F.col("name").alias("root"))
        return arch.call_trees(roots, edges, depth)

    def ask(self, question: str, client: Callable[[list[dict]], str], **params) -> str:
        return ask(self.chunks, question, client, self.config, **params)

    def repositories(self, indexed: set[str] = frozenset()) -> list[tuple[str, str, str, str]]:
        return repository_status(self.config, set(indexed))
