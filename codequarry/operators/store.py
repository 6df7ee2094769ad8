"""The chunk store as versioned Parquet tables, and incremental indexing plans."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.scalars import sha256_hex


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace stored rows of the same key. Repeated keys in ``new`` count once."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new.dropDuplicates([key]), allowMissingColumns=True)


def delete_by(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return stored.join(keys.select(key).distinct(), key, "left_anti")


def removed_files(stored: DataFrame, current: DataFrame, path: str = "file_path") -> DataFrame:
    """Stored paths that the current files no longer have."""
    return stored.select(path).distinct().join(current.select(path).distinct(), path, "left_anti")


def changed(current: DataFrame, stored: DataFrame, key: str, text: str, hash_col: str) -> DataFrame:
    """Current rows that are new or whose text hash differs from the stored one."""
    known = stored.groupBy(key).agg(F.max(hash_col).alias("_known"))
    joined = current.withColumn("_now", sha256_hex(F.col(text))).join(known, key, "left")
    return joined.where(~F.col("_now").eqNullSafe(F.col("_known"))).drop("_now", "_known")


def reuse_vectors(new: DataFrame, stored: DataFrame, text: str = "content") -> DataFrame:
    """Vector of the first stored chunk of equal text, by chunk id; null where none is
    stored. The stored side is one row a text, so the join cannot multiply rows."""
    known = stored.where(F.size("vector") > 0).groupBy(sha256_hex(F.col(text)).alias("_h")).agg(F.min_by("vector", "chunk_id").alias("vector"), F.min("chunk_id").alias("vector_from"))
    return new.withColumn("_h", sha256_hex(F.col(text))).join(known, "_h", "left").drop("_h")


def store_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.countDistinct("file_path").alias("n_files"), F.countDistinct("chunk_id").alias("n_chunks"), F.max("updated_at").alias("last_updated"))


def chunks_per_file(files: DataFrame, chunks: DataFrame, path: str = "file_path") -> DataFrame:
    """Chunk count of every file, 0 included."""
    n = chunks.groupBy(path).agg(F.countDistinct("chunk_id").alias("n_chunks"))
    return files.select(path).distinct().join(n, path, "left").select(path, F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def persist(df: DataFrame, root: str, partition: str | None = None) -> str:
    """Write a new version of a table and move its pointer; readers of the old version
    are not disturbed."""
    version = f"v{time.time_ns()}"
    w = df.write.mode("errorifexists")
    (w.partitionBy(partition) if partition else w).parquet(f"{root}/{version}")
    df.sparkSession.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").text(f"{root}/_current")
    return version


def load(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The current version; an empty table where none was written."""
    try:
        version = spark.read.text(f"{root}/_current").first()[0]
    except Exception:  # noqa: BLE001 - Spark raises one type for any missing path
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{root}/{version}")


def last_events(events: DataFrame) -> DataFrame:
    """The last event of each path by (ts, seq); a batch without these columns counts as one
    instant, in which a removal is followed by what wrote the file again."""
    order = [c for c in ("ts", "seq") if c in events.columns] or [F.when(F.col("op").isin("remove", "rename"), 0).otherwise(1).alias("_o")]
    keys = F.struct(*order, F.col("op"), *(c for c in ("mod_time",) if c in events.columns))
    e = events.withColumn("_k", keys)
    return e.groupBy("path").agg(F.max_by(F.struct(*events.columns), "_k").alias("e")).select("e.*")


class Versions:
    """Tables kept by file in hash buckets. A change writes the touched buckets of all tables
    anew and then one manifest row, which moves them all at once: a reader sees the state
    before or after it, and so does whoever comes back after a crash."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, tuple[str, str]], buckets: int = 64):
        """``tables`` maps a name to (schema, path column)."""
        self.spark, self.root, self.tables, self.buckets = spark, root, tables, buckets

    def manifest(self) -> dict[str, dict[str, str]]:
        """Version folder of every bucket of every table; empty before the first write."""
        try:
            row = self.spark.read.schema("version long, text string").parquet(f"{self.root}/_manifest").agg(F.max_by("text", "version").alias("t")).first()
        except Exception:  # noqa: BLE001 - Spark raises one type for any missing path
            return {n: {} for n in self.tables}
        return json.loads(row.t) if row.t else {n: {} for n in self.tables}

    def bucket(self, path: str):
        return F.pmod(F.xxhash64(path), F.lit(self.buckets)).cast("int")

    def read(self, name: str, only: list[int] | None = None) -> DataFrame:
        """A table, or some of its buckets."""
        schema, _ = self.tables[name]
        at = self.manifest()[name]
        folders = [f"{self.root}/{name}/{v}/bucket={b}" for b, v in sorted(at.items()) if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def replace(self, rows: dict[str, DataFrame], touched: list[int]) -> None:
        """Put ``rows`` in place of all rows of the touched buckets."""
        version, manifest = f"v{time.time_ns()}", self.manifest()
        for name, df in rows.items():
            schema, path = self.tables[name]
            columns = [c.split()[0] for c in schema.split(", ")]
            written = df.select(*columns).withColumn("bucket", self.bucket(path)).where(F.col("bucket").isin(touched) if touched else F.lit(False))
            written.repartition("bucket").write.mode("errorifexists").partitionBy("bucket").parquet(f"{self.root}/{name}/{version}")
            have = {str(r.bucket) for r in self.spark.read.parquet(f"{self.root}/{name}/{version}").select("bucket").distinct().collect()} if not self._empty(name, version) else set()
            own = manifest.setdefault(name, {})
            for b in map(str, touched):
                own.pop(b, None)
                if b in have:
                    own[b] = version
        self.spark.createDataFrame([(time.time_ns(), json.dumps(manifest))], "version long, text string").coalesce(1).write.mode("append").parquet(f"{self.root}/_manifest")

    def _empty(self, name: str, version: str) -> bool:
        try:
            return "bucket" not in self.spark.read.parquet(f"{self.root}/{name}/{version}").columns
        except Exception:  # noqa: BLE001 - a folder without files has no schema
            return True
