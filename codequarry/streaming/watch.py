"""Change events: suppression of unchanged writes, debouncing, and their application."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codequarry.operators import store
from codequarry.session import cut
from codequarry.sources.scan import MAX_FILE_BYTES, is_text_file

OPS = ("create", "write", "remove", "rename")


def map_op(flags: Column) -> Column:
    """Operation of a set of flags: create before write before remove before rename, else write."""
    out = F.lit("write")
    for op in reversed(OPS):
        out = F.when(F.array_contains(flags, op), op).otherwise(out)
    return out


def drop_hidden(events: DataFrame, path: str = "path") -> DataFrame:
    return events.where(~F.exists(F.split(path, "/"), lambda p: p.startswith(".") & (F.length(p) > 1)))


def suppress_unchanged(events: DataFrame, order: list[str] = ("ts", "seq")) -> DataFrame:
    """Batch form. Per path, a create or write whose hash equals the last known one is
    dropped; remove and rename clear it; an empty or null hash always passes and
    changes nothing."""
    w = Window.partitionBy("path").orderBy(*order)
    clears = F.col("op").isin("remove", "rename")
    known = F.when(clears, F.lit("")).when(F.coalesce(F.col("content_hash"), F.lit("")) == "", F.lit(None)).otherwise(F.col("content_hash"))
    # a dropped event carries the hash that is known already, so it may count as known
    last = F.last(F.col("_known"), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = events.withColumn("_known", known).withColumn("_last", last)
    keep = clears | F.coalesce(F.col("content_hash") == "", F.lit(True)) | ~F.col("content_hash").eqNullSafe(F.col("_last"))
    return marked.where(keep).drop("_known", "_last")


def suppress_unchanged_stream(events: DataFrame) -> DataFrame:
    """Streaming form over ``(path, op, ts, seq, content_hash)``: one value per path is kept."""
    schema = "path string, op string, ts timestamp_ntz, seq long, content_hash string"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable")
        keep = []
        for op, h in zip(rows["op"], rows["content_hash"]):
            h = h if isinstance(h, str) and h else None
            if op in ("remove", "rename"):
                last = ""
                keep.append(True)
            elif h is None:
                keep.append(True)
            else:
                keep.append(h != last)
                last = h
        if last is not None:
            state.update((last,))
        yield rows[keep].astype({"content_hash": object})

    src = events.select("path", "op", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("seq").cast("long").alias("seq"), "content_hash")
    return src.groupBy("path").applyInPandasWithState(step, schema, "last string", "append", GroupStateTimeout.NoTimeout)


def debounce(events: DataFrame, tick: str, watermark: str | None = None) -> DataFrame:
    """Last event of each path within every fixed tick. With ``watermark`` it runs on a
    stream with bounded state; the batch form needs none."""
    src = events.withWatermark("ts", watermark) if watermark else events
    last = F.max(F.struct("ts", "seq", "op"))
    return src.groupBy(F.window("ts", tick).alias("w"), "path").agg(last.alias("e"), F.count("*").alias("n_events")).select(F.col("w.start").alias("tick_start"), "path", F.col("e.op").alias("op"), F.col("e.ts").alias("ts"), "n_events")


#: What is remembered of every file between two looks at a tree.
KNOWN = "path string, mod_time timestamp, size long, content_hash string"


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """``(path, mod_time, size)`` of a tree's text files, hidden and large ones left out. Only
    metadata is read; new folders are found by the listing itself."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = files.select(_relative(F.col("path"), root).alias("path"), F.col("modificationTime").alias("mod_time"), F.col("length").alias("size"))
    return drop_hidden(rows).where(is_text_file(F.col("path")) & (F.col("size") <= MAX_FILE_BYTES))


def _relative(path: Column, root: str) -> Column:
    return F.regexp_replace(path, "^(?:file:)?/*" + re.escape(os.path.abspath(root).strip("/")) + "/", "")


def _contents(spark: SparkSession, root: str, paths: DataFrame, whole: bool, block: int = 10_000) -> DataFrame:
    """``(path, content, content_hash)`` of the given files, read by name in blocks; of a tree
    seen for the first time all files are read at once."""
    columns = [_relative(F.col("path"), root).alias("path"), F.col("content").cast("string").alias("content"), F.sha2("content", 256).alias("content_hash")]
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if whole:
        return reader.load(root).select(*columns).join(paths, "path", "left_semi")
    out, names = None, []

    def read() -> None:
        nonlocal out, names
        part = reader.load(names).select(*columns)
        out, names = part if out is None else out.union(part), []

    for r in paths.toLocalIterator():
        names.append(f"{root.rstrip('/')}/{r.path}")
        if len(names) == block:
            read()
    if names:
        read()
    return out if out is not None else spark.createDataFrame([], "path string, content string, content_hash string")


def tree_changes(spark: SparkSession, root: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, what is known afterwards): a tree against ``known`` (see ``KNOWN``).

    A file that is new gives ``create``, one whose time or size changed ``write``, one that is
    gone ``remove``, or ``rename`` where a new file has its text. Events are
    ``(path, op, ts, seq, content_hash, mod_time, content)``.
    """
    first = known.isEmpty()
    now = cut(list_tree(spark, root))
    old = known.select("path", F.col("mod_time").alias("_t"), F.col("size").alias("_s"), F.col("content_hash").alias("_h"))
    both = now.join(old, "path", "full")
    changed = both.where("mod_time is not null and (_t is null or _t != mod_time or _s != size)")
    texts = cut(_contents(spark, root, changed.select("path"), first))
    named = changed.join(texts, "path").select("path", F.when(F.col("_t").isNull(), "create").otherwise("write").alias("op"), F.col("mod_time").cast("timestamp_ntz").alias("ts"), "content_hash", "mod_time", "content")
    fresh = named.where("op = 'create'").select(F.col("content_hash").alias("_h")).distinct().withColumn("_moved", F.lit(True))
    gone = both.where("mod_time is null").join(fresh, "_h", "left").select("path", F.when(F.col("_moved"), "rename").otherwise("remove").alias("op"), F.current_timestamp().cast("timestamp_ntz").alias("ts"), F.lit(None).cast("string").alias("content_hash"), F.lit(None).cast("timestamp").alias("mod_time"), F.lit(None).cast("string").alias("content"))
    events = named.union(gone).withColumn("seq", F.unix_micros(F.col("ts").cast("timestamp"))).select("path", "op", "ts", "seq", "content_hash", "mod_time", "content")
    after = both.where("mod_time is not null").join(texts.select("path", F.col("content_hash").alias("_new")), "path", "left").select("path", "mod_time", "size", F.coalesce("_new", "_h").alias("content_hash"))
    return events, after


def look(spark: SparkSession, root: str, apply, state: str, batch_id: int = 0) -> None:
    """One look at a tree: hand its changes to ``apply(events, batch_id)``, then remember it.
    If ``apply`` fails, the next look sees the same changes again."""
    events, after = tree_changes(spark, root, store.load(spark, state, KNOWN))
    events = cut(events)
    if not events.isEmpty():
        after = cut(after)
        apply(events, batch_id)
        store.persist(after, state)


def start_tree_watch(spark: SparkSession, root: str, apply, state: str, checkpoint: str, trigger: dict | None = None):
    """Look at a tree at every trigger of a stream (500 milliseconds by default)."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", "1").load()
    return start_watch(ticks, lambda _, i: look(spark, root, apply, state, i), checkpoint, trigger)


def counters(events: DataFrame) -> DataFrame:
    return events.groupBy("op").agg(F.count("*").alias("n_events"), F.max("ts").alias("last_event"))


def start_watch(stream: DataFrame, apply, checkpoint: str, trigger: dict | None = None):
    """Run ``apply(batch, batch_id)`` for every micro-batch of changes; it must be
    idempotent by batch id, as a batch may come again after a failure."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "500 milliseconds"})).start()
