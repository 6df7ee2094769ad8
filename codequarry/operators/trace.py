"""Definitions, references, callers and callees over lines and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions.scalars import call_names, directory, trim_space, whole_word


def lines_table(files: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """``(path, line, text)``, lines from 1."""
    return files.select(F.col(path_col).alias("path"), F.posexplode(F.split(text_col, "\n")).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), F.regexp_replace("text", "\r$", "").alias("text"))


def references(lines: DataFrame, name: str) -> DataFrame:
    """Every line that holds the whole word; definitions, comments and strings included."""
    return lines.where(F.col("text").contains(name) & F.col("text").rlike(whole_word(name))).select("path", "line", trim_space(F.col("text")).alias("context"))


def enclosing(points: DataFrame, ranges: DataFrame, only: str = "true") -> DataFrame:
    """Each point ``(path, line, ...)`` with the first range ``(path, start_line,
    end_line, ordinal, ...)`` of its file that holds it, by ordinal, among those for which
    the condition ``only`` holds."""
    r = ranges.withColumnRenamed("path", "_path")
    hit = points.join(r, (F.col("path") == F.col("_path")) & F.col("line").between(F.col("start_line"), F.col("end_line"))).drop("_path").where(only)
    keys = points.columns
    order = Window.partitionBy(*keys).orderBy("ordinal")
    return hit.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def call_edges(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(caller, caller_file, caller_line, callee)``: call sites of known functions
    inside known functions; self-calls and definition lines are left out."""
    funcs = symbols.where(F.col("kind").isin("function", "method")).select("path", "start_line", "end_line", "ordinal", F.col("name").alias("caller"))
    known = funcs.select(F.col("caller").alias("callee")).distinct()
    sites = lines.where(F.col("text").contains("(")).select("path", "line", F.explode(call_names(F.col("text"))).alias("callee")).join(known, "callee", "left_semi")
    inside = enclosing(sites.select("path", "line", "callee"), funcs)
    return inside.where("caller != callee").select("caller", F.col("path").alias("caller_file"), F.col("line").alias("caller_line"), "callee")


def callers_of(edges: DataFrame, name: str) -> DataFrame:
    return edges.where((F.col("callee") == name) & (F.col("caller") != name)).orderBy("caller_file", "caller_line", "caller")


def callees_of(edges: DataFrame, name: str) -> DataFrame:
    """Distinct callees with the place of the first call."""
    return distinct_edges(edges.where((F.col("caller") == name) & (F.col("callee") != name))).orderBy("callee")


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One row per (caller, callee): its first call by file and line, unknown lines last."""
    first = F.min(F.struct("caller_file", F.coalesce("caller_line", F.lit(2147483647)).alias("at"), "caller_line"))
    return edges.groupBy("caller", "callee").agg(first.alias("f")).select("caller", "callee", "f.caller_file", "f.caller_line")


def resolve_names(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges with the file of their callee: the only definition of the name, else the
    only one in the caller's folder, else the edge is dropped."""
    defs = symbols.where(F.col("kind").isin("function", "method")).select(F.col("name").alias("callee"), F.col("path").alias("callee_file"), F.col("start_line").alias("callee_line"), directory(F.col("path")).alias("_dir"))
    by_name = defs.groupBy("callee").agg(F.count("*").alias("_n"), F.min("callee_file").alias("_file"), F.min("callee_line").alias("_line"))
    by_dir = defs.groupBy("callee", "_dir").agg(F.count("*").alias("_nd"), F.min("callee_file").alias("_dfile"), F.min("callee_line").alias("_dline"))
    e = edges.withColumn("_dir", directory(F.col("caller_file"))).join(by_name, "callee").join(by_dir, ["callee", "_dir"], "left")
    one, near = F.col("_n") == 1, F.coalesce(F.col("_nd") == 1, F.lit(False))
    return e.where(one | near).select(*edges.columns, F.when(one, F.col("_file")).otherwise(F.col("_dfile")).alias("callee_file"), F.when(one, F.col("_line")).otherwise(F.col("_dline")).alias("callee_line"))


def full_trace(name: str, symbols: DataFrame, lines: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    return {
        "definition": symbols.where(F.col("name") == name).orderBy("path", "start_line"),
        "references": references(lines, name),
        "callers": callers_of(edges, name),
        "callees": callees_of(edges, name),
    }


def first_definition(definitions: DataFrame) -> DataFrame:
    """The first of several definitions by file and line, where nothing else chooses."""
    return definitions.orderBy("path", "start_line").limit(1)
