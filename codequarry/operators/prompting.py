"""Bounded context for language models: token estimates, assembly, splitting, errors."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions.scalars import trim_space

#: Phrases of a response that says a prompt is too long.
LIMIT_PHRASES = ("max_prompt_tokens_exceeded", "exceeds the limit", "context length", "too long", "prompt is too long", "maximum context length", "token limit", "context_length_exceeded")


def message_tokens(messages: DataFrame, key: str, text: str) -> DataFrame:
    """Estimated tokens per conversation: all bytes, then divided by four."""
    return messages.groupBy(key).agg(F.floor(F.sum(F.octet_length(text)) / 4).cast("long").alias("n_tokens"), F.count("*").alias("n_messages"))


def context_text(results: DataFrame, rank: str = "rank") -> DataFrame:
    """One text of all results in rank order. The input is a cut result list."""
    part = F.concat(F.lit("File: "), "file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("\n"), "content")
    rows = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), part.alias("t"))))
    return results.agg(F.concat_ws("\n\n---\n\n", F.transform(rows, lambda x: x["t"])).alias("context"))


def split_middle(text: str) -> tuple[str, str]:
    """Cut at the blank line nearest the middle, else at the nearest line end, else in
    the middle (at a character)."""
    mid = len(text) // 2
    for mark in ("\n\n", "\n"):
        spots = [p for p in (text.rfind(mark, 0, mid), text.find(mark, mid)) if p > 0]
        spots = [p for p in spots if p + len(mark) < len(text)]
        if spots:
            at = min(spots, key=lambda p: abs(p - mid)) + len(mark)
            return text[:at], text[at:]
    return text[:mid], text[mid:]


def split_context(text: str, parts: int = 2, depth: int = 0) -> list[str]:
    """Paragraphs, small ones (under an eighth of the text, at least 200 bytes) merged
    with the next; a text of one paragraph is halved, at most three times."""
    blocks = [p.strip() for p in text.split("\n\n") if p.strip()]
    if len(blocks) < parts:
        if depth >= 3 or len(text) < 2:
            return [text] if text.strip() else []
        a, b = split_middle(text)
        return [x for h in (a, b) for x in ([h] if h.strip() else [])]
    least = max(len(text.encode()) // 8, 200)
    out = [blocks[0]]
    for p in blocks[1:]:
        if len(out[-1].encode()) < least:
            out[-1] += "\n\n" + p
        else:
            out.append(p)
    return out


def context_parts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, part_no, text)``: the parts of ``split_context`` of every text, from 1. Null ids
    and texts give no row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            who, number, parts = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = split_context(text)
                who += [i] * len(own)
                number += range(1, len(own) + 1)
                parts += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())), pa.array(number, pa.int32()), pa.array(parts, pa.string())], names=["id", "part_no", "text"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null").mapInArrow(run, f"id {kind}, part_no int, text string")


def fold_summaries(parts: list[str], ask) -> str:
    """Carry a summary over the parts: ``ask(part, summary so far)``. Sequential by nature."""
    summary = ""
    for p in parts:
        summary = ask(p, summary)
    return summary


def token_limit_error(status: Column, body: Column) -> Column:
    """Struct (is_limit, prompt, limit): status 400 with one of the known phrases; the
    larger number is the prompt's size, the smaller the limit."""
    low = F.lower(body)
    hit = F.lit(False)
    for p in LIMIT_PHRASES:
        hit = hit | low.contains(p)
    hit = (status == 400) & hit
    numbers = F.transform(F.regexp_extract_all(body, F.lit(r"(\d{3,})"), F.lit(1)), lambda x: x.cast("int"))
    two = hit & (F.size(numbers) >= 2)
    return F.struct(F.coalesce(hit, F.lit(False)).alias("is_limit"), F.when(two, F.greatest(numbers[0], numbers[1])).otherwise(0).alias("prompt"), F.when(two, F.least(numbers[0], numbers[1])).otherwise(0).alias("limit"))


def clean_answer(text: Column) -> Column:
    """An answer without reasoning tags and an enclosing code fence."""
    out = trim_space(F.regexp_replace(text, r"(?s)<think(?:ing)?>.*?</think(?:ing)?>", ""))
    return trim_space(F.regexp_replace(F.regexp_replace(out, r"^```\w*\n", ""), r"\n```$", ""))


def clean_text(text: str) -> str:
    """As ``clean_answer``, for one text."""
    text = re.sub(r"(?s)<think(?:ing)?>.*?</think(?:ing)?>", "", text).strip()
    return re.sub(r"\n```$", "", re.sub(r"^```\w*\n", "", text)).strip()


def stream_sse(lines: Iterable[str]) -> Iterator[str]:
    """Contents of a streamed answer as they come; other and malformed lines are skipped,
    ``[DONE]`` or a finish reason ends it."""
    for line in lines:
        if not line.startswith("data: "):
            continue
        data = line[6:].strip()
        if data == "[DONE]":
            return
        try:
            choice = json.loads(data)["choices"][0]
            piece, done = (choice.get("delta") or {}).get("content"), choice.get("finish_reason")
        except (ValueError, KeyError, IndexError, TypeError, AttributeError):
            continue
        if piece:
            yield piece
        if done:
            return


def read_sse(lines: list[str]) -> list[str]:
    return list(stream_sse(lines))


#: Bytes kept of a file that introduces a project.
EXCERPTS = {"readme": 3000, "makefile": 1500, "manifest": 1500}
_MANIFESTS = ("go.mod", "package.json", "cargo.toml", "pyproject.toml", "pom.xml", "build.gradle", "composer.json", "gemfile")


def excerpt_kind(path: Column) -> Column:
    """``readme``, ``makefile`` or ``manifest`` for a file at the root, else null."""
    low = F.lower(path)
    return F.when(low.rlike(r"^readme(?:\.\w+)?$"), "readme").when(low.isin("makefile", "gnumakefile"), "makefile").when(low.isin(*_MANIFESTS), "manifest")


def excerpts(files: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """``(path, kind, text)``: the heads of readme, makefile and manifest, each of at most its
    number of bytes, cut at a character."""
    kind = excerpt_kind(F.col(path_col))
    most = F.lit(0)
    for k, n in EXCERPTS.items():
        most = F.when(kind == k, n).otherwise(most)
    return files.select(F.col(path_col).alias("path"), kind.alias("kind"), first_bytes(F.col(text_col), most).alias("text")).where("kind is not null")


def first_bytes(text: Column, n: Column) -> Column:
    """The longest head of a text that has at most ``n`` bytes and ends with a whole character."""
    head = F.substring(text.cast("binary"), F.lit(1), n)
    # a cut character leaves one to three bytes that are no text: take so many off
    whole = head.cast("string")
    for k in (1, 2, 3):
        shorter = F.substring(text.cast("binary"), F.lit(1), n - k).cast("string")
        whole = F.when(F.is_valid_utf8(whole), whole).otherwise(shorter)
    return whole


def duration_text(seconds: Column) -> Column:
    """A duration for reading: milliseconds below a second, then seconds, then minutes and seconds."""
    ms, whole = F.round(seconds * 1000).cast("long"), F.floor(seconds).cast("long")
    return F.when(seconds < 1, F.concat(ms.cast("string"), F.lit("ms"))).when(seconds < 60, F.concat(F.format_string("%.1f", F.round(seconds.cast("double"), 1)), F.lit("s"))).otherwise(F.concat(F.floor(whole / 60).cast("string"), F.lit("m"), (whole % 60).cast("string"), F.lit("s")))


def symbol_ref(text: Column) -> Column:
    """Struct (path, symbol) of a ``path:symbol`` text, split at the last colon; path is null
    where what stands before it does not look like one."""
    left, right = F.regexp_extract(text, r"(?s)^(.*):([^:]*)$", 1), F.regexp_extract(text, r"(?s)^(.*):([^:]*)$", 2)
    is_path = (right != "") & (left.contains("/") | left.rlike(r"\.\w+$"))
    return F.struct(F.when(is_path, left).alias("path"), F.when(is_path, right).otherwise(text).alias("symbol"))


def relative_path(path: str, root: str) -> str:
    """An absolute path below the root as one relative to it; others stay."""
    base = root.rstrip("/") + "/"
    return path[len(base) :] if path.startswith(base) else path


def declaration_text(spans: DataFrame, lines: DataFrame, most: int = 30) -> DataFrame:
    """``(name, path, start_line, text)`` of declarations ``(name, path, start_line, end_line)``:
    up to ``most`` lines; one whose end is not behind its start is balanced by its braces."""
    s = spans.select("name", F.col("path").alias("_p"), "start_line", "end_line").distinct()
    own = s.join(lines, (F.col("path") == F.col("_p")) & (F.col("line") >= F.col("start_line")) & (F.col("line") < F.col("start_line") + most))
    depth = lambda c: F.octet_length(F.col("text")) - F.octet_length(F.replace("text", F.lit(c), F.lit("")))
    w = Window.partitionBy("name", "_p", "start_line").orderBy("line")
    own = own.withColumn("_d", F.sum(depth("{") - depth("}")).over(w)).withColumn("_o", F.sum(depth("{")).over(w))
    closed = F.min(F.when((F.col("_o") > 0) & (F.col("_d") <= 0), F.col("line"))).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    any_ = F.max(F.when(F.col("line") <= F.col("start_line") + 1, F.col("_o"))).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.when(F.col("end_line") > F.col("start_line"), F.col("end_line")).otherwise(F.when(any_ > 0, F.coalesce(closed, F.col("start_line") + most)).otherwise(F.col("start_line")))
    kept = own.withColumn("_last", last).where("line <= _last")
    return kept.groupBy("name", F.col("_p").alias("path"), "start_line").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"])).alias("text"))


def function_context(symbols: DataFrame, lines: DataFrame, path: str, line: int, max_header: int = 50, max_types: int = 8, max_callees: int = 12, max_lines: int = 30) -> dict[str, DataFrame]:
    """What a reader of a function needs: the file's head, the declaration it belongs to, the
    types its body names with their text, and the signatures of what it calls."""
    me = symbols.where((F.col("path") == path) & (F.col("start_line") == line)).limit(1)
    body = lines.join(F.broadcast(me.select(F.col("path").alias("_p"), "start_line", "end_line", "name", "parent")), (F.col("path") == F.col("_p")) & F.col("line").between(F.col("start_line"), F.col("end_line")))
    words = body.select(F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))).alias("word"), "parent", F.col("name").alias("me")).distinct()
    calls = body.select(F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))).alias("word"), F.col("name").alias("me")).distinct()
    known = symbols.where(F.col("narrow_kind").isin("type", "interface"))
    types = known.join(words.where("word != coalesce(parent, '') and word rlike '^[A-Z]'"), F.col("name") == F.col("word"), "left_semi")
    types = types.orderBy("name", "path", "start_line").limit(max_types)
    holder = known.join(F.broadcast(me.select(F.col("parent").alias("_n"))), F.col("name") == F.col("_n"), "left_semi").orderBy(F.col("path") != path, "path", "start_line").limit(1)
    callees = symbols.where(F.col("kind").isin("function", "method")).join(calls.where("word != me"), F.col("name") == F.col("word"), "left_semi")
    return {
        "header": lines.where((F.col("path") == path) & (F.col("line") <= min(line - 1, max_header))).orderBy("line"),
        "parent": declaration_text(holder, lines, max_lines),
        "types": declaration_text(types, lines, max_lines).join(types.select("name", "path", "start_line", "signature"), ["name", "path", "start_line"]).orderBy("name", "path", "start_line"),
        "callees": callees.select("name", "path", "start_line", "signature").dropDuplicates(["name", "signature"]).orderBy("name", "path", "start_line").limit(max_callees),
    }


def choose_repositories(repos: DataFrame, name: str | None = None, every: bool = False, with_current: bool = False, current: str | None = None) -> DataFrame:
    """One named repository, all of them, all and the current one, or only the current
    one; two choices at once, an unknown name and an empty choice are errors."""
    if sum((name is not None, every, with_current)) > 1:
        raise ValueError("choose one of name, every, with_current")
    if name is not None:
        out = repos.where(F.col("name") == name)
    elif every:
        out = repos.where(F.col("name") != (current or ""))
    elif with_current:
        out = repos
    else:
        out = repos.where(F.col("name") == current)
    if out.isEmpty():
        raise LookupError(f"no repository {name or ''}".strip())
    return out


def parse_symbol_ref(text: str, root: str = "") -> tuple[str | None, str]:
    """``path:symbol`` at the last colon, if the left part looks like a path; an absolute one
    becomes relative to ``root``."""
    left, colon, right = text.rpartition(":")
    if colon and right and ("/" in left or re.search(r"\.\w+$", left)):
        return relative_path(left, root) if root else left, right
    return None, text
