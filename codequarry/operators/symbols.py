"""Symbols of source files by the rule tables, as one table function."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions.scalars import basename, extension
from codequarry.operators.formats import FORMATS
from codequarry.operators.languages import BY_EXTENSION, BY_FILE_NAME, BY_NAME, LANGUAGES, NARROW, Language

_STRINGS = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`\n]*`")


def language_of(path: Column) -> Column:
    """Language by extension, else by lower-cased file name; null if unknown."""
    ext = F.create_map(*(F.lit(x) for kv in BY_EXTENSION.items() for x in kv))
    names = F.create_map(*(F.lit(x) for kv in BY_FILE_NAME.items() for x in kv))
    return F.coalesce(ext[extension(path)], names[F.lower(basename(path))])


def is_test_path(path: Column, language: Column) -> Column:
    out = F.lit(False)
    for x in LANGUAGES:
        if x.tests != "(?!)":
            out = F.when(language == x.name, path.rlike(x.tests)).otherwise(out)
    return out


def plain(line: str, comments: tuple[str, ...]) -> str:
    """The line without string contents and trailing comment."""
    line = _STRINGS.sub('""', line)
    for c in comments:
        at = line.find(c)
        if at >= 0 and not (c == "#" and at > 0 and line[at - 1] in "$&{"):
            line = line[:at]
    return line


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" \t"))


def last_line(lines: list[str], at: int, lang: Language, depth: list[int] | None = None) -> int:
    """Index of a symbol's last line."""
    n = len(lines)
    if lang.ends in ("brace", "shell"):
        level, opened = 0, False
        for i in range(at, n):
            for ch in plain(lines[i], lang.comments):
                if ch == "{":
                    level, opened = level + 1, True
                elif ch == "}":
                    level -= 1
                    if opened and level <= 0:
                        return i
                elif ch == ";" and not opened and level == 0:
                    return i
            if not opened and i > at + 3:
                return at
        return n - 1 if opened else at
    if lang.ends == "indent":
        base, end = _indent(lines[at]), at
        for i in range(at + 1, n):
            s = lines[i].strip()
            if not s or s.startswith("#"):
                continue
            if _indent(lines[i]) <= base:
                break
            end = i
        return end
    if lang.ends == "end":
        level = 0
        for i in range(at, n):
            s = plain(lines[i], lang.comments)
            opens = re.match(r"\s*(?:class|module|def|if|unless|case|while|until|for|begin)\b", s) or re.search(r"\bdo\b(?:\s*\|[^|]*\|)?\s*$|=\s*(?:if|case|begin)\b", s)
            closes = re.search(r"\bend\b", s)
            level += bool(opens) - bool(closes)
            if level <= 0 and (closes or i > at):
                return i
        return n - 1
    if lang.ends == "sql":
        text, paren, begin, dollar = "", 0, 0, False
        for i in range(at, n):
            s = plain(lines[i], lang.comments)
            text = s.lower()
            dollar ^= text.count("$$") % 2 == 1
            begin += len(re.findall(r"\b(?:begin|case)\b", text)) - len(re.findall(r"\bend\b(?!\s+(?:if|loop))", text))
            paren += s.count("(") - s.count(")")
            if not dollar and begin <= 0 and paren <= 0 and s.rstrip().endswith((";", "$$")):
                return i
        return n - 1
    if lang.ends == "section":
        if lang.name == "markdown":
            rank = len(lines[at]) - len(lines[at].lstrip("#"))
            stop = lambda s: rank and re.match(rf"#{{1,{rank}}}\s", s)
        elif lang.name == "toml":
            stop = lambda s: s.startswith("[")
        else:
            stop = lambda s: s and not s[0].isspace() and not s.startswith("#")
        if lang.name == "markdown" and not rank or lang.name == "toml" and not lines[at].startswith("["):
            return at
        for i in range(at + 1, n):
            if stop(lines[i]):
                return i - 1
        return n - 1
    return at


def extract(content: str, language: str) -> list[dict]:
    """Symbols ``{name, kind, start_line, end_line, signature, parent}`` in file order."""
    lang = BY_NAME.get(language)
    if lang is None:
        return []
    lines = [x.rstrip("\r") for x in content.split("\n")]
    if lines and not lines[-1]:
        lines.pop()
    if language in FORMATS:
        return [{"name": n, "kind": k, "start_line": a + 1, "end_line": b + 1, "signature": lines[a].strip(), "parent": p} for k, n, a, b, p in FORMATS[language](lines)]
    out: list[dict] = []
    routine = -1  # last line of the SQL routine that is open: what it alters is no definition
    block = ""  # the settings block of a build script that is open
    holders: list[tuple[str, int]] = []
    for i, line in enumerate(lines):
        s = line.strip()
        if not s or (lang.comments and s.startswith(lang.comments) and lang.name not in ("markdown", "c", "cpp")):
            continue
        while holders and i > holders[-1][1]:
            holders.pop()
        if lang.name == "sql" and i <= routine and re.match(r"(?i)alter\b", s):
            continue
        if lang.name == "groovy":
            if block and s.startswith("}"):
                block = ""
            elif block:
                if m := re.match(r"(\w+)\s*=" if block == "environment" else r"\w+\s*\(?.*?\bname\s*:\s*['\"](\w+)", s):
                    out.append({"name": m[1], "kind": "variable", "start_line": i + 1, "end_line": i + 1, "signature": s, "parent": block})
                continue
            elif m := re.match(r"(environment|parameters)\s*\{", s):
                block = m[1]
                continue
        for kind, pattern in lang.rules:
            m = pattern.search(line)
            if not m or not m.groupdict().get("n") or m["n"] in lang.stop:
                continue
            parent = m.groupdict().get("p") or (holders[-1][0] if holders else "")
            if kind == "member" and not holders:
                if lang.name not in ("java", "csharp", "ruby", "protobuf"):
                    continue
            if kind == "static":  # a function of the class, not a method
                kind = "function"
            elif kind == "member" or (kind == "function" and holders and lang.inside):
                kind = "method" if holders else "function"
            end = last_line(lines, i, lang) if kind not in ("constant", "variable", "import", "package", "property") else i
            if lang.name == "sql" and kind == "function":
                routine = max(routine, end)
            if kind in lang.inside or (lang.name == "perl" and kind == "package"):
                end = len(lines) - 1 if lang.name == "perl" else end
                holders.append((m["n"], end))
                if kind == "package":
                    end = i
            names = [] if kind == "impl" else re.findall(r":(\w+)", s) if lang.name == "ruby" and kind == "property" else [m["n"]]
            for name in names:
                out.append({"name": name, "kind": kind, "start_line": i + 1, "end_line": end + 1, "signature": s, "parent": parent})
            break
    return out


_SCHEMA = "path string, language string, ordinal int, name string, kind string, narrow_kind string, start_line int, end_line int, signature string, parent string"


def symbol_table(files: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """Symbols of all files with a known language, ``ordinal`` in extraction order.
    Null paths and texts give no row; other columns are ignored."""
    src = files.select(F.col(path_col).cast("string").alias("path"), language_of(F.col(path_col)).alias("language"), F.col(text_col).cast("string").alias("text")).where("path is not null and text is not null and language is not null")
    kinds = {"ordinal": pa.int32(), "start_line": pa.int32(), "end_line": pa.int32()}
    names = [c.split()[0] for c in _SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for path, language, text in zip(*(c.to_pylist() for c in batch.columns)):
                for k, s in enumerate(extract(text, language)):
                    rows.append({"path": path, "language": language, "ordinal": k, "narrow_kind": NARROW.get(s["kind"], s["kind"]), **s})
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)

    return src.mapInArrow(run, _SCHEMA)


_FUNCTIONS = "id string, path string, language string, name string, parent string, start_line int, source string"


def function_table(files: DataFrame, id_col: str, path_col: str, text_col: str, line_col: str | None = None) -> DataFrame:
    """Every function and method with its own text; ``id`` is the row's id, ``#`` and the
    function's ordinal. ``line_col`` is the file line of the text's first line."""
    src = files.select(
        F.col(id_col).cast("string").alias("id"), F.col(path_col).cast("string").alias("path"), language_of(F.col(path_col)).alias("language"),
        F.col(text_col).cast("string").alias("text"), (F.col(line_col).cast("int") if line_col else F.lit(1)).alias("line"),
    ).where("id is not null and text is not null and language is not null")
    names = [c.split()[0] for c in _FUNCTIONS.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for key, path, language, text, line in zip(*(c.to_pylist() for c in batch.columns)):
                lines = text.split("\n")
                for k, s in enumerate(x for x in extract(text, language) if x["kind"] in ("function", "method")):
                    rows.append((f"{key}#{k}", path, language, s["name"], s["parent"], max(line or 1, 1) + s["start_line"] - 1, "\n".join(lines[s["start_line"] - 1 : s["end_line"]])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "start_line" else pa.string()) for n, c in zip(names, zip(*rows))], names=names)

    return src.mapInArrow(run, _FUNCTIONS)


def traceable(files: DataFrame, path_col: str, skip_names: list[str] = ()) -> DataFrame:
    """Files that traces read: a known language, no test file, no hidden or listed folder;
    ignore rules and the size limit do not apply."""
    p = F.col(path_col)
    language = language_of(p)
    folders = F.slice(F.split(p, "/"), 1, F.greatest(F.size(F.split(p, "/")) - 1, F.lit(0)))
    skipped = F.exists(folders, lambda x: x.startswith(".") | x.isin(list(skip_names)) if skip_names else x.startswith("."))
    return files.where(language.isNotNull() & ~is_test_path(p, language) & ~skipped)


def find_functions(symbols: DataFrame, name: str, language: str = "", file_part: str = "") -> DataFrame:
    """Function candidates with a usable range; languages without control flow are hidden
    unless one is asked for."""
    out = find_candidates(symbols, name, ["function", "method"], file_part, language).where("end_line >= start_line")
    return out if language else out.where(F.col("language").isin([x.name for x in LANGUAGES if x.style != "unsupported"]))


def find_candidates(symbols: DataFrame, name: str, kinds: list[str] = (), file_part: str = "", language: str = "", parent: str = "") -> DataFrame:
    """Symbols of a name under optional filters, one per place, by file and line."""
    out = symbols.where((F.col("name") == name) & (F.col("start_line") > 0))
    if kinds:
        out = out.where(F.col("narrow_kind").isin(list(kinds)))
    if file_part:
        out = out.where(F.col("path").contains(file_part))
    if language:
        out = out.where(F.lower("language") == language.lower())
    if parent:
        out = out.where(F.lower("parent") == parent.lower())
    return out.dropDuplicates(["path", "start_line", "end_line", "parent"]).orderBy("path", "start_line", "ordinal")


class NotFound(LookupError):
    pass


class Ambiguous(LookupError):
    def __init__(self, subject: str, rows: list):
        super().__init__(f"{subject} is ambiguous: " + ", ".join(f"{r.path}:{r.start_line}" for r in rows))
        self.rows = rows


def select_one(candidates: DataFrame, subject: str):
    """The only candidate; NotFound for none, Ambiguous with all of them (definitions of
    one name) for several."""
    rows = candidates.collect()
    if not rows:
        raise NotFound(subject)
    if len(rows) > 1:
        raise Ambiguous(subject, rows)
    return rows[0]
