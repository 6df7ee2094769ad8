"""Generated, minified, vendored and data-only source files.

Path rules are Spark expressions. The file's head (the comment lines before its
first code, in its first chunk) goes through an Aho-Corasick automaton of notices.
Where neither speaks, shape decides (minified code, data kept as code, code in periodic
runs), measured over all chunks of a file: only a handful of numbers a file are shuffled,
combined before the exchange. A chunk stored twice is measured once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folders that hold third-party copies (a package folder follows).
VENDOR_DIRS = "vendor third_party third-party thirdparty 3rdparty 3rd_party node_modules bower_components site-packages dist-packages jspm_packages Pods Carthage extern external externals deps godeps Godeps".split()
#: Lockfiles.
LOCKFILES = "package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml composer.lock Cargo.lock Gemfile.lock Pipfile.lock poetry.lock go.sum".split()
#: Notices that a tool writes, as they open a comment.
GENERATED_NOTICES = [
    "code generated by", "@generated", "<auto-generated", "auto-generated", "autogenerated", "auto generated", "automatically generated",
    "generated code", "generated by", "generated at", "generated from", "generated with", "generated file", "generated automatically",
    "this file was automatically", "this file is automatically", "this file was generated", "this file is generated", "this code was generated",
    "this file has been generated", "this file has been automatically", "machine-written", "machine generated", "machine-generated", "do not edit", "do not modify", "don't edit",
    "automatisch erzeugt", "automatisch generiert", "maschinell erzeugt", "diese datei wurde automatisch", "diese datei wurde maschinell", "diese datei wurde generiert",
    "fichier produit par", "fichier généré", "ce fichier a été généré", "généré automatiquement", "archivo generado", "este archivo fue generado",
    "generado automáticamente", "gerado automaticamente", "arquivo gerado", "file generato", "generato automaticamente", "automatisch gegenereerd",
    "gegenereerd door", "wygenerowano", "plik wygenerowany", "сгенерировано", "этот файл создан", "файл создан автоматически", "自動生成",
]
#: Words of what a reader might do, and of what becomes of it; a comment line
#: with one of either says that a tool writes the file again.
CHANGES = ["edit", "modif", "manual", "change", "bearbeit", "änder", "éditer", "refresh", "touch"]
FATES = ["overwrit", "survive", "be lost", "discard", "regenerat", "next build", "template", "instead", "nicht", "ne pas", "no editar", "não edit", "non modific", "to refresh it", "rerun"]
WARNINGS = ["hands off", "regenerate with"]
#: Words of taking, and of where from; a comment line with one of either marks
#: a copy of another project.
TAKEN = ["bundled", "redistribut", "imported", "taken from", "copied from", "vendored", "copy of", "mirrored", "upstream"]
ORIGINS = ["upstream", "release", "revision", "version", "commit", "licen", "tag ", "their copying"]
#: Phrases that show a file only speaks of such notices.
DENIALS = ["written by hand", "hand-written", "handwritten", "hand written", "our own team", "that start with", "the words", "code is ours", "looks for", "detects", "not generated"]

_COMMENT = re.compile(r"^\s*(?://+!?|#+!?|--+|/\*+|\*+(?!/)|<!--|;+|\"\"\"|'''|%|rem\b)\s*(.*?)\s*(?:\*+/|-->|\"\"\"|''')?\s*$", re.I)
#: Lines that may stand before a notice.
_PROLOGUE = re.compile(r"^\s*(?:#!|<\?|package\b|module\b|['\"]use strict|import\b|from\b|using\b|@charset)", re.I)
_LEAD = re.compile(r"^[\s<@\W]*", re.UNICODE)
_NUMBERS = re.compile(r"(?:[-+]?(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)[\s,;]+(?:(?:--|//|#)\s*)?){8,}")
_BLOB = re.compile(r"[\"'][A-Za-z0-9+/=_-]{60,}[\"'\\]")
_RECORDS = re.compile(r"(?:\\?[\"'][A-Za-z_]{1,16}\\?[\"']\s*:\s*[\[{]?(?:\\?[\"'][^\"'\\]{0,40}\\?[\"']|-?[\d.]+(?:\s*,\s*-?[\d.]+)*|true|false|null)[\]}\s]*,?\s*\{?\s*){4,}")

_STRING, _NAME, _NUMBER = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'"), re.compile(r"[^\W\d]\w*"), re.compile(r"\d+")
_MAX_PERIOD = 8
_COMMENT_MARKS = ("//", "#", "--", "/*", "* ", "*/", "<!--")

METRICS = ["n_chars", "n_space", "n_lines", "n_data", "n_full", "n_periodic"]


def path_kind(path: Column) -> Column:
    """``vendored``, ``lockfile``, ``minified``, ``generated`` or null by the path alone."""
    dirs = "|".join(re.escape(d) for d in VENDOR_DIRS)
    locks = "|".join(re.escape(x) for x in LOCKFILES)
    return (
        F.when(path.rlike(rf"(?:^|/)(?:{dirs})/[^/]+/"), "vendored")
        .when(path.rlike(rf"(?:^|/)(?:{locks})$"), "lockfile")
        .when(path.rlike(r"(?i)[.-]min\.[cm]?[a-z]+$|\.prod\.m?js$|\.bundle\.m?js$|[.-](?=[0-9a-f]*[0-9])[0-9a-f]{8,20}\.m?js$|\.(?:js|css)\.map$"), "minified")
        .when(path.rlike(r"(?i)\.(?:generated|autogen|g|pb|pb2|gen|designer)\.[a-z]+$|(?:_pb2(?:_grpc)?|_gen|_generated|\.pb\.gw)\.[a-z]+$|(?:^|/)zz_generated\.[^/]*$|(?:^|/)generated/|(?:^|/)gen/stubs/"), "generated")
    )


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    words: dict[str, set[str]] = {}
    for kind, phrases in (("start", GENERATED_NOTICES), ("change", CHANGES), ("fate", FATES), ("generated", WARNINGS), ("taken", TAKEN), ("origin", ORIGINS), ("denied", DENIALS)):
        for p in phrases:
            words.setdefault(p, set()).add(kind)
    for p, kinds in words.items():
        a.add_word(p, (len(p), tuple(sorted(kinds))))
    a.make_automaton()
    return a


def head_kind(text: str, automaton) -> str | None:
    """What the comments at the head of a file say it is: ``generated``, ``vendored`` or None."""
    for line in text.split("\n"):  # ends at the first line of code
        if not line.strip():
            continue
        m = _COMMENT.match(line.rstrip("\r"))
        if not m:
            if _PROLOGUE.match(line):
                continue
            break
        body = m[1].lower()
        lead = _LEAD.match(body).end()
        found, where = set(), {}
        for end, (size, kinds) in automaton.iter(body):
            start = end - size + 1
            for k in kinds:
                if k != "start":
                    found.add(k)
                    where.setdefault(k, set()).add(start)
                elif start <= lead:
                    found.add("generated")
        if "denied" in found:
            return None
        if {"change", "fate"} <= found:
            found.add("generated")
        if {"taken", "origin"} <= found and len(where["taken"] | where["origin"]) > 1:  # two words, not one of both kinds
            found = {"vendored"}
        for kind in ("generated", "vendored"):
            if kind in found:
                return kind
    return None


def data_chars(text: str) -> int:
    return sum(m.end() - m.start() for p in (_NUMBERS, _BLOB, _RECORDS) for m in p.finditer(text))


def periodic_lines(text: str) -> tuple[int, int]:
    """(lines in periodic runs, lines) of a text without blank and comment lines. With
    names, numbers and strings masked, code that a tool writes field by field repeats one
    line, or one block of up to eight lines, many times in a row: five blocks with a
    long line in them, or four long lines."""
    masked = _NUMBER.sub("\x03", _NAME.sub("\x02", _STRING.sub("\x01", text)))
    shapes = [y for x in masked.split("\n") if (y := x.strip(" \t\r")) and not y.startswith(_COMMENT_MARKS)]
    code: dict[str, int] = {}
    a = np.array([code.setdefault(x, len(code)) for x in shapes], np.int64)
    long = np.array([sum(map(x.count, "\x01\x02\x03")) > 4 for x in shapes], bool)
    marked = np.zeros(len(a), bool)
    for p in range(1, min(_MAX_PERIOD, len(a) - 1) + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (a[p:] == a[:-p]).astype(np.int8), [0]])))
        for s, e in zip(edges[::2], edges[1::2]):
            if e - s >= (3 if p == 1 else 4 * p) and long[s : s + p].any():
                marked[s : e + p] = True
    return int(marked.sum()), len(a)


def _measurer():
    schema = pa.schema([("path", pa.string()), ("chunk", pa.string()), ("head", pa.string()), *((m, pa.int64()) for m in METRICS)])
    state: dict = {}

    def run(batches):
        if not state:
            state["automaton"] = _automaton()
        for batch in batches:
            path, chunk, first, text = batch.to_pydict().values()
            rows = {"path": path, "chunk": chunk, "head": [head_kind(t, state["automaton"]) if f else None for t, f in zip(text, first)]}
            rows["n_chars"] = [len(t) for t in text]
            rows["n_space"] = [len(t) - len("".join(t.split())) for t in text]
            rows["n_lines"] = [t.count("\n") + 1 for t in text]
            rows["n_data"] = [data_chars(t) for t in text]
            runs = [periodic_lines(t) for t in text]
            rows["n_periodic"], rows["n_full"] = [r[0] for r in runs], [r[1] for r in runs]
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    return run, "path string, chunk string, head string, " + ", ".join(f"{m} long" for m in METRICS)


def classify_files(df: DataFrame, path_col: str, text_col: str, chunk_col: str, *, data_share: float = 0.5, space_share: float = 0.06, line_chars: int = 160, periodic_share: float = 0.5, least_lines: int = 8) -> DataFrame:
    """``(file_path, kind)`` of every file: ``vendored``, ``lockfile``, ``minified``,
    ``generated``, ``data`` or ``handwritten``.

    A chunk id ends in the chunk's number within its file; chunk 0 holds the head.
    Rows with a null path are left out, a null text counts as empty, a chunk id that
    repeats counts once (its largest figures), chunks without an id by their text.
    Path rules and head notices are the method; the three shapes (``data``, ``minified``,
    periodic runs) only speak for files that neither names. Other columns are ignored.
    """
    text, chunk = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(chunk_col).cast("string")
    rows = df.select(F.col(path_col).cast("string").alias("path"), F.coalesce(chunk, F.hex(F.xxhash64(text))).alias("chunk"), F.coalesce(chunk.rlike(r"_0+$"), F.lit(True)).alias("first"), text.alias("text")).where("path is not null")
    run, schema = _measurer()
    # a chunk may be stored twice with equal content; first by chunk, which spreads a file of many chunks
    per_chunk = rows.mapInArrow(run, schema).groupBy("path", "chunk").agg(F.max("head").alias("head"), *(F.max(m).alias(m) for m in METRICS))
    per_file = per_chunk.groupBy("path").agg(F.max("head").alias("head"), *(F.sum(m).alias(m) for m in METRICS))
    by_path = path_kind(F.col("path"))
    minified = F.col("path").rlike(r"(?i)\.(?:[cm]?js|jsx|ts|css)$") & (F.col("n_space") < F.lit(space_share) * F.col("n_chars")) & (F.col("n_chars") > F.lit(line_chars) * F.col("n_lines"))
    data = (F.col("n_data") > F.lit(data_share) * F.col("n_chars")) & (F.col("n_chars") > 0)
    periodic = (F.col("n_periodic") > F.lit(periodic_share) * F.col("n_full")) & (F.col("n_full") >= least_lines)
    return per_file.select(F.col("path").alias("file_path"), F.coalesce(by_path, F.col("head"), F.when(data, "data"), F.when(minified, "minified"), F.when(periodic, "generated"), F.lit("handwritten")).alias("kind"))
