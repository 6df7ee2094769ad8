"""Source trees: listing, text-file and ignore predicates, incremental reads."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.scalars import basename, extension, glob_to_regex

MAX_FILE_BYTES = 1 << 20

#: Extensions of text files.
TEXT_EXTENSIONS = (
    "go js ts jsx tsx py rb rs java kt c h cpp hpp cc cs swift m mm php lua zig nim scala clj ex exs erl hs ml fs fsx r jl dart v vhdl "
    "pl pm sh bash zsh fish ps1 bat cmd html htm css scss sass less vue svelte astro json yaml yml toml xml ini cfg conf env properties "
    "md rst txt adoc tmpl tpl ejs hbs pug mk cmake gradle sql proto dockerfile graphql gql"
).split()
#: File names that are text without such an extension.
TEXT_NAMES = "makefile dockerfile rakefile gemfile cmakelists.txt go.mod go.sum cargo.toml cargo.lock package.json tsconfig.json .gitignore .dockerignore".split()


@dataclass(frozen=True)
class IgnoreRule:
    pattern: str
    negated: bool = False
    dir_only: bool = False
    anchored: bool = False


def parse_rule(line: str) -> IgnoreRule | None:
    """One line of an ignore file; None for blanks and comments."""
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    dir_only = line.endswith("/")
    line = line[: len(line) - dir_only]
    return IgnoreRule(line.removeprefix("/"), negated, dir_only, "/" in line) if not line.startswith("/") else IgnoreRule(line, negated, dir_only, True)


def parse_rules(text: str) -> list[IgnoreRule]:
    return [r for line in text.split("\n") if (r := parse_rule(line))]


def load_rules(root: str, files: tuple[str, ...] = (".gitignore",)) -> list[IgnoreRule]:
    """Rules of a tree's ignore files in order, so that later files win; missing ones are skipped."""
    out: list[IgnoreRule] = []
    for name in files:
        path = os.path.join(root, name)
        if os.path.isfile(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                out += parse_rules(f.read())
    return out


def is_text_file(path: Column) -> Column:
    name = F.lower(basename(path))
    return name.isin(TEXT_NAMES) | extension(path).isin([f".{e}" for e in TEXT_EXTENSIONS])


def _verdict(path: Column, is_dir: bool, rules: list[IgnoreRule]) -> Column:
    """Last matching rule wins."""
    out = F.lit(False)
    for r in rules:
        pattern = glob_to_regex(r.pattern)
        if pattern is None or (r.dir_only and not is_dir):
            continue
        subject = path if r.anchored else F.element_at(F.split(path, "/"), -1)
        out = F.when(subject.rlike(pattern), F.lit(not r.negated)).otherwise(out)
    return out


def is_ignored(path: Column, names: list[str], rules: list[IgnoreRule]) -> Column:
    """A path part is a listed name, or a parent folder is ignored (nothing below it
    comes back), or the last rule that matches the file ignores it.

    All folders above a path are tried, so a flat list of paths gives what a walk
    that skips ignored folders gives, at any depth.
    """
    parts = F.split(path, "/")
    listed = F.arrays_overlap(parts, F.array(*(F.lit(n) for n in names))) if names else F.lit(False)
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.concat_ws("/", F.slice(parts, F.lit(1), n)))
    by_folder = F.when(F.size(parts) > 1, F.exists(above, lambda p: _verdict(p, True, rules))).otherwise(False)
    return listed | by_folder | _verdict(path, False, rules)


def indexable(files: DataFrame, path: str, size: str | None, names: list[str], rules: list[IgnoreRule]) -> DataFrame:
    """Files to index: text, not hidden, not ignored, at most 1 MiB."""
    p = F.col(path)
    hidden = F.exists(F.split(p, "/"), lambda x: x.startswith(".") & ~x.isin(".gitignore", ".dockerignore"))
    out = files.where(is_text_file(p) & ~hidden & ~is_ignored(p, names, rules))
    return out.where(F.col(size) <= MAX_FILE_BYTES) if size else out


def scan_tree(spark: SparkSession, root: str, modified_after: str | None = None, names: list[str] = (), rules: list[IgnoreRule] = ()) -> DataFrame:
    """``(path, mod_time, size, content)`` of a tree's indexable files through the binary
    file source; ``modified_after`` keeps files strictly newer."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    base = os.path.abspath(root).rstrip("/") + "/"
    files = reader.load(root).select(
        F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + base, "").alias("path"), F.col("modificationTime").alias("mod_time"), F.col("length").alias("size"), "content"
    )
    return indexable(files, "path", "size", list(names), list(rules)).withColumn("content", F.col("content").cast("string"))


def walk_following_links(root: str) -> list[tuple[str, str, float, int]]:
    """(path, absolute path, mtime, size) of a local tree, following folder links that
    stay within it; real folders win over links and no folder is visited twice."""
    top = os.path.realpath(root)
    out, seen, later = [], {top}, []

    def visit(real: str, logical: str) -> None:
        for e in sorted(os.scandir(real), key=lambda x: x.name):
            at = f"{logical}/{e.name}" if logical else e.name
            target = os.path.realpath(e.path)
            if e.is_symlink() and (not os.path.exists(target) or os.path.relpath(target, top).startswith("..")):
                continue
            if os.path.isdir(target):
                if e.is_symlink():
                    later.append((target, at))
                elif target not in seen:
                    seen.add(target)
                    visit(target, at)
            else:
                st = os.stat(target)
                out.append((at, e.path, st.st_mtime, st.st_size))

    visit(top, "")
    while later:
        target, at = later.pop(0)
        if target not in seen:
            seen.add(target)
            visit(target, at)
    return out
