"""Column functions shared by all operators. Lengths are bytes, word edges are ASCII."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BYTES_PER_TOKEN = 4


def byte_count(text: Column, term: Column | str) -> Column:
    """Non-overlapping occurrences of a literal term."""
    t = F.lit(term) if isinstance(term, str) else term
    return ((F.octet_length(text) - F.octet_length(F.replace(text, t, F.lit("")))) / F.octet_length(t)).cast("int")


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapse_space(text: Column) -> Column:
    return trim_space(F.regexp_replace(text, r"\s+", " "))


def line_count(text: Column) -> Column:
    """0 for an empty text, else 1 + line feeds."""
    return F.when(F.octet_length(text) == 0, 0).otherwise(1 + byte_count(text, "\n"))


def token_estimate(text: Column) -> Column:
    return F.floor(F.octet_length(text) / BYTES_PER_TOKEN).cast("long")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def short_hash(*parts: Column) -> Column:
    """First 16 hex digits over the parts joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for null, empty, unequal or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm > 0)
    return F.when(ok, dot(a, b) / norm).otherwise(F.lit(0.0))


def whole_word(name: str) -> str:
    """Pattern of a whole ASCII word."""
    return rf"(?<![A-Za-z0-9_])\Q{name}\E(?![A-Za-z0-9_])"


#: Identifier directly before an opening parenthesis.
CALL_PATTERN = r"(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*)\s*\("


def call_names(text: Column) -> Column:
    """Names called in a text, with string literals blanked."""
    plain = F.regexp_replace(text, r"\"[^\"\n]*\"|'[^'\n]*'|`[^`\n]*`", '""')
    return F.array_distinct(F.regexp_extract_all(plain, F.lit(CALL_PATTERN), F.lit(1)))


def identifiers(text: Column) -> Column:
    """Distinct identifiers of a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))))


def words(text: Column) -> Column:
    """Parts between runs of white space, empty ones dropped."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def snippet(text: Column, lines: int) -> Column:
    return F.concat_ws("\n", F.slice(F.split(trim_space(text), "\n"), 1, lines))


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, "\n\n"), trim_space), lambda p: p != "")


def truncate_bytes(text: Column, n: int) -> Column:
    """At most ``n`` characters before an ellipsis once the text exceeds ``n`` bytes."""
    return F.when(F.octet_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def glob_to_regex(glob: str) -> str | None:
    """Anchored pattern of a path glob; ``*`` and ``?`` stay within a path part. None
    for a malformed glob, which never matches."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                return None
            body = glob[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] == "^" else body).replace("\\", "\\\\") + "]")
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def mermaid_escape(text: Column) -> Column:
    """Characters that end a diagram label, replaced in one pass by entity codes."""
    table = {'"': "#quot;", "<": "#lt;", ">": "#gt;", "{": "#123;", "}": "#125;", "[": "#91;", "]": "#93;", "(": "#40;", ")": "#41;", "|": "#124;"}
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.concat_ws("", F.transform(F.split(text, ""), lambda c: F.coalesce(pairs[c], c)))
