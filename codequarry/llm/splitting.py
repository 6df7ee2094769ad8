"""Oversized items cut by recursive bisection at natural boundaries.

A text above its limit is cut at the strongest boundary near its middle (a symbol's
first line, then a blank line, a line of least indent, any line, a blank, any
character); each half still above the limit minus the overlap is cut again. The
overlaps are attached last, so every piece stays within the limit.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.textkernels import flat

BYTES_PER_TOKEN, DEFAULT_SIZE, DEFAULT_OVERLAP = 4, 512, 50

#: Lines that open a symbol, by the common forms of many languages.
_SYMBOL = re.compile(
    rb"^[ \t]{0,4}(?:@[\w.]+[^\n]*\n[ \t]*)*(?:(?:export|default|public|private|protected|internal|static|final|abstract|async|pub(?:\([a-z]+\))?|unsafe|extern|inline|const|override|virtual|sealed)[ \t]+)*"
    rb"(?:(?:func|def|fn|function|fun|class|struct|enum|trait|interface|impl|module|namespace|type|record|object|protocol|extension|sub|procedure|proc)\b[ \t*]*(?:\([^)\n]*\)[ \t]*)?([A-Za-z_]\w*)?"
    rb"|CREATE[ \t]+(?:OR[ \t]+REPLACE[ \t]+)?(?:TABLE|VIEW|FUNCTION|PROCEDURE|INDEX|TRIGGER)[ \t]+([\w.]+)"
    rb"|(?:[A-Za-z_][\w<>,\[\]]*[ \t*]+)+([A-Za-z_]\w*)[ \t]*\([^;{}\n]*\)[ \t]*(?:throws[ \t]+[\w, ]+)?(?:\{|\r?\n\{)|([A-Za-z_]\w*)[ \t]*\(\)[ \t]*\{|([A-Za-z_][\w-]*):[ \t]*\r?$)",
    re.M,
)
_NOT_NAMES = frozenset(b"if for while switch return else case catch do with when match".split())


def limits(size: int | None, overlap: int | None) -> tuple[int, int]:
    """(limit, overlap) in bytes: a size that is null, zero or negative means 512
    tokens; an overlap that is null or negative means 50, one not below the size
    a tenth of the size."""
    size = size if size and size > 0 else DEFAULT_SIZE
    overlap = DEFAULT_OVERLAP if overlap is None or overlap < 0 else overlap
    if overlap >= size:
        overlap = size // 10
    return size * BYTES_PER_TOKEN, overlap * BYTES_PER_TOKEN


def symbols(raw: bytes) -> list[tuple[int, str]]:
    """(line start, name) of every line that opens a symbol."""
    out = []
    for m in _SYMBOL.finditer(raw):
        name = next((g for g in m.groups() if g), None)
        if name and name not in _NOT_NAMES:
            out.append((m.start(), name.decode("utf-8", "replace")))
    return out


def bisect_text(raw: bytes, most: int, marks: list[int]) -> list[int]:
    """Cut positions, with 0 and the length, so that no part exceeds ``most`` bytes.
    ``marks`` are the line starts of symbols."""
    data = np.frombuffer(raw, np.uint8)
    line = np.flatnonzero(data == 10) + 1
    starts = np.append(0, line)
    ends = np.append(line, len(raw))
    width, blank = np.zeros(len(starts), np.int64), np.zeros(len(starts), bool)
    for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
        body = raw[s:e].lstrip(b" \t")
        width[i], blank[i] = e - s - len(body), not body.strip()
    level = np.ones(len(starts), np.int8)
    level[width == 0] = 2
    level[1:][blank[:-1]] = 3
    level[np.isin(starts, np.array(marks, np.int64))] = 4
    level[blank] = 0  # a cut before a blank line is no better than one inside a line
    pos = {v: starts[level == v].tolist() for v in (4, 3, 2, 1)}
    pos[0] = (np.flatnonzero((data == 32) | (data == 9)) + 1).tolist() if (ends - starts).max(initial=0) > most else []

    def cut(lo: int, hi: int) -> int:
        mid, near = (lo + hi) // 2, (hi - lo) // 4
        for a, b in ((mid - near, mid + near), (lo + 1, hi - 1)):
            for v in (4, 3, 2, 1):
                p = pos[v]
                i, j = bisect_left(p, max(a, lo + 1)), bisect_right(p, min(b, hi - 1))
                if i < j:
                    k = bisect_left(p, mid, i, j)
                    return min(p[max(i, k - 1) : min(j, k + 1)], key=lambda x: abs(x - mid))
        p = pos[0]
        i, j = bisect_left(p, max(lo + 1, mid - near)), bisect_right(p, min(hi - 1, mid + near))
        if i < j:
            k = bisect_left(p, mid, i, j)
            return min(p[max(i, k - 1) : min(j, k + 1)], key=lambda x: abs(x - mid))
        c = mid
        while c > lo + 1 and (raw[c] & 0xC0) == 0x80:
            c -= 1
        if c > lo + 1 and raw[c - 1 : c + 1] == b"\r\n":
            c -= 1
        if (raw[c] & 0xC0) == 0x80:  # a single long character left of the middle
            c = mid
            while c < hi - 1 and (raw[c] & 0xC0) == 0x80:
                c += 1
        return c

    out, stack = [], [(0, len(raw))]
    while stack:
        lo, hi = stack.pop()
        if hi - lo <= most or hi - lo < 2:
            out.append(hi)
            continue
        c = cut(lo, hi)
        if not lo < c < hi or (raw[c] & 0xC0) == 0x80:
            out.append(hi)
            continue
        stack += [(c, hi), (lo, c)]
    return [0, *out]


def overlap_start(raw: bytes, at: int, overlap: int) -> int:
    """Where the overlap before ``at`` begins: at a line start if one lies within it,
    else at a character."""
    if overlap <= 0 or at <= 0:
        return at
    low = max(0, at - overlap)
    if low == 0 or raw[low - 1 : low] == b"\n":
        return low
    nl = raw.find(b"\n", low, at - 1)
    if nl >= 0:
        return nl + 1
    while low < at and (raw[low] & 0xC0) == 0x80:
        low += 1
    return low


def pieces(raw: bytes, size: int | None, overlap: int | None, start_line: int | None, symbol: str | None):
    """Rows (start, overlap bytes, text, first line, last line, symbol) of one item."""
    limit, back = limits(size, overlap)
    first = start_line if start_line and start_line > 0 else 1
    found = symbols(raw) if len(raw) > limit or not symbol else []
    cuts = [0, len(raw)] if len(raw) <= limit else bisect_text(raw, limit - back, [p for p, _ in found])
    names = [p for p, _ in found]
    line, at = first, 0
    for s, e in zip(cuts[:-1], cuts[1:]):
        b = overlap_start(raw, s, back if s else 0)
        text = raw[b:e]
        line += raw.count(b"\n", at, b) if b >= at else -raw.count(b"\n", b, at)
        at = b
        last = max(line, line + text.count(b"\n") - (1 if text.endswith(b"\n") else 0))
        name = symbol or None
        if not name and found:
            k = bisect_right(names, s) - 1
            name = found[k][1] if k >= 0 else next((n for p, n in found if p < e), None)
        yield b, s - b, text, line, last, name


def split_oversized(df: DataFrame, id_col: str = "info_id", text_col: str = "content", size_col: str = "chunk_size", overlap_col: str = "overlap", line_col: str = "start_line", symbol_col: str = "symbol_name") -> DataFrame:
    """``(id, piece_no, n_pieces, start_line, end_line, symbol_name, overlap_bytes, content)``.

    An item within its limit gives one piece. A start line that is null or below 1
    counts as 1. A given symbol name stands for every piece; without one, a piece
    takes the symbol that is open where it begins. Only where a single character
    is wider than the limit does a piece exceed it. A null text counts as empty;
    rows with a null id are left out; rows that repeat an id give their pieces
    once per row. Other columns are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, off = flat(batch.column(1))
            raw = data.tobytes()
            size, overlap, line, symbol = (batch.column(c).to_pylist() for c in range(2, 6))
            who, rows = [], []
            for i in range(batch.num_rows):
                own = list(pieces(raw[off[i] : off[i + 1]], size[i], overlap[i], line[i], symbol[i]))
                who += [i] * len(own)
                rows += [(k, len(own), p[3], p[4], p[5], p[1], p[2].decode("utf-8", "replace")) for k, p in enumerate(own)]
            if rows:
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=["id", "piece_no", "n_pieces", "start_line", "end_line", "symbol_name", "overlap_bytes", "content"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).cast("int") for c in (size_col, overlap_col, line_col)), F.col(symbol_col).cast("string")).where("id is not null")
    return src.mapInArrow(run, f"id {kind}, piece_no int, n_pieces int, start_line int, end_line int, symbol_name string, overlap_bytes int, content string")
