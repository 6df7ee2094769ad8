"""Files to chunks: greedy line packing with overlap, and packing along symbols.

One row in, some rows out, no shuffle; a file's lines are handled as bytes.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_BYTES = 16


@dataclass(frozen=True)
class ChunkSize:
    """Sizes in tokens of four bytes; out-of-range values take their defaults."""

    size: int = 512
    overlap: int = 50

    def bytes(self) -> tuple[int, int]:
        size = self.size if self.size > 0 else 512
        overlap = 50 if self.overlap < 0 else self.overlap
        return size * 4, (size // 10 if overlap >= size else overlap) * 4


def _sha(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def _row(path: str, index: int, start: int, text: bytes, symbol: str | None = None, end: int | None = None, header: str | None = None) -> dict:
    last = end if end is not None else max(start, start + text.count(b"\n") - text.endswith(b"\n"))
    plain = text.decode("utf-8", "replace")
    return {
        "chunk_id": f"{path}_{index}",
        "start_line": start,
        "end_line": last,
        "content": plain,
        "hash": _sha(f"{path}:{start}:{last}:".encode() + text)[:16],
        "content_hash": _sha(text),
        "embed_content": f"File: {path}\n{header or ''}\n{plain}",
        "symbol_name": symbol,
    }


def pack_lines(lines: list[bytes], most: int, overlap: int) -> list[tuple[int, int]]:
    """(first, end) line ranges: as many lines as fit, at least one; the next range
    begins early enough to repeat ``overlap`` bytes in whole lines, the crossing line
    included. A range of under 16 bytes of text is skipped without overlap."""
    out, at = [], 0
    while at < len(lines):
        end, used = at, 0
        while end < len(lines) and used + len(lines[end]) <= most:
            used += len(lines[end])
            end += 1
        end = max(end, at + 1)
        if len(b"".join(lines[at:end]).strip()) < MIN_BYTES:
            at = end
            continue
        out.append((at, end))
        back, seen = end, 0
        while overlap and end < len(lines) and back > 0 and seen < overlap:
            back -= 1
            seen += len(lines[back])
        at = back if overlap and at < back < end else end
    return out


def chunk_file(path: str, content: str, size: ChunkSize = ChunkSize()) -> list[dict]:
    raw = content.encode()
    if not raw.strip():
        return []
    most, overlap = size.bytes()
    lines = raw.splitlines(keepends=True) if b"\r" not in raw and b"\x0b" not in raw and b"\x0c" not in raw else [x + b"\n" for x in raw.split(b"\n")[:-1]] + [raw.split(b"\n")[-1]]
    lines = [x for x in lines if x]
    return [_row(path, i, a + 1, b"".join(lines[a:b])) for i, (a, b) in enumerate(pack_lines(lines, most, overlap))]


def chunk_by_symbols(path: str, content: str, symbols: list[dict], size: ChunkSize = ChunkSize()) -> list[dict]:
    """Chunks along symbols ``{name, start_line, end_line}``: a gap of 16 bytes or more
    before a symbol, the symbol (cut at half size if it exceeds the limit), the tail.
    Without symbols, or without any chunk, lines are packed instead."""
    most, _ = size.bytes()
    lines = content.encode().split(b"\n")
    out: list[dict] = []

    def emit(a: int, b: int, symbol: str | None, least: int) -> None:
        text = b"\n".join(lines[a - 1 : b])
        if len(text.strip()) < least:
            return
        if len(text) <= most:
            out.append(_row(path, len(out), a, text, symbol, b, f"Symbol: {symbol}\n" if symbol else None))
            return
        half = ChunkSize(max(1, most // 8), max(0, size.bytes()[1] // 8))
        for r in chunk_file(path, text.decode("utf-8", "replace"), half):
            r |= {"chunk_id": f"{path}_{len(out)}", "start_line": r["start_line"] + a - 1, "end_line": r["end_line"] + a - 1, "symbol_name": symbol}
            out.append(r)

    at = 1
    for s in sorted(symbols, key=lambda s: s["start_line"]):
        a, b = max(1, s["start_line"]), min(len(lines), s["end_line"])
        if b < a:
            continue
        if a > at:
            emit(at, a - 1, None, MIN_BYTES)
        emit(a, b, s["name"], 1)
        at = b + 1
    if symbols and at <= len(lines):
        emit(at, len(lines), None, MIN_BYTES)
    return out or chunk_file(path, content, size)


_SCHEMA = "path string, chunk_id string, start_line int, end_line int, content string, hash string, content_hash string, embed_content string, symbol_name string"


def chunk_table(files: DataFrame, path_col: str, text_col: str, size: ChunkSize = ChunkSize(), symbols_col: str | None = None) -> DataFrame:
    """All chunks of all files. A null path or text gives no row; ``symbols_col`` holds
    ``array<struct<name, start_line, end_line>>`` and switches to symbol packing."""
    kinds = {"start_line": pa.int32(), "end_line": pa.int32()}

    def run(batches):
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            rows = []
            for path, text, *symbols in zip(*cols):
                own = chunk_by_symbols(path, text, symbols[0] or [], size) if symbols else chunk_file(path, text, size)
                rows += [{"path": path, **r} for r in own]
            if rows:
                yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], kinds.get(k, pa.string())) for k in rows[0]})

    src = [F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text")]
    if symbols_col:
        src.append(F.col(symbols_col).alias("symbols"))
    return files.select(*src).where("path is not null and text is not null").mapInArrow(run, _SCHEMA)
