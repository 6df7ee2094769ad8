"""Test passages in training text by suffix arrays over training shards.

Every batch of documents is a shard. Its words become 63-bit hashes; a word that no item
has (by a bitmap of fixed size over the words of all items) ends every match, so only runs
long enough for a match are kept and sorted into the shard's suffix array. Every suffix of
every item is looked up by binary search, all at once, and each hit is extended to the
longest verbatim match. Only hits leave the pass. Items of more than one block are searched
block by block over the stored shard arrays, which are built once.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.session import cut

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Longest runs of letters and digits, lower-cased."""
    return _WORD.findall(text.lower())


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``s`` in order by their first ``depth`` numbers (prefix doubling)."""
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    order, k = np.argsort(rank, kind="stable"), 1
    while k < depth and rank.max(initial=0) < len(s) - 1:
        nxt = np.zeros(len(s), np.int64)
        nxt[:-k] = rank[k:] + 1
        key = rank * (len(s) + 1) + nxt
        order = np.argsort(key, kind="stable")
        steps = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(len(s), np.int64)
        rank[order] = steps
        k *= 2
    return order


BITS = 22  # of the bitmap of words: half a megabyte, however many items there are


class WordHashes(dict):
    """Hash of each word, 0 for a word whose bit is not set; kept for a bounded number of words."""

    def __init__(self, seen: np.ndarray | None = None, most: int = 1 << 20):
        super().__init__()
        self.seen, self.most = seen, most

    def __missing__(self, word: str) -> int:
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little") >> 1 or 1
        if self.seen is not None and not self.seen[h & ((1 << BITS) - 1)]:
            h = 0
        if len(self) >= self.most:
            self.clear()
        self[word] = h
        return h

    def of(self, text: str) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words(text)), np.int64)


class Shard:
    """Suffix array over the runs of known words of a batch of documents."""

    def __init__(self, s: np.ndarray, where: np.ndarray, doc: np.ndarray, order: np.ndarray):
        self.s, self.where, self.doc, self.order = s, where, doc, order

    @staticmethod
    def build(docs: list[str], hashes: WordHashes, least: int, depth: int) -> Shard | None:
        parts, where, doc = [], [], []
        for d, t in enumerate(docs):
            s = hashes.of(t)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], s != 0, [0]])))
            for a, b in zip(edges[::2], edges[1::2]):
                if b - a >= least:
                    parts.append(np.append(s[a:b], 0))
                    where.append(np.arange(a, b + 1, dtype=np.int32))
                    doc.append(np.full(b - a + 1, d, np.int32))
        if not parts:
            return None
        s = np.concatenate(parts)
        return Shard(s, np.concatenate(where), np.concatenate(doc), suffix_array(s, depth).astype(np.int32))

    def store(self) -> list[bytes]:
        return [x.tobytes() for x in (self.s, self.where, self.doc, self.order)]

    @staticmethod
    def load(stored) -> Shard:
        return Shard(*(np.frombuffer(x, t) for x, t in zip(stored, (np.int64, np.int32, np.int32, np.int32))))


class TestItems:
    """Suffixes of a bounded block of test items."""

    def __init__(self, rows: list[tuple], least: int):
        hashes = WordHashes()
        self.least, self.ids = least, [r[0] for r in rows]
        lists = [hashes.of(r[1] or "") for r in rows]
        # every item ends with a number that no document has
        self.flat = np.concatenate([*(x for ws in lists for x in (ws, [-1])), [-1] * least]).astype(np.int64)
        lens = np.array([len(ws) for ws in lists], np.int64)
        starts = np.cumsum(lens + 1) - lens - 1
        n = np.maximum(lens - least + 1, 0)
        self.item = np.repeat(np.arange(len(rows)), n)
        self.word = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.at = np.repeat(starts, n) + self.word
        self.depth = int(lens.max(initial=0))

    def mark(self, seen: np.ndarray) -> None:
        """Set the bits of all words."""
        seen[self.flat[self.flat > 0] & ((1 << BITS) - 1)] = True

    def search(self, shard: Shard | None, most: int = 1 << 20):
        """(document, item, words, word in document, word in item) of all longest matches;
        at most about ``most`` hits are extended at once."""
        if shard is None or not len(self.at):
            return
        s, order, least = shard.s, shard.order, self.least
        padded = np.append(s, np.zeros(least, np.int64))
        query = self.flat[self.at[:, None] + np.arange(least)]

        def edge(right: bool) -> np.ndarray:
            lo, hi = np.zeros(len(query), np.int64), np.full(len(query), len(order))
            rows = np.arange(len(query))
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                have = padded[order[np.minimum(mid, len(order) - 1)][:, None] + np.arange(least)]
                diff = have != query
                k = diff.argmax(1)
                less = np.where(diff.any(1), have[rows, k] < query[rows, k], right)
                lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
            return lo

        lo, hi = edge(False), edge(True)
        padded = np.append(s, 0)
        total = np.cumsum(hi - lo)
        cuts = np.unique(np.append(np.searchsorted(total, np.arange(0, total[-1], most), side="left"), len(total)))
        for a, b in zip(cuts[:-1], cuts[1:]):
            n = (hi - lo)[a:b]
            q = np.repeat(np.arange(a, b), n)
            p = order[np.repeat(lo[a:b], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)].astype(np.int64)
            # only matches that cannot be made longer to the left
            before_item = np.where(self.word[q] > 0, self.flat[self.at[q] - 1], -1)
            before_doc = np.where(p > 0, s[p - 1], 0)
            q, p = q[before_item != before_doc], p[before_item != before_doc]
            size = np.full(len(q), least)
            growing = np.ones(len(q), bool)
            while growing.any():
                i = np.flatnonzero(growing)
                same = padded[np.minimum(p[i] + size[i], len(s))] == self.flat[np.minimum(self.at[q[i]] + size[i], len(self.flat) - 1)]
                size[i[same]] += 1
                growing[i[~same]] = False
            yield from zip(shard.doc[p].tolist(), [self.ids[i] for i in self.item[q]], size.tolist(), shard.where[p].tolist(), self.word[q].tolist())


_STORED = "ids binary, s binary, place binary, doc binary, suffixes binary"


def leaks(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, *, least: int = 13, block_bytes: int = 8 << 20) -> DataFrame:
    """``(doc_id, item_id, n_words, doc_word, item_word)``: every longest run of at
    least ``least`` words that a document shares with an item, with its places.

    The items are taken in blocks of at most about ``block_bytes`` of text, so what
    a task holds is bounded. One block is one pass over the documents; for more, the
    shards' suffix arrays are stored once and each block is one pass over these, its
    broadcast given up before the next. Null and empty texts and items shorter than
    ``least`` words match nothing; rows with a null id are left out; repeated rows
    give repeated matches once.
    """
    dk, ik = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    sc = docs.sparkSession.sparkContext
    tests = items.select(F.col(item_id).alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null")
    n_bytes = tests.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = int(-(-n_bytes // block_bytes)) or 1
    texts = docs.select(F.col(doc_id).alias("d"), F.col(doc_text).cast("string").alias("t")).where("d is not null and t is not null")
    schema = f"doc_id {dk}, item_id {ik}, n_words int, doc_word int, item_word int"
    names = [c.split()[0] for c in schema.split(", ")]

    def block(b: int) -> TestItems:
        rows = tests.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).distinct().collect()  # at most a block
        return TestItems([tuple(r) for r in rows], least)

    def batch_of(hits: list, ids) -> pa.RecordBatch:
        d, *rest = zip(*hits)
        return pa.RecordBatch.from_pydict(dict(zip(names, (ids.take(pa.array(d)), rest[0], *(pa.array(c, pa.int32()) for c in rest[1:])))))

    seen, depth, first = np.zeros(1 << BITS, bool), least, None
    for b in range(blocks):
        own = block(b)
        own.mark(seen)
        depth, first = max(depth, own.depth), own
    words_of = sc.broadcast(seen)

    def shards(batches):
        hashes = WordHashes(words_of.value)
        for batch in batches:
            yield batch.column(0), Shard.build(batch.column(1).to_pylist(), hashes, least, depth)

    if blocks == 1:
        only = sc.broadcast(first)

        def run(batches):
            for ids, shard in shards(batches):
                if hits := list(only.value.search(shard)):
                    yield batch_of(hits, ids)

        return texts.mapInArrow(run, schema).distinct()

    def build(batches):
        for ids, shard in shards(batches):
            if shard:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, pa.schema([("d", ids.type)])) as w:
                    w.write_batch(pa.RecordBatch.from_arrays([ids], names=["d"]))
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (sink.getvalue().to_pybytes(), *shard.store())], names=[c.split()[0] for c in _STORED.split(", ")])

    stored, out = cut(texts.mapInArrow(build, _STORED)), None
    for b in range(blocks):
        shared = sc.broadcast(block(b))

        def run(batches, shared=shared):
            for batch in batches:
                for ids, *arrays in zip(*(c.to_pylist() for c in batch.columns)):
                    if hits := list(shared.value.search(Shard.load(arrays))):
                        yield batch_of(hits, pa.ipc.open_stream(ids).read_all().column(0).combine_chunks())

        hits = cut(stored.mapInArrow(run, schema))
        shared.destroy()
        out = hits if out is None else out.union(hits)
    return out.distinct()
