"""k most similar vectors of every vector: inverted file, product-quantised
residuals, asymmetric distance tables, exact reranking.

The coarse centroids have two levels: a few on top, fitted here on a bounded sample, and
below each of them its own, fitted by one task each on a bounded sample of its vectors. So
the number of cells grows with the rows, a cell stays at about ``list_rows`` vectors up to
``max_lists`` cells (the bound of what is broadcast), and a vector is compared with the
centroids of a few top cells only. Every vector is indexed. Both sides are cut into blocks:
a cell with many vectors is split by salts on the stored and on the asking side, so no task
holds more than ``block`` stored vectors of a cell, however hot the cell is. Reranking
happens in the cell, where the vectors are: sending each once costs far less than fetching
a pool of them for every asking vector. Vectors that are equal are indexed once and
expanded at the end.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.session import cut

SUBSPACES, CODES = 8, 256


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm; an empty cluster takes over a random row."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c, 1)[:, 0]
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        sums = np.zeros_like(c)
        has = np.flatnonzero(n)
        sums[has] = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n[has])[:-1]]), axis=0)
        c = sums / np.maximum(n, 1)[:, None].astype(np.float32)
        c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Row i: the k centroids nearest to x[i], nearest first."""
    out = np.empty((len(x), k), np.int32)
    half = (c * c).sum(1) / 2
    for i in range(0, len(x), 1024):
        d = half - x[i : i + 1024] @ c.T
        if k == 1:
            out[i : i + 1024, 0] = d.argmin(1)
        else:
            p = np.argpartition(d, min(k, d.shape[1] - 1), axis=1)[:, :k]
            out[i : i + 1024] = np.take_along_axis(p, np.argsort(np.take_along_axis(d, p, 1), axis=1, kind="stable"), 1)
    return out


class Index:
    """Two levels of coarse centroids, and residual codebooks."""

    def __init__(self, tops: np.ndarray, cells: np.ndarray, top_of: np.ndarray, sample: np.ndarray, visit: int):
        order = np.argsort(top_of, kind="stable")
        self.tops, self.cells, self.visit = tops, np.ascontiguousarray(cells[order]), min(visit, len(tops))
        self.first = np.searchsorted(top_of[order], np.arange(len(tops) + 1))
        self.half = (self.cells * self.cells).sum(1) / 2
        res = sample - self.cells[self.near(sample, 1)[:, 0]]
        self.books = np.stack([kmeans(np.ascontiguousarray(s), CODES, 6) for s in np.split(res, SUBSPACES, axis=1)])

    def near(self, x: np.ndarray, k: int) -> np.ndarray:
        """Row i: up to k cells nearest to x[i] among those of its nearest top cells, nearest
        first; -1 fills a row of fewer."""
        best, cell = np.full((len(x), k), np.inf, np.float32), np.full((len(x), k), -1, np.int32)
        tops = nearest(x, self.tops, self.visit)
        who, which = np.repeat(np.arange(len(x)), self.visit), tops.ravel()
        order = np.argsort(which, kind="stable")
        bounds = np.searchsorted(which[order], np.arange(len(self.tops) + 1))
        for t in np.flatnonzero(np.diff(bounds) * np.diff(self.first)):
            lo, hi = self.first[t], self.first[t + 1]
            rows = who[order[bounds[t] : bounds[t + 1]]]
            for i in range(0, len(rows), 1024):
                r = rows[i : i + 1024]
                d = np.concatenate([best[r], self.half[lo:hi] - x[r] @ self.cells[lo:hi].T], axis=1)
                c = np.concatenate([cell[r], np.broadcast_to(np.arange(lo, hi, dtype=np.int32), (len(r), hi - lo))], axis=1)
                p = np.argpartition(d, k - 1, axis=1)[:, :k]
                best[r], cell[r] = np.take_along_axis(d, p, 1), np.take_along_axis(c, p, 1)
        p = np.argsort(best, axis=1, kind="stable")
        return np.take_along_axis(cell, p, 1)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        res = x - self.cells[cell]
        return np.stack([nearest(np.ascontiguousarray(s), b, 1)[:, 0] for s, b in zip(np.split(res, SUBSPACES, axis=1), self.books)], axis=1).astype(np.uint8)

    def distances(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances of exact queries to coded vectors of one cell."""
        res = (q - self.cells[cell]).reshape(len(q), SUBSPACES, -1)
        out = np.zeros((len(q), len(codes)), np.float32)
        for m in range(SUBSPACES):
            table = (self.books[m] ** 2).sum(1) - 2 * (res[:, m] @ self.books[m].T)
            out += np.take(table, codes[:, m], axis=1)
        return out


def _usable(dim: int):
    schema = pa.schema([("id", pa.string()), ("hi", pa.int64()), ("lo", pa.int64()), ("vec", pa.binary())])

    def run(batches):
        for batch in batches:
            col = batch.column(1)
            ok = np.flatnonzero(np.diff(col.offsets.to_numpy(zero_copy_only=False)) == dim)
            if not len(ok):
                continue
            take = pa.array(ok)
            flat = col.take(take).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            norm = np.sqrt((x * x).sum(1))
            good = np.flatnonzero(np.isfinite(norm) & (norm > 0))
            x = (x[good] / norm[good, None]).astype(np.float32)
            raw = [v.tobytes() for v in x]
            keys = np.array([np.frombuffer(hashlib.blake2b(v, digest_size=16).digest(), np.int64) for v in raw]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take).take(pa.array(good)), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(raw, pa.binary())], schema=schema)

    return run, "id string, hi long, lo long, vec binary"


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    off = col.offset * 4
    start = int(np.frombuffer(col.buffers()[1], np.int32, 1, off)[0]) if len(col) else 0
    return np.frombuffer(col.buffers()[2], np.uint8, len(col) * width, start).reshape(len(col), width) if len(col) else np.zeros((0, width), np.uint8)


def _floats(raw: np.ndarray, dim: int) -> np.ndarray:
    return np.ascontiguousarray(raw[:, : 4 * dim]).view(np.float32)


def _router(index: Index, dim: int, probes: int, splits: np.ndarray, base: bool):
    """Stored side: one row per vector and asking salt of its cell, with its code.
    Asking side: one row per probed cell and stored salt."""
    schema = pa.schema([("g", pa.int64()), ("tag", pa.int32()), ("rid", pa.int64()), ("data", pa.binary())])
    width = 4 * dim + SUBSPACES

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rid = batch.column(0).to_numpy(zero_copy_only=False)
            raw = _matrix(batch.column(1), 4 * dim)
            x = _floats(raw, dim)
            cell = index.near(x, 1 if base else min(probes, len(index.cells)))
            data = np.zeros((len(x), width), np.uint8)
            data[:, : 4 * dim] = raw
            if base:
                data[:, 4 * dim :] = index.encode(x, cell[:, 0])
            own = (rid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            rows, cells = np.repeat(np.arange(len(x)), cell.shape[1]), cell.ravel().astype(np.int64)
            rows, cells = rows[cells >= 0], cells[cells >= 0]
            n = splits[cells]
            rows, cells, salts = np.repeat(rows, n), np.repeat(cells, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            mine = own[rows] % splits[cells]
            stored, asking = (mine, salts) if base else (salts, mine)
            g = (cells << 40) | (stored << 20) | asking
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.full(len(g), 0 if base else 1, np.int32)), pa.array(rid[rows]), pa.array([v.tobytes() for v in data[rows]], pa.binary())], schema=schema)

    return run, "g long, tag int, rid long, data binary"


def _searcher(index: Index, dim: int, k: int, pool: int, floor: float):
    """Rows arrive sorted by block, stored vectors first."""
    schema = pa.schema([("q", pa.int64()), ("x", pa.int64()), ("cosine", pa.float64())])
    width = 4 * dim + SUBSPACES

    def run(batches):
        at, ids, vecs, codes = None, [], [], []
        for batch in batches:
            g, tag, rid = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            data = _matrix(batch.column(3), width)
            edges = np.concatenate([[0], np.flatnonzero((g[1:] != g[:-1]) | (tag[1:] != tag[:-1])) + 1, [len(g)]]) if len(g) else [0]
            found = []
            for s, e in pairwise(edges):
                if tag[s] == 0:
                    if g[s] != at:
                        at, ids, vecs, codes = g[s], [], [], []
                    ids.append(rid[s:e])
                    vecs.append(_floats(data[s:e], dim))
                    codes.append(data[s:e, 4 * dim :])
                elif g[s] == at:
                    ids, vecs, codes = [np.concatenate(ids)], [np.concatenate(vecs)], [np.concatenate(codes)]
                    for i in range(s, e, 256):
                        q, qid = _floats(data[i : min(e, i + 256)], dim), rid[i : min(e, i + 256)]
                        d = index.distances(q, int(at >> 40), codes[0])
                        d[qid[:, None] == ids[0][None, :]] = np.inf
                        top = np.argpartition(d, pool, axis=1)[:, :pool] if d.shape[1] > pool else np.broadcast_to(np.arange(d.shape[1]), d.shape)
                        cos = np.einsum("qd,qpd->qp", q, vecs[0][top])
                        cos[np.take_along_axis(d, top, 1) == np.inf] = -np.inf
                        best = np.argsort(-cos, axis=1, kind="stable")[:, :k]
                        c = np.take_along_axis(cos, best, 1)
                        r, p = np.nonzero(c >= floor)
                        found.append((qid[r], ids[0][np.take_along_axis(top, best, 1)[r, p]], c[r, p].astype(np.float64)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found])) for i in range(3)], schema=schema)

    return run, "q long, x long, cosine double"


def most_similar(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    k: int,
    *,
    dim: int = 64,
    min_cosine: float | None = None,
    queries: Column | None = None,
    probes: int = 8,
    pool_factor: int = 12,
    list_rows: int = 256,
    max_lists: int = 1 << 18,
    visit: int = 8,
    train_rows: int = 16384,
    block: int = 4096,
    task_bytes: int = 8 << 20,
) -> DataFrame:
    """``(query_id, neighbour_id, cosine, rank)``: up to k neighbours of each vector.

    Only vectors of ``dim`` finite components that are not all zero take part; a
    null, empty or shorter one is skipped. Rows that repeat an id count once. Ties
    rank by neighbour id. ``min_cosine`` is applied inside the search (a neighbour
    below it cannot displace one above it). ``queries`` restricts the asking rows
    by a condition on the id column; all rows stay searchable. An empty table
    gives an empty result. Approximate: a neighbour is missed if its cell is not
    among the ``probes`` nearest ones of the ``visit`` nearest top cells or the coded
    distance ranks it below ``pool_factor * k`` of its cell. The top level and the
    codebooks are fitted on about ``train_rows`` vectors chosen by hash, the cells below
    a top cell on up to 200 vectors a cell.
    """
    if dim % SUBSPACES:
        raise ValueError(f"dim must be a multiple of {SUBSPACES}")
    spark = df.sparkSession
    run, schema = _usable(dim)
    source = df.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).where("id is not null and v is not null").where(~F.exists("v", lambda c: c.isNull()))
    signed = cut(source.mapInArrow(run, schema))
    reps = cut(signed.groupBy("hi", "lo").agg(F.first("vec").alias("vec"), F.min("id").alias("first_id")).withColumn("rid", F.monotonically_increasing_id()))
    out = "query_id string, neighbour_id string, cosine double, rank int"
    n = reps.count()
    if not n:
        return spark.createDataFrame([], out)
    lists = int(np.clip(n // list_rows, 1, max_lists))
    n_tops = max(1, round(lists**0.5 / 2))
    ticket = F.pmod(F.xxhash64("hi", "lo"), F.lit(1 << 30))

    def drawn(rows: float):  # a hash share, not an ordered limit: that would send every partition's first rows here
        return reps.where(ticket < F.lit(int(min(1.0, rows / n) * (1 << 30))))

    sample = np.frombuffer(b"".join(bytes(r.vec) for r in drawn(train_rows).select("vec").collect()), np.float32).reshape(-1, dim)
    if not len(sample):
        sample = np.frombuffer(bytes(reps.select("vec").first().vec), np.float32).reshape(-1, dim)
    tops = kmeans(sample, n_tops)
    upper = spark.sparkContext.broadcast(tops)
    per_top = 48 * -(-lists // n_tops)

    def place(batches):
        for batch in batches:
            top = nearest(_floats(_matrix(batch.column(1), 4 * dim), dim), upper.value, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(top), batch.column(0), batch.column(1)], names=["top", "ticket", "vec"])

    def fit(key, table):
        x = _floats(_matrix(table.column("vec").combine_chunks(), 4 * dim), dim)
        c = kmeans(x, max(1, len(x) // 48))
        return pa.table({"top": pa.array(np.full(len(c), key[0].as_py(), np.int32)), "vec": pa.array([v.tobytes() for v in c], pa.binary())})

    placed = drawn(48.0 * lists).select(ticket.alias("ticket"), "vec").mapInArrow(place, "top int, ticket long, vec binary")
    few = placed.withColumn("r", F.row_number().over(Window.partitionBy("top").orderBy("ticket"))).where(F.col("r") <= 4 * per_top).select("top", "vec")
    below = few.groupBy("top").applyInArrow(fit, "top int, vec binary").collect()  # at most about max_lists rows
    cells, top_of = np.frombuffer(b"".join(bytes(r.vec) for r in below), np.float32).reshape(-1, dim), np.array([r.top for r in below], np.int64)
    if not len(cells):
        cells, top_of = tops, np.arange(len(tops))
    index = Index(tops, cells, top_of, sample, visit)
    shared = spark.sparkContext.broadcast(index)  # at most about max_lists centroids and 8 x 256 codes

    def homes(batches):
        for batch in batches:
            cells = shared.value.near(_floats(_matrix(batch.column(0), 4 * dim), dim), 1)[:, 0]
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cells)})

    splits = np.ones(len(index.cells), np.int64)
    for r in reps.select("vec").mapInArrow(homes, "cell int").groupBy("cell").count().collect():  # a row per centroid
        splits[r.cell] = max(1, -(-r["count"] // block))
    member = signed.groupBy("id").agg(F.min(F.struct("hi", "lo")).alias("c")).select("id", "c.hi", "c.lo").join(reps.select("hi", "lo", "rid"), ["hi", "lo"]).select("id", "rid")
    member = cut(member)
    asking = member if queries is None else member.join(df.where(queries).select(F.col(id_col).cast("string").alias("id")).distinct(), "id", "left_semi")
    asked = reps.select("rid", "vec") if queries is None else reps.join(asking.select("rid").distinct(), "rid", "left_semi").select("rid", "vec")

    def route(base):
        def f(batches):
            yield from _router(shared.value, dim, probes, splits, base)[0](batches)

        return f

    def search(batches):
        yield from _searcher(shared.value, dim, k, pool_factor * k, -2.0 if min_cosine is None else min_cosine)[0](batches)

    kind = "g long, tag int, rid long, data binary"
    blocks = reps.select("rid", "vec").mapInArrow(route(True), kind).union(asked.mapInArrow(route(False), kind))
    # as many tasks as hold about ``task_bytes`` each: a number of its own, as adaptive execution only merges
    n_asked = asked.count()
    sent = (n + n_asked * min(probes, len(index.cells))) * (4 * dim + SUBSPACES + 24)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sent // task_bytes))
    hits = blocks.repartition(int(tasks), "g").sortWithinPartitions("g", "tag").mapInArrow(search, "q long, x long, cosine double")
    near = hits.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "x"))).where(F.col("r") <= k).select("q", "x", "cosine")
    # of each class of equal vectors, the k + 1 smallest ids can stand among anyone's k neighbours
    few = member.withColumn("r", F.row_number().over(Window.partitionBy("rid").orderBy("id"))).where(F.col("r") <= k + 1).select(F.col("rid").alias("x"), F.col("id").alias("neighbour_id"))
    own = asked.select(F.col("rid").alias("q"), F.col("rid").alias("x"), F.lit(1.0).alias("cosine"))
    named = asking.select(F.col("rid").alias("q"), F.col("id").alias("query_id")).join(near.union(own), "q").join(few, "x").where("query_id != neighbour_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "neighbour_id"))
    return named.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "neighbour_id", "cosine", "rank")
