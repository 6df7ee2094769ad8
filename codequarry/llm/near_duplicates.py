"""Near-duplicate texts by circulant MinHash, banding and exact Jaccard verification.

Signature: the two permutations are bijections of the 32-bit numbers. The first
(``sigma``) breaks up the structure of the shingle hashes; the second (``pi``) is
applied to the result shifted circularly by k, for every coordinate k. One pair of
permutations so gives all coordinates.

Shape at scale: one Python pass over the texts makes ``bands`` 8-byte keys a text; texts with the same shingle set fall together before anything
is paired, so exact copies cost one row each. Pairs join the keys with themselves (one
exchange, used twice; adaptive execution splits a hot key) and only candidates are shingled
again; pairs fetch these sets, never texts. Groups need no pairs: each bucket is first checked against its
smallest member only, and members are paired only where that left a bucket in several groups.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm import textkernels as tk
from codequarry.operators.components import connected_components
from codequarry.session import cut

_SLICE = 512  # texts per block, so that a block's shingles stay in cache


def _permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A bijection of the 32-bit numbers."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def signatures(s: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """Circulant MinHash: row i holds k minima over the shingles of text i.

    Every text must have a shingle.
    """
    sigma = _permute((s >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    out = np.empty((len(bounds) - 1, k), np.uint32)
    for i in range(0, len(out), _SLICE):
        j = min(len(out), i + _SLICE)
        x, at = sigma[bounds[i] : bounds[j]], bounds[i:j] - bounds[i]
        for c in range(k):
            out[i:j, c] = np.minimum.reduceat(_permute(x + np.uint32(c), 0x21F0AAAD, 0x735A2D97), at)
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    rows = sig.shape[1] // bands
    x = np.zeros((len(sig), bands), np.uint64)
    for r in range(rows):
        x = tk.mix64(x * np.uint64(31) + sig[:, r::rows][:, :bands].astype(np.uint64) + np.uint64(1))
    return tk.mix64(x + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _class_of(u: np.ndarray) -> np.ndarray:
    """128 bits that name a set of sorted shingle hashes."""
    return np.frombuffer(hashlib.blake2b(u.tobytes(), digest_size=16).digest(), np.int64)


def _signer(width: int, bands: int, rows: int):
    schema = pa.schema([("id", pa.string()), ("hi", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            h, bounds = tk.tokens(*tk.flat(batch.column(1)))
            s, sb = tk.shingles(h, bounds, width)
            keep = np.flatnonzero(np.diff(sb) > 0)
            if not len(keep):
                continue
            ends = np.append(sb[keep], sb[-1])
            keys = band_keys(signatures(s, ends, bands * rows), bands)
            hi, lo, n = (np.empty(len(keep), t) for t in (np.int64, np.int64, np.int32))
            for r in range(len(keep)):
                u = np.unique(s[ends[r] : ends[r + 1]])
                hi[r], lo[r] = _class_of(u)
                n[r] = len(u)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * bands, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)).cast(pa.string()), pa.array(hi), pa.array(lo), pa.array(n), lists], schema=schema)

    return run, "id string, hi long, lo long, n int, keys array<long>"


def _shingler(width: int):
    """Class and sorted shingle hashes of every text."""

    def run(batches):
        for batch in batches:
            h, bounds = tk.tokens(*tk.flat(batch.column(0)))
            s, sb = tk.shingles(h, bounds, width)
            sets = [u for i in range(len(sb) - 1) if len(u := np.unique(s[sb[i] : sb[i + 1]]))]
            if sets:
                names = np.stack([_class_of(u) for u in sets])
                yield pa.RecordBatch.from_arrays([pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([u.tobytes() for u in sets], pa.binary())], names=["hi", "lo", "grams"])

    return run, "hi long, lo long, grams binary"


def _verifier(threshold: float):
    schema = pa.schema([("a_hi", pa.int64()), ("a_lo", pa.int64()), ("b_hi", pa.int64()), ("b_lo", pa.int64()), ("jaccard", pa.float64())])

    def run(batches):
        for batch in batches:
            j = np.zeros(batch.num_rows)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                j[i] = both / max(1, len(x) + len(y) - both)
            keep = pa.array(np.flatnonzero(j >= threshold))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(keep) for c in range(4)), pa.array(j).take(keep)], schema=schema)

    return run, "a_hi long, a_lo long, b_hi long, b_lo long, jaccard double"


_PAIR = ["a_hi", "a_lo", "b_hi", "b_lo"]


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")


def _signed(texts: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    run, schema = _signer(width, bands, rows)
    return cut(texts.mapInArrow(run, schema))


def _members(signed: DataFrame) -> DataFrame:
    """``(id, hi, lo)``; of an id with several texts the one of the smallest class counts."""
    return signed.groupBy("id").agg(F.min(F.struct("hi", "lo")).alias("c")).select("id", "c.hi", "c.lo")


def _keyed(signed: DataFrame) -> DataFrame:
    """``(key, hi, lo, n)``: the band keys of every class."""
    return signed.groupBy("hi", "lo").agg(F.first("n").alias("n"), F.first("keys").alias("keys")).select(F.explode("keys").alias("key"), "hi", "lo", "n")


def _side(keyed: DataFrame, side: str, *more: str) -> DataFrame:
    return keyed.select("key", *(F.col(c).alias(f"{side}_{c}") for c in ("hi", "lo", "n", *more)))


def _alike_in_size(threshold: float):
    return F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * F.lit(threshold)


_ASCENDING = "(a_hi < b_hi or (a_hi = b_hi and a_lo < b_lo))"


def _verified(pairs: DataFrame, signed: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs of classes whose shingle sets are alike, with their Jaccard similarity. One
    text of every class at stake is shingled again, so no sets are stored for the others; a
    set names its class itself, whatever other texts its id has."""
    ends = pairs.selectExpr("a_hi as hi", "a_lo as lo").union(pairs.selectExpr("b_hi", "b_lo")).distinct()
    ids = signed.select("id", "hi", "lo").join(ends, ["hi", "lo"], "left_semi").groupBy("hi", "lo").agg(F.min("id").alias("id")).select("id").distinct()
    run, schema = _shingler(width)
    sets = texts.join(ids, "id", "left_semi").select("text").mapInArrow(run, schema)
    sets = cut(sets.join(ends, ["hi", "lo"], "left_semi").groupBy("hi", "lo").agg(F.first("grams").alias("grams")))
    run, schema = _verifier(threshold)
    both = pairs.join(sets.toDF("a_hi", "a_lo", "a_grams"), ["a_hi", "a_lo"]).join(sets.toDF("b_hi", "b_lo", "b_grams"), ["b_hi", "b_lo"])
    return both.select(*_PAIR, "a_grams", "b_grams").mapInArrow(run, schema)


def classes_and_links(df: DataFrame, id_col: str, text_col: str, *, threshold: float = 0.8, width: int = 5, bands: int = 32, rows: int = 4) -> tuple[DataFrame, DataFrame]:
    """(members, links): ``members(id, hi, lo)`` names each text's class of equal
    shingle sets, ``links(a_hi, a_lo, b_hi, b_lo, jaccard)`` holds every pair of
    different classes found at ``threshold`` or above.

    A pair of similarity s is missed with probability (1 - s^rows)^bands: 2e-5 at
    0.73 with the default bands. A text of fewer than ``width`` tokens, and a
    null or empty one, has no shingles and so is in no class. Rows with a null id
    are left out; rows that repeat an id count once. Other columns are ignored.
    """
    texts = _texts(df, id_col, text_col)
    signed = _signed(texts, width, bands, rows)
    members = _members(signed)
    keyed = _keyed(signed.join(members.select("hi", "lo").distinct(), ["hi", "lo"], "left_semi"))
    pairs = cut(_side(keyed, "a").join(_side(keyed, "b"), "key").where(_ASCENDING).where(_alike_in_size(threshold)).select(*_PAIR).distinct())
    return members, _verified(pairs, signed, texts, width, threshold)


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, **params) -> DataFrame:
    """Every pair of ids (``id_a`` < ``id_b``) whose texts are alike, copies expanded."""
    members, links = classes_and_links(df, id_col, text_col, **params)
    a = members.select(F.col("id").alias("x"), F.col("hi").alias("a_hi"), F.col("lo").alias("a_lo"))
    b = members.select(F.col("id").alias("y"), F.col("hi").alias("b_hi"), F.col("lo").alias("b_lo"))
    linked = links.join(a, ["a_hi", "a_lo"]).join(b, ["b_hi", "b_lo"]).select("x", "y", "jaccard")
    copies = a.join(b, (F.col("a_hi") == F.col("b_hi")) & (F.col("a_lo") == F.col("b_lo"))).where("x < y").select("x", "y", F.lit(1.0).alias("jaccard"))
    return linked.unionByName(copies).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "jaccard")


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, *, threshold: float = 0.8, width: int = 5, bands: int = 32, rows: int = 4) -> DataFrame:
    """``(id, class_id, group_id)``, one row per id: the smallest id of its exact class and
    of the group that links between classes form. An id whose text has no shingles is its
    own class and group. The groups are those of all links (see ``classes_and_links``).

    Every class is verified against the smallest class of each of its buckets. Only where
    that leaves a bucket in several groups are its classes paired across groups, so a
    bucket of m near-copies costs m links, not m^2 / 2.
    """
    texts = _texts(df, id_col, text_col)
    signed = _signed(texts, width, bands, rows)
    members = cut(_members(signed))
    names = members.groupBy("hi", "lo").agg(F.min("id").alias("class_id"))
    keyed = _keyed(signed.join(names.select("hi", "lo"), ["hi", "lo"], "left_semi"))
    keyed = cut(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "key", "left_semi"))
    least = keyed.groupBy("key").agg(F.min(F.struct("hi", "lo", "n")).alias("a")).select("key", F.col("a.hi").alias("a_hi"), F.col("a.lo").alias("a_lo"), F.col("a.n").alias("a_n"))
    stars = cut(least.join(_side(keyed, "b"), "key").where(_ASCENDING).where(_alike_in_size(threshold)).select(*_PAIR).distinct())

    def linked(pairs: DataFrame) -> DataFrame:
        found = _verified(pairs, signed, texts, width, threshold)
        return found.join(names.toDF("a_hi", "a_lo", "src"), ["a_hi", "a_lo"]).join(names.toDF("b_hi", "b_lo", "dst"), ["b_hi", "b_lo"]).select("src", "dst")

    links = cut(linked(stars))
    group = cut(connected_components(links, "src", "dst"))
    placed = keyed.join(names, ["hi", "lo"]).join(group.toDF("class_id", "group_id"), "class_id", "left").withColumn("g", F.coalesce("group_id", "class_id")).select("key", "hi", "lo", "n", "g")
    open_ = placed.groupBy("key").agg(F.min("g").alias("x"), F.max("g").alias("y")).where("x != y").select("key")
    rest = placed.join(open_, "key", "left_semi")
    across = _side(rest, "a", "g").join(_side(rest, "b", "g"), "key").where("a_g != b_g").where(_ASCENDING).where(_alike_in_size(threshold)).select(*_PAIR).distinct()
    across = cut(across.join(stars, _PAIR, "left_anti"))
    if not across.isEmpty():
        group = connected_components(cut(links.union(linked(across))), "src", "dst")
    group = group.toDF("class_id", "group_id")
    named = members.join(names, ["hi", "lo"]).select("id", "class_id")
    every = df.select(F.col(id_col).cast("string").alias("id")).where("id is not null").distinct()
    return every.join(named, "id", "left").withColumn("class_id", F.coalesce("class_id", "id")).join(group, "class_id", "left").select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"))
