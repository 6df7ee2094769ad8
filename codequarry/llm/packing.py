"""Documents laid into contexts of fixed capacity by bound-certified repacking.

Documents are spread by hash over partitions of bounded size; best-fit decreasing
packs each, and dual feasible functions give a lower bound for its number of
contexts. Partitions that reach their bound are certified and final. The others
exchange their documents (a new hash spreads them over half as many partitions)
and are packed again; the better result stands.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.textkernels import flat
from codequarry.session import cut

#: Fixed value: how the vocabulary's tokenizer splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counts(df: DataFrame, id_col: str, text_col: str, tokenizer: str) -> DataFrame:
    """``(id, n_tokens)`` of every row under a public byte-level vocabulary file.
    A null text has no tokens; rows with a null id are left out."""
    state: dict = {}

    def run(batches):
        if not state:
            import base64

            import tiktoken

            with open(tokenizer, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
            state["encode"] = tiktoken.Encoding("counts", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        encode = state["encode"]
        for batch in batches:
            data, off = flat(batch.column(1))
            raw = data.tobytes()
            n = [len(encode(raw[s:e].decode("utf-8", "replace"))) for s, e in zip(off[:-1], off[1:])]  # one call a text: the batch call takes 1.7 times as long
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["id", "n_tokens"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    return rows.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, n_tokens long")


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Contexts needed at least: the best of two families of dual feasible functions."""
    s = np.sort(sizes[sizes > 0])
    if not len(s):
        return int(len(sizes) > 0)
    best = -(-int(s.sum()) // capacity)
    total = np.concatenate([[0], np.cumsum(s)])
    half = np.searchsorted(s, capacity / 2, side="right")  # sizes above half a context
    a = np.unique(np.concatenate([[0], s[:half]]))  # u_a: drop sizes below a, round sizes above capacity - a up
    low, high = np.searchsorted(s, a, side="left"), np.searchsorted(s, capacity - a, side="right")
    high = np.maximum(high, half)
    room = (high - half) * capacity - (total[high] - total[half])
    need = -(-(total[half] - total[low] - room) // capacity)
    best = max(best, int((len(s) - half + np.maximum(0, need)).max()))
    for k in range(1, 32):  # f_k: round (k + 1) s / C down to whole k-ths unless it is whole
        x = s * (k + 1)
        whole = x % capacity == 0
        best = max(best, -(-int(np.where(whole, s * k, (x // capacity) * capacity).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(context of every item, number of contexts); largest first, fullest fitting context."""
    place = np.zeros(len(sizes), np.int64)
    free: list[tuple[int, int]] = []
    n = 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        at = bisect.bisect_left(free, (size, -1))
        if at == len(free):
            room, b = capacity, n
            n += 1
        else:
            room, b = free.pop(at)
        place[i] = b
        bisect.insort(free, (room - size, b))
    return place, n


def _packer(capacity: int, key: str, kind: str):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "id"], ascending=[False, True], kind="stable")
        n = pdf["n_tokens"].to_numpy()
        whole = n // capacity
        whole = np.where((n > capacity) & (n % capacity == 0), whole, np.where(n > capacity, whole, 0))
        rest = np.where(n > capacity, n - whole * capacity, n)
        item = (n <= capacity) | (rest > 0)
        place, bins = best_fit_decreasing(rest[item], capacity)
        bound = lower_bound(rest[item], capacity)
        rows = np.repeat(np.arange(len(n)), whole)
        piece = np.arange(len(rows)) - np.repeat(np.cumsum(whole) - whole, whole)
        ids = pdf["id"].to_numpy()
        return pd.DataFrame(
            {
                "part": pdf["part"].iloc[0],
                "id": np.concatenate([ids[item], ids[rows]]),
                "piece": np.concatenate([whole[item], piece]),
                "n_tokens": np.concatenate([rest[item], np.full(len(rows), capacity)]),
                "context": np.concatenate([place, bins + np.arange(len(rows))]),
                "total": np.concatenate([n[item], n[rows]]),
                "n_bins": bins,
                "bound": bound,
            }
        )

    return pack, f"part long, id {kind}, piece long, n_tokens long, context long, total long, n_bins long, bound long"


def pack_documents(df: DataFrame, id_col: str, text_col: str, *, capacity: int = 2048, tokenizer: str, part_tokens: int = 4_000_000, part_rows: int = 40_000, rounds: int = 2) -> DataFrame:
    """``(id, piece, n_tokens, part, context, certified)``: every document, or every piece of
    one that exceeds the capacity, in a context ``(part, context)``. ``certified`` says that
    the row's partition has as few contexts as its lower bound demands; where it is false
    after ``rounds`` exchanges, a packing with fewer contexts may exist.

    Only a document larger than ``capacity`` is split: whole contexts first, the
    rest goes in with other documents. A null or empty text has no tokens and one
    row. Ids must be unique; a repeated id counts once, with its longest text.
    """
    kind = df.schema[id_col].dataType.simpleString()
    sizes = cut(token_counts(df, id_col, text_col, tokenizer).groupBy("id").agg(F.max("n_tokens").alias("n_tokens")))
    n, tokens = sizes.agg(F.count("*"), F.sum("n_tokens")).first()
    parts = max(1, -(-(tokens or 0) // part_tokens), -(-n // part_rows))
    pack, schema = _packer(capacity, id_col, kind)
    spread = sizes.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    done = cut(spread.groupBy("part").applyInPandas(pack, schema))
    first = parts
    for r in range(rounds):
        gaps = done.where("n_bins > bound").select("part", "n_bins").distinct()
        h, bins = gaps.agg(F.count("*"), F.sum("n_bins")).first()
        if h < 2:
            break
        again = done.join(gaps.select("part"), "part", "left_semi").select("id", F.col("total").alias("n_tokens")).distinct()
        again = again.withColumn("part", F.lit(first) + F.pmod(F.xxhash64("id", F.lit(r + 1)), F.lit((h + 1) // 2)))
        other = cut(again.groupBy("part").applyInPandas(pack, schema))
        first += (h + 1) // 2
        if other.select("part", "n_bins").distinct().agg(F.sum("n_bins")).first()[0] >= bins:
            break
        done = done.join(gaps.select("part"), "part", "left_anti").union(other.select(*done.columns))
        done = cut(done)
    return done.select("id", F.col("piece").cast("int").alias("piece"), "n_tokens", "part", "context", (F.col("n_bins") <= F.col("bound")).alias("certified"))
