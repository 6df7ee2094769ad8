"""Languages of documents and of their blocks by hierarchical discrimination.

First the language family, then one-versus-one linear support vector machines
between the languages of that family. Features are hashed byte trigrams of the
lower-cased text, so every script is covered and a batch is scored by array
passes over its bytes. The models are fitted on a bounded number of labelled
documents per language; every document is scored whole.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.textkernels import LOWER, flat

#: The families and their languages.
FAMILIES = {"germanic": ("de", "en", "nl"), "romance": ("es", "fr", "it", "pt"), "slavic": ("pl", "ru"), "japonic": ("ja",)}
LANGUAGES = tuple(sorted(x for f in FAMILIES.values() for x in f))
#: Other spellings of a language code.
SPELLINGS = {
    "de": "deu ger german deutsch", "en": "eng english", "es": "spa spanish español espanol castellano", "fr": "fra fre french français francais",
    "it": "ita italian italiano", "ja": "jpn jp japanese 日本語", "nl": "nld dut dutch nederlands", "pl": "pol polish polski", "pt": "por portuguese português portugues", "ru": "rus russian русский",
}
#: Labels that name no language.
NO_LABEL = ("", "unknown", "und", "xx", "xxx", "n/a", "na", "none", "null", "nil", "mul", "zxx", "mis", "other", "?", "-", "--")

BITS = 14
_BREAK = re.compile(rb"\n(?:[ \t\r\f\v]*\n)+")
_FOLD = LOWER.copy()
_FOLD[:65] = 32
_FOLD[91:97] = 32
_FOLD[123:128] = 32


def normal_label(label: Column) -> Column:
    """Two-letter code of a label however it is spelt; null if it names no language.
    An unknown label is kept, lower-cased, as another language's name."""
    low = F.lower(F.regexp_replace(label, r"^\s+|\s+$", ""))
    stem = F.regexp_extract(low, r"^([^-_]*)", 1)
    out = F.when(label.isNull() | low.isin(*NO_LABEL) | stem.isin(*NO_LABEL), F.lit(None))
    for code, others in SPELLINGS.items():
        out = out.when(low.isin(code, *others.split()) | stem.isin(code, *others.split()), code)
    return out.otherwise(stem)


def blocks(raw: bytes) -> list[tuple[int, int, int]]:
    """(number, start, end) of every block of prose; blocks are separated by blank
    lines and counted from 1, fenced code counts but is left out. A fence that is never
    closed takes its own block only."""
    parts, at = [], 0
    for end, nxt in [*((m.start(), m.end()) for m in _BREAK.finditer(raw)), (len(raw), len(raw))]:
        if raw[at:end].strip():
            parts.append((at, end))
        at = nxt
    last = {}  # of each fence mark, the last block that has it
    for i, (s, e) in enumerate(parts):
        for mark in (b"```", b"~~~"):
            if mark in raw[s:e]:
                last[mark] = i
    out, number, fence = [], 0, b""
    for i, (s, e) in enumerate(parts):
        part = raw[s:e].strip()
        if fence:
            if fence in part:
                fence = b""
            continue
        number += 1
        mark = part[:3]
        if mark not in (b"```", b"~~~"):
            out.append((number, s, e))
        elif part.count(mark) % 2 and last[mark] > i:
            fence = mark
    return out


def grams(data: np.ndarray) -> np.ndarray:
    """Hash of the trigram at every byte (two short at the end)."""
    x = _FOLD[data].astype(np.uint32)
    code = x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32)


def spans_of(data: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all spans, start of each); three blanks close every span."""
    n = spans[:, 1] - spans[:, 0] + 3
    starts = np.cumsum(n) - n
    out = np.full(int(n.sum()), 32, np.uint8)
    body = np.arange(int((n - 3).sum())) + np.repeat(spans[:, 0] - (np.cumsum(n - 3) - (n - 3)), n - 3)
    place = np.arange(len(body)) + np.repeat(3 * np.arange(len(n)), n - 3)
    out[place] = data[body]
    return out, starts


class SVM:
    """Linear machines for a squared hinge loss, by accelerated gradient steps."""

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 40) -> np.ndarray:
        """One machine per column of ``y`` (1 and -1); the last row holds the biases."""
        yes = (y > 0).sum(0, keepdims=True)
        weight = np.where(y > 0, len(y) / (2.0 * np.maximum(1, yes)), len(y) / (2.0 * np.maximum(1, len(y) - yes))).astype(np.float32) * np.float32(cost / max(1, len(y)))
        out = lambda w: x @ w[:-1] + w[-1]
        back = lambda g: np.vstack([x.T @ g, g.sum(0, keepdims=True)])
        v = np.ones((x.shape[1] + 1, y.shape[1]), np.float32)
        top = np.ones(y.shape[1], np.float32)
        for _ in range(6):  # largest eigenvalues, for the steps
            v = back(weight * out(v))
            top = np.maximum(np.linalg.norm(v, axis=0), 1e-12).astype(np.float32)
            v /= top
        step = (1.0 / (1.0 + 2.0 * top)).astype(np.float32)
        w, u, t = np.zeros_like(v), np.zeros_like(v), 1.0
        for _ in range(rounds):
            new = u - step * (u - 2 * back(weight * y * np.maximum(0, 1 - y * out(u))))
            t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
            u = new + np.float32((t - 1) / t_new) * (new - w)
            w, t = new, t_new
        return w


class Model:
    """A machine per family against the rest, and one per pair within a family."""

    scale = np.float32(40.0)

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]], labels: list[str]):
        """``counts`` has (trigram hashes, how often) of each text. A label outside the
        known families is a family of its own."""
        x = np.zeros((len(counts), 1 << BITS), np.float32)
        for i, (g, c) in enumerate(counts):
            x[i, g] = c * (self.scale / max(1, c.sum()))
        self.known = tuple(sorted(set(labels)))
        families = FAMILIES | {m: (m,) for m in self.known if m not in LANGUAGES}
        self.families = {f: own for f, ms in families.items() if (own := tuple(m for m in ms if m in self.known))}
        lab = np.array(labels, dtype="U16")
        # each half is judged by a fit on the other one, so a wrong label cannot vouch
        # for itself; rows that are denied are left out of the last fit
        keep, half = np.ones(len(lab), bool), np.arange(len(lab)) % 2
        for h in (0, 1):
            other, mine = np.flatnonzero(half != h), np.flatnonzero(half == h)
            if len(other) and len(mine):
                self._fit(x[other], lab[other])
                names, counts = np.unique(lab[other], return_counts=True)
                judged = np.isin(lab[mine], names[counts >= 5])
                keep[mine] = ~judged | (self.classify_rows(x[mine])[0] == lab[mine])
        if not keep.all():
            x, lab = x[keep], lab[keep]
        self._fit(x, lab)

    def _fit(self, x: np.ndarray, lab: np.ndarray) -> None:
        sign = lambda yes: np.where(yes, 1, -1).astype(np.float32)
        fam = {m: f for f, ms in self.families.items() for m in ms}
        own = np.array([fam[a] for a in lab], dtype="U16")
        self.names = list(self.families)
        self.top = SVM.fit(x, np.stack([sign(own == f) for f in self.names], 1)) if len(lab) else np.zeros(((1 << BITS) + 1, len(self.names)), np.float32)
        self.pairs = {f: list(combinations(ms, 2)) for f, ms in self.families.items()}
        self.duel = {}
        for f, ps in self.pairs.items():
            fits = []
            for a, b in ps:
                rows = (lab == a) | (lab == b)
                fits.append(SVM.fit(x[rows], sign(lab[rows] == a)[:, None])[:, 0])
            if fits:
                self.duel[f] = np.stack(fits, 1)

    def _decide(self, top: np.ndarray, duels) -> tuple[np.ndarray, np.ndarray]:
        """duels(family, rows) gives the pair margins of those rows."""
        best = top.argmax(1)
        lang, conf = np.full(len(top), "", "U16"), 1 / (1 + np.exp(-3 * top.max(1, initial=-9)))
        for k, f in enumerate(self.names):
            rows = np.flatnonzero(best == k)
            if not len(rows):
                continue
            ms = self.families[f]
            if len(ms) == 1:
                lang[rows] = ms[0]
                continue
            margin = duels(f, rows)
            votes, least = np.zeros((len(rows), len(ms))), np.full((len(rows), len(ms)), np.inf)
            for j, (a, b) in enumerate(self.pairs[f]):
                ia, ib = ms.index(a), ms.index(b)
                p = 1 / (1 + np.exp(-3 * margin[:, j]))
                # a duel won counts; the sum of margins only breaks a tie
                votes[:, ia] += (p >= 0.5) + p / (4 * len(ms))
                votes[:, ib] += (p < 0.5) + (1 - p) / (4 * len(ms))
                least[:, ia] = np.minimum(least[:, ia], p)
                least[:, ib] = np.minimum(least[:, ib], 1 - p)
            won = votes.argmax(1)
            lang[rows] = np.array(ms)[won]
            conf[rows] = np.minimum(conf[rows], least[np.arange(len(rows)), won])
        return lang, conf

    def classify_rows(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._decide(x @ self.top[:-1] + self.top[-1], lambda f, r: x[r] @ self.duel[f][:-1] + self.duel[f][-1])

    def classify(self, data: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and confidence of every span of the bytes."""
        if not len(spans) or not self.names:
            return np.full(len(spans), "", "U16"), np.zeros(len(spans))

        def margins(w: np.ndarray, rows: np.ndarray) -> np.ndarray:
            out = np.empty((len(rows), w.shape[1]), np.float32)
            lens = spans[rows, 1] - spans[rows, 0] + 3
            cuts = np.unique(np.append(np.searchsorted(np.cumsum(lens), np.arange(0, lens.sum(), 1 << 20)), len(rows)))
            for s, e in zip(cuts[:-1], cuts[1:]):
                buf, starts = spans_of(data, spans[rows[s:e]])
                g = np.append(grams(buf), [0, 0])
                n = np.diff(np.append(starts, len(buf)))
                ok = np.ones(len(buf), np.float32)
                for back in (1, 2):  # trigrams over a span's end do not count
                    ok[starts + n - back] = 0
                out[s:e] = np.add.reduceat(w[:-1][g] * ok[:, None], starts, axis=0) * (self.scale / np.maximum(1, n - 2))[:, None] + w[-1]
            return out

        every = np.arange(len(spans))
        return self._decide(margins(self.top, every), lambda f, r: margins(self.duel[f], r))


def gram_counts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(trigram hashes, how often each occurs) of a text; at most 2^BITS entries however long it is."""
    buf, _ = spans_of(np.frombuffer(raw, np.uint8), np.array([[0, len(raw)]]))
    return np.unique(grams(buf), return_counts=True)


def _longest(batches):
    schema = pa.schema([("id", pa.string()), ("lang", pa.string()), ("gram", pa.binary()), ("times", pa.binary())])
    for batch in batches:
        out: dict = {f.name: [] for f in schema}
        for key, text, lang in zip(*(c.to_pylist() for c in batch.columns)):
            raw = text.encode()
            best = max(blocks(raw), key=lambda b: b[2] - b[1], default=None)
            if best:
                g, c = gram_counts(raw[best[1] : best[2]])
                for name, v in zip(out, (key, lang, g.astype(np.int32).tobytes(), c.astype(np.int64).tobytes())):
                    out[name].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=schema)


def train(df: DataFrame, text_col: str, label_col: str, id_col: str, per_language: int = 200, least_share: float = 0.001) -> Model:
    """A model fitted on at most ``per_language`` documents of each label, chosen by hash;
    each gives its longest block of prose, whole: what comes here is its trigram counts,
    at most 2^BITS numbers a document. Besides the languages of ``FAMILIES`` every label
    of at least 50 documents and ``least_share`` of the labelled ones is a language."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), normal_label(F.col(label_col)).alias("lang")).where("lang is not null and text is not null and id is not null")
    # at most 1 / least_share labels can have that share; the row without a label is the total
    counted = [(r.lang, r.n) for r in rows.rollup("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(int(1 / least_share) + len(LANGUAGES) + 1).collect()]
    least = max(50, least_share * max((n for lang, n in counted if lang is None), default=0))
    labels = [lang for lang, n in counted if lang and (lang in LANGUAGES or n >= least)]
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    picked = rows.where(F.col("lang").isin(labels)).select("id", "lang").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language).select("id", "lang")
    sample = rows.join(F.broadcast(picked), ["id", "lang"]).select("id", "text", "lang").mapInArrow(_longest, "id string, lang string, gram binary, times binary")
    got = {r.id: r for r in sample.orderBy("id").collect()}  # bounded by per_language
    return Model([(np.frombuffer(r.gram, np.int32), np.frombuffer(r.times, np.int64)) for r in got.values()], [r.lang for r in got.values()])


def languages(df: DataFrame, id_col: str, text_col: str, label_col: str, *, per_language: int = 200, foreign_confidence: float = 2 / 3, related_confidence: float = 0.75, least_confidence: float = 0.3, model: Model | None = None) -> DataFrame:
    """``(id, block_no, lang, confidence, label)``.

    ``block_no`` 0 is the document's main language (of most of its prose); a row
    with a number above 0 is a block in another language than the main one, held
    with ``foreign_confidence`` or more (two to one), within a family
    ``related_confidence``. A main language held with less than ``least_confidence`` is
    ``und``: none of the languages learned.
    ``label`` is the normalised given label. A document without prose (null,
    empty or code only) gives no row, nor does a row with a null id; repeated rows
    count once. Other columns are ignored.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model or train(df, text_col, label_col, id_col, per_language))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        m = shared.value
        codes = np.array(["", *m.known])
        family = np.array([-1, *(next(i for i, ms in enumerate(m.families.values()) if x in ms) for x in m.known)])
        for batch in batches:
            data, off = flat(batch.column(1))
            raw = data.tobytes()
            found = [(d, k, off[d] + s, off[d] + e) for d in range(len(off) - 1) for k, s, e in blocks(raw[off[d] : off[d + 1]])]
            if not found:
                continue
            doc, number, s, e = np.array(found, np.int64).T
            lang, conf = m.classify(data, np.stack([s, e], 1))
            li = np.searchsorted(codes, lang)
            size = (e - s).astype(np.float64)
            weight = np.zeros((len(off) - 1, len(codes)))
            np.add.at(weight, (doc, li), size)
            main = weight.argmax(1)
            has = np.flatnonzero(weight.sum(1) > 0)
            right = np.zeros(len(off) - 1)
            np.add.at(right, doc, np.where(li == main[doc], conf * size, 0))
            share = right / np.maximum(1, weight[np.arange(len(main)), main])
            related = family[li] == family[main[doc]]
            odd = np.flatnonzero((li != main[doc]) & (conf >= np.where(related, related_confidence, foreign_confidence)))
            odd = odd[share[doc[odd]] >= least_confidence]
            who = np.concatenate([has, doc[odd]])
            mains = np.where(share[has] < least_confidence, "und", codes[main[has]])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(who)),
                    pa.array(np.concatenate([np.zeros(len(has), np.int64), number[odd]]), pa.int32()),
                    pa.array(np.concatenate([mains, lang[odd]]).tolist(), pa.string()),
                    pa.array(np.concatenate([share[has], conf[odd]])),
                    batch.column(2).take(pa.array(who)),
                ],
                names=["id", "block_no", "lang", "confidence", "label"],
            )

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), normal_label(F.col(label_col).cast("string")).alias("label")).where("id is not null and text is not null")
    return rows.mapInArrow(run, f"id {kind}, block_no int, lang string, confidence double, label string").dropDuplicates(["id", "block_no"])
