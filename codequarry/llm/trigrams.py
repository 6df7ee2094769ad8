"""Trigram index over a batch of texts, and the trigrams a regular expression requires.

The index of a batch is a bitmap per required trigram (its postings). A pattern's
requirement is a formula of AND and OR over trigrams; evaluating it intersects and
unites postings, so the pattern itself only runs on the texts that are left.
Everything is folded to ASCII lower case, which can only add candidates.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser

import numpy as np

from codequarry.llm.textkernels import LOWER

MAX_EXACT = 1024  # alternatives kept as exact strings while a pattern is walked
TRUE = ("and", ())


def _both(op: str, parts) -> tuple:
    parts = tuple(dict.fromkeys(p for p in parts if op == "or" or p != TRUE))
    if op == "or" and TRUE in parts:
        return TRUE
    return parts[0] if len(parts) == 1 else (op, parts)


def _grams(words: set[str]) -> tuple:
    """Any of the words must occur."""
    return _both("or", [_both("and", [w[i : i + 3] for i in range(len(w) - 2)]) if len(w) > 2 else TRUE for w in sorted(words)])


def _walk(tree) -> tuple[set[str] | None, tuple]:
    """(exact strings the pattern can match or None, requirement)."""
    exact: set[str] = {""}
    need: list = []

    def flush():
        nonlocal exact
        need.append(_grams(exact))
        exact = {""}

    for op, arg in tree:
        words, req = None, TRUE
        if op is sre.LITERAL:
            words = {chr(arg).lower()} if arg < 128 else None
        elif op is sre.IN:
            chars = {chr(v).lower() for o, v in arg if o is sre.LITERAL and v < 128}
            words = chars if all(o is sre.LITERAL for o, _ in arg) and len(chars) <= 10 else None
        elif op is sre.SUBPATTERN:
            words, req = _walk(arg[3])
        elif op is sre.BRANCH:
            each = [_walk(b) for b in arg[1]]
            if all(w is not None for w, _ in each):
                words = set().union(*(w for w, _ in each))
            req = _both("or", [_both("and", [_grams(w) if w is not None else TRUE, r]) for w, r in each])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, sub = arg
            w, r = _walk(sub)
            if low == 0 and high == 1 and w is not None:
                words = w | {""}
            elif low == high == 1:
                words, req = w, r
            elif low >= 1:
                if w is not None and len(w) == 1 and low <= 32:  # e.g. -{5}
                    exact = {e + next(iter(w)) * low for e in exact}
                req = _both("and", [_grams(w) if w is not None else TRUE, r])
        elif op is sre.ASSERT and arg[0] == 1:  # what must follow, without taking it
            words, req = _walk(arg[1])
            ahead = {e + w for e in exact for w in words} if words is not None and len(words) * len(exact) <= MAX_EXACT else exact
            need += [_grams(ahead), req if words is None else TRUE]
            continue
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            continue
        if words is not None and len(words) * len(exact) <= MAX_EXACT:
            exact = {e + w for e in exact for w in words}
        else:
            flush()
            need.append(req if words is None else _both("and", [req, _grams(words)]))
            if words is not None and len(words) <= MAX_EXACT:
                exact = words
    if not need:
        return exact, TRUE
    flush()
    return None, _both("and", need)


def required(pattern: str) -> tuple:
    """The requirement of a pattern; ``TRUE`` if it has none."""
    words, req = _walk(parser.parse(pattern))
    return _both("and", [req, _grams(words) if words is not None else TRUE])


def grams_of(formula) -> set[str]:
    return {formula} if isinstance(formula, str) else set().union(set(), *(grams_of(p) for p in formula[1]))


class Index:
    """Postings of the given trigrams, built per batch."""

    def __init__(self, grams: set[str]):
        self.grams = {g: i for i, g in enumerate(sorted(grams))}
        self.table = np.zeros(1 << 24, np.uint16)
        for g, i in self.grams.items():
            a, b, c = g.encode("ascii")
            self.table[a << 16 | b << 8 | c] = i + 1

    def postings(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Row per trigram, column per text: does the trigram occur in it?"""
        out = np.zeros((len(self.grams), len(off) - 1), bool)
        step = 1 << 22
        for s in range(0, max(0, len(data) - 2), step):
            low = LOWER[data[s : s + step + 2]].astype(np.uint32)
            hit = self.table[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
            at = np.flatnonzero(hit)
            text = np.searchsorted(off, at + s, side="right") - 1
            inside = at + s + 3 <= off[text + 1]
            out[hit[at[inside]] - 1, text[inside]] = True
        return out

    def matching(self, formula, bitmaps: np.ndarray) -> np.ndarray:
        if isinstance(formula, str):
            return bitmaps[self.grams[formula]]
        out = np.full(bitmaps.shape[1], formula[0] == "and")
        for part in formula[1]:
            m = self.matching(part, bitmaps)
            out = out & m if formula[0] == "and" else out | m
        return out
