"""Periodic runs of words: stretches that repeat a period several times over.

A run of period q and length n agrees with itself over n - q words when moved by q. Where the least such
overlap is k, each word of a run lies in a k-gram that the text holds at least twice, so words outside
repeated k-grams cannot join a run. What is left are segments, and in most texts nothing. On each segment
the divide and conquer of Main and Lorentz finds all runs: those across a segment's middle follow, for
every period at once, from how far the text agrees with itself on either side (Z functions, in linear
time), the others lie in its halves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marginalia.llm.base import cleared, row_schema, sliced, texts_of, with_columns

#: A run has this many words at least, and this many times its period.
LEAST, TIMES = 6, 4
#: Odd factors that make a number of the words of a k-gram. Two k-grams may share one; that only leaves more to look at.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def overlap(least: int, times: int) -> int:
    """The least number of words over which a run agrees with itself moved by its period."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def gram_numbers(codes: np.ndarray, k: int) -> np.ndarray:
    """A number for each k-gram; equal k-grams have equal ones."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, x = np.zeros(n, np.uint64), codes.astype(np.uint64) + np.uint64(1)
    for i in range(k):
        mixed = x[i : i + n] * _FACTORS[i % len(_FACTORS)]
        out = (out ^ (out >> np.uint64(29))) * _FACTORS[0] + (mixed ^ (mixed >> np.uint64(32)))
    return out


def segments(grams: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The longest stretches of words that lie in repeated k-grams."""
    if not len(grams):
        return []
    order = np.argsort(grams, kind="stable")
    x = grams[order]
    same = x[1:] == x[:-1]
    if not same.any():
        return []
    twice = np.zeros(len(x), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = np.sort(order[twice])
    step = np.zeros(len(grams) + k, np.int64)
    step[at] += 1
    np.add.at(step, at + k, -1)
    inside = np.concatenate([[False], np.cumsum(step)[:-1] > 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def agreement(s: list[int]) -> list[int]:
    """For each place of s, how many values from there on are as those from the start (the Z function)."""
    n = len(s)
    z, a, b = [0] * n, 0, 0
    for i in range(1, n):
        m = min(b - i, z[i - a]) if i < b else 0
        while i + m < n and s[m] == s[i + m]:
            m += 1
        z[i] = m
        if i + m > b:
            a, b = i, i + m
    if n:
        z[0] = n
    return z


def _across(codes: np.ndarray, a: int, mid: int, b: int, most: int) -> Iterator[tuple[int, int, int]]:
    """Start, end and period of what repeats with a period up to most across mid, within a to b."""
    left, right = codes[a:mid].tolist(), codes[mid:b].tolist()
    back = left[::-1]
    wide = min(most, len(right))
    ahead = agreement(right)
    behind = agreement([*back, -1, *right[:wide][::-1], *back])[len(back) + 1 :]
    for p in range(1, wide + 1):  # a copy of the period begins at mid
        yield mid - behind[wide - p], mid + p + (ahead[p] if p < len(right) else 0), p
    wide = min(most, len(left))
    behind = agreement(back)
    ahead = agreement([*right, -1, *left[len(left) - wide :], *right])[len(right) + 1 :]
    for p in range(1, wide + 1):  # a copy ends there
        yield mid - p - (behind[p] if p < len(left) else 0), mid + ahead[wide - p], p


def _may_cross(codes: np.ndarray, grams: np.ndarray, k: int, mid: int, most: int, a: int, b: int) -> bool:
    """Whether a run of a period up to most may lie across mid: two of its periods then lie on one side, so the side's first words come again."""
    short = min(k - 1, most)
    if (codes[mid + 1 : min(mid + short + 1, b)] == codes[mid]).any() or (codes[max(mid - 1 - short, a) : mid - 1] == codes[mid - 1]).any():
        return True
    if most < k:
        return False
    first, last = max(a, mid - k - most), min(b - k, mid + most)
    return bool(mid + k <= b and (grams[mid + k : last + 1] == grams[mid]).any()) or bool(mid - k >= a and (grams[first : mid - 2 * k + 1] == grams[mid - k]).any())


def runs(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of every run of the words that codes stand for, by start, then period.

    A run has at least least words and times periods (times must be 3 at least), and none of its neighbours goes on with the period.
    """
    if times < 3:
        raise ValueError("a run must hold its period three times")
    n, k, found = len(codes), overlap(least, times), {}
    grams = gram_numbers(codes, k)
    todo = segments(grams, k)
    while todo:
        a, b = todo.pop()
        if b - a < max(least, times):
            continue
        mid, most = (a + b) // 2, (b - a) // times
        if _may_cross(codes, grams, k, mid, most, a, b):
            for s, e, p in _across(codes, a, mid, b, most):
                if e - s < max(least, times * p) or (s and codes[s - 1] == codes[s - 1 + p]) or (e < n and codes[e] == codes[e - p]):
                    continue  # too short, or a part of a run that goes on beyond a to b
                found[s, e] = min(p, found.get((s, e), p))
        todo += [(a, mid), (mid, b)]
    return sorted((s, e - s, p) for (s, e), p in found.items())


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: all but those that lie in a run behind its first period."""
    step = np.zeros(n + 1, np.int64)
    for s, length, p in found:
        step[s + p] += 1
        step[s + length] -= 1
    return np.cumsum(step[:n]) == 0


def find_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with runs (an array of start, length, period in words, by start, then period) and collapsed.

    collapsed is the words that stay, joined by single spaces, once every run is cut back to its first
    period. Null and empty texts have no words, hence no runs and an empty collapsed text. Own columns of
    these names give way. A text is worked on as a whole, in memory that follows its length; a row depends
    on nothing but itself, so repeated rows have equal results and lost tasks are simply run again.
    """
    docs, back = cleared(docs, ("runs", "collapsed"), (text_col,))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct({"start": pa.int64(), "length": pa.int64(), "period": pa.int64()}))
        for batch in sliced(batches, text_col):
            out, texts = [], []
            for text in texts_of(batch, text_col):
                words = text.encode().split()  # by space and tab to carriage return
                known: dict[bytes, int] = {}
                found = runs(np.array([known.setdefault(w, len(known)) for w in words], np.int64), least, times)
                if found:
                    words = [w for w, stays in zip(words, kept(len(words), found).tolist(), strict=True) if stays]
                out.append([dict(zip(("start", "length", "period"), x, strict=True)) for x in found])
                texts.append(b" ".join(words).decode())
            yield with_columns(batch, runs=pa.array(out, kind), collapsed=pa.array(texts, pa.string()))

    return back(docs.mapInArrow(run, row_schema(docs, "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")))
