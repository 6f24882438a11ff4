"""String similarity. The two measures Spark lacks are vectorised UDFs; the rest are expressions."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


LONGEST_SHORT = 100
SEGMENTS_AT_ONCE = 8192


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts in rows of equal width, and the texts' lengths."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    rows = np.zeros((len(texts), max(int(sizes.max(initial=0)), 1)), np.uint32)
    rows[np.arange(rows.shape[1]) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return rows, sizes


def _longest_blocks(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and starts of the longest common block of each pair (a column of ``x`` and of ``y``), first in x, then in y."""
    n = x.shape[1]
    size, at_x, at_y = (np.zeros(n, np.int64) for _ in range(3))
    last = np.arange(len(y), dtype=np.int16)[:, None]
    run = np.zeros((len(y) + 1, n), np.int16)
    for i in range(len(x)):
        run[1:] = (run[:-1] + 1) * (y == x[i])
        best = (run[1:] * 128 - last).max(axis=0).astype(np.int64)  # the longest run, the earliest of equal ones
        length = (best + 127) // 128
        better = length > size
        size[better] = length[better]
        at_x[better] = i + 1 - length[better]
        at_y[better] = (length * 128 - best + 1 - length)[better]
    return size, at_x, at_y


def _matched(a: list[str], b: list[str]) -> np.ndarray:
    """Characters in the matching blocks of each pair of short texts: the longest block, then both sides of it, a level at a time."""
    (xs, xn), (ys, yn) = _codes(a), _codes(b)
    total = np.zeros(len(a), np.int64)
    segments = np.stack([np.arange(len(a)), np.zeros_like(xn), xn, np.zeros_like(yn), yn])
    while True:
        segments = segments[:, (segments[1] < segments[2]) & (segments[3] < segments[4])]
        if not segments.shape[1]:
            return total
        below = []
        for at in range(0, segments.shape[1], SEGMENTS_AT_ONCE):
            pair, x0, x1, y0, y1 = segments[:, at : at + SEGMENTS_AT_ONCE]
            i = x0 + np.arange((x1 - x0).max())[:, None]
            j = y0 + np.arange((y1 - y0).max())[:, None]
            # beyond a segment's end stand codes that no character has, another one on each side
            x = np.where(i < x1, xs[pair, np.minimum(i, xs.shape[1] - 1)], np.uint32(0xFFFFFFFF))
            y = np.where(j < y1, ys[pair, np.minimum(j, ys.shape[1] - 1)], np.uint32(0xFFFFFFFE))
            size, at_x, at_y = _longest_blocks(x, y)
            np.add.at(total, pair, size)
            p, q, found = x0 + at_x, y0 + at_y, size > 0
            below += [np.stack([pair, x0, p, y0, q])[:, found], np.stack([pair, p + size, x1, q + size, y1])[:, found]]
        segments = np.concatenate(below, axis=1)


def sequence_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """``SequenceMatcher(None, x, y).ratio()`` of each pair; pairs of short texts are matched together in arrays."""
    out = np.ones(len(a))
    short = np.fromiter((len(x) <= LONGEST_SHORT and len(y) <= LONGEST_SHORT for x, y in zip(a, b)), bool, len(a))
    for k in np.flatnonzero(~short):
        out[k] = SequenceMatcher(None, a[k], b[k]).ratio()
    near = np.flatnonzero(short)
    x, y = [a[k] for k in near], [b[k] for k in near]
    sizes = np.fromiter((len(p) + len(q) for p, q in zip(x, y)), np.int64, len(near))
    if len(near):
        out[near] = np.where(sizes > 0, 2.0 * _matched(x, y) / np.maximum(sizes, 1), 1.0)
    return out


@F.pandas_udf(T.DoubleType())
def ratcliff_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio, argument order kept (it is not symmetric)."""
    return pd.Series(sequence_ratios([x or "" for x in a], [y or "" for y in b]))


@F.pandas_udf(T.StringType())
def longest_common_substring(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest block shared by the lower-cased names, cut from the first name; '' up to 3 characters."""

    out = []
    for at in range(0, len(a), SEGMENTS_AT_ONCE):
        names = [x or "" for x in a[at : at + SEGMENTS_AT_ONCE]]
        xs, ys = [x.lower() for x in names], [(y or "").lower() for y in b[at : at + SEGMENTS_AT_ONCE]]
        if max(map(len, xs + ys)) <= LONGEST_SHORT:
            (x, xn), (y, yn) = _codes(xs), _codes(ys)
            # beyond a text's end stand codes that no character has, another one on each side
            x = np.where(np.arange(x.shape[1]) < xn[:, None], x, np.uint32(0xFFFFFFFF))
            y = np.where(np.arange(y.shape[1]) < yn[:, None], y, np.uint32(0xFFFFFFFE))
            size, start, _ = _longest_blocks(x.T, np.ascontiguousarray(y.T))
            hits = zip(start.tolist(), size.tolist())
        else:
            found = [SequenceMatcher(None, x, y).find_longest_match(0, len(x), 0, len(y)) for x, y in zip(xs, ys)]
            hits = ((hit.a, hit.size) for hit in found)
        out += [name[i : i + n] if n > 3 else "" for name, (i, n) in zip(names, hits)]
    return pd.Series(out, dtype="object")


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """(longest - distance) / longest, 0 when either side is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(
        (F.length(a) > 0) & (F.length(b) > 0), (longest - F.levenshtein(a, b)) / longest
    ).otherwise(0.0)


def ratio_possible(a: Column, b: Column, threshold: float | Column) -> Column:
    """Necessary condition of ``ratio(a, b) >= threshold`` that needs no Python.

    The ratio is 2M / (|a| + |b|); M is at most the shorter length, and all characters outside the
    matching blocks can be repaired one edit each, so the edit distance is at most
    (1 - threshold) * (|a| + |b|).
    """
    total = F.length(a) + F.length(b)
    threshold = threshold if isinstance(threshold, Column) else F.lit(threshold)
    slack = F.floor((1.0 - threshold) * total + 1e-9).cast("int")
    return (2 * F.least(F.length(a), F.length(b)) >= (threshold - 1e-9) * total) & (
        F.levenshtein(a, b) <= slack
    )


def boosted_ratio(a: Column, b: Column, boost: float = 0.8) -> Column:
    """Ratio of the upper-cased names, at least ``boost`` when one contains the other."""
    ua, ub = F.upper(a), F.upper(b)
    contained = ua.contains(ub) | ub.contains(ua)
    ratio = ratcliff_ratio(ua, ub)
    return F.when(contained, F.greatest(ratio, F.lit(boost))).otherwise(ratio)


def plain_ratio(a: Column, b: Column) -> Column:
    """Ratio of the trimmed upper-cased names; 1 when equal."""
    ua, ub = F.upper(F.trim(a)), F.upper(F.trim(b))
    return F.when(ua == ub, F.lit(1.0)).otherwise(ratcliff_ratio(ua, ub))


def boosted_levenshtein(a: Column, b: Column, boost: float = 0.8) -> Column:
    """JVM-side stand-in for :func:`boosted_ratio` with the same containment rule."""
    ua, ub = F.upper(a), F.upper(b)
    contained = ua.contains(ub) | ub.contains(ua)
    sim = levenshtein_similarity(ua, ub)
    return F.when(contained, F.greatest(sim, F.lit(boost))).otherwise(sim)


def digit_free(text: Column) -> Column:
    """The text with a mark in place of each digit: names that differ by numbers only have it in common."""
    return F.regexp_replace(text, "[0-9]", "\u0000")


def _by_mask(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """(places, digits of each) of the texts that are equal but for their digits; long texts stand alone, their digits unknown."""
    masks: dict[str, list[int]] = {}
    for n, text in enumerate(texts):
        plain = len(text) <= LONGEST_SHORT and "\0" not in text
        masks.setdefault(text.translate(_MASK) if plain else f"{n} {text}", []).append(n)
    out = []
    for mask, places in masks.items():
        at = [k for k, c in enumerate(mask) if c == "\0"]
        known = mask[:1] not in _DIGIT
        digits = np.array([[_DIGIT[texts[n][k]] for k in at] for n in places], np.int64).reshape(len(places), len(at)) if known else None
        out.append((np.array(places), digits))
    return out


_DIGIT = {str(d): d for d in range(10)}
_MASK = {ord(d): "\0" for d in _DIGIT}


def _equal_digits(x: np.ndarray | None, y: np.ndarray | None) -> np.ndarray | None:
    """A number for each pair of rows that tells which digits of the one equal which of the other; None if it does not fit."""
    if x is None or y is None or x.shape[1] * y.shape[1] > 62:
        return None
    width = y.shape[1]
    found = np.zeros((len(y), 10), np.int64)  # where each digit stands, a bit for each place
    for k in range(width):
        found[np.arange(len(y)), y[:, k]] |= 1 << k
    out = np.zeros((len(x), len(y)), np.int64)
    for k in range(x.shape[1]):
        out |= found.T[x[:, k]] << (k * width)
    return out


@F.pandas_udf(T.StructType([T.StructField("total", T.DoubleType()), T.StructField("pairs", T.LongType())]))
def ratio_totals(xs: pd.Series, x_texts: pd.Series, ys: pd.Series, y_texts: pd.Series, same: pd.Series) -> pd.DataFrame:
    """Sum of the ratios of every pair of different names of two chunks, the earlier name first, and their number.

    ``x_texts`` and ``y_texts`` are what is compared; of one chunk with itself (``same``) each pair counts once.
    The ratio only asks which characters are equal. So pairs of texts that differ by digits only, and have equal digits in
    the same places, have one ratio: it is worked out once and counted as often as there are such pairs.
    """
    out = []
    for left, low, right, high, once in zip(xs, x_texts, ys, y_texts, same):
        rank = np.unique(np.concatenate([left, right]).astype(object), return_inverse=True)[1]
        x_rank, y_rank = rank[: len(left)], rank[len(left) :]
        first, second, times = [], [], []
        x_masks, y_masks = _by_mask(list(low)), _by_mask(list(high))
        for p, x in x_masks:
            for q, y in y_masks:
                kinds = _equal_digits(x, y)
                if kinds is None:
                    kinds = np.arange(len(p) * len(q)).reshape(len(p), len(q))
                before = x_rank[p][:, None] < y_rank[q][None, :]
                after = np.zeros_like(before) if once else x_rank[p][:, None] > y_rank[q][None, :]
                for turned, chosen in enumerate((before, after)):
                    i, j = np.nonzero(chosen)
                    _, at, n = np.unique(kinds[chosen], return_index=True, return_counts=True)
                    a, b = [low[k] for k in p[i[at]]], [high[k] for k in q[j[at]]]
                    first += b if turned else a
                    second += a if turned else b
                    times.append(n)
        n = np.concatenate(times) if times else np.zeros(0, np.int64)
        out.append((float((sequence_ratios(first, second) * n).sum()), int(n.sum())))
    return pd.DataFrame(out, columns=["total", "pairs"])


def ratio_upper_bound(a: Column, b: Column) -> Column:
    """No Ratcliff ratio exceeds this, and it needs no Python: 1 - edit distance / (|a| + |b|)."""
    total = F.length(a) + F.length(b)
    by_edits = 1.0 - F.levenshtein(a, b) / total
    by_length = 2.0 * F.least(F.length(a), F.length(b)) / total
    return F.when(total > 0, F.least(by_edits, by_length)).otherwise(1.0)
