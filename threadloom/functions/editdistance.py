"""Weighted edit distance.

Insert and delete cost 1.  A substitution costs 1 within a class (letter for
letter, other for other) and 2 across classes.  If either side is empty the
distance is 0.  It is never below the plain distance and never above twice it,
so Spark's built-in ``levenshtein`` settles most pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from threadloom.functions.text import characters


def one_class(a: Column, b: Column) -> Column:
    """True when both sides are all letters, or both hold none."""
    both = F.concat(a, b)
    return both.rlike(r"^\p{L}*$") | both.rlike(r"^\P{L}*$")


def _letter(c: Column) -> Column:
    return c.rlike(r"^\p{L}$")


def _table(a: Column, b: Column) -> Column:
    """Last cell of the distance table, row by row (for short texts)."""
    ys = characters(b)

    def cost(x: Column, y: Column) -> Column:
        return F.when(x == y, 0).when(_letter(x) == _letter(y), 1).otherwise(2)

    def next_row(above: Column, x: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.size(ys)),
            F.array(F.get(above, 0) + 1),
            lambda row, j: F.array_append(
                row,
                F.least(
                    F.get(row, j - 1) + 1,
                    F.get(above, j) + 1,
                    F.get(above, j - 1) + cost(x, F.get(ys, j - 1)),
                ),
            ),
        )

    top = F.sequence(F.lit(0), F.size(ys))
    return F.element_at(F.aggregate(characters(a), top, next_row), -1)


def weighted_levenshtein(a: Column, b: Column) -> Column:
    """Exact weighted distance of two short texts (tokens), without Python."""
    return (
        F.when((a == "") | (b == "") | (a == b), 0)
        .when(one_class(a, b), F.levenshtein(a, b))
        .otherwise(_table(a, b))
    )


def is_within(a: Column, b: Column, threshold: Column) -> Column:
    """Whether the weighted distance of two non-empty tokens is at most ``threshold``.

    Checks run from cheap to dear: length gap, bounded plain distance, table.
    """
    plain = F.call_function("levenshtein", a, b, threshold)
    return (
        F.when(F.abs(F.length(a) - F.length(b)) > threshold, False)
        .when(threshold == 0, a == b)
        .when(plain < 0, False)
        .when(plain * 2 <= threshold, True)
        .when(one_class(a, b), True)
        .otherwise(_table(a, b) <= threshold)
    )


# --- long texts: Arrow batches ------------------------------------------------

#: Cells (characters and band) of the pairs that are worked on together: some 30 MB.
CELLS = 1 << 21
FAR = 1 << 30


def _characters(texts: list[str], lengths: np.ndarray, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of code points for each text, padded on both sides, and whether each is a letter."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    distinct, place = np.unique(flat, return_inverse=True)
    is_letter = np.fromiter((chr(c).isalpha() for c in distinct), bool, len(distinct))
    longest = int(lengths.max())
    codes = np.full((len(texts), left + longest + right), 0xFFFFFFFF, np.uint32)
    letters = np.zeros(codes.shape, bool)
    inside = np.arange(longest) < lengths[:, None]
    codes[:, left : left + longest][inside] = flat
    letters[:, left : left + longest][inside] = is_letter[place]
    return codes, letters


def _banded(xs: list[str], ys: list[str], n: np.ndarray, m: np.ndarray, width: int) -> np.ndarray:
    """Distances of pairs, longest ``xs`` first, right where they are ``width`` or less.

    Row i of the table of every pair is worked out at once, in the band of columns
    i - width to i + width: further out no way costs so little.
    """
    x, x_letter = _characters(xs, n, 0, 0)
    y, y_letter = _characters(ys, m, width + 1, int(n[0]) + width)
    steps = np.arange(2 * width + 1, dtype=np.int32)
    row = np.where(steps >= width, steps - width, FAR).astype(np.int32) + np.zeros((len(xs), 1), np.int32)
    found = np.empty(len(xs), np.int32)
    ends = m - n + width
    for i in range(int(n[0]) + 1):
        if i:
            here = slice(i, i + 2 * width + 1)
            cost = np.where(y_letter[:, here] == x_letter[:, i - 1 : i], 1, 2).astype(np.int32)
            cost[y[:, here] == x[:, i - 1 : i]] = 0
            best = row + cost
            np.minimum(best[:, :-1], row[:, 1:] + 1, out=best[:, :-1])
            row = np.minimum.accumulate(best - steps, axis=1) + steps
        open_ = int(np.searchsorted(-n, -i, side="left"))  # pairs that go on beyond row i
        if open_ < len(row):
            done = np.arange(open_, len(row))
            found[done] = row[done, ends[done]]
            row, x, x_letter, y, y_letter = row[:open_], x[:open_], x_letter[:open_], y[:open_], y_letter[:open_]
    return found


def distances(xs: list[str], ys: list[str], limits: list[int] | np.ndarray) -> np.ndarray:
    """The lesser of weighted distance and limit, of many pairs at once; 0 where a side is empty.

    Pairs of like limits and lengths share an array of at most ``CELLS``, or one
    pair's own table rows if these are longer.
    """
    n, m = (np.fromiter(map(len, t), np.int64, len(t)) for t in (xs, ys))
    limit = np.asarray(limits, np.int64)
    out = np.where(np.abs(n - m) < limit, FAR, limit)
    equal = np.fromiter((a == b for a, b in zip(xs, ys)), bool, len(xs))
    out[(n == 0) | (m == 0) | equal] = 0
    width = np.minimum(limit - 1, np.maximum(n, m))
    class_of = np.ceil(np.log2(np.maximum(width, 1)))
    asked = np.flatnonzero((out == FAR) & (limit > 0))
    asked = asked[np.lexsort((-n[asked], class_of[asked]))]
    at = 0
    while at < len(asked):
        ahead = asked[at:]
        ahead = ahead[: int(np.searchsorted(class_of[ahead], class_of[ahead[0]], side="right"))]
        band = int(width[ahead].max())
        cells = np.maximum.accumulate(n[ahead] * 2 + np.maximum.accumulate(m[ahead]) + 4 * band) * np.arange(1, len(ahead) + 1)
        some = ahead[: max(1, int(np.searchsorted(cells, CELLS)))]
        band = int(width[some].max())
        out[some] = _banded([xs[i] for i in some], [ys[i] for i in some], n[some], m[some], band)
        at += len(some)
    return np.minimum(out, np.maximum(limit, 0))


def exact_distances(xs: list[str], ys: list[str]) -> np.ndarray:
    """Weighted distances; the band grows until it holds them, so that close texts cost little."""
    out = np.zeros(len(xs), np.int64)
    asked = np.arange(len(xs))
    limits = np.fromiter((abs(len(a) - len(b)) + 8 for a, b in zip(xs, ys)), np.int64, len(xs))
    while len(asked):
        out[asked] = distances([xs[i] for i in asked], [ys[i] for i in asked], limits[asked])
        asked = asked[out[asked] >= limits[asked]]
        limits[asked] *= 2
    return out


def distance(a: str, b: str, limit: int | None = None) -> int:
    """Weighted distance of one pair, or ``limit`` if that is less."""
    return int((exact_distances([a], [b]) if limit is None else distances([a], [b], [limit]))[0])


@F.pandas_udf(IntegerType())
def weighted_levenshtein_long(a: pd.Series, b: pd.Series) -> pd.Series:
    """Exact weighted distance of long texts, an Arrow batch at a time."""
    out = pd.Series(None, index=range(len(a)), dtype="Int32")
    known = np.flatnonzero(a.notna().to_numpy() & b.notna().to_numpy())
    if len(known):
        out.iloc[known] = exact_distances(a.iloc[known].tolist(), b.iloc[known].tolist())
    return out


@F.pandas_udf(IntegerType())
def first_closer_than(text: pd.Series, others: pd.Series, limit: pd.Series) -> pd.Series:
    """Index (from 0) of the first of ``others`` whose distance is below ``limit``; null if none is.

    All pairs of an Arrow batch are measured together.
    """
    out = pd.Series(None, index=range(len(text)), dtype="Int32")
    known = np.flatnonzero(text.notna().to_numpy() & others.notna().to_numpy() & limit.notna().to_numpy())
    lists = [others.iloc[i] for i in known]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    row = np.repeat(known, sizes)
    if not len(row):
        return out
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    limits = limit.iloc[row].to_numpy(np.int64)
    near = distances(text.iloc[row].tolist(), [c for one in lists for c in one], limits) < limits
    rows, first = np.unique(row[near], return_index=True)
    out.iloc[rows] = at[near][first]
    return out


def register(spark) -> None:
    """Make the distance callable from SQL as ``weighted_levenshtein(a, b)``."""
    spark.udf.register("weighted_levenshtein", weighted_levenshtein_long)
