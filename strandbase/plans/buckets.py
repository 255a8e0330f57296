"""Builds, merges and differences of indexes that are only counted: done bucket by bucket, no index is stored.

All k-mers of a bucket are at hand in one task, so its part of each index is built, merged and compared there.
What leaves a task is color lists and how many k-mers have them.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.superkmers import by_bucket, dealt

#: Lists a task counts before it gives them away.
LISTS = 1 << 16


class Lists(NamedTuple):
    """A bucket's part of an index: its k-mers' ranks, which ascend, where the list of each begins, and the lists' colors."""

    ranks: np.ndarray
    starts: np.ndarray
    colors: np.ndarray

    def sizes(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.colors)))


def _grouped(ranks: np.ndarray, colors: np.ndarray) -> Lists:
    """Lists of (rank, color) pairs in order."""
    if not len(ranks):
        return Lists(ranks, ranks, colors)
    starts = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1]))
    return Lists(ranks[starts], starts, colors)


def built(ranks: np.ndarray, colors: np.ndarray) -> Lists:
    """The index of (rank, color) pairs in any order, which may repeat."""
    if not len(ranks):
        return _grouped(ranks, colors)
    known = None
    if colors.min() < 0 or int(colors.max() + 1) * int(ranks.max() + 1) >= 1 << 63:
        known, colors = np.unique(colors, return_inverse=True)
    top = int(colors.max()) + 1
    pairs = np.sort(ranks * top + colors)
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])]
    return _grouped(pairs // top, pairs % top if known is None else known[pairs % top])


def merged(parts: list[tuple[Lists, int]]) -> Lists:
    """Union of indexes in order, the colors of each shifted beyond those before it; lists are joined as they are."""
    if len(parts) == 1 and not parts[0][1]:
        return parts[0][0]
    ranks, colors = (np.concatenate(x) for x in zip(*((np.repeat(x.ranks, x.sizes()), x.colors + shift) for x, shift in parts), strict=True))
    order = np.argsort(ranks, kind="stable")
    ranks, colors = ranks[order], colors[order]
    if ((ranks[1:] == ranks[:-1]) & (colors[1:] <= colors[:-1])).any():  # shifted colors are among those before them
        return built(ranks, colors)
    return _grouped(ranks, colors)


def _at(x: Lists, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Colors of some lists and where each begins."""
    sizes = x.sizes()[which]
    begins = np.cumsum(sizes) - sizes
    return x.colors[np.repeat(x.starts[which] - begins, sizes) + np.arange(int(sizes.sum()))], begins


def differing(a: Lists, b: Lists) -> tuple[np.ndarray, np.ndarray]:
    """Which lists of each index the other hasn't for that k-mer."""
    only_a, only_b = np.ones(len(a.ranks), bool), np.ones(len(b.ranks), bool)
    _, i, j = np.intersect1d(a.ranks, b.ranks, assume_unique=True, return_indices=True)
    alike = a.sizes()[i] == b.sizes()[j]
    i, j = i[alike], j[alike]
    if len(i):
        (x, begins), (y, _) = _at(a, i), _at(b, j)
        same = np.logical_and.reduceat(x == y, begins)
        only_a[i[same]] = only_b[j[same]] = False
    return np.flatnonzero(only_a), np.flatnonzero(only_b)


def _count(into: Counter, side: str, x: Lists, which: np.ndarray | None = None) -> None:
    if which is not None:
        colors, starts = _at(x, which)
        x = Lists(x.ranks[which], starts, colors)
    sizes = x.sizes()
    one, n = np.unique(x.colors[x.starts[sizes == 1]], return_counts=True)
    for c, m in zip(one, n.tolist(), strict=True):
        into[side, c.tobytes()] += m
    many = np.flatnonzero(sizes > 1)
    text, starts, ends = x.colors.tobytes(), (8 * x.starts[many]).tolist(), (8 * (x.starts + sizes)[many]).tolist()
    into.update((side, text[a:b]) for a, b in zip(starts, ends, strict=True))


def _counts(seqs: DataFrame, k: int, left: dict[str, int], right: dict[str, int] | None, both_strands: bool, spread: int | None) -> DataFrame:
    columns = list(dict.fromkeys([*left, *(right or {})]))
    into: Counter = Counter()

    def work(kms: np.ndarray, colors: list[np.ndarray]) -> None:
        order = np.argsort(kms)
        kms = kms[order]
        ranks = np.cumsum(np.append(False, kms[1:] != kms[:-1]))
        indexes = {}
        for name, c in zip(columns, colors, strict=True):
            c = c[order]
            here = c != 0
            indexes[name] = built(ranks[here], c[here] - (c[here] > 0))
        a = merged([(indexes[name], shift) for name, shift in left.items()])
        if right is None:
            _count(into, "left", a)
            return
        b = merged([(indexes[name], shift) for name, shift in right.items()])
        only_a, only_b = differing(a, b)
        _count(into, "left", a, only_a)
        _count(into, "right", b, only_b)

    def rest(last: bool):
        if into and (last or len(into) >= LISTS):
            sides, lists = zip(*into, strict=True)
            ends = np.cumsum([0, *(len(x) // 8 for x in lists)])
            colors = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(lists), np.int64)))
            batch = pa.RecordBatch.from_arrays([pa.array(sides, pa.string()), colors, pa.array(list(into.values()), pa.int64())], names=["side", "colors", "n"])
            into.clear()
            yield batch

    packs = dealt(seqs, k, columns, "seq", both_strands, spread)
    rows = by_bucket(packs, k, len(columns), both_strands, work, rest, "side string, colors array<long>, n long")
    return rows.groupBy("side", "colors").agg(F.sum("n").alias("n"))


def merged_sets(seqs: DataFrame, k: int, parts: dict[str, int], both_strands: bool = True, spread: int | None = None) -> DataFrame:
    """(colors, n) of the merge of indexes: each color list and how many k-mers have it.

    seqs(seq, ...) has a column for each index: the sequence's color in it, null if it isn't in it. `parts` are these
    columns, in order, and what their colors are shifted by: the number of colors before them.
    """
    return _counts(seqs, k, parts, None, both_strands, spread).select("colors", "n")


def differing_sets(seqs: DataFrame, k: int, left: dict[str, int], right: dict[str, int], both_strands: bool = True, spread: int | None = None) -> DataFrame:
    """(side, colors, n) of the k-mers whose colors differ between two indexes or merges, given as in merged_sets()."""
    return _counts(seqs, k, left, right, both_strands, spread)
