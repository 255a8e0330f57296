"""Runs of neighbouring k-mers with one minimizer, dealt to buckets, so that equal k-mers meet without a shuffle of k-mers.

A run of ten k-mers takes about a dozen bytes, ten (k-mer, color) rows take a hundred.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dna import MAX_PACKED
from .windows import _CODE, STRETCH, _mixed, _source, encode, ship

BUCKETS, MINIMIZER = 1 << 12, 13
#: Windows whose runs are held before they are dealt, and windows opened at once; a larger bucket is opened in several passes.
HELD, OPENED = 1 << 22, 1 << 22


def runs(bases: np.ndarray, k: int, canonical: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows (at most k) and bucket of each run of valid windows with one minimizer; bases as 0 to 3, others 4."""
    bad = np.concatenate(([0], np.cumsum(bases > 3, dtype=np.int32)))
    valid = bad[k:] == bad[:-k]
    m = min(MINIMIZER, (k + 1) // 2)
    least, size, w = (encode(bases, m, canonical)[0] + 1) * np.int64(-7046029254386353131), 1, k - m + 1
    while 2 * size <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: len(valid)], least[w - size : w - size + len(valid)])
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    start = np.flatnonzero(new)
    if not len(start):
        return start, start, start
    n = np.add.reduceat(valid.astype(np.int64), start)
    pieces = -(-n // k)
    own = np.repeat(np.arange(len(start)), pieces)
    step = k * (np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    buckets = (_mixed(least[start], 7).view(np.uint64) >> np.uint64(52)).astype(np.int64)
    return start[own] + step, np.minimum(n[own] - step, k), buckets[own]


def spelled(bases: np.ndarray, start: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Code of each run's first k-mer and of the n - 1 bases behind it."""
    first, rest, two = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64), np.uint64(2)
    for j in range(k):
        first = first << two | bases[start + j].astype(np.uint64)
    for j in range(int(n.max(initial=1)) - 1):
        more = np.flatnonzero(n > j + 1)
        rest[more] = rest[more] << two | bases[start[more] + k + j].astype(np.uint64)
    return first, rest


def opened(first: np.ndarray, rest: np.ndarray, n: np.ndarray, k: int, canonical: bool) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all k-mers of runs and the run of each."""
    own = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    forward = first[own] << (2 * j).astype(np.uint64) | rest[own] >> (2 * (n[own] - 1 - j)).astype(np.uint64)
    forward &= np.uint64((1 << 2 * k) - 1)
    if not canonical:
        return forward.view(np.int64), own
    back = ~forward
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        back = back >> np.uint64(shift) & np.uint64(mask) | (back & np.uint64(mask)) << np.uint64(shift)
    return np.minimum(forward, back.byteswap() >> np.uint64(64 - 2 * k)).view(np.int64), own


def _packed(parts: list[tuple], width: int) -> pa.RecordBatch:
    """One row for each bucket; equal runs with equal colors once. Bytes of equal weight lie together, which compresses them."""
    first, rest, n, bucket, colors = (np.concatenate(x, axis=-1) for x in zip(*parts, strict=True))
    mix = first ^ _mixed(rest, 3).view(np.uint64) ^ n.astype(np.uint64)
    for i in range(width):
        mix = _mixed(mix, 2 * i + 13).view(np.uint64) ^ colors[i].view(np.uint64)
    key = bucket.astype(np.uint64) << np.uint64(52) | _mixed(mix, 1).view(np.uint64) >> np.uint64(12)
    order = np.argsort(key)
    table = np.empty((len(order), 17 + 8 * width), np.uint8)
    table[:, :8], table[:, 8:16], table[:, 16] = first[order].view(np.uint8).reshape(-1, 8), rest[order].view(np.uint8).reshape(-1, 8), n[order]
    for i in range(width):
        table[:, 17 + 8 * i : 25 + 8 * i] = colors[i][order].view(np.uint8).reshape(-1, 8)
    key, bucket = key[order], bucket[order]
    maybe = np.flatnonzero(key[1:] == key[:-1])
    keep = np.ones(len(order), bool)
    keep[maybe + 1] = (table[maybe + 1] != table[maybe]).any(axis=1)
    table, bucket = table[keep], bucket[keep]
    found = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    ends, codec = np.append(found[1:], len(bucket)), pa.Codec("zstd")
    packs = [codec.compress(table[a:b].T.tobytes(), asbytes=True) for a, b in zip(found.tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[found], pa.int32()), pa.array(ends - found, pa.int32()), pa.array(packs, pa.binary())], names=["bucket", "n", "runs"])


def _marked(colors: pa.Array) -> np.ndarray:
    """Colors as numbers of which 0 means none: those from 0 on are raised by one."""
    c = colors.fill_null(0).to_numpy()
    return np.where(colors.is_valid().to_numpy(zero_copy_only=False), c + (c >= 0), 0)


def dealt(df: DataFrame, k: int, colors: list[str], seq: str = "seq", canonical: bool = True, spread: int | None = None) -> DataFrame:
    """(bucket, n, runs): packs of n runs of the sequences' k-mers. `colors` are a sequence's color in each index, null if it isn't in it.

    `spread` deals the sequences over so many partitions first if they come in fewer.
    """
    if k > MAX_PACKED:
        raise ValueError(f"runs are of k-mers up to {MAX_PACKED}")
    width = len(colors)
    rows = df.select(*(F.col(c).cast("long").alias(c) for c in colors), F.col(seq).alias("seq"))
    src = _source(rows, colors, "seq", spread if spread and rows.rdd.getNumPartitions() < spread else None)

    def run(batches):
        held, n_held, texts, owners, n_bases = [], 0, [], [], 0

        def cut() -> int:
            bases = _CODE[np.frombuffer(b"N".join(texts), np.uint8)]
            start, n, bucket = runs(bases, k, canonical)
            ends = np.cumsum([len(t) + 1 for t in texts])
            held.append((*spelled(bases, start, n, k), n, bucket, np.stack(owners, axis=1)[:, np.searchsorted(ends, start, "right")]))
            return int(n.sum())

        for b in batches:
            own = np.stack([_marked(b.column(i)) for i in range(width)])
            for i in np.flatnonzero(own.any(axis=0)).tolist():
                s = b.column(width)[i].as_py()
                if s is None or len(s) < k:
                    continue
                for a in range(0, len(s) - k + 1, STRETCH):
                    texts.append(s[a : a + STRETCH + k - 1])
                    owners.append(own[:, i])
                    n_bases += len(texts[-1])
                    if n_bases >= STRETCH:
                        n_held += cut()
                        texts, owners, n_bases = [], [], 0
                    if n_held >= HELD:
                        yield _packed(held, width)
                        held, n_held = [], 0
        if texts:
            n_held += cut()
        if n_held:
            yield _packed(held, width)

    return src.mapInArrow(run, "bucket int, n int, runs binary")


def by_bucket(packs: DataFrame, k: int, width: int, canonical: bool, work: Callable[[np.ndarray, list[np.ndarray]], None], rest: Callable[[bool], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work(k-mers, [colors in each index, as _marked() gives them]) for all k-mers of a bucket or of a part of one.

    What rest(last) gives goes to the result, after each bucket and at the task's end.
    """
    ship(packs.sparkSession)
    src = packs.repartition("bucket").sortWithinPartitions("bucket")

    def done(held: list[tuple[int, bytes]], codec: pa.Codec) -> None:
        size = 17 + 8 * width
        table = np.concatenate([np.frombuffer(codec.decompress(x, n * size), np.uint8).reshape(size, n).T for n, x in held])
        number = lambda a: np.ascontiguousarray(table[:, a : a + 8]).view(np.uint64).ravel()
        first, behind, n, colors = number(0), number(8), table[:, 16].astype(np.int64), [number(17 + 8 * i).view(np.int64) for i in range(width)]
        places = np.cumsum(n)
        total = int(places[-1])
        if total <= OPENED:
            kms, own = opened(first, behind, n, k, canonical)
            return work(kms, [c[own] for c in colors])
        passes = -(-total // OPENED)
        cuts = np.unique(np.append(np.searchsorted(places, np.arange(0, total, OPENED)), len(n)))
        for p in range(passes):
            found = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                kms, own = opened(first[a:b], behind[a:b], n[a:b], k, canonical)
                here = np.flatnonzero(_mixed(kms, 9).view(np.uint64) % np.uint64(passes) == p)
                found.append((kms[here], *(c[a:b][own[here]] for c in colors)))
            kms, *own_colors = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(kms):
                work(kms, own_colors)

    def run(batches):
        now, held, codec = None, [], pa.Codec("zstd")
        for b in batches:
            for bucket, n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if bucket != now and held:
                    done(held, codec)
                    yield from rest(False)
                    held = []
                now = bucket
                held.append((n, x.as_py()))
        if held:
            done(held, codec)
        yield from rest(True)

    return src.mapInArrow(run, schema)
