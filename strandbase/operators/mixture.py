"""Support rules and mixture weights over (obs, color) compatibility.

Unique support counts the reads (or segments) compatible with a color alone, shared support all that are
compatible with it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import ship
from ..plans.store import stored


def _supports(hits: DataFrame, keys: list[str]) -> DataFrame:
    alone = (F.col("size") == 1).cast("long")
    return hits.groupBy(*keys).agg(F.sum(alone).alias("unique_n"), F.count(F.lit(1)).alias("shared_n"))


def support(results: DataFrame) -> DataFrame:
    """(color, unique_n, shared_n): reads compatible with the color alone, and all reads compatible with it."""
    return _supports(results.select(F.size("colors").alias("size"), F.explode("colors").alias("color")), ["color"])


def _need(top: Column, minimum: int, fraction: float) -> Column:
    return F.greatest(F.lit(minimum), F.floor(top * F.lit(float(fraction))))


def unique_support(supports: DataFrame, min_unique: int, fraction: float, min_shared: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Rows that reach max(min_unique, floor(greatest * fraction)) of unique support.

    If no color reaches that, the rows that reach the same bar of shared support, with its own minimum
    (default: the unique one). `keys` decides apart for each of their values.
    """
    own = keys or []
    tops = supports.groupBy(*own).agg(F.max("unique_n").alias("__u"), F.max("shared_n").alias("__s"))
    if own:
        rows = supports.join(tops, own)
    else:
        u, s = tops.first()  # one row
        rows = supports.withColumns({"__u": F.lit(u), "__s": F.lit(s)})
    unique, shared = _need(F.col("__u"), min_unique, fraction), _need(F.col("__s"), min_unique if min_shared is None else min_shared, fraction)
    passed = F.when(F.col("__u") >= unique, F.col("unique_n") >= unique).otherwise(F.col("shared_n") >= shared)
    return rows.where(passed).drop("__u", "__s")


def combined_support(supports: DataFrame, threshold: float, weight: float, denominator: float, min_unique: int = 0, min_shared: int = 0) -> DataFrame:
    """Rows whose weighted mean of unique and shared support over the denominator reaches the threshold; none if it isn't positive."""
    if denominator <= 0:
        return supports.limit(0)
    share = (F.col("unique_n") * weight + F.col("shared_n") * (1 - weight)) / F.lit(float(denominator))
    return supports.where((F.col("unique_n") >= min_unique) & (F.col("shared_n") >= min_shared) & (share >= threshold - 1e-8))


def consensus(segments: DataFrame, min_unique: int, fraction: float, min_shared: int | None = None) -> DataFrame:
    """(query, color, unique_n, shared_n) of each query's colors that unique_support() would keep, over its segments' colors."""
    hits = segments.select("query", F.size("colors").alias("size"), F.explode("colors").alias("color"))
    return unique_support(_supports(hits, ["query", "color"]), min_unique, fraction, min_shared, ["query"]).select("query", "color", "unique_n", "shared_n")


def observations(results: DataFrame) -> DataFrame:
    """(obs, colors, n): equal color lists of results counted once; what EM iterates over."""
    return results.where(F.size("colors") > 0).groupBy("colors").agg(F.count(F.lit(1)).alias("n")).select(F.xxhash64("colors").alias("obs"), "colors", "n")


def likelihoods(obs: DataFrame, value: Callable[[Column], Column]) -> DataFrame:
    """(obs, n, color, likelihood) with a likelihood of one's own: `value` maps the color, beside obs's columns, to it."""
    return obs.withColumn("color", F.explode("colors")).select("obs", "n", "color", value(F.col("color")).cast("double").alias("likelihood"))


def compatibility(obs: DataFrame, w: float) -> DataFrame:
    """(obs, n, color, likelihood): w / (w + 1) for compatible colors; others have 1 / (w + 1), the base of em()."""
    return likelihoods(obs, lambda _: F.lit(w / (w + 1)))


@dataclass
class _Sums:
    weights: np.ndarray  # of each component, times its posterior; base part left out
    shares: float  # n / mass over all observations
    compatible: float  # expected observations of listed components
    log: float  # n * ln(mass)


def _listed(table: DataFrame) -> DataFrame:
    """(n, colors, likelihoods) of each observation, as a stored table."""
    own = F.sort_array(F.collect_list(F.struct("color", "likelihood")))
    rows = table.groupBy("obs", "n").agg(own.alias("own"))
    return stored(rows.select("n", F.col("own.color").alias("colors"), F.col("own.likelihood").alias("likelihoods")), "mixture")


def _pass(rows: DataFrame, weights: np.ndarray, base: float, value: float | None = None) -> _Sums:
    """One job over the observations: sums for every component. `value` stands for all likelihoods.

    Weights are sent as a broadcast array of n_components numbers; tasks add up before anything is shuffled,
    and the driver gets one number for each component.
    """
    spark = rows.sparkSession
    ship(spark)
    sent, mass_of_all, k = spark.sparkContext.broadcast(weights), float(weights.sum()), len(weights)

    def run(batches):
        got, rest = np.zeros(k), np.zeros(3)
        for b in batches:
            n, lists, liks = b.column(0).to_numpy(zero_copy_only=False).astype(float), b.column(1), b.column(2)
            color, lik = lists.flatten().to_numpy(zero_copy_only=False), liks.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(len(n)), sizes)
            lik = np.full(len(color), value) if value is not None else lik
            w = sent.value[color]
            mass = np.bincount(owner, w * (lik - base), len(n)) + base * mass_of_all
            q = n / mass
            got += np.bincount(color, q[owner] * w * (lik - base), k)
            rest += q.sum(), (q[owner] * w * lik).sum(), (n * np.log(mass)).sum()
        at = np.flatnonzero(got)
        names = np.concatenate((at, [-1, -2, -3])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate((got[at], rest)))], names=["color", "v"])

    sums = {r["color"]: r["v"] for r in rows.mapInArrow(run, "color long, v double").groupBy("color").agg(F.sum("v").alias("v")).collect()}
    sent.destroy()
    own = np.zeros(k)
    for c, v in sums.items():
        if c >= 0:
            own[c] = v
    return _Sums(own, sums.get(-1, 0.0), sums.get(-2, 0.0), sums.get(-3, 0.0))


def em(table: DataFrame, n_components: int, base: float = 0.0, rounds: int = 100, tolerance: float = 1e-5, start: list[float] | None = None) -> list[float]:
    """Mixture weights of components 0 to n_components - 1 from (obs, n, color, likelihood).

    Pairs that the table lacks have likelihood `base`. It ends after `rounds`, or when the weights move by less
    than `tolerance` (L2).
    """
    return _fit(_listed(table), n_components, start, rounds, tolerance, lambda _: (base, None), None)[0]


def em_compatibility(obs: DataFrame, n_components: int, w: float = 99.0, update_w: bool = False, rounds: int = 100, tolerance: float = 1e-5, start: list[float] | None = None) -> tuple[list[float], float]:
    """Weights, and w, of the binary compatibility model; with update_w the odds w are refitted each round."""
    rows = _listed(compatibility(obs, w))
    return _fit(rows, n_components, start, rounds, tolerance, lambda x: (1 / (x + 1), x / (x + 1)), w, update_w)


def _fit(rows: DataFrame, k: int, start: list[float] | None, rounds: int, tolerance: float, model: Callable, w: float | None, update_w: bool = False) -> tuple[list[float], float | None]:
    weights = np.array(start, float) if start is not None else np.full(k, 1.0 / max(k, 1))
    total = rows.agg(F.sum("n")).first()[0] or 0
    for _ in range(rounds if total else 0):
        base, value = model(w)
        got = _pass(rows, weights, base, value)
        new = (got.weights + weights * base * got.shares) / total
        new_w = got.compatible / max(total - got.compatible, 1e-12) if update_w else w
        moved = math.sqrt(float(((new - weights) ** 2).sum()) + ((new_w - w) ** 2 if update_w else 0.0))
        weights, w = new, new_w
        if moved < tolerance:
            break
    return weights.tolist(), w


def log_likelihood(table: DataFrame, weights: list[float], base: float = 0.0) -> float:
    """Sum over observations of n * ln(sum of weight * likelihood) for (obs, n, color, likelihood)."""
    return _pass(_listed(table), np.array(weights, float), base).log


def ln_binomial(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _ln_beta(x: float, y: float) -> float:
    return math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)


def ln_beta_binomial(k: float, n: float, a: float, b: float) -> float:
    """Log probability of k successes in n under a beta-binomial law."""
    return ln_binomial(n, k) + _ln_beta(k + a, n - k + b) - _ln_beta(a, b)


def ln_relative(hits: Column, size: Column, a: Column, b: Column) -> Column:
    """Log of the beta-binomial weight of `hits` in `size` over that of `size` in `size`.

    Both are products of gamma functions whose arguments differ by whole numbers, so the ratio is a product
    of size - hits plain factors, each with a part of the binomial.
    """
    steps = F.when(size > hits, F.sequence(F.lit(0).cast("long"), (size - hits - 1).cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.log((hits + 1 + i) * (b + i) / ((i + 1) * (a + hits + i))))


def cluster_likelihood(hits: Column, size: Column, pi: float = 0.65, lo: float = 0.01, hi: float = 0.99) -> Column:
    """Likelihood of a read that is compatible with `hits` of the `size` colors of a cluster, given that it is from there.

    `lo` without a hit; else `hi`, times the beta-binomial weight of the hits relative to that of a full hit,
    with mean pi and the spread phi = 1 - pi + 0.01 / size.
    """
    phi = 1 - pi + F.lit(0.01) / size
    return F.when(hits == 0, F.lit(lo)).otherwise(hi * F.exp(ln_relative(hits, size, pi / phi, (1 - pi) / phi)))


def cluster_table(results: DataFrame, clusters: DataFrame) -> DataFrame:
    """(obs, n, color, hits, size, likelihood) for clusters(color, cluster): each observation with the clusters it hits.

    The column color holds the cluster, so that em() takes the table with base 0.01 for all other clusters.
    """
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    hit = observations(results).select("obs", "n", F.explode("colors").alias("color")).join(clusters, "color").groupBy("obs", "n", "cluster").agg(F.count(F.lit(1)).alias("hits"))
    rows = hit.join(sizes, "cluster")
    return rows.select("obs", "n", F.col("cluster").alias("color"), "hits", "size", cluster_likelihood(F.col("hits"), F.col("size")).alias("likelihood"))
