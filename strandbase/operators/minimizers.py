"""Minimizer studies: how often a k-mer's minimizer class has the k-mer's own color set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.index import Index
from ..plans.store import stored
from .unitigs import oriented


def _texts(index: Index) -> DataFrame:
    return oriented(index).select(index.kmer.decode(F.col("x")).alias("s"), "set_id")


def _parts(m: int, k: int):
    return F.transform(F.sequence(F.lit(1), F.lit(k - m + 1)), lambda i: F.substring(F.col("s"), i, F.lit(m)))


def with_key(index: Index, key: Callable[[Column], Column]) -> DataFrame:
    """(s, set_id, key): each k-mer of both strands and what a rule of one's own picks from its text."""
    return _texts(index).withColumn("key", key(F.col("s")))


def with_minimizer(index: Index, m: int) -> DataFrame:
    """(s, set_id, key): each k-mer of both strands and its least m-mer, leftmost among equals."""
    if not 1 <= m <= index.k:
        raise ValueError("m must lie between 1 and k")
    return with_key(index, lambda s: F.array_min(_parts(m, index.k)))


def graph_nodes(rows: DataFrame, k: int) -> DataFrame:
    """(s) of the k-mers' texts and, for k-mers that nothing precedes, of all their shorter prefixes, once each."""
    begins = rows.select(F.substring("s", 2, k - 1).alias("w")).distinct()
    firsts = rows.withColumn("w", F.substring("s", 1, k - 1)).join(begins, "w", "left_anti")
    pads = firsts.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda i: F.substring(F.col("s"), F.lit(1), i))).alias("s")) if k > 1 else firsts.select("s").limit(0)
    return rows.select("s").unionAll(pads.distinct())


def with_finimizer(index: Index) -> DataFrame:
    """(s, set_id, key): each k-mer and its shortest substring that ends only one node of the graph.

    Nodes are the k-mers of both strands and the padded prefixes of those that nothing precedes. Ties go to
    the least in colexicographic order, that is by the reversed text. For each place in a k-mer at most one
    candidate is looked up: the k-mer's prefix that ends there leads to the one node that it can end, and that
    node knows its shortest suffix that no other node has.
    """
    rows, k = _texts(index), index.k
    nodes = graph_nodes(rows, k)
    ends = nodes.select("s", F.explode(F.transform(F.sequence(F.lit(1), F.length("s")), lambda i: F.right(F.col("s"), i))).alias("part"))
    single = stored(ends.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("node")).where("n = 1").drop("n"), "suffixes")
    shortest = single.groupBy("node").agg(F.min(F.length("part")).alias("least"))
    known = single.join(shortest, "node").select("part", "least")
    prefixes = rows.select("s", "set_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.substring(F.col("s"), F.lit(1), i))).alias("part"))
    cand = prefixes.join(known, "part").select("s", "set_id", "least", F.reverse(F.right("part", F.col("least"))).alias("back"))
    best = cand.groupBy("s", "set_id").agg(F.min(F.struct("least", "back")).alias("best"))
    return best.select("s", "set_id", F.reverse("best.back").alias("key"))


def class_stats(index: Index, keyed: DataFrame) -> DataFrame:
    """One row for each length 0 to k of the keys: classes, k-mers, k-mers whose set is the class's union, means.

    A k-mer's set is part of its class's union, so their Jaccard similarity is the ratio of their sizes.
    """
    sets = index.color_sets.select("set_id", "size", "colors")
    own = keyed.groupBy("key", "set_id").agg(F.count(F.lit(1)).alias("n"))
    union = own.join(sets, "set_id").select("key", F.explode("colors").alias("c")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("union_size"))
    rows = own.join(sets.select("set_id", "size"), "set_id").join(union, "key", "left").withColumn("union_size", F.coalesce("union_size", F.lit(0)))
    ratio = F.when(F.col("union_size") == 0, F.lit(1.0)).otherwise(F.col("size") / F.col("union_size"))
    by_class = rows.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("size") == F.col("union_size"), F.col("n")).otherwise(0)).alias("ok"), F.sum(ratio * F.col("n")).alias("j"))
    by_len = by_class.groupBy(F.length("key").cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n_classes"), F.sum("n").alias("n_kmers"), F.sum("ok").alias("n_correct"), F.sum("j").alias("j"))
    every = index.kmers.sparkSession.range(index.k + 1).select(F.col("id").alias("length"))
    zero, nan = F.lit(0).cast("long"), F.lit(float("nan"))
    out = every.join(F.broadcast(by_len), "length", "left")
    none = F.col("n_classes").isNull()
    return out.select(
        "length", *(F.coalesce(c, zero).alias(c) for c in ("n_classes", "n_kmers", "n_correct")),
        F.when(none, nan).otherwise(F.col("n_correct") / F.col("n_kmers")).alias("correct_share"),
        F.when(none, nan).otherwise(F.col("n_kmers") / F.col("n_classes")).alias("mean_class_size"),
        F.when(none, nan).otherwise(F.col("j") / F.col("n_kmers")).alias("mean_jaccard"),
    )


def minimizer_stats(index: Index, m: int) -> DataFrame:
    return class_stats(index, with_minimizer(index, m))


def finimizer_stats(index: Index) -> DataFrame:
    return class_stats(index, with_finimizer(index))
