"""Pseudoalignment: color sets of a read's k-mers, combined by threshold voting or by intersection.

Reads are rows (qid, ..., seq). Every read yields a row, with an empty list if nothing is compatible.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.index import Index
from ..plans.store import maybe_broadcast, stored

DENOMINATORS = ("all", "relevant", "max-hits")
#: Windows of a read that one task orders; longer reads are cut into such blocks.
BLOCK = 1 << 20


def looked_up(index: Index, reads: DataFrame, spread: int | None = None) -> DataFrame:
    """(qid, pos, set_id) of every window, stored since several plans read it."""
    return stored(index.lookup(reads, ["qid"], "seq", spread), "lookup")


def color_counts(index: Index, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(qid, color, cnt), and (qid, n_all, n_relevant) for reads with windows.

    Windows are counted for each set before sets are opened, so a long run costs one row.
    """
    per_set = stored(found.groupBy("qid", "set_id").agg(F.count(F.lit(1)).alias("n")), "per_set")
    totals = per_set.groupBy("qid").agg(F.sum("n").alias("n_all"), F.sum(F.when(F.col("set_id").isNotNull(), F.col("n")).otherwise(0)).alias("n_relevant"))
    counts = per_set.join(maybe_broadcast(index.color_sets), "set_id").select("qid", "n", F.explode("colors").alias("color")).groupBy("qid", "color").agg(F.sum("n").alias("cnt"))
    return counts, totals


def run_counts(found: DataFrame) -> DataFrame:
    """(qid, n_runs): maximal stretches of equal set ids, those of absent k-mers left out.

    Runs are counted in blocks of windows; one that goes on from block to block is counted once.
    """
    block = F.floor(F.col("pos") / BLOCK)
    w = Window.partitionBy("qid", "block").orderBy("pos")
    starts = F.col("set_id").isNotNull() & (F.row_number().over(w).eqNullSafe(1) | ~F.col("set_id").eqNullSafe(F.lag("set_id").over(w)))
    marked = found.withColumn("block", block).select("qid", "block", "pos", "set_id", starts.cast("long").alias("starts"))
    ends = [F.min_by("set_id", "pos").alias("first"), F.max_by("set_id", "pos").alias("last")]
    blocks = marked.groupBy("qid", "block").agg(F.sum("starts").alias("n"), *ends)
    before = F.lag("last").over(Window.partitionBy("qid").orderBy("block"))  # one row for each block
    joined = blocks.select("qid", "n", F.coalesce(F.col("first") == before, F.lit(False)).cast("long").alias("same"))
    return joined.groupBy("qid").agg((F.sum("n") - F.sum("same")).alias("n_runs"))


def threshold_pairs(index: Index, found: DataFrame, threshold: float, denominator: str = "all", min_hits: int = 1) -> DataFrame:
    """(qid, color, cnt) of the compatible colors."""
    if denominator not in DENOMINATORS:
        raise ValueError(f"denominator must be one of {DENOMINATORS}")
    counts, totals = color_counts(index, found)
    rows = counts.join(totals, "qid")
    if denominator == "max-hits":
        rows = rows.withColumn("den", F.max("cnt").over(Window.partitionBy("qid")))
    else:
        rows = rows.withColumn("den", F.col("n_all" if denominator == "all" else "n_relevant"))
    return rows.where((F.col("n_relevant") >= min_hits) & (F.col("cnt") / F.col("den") >= F.lit(float(threshold)))).select("qid", "color", "cnt")


def intersection_pairs(index: Index, found: DataFrame, min_hits: int = 1) -> DataFrame:
    """(qid, color, cnt) of the colors in every relevant window; min_hits counts runs."""
    counts, totals = color_counts(index, found)
    rows = counts.join(totals, "qid").where(F.col("cnt") == F.col("n_relevant"))
    if min_hits > 1:
        rows = rows.join(run_counts(found).where(F.col("n_runs") >= min_hits), "qid", "left_semi")
    return rows.select("qid", "color", "cnt")


def bases_covered(index: Index, found: DataFrame, pairs: DataFrame) -> DataFrame:
    """(qid, color, bases_covered) for the given pairs: the union of the windows whose set has the color.

    Stretches of windows with one set become intervals before sets are opened; of these only the wanted
    colors' are laid over each other.
    """
    near = found.where("set_id is not null").withColumn("block", F.floor(F.col("pos") / BLOCK))
    nth = F.row_number().over(Window.partitionBy("qid", "set_id", "block").orderBy("pos"))
    runs = near.select("qid", "set_id", "block", "pos", (F.col("pos") - nth).alias("run")).groupBy("qid", "set_id", "block", "run")
    spans = runs.agg(F.min("pos").alias("lo"), (F.max("pos") + index.k).alias("hi"))
    opened = spans.join(maybe_broadcast(index.color_sets.select("set_id", "colors")), "set_id").select("qid", "lo", "hi", F.explode("colors").alias("color"))
    own = opened.join(pairs.select("qid", "color"), ["qid", "color"], "left_semi")
    w = Window.partitionBy("qid", "color").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", F.coalesce(F.max("hi").over(w), F.col("lo"))))
    return own.select("qid", "color", fresh.alias("s")).groupBy("qid", "color").agg(F.sum("s").alias("bases_covered"))


def _kmer_hits(index: Index, found: DataFrame, pairs: DataFrame) -> DataFrame:
    return pairs.select("qid", "color", F.col("cnt").alias("kmer_hits"))


#: A metric's name and how it is found: from (index, found, pairs) to (qid, color, <name>) for every pair.
Metric = Callable[[Index, DataFrame, DataFrame], DataFrame]
METRICS: dict[str, Metric] = {"kmer_hits": _kmer_hits, "bases_covered": bases_covered}


def register_metric(name: str, metric: Metric) -> None:
    """Make a metric of one's own known to the aligners and the result lines; its values are longs."""
    if name in METRICS:
        raise ValueError(f"there is a metric {name!r} already")
    METRICS[name] = metric


def collected(reads: DataFrame, pairs: DataFrame, metrics: tuple[str, ...] = ()) -> DataFrame:
    """All columns of reads but seq, and colors (ascending) with the metrics' lists beside them."""
    item = F.struct("color", *metrics)
    lists = pairs.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("items"))
    empty = F.array().cast("array<long>")
    rows = reads.drop("seq", "qual").join(lists, "qid", "left")
    return rows.withColumns({"colors": F.coalesce(F.col("items.color"), empty)} | {m: F.coalesce(F.col(f"items.{m}"), empty) for m in metrics}).drop("items")


def _with_metrics(index: Index, found: DataFrame, pairs: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    if unknown := [m for m in metrics if m not in METRICS]:
        raise ValueError(f"no metric {unknown}; there are {sorted(METRICS)}")
    if any(m != "kmer_hits" for m in metrics):
        pairs = stored(pairs, "pairs")
    out = pairs
    for m in metrics:
        out = out.withColumn(m, F.col("cnt")) if m == "kmer_hits" else out.join(METRICS[m](index, found, pairs).select("qid", "color", m), ["qid", "color"])
    return out


#: A rule of one's own: from (index, found) to (qid, color, cnt) of the compatible colors; found holds (qid, pos, set_id).
Rule = Callable[[Index, DataFrame], DataFrame]


def align(index: Index, reads: DataFrame, rule: Rule, metrics: tuple[str, ...] = (), spread: int | None = None) -> DataFrame:
    """Reads with the colors that the rule finds compatible, and the metrics' lists beside them."""
    found = looked_up(index, reads, spread)
    return collected(reads, _with_metrics(index, found, rule(index, found), metrics), metrics)


def threshold_align(index: Index, reads: DataFrame, threshold: float, denominator: str = "all", min_hits: int = 1, metrics: tuple[str, ...] = (), spread: int | None = None) -> DataFrame:
    """Reads with the colors whose share of the k-mers reaches the threshold; min_hits counts k-mers."""
    return align(index, reads, lambda x, found: threshold_pairs(x, found, threshold, denominator, min_hits), metrics, spread)


def intersection_align(index: Index, reads: DataFrame, min_hits: int = 1, metrics: tuple[str, ...] = (), spread: int | None = None) -> DataFrame:
    """Reads with the colors common to all their k-mers in the index; min_hits counts runs.

    With min_hits 0, a read without such k-mers has all colors, also if it is shorter than k.
    """
    if metrics and min_hits < 1:
        raise ValueError("metrics need min_hits of 1 or more: a read without k-mers in the index has none")
    found = looked_up(index, reads, spread)
    rows = collected(reads, _with_metrics(index, found, intersection_pairs(index, found, min_hits), metrics), metrics)
    if min_hits < 1:
        hit = found.where("set_id is not null").select("qid").distinct().withColumn("__hit", F.lit(True))
        every = F.sequence(F.lit(0).cast("long"), F.lit(index.n_colors - 1).cast("long")) if index.n_colors else F.array().cast("array<long>")
        rows = rows.join(hit, "qid", "left").withColumn("colors", F.when(F.col("__hit"), F.col("colors")).otherwise(every)).drop("__hit")
    return rows


def kmer_lines(index: Index, reads: DataFrame, print_kmers: bool = False) -> DataFrame:
    """(qid, pos, line): the colors of each window, joined by spaces, behind its text if asked for."""
    sets = index.color_sets.select("set_id", F.array_join(F.transform("colors", lambda c: c.cast("string")), " ").alias("own"))
    rows = index.lookup(reads, ["qid"]).join(sets, "set_id", "left").withColumn("own", F.coalesce("own", F.lit("")))
    if not print_kmers:
        return rows.select("qid", "pos", F.col("own").alias("line"))
    text: Column = F.substring(F.col("seq"), F.col("pos").cast("int") + 1, F.lit(index.k))
    return rows.join(reads.select("qid", "seq"), "qid").select("qid", "pos", F.concat_ws(" ", text, F.col("own")).alias("line"))
