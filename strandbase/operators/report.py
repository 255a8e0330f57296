"""Aggregates over alignment results, and the read filter."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def color_counts(results: DataFrame, names: DataFrame) -> DataFrame:
    """(color_id, name, n, n_unique) of the colors with positive reads, by n descending, ties by color id.

    Repeated colors in a record count each time, as records give them.
    """
    hits = results.select(F.size("colors").alias("size"), F.explode("colors").alias("color_id"))
    counted = hits.groupBy("color_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("size") == 1).cast("long")).alias("n_unique"))
    joined = counted.join(names, "color_id", "left")
    if joined.where("name is null").take(1):
        raise ValueError("a result has a color that the index doesn't name")
    return joined.select("color_id", "name", "n", "n_unique").orderBy(F.desc("n"), "color_id")


def read_counts(results: DataFrame) -> DataFrame:
    """One row: n_reads and n_positive_reads."""
    return results.agg(F.count(F.lit(1)).alias("n_reads"), F.coalesce(F.sum((F.size("colors") > 0).cast("long")), F.lit(0).cast("long")).alias("n_positive_reads"))


def report(results: DataFrame, names: DataFrame) -> dict:
    """The report as a dictionary; what is collected is one row for each color."""
    reads = read_counts(results).first()
    rows = color_counts(results, names).collect()
    unique = sorted((r for r in rows if r["n_unique"]), key=lambda r: (-r["n_unique"], r["color_id"]))
    return {"n_reads": reads["n_reads"], "n_positive_reads": reads["n_positive_reads"], "positive_by_color": [[r["name"], r["n"]] for r in rows], "unique_positive_by_color": [[r["name"], r["n_unique"]] for r in unique]}


def report_json(found: dict) -> str:
    return json.dumps(found, indent=2, ensure_ascii=False)


def reads_without_record(reads: DataFrame, results: DataFrame) -> DataFrame:
    return reads.join(results, "name", "left_anti")


def records_without_read(reads: DataFrame, results: DataFrame) -> DataFrame:
    return results.join(reads, "name", "left_anti")


def kept_names(results: DataFrame, targets: DataFrame, order: str = "record") -> DataFrame:
    """(name) of the records with a target color (color_id); of records with the same name the last decides."""
    last = results.groupBy("name").agg(F.max_by("colors", order).alias("colors"))
    return last.select("name", F.explode("colors").alias("color_id")).join(targets.select("color_id").distinct(), "color_id", "left_semi").select("name").distinct()


def filter_reads(reads: DataFrame, results: DataFrame, targets: DataFrame, order: str = "record", check: bool = True) -> DataFrame:
    """The reads whose record has a target color, in the order of their ordinals.

    Reads without a record and records without a read are errors, found before anything is returned.
    """
    if check:
        if reads_without_record(reads, results).take(1):
            raise ValueError("a read has no alignment record")
        if records_without_read(reads, results).take(1):
            raise ValueError("an alignment record has no read")
    return reads.join(kept_names(results, targets, order), "name", "left_semi")
