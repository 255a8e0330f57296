"""Text forms of results and indexes, as columns `line`, and ordered writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import int_list, json_name


def jsonl(results: DataFrame, metrics: tuple[str, ...] = ()) -> Column:
    """{"name": "N", "colors": [0,1]} with the metrics' lists behind it."""
    parts = [F.lit('{"name": "'), json_name(F.col("name")), F.lit('", "colors": '), int_list(F.col("colors"))]
    for m in metrics:
        parts += [F.lit(f', "{m}": '), int_list(F.col(m))]
    return F.concat(*parts, F.lit("}"))


def legacy(results: DataFrame, metrics: tuple[str, ...] = (), ordinal: str = "qid") -> Column:
    """<query ordinal> c1 c2 ..."""
    if metrics:
        raise ValueError("the legacy format has no metrics")
    return F.concat_ws(" ", F.col(ordinal).cast("string"), *[F.transform("colors", lambda c: c.cast("string"))])


def names_line() -> Column:
    return F.concat_ws("\t", F.col("color_id").cast("string"), F.col("name"))


def unitig_lines(unitigs: DataFrame) -> Column:
    return F.concat(F.lit("> unitig_id="), F.col("unitig_id").cast("string"), F.lit(" color_set_id="), F.col("set_id").cast("string"), F.lit("\n"), F.col("seq"))


def gfa_lines(unitigs: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """(part, key, line) of a GFA 1.0 file: header, segments, links."""
    u = lambda c: F.concat(F.lit("u"), F.col(c).cast("string"))
    head = unitigs.sparkSession.createDataFrame([(0, 0, "H\tVN:Z:1.0")], "part int, key long, line string")
    segments = unitigs.select(F.lit(1).alias("part"), F.col("unitig_id").alias("key"), F.concat_ws("\t", F.lit("S"), u("unitig_id"), F.col("seq"), F.concat(F.lit("cs:i:"), F.col("set_id").cast("string"))).alias("line"))
    edges = links.select(F.lit(2).alias("part"), F.col("from_id").alias("key"), F.concat_ws("\t", F.lit("L"), u("from_id"), F.col("from_sign"), u("to_id"), F.col("to_sign"), F.lit(f"{k - 1}M")).alias("line"))
    return head.unionAll(segments).unionAll(edges)


def color_set_lines() -> Column:
    head = F.concat(F.lit("color_set_id="), F.col("set_id").cast("string"), F.lit(" size="), F.col("size").cast("string"))
    return F.concat_ws(" ", head, F.transform("colors", lambda c: c.cast("string")))


def metadata(n_colors: int, n_sets: int, k: int, n_unitigs: int | None) -> str:
    lines = [f"num_colors={n_colors}", *([f"num_unitigs={n_unitigs}"] if n_unitigs is not None else []), f"num_color_sets={n_sets}", f"k={k}"]
    return "\n".join(lines) + "\n"


def fastx_lines() -> Column:
    """A read's record, FASTQ if it has a quality and FASTA if not."""
    fastq = F.concat(F.lit("@"), F.col("header"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual"))
    return F.when(F.col("qual").isNotNull(), fastq).otherwise(F.concat(F.lit(">"), F.col("header"), F.lit("\n"), F.col("seq")))


def write_lines(df: DataFrame, line: Column, path: str, order: list[str] | None = None, compression: str | None = None) -> None:
    """Write one line for each row; in the given order over the numbered part files."""
    rows = df.orderBy(*order) if order else df
    rows.select(line.alias("value")).write.mode("errorifexists").option("compression", compression or "none").text(path)
