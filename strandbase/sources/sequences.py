"""FASTA and FASTQ scans (plain or gzip), list files, and the text forms of indexes and results."""

from __future__ import annotations

import re
import sys

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dna import name_token
from ..plans.store import maybe_broadcast, scratch_path, stored

#: File name endings (before .gz) that tell the format; other files are told by their first character.
FASTA, FASTQ = (".fa", ".fna", ".fasta", ".ffn", ".faa", ".frn"), (".fq", ".fastq")


def _plain(path: str) -> str:
    return re.sub("^file:/+", "file:/", path)


def qualified(spark: SparkSession, paths: list[str]) -> list[str]:
    """Paths as `source` names the files."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        out.append(_plain(at.getFileSystem(conf).makeQualified(at).toUri().toString()).rstrip("/"))
    return out


def files(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files of the paths, folders opened, as `source` names them."""
    return sorted({*map(_plain, spark.read.text(paths).inputFiles())})


def _is_fastq(spark: SparkSession, path: str) -> bool:
    name = path.lower().rstrip("/").removesuffix(".gz")
    if name.endswith(FASTA) or name.endswith(FASTQ):
        return name.endswith(FASTQ)
    first = spark.read.text(path).where("value != ''").first()
    return first is not None and first["value"].startswith("@")


def _numbered(spark: SparkSession, paths: list[str], separator: str, no_lead: Column | None = None) -> DataFrame:
    """(source, row, lead, value): pieces of text files between separators; row counts a file's pieces from 0.

    Files are read in splits, each by a task of its own. A split's pieces are counted first; prefix sums over
    the splits of a file, one row each, give its first number. Where `no_lead` holds for a file's first piece,
    that piece is no row and lead is 1.
    """
    meta = [F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")]
    rows = spark.read.option("lineSep", separator).text(paths).select(*meta, "value")
    flag = F.lit(0) if no_lead is None else no_lead.cast("int")
    splits = rows.groupBy("source", "block").agg(F.min(2 * F.col("id") + flag).alias("code"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    lead = F.coalesce(F.max(F.when(F.col("block") == 0, F.col("code") % 2)).over(Window.partitionBy("source")), F.lit(0))
    starts = splits.select("source", "block", F.floor(F.col("code") / 2).alias("first"), F.coalesce(before, F.lit(0)).alias("before"), lead.alias("lead"))
    row = F.col("id") - F.col("first") + F.col("before") - F.col("lead")
    return rows.join(maybe_broadcast(starts), ["source", "block"]).select("source", row.alias("row"), "lead", "value").where("row >= 0")


def _fasta(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records begin where a line begins with '>'; the rest of a record's lines are its sequence."""
    rows = _numbered(spark, paths, "\n>", F.col("value").rlike(r"\A\s*\z"))
    first = (F.col("row") == 0) & (F.col("lead") == 0)  # this piece still has its '>'
    late = F.raise_error(F.concat(F.lit("sequence data before the first header of "), F.col("source")))
    text = F.when(~first, F.col("value")).when(F.col("value").startswith(">"), F.expr("substr(value, 2)")).otherwise(late)
    rows = rows.select("source", "row", text.alias("value")).withColumn("end", F.locate("\n", F.col("value")))
    header = F.when(F.col("end") > 0, F.expr("substr(value, 1, end - 1)")).otherwise(F.col("value"))
    seq = F.when(F.col("end") > 0, F.regexp_replace(F.expr("substr(value, end + 1)"), r"\s+", "")).otherwise(F.lit(""))
    return rows.select("source", F.col("row").alias("ordinal"), F.regexp_replace(header, r"\r$", "").alias("header"), seq.alias("seq"), F.lit(None).cast("string").alias("qual"))


def _fastq(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Four lines to a record, brought together by file and record."""
    rows = _numbered(spark, paths, "\n").select("source", "row", F.regexp_replace("value", r"\r$", "").alias("value"))
    record, part = F.floor(F.col("row") / 4).alias("ordinal"), F.col("row") % 4
    line = lambda i: F.max(F.when(F.col("part") == i, F.col("value")))
    four = rows.select("source", record, part.alias("part"), "value").groupBy("source", "ordinal").agg(*(line(i).alias(f"l{i}") for i in range(4)))
    full = four.where(F.concat_ws("", "l0", "l1", "l2", "l3") != "")  # blank lines may stand at the end
    bad = F.coalesce(~F.col("l0").startswith("@") | ~F.col("l2").startswith("+"), F.lit(True)) | F.col("l3").isNull()
    header = F.when(bad, F.raise_error(F.concat(F.lit("bad FASTQ record "), F.col("ordinal").cast("string"), F.lit(" of "), F.col("source")))).otherwise(F.expr("substr(l0, 2)"))
    return full.select("source", "ordinal", header.alias("header"), F.col("l1").alias("seq"), F.col("l3").alias("qual"))


def read_sequences(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source, ordinal, header, name, seq, qual) of every record; ordinal counts the records of a file from 0.

    All files of a format are one scan. Plain files are read in splits, so a file may be larger than a task's
    memory; a gzip file is streamed by one task. A record must fit one value (2 GB). A malformed file is an
    error when the rows are read.
    """
    given = list(dict.fromkeys([paths] if isinstance(paths, str) else paths))
    kinds: dict[bool, list[str]] = {}
    for p in given:
        kinds.setdefault(_is_fastq(spark, p), []).append(p)
    parts = [(_fastq if fastq else _fasta)(spark, own) for fastq, own in kinds.items()]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.select("source", "ordinal", "header", name_token(F.col("header")).alias("name"), "seq", "qual")


def read_in_order(spark: SparkSession, path: str) -> DataFrame:
    """read_sequences() of one path; in a folder of part files, ordinal goes on from file to file by their names."""
    rows = read_sequences(spark, path)
    if len(files(spark, [path])) < 2:
        return rows
    sizes = rows.groupBy("source").agg((F.max("ordinal") + 1).alias("n"))
    before = F.sum("n").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1))  # one row for each file
    starts = stored(sizes.select("source", F.coalesce(before, F.lit(0)).alias("before")), "files")
    return rows.join(maybe_broadcast(starts), "source").withColumn("ordinal", F.col("ordinal") + F.col("before")).select(*rows.columns)


def from_stdin(spark: SparkSession, stream=None, chunk: int = 1 << 20) -> str:
    """Copy standard input, piece by piece, to a file in the shared folder; its path."""
    stream = stream or sys.stdin.buffer
    head = stream.read(chunk)
    ending = (".fq" if head.lstrip().startswith(b"@") else ".fa") if head[:2] != b"\x1f\x8b" else ".gz"
    path = scratch_path(spark, "stdin", ending)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(conf).create(at)
    try:
        while head:
            out.write(bytearray(head))
            head = stream.read(chunk)
    finally:
        out.close()
    return path


def read_list(spark: SparkSession, path: str) -> list[str]:
    """Paths of a list file, in order, blank lines left out."""
    return [r["value"] for r in spark.read.text(path).coalesce(1).collect() if r["value"].strip()]


def file_colors(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(color, seq) with one color for each path, and color_names; all files are one scan.

    A folder's files have the folder's color. A path given twice has a color for each time.
    """
    names = spark.createDataFrame(list(enumerate(paths)), "color_id long, name string")
    if not paths:
        return spark.createDataFrame([], "color long, seq string"), names
    given: dict[str, list[int]] = {}
    for color, p in enumerate(qualified(spark, paths)):
        given.setdefault(p, []).append(color)
    pairs = []
    for f in files(spark, paths):
        at, own = f, list(given.get(f, []))
        while "/" in at:
            at = at.rpartition("/")[0]
            own += given.get(at, [])
        if not own:
            raise ValueError(f"no given path holds {f}")
        pairs += [(c, f) for c in own]
    colors = maybe_broadcast(spark.createDataFrame(pairs, "color long, source string"))
    return read_sequences(spark, paths).join(colors, "source").select("color", "seq"), names


def sequence_colors(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(color, seq) with one color for each record of a file, or of a folder's files, and color_names (the header's first word)."""
    rows = read_in_order(spark, path)
    return rows.select(F.col("ordinal").alias("color"), "seq"), rows.select(F.col("ordinal").alias("color_id"), "name")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(record, name, colors, kmer_hits, bases_covered) of a JSON-lines result; a bad line is an error.

    record orders the lines by file, in a folder of part files by their names, and by their place there.
    """
    schema = "name string, colors array<long>, kmer_hits array<long>, bases_covered array<long>"
    lines = _numbered(spark, [path], "\n").where(F.trim("value") != "")
    parsed = lines.select(F.struct("source", "row").alias("record"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("record", "r.*")


def read_color_ids(spark: SparkSession, path: str) -> DataFrame:
    """(color_id) of a file with one integer for each line; blank lines are skipped, others must be integers."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("value"), F.expr("try_cast(trim(value) as bigint)").alias("color_id"))
    bad = rows.where("color_id is null").take(1)
    if bad:
        raise ValueError(f"not a color id: {bad[0]['value']!r}")
    return rows.select("color_id")


def read_color_sets(spark: SparkSession, path: str) -> DataFrame:
    """(set_id, size, colors) of a color-set dump; ids must be 0, 1, ... and sizes must hold."""
    pattern = r"^color_set_id=(\d+) size=(\d+) ?([\d ]*)$"
    rows = spark.read.text(path).where("value != ''").select(
        F.regexp_extract("value", pattern, 1).alias("i"), F.regexp_extract("value", pattern, 2).alias("n"), F.regexp_extract("value", pattern, 3).alias("c")
    )
    sets = rows.select(F.expr("try_cast(i as bigint)").alias("set_id"), F.expr("try_cast(n as int)").alias("size"), F.transform(F.filter(F.split("c", " "), lambda x: x != ""), lambda x: x.cast("long")).alias("colors"))
    n, low, high, distinct, bad = sets.agg(F.count(F.lit(1)), F.min("set_id"), F.max("set_id"), F.count_distinct("set_id"), F.count_if(F.col("set_id").isNull() | (F.size("colors") != F.col("size")))).first()
    if bad or n and (low != 0 or high != n - 1 or distinct != n):
        raise ValueError("color-set lines are malformed or not numbered 0, 1, ...")
    return sets


def read_unitigs(spark: SparkSession, path: str) -> DataFrame:
    """(unitig_id, set_id, seq) of colored unitigs."""
    rows = read_sequences(spark, path)
    take = lambda key: F.regexp_extract("header", rf"\b{key}=(\d+)", 1).cast("long")
    return rows.select(take("unitig_id").alias("unitig_id"), take("color_set_id").alias("set_id"), "seq")


def read_metadata(spark: SparkSession, path: str) -> dict[str, int]:
    """The key=value lines of a dump; num_unitigs may be missing, unknown keys are errors."""
    out: dict[str, int] = {}
    for r in spark.read.text(path).collect():
        m = re.fullmatch(r"(num_colors|num_unitigs|num_color_sets|k)=(\d+)", r["value"].strip())
        if m:
            out[m[1]] = int(m[2])
        elif r["value"].strip():
            raise ValueError(f"unknown metadata line {r['value']!r}")
    missing = {"num_colors", "num_color_sets", "k"} - out.keys()
    if missing:
        raise ValueError(f"metadata lacks {sorted(missing)}")
    return out
