"""Command line: one subcommand for each operation on indexes, reads and results.

Results are folders of part files, as Spark writes them; an existing output is an error. Without a query file
reads come from standard input, without an output lines go to standard output.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dna
from .operators import align, minimizers, report, unitigs
from .plans import index as ix
from .plans.store import stored
from .sources import sequences, sinks


def _reads(spark: SparkSession, path: str | None) -> DataFrame:
    """The records of a file, or of standard input without one (or with -)."""
    rows = sequences.read_in_order(spark, sequences.from_stdin(spark) if path in (None, "-") else path)
    return rows.withColumn("qid", F.col("ordinal"))


def _pairs_of_files(spark: SparkSession, a: argparse.Namespace) -> list[tuple[str | None, str | None]]:
    """Inputs and outputs; None is standard input or output."""
    pairs: list[tuple[str | None, str | None]] = [(a.query, a.output)] if a.query else []
    if a.query_list:
        queries = sequences.read_list(spark, a.query_list)
        outputs: list[str | None] = [*sequences.read_list(spark, a.query_output_list)] if a.query_output_list else [None] * len(queries)
        if not queries or len(queries) != len(outputs):
            raise ValueError("the query list is empty, or the lists differ in length")
        pairs += zip(queries, outputs, strict=True)
    return pairs or [(None, a.output)]


def _write(rows: DataFrame, line, output: str | None, order: list[str] | None) -> None:
    """A folder of part files, or lines to standard output, fetched partition by partition."""
    if output:
        sinks.write_lines(rows, line, output, order)
        return
    for r in (rows.orderBy(*order) if order else rows).select(line.alias("line")).toLocalIterator():
        print(r["line"])


def _align(spark: SparkSession, a: argparse.Namespace) -> None:
    metrics = ("kmer_hits",) * a.report_hit_counts + ("bases_covered",) * a.report_bases_covered
    if a.legacy_output_format and metrics:
        raise ValueError("the legacy format has no metrics")
    index = ix.load(spark, a.index)
    for query, output in _pairs_of_files(spark, a):
        reads = _reads(spark, query)
        if a.command == "threshold-pseudoalign":
            rows = align.threshold_align(index, reads, a.threshold, a.denominator, a.min_hits, metrics)
        else:
            rows = align.intersection_align(index, reads, a.min_hits, metrics)
        line = sinks.legacy(rows) if a.legacy_output_format else sinks.jsonl(rows, metrics)
        _write(rows, line, output, ["qid"] if a.sort_output else None)


def _build(spark: SparkSession, a: argparse.Namespace) -> None:
    if bool(a.file_colors) == bool(a.seq_colors):
        raise ValueError("give either --file-colors or --seq-colors")
    if a.from_unitigs and a.k % 2 == 0:
        raise ValueError("unitigs need an odd k")  # an even k has k-mers that are their own reverse complement
    seqs, names = sequences.file_colors(spark, sequences.read_list(spark, a.file_colors)) if a.file_colors else sequences.sequence_colors(spark, a.seq_colors)
    dictionary = _dictionary(spark, a.dictionary, a.k) if a.dictionary else None
    ix.build(seqs, a.k, names, dictionary=dictionary).save(a.output)


def _dictionary(spark: SparkSession, path: str, k: int) -> DataFrame:
    """(km) of a Parquet table of k-mer texts (kmer)."""
    kmer = dna.Kmer(k)
    return spark.read.parquet(path).select(kmer.canonical(kmer.encode(F.upper("kmer"))).alias("km")).distinct()


def _export(spark: SparkSession, a: argparse.Namespace) -> None:
    index, n = ix.load(spark, a.index), None
    if not a.no_color_sets:
        if a.colors_to_stdout:
            for r in index.color_sets.orderBy("set_id").select(sinks.color_set_lines().alias("line")).toLocalIterator():
                print(r["line"])
        else:
            sinks.write_lines(index.color_sets, sinks.color_set_lines(), f"{a.output}.color_sets.txt", ["set_id"])
    if not a.no_unitigs:
        pieces = stored(unitigs.colored_unitigs(index), "unitigs")
        n = pieces.count()
        if a.gfa:
            lines = sinks.gfa_lines(pieces, unitigs.gfa_links(pieces, index.k), index.k)
            sinks.write_lines(lines, F.col("line"), f"{a.output}.unitigs.gfa", ["part", "key"])
        else:
            sinks.write_lines(pieces, sinks.unitig_lines(pieces), f"{a.output}.unitigs.fa", ["unitig_id"])
    text = sinks.metadata(index.n_colors, index.color_sets.count(), index.k, n)
    sinks.write_lines(spark.createDataFrame([(text.rstrip("\n"),)], "t string").coalesce(1), F.col("t"), f"{a.output}.metadata.txt")


def _import(spark: SparkSession, a: argparse.Namespace) -> None:
    prefix = a.color_dump_prefix
    meta = sequences.read_metadata(spark, f"{prefix}.metadata.txt")
    sets = sequences.read_color_sets(spark, f"{prefix}.color_sets.txt")
    names = spark.range(meta["num_colors"]).select(F.col("id").alias("color_id"), F.col("id").cast("string").alias("name"))
    unitigs.import_unitigs(sequences.read_unitigs(spark, f"{prefix}.unitigs.fa"), sets, meta["k"], names).save(a.output)


def _report(spark: SparkSession, a: argparse.Namespace) -> None:
    text = report.report_json(report.report(sequences.read_results(spark, a.pseudoalignment), ix.load_color_names(spark, a.index)))
    if a.output:
        sinks.write_lines(spark.createDataFrame([(text,)], "t string").coalesce(1), F.col("t"), a.output)
    else:
        print(text)


def _filter(spark: SparkSession, a: argparse.Namespace) -> None:
    reads = _reads(spark, a.reads)
    kept = report.filter_reads(reads, sequences.read_results(spark, a.pseudoalignment), sequences.read_color_ids(spark, a.color_ids))
    sinks.write_lines(kept, sinks.fastx_lines(), a.output, ["ordinal"], "gzip" if a.output.endswith(".gz") else None)


def _show(rows: DataFrame, order: str) -> None:
    print("\t".join(rows.columns))
    for r in rows.orderBy(order).toLocalIterator():
        print("\t".join(map(str, r)))


def _run(spark: SparkSession, a: argparse.Namespace) -> None:
    c = a.command
    if c == "build":
        _build(spark, a)
    elif c.endswith("pseudoalign"):
        _align(spark, a)
    elif c == "print-color-sets":
        _write(align.kmer_lines(ix.load(spark, a.index), _reads(spark, a.query), a.print_kmers), F.col("line"), a.output, ["qid", "pos"])
    elif c == "dump-color-names":
        _write(ix.load_color_names(spark, a.index), sinks.names_line(), a.output, ["color_id"])
    elif c == "merge":
        ix.merge([ix.load(spark, p) for p in sequences.read_list(spark, a.index_file_list)]).save(a.output)
    elif c == "import":
        _import(spark, a)
    elif c == "import-kmers":
        ix.single_color(_dictionary(spark, a.dictionary, a.k), a.k, a.color_name).save(a.output)
    elif c == "export":
        _export(spark, a)
    elif c == "stats":
        for r in unitigs.stats(ix.load(spark, a.index)).collect():
            print(f"{r['key']}\t{r['value']}")
    elif c == "report":
        _report(spark, a)
    elif c == "filter-reads":
        _filter(spark, a)
    elif c == "minimizer-stats":
        _show(minimizers.minimizer_stats(ix.load(spark, a.index), a.minimizer_length), "length")
    else:
        _show(minimizers.finimizer_stats(ix.load(spark, a.index)), "length")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandbase", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple) -> None:
        p = sub.add_parser(name)
        for names, extra in options:
            p.add_argument(*names, **extra)

    need = {"required": True}
    index, output = (("-i", "--index"), need), (("-o", "--output"), need)
    results = (("-p", "--pseudoalignment"), need)
    flag = lambda n: ((n,), {"action": "store_true"})
    reading = (
        index, (("-q", "--query"), {}), (("-o", "--output"), {}), (("--query-list",), {}), (("--query-output-list",), {}), (("-m", "--min-hits"), {"type": int, "default": 1}),
        flag("--report-hit-counts"), flag("--report-bases-covered"), flag("--sort-output"), flag("--legacy-output-format"),
    )
    command("build", (("--file-colors",), {}), (("--seq-colors",), {}), (("-k",), {"type": int, **need}), (("--dictionary",), {}), flag("--from-unitigs"), output)
    command("intersection-pseudoalign", *reading)
    command("threshold-pseudoalign", *reading, (("-d", "--threshold"), {"type": float, **need}), (("-n", "--denominator"), {"choices": align.DENOMINATORS, "default": "all"}))
    command("print-color-sets", index, (("-q", "--query"), {}), flag("--print-kmers"), (("-o", "--output"), {}))
    command("dump-color-names", index, (("-o", "--output"), {}))
    command("merge", (("--index-file-list",), need), output)
    command("import", (("-c", "--color-dump-prefix"), need), output)
    command("import-kmers", (("--dictionary",), need), (("-k",), {"type": int, **need}), (("--color-name",), {"default": "0"}), output)
    command("export", index, output, flag("--gfa"), flag("--colors-to-stdout"), flag("--no-unitigs"), flag("--no-color-sets"))
    command("stats", index)
    command("report", index, results, (("-o", "--output"), {}))
    command("filter-reads", results, (("-r", "--reads"), need), (("-c", "--color-ids"), need), output)
    command("finimizer-stats", index)
    command("minimizer-stats", index, (("-m", "--minimizer-length"), {"type": int, **need}))
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = parser().parse_args(args)
    try:
        _run(spark or SparkSession.builder.appName("strandbase").getOrCreate(), given)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
