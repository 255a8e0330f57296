"""Registered queries that go through files: sources, sinks, stored indexes, the command line and the stream; with their SQL.

Files are written to the shared folder from the driver's whole tables and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as q
from .functions import dna
from .operators import align, mixture, report, unitigs
from .plans import index as ix
from .plans.store import dense_ids, scratch_path
from .sources import sequences, sinks
from .streaming.align import align_stream

#: Files, and so colors, of file_colors, and parts of merge_many.
FILES, PARTS = 16, 3
_texts = q._texts


def _written(rows: DataFrame, line: Column, name: str, ending: str = "", order: list[str] | None = None, compression: str | None = None) -> str:
    """The path of a folder with a line for each row."""
    path = scratch_path(rows.sparkSession, name, ending)
    sinks.write_lines(rows, line, path, order, compression)
    return path


def _command(spark: SparkSession, *args: str) -> None:
    from .cli import main

    if main(list(args), spark):
        raise RuntimeError(f"command failed: {' '.join(args)}")


def _wrapped(seq: str = "seq") -> Column:
    """A sequence in lines of 60 bases."""
    return F.regexp_replace(seq, "(.{60})(?=.)", "$1\n")


def fasta_records(spark, d):
    """Documents written as FASTA in lines of 60 bases and read again."""
    rows = q.documents(spark, d).where("seq is not null")
    line = F.concat(F.lit(">doc"), F.col("doc_id").cast("string"), F.lit(" of "), F.coalesce(F.col("color").cast("string"), F.lit("none")), F.lit("\n"), _wrapped())
    return sequences.read_sequences(spark, _written(rows, line, "docs", ".fa")).select("header", "name", "seq")


def fastq_records(spark, d):
    """Passages written as gzipped FASTQ in the order of their ids and read again with their places."""
    rows = q.passages(spark, d).withColumns({"header": F.concat("name", F.lit(" x")), "qual": F.translate("seq", "ACGTN", "IIII!")})
    path = _written(rows, sinks.fastx_lines(), "reads", ".fq", ["qid"], "gzip")
    return sequences.read_in_order(spark, path).select(F.col("ordinal").alias("place"), "name", "seq", "qual")


def file_colors(spark, d):
    """k-mers of each of 16 files that hold the documents, named by a list file."""
    rows = q.documents(spark, d).where("seq is not null").withColumn("file", F.pmod("doc_id", F.lit(FILES)))
    top = scratch_path(spark, "files")
    rows.select("file", F.concat_ws("\n", F.concat(F.lit(">d"), F.col("doc_id").cast("string")), "seq").alias("value")).repartition(FILES, "file").write.partitionBy("file").text(top)
    folders = sorted({f.rpartition("/")[0] for f in sequences.files(spark, [top])}, key=lambda f: int(f.rpartition("=")[2]))
    listed = _written(spark.createDataFrame([(f,) for f in folders], "path string").coalesce(1), F.col("path"), "list") if folders else None
    seqs, names = sequences.file_colors(spark, sequences.read_list(spark, listed) if listed else [])
    counts = ix.build(seqs, q.K, names, spread=q._spread(spark)).pairs().groupBy("color").agg(F.count(F.lit(1)).alias("n_kmers"))
    named = names.select(F.col("color_id").alias("color"), F.regexp_extract("name", r"file=(\d+)/?$", 1).cast("long").alias("file"))
    return counts.join(named, "color").select("file", "n_kmers")


def sequence_colors(spark, d):
    """k-mers of each record of one lower-case FASTA file of all passages, by the records' names."""
    rows = q.passages(spark, d).where("seq is not null")
    path = _written(rows, F.concat(F.lit(">"), F.col("name"), F.lit(" of benchmark\n"), F.lower(_wrapped())), "passages", ".fna", ["qid"])
    seqs, names = sequences.sequence_colors(spark, path)
    x = ix.build(seqs, q.K, names)
    return x.pairs().groupBy(F.col("color").alias("color_id")).agg(F.count(F.lit(1)).alias("n_kmers")).join(x.color_names, "color_id").select("color_id", "name", "n_kmers")


def _saved(spark: SparkSession, name: str, x: ix.Index) -> str:
    path = scratch_path(spark, name)
    x.save(path)
    return path


def saved_index(spark, d):
    """The documents' index written and loaded again: k-mers of each color, with the names loaded alone."""
    path = q._once(spark, ("saved", d), lambda: _saved(spark, "index", q.index(spark, d)))
    counts = ix.load(spark, path).pairs().groupBy(F.col("color").alias("color_id")).agg(F.count(F.lit(1)).alias("n_kmers"))
    return ix.load_color_names(spark, path).join(counts, "color_id", "left").select("color_id", "name", F.coalesce("n_kmers", F.lit(0).cast("long")).alias("n_kmers"))


def _saved_passages(spark, d):
    return q._once(spark, ("saved_passages", d), lambda: _saved(spark, "passages", q.passage_index(spark, d)))


def exported_dump(spark, d):
    """The passages' index exported to text files and imported from them, by commands."""
    dump, back = scratch_path(spark, "dump"), scratch_path(spark, "imported")
    _command(spark, "export", "-i", _saved_passages(spark, d), "-o", dump)
    _command(spark, "import", "-c", dump, "-o", back)
    x = ix.load(spark, back)
    return x.kmers.join(x.color_sets, "set_id").select(x.kmer.decode(F.col("km")).alias("kmer"), _texts().alias("colors"))


def dump_metadata(spark, d):
    """The metadata and the color sets' lines of an export."""
    dump = scratch_path(spark, "dump")
    _command(spark, "export", "-i", _saved_passages(spark, d), "-o", dump, "--no-unitigs")
    meta = sequences.read_metadata(spark, f"{dump}.metadata.txt")
    sets = sequences.read_color_sets(spark, f"{dump}.color_sets.txt").groupBy(_texts().alias("value")).agg(F.count(F.lit(1)).alias("n"))
    head = spark.createDataFrame([(k, str(v), 1) for k, v in meta.items()], "key string, value string, n long")
    return head.unionByName(sets.withColumn("key", F.lit("set")))


def index_dictionary(spark, d):
    """The documents' colors of the k-mers of a dictionary, that of the passages; k-mers without a color have the empty set."""
    x = ix.build(q.documents(spark, d), q.K, dictionary=q.passage_index(spark, d).kmers.select("km"), allow_missing=True, spread=q._spread(spark))
    return x.kmers.join(x.color_sets, "set_id").select(x.kmer.decode(F.col("km")).alias("kmer"), _texts().alias("colors"))


def import_kmers(spark, d):
    """The passages' k-mers as a Parquet dictionary of texts, imported under one color by command."""
    x, table, back = q.passage_index(spark, d), scratch_path(spark, "dictionary"), scratch_path(spark, "imported")
    x.kmers.select(x.kmer.decode(F.col("km")).alias("kmer")).write.parquet(table)
    _command(spark, "import-kmers", "--dictionary", table, "-k", str(q.K), "--color-name", "all", "-o", back)
    y = ix.load(spark, back)
    return y.pairs().withColumnRenamed("color", "color_id").join(y.color_names, "color_id").select(y.kmer.decode(F.col("km")).alias("kmer"), "name")


def merge_many(spark, d):
    """Three indexes of one unnamed color each, merged at once: the passages by their id's remainder."""
    rows = q.passages(spark, d).select(F.pmod("qid", F.lit(PARTS)).alias("part"), F.lit(0).cast("long").alias("color"), "seq")
    x = ix.merge([ix.build(rows.where(F.col("part") == i), q.K, ix.default_names(spark, 1)) for i in range(PARTS)])
    return x.kmers.join(x.color_sets, "set_id").select(x.kmer.decode(F.col("km")).alias("kmer"), _texts().alias("colors"))


def _results_file(spark, d):
    rows = q._results(spark, d)
    return q._once(spark, ("results_file", d), lambda: _written(rows, sinks.jsonl(rows, ("kmer_hits", "bases_covered")), "results", ".jsonl", ["qid"]))


def result_files(spark, d):
    """The passages' results written as JSON lines in order and read again, numbered by their places in the files."""
    rows = sequences.read_results(spark, _results_file(spark, d))
    return dense_ids(rows, "record", "place").select("place", "name", *(_texts(c).alias(c) for c in ("colors", "kmer_hits", "bases_covered")))


def report_rows(spark, d):
    """The report of a result file: its two totals and its two lists, with the places in them."""
    names = ix.load_color_names(spark, q._once(spark, ("saved", d), lambda: _saved(spark, "index", q.index(spark, d))))
    found = report.report(sequences.read_results(spark, _results_file(spark, d)), names)
    rows = [(k, 0, None, found[k]) for k in ("n_reads", "n_positive_reads")]
    rows += [(k, i, name, n) for k in ("positive_by_color", "unique_positive_by_color") for i, (name, n) in enumerate(found[k])]
    return spark.createDataFrame(rows, "part string, place long, name string, n long")


def filtered_reads(spark, d):
    """Passages compatible with a color below 10, filtered by command from gzipped FASTQ and a list of ids."""
    rows = q.passages(spark, d).where("seq is not null").withColumns({"header": F.col("name"), "qual": F.translate("seq", "ACGTN", "IIII!")})
    reads = _written(rows, sinks.fastx_lines(), "reads", ".fq", ["qid"], "gzip")
    results = q._results(spark, d).join(rows.select("qid"), "qid", "left_semi")
    ids = _written(spark.range(10).coalesce(1), F.when(F.col("id") % 2 == 0, F.concat(F.col("id").cast("string"), F.lit("\n"))).otherwise(F.col("id").cast("string")), "ids")
    out = scratch_path(spark, "kept", ".fq")
    _command(spark, "filter-reads", "-p", _written(results, sinks.jsonl(results), "results"), "-r", reads, "-c", ids, "-o", out)
    return sequences.read_in_order(spark, out).select(F.col("ordinal").alias("place"), "name", "seq", "qual")


def streamed_results(spark, d):
    """Passages read as a stream of Parquet files, aligned batch by batch against the documents' index."""
    src, out = scratch_path(spark, "stream"), scratch_path(spark, "streamed")
    q.passages(spark, d).write.parquet(src)
    reads = spark.readStream.schema("qid long, name string, seq string").parquet(src)
    x = q.index(spark, d)
    align_stream(reads, lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}"), x, scratch_path(spark, "offsets"), q.THRESHOLD, True).awaitTermination()
    return spark.read.schema("qid long, colors array<long>").parquet(f"{out}/*").select("qid", _texts().alias("colors"))


def intersection_all_colors(spark, d):
    """Intersection without a least number of runs: passages without a k-mer of the index have all colors."""
    return align.intersection_align(q.index(spark, d), q.passages(spark, d), 0, spread=q._spread(spark)).select("qid", _texts().alias("colors"))


def combined_support(spark, d):
    """Sources whose mean of unique and shared support, weighted 3 to 1, reaches a tenth of the positive passages."""
    results = q._results(spark, d)
    n = results.where(F.size("colors") > 0).count()
    return mixture.combined_support(mixture.support(results), 0.1, 0.75, float(n))


def stats_lines(spark, d):
    """The passages' index in figures, as the stats command prints them."""
    return unitigs.stats(q.passage_index(spark, d))


def dna_pieces(spark, d):
    """Runs of at least 31 bases of every document, and the first word of a header."""
    rows = q.documents(spark, d)
    header = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(" "), F.coalesce("lang", F.lit("")))
    return rows.select("doc_id", F.array_join(dna.dna_pieces(F.col("seq"), q.K), ",").alias("pieces"), dna.name_token(header).alias("name"))


def bare_dense_marks(spark, d):
    """Sizes of the documents' sets and which form is smaller where a set has no fixed cost."""
    x = q.index(spark, d)
    rows = x.color_sets.select(F.col("size").cast("long").alias("size"), dna.is_dense(F.col("size"), x.n_colors, 0).alias("dense"))
    return rows.groupBy("size", "dense").agg(F.count(F.lit(1)).alias("n_sets"))


def both_strands(spark, d):
    """Passages beside their reverse complements as one scan, and the k-mers of each, strands kept apart."""
    rows = q.passages(spark, d).select("qid", "seq")
    both = rows.withColumn("strand", F.lit("+")).unionByName(rows.select("qid", dna.reverse_complement(F.col("seq")).alias("seq"), F.lit("-").alias("strand")))
    found = q.windows(both, q.K, ["qid", "strand"], canonical=False).where("km is not null")
    return found.groupBy("qid", "strand").agg(F.count_distinct("km").alias("n_kmers"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        fasta_records, fastq_records, file_colors, sequence_colors, saved_index, exported_dump, dump_metadata, index_dictionary, import_kmers, merge_many,
        result_files, report_rows, filtered_reads, streamed_results, intersection_all_colors, combined_support, stats_lines, dna_pieces, bare_dense_marks, both_strands,
    )
}


# ---- the same in DuckDB SQL ---------------------------------------------------------------------------

_QUAL = "replace(regexp_replace(seq, '[ACGT]', 'I', 'g'), 'N', '!')"
_REPORT = q._HITS + """, sup AS (SELECT color, CAST(sum(CASE WHEN size = 1 THEN 1 ELSE 0 END) AS BIGINT) AS unique_n, count(*) AS shared_n FROM hit JOIN res USING (qid) GROUP BY color)"""
_READ_PARTS = f"parts AS (SELECT qid % {PARTS} AS color, seq FROM reads)"
_LENGTHS = q.ORACLE_SQL["unitig_stats"].rsplit("SELECT CAST(sum(n)", 1)[0]

ORACLE_SQL: dict[str, str] = {
    "fasta_records": f"WITH {q._DOCS} SELECT 'doc' || doc_id || ' of ' || coalesce(CAST(color AS VARCHAR), 'none') AS header, 'doc' || doc_id AS name, seq FROM docs WHERE seq IS NOT NULL",
    "fastq_records": f"WITH {q._READS} SELECT row_number() OVER (ORDER BY qid) - 1 AS place, name, seq, {_QUAL} AS qual FROM reads WHERE seq IS NOT NULL",
    "file_colors": f"WITH {q._DOCS}, {q._windows('dw', '(SELECT doc_id % ' + str(FILES) + ' AS file, seq FROM docs)', 'file')} SELECT file, count(DISTINCT km) AS n_kmers FROM dw WHERE km IS NOT NULL GROUP BY file",
    "sequence_colors": f"WITH {q._READS}, r AS (SELECT row_number() OVER (ORDER BY qid) - 1 AS color_id, name, seq FROM reads WHERE seq IS NOT NULL), {q._windows('rw', 'r', 'color_id, name')} SELECT color_id, name, count(DISTINCT km) AS n_kmers FROM rw WHERE km IS NOT NULL GROUP BY ALL",
    "saved_index": f"{q._INDEX}, n AS (SELECT color, count(*) AS n FROM dsp GROUP BY color) SELECT c AS color_id, 'color_' || c AS name, coalesce(n, 0) AS n_kmers FROM range((SELECT max(color) + 1 FROM docs)) AS r(c) LEFT JOIN n ON n.color = c",
    "exported_dump": f"{q._PASSAGES} SELECT km AS kmer, cs AS colors FROM ps",
    "dump_metadata": f"""{q._PASSAGES}, u AS (SELECT DISTINCT cs FROM ps) SELECT 'set' AS key, cs AS value, CAST(1 AS BIGINT) AS n FROM u
UNION ALL SELECT 'k', '{q.K}', 1 UNION ALL SELECT 'num_colors', CAST(count(*) AS VARCHAR), 1 FROM reads UNION ALL SELECT 'num_color_sets', CAST(count(*) AS VARCHAR), 1 FROM u""",
    "index_dictionary": f"{q._INDEX}, {q._windows('pw', 'reads', 'qid')} SELECT km AS kmer, coalesce(cs, '') AS colors FROM (SELECT DISTINCT km FROM pw WHERE km IS NOT NULL) LEFT JOIN ds USING (km)",
    "import_kmers": f"{q._PASSAGES} SELECT km AS kmer, 'all' AS name FROM ps",
    "merge_many": f"WITH {q._READS}, {_READ_PARTS}, {q._windows('pw', 'parts', 'color')}, {q._sets('ps', 'pw')} SELECT km AS kmer, cs AS colors FROM ps",
    "result_files": q._HITS + " SELECT row_number() OVER (ORDER BY qid) - 1 AS place, name, coalesce(cs, '') AS colors, coalesce(hs, '') AS kmer_hits, coalesce(bs, '') AS bases_covered FROM reads LEFT JOIN res USING (qid)",
    "report_rows": _REPORT + """ SELECT 'n_reads' AS part, CAST(0 AS BIGINT) AS place, CAST(NULL AS VARCHAR) AS name, count(*) AS n FROM reads UNION ALL SELECT 'n_positive_reads', 0, NULL, count(*) FROM res
UNION ALL SELECT 'positive_by_color', row_number() OVER (ORDER BY shared_n DESC, color) - 1, 'color_' || color, shared_n FROM sup
UNION ALL SELECT 'unique_positive_by_color', row_number() OVER (ORDER BY unique_n DESC, color) - 1, 'color_' || color, unique_n FROM sup WHERE unique_n > 0""",
    "filtered_reads": q._HITS + f" SELECT row_number() OVER (ORDER BY qid) - 1 AS place, name, seq, {_QUAL} AS qual FROM reads WHERE qid IN (SELECT qid FROM hit WHERE color < 10)",
    "streamed_results": q.ORACLE_SQL["threshold_all"],
    "intersection_all_colors": f"""{q._ALIGN}, every AS (SELECT string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS cs FROM range((SELECT max(color) + 1 FROM docs)) AS r(c)),
hit AS (SELECT qid, string_agg(CAST(color AS VARCHAR), ',' ORDER BY color) AS colors FROM cnt JOIN tot USING (qid) WHERE c = n_rel GROUP BY qid)
SELECT reads.qid, CASE WHEN coalesce(n_rel, 0) = 0 THEN every.cs ELSE coalesce(colors, '') END AS colors FROM every, reads LEFT JOIN tot USING (qid) LEFT JOIN hit USING (qid)""",
    "combined_support": _REPORT + " SELECT color, unique_n, shared_n FROM sup WHERE (unique_n * 0.75::DOUBLE + shared_n * 0.25::DOUBLE) / (SELECT count(*) FROM res) >= 0.1::DOUBLE - 1e-8::DOUBLE",
    "stats_lines": f"""{_LENGTHS}, cs AS (SELECT km, string_agg(CAST(qid AS VARCHAR), ',' ORDER BY qid) AS cs, count(*) AS size FROM (SELECT DISTINCT km, qid FROM pw WHERE km IS NOT NULL) GROUP BY km), u AS (SELECT DISTINCT cs, size FROM cs)
SELECT 'k' AS key, '{q.K}' AS value UNION ALL SELECT 'n_colors', CAST(count(*) AS VARCHAR) FROM reads UNION ALL SELECT 'n_kmers', CAST(count(*) AS VARCHAR) FROM x UNION ALL SELECT 'n_canonical_kmers', CAST(count(*) AS VARCHAR) FROM cs
UNION ALL SELECT 'n_color_sets', CAST(count(*) AS VARCHAR) FROM u UNION ALL SELECT 'mean_color_set_size', format('{{:.6f}}', avg(size)) FROM u UNION ALL SELECT 'mean_kmer_color_set_size', format('{{:.6f}}', avg(size)) FROM cs
UNION ALL SELECT 'n_unitigs', CAST(count(*) AS VARCHAR) FROM h UNION ALL SELECT 'min_unitig_length', CAST(min(n) + {q.K - 1} AS VARCHAR) FROM h UNION ALL SELECT 'max_unitig_length', CAST(max(n) + {q.K - 1} AS VARCHAR) FROM h
UNION ALL SELECT 'mean_unitig_length', format('{{:.6f}}', avg(n + {q.K - 1})) FROM h""",
    "dna_pieces": f"WITH {q._DOCS} SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(seq, '[^ACGT]+'), lambda x: length(x) >= {q.K}), ',') AS pieces, 'doc' || doc_id AS name FROM docs",
    "bare_dense_marks": q.ORACLE_SQL["sparse_dense_marks"].replace("size * w + 64", "size * w"),
    "both_strands": f"""WITH {q._READS}, {q._windows('pw', 'reads', 'qid')}, f AS (SELECT qid, count(DISTINCT w) AS n FROM pw WHERE km IS NOT NULL GROUP BY qid)
SELECT qid, '+' AS strand, n AS n_kmers FROM f UNION ALL SELECT qid, '-', n FROM f""",
}
