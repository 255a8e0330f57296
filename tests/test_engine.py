import collections
import gzip
import itertools
import math
import random

import brute
import pytest
from pyspark.sql import functions as F

from strandbase import queries
from strandbase.functions import dna
from strandbase.functions.windows import windows
from strandbase.operators import align, minimizers, mixture, report, unitigs
from strandbase.plans import index as ix
from strandbase.plans import store
from strandbase.sources import sequences, sinks
from strandbase.streaming.align import align_stream


def collection(seed, n=6, size=60, letters="ACGT"):
    r = random.Random(seed)
    base = brute.dna(r, size, letters)
    out = []
    for c in range(n):
        s = list(base)
        for _ in range(3):
            s[r.randrange(size)] = r.choice(letters)
        out.append((c, "".join(s)))
    return [*out, (0, brute.dna(r, 12)), (1, "ACGTNNacgtacgga"), (2, ""), (3, "AAAAAAAAAAAAAA"), (4, "ACGACGACGACGACG")]


def as_dict(index):
    rows = index.kmers.join(index.color_sets, "set_id").select(index.kmer.decode(F.col("km")).alias("w"), "colors").collect()
    return {r["w"]: frozenset(r["colors"]) for r in rows}


def frame(spark, seqs):
    return spark.createDataFrame(seqs, "color long, seq string")


@pytest.mark.parametrize("k", [3, 4, 7, 31, 33])
def test_build_matches_brute_force(spark, k):
    seqs = collection(k)
    for exact in (False, True):
        x = ix.build(frame(spark, seqs), k, exact=exact)
        assert as_dict(x) == brute.build(seqs, k)
        assert x.kmers.count() == x.kmers.select("km").distinct().count()
        assert x.color_sets.count() == x.color_sets.select("colors").distinct().count()


def test_scalar_functions(spark):
    df = spark.createDataFrame([("ACGTTTGCA",), ("acgNNNttt",), ("",)], "s string")
    got = df.select(dna.reverse_complement(F.col("s")), dna.is_dna(F.col("s")), dna.dna_pieces(F.col("s"), 3), dna.n_windows(F.col("s"), 4)).collect()
    assert [tuple(r) for r in got] == [("TGCAAACGT", True, ["ACGTTTGCA"], 6), ("AAANNNCGT", False, ["ACG", "TTT"], 6), ("", False, [], 0)]
    k = dna.Kmer(9)
    r = df.limit(1).select(k.encode(F.col("s")).alias("x")).select("x", k.decode(F.col("x")), k.decode(k.reverse_complement(F.col("x"))), k.last_base(F.col("x"))).first()
    assert tuple(r)[1:] == ("ACGTTTGCA", "TGCAAACGT", "A")
    assert [dna.bits_per_color(n) for n in (1, 2, 3, 4, 5, 1000)] == [1, 1, 2, 2, 3, 10]
    marks = spark.createDataFrame([(n,) for n in (10, 800, 1000, 4, 0, 1)], "n int").select("n", dna.is_dense(F.col("n"), 1000).alias("d")).collect()
    assert {r["n"] for r in marks if r["d"]} == {800, 1000}


@pytest.mark.parametrize("k", [5, 8])
def test_alignment_matches_brute_force(spark, k):
    seqs = collection(k + 100)
    index, model = ix.build(frame(spark, seqs), k), brute.build(seqs, k)
    r = random.Random(k)
    reads = [(i, f"r{i}", s) for i, s in enumerate([s for _, s in seqs] + [brute.dna(r, 30), "NNNNNNNNNN", "AC", "ACGTNACGTACGTNNACGTACG"])]
    df = spark.createDataFrame(reads, "qid long, name string, seq string")
    ids = {i: brute.sids(model, s, k) for i, _, s in reads}
    found = align.looked_up(index, df)
    for den, t, m in (("all", 0.0, 1), ("all", 0.7, 4), ("relevant", 0.5, 1), ("relevant", 1.0, 1), ("max-hits", 0.7, 4), ("max-hits", 1.0, 1)):
        got = {x["qid"]: x["colors"] for x in align.collected(df, align.threshold_pairs(index, found, t, den, m)).collect()}
        assert got == {i: brute.threshold(v, t, den, m) for i, v in ids.items()}
    for m in (0, 1, 2):
        got = {x["qid"]: x["colors"] for x in align.intersection_align(index, df, m).collect()}
        assert got == {i: brute.intersection(v, m, index.n_colors) for i, v in ids.items()}
    for x in align.threshold_align(index, df, 0.3, metrics=("kmer_hits", "bases_covered")).collect():
        v = ids[x["qid"]]
        assert x["kmer_hits"] == [brute.counts(v)[c] for c in x["colors"]]
        assert x["bases_covered"] == [brute.covered(v, c, k) for c in x["colors"]]
    with pytest.raises(ValueError):
        align.intersection_align(index, df, 0, ("kmer_hits",))
    lines = {(x["qid"], x["pos"]): x["line"] for x in align.kmer_lines(index, df).collect()}
    assert lines == {(i, p): " ".join(map(str, sorted(s or ()))) for i, v in ids.items() for p, s in enumerate(v)}


def test_dictionary_gives_empty_sets_and_checks_input(spark):
    seqs = [(0, "ACGTA")]
    words = [(x,) for x in ("ACG", "GTA", "CCC")]
    d = spark.createDataFrame(words, "w string").select(dna.Kmer(3).canonical(dna.Kmer(3).encode(F.col("w"))).alias("km")).distinct()
    x = ix.build(frame(spark, seqs), 3, dictionary=d)
    assert as_dict(x) == {"ACG": frozenset({0}), "GTA": frozenset({0}), "CCC": frozenset()}
    read = spark.createDataFrame([(0, "ACGTACCC")], "qid long, seq string")
    assert align.intersection_align(x, read).first()["colors"] == []
    with pytest.raises(ValueError):
        ix.build(frame(spark, [(0, "ACGTTTT")]), 3, dictionary=d)


@pytest.mark.parametrize("k", [3, 6])
def test_merge_equals_joint_build(spark, k, tmp_path):
    r = random.Random(k)
    seqs = [(c, brute.dna(r, 20)) for c in range(9)]
    names = lambda lo, hi: spark.createDataFrame([(c - lo, f"n{c}") for c in range(lo, hi)], "color_id long, name string")
    parts = [ix.build(frame(spark, [(c - a, s) for c, s in seqs if a <= c < b]), k, names(a, b)) for a, b in ((0, 4), (4, 6), (6, 9))]
    joint = ix.build(frame(spark, seqs), k, names(0, 9))
    merged = ix.merge(parts)
    assert as_dict(merged) == as_dict(joint) and merged.n_colors == 9
    assert merged.checksum().first() == joint.checksum().first() and not merged.difference(joint).take(1)
    assert [x["name"] for x in merged.color_names.orderBy("color_id").collect()] == [f"n{c}" for c in range(9)]
    assert ix.merge(parts[:1]) is parts[0]
    merged.save(str(tmp_path / "i"))
    assert as_dict(ix.load(spark, str(tmp_path / "i"))) == as_dict(joint)
    assert ix.load_color_names(spark, str(tmp_path / "i")).count() == 9


@pytest.mark.parametrize(("k", "local"), [(3, 20), (4, 1 << 21), (5, 30), (7, 60), (33, 50)])
def test_unitigs_cover_each_kmer_once(spark, k, local, monkeypatch):
    monkeypatch.setattr(unitigs, "LOCAL_NODES", local)
    for seed in (1 if k < 5 else 0,):
        seqs = collection(seed, 3, 25, "ACGT" if seed else "AC") + [(5, "ACGTACGTACGT"), (5, "AATTAATTAATT")]
        if k == 33:
            seqs = collection(k, 3, 50)
        x = ix.build(frame(spark, seqs), k)
        model = brute.build(seqs, k)
        sets = {r["set_id"]: frozenset(r["colors"]) for r in x.color_sets.collect()}
        pieces = unitigs.colored_unitigs(x)
        seen = [(brute.canon(w), sets[r["set_id"]]) for r in pieces.collect() for w in brute.windows(r["seq"], k)]
        assert len(seen) == len(model) and dict(seen) == model
        again = unitigs.import_unitigs(pieces, x.color_sets, k)
        assert as_dict(again) == model
        both = {w for m in model for w in (m, brute.rc(m))}
        assert unitigs.unitig_lengths(x).agg(F.sum("n_kmers")).first()[0] == len(both)
        ends = {(r["unitig_id"], s): q for r in pieces.collect() for s, q in (("+", r["seq"]), ("-", brute.rc(r["seq"])))}
        want = {(*a, *b) for a, p in ends.items() for b, q in ends.items() if p[-(k - 1) :] == q[: k - 1]}
        assert {tuple(r) for r in unitigs.gfa_links(pieces, k).select("from_id", "from_sign", "to_id", "to_sign").collect()} == want
    rows = {r["key"]: r["value"] for r in unitigs.stats(x).collect()}
    assert rows["n_canonical_kmers"] == str(len(model)) and rows["n_kmers"] == str(len(both))


def test_minimizers_match_brute_force(spark):
    k, m = 6, 3
    seqs = collection(9, 4, 40)
    x, model = ix.build(frame(spark, seqs), k), brute.build(seqs, k)
    both = {w: model[brute.canon(w)] for c in model for w in (c, brute.rc(c))}
    groups = {}
    for w, s in both.items():
        groups.setdefault(min(w[i : i + m] for i in range(k - m + 1)), []).append(s)
    union = {g: frozenset().union(*v) for g, v in groups.items()}
    row = next(r for r in minimizers.minimizer_stats(x, m).collect() if r["length"] == m)
    assert (row["n_classes"], row["n_kmers"]) == (len(groups), len(both))
    assert row["n_correct"] == sum(s == union[g] for g, v in groups.items() for s in v)
    assert row["mean_jaccard"] == pytest.approx(sum(len(s) / len(union[g]) for g, v in groups.items() for s in v) / len(both))
    nodes = set(both) | {w[:i] for w in both if not any(v[1:] == w[:-1] for v in both) for i in range(1, k)}
    ends = collections.Counter(w[-i:] for w in nodes for i in range(1, len(w) + 1))
    want = {w: min((e - b, w[b:e][::-1]) for b in range(k) for e in range(b + 1, k + 1) if ends[w[b:e]] == 1) for w in both}
    got = {r["s"]: (len(r["key"]), r["key"][::-1]) for r in minimizers.with_finimizer(x).collect()}
    assert got == want
    groups = {}
    for w, key in want.items():
        groups.setdefault(key, []).append(both[w])
    for r in minimizers.finimizer_stats(x).collect():
        mine = [v for (n, _), v in groups.items() if n == r["length"]]
        assert (r["n_classes"], r["n_kmers"]) == (len(mine), sum(map(len, mine)))
        assert r["n_correct"] == sum(s == frozenset().union(*v) for v in mine for s in v)
    own = minimizers.with_key(x, lambda s: F.substring(s, 1, 2))
    assert {(r["s"], r["key"]) for r in own.collect()} == {(w, w[:2]) for w in both}


def test_ties_between_finimizers_go_by_the_reversed_text(spark):
    # one k-mer and its complement; AC, CC, GG and GT each end one node, and of ACC's own AC < CC backwards as CA < CC
    x = ix.build(frame(spark, [(0, "ACC")]), 3)
    got = {r["s"]: r["key"] for r in minimizers.with_finimizer(x).collect()}
    assert got == {"ACC": "A", "GGT": "T"}


FASTA = b">a first\nACGT\nACGG\n>b\n\n>c\"q\nTTTT\n"
FASTQ = b"@a x\nACGT\n+\n@III\n@b\nGG\n+b\nII\n"


def records(spark, *paths, columns=("ordinal", "name", "seq", "qual")):
    return [tuple(r) for r in sequences.read_sequences(spark, list(map(str, paths))).orderBy("source", "ordinal").select(*columns).collect()]


def test_readers(spark, tmp_path):
    (tmp_path / "x.fna").write_bytes(FASTA)
    with gzip.open(tmp_path / "y.fq.gz", "wb") as f:
        f.write(FASTQ)
    assert records(spark, tmp_path / "x.fna") == [(0, "a", "ACGTACGG", None), (1, "b", "", None), (2, 'c"q', "TTTT", None)]
    assert records(spark, tmp_path / "y.fq.gz", columns=("header", "seq", "qual")) == [("a x", "ACGT", "@III"), ("b", "GG", "II")]
    (tmp_path / "untold").write_bytes(FASTQ + b"\n")
    assert records(spark, tmp_path / "untold", columns=("ordinal", "seq")) == [(0, "ACGT"), (1, "GG")]
    (tmp_path / "blank.fa").write_bytes(b"\r\n\n>a  b\r\nAC\r\n G T\r\n>\n>z\n")
    assert records(spark, tmp_path / "blank.fa") == [(0, "a", "ACGT", None), (1, "", "", None), (2, "z", "", None)]
    for name, text in (("bad.fa", b"ACGT\n>a\nAC\n"), ("bad.fq", b"@a\nAC\n-\nII\n"), ("short.fq", b"@a\nAC\n+\n")):
        (tmp_path / name).write_bytes(text)
        with pytest.raises(Exception, match="first header|bad FASTQ"):
            records(spark, tmp_path / name)
    (tmp_path / "empty.fa").write_bytes(b"")
    assert records(spark, tmp_path / "empty.fa") == []
    (tmp_path / "ids").write_text("3\n\n5\n")
    assert sorted(r[0] for r in sequences.read_color_ids(spark, str(tmp_path / "ids")).collect()) == [3, 5]
    (tmp_path / "bad").write_text("3\nx\n")
    with pytest.raises(ValueError):
        sequences.read_color_ids(spark, str(tmp_path / "bad"))
    (tmp_path / "meta").write_text(sinks.metadata(3, 2, 31, None))
    assert sequences.read_metadata(spark, str(tmp_path / "meta")) == {"num_colors": 3, "num_color_sets": 2, "k": 31}


def test_files_are_read_in_splits(spark, tmp_path):
    r = random.Random(2)
    fasta = [(f"r{i}", brute.dna(r, r.randrange(90))) for i in range(400)]
    (tmp_path / "a.fa").write_text("".join(f">{n} x\n" + "".join(f"{s[i : i + 30]}\n" for i in range(0, len(s), 30)) for n, s in fasta))
    fastq = [(f"q{i}", brute.dna(r, 30)) for i in range(400)]
    (tmp_path / "b.fq").write_text("".join(f"@{n}\n{s}\n+\n@{'I' * 29}\n" for n, s in fastq))
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = sequences.read_sequences(spark, [str(tmp_path / "a.fa"), str(tmp_path / "b.fq")])
        got = [tuple(x) for x in rows.orderBy("source", "ordinal").select("ordinal", "name", "seq").collect()]
        # the last record in a folder of part files decides, whatever the order in which Spark reads them
        (tmp_path / "out").mkdir()
        (tmp_path / "out" / "part-0").write_text('{"name": "a", "colors": [1]}\n')
        (tmp_path / "out" / "part-1").write_text("".join(f'{{"name": "{n}", "colors": []}}\n' for n in ["b"] * 100 + ["a"]))
        results = sequences.read_results(spark, str(tmp_path / "out"))
        kept = report.kept_names(results, spark.createDataFrame([(1,)], "color_id long")).collect()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert got == [(i, n, s) for part in (fasta, fastq) for i, (n, s) in enumerate(part)]
    assert results.rdd.getNumPartitions() >= 1 and kept == []


def test_many_files_are_one_scan(spark, tmp_path):
    paths = []
    for i in range(300):
        p = tmp_path / f"g {i}.fna"
        p.write_text(f">s\n{brute.dna(random.Random(i), 20)}\n")
        paths.append(str(p))
    seqs, names = sequences.file_colors(spark, [*paths, paths[0]])
    assert len(seqs._jdf.queryExecution().optimizedPlan().toString()) < 40_000
    assert sorted(r["color"] for r in seqs.collect()) == list(range(301)) and names.count() == 301
    seqs, names = sequences.file_colors(spark, [])
    assert ix.build(seqs, 3, names).kmers.count() == 0


def test_folders_of_part_files(spark, tmp_path):
    path = tmp_path / "reads.fa"
    path.mkdir()
    for i in range(3):
        (path / f"part-{i}").write_text(f">r{2 * i}\nACG\n>r{2 * i + 1}\nTTA\n")
    (path / "part-3").write_text("")
    got = sequences.read_in_order(spark, str(path)).orderBy("ordinal").select("ordinal", "name").collect()
    assert [tuple(r) for r in got] == [(i, f"r{i}") for i in range(6)]
    seqs, names = sequences.sequence_colors(spark, str(path))
    assert sorted(r["color"] for r in seqs.collect()) == list(range(6)) and names.distinct().count() == 6
    one = tmp_path / "one.fa"
    one.write_text(">x\nGGG\n")
    seqs, names = sequences.file_colors(spark, [str(one), str(path), str(path / "part-0")])
    assert {r["color"] for r in seqs.where("seq = 'GGG'").collect()} == {0}
    assert {r["color"] for r in seqs.where("seq = 'ACG'").collect()} == {1, 2} and names.count() == 3


def test_one_color_is_a_color(spark):
    seqs = [(0, "ACGTA")]
    one = ix.build(frame(spark, seqs), 3)
    assert one.n_colors == 1 and [r["name"] for r in one.color_names.collect()] == ["color_0"]
    two = ix.merge([one, ix.build(frame(spark, [(0, "ACGG")]), 3)])
    assert two.n_colors == 2 and as_dict(two) == brute.build([(0, "ACGTA"), (1, "ACGG")], 3)
    read = spark.createDataFrame([(0, "NNNN")], "qid long, seq string")
    assert align.intersection_align(one, read, 0).first()["colors"] == [0]
    again = unitigs.import_unitigs(unitigs.colored_unitigs(one), one.color_sets, 3)
    assert again.n_colors == 1
    assert ix.build(frame(spark, []), 3).n_colors == 0


def test_blocks_of_windows_and_metrics_of_ones_own(spark, monkeypatch):
    monkeypatch.setattr(align, "BLOCK", 5)
    k, seqs = 5, collection(11)
    index, model = ix.build(frame(spark, seqs), k), brute.build(seqs, k)
    reads = [(i, s + "N" + s[:9]) for i, (_, s) in enumerate(seqs)]
    df = spark.createDataFrame(reads, "qid long, seq string")
    ids = {i: brute.sids(model, s, k) for i, s in reads}
    found = align.looked_up(index, df)
    runs = {r["qid"]: r["n_runs"] for r in align.run_counts(found).collect()}
    assert runs == {i: len([x for x, _ in itertools.groupby(v) if x is not None]) for i, v in ids.items() if v}
    align.register_metric("last_hit", lambda x, found, pairs: found.join(x.color_sets, "set_id").select("qid", "pos", F.explode("colors").alias("color")).groupBy("qid", "color").agg(F.max("pos").alias("last_hit")))
    try:
        with pytest.raises(ValueError):
            align.register_metric("last_hit", None)
        rule = lambda x, found: align.threshold_pairs(x, found, 0.2)
        for r in align.align(index, df, rule, ("bases_covered", "last_hit", "kmer_hits")).collect():
            v = ids[r["qid"]]
            assert r["colors"] == brute.threshold(v, 0.2, "all", 1)
            assert r["bases_covered"] == [brute.covered(v, c, k) for c in r["colors"]]
            assert r["last_hit"] == [max(i for i, x in enumerate(v) if x and c in x) for c in r["colors"]]
    finally:
        del align.METRICS["last_hit"]
    with pytest.raises(ValueError):
        align.threshold_align(index, df, 0.2, metrics=("none",)).collect()


def test_joins_with_common_keys(spark, monkeypatch):
    rows = [(i, i % 7 if i % 2 else 100) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, key long")
    sized = df.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("top"))
    want = sorted((k, i, max(j for j, x in rows if x == k)) for i, k in rows)
    for small, hot in ((500_000, 4096), (0, 4), (0, 4096)):
        monkeypatch.setattr(store, "BROADCAST_ROWS", small)
        monkeypatch.setattr(store, "HOT_KEYS", hot)
        monkeypatch.setattr(store, "is_small", lambda df, rows=small: df.limit(rows + 1).count() <= rows)
        assert sorted(tuple(r[c] for c in ("key", "i", "top")) for r in store.join_sized(df, sized, ["key"], "n").collect()) == want


def test_scratch_is_removed_and_shared(spark):
    before = store.written()
    df = store.stored(spark.range(5), "x")
    new = store.written()[len(before) :]
    assert df.count() == 5 and len(new) == 1
    store.drop(spark, new)
    assert store.written() == before
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FAILED_READ"):
        spark.read.parquet(new[0]).count()

    class Elsewhere:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://far:7077"
            getConf = staticmethod(lambda: {})

    with pytest.raises(RuntimeError):
        store.scratch_dir(Elsewhere)


def test_lines_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, 'n"1', [0, 2], [5, 4]), (1, "m", [], [])], "qid long, name string, colors array<long>, kmer_hits array<long>")
    got = [r[0] for r in rows.orderBy("qid").select(sinks.jsonl(rows, ("kmer_hits",))).collect()]
    assert got == ['{"name": "n\\"1", "colors": [0,2], "kmer_hits": [5,4]}', '{"name": "m", "colors": [], "kmer_hits": []}']
    assert [r[0] for r in rows.orderBy("qid").select(sinks.legacy(rows)).collect()] == ["0 0 2", "1"]
    with pytest.raises(ValueError):
        sinks.legacy(rows, ("kmer_hits",))
    sinks.write_lines(rows, sinks.jsonl(rows), str(tmp_path / "r"), ["qid"])
    back = sequences.read_results(spark, str(tmp_path / "r")).orderBy("name").collect()
    assert [(r["name"], r["colors"]) for r in back] == [("m", []), ('n"1', [0, 2])]
    sets = spark.createDataFrame([(0, 2, [1, 4]), (1, 0, [])], "set_id long, size int, colors array<long>")
    sinks.write_lines(sets, sinks.color_set_lines(), str(tmp_path / "s"))
    assert sorted(map(tuple, sequences.read_color_sets(spark, str(tmp_path / "s")).collect())) == [(0, 2, [1, 4]), (1, 0, [])]


def test_report_and_filter(spark):
    results = spark.createDataFrame([(0, "a", [0]), (1, "b", [1]), (2, "c", [0, 2]), (3, "d", []), (4, "a", [2])], "record long, name string, colors array<long>")
    names = spark.createDataFrame([(i, f"n{i}") for i in range(3)], "color_id long, name string")
    assert report.report(results, names) == {"n_reads": 5, "n_positive_reads": 4, "positive_by_color": [["n0", 2], ["n2", 2], ["n1", 1]], "unique_positive_by_color": [["n0", 1], ["n1", 1], ["n2", 1]]}
    reads = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "a")], "ordinal long, name string")
    targets = spark.createDataFrame([(2,)], "color_id long")
    kept = report.filter_reads(reads, results, targets).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in kept] == [0, 2, 4]
    with pytest.raises(ValueError):
        report.filter_reads(reads.where("name != 'b'"), results, targets)
    with pytest.raises(ValueError):
        report.filter_reads(reads, results.where("name != 'b'"), targets)


def brute_em(colors, n, k, w, update_w, rounds, tolerance=1e-5):
    """colors and n of each observation; plain loops over all components."""
    theta = [1 / k] * k
    for _ in range(rounds):
        new, yes, no = [0.0] * k, 0.0, 0.0
        for own, m in zip(colors, n, strict=True):
            lik = [(w if c in own else 1) / (w + 1) for c in range(k)]
            mass = sum(t * x for t, x in zip(theta, lik, strict=True))
            for c in range(k):
                part = m * theta[c] * lik[c] / mass
                new[c] += part / sum(n)
                yes, no = (yes + part, no) if c in own else (yes, no + part)
        new_w = yes / no if update_w else w
        moved = (sum((a - b) ** 2 for a, b in zip(new, theta, strict=True)) + (new_w - w) ** 2) ** 0.5
        theta, w = new, new_w
        if moved < tolerance:
            break
    return theta, w


def test_mixture(spark):
    lists = [[0]] * 6 + [[1]] * 2 + [[0, 1]] * 4 + [[2, 3]] * 3 + [[0, 3]] * 2 + [[]] * 3
    results = spark.createDataFrame([(x,) for x in lists], "colors array<long>")
    obs = mixture.observations(results)
    n = collections.Counter(map(tuple, lists))
    del n[()]
    own, sizes = list(n), list(n.values())
    for w, update, rounds in ((99.0, False, 100), (4.0, False, 3), (4.0, True, 7), (2.0, True, 100)):
        want = brute_em(own, sizes, 5, w, update, rounds)
        got = mixture.em_compatibility(obs, 5, w, update, rounds)
        assert got[0] == pytest.approx(want[0], abs=1e-9) and got[1] == pytest.approx(want[1], rel=1e-9)
        if not update:
            assert mixture.em(mixture.compatibility(obs, w), 5, 1 / (w + 1), rounds) == pytest.approx(want[0], abs=1e-9)
    # likelihoods of one's own, and the mixture's likelihood against the enumeration of all assignments
    lik = lambda c: 0.2 + 0.1 * c
    table = mixture.likelihoods(obs, lik)
    theta = [0.5, 0.2, 0.1, 0.15, 0.05]
    want = sum(m * math.log(sum(theta[c] * (lik(c) if c in x else 0.01) for c in range(5))) for x, m in n.items())
    assert mixture.log_likelihood(table, theta, 0.01) == pytest.approx(want)
    reads = [x for x in lists if x][4:10]
    few = spark.createDataFrame([(x,) for x in reads], "colors array<long>")
    every = sum(math.prod(theta[c] * (lik(c) if c in x else 0.01) for c, x in zip(z, reads, strict=True)) for z in itertools.product(range(5), repeat=len(reads)))
    assert mixture.log_likelihood(mixture.likelihoods(mixture.observations(few), lik), theta, 0.01) == pytest.approx(math.log(every))
    assert mixture.em(table.limit(0), 2) == [0.5, 0.5]


def test_support_rules(spark):
    frame_ = lambda rows: spark.createDataFrame(rows, "color long, unique_n long, shared_n long")
    kept = lambda df: sorted(r["color"] for r in df.collect())
    results = spark.createDataFrame([([0],)] * 6 + [([1],)] * 2 + [([0, 1],)] * 4, "colors array<long>")
    sup = mixture.support(results)
    assert sorted(map(tuple, sup.collect())) == [(0, 6, 10), (1, 2, 6)]
    assert kept(mixture.unique_support(sup, 1, 0.5)) == [0]
    low = frame_([(0, 2, 9), (1, 1, 8), (2, 0, 1)])
    assert kept(mixture.unique_support(low, 3, 0.5)) == [0, 1]  # nobody has three: shared support decides
    assert kept(mixture.unique_support(low, 2, 0.5)) == [0]
    assert kept(mixture.unique_support(low, 3, 0.5, 9)) == [0] and kept(mixture.unique_support(low, 3, 0.5, 10)) == []
    assert kept(mixture.unique_support(low, 0, 0.0)) == [0, 1, 2] and kept(mixture.unique_support(low.limit(0), 1, 0.5)) == []
    assert kept(mixture.combined_support(sup, 0.5, 0.5, 10)) == [0] and mixture.combined_support(sup, 0.5, 0.5, 0).count() == 0
    # segments: shared support counts all of them
    seg = [(0, [0]), (0, [0]), (0, [0, 1]), (0, [1, 2]), (1, [3]), (1, [3, 4]), (1, [4])]
    rows = spark.createDataFrame(seg, "query long, colors array<long>")
    got = lambda *a: sorted((r["query"], r["color"], r["unique_n"], r["shared_n"]) for r in mixture.consensus(rows, *a).collect())
    assert got(2, 0.5) == [(0, 0, 2, 3), (1, 3, 1, 2), (1, 4, 1, 2)]
    assert got(3, 0.5, 2) == [(0, 0, 2, 3), (0, 1, 0, 2), (1, 3, 1, 2), (1, 4, 1, 2)]


def test_cluster_likelihood(spark):
    def brute_value(k, n, pi=0.65):
        phi = 1 - pi + 0.01 / n
        a, b = pi / phi, (1 - pi) / phi
        return 0.01 if k == 0 else 0.99 * math.exp(mixture.ln_beta_binomial(k, n, a, b) - mixture.ln_beta_binomial(n, n, a, b))

    cases = [(k, n) for n in (1, 2, 5, 10, 300) for k in {0, 1, n // 2, n}]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", mixture.cluster_likelihood(F.col("k"), F.col("n")).alias("v"))
    for r in df.collect():
        assert r["v"] == pytest.approx(brute_value(r["k"], r["n"]))
    value = {(r["k"], r["n"]): r["v"] for r in df.collect()}
    assert value[5, 5] == pytest.approx(0.99) and value[1, 1] == pytest.approx(0.99) and value[1, 10] == pytest.approx(0.224, abs=1e-3)
    assert mixture.ln_binomial(5, 2) == pytest.approx(math.log(10))
    results = spark.createDataFrame([([0, 1, 2],), ([0, 3],)], "colors array<long>")
    clusters = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "color long, cluster long")
    rows = mixture.cluster_table(results, clusters)
    assert sorted((r["color"], r["hits"], r["size"]) for r in rows.collect()) == [(0, 1, 2), (0, 2, 2), (1, 1, 2), (1, 1, 2)]
    assert sum(mixture.em(rows, 2, 0.01)) == pytest.approx(1)


def test_stream_equals_batch(spark, tmp_path):
    seqs = collection(3)
    index = ix.build(frame(spark, seqs), 5)
    reads = spark.createDataFrame([(i, f"r{i}", s) for i, (_, s) in enumerate(seqs)], "qid long, name string, seq string")
    reads.repartition(3).write.parquet(str(tmp_path / "reads"))
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "reads"))
    q = align_stream(stream, lambda df, _: df.write.mode("append").parquet(out), index, str(tmp_path / "cp"), 0.5, available_now=True)
    q.awaitTermination(120)
    want = align.threshold_align(index, reads, 0.5)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, want.collect()))


def test_window_positions_over_long_sequences(spark, monkeypatch):
    df = spark.createDataFrame([(0, "ACGTACGGTNACGTAC")], "qid long, seq string")
    got = [(r["pos"], r["w"]) for r in windows(df, 4, ["qid"], canonical=False).select("pos", dna.Kmer(4).decode(F.col("km")).alias("w")).orderBy("pos").collect()]
    assert got == list(enumerate(brute.windows("ACGTACGGTNACGTAC", 4)))


def prose(r, n):
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))


def write_tables(spark, path, docs, passages):
    """docs: (source number, lang, text); passages: text."""
    rows = [(i, t, lang, f"src{c}") for i, (c, lang, t) in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_merged_index_keeps_documents_without_language(spark, tmp_path):
    r = random.Random(7)
    shared = prose(r, 60)
    docs = [(0, "en", shared), (1, "fr", shared), (2, None, shared), (3, None, prose(r, 70)), (24, "en", prose(r, 50)), (24, None, prose(r, 50)), (4, "de", prose(r, 50))]
    for name, own, n in (("few", docs[:4] + docs[6:], 20), ("many", docs, 25)):
        (tmp_path / name).mkdir()
        d = write_tables(spark, tmp_path / name, own, [])
        seqs = {x["doc_id"]: x["seq"] for x in queries.documents(spark, d).collect()}
        index = brute.build([(c if lang == "en" else c + n, seqs[i]) for i, (c, lang, _) in enumerate(own)], queries.K)
        want = collections.Counter(",".join(map(str, sorted(c))) for c in index.values())
        assert {x["colors"]: x["n_kmers"] for x in queries.merge_indexes(spark, d).collect()} == want
        assert queries.merge_diff(spark, d).first()["n"] == 0
