import gzip
import io
import json
import random

import brute

from strandbase.cli import main
from strandbase.plans import index as ix


def lines(path):
    return [x for p in sorted(path.glob("part-*")) for x in p.read_text().splitlines()]


def test_commands_end_to_end(spark, tmp_path, capsys):
    r = random.Random(0)
    seqs = [brute.dna(r, 60) for _ in range(3)]
    paths = []
    for i, s in enumerate(seqs):
        p = tmp_path / f"c{i}.fna"
        p.write_text(f">s{i} x\n{s[:30]}\n{s[30:]}\n")
        paths.append(str(p))
    (tmp_path / "list").write_text("\n".join(paths) + "\n")
    (tmp_path / "all.fna").write_text("".join(f">s{i} x\n{s}\n" for i, s in enumerate(seqs)))
    at = lambda n: str(tmp_path / n)
    run = lambda *a: main([str(x) for x in a], spark)
    assert run("build", "--file-colors", at("list"), "-k", 7, "-o", at("a")) == 0
    assert run("build", "--seq-colors", at("all.fna"), "-k", 7, "-o", at("b")) == 0
    assert run("build", "-k", 7, "-o", at("c")) == 1
    a, b = ix.load(spark, at("a")), ix.load(spark, at("b"))
    assert a.checksum().first() == b.checksum().first()
    assert run("threshold-pseudoalign", "-i", at("b"), "-q", at("all.fna"), "-o", at("t"), "-d", 1.0, "--sort-output", "--report-hit-counts") == 0
    rows = [json.loads(x) for x in lines(tmp_path / "t")]
    assert [x["name"] for x in rows] == ["s0", "s1", "s2"] and all(i in x["colors"] for i, x in enumerate(rows))
    assert run("intersection-pseudoalign", "-i", at("b"), "-q", at("all.fna"), "-o", at("l"), "--sort-output", "--legacy-output-format") == 0
    assert [x.split(" ")[0] for x in lines(tmp_path / "l")] == ["0", "1", "2"]
    assert run("dump-color-names", "-i", at("b"), "-o", at("n")) == 0
    assert lines(tmp_path / "n") == ["0\ts0", "1\ts1", "2\ts2"]
    assert run("print-color-sets", "-i", at("b"), "-q", paths[0], "--print-kmers", "-o", at("k")) == 0
    assert [x.split(" ")[0] for x in lines(tmp_path / "k")] == brute.windows(seqs[0], 7)
    for i, p in enumerate(paths):
        assert run("build", "--seq-colors", p, "-k", 7, "-o", at(f"m{i}")) == 0
    (tmp_path / "indexes").write_text("\n".join(at(f"m{i}") for i in range(3)))
    assert run("merge", "--index-file-list", at("indexes"), "-o", at("m")) == 0
    assert ix.load(spark, at("m")).checksum().first() == b.checksum().first()
    assert run("export", "-i", at("b"), "-o", at("e")) == 0
    assert run("import", "-c", at("e"), "-o", at("x")) == 0
    assert ix.load(spark, at("x")).checksum().first() == b.checksum().first()
    assert run("export", "-i", at("b"), "-o", at("g"), "--gfa", "--no-color-sets") == 0
    assert lines(tmp_path / "g.unitigs.gfa")[0] == "H\tVN:Z:1.0"
    capsys.readouterr()
    assert run("report", "-i", at("b"), "-p", at("t")) == 0
    assert json.loads(capsys.readouterr().out)["n_reads"] == 3
    assert run("stats", "-i", at("b")) == 0
    assert "n_colors\t3" in capsys.readouterr().out
    (tmp_path / "ids").write_text("1\n")
    assert run("filter-reads", "-p", at("t"), "-r", at("all.fna"), "-c", at("ids"), "-o", at("f")) == 0
    assert ">s1 x" in lines(tmp_path / "f")
    assert run("minimizer-stats", "-i", at("b"), "-m", 4) == 0
    spark.createDataFrame([(w,) for w in brute.windows(seqs[0], 7)], "kmer string").write.parquet(at("d"))
    assert run("import-kmers", "--dictionary", at("d"), "-k", 7, "-o", at("s")) == 0
    assert ix.load(spark, at("s")).n_colors == 1


def test_reads_from_lists_and_standard_input(spark, tmp_path, capsys, monkeypatch):
    r = random.Random(1)
    seqs = [brute.dna(r, 40) for _ in range(2)]
    at = lambda n: str(tmp_path / n)
    run = lambda *a: main([str(x) for x in a], spark)
    (tmp_path / "all.fna").write_text("".join(f">s{i}\n{s}\n" for i, s in enumerate(seqs)))
    assert run("build", "--seq-colors", at("all.fna"), "-k", 7, "-o", at("i")) == 0
    for i, s in enumerate(seqs):
        (tmp_path / f"q{i}.fq").write_text(f"@s{i}\n{s}\n+\n{'I' * 40}\n")
    (tmp_path / "in").write_text(f"{at('q0.fq')}\n{at('q1.fq')}\n")
    (tmp_path / "out").write_text(f"{at('o0')}\n{at('o1')}\n")
    go = ("threshold-pseudoalign", "-i", at("i"), "-d", 1.0)
    assert run(*go, "--query-list", at("in"), "--query-output-list", at("out")) == 0
    for i in range(2):
        assert [json.loads(x) for x in lines(tmp_path / f"o{i}")] == [{"name": f"s{i}", "colors": [i]}]
    (tmp_path / "one").write_text(at("q0.fq"))
    assert run(*go, "--query-list", at("one"), "--query-output-list", at("out")) == 1
    capsys.readouterr()
    for text in ("".join(f">s{i}\n{s}\n" for i, s in enumerate(seqs)).encode(), (tmp_path / "q1.fq").read_bytes(), gzip.compress((tmp_path / "all.fna").read_bytes())):
        monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(text)))
        assert run(*go, "--sort-output") == 0
        got = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
        assert [(x["name"], x["colors"]) for x in got] == ([("s1", [1])] if text[:1] == b"@" else [("s0", [0]), ("s1", [1])])
    assert run("dump-color-names", "-i", at("i")) == 0
    assert capsys.readouterr().out == "0\ts0\n1\ts1\n"
    assert run(*go, "-q", at("q0.fq"), "-o", at("m"), "--legacy-output-format", "--report-hit-counts") == 1
    (tmp_path / "ids").write_text("x")
    assert run("filter-reads", "-p", at("o0"), "-r", at("q0.fq"), "-c", at("ids"), "-o", at("f.gz")) == 1
    (tmp_path / "ids").write_text("0")
    assert run("filter-reads", "-p", at("o0"), "-r", at("q0.fq"), "-c", at("ids"), "-o", at("f.gz")) == 0
    found = [gzip.decompress(p.read_bytes()).decode() for p in (tmp_path / "f.gz").glob("part-*.gz")]
    assert "".join(found) == (tmp_path / "q0.fq").read_text()
    assert run("stats", "-i", at("i")) == 0
    rows = dict(x.split("\t") for x in capsys.readouterr().out.splitlines())
    assert rows["k"] == "7" and int(rows["n_canonical_kmers"]) == len(brute.build([(i, s) for i, s in enumerate(seqs)], 7))


def test_entry_registers_every_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
