"""Indexes that are built, merged and compared by bucket, against the stored ones and a brute-force model."""

import collections
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_engine import prose, write_tables

from strandbase import queries
from strandbase.functions import superkmers
from strandbase.functions.windows import _CODE, encode
from strandbase.plans import buckets, store
from strandbase.plans import index as ix


def dna(r, n, letters="ACGT"):
    return "".join(r.choice(letters) for _ in range(n))


def collection(seed, n=30):
    """(seq, color in x, in y, in z): repeats, long runs of one letter, other bytes, empty and null texts, absent colors."""
    r = random.Random(seed)
    pool = [dna(r, 80) for _ in range(4)]
    seqs = [r.choice(pool) + dna(r, r.randrange(40), "ACGTacgtN") + "A" * r.choice([0, 90]) + r.choice(pool) for _ in range(n)]
    color = lambda top: r.choice([None, *range(top)])
    return [(s, color(4), color(3), color(6)) for s in [*seqs, "", None, "ACG"]]


def frame(spark, rows):
    return spark.createDataFrame(rows, "seq string, x long, y long, z long").repartition(3)


def tally(df, *columns):
    rows = [(tuple(r[c] for c in columns[:-1]) + (tuple(r["colors"]),), r[columns[-1]]) for r in df.collect()]
    assert len(dict(rows)) == len(rows)
    return dict(rows)


def stored_index(df, column, k, n):
    own = df.where(F.col(column).isNotNull()).select(F.col(column).alias("color"), "seq")
    return ix.build(own, k, ix.default_names(df.sparkSession, n))


@pytest.mark.parametrize("k", [1, 2, 5, 14, 31])
@pytest.mark.parametrize("canonical", [True, False])
def test_runs_open_to_the_windows_and_keep_equal_kmers_together(k, canonical):
    r = random.Random(k)
    bases = _CODE[np.frombuffer((dna(r, 3000, "ACGTacgt" * 12 + "N") + "A" * 300 + dna(r, 500) * 2).encode(), np.uint8)]
    code, valid = encode(bases, k, canonical)
    start, n, bucket = superkmers.runs(bases, k, canonical)
    kms, own = superkmers.opened(*superkmers.spelled(bases, start, n, k), n, k, canonical)
    assert kms.tolist() == code[valid].tolist() and n.max() <= k
    places = collections.defaultdict(set)
    for km, b in zip(kms.tolist(), bucket[own].tolist(), strict=True):
        places[km].add(b)
    assert all(len(x) == 1 for x in places.values())


@pytest.mark.parametrize("k", [3, 9, 31])
def test_merge_and_difference_equal_the_stored_ones(spark, k):
    df = frame(spark, collection(k))
    x, y, z = (stored_index(df, c, k, n) for c, n in (("x", 4), ("y", 3), ("z", 6)))
    merged = ix.merge([x, y])
    sizes = merged.kmers.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    assert tally(buckets.merged_sets(df, k, {"x": 0, "y": 4}), "n") == tally(merged.color_sets.join(sizes, "set_id"), "n")
    want = merged.difference(z).groupBy("side", "colors").agg(F.count(F.lit(1)).alias("n"))
    got = tally(buckets.differing_sets(df, k, {"x": 0, "y": 4}, {"z": 0}), "side", "n")
    assert got == tally(want, "side", "n") and {s for s, _ in got} == {"left", "right"}
    assert tally(buckets.differing_sets(df, k, {"x": 0, "y": 4}, {"x": 0, "y": 4}), "side", "n") == {}


def test_one_strand_and_long_kmers(spark):
    df = frame(spark, collection(8))
    seqs = [(c, s) for s, c, _, _ in collection(8) if c is not None and s]
    lists = collections.defaultdict(set)
    for c, s in seqs:
        for w in brute.windows(s.upper(), 6):
            if w is not None and not w.strip("ACGT"):
                lists[w].add(c)
    want = collections.Counter((tuple(sorted(x)),) for x in lists.values())
    assert tally(buckets.merged_sets(df, 6, {"x": 0}, both_strands=False), "n") == want
    with pytest.raises(ValueError, match="up to 31"):
        buckets.merged_sets(df, 32, {"x": 0})


def test_a_bucket_opened_in_several_passes(spark, monkeypatch):
    """The generators that run in tasks, called here with small limits."""
    made = []

    class Frame:
        sparkSession = spark

        def repartition(self, *_):
            return self

        sortWithinPartitions = repartition

        def mapInArrow(self, run, _):
            made.append(run)

    r = random.Random(4)
    seqs = [dna(r, 400) for _ in range(5)]
    seqs += seqs[:2]
    rows = spark.createDataFrame([(s, i % 3) for i, s in enumerate(seqs)], "seq string, c long").coalesce(1)
    packs = superkmers.dealt(rows, 15, ["c"]).withColumn("bucket", F.lit(0)).coalesce(1).toArrow().to_batches()
    monkeypatch.setattr(superkmers, "OPENED", 300)
    pairs, passes = collections.Counter(), []

    def work(kms, colors):
        passes.append(set(kms.tolist()))
        pairs.update(zip(kms.tolist(), (colors[0] - 1).tolist(), strict=True))

    superkmers.by_bucket(Frame(), 15, 1, True, work, lambda last: iter(()), "")
    list(made[0](iter(packs)))
    want = {(int(x), i % 3) for i, s in enumerate(seqs) for x in encode(_CODE[np.frombuffer(s.encode(), np.uint8)], 15, True)[0]}
    assert set(pairs) == want
    assert len(passes) > 4 and sum(map(len, passes)) == len(set().union(*passes))


def test_packs_take_few_bytes_a_kmer_and_equal_texts_once(spark):
    r = random.Random(5)
    once = spark.createDataFrame([(dna(r, 2000), i % 20) for i in range(200)], "seq string, c long").coalesce(1)
    size = lambda df: superkmers.dealt(df, 31, ["c"]).agg(F.sum(F.length("runs"))).first()[0]
    assert size(once) < 4 * 200 * 1970  # a (k-mer, color) row has 16 bytes, and half of these are random; packs here are small
    assert size(once.unionAll(once).coalesce(1)) < 1.2 * size(once)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of small tables and (color, lang, seq) of its documents."""
    r = random.Random(9)
    shared = prose(r, 90)
    docs = [(0, "en", shared), (1, "fr", shared + prose(r, 40)), (2, None, prose(r, 70)), (5, "en", prose(r, 80)), (3, "de", ""), (5, "fr", None)]
    d = write_tables(spark, tmp_path_factory.mktemp("tables"), docs, [])
    return d, [(x["color"], x["lang"], x["seq"]) for x in queries.documents(spark, d).collect() if x["seq"]]


def texts(colors):
    return ",".join(map(str, sorted(colors)))


def test_merge_diff_stores_no_kmers(spark, tables):
    before = store.written()
    assert queries.merge_diff(spark, tables[0]).first()["n"] == 0
    assert store.written() == before


def test_index_diff_stores_no_kmers(spark, tables):
    before, (d, seqs) = store.written(), tables
    every, fewer = (brute.build([(c, s) for c, _, s in seqs if c < top], queries.K) for top in (6, 5))
    want = collections.Counter()
    for km in every.keys() | fewer.keys():
        a, b = every.get(km), fewer.get(km)
        if a != b:
            want.update((side, texts(x)) for side, x in (("left", a), ("right", b)) if x is not None)
    assert {(x["side"], x["colors"]): x["n"] for x in queries.index_diff(spark, d).collect()} == want and want
    assert store.written() == before


def test_merge_indexes_stores_no_kmers(spark, tables):
    before, (d, seqs) = store.written(), tables
    index = brute.build([(c if lang == "en" else c + 20, s) for c, lang, s in seqs], queries.K)
    assert {x["colors"]: x["n_kmers"] for x in queries.merge_indexes(spark, d).collect()} == collections.Counter(map(texts, index.values()))
    assert store.written() == before


def test_colors_below_zero_and_beyond_what_a_product_holds(spark):
    r = random.Random(6)
    shared, own = dna(r, 40), [dna(r, 50) for _ in range(3)]
    rows = [(shared, -5, None), (shared, 1 << 61, 7), (shared, 3, -9), (own[0], -5, None), (own[1], 0, -1), (own[2], 1 << 61, 0)]
    df = spark.createDataFrame(rows, "seq string, x long, y long")
    want = {(-9 + 20, -5, 27, 3, 1 << 61): 10, (-5,): 20, (0, 19): 20, (20, 1 << 61): 20}
    want = {(tuple(sorted(c)),): n for c, n in want.items()}
    assert tally(buckets.merged_sets(df, 31, {"x": 0, "y": 20}), "n") == want
