"""Unitigs of the k-mer graph: contraction by pointer doubling, export, links and import.

For a (k-1)-mer, an edge inside a unitig exists if exactly one k-mer ends with it and exactly one begins with
it. k-mers are dealt by their minimizer, so that neighbours mostly lie together, and chains are solved where
they lie; what remains are the chains' heads, whose paths are solved in as many rounds as the longest has
doublings. Nodes that never reach a head lie on cycles, which are cut at their least k-mer and solved again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dna import Kmer, reverse_complement
from ..functions.windows import ship
from ..plans.index import Index, from_pairs, n_named
from ..plans.store import BROADCAST_ROWS, dense_ids, stored


#: k-mers that one task contracts, and the length of the minimizers that deal them.
LOCAL_NODES, LOCAL_M = 1 << 21, 12


def oriented(index: Index) -> DataFrame:
    """(x, canon, set_id): both strands of every k-mer, once each; one strand if the index is strand-specific."""
    kmer = index.kmer
    own = index.kmers.select(F.col("km").alias("x"), F.col("km").alias("canon"), "set_id")
    if not index.both_strands:
        return own
    other = index.kmers.select(kmer.reverse_complement(F.col("km")).alias("x"), F.col("km").alias("canon"), "set_id").where("x != canon")
    return own.unionAll(other)


def predecessors(nodes: DataFrame, kmer: Kmer, colored: bool) -> DataFrame:
    """(x, prev) of the edges inside unitigs; with `colored`, only between k-mers of the same color set."""
    out = nodes.select(kmer.suffix(F.col("x")).alias("w"), F.col("x").alias("l"), F.col("set_id").alias("ls"), F.lit(None).cast(kmer.type).alias("r"), F.lit(None).cast("long").alias("rs"))
    into = nodes.select(kmer.prefix(F.col("x")).alias("w"), F.lit(None).cast(kmer.type).alias("l"), F.lit(None).cast("long").alias("ls"), F.col("x").alias("r"), F.col("set_id").alias("rs"))
    met = out.unionAll(into).groupBy("w").agg(F.count("l").alias("nl"), F.count("r").alias("nr"), F.min("l").alias("prev"), F.min("ls").alias("ls"), F.min("r").alias("x"), F.min("rs").alias("rs"))
    one = met.where("nl = 1 and nr = 1 and prev != x")  # a k-mer that follows itself is a path of its own
    return (one.where("ls = rs") if colored else one).select("x", "prev")


def _doubled(start: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(x, ptr, dist) of the nodes whose pointer has reached a head, and (x) of those that never do.

    start(x, ptr, dist): heads point at themselves with dist 0. Only nodes on the way are rewritten and
    joined in a round; those that have arrived stay where they were written.
    """
    start = stored(start, "paths")
    arrived, open_ = start.where("dist = 0"), start.where("dist > 0")
    n = open_.count()
    while n:
        ends = arrived.withColumn("end", F.lit(True)).unionAll(open_.withColumn("end", F.lit(False)))
        ahead = ends.select(F.col("x").alias("y"), F.col("ptr").alias("next"), F.col("dist").alias("more"), "end")
        behind = F.broadcast(open_) if n <= BROADCAST_ROWS else open_  # n is its exact size
        moved = behind.join(ahead, F.col("ptr") == F.col("y")).select("x", F.col("next").alias("ptr"), (F.col("dist") + F.col("more")).alias("dist"), "end")
        moved = stored(moved, "paths")
        left = moved.where(~F.col("end")).drop("end")
        m = left.count()
        if m == n:  # nobody arrived in this round: all that is left lies on cycles
            return arrived, open_.select("x")
        arrived, open_, n = arrived.unionAll(moved.where("end").drop("end")), left, m
    return arrived, None


def _nearby(kmer: Kmer) -> Column:
    """The least hash of a k-mer's short substrings, which neighbours mostly share."""
    m = max(1, min(LOCAL_M, kmer.k - 1))
    part = f"shiftright(x, 2 * i) & {(1 << 2 * m) - 1}L" if kmer.packed else f"substr(x, i + 1, {m})"
    return F.expr(f"array_min(transform(sequence(0, {kmer.k - m}), i -> xxhash64({part})))")


def solve_chains(x: np.ndarray, prev: np.ndarray, has_prev: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For nodes and their predecessors: the place of each one's chain head, its distance, and which heads begin a cut cycle.

    A predecessor that isn't among the nodes ends the chain. A cycle is cut at its least node.
    """
    n = len(x)
    order = np.argsort(x, kind="stable")
    at = np.minimum(np.searchsorted(x[order], prev), n - 1)
    at = order[at]
    local = has_prev & (x[at] == prev)
    first = np.where(local, at, np.arange(n))
    cut = np.zeros(n, bool)

    def doubled() -> tuple[np.ndarray, np.ndarray]:
        ptr, dist = first.copy(), (first != np.arange(n)).astype(np.int64)
        for _ in range(max(1, n).bit_length() + 1):
            if (ptr == ptr[ptr]).all():
                break
            dist += dist[ptr]
            ptr = ptr[ptr]
        return ptr, dist

    ptr, dist = doubled()
    ring = first[ptr] != ptr  # a pointer that isn't at a head after so many rounds goes round
    if ring.any():
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        least, hop = rank.copy(), first.copy()
        for _ in range(n.bit_length() + 1):
            least = np.minimum(least, least[hop])
            hop = hop[hop]
        cut = ring & (least == rank)
        first = np.where(cut, np.arange(n), first)
        ptr, dist = doubled()
    return ptr, dist, cut


def _contracted(start: DataFrame, kmer: Kmer, n: int) -> DataFrame:
    """(x, lead, far, before) for start(x, prev): each node's head among the nodes dealt to its task, its distance, and that head's predecessor elsewhere."""
    ship(start.sparkSession)
    parts = -(-n // LOCAL_NODES) or 1
    dealt = start.repartition(parts, _nearby(kmer)) if parts > 1 else start.repartition(1)
    kind = pa.int64() if kmer.packed else pa.string()

    def run(batches):
        got = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not got:
            return
        t = pa.concat_tables(got).combine_chunks()
        plain = (lambda c: c.to_numpy()) if kind == pa.int64() else (lambda c: np.array(c.to_pylist(), str))
        x, own = plain(t.column("x")), t.column("prev")
        has = own.is_valid().to_numpy()
        prev = plain(own.fill_null(0 if kind == pa.int64() else ""))
        lead, far, cut = solve_chains(x, prev, has)
        before = pa.array(prev[lead], kind, mask=~has[lead] | cut[lead])
        yield from pa.table({"x": pa.array(x, kind), "lead": pa.array(x[lead], kind), "far": pa.array(far), "before": before}).to_batches(max_chunksize=1 << 18)

    return dealt.mapInArrow(run, f"x {kmer.type}, lead {kmer.type}, far long, before {kmer.type}")


def paths(nodes: DataFrame, prev: DataFrame, kmer: Kmer) -> DataFrame:
    """(x, head, rank): each node's path, named by its first node, and its place there."""
    zero = F.lit(0).cast("long")
    rows = stored(_contracted(nodes.select("x").join(prev, "x", "left").select("x", "prev"), kmer, nodes.count()), "chains")
    leads = rows.where("far = 0").select("x", "before")
    if not leads.where("before is not null").take(1):
        return rows.select("x", F.col("lead").alias("head"), F.col("far").alias("rank"))
    ahead = rows.select(F.col("x").alias("before"), F.col("lead").alias("ptr"), (F.col("far") + 1).alias("dist"))
    start = leads.join(ahead, "before", "left").select("x", F.coalesce("ptr", "x").alias("ptr"), F.coalesce("dist", zero).alias("dist"))
    solved, ring = _doubled(start)
    own = solved.select(F.col("x").alias("lead"), F.col("ptr").alias("head"), F.col("dist").alias("more"))
    out = rows.join(own, "lead").select("x", "head", (F.col("far") + F.col("more")).alias("rank"))
    if ring is None:
        return out
    return out.unionAll(_cycles(rows.join(ring.select(F.col("x").alias("lead")), "lead", "left_semi").select("x"), prev))


def _cycles(ring: DataFrame, prev: DataFrame) -> DataFrame:
    """(x, head, rank) of nodes that lie on cycles, which are cut at their least node, found by doubling over minima."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    edges = stored(ring.join(prev, "x"), "ring_edges")
    least = edges.select("x", F.col("prev").alias("ptr"), F.least("x", "prev").alias("m"))
    while True:
        least = stored(least, "ring_least")
        ahead = least.select(F.col("x").alias("y"), F.col("ptr").alias("next"), F.col("m").alias("m2"))
        moved = stored(least.join(ahead, least["ptr"] == ahead["y"]).select("x", F.col("next").alias("ptr"), F.least("m", "m2").alias("m"), (F.col("m2") < F.col("m")).alias("moved")), "ring_next")
        least = moved.drop("moved")
        if not moved.where("moved").take(1):
            break
    cut = edges.join(least.select("x", "m"), "x").select("x", F.when(F.col("x") == F.col("m"), F.col("x")).otherwise(F.col("prev")).alias("ptr"), F.when(F.col("x") == F.col("m"), zero).otherwise(one).alias("dist"))
    return _doubled(cut)[0].select("x", F.col("ptr").alias("head"), F.col("dist").alias("rank"))


def unitig_lengths(index: Index, colored: bool = False) -> DataFrame:
    """(head, n_kmers) of the unitigs of both strands."""
    nodes = stored(oriented(index), "nodes")
    return paths(nodes, stored(predecessors(nodes, index.kmer, colored), "edges"), index.kmer).groupBy("head").agg(F.count(F.lit(1)).alias("n_kmers"))


def colored_unitigs(index: Index, colored: bool = True) -> DataFrame:
    """(unitig_id, seq, set_id, n_kmers): every canonical k-mer in exactly one piece, each piece of one set.

    Of a path and its reverse complement one is kept. Of a path that is its own, the first occurrence of each
    k-mer is kept, and it is split where occurrences aren't next to each other.
    """
    kmer = index.kmer
    nodes = stored(oriented(index), "nodes")
    along = paths(nodes, stored(predecessors(nodes, kmer, colored), "edges"), kmer).join(nodes, "x")
    first = F.row_number().over(Window.partitionBy("canon").orderBy("head", "rank"))
    kept = along.withColumn("nth", first).where("nth = 1").drop("nth")
    # the strand is chosen for whole paths: k-mer by k-mer the lesser head wins, and it is the same for all of a path
    piece = F.col("rank") - F.row_number().over(Window.partitionBy("head").orderBy("rank"))
    kept = kept.withColumn("piece", piece)
    text = F.array_sort(F.collect_list(F.struct("rank", kmer.last_base(F.col("x")).alias("base"))))
    made = kept.groupBy("head", "piece").agg(F.min_by("x", "rank").alias("x"), F.min_by("set_id", "rank").alias("set_id"), text.alias("t"), F.count(F.lit(1)).alias("n_kmers"))
    rest = F.array_join(F.slice(F.col("t.base"), F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))), "")
    return dense_ids(made.select(F.col("x").alias("first"), "set_id", "n_kmers", F.concat(kmer.decode(F.col("x")), rest).alias("seq")), "first", "unitig_id").select("unitig_id", "seq", "set_id", "n_kmers")


def gfa_links(unitigs: DataFrame, k: int) -> DataFrame:
    """(from_id, from_sign, to_id, to_sign) of all ends that overlap by k - 1 bases, in the four orientations."""
    plus = unitigs.select("unitig_id", F.lit("+").alias("sign"), "seq")
    minus = unitigs.select("unitig_id", F.lit("-").alias("sign"), reverse_complement(F.col("seq")).alias("seq"))
    both = plus.unionAll(minus)
    ends = both.select(F.col("unitig_id").alias("from_id"), F.col("sign").alias("from_sign"), F.substring(F.col("seq"), F.length("seq") - (k - 2), F.lit(k - 1)).alias("w"))
    begins = both.select(F.col("unitig_id").alias("to_id"), F.col("sign").alias("to_sign"), F.substring("seq", 1, k - 1).alias("w"))
    return ends.join(begins, "w").drop("w")


def import_unitigs(unitigs: DataFrame, color_sets: DataFrame, k: int, names: DataFrame | None = None) -> Index:
    """Index of colored unitigs (set_id, seq) and sets (set_id, colors); names default to the decimal ids.

    Equal sets under different ids become one.
    """
    from ..functions.windows import windows

    rows = windows(unitigs, k, ["set_id"]).where("km is not null").select("km", "set_id").distinct()
    pairs = rows.join(color_sets, "set_id").select("km", F.explode("colors").alias("color"))
    n = n_named(color_sets.agg(F.max(F.array_max("colors"))).first()[0])
    if names is None:
        names = unitigs.sparkSession.range(n).select(F.col("id").alias("color_id"), F.col("id").cast("string").alias("name"))
    return from_pairs(pairs, names, k, True, rows.select("km"))


def stats(index: Index) -> DataFrame:
    """(key, value) rows: counts, mean set sizes and unitig lengths (both strands, colors ignored)."""
    sizes = index.color_sets.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean")).first()
    kmers = index.kmers.join(index.color_sets.select("set_id", "size"), "set_id").agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean")).first()
    k = index.k
    lengths = unitig_lengths(index).agg(F.count(F.lit(1)).alias("n"), F.min("n_kmers").alias("lo"), F.max("n_kmers").alias("hi"), F.avg(F.col("n_kmers") + k - 1).alias("mean")).first()
    mean = lambda v: f"{v:.6f}" if v is not None else "NaN"
    rows = [
        ("k", str(k)), ("n_colors", str(index.n_colors)), ("n_kmers", str(oriented(index).count())), ("n_canonical_kmers", str(kmers["n"])), ("n_color_sets", str(sizes["n"])),
        ("mean_color_set_size", mean(sizes["mean"])), ("mean_kmer_color_set_size", mean(kmers["mean"])), ("n_unitigs", str(lengths["n"])),
        ("min_unitig_length", str((lengths["lo"] or 0) + k - 1)), ("max_unitig_length", str((lengths["hi"] or 0) + k - 1)), ("mean_unitig_length", mean(lengths["mean"])),
    ]
    return index.kmers.sparkSession.createDataFrame(rows, "key string, value string")
