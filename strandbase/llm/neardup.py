"""N-gram Jaccard join: MinHash banding, band hashes shuffled, pairs verified on full n-gram sets.

Texts are lower-cased and cut into words (letters and digits; in scripts without spaces, each letter is a word
of its own); a text's set holds the 64-bit hashes of its
runs of `n` words, or of all its words if it has fewer. Rows with equal sets form one set row, so copies
never meet pair by pair. Bands and rows are chosen from the threshold and a target recall. Set rows are
shuffled on their band hashes; buckets of two or more are cut into blocks of bounded size, every pair of
blocks goes to a task, and there all pairs are verified at once by products of incidence matrices. A pair is
verified only in the first band where it meets: sets all of whose pairs met before are put aside first, so a
large group that stays together from band to band is compared once. No pair is ever a row: a task yields, for each set, how
many rows it is linked to, and a spanning forest of the links. Classes are the connected components of those
forests, found by rounds of large-star and small-star steps over the edge table.

Result: doc_id, class_id (the least doc_id of its class) and n_links (how many other rows have a similarity of
at least the threshold, copies included).

Defined cases: null and empty texts, and texts without a word, have the empty set; empty sets are alike;
repeated rows are copies of each other; an empty table gives an empty result; extra columns are ignored. Rows
with a null id are linked like others and take their class's least id, which is null if no member has one;
keep_one() can't tell such rows apart, so it keeps them all. An id may stand for several texts: keep_one() decides
on the id and the fingerprint of its set, so that each class keeps one row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

N, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Most sets in a block, and most n-grams in a block of several sets.
BLOCK_SETS, BLOCK_GRAMS = 1024, 1 << 20
WORDS_CACHE = 65_536
#: Sets that are broadcast when results go back to rows: those with more than this part of all rows.
HOT_SETS = 4096
#: Columns of the incidence matrix that are multiplied at once.
COLUMNS = 2048
_SPACED = re.compile(r"[\W_]+")
#: Letters of scripts that put no spaces between words: Thai and Lao, Burmese, Khmer, kana, Han.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")


def banding(threshold: float = THRESHOLD, recall: float = RECALL, rows: tuple[int, ...] = (4, 5, 3, 2, 1)) -> tuple[int, int]:
    """(bands, rows): the first number of rows for which at most 16 bands find a pair at the threshold with the target recall."""
    for r in rows:
        for b in range(1, 65):
            if 1 - (1 - threshold**r) ** b >= recall:
                if b <= 16 or r == rows[-1]:
                    return b, r
                break
    raise ValueError("no banding reaches the target recall")


class Grams:
    """Makes n-gram sets and band hashes; holds a bounded cache of word hashes."""

    def __init__(self, n: int, bands: int, rows: int) -> None:
        self.n, self.bands, self.rows = n, bands, rows
        seeds = np.random.default_rng(20).integers(1, 1 << 63, (2, bands * rows), dtype=np.uint64)
        self.mul, self.add = seeds[0] | np.uint64(1), seeds[1]
        outer = self

        class Words(dict):
            def __missing__(self, w: str) -> int:
                if len(self) >= WORDS_CACHE:
                    self.clear()
                h = self[w] = xxhash.xxh64_intdigest(w)
                return h

        self.word = Words()

    def grams(self, text: bytes | None) -> np.ndarray:
        """The text's set: distinct n-gram hashes, ascending."""
        low = str(text or b"", "utf-8", "replace").lower()
        if not low.isascii() and _UNSPACED.search(low):
            low = _UNSPACED.sub(r" \1 ", low)
        words = _SPACED.sub(" ", low).split(" ")
        words = [w for w in words if w]
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.word.__getitem__, words), np.uint64, len(words))
        k = min(self.n, len(h))
        m = len(h) - k + 1
        out = np.full(m, k, np.uint64)
        for i in range(k):
            out = (out ^ h[i : m + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out)

    def signature(self, grams: np.ndarray) -> list[int]:
        """One 64-bit hash for each band; all zero for the empty set."""
        if not len(grams):
            return [0] * self.bands
        least = np.full(len(self.mul), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(grams), 4096):
            x = grams[i : i + 4096, None] * self.mul + self.add
            x ^= x >> np.uint64(32)
            np.minimum(least, x.min(axis=0), out=least)
        least = least.reshape(self.bands, self.rows)
        h = np.arange(1, self.bands + 1, dtype=np.uint64)
        for k in range(self.rows):
            h = (h ^ least[:, k]) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        return h.view(np.int64).tolist()


def fingerprint(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def sketches(df: DataFrame, doc_id: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, fp, grams, bands) of every row; the sets themselves stay behind."""
    common.ship(df.sparkSession)
    src = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("t"))
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches):
        g = Grams(n, bands, rows)
        for b in batches:
            for part in common.sliced(b):
                sets = [g.grams(t) for t in part.column(1).to_pylist()]
                cols = [part.column(0), pa.array([fingerprint(x) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array([g.signature(x) for x in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "fp", "grams", "bands"])
        pa.default_memory_pool().release_unused()

    return src.mapInArrow(run, f"doc_id {kind}, fp binary, grams long, bands array<long>")


def full_sets(df: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """(doc_id, fp, set) of every row of df; sets as the bytes of ascending 64-bit hashes."""
    src = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("t"))
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches):
        g = Grams(n, 1, 1)
        for b in batches:
            for part in common.sliced(b, 4 << 20):
                sets = [g.grams(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([fingerprint(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["doc_id", "fp", "set"])
        pa.default_memory_pool().release_unused()

    return src.mapInArrow(run, f"doc_id {kind}, fp binary, set binary")


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Matrix of the pairs whose Jaccard similarity is at least the threshold; sets aren't empty."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    if m == 2:
        both = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))]] * 2, np.float64)
        both[1] = both[1][::-1]
    else:
        _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = seen >= 2
        column = np.where(shared, np.cumsum(shared) - 1, -1)[column]
        row = np.repeat(np.arange(m), size.astype(np.int64))
        row, column = row[column >= 0], column[column >= 0]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((m, m))
        width = int(column[-1]) + 1 if len(column) else 0
        for a in range(0, width, COLUMNS):
            lo, hi = np.searchsorted(column, (a, a + COLUMNS))
            x = np.zeros((m, min(COLUMNS, width - a)), np.float32)
            x[row[lo:hi], column[lo:hi] - a] = 1
            both += x @ x.T
    union = size[:, None] + size[None, :] - both
    found = both >= threshold * union - 1e-9
    np.fill_diagonal(found, False)
    return found


def forest(found: np.ndarray) -> list[tuple[int, int]]:
    """(least member, member) for every member of each component of a symmetric boolean matrix."""
    left = found.any(axis=1)
    out = []
    for k in range(len(found)):
        if not left[k]:
            continue
        left[k] = False
        reached = np.zeros(len(found), bool)
        edge = np.zeros(len(found), bool)
        edge[k] = True
        while edge.any():
            reached |= edge
            edge = found[edge].any(axis=0) & ~reached
        left &= ~reached
        out += [(k, int(j)) for j in np.flatnonzero(reached) if j != k]
    return out


def _verify(threshold: float):
    """Over rows sorted by bucket and block pair: linked rows and forest edges of every group, as (a, b, n)."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        last, rows = None, []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[:4] != last:
                    if rows:
                        yield rows
                    last, rows = r[:4], []
                rows.append(r)
        if rows:
            yield rows

    def run(batches):
        a: list[bytes] = []
        b: list[bytes | None] = []
        n: list[int] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], names=["a", "b", "n"])
            a.clear(), b.clear(), n.clear()
            return out

        for rows in groups(batches):
            if len(rows) < 2:
                continue
            rows.sort(key=lambda r: r[4])
            band, _, i, j = rows[0][:4]
            new = np.ones((len(rows), len(rows)), bool)
            np.fill_diagonal(new, False)
            if i != j:
                block = np.array([r[5] for r in rows])
                new &= block[:, None] != block[None, :]
            if band:
                bands = np.array([r[7][:band] for r in rows], np.int64)
                for k in range(band):  # met before: verified there
                    new &= bands[:, k][:, None] != bands[:, k][None, :]
            some = new.any(axis=1)
            if not some.any():
                continue
            if not some.all():
                rows, new = [r for r, y in zip(rows, some.tolist(), strict=True) if y], new[np.ix_(some, some)]
            fps = [r[4] for r in rows]
            found = similar([np.frombuffer(r[8], np.uint64) for r in rows], threshold) & new
            if not found.any():
                continue
            weight = np.array([r[6] for r in rows], np.int64)
            linked = found @ weight
            for k in np.flatnonzero(linked):
                a.append(fps[k])
                b.append(None)
                n.append(int(linked[k]))
            for k, m in forest(found):
                a.append(fps[k])
                b.append(fps[m])
                n.append(0)
            if len(a) >= 20_000:
                yield flush()
        if a:
            yield flush()
        pa.default_memory_pool().release_unused()

    return run


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the edge table (a, b): root is the least node of its component.

    Rounds of large-star and small-star steps over tables in the shared folder, until a round changes nothing.
    """
    edges = common.stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        up = large.groupBy("b").agg(F.min("a").alias("m"))  # each node's least lower neighbour
        small = large.join(up, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))
        edges = common.stored(small.where("a < b").distinct(), "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, fp, class_id, n_links and leads for every row; leads: its set is the one that stands for its class."""
    spark = df.sparkSession
    bands, per_band = banding(threshold, recall)
    rows = common.stored(sketches(df, doc_id, text, n, bands, per_band), "sketches")
    sets = common.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.max("grams").alias("grams"), F.min("bands").alias("bands")), "sets")
    placed = sets.where("grams > 0").select("fp", "size", "grams", F.posexplode("bands").alias("band", "hash"))
    most = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("grams") / BLOCK_GRAMS)).cast("int")
    buckets = placed.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("members"), most.alias("blocks")).where("members > 1").drop("members")
    met = common.stored(placed.drop("grams").join(buckets, ["band", "hash"]).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")), "met")
    reps = met.select("fp").distinct().join(sets.select("fp", "rep", "bands"), "fp")
    reps = common.stored(reps, "reps")
    # only texts of sets that met are read again; a repeated id may bring other texts, which fp sorts out
    wanted = common.maybe_broadcast(reps.select("rep").distinct())
    src = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    own = full_sets(src.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi"), "doc_id", "text", n)
    own = reps.join(own, (reps["fp"] == own["fp"]) & reps["rep"].eqNullSafe(own["doc_id"])).select(reps["fp"], "bands", "set").dropDuplicates(["fp"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sent = met.select("band", "hash", "fp", "size", "block", "blocks", other.alias("other"))
    # a block meets itself only if the bucket has no other; otherwise pairs inside a block are verified in (k, k)
    sent = sent.select("band", "hash", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp", "block", "size")
    keyed = sent.join(own, "fp").select("band", "hash", "i", "j", "fp", "block", "size", "bands", "set")
    keyed = keyed.repartition("band", "hash", "i", "j").sortWithinPartitions("band", "hash", "i", "j")
    found = common.stored(keyed.mapInArrow(_verify(threshold), "a binary, b binary, n long"), "found")
    degree = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "fp")
    roots = components(found.where("b is not null").select("a", "b"))
    named = sets.select("fp", "rep", "size").join(roots, sets["fp"] == roots["node"], "left").select("fp", "rep", "size", F.coalesce("root", "fp").alias("root"))
    # classes of more than one set are few; only they need the least doc_id of the class, and the least set that has it
    many = named.join(roots.select("root").distinct(), "root", "left_semi")
    least = many.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "fp")).alias("first"))
    least = least.select("root", F.col("first.rep").alias("class_id"), F.col("first.fp").alias("first"))
    linked = many.select("fp", "root").join(least, "root").join(degree, "fp", "left").select("fp", "class_id", (F.col("fp") == F.col("first")).alias("leads"), "n")
    n_links = (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")
    answer = sets.select("fp", "rep", "size").join(linked, "fp", "left").select("fp", "size", F.coalesce("class_id", "rep").alias("class_id"), n_links, F.coalesce("leads", F.lit(True)).alias("leads"))
    return to_copies(rows.select("doc_id", "fp"), common.stored(answer, "answer"))


def to_copies(rows: DataFrame, answer: DataFrame) -> DataFrame:
    """Each row (doc_id, fp) with its set's other columns, class_id and n_links first.

    Fewer than HOT_SETS sets can hold more than their share of all rows; these are broadcast, so that no
    task gets all copies of one text. The other sets are joined by a shuffle.
    """
    limit = (answer.agg(F.sum("size")).first()[0] or 0) // HOT_SETS
    own = answer.drop("size")
    hot, cool = F.broadcast(own.where(answer["size"] > limit)), own.where(answer["size"] <= limit)
    found = rows.join(hot, "fp").unionAll(rows.join(hot.select("fp"), "fp", "left_anti").join(cool, "fp"))
    return found.select("doc_id", *own.columns)


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of df that hold the least doc_id of their class, in the set that stands for it; of repeated rows, one stays."""
    classes = common.stored(near_duplicates(df, doc_id, text, n, threshold, recall), "classes")
    first = F.col("leads") & (F.col("doc_id") == F.col("class_id"))
    ids = classes.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(first).alias("n_first"))
    gone = common.stored(ids.where("n_first = 0 or n > 1").select(F.col("doc_id").alias(doc_id), "n_first"), "gone")
    # an id of several rows, not all to be dropped, is decided by the fingerprint
    mixed = gone.where("n_first > 0").select(doc_id)
    rows = df.join(common.maybe_broadcast(gone.select(doc_id)), doc_id, "left_anti").select(*df.columns)
    if not mixed.take(1):
        return rows
    again = common.per_row(df.join(common.maybe_broadcast(mixed), doc_id, "left_semi").select(*df.columns), _prints(n), [("__fp", T.BinaryType())], df.columns, text)
    kept = classes.where(first).select(F.col("doc_id").alias(doc_id), F.col("fp").alias("__fp")).distinct()
    again = again.join(kept, [doc_id, "__fp"], "left_semi").dropDuplicates([doc_id, "__fp"])
    return rows.unionAll(again.select(*df.columns))


def _prints(n: int) -> Callable:
    def make() -> Callable:
        g = Grams(n, 1, 1)
        return lambda texts: [[fingerprint(g.grams(t)) for t in texts]]

    return make


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links")
