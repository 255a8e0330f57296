"""The colored k-mer index: a handle over four DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dna import Kmer, bits_per_color, is_dense
from ..functions.windows import distinct_kmers, sets_by_kmer, windows
from .store import BROADCAST_ROWS, dense_ids, is_small, join_sized, maybe_broadcast, stored

VERSION = 1


@dataclass
class Index:
    """kmers(km, set_id), color_sets(set_id, size, colors), color_names(color_id, name) and their description.

    km is canonical if both_strands, and unique. Colors of a set ascend; a set may be empty.
    """

    kmers: DataFrame
    color_sets: DataFrame
    color_names: DataFrame
    k: int
    n_colors: int
    both_strands: bool = True
    _small: bool | None = field(default=None, repr=False, compare=False)

    @property
    def kmer(self) -> Kmer:
        return Kmer(self.k)

    def windows(self, df: DataFrame, keep: list[str], seq: str = "seq", spread: int | None = None) -> DataFrame:
        return windows(df, self.k, keep, seq, self.both_strands, spread)

    def dictionary(self) -> DataFrame:
        """(km, set_id), marked for broadcast if its checked size allows."""
        if self._small is None:
            self._small = is_small(self.kmers, BROADCAST_ROWS)
        return F.broadcast(self.kmers) if self._small else self.kmers

    def lookup(self, df: DataFrame, keep: list[str], seq: str = "seq", spread: int | None = None) -> DataFrame:
        """Columns `keep`, pos and set_id (null where the k-mer isn't in the index) for every window."""
        # windows without a k-mer get keys of their own that match nothing, so that a shuffle doesn't bring them together
        slot = F.pmod("pos", F.lit(4096))
        none = -1 - slot if self.kmer.packed else F.concat(F.lit("N"), slot.cast("string"))
        found = self.windows(df, keep, seq, spread).withColumn("km", F.coalesce("km", none))
        return found.join(self.dictionary(), "km", "left").select(*keep, "pos", "set_id")

    def lookup_colors(self, df: DataFrame, keep: list[str], seq: str = "seq") -> DataFrame:
        """Columns `keep`, pos and colors (null where the k-mer isn't in the index) for every window."""
        return self.lookup(df, keep, seq).join(self.color_sets.select("set_id", "colors"), "set_id", "left").select(*keep, "pos", "colors")

    def pairs(self) -> DataFrame:
        """(km, color) rows."""
        return self.kmers.join(self.color_sets, "set_id").select("km", F.explode("colors").alias("color"))

    def save(self, path: str) -> None:
        """Write the index; an existing one is an error."""
        spark = self.kmers.sparkSession
        spark.createDataFrame([(self.k, self.n_colors, self.both_strands, VERSION)], "k int, n_colors long, both_strands boolean, version int").write.parquet(f"{path}/meta")
        self.color_names.write.parquet(f"{path}/color_names")
        self.color_sets.write.parquet(f"{path}/color_sets")
        self.kmers.write.parquet(f"{path}/kmers")

    def dense_marks(self) -> DataFrame:
        """(set_id, size, dense): which form would store each set in less space."""
        return self.color_sets.select("set_id", "size", is_dense(F.col("size"), self.n_colors).alias("dense"))

    def set_bits(self) -> int:
        return bits_per_color(self.n_colors)

    def checksum(self) -> DataFrame:
        """One row: n_kmers, kmer_sum and pair_sum, equal for equal indexes whatever the set ids are.

        A sum is the exclusive or of the first 60 bits of MD5 digests: of the k-mers' texts, and of those texts
        with the digest of their color list behind them.
        """
        short = lambda c: F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")
        sets = self.color_sets.select("set_id", F.md5(F.array_join(F.transform("colors", lambda c: c.cast("string")), ",")).alias("h"))
        rows = self.kmers.join(maybe_broadcast(sets), "set_id").select(self.kmer.decode(F.col("km")).alias("w"), "h")
        return rows.agg(F.count(F.lit(1)).alias("n_kmers"), F.bit_xor(short(F.col("w"))).alias("kmer_sum"), F.bit_xor(short(F.concat("w", "h"))).alias("pair_sum"))

    def difference(self, other: Index) -> DataFrame:
        """(side, km, colors) of the k-mers whose colors differ between two indexes."""
        a, b = (x.kmers.join(x.color_sets, "set_id").select("km", "colors") for x in (self, other))
        return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def load(spark: SparkSession, path: str) -> Index:
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta["version"] != VERSION:
        raise ValueError(f"index version {meta['version']} isn't {VERSION}")
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Index(read("kmers"), read("color_sets"), read("color_names"), meta["k"], meta["n_colors"], meta["both_strands"])


def load_color_names(spark: SparkSession, path: str) -> DataFrame:
    """The names alone; no other table is read."""
    return spark.read.parquet(f"{path}/color_names")


def default_names(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("color_id"), F.concat(F.lit("color_"), F.col("id").cast("string")).alias("name"))


def from_pairs(pairs: DataFrame, names: DataFrame, k: int, both_strands: bool = True, dictionary: DataFrame | None = None, exact: bool = False) -> Index:
    """Index of (km, color) rows, which may repeat.

    Pairs are shuffled once, by k-mer, and made distinct and listed where they land. A set is then known
    by two 64-bit hash sums and its size, and its list is taken from one representative k-mer. `exact` groups
    by the lists themselves. With a dictionary (km), its k-mers without a color get the empty set.
    """
    hashes = ["f1", "f2", "n"]
    keyed = sets_by_kmer(pairs)
    if dictionary is not None:
        zero = F.lit(0).cast("long")
        keyed = dictionary.select("km").distinct().join(keyed, "km", "left").select("km", *(F.coalesce(c, zero).alias(c) for c in hashes), F.coalesce("colors", F.array().cast("array<long>")).alias("colors"))
    keyed = stored(keyed, "keyed")
    key = ["colors"] if exact else hashes
    sets = stored(dense_ids(keyed.groupBy(*key).agg(F.min("km").alias("rep"), F.count(F.lit(1)).alias("n_kmers")), "rep", "set_id"), "sets")
    kmers = stored(join_sized(keyed.select("km", *key), sets.select(*key, "set_id", "n_kmers"), key, "n_kmers").select("km", "set_id"), "kmers")
    reps = maybe_broadcast(sets.select(F.col("rep").alias("km"), "set_id"))
    color_sets = keyed.select("km", "colors").join(reps, "km").select("set_id", F.size("colors").alias("size"), "colors")
    return Index(kmers, stored(color_sets, "color_sets"), names, k, names.count(), both_strands)


def n_named(top: int | None) -> int:
    """How many colors there are if the greatest is `top` (None: there is none)."""
    return 0 if top is None else top + 1


def build(seqs: DataFrame, k: int, names: DataFrame | None = None, both_strands: bool = True, dictionary: DataFrame | None = None, allow_missing: bool = False, exact: bool = False, spread: int | None = None) -> Index:
    """Index of seqs(color, seq). A dictionary (km) fixes the k-mers; input k-mers outside it are an error unless allowed."""
    own = distinct_kmers(seqs, k, "color", "seq", both_strands, spread)
    if dictionary is not None:
        own = stored(own, "pairs")
        if not allow_missing and own.select("km").join(dictionary, "km", "left_anti").take(1):
            raise ValueError("the dictionary lacks k-mers of the input")
        own = own.join(dictionary, "km", "left_semi")
    if names is None:
        names = default_names(seqs.sparkSession, n_named(seqs.agg(F.max("color")).first()[0]))
    return from_pairs(own, names, k, both_strands, dictionary, exact)


def single_color(kmers: DataFrame, k: int, name: str = "0", both_strands: bool = True) -> Index:
    """Index of a k-mer set (km) under one color."""
    spark = kmers.sparkSession
    sets = spark.createDataFrame([(0, 1, [0])], "set_id long, size int, colors array<long>")
    return Index(kmers.select("km").distinct().withColumn("set_id", F.lit(0).cast("long")), sets, spark.createDataFrame([(0, name)], "color_id long, name string"), k, 1, both_strands)


def _plus(n: int):
    return lambda c: c + n


def merge(indexes: list[Index]) -> Index:
    """Union of indexes, in order: colors are shifted by the number before them, names are concatenated.

    k-mers are brought together once; distinct combinations of set ids give the merged sets, so that no color
    list is spread over k-mers.
    """
    if not indexes:
        raise ValueError("nothing to merge")
    first = indexes[0]
    if any(x.k != first.k or x.both_strands != first.both_strands for x in indexes):
        raise ValueError("indexes differ in k or strands")
    if len(indexes) == 1:
        return first
    tagged, sets, names, before = None, None, None, 0
    for i, x in enumerate(indexes):
        own = x.kmers.select("km", F.struct(F.lit(i).alias("i"), F.col("set_id").alias("s")).alias("part"))
        shifted = x.color_sets.select(F.struct(F.lit(i).alias("i"), F.col("set_id").alias("s")).alias("part"), F.transform("colors", _plus(before)).alias("colors"))
        named = x.color_names.select((F.col("color_id") + before).alias("color_id"), "name")
        tagged = own if tagged is None else tagged.unionAll(own)
        sets = shifted if sets is None else sets.unionAll(shifted)
        names = named if names is None else names.unionAll(named)
        before += x.n_colors
    combined = stored(tagged.groupBy("km").agg(F.array_sort(F.collect_list("part")).alias("parts")), "combined")
    distinct = stored(combined.groupBy("parts").agg(F.count(F.lit(1)).alias("n_kmers")), "parts")
    # parts ascend by index and so do their colors; a stable join of the lists is the merged set
    lists = distinct.select("parts", F.explode("parts").alias("part")).join(sets, "part").groupBy("parts").agg(F.array_sort(F.flatten(F.collect_list("colors"))).alias("colors"))
    lists = stored(lists, "lists")
    ids = stored(dense_ids(lists.select("colors").distinct(), "colors", "set_id"), "merged_sets")
    by_parts = lists.join(ids, "colors").select("parts", "set_id").join(distinct, "parts")
    kmers = stored(join_sized(combined, by_parts, ["parts"], "n_kmers").select("km", "set_id"), "kmers")
    return Index(kmers, ids.select("set_id", F.size("colors").alias("size"), "colors"), names, first.k, before, first.both_strands)
