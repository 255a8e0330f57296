"""Tables that cut lineage: written to the shared checkpoint folder and read back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it has at most this many rows (of some tens of bytes).
BROADCAST_ROWS = 500_000
#: Keys that hold more than this part of all rows are joined by broadcast; there are fewer than this many.
HOT_KEYS = 4096
_written: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local master may leave it unset: executors elsewhere share no folder of ours."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="strandbase-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        where = "file://" + own
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str, ending: str = "") -> str:
    """A new path in the shared folder, which drop() removes like a stored table."""
    path = f"{scratch_dir(spark)}/strandbase/{name}-{uuid.uuid4().hex}{ending}"
    _written.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later rounds start from it, and lost executors don't matter."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """The paths that scratch_path() has given and nobody has dropped, oldest first."""
    return list(_written)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables of stored() whose results are saved elsewhere."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
        if p in _written:
            _written.remove(p)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most `rows` rows, found without counting beyond that."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it is small; otherwise Spark's shuffled join (with skew handling) is used."""
    return F.broadcast(df) if is_small(df, rows) else df


def join_sized(rows: DataFrame, sized: DataFrame, key: list[str], size: str) -> DataFrame:
    """rows joined with sized(key, ..., size) on unique keys, where `size` says how many rows have the key.

    If `sized` is too large to broadcast, the few keys with more than their share of the rows still are, so
    that no task gets all rows of one key; the others are joined by a shuffle.
    """
    own = sized.drop(size)
    if is_small(own):
        return rows.join(F.broadcast(own), key)
    limit = (sized.agg(F.sum(size)).first()[0] or 0) // HOT_KEYS
    hot, cool = F.broadcast(own.where(sized[size] > limit)), own.where(sized[size] <= limit)
    return rows.join(hot, key).unionByName(rows.join(hot.select(*key), key, "left_anti").join(cool, key))


def dense_ids(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with `name` = 0, 1, ... in the order of the unique column `order`, without a one-task sort.

    Rows are dealt by range; each partition's count gives the next one's first id.
    """
    parts = stored(df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()), "ranged")
    sizes = sorted((r["__part"], r["n"]) for r in parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    first, total = [], 0
    for part, n in sizes:
        first.append((part, total))
        total += n
    if not first:
        return df.withColumn(name, F.lit(0).cast("long"))
    offsets = F.broadcast(df.sparkSession.createDataFrame(first, "__part int, __first long"))  # one row for each partition
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return parts.withColumn(name, rank - 1).join(offsets, "__part").withColumn(name, (F.col(name) + F.col("__first")).cast("long")).drop("__part", "__first")
