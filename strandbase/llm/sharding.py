"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Rows with equal texts are a group. Groups are found by a hash of the text (a clash only makes two groups
share a place). Every group above a small share of a shard, of which there can only be a bounded number, is an
item of its own; in a table of few groups that is every group. The groups below it are dealt by that hash into
a fixed number of cells, each an item. A group too large for one shard is cut into cells by a hash of the row's
number, each an item, so that identical rows part as well. Items, the largest first, go to the shard whose
residual capacity has the greatest dot product with the item; moves and swaps of items then narrow the gap in
bytes. What the driver sees is bounded by the parameters and one line for each ROWS_AT_ONCE rows.

The law is `bytes`: the shards' sizes are near equal. Equal texts share a shard unless their group alone is
more than one shard can hold. Tokens are the pre-tokens that byte-level BPE cuts a text into.

Defined cases: a null text has no bytes (size 8, checksum 0) and is one group; a null id is an id like others;
repeated rows are placed one by one; ties between shards go to the first, between items to the one of the
lower number; very long texts are groups of their own; an empty table gives no rows; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 24
#: Cells that small groups are dealt into, and the share of a shard above which a group is an item.
CELLS, LARGE = 8192, 1 / 512
#: Row cells of each group that is itself more than a shard, for each shard's worth of it.
SPLIT = 64
ROUNDS = 4000
#: Rows that one task numbers; an item of more is numbered in parts.
ROWS_AT_ONCE = 1 << 20
#: Pre-tokens of byte-level BPE, a fixed value but for the contractions, which stand with the words here.
PRE_TOKENS = r"\\p{L}+|\\p{N}+|[^\\s\\p{L}\\p{N}]+"


def tokens_of(text: str) -> Column:
    """How many pre-tokens a text has; null has none."""
    return F.expr(f"coalesce(regexp_count(`{text}`, '{PRE_TOKENS}'), 0)").cast("long")


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (a row of bytes, tokens, rows) by greatest dot product with residual capacity."""
    total = items.sum(axis=0)
    scaled = items / np.maximum(total / shards, 1e-9)
    left = np.ones((shards, items.shape[1]))
    where = np.zeros(len(items), np.int64)
    for k in np.argsort(-scaled.max(axis=1), kind="stable"):
        s = int((left @ scaled[k]).argmax())
        where[k] = s
        left[s] -= scaled[k]
    return where


def level(items: np.ndarray, where: np.ndarray, shards: int, rounds: int = ROUNDS) -> np.ndarray:
    """Move or swap single items between the fullest and the emptiest shard in bytes while that helps."""
    where = where.copy()
    size = items[:, 0].astype(np.float64)
    load = np.bincount(where, weights=size, minlength=shards)
    for _ in range(rounds):
        a, b = int(load.argmax()), int(load.argmin())
        gap = load[a] - load[b]
        mine, theirs = np.flatnonzero(where == a), np.flatnonzero(where == b)
        # the best change is the one that shifts half the gap; a swap shifts the difference of two items
        other = np.concatenate(([0.0], size[theirs]))
        order = np.argsort(other, kind="stable")
        want = size[mine] - gap / 2
        at = np.clip(np.searchsorted(other[order], want), 0, len(order) - 1)
        lower = np.maximum(at - 1, 0)
        near = np.where(np.abs(other[order][at] - want) < np.abs(other[order][lower] - want), at, lower)
        shift = size[mine] - other[order][near]
        rest = np.abs(gap - 2 * shift)
        if not len(rest) or rest.min() >= gap - 1e-9:
            break
        k = int(rest.argmin())
        j = int(order[near[k]])
        where[mine[k]] = b
        if j:
            where[theirs[j - 1]] = a
        load[a] -= shift[k]
        load[b] += shift[k]
    return where


def assign(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, tokens: Column | None = None, cells: int = CELLS) -> DataFrame:
    """doc_id, size, text_crc32, n_tokens, shard and slot for every row."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        (F.octet_length(t) + 8).cast("long").alias("size"),
        F.crc32(t).alias("text_crc32"),
        (tokens_of(text) if tokens is None else tokens).cast("long").alias("n_tokens"),
        F.xxhash64(F.col(f"`{text}`").isNull(), t).alias("group"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = common.stored(rows, "rows")  # from here on a row's number is fixed
    sums = [F.sum("size").alias("b"), F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")]
    total = rows.agg(*sums).first()
    if not total["n"]:
        return rows.select("doc_id", "size", "text_crc32", "n_tokens", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    fair = [max(1.0, (total[c] or 0) / shards) for c in ("b", "t", "n")]
    share = F.greatest(*(F.col(c) / F.lit(f) for c, f in zip(("b", "t", "n"), fair, strict=True)))
    # at most 3 * shards / LARGE groups can be as large as this
    large = rows.groupBy("group").agg(*sums).select("group", share.alias("share")).where(F.col("share") > LARGE).collect()
    at, spec = cells, []
    for r in sorted(large, key=lambda r: r["group"]):
        parts = int(np.ceil(r["share"])) * SPLIT if r["share"] > 1 else 1
        spec.append((r["group"], at, parts))
        at += parts
    spark = df.sparkSession
    by_row = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), F.col("row")), n)
    small = F.pmod(F.xxhash64(F.lit(1), F.col("group")), F.lit(cells))
    if spec:
        big = F.broadcast(spark.createDataFrame(spec, "group long, first long, parts long"))
        rows = rows.join(big, "group", "left").withColumn("item", F.coalesce(F.col("first") + by_row(2, F.col("parts")), small))
    else:
        rows = rows.withColumn("item", small)
    counted = sorted(tuple(r) for r in rows.groupBy("item").agg(*sums).collect())
    items = np.array([c[1:] for c in counted], np.float64)
    where = level(items, place(items, shards), shards)
    # units are what slots are counted in: an item, or parts of one with many rows
    units, at = [], 0
    for (item, _, _, n), s in zip(counted, where.tolist(), strict=True):
        parts = -(-n // ROWS_AT_ONCE)
        units.append((item, s, at, parts))
        at += parts
    rows = rows.join(F.broadcast(spark.createDataFrame(units, "item long, shard int, unit_first long, unit_parts long")), "item")
    rows = rows.withColumn("unit", F.col("unit_first") + by_row(3, F.col("unit_parts")))
    if at == len(units):
        sizes = {u: n for u, (_, _, _, n) in enumerate(counted)}
    else:
        sizes = {r["unit"]: r["n"] for r in rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).collect()}
    used, before = [0] * shards, []
    for _, s, first, parts in units:
        for u in range(first, first + parts):
            before.append((u, used[s]))
            used[s] += sizes.get(u, 0)
    rows = rows.join(F.broadcast(spark.createDataFrame(before, "unit long, before long")), "unit")
    nth = F.row_number().over(Window.partitionBy("unit").orderBy("row"))
    return rows.select("doc_id", "size", "text_crc32", "n_tokens", "shard", (F.col("before") + nth - 1).alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    rows = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
