"""The k-mer window generator: the one Arrow function of the engine."""

from __future__ import annotations

import os
import tempfile
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dna import MAX_PACKED

_shipped: set[str] = set()
_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    _CODE[_b] = _CODE[_b + 32] = _i
#: Bases encoded at once; a longer sequence is cut into overlapping stretches.
STRETCH = 1 << 20


def ship(spark: SparkSession) -> None:
    """Give this package's code to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "strandbase_engine.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def encode(bases: np.ndarray, k: int, canonical: bool) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all windows and whether each is valid; bases as 0 to 3, others 4."""
    bad = np.concatenate(([0], np.cumsum(bases > 3)))
    valid = bad[k:] == bad[:-k]
    forward = (bases & 3).astype(np.int64)
    back = 3 - forward
    out_forward = out_back = None
    done, size = 0, 1  # windows of `size` bases, doubled; those that k's binary digits name are joined
    while True:
        if k & size:
            if out_forward is None:
                out_forward, out_back = forward, back
            else:
                m = len(bases) - done - size + 1
                out_forward = (out_forward[:m] << 2 * size) | forward[done : done + m]
                out_back = out_back[:m] | (back[done : done + m] << 2 * done)
            done += size
        if done == k:
            break
        m = len(bases) - 2 * size + 1
        forward, back = (forward[:m] << 2 * size) | forward[size : size + m], back[:m] | (back[size : size + m] << 2 * size)
        size *= 2
    return (np.minimum(out_forward, out_back) if canonical else out_forward), valid


def _texts(seq: bytes, k: int, canonical: bool) -> list[str | None]:
    s = seq.decode("latin-1").upper()
    r = s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    n = len(s)
    out: list[str | None] = []
    for i in range(n - k + 1):
        w = s[i : i + k]
        if w.strip("ACGT"):
            out.append(None)
        else:
            out.append(min(w, r[n - i - k : n - i]) if canonical else w)
    return out


def _source(df: DataFrame, keep: list[str], seq: str, spread: int | None) -> DataFrame:
    ship(df.sparkSession)
    src = df.select(*keep, F.col(seq).cast("binary").alias("__seq"))
    return src.repartition(spread) if spread else src


def distinct_kmers(df: DataFrame, k: int, color: str, seq: str = "seq", canonical: bool = True, spread: int | None = None) -> DataFrame:
    """(color, km) of all valid windows, each pair once for each stretch of windows that a batch holds."""
    packed = k <= MAX_PACKED
    src = _source(df.select(F.col(color).cast("long").alias("color"), F.col(seq).alias("seq")), ["color"], "seq", spread)

    def run(batches):
        colors, codes, held = [], [], 0

        def flush() -> pa.RecordBatch:
            c = np.concatenate(colors)
            if packed:
                x = np.concatenate(codes)
                order = np.lexsort((x, c))
                c, x = c[order], x[order]
                new = np.ones(len(c), bool)
                new[1:] = (c[1:] != c[:-1]) | (x[1:] != x[:-1])
                return pa.RecordBatch.from_arrays([pa.array(c[new]), pa.array(x[new])], names=["color", "km"])
            pairs = list({*zip(c.tolist(), (x for part in codes for x in part), strict=True)})
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.string())], names=["color", "km"])

        for b in batches:
            for own, s in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = s.as_py()
                if s is None or own is None or len(s) < k:
                    continue
                for a in range(0, len(s) - k + 1, STRETCH):
                    piece = s[a : a + STRETCH + k - 1]
                    if packed:
                        code, valid = encode(_CODE[np.frombuffer(piece, np.uint8)], k, canonical)
                        found = code[valid]
                    else:
                        found = [x for x in _texts(piece, k, canonical) if x is not None]
                    codes.append(found)
                    colors.append(np.full(len(found), own, np.int64))
                    held += len(found)
                    if held >= STRETCH:
                        yield flush()
                        colors, codes, held = [], [], 0
        if held:
            yield flush()

    return src.mapInArrow(run, f"color long, km {'long' if packed else 'string'}")


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each number, whose exclusive or stands for a set."""
    y = (x.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    y = (y ^ (y >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    y = (y ^ (y >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (y ^ (y >> np.uint64(31))).view(np.int64)


def sets_by_kmer(pairs: DataFrame) -> DataFrame:
    """(km, f1, f2, n, colors) for (km, color) rows: each k-mer once, with its distinct colors and two hash sums of them.

    Pairs are shuffled by k-mer and sorted where they land; then one pass over the sorted rows finds repeats
    and groups. A k-mer's colors are held at once, nothing else.
    """
    ship(pairs.sparkSession)
    kind = pairs.schema["km"].dataType.simpleString()
    km_type = pa.int64() if kind == "bigint" else pa.string()
    src = pairs.select("km", F.col("color").cast("long").alias("color")).repartition("km").sortWithinPartitions("km", "color")

    def made(kms: pa.Array, colors: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        n = np.diff(np.append(starts, len(colors)))
        sums = [np.bitwise_xor.reduceat(_mixed(colors, seed), starts) for seed in (11, 23)]
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(colors)), pa.int32()), pa.array(colors))
        return pa.RecordBatch.from_arrays([kms.take(pa.array(starts)), pa.array(sums[0]), pa.array(sums[1]), pa.array(n.astype(np.int64)), lists], names=["km", "f1", "f2", "n", "colors"])

    def run(batches):
        held: list[tuple[pa.Array, np.ndarray]] = []  # the last k-mer's rows
        for b in batches:
            if not b.num_rows:
                continue
            kms, colors = b.column(0), b.column(1).to_numpy()
            if held:
                kms, colors = pa.concat_arrays([*(k for k, _ in held), kms]), np.concatenate([*(c for _, c in held), colors])
            other = pc.not_equal(kms[1:], kms[:-1]).to_numpy(zero_copy_only=False)
            new = np.append(True, other | (colors[1:] != colors[:-1]))
            first = np.append(True, other)[new]
            kms, colors = kms.filter(pa.array(new)), colors[new]
            starts = np.flatnonzero(first)
            last = int(starts[-1])
            if len(starts) > 1:
                yield made(kms[:last], colors[:last], starts[:-1])
            held = [(kms[last:], colors[last:])]
        if held:
            yield made(held[0][0], held[0][1], np.zeros(1, np.int64))

    return src.mapInArrow(run, f"km {'long' if km_type == pa.int64() else 'string'}, f1 long, f2 long, n long, colors array<long>")


def windows(df: DataFrame, k: int, keep: list[str], seq: str = "seq", canonical: bool = True, spread: int | None = None) -> DataFrame:
    """Columns `keep`, pos and km for every window of every sequence; km is null if the window has a non-ACGT byte.

    `spread` deals the sequences over so many partitions first, for small inputs in one file.
    """
    packed = k <= MAX_PACKED
    src = _source(df, keep, seq, spread)
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("pos", T.LongType()), T.StructField("km", T.LongType() if packed else T.StringType())])
    names = [*keep, "pos", "km"]

    def run(batches):
        for b in batches:
            own, column = b.columns[:-1], b.column(b.num_columns - 1)
            rows, places, codes, fine, held = [], [], [], [], 0

            def flush() -> pa.RecordBatch:
                take = pa.array(np.concatenate(rows))
                value = np.concatenate(codes) if packed else [x for c in codes for x in c]
                km = pa.array(value, pa.int64(), mask=~np.concatenate(fine)) if packed else pa.array(value, pa.string())
                return pa.RecordBatch.from_arrays([*(c.take(take) for c in own), pa.array(np.concatenate(places)), km], names=names)

            for i in range(b.num_rows):
                s = column[i].as_py()
                if s is None or len(s) < k:
                    continue
                for a in range(0, len(s) - k + 1, STRETCH):
                    piece = s[a : a + STRETCH + k - 1]
                    n = len(piece) - k + 1
                    if packed:
                        code, valid = encode(_CODE[np.frombuffer(piece, np.uint8)], k, canonical)
                        codes.append(code)
                        fine.append(valid)
                    else:
                        codes.append(_texts(piece, k, canonical))
                    rows.append(np.full(n, i, np.int64))
                    places.append(np.arange(a, a + n, dtype=np.int64))
                    held += n
                    if held >= STRETCH:
                        yield flush()
                        rows, places, codes, fine, held = [], [], [], [], 0
            if held:
                yield flush()

    return src.mapInArrow(run, schema)
