"""Shared plumbing of the corpus operators: scratch tables, batch helpers, code shipping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.windows import ship
from ..plans import store
from ..plans.store import is_small, maybe_broadcast, scratch_dir, stored

__all__ = ["Batches", "arrow_type", "is_small", "maybe_broadcast", "per_row", "scratch_dir", "settled", "ship", "sliced", "stored"]

Batches = Iterator[pa.RecordBatch]


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() gives as a stored table; the scratch tables that were written on the way are removed."""
    before = set(store.written())
    out = stored(make(), name)
    *rest, _ = store.written()
    store.drop(out.sparkSession, [p for p in rest if p not in before])
    return out


def per_row(df: DataFrame, make: Callable, fields: list[tuple[str, T.DataType]], keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` of df plus one new column for each field, computed in Arrow batches.

    make() is called once in each task and returns a function from a list of texts (bytes, or None for
    null) to one list for each field. Only `keep` and `text` are read, so other columns can't clash. A text
    that is kept reaches the worker once.
    """
    ship(df.sparkSession)
    cols = [F.col(f"`{c}`") for c in keep]
    if text in keep and isinstance(df.schema[text].dataType, T.StringType | T.BinaryType):
        at, src = keep.index(text), df.select(*cols)
    else:
        at, src = len(keep), df.select(*cols, F.col(f"`{text}`").cast("binary").alias("__text"))
    n_kept = len(keep)
    schema = T.StructType([*src.schema.fields[:n_kept], *(T.StructField(n, t) for n, t in fields)])
    kinds = [arrow_type(t) for _, t in fields]
    names = [*keep, *(n for n, _ in fields)]

    def run(batches: Batches) -> Batches:
        f = make()
        for b in batches:
            for part in sliced(b):
                out = f(part.column(at).cast(pa.binary()).to_pylist())
                made = [pa.array(v, k) for v, k in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n_kept], *made], names=names)
        pa.default_memory_pool().release_unused()

    return src.mapInArrow(run, schema)


def arrow_type(t: T.DataType) -> pa.DataType:
    plain = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.StringType: pa.string(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary()}
    return pa.list_(arrow_type(t.elementType)) if isinstance(t, T.ArrayType) else plain[type(t)]


def sliced(b: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that few pieces hold more than `most` bytes; a single huge row stays whole."""
    n = max(1, -(-b.nbytes // most))
    step = max(1, -(-b.num_rows // n))
    for i in range(0, b.num_rows, step):
        yield b.slice(i, step)
