"""Token counts by a two-tier lookup on the map side; pre-tokens are never shuffled.

A text is cut into pre-tokens where a space follows a character that is no space; the vocabulary has no piece
with a space behind another character (checked when the model is loaded), so no merge crosses such a cut and
the pieces' counts add up exactly. A first pass over all texts finds frequent pre-tokens: each task keeps a
bounded table and emits one summary, and summaries meet in a fixed number of rows. The merged table of
lengths, sorted by 64-bit hash, is broadcast. The second pass looks every pre-token up there, then in the
worker's own cache, and encodes only what both miss.

Defined cases: a null or empty text has 0 tokens; a text that ends in spaces or holds the vocabulary's own
space mark is encoded whole by the library; repeated rows are counted one by one; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Pre-tokens in the broadcast table, kept in each summary, and in a worker's cache.
FREQUENT, SUMMARY, CACHE = 65_536, 16_384, 600_000
#: Rows in which the tasks' summaries meet.
MEETING = 16
LIMIT = 4096
MARK = "▁"
_CUT = re.compile(r"(?<=[^ ]) ")
_models: dict[str, object] = {}


def model(path: str):
    """The SentencePiece model of a file, loaded once in each process; its cuts are checked."""
    if path not in _models:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        if any(MARK in m.id_to_piece(i).lstrip(MARK) for i in range(m.vocab_size())):
            raise ValueError("the vocabulary has pieces that cross words; pre-tokens can't be counted one by one")
        _models[path] = m
    return _models[path]


def pretokens(text: str) -> list[str] | None:
    """The pre-tokens of a text without their leading space; None if the text must be encoded whole."""
    if not text:
        return []
    if text[-1] == " " or MARK in text:
        return None
    return _CUT.split(text) if "  " in text or text[0] == " " else text.split(" ")


def _summaries(df: DataFrame, text: str, cut: Callable) -> DataFrame:
    """One row for each of MEETING slots: pre-tokens and counts as arrays."""
    schema = "slot int, words array<string>, counts array<long>"

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(cut(str(t, "utf-8", "replace")) or ())
            if len(seen) > 16 * SUMMARY:
                seen = Counter(dict(seen.most_common(4 * SUMMARY)))
        best = seen.most_common(SUMMARY)
        if best:
            k = TaskContext.get().partitionId() % MEETING
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([[w for w, _ in best]]), pa.array([[n for _, n in best]], pa.list_(pa.int64()))], names=["slot", "words", "counts"])

    def meet(batches):
        slots: dict[int, Counter] = {}
        for b in batches:
            for k, words, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                mine = slots.setdefault(k, Counter())
                for w, n in zip(words, counts, strict=True):
                    mine[w] += n
                if len(mine) > 4 * SUMMARY:
                    slots[k] = Counter(dict(mine.most_common(2 * SUMMARY)))
        for k, mine in slots.items():
            best = mine.most_common(SUMMARY)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([[w for w, _ in best]]), pa.array([[n for _, n in best]], pa.list_(pa.int64()))], names=["slot", "words", "counts"])

    common.ship(df.sparkSession)
    own = df.select(F.col(f"`{text}`").cast("binary").alias("t")).mapInArrow(count, schema)
    return own.repartition(MEETING, "slot").mapInArrow(meet, schema)


def frequent_words(df: DataFrame, text: str = "text", size: int = FREQUENT, cut: Callable = pretokens) -> list[str]:
    """The most frequent pre-tokens (as `cut` makes them) of all texts, as far as bounded summaries tell; most frequent first.

    The list only decides what is looked up first; counts are exact whatever it holds.
    """
    total: Counter = Counter()
    for r in _summaries(df, text, cut).toLocalIterator():
        for w, n in zip(r["words"], r["counts"], strict=True):
            total[w] += n
    return [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:size]]


def compact(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) and token counts of words; words whose hashes clash are left out."""
    counts = np.array([len(x) for x in model(path).encode(words, num_threads=1)], np.uint32) if words else np.zeros(0, np.uint32)
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    order = np.argsort(h, kind="stable")
    h, counts = h[order], counts[order]
    same = np.zeros(len(h), bool)
    if len(h) > 1:
        same[1:] |= h[1:] == h[:-1]
        same[:-1] |= h[1:] == h[:-1]
    return h[~same], counts[~same]


def _make(path: str, table, size: int) -> Callable:
    class Lengths(dict):
        """The worker's cache: a miss asks the broadcast table, then the library."""

        def __init__(self) -> None:
            super().__init__()
            self.hashes, self.counts = table.value
            self.model = model(path)

        def __missing__(self, word: str) -> int:
            n = len(self.model.encode(word))
            if len(self) >= size:
                self.clear()
            self[word] = n
            return n

        def learn(self, words: set[str]) -> None:
            """Take what the broadcast table has of these words and encode the rest in one call."""
            new = [w for w in words if w not in self]
            if not new:
                return
            if len(self) + len(new) > size:
                self.clear()
                new = list(words)
            h = np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))
            at = np.searchsorted(self.hashes, h)
            at[at == len(self.hashes)] = 0
            known = self.hashes[at] == h if len(self.hashes) else np.zeros(len(new), bool)
            got = self.counts[at] if len(self.hashes) else h
            missed = [w for w, k in zip(new, known.tolist(), strict=True) if not k]
            self.update(zip(missed, map(len, self.model.encode(missed, num_threads=1)), strict=True))
            self.update((w, n) for w, n, k in zip(new, got.tolist(), known.tolist(), strict=True) if k)

    def make() -> Callable:
        lengths = Lengths()

        def one(text: bytes | None) -> int:
            if not text:
                return 0
            s = str(text, "utf-8", "replace")
            words = pretokens(s)
            if words is None:
                return len(lengths.model.encode(s))
            if len(words) <= size // 4:
                lengths.learn(set(words))
                return sum(map(lengths.__getitem__, words))
            return sum(lengths[w] for w in words)

        return lambda texts: [[len(t or b"") for t in texts], [one(t) for t in texts]]

    return make


FIELDS = [("n_bytes", T.LongType()), ("n_tokens", T.LongType())]


def count_tokens(df: DataFrame, path: str, keep: list[str], text: str = "text", frequent: int = FREQUENT, cache: int = CACHE) -> DataFrame:
    """Columns `keep`, n_bytes and n_tokens for every row, as the model of `path` has them."""
    table = df.sparkSession.sparkContext.broadcast(compact(frequent_words(df, text, frequent), path))
    return common.per_row(df, _make(path, table, cache), FIELDS, keep, text)


def query(spark, sf_dir: str) -> DataFrame:
    rows = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])
    return rows.withColumn("over_limit", F.col("n_tokens") > LIMIT)
