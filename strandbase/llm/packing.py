"""Concatenate and cut: documents packed into sequences of a fixed length with global token offsets.

Pass one tokenizes every text once and stores the ids with their start inside the partition. The partitions'
totals (two numbers for each input split) give each partition's global offset by a prefix sum. Pass two adds
the offset and cuts each document at the multiples of the sequence length; a document that crosses a cut
yields one record for each sequence that it touches. Only the very last sequence can need padding: to the
full length, unless its own length is a power of two.

Defined cases: a null or empty text is the end id alone; a null id is kept; a very long text fills many
sequences; repeated rows are packed one by one, in the order of the scan; an empty table gives no pieces; extra
columns are ignored, whatever their names. The driver holds one number for each input split.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .lexicon import PLAIN, byte_letters, latin_cut

LENGTH, END_ID, CACHE = 1024, 0, 150_000
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
#: The pre-tokenizer's pattern, a fixed value of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{L}]+| ?[\p{N}]+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def is_byte_level(spec: dict) -> bool:
    """Whether a tokenizer's file says that pre-tokens are cut by PATTERN alone and merged by plain BPE."""
    cut, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    return not spec.get("normalizer") and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and model.get("type") == "BPE" and plain


class WordIds(dict):
    """Ids, as little-endian bytes, of a pre-token with its leading space; a bounded cache that only saves work.

    A tokenizer that isn't is_byte_level() encodes whole texts itself. Otherwise texts of the scripts that lexicon.PLAIN names are cut by one pattern. Others are cut where a single space
    stands between two characters that aren't white space, which no pre-token crosses, and encoded by the
    library, as are texts that hold an added token.
    """

    def __init__(self, path: str, size: int) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            self.known = is_byte_level(json.load(f))
        self.model = self.library.model
        self.kind = "H" if self.library.get_vocab_size(with_added_tokens=True) <= 65536 else "I"
        self.size = size
        self.bytes = byte_letters()
        self.cut = latin_cut(PATTERN)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def raw(self, text: str) -> bytes:
        return array(self.kind, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.size:
            self.clear()
        ids = self[word] = array(self.kind, [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.bytes))]).tobytes()
        return ids

    def of(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.known or any(a in text for a in self.added):
            return self.raw(text)
        if PLAIN.fullmatch(text):
            return b"".join(map(self.__getitem__, self.cut.findall(text)))
        first, *rest = _SINGLE.split(text)
        return b"".join([self.raw(first), *(self.raw(" " + w) if not PLAIN.fullmatch(w) else b"".join(map(self.__getitem__, self.cut.findall(" " + w))) for w in rest)])


_words: dict[tuple, WordIds] = {}


def _word_ids(path: str, size: int) -> WordIds:
    if (path, size) not in _words:
        _words[path, size] = WordIds(path, size)
    return _words[path, size]


def tokenized(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, cache: int = CACHE) -> DataFrame:
    """(part, start, doc_id, n, ids): ids as bytes, start counted inside the partition."""
    common.ship(df.sparkSession)
    src = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("t"))
    kind = df.schema[doc_id].dataType.simpleString()
    names = ["part", "start", "doc_id", "n", "ids"]

    def run(batches):
        words, start, part = _word_ids(path, cache), 0, TaskContext.get().partitionId()
        end = array(words.kind, [end_id]).tobytes()
        for b in batches:
            for piece in common.sliced(b):
                ids = [words.of(str(t or b"", "utf-8", "replace")) + end for t in piece.column(1).to_pylist()]
                n = np.array([len(x) // len(end) for x in ids], np.int64)
                starts = start + np.cumsum(n) - n
                start += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int64)), pa.array(starts), piece.column(0), pa.array(n), pa.array(ids, pa.binary())], names=names)

    return src.mapInArrow(run, f"part long, start long, doc_id {kind}, n long, ids binary")


def cut(doc: int, first: int, n: int, ids: np.ndarray, length: int) -> list[tuple]:
    """The pieces of one document whose ids begin at the global offset `first`."""
    wide = memoryview(ids.astype("<u4")).cast("B") if n else memoryview(b"")
    out, at = [], 0
    while at < n:
        sequence, offset = divmod(first + at, length)
        size = min(length - offset, n - at)
        out.append((doc, at, size, zlib.crc32(wide[4 * at : 4 * (at + size)]), n, sequence, offset))
        at += size
    return out


def pack(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to, and with `with_ids` the ids.

    padded_to is the length that the piece's sequence has with padding.
    """
    rows = common.stored(tokenized(df, path, doc_id, text, end_id), "ids")
    kind = df.schema[doc_id].dataType.simpleString()
    totals = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.max(F.col("start") + F.col("n")).alias("n")).collect())
    offsets, total = {}, 0
    for part, n in totals:
        offsets[part] = total
        total += n
    tail = total % length
    padded = tail if tail and tail & (tail - 1) == 0 else length
    last = total // length
    sent = df.sparkSession.sparkContext.broadcast(offsets)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_to"] + ["ids"] * with_ids

    def run(batches):
        for b in batches:
            done: list[tuple] = []
            own: list[np.ndarray] = []
            ids_kind: pa.DataType = b.schema.field(2).type
            def rest() -> pa.RecordBatch:
                cols = list(zip(*done, strict=True))
                arrays = [pa.array(cols[0], ids_kind), *(pa.array(c, pa.int64()) for c in cols[1:]), pa.array([padded if s == last else length for s in cols[5]], pa.int64())]
                if with_ids:
                    arrays.append(pa.array(own, pa.list_(pa.int64())))
                return pa.RecordBatch.from_arrays(arrays, names=names)
            for part, start, doc, n, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")
                pieces = cut(doc, sent.value[part] + start, n, ids, length)
                done += pieces
                if with_ids:
                    own += [ids[p[1] : p[1] + p[2]].astype(np.int64) for p in pieces]
                if len(done) >= 20_000:
                    yield rest()
                    done, own = [], []
            if done:
                yield rest()

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long" + ", ids array<long>" * with_ids
    return rows.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
