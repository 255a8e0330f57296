"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

A first pass over all texts finds frequent words (pre-tokens after normalisation). They and their ids are
compiled into a minimal acyclic automaton that shares suffixes; a path through it adds up to the word's
number, and the number gives the ids. The automaton is one file, which Spark gives to each executor once and all
its workers map into memory. Words that it doesn't hold are merged exactly; a bounded cache holds what a worker
has found either way. Texts of the scripts in PLAIN are
cut by one pattern; others are normalised and cut by the library between their spaces, which no word crosses.
Texts of added tokens are taken out first, as the library does.

Decoding joins the ids' pieces by the model's decoder; word_bpe_49k.json names none, so pieces are joined by
one space, as the library does.

Tokenizers of another build than word_bpe_49k.json's (its normalizer, cut and added tokens) are refused.

Defined cases: a null or empty text has no ids and decodes to the empty text; repeated rows are encoded one
by one; a very long text is handled word by word; of equally frequent words any may be in the lexicon, which
changes no id; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import atexit
import functools
import hashlib
import mmap
import os
import re
import shutil
import struct
import tempfile
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import public_tokenizers
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common
from .tokencount import frequent_words

WORDS, CACHE = 32_768, 400_000
_MAGIC = b"MAT1"


# ---- the automaton -------------------------------------------------------------------------------------


def _minimal(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool], int]:
    """States (label -> state), finals and the root of the minimal automaton of sorted distinct words."""
    edges: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path = [0]  # states along the last word
    last = b""

    def freeze(depth: int) -> None:
        while len(path) - 1 > depth:
            state = path.pop()
            key = (final[state], tuple(edges[state].items()))
            same = register.setdefault(key, state)
            if same != state:
                edges[path[-1]][last[len(path) - 1]] = same

    for w in words:
        common_ = os.path.commonprefix((w, last))
        freeze(len(common_))
        for c in w[len(common_) :]:
            edges.append({})
            final.append(False)
            edges[path[-1]][c] = len(edges) - 1
            path.append(len(edges) - 1)
        final[path[-1]] = True
        last = w
    freeze(0)
    return edges, final, 0


def compile_lexicon(entries: dict[str, list[int]]) -> bytes:
    """The transducer of word -> ids as one run of bytes.

    For each state: where its edges begin and whether a word ends there. For each edge: label, target and how
    many words lie before it among those of its state. Then where each word's ids begin, and all ids.
    """
    keyed = sorted((w.encode(), ids) for w, ids in entries.items())
    edges, final, root = _minimal([w for w, _ in keyed])
    order, place = [root], {root: 0}
    for s in order:
        for t in edges[s].values():
            if t not in place:
                place[t] = len(order)
                order.append(t)
    below: dict[int, int] = {}
    stack = [root]
    while stack:  # words below each state, children first
        s = stack[-1]
        todo = [t for t in edges[s].values() if t not in below]
        if todo:
            stack.extend(todo)
            continue
        stack.pop()
        below[s] = final[s] + sum(below[t] for t in edges[s].values())
    begin, ends, labels, targets, before = array("I"), bytearray(), bytearray(), array("I"), array("I")
    for s in order:
        begin.append(len(labels))
        ends.append(final[s])
        n = int(final[s])
        for c, t in sorted(edges[s].items()):
            labels.append(c)
            targets.append(place[t])
            before.append(n)
            n += below[t]
    begin.append(len(labels))
    starts, flat = array("I", [0]), array("I")
    for _, ids in keyed:
        flat.extend(ids)
        starts.append(len(flat))
    parts = [begin.tobytes(), targets.tobytes(), before.tobytes(), starts.tobytes(), flat.tobytes(), bytes(ends), bytes(labels)]
    return _MAGIC + struct.pack("<8I", max((len(w) for w, _ in keyed), default=0), *map(len, parts)) + b"".join(parts)


class Lexicon:
    """A compiled transducer, from its bytes or the path of a file that is mapped into memory."""

    def __init__(self, source: bytes | str) -> None:
        if isinstance(source, bytes):
            self.map = source
        else:
            with open(source, "rb") as f:
                self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self.map[:4] != _MAGIC:
            raise ValueError("not a lexicon")
        self.longest, *sizes = struct.unpack("<8I", self.map[4:36])
        view, at, parts = memoryview(self.map), 36, []
        for n in sizes:
            parts.append((at, view[at : at + n]))
            at += n
        self.begin, self.targets, self.before, self.starts, self.ids = (p.cast("I") for _, p in parts[:5])
        self.ends, self.labels = parts[5][1], parts[6][0]

    def number(self, word: bytes) -> int | None:
        """The word's place among the sorted words, or None."""
        state = total = 0
        if len(word) > self.longest:
            return None
        for k in range(len(word)):
            at = self.map.find(word[k : k + 1], self.labels + self.begin[state], self.labels + self.begin[state + 1])
            if at < 0:
                return None
            at -= self.labels
            total += self.before[at]
            state = self.targets[at]
        return total if self.ends[state] else None

    def get(self, word: str) -> list[int] | None:
        n = self.number(word.encode("utf-8", "surrogatepass"))
        return None if n is None else self.ids[self.starts[n] : self.starts[n + 1]].tolist()


# ---- exact merging ------------------------------------------------------------------------------------


#: Letters of scripts where normal forms, lower case and classes are those of single characters.
PLAIN = re.compile("[\t-\r\x20-\x7e\xa1-\u012f\u0131-\u017f]*")


def byte_letters() -> dict[int, str]:
    """The byte alphabet: printable bytes stand for themselves, the others follow from U+0100 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(other)}


def latin_cut(pattern: str) -> re.Pattern:
    """The pre-tokenizer's pattern with its classes spelled out for the letters of PLAIN."""
    kinds = {k: "".join(re.escape(chr(c)) for c in range(0x21, 0x180) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    return re.compile(pattern.replace(r"\p{L}", kinds["L"]).replace(r"\p{N}", kinds["N"]))


def is_word_level(spec: dict) -> bool:
    """Whether a tokenizer's file says what Codec relies on: NFC, white space to one space, lower case; words cut by a pattern; plain added tokens."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    white = [s.get("content") for s in steps if s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"}]
    split, *rest = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    cut = split.get("type") == "Split" and "Regex" in split["pattern"] and split["behavior"] == "Removed" and split["invert"]
    letters = [s["type"] for s in rest] == ["ByteLevel"] and not rest[0]["add_prefix_space"] and not rest[0].get("use_regex", True)
    plain = not any(t[k] for t in spec["added_tokens"] for k in ("normalized", "lstrip", "rstrip", "single_word"))
    model = spec["model"]
    return [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and white == [" "] and cut and letters and plain and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "byte_fallback"))


class Codec:
    """Encodes single words as the library does, from the tokenizer's own file."""

    def __init__(self, path: str) -> None:
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not is_word_level(spec):
            raise ValueError("the lexicon serves tokenizers that normalise, cut and merge words as word_bpe_49k.json does")
        self.model = self.library.model
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces = {i: t for t, i in self.library.get_vocab(with_added_tokens=True).items()}
        self.bytes = byte_letters()
        self.letters = {ord(c): b for b, c in self.bytes.items()}
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex", "")
        self.cut = latin_cut(split) if split else None

    def merge(self, word: str) -> list[int]:
        """The word's ids by the model's own merges; words are put into the byte alphabet first."""
        if not (word.isascii() and word.isprintable()):
            word = word.encode().decode("latin-1").translate(self.bytes)
        return [t.id for t in self.model.tokenize(word)]

    def words(self, text: str) -> list[str]:
        """The text's words: normalised pre-tokens and added tokens, in order."""
        if any(a in text for a in self.added):
            parts = self.special.split(text)
            return [w for k, p in enumerate(parts) for w in ([p] if k % 2 else self.words(p))]
        if self.cut is not None and PLAIN.fullmatch(text):
            return self.cut.findall(text.lower())
        out: list[str] = []
        for run in text.split(" "):
            if self.cut is not None and PLAIN.fullmatch(run):
                out += self.cut.findall(run.lower())
                continue
            normal = self.library.normalizer.normalize_str(run) if self.library.normalizer else run
            out += [p.translate(self.letters).encode("latin-1").decode() for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def encode(self, word: str) -> list[int]:
        """Ids of one word of words()."""
        return [self.added[word]] if word in self.added else self.merge(word)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _worker(path: str, name: str, size: int) -> dict[str, tuple[int, str, str]]:
    """A word's number of ids, its ids and its pieces, each joined by a space, kept in a bounded cache."""

    class Known(dict):
        def __init__(self) -> None:
            super().__init__()
            self.lexicon, self.codec = Lexicon(SparkFiles.get(name)), codec(path)

        def __missing__(self, word: str) -> tuple[int, str, str]:
            ids = self.lexicon.get(word)
            if ids is None:
                ids = self.codec.encode(word)
            pieces = self.codec.pieces
            if len(self) >= size:
                self.clear()
            got = self[word] = (len(ids), " ".join(map(str, ids)), " ".join([pieces[i] for i in ids]))
            return got

    return Known()


_workers: dict[tuple, dict] = {}


def _make(path: str, name: str, size: int, full: bool) -> Callable:
    key = (path, size, name)

    def make() -> Callable:
        if key not in _workers:  # a worker's next tasks find what it has learned; one cache at a time
            _workers.clear()
            _workers[key] = _worker(path, name, size)
        known = _workers[key]

        def one(text: bytes | None) -> tuple:
            got = list(map(known.__getitem__, known.codec.words(str(text or b"", "utf-8", "replace"))))
            sizes, ids, decoded = zip(*got, strict=True) if got else ((), (), ())
            n, ids, decoded = sum(sizes), " ".join(ids), " ".join(decoded)
            if full:
                return n, [int(i) for i in ids.split()], decoded
            return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

        return lambda texts: list(zip(*map(one, texts), strict=True)) if texts else [[], [], []]

    return make


def build(df: DataFrame, path: str, text: str = "text", size: int = WORDS) -> bytes:
    """The lexicon of df's frequent words under the tokenizer of `path`."""
    own = codec(path)
    return compile_lexicon({w: own.encode(w) for w in frequent_words(df, text, size, functools.partial(_words, path))})


def _words(path: str, text: str) -> list[str]:
    return codec(path).words(text)


def given_out(spark: SparkSession, blob: bytes) -> str:
    """The name under which every executor finds the bytes as a file; Spark copies it to those that come later, too."""
    name = f"lexicon-{hashlib.sha256(blob).hexdigest()[:32]}"
    own = tempfile.mkdtemp()  # the driver's copy, which Spark serves
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    with open(os.path.join(own, name), "wb") as f:
        f.write(blob)
    if not any(x.endswith(name) for x in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(os.path.join(own, name))
    return name


def encode(df: DataFrame, path: str, keep: list[str], text: str = "text", full: bool = True, size: int = WORDS, cache: int = CACHE) -> DataFrame:
    """Columns `keep`, n_tokens and either ids and decoded, or (not full) their SHA-256 digests."""
    name = given_out(df.sparkSession, build(df, path, text, size))
    fields = [("n_tokens", T.LongType()), ("ids", T.ArrayType(T.LongType())), ("decoded", T.StringType())]
    digests = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return common.per_row(df, _make(path, name, cache, full), fields if full else digests, keep, text)


def decode(df: DataFrame, path: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """Columns `keep` and the decoded text of an array of ids (null: empty)."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    common.ship(df.sparkSession)
    src = df.select(*keep, F.col(f"`{ids}`").alias("__ids"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("decoded", T.StringType())])

    def run(batches: Iterator) -> Iterator:
        codec = Codec(path)
        for b in batches:
            texts = [codec.library.decode(x or [], skip_special_tokens=False) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "decoded"])

    return src.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), ["doc_id"], full=False)
