"""Language identification by rank-order n-gram profiles and the out-of-place distance.

A text's n-grams (1 to 3 letters inside words, words padded by a space on both sides) are ranked by
frequency, ties by code. Its distance to a language is the sum, over the text's first `size` n-grams, of how
far each stands from its rank in the language's profile; an absent n-gram costs `size`. The least distance
wins, ties by the language's name.

Profiles are learned from a bounded sample: for each of the `max_langs` most frequent languages, the
`sample_docs` labelled documents with the lowest hash of their id and text. Prediction reads whole texts and
nothing else.

Defined cases: a null text or one without a letter gives 'und' and score 0; so does every text if nothing
could be learned; rows with a null lang teach nothing, rows with a null id do; repeated rows teach once and
each get their own prediction; very long texts are counted in blocks; languages beyond `max_langs` are not
learned, of equally frequent ones the later by name; an empty table gives no rows and teaches nothing; extra
columns are ignored by identify() and kept by keep_known(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SIZE = 400
SAMPLE_DOCS, MAX_LANGS = 400, 256
#: Characters counted at once, so that a very long text needs little memory.
BLOCK = 1 << 20
_is_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _is_letter
    if _is_letter is None:
        _is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _is_letter


def _block_counts(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of a row of letters with single spaces (1, so that no code begins with 0) between words."""
    a = points.astype(np.int64) + 2
    a[points == 32] = 1
    two = (a[:-1] << 21) | a[1:]
    two = two[(a[:-1] != 1) | (a[1:] != 1)]
    three = ((a[:-2] << 42) | (a[1:-1] << 21) | a[2:])[a[1:-1] != 1]
    return np.unique(np.concatenate((a[a != 1], two, three)), return_counts=True)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes (ascending) and counts of all n-grams of the whole text; empty if it has no letter."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    table = _letters()
    carry = np.zeros(0, np.uint32)
    text = text.lower()
    for i in range(0, len(text), BLOCK):
        p = np.frombuffer(text[i : i + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)
        p = np.concatenate((carry, np.where(table[p], p, 32)))
        last = i + BLOCK >= len(text)
        if not last:  # the word at the block's end goes to the next one, unless it fills the block
            gaps = np.flatnonzero(p == 32)
            cut = int(gaps[-1]) if len(gaps) else len(p)
            p, carry = p[:cut], p[cut:]
        p = np.concatenate(([32], p, [32])).astype(np.uint32)
        p = p[np.concatenate(([True], (p[1:] != 32) | (p[:-1] != 32)))]
        if len(p) > 2:
            found.append(_block_counts(p))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(found) == 1:
        return found[0]
    codes, where = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    return codes, np.bincount(where, weights=np.concatenate([n for _, n in found])).astype(np.int64)


def top(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The `size` most frequent codes in rank order, ties by code."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Rank tables of all languages, laid out so that one search serves them all."""

    def __init__(self, by_lang: dict[str, list[int]], size: int = SIZE) -> None:
        self.langs, self.size = sorted(by_lang), size
        self.codes = np.unique(np.array([c for v in by_lang.values() for c in v], np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, np.array(by_lang[lang], np.int64)), k] = np.arange(len(by_lang[lang]))

    def distances(self, text: str) -> np.ndarray | None:
        """Out-of-place distance to each language over 0 to 1; None without letters."""
        own = top(*ngram_counts(text), self.size)
        if not len(own) or not self.langs:
            return None
        at = np.searchsorted(self.codes, own)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        ranks = self.ranks[at]
        far = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None]))
        return far.sum(axis=0) / (len(own) * self.size)

    def predict(self, text: bytes | None) -> tuple[str, float, dict[str, float]]:
        """Language, score (1 less the distance) and every language's score."""
        d = None if not text else self.distances(str(text, "utf-8", "replace"))
        if d is None:
            return "und", 0.0, {}
        k = int(d.argmin())
        return self.langs[k], float(1 - d[k]), dict(zip(self.langs, (1 - d).tolist(), strict=True))


def learn(df: DataFrame, train: Column | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", size: int = SIZE, sample_docs: int = SAMPLE_DOCS, max_langs: int = MAX_LANGS) -> Profiles:
    """Profiles from df's rows where `train` holds and lang isn't null.

    The sample is chosen on hashes and labels; only its texts are then counted. It has at most sample_docs *
    max_langs texts, which bounds what is broadcast; what reaches the driver is `size` n-grams for each language.
    """
    common.ship(df.sparkSession)
    rows = df.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    rows = rows.where(train) if train is not None else rows
    rows = rows.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"), F.col(f"`{doc_id}`").cast("string").alias("id"))
    rows = rows.select("lang", "text", F.xxhash64("id", "text").alias("h"))
    keys = rows.select("lang", "h")
    # each language's share of hashes holds about twice the sample, so that ranking sees few rows of any language
    common_ = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs)
    share = F.broadcast(common_.select("lang", (F.lit(2.0 * sample_docs) / F.col("n")).alias("share")))
    near = keys.join(share, "lang").where((F.col("h") / 2.0**63 + 1) / 2 < F.col("share")).distinct()
    chosen = near.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= sample_docs).select("lang", "h")
    sample = rows.join(F.broadcast(chosen), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])

    def count(batches):
        for b in batches:
            for lang_, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                codes, counts = ngram_counts(str(t, "utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "code", "n"])

    counts = sample.select("lang", F.col("text").cast("binary")).mapInArrow(count, "lang string, code long, n long")
    ranked = counts.groupBy("lang", "code").agg(F.sum("n").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code")))
    by_lang: dict[str, list[int]] = {}
    for r in sorted(ranked.where(F.col("r") <= size).collect(), key=lambda r: r["r"]):
        by_lang.setdefault(r["lang"], []).append(r["code"])
    return Profiles(by_lang, size)


def _predictor(profiles: Profiles, claimed: bool = False) -> Callable:
    def make() -> Callable:
        def f(texts: list[bytes | None]) -> list[list]:
            found = [profiles.predict(t) for t in texts]
            return [[x[0] for x in found], [x[1] for x in found], [sorted(x[2].values())[-2] if len(x[2]) > 1 else 0.0 for x in found]]

        return f

    return make


FIELDS = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("second_score", T.DoubleType())]


def identify(df: DataFrame, profiles: Profiles, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep`, lang_pred, score and the runner-up's score for every row."""
    return common.per_row(df, _predictor(profiles), FIELDS, keep, text)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(f"`{doc_id}`").cast("string")) % 3 == 1


def keep_known(df: DataFrame, profiles: Profiles, text: str = "text", lang: str = "lang", margin: float = 0.2) -> DataFrame:
    """df without the rows whose language can't be told ('und') or is clearly not the one they state.

    A stated language is contradicted if another wins by more than `margin` of score over the runner-up.
    """
    columns = df.columns
    inner = [f"__c{i}" for i in range(len(columns))]
    plain = df.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(columns, inner, strict=True)), F.col(f"`{lang}`").alias("__lang"))
    rows = identify(plain, profiles, [*inner, "__lang"], inner[columns.index(text)])
    wrong = F.coalesce((F.col("__lang") != F.col("lang_pred")) & (F.col("score") - F.col("second_score") > margin), F.lit(False))
    return rows.where((F.col("lang_pred") != "und") & ~wrong).select(*(F.col(i).alias(c) for c, i in zip(columns, inner, strict=True)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = learn(docs, ~F.coalesce(held_out(), F.lit(False)))
    return identify(docs.withColumn("held_out", F.coalesce(held_out(), F.lit(False))), profiles, ["doc_id", "held_out"])
