"""Host-level quality rules: failures by host, rates shrunk by an empirical beta prior, verdicts joined back.

Every document is measured once. A document fails a rule by its own figures. Failures are counted by host,
a beta prior is fitted to the hosts' rates by the method of moments, and a host is rejected as a whole if its
rate is above `host_limit` even two standard deviations below its posterior mean: few documents don't condemn a
host, many do. A document is kept if it fails no rule and its host isn't rejected.

Defined cases: a null or empty text has no words, so it fails the base rule; a null host is a host of its
own; a rate that just meets the limit isn't above it; repeated rows are measured and counted one by one; very
long texts are measured whole; an empty table gives an empty result; extra columns are ignored by quality() and
kept by keep_good(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"

FIELDS = [(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")]


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    v = len(number)
    pair = ids[:-2] * v + ids[1:-1]
    if v > 1_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    code = pair * v + ids[2:]
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """The figures named in FIELDS for one UTF-8 text."""
    if not text:
        return (0,) * len(FIELDS)
    words = text.split()
    bare = text.translate(None, _SPACE)
    chars = len(str(bare, "utf-8", "replace"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper = len(bare) - len(bare.translate(None, _UPPER))
    letters = upper + len(bare) - len(bare.translate(None, _LOWER))
    symbols = len(bare) - len(bare.translate(None, _SYMBOLS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words), len(lines), upper, letters


def _make() -> Callable:
    return lambda texts: list(zip(*map(measure, texts), strict=True)) if texts else [[] for _ in FIELDS]


def measured(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` and the figures of FIELDS for every row."""
    return common.per_row(df, _make, FIELDS, keep, text)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules(symbol_rate: float, line_rate: float, shout_rate: float, word_length: tuple[float, float]) -> Column:
    """True where the document fails a rule by its own figures."""
    w = F.col("n_words")
    return (
        base_failed()
        | (F.col("n_symbols") > symbol_rate * w)
        | (F.col("n_dup_lines") > line_rate * F.col("n_lines"))
        | (F.col("n_upper") > shout_rate * F.col("n_letters"))
        | (F.col("word_chars") < word_length[0] * w)
        | (F.col("word_chars") > word_length[1] * w)
    )


#: Limits of the documents' own rules.
LIMITS = {"symbol_rate": 0.2, "line_rate": 0.5, "shout_rate": 0.5, "word_length": (2.0, 20.0)}


def host_key(host: str) -> Column:
    return F.coalesce(F.concat(F.lit("h"), F.col(f"`{host}`").cast("string")), F.lit("null"))


def host_rates(failed: DataFrame) -> DataFrame:
    """From (host, failed): host, n, bad, rate (the posterior mean) and least (two standard deviations below).

    The prior is a beta law with the mean m of the hosts' rates and the strength that the rates' variance
    v leaves once binomial noise is taken off: a + b = m(1 - m) / v - 1, held within 1 and 10,000.
    """
    hosts = common.stored(failed.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("bad")), "hosts")
    rate = F.col("bad") / F.col("n")
    b, t, v, inv = hosts.agg(F.sum("bad"), F.sum("n"), F.var_pop(rate), F.avg(1 / F.col("n"))).first()  # one row
    m = b / t if t else 0.0
    odd = m * (1 - m)
    strength = min(max(odd / max((v or 0.0) - odd * (inv or 0.0), 1e-9) - 1, 1.0), 10_000.0)
    mean = (F.col("bad") + m * strength) / (F.col("n") + strength)
    least = F.col("rate") - 2 * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + strength + 1))
    return hosts.select("host", "n", "bad", mean.alias("rate")).withColumn("least", least)


def rejected_hosts(failed: DataFrame, host_limit: float) -> DataFrame:
    """(host) of the hosts whose failure rate is surely above host_limit, broadcast if they are few."""
    return common.maybe_broadcast(host_rates(failed).where(F.col("least") > host_limit).select("host", F.lit(True).alias("host_rejected")))


#: The failure rate above which a host is rejected.
HOST_LIMIT = 0.5


def quality(df: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", host_limit: float = HOST_LIMIT, limits: dict | None = None) -> DataFrame:
    """One row for each document: doc_id, figures, base_failed, failed (own rules), host_rejected, kept."""
    own = rules(**(limits or LIMITS))
    src = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), host_key(host).alias("host"))
    rows = common.stored(measured(src, ["doc_id", "host"]).withColumns({"base_failed": base_failed(), "failed": own}), "quality")
    bad = rejected_hosts(rows.select("host", "failed"), host_limit)
    return rows.join(bad, "host", "left").withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False))).withColumn("kept", ~F.col("failed") & ~F.col("host_rejected"))


def keep_good(df: DataFrame, text: str = "text", host: str = "source", host_limit: float = HOST_LIMIT, limits: dict | None = None) -> DataFrame:
    """The rows of df that quality() keeps, with df's own columns; no text is shuffled or joined by id.

    Texts are measured twice, once for the hosts' rates and once where rows are dropped, which costs less
    than carrying them through a shuffle.
    """
    own = rules(**(limits or LIMITS))
    marked = df.withColumn("__host", host_key(host))
    bad = rejected_hosts(measured(marked, ["__host"], text).select(F.col("__host").alias("host"), own.alias("failed")), host_limit)
    columns = df.columns
    inner = [f"__c{i}" for i in range(len(columns))]
    plain = marked.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(columns, inner, strict=True)), F.col("__host").alias("host"))
    rows = measured(plain, [*inner, "host"], inner[columns.index(text)]).where(~own)
    return rows.join(bad, "host", "left").where(F.col("host_rejected").isNull()).select(*(F.col(i).alias(c) for c, i in zip(columns, inner, strict=True)))


def query(spark, sf_dir: str) -> DataFrame:
    rows = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed", "host_rejected")
