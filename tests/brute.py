"""A brute-force model of the engine's semantics, for tests."""

from __future__ import annotations

import random
from itertools import groupby

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def rc(s: str) -> str:
    return s.translate(COMPLEMENT)[::-1]


def canon(s: str) -> str:
    return min(s, rc(s))


def windows(s: str, k: int) -> list[str | None]:
    s = s.upper()
    out = [s[i : i + k] for i in range(len(s) - k + 1)]
    return [None if set(w) - set("ACGT") else w for w in out]


def build(seqs: list[tuple[int, str]], k: int) -> dict[str, frozenset[int]]:
    found: dict[str, set[int]] = {}
    for c, s in seqs:
        for w in windows(s, k):
            if w:
                found.setdefault(canon(w), set()).add(c)
    return {w: frozenset(c) for w, c in found.items()}


def sids(index: dict, s: str, k: int) -> list:
    return [index.get(canon(w)) if w else None for w in windows(s, k)]


def counts(ids: list) -> dict[int, int]:
    out: dict[int, int] = {}
    for x in ids:
        for c in x or ():
            out[c] = out.get(c, 0) + 1
    return out


def threshold(ids: list, t: float, denominator: str, min_hits: int) -> list[int]:
    n, rel = counts(ids), sum(x is not None for x in ids)
    if rel < min_hits or not n:
        return []
    den = {"all": len(ids), "relevant": rel, "max-hits": max(n.values())}[denominator]
    return sorted(c for c, v in n.items() if v / den >= t)


def intersection(ids: list, min_hits: int, n_colors: int) -> list[int]:
    runs = [x for x, _ in groupby(ids) if x is not None]
    if len(runs) < min_hits:
        return []
    out = set(range(n_colors))
    for x in runs:
        out &= x
    return sorted(out)


def covered(ids: list, color: int, k: int) -> int:
    return len({p for i, x in enumerate(ids) if x and color in x for p in range(i, i + k)})


def dna(r: random.Random, n: int, letters: str = "ACGT") -> str:
    return "".join(r.choice(letters) for _ in range(n))
