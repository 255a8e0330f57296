"""Scalar functions on DNA text and k-mer codes, as Spark columns.

A k-mer of up to 31 bases is a long of two bits for each base (A 0, C 1, G 2, T 3), the first base highest, so
that numbers sort as the text does. Longer k-mers are strings; the functions of Kmer serve both.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_PACKED = 31


def project_text(text: Column) -> Column:
    """Prose to DNA: lower case, white space, digits and . , ; : ! ? - deleted, a-z to ACGT in turn, the rest N."""
    bare = F.regexp_replace(F.lower(text), r"[ \n\r\t.,;:!?0-9-]", "")
    return F.regexp_replace(F.translate(bare, "abcdefghijklmnopqrstuvwxyz", ("ACGT" * 7)[:26]), "[^ACGT]", "N")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(F.upper(seq), "ACGT", "TGCA"))


def is_dna(seq: Column) -> Column:
    return F.upper(seq).rlike("^[ACGT]+$")


def dna_pieces(seq: Column, k: int) -> Column:
    """Maximal ACGT runs of at least k bases, in order."""
    return F.filter(F.split(F.upper(seq), "[^ACGT]+"), lambda x: F.length(x) >= k)


def n_windows(seq: Column, k: int) -> Column:
    return F.greatest(F.length(seq) - (k - 1), F.lit(0))


def name_token(header: Column) -> Column:
    return F.split(header, " ")[0]


def bits_per_color(n_colors: int) -> int:
    """log2 of the next power of two, at least 1."""
    return max(1, (n_colors - 1).bit_length())


def is_dense(size: Column, n_colors: int, overhead: int = 64) -> Column:
    """Whether a bitmap is the smaller form of a color set."""
    return F.lit(n_colors) <= size * bits_per_color(n_colors) + overhead


def json_name(name: Column) -> Column:
    return F.replace(name, F.lit('"'), F.lit('\\"'))


def int_list(ints: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(ints, lambda x: x.cast("string")), ","), F.lit("]"))


class Kmer:
    """Column functions on k-mers of one length."""

    def __init__(self, k: int) -> None:
        if k < 1:
            raise ValueError("k must be positive")
        self.k, self.packed = k, k <= MAX_PACKED
        self.type = "long" if self.packed else "string"

    def encode(self, text: Column) -> Column:
        """Code of a valid k-mer's upper-case text."""
        if not self.packed:
            return text
        digits = F.translate(text, "ACGT", "0123")
        return F.conv(digits, 4, 10).cast("long")

    def decode(self, x: Column) -> Column:
        return F.translate(F.lpad(F.conv(x.cast("string"), 10, 4), self.k, "0"), "0123", "ACGT") if self.packed else x

    def reverse_complement(self, x: Column) -> Column:
        if not self.packed:
            return reverse_complement(x)
        y = F.bitwise_not(x)
        for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
            y = F.shiftrightunsigned(y, shift).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(y.bitwiseAND(F.lit(mask)), shift))
        return F.shiftrightunsigned(y, 64 - 2 * self.k)

    def canonical(self, x: Column) -> Column:
        return F.least(x, self.reverse_complement(x))

    def prefix(self, x: Column) -> Column:
        """The first k - 1 bases."""
        return F.shiftright(x, 2) if self.packed else F.substring(x, 1, self.k - 1)

    def suffix(self, x: Column) -> Column:
        """The last k - 1 bases."""
        return x.bitwiseAND(F.lit((1 << 2 * (self.k - 1)) - 1)) if self.packed else F.substring(x, 2, self.k - 1)

    def last_base(self, x: Column) -> Column:
        return F.substring(F.lit("ACGT"), x.bitwiseAND(F.lit(3)).cast("int") + 1, F.lit(1)) if self.packed else F.substring(x, self.k, 1)
