"""Licence scans: Aho-Corasick over normalised words, SPDX expressions by a shunting-yard parser.

Words are runs of letters, digits and non-ASCII characters after A-Z are lower-cased. All phrases and the
identifier tag are found in one pass of one automaton over the words of the whole text. The text behind an
identifier tag, up to the next tag or its line's end, is parsed as an expression of identifiers, `and`, `or`,
`with` and parentheses; `with` binds closest, `or` loosest. Only identifiers of the SPDX lists count, and
LicenseRef names: another word ends the expression, so prose gives no label. An expression is permissive if the
identifiers that must be obeyed together are, for at least one choice.

A licence has one label, however it is named: label_of() drops `-only`, `-or-later`, `+` and a version's `.0`.

Defined cases: a null or empty text has no words and no labels; a malformed expression gives no label of its
own but its tag still counts as evidence; where phrases overlap, each counts; repeated rows are scanned one by
one; very long texts are scanned whole; an empty table gives no rows; extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Phrases that make the base counts, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notices and their labels.
NOTICES = {
    "gnu general public license version 3": "gpl-3", "gnu general public license version 2": "gpl-2", "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl", "mozilla public license": "mpl", "eclipse public license": "epl", "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd", "creative commons attribution": "cc-by", "cc0": "cc0", "public domain": "public-domain", "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd", "permission is hereby granted free of charge": "mit",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: Licence families of the SPDX list (fixed values): the name's beginning, and the versions that follow it.
FAMILIES = {
    "cc-by": "1.0 2.0 2.5 2.5-au 3.0 3.0-at 3.0-au 3.0-de 3.0-igo 3.0-nl 3.0-us 4.0", "cc-by-nc": "1.0 2.0 2.5 3.0 3.0-de 4.0", "cc-by-nc-nd": "1.0 2.0 2.5 3.0 3.0-de 3.0-igo 4.0",
    "cc-by-nc-sa": "1.0 2.0 2.0-de 2.0-fr 2.0-uk 2.5 3.0 3.0-de 3.0-igo 4.0", "cc-by-nd": "1.0 2.0 2.5 3.0 3.0-de 4.0", "cc-by-sa": "1.0 2.0 2.0-uk 2.1-jp 2.5 3.0 3.0-at 3.0-de 3.0-igo 4.0",
    "gpl": "1.0 2.0 3.0", "lgpl": "2.0 2.1 3.0", "agpl": "1.0 3.0", "gfdl": "1.1 1.2 1.3", "apache": "1.0 1.1 2.0", "apsl": "1.0 1.1 1.2 2.0", "artistic": "1.0 1.0-cl8 1.0-perl 2.0",
    "mpl": "1.0 1.1 2.0 2.0-no-copyleft-exception", "npl": "1.0 1.1", "epl": "1.0 2.0", "eupl": "1.0 1.1 1.2", "cddl": "1.0 1.1", "cecill": "1.0 1.1 2.0 2.1 b c", "cpl": "1.0", "cpal": "1.0",
    "osl": "1.0 1.1 2.0 2.1 3.0", "afl": "1.1 1.2 2.0 2.1 3.0", "lppl": "1.0 1.1 1.2 1.3a 1.3c", "ofl": "1.0 1.0-rfn 1.0-no-rfn 1.1 1.1-rfn 1.1-no-rfn", "php": "3.0 3.01",
    "python": "2.0 2.0.1", "psf": "2.0", "zpl": "1.1 2.0 2.1", "efl": "1.0 2.0", "ecl": "1.0 2.0", "oldap": "1.1 1.2 1.3 1.4 2.0 2.0.1 2.1 2.2 2.2.1 2.2.2 2.3 2.4 2.5 2.6 2.7 2.8",
    "bsd": "1-clause 2-clause 2-clause-patent 2-clause-views 3-clause 3-clause-attribution 3-clause-clear 3-clause-lbnl 3-clause-modification 3-clause-open-mpi 4-clause 4-clause-uc protection source-code",
    "mit": "0 cmu advertising enna feh festival modern-variant open-group wu", "cc0": "1.0", "cc-pddc": "", "bsl": "1.0", "busl": "1.1", "sspl": "1.0", "blueoak": "1.0.0", "upl": "1.0", "ncsa": "",
    "ms": "pl rl lpl", "cdla-permissive": "1.0 2.0", "cdla-sharing": "1.0", "odc-by": "1.0", "odbl": "1.0", "pddl": "1.0", "ogl-uk": "1.0 2.0 3.0", "etalab": "2.0", "mulanpsl": "1.0 2.0", "elastic": "2.0",
    "polyform-noncommercial": "1.0.0", "polyform-small-business": "1.0.0", "cern-ohl": "1.1 1.2 p-2.0 s-2.0 w-2.0", "liliq-p": "1.1", "liliq-r": "1.1", "liliq-rplus": "1.1", "ipl": "1.0", "spl": "1.0", "rpl": "1.1 1.5",
    "rpsl": "1.0", "qpl": "1.0", "sgi-b": "1.0 1.1 2.0", "ypl": "1.0 1.1", "zimbra": "1.3 1.4", "tcp-wrappers": "", "unicode": "3.0 dfs-2015 dfs-2016 tou", "w3c": "19980720 20150513", "watcom": "1.0", "ucl": "1.0", "vsl": "1.0", "sissl": "1.2",
    "nasa": "1.3", "nposl": "3.0", "oclc": "2.0", "ldpl": "1.0", "frameworx": "1.0", "eudatagrid": "", "cua-opl": "1.0", "catosl": "1.1", "capec-tou": "", "interbase": "1.0", "hpnd": "sell-variant mit-disclaimer", "bittorrent": "1.0 1.1",
}
#: Families of which `-only` and `-or-later` exist, and licences without a family (fixed values).
ONLY_OR_LATER = ("gpl", "lgpl", "agpl", "gfdl")
SINGLE = frozenset("""
0bsd aal abstyles adsl afmparse aladdin aml ampas antlr-pd app-s2p arphic-1999 bahyph barr beerware bitstream-vera blessing borceux caldera clartistic cnri-python condor-1.1 crossword crystalstacker cube curl
d-fsl-1.0 diffmark doc dotseqn dsdp dtoa dvipdfm egenix entessa erlpl-1.1 eurosym fair freebsd-doc freeimage fsfap fsful fsfullr ftl giftware gl2ps glide glulxe gnuplot gsoap-1.3b haskellreport hippocratic-2.1 htmltidy
ibm-pibs icu ijg imagemagick imatix imlib2 info-zip intel intel-acpi isc jasper-2.0 jpl-image jpnic json knuth-ctan latex2e leptonica libpng libpng-2.0 libselinux-1.0 libtiff linux-man-pages-copyleft linux-openib lucida-bitmap-fonts
makeindex miros mit mitnfa motosoto mpich2 mup multics naumen nbpl-1.0 ncsa net-snmp netcdf newsletr ngpl nist-pd nlod-1.0 nlpl nokia nosl noweb nrl ntp o-uda-1.0 occt-pl offis ogtsl oml openssl opubl-1.0 oset-pl-2.1 parity-6.0.0 parity-7.0.0
plexus postgresql psfrag psutils qhull rdisc rhecos-1.1 rsa-md ruby saxpath scea sendmail sgp4 shl-0.5 shl-0.51 simpl-2.0 sleepycat smlnj smppl snia spencer-86 spencer-94 spencer-99 ssh-openssh ssleay-standalone sugarcrm-1.1.3 swl tcl
tmate torque-1.1 tosl unlicense vim vostrom wsuipa wtfpl x11 xerox xfig xinetd xnet xpp xskat zed zend-2.0 zlib zlib-acknowledgement
""".split())
#: Names that may stand behind `with` (fixed values).
EXCEPTIONS = frozenset("""
389-exception asterisk-exception autoconf-exception-2.0 autoconf-exception-3.0 autoconf-exception-generic bison-exception-1.24 bison-exception-2.2 bootloader-exception classpath-exception-2.0 clisp-exception-2.0 cryptsetup-openssl-exception
digirule-foss-exception ecos-exception-2.0 fawkes-runtime-exception fltk-exception font-exception-2.0 freertos-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 gnat-exception gnu-javamail-exception gpl-3.0-interface-exception
gpl-3.0-linking-exception gpl-3.0-linking-source-exception gpl-cc-1.0 gstreamer-exception-2005 gstreamer-exception-2008 i2p-gpl-java-exception kicad-libraries-exception lgpl-3.0-linking-exception libpri-openh323-exception libtool-exception
linux-syscall-note llgpl llvm-exception lzma-exception mif-exception ocaml-lgpl-linking-exception occt-exception-1.0 openjdk-assembly-exception-1.0 openvpn-openssl-exception ps-or-pdf-font-exception-20170817 qt-gpl-exception-1.0
qt-lgpl-exception-1.1 qwt-exception-1.0 sane-exception shl-2.0 shl-2.1 swift-exception texinfo-exception u-boot-exception-2.0 universal-foss-exception-1.0 vsftpd-openssl-exception wxwindows-exception-3.1 x11vnc-openssl-exception
""".split())


def identifiers() -> frozenset[str]:
    """All licence identifiers in lower case, made from the families."""
    made = set(SINGLE)
    for stem, versions in FAMILIES.items():
        for v in versions.split() or [""]:
            name = f"{stem}-{v}" if v else stem
            made.add(name)
            if stem in ONLY_OR_LATER:
                made |= {f"{name}-only", f"{name}-or-later"}
                if stem == "gfdl":
                    made |= {f"{name}-{part}-{kind}" for part in ("invariants", "no-invariants") for kind in ("only", "or-later")}
    return frozenset(made)


IDENTIFIERS = identifiers()
#: Families and single licences that count as permissive.
PERMISSIVE_FAMILIES = frozenset("mit apache bsd cc0 bsl upl blueoak cc-by psf python zpl cdla-permissive pddl ms-pl artistic-2.0 libpng unicode w3c mulanpsl".split())
PERMISSIVE = frozenset("0bsd mit isc zlib unlicense x11 postgresql ncsa curl icu ijg json ntp beerware fsfap ftl libtiff openssl ruby tcl vim wtfpl zlib-acknowledgement public-domain cc-pddc".split())
_STEMS = {f"{stem}-{v}" if v else stem: stem for stem, versions in FAMILIES.items() for v in versions.split() or [""]}
_OWN_LABELS = {"cc0-1.0": "cc0"}


def is_identifier(word: str) -> bool:
    """Whether a word is a licence identifier, or a name that refers to a licence text beside it."""
    low = word.lower()
    return low.removesuffix("+") in IDENTIFIERS or re.fullmatch(r"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+", low) is not None


def label_of(identifier: str) -> str:
    """The one label of a licence: without -only, -or-later and +, a version's .0 left out."""
    if "licenseref-" in identifier:
        return identifier
    name = re.sub(r"(?:\+|-only|-or-later)$", "", identifier)
    return _OWN_LABELS.get(name, re.sub(r"(?<=-)([0-9]+)(?:\.0)+(?=-|$)", r"\1", name))


def is_permissive(identifier: str) -> bool:
    name = identifier.removesuffix("+")
    return name in PERMISSIVE or name in PERMISSIVE_FAMILIES or _STEMS.get(name) in PERMISSIVE_FAMILIES


_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:_-]*")
_TAG = re.compile(rb"spdx-license-identifier[ \t]*:", re.IGNORECASE)
_RANK = {"or": 1, "and": 2, "with": 3}


def to_postfix(text: str) -> list[str] | None:
    """Shunting-yard: an expression's tokens in postfix order; None if it is malformed."""
    out: list[str] = []
    held: list[str] = []
    operand_next = True
    for token in _TOKEN.findall(text):
        low = token.lower()
        if low in _RANK:
            if operand_next:
                return None
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[low]:
                out.append(held.pop())
            held.append(low)
            operand_next = True
        elif token == "(":
            if not operand_next:
                return None
            held.append(token)
        elif token == ")":
            if operand_next:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif operand_next:
            out.append(low)
            operand_next = False
        else:
            break  # prose after the expression
    if operand_next or "(" in held:
        return None
    return out + held[::-1]


def without_prose(text: str) -> str:
    """The longest beginning that is an expression, whole as to its parentheses; dots and the like at a word's end go."""
    kept: list[str] = []
    whole = depth = 0
    operand_next, exception = True, False
    for token in _TOKEN.findall(text):
        low = token.lower()
        if token == "(":
            if not operand_next or exception:
                break
            depth += 1
        elif operand_next:
            token = token.rstrip(".:_-")
            if not (token.lower() in EXCEPTIONS if exception else is_identifier(token)):
                break
            operand_next = exception = False
        elif token == ")":
            if not depth:
                break
            depth -= 1
        elif low in _RANK:
            operand_next, exception = True, low == "with"
        else:
            break  # prose after the expression
        kept.append(token)
        if not operand_next and not depth:
            whole = len(kept)
    return " ".join(kept[:whole])


def evaluate(postfix: list[str]) -> tuple[set[str], bool]:
    """All licence identifiers of an expression, and whether it can be met by permissive ones alone.

    The name behind `with` is an exception to the licence before it and no licence itself.
    """
    stack: list[tuple[set[str], bool]] = []
    for token in postfix:
        if token not in _RANK:
            stack.append(({token}, is_permissive(token)))
            continue
        (b, y), (a, x) = stack.pop(), stack.pop()
        stack.append((a, x) if token == "with" else (a | b, x and y if token == "and" else x or y))
    return stack[0]


def automaton(phrases: list[str]) -> ahocorasick.Automaton:
    """Finds each phrase where its words stand one behind the other in ' word word '."""
    found = ahocorasick.Automaton()
    for p in phrases:
        spaced = f" {p} ".encode().decode("latin-1")
        found.add_word(spaced, (p, len(spaced)))
    found.make_automaton()
    return found


def _make(notices: dict[str, str]) -> Callable:
    def make() -> Callable:
        labels_of = BASE | notices
        finder = automaton([*labels_of, TAG])

        def scan(text: bytes | None) -> tuple:
            words = (text or b"").translate(_TABLE).split()
            # one character for each byte, so that places are byte places whatever the script
            joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
            base, first, last, tagged = 0, None, None, False
            base_labels, labels = set(), set()
            word, seen = 0, 0
            for end, (phrase, size) in finder.iter(joined):
                if phrase in BASE:
                    begin = end - size + 1
                    word = word + joined.count(" ", seen, begin) if begin >= seen else joined.count(" ", 0, begin)
                    seen = begin
                    base += 1
                    first = word if first is None else min(first, word)
                    last = word if last is None else max(last, word)
                    base_labels.add(BASE[phrase])
                elif phrase == TAG:
                    tagged = True
                if phrase in labels_of:
                    labels.add(labels_of[phrase])
            permissive = None
            if tagged:
                tags = list(_TAG.finditer(text))
                ends = [*(m.start() for m in tags[1:]), len(text)]
                for m, end in zip(tags, ends, strict=False):
                    own = text[m.end() : end].split(b"\n", 1)[0]
                    postfix = to_postfix(without_prose(own.decode("utf-8", "replace")))
                    if postfix:
                        names, ok = evaluate(postfix)
                        labels |= {label_of(n) for n in names}
                        permissive = ok if permissive is None else permissive and ok
            score = 1.0 if permissive is not None else 0.9 if base else 0.7 if tagged or labels else 0.0
            return len(words), base, first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, permissive

        return lambda texts: list(zip(*map(scan, texts), strict=True)) if texts else [[] for _ in FIELDS]

    return make


FIELDS = [
    ("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()),
    ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()), ("permissive", T.BooleanType()),
]


def scan_licenses(df: DataFrame, keep: list[str], text: str = "text", notices: dict[str, str] | None = None) -> DataFrame:
    """Columns `keep` and the findings of FIELDS for every row; phrases of `notices` replace NOTICES."""
    return common.per_row(df, _make(NOTICES if notices is None else notices), FIELDS, keep, text)


def query(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
