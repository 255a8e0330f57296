import collections
import hashlib
import io
import random
import re
import wave
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandbase.llm import common, htmltext, langid, lexicon, licenses, media, neardup, packing, quality, sharding, tokencount

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: One column for each name that an operator makes itself, so that names clash.
EXTRA = ["score", "fp", "n_words", "kept", "host", "size", "shard", "ids", "start", "n", "group", "unit", "label", "t", "__text"]


def rows_():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgéßñ") for _ in range(r.randint(1, 8)))
    base = [word() for _ in range(80)]
    near = base[:40] + ["changed"] + base[41:]
    out = [(0, None), (1, ""), (2, " "), (3, "a"), (4, " ".join(base)), (5, " ".join(base)), (6, " ".join(near)), (7, "\n\n\t x \x1c y"), (8, "漢字 かな <|endoftext|> <s> \U0001f600 é"), (9, "ab " * 30000),
           (10, "".join(f"{word()}{r.choice('  .!\n')}" for _ in range(20000))), (11, "A  B   C "), (12, "a\x00b"), (13, "a a a a a\nx\nx\nx"), (14, ", ".join(base)), (4, " ".join(base))]
    return [(i, t, ("en", "fr", None)[i % 3], (None, "s1", "s2")[i % 3], None) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows_(), SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in EXTRA}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA).withColumns({c: F.lit("clash") for c in EXTRA})


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}


def test_quality(spark, docs, empty):
    def brute(t):
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        tri = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {i + j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)

    t = texts(docs)
    got = quality.quality(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(t[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in got if r["kept"])
    assert quality.quality(empty).count() == 0 and quality.keep_good(empty).count() == 0


def test_hosts_shrink_and_are_rejected(spark):
    rows = [("bad", True)] * 95 + [("bad", False)] * 5 + [("one", True)] * 2 + [("good", i % 20 == 0) for i in range(400)] + [("even", i % 2 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "host string, failed boolean")
    rates = {r["host"]: r for r in quality.host_rates(df).collect()}
    assert rates["bad"]["rate"] > 0.8 and rates["one"]["rate"] < 0.95 and rates["good"]["rate"] < 0.1
    assert all(r["least"] < r["rate"] for r in rates.values())
    assert [r["host"] for r in quality.rejected_hosts(df, 0.5).collect()] == ["bad"]


def test_a_bad_host_takes_its_clean_documents_along(spark):
    r = random.Random(9)
    clean = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(60))
    rows = [(i, clean() if i % 10 == 0 else "too short", "en", "spam", 0) for i in range(100)]
    rows += [(1000 + i, "too short" if i % 10 == 0 else clean(), "en", f"s{i % 3}", 0) for i in range(150)]
    rows += [(2000, clean(), "en", None, 0), (2001, "short", "en", "few", 0), (2002, clean(), "en", "few", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {x["doc_id"]: x for x in quality.quality(df).collect()}
    assert all(got[i]["host_rejected"] and not got[i]["kept"] for i in range(100)) and not got[0]["failed"]
    assert {i for i, x in got.items() if x["kept"]} == {i for i, t, *_, in rows if i >= 1000 and len(t) > 9}
    assert {x["doc_id"] for x in quality.keep_good(df).collect()} == {i for i, x in got.items() if x["kept"]}


def test_language(spark, docs, empty):
    r = random.Random(1)
    rows = []
    for i in range(300):
        lang, sylls = [("aa", ["ka", "to", "mi", "ré"]), ("bb", ["schl", "ung", "ver", "ö"]), ("cc", ["th", "ing", "ed", "wh"])][i % 3]
        rows.append((i, " ".join("".join(r.choice(sylls) for _ in range(3)) for _ in range(r.randint(5, 60))), lang, "s", 0))
    df = spark.createDataFrame(rows, SCHEMA)
    p = langid.learn(df, ~langid.held_out())
    got = langid.identify(df.withColumn("held_out", langid.held_out()), p, ["doc_id", "lang", "held_out"])
    assert got.where("held_out").count() > 50
    assert got.where("held_out and lang != lang_pred").count() == 0
    odd = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in langid.identify(docs, p, ["doc_id"]).collect()}
    assert odd[0] == odd[1] == odd[2] == ("und", 0.0) and all(0 <= s <= 1 for _, s in odd.values())
    assert langid.identify(empty, p, ["doc_id"]).count() == 0
    none = langid.learn(empty)
    assert {x["lang_pred"] for x in langid.identify(docs, none, ["doc_id"]).collect()} == {"und"}
    assert langid.keep_known(docs, p).columns == docs.columns
    # counting in blocks gives the same n-grams
    text = rows[0][1] * 3
    whole = langid.ngram_counts(text)
    old, langid.BLOCK = langid.BLOCK, 64
    try:
        parts = langid.ngram_counts(text)
    finally:
        langid.BLOCK = old
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_distances_equal_plain_ones():
    def grams(text):
        out = collections.Counter()
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            w = f" {w} "
            for n in (1, 2, 3):
                for i in range(len(w) - n + 1):
                    g = w[i : i + n]
                    if g.strip() and not (n == 3 and g[1] == " "):
                        out[g] += 1
        return out

    def ranked(text, size):
        # ties by code: letter by letter, the space before all letters, shorter n-grams first
        code = lambda g: sum((ord(c) + 2 if c != " " else 1) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
        return [code(g) for g, _ in sorted(grams(text).items(), key=lambda x: (-x[1], code(x[0])))[:size]]

    r = random.Random(3)
    word = lambda s: "".join(r.choice(s) for _ in range(r.randint(1, 7)))
    texts = {k: " ".join(word(s) for _ in range(80)) for k, s in (("aa", "abcde"), ("bb", "defgh"), ("cc", "éaxyz"))}
    size = 60
    p = langid.Profiles({k: langid.top(*langid.ngram_counts(t), size).tolist() for k, t in texts.items()}, size)
    for text in [*(t[:200] for t in texts.values()), "abc Déf, ghi-xyz 12 a_b", "q", "Q1w2 e"]:
        own = ranked(text, size)
        assert langid.top(*langid.ngram_counts(text), size).tolist() == own
        want = []
        for k in sorted(texts):
            rank = {g: i for i, g in enumerate(ranked(texts[k], size))}
            want.append(sum(abs(i - rank[g]) if g in rank else size for i, g in enumerate(own)) / (len(own) * size))
        assert p.distances(text).tolist() == pytest.approx(want)
        assert p.predict(text.encode())[0] == sorted(texts)[want.index(min(want))]
    same = langid.Profiles({"b": p.codes[:5].tolist(), "a": p.codes[:5].tolist()}, size)
    assert same.predict(b"abc")[0] == "a"  # a tie goes to the first name


def test_sample_is_bounded_by_rows_and_languages(spark):
    rows = [(1, f"wort {i} haus", "de", "s", 0) for i in range(50)] + [(1, "same text", "de", "s", 0)] * 30 + [(None, "nur hier", "xx", "s", 0)] + [(i, "x", f"l{i:03d}", "s", 0) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert langid.learn(df, sample_docs=3, max_langs=3).langs == ["de", "l000", "l001"]
    every = langid.learn(df, sample_docs=1000)
    assert len(every.langs) == 42 and langid.Profiles({"xx": langid.top(*langid.ngram_counts("nur hier"), 400).tolist()}).predict(b"nur hier")[1] == 1.0
    assert every.predict(b"nur hier")[0] == "xx"


def test_licenses(spark, docs, empty):
    cases = {
        100: "Released Under The MIT License. under the mit license under the mit license",
        101: "x Apache-License, Version 2.0 y CC BY-NC 4.0",
        102: "SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0\nfoo",
        103: "SPDX-License-Identifier: GPL-3.0-only AND MIT", 104: "SPDX-License-Identifier: (MIT OR", 105: "under\nthe ±MIT license; under the mit licenses",
    }
    df = docs.select("doc_id", "text", "score").unionByName(spark.createDataFrame([(i, t, "") for i, t in cases.items()], "doc_id long, text string, score string"))
    t = texts(df)
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df, ["doc_id"]).collect()}
    for i, s in t.items():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(k, lab) for p, lab in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
    assert got[102]["labels"] == "apache-2,gpl-2,mit" and got[102]["permissive"] is True
    assert got[103]["permissive"] is False and got[104]["labels"] == "" and got[104]["score"] == 0.7
    for i, x in t.items():
        assert got[i]["labels"] == ",".join(sorted(plain_labels(x)))
    assert licenses.to_postfix("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert licenses.to_postfix("(a or b") is None and licenses.to_postfix("and a") is None
    assert licenses.scan_licenses(empty, ["doc_id"]).count() == 0


def plain_labels(text):
    """All labels of a text by string search and a recursive parser."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    spaced = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)) + " "
    out = {x for p, x in (licenses.BASE | licenses.NOTICES).items() if f" {p} " in spaced}
    for part in re.split(r"(?i)spdx-license-identifier[ \t]*:", text)[1:]:
        tokens = re.findall(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:_-]*", part.split("\n")[0])
        names, at = [], 0

        def operand():
            nonlocal at
            if at < len(tokens) and tokens[at] == "(":
                at += 1
                own = expression()
                if own is None or at >= len(tokens) or tokens[at] != ")":
                    return None
                at += 1
                return own
            if at < len(tokens) and licenses.is_identifier(tokens[at].rstrip(".:_-")):
                at += 1
                return {licenses.label_of(tokens[at - 1].rstrip(".:_-").lower())}
            return None

        def expression():
            nonlocal at
            own = operand()
            while own is not None and at < len(tokens) and tokens[at].lower() in ("and", "or", "with"):
                back, op = at, tokens[at].lower()
                at += 1
                if op == "with":
                    if at < len(tokens) and tokens[at].rstrip(".:_-").lower() in licenses.EXCEPTIONS:
                        at += 1
                        continue
                    other = None
                else:
                    other = operand()
                if other is None:
                    at = back
                    break
                own = own | other
            return own

        names = expression()
        out |= names or set()
    return out


def test_labels_equal_plain_ones_on_made_expressions():
    r = random.Random(4)
    words = ["MIT", "mit", "Apache-2.0", "GPL-2.0-only", "GPL-3.0+", "LGPL-2.1-or-later", "CC-BY-4.0", "CC0-1.0", "LicenseRef-Own", "see", "the", "mitre-custom", "x1", "Classpath-exception-2.0", "and", "or", "AND", "with", "WITH", "(", ")", ".", "\n", "SPDX-License-Identifier:", "under the mit license", "cc0"]
    scan = licenses._make(licenses.NOTICES)()
    texts = [" ".join(["SPDX-License-Identifier:"] * (k % 3 > 0) + [r.choice(words) for _ in range(r.randint(1, 12))]) for k in range(4000)]
    got = scan([t.encode() for t in texts])[5]
    wrong = [(t, g, plain_labels(t)) for t, g in zip(texts, got, strict=True) if g != ",".join(sorted(plain_labels(t)))]
    assert not wrong, wrong[:3]
    same = {licenses.label_of(x) for x in ("gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-2.0+")}
    assert same == {"gpl-2"} and licenses.label_of("apache-2.0") == "apache-2" and licenses.label_of("lgpl-2.1+") == "lgpl-2.1" and licenses.label_of("blueoak-1.0.0") == "blueoak-1"


def test_licence_expressions_end_at_tags_and_prose():
    scan = licenses._make(licenses.NOTICES)()
    tag = "SPDX-License-Identifier: "
    cases = {
        f"/* {tag}MIT */ a(); /* {tag}GPL-3.0-only */": ("gpl-3,mit", False), f"{tag}MIT. {tag}Apache-2.0": ("apache-2,mit", True),
        f"{tag}MIT and the rest of it": ("mit", True), f"{tag}(MIT or ISC) and all others": ("isc,mit", True), f"{tag}MIT.\nx": ("mit", True),
        f"{tag}GPL-2.0-only WITH Classpath-exception-2.0 or curl": ("curl,gpl-2", True), f"{tag}(MIT or the": ("", None), f"{tag}MIT OR LicenseRef-x": ("licenseref-x,mit", True),
        f"{tag}see the LICENSE file": ("", None), f"{tag}MIT or something else": ("mit", True), f"{tag}mitre-custom": ("", None), f"{tag}LicenseRef-own": ("licenseref-own", False),
        f"{tag}GPL-2.0-only with nothing": ("gpl-2", False), f"{tag}((MIT)": ("", None),
    }
    out = scan([t.encode() for t in cases])
    assert list(zip(out[5], out[7], strict=True)) == list(cases.values())


def test_media(docs, empty):
    t = texts(docs)
    got = media.media_columns(docs, ["doc_id"]).collect()
    assert len(got) == docs.count()
    feature = {}
    for r in got:
        b = t[r["doc_id"]].encode()
        payload = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        with wave.open(io.BytesIO(r["media"])) as w:
            assert w.readframes(w.getnframes()) == payload and w.getsampwidth() == 1
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"], r["media_bytes"]) == (len(b), len(payload), zlib.crc32(payload[-64:]), len(r["media"]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest()
        assert feature.setdefault(b, r["feature"]) == r["feature"] and len(r["times"]) == len(r["codes"]) == int(r["feature"].split(":")[0])
    assert media.media_columns(empty, ["doc_id"]).count() == 0
    frames, bins = np.array([0, 0, 1, 4, 5, 5, 5, 30]), np.array([3, 9, 4, 7, 8, 9, 200, 256])
    want = []
    for i in range(8):
        near = [j for j in range(i + 1, 8) if frames[j] - frames[i] <= media.REACH][: media.FAN]
        want += [(frames[i], bins[i] << 13 | bins[j] << 4 | frames[j] - frames[i]) for j in near]
    assert list(zip(*media.pairs(frames, bins), strict=True)) == want
    samples = np.random.default_rng(1).integers(0, 256, 40 * media.HOP).astype(np.uint8)
    whole = media.peaks(samples)
    old, media.BLOCK = media.BLOCK, 7
    try:
        assert all((a == b).all() for a, b in zip(whole, media.peaks(samples), strict=True))
    finally:
        media.BLOCK = old


def test_media_fingerprints_cover_short_texts_and_frame_edges():
    def codes(b):
        return media.pairs(*media.peaks(np.frombuffer(media.payload_of(b), np.uint8)))

    r = random.Random(6)
    prose = lambda n: bytes(r.choice(b"etaoin shrdlu, cmfwyp. ETA") for _ in range(n))
    short = [prose(n) for n in (1, 5, 30, 64, 100, 300, 511)]
    found = [codes(b) for b in short]
    assert all(len(c) for _, c in found) and len({(t.tobytes(), c.tobytes()) for t, c in found}) == len(short)
    # every sample counts: an edit anywhere, so also on a multiple of 512, changes the peaks as often
    text, same = prose(40 * 512), collections.Counter()
    for at in range(512, 39 * 512, 256):
        edited = text[: at - 4] + prose(8) + text[at + 4 :]
        same[at % 512] += all(np.array_equal(a, b) for a, b in zip(codes(text), codes(edited), strict=True))
    assert same[0] <= 25 and same[256] <= 25  # of 77 and 76
    # a copy that stands later keeps most of its pairs
    late = collections.Counter(codes(prose(200) + text)[1].tolist())
    own = collections.Counter(codes(text)[1].tolist())
    assert (own & late).total() >= 0.4 * own.total()
    assert not len(codes(bytes([128]) * 640)[1])


def test_peaks_equal_a_plain_transform():
    samples = np.random.default_rng(2).integers(0, 256, 1300).astype(np.uint8)
    padded = np.concatenate((np.zeros(media.LEAD), samples - 128.0, np.zeros(media.FRAME)))
    want = []
    for k in range(-(-(len(samples) + media.LEAD) // media.HOP)):
        part = padded[k * media.HOP :][: media.FRAME] * np.hanning(media.FRAME)
        size = [abs(sum(part * np.exp(-2j * np.pi * f * np.arange(media.FRAME) / media.FRAME))) for f in range(257)]
        for lo, hi in zip(media.BANDS, media.BANDS[1:], strict=False):
            best = max(range(lo, hi), key=lambda f: (size[f], -f))
            if size[best] > 2 * np.mean(size):
                want.append((k, best))
    assert list(zip(*(x.tolist() for x in media.peaks(samples)), strict=True)) == want


def test_token_counts(docs, empty):
    path = P.path("piece_bpe_32k.model")
    m = tokencount.model(path)
    for frequent, cache in ((1000, 1000), (0, 5)):
        got = {r["doc_id"]: r for r in tokencount.count_tokens(docs, path, ["doc_id"], frequent=frequent, cache=cache).collect()}
        for i, s in texts(docs).items():
            assert (got[i]["n_bytes"], got[i]["n_tokens"]) == (len(s.encode()), len(m.encode(s)))
    assert tokencount.count_tokens(empty, path, ["doc_id"]).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    once = docs.dropDuplicates(["doc_id"])
    t = texts(once)
    rows = sorted(packing.pack(once, path, with_ids=True).collect(), key=lambda r: (r["doc_id"], r["start"]))
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) > 0 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, s in t.items():
        ids = lib.encode(s, add_special_tokens=False).ids + [0]
        assert [x for r in by_doc[i] for x in r["ids"]] == ids and all(r["doc_tokens"] == len(ids) for r in by_doc[i])
        assert [r["start"] for r in by_doc[i]] == list(np.cumsum([0] + [r["length"] for r in by_doc[i]])[:-1])
    assert sorted(by_seq) == list(range(len(by_seq)))
    for k, v in by_seq.items():
        at = 0
        for r in sorted(v, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 1024 or k == len(by_seq) - 1 and at < 1024
    assert packing.pack(docs, path).agg(F.sum("length")).first()[0] == sum(r["length"] for r in rows) + len(lib.encode(t[4], add_special_tokens=False).ids) + 1
    assert packing.pack(empty, path).count() == 0


def test_word_cache_is_bounded_and_exact():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    words = packing.WordIds(path, 10)
    r = random.Random(4)
    for _ in range(400):
        text = "".join(r.choice(["un", "heard", " ", "  ", "\n", "é", "12", "'s", ".", "東", "\x1c", "a b"]) for _ in range(r.randint(0, 30)))
        assert np.frombuffer(words.of(text), np.uint16).tolist() == lib.encode(text, add_special_tokens=False).ids
        assert len(words) <= 10


def test_lexicon(docs, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    for size, cache in ((500, 1000), (0, 7)):
        got = {r["doc_id"]: r for r in lexicon.encode(docs, path, ["doc_id"], size=size, cache=cache).collect()}
        for i, s in texts(docs).items():
            ids = lib.encode(s, add_special_tokens=False).ids
            assert (got[i]["n_tokens"], got[i]["ids"]) == (len(ids), ids) and got[i]["decoded"] == lib.decode(ids, skip_special_tokens=False)
    back = lexicon.decode(lexicon.encode(docs, path, ["doc_id"]), path, ["doc_id", "decoded"][:1])
    assert back.count() == docs.count()
    assert lexicon.encode(empty, path, ["doc_id"]).count() == 0


def test_tokenizers_of_another_build(tmp_path):
    import json

    from tokenizers import Tokenizer

    spec = json.load(open(P.path("word_bpe_49k.json"), encoding="utf-8"))
    assert lexicon.is_word_level(spec)
    spec["normalizer"] = {"type": "NFC"}
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        lexicon.Codec(str(tmp_path / "other.json"))
    spec = json.load(open(P.path("byte_bpe_50k.json"), encoding="utf-8"))
    assert packing.is_byte_level(spec)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "prefix.json").write_text(json.dumps(spec))
    words = packing.WordIds(str(tmp_path / "prefix.json"), 10)
    want = Tokenizer.from_file(str(tmp_path / "prefix.json")).encode("hello there", add_special_tokens=False).ids
    assert np.frombuffer(words.of("hello there"), words.kind).tolist() == want


def test_transducer_is_exact_and_minimal(tmp_path):
    words = {w: [len(w), i] for i, w in enumerate(["", "a", "ab", "abb", "bb", "tops", "stops", "été", "top"])}
    x = lexicon.Lexicon(lexicon.compile_lexicon(words))
    (tmp_path / "lexicon").write_bytes(lexicon.compile_lexicon(words))
    mapped = lexicon.Lexicon(str(tmp_path / "lexicon"))
    assert all(x.get(w) == mapped.get(w) == ids for w, ids in words.items())
    assert all(x.get(w) is None for w in ("b", "abbb", "to", "é", "x"))
    states = len(lexicon._minimal(sorted(w.encode() for w in words))[0])
    assert len(x.ends) < states


def test_sharding(docs, empty):
    out = sharding.assign(docs, shards=3, cells=16).collect()
    assert len(out) == docs.count()
    t = texts(docs)
    slots = collections.defaultdict(list)
    for r in out:
        b = t[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(b) + 8, zlib.crc32(b))
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.assign(empty).count() == 0


def test_sharding_balances_with_a_hot_group(spark):
    r = random.Random(2)
    rows = [(i, "hot text " * 20 if i % 3 == 0 else "w" * r.randint(1, 900)) for i in range(6000)]
    out = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"))
    per = out.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    sizes = [x["b"] for x in per]
    assert len(per) == 24 and max(sizes) - min(sizes) <= 0.001 * max(sizes)


def test_sharding_parts_identical_rows_and_keeps_groups(spark, monkeypatch):
    r = random.Random(5)
    rows = [((None, 7)[i % 2], "the same text again " * 9) for i in range(9000)] + [(i, f"group {i % 3000} " * (1 + i % 3000 % 30)) for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for at_once in (1 << 20, 100):  # an item of many rows is numbered in parts
        monkeypatch.setattr(sharding, "ROWS_AT_ONCE", at_once)
        out = sharding.assign(df).collect()
        load, slots, homes = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
        for x in out:
            load[x["shard"]] += x["size"]
            slots[x["shard"]].append(x["slot"])
            homes[x["text_crc32"]].add(x["shard"])
        assert len(out) == len(rows) and max(load.values()) - min(load.values()) <= 0.005 * max(load.values())
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert sorted(map(len, homes.values()))[:-1] == [1] * 3000  # only the group that fills a third of all shards is cut
    assert r


def test_placing_equals_a_plain_version():
    r = np.random.default_rng(6)
    items = r.integers(1, 50, (60, 3)).astype(float)
    fair = items.sum(axis=0) / 4
    left, want = [[1.0] * 3 for _ in range(4)], [0] * 60
    for k in sorted(range(60), key=lambda k: (-max(items[k] / fair), k)):
        score = [sum(a * b for a, b in zip(left[s], items[k] / fair, strict=True)) for s in range(4)]
        want[k] = max(range(4), key=lambda s: (score[s], -s))
        left[want[k]] = [a - b for a, b in zip(left[want[k]], items[k] / fair, strict=True)]
    where = sharding.place(items, 4)
    assert where.tolist() == want
    load = lambda w: [items[np.array(w) == s, 0].sum() for s in range(4)]
    better = sharding.level(items, where, 4)
    assert max(load(better)) - min(load(better)) <= max(load(where)) - min(load(where))
    # at the end no single move or swap between the fullest and the emptiest shard narrows the gap
    a, b = int(np.argmax(load(better))), int(np.argmin(load(better)))
    gap = max(load(better)) - min(load(better))
    shifts = [x - y for x in items[better == a, 0] for y in [0.0, *items[better == b, 0]]]
    assert min(abs(gap - 2 * x) for x in shifts) >= gap - 1e-9


def test_near_duplicates(spark, docs, empty):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    rows = []
    for g in range(25):
        base = [word() for _ in range(r.randint(6, 120))]
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
        rows.append((len(rows), rows[-1][1]))
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 1000))
    data = [(x["doc_id"], x["text"]) for x in df.collect()]
    g = neardup.Grams(5, 1, 1)
    sets = [frozenset(g.grams((t or "").encode()).tolist()) for _, t in data]
    n, root = len(data), list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = collections.Counter()
    for i in range(n):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), 10**9), data[i][0])
    want = sorted((data[i][0], least[find(i)], links[i]) for i in range(n))
    for size in (1024, 3):  # large buckets are cut into blocks
        old, neardup.BLOCK_SETS = neardup.BLOCK_SETS, size
        try:
            got = neardup.near_duplicates(df).select("doc_id", "class_id", "n_links").collect()
        finally:
            neardup.BLOCK_SETS = old
        assert sorted(map(tuple, got)) == want
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns and sorted(x["doc_id"] for x in kept.collect()) == sorted(set(least.values()))
    assert neardup.near_duplicates(empty).count() == 0 and neardup.keep_one(empty).count() == 0
    assert neardup.banding() == (14, 4) and 1 - (1 - 0.8**4) ** 14 >= 0.999


def test_near_duplicates_in_scripts_without_spaces(spark):
    r = random.Random(7)
    han = lambda n: "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    a, b = han(200), "".join(chr(r.randrange(0x0E01, 0x0E2F)) for _ in range(200))
    rows = [(0, a), (1, a[:100] + "x" + a[101:]), (2, b), (3, b[:198]), (4, han(200))]
    got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (0, 1), 1: (0, 1), 2: (2, 1), 3: (2, 1), 4: (4, 0)}


def test_near_duplicates_with_null_ids(spark):
    base = [f"w{i}" for i in range(60)]
    near, far = base[:30] + ["x"] + base[31:], [f"v{i}" for i in range(60)]
    rows = [(None, base), (7, near), (None, far), (None, far[:-1]), (9, ["only"])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = sorted((x["doc_id"] or 0, x["class_id"] or 0, x["n_links"]) for x in neardup.near_duplicates(df).collect())
    assert got == [(0, 0, 1), (0, 0, 1), (0, 7, 1), (7, 7, 1), (9, 9, 0)]
    assert neardup.keep_one(df).count() == 5


def test_each_class_keeps_one_row_where_ids_repeat(spark):
    one, two, three, four = (" ".join(f"{c}{i}" for i in range(60)) for c in "abcd")
    near = one.replace("a30", "x")
    # 5 is a near copy of 3 and alone in two other classes; 2 leads one class by two sets; 8 is an exact repeat
    rows = [(3, one), (5, near), (5, two), (5, three), (5, three), (2, four), (2, four.replace("d30", "x")), (9, four), (8, "only here"), (8, "only here"), (None, one)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    got = collections.Counter((r["doc_id"], r["text"][0]) for r in kept.collect())
    assert got == collections.Counter([(3, "a"), (5, "b"), (5, "c"), (2, "d"), (8, "o"), (None, "a")])


def test_results_reach_copies_of_large_and_small_sets(spark, monkeypatch):
    rows = [(i, "hot" if i % 2 else f"s{i % 10}") for i in range(200)]
    size = collections.Counter(fp for _, fp in rows)
    df = spark.createDataFrame([(i, fp.encode()) for i, fp in rows], "doc_id long, fp binary")
    sets = spark.createDataFrame([(fp.encode(), n, len(fp), n - 1) for fp, n in size.items()], "fp binary, size long, class_id long, n_links long")
    want = sorted((i, fp.encode(), len(fp), size[fp] - 1) for i, fp in rows)
    for parts in (1, 4, 4096):  # no set is large, one is, all are
        monkeypatch.setattr(neardup, "HOT_SETS", parts)
        got = neardup.to_copies(df, sets)
        assert sorted((r[0], bytes(r[1]), r[2], r[3]) for r in got.collect()) == want
    assert neardup.to_copies(df.limit(0), sets.limit(0)).count() == 0


def test_kept_text_comes_back_whole(spark, docs):
    make = lambda: lambda texts: [[len(t or b"") for t in texts]]
    field = [("n_text", T.LongType())]
    with_text = common.per_row(docs, make, field, ["doc_id", "text"])
    assert with_text.columns == ["doc_id", "text", "n_text"]
    assert all(r["n_text"] == len((r["text"] or "").encode()) for r in with_text.collect())
    key = lambda r: (r["doc_id"], r["text"] or "")
    assert sorted(map(key, with_text.collect())) == sorted(map(key, docs.collect()))
    assert sorted(r["n_text"] for r in common.per_row(docs, make, field, ["doc_id"]).collect()) == sorted(r["n_text"] for r in with_text.collect())


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(60)]
    got = {x["node"]: x["root"] for x in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_html(spark):
    page = """<html><head><title>T</title><script>var a="<p>x</p>"</script><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></ul></nav>
    <div class="cookie notice">We use cookies</div><article><h1>Head &amp; more</h1><p>One <b>bold</b>\n  word<br>here.<p>Two &lt;x&gt; &copy <!-- no --></article>
    <aside class=sidebar><p>Side</p></aside><section class="comments"><div class="comment"><p>Nice post</p></div></section><form><input><label>Mail</label></form><footer>end</footer></body></html>"""
    rows = [(0, "u", page), (1, None, None), (2, "", ""), (3, "u", "plain"), (4, "u", "<article><p>" + "long words here. " * 50000), (0, "u", page), (5, "u", "</p></div><b><<>> & &#x41;")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    model = htmltext.train()
    got = collections.defaultdict(list)
    for r in htmltext.extract_pages(df, ["page_id", "url"], model=model).collect():
        got[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert got[0] == ["Head & more\nOne bold word here.\nTwo <x> ©"] * 2
    assert got[1] == got[2] == [""] and got[4] == [("long words here. " * 50000).strip()]
    assert htmltext.extract_pages(df.limit(0), ["page_id"], model=model).count() == 0
    right = total = 0
    for nodes, labels in htmltext.make_pages(150, seed=1234):
        for n, p, y in zip(nodes[1:], model.marginals(nodes)[1:], labels[1:], strict=True):
            if n.own:
                total += 1
                right += (p > 0.5) == bool(y)
    assert right / total > 0.95


def test_pages_are_parsed_like_the_library_does():
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__()
            self.nodes, self.path, self.texts = [("#root", -1)], [0], []

        def handle_starttag(self, tag, attrs):
            self.nodes.append((tag, self.path[-1]))
            self.path.append(len(self.nodes) - 1)

        def handle_endtag(self, tag):
            assert self.nodes[self.path.pop()][0] == tag

        def handle_data(self, data):
            self.texts.append((self.path[-1], data))

    r = random.Random(11)

    def element(depth):
        tag = r.choice(["div", "section", "b", "span", "article", "em", "ul"])
        inside = "".join(element(depth + 1) if depth < 5 and r.random() < 0.5 else r.choice(["text ", "a &amp; b", "x&#65;", "<!-- no <b> -->", "1 < 2 ", ""]) for _ in range(r.randint(0, 4)))
        return f"<{tag} class='a > b' id=\"q'\">{inside}</{tag}>"

    raws = [element(0) for _ in range(200)]
    for page in raws:
        t = Tree()
        t.feed(page)
        t.close()
        nodes, runs = htmltext.parse(page)
        assert [(n.tag, n.parent) for n in nodes] == t.nodes
        mine, theirs = collections.defaultdict(str), collections.defaultdict(str)
        for k, x, _ in runs:
            mine[k] += x
        for k, x in t.texts:
            theirs[k] += x
        assert {k: x for k, x in mine.items() if x} == {k: x for k, x in theirs.items() if x}


def test_malformed_pages_take_linear_time():
    import time

    model = htmltext.train(100)
    n = 40_000
    pages = ["<a " * n, "<b>" * n + "</i>" * n, '<a "' * (n + 1) + ">", "<ul>" + "<b>" * n + "<li></li>" * n, "<p><td>" + "<b>" * n + "<hr>" * n, "<textarea>" * n, "<!" * n, "&#" + "9" * n, "<" * n]
    for page in pages:
        start = time.perf_counter()
        htmltext.extract(page, model)
        assert time.perf_counter() - start < 8, page[:20]  # quadratic readers need minutes
    assert htmltext.parse("x &#" + "9" * 30 + "; y")[1][0][1] == "x \ufffd y"
    assert htmltext.extract('<article><p>one two three four <a href="x>five</a> six</p></article>', htmltext.train()) == "one two three four five six"


def test_marginals_are_exact():
    nodes, _ = htmltext.parse("<div><p class=ad>aa</p><p>bb<a>cc</a></p></div>")
    model = htmltext.train(200)
    got = model.marginals(nodes)
    n = len(nodes)
    mass = np.zeros((n, 2))
    for state in range(1 << n):
        y = [state >> k & 1 for k in range(n)]
        w = [1.0, 1e-6][y[0]]
        for k in range(1, n):
            d = sum(e[1] - e[0] for e in map(model.evidence.get, htmltext.features(nodes[k])) if e is not None)
            ratio = np.exp(np.clip(d, -30, 30))
            w *= [1 / (1 + ratio), ratio / (1 + ratio)][y[k]] * model.coupling.get(htmltext.edge_kind(nodes[k]), model.coupling[""])[2 * y[nodes[k].parent] + y[k]]
        for k in range(n):
            mass[k, y[k]] += w
    assert np.allclose(got, mass[:, 1] / mass.sum(axis=1))
