"""The registered queries' columns and types, and the pipeline against a plain run of its stages."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from strandbase.llm import common, langid, neardup
from strandbase.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CONTRACT = {
    "op1_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op2_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op3_media_columns": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, times array<int>, codes array<int>",
    "op4_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op5_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op6_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op7_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op8_ngram_jaccard_join": "doc_id bigint, class_id bigint, n_links bigint",
    "op9_bpe_lexicon": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op10_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
}


def corpus():
    """Two languages, copies, near copies, a wrong language, a bad host, short and empty and null texts, repeated ids."""
    r = random.Random(8)
    sounds = {"aa": ["th", "er", "ing", "an", "ed", "o"], "bb": ["kül", "ump", "vö", "ß", "sky", "zu"]}
    words = {k: ["".join(r.choice(v) for _ in range(r.randint(1, 3))) for _ in range(400)] for k, v in sounds.items()}
    prose = lambda lang, n: [r.choice(words[lang]) for _ in range(n)]
    rows, base = [], {}
    for i in range(60):
        lang = ("aa", "bb")[i % 2]
        base[i] = prose(lang, r.randint(60, 200))
        rows.append((i, " ".join(base[i]), lang if i % 7 else None, f"s{i % 3}", 0))
    rows += [(100 + i, " ".join(base[i]), "aa", "s0", 0) for i in range(0, 10, 2)]
    for i in range(10, 20):  # near copies, of which the last ones differ in too many words
        w = list(base[i])
        for k in range(0, len(w), 40 if i < 16 else 7):
            w[k] = "changed"
        rows.append((200 + i, " ".join(w), ("aa", "bb")[i % 2], "s1", 0))
    rows += [(300, " ".join(prose("bb", 120)), "aa", "s2", 0), (301, None, "aa", "s0", 0), (302, "", None, None, 0), (303, "1 " * 80, "aa", "s1", 0), (304, "12 345 " * 3 + "\n" + " ".join(map(str, range(90))), "bb", "s0", 0)]
    rows += [(400 + i, " ".join(prose("aa", 80)) if i % 10 == 0 else "too short", "aa", "spam", 0) for i in range(100)]
    rows += [(5, " ".join(prose("bb", 90)), "bb", "s2", 0), (7, " ".join(base[7]), "bb", "s1", 0), (None, " ".join(prose("aa", 90)), "aa", None, 0)]
    return rows


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    out = {}
    page = "<html><body><nav><a href=x>Home</a></nav><article><p>Some words &amp; more of them here.</p></article></body></html>"
    for name, docs, pages in (("full", corpus(), [(0, "u", page), (1, None, None)]), ("empty", [], [])):
        path = tmp_path_factory.mktemp(name)
        spark.createDataFrame(docs, SCHEMA).withColumns({c: F.lit("clash") for c in ("fp", "score", "host", "n", "size")}).write.parquet(str(path / "documents.parquet"))
        spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash")).write.parquet(str(path / "pages.parquet"))
        out[name] = str(path)
    return out


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_gives_its_columns_for_every_row(spark, tables, name):
    assert list(QUERIES) == list(CONTRACT)
    for kind in ("full", "empty"):
        df = QUERIES[name](spark, tables[kind])
        want = CONTRACT[name].split(", ")
        assert [f"{c} {t}" for c, t in df.dtypes][: len(want)] == want
        n = df.count() if name != "op7_packing" else df.where("start = 0").count()
        assert n == (0 if kind == "empty" else 2 if name == "op4_html_extraction" else len(corpus()))


def test_sql_of_the_queries(spark, tables):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tables['full']}/documents.parquet/*.parquet')")
    for name, sql in ORACLE_SQL.items():
        got, want = QUERIES[name](spark, tables["full"]), con.execute(sql)
        columns = [c[0] for c in want.description]
        values = lambda rows: sorted(tuple(map(str, r)) for r in rows)
        assert values(got.select(*columns).collect()) == values(want.fetchall())
        assert got.where("host_rejected").count() == 100


def plain_stages(rows):
    """The kept rows of each filtering stage, by loops over single documents."""
    from strandbase.llm import quality

    def failed(t):
        n, chars, symbols, dup, repeat, lines, upper, letters = quality.measure(None if t is None else t.encode())
        return n < 50 or 100 * repeat > 50 * n or symbols > 0.2 * n or dup > 0.5 * lines or upper > 0.5 * letters or not 2 * n <= chars <= 20 * n

    hosts = collections.defaultdict(list)
    for r in rows:
        hosts[r[3]].append(failed(r[1]))
    m = sum(map(sum, hosts.values())) / len(rows)
    rates = [sum(v) / len(v) for v in hosts.values()]
    mean = sum(rates) / len(rates)
    noise = m * (1 - m) * sum(1 / len(v) for v in hosts.values()) / len(hosts)
    s = min(max(m * (1 - m) / max(sum((x - mean) ** 2 for x in rates) / len(rates) - noise, 1e-9) - 1, 1), 10_000)
    bad = set()
    for h, v in hosts.items():
        rate = (sum(v) + m * s) / (len(v) + s)
        if rate - 2 * (rate * (1 - rate) / (len(v) + s + 1)) ** 0.5 > 0.5:
            bad.add(h)
    assert bad == {"spam"}
    rows = [r for r in rows if not failed(r[1]) and r[3] not in bad]
    yield rows
    taught, seen = collections.defaultdict(collections.Counter), set()
    for i, t, lang, *_ in rows:
        if lang is None or (i, t) in seen or i is not None and zlib.crc32(str(i).encode()) % 3 == 1:
            continue
        seen.add((i, t))
        codes, counts = langid.ngram_counts(t)
        taught[lang].update(dict(zip(codes.tolist(), counts.tolist(), strict=True)))
    profiles = langid.Profiles({k: sorted(c, key=lambda g: (-c[g], g))[: langid.SIZE] for k, c in taught.items()})
    kept = []
    for r in rows:
        lang, score, every = profiles.predict(r[1].encode())
        if lang != "und" and not (r[2] is not None and r[2] != lang and score - sorted(every.values())[-2] > 0.2):
            kept.append(r)
    rows = kept
    yield rows
    g = neardup.Grams(5, 1, 1)
    sets = [frozenset(g.grams(r[1].encode()).tolist()) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                root[find(i)] = find(j)
    classes = collections.defaultdict(list)
    for i, r in enumerate(rows):
        classes[find(i)].append(r)
    yield [min(v, key=lambda r: (r[0] is None, r[0] or 0)) for v in classes.values()]


def test_pipeline_equals_plain_stages(spark, tables):
    from tokenizers import Tokenizer

    import corpus_pipeline as cp

    key = lambda r: (-1 if r[0] is None else r[0], r[1])
    docs = spark.read.parquet(f"{tables['full']}/documents.parquet")
    columns = docs.columns
    for (name, stage), want in zip(cp.STAGES[:-1], plain_stages(corpus()), strict=True):
        docs = common.stored(stage(spark, docs, tables["full"]), name)
        assert docs.columns == columns
        assert sorted(key(r) for r in docs.collect()) == sorted(map(key, want)), name
        assert docs.where("fp != 'clash' or host != 'clash'").count() == 0
    assert 300 not in {r["doc_id"] for r in docs.collect()}
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = cp.run(spark, tables["full"]).collect()
    ids = {key(r)[0]: [*lib.encode(r[1], add_special_tokens=False).ids, 0] for r in want}
    by_seq, total = collections.defaultdict(list), 0
    texts = collections.Counter(len(lib.encode(r[1], add_special_tokens=False).ids) + 1 for r in want)
    assert collections.Counter(p["doc_tokens"] for p in pieces if p["start"] == 0) == texts
    for p in pieces:
        by_seq[p["sequence_id"]].append(p)
        total += p["length"]
        if p["doc_id"] not in (5, 7, None):
            own = ids[p["doc_id"]]
            assert p["doc_tokens"] == len(own)
            assert p["ids_crc32"] == zlib.crc32(np.array(own[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
    assert total == sum(k * n for k, n in texts.items())
    assert sorted(by_seq) == list(range(-(-total // 1024)))
    for k, v in by_seq.items():
        v.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in v] == list(np.cumsum([0] + [p["length"] for p in v])[:-1])
        assert sum(p["length"] for p in v) == (1024 if k < len(by_seq) - 1 else total - 1024 * k)


def test_pipeline_on_an_empty_table(spark, tables):
    import corpus_pipeline as cp

    assert cp.run(spark, tables["empty"]).count() == 0


def test_scratch_of_a_stage_is_removed(spark):
    from strandbase.plans import store

    before = store.written()

    def make():
        return common.stored(spark.range(7), "inner").where("id > 2")

    out = common.settled(make, "outer")
    assert out.count() == 4 and len(store.written()) == len(before) + 1
    store.drop(spark, store.written()[len(before) :])
