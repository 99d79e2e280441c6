"""The ten operators against brute force, libraries and round trips, and on odd tables."""

import itertools
import json
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspark.llm import common, components, decontaminate, exact_dedup, packing, quality, sharding, simhash, token_counts, token_files, tokens, url_filter, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")

ODD = [
    (1, "A  b c", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (None, "null id", "x"), (5, " \n\t ", None), (6, "It's don't 'll x's\n\n<|endoftext|> é́ ﬁ", "x"),
    (7, "word " * 30000, "x"), (8, "A  b c", "y"), (9, "a b c d e f g h i j k l", "y"), (10, "日本語 ١٢٣ Ⅷ½ \u0085  z", "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeats, and columns whose names the operators use themselves."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    for c in ("fp", "sha", "n", "node", "mask", "value", "shard", "vslot", "page_id", "url", "html", "score", "host", "path"):
        df = df.withColumn(c, F.lit(1))
    return df


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# --- 1


SIZES = pytest.mark.parametrize("data", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])


@SIZES
def test_decontaminate_equals_brute_force(spark, data):
    docs = [(r.doc_id, r.text) for r in _docs(spark, data).select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    got = sorted(tuple(r) for r in decontaminate.op1_decontaminate(spark, data).collect())
    assert got == sorted(decontaminate.brute_force(docs, items)) and any(r[5] for r in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab c,é", max_size=60), max_size=6), st.lists(st.text(alphabet="ab c,é", max_size=40), max_size=4))
def test_search_shard(texts, items):
    tests = decontaminate.TestSet([(str(i), t.encode()) for i, t in enumerate(items)], 3)
    words, hit, pairs, found = decontaminate.search_shard(tests, *common.flat(pa.array(texts, pa.string())))
    want = decontaminate.brute_force(list(enumerate(texts)), list(enumerate(items)), 3)
    assert int(hit.sum()) == sum(r[2] for r in want) and pairs.shape[1] == sum(r[3] for r in want)
    begins = np.concatenate([[0], np.cumsum(np.bincount(words.text, minlength=len(texts)))])
    got = sorted((t, i, place, word - begins[t], n) for t, i, place, word, n in found.T.tolist())
    assert got == sorted((t, i, *m) for t, text in enumerate(texts) for i, item in enumerate(items) for m in longest_by_hand(text, item, 3))


def test_ranges_at_the_end_of_the_shard():
    """The last suffix of a shard is also the greatest, and windows are longer than what is left of it."""
    tests = decontaminate.TestSet([("0", b"a a b b c c c"), ("1", b"c c c c c c c c c c c")])
    for text in ("x c", "c", "b c c", "a a b b c c c", "c " * 11):
        _, hit, pairs, _ = decontaminate.search_shard(tests, *common.flat(pa.array([text], pa.string())))
        want = decontaminate.brute_force([(0, text)], [(0, "a a b b c c c"), (1, "c c c c c c c c c c c")])[0]
        assert (int(hit.sum()), pairs.shape[1]) == want[2:4]


def longest_by_hand(text, item, window):
    """(item word, word, words) of each match that can't be made longer."""
    a, b = (re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) for t in (item, text))
    least, out = min(len(a), window), set()
    for i, j in itertools.product(range(len(a)), range(len(b))):
        if a[i] == b[j] and not (i and j and a[i - 1] == b[j - 1]):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            out |= {(i, j, n)} if n >= least else set()
    return out


def test_longest_matches_in_blocks_of_tests(spark):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, "x y " + " ".join(words[5:25]) + " z"), (2, "clean text only"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(words[i : i + 25])) for i in (0, 10)] + [(99, "!?"), (None, "clean text")], "item_id long, text string")
    one = {r.doc_id: r for r in decontaminate.longest_matches(docs, bench).collect()}
    many = {r.doc_id: r for r in decontaminate.longest_matches(docs, bench, block_bytes=1).collect()}
    assert [(s.start, s.end) for s in one[1].spans] == [(s.start, s.end) for s in many[1].spans] == [(2, 22)]
    assert one[1].item_ids == many[1].item_ids == ["0", "10"] and one[2].spans == many[2].spans == []
    assert sorted(map(tuple, one[1].matches)) == sorted(map(tuple, many[1].matches)) == [("0", 5, 2, 20), ("10", 0, 7, 15)]
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()} == {2, 3}


def thue_morse(n):
    """Two words of n letters that share every polynomial hash modulo a power of two."""
    bits = [i.bit_count() % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_colliding_words_are_told_apart(spark):
    one, other = thue_morse(1024)
    bench = spark.createDataFrame([(0, one), (1, other)], "item_id long, text string")
    docs = spark.createDataFrame([(0, f"x {one} y"), (1, f"{other}!")], "doc_id long, text string")
    assert {r.doc_id: r.item_ids for r in decontaminate.longest_matches(docs, bench).collect()} == {0: ["0"], 1: ["1"]}


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontaminate.spans, "hashes", lambda data, start, end: np.full(len(start), 7, np.uint64))
    tests = decontaminate.TestSet([("0", b"a b c"), ("1", b"c b a")])
    _, _, pairs, _ = decontaminate.search_shard(tests, *common.flat(pa.array(["x a b c", "a c b a", "d e"], pa.string())))
    assert pairs.T.tolist() == [[0, 0], [1, 1]]
    monkeypatch.setattr(tokens.spans, "quick_hashes", lambda data, start, end: np.full(len(start), 7, np.uint64))
    texts = ["one two three", "six", "one one two"] * 2
    enc = tokens.Encoder(BYTE)
    ids, at = enc.encode(*common.flat(pa.array(texts, pa.string())))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(6)] == [library_byte().encode(t).ids for t in texts]


# --- 2, 6, 10


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_library(path):
    texts = [t for _, t, _ in ODD[:-1]] + [ODD[-1][1], "x.\nY, z!\n\n a  b", "| a |b|", "<|startoftext|>x", *(w for n in (1024, 2048, 4096) for w in thue_morse(n))]
    enc, lib = tokens.Encoder(path), library(path)
    for _ in range(2):  # cold and from the cache
        ids, at = enc.encode(*common.flat(pa.array(texts, pa.string())))
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abrvlestmd'' \n\t1,.é<| 日́!"), max_size=80))
def test_counter_equals_library(text):
    got = token_counts.counter(BYTE).count(*common.flat(pa.array([text, "", text + text], pa.string())))
    lib = library_byte()
    assert got.tolist() == [len(lib.encode(t, add_special_tokens=False).ids) for t in (text, "", text + text)]


@pytest.mark.parametrize("states", [150_000, 300])
def test_long_words_are_composed_of_parts(states, monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_STATES", states)
    rng = np.random.default_rng(4)
    letters = lambda n, of: "".join(rng.choice(list(of), n))
    texts = ["a" * 3000, letters(5000, "ab"), letters(2000, "etaoinshrdlu"), letters(1500, "日本語中文字漢"), "x " + letters(700, "abc") + ". " + letters(900, "xyzé"), "ab" * 800 + " c", "9" * 1000, "-" * 257 + "=" * 256]
    got = token_counts.TokenCounter(BYTE).count(*common.flat(pa.array(texts, pa.string())))
    assert got.tolist() == [len(library_byte().encode(t, add_special_tokens=False).ids) for t in texts]


_LIB: list = []


def library_byte():
    if not _LIB:
        _LIB.append(library(BYTE))
    return _LIB[0]


def test_character_classes_equal_library():
    """Each code point beside a letter, a digit and a mark is split as the library does."""
    counter, lib = token_counts.counter(BYTE), library_byte()
    points = [chr(i) for i in itertools.chain(range(0x3000), range(0xFB00, 0xFFFE), range(0x1D400, 0x1D500))]
    texts = [f"a{c}1{c}!{c} {c}b" for c in points]
    got = counter.count(*common.flat(pa.array(texts, pa.string()))).tolist()
    want = [len(e.ids) for e in lib.encode_batch_fast(texts, add_special_tokens=False)]
    assert [points[i] for i in range(len(texts)) if got[i] != want[i]] == []


@SIZES
def test_token_counts_of_documents(spark, data, odd, empty):
    lib = library_byte()
    want = {r.doc_id: len(lib.encode(r.text, add_special_tokens=False).ids) for r in _docs(spark, data).collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.op6_token_counts(spark, data).collect()} == want
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(odd, BYTE).collect())
    assert got == sorted((k or -1, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for k, t, _ in ODD)
    assert token_counts.token_counts(empty, BYTE).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=900), st.data())
def test_codes_are_directly_addressable(ids, draw):
    raw = token_files.encode_file(np.array(ids, np.uint32), np.array([4]), np.array([False]), np.array([0]))
    f = token_files.TokenFile(lambda at, n: raw[at : at + n], len(raw))
    assert f.slice(0, len(ids)).tolist() == ids
    if ids:
        i = draw.draw(st.integers(0, len(ids) - 1))
        j = draw.draw(st.integers(i, len(ids)))
        assert f[i] == ids[i] and f.slice(i, j).tolist() == ids[i:j]


def _expected_files(rows, path):
    lib, at, out = library(path), 0, []
    for k, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@SIZES
def test_token_files(spark, data, odd, empty):
    docs = sorted((r.doc_id, r.text) for r in _docs(spark, data).collect())
    assert sorted(tuple(r) for r in token_files.op2_token_files(spark, data).collect()) == _expected_files(docs, WORD)
    write = lambda df: token_files.read_token_files(common.saved(token_files.write_token_files(df, WORD, common.fresh(spark, "t")), "m")).collect()
    got = sorted((tuple(r) for r in write(odd)), key=lambda r: r[1])
    assert got == _expected_files(sorted(((k, t) for k, t, _ in ODD), key=lambda r: (r[0] is not None, r[0] or 0)), WORD)
    assert write(empty) == []


def check_pieces(docs, pieces, window=2048):
    by, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for key, copies in docs.items():
        assert sum(r.length for r in by[key]) == len(copies[0]) * len(copies)
        for r in by[key]:
            assert r.doc_tokens == len(copies[0]) and r.ids_crc32 == zlib.crc32(np.array(copies[0][r.start : r.start + r.length], "<u4").tobytes())
        cover = np.zeros(len(copies[0]), int)
        for r in by[key]:
            cover[r.start : r.start + r.length] += 1
        assert (cover == len(copies)).all()
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
    return sum(n for p in sequences.values() for _, n in p) / (window * len(sequences))


@SIZES
@pytest.mark.parametrize("group", [16384, 40])
def test_packing(spark, data, group):
    lib = library_byte()
    docs = {r.doc_id: [[*lib.encode(r.text, add_special_tokens=False).ids, 1]] for r in _docs(spark, data).collect()}
    filled = check_pieces(docs, packing.digests(packing.pack(_docs(spark, data), BYTE, group_docs=group)).collect())
    assert filled > 0.98


def test_packing_of_odd_rows(odd, empty):
    lib, docs = library_byte(), defaultdict(list)
    for k, t, _ in ODD:
        docs[k].append([*lib.encode(t or "", add_special_tokens=False).ids, 1])
    check_pieces(docs, packing.digests(packing.pack(odd, BYTE)).collect())
    assert packing.pack(empty, BYTE).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 15), max_size=120), st.integers(0, 15))
def test_plan_places_every_token_once(tails, fill):
    tails = np.array(tails, np.int64)
    tail, start, sequence, offset, opened, end_fill = packing.plan(tails, 16, fill)
    assert set(tail.tolist()) == set(range(len(tails))) and len(set(zip(tail.tolist(), start.tolist(), strict=True))) == len(tail)
    used = defaultdict(list)
    order = np.lexsort((start, tail))
    for a, i in enumerate(order.tolist()):
        last = a + 1 == len(order) or tail[order[a + 1]] != tail[i]
        used[int(sequence[i])].append((int(offset[i]), int((tails[tail[i]] if last else start[order[a + 1]]) - start[i])))
    for s, parts in used.items():
        at = fill if s == 0 else 0
        for o, n in sorted(parts):
            assert o == at and n > 0
            at += n
        assert at <= 16 and (at == 16 or s == opened)
    assert 0 <= end_fill <= 16


# --- 3


def test_url_filter(spark):
    urls = ["http://A.Example.COM/en/7x?q", "https://example.com/en/8", "http://com/en/", "http://xcom/en/", "ftp://b.example.net/de/8#x", "http://n.net/de/1", "http://o.org/es", None, "no scheme", "http://", "://x.org/es/", "http://x.org?/es/", ""]
    pages = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(urls + urls[:2])], "page_id long, url string, verdict string").withColumn("host", F.lit(1)).withColumn("__x", F.lit(2))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")).collect()}
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") == got[13]
    assert got[1][2:] == ("com/en/", "block") and got[2][2:] == ("com/en/", "block") and got[3][2:] == (None, "allow")
    assert got[4][2:] == ("example.net/de/8", "block") and got[5][2:] == ("net/de/", "allow") and got[6][2:] == (None, "allow")
    assert got[7] == got[8] == ("", "", None, "allow") and got[9][:2] == ("", "") and got[10][2] == "org/es/" and got[11][:2] == ("x.org", "")
    assert url_filter.judge(pages.limit(0), spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")).count() == 0


def test_url_rules_are_the_contracts(spark, tmp_path):
    """Each rule's word, in the query and in its SQL, on one url a rule and on one that none fits."""
    from ..oracle import same

    urls = {"http://www.com/en/": "block", "http://a.example.com/en/7": "allow", "http://b.net/de/9": "allow", "http://example.net/de/8": "block", "http://c.org/es/": "block", "http://example.net/en/": "allow"}
    spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = url_filter.op3_url_filter(spark, str(tmp_path)).orderBy("page_id").collect()
    assert [r.verdict for r in got] == list(urls.values())
    assert [r.rule for r in got] == ["com/en/", "example.com/en/7", "net/de/", "example.net/de/8", "org/es/", None]
    same(spark, str(tmp_path), url_filter.op3_url_filter, url_filter.ORACLE_SQL["op3_url_filter"])


def test_bloom_filter_misses_none(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    bloom = url_filter.build_filter(keys, 5000)
    h = np.array([r.h for r in keys.collect()])
    block, bits = url_filter._places(h, len(bloom))
    assert ((bloom[block] & bits) == bits).all()
    other = np.array([r.h for r in spark.range(5000, 15000).select(F.xxhash64("id").alias("h")).collect()])
    block, bits = url_filter._places(other, len(bloom))
    assert ((bloom[block] & bits) == bits).all(axis=1).mean() < 0.02


# --- 4


def test_exact_dedup_of_odd_rows(odd, empty):
    got = exact_dedup.exact_groups(odd).collect()
    body = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for k, t, _ in ODD:
        groups[body(t)].append((k, t or ""))
    want = []
    for members in groups.values():
        keep = min((m for m in members), key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        want += [(str(k), str(keep), len(members), k == keep) for k, _ in members]
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == sorted(want)
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.deduplicate(odd).columns == odd.columns


def test_exact_dedup_of_the_least_id(spark):
    rows = [(-(2**63), "a b"), (4, "ab"), (None, "ab")]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(-(2**63), 3)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=60), st.lists(st.integers(0, 40), max_size=60))
def test_filters_merge_without_loss(a, b):
    def of(values):
        fp, n = np.unique(np.array(values, np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(4), return_counts=True)
        return exact_dedup.QuotientFilter.of(4, fp, n)

    whole, both = exact_dedup.QuotientFilter.merged([of(a), of(b), of([])]), of(a + b)
    again = exact_dedup.QuotientFilter.loads(whole.dumps())
    for x in (whole, again):
        assert x.fingerprints(0).tolist() == both.fingerprints(0).tolist() and x.counts.tolist() == both.counts.tolist()


# --- 5


def test_warc_bundles(spark):
    big = "<p>" + "x" * 200
    rows = [(5, "http://a", big), (2, "http://b\r\n: c", big), (9, None, big), (1, "u", "small"), (3, "u", "small"), (4, "u", None), (None, "u", big), (7, "u", "é" * 70000), (2, "again", big), (9, "other", big + "!")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit("mine"))
    index = common.saved(warc.write_bundles(pages, common.fresh(spark, "w")), "i")
    got = sorted((r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_bundles(index).collect())
    n = len(big)
    assert got == [(-1, n, "response", None), (1, 5, "response", None), (2, n, "response", None), (2, n, "response", None), (3, 5, "response", None), (4, 0, "response", None), (5, n, "revisit", 2), (7, 140000, "response", None), (9, n, "revisit", 2), (9, n + 1, "response", None)]
    for r in index.collect():
        headers, block = warc.open_bundle(r.uri, r.bytes).record(r.frame, r.offset)
        assert headers["X-Page-Id"] == ("null" if r.page_id is None else str(r.page_id)) and len(block) == int(headers["Content-Length"]) and block.startswith(b"HTTP/1.1 200 OK")
    bundles = {r.uri: r.bytes for r in index.collect()}
    named = [(h["WARC-Type"], h["WARC-Record-ID"]) for uri, size in bundles.items() for h, _ in warc.open_bundle(uri, size).records()]
    assert len({x for _, x in named}) == len(named) == len(rows) + len(bundles) and sum(t == "warcinfo" for t, _ in named) == len(bundles)
    some = warc.read_bundles(index.where("page_id = 9")).collect()
    assert sorted((r.page_id, r.refers_to or 0) for r in some) == [(9, 0), (9, 2)]
    assert warc.write_bundles(pages.limit(0), common.fresh(spark, "w")).count() == 0


@pytest.mark.parametrize("blocks", [None, 1])
def test_records_are_found_by_their_identifiers(spark, monkeypatch, blocks):
    """Each identifier of the bundles is in the index once, repeated and null page ids too, and revisits name a response of
    their payload; with a filter of one block, which passes nearly all, the records are the same."""
    if blocks:
        monkeypatch.setattr(warc, "_filter", lambda keys: (lambda h: np.ones(len(h), bool)))
    rng = np.random.default_rng(7)
    rows = [(None if i % 11 == 0 else int(rng.integers(0, 60)), f"http://u/{i % 40}", f"<p>{int(rng.integers(0, 25)):0>150}" if i % 3 else "small") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    index = warc.write_bundles(pages, common.fresh(spark, "w"))
    found = {}
    for r in index.collect():
        headers, block = warc.open_bundle(r.uri, r.bytes).record(r.frame, r.offset)
        assert headers["WARC-Record-ID"] == f"<urn:uuid:{r.record_id}>" and r.record_id not in found
        found[r.record_id] = (r.page_id, headers, block)
    bundles = {r.uri: r.bytes for r in index.collect()}
    listed = [h["WARC-Record-ID"][10:-1] for uri, size in bundles.items() for h, _ in warc.open_bundle(uri, size).records() if h["WARC-Type"] != "warcinfo"]
    assert sorted(listed) == sorted(found) and len(listed) == len(rows)
    first = {}
    for k, _, html in rows:
        if k is not None and len(html) >= 100:
            first[html] = min(first.get(html, k), k)
    want = sorted((-1 if k is None else k, "revisit" if k is not None and html in first and k > first[html] else "response") for k, _, html in rows)
    assert want == sorted((-1 if k is None else k, h["WARC-Type"]) for k, h, _ in found.values())
    for k, headers, _ in found.values():
        if headers["WARC-Type"] == "revisit":
            named, other, block = found[headers["WARC-Refers-To"][10:-1]]
            assert other["WARC-Type"] == "response" and other["WARC-Payload-Digest"] == headers["WARC-Payload-Digest"] and named == int(headers["X-Refers-To-Page"]) < k
            assert other["WARC-Target-URI"] == headers["WARC-Refers-To-Target-URI"] and first[warc.http_payload(block)[0].decode()] == named


def test_bundle_frames_are_independent():
    w = warc.BundleWriter()
    places = [w.add(warc.make_record(f"n{i}", i, f"u{i}", bytes([65 + i % 26]) * 50_000, 50_000, b"d" * 32)) for i in range(30)]
    raw = w.finish()
    b = warc.Bundle(lambda at, n: raw[at : at + n], len(raw))
    assert len(b.sizes) > 3 and len(list(b.records())) == 30
    assert all(warc.http_payload(b.record(f, o)[1])[0] == bytes([65 + i % 26]) * 50_000 for i, (f, o, _) in enumerate(places))


# --- 7


@SIZES
def test_sharding(spark, data, odd, empty):
    rows = common.saved(sharding.with_slot(_docs(spark, data)), "s")
    docs = {r.doc_id: r.text for r in _docs(spark, data).collect()}
    vslot = {r.doc_id: r.vslot for r in rows.collect()}
    # placement by hand: slots in turn, then moves from the heaviest to the lightest shard
    sizes = defaultdict(int)
    for k, t in docs.items():
        sizes[vslot[k]] += len(t.encode()) + 16
    placed = {s: s % 40 for s in range(sharding.SLOTS)}
    load = [sum(sizes[s] for s in range(k, sharding.SLOTS, 40)) for k in range(40)]
    mean = sum(load) / 40
    while not (min(load) >= 0.999 * mean and max(load) <= 1.001 * mean):
        heavy, light = load.index(max(load)), load.index(min(load))
        gap = load[heavy] - load[light]
        fits = [(abs(gap / 2 - sizes[s]), s) for s in sizes if placed[s] == heavy and 0 < sizes[s] < gap]
        if not fits:
            break
        s = min(fits)[1]
        placed[s], load[heavy], load[light] = light, load[heavy] - sizes[s], load[light] + sizes[s]
    want, nth = {}, defaultdict(int)
    for s in sorted(sizes):
        for k in sorted(k for k in docs if vslot[k] == s):
            want[k] = (placed[s], nth[placed[s]])
            nth[placed[s]] += 1
    got = sharding.op7_shards(spark, data).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == want and len(got) == len(docs)
    assert all((r["size"], r.text_crc32) == (len(docs[r.doc_id].encode()) + 16, zlib.crc32(docs[r.doc_id].encode())) for r in got)
    assert len(sharding.shard_documents(odd, 3, 64).collect()) == len(ODD) and sharding.shard_documents(empty, 3, 64).count() == 0


def test_sharding_is_even_at_size(spark):
    load = defaultdict(int)
    for r in sharding.op7_shards(spark, "/root/testdata/sf0.1").collect():
        load[r.shard] += r["size"]
    assert len(load) == 40 and max(load.values()) < 1.01 * min(load.values())


def test_one_key_is_dealt_out(spark):
    docs = spark.range(6000).select(F.when(F.col("id") > 2000, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.lit("same text").alias("text"))
    rows = sharding.shard_documents(docs, 4, 64).collect()
    load = defaultdict(list)
    for r in rows:
        load[r.shard].append(r.slot)
    assert len(rows) == 6000 and all(sorted(s) == list(range(len(s))) for s in load.values())
    assert max(map(len, load.values())) < 1.1 * min(map(len, load.values()))


def test_slot_maps_are_edited(spark):
    sizes = {s: 100 + s % 7 for s in range(200)}
    first = sharding.first_map(sizes, 4)
    grown = sharding.rebalanced(first, sizes, 5)
    moved = {s for s in first if first[s] != grown[s]}
    assert moved and {grown[s] for s in moved} == {4}
    sizes[next(s for s in first if first[s] == 0)] += 5000
    even = sharding.rebalanced(first, sizes, 4)
    load = lambda m: [sum(sizes[s] for s in m if m[s] == k) for k in range(4)]
    assert max(load(even)) - min(load(even)) < max(load(first)) - min(load(first))
    folder = common.fresh(spark, "maps")
    sharding.save_map(spark, folder, 0, first)
    sharding.save_map(spark, folder, 1, even)
    assert {r.vslot: r.shard for r in sharding.load_map(spark, folder, 0).collect()} == first
    with pytest.raises(Exception, match="exist"):
        sharding.save_map(spark, folder, 1, first)


# --- 8


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.op8_quality(spark, d).collect()}
    assert len(got) == _docs(spark, d).count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    pairs = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert np.mean([p.predicted == q for p, q in pairs]) > 0.9
    assert all(p.predicted == 1 for p, q in pairs if q == 1)


def test_quality_of_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (6, 1), (None, 1), (9, None), (10, 0)], "doc_id long, quality int").withColumn("text", F.lit("mine"))
    assert quality.scores(odd, quality.train(odd, labels)).count() == len(ODD)
    assert quality.scores(odd, quality.train(odd, labels.limit(0))).count() == len(ODD)
    assert quality.scores(empty, quality.train(empty, labels.limit(0))).count() == 0
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_risk_and_prior_of_a_toy():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0, 1, (20000, 4)), rng.normal(0, 1, (6000, 4)) + np.r_[4.0, np.zeros(3)]
    for share in (0.3, 0.8):
        n = int(8000 * share)
        mixed = np.concatenate([good[4000 : 4000 + n], bad[: 8000 - n] if share < 0.5 else bad[:1600]])
        p, u = quality.second_moments(good[:4000]), quality.second_moments(mixed)
        line, centre, spread = quality.contrast(p, u)
        edges = np.linspace(centre - 8 * spread, centre + 8 * spread, 1001)
        histogram = lambda x: np.histogram(np.clip(line.line(x), edges[0], edges[-1]), edges)[0]  # noqa: B023, E731
        prior = quality.estimated_prior(histogram(good[:4000]), histogram(mixed))
        assert abs(prior - n / len(mixed)) < 0.05
        model = quality.fit(p, u, prior)
        assert (model.score(good[15000:]) > 0.5).mean() > 0.9 and (model.score(bad[5700:]) < 0.5).mean() > 0.8
        assert np.allclose(model.score(good[:5]), np.clip((1 + model.line(good[:5])) / 2, 0, 1))


def test_risk_of_negatives_stays_at_zero(monkeypatch):
    """With more features than rows the unbiased risk of the negatives would fall below zero; brute force over steps agrees."""
    monkeypatch.setattr(quality, "RIDGE", 0.001)
    rng = np.random.default_rng(2)
    p, u = rng.normal(0, 1, (30, 40)), rng.normal(0.1, 1, (35, 40))
    model = quality.fit(quality.second_moments(p), quality.second_moments(u), 0.9)
    g = lambda x: model.line(x)
    negatives = np.mean((1 + g(u)) ** 2) - 0.9 * np.mean((1 + g(p)) ** 2)
    assert abs(negatives) < 1e-6

    def risk(w, b):
        gp, gu = ((x - model.mean) * model.scale @ w + b for x in (p, u))
        return 0.9 * np.mean((1 - gp) ** 2) + max(0, np.mean((1 + gu) ** 2) - 0.9 * np.mean((1 + gp) ** 2)) + 0.001 * (1 + 41 / 30) * (w @ w)

    best = risk(model.weight, model.bias)
    for _ in range(300):
        assert risk(model.weight + rng.normal(0, 0.01, 40), model.bias + rng.normal(0, 0.01)) >= best - 1e-9


def test_moments_and_prior_are_of_all_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = _docs(spark, d), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality._flagged(docs, labels, 10**6)
    every, positive = quality._sums(rows.repartition(7))
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    texts = [(r.doc_id, r.text) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    of = lambda t: quality.second_moments(quality.features(*common.flat(pa.array(t, pa.string()))).astype(np.float64))
    assert np.allclose(every, of([t for _, t in texts]), rtol=1e-4) and np.allclose(positive, of([t for k, t in texts if k in good]), rtol=1e-4)
    model, centre, spread = quality.contrast(positive, every)
    counts = quality._histograms(rows, model, centre - 8 * spread, centre + 8 * spread)
    assert counts[0].sum() == len(texts) and counts[1].sum() == sum(k in good for k, _ in texts)


# --- 9


def reference_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def reference_components(fingerprints):
    """{doc_id: smallest reachable doc_id}"""
    ids = list(fingerprints)
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(ids, 2):
        if (fingerprints[a] ^ fingerprints[b]).bit_count() <= 3:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@SIZES
def test_simhash_of_documents(spark, data):
    docs = {r.doc_id: r.text for r in _docs(spark, data).collect()}
    fps = {k: reference_fingerprint(t) for k, t in docs.items()}
    got = {r.doc_id: r for r in simhash.op9_simhash(spark, data).collect()}
    assert {k: r.fingerprint for k, r in got.items()} == {k: f"{f:016x}" for k, f in fps.items()}
    assert {k: r.component_id for k, r in got.items()} == reference_components(fps)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2**64 - 1) | st.integers(0, 31)), max_size=150), st.sampled_from([0, 1, 2, 3, 4, 9, 20]))
def test_close_pairs(rows, radius):
    rows.sort()
    group, fp = np.array([g for g, _ in rows], np.int64), np.array([f for _, f in rows], np.uint64)
    got = {(int(a), int(b)) for i, j in simhash.close_pairs(fp, group, radius) for a, b in zip(i, j, strict=True)}
    assert got == {(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if group[a] == group[b] and (int(fp[a]) ^ int(fp[b])).bit_count() <= radius}


def test_links_and_hot_buckets(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 12)]
    fps = {}
    for k in range(300):
        f = base[k % 12]
        for b in rng.integers(0, 64, k % 6):
            f ^= 1 << int(b)
        fps[k] = f & ((1 << 64) - 1)
    first = {}
    for k, f in fps.items():
        first.setdefault(f, k)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    nodes = spark.createDataFrame([(signed(f), k) for f, k in first.items()], "fp long, node long")
    want = reference_components({k: f for f, k in first.items()})
    for hot in (4096, 5):
        monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
        found = {r.node: r.component for r in components.components(simhash.near_links(nodes)).collect()}
        assert {k: found.get(k, k) for k in want} == want


@pytest.mark.parametrize("n", [10, 10**7, 10**9, 10**12])
def test_masks_lose_no_pair(n):
    masks, rng = simhash.first_masks(n, 3), np.random.default_rng(0)
    for _ in range(200):
        flips = [int(b) for b in rng.choice(64, 3, replace=False)]
        assert any(not any(m >> b & 1 for b in flips) for m in masks)


def test_simhash_of_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert {r.fingerprint for r in got if r.doc_id in (2, 3, 5)} == {"0" * 16} and {r.component_id for r in got if r.doc_id in (2, 3, 5)} == {2}
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicate(odd).columns == odd.columns


def test_null_ids_carry_links(spark, monkeypatch):
    rows = [(4, 0), (None, 0b111), (2, 0b111111), (9, -1), (None, 1 << 40 | 0xFFFFFF)]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle: spark.createDataFrame(rows, "doc_id long, fp long"))
    got = {(r.doc_id, int(r.fingerprint, 16)): r.component_id for r in simhash.near_duplicates(spark.range(1)).collect()}
    assert got == {(4, 0): 2, (None, 7): 2, (2, 63): 2, (9, (1 << 64) - 1): 9, (None, 1 << 40 | 0xFFFFFF): None}
    with pytest.raises(ValueError, match="radius"):
        simhash.near_links(spark.range(1).select(F.col("id").alias("fp"), F.col("id").alias("node")), 40)


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (105, 101), (200, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {k: got[k] for k in range(1, 61)} == dict.fromkeys(range(1, 61), 0) and got[101] == got[105] == 100 and 200 not in got


# --- the rest of the contract


def test_decontaminate_of_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "b c d e f g h i j k"), (None, "a"), (3, None)], "item_id long, text string")
    got = decontaminate.longest_matches(odd, bench).collect()
    assert len(got) == len(ODD) and [r.doc_id for r in got if r.spans] == [9]
    assert decontaminate.longest_matches(empty, bench).count() == 0 and decontaminate.longest_matches(odd, bench.limit(0)).where("size(spans) > 0").count() == 0
    assert decontaminate.decontaminate(odd, bench).columns == odd.columns


def test_queries_with_sql_equal_it(spark, data):
    from loomspark.llm import registry

    from ..oracle import same

    queries, sql = registry.queries(), registry.oracle_sql()
    assert [int(k[2:].split("_")[0]) for k in queries if k != "pipeline"] == list(range(1, 11)) and "pipeline" in queries
    for name, statement in sql.items():
        same(spark, data, queries[name], statement)


def test_pipeline_stages_equal_brute_force(spark, data):
    import corpus_pipeline as cp

    from .test_stages import brute_force_components

    docs = _docs(spark, data)
    text = {r.doc_id: r.text for r in docs.collect()}
    model = quality.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    kept = {r.doc_id for r in quality.scores(docs, model).collect() if r.score >= 0.3}
    groups = defaultdict(list)
    for k in kept:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text[k])].append(k)
    kept2 = {min(g, key=lambda k: (-len(text[k]), k)) for g in groups.values()}
    rows = [(k, text[k]) for k in sorted(kept2)]
    kept3 = {rows[i][0] for i, least in brute_force_components(rows).items() if i == least}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    kept4 = {r[0] for r in decontaminate.brute_force([(k, text[k]) for k in kept3], items) if not r[5]}
    out = docs
    for (_, stage), want in zip(cp.STAGES[:-1], (kept, kept2, kept3, kept4), strict=True):
        out = common.saved(stage(spark, out, data), "stage")
        assert {r.doc_id for r in out.collect()} == want and out.columns == docs.columns
    lib = library_byte()
    check_pieces({k: [[*lib.encode(text[k], add_special_tokens=False).ids, 1]] for k in kept4}, cp.STAGES[-1][1](spark, out, data).collect())
    assert cp.run(spark, data).count() > 0


def test_vocabulary_format():
    with open(BYTE, encoding="utf-8") as f:
        assert json.load(f)["model"]["type"] == "BPE"


def test_url_filter_on_clashing_columns_and_long_hosts(spark):
    names = ("row", "at", "id", "key", "best", "rule_host", "__row", "__keys", "__key", "Rule", "a.b")
    long = "http://" + "a." * 20_000 + "example.com/en/7"
    pages = spark.createDataFrame([(1, long), (2, "http://" + "x" * 500_000 + ".org/es/" + "y" * 500_000), (3, "http://none.example/")], "page_id long, url string")
    for c in names:
        pages = pages.withColumn(c, F.lit("mine"))
    got = {r.page_id: r for r in url_filter.judge(pages, spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")).collect()}
    assert {k: (r.rule, r.verdict) for k, r in got.items()} == {1: ("example.com/en/7", "allow"), 2: ("org/es/", "block"), 3: (None, "allow")}
    assert all(r[c] == "mine" for r in got.values() for c in names if c != "Rule")
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert {r.verdict for r in url_filter.judge(pages, none, "block").collect()} == {"block"}


def test_many_rule_shapes_by_brute_force(spark):
    """Rules of 400 path lengths and up to 6 labels; the plan is as long as with a few rules."""
    import io
    from contextlib import redirect_stdout

    def lines(df):
        out = io.StringIO()
        with redirect_stdout(out):
            df.explain("simple")
        return out.getvalue().count("\n")

    rng = np.random.default_rng(5)
    part = lambda k: "".join("abc"[i] for i in rng.integers(0, 3, k))
    hosts = [".".join(part(1) for _ in range(int(rng.integers(1, 7)))) for _ in range(300)]
    tail = part(500)
    rules = {(h, "/" + tail[: int(rng.integers(0, 400))]): ("block", "allow")[int(rng.integers(0, 2))] for h in hosts for _ in range(4)}
    pages = [(i, f"http://{part(1)}.{hosts[int(rng.integers(0, 300))]}/{tail[: int(rng.integers(0, 500))]}") for i in range(400)]
    table = spark.createDataFrame([(v, h, p) for (h, p), v in rules.items()], "verdict string, host string, path string")
    made = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), table)
    plan = lines(made)
    got = {r.page_id: (r.rule, r.verdict) for r in made.collect()}
    for i, url in pages:
        host, _, path = url[7:].partition("/")
        fits = [(len(h) + len(p), len(h), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        assert got[i] == (max(fits)[2:] if fits else (None, "allow"))
    assert sum(r is not None for r, _ in got.values()) > 50

    few = url_filter.judge(spark.createDataFrame(pages[:1], "page_id long, url string"), table.limit(2))
    assert plan == lines(few)
