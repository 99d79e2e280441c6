"""Ranked lexical search and importance resampling against brute force, and on odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspark.llm import decontaminate, importance, lexical

from .test_operators import empty, odd  # noqa: F401  fixtures

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


# --- 11


def searched_by_hand(docs, items, top=10):
    """The contract of op11 for lists of (doc_id, text) and (item_id, text), in plain Python."""
    bags = [(i, Counter(words(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_all, df = len(bags), sum(n for *_, n in bags), Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for doc, bag, n in bags:
            m, score = 100 - 90 + (90 * n * n_docs) // n_all, 0
            for t in set(words(text)) & set(bag):
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def searched(spark, docs, items, **options):
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in lexical.search(docs.repartition(3), items, **options).collect()), key=str)


def test_search_of_documents(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted((tuple(r) for r in lexical.op11_lexical_search(spark, data).collect()), key=str)
    assert got == searched_by_hand(docs, items) and len(got) > 300


def test_copies_ties_and_blocks(spark, monkeypatch):
    """Groups of copies with more members than are asked for, in several tasks, flushes and blocks of items."""
    rng = np.random.default_rng(3)
    texts = ["alpha beta", "alpha beta gamma", "beta alpha", "Gamma, gamma!", "delta", "", None, "x " * 50 + "alpha", "ß É é alpha"]
    docs = [(int(i), texts[int(rng.integers(len(texts)))]) for i in rng.permutation(120)] + [(None, "alpha beta"), (None, "delta"), (7, "delta"), (7, "delta")]
    items = [(1, "Alpha"), (2, "beta beta gamma"), (3, "nowhere"), (4, None), (5, "--"), (None, "alpha"), (6, "delta x"), (6, "delta x"), (8, "é É")]
    want = searched_by_hand(docs, [i for i in items if i[0] is not None])
    assert searched(spark, docs, items) == want
    monkeypatch.setattr(lexical, "HELD_BYTES", 1)
    monkeypatch.setattr(lexical, "HELD_SCORES", 1)
    monkeypatch.setattr(lexical, "BLOCK_OF_ITEMS", 8)
    assert searched(spark, docs, items) == want
    assert searched(spark, docs, items, top=200) == searched_by_hand(docs, [i for i in items if i[0] is not None], 200)


def test_large_scores_stay_whole():
    items = decontaminate.TestSet([("a", b"x y"), ("b", b"y")], 1)
    p = lexical.Postings(items, np.array([0, 5, 7]))
    bag = np.array([[1, 3], [2, 1]], "<i4").tobytes()
    small = [s.tolist() for _, s in p.scores(np.array([20]), [bag])]
    p.most = 1 << 60
    assert small == [s.tolist() for _, s in p.scores(np.array([20]), [bag])] == [[[5 * (3000000000 // 3160) + 7 * (1000000000 // 1160), 7 * (1000000000 // 1160)]]]


def test_search_of_odd_tables(spark, odd, empty):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    items = spark.createDataFrame([(1, "a b C", "z"), (2, "word", "z"), (3, "日本語", "z")], "item_id long, text string, doc_id string")
    got = sorted((tuple(r) for r in lexical.search(odd, items).collect()), key=str)
    assert got == searched_by_hand(rows, [(1, "a b C"), (2, "word"), (3, "日本語")]) and got
    assert lexical.search(empty, items).count() == 0 and lexical.search(odd, items.limit(0)).count() == 0
    assert lexical.search(odd, items.select(F.lit("k").alias("item_id"), "text").limit(1)).first().item_id == "k"


# --- 13


def weighed_by_hand(docs, target):
    """The contract of op13 for lists of (doc_id, text) and texts."""

    def features(text):
        w = words(text)
        return [x.encode() for x in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    counts = []
    for texts in ([t for _, t in docs], target):
        counts.append(Counter(zlib.crc32(f) % 10000 for t in texts for f in features(t)))
    s, t = counts
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for doc, text in docs:
        f = features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in (zlib.crc32(x) % 10000 for x in f)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append((doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))))
    fits = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = fits[: 25 * len(fits) // 100]
    return sorted([(*r[:4], k + 1) for k, r in enumerate(drawn)] + [(*r[:4], None) for r in fits[len(drawn) :]] + [(*r[:4], None) for r in rows if r[4] < 20], key=str)


@pytest.mark.parametrize("data", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_weights_of_documents(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in importance.op13_importance(spark, data).collect()), key=str)
    assert got == weighed_by_hand(docs, target) and any(r[4] for r in got)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab c,Éß1", max_size=80), st.integers(1, 9), st.integers(1, 3))
def test_checksums_of_parts(text, part, grams):
    got, n_words = Counter(), 0
    before = importance.PART_BYTES
    importance.PART_BYTES = part
    try:
        for n, sums in importance.checksums(text.encode(), grams):
            n_words += n
            for k, s in enumerate(sums):
                got.update((k, x) for x in s)
    finally:
        importance.PART_BYTES = before
    w = words(text)
    want = Counter((k, zlib.crc32(" ".join(w[i : i + k + 1]).encode())) for k in range(grams) for i in range(len(w) - k))
    assert got == want and n_words == len(w)


def test_ranks_of_repeated_rows(spark):
    """One id with a third of all rows, null ids, ties over the edge of what is drawn."""
    text = " ".join(f"w{i}" for i in range(25))
    docs = [(i, text) for i in range(200)] + [(5, text)] * 100 + [(None, text)] * 20 + [(6, "short"), (7, ""), (8, None)]
    target = [("w1 w2",), (None,)]
    d, t = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(target, "text string")
    got = importance.weighed(d, t).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted((tuple(r) for r in got.collect()), key=str) == weighed_by_hand(docs, [x for (x,) in target])


def test_weights_of_odd_tables(spark, odd, empty):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    target = spark.createDataFrame([("word word", 1)], "text string, bucket int")
    got = importance.weighed(odd, target).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted((tuple(r) for r in got.collect()), key=str) == weighed_by_hand(rows, ["word word"])
    assert importance.weighed(empty, target).count() == 0
    assert importance.weighed(odd, target.limit(0)).count() == len(rows)
    drawn = importance.resample(odd, target, least_words=1, share=50)
    assert drawn.columns == odd.columns and 0 < drawn.count() < len(rows)
