"""Which rows the pipeline's stages keep."""

import itertools
import random

import corpus_pipeline as cp
from loomspark.llm import near_copies, simhash
from pyspark.sql import functions as F


def brute_force_components(rows):
    """{index: least (id is null, id, index) reachable} over all pairs with 0.8 of their five-word shingles in common."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, j in itertools.combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            parent[find(j)] = find(i)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return {i: min(g, key=lambda k: (rows[k][0] is None, rows[k][0] or 0)) for g in groups.values() for i in g}


def _words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_near_stage_equals_brute_force(spark):
    rng, rows = random.Random(3), []
    for _ in range(40):
        text = _words(rng, 100)
        rows.append((len(rows), " ".join(text)))
        for changed in (1, 2, 2, 3, 9):  # a changed word changes five shingles of 96: two leave a similarity of 0.81
            other = list(text)
            for i in rng.sample(range(0, 100, 7), changed):
                other[i] = "changed" + str(rng.random())
            rows.append((len(rows), " ".join(other)))
    rows += [(None, rows[0][1] + " end"), (None, " ".join(_words(rng, 50))), (0, " ".join(_words(rng, 60))), (900, "Two words"), (901, "two  WORDS"), (902, ""), (903, None)]
    want = {k for i, k in brute_force_components(rows).items() if i == k}
    far = sum(1 for i, k in brute_force_components(rows).items() if i != k)
    assert far >= 120
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = cp.near_stage(spark, docs, "").collect()
    assert sorted(map(str, got)) == sorted(str(r) for i, r in enumerate(docs.collect()) if i in want)


def test_near_stage_keeps_one_repeated_row(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, "d e f", "x"), (None, "g", "x"), (None, "g", "x")]
    got = cp.near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()
    assert sorted(map(tuple, got), key=str) == sorted(set(rows), key=str)


def test_candidates_at_the_limit():
    rng, found = random.Random(5), 0
    for _ in range(300):
        text = _words(rng, 124)
        other = [*text[:60], "x", *text[61:90], "y", *text[91:]]  # 110 of 130 shingles: 0.846
        h, count = near_copies.hashed([" ".join(text).encode(), " ".join(other).encode()])
        a, b = near_copies._buckets(near_copies.sketches_of(h, count))
        x, y = simhash.majority(h, count).tolist()
        found += (a == b).any() and (x ^ y).bit_count() <= near_copies.RADIUS
    assert found == 300


def test_large_bucket_in_tiles_equals_brute_force(spark, monkeypatch):
    """A group of near copies most of which aren't similar to its least row, in chunks of a few rows."""
    monkeypatch.setattr(near_copies, "TILE", 16)
    rng, rows = random.Random(9), []
    base = _words(rng, 120)
    for k in range(130):
        other = list(base)
        for i in rng.sample(range(120), 1 + k % 12):
            other[i] = f"own{k}x{i}"
        rows.append((k, " ".join(other)))
    rng.shuffle(rows)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    want = {k for i, k in brute_force_components(rows).items() if i == k}
    assert 5 < len(want) < 120
    got = cp.near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert {r.doc_id for r in got} == want


def test_recall_on_planted_near_copies(spark):
    """Copies with words changed, dropped and added at random places: all at 0.8 or more go."""
    rng, rows, planted = random.Random(11), [], []
    for k in range(150):
        text = _words(rng, rng.choice((40, 150, 600)))
        rows.append((k, " ".join(text)))
        other = list(text)
        for _ in range(max(1, len(text) // 100)):
            i = rng.randrange(len(other))
            other[i : i + 1] = rng.choice(([], ["new"], [other[i], "put"]))
        rows.append((1000 + k, " ".join(other)))
        sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (text, other)]
        if len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]):
            planted.append(1000 + k)
    got = {r.doc_id for r in cp.near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert len(planted) > 100 and not got & set(planted) and set(range(150)) <= got


def test_stages_on_empty_and_odd_tables(spark):
    rows = [(None, None, None), (1, "", "x"), (1, "", "x"), (2, "word " * 30000, "x"), (3, "a b c", None), (3, "a b c", None), (None, "a  b c", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("node", F.lit(1)).withColumn("fp", F.lit(2)).withColumn("bucket", F.lit("x"))
    docs = docs.withColumn("__key0", F.lit(3)).withColumn("__row", F.lit(4)).withColumn("__shorter", F.lit(5))
    d = "/root/testdata/sf0.001"
    for name, stage in cp.STAGES:
        for frame in (docs, docs.limit(0)):
            got = stage(spark, frame, d)
            assert got.count() <= frame.count() + (100 if name == "pack" else 0)
            assert name == "pack" or got.columns == docs.columns


def test_exact_stage_drops_rows_not_ids(spark):
    rows = [(None, "a b"), (1, "ab"), (None, "unique"), (5, "x"), (5, "a  b"), (7, "r"), (7, "r"), (7, "r "), (None, "n"), (None, "n"), (8, None), (9, " ")]
    got = cp.exact_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, "unique"), (5, "x"), (5, "a  b"), (7, "r "), (None, "n"), (9, " ")]))
