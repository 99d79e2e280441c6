"""Toxicity by compression distance: sizes against single frames, held-out labels, what may be learnt from, odd tables."""

import re

import numpy as np
import pyarrow as pa
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspark.llm import common, decontaminate, toxicity

from .test_operators import empty, odd  # noqa: F401  fixtures


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab c,Éß1\n", max_size=90), max_size=5))
def test_windows_hold_all_words(texts):
    laid, low, size, owner = toxicity._segments(decontaminate.Words(*common.flat(pa.array(texts, pa.string()))))
    lower = [t.translate({c: c + 32 for c in range(65, 91)}) for t in texts]
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t) for t in lower]
    want = [(i, f" {' '.join(w[k : k + toxicity.WINDOW])} ") for i, w in enumerate(words) for k in range(0, len(w), toxicity.WINDOW)]
    raw = laid.tobytes()
    assert [(o, raw[a : a + n : 2].decode()) for o, a, n in zip(owner.tolist(), low.tolist(), size.tolist(), strict=True)] == want
    assert raw[::2] == raw[1::2]


def test_sizes_are_those_of_single_frames():
    rng = np.random.default_rng(1)
    words = ["idiot", "the", "and", "thereof", "ou", "eres"]
    texts = [" ".join(words[i] for i in rng.integers(0, 6, n)) for n in (0, 1, 5, 8, 9, 40)]
    ordinary, toxic = b"tthhee  aanndd  tthheerreeooff ", b"  iiddiioott  "
    data, at = common.flat(pa.array(texts))
    laid, low, size, owner = toxicity._segments(decontaminate.Words(data, at))
    gain = []
    for a, n in zip(low.tolist(), size.tolist(), strict=True):
        one = [len(toxicity._compressor(d).compress(laid[a : a + n].tobytes())) for d in (ordinary, toxic + ordinary)]
        gain.append(one[0] - one[1])
    got = toxicity.evidence(ordinary, toxic, data, at)
    for i in range(len(texts)):
        mine = [g for g, o in zip(gain, owner.tolist(), strict=True) if o == i]
        assert np.allclose(got[i], [max([0, *mine]), np.log1p(sum(max(g, 0) for g in mine)), sum(g >= 3 for g in mine) / np.sqrt(max(len(mine), 1)), min(sum(g >= 3 for g in mine), 3), np.log(max(len(mine), 1))])
    assert max(gain) >= 3


def test_dictionaries_hold_what_toxic_rows_share():
    rng = np.random.default_rng(2)
    syllables = ["the", "er", "ou", "and", "ing", "tion", "hea", "st"]
    say = lambda n: ["".join(syllables[i] for i in rng.integers(0, 8, rng.integers(1, 4))) for _ in range(n)]
    texts, labels = [], []
    for k in range(400):
        words = say(60)
        if k % 8 == 0:
            words[10], words[40] = "pathetic", "vequ" + "".join(say(1))
        texts.append(" ".join(words))
        labels.append(k % 8 == 0)
    model = toxicity.fit(texts, labels)
    doubled = lambda s: np.repeat(np.frombuffer(s.encode(), np.uint8), 2).tobytes()
    assert doubled("pathetic") in model.toxic and doubled("vequ") in model.toxic and doubled("pathetic") not in model.ordinary
    seen = [" ".join(say(30) + extra + say(30)) for extra in (["pathetic"], ["vequouou", "pathetic"], [], [])]
    s = model.score(*common.flat(pa.array([*seen, "", None])))
    assert (s[:2] >= 0.5).all() and (s[2:] < 0.5).all() and (s >= 0).all() and (s <= 1).all()


def test_held_out_labels(spark):
    """AUC and recall of English rows on sf0.1; toxic rows in other languages hold nothing that tells them there."""
    data = "/root/testdata/sf0.1"
    found = toxicity.op12_toxicity(spark, data).where("held_out").join(spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    rows = found.join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id").where("toxic is not null and lang = 'en'").collect()
    toxic, other = ([r for r in rows if r.toxic == v] for v in (1, 0))
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic) and sum(r.predicted for r in other) <= 0.02 * len(other)
    pairs = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in toxic for b in other]
    assert sum(pairs) / len(pairs) >= 0.93


def test_held_out_labels_are_not_learnt(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.quality.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, other = toxicity.train(docs, labels), toxicity.train(docs.repartition(7), turned)
    assert one.toxic == other.toxic and one.ordinary == other.ordinary and np.array_equal(one.weight, other.weight) and one.bias == other.bias


def test_odd_tables(spark, odd, empty):  # noqa: F811
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(1, 30)] + [(None, 1, "x"), (4, None, "x"), (6, 1, "x"), (6, 0, "x")], "doc_id long, toxic int, text string")
    got = toxicity.scores(odd, toxicity.train(odd, labels)).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    same = {r.score for r in got if r.doc_id in (2, 3, 5)}
    assert len(same) == 1  # null, empty and blank texts
    assert toxicity.scores(empty, toxicity.train(empty, labels)).count() == 0
    assert {r.score for r in toxicity.scores(odd, toxicity.train(odd, labels.limit(0))).collect()} == {0.5}
    ones = toxicity.scores(odd, toxicity.train(odd, labels.where("toxic = 1"))).collect()
    assert all(r.score > 0.99 for r in ones)
    assert toxicity.keep_civil(odd, labels.limit(0), 0.6).columns == odd.columns


def test_text_bytes_that_come_to_the_driver_are_bounded(spark):
    docs = spark.createDataFrame([(i, "a" * (1000 if i % 10 else 9000)) for i in range(1, 60)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    seen = []
    kept, toxicity.fit = toxicity.fit, lambda texts, marks: seen.append((texts, marks))
    try:
        toxicity.train(docs, labels, most_rows=10, most_bytes=5000)
    finally:
        toxicity.fit = kept
    texts, marks = seen[0]
    for v in (True, False):
        assert 0 < sum(len(t) for t, m in zip(texts, marks, strict=True) if m == v) <= 5000


def test_frames_need_the_dictionary():
    data = np.frombuffer(b"  iiddiioott  ", np.uint8)
    frame = toxicity._compressor(b"xx iiddiioott xx").compress(data.tobytes())
    held = zstandard.ZstdCompressionDict(b"xx iiddiioott xx", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    assert zstandard.ZstdDecompressor(dict_data=held).decompress(frame, max_output_size=100) == data.tobytes()
