"""The screening queries over all documents and recognizers, against brute force on a small table."""

import hashlib
import random
import re

from loomspark import registry
from loomspark.operators import governance

DOCS = [
    (0, "mail a.b@gmail.com or info@example.org"), (1, "her mobile is +63 917 555 0123 now"), (2, "ssn 000-12-3456 here"), (3, "card 4111 1111 1111 1111 stays, 4111 1111 1111 1112 is none"),
    (4, "host 192.0.2.44 and version 10.4.0.1"), (5, "nothing"), (6, ""), (7, "call our office line (202) 555-0180, ssn 123-45-6789, x@y.example"), (8, "1234 in 2026"),
]
_RULES = (("EMAIL", r"[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}"), ("PHONE", r"\+63 917 555 0123|\(202\) 555-0180"), ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"), ("CREDIT_CARD", r"\b4111 1111 1111 1111\b"), ("IP_ADDRESS", r"(?<!version )\b(?:\d+\.){3}\d+\b"))


def masked(text):
    for entity, pattern in _RULES:
        text = re.sub(pattern, f"[{entity}]", text)
    return text


def table(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("doc_id", "text", "'s' AS source").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_stream_screens_all(spark, tmp_path):
    got = {r.doc_id: (r.verdict, r.text_md5) for r in registry.queries()["r3_stream_screen_all"](spark, table(spark, tmp_path)).collect()}
    assert got == {k: ("allowed", md5(masked(t))) for k, t in DOCS}


CLASSES = [
    (0, "EMAIL", "a.b@gmail.com", "personal"), (0, "EMAIL", "info@example.org", "business"), (1, "PHONE", "+63 917 555 0123", "personal"), (2, "SSN", "000-12-3456", "personal"), (3, "CREDIT_CARD", "4111 1111 1111 1111", "personal"),
    (4, "IP_ADDRESS", "192.0.2.44", "infra"), (7, "PHONE", "(202) 555-0180", "business"), (7, "SSN", "123-45-6789", "personal"), (7, "EMAIL", "x@y.example", "ambiguous"),
]


def test_screening_queries_run_all_recognizers(spark, tmp_path):
    d, q = table(spark, tmp_path), registry.queries()
    rows = lambda name: sorted(tuple(r) for r in q[name](spark, d).collect())
    assert rows("d4_classify_all") == sorted(CLASSES)
    assert rows("d5_apply_policy_all") == [(k, "allowed", md5(masked(t))) for k, t in DOCS]
    assert rows("d7_shift_offsets_all") == [(k, len(masked(t)), 0) for k, t in DOCS]
    count = lambda k: sum(c[0] == k for c in CLASSES)
    assert rows("d8_modes_all") == [(k, "allowed" if k % 3 else "unscreened", count(k) if k % 3 else 0, md5(masked(t) if k % 3 == 2 else t)) for k, t in DOCS]
    action = {"personal": "mask", "business": "tag", "ambiguous": "mask", "infra": "tag"}
    assert rows("d10_audit_all") == sorted((k, e, c, "preview", v[0] + "*" * (len(v) - 2) + v[-1], action[c]) for k, e, v, c in CLASSES)
    kinds = [(e, c, action[c]) for _, e, _, c in CLASSES]
    assert rows("a5_summarize_findings_all") == sorted({(*k, kinds.count(k)) for k in kinds})
    blocked = {k for k, _, _, c in CLASSES if c in ("personal", "ambiguous")}
    assert rows("d11_blocked_leave_no_chunks_all") == [(f"s/{k}.txt", 1) for k, t in DOCS if k not in blocked and t]


def plausible(entity, value, before):
    digits = [int(c) for c in value if c.isdigit()]
    if entity == "CREDIT_CARD":
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return entity != "IP_ADDRESS" or (all(int(o) <= 255 for o in value.split(".")) and not re.search(governance.VERSION_BEFORE, before[-governance.VERSION_WINDOW :].lower()))


def found_by_hand(text):
    every = [(m.start(), -len(m[0]), i, name, m[0], sure) for i, (name, pattern, sure, _) in enumerate(governance.RECOGNIZERS) for m in re.finditer(pattern, text) if plausible(name, m[0], text[: m.start()])]
    out, reach = [], 0
    for start, minus, _, name, value, sure in sorted(every):
        if start >= reach:
            reach = start - minus
            out.append((name, value, start, reach, sure))
    return out


def test_findings_by_hand_on_all_documents(spark):
    d = "/root/testdata/sf0.01"
    want = sorted((r.doc_id, *f) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect() for f in found_by_hand(r.text or ""))
    df = registry.queries()["d2_d3_findings"](spark, d)
    assert df._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all") == len(governance.RECOGNIZERS)  # each pattern is searched once
    assert len(want) > 50 and sorted(tuple(r) for r in df.collect()) == want


def test_findings_by_hand_on_odd_texts(spark):
    """Matches that touch, overlap or repeat, other digits, long runs, no text."""
    parts = ["4111 1111 1111 1111", "4111111111111111", "192.0.2.44", "1.2.3.4.5", "000-12-3456", "+63 917 555 0123", "(202) 555-0180", "a@b.co", "version 10.4.0.1", "\u0664\u0665-1", " ", "-", ".", "x", "\n", "build:", "\U0001f600"]
    rng = random.Random(5)
    texts = [None, "", *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(400)), "a@b.co " * 3000 + "12" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {}
    for r in governance.findings_of(governance.detect(docs), "doc_id").collect():
        got.setdefault(r.doc_id, []).append((r.f.entity, r.f.value, r.f.start, r.f.end, r.f.confidence))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(f) for k, t in enumerate(texts) if (f := found_by_hand(t or ""))}
