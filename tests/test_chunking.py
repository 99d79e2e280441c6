"""Properties that hold for every strategy, and the sequential cuts against their rules."""

import hashlib
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from loomspark import registry
from loomspark.functions import ids
from loomspark.operators import chunking, sections
from loomspark.plans import tables

TEXT = "# Top\n\nFirst words here. " + "alpha beta gamma. " * 40 + "\n\n## Two\n" + "delta epsilon zeta eta " * 60 + "\n\n## Three\nshort tail here with enough text to be a section of its own."


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("a/1.txt", TEXT), ("a/2.txt", "   \n\n \t "), ("a/3.txt", None), ("a/4.txt", "one")], "source_key string, text string")


@pytest.mark.parametrize("strategy", ids.STRATEGIES)
def test_contract(docs, strategy):
    rows = chunking.chunk_all(docs, [f"{strategy}-64-16"]).orderBy("source_key", "chunk_index").collect()
    by = {}
    for r in rows:
        by.setdefault(r.source_key, []).append(r)
    assert set(by) <= {"a/1.txt", "a/4.txt"} and "a/1.txt" in by
    for key, chunks in by.items():
        assert [c.chunk_index for c in chunks] == list(range(len(chunks))) and {c.chunk_total for c in chunks} == {len(chunks)}
        assert all(c.content.strip() == c.content != "" for c in chunks) and chunks[0].overlap == 0
        assert all(c.token_count <= 64 for c in chunks)
    joined = " ".join(c.content for c in by["a/1.txt"]).split()
    assert set(TEXT.split()) - {"#", "##"} <= set(joined)


@pytest.mark.parametrize("variant", ["nonsense", "recursive", "recursive-512", "recursive-512-x", "wobbly-512-64", "fixed-128-128", "fixed-63-0", "fixed-8001-0"])
def test_refused(variant):
    with pytest.raises(ValueError):
        ids.parse_variant(variant)


def by_rule(text, size, overlap):
    """Boundary windows checked character by character: (content, note) from the rule alone."""
    text, out = text.strip(), []
    words = [m.span() for m in re.finditer(r"\S+", text)]
    if len(words) <= size:
        return [(text, "whole")] if text else []
    first = 0
    while first < len(words):
        begin = words[first - 1][1] if first else 0
        if first + size >= len(words):
            out.append((text[begin:].strip(), "tail"))
            break
        piece = text[begin : words[first + size - 1][1]]
        ends = range(len(piece), int(len(piece) * 0.75) - 1, -1)
        blank = next((e for e in ends if e and piece[e - 1] == "\n" and re.search(r"\n\s*\n$", piece[:e]) and not re.match(r"\s*\n", piece[e:])), None)
        stop = next((e for e in ends if e > 1 and piece[e - 1].isspace() and piece[e - 2] in ".!?"), None)
        cut = blank if blank is not None else stop
        content = piece[:cut].strip() if cut is not None else piece.strip()
        if content:
            out.append((content, "blank" if blank is not None else "sentence" if stop is not None else "limit"))
        first += max(1, (len(content.split()) or size) - overlap)
    return out


def split_by_rule(text, size, level=0):
    if len(text.split()) <= size:
        return [text] if text else []
    for k, separator in enumerate(["\n\n", "\n", ". ", " "][level:], level):
        if separator in text:
            *parts, last = text.split(separator)
            return [piece for part in [*(x + separator for x in parts), last] for piece in split_by_rule(part, size, k + 1)]
    return [text]  # one word more than size can't be: words are parted by a separator, or by other white space


@given(st.text(alphabet="ab .\n!", max_size=300), st.integers(2, 9), st.integers(0, 1))
def test_boundary_by_rule(text, size, overlap):
    names = {"a blank line": "blank", "a sentence end": "sentence", "break in reach": "limit", "tail": "tail", "fits in one": "whole"}
    got = [(c, next(v for k, v in names.items() if k in note)) for c, _, _, note in chunking.boundary_segments(text, size, overlap)]
    assert got == by_rule(text, size, overlap)


@given(st.text(alphabet="ab .\n", max_size=300), st.integers(2, 9), st.integers(0, 3))
def test_recursive_by_rule(text, size, overlap):
    whole = text.strip()
    pieces = split_by_rule(whole, size)
    marks = chunking.Marks(text)
    edges, _ = chunking.recursive_pieces(marks, size)
    assert [whole[a:b] for a, b in zip(edges, edges[1:], strict=False) if b > a] == pieces
    n = [len(p.split()) for p in pieces]
    want, first = [], 0
    while first < len(pieces):
        last = next(k for k in range(len(pieces), first, -1) if sum(n[first:k]) <= size or k == first + 1)
        want += [c] if (c := "".join(pieces[first:last]).strip()) else []
        if last == len(pieces):
            break
        first = next(k for k in range(first + 1, last + 1) if sum(n[k:last]) <= overlap)
    assert [c for c, _, _, _ in chunking.recursive_segments(text, size, overlap)] == want


@pytest.mark.parametrize("variant", ["boundary-64-16", "recursive-64-16"])
def test_queries_by_rule(spark, data, variant):
    strategy, docs = variant.split("-")[0], {r.source_key: r.text for r in tables.files(spark, data).collect()}
    df = chunking.chunk_all(tables.files(spark, data), [variant])
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in df.collect():
        got.setdefault(r.source_key, []).append((r.chunk_index, r.content, r.chunk_total))
        assert docs[r.source_key].strip()[r.start_offset : r.end_offset] == r.content
    for key, text in docs.items():
        rows = sorted(got.get(key, []))
        assert [i for i, _, _ in rows] == list(range(len(rows))) and {t for _, _, t in rows} <= {len(rows)}
        if strategy == "boundary":
            assert [c for _, c, _ in rows] == [c for c, _ in by_rule(text, 64, 16)]
        else:
            assert "".join(split_by_rule(text.strip(), 64)) == text.strip() and all(len(c.split()) <= 64 for _, c, _ in rows)


@given(st.text(alphabet="ab .\n!", max_size=300), st.integers(2, 9), st.integers(0, 1))
def test_boundary_offsets(text, size, overlap):
    whole = text.strip()
    for content, start, end, _ in chunking.boundary_segments(text, size, overlap):
        assert content and end - start == len(content)
        assert len(content.split()) <= size
    assert "".join("".join(s[0] for s in chunking.boundary_segments(text, size, 0)).split()) == "".join(whole.split())


@given(st.text(alphabet="ab .\n", max_size=300), st.integers(2, 9))
def test_recursive_keeps_all_text(text, size):
    whole = text.strip()
    parts = list(chunking.recursive_segments(text, size, 0))
    assert all(whole[s:e] == c for c, s, e, _ in parts)
    assert "".join("".join(p[0] for p in parts).split()) == "".join(whole.split())


def test_split_and_section_spans(spark, data):
    """Default slices by the rule; every section's span in its document holds its body."""
    docs = {r.source_key: r.text for r in tables.files(spark, data).collect()}
    got = {}
    for r in registry.queries()["c10_split_text"](spark, data).collect():
        got.setdefault(r.source_key, []).append((r.position, r.content_md5))
    for key, text in docs.items():
        assert [m for _, m in sorted(got.get(key, []))] == [hashlib.md5(c.encode()).hexdigest() for c, _ in by_rule(text, 400, 0)]
    f = tables.files(spark, data)
    bodies = {(r.source_key, r.position): r.body for r in sections.sections(f).collect()}
    spans = sections.section_spans(f, found_only=True).collect()
    assert len(spans) > len(docs) / 2
    assert all(docs[r.source_key].strip()[r.start : r.end] == bodies[r.source_key, r.position] for r in spans)


def test_sections_are_cut_in_their_row(spark):
    """No shuffle; of repeated titles each has its ordinal; empty, blank and null texts have no sections; further columns don't matter."""
    rows = [("a", "## T\nfirst\n## U\nsecond\n## T\nthird\n### Sub\nfourth\n## T\nfifth", 1), ("b", "", 2), ("c", None, 3), ("d", " \n \t\n", 4), ("e", "no heading here", 5), ("a", "## T\nalone", 6), ("f", "## Empty\n## Bare", 7)]
    docs = spark.createDataFrame(rows, "source_key string, text string, sections int")
    found = sections.sections(docs)
    for df in (found, sections.headings(docs), sections.section_spans(docs), chunking.chunk_all(docs, ["structural-64-16"])):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.source_key, r.position, r.title, r.level, r.body, tuple(r.subsections)) for r in found.collect())
    assert got == [
        ("a", 0, "T", "top", "alone", ()), ("a", 0, "T", "top", "first", ()), ("a", 1, "U", "top", "second", ()), ("a", 2, "T (2)", "top", "third\n\nSub\nfourth", ("Sub",)),
        ("a", 4, "T (3)", "top", "fifth", ()), ("e", 0, "no heading here", "preamble", "no heading here", ()), ("f", 0, "## Empty", "preamble", "## Empty\n## Bare", ()),
    ]
    spans = {(r.source_key, r.title): (r.start, r.end) for r in sections.section_spans(docs, found_only=True).where("title <> 'T'").collect()}
    assert spans == {("a", "U"): (16, 22), ("a", "T (3)"): (54, 59), ("e", "no heading here"): (0, 15), ("f", "## Empty"): (0, 16)}


@pytest.mark.parametrize("rest, n", [("x" * 39, 0), ("x" * 40, 1), ("x\n\n" + "y" * 37, 1), ("x\n\n" + "y" * 36, 0), ("\n  \n" + "y" * 40 + "  \n\n", 1), ("", 0)])
def test_plain_headings_need_text_after_them(spark, rest, n):
    docs = spark.createDataFrame([("a", f"SECTION ONE\n{rest}")], "source_key string, text string")
    assert [(r.start, r.title, r.level) for r in sections.headings(docs).collect()] == [(0, "SECTION ONE", "top")] * n


@given(st.lists(st.text(alphabet="ab .\n\r\u00a0", max_size=80), max_size=6), st.integers(2, 9), st.integers(0, 3))
def test_documents_of_a_block_are_cut_alone(texts, size, overlap):
    alone = [list(chunking.recursive_segments(t, size, overlap)) for t in texts]
    assert list(chunking.recursive_blocks(texts, size, overlap)) == alone
    assert all(t.strip()[s:e] == c for t, found in zip(texts, alone, strict=True) for c, s, e, _ in found)


def test_section_mapping(spark):
    body = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"term{i}" for i in range(60))
    docs = spark.createDataFrame([("b.txt", f"## One\n{body}\n## Two\n{other}")], "source_key string, text string")
    found = {(r.chunk_index, r.title) for r in sections.map_sections(chunking.chunk_fixed(docs, 64, 0), docs).collect()}
    assert (0, "One") in found and (1, "Two") in found


def test_pages(spark):
    from loomspark.sources import listing

    pages = spark.createDataFrame([("p.pdf", 1, "x" * 100), ("p.pdf", 2, None), ("p.pdf", 3, "y" * 50)], "source_key string, page int, text string")
    row = listing.assemble_pages(pages).first()
    assert [s.page for s in row.spans] == [1, 2, 3] and row.spans[0].start == 0 and row.spans[-1].end == len(row.text)
    assert all(a.end == b.start for a, b in zip(row.spans, row.spans[1:], strict=False))


def test_passages_are_found_in_one_pass(monkeypatch):
    """Against str.find: repetitive and random texts, astral letters, needles longer than the text, over several parts, sums that clash."""
    import random

    import numpy as np

    from loomspark.functions import locate

    rng = random.Random(3)
    for part in (7, 64, 1 << 20):
        monkeypatch.setattr(locate, "PART", part)
        for letters in ("ab", "abcdefgh \n", "a\U0001F600\ud800b", "a"):
            for n in (0, 1, 5, 300):
                whole = "".join(rng.choice(letters) for _ in range(n))
                needles = ["", whole, whole + "x"] + [whole[(i := rng.randrange(n + 1)) : i + rng.randrange(40)] for _ in range(20)] + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(20)]
                assert locate.first_hits(whole, needles) == [whole.find(x) for x in needles]
                cursors = [rng.randrange(n + 3) for _ in needles]
                assert locate.next_hits(whole, needles, cursors) == [p if c <= n and (p := whole.find(x, c)) >= 0 else whole.find(x) for x, c in zip(needles, cursors)]
    monkeypatch.setattr(locate, "BASE", np.uint64(1))
    assert locate.first_hits("xxabba", ["ab", "ba", "bb", "aa", "xb"]) == [2, 4, 3, -1, -1]


def in_turn_by_hand(whole, needles):
    out, cursor = [], 0
    for n in needles:
        hit = whole.find(n, cursor) if whole.find(n, cursor) >= 0 else whole.find(n)
        out.append((max(hit, 0) if hit >= 0 else cursor, hit >= 0))
        cursor = out[-1][0] + len(n)
    return out


def test_passages_in_turn(monkeypatch):
    """Against str.find: near and far, behind the cursor, absent, shorter and longer than a window, over several parts."""
    import random

    from loomspark.functions import locate

    rng = random.Random(7)
    for part, near, width in ((7, 0, 3), (64, 5, 8), (1 << 20, 1 << 12, 32)):
        monkeypatch.setattr(locate, "PART", part)
        monkeypatch.setattr(locate, "NEAR", near)
        monkeypatch.setattr(locate, "WIDTH", width)
        for letters in ("ab", "abcdefgh \n", "a\U0001F600\ud800b", "a"):
            for n in (0, 1, 5, 300):
                whole = "".join(rng.choice(letters) for _ in range(n))
                needles = [whole[(i := rng.randrange(n + 1)) : i + rng.randrange(60)] + rng.choice(["", "", "z"]) for _ in range(30)] + ["", whole, whole + "x"]
                assert locate.hits_in_turn(whole, needles) == in_turn_by_hand(whole, needles)
                absent = locate.absence(whole)
                assert not any(absent(x) for x in needles if x in whole)


def test_located_chunks_keep_their_rows(spark):
    rows = [("d", 0, "alpha", 0), ("d", 1, "alpha", 3), ("d", 2, "nowhere", 4), ("d", 3, None, 2), ("d", 4, "beta", None), ("d", 5, "zzz", None), ("n", 0, "x", 1), ("gone", 0, "x", 0)]
    c = spark.createDataFrame(rows, "source_key string, chunk_index int, content string, cursor int")
    docs = spark.createDataFrame([("d", "  alpha beta alpha ", 9), ("n", None, 9)], "source_key string, text string, start int")
    got = {(r.source_key, r.chunk_index): (r.start, r.end) for r in chunking.locate_chunks(c, docs).collect()}
    assert got == {("d", 0): (0, 5), ("d", 1): (11, 16), ("d", 2): (4, 11), ("d", 3): (2, None), ("d", 4): (6, 10), ("d", 5): (None, None), ("n", 0): (1, 2)}


def test_few_passages_of_a_short_text_are_searched_plainly(monkeypatch):
    """Below the bound no sums are made; above it they find the same, also where the text is cut into parts."""
    from loomspark.functions import locate

    whole = " ".join(f"w{i % 50}" for i in range(600))
    needles = ["w49 w0", "w7 w9", "", "w599", whole[50:146], whole[-96:], whole + "x"]
    want = [whole.find(n) for n in needles]

    def none(s):
        raise AssertionError("sums were made")

    with monkeypatch.context() as m:
        m.setattr(locate, "_codes", none)
        assert locate.first_hits(whole, needles) == want
    monkeypatch.setattr(locate, "PLAIN", 0)
    for part in (locate.PART, 100, 7):
        monkeypatch.setattr(locate, "PART", part)
        assert locate.first_hits(whole, needles) == want


def test_folded_sections_of_documents_without_text(spark, tmp_path):
    """Every document is a section of its binder, as the SQL has it: null and blank ones, and those that hold headings, rules or the marks of the binder."""
    from loomspark.plans import screening
    from loomspark.registry import oracle_sql

    from .oracle import same

    texts = ["a", "b", "", None, " \n", "c", "\x0bd", "", None, "e\n## f\n### g", "x\n========\nTitle\n--------\ny", "\n", "\ue000n", "\ue000q", "\ue000\x0b", None, "  # h", "\n\ndoc-3\n\ue000n"]
    rows = [(1000 * k + (i + k) % len(texts), t, "one") for k in range(4) for i, t in enumerate(texts)]
    rows += [(i, None, "no text") for i in range(8)] + [(3, "", "blank"), (3, "sub first", "alone"), (4, None, "alone"), (7, "i", "alone"), (11, "\x0b", "alone")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.source_key, r.title): (r.body_md5, r.n_sub) for r in screening.s6(spark, str(tmp_path)).collect()}
    empty = "d41d8cd98f00b204e9800998ecf8427e"
    assert got["blank/0", "doc-3"] == (empty, 0) and got["no text/0", "doc-2"] == (None, 1) and got["one/0", "doc-4"] == (empty, 0)
    same(spark, str(tmp_path), screening.s6, oracle_sql()["s6_folded_sections"])
