"""Fixed chunks know where they begin and end."""

from loomspark.operators import chunking, sections


def test_offsets_of_repeated_passages(spark):
    texts = {"a.txt": "  one two\n" * 90 + " ", "b.txt": "same words here " * 70, "c.txt": "short", "d.txt": "é 日本 x\n\n" * 50, "e.txt": " ", "f.txt": None}
    docs = spark.createDataFrame(list(texts.items()), "source_key string, text string")
    rows = chunking.chunk_fixed(docs, 64, 16).collect()
    assert {r.source_key for r in rows} == {"a.txt", "b.txt", "c.txt", "d.txt"}
    for r in rows:
        whole = texts[r.source_key].strip()
        assert whole[r.start_offset : r.end_offset] == r.content
        assert len(whole[: r.start_offset].split()) == 48 * r.chunk_index


def test_fixed_chunks_have_pages(spark):
    docs = spark.createDataFrame([("a.pdf", "word " * 200)], "source_key string, text string")
    pages = spark.createDataFrame([("a.pdf", 1, 0, 500), ("a.pdf", 2, 500, 999)], "source_key string, page int, start int, end int")
    got = sections.stamp_pages(chunking.chunk_fixed(docs, 64, 0), pages).orderBy("chunk_index").collect()
    assert [(r.page_start, r.page_end) for r in got] == [(1, 1), (1, 2), (2, 2), (2, 2)]


def test_windows_of_a_long_text_carry_no_tokens(spark):
    """Sizes and overlaps of all shapes against plain Python; what goes on from a document is its windows, cut in its own row."""
    import re

    body = " \t" + "".join(f"{sep}w{i}" for i, sep in zip(range(3000), [" ", "\n\n", "\x0b", "\u00a0", " \r\n"] * 600)) + "\n "
    docs = spark.createDataFrame([("a", body), ("b", " \n"), ("c", None), ("d", "one")], "source_key string, text string")
    stripped = body.strip(" \t\n\x0b\f\r")
    tokens = re.findall(r"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+", stripped)
    for size, overlap in ((64, 16), (64, 0), (70, 69), (3000, 10), (100, 60)):
        cut = chunking.chunk_fixed(docs, size, overlap)
        got = {(r.source_key, r.chunk_index): (r.content, r.start_offset, r.end_offset, r.token_count, r.chunk_total) for r in cut.collect()}
        n = max(0, -(-(len(tokens) - size) // (size - overlap))) + 1
        for w in range(n):
            part = tokens[w * (size - overlap) :][:size]
            end = len("".join(tokens[: w * (size - overlap) + size]))
            content = "".join(part).lstrip(" \t\n\x0b\f\r")
            assert got.pop(("a", w)) == (content, end - len(content), end, len(part), n) and stripped[end - len(content) : end] == content
        assert got == {("d", 0): ("one", 0, 3, 1, 1)}
    plan = chunking.chunk_fixed(docs, 64, 16)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan


def test_the_stored_index_is_built_without_a_shuffle(spark, data):
    from loomspark.plans import tables

    plan = tables._indexed(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1
