"""Stored tables, decoding, JSONL, uploads, pointers and guards."""

import re

import pytest
from pyspark.sql import functions as F

from loomspark.operators import golden, search, status
from loomspark.sources import lines, listing, stored

V = "space string, vector_id string, source_key string, document_id string, chunk_index int, chunk_total int, content string, source_etag string, embedded_at timestamp, embedding_model string"


def test_replace_partitions_touches_only_its_own(spark, tmp_path):
    path = str(tmp_path / "v")
    stored.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "id int, space string"), path, "space")
    stored.replace_partitions(spark.read.parquet(path).where("space = 'b'").withColumn("id", F.col("id") + 10), path, "space")
    assert sorted((r.id, r.space) for r in spark.read.parquet(path).collect()) == [(1, "a"), (12, "b")]


def test_missing_table_reads_empty(spark, tmp_path):
    assert stored.read_table(spark, str(tmp_path / "none"), V).count() == 0 and not (tmp_path / "none").exists()


def test_unreadable_ids_stay_and_spaces_need_a_name(spark):
    v = spark.createDataFrame([("", "d#00001"), ("", "d#00007"), ("", "odd")], "space string, vector_id string")
    assert {r.vector_id for r in stored.pruned(v, "", 5).collect()} == {"d#00001", "odd"}
    with pytest.raises(ValueError):
        stored.drop_space(v, "")


def test_decode(spark):
    rows = [(1, "héllo".encode()), (2, b"\xef\xbb\xbfmark"), (3, b"caf\xe9 \x93q\x94"), (4, b"\x81\xe9"), (5, b""), (6, None)]
    got = {r.id: r.text for r in listing.decode_text(spark.createDataFrame(rows, "id int, content binary")).collect()}
    assert got == {1: "héllo", 2: "mark", 3: "café “q”", 4: "\x81é", 5: "", 6: None}


def test_scan_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("hi")
    row = listing.scan_sources(spark, f"file:{tmp_path}", "a/").first()
    assert (row.source_key, row.size, row.etag) == ("a/x.txt", 2, "49f68a5c8493ec2c0bf489821c21fc3b")


def test_jsonl(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"id": "Q1", "answer": "a"}\n\n{"id": "Q2"}\n')
    assert [(r.id, r.answer) for r in lines.read_jsonl(spark, str(good), "id string, answer string").orderBy("id").collect()] == [("Q1", "a"), ("Q2", None)]
    for n, bad in enumerate(["{oops", '{"answer": "no id"}']):
        f = tmp_path / f"bad{n}.jsonl"
        f.write_text(bad + "\n")
        with pytest.raises(Exception, match="bad line"):
            lines.read_jsonl(spark, str(f), "id string, answer string").collect()


def test_replace_and_artifacts(spark):
    src = spark.createDataFrame([("a", "1"), ("b", "2")], "source_key string, text string")
    vec = spark.createDataFrame([("a", "v1"), ("b", "v2")], "source_key string, vector_id string")
    s, v = listing.replace_sources(src, spark.createDataFrame([("a", "new")], "source_key string, text string"), vec)
    assert {(r.source_key, r.text) for r in s.collect()} == {("a", "new"), ("b", "2")} and [r.vector_id for r in v.collect()] == ["v2"]
    ex = spark.createDataFrame([("d", [("table-001", "|a|", 1, "c")])], "document_id string, tables array<struct<table_id:string,markdown:string,page:int,caption:string>>")
    assert listing.table_artifacts(ex, "d", "table-001").first().markdown == "|a|" and listing.table_artifacts(ex, "e").count() == 0


def test_reindex_of_unchanged_text_embeds_nothing(spark):
    docs = spark.createDataFrame([("a.txt", "x " * 200)], "source_key string, text string")
    from loomspark.operators import chunking

    c = chunking.chunk_fixed(docs, 64, 16)
    held = stored.upserted(spark.createDataFrame([], V), c.select("vector_id", "source_key", "document_id", "chunk_index", "chunk_total", "content"), "", "m")
    assert {r.action for r in status.index_plan(c, held, "", "m").collect()} == {"reuse"}
    assert {r.action for r in status.index_plan(c, held, "", "m", force=True).collect()} == {"embed"}
    fewer = held.where("chunk_index < 2")
    plan = {r.chunk_index: r.action for r in status.index_plan(c, fewer, "", "m").collect()}
    assert plan[0] == "embed" and plan[1] == "reuse" and plan[2] == "embed"


def test_pointer(spark):
    v = spark.createDataFrame([("fixed-64-16", "d#00000", "k", "d", 0, 2, "t", "e", None, "m")], V)
    with pytest.raises(ValueError, match="interrupted"):
        status.point_at(status.variants(v), "fixed-64-16")
    with pytest.raises(ValueError, match="no vectors"):
        status.point_at(status.variants(v), "fixed-128-16")
    assert status.point_at(status.variants(v.withColumn("chunk_total", F.lit(1))), "fixed-64-16").first().space == "fixed-64-16"
    lost = status.production(spark.createDataFrame([("fixed-128-16",)], "space string"), status.variants(v)).first()
    assert lost.state == "missing"
    assert status.variants(v.withColumn("space", F.lit("prod"))).count() == 0


def test_model_guard(spark):
    m = spark.createDataFrame([(1, "m"), (2, None)], "id int, embedding_model string")
    assert len(search.assert_same_model(m, "m").collect()) == 2
    with pytest.raises(Exception, match="query with other"):
        search.assert_same_model(m, "other").collect()


def test_embed_in_batches(spark):
    out = search.embed(spark.createDataFrame([("a",), ("bb",)], "content string"), lambda texts: [[float(len(t))] for t in texts], "len", 1)
    assert {(r.content, r.embedding[0], r.embedding_model) for r in out.collect()} == {("a", 1.0, "len"), ("bb", 2.0, "len")}


GOLD = "id string, type string, difficulty string, numeric_answer double, numeric_tolerance double, answer_keys array<string>, forbidden_keys array<string>, must_refuse boolean, gold_sections array<string>"


@pytest.mark.parametrize(
    ("gold", "answer", "correct"),
    [
        (("1", "lookup", "easy", None, None, ["41"], None, None, ["S"]), "It is 1041.", True),
        (("1", "lookup", "easy", None, None, ["41", "b"], None, None, ["S"]), "41", False),
        (("1", "arithmetic", "easy", 2024.0, None, None, None, None, ["S"]), "in 2024-2025", True),
        (("1", "arithmetic", "easy", -2025.0, None, None, None, None, ["S"]), "in 2024-2025", True),
        (("1", "arithmetic", "easy", 1234.5, None, None, None, None, ["S"]), "1,234.52 in all", True),
        (("1", "arithmetic", "easy", 1234.5, 0.01, None, None, None, ["S"]), "1,234.52 in all", False),
        (("1", "lookup", "easy", None, None, ["a"], [""], None, ["S"]), "a", False),
        (("1", "unanswerable", "easy", None, None, ["half"], None, True, []), "Half is so; the rest is NOT  stated.", True),
        (("1", "unanswerable", "easy", None, None, ["half"], None, True, []), "The rest is not stated.", False),
        (("1", "lookup", "easy", None, None, ["a"], None, None, []), None, False),
    ],
)
def test_scorer(spark, gold, answer, correct):
    p = spark.createDataFrame([("1", answer, ["s "])], "id string, answer string, retrieved_sections array<string>")
    row = golden.score_predictions(spark.createDataFrame([gold], GOLD), p).first()
    assert row.correct is correct
    assert (row.recall, row.precision) == ((1.0, 1.0) if gold[-1] else (None, None))


def test_extractions_replace_their_own(spark, tmp_path):
    path, schema = str(tmp_path / "ex"), "document_id string, text string"
    stored.save_extractions(spark.createDataFrame([("a", "1"), ("b", "2")], schema), path, 2)
    stored.save_extractions(spark.createDataFrame([("a", "new"), ("c", "3")], schema), path, 2)
    assert {(r.document_id, r.text) for r in stored.extractions_table(spark, path, schema).read().collect()} == {("a", "new"), ("b", "2"), ("c", "3")}
    t = "document_id string, table_id string"
    gone = stored.pruned_artifacts(spark.createDataFrame([("a", "t1"), ("a", "t2"), ("b", "t1")], t), spark.createDataFrame([("a", "t1")], t))
    assert [(r.document_id, r.table_id) for r in gone.collect()] == [("a", "t2")]


def test_chunk_in_sql(spark):
    from loomspark.functions import ids, sql
    from loomspark.operators import chunking

    sql.register(spark)
    docs = spark.createDataFrame([("a", "x. " * 150)], "source_key string, text string")
    docs.createOrReplaceTempView("sql_docs")
    for v in ("fixed-64-16", "recursive-64-16", "boundary-64-0"):
        got = [r.content for r in spark.sql(f"SELECT c.* FROM sql_docs, LATERAL chunk(text, '{v}') c ORDER BY position").collect()]
        assert got == [r.content for r in chunking.chunk_all(docs, [v]).orderBy("chunk_index").collect()]
    assert ids.resolve_variant("fixed-64-16", "boundary", 128, 0) == "fixed-64-16" and ids.resolve_variant(None, "boundary", 128, 0) == "boundary-128-0" and ids.resolve_variant(None) == ""


def test_values_read_back(spark):
    from loomspark.functions import values

    df = spark.createDataFrame([("1704067200.5",), ("x",), (None,), ("nan",), ("1e400",), ("-3.9",), ("",), ("99999999999999",)], "v string")
    rows = df.select(values.from_epoch("v").cast("string").alias("at"), values.as_count("v").alias("n"), values.as_page("v").alias("p")).collect()
    assert [r.at for r in rows] == ["2024-01-01 00:00:00.5", None, None, None, None, "1969-12-31 23:59:56.1", None, None]
    assert [r.n for r in rows] == [1704067200, 0, 0, 0, 0, -3, 0, 99999999999999] and [r.p for r in rows][1:7] == [None, None, None, None, -3, None]


def test_bad_lines_have_numbers_in_split_files(spark, tmp_path):
    """Two files of several splits each, blank lines among them, against numbers counted by hand."""
    want = set()
    for name, step in (("a", 7), ("b", 11)):
        rows = ["" if i % 5 == 0 else "{oops" if i % step == 0 else '{"answer": "no id"}' if i % step == 1 else f'{{"id": "Q{i}", "answer": "{"x" * (i % 90)}"}}' for i in range(1, 2000)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(rows) + "\n")
        want |= {(name, n, r) for n, r in enumerate(rows, 1) if r and '"id"' not in r}
    schema, old = "id string, answer string", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        assert lines._heads(lines._tagged(spark, str(tmp_path), lines.T._parse_datatype_string(schema))).groupBy("file").count().where("count > 4").count() == 2
        got = {(r.file[-7], r.line, r.value) for r in lines.bad_lines(spark, str(tmp_path), schema).collect()}
        assert got == want
        first = min(want)
        with pytest.raises(ValueError, match=rf"bad line {first[1]} of .*a\.jsonl: "):
            lines.read_jsonl(spark, str(tmp_path), schema)
        (tmp_path / "late").mkdir()
        late = [f'{{"id": "Q{i}"}}' for i in range(3000)] + ["{"]
        (tmp_path / "late" / "c.jsonl").write_text("\n".join(late))
        with pytest.raises(ValueError, match=r"bad line 3001 of "):
            lines.read_jsonl(spark, str(tmp_path / "late" / "c.jsonl"), schema)
        (tmp_path / "late" / "none.jsonl").write_text("")
        assert lines.read_jsonl(spark, str(tmp_path / "late" / "none.jsonl"), schema).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_search_grid_equals_broadcast(spark):
    """Repeated questions and vectors, ties, nulls, string ids, empty sides; dense and sparse, against plain NumPy and each other."""
    import numpy as np

    from loomspark.operators import search

    rng = np.random.default_rng(5)
    v = [(f"v{i % 150}", rng.integers(-2, 3, 8).astype(float).tolist()) for i in range(150)] + [("same", [1.0] * 8)] * 400 + [(None, [0.5] * 8), ("none", None)]
    q = [(i, rng.integers(-2, 3, 8).astype(float).tolist()) for i in range(60)] + [(99, [0.1] * 8)] * 70 + [(100, None), (None, [0.05] * 8)]
    qs, vs = spark.createDataFrame(q, "question_id long, embedding array<double>").repartition(3), spark.createDataFrame(v, "vector_id string, embedding array<double>").repartition(5)
    rows = lambda df: sorted(map(str, df.select("question_id", "vector_id", "score", "rank").collect()))
    small, grid = rows(search.search(qs, vs, 7)), search.search(qs, vs, 7, question_bytes=64 * 9)
    assert rows(grid) == small and len(small) == 62 * 7 and "BroadcastNestedLoop" not in grid._jdf.queryExecution().toString()
    want = {}
    for i, e in q[:60]:
        scored = sorted((-round(float(np.clip(np.dot(e, x), 0, 1)), 6), (n is not None, n or "")) for n, x in v if x)
        want[i] = [(n[1] or None, -s) for s, n in scored[:7]]
    for i in want:
        got = [(r.vector_id, r.score) for r in grid.where(f"question_id = {i}").orderBy("rank").collect()] if i % 20 == 0 else None
        assert got is None or got == want[i]
    assert search.search(qs.limit(0), vs, 3).count() == 0 and search.search(qs, vs.limit(0), 3, question_bytes=64).count() == 0
    flat = lambda df, key: df.where("embedding is not null").dropDuplicates([key]).select(key, F.posexplode("embedding").alias("bucket", "weight")).where("weight <> 0")
    sq, sv = flat(qs, "question_id").where("question_id is not null"), flat(vs, "vector_id").where("vector_id is not null")
    assert rows(search.search_sparse(sq, sv, 5)) == rows(search.search_sparse(sq, sv, 5, question_bytes=8 * 1024 * 7))


def test_search_grid_shuffles_vectors_by_what_a_task_holds(spark):
    """Questions too many to broadcast lie in few tiles, so each vector is sent to few cells; small tiles give the same rows."""
    import numpy as np

    from loomspark.operators import search

    rng = np.random.default_rng(7)
    rows = lambda df: sorted(map(str, df.collect()))
    vs = spark.createDataFrame([(i, rng.integers(-2, 3, 8).astype(float).tolist()) for i in range(400)], "vector_id long, embedding array<double>")
    qs = vs.where("vector_id % 2 = 0").withColumnRenamed("vector_id", "question_id")
    grid = search.search(qs, vs, 5, question_bytes=64)
    plan = grid._jdf.queryExecution().analyzed().toString()
    sent = [int(x) for x in re.findall(r"sequence\(0, (\d+)", plan)]
    assert sorted(sent) == [0, 0], "one tile and one slice"
    assert rows(grid) == rows(search.search(qs, vs, 5)) == rows(search.search(qs, vs, 5, question_bytes=64, tile_bytes=64 * 9))


def test_context_scores_are_rounded_from_their_exact_value(spark):
    """All scores of six decimals that lie half way between two of three, against Python's formatting."""
    from loomspark.operators import search

    scores = [(i, (2 * i + 1) / 2000) for i in range(1000)] + [(1000, 1.0), (1001, 0.0), (1002, 0.123456)]
    m = spark.createDataFrame(scores, "question_id long, score double").withColumns({c: F.lit("x") for c in ("content", "vector_id", "source", "document_id")}).withColumns({"dropped": F.lit(False), "rank": F.lit(0)})
    got = {r.question_id: r.context for r in search.context_block(m, "{score}").collect()}
    assert got == {i: f"{x:.3f}" for i, x in scores}
