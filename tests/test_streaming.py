"""Streams equal their batch results; reruns change nothing."""

from pyspark.sql import functions as F

from loomspark.operators import chunking
from loomspark.streaming import jobs

FILES = "source_key string, text string, last_modified timestamp"


def _files(spark, rows, path):
    spark.createDataFrame(rows, "source_key string, text string").withColumn("last_modified", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def _run(spark, df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_index_follows_files(spark, tmp_path):
    src, out, cp = str(tmp_path / "in"), str(tmp_path / "vec"), str(tmp_path / "cp")
    _files(spark, [("a.txt", "x " * 200), ("b.txt", "y " * 30)], src)
    go = lambda: jobs.stream_index(spark.readStream.schema(FILES).parquet(src), out, cp, "fixed-64-16", "m").awaitTermination(120)
    go()
    _files(spark, [("a.txt", "x " * 70)], src)
    go()
    go()
    want = chunking.chunk_fixed(spark.createDataFrame([("a.txt", "x " * 70), ("b.txt", "y " * 30)], "source_key string, text string"), 64, 16)
    key = lambda df: sorted((r.vector_id, r.content) for r in df.select("vector_id", "content").collect())
    assert key(jobs.index_table(spark, out).read()) == key(want)


def test_index_cuts_as_the_space_says_and_keeps_columns(spark, tmp_path):
    """A boundary space over two batches: what a batch doesn't touch keeps its embedding, an emptied file leaves nothing."""
    src, out, cp = str(tmp_path / "in"), str(tmp_path / "vec"), str(tmp_path / "cp")
    text = "First words here. " + "alpha beta gamma. " * 60 + "\n\n" + "delta epsilon " * 50
    embed = lambda df: df.withColumn("embedding", F.array(F.length("content").cast("float")))
    go = lambda: jobs.stream_index(spark.readStream.schema(FILES).parquet(src), out, cp, "boundary-64-16", "m", embed).awaitTermination(120)
    _files(spark, [("a.txt", text), ("b.txt", "y " * 200), ("c.txt", "gone " * 10)], src)
    go()
    before = {r.vector_id: r for r in jobs.index_table(spark, out).read().where("source_key = 'b.txt'").collect()}
    _files(spark, [("a.txt", text + " And a new end."), ("c.txt", " ")], src)
    go()
    want = chunking.chunk_all(spark.createDataFrame([("a.txt", text + " And a new end."), ("b.txt", "y " * 200)], "source_key string, text string"), ["boundary-64-16"])
    now = jobs.index_table(spark, out).read().collect()
    assert sorted((r.vector_id, r.content, r.chunk_total) for r in now) == sorted((r.vector_id, r.content, r.chunk_total) for r in want.collect())
    assert all(r.embedding == [float(len(r.content))] and r.source_etag for r in now)
    assert {r.vector_id: r for r in now if r.source_key == "b.txt"} == before


def test_indexed_in_two_batches_equals_batch(spark, data):
    from loomspark import registry
    from loomspark.plans import tables

    f = tables.files(spark, data).withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" And more."))).otherwise(F.col("text")))
    want = chunking.chunk_all(f, ["boundary-64-16"]).select("vector_id", "chunk_index", F.md5("content").alias("m")).collect()
    got = registry.queries()["r1_stream_index_boundary"](spark, data).collect()
    assert sorted((r.vector_id, r.chunk_index, r.content_md5) for r in got) == sorted(map(tuple, want)) and all(r.embedding_model for r in got)


def _shuffled(spark, after=-1):
    """(bytes written to shuffles by stages after a stage, the last stage)."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    stages = [stages.apply(i) for i in range(stages.size())]
    return sum(s.shuffleWriteBytes() for s in stages if s.stageId() > after), max((s.stageId() for s in stages), default=-1)


def test_an_index_batch_shuffles_contents_once(spark, tmp_path):
    """Texts that don't compress: a batch moves its chunks and what their buckets hold once, and no text."""
    import hashlib

    src, out, cp = str(tmp_path / "in"), str(tmp_path / "vec"), str(tmp_path / "cp")
    word = lambda *at: hashlib.sha256(repr(at).encode()).hexdigest()
    text = lambda doc, end: " ".join(word(doc, i) for i in range(600)) + end
    go = lambda: jobs.stream_index(spark.readStream.schema(FILES).parquet(src), out, cp, "boundary-64-16", "m").awaitTermination(120)
    held = 0
    for end in ("", " more"):
        _files(spark, [(f"{d}.txt", text(d, end)) for d in range(60)], src)
        before = _shuffled(spark)[1]
        go()
        now = jobs.index_table(spark, out).read().agg(F.sum(F.length("content"))).first()[0]
        assert 0 < _shuffled(spark, before)[0] < 1.3 * (held + now)
        held = now


def test_index_batches_equal_a_plain_reckoning(spark, tmp_path):
    """Over three batches: files that come twice, unknown times, emptied files; vectors of another model or space, with ids that can't be read, and too many of them."""
    import datetime
    import random

    src, out, cp, space = str(tmp_path / "in"), str(tmp_path / "vec"), str(tmp_path / "cp"), "boundary-64-16"
    rng, table = random.Random(5), jobs.index_table(spark, out)
    key = lambda r: (r.space, r.vector_id)
    facts = lambda r: (r.content, r.source_etag, r.embedding_model, r.chunk_index, r.chunk_total, r.source_key)
    text = lambda: "".join(rng.choice(("alpha ", "beta. ", "gamma ", "\n\n")) for _ in range(rng.choice((0, 10, 150, 400))))
    texts, want = {}, {}
    for nth in range(3):
        rows, latest = [], {}
        for n in rng.sample(range(30), 30 if nth == 0 else 12):
            times = rng.sample(range(1, 9), rng.choice((1, 1, 2, 3)))
            # a change at the end leaves most chunks as they were
            found = [(t, texts.get(n, "") + " and an end." if nth and rng.random() < 0.5 else text()) for t in times]
            found += [(None, "of an unknown time")] * rng.choice((0, 1))
            rows += [(f"f{n}.txt", x, None if t is None else datetime.datetime(2024, 1, t)) for t, x in found]
            texts[n] = latest[n] = max((f for f in found if f[0]))[1]
        if nth == 1:
            rows, texts[90], latest[90] = [*rows, ("f90.txt", "alone and of an unknown time", None)], "alone", "alone and of an unknown time"
        spark.createDataFrame(rows, FILES).coalesce(1).write.mode("append").parquet(src)
        cut = chunking.chunk_all(spark.createDataFrame([(f"f{n}.txt", x) for n, x in latest.items()], "source_key string, text string"), [space])
        tags = {r.source_key: r.e for r in spark.createDataFrame([(f"f{n}.txt", x) for n, x in latest.items()], "source_key string, text string").select("source_key", F.md5("text").alias("e")).collect()}
        chunks = {}
        for r in cut.collect():
            chunks.setdefault(r.source_key, {})[r.chunk_index] = r
        for k, tag in tags.items():
            mine = {v: f for v, f in want.items() if v[0] == space and f[5] == k}
            new = {(space, c.vector_id): (c.content, tag, "m", c.chunk_index, c.chunk_total, k) for c in chunks.get(k, {}).values()}
            same = {v for v in new if v in mine and mine[v][0] == new[v][0] and mine[v][2] == "m"}
            if same != set(new) | set(mine):
                same -= {v for v in new if new[v][3] == 0}
            want = {v: f for v, f in want.items() if v not in mine or v in same} | {v: f for v, f in new.items() if v not in same}
        jobs.stream_index(spark.readStream.schema(FILES).parquet(src), out, cp, space, "m").awaitTermination(120)
        assert {key(r): facts(r) for r in table.read().collect()} == want and table.read().count() == len(want)
        # drift of the store: models, a second space, an id that can't be read, a chunk too many
        n, at = F.regexp_extract("source_key", r"(\d+)", 1).cast("int"), F.col("chunk_index")
        now = table.read().withColumn("embedding_model", F.when((n % 5 == 0) & (at == 1), "old").otherwise(F.col("embedding_model")))
        first = now.where((at == 0) & (F.col("space") == space))
        more = [first.where(n % 4 == 0).withColumn("space", F.lit("other")), first.where(n % 6 == 1).withColumn("vector_id", F.concat("document_id", F.lit("#x"))), first.where(n % 6 == 2).withColumn("vector_id", F.concat("document_id", F.lit("#00777")))]
        for m in more if nth == 0 else ():
            now = now.unionByName(m)
        table.commit(now)
        want = {key(r): facts(r) for r in table.read().collect()}


def test_totals_equal_batch(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "event_type", "value")
    e.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "ev"))
    got = _run(spark, jobs.stream_totals(stream, "1 day", "1 day"), tmp_path, "totals", "complete")
    want = e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    assert sorted((str(r.start), r.event_type, r.n, r.total) for r in got.collect()) == sorted((str(r.window.start), r.event_type, r.n, r.total) for r in want.collect())


def test_requests_collapse(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a", "v"), ("2024-01-01 00:01:00", "a", "v"), ("2024-01-01 00:01:00", "b", "v")]
    df = spark.createDataFrame(rows, "at string, source_key string, variant string").withColumn("at", F.col("at").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "rq"))
    got = _run(spark, jobs.dedupe_requests(spark.readStream.schema(df.schema).parquet(str(tmp_path / "rq")), "10 minutes"), tmp_path, "requests")
    assert sorted(r.source_key for r in got.collect()) == ["a", "b"]


def test_screening_has_two_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "mail a@gmail.com"), (2, "none")], "doc_id long, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "docs"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "docs"))
    jobs.stream_screen(stream, {}, str(tmp_path / "out"), str(tmp_path / "audit"), str(tmp_path / "cp2")).awaitTermination(120)
    assert {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "mail [EMAIL]", 2: "none"}
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 1


def test_stages_pair_and_open_ones_come_out(spark, tmp_path):
    rows = [("t", 1, "embed", "started", 0), ("t", 1, "embed", "completed", 5), ("t", 2, "search", "started", 6), ("z", 9, "late", "started", 9000), ("z", 9, "late", "completed", 9001)]
    path = str(tmp_path / "st")
    schema = "trace_id string, sequence int, name string, status string, at timestamp"
    for i, part in enumerate((rows[:3], rows[3:])):
        df = spark.createDataFrame(part, "trace_id string, sequence int, name string, status string, s int").withColumn("at", F.timestamp_seconds(F.lit(1704067200) + F.col("s"))).drop("s")
        df.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {(r.trace_id, r.sequence): r.status for r in _run(spark, jobs.stream_timeline(stream, "10 minutes"), tmp_path, "stages").collect()}
    assert got[("t", 1)] == "completed" and got[("z", 9)] == "completed" and got.get(("t", 2)) == "open"


def test_holds_are_taken_one_by_one():
    import numpy as np

    for seed in range(50):
        rng = np.random.default_rng(seed)
        times, hold, last = np.sort(rng.integers(0, 200, 60)), int(rng.integers(1, 40)), None if seed % 2 else int(rng.integers(0, 100))
        want, held = [], last
        for t in times.tolist():
            if held is None or t >= held + hold:
                want.append(t)
                held = t
        assert jobs._first_after(times, last, hold) == want


def test_holds_of_many_keys_are_taken_at_once():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(50):
        keys, times, hold = np.sort(rng.integers(0, 9, 80)), rng.integers(0, 200, 80), int(rng.integers(1, 40))
        last = np.where(rng.random(10) < 0.5, jobs._NEVER, rng.integers(0, 100, 10))
        times = times[np.lexsort((times, keys))]
        want = [(k, t) for k in range(10) for t in jobs._first_after(times[keys == k], None if last[k] == jobs._NEVER else int(last[k]), hold)]
        assert list(zip(*[x.tolist() for x in jobs._taken(keys, times, last, hold)])) == want


def test_keys_of_one_part_hold_for_themselves(spark, tmp_path):
    """All keys in one part: a state is a list of keys, nulls among them, over three batches."""
    path, schema, out = str(tmp_path / "rq"), "at timestamp, source_key string, variant string", []
    for rows in ([(0, "a", "v"), (0, "a", None), (1, None, "v"), (2, None, None), (700, "b", "v")], [(650, "a", "v"), (660, "a", None), (670, "b", "v"), (700, None, "v"), (710, None, None)], [(1301, "b", "v"), (1400, "c", "v"), (1200, "a", "v")]):
        spark.createDataFrame(rows, "s int, source_key string, variant string").select(F.timestamp_seconds(F.lit(1704067200) + F.col("s")).alias("at"), "source_key", "variant").write.mode("append").parquet(path)
        got = jobs.admitted_requests(spark.readStream.schema(schema).parquet(path), "10 minutes", "1 minute", parts=1)
        assert got.writeStream.foreachBatch(lambda b, e: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    taken = sorted((str(r.source_key), str(r.variant), int(r.at.timestamp()) - 1704067200) for r in out)
    assert taken == [("None", "None", 2), ("None", "None", 710), ("None", "v", 1), ("None", "v", 700), ("a", "None", 0), ("a", "None", 660), ("a", "v", 0), ("a", "v", 650), ("b", "v", 700), ("b", "v", 1301), ("c", "v", 1400)]


def test_a_hold_ends_although_no_batch_came_between(spark, tmp_path):
    """Over three batches: a request after the hold is admitted, one within it not, a late one not; null keys hold too; expired
    state doesn't come back."""
    path, schema = str(tmp_path / "rq"), "at timestamp, source_key string, variant string"
    batches = [
        [(0, "a", "v"), (30, "a", "v"), (700, "a", "v"), (0, None, "v"), (5, None, "v"), (None, "a", "v"), (3, "b", "w")],
        [(1200, "a", "v"), (1300, "a", "v"), (20, "late", "v"), (100_000, "c", "v")],
        [(100_001, "c", "v"), (100_002, "a", "v"), (1400, "a", "v")],
    ]
    out = []
    for rows in batches:
        df = spark.createDataFrame(rows, "s int, source_key string, variant string").select(F.timestamp_seconds(F.lit(1704067200) + F.col("s")).alias("at"), "source_key", "variant")
        df.write.mode("append").parquet(path)
        got = jobs.admitted_requests(spark.readStream.schema(schema).parquet(path), "10 minutes", "1 minute")
        q = got.writeStream.foreachBatch(lambda b, e: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    taken = sorted((str(r.source_key), int(r.at.timestamp()) - 1704067200) for r in out)
    assert taken == [("None", 0), ("a", 0), ("a", 700), ("a", 1300), ("a", 100_002), ("b", 3), ("c", 100_000)]


def test_jobs_expire_and_begin_anew(spark, tmp_path):
    path, schema, out = str(tmp_path / "ev"), "at timestamp, job_id long", []
    for rows in ([(0, 1), (500, 1), (0, 2)], [(5000, 1), (5100, 2), (10, 3)], [(9000, 4)]):
        df = spark.createDataFrame(rows, "s int, job_id long").select(F.timestamp_seconds(F.lit(1704067200) + F.col("s")).alias("at"), "job_id")
        df.write.mode("append").parquet(path)
        ttl = F.when(F.col("job_id") == 1, "15 minutes").otherwise("1 hour")
        q = jobs.expired_jobs(spark.readStream.schema(schema).parquet(path), ttl, "1 minute").writeStream.foreachBatch(lambda b, e: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    lives = sorted((r.job_id, int(r.started.timestamp()) - 1704067200, int(r["last"].timestamp()) - 1704067200, r.n) for r in out)
    assert lives == [(1, 0, 500, 2), (1, 5000, 5000, 1), (2, 0, 0, 1), (2, 5100, 5100, 1), (3, 10, 10, 1)]
