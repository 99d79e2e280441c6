"""The streaming jobs. Each takes a streaming DataFrame and returns one, or starts a query on a checkpoint."""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import chunking, governance
from ..sources import stored, versions


#: Columns of the vector table, and its buckets by document, which are rewritten only where a document changed.
_TABLE = "vector_id string, source_key string, document_id string, chunk_index int, chunk_total int, content string, source_etag string, embedded_at timestamp, embedding_model string, embedding array<float>, space string, bucket int"
BUCKETS = 256


def index_table(spark: SparkSession, path: str) -> versions.VersionedTable:
    """The vector table at path."""
    return versions.VersionedTable(spark, path, _TABLE, "bucket")


def _index_batch(batch: DataFrame, epoch: int, path: str, space: str, model: str, query: str, embed=None) -> None:
    """One micro-batch of files: stored once, cut as the space says, planned against the version that stands, and committed as the
    next one. Of the same file in a batch the last change counts. A batch that was committed before changes nothing.

    The plan is that of status.index_plan. Chunks, what the touched buckets hold, and a row for each file are dealt out by
    bucket, as the commit needs them, in the one shuffle that carries contents; the rest are windows over that order.
    """
    spark = batch.sparkSession
    table = index_table(spark, path)
    parent = table.version()
    if table.manifest(parent)["batches"].get(query, -1) >= epoch:
        return
    etag = F.col("etag") if "etag" in batch.columns else F.md5("text")
    staged = f"{path}/staged/{uuid.uuid4().hex}"
    files = batch.where("source_key is not null").select("source_key", "text", "last_modified", etag.alias("source_etag"), F.monotonically_increasing_id().alias("row"))
    files.write.option("compression", "zstd").parquet(staged)
    files = spark.read.schema(files.schema).parquet(staged)
    # without their texts; a file that comes once is not shuffled with its text
    last = files.groupBy("source_key").agg(F.max(F.struct("last_modified", "source_etag", "row")).alias("f"))
    last = last.select("source_key", ids.document_id("source_key").alias("document_id"), "f.source_etag", "f.row").withColumn("bucket", _bucket())
    found = {r.bucket: r["count"] for r in last.groupBy("bucket").count().collect()}  # BUCKETS at most
    latest = files if files.count() == sum(found.values()) else files.join(last.select("row"), "row", "left_semi")
    rows = _indexed(table.read(parent, list(found)), chunking.chunk_all(latest, [space]), last, space, model)
    if embed:
        new = embed(rows.where("kind = 'new'").select("vector_id", "source_key", "document_id", "chunk_index", "chunk_total", "content", "source_etag", "bucket", "embedded_at"))
        rows = rows.where("kind <> 'new'").drop("kind").unionByName(stored.stamped(new, space, model), allowMissingColumns=True)
    table.commit(rows, list(found), parent, query, epoch, dealt=not embed)
    gone = table._path(staged)
    table._fs.delete(gone, True)


def _bucket() -> Column:
    return F.pmod(F.xxhash64("document_id"), F.lit(BUCKETS)).cast("int")


def _indexed(every: DataFrame, chunks: DataFrame, files: DataFrame, space: str, model: str) -> DataFrame:
    """What is to stand in place of `every` once the space holds the chunks of files (document_id, source_etag, bucket), each
    once: rows of the table with their kind (new, held, other), dealt out by bucket and sorted by it."""
    _, parsed = ids.parsed_vector_id("vector_id")
    mine = (F.col("space") == space) & F.col("document_id").isNotNull()
    held = every.select("*", F.when(mine, parsed).alias("at"), F.when(mine, "held").otherwise("other").alias("kind"))
    new = chunks.select("vector_id", "source_key", "document_id", "chunk_index", "chunk_total", "content", _bucket().alias("bucket"), F.lit(space).alias("space"), F.lit(model).alias("embedding_model"), F.current_timestamp().alias("embedded_at"), F.col("chunk_index").alias("at"), F.lit("new").alias("kind"))
    rows = held.unionByName(new, allowMissingColumns=True).unionByName(files.select("document_id", "source_etag", "bucket", F.lit("file").alias("kind")), allowMissingColumns=True)
    a_new, a_held, a_file = (F.col("kind") == k for k in ("new", "held", "file"))
    position, whole = Window.partitionBy("bucket", "document_id", "at"), Window.partitionBy("bucket", "document_id")
    rows = rows.repartition("bucket").withColumn("cut", F.max(F.when(a_new, F.col("content"))).over(position))
    same = F.coalesce(a_held & (F.col("content") == F.col("cut")) & (F.col("embedding_model") == model), F.lit(False))
    rows = rows.select(*every.columns, "at", "kind", F.col("cut").isNotNull().alias("wanted"), same.alias("same"))
    # a position is embedded unless something is held there, all of it the same
    rows = rows.withColumn("reused", F.coalesce(F.bool_and(F.when(a_held, F.col("same"))).over(position), F.lit(False)) & F.col("wanted"))
    rows = rows.withColumn("touched", F.bool_or(a_file).over(whole)).withColumn("etag", F.max(F.when(a_file, F.col("source_etag"))).over(whole)).withColumn("changed", F.bool_or((a_new | a_held) & ~F.col("reused")).over(whole))
    # chunk 0 carries the total, so it goes with any change of its document
    reused = F.col("reused") & ~(F.col("changed") & (F.col("at") == 0))
    stays = F.when(a_new, ~reused).when(a_held, ~F.col("touched") | reused).otherwise(~a_file)
    return rows.where(stays).withColumn("source_etag", F.when(a_new, F.col("etag")).otherwise(F.col("source_etag"))).select(*every.columns, "kind")


def stream_index(files: DataFrame, path: str, checkpoint: str, space: str, model: str, embed=None):
    """New and changed files (source_key, text, last_modified, and etag if there is one) into the vector table at path, cut by
    the variant that names the space; `embed` adds an embedding column to new rows. Vectors that a batch doesn't touch
    keep all their columns. Each batch is one version of the table (index_table), so readers see whole batches; a
    batch that runs again after its commit, or that died before it, leaves no trace of its first run."""
    run = functools.partial(_index_batch, path=path, space=space, model=model, query=checkpoint, embed=embed)
    return files.writeStream.foreachBatch(lambda b, e: run(b, e)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe_requests(requests: DataFrame, delay: str) -> DataFrame:
    """Requests (at, source_key, variant): one of a file and variant while within the delay."""
    return requests.withWatermark("at", delay).dropDuplicatesWithinWatermark(["source_key", "variant"])


def _first_after(times: np.ndarray, last: int | None, hold: int) -> list[int]:
    """Of sorted times those that lie hold or more after the one taken before them, the first after `last`."""
    return _taken(np.zeros(len(times), np.int64), times, np.array([_NEVER if last is None else last]), hold)[1].tolist()


#: The last time of a key that has none.
_NEVER = -(1 << 63)


def _taken(keys: np.ndarray, times: np.ndarray, last: np.ndarray, hold: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, time) of what is taken of the times of many keys, numbered from 0 and sorted by key and time: of each key the times
    that lie hold or more after the one taken before them, the first after last[key]. All keys take a step at once."""
    ends, n = np.searchsorted(keys, np.arange(len(last)), "right"), np.arange(len(last))
    at, found = np.searchsorted(keys, n, "left"), [np.zeros(0, np.int64)]
    due = np.where(last == _NEVER, _NEVER, last + hold)
    while len(n):
        low, high = at, ends[n]
        while (low < high).any():  # the first time at or after what is due, by halves
            mid = (low + high) // 2
            before = (low < high) & (times[np.minimum(mid, len(times) - 1)] < due)
            low, high = np.where(before, mid + 1, low), np.where(before | (low >= high), high, mid)
        going = low < ends[n]
        n, at = n[going], low[going]
        found.append(at)
        due = times[at] + hold
    places = np.sort(np.concatenate(found))
    return keys[places], times[places]


#: Parts of the keys of admitted requests. A part's keys are one state, so a batch costs a call for each part, not for each key.
HELD_PARTS = 1024


def admitted_requests(requests: DataFrame, hold: str, delay: str, parts: int = HELD_PARTS) -> DataFrame:
    """Requests (at, source_key, variant), of which one holds its file and variant for the time `hold`: others within
    it collapse into it, and the first one after it is admitted again, also where no batch came in between.

    The state of a file and variant is the time of the last admitted request; it goes when the watermark (delay
    behind the latest request) has passed the hold. Keys are dealt out to `parts`, which a checkpoint fixes; a part's state is a
    list of its keys and their times, and a timer drops it when the last of them is over. Requests older than the watermark are left
    out, as are those without a time; null keys are a key of their own. A part's requests of one batch are told by a number of their key
    and their times alone, sixteen bytes each, so that a hot key stays small.
    """
    micros = requests.sparkSession.range(1).select(F.expr(f"unix_micros(timestamp_seconds(0) + interval {hold})")).first()[0]

    def admit(part, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        number: dict[tuple, int] = {}
        last: list[int] = []
        over = state.getCurrentWatermarkMs() * 1000
        for source, variant, at in zip(*state.get, strict=True) if state.exists else ():
            if at + micros > over:
                number[source, variant] = len(last)
                last.append(at)
        keys, times = [], []
        for b in batches:
            told = [pd.factorize(b[c], use_na_sentinel=True) for c in ("source_key", "variant")]
            pairs, place = np.unique(np.stack([codes for codes, _ in told], axis=1), axis=0, return_inverse=True)
            named = [tuple(None if c < 0 else names[c] for c, (_, names) in zip(pair, told, strict=True)) for pair in pairs.tolist()]
            keys.append(np.array([number.setdefault(k, len(number)) for k in named], np.int64)[place.reshape(-1)])
            times.append(b["us"].to_numpy(dtype=np.int64))
        last += [_NEVER] * (len(number) - len(last))
        k, t = np.concatenate(keys), np.concatenate(times)
        order = np.lexsort((t, k))
        k, t = _taken(k[order], t[order], np.array(last, np.int64), micros)
        held = np.array(last, np.int64)
        np.maximum.at(held, k, t)
        every = list(number)
        # a late request's hold may be over with its batch; the timer can't lie before the watermark
        live = [i for i, at in enumerate(held.tolist()) if at != _NEVER]
        state.update(([every[i][0] for i in live], [every[i][1] for i in live], held[live].tolist()))
        state.setTimeoutTimestamp(max((int(held.max()) + micros) // 1000, state.getCurrentWatermarkMs() + 1))
        if len(k):
            yield pd.DataFrame({"source_key": [every[i][0] for i in k.tolist()], "variant": [every[i][1] for i in k.tolist()], "us": t})

    part = F.pmod(F.xxhash64("source_key", "variant"), F.lit(parts)).cast("int")
    timed = requests.where("at is not null").withWatermark("at", delay).select("at", "source_key", "variant", F.unix_micros("at").alias("us"), part.alias("part"))
    out = timed.groupBy("part").applyInPandasWithState(admit, "source_key string, variant string, us long", "source_keys array<string>, variants array<string>, lasts array<bigint>", "append", "EventTimeTimeout")
    return out.select("source_key", "variant", F.timestamp_micros("us").alias("at"))


def stream_screen(docs: DataFrame, policy: dict, out: str, audit_out: str, checkpoint: str, recognizers=governance.RECOGNIZERS):
    """Screened text to one table and the audit of its findings to another."""

    def put(batch: DataFrame, epoch: int) -> None:
        done = governance.screen(batch, policy, recognizers).persist()
        done.select("doc_id", "text", "verdict").withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(out)
        governance.audit(done).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(audit_out)
        done.unpersist()

    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_totals(events: DataFrame, width: str, delay: str) -> DataFrame:
    """Events (ts, event_type, value) per tumbling window and type; events later than the delay are left out, and the
    state of a window goes when the watermark passes it."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def stream_timeline(events: DataFrame, timeout: str) -> DataFrame:
    """Starts paired with ends (trace_id, sequence, name, status, at) across batches; a stage without an end by the
    timeout comes out open."""
    starts = events.where("status = 'started'").select("trace_id", "sequence", "name", F.col("at").alias("started")).withWatermark("started", timeout)
    ends = events.where("status <> 'started'").select(F.col("trace_id").alias("t2"), F.col("sequence").alias("s2"), F.col("status").alias("end_status"), F.col("at").alias("ended")).withWatermark("ended", timeout)
    on = (F.col("trace_id") == F.col("t2")) & (F.col("sequence") == F.col("s2")) & (F.col("ended") >= F.col("started")) & (F.col("ended") <= F.col("started") + F.expr(f"interval {timeout}"))
    return starts.join(ends, on, "left_outer").select("trace_id", "sequence", "name", "started", "ended", F.coalesce("end_status", F.lit("open")).alias("status"))


def resume(events: DataFrame, cursor: int) -> DataFrame:
    """The rows after the last one seen."""
    return events.where(F.col("cursor") > cursor)


def stream_replayable(events: DataFrame, ttl: str) -> DataFrame:
    """Events (job_id, cursor, at, event) that a client may still replay: each once, for as long after its time as ttl says;
    their state goes with the watermark, later arrivals of an older time are left out."""
    return events.withWatermark("at", ttl).dropDuplicates(["job_id", "cursor", "at"])


def expired_jobs(events: DataFrame, ttl: Column | str, delay: str) -> DataFrame:
    """Jobs whose replay state is over: (job_id, started, last, n) of each run of events (job_id, at) with less than ttl
    between them, given once the watermark (delay behind the latest event) has passed ttl after the last.

    ttl may be a column, so that each job has its own. A job whose events come again after its expiry begins anew. The
    state of a living job is its bounds and count; events whose own ttl has passed the watermark are left out.
    """
    alive = F.session_window("at", ttl)
    runs = events.withWatermark("at", delay).groupBy(alive.alias("alive"), "job_id").agg(F.min("at").alias("started"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n"))
    return runs.select("job_id", "started", "last", "n")


def retained(events: DataFrame, now, ttl: str) -> DataFrame:
    """The same of a stored table: rows of jobs whose last event isn't older than ttl at `now`."""
    last = events.groupBy("job_id").agg(F.max("at").alias("last")).where(F.col("last") >= now - F.expr(f"interval {ttl}")).select("job_id")
    return events.join(last, "job_id", "left_semi")
