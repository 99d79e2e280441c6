"""Streaming queries over events that arrive in four parts, each a run of the job on its checkpoint: watermarks of hours pass,
late rows are left out, state expires.

Events of ten days make a part; every tenth event that lies more than a day before the end of its part comes with the next
one. The SQL states each part's watermark from the parts before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import registered
from ..streaming import jobs
from .scratch import fresh
from .tables import table

_BEGIN, _PART, _PARTS, _DAY, _HOUR = 1704067200, 864_000, 3, 86_400, 3_600_000


def arriving(spark: SparkSession, d: str) -> DataFrame:
    """events with `at` and the part they arrive in."""
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    second = F.unix_seconds("at") - _BEGIN
    part = F.greatest(F.lit(0), F.least(F.lit(_PARTS - 1), F.floor(second / _PART))).cast("int")
    late = (F.col("event_id") % 10 == 0) & ((part + 1) * _PART - second > _DAY)
    return e.withColumn("part", part + late.cast("int")).drop("ts")


def by_parts(events: DataFrame, label: str, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All that the job has put out after the last part. A batch that runs again writes its own folder again."""
    spark = events.sparkSession
    source, out, checkpoint = fresh(spark, f"{label}-parts"), fresh(spark, label), fresh(spark, f"{label}-checkpoint")
    rows = events.drop("part")

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    for part in range(_PARTS + 1):
        events.where(F.col("part") == part).drop("part").write.mode("append").parquet(source)
        result = job(spark.readStream.schema(rows.schema).parquet(source))
        result.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(out)


def _sql(delay_ms: int, then: str) -> str:
    """kept: rows newer than their part's watermark; over: the last watermark; both of a stream of one watermark."""
    return f"""WITH RECURSIVE e AS (SELECT *, epoch_us(ts) AS us, epoch_us(ts) // 1000000 - {_BEGIN} AS s FROM events),
p AS (SELECT *, greatest(0, least({_PARTS - 1}, floor(s / {_PART}.0)))::INT AS span FROM e),
arrived AS (SELECT *, span + CASE WHEN event_id % 10 = 0 AND (span + 1) * {_PART} - s > {_DAY} THEN 1 ELSE 0 END AS part FROM p),
marks AS (SELECT k AS part, (SELECT max(us) FROM arrived WHERE part < k) // 1000 - {delay_ms} AS mark FROM range(0, {_PARTS + 1}) AS r(k)),
timed AS (SELECT a.*, coalesce(mark, -1) * 1000 AS mark FROM arrived a JOIN marks USING (part)), kept AS (SELECT * FROM timed WHERE us > mark),
final AS (SELECT ((SELECT max(us) FROM arrived) // 1000 - {delay_ms}) * 1000 AS over)
{then}"""


@registered("r2_admitted_requests", _sql(_HOUR, f""", q AS (SELECT user_id::VARCHAR AS source_key, event_type AS variant, us FROM kept),
taken AS (SELECT source_key, variant, min(us) AS at FROM q GROUP BY ALL UNION ALL SELECT source_key, variant, min(q.us) AS at FROM taken JOIN q USING (source_key, variant) WHERE q.us >= taken.at + 2 * {_DAY}000000 GROUP BY source_key, variant)
SELECT * FROM taken""").replace("\n, q", ",\nq"))
def r2(spark: SparkSession, d: str) -> DataFrame:
    """A request holds its file and variant for two days."""
    e = arriving(spark, d).select("part", "at", F.col("user_id").cast("string").alias("source_key"), F.col("event_type").alias("variant"))
    return by_parts(e, "admitted", lambda s: jobs.admitted_requests(s, "2 days", "1 hour")).select("source_key", "variant", F.unix_micros("at").alias("at"))


@registered("r4_closed_totals", _sql(72 * _HOUR, """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total
FROM timed, final WHERE epoch_us(date_trunc('day', ts)) + 86400000000 > mark AND epoch_us(date_trunc('day', ts)) + 86400000000 <= over GROUP BY ALL"""))
def r4(spark: SparkSession, d: str) -> DataFrame:
    """Days that the watermark has passed, three days behind the latest event: late rows of an open day count, of a closed one not."""
    e = arriving(spark, d).select("part", F.col("at").alias("ts"), "event_type", "value")
    return by_parts(e, "totals", lambda s: jobs.stream_totals(s, "1 day", "3 days")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def _stages(e: DataFrame) -> DataFrame:
    """Each event as a stage that begins; of three quarters an end comes thirty seconds later."""
    row = lambda status, at: F.struct(F.col("user_id").cast("string").alias("trace_id"), F.col("event_id").alias("sequence"), F.col("event_type").alias("name"), F.lit(status).alias("status"), at.alias("at"))
    both = F.array_compact(F.array(row("started", F.col("at")), F.when(F.col("event_id") % 4 != 0, row("completed", F.col("at") + F.expr("interval 30 seconds")))))
    return e.select("part", F.explode(both).alias("r")).select("part", "r.*")


@registered("r5_open_stages", f"""WITH e AS (SELECT *, epoch_us(ts) AS us, epoch_us(ts) // 1000000 - {_BEGIN} AS s FROM events),
p AS (SELECT *, greatest(0, least({_PARTS - 1}, floor(s / {_PART}.0)))::INT AS span FROM e),
arrived AS (SELECT *, span + CASE WHEN event_id % 10 = 0 AND (span + 1) * {_PART} - s > {_DAY} THEN 1 ELSE 0 END AS part, us + 30000000 AS ended FROM p),
marks AS (SELECT k AS part, least((SELECT max(us) FROM arrived WHERE part < k) // 1000, (SELECT max(ended) FROM arrived WHERE part < k AND event_id % 4 <> 0) // 1000) - 600000 AS mark FROM range(0, {_PARTS + 2}) AS r(k)),
t AS (SELECT a.*, coalesce(mark, -1) * 1000 AS mark, (SELECT mark * 1000 FROM marks WHERE part = {_PARTS + 1}) AS over FROM arrived a JOIN marks USING (part))
SELECT user_id::VARCHAR AS trace_id, event_id AS sequence, event_type AS name, us AS started, CASE WHEN event_id % 4 <> 0 THEN 'completed' ELSE 'open' END AS status FROM t WHERE us > mark AND (event_id % 4 <> 0 OR us + 600000000 <= over)""")
def r5(spark: SparkSession, d: str) -> DataFrame:
    """Stages without an end come out open when ten minutes have passed; late ones and those that may still end don't."""
    out = by_parts(_stages(arriving(spark, d)), "stages", lambda s: jobs.stream_timeline(s, "10 minutes"))
    return out.select("trace_id", "sequence", "name", F.unix_micros("started").alias("started"), "status")


@registered("r7_expired_jobs", _sql(_HOUR, """, j AS (SELECT user_id % 20 AS job_id, us, CASE WHEN user_id % 2 = 0 THEN 900000000 ELSE 3600000000 END AS ttl, mark FROM timed),
g AS (SELECT *, us > lag(us) OVER (PARTITION BY job_id ORDER BY us) + ttl AS fresh FROM j WHERE us + ttl > mark),
n AS (SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY job_id ORDER BY us) AS life FROM g)
SELECT job_id, min(us) AS started, max(us) AS last, count(*) AS n FROM n, final GROUP BY job_id, life, ttl, over HAVING max(us) + ttl <= over""").replace("\n, j", ",\nj"))
def r7(spark: SparkSession, d: str) -> DataFrame:
    """Replay state of some jobs lasts fifteen minutes, of others an hour."""
    e = arriving(spark, d).select("part", "at", (F.col("user_id") % 20).alias("job_id"))
    out = by_parts(e, "expired", lambda s: jobs.expired_jobs(s, F.when(F.col("job_id") % 2 == 0, "15 minutes").otherwise("1 hour"), "1 hour"))
    return out.select("job_id", F.unix_micros("started").alias("started"), F.unix_micros("last").alias("last"), "n")


@registered("r7_replayable_in_time", _sql(_HOUR, "SELECT user_id AS job_id, event_id AS cursor FROM kept"))
def r7b(spark: SparkSession, d: str) -> DataFrame:
    """Every event sent twice, those of ended lives again too late."""
    e = arriving(spark, d).select("part", F.col("user_id").alias("job_id"), F.col("event_id").alias("cursor"), "at")
    e = e.withColumn("twice", F.explode(F.array(F.lit(1), F.lit(2)))).drop("twice")
    return by_parts(e, "replay", lambda s: jobs.stream_replayable(s, "1 hour")).select("job_id", "cursor")
