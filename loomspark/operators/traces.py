"""Traces of answered questions, their chunks, people's verdicts, run history and costs, as queries over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from .golden import live

#: Tags by the stage they judge, in catalog order.
TAGS = {
    "retrieval": ("nothing_retrieved", "missing_chunk", "wrong_chunks", "ranked_low", "below_threshold", "wrong_source", "redundant_chunks"),
    "generation": ("ignored_context", "hallucinated", "bad_arithmetic", "wrong_period", "refused_answerable", "answered_unanswerable", "incomplete", "no_citation", "verbose"),
    "overall": ("ambiguous_question", "not_in_corpus", "config_fault"),
}
TAG_TARGET = {t: target for target, tags in TAGS.items() for t in tags}
RETENTION_DAYS = 30


def filter_traces(traces: DataFrame, chunks: DataFrame, evals: DataFrame, model=None, state=None, question=None, source=None, evaluated=None, verdict=None, target=None) -> DataFrame:
    """Traces by any of: model, state, part of the question (letter case aside), a file retrieved from, and live
    verdicts (present, absent, of a kind, on a target)."""
    t = traces
    if model:
        t = t.where(F.col("model") == model)
    if state:
        t = t.where(F.col("state") == state)
    if question:
        t = t.where(F.contains(F.lower("question"), F.lit(question.lower())))
    if source:
        t = t.join(chunks.where(F.col("source") == source).select("trace_id"), "trace_id", "left_semi")
    if evaluated is not None or verdict or target:
        e = filter_evaluations(evals, target=target, verdict=verdict).select("trace_id")
        t = t.join(e, "trace_id", "left_anti" if evaluated is False else "left_semi")
    return t


def filter_evaluations(evals: DataFrame, target=None, verdict=None, author=None, tag=None, deleted: bool = False) -> DataFrame:
    e = evals if deleted else live(evals)
    for c, v in (("target", target), ("verdict", verdict), ("author", author)):
        e = e.where(F.col(c) == v) if v else e
    return e.where(F.array_contains("tags", tag)) if tag else e


def page(df: DataFrame, order: list[Column], limit: int, offset: int) -> tuple[DataFrame, DataFrame]:
    """(one page, its one-row total); sizes are clamped to 1..200, offsets to 0 and more."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(200, max(1, limit))), df.agg(F.count(F.lit(1)).alias("total"))


def verdict_rollup(evals: DataFrame) -> DataFrame:
    """Per trace: live verdicts and the latest one of each target, as a map."""
    last = live(evals).groupBy("trace_id", "target").agg(F.max_by("verdict", F.struct("created_at", "eval_id")).alias("verdict"), F.count(F.lit(1)).alias("n"))
    return last.groupBy("trace_id").agg(F.sum("n").alias("n_live"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("target", "verdict")))).alias("verdicts"))


def tag_counts(evals: DataFrame) -> DataFrame:
    """Live tags by target and verdict, with all subtotals."""
    return live(evals).select("target", "verdict", F.explode("tags").alias("tag")).cube("target", "verdict").agg(F.count(F.lit(1)).alias("n"))


def validate_tags(evals: DataFrame) -> DataFrame:
    """evals with kept (known tags of the target, once each, in catalog order), unknown and misplaced tags."""
    known = F.create_map(*[F.lit(x) for kv in TAG_TARGET.items() for x in kv])
    catalog = F.array(*map(F.lit, TAG_TARGET))
    of = lambda t: F.element_at(known, t)
    return (
        evals.withColumn("unknown", F.array_sort(F.array_distinct(F.filter("tags", lambda t: of(t).isNull()))))
        .withColumn("misplaced", F.array_sort(F.array_distinct(F.filter("tags", lambda t: of(t) != F.col("target")))))
        .withColumn("kept", F.filter(catalog, lambda t: F.array_contains("tags", t) & (of(t) == F.col("target"))))
    )


def apply_verdict_log(log: DataFrame, traces: DataFrame) -> DataFrame:
    """State of each evaluation from a log (seq, op create/withdraw/restore, eval_id, trace_id, reason, at): the first
    withdrawal's reason and time stay until a restore; evaluations of unknown traces are left out."""
    made = log.where("op = 'create'").join(traces.select("trace_id"), "trace_id", "left_semi")
    changes = log.where("op <> 'create'").select("eval_id", "seq", "op", "reason", "at")
    restored = changes.where("op = 'restore'").groupBy("eval_id").agg(F.max("seq").alias("restored_seq"))
    open_ones = changes.where("op = 'withdraw'").join(restored, "eval_id", "left").where("seq > coalesce(restored_seq, -1)")
    first = open_ones.groupBy("eval_id").agg(F.min_by(F.struct("reason", "at"), "seq").alias("w"))
    return made.select("eval_id", "trace_id").join(first, "eval_id", "left").select("eval_id", "trace_id", F.col("w").isNotNull().alias("deleted"), F.col("w.reason").alias("reason"), F.col("w.at").alias("deleted_at"))


def trace_summary(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("trace_id").agg(F.count_if(~F.col("dropped")).alias("chunk_count"), F.coalesce(F.max(F.when(~F.col("dropped"), F.col("score"))), F.lit(0.0)).alias("top_score"))


def build_traces(events: DataFrame) -> DataFrame:
    """Events (trace_id, seq, kind, value) to one trace each: the answer's parts in order, the last error, tokens, and
    the state: a generation error means failed, else a cancellation cancelled, else completed."""
    by = F.struct("seq")
    g = events.groupBy("trace_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "token", F.struct("seq", "value")))), lambda x: x["value"]), "").alias("answer"),
        F.max_by(F.when(F.col("kind").startswith("error:"), F.col("kind")), F.when(F.col("kind").startswith("error:"), by)).alias("error"),
        F.bool_or(F.col("kind") == "cancel").alias("cancelled"), F.sum(F.when(F.col("kind") == "usage", F.col("value").try_cast("bigint"))).alias("tokens"),
        F.max(F.when(F.col("kind") == "question", F.col("value"))).alias("question"),
    )
    stage = F.regexp_replace("error", "^error:", "")
    return g.select("trace_id", "question", "answer", stage.alias("error_stage"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.when(stage == "generation", "failed").when(F.col("cancelled"), "cancelled").otherwise("completed").alias("state"))


def trace_chunks(matches: DataFrame) -> DataFrame:
    """Matches as they were shown, with a fingerprint of their text."""
    return matches.withColumn("content_hash", ids.content_hash("content"))


def drifted(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Trace chunks whose vector id now holds other text."""
    now = vectors.select("vector_id", ids.content_hash("content").alias("now_hash"))
    return chunks.join(now, "vector_id").where(F.col("content_hash") != F.col("now_hash"))


def timeline(events: DataFrame) -> DataFrame:
    """Stage events (trace_id, sequence, name, status, at) paired by sequence: status, duration (never negative), and
    its part of the trace's total; a stage without an end is open."""
    g = events.groupBy("trace_id", "sequence").agg(
        F.first("name").alias("name"), F.min(F.when(F.col("status") == "started", F.col("at"))).alias("started"), F.max(F.when(F.col("status") != "started", F.col("at"))).alias("ended"),
        F.max(F.when(F.col("status") != "started", F.col("status"))).alias("status"),
    )
    g = g.withColumn("status", F.coalesce("status", F.lit("open"))).withColumn("duration", F.greatest(F.lit(0), F.col("ended") - F.col("started")))
    return g.withColumn("total", F.sum("duration").over(Window.partitionBy("trace_id")))


def list_traces(traces: DataFrame, evals: DataFrame, limit: int, offset: int) -> DataFrame:
    """A page of traces, newest first, with their verdict rollup."""
    rows, _ = page(traces, [F.col("created_at").desc(), F.col("trace_id").desc()], limit, offset)
    return rows.join(verdict_rollup(evals), "trace_id", "left")


def trace_detail(traces: DataFrame, chunks: DataFrame, evals: DataFrame) -> DataFrame:
    """Traces with all chunks by rank and all evaluations, withdrawn ones included."""
    c = chunks.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vector_id", "score", "dropped"))).alias("chunks"))
    e = evals.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "eval_id", "target", "verdict", "deleted"))).alias("evaluations"))
    return traces.join(c, "trace_id", "left").join(e, "trace_id", "left")


def export_evaluations(traces: DataFrame, chunks: DataFrame, evals: DataFrame) -> DataFrame:
    """A JSON record per judged trace: chunks (scores to 6 places), live verdicts by target, newest first; cost to 8 places."""
    e = live(evals).groupBy("trace_id", "target").agg(F.sort_array(F.collect_list(F.struct("created_at", "eval_id", "verdict", "tags")), False).alias("es"))
    e = e.groupBy("trace_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("target", "es")))).alias("evaluations"))
    c = chunks.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vector_id", F.round("score", 6).alias("score"), "dropped"))).alias("chunks"))
    rows = traces.join(e, "trace_id").join(c, "trace_id", "left")
    return rows.select("trace_id", F.to_json(F.struct("trace_id", "question", "answer", "model", F.round("total_cost", 8).alias("total_cost"), "chunks", "evaluations")).alias("value"))


def prune_traces(traces: DataFrame, chunks: DataFrame, evals: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(traces, chunks) without unjudged traces older than RETENTION_DAYS; any evaluation, withdrawn or not, keeps one."""
    old = traces.where(F.col("created_at") < now - F.expr(f"interval {RETENTION_DAYS} days")).select("trace_id").join(evals.select("trace_id"), "trace_id", "left_anti")
    return traces.join(old, "trace_id", "left_anti"), chunks.join(old, "trace_id", "left_anti")


def delete_traces(trace_ids: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """Each table without the traces' rows."""
    gone = trace_ids.select("trace_id").distinct()
    return [t.join(gone, "trace_id", "left_anti") for t in tables]


def distinct_models(traces: DataFrame) -> DataFrame:
    return traces.where(F.coalesce("model", F.lit("")) != "").select("model").distinct().orderBy("model")


def cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (model, input_, output_, cache_read_, cache_write_tokens) with the four costs and their sum; an unknown
    model costs nothing. prices: per million tokens, a handful of rows."""
    out = usage.join(F.broadcast(prices) if prices.limit(10_001).count() <= 10_000 else prices, "model", "left")
    parts = ("input", "output", "cache_read", "cache_write")
    for p in parts:
        out = out.withColumn(f"{p}_cost", F.coalesce(F.col(f"{p}_tokens"), F.lit(0)) / 1_000_000 * F.coalesce(F.col(f"{p}_per_1m"), F.lit(0.0)))
    return out.withColumn("total_cost", sum((F.col(f"{p}_cost") for p in parts[1:]), F.col("input_cost"))).drop(*[f"{p}_per_1m" for p in parts])


def spend(usage: DataFrame) -> DataFrame:
    return usage.groupBy("model").agg(*[F.sum(f"{p}_tokens").alias(f"{p}_tokens") for p in ("input", "output", "cache_read", "cache_write")], F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"))


# --- runs


def run_totals(run_files: DataFrame) -> DataFrame:
    """Per job: files indexed, skipped, failed; chunks embedded, reused, pruned."""
    n = lambda *s: F.count_if(F.col("outcome").isin(*s))
    return run_files.groupBy("job_id").agg(n("indexed").alias("indexed"), n("current", "unsupported", "missing").alias("skipped"), n("failed", "blocked").alias("failed"), *[F.sum(c).alias(c) for c in ("chunks", "reused", "pruned")])


def recent_runs(runs: DataFrame, n: int) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc(), "job_id").limit(n)


def prune_runs(runs: DataFrame, run_files: DataFrame, run_events: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    kept = runs.where(F.col("started_at") >= now - F.expr(f"interval {RETENTION_DAYS} days"))
    ids_ = kept.select("job_id")
    return kept, run_files.join(ids_, "job_id", "left_semi"), run_events.join(ids_, "job_id", "left_semi")


def close_abandoned(runs: DataFrame) -> DataFrame:
    return runs.withColumn("state", F.when(F.col("state") == "running", "abandoned").otherwise(F.col("state")))


def replay(events: DataFrame, job_id, after: int) -> DataFrame:
    """Events of a job after a cursor, in order."""
    return events.where((F.col("job_id") == job_id) & (F.col("cursor") > after)).orderBy("cursor")


def run_report(runs: DataFrame, run_files: DataFrame, n: int) -> DataFrame:
    """Recent runs with totals and files by outcome."""
    by = run_files.groupBy("job_id", "outcome").agg(F.count(F.lit(1)).alias("n")).groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "n")))).alias("outcomes"))
    return recent_runs(runs, n).join(run_totals(run_files), "job_id", "left").join(by, "job_id", "left")
