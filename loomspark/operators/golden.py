"""Golden question sets: scoring, validation, facts, quotas, drafts, edits, comparison of variants.

gold: id, type, difficulty, question, answer, numeric_answer, numeric_tolerance, answer_keys, forbidden_keys,
must_refuse, gold_sections. predictions: id, answer, retrieved_sections.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.text import norm
from . import sections as _sections

#: Fixed values.
TOLERANCE, DERIVATION_TOLERANCE, SIMILAR, LEAST_QUESTION, CONTEXT_CHARS, DIGEST = 0.05, 0.25, 0.85, 12, 110, 120
PER_SECTION, CROSS, UNANSWERABLE, ARITHMETIC = (500, 1, 5), (1.0, 2, 12), (0.45, 2, 8), 12
MOST_VARIANTS = 1000
TYPES, DIFFICULTIES = ("lookup", "arithmetic", "multi_hop", "unanswerable", "temporal", "distractor", "synthesis"), ("easy", "medium", "hard")


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.expr("cast(array() as array<string>)"))


def section_metrics(wanted: Column, found: Column) -> tuple[Column, Column]:
    """(recall, precision) of section titles as sets of normal forms; null where there is nothing to measure."""
    w, f = (F.array_distinct(F.transform(x, norm)) for x in (wanted, found))
    hits, known = F.size(F.array_intersect(w, f)), found.isNotNull() & (F.size(F.coalesce(wanted, F.expr("cast(array() as array<string>)"))) > 0)
    return F.when(known, hits / F.size(w)), F.when(known, F.when(F.size(f) > 0, hits / F.size(f)).otherwise(0.0))


def score(joined: DataFrame) -> DataFrame:
    """Verdict columns for gold rows beside their prediction (pred_answer, retrieved_sections): correct, reasons,
    support, recall, precision. Rules in order: forbidden keys, refusal, number within tolerance, all keys."""
    answer = F.coalesce("pred_answer", F.lit(""))
    low = norm(answer)
    missing = F.filter(_list("answer_keys"), lambda k: ~F.contains(F.col("__low"), norm(k)))
    trapped = F.filter(_list("forbidden_keys"), lambda k: F.contains(F.col("__low"), norm(k)))
    out = joined.withColumn("__low", low).withColumn("__missing", missing).withColumn("__trapped", trapped)
    near = F.exists(text.numbers(answer), lambda x: F.abs(x - F.col("numeric_answer")) <= F.coalesce("numeric_tolerance", F.lit(TOLERANCE)))
    refuse, numeric = F.coalesce("must_refuse", F.lit(False)), F.col("numeric_answer").isNotNull()
    why = F.concat(
        F.transform("__trapped", lambda k: F.concat(F.lit("contains forbidden key '"), k, F.lit("'"))),
        F.when(refuse & ~text.is_refusal(answer), F.array(F.lit("did not acknowledge that this is not stated"))).otherwise(F.array().cast("array<string>")),
        F.when(refuse, F.transform("__missing", lambda k: F.concat(F.lit("missing stated fact '"), k, F.lit("'")))).otherwise(F.array().cast("array<string>")),
        F.when(~refuse & numeric & ~near, F.array(F.lit("no number within the tolerance"))).otherwise(F.array().cast("array<string>")),
        F.when(~refuse & ~numeric & (F.size("__missing") > 0), F.array(F.concat(F.lit("missing keys: "), F.array_join("__missing", ", ")))).otherwise(F.array().cast("array<string>")),
    )
    recall, precision = section_metrics(F.col("gold_sections"), F.col("retrieved_sections"))
    keys = F.size(_list("answer_keys"))
    support = F.when(keys > 0, (keys - F.size("__missing")) / keys)
    return out.withColumn("reasons", why).withColumn("correct", F.size("reasons") == 0).withColumn("support", support).withColumn("recall", recall).withColumn("precision", precision).drop("__low", "__missing", "__trapped")


def score_predictions(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every golden row, scored; one without a prediction fails."""
    p = predictions.select("id", F.col("answer").alias("pred_answer"), "retrieved_sections")
    return score(gold.join(p, "id", "left"))


def unknown_predictions(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    return predictions.join(gold, "id", "left_anti")


def eval_report(scores: DataFrame) -> DataFrame:
    """In all and by type and by difficulty: total, correct, answered, means of support, recall, precision (measured rows only)."""
    grouped = scores.groupingSets([["type"], ["difficulty"], []], "type", "difficulty").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("correct").alias("correct"), F.count_if(F.coalesce("pred_answer", F.lit("")) != "").alias("answered"),
        *[F.round(F.avg(c), 6).alias(c) for c in ("support", "recall", "precision")],
    )
    return grouped


def score_variants(gold: DataFrame, matches: DataFrame, chunks: DataFrame, docs: DataFrame, answers: DataFrame | None = None, variants: list[str] | None = None) -> DataFrame:
    """A row per variant and golden row: variant, id, type, difficulty, correct, recall, precision, failed, error.

    matches: variant, id, source_key, chunk_index, dropped; chunks: variant, source_key, chunk_index, content; docs:
    source_key, text. Matches that bring their chunk's content (as a search returns it) are looked up by it, and chunks aren't
    read for it. variants: the names of the compared variants, if known; else they are taken from chunks. The sections in which a row's kept matches lie are what was retrieved. answers (variant, id,
    answer, error) are scored where given; without them `correct` is null. A row with an error is recorded as failed, and
    neither right nor wrong.
    """
    key = ["variant", "source_key", "chunk_index"]
    kept = matches.where("not dropped").select("variant", "id", "source_key", "chunk_index").distinct()
    if "content" in matches.columns:
        used = matches.where("not dropped").groupBy(*key).agg(F.max("content").alias("content"))
    else:
        used = chunks.join(kept.select(*key).distinct(), key, "left_semi")
    titles = kept.join(_sections.map_sections(used, docs, by=("variant",)), ["variant", "source_key", "chunk_index"])
    titles = titles.groupBy("variant", "id").agg(F.array_sort(F.collect_set("title")).alias("titles"))
    said = answers.select("variant", "id", F.col("answer").alias("pred_answer"), "error") if answers is not None else None
    names = _named(chunks.select("variant").distinct()) if variants is None else variants
    rows = _every_pair(gold, names).join(titles, ["variant", "id"], "left")
    rows = rows.join(said, ["variant", "id"], "left") if said is not None else rows.withColumn("pred_answer", F.lit(None).cast("string")).withColumn("error", F.lit(None).cast("string"))
    absent = {"numeric_answer": "double", "numeric_tolerance": "double", "answer_keys": "array<string>", "forbidden_keys": "array<string>", "must_refuse": "boolean"}
    for c, kind in absent.items():
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast(kind))
    scored = score(rows.withColumn("retrieved_sections", F.coalesce("titles", F.array().cast("array<string>"))))
    failed = F.col("error").isNotNull()
    correct = F.when(~failed & F.lit(answers is not None), F.col("correct"))
    return scored.select("variant", "id", "type", "difficulty", correct.alias("correct"), F.when(~failed, F.col("recall")).alias("recall"), F.when(~failed, F.col("precision")).alias("precision"), failed.alias("failed"), "error")


def _named(plans: DataFrame) -> list[str]:
    return [r.variant for r in plans.limit(MOST_VARIANTS + 1).collect()]


def _every_pair(gold: DataFrame, names: list[str]) -> DataFrame:
    """gold once for each variant; the variants of a comparison are a handful, and named in an array."""
    if len(names) > MOST_VARIANTS:
        raise ValueError(f"at most {MOST_VARIANTS} variants are compared at once")
    return gold.withColumn("variant", F.explode(F.array(*map(F.lit, sorted(set(names)))) if names else F.array().cast("array<string>")))


def compare_variants_run(gold: DataFrame, matches: DataFrame, chunks: DataFrame, docs: DataFrame, answers: DataFrame | None = None, variants: list[str] | None = None) -> DataFrame:
    """The leaderboard of all variants over all golden rows."""
    return leaderboard(variant_totals(score_variants(gold, matches, chunks, docs, answers, variants)))


def variant_totals(row_scores: DataFrame) -> DataFrame:
    """Per variant: rows, correct, failed, and recall and precision over measured rows (0 where none is)."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c)
    return row_scores.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("correct"), mean("recall"), mean("precision"), F.count_if("failed").alias("failed"))


def leaderboard(totals: DataFrame) -> DataFrame:
    order = Window.orderBy(F.col("recall").desc(), F.col("correct").desc(), "variant")
    return totals.withColumn("place", F.row_number().over(order)).withColumn("winner", F.col("place") == 1)


def miss_grid(row_scores: DataFrame, variants: list[str]) -> DataFrame:
    return row_scores.groupBy("id").pivot("variant", variants).agg(F.first("recall"))


def variants_for(docs_by_variant: DataFrame, asked: list[str] | None = None) -> DataFrame:
    """Variants to score: those asked for, once each, else all that hold a file; the job fails if there are none."""
    v = docs_by_variant.select("variant").distinct()
    v = v.where(F.col("variant").isin(*asked)) if asked else v
    if v.isEmpty():
        raise ValueError("no variant to score")
    return v


def facts(sections: DataFrame) -> DataFrame:
    """Each number token with its line (shortened) and section, once per line: source_key, title, token, context, value."""
    lines = sections.where("level <> 'sub'").select("source_key", "title", "position", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    context = F.substring(F.trim(F.regexp_replace("line", r"\s+", " ")), 1, CONTEXT_CHARS)
    tokens = lines.withColumn("context", context).where("context <> ''").select("source_key", "title", "position", "line_no", "context", F.posexplode(text.number_tokens("line")).alias("token_no", "token"))
    found = tokens.withColumn("value", text.to_number("token")).where("value is not null")
    first = F.row_number().over(Window.partitionBy("source_key", "title", "position", "token", "context").orderBy("line_no", "token_no"))
    return found.withColumn("nth", first).where("nth = 1").drop("nth")


def fact_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("source_key").agg(F.countDistinct("value").alias("figures")).withColumn("allow_arithmetic", F.col("figures") >= ARITHMETIC)


def render_digest(found: DataFrame, n: int = DIGEST) -> DataFrame:
    """One text per document: its first n facts in order, one a line."""
    nth = F.row_number().over(Window.partitionBy("source_key").orderBy("position", "line_no", "token_no"))
    kept = found.withColumn("nth", nth).where(F.col("nth") <= n)
    line = F.concat(F.lit("["), "title", F.lit("] "), "token", F.lit(" — "), "context")
    return kept.groupBy("source_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))), lambda x: x["line"]), "\n").alias("digest"))


def quota(sections: DataFrame, counts: DataFrame, density: float = 1.0) -> DataFrame:
    """Per document: questions by section (array), across sections, unanswerable, and the arithmetic gate."""
    s = sections.where("level <> 'sub'")
    chars, low, high = PER_SECTION
    n = F.greatest(F.lit(low), F.least(F.lit(high), F.bround(F.length("body") / chars * density).cast("int")))
    per = s.groupBy("source_key").agg(F.array_sort(F.collect_list(F.struct("position", "title", n.alias("n")))).alias("per_section"), F.count(F.lit(1)).alias("k"))
    scaled = lambda r: F.greatest(F.lit(r[1]), F.least(F.lit(r[2]), F.bround(F.col("k") * r[0] * density).cast("int")))
    return per.join(counts, "source_key", "left").select("source_key", "per_section", scaled(CROSS).alias("cross_section"), scaled(UNANSWERABLE).alias("unanswerable"), F.coalesce("allow_arithmetic", F.lit(False)).alias("allow_arithmetic"))


def recomputed(operator: Column, x: Column) -> Column:
    """A derivation's figure; null where it can't be computed."""
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    a, b = F.get(x, F.lit(0)), F.get(x, F.lit(1))
    return F.when(F.size(x) == 0, None).when(operator == "sum", total).when(operator == "difference", 2 * a - total).when(operator == "ratio", F.try_divide(a, b)).when(operator == "percent_of", F.try_divide(a, b) * 100).when(operator == "percent_change", F.try_divide(a - b, b) * 100)


_VERDICT = T.StructType().add("verbatim", T.BooleanType()).add("titles", T.ArrayType(T.StringType()))
_VERDICTS = T.ArrayType(T.StructType().add("verdicts", T.ArrayType(T.StructType().add("key", T.StringType()).add("v", _VERDICT))).add("stated", T.ArrayType(T.DoubleType())))


def _stated(figures: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Of the asked numbers those that lie within 1e-9 of one of the figures, which are sorted: of its two neighbours."""
    if not len(figures):
        return asked[:0]
    at = np.searchsorted(figures, asked)
    with np.errstate(invalid="ignore"):
        off = np.minimum(*[np.nan_to_num(np.abs(figures[np.clip(k, 0, len(figures) - 1)] - asked), nan=np.inf) for k in (at - 1, at)])
    return asked[off < 1e-9]


@F.pandas_udf(_VERDICTS)
def _grounds_of(titles: pd.Series, bodies: pd.Series, figures: pd.Series, keys: pd.Series, cites: pd.Series, numbers: pd.Series) -> pd.Series:
    """For each row of a document: which of its cited sections hold each of its keys, whether the document does, and which of its numbers it states."""
    out = []
    for ts, bs, fs, *asked in zip(titles, bodies, figures, keys, cites, numbers):
        doc, by_title, known, rows = " ".join(bs), {}, {}, []
        fs = np.asarray(fs, np.float64)
        for t, b in zip(ts, bs):
            by_title.setdefault(t, []).append(b)
        for ks, cs, ns in zip(*asked):
            held = {k: [t for t in cs for b in by_title.get(t, ()) if k in b] for k in ks}
            for k in ks:
                if k not in known:
                    known[k] = bool(held[k]) or k in doc
            rows.append({"verdicts": [{"key": k, "v": {"verbatim": known[k], "titles": held[k]}} for k in ks], "stated": _stated(fs, np.asarray(ns, np.float64)).tolist()})
        out.append(rows)
    return pd.Series(out, dtype=object)


class Grounds:
    """What a check of a row can ask of its document's sections and figures; all answers are columns."""

    def titled(self, title: Column) -> Column:
        """Whether a section has the title."""
        return F.array_contains("titles", title)

    def verbatim(self, key: Column) -> Column:
        """Whether the document holds an answer key or forbidden key of the row."""
        return F.element_at("verdicts", norm(key))["verbatim"]

    def cited(self, key: Column) -> Column:
        """Whether one of the row's gold sections holds the key."""
        return F.exists(_list("gold_sections"), lambda t: F.array_contains(F.element_at("verdicts", norm(key))["titles"], t))

    def states(self, figure: Column) -> Column:
        """Whether the document states the row's answer figure, or one of its operands."""
        return F.array_contains("stated", figure)


def _numeric_grounded(g: Grounds) -> Column:
    operands = F.coalesce("operands", F.array().cast("array<double>"))
    computed, answer = recomputed(F.col("operator"), operands), F.col("numeric_answer")
    said = F.when(answer.isNull() | g.states(answer), None).when(computed.isNull(), "not stated, no derivation").when(F.exists(operands, lambda o: ~g.states(o)), "derivation uses figures that are not stated")
    return F.array_compact(F.array(said.when(F.abs(computed - answer) > DERIVATION_TOLERANCE, "derivation computes another figure")))


def _refusal_shape(g: Grounds) -> Column:
    unanswerable, refuses = F.col("type") == "unanswerable", F.coalesce("must_refuse", F.lit(False))
    return F.array_compact(F.array(F.when(unanswerable & ~refuses, "typed unanswerable without must_refuse").when(refuses & ~unanswerable, "must_refuse on another type")))


#: The checks of a row by name, in order. A caller adds to a copy and passes it to validate.
CHECKS: list[tuple[str, Callable[[Grounds], Column]]] = [
    ("sections_exist", lambda g: F.filter(_list("gold_sections"), lambda t: ~g.titled(t))),
    ("keys_verbatim", lambda g: F.filter(_list("answer_keys"), lambda k: ~g.verbatim(k))),
    ("keys_in_section", lambda g: F.filter(_list("answer_keys"), lambda k: g.verbatim(k) & (F.size(_list("gold_sections")) > 0) & ~g.cited(k))),
    ("numeric_grounded", _numeric_grounded),
    ("forbidden_grounded", lambda g: F.filter(_list("forbidden_keys"), lambda k: ~g.verbatim(k))),
    ("forbidden_grounded", lambda g: F.filter(_list("forbidden_keys"), lambda k: (norm(k) != "") & F.contains(norm("answer"), norm(k)))),
    ("refusal_shape", _refusal_shape),
]


def validate(rows: DataFrame, sections: DataFrame, found: DataFrame, checks: list[tuple[str, Callable[[Grounds], Column]]] | None = None) -> DataFrame:
    """rows (set_id = source_key, row_id, position, ...; operator and operands of a derivation) with issues and status.

    Checks: those of CHECKS, or the given ones (a name, and a function of Grounds to the array of a row's findings, in which
    any column of rows may be used), then self_check and no_duplicates. All are columns of one pass. A document's keys and numbers are gathered and looked up in its sections once; rows are
    joined to the verdicts, not to the text.
    """
    no_text, no_numbers = F.array().cast("array<string>"), F.array().cast("array<double>")
    s = sections.where("level <> 'sub'")
    whole = s.groupBy("source_key").agg(F.array_sort(F.collect_list(F.struct("position", "title", norm(F.concat("title", F.lit("\n"), "body")).alias("body")))).alias("secs"))
    whole = whole.select("source_key", F.transform("secs", lambda x: x["title"]).alias("titles"), F.transform("secs", lambda x: x["body"]).alias("bodies"))
    figures = found.groupBy("source_key").agg(F.array_sort(F.collect_set("value")).alias("figures"))
    gathered = lambda c: F.array_distinct(F.array_compact(F.flatten(F.collect_list(c))))
    keys = F.transform(F.concat(_list("answer_keys"), _list("forbidden_keys")), norm)
    asks = rows.groupBy("source_key", "row_id").agg(gathered(keys).alias("keys"), gathered(_list("gold_sections")).alias("cites"), gathered(F.concat(F.array("numeric_answer"), F.coalesce("operands", no_numbers))).alias("numbers"))
    asks = asks.groupBy("source_key").agg(F.collect_list(F.struct("row_id", "keys", "cites", "numbers")).alias("asks"))
    asks = asks.join(whole, "source_key", "left").join(figures, "source_key", "left")
    part = lambda c: F.transform("asks", lambda x: x[c])
    told = _grounds_of(F.coalesce("titles", no_text), F.coalesce("bodies", no_text), F.coalesce("figures", no_numbers), part("keys"), part("cites"), part("numbers"))
    checked = asks.select("source_key", F.explode(F.arrays_zip(part("row_id").alias("row_id"), told.alias("told"))).alias("c"))
    checked = checked.select(F.col("source_key").alias("__set"), F.col("c.row_id").alias("__row"), F.map_from_entries("c.told.verdicts").alias("verdicts"), F.col("c.told.stated").alias("stated"))
    r = rows.join(checked, (F.col("source_key") == F.col("__set")) & F.col("row_id").eqNullSafe(F.col("__row")), "left").drop("__set", "__row")
    r = r.join(whole.select("source_key", "titles"), "source_key", "left").withColumn("titles", F.coalesce("titles", no_text))
    grounds, none = Grounds(), F.array().cast("array<string>")
    named = lambda name, items: F.transform(F.coalesce(items, none), lambda x: F.concat(F.lit(f"{name}: "), x))
    issues = F.concat(none, *[named(name, check(grounds)) for name, check in (CHECKS if checks is None else checks)])
    r = r.withColumn("issues", issues).drop("verdicts", "stated", "titles")
    own = score(r.withColumn("pred_answer", F.col("answer")).withColumn("retrieved_sections", F.lit(None).cast("array<string>")))
    r = own.withColumn("issues", F.concat("issues", F.when(~F.col("correct"), F.array(F.lit("self_check: the reference answer fails its own row"))).otherwise(F.array().cast("array<string>")))).drop("pred_answer", "retrieved_sections", "reasons", "correct", "support", "recall", "precision")
    again = duplicate_questions(rows).select("source_key", "row_id", F.lit(True).alias("again"))
    r = r.join(again, ["source_key", "row_id"], "left").withColumn("issues", F.concat("issues", F.when(F.col("again"), F.array(F.lit("no_duplicates: asks nearly the same question"))).otherwise(F.array().cast("array<string>")))).drop("again")
    return r.withColumn("status", F.when(F.size("issues") > 0, "flagged").otherwise("valid"))


def duplicate_questions(rows: DataFrame) -> DataFrame:
    """Rows (source_key, row_id, position, question) that share their words with an earlier row of the set, to SIMILAR
    or more of the larger set: an equi-join on rare shared words, then the exact overlap. Rows of the same words meet others once, by their least position.

    Rows within the bound share all but a few words, so each row is indexed by its rarest words only: the prefix
    that two such rows must have in common.
    """
    words = F.array_sort(F.array_distinct(F.filter(F.split(norm("question"), " "), lambda w: w != "")))
    asked = rows.where(F.length("question") >= LEAST_QUESTION).select("source_key", "row_id", "position", words.alias("words")).where("size(words) > 0")
    # rows of the same words are one class, which stands at its least position
    q = asked.groupBy("source_key", "words").agg(F.min("position").alias("first"))
    flat = q.select("source_key", "words", F.explode("words").alias("word"))
    rarity = flat.groupBy("source_key", "word").agg(F.count(F.lit(1)).alias("df"))
    ranked = flat.join(rarity, ["source_key", "word"]).groupBy("source_key", "words").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("ws"))
    prefix = F.size("ws") - F.ceil(F.size("ws") * F.lit(SIMILAR)).cast("int") + 1
    keys = ranked.select("source_key", "words", F.explode(F.transform(F.slice("ws", 1, prefix), lambda x: x["word"])).alias("word"))
    a = keys.join(q, ["source_key", "words"]).select("source_key", "word", "first", "words")
    b = a.select("source_key", "word", F.col("first").alias("p2"), F.col("words").alias("w2"))
    near = a.join(b, ["source_key", "word"]).where("p2 < first").where(F.size(F.array_intersect("words", "w2")) / F.greatest(F.size("words"), F.size("w2")) >= SIMILAR)
    before = q.unionByName(near.select("source_key", "words", F.col("p2").alias("first"))).groupBy("source_key", "words").agg(F.min("first").alias("first"))
    return asked.join(before, ["source_key", "words"]).where("first < position").select("source_key", "row_id").distinct()


def exportable(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce("review", F.lit("pending")) != "dropped")


def export_golden(rows: DataFrame) -> DataFrame:
    """row_id and its JSON line: fields in fixed order, absent ones left out, tolerance beside a number, dropped rows excluded."""
    some = lambda c: F.when(F.size(_list(c)) > 0, F.col(c)).alias(c)
    line = F.struct(
        F.col("question_id").alias("id"), "type", "difficulty", "question", "answer", "numeric_answer", F.when(F.col("numeric_answer").isNotNull(), F.coalesce("numeric_tolerance", F.lit(TOLERANCE))).alias("numeric_tolerance"),
        some("answer_keys"), some("forbidden_keys"), F.when(F.col("must_refuse"), True).alias("must_refuse"), _list("gold_sections").alias("gold_sections"), F.when(F.col("note") != "", F.col("note")).alias("note"),
    )
    return exportable(rows).select("row_id", F.to_json(line, {"ignoreNullFields": "true"}).alias("value"))


def renumber(rows: DataFrame) -> DataFrame:
    """question_id Q001, Q002, ... by position in the set, dropped rows skipped (blank id)."""
    live = F.coalesce("review", F.lit("pending")) != "dropped"
    n = F.sum(F.when(live, 1).otherwise(0)).over(Window.partitionBy("source_key").orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("question_id", F.when(live, F.format_string("Q%03d", n)).otherwise(""))


def withdraw(sets: DataFrame, set_ids: DataFrame, at) -> DataFrame:
    """sets with those of set_ids marked deleted at a time; rows stay, and live() leaves them out."""
    return _marked(sets, set_ids, F.lit(True), at)


def restore(sets: DataFrame, set_ids: DataFrame) -> DataFrame:
    return _marked(sets, set_ids, F.lit(False), F.lit(None))


def _marked(sets: DataFrame, set_ids: DataFrame, deleted: Column, at) -> DataFrame:
    asked = set_ids.select(F.col("set_id").alias("__asked")).distinct()
    was = F.col("deleted") if "deleted" in sets.columns else F.lit(False)
    when = F.col("deleted_at") if "deleted_at" in sets.columns else F.lit(None).cast("timestamp")
    both = sets.join(asked, F.col("set_id") == F.col("__asked"), "left")
    chosen = F.col("__asked").isNotNull()
    return both.withColumn("deleted", F.when(chosen, deleted).otherwise(F.coalesce(was, F.lit(False)))).withColumn("deleted_at", F.when(chosen, at).otherwise(when).cast("timestamp")).drop("__asked")


def apply_row_updates(rows: DataFrame, updates: DataFrame, sections: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """Only given fields change (question, answer, review); a change of content sets edited; ids are renumbered. With the
    sections and facts of the documents, sets that hold an edited row are validated again, whole, since an edit can make
    another row its duplicate; other sets keep their issues and status."""
    u = updates.select(F.col("row_id").alias("__id"), F.col("question").alias("__q"), F.col("answer").alias("__a"), F.col("review").alias("__r"))
    r = rows.join(u, F.col("row_id") == F.col("__id"), "left")
    r = r.withColumn("edited", F.coalesce("edited", F.lit(False)) | F.coalesce(F.col("__q").isNotNull() | F.col("__a").isNotNull(), F.lit(False)))
    r = r.withColumn("question", F.coalesce("__q", "question")).withColumn("answer", F.coalesce("__a", "answer")).withColumn("review", F.coalesce("__r", "review"))
    r = renumber(r.drop("__id", "__q", "__a", "__r"))
    if sections is None:
        return r
    content = updates.where(F.col("question").isNotNull() | F.col("answer").isNotNull()).select("row_id")
    touched = rows.join(content, "row_id", "left_semi").select("source_key").distinct()
    again = validate(r.join(touched, "source_key", "left_semi").drop("issues", "status"), sections, found)
    return r.join(touched, "source_key", "left_anti").unionByName(again, allowMissingColumns=True)


def set_counts(sets: DataFrame, rows: DataFrame) -> DataFrame:
    n = rows.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("status") == "valid").alias("valid"), F.count_if(F.col("review") == "accepted").alias("accepted"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sets.join(n, "set_id", "left").select(*sets.columns, zero("n_rows"), zero("valid"), zero("accepted"))


def live(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce("deleted", F.lit(False)))


_DRAFT = "struct<rows:array<struct<type:string,difficulty:string,question:string,answer:string,numeric_answer:string,numeric_tolerance:string,answer_keys:array<string>,forbidden_keys:array<string>,must_refuse:boolean,gold_sections:array<string>,note:string>>>"


def parse_drafts(replies: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """reply_id, reply to draft rows: code fences off, the outermost braces of the reply as JSON, types outside the
    allowed list become its first, rows without question or answer left out; error where nothing parses."""
    cleaned = text.strip(F.regexp_replace(F.coalesce("reply", F.lit("")), r"(?m)^\s*```[A-Za-z]*\s*$", ""))
    braces = F.regexp_extract(cleaned, r"(?s)\{.*\}", 0)
    parsed = F.from_json(braces, _DRAFT)
    out = replies.select("reply_id", F.when(cleaned == "", "the reply was empty").when(F.get_json_object(braces, "$").isNull(), "no JSON object in the reply").alias("error"), F.explode_outer(parsed["rows"]).alias("r"))
    blank = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), text.strip), lambda x: x != "")
    return out.select(
        "reply_id", "error", F.when(F.col("r.type").isin(*allowed), F.col("r.type")).otherwise(allowed[0]).alias("type"), F.when(F.col("r.difficulty").isin(*DIFFICULTIES), F.col("r.difficulty")).otherwise("medium").alias("difficulty"),
        text.strip("r.question").alias("question"), text.strip("r.answer").alias("answer"), F.col("r.numeric_answer").try_cast("double").alias("numeric_answer"), blank(F.col("r.answer_keys")).alias("answer_keys"),
        F.coalesce("r.must_refuse", F.lit(False)).alias("must_refuse"), blank(F.col("r.gold_sections")).alias("gold_sections"),
    ).where("error is not null or (coalesce(question, '') <> '' and coalesce(answer, '') <> '')")
