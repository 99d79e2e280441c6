"""Titled sections of documents (source_key, text), by ruled, ATX or plain headings, else token slices.

A document's lines are an array of its own row: they are classified there, and bodies are cut from it, so nothing is
shuffled. Output: source_key, position, title, level (top, sub or preamble), body, subsections.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import locate, text
from . import chunking
from .governance import bound

#: The least body of a plain heading, title length of an untitled block, longest heading, words that
#: begin headings, and the patterns of rules, ATX headings and numbered headings.
MIN_BODY, TITLE_CHARS, MAX_HEADING = 40, 80, 90
KEYWORDS = ("article", "section", "chapter", "part", "appendix", "exhibit", "schedule", "annex", "clause")
RULE = r"^\s*([=\-_*~])\1{7,}\s*$"
ATX = r"^\s{0,3}(#{1,6})\s+(.+?)\s*#*\s*$"
NUMBERED = r"^\s*(\d+(?:\.\d+)*)\.?\s+(\S.*[^.\s])\s*$"
SLICE_TOKENS = 400


def _last_with_body(body: Column) -> Column:
    """The last line from whose ink on a text holds MIN_BODY characters up to its last: so has what follows any line above it."""
    inked = lambda t: F.regexp_replace(t, r"\s+$", "")
    return F.size(F.split(bound(inked(body), lambda t: inked(F.substring(t, F.lit(1), F.length(t) - MIN_BODY + 1))), "\n")) - 1


def _classes(lines: Column) -> Column:
    """What each line is: its text without outer white space, whether it may be a heading or is a rule, its hashes."""
    titled = F.transform(lines, lambda line: F.struct(line.alias("line"), text.strip(line).alias("title")))
    plausible = lambda t: (F.length(t) > 0) & (F.length(t) <= MAX_HEADING) & ~t.rlike("[,;:]$")
    return F.transform(titled, lambda x: F.struct(x["line"].alias("line"), x["title"].alias("title"), plausible(x["title"]).alias("plausible"), x["line"].rlike(RULE).alias("rule"), F.length(F.regexp_extract(x["line"], ATX, 1)).alias("hashes")))


def _plain_level(title: Column) -> Column:
    """Level of a title that is numbered, begins with a keyword or has no small letters; else null."""
    number = F.regexp_extract(title, NUMBERED, 1)
    first_word = F.regexp_replace(F.lower(F.split(title, " ")[0]), "[.:]+$", "")
    capitals = title.rlike(r"\p{L}") & ~title.rlike(r"[\p{L}&&[^\p{Lu}]]")
    return F.when(number != "", F.when(F.contains(number, F.lit(".")), "sub").otherwise("top")).when(first_word.isin(*KEYWORDS) | capitals, "top")


def _found(body: Column, lines: Column) -> Column:
    """Headings (start, body_start, title, level) of the first convention that finds any, in order."""

    def of_classes(c: Column, last: Column) -> Column:
        def kinds(x: Column, i: Column) -> Column:
            above, below = F.coalesce(F.get(c, i - 1)["rule"], F.lit(False)), F.coalesce(F.get(c, i + 1)["rule"], F.lit(False))
            row = lambda kind, start, to, title, depth, level: F.struct(F.lit(kind).alias("kind"), start.alias("start"), to.alias("body_start"), title.alias("title"), depth.alias("depth"), level.alias("level"))
            top = F.lit("top")
            return F.array_compact(F.array(
                F.when(x["plausible"] & (above | below), row(1, i - above.cast("int"), i + 1 + below.cast("int"), x["title"], F.lit(0), top)),
                F.when(x["hashes"] > 0, row(2, i, i + 1, text.strip(F.regexp_extract(x["line"], ATX, 2)), x["hashes"], top)),
                F.when(x["plausible"] & (i < last), bound(_plain_level(x["title"]), lambda level: F.when(level.isNotNull(), row(3, i, i + 1, x["title"], F.lit(0), level)))),
            ))

        return bound(F.flatten(F.transform(c, kinds)), chosen)

    def chosen(found: Column) -> Column:
        first = F.array_min(F.transform(found, lambda h: h["kind"]))
        return bound(bound(first, lambda kind: F.filter(found, lambda h: h["kind"] == kind)), levelled)

    def levelled(kept: Column) -> Column:
        # the depth that most hash headings have, the least of these, makes sections
        most = F.array_max(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda d: F.struct(F.size(F.filter(kept, lambda h: h["depth"] == d)), -d)))["col2"]
        level = lambda h, depth: F.when((h["kind"] == 2) & (h["depth"] > depth), "sub").otherwise(h["level"])
        return bound(-most, lambda depth: F.array_sort(F.transform(kept, lambda h: F.struct(h["start"].alias("start"), h["body_start"].alias("body_start"), h["title"].alias("title"), level(h, depth).alias("level")))))

    return bound(_last_with_body(body), lambda last: bound(_classes(lines), lambda c: of_classes(c, last)))


def headings(docs: DataFrame) -> DataFrame:
    """source_key, start (first line), body_start, title, level, of the first convention that finds any heading in a document."""
    body = F.coalesce("text", F.lit(""))
    found = docs.select("source_key", F.explode_outer(bound(F.split(body, "\n"), lambda lines: _found(body, lines))).alias("h"))
    return found.where("h is not null").select("source_key", "h.*")


def _opening(lines: Column) -> Column:
    """A title for text without one: its first line with ink that is no rule."""
    inked = F.filter(lines, lambda s: (F.length(text.strip(s)) > 0) & ~s.rlike(RULE))
    return F.coalesce(F.substring(text.strip(F.get(inked, F.lit(0))), 1, TITLE_CHARS), F.lit("Untitled"))


def _carved(lines: Column, hs: Column) -> Column:
    """A section per heading, after a preamble of enough text."""
    body = lambda a, b: text.strip(F.array_join(F.slice(lines, a + 1, F.greatest(F.lit(0), b - a)), "\n"))
    section = lambda title, level, held: F.struct(title.alias("title"), level.alias("level"), held.alias("body"))
    cut = F.transform(hs, lambda h, i: section(h["title"], h["level"], body(h["body_start"], F.coalesce(F.get(hs, i + 1)["start"], F.size(lines)))))
    above = F.coalesce(F.get(hs, F.lit(0))["start"], F.lit(0))
    preamble = section(_opening(F.slice(lines, F.lit(1), above)), F.lit("preamble"), body(F.lit(0), above))
    return F.concat(F.filter(F.array(preamble), lambda p: F.length(p["body"]) >= MIN_BODY), cut)


def _folded(carved: Column) -> Column:
    """Subsections go into the section above them: their titles listed, their text appended."""

    def fold(every: Column) -> Column:
        def of_heads(heads: Column) -> Column:
            def one(first: Column, k: Column) -> Column:
                head, rest = F.get(every, first), F.slice(every, first + 2, F.coalesce(F.get(heads, k + 1), F.size(every)) - first - 1)
                pieces = F.concat(F.array(head["body"]), F.transform(rest, lambda s: text.strip(F.concat(s["title"], F.lit("\n"), s["body"]))))
                body = text.strip(F.array_join(F.filter(pieces, lambda p: F.length(p) > 0), "\n\n"))
                return F.struct(first.alias("position"), head["title"].alias("title"), head["level"].alias("level"), body.alias("body"), F.transform(rest, lambda s: s["title"]).alias("subsections"))

            return F.filter(F.transform(heads, one), lambda s: F.length(s["body"]) > 0)

        return bound(F.array_compact(F.transform(every, lambda s, i: F.when((s["level"] != "sub") | (i == 0), i))), of_heads)

    return bound(carved, fold)


def unique_titles(sections: Column) -> Column:
    """A title that repeats in its document gets its ordinal: `title (2)`. Titles are brought together by a sort, each run is numbered."""

    def numbered(s: Column) -> Column:
        def of_runs(runs: Column) -> Column:
            def run(first: Column, k: Column) -> Column:
                said = lambda x, nth: F.when(nth > 0, F.concat(x["title"], F.lit(" ("), (nth + 1).cast("string"), F.lit(")"))).otherwise(x["title"])
                return F.transform(F.slice(s, first + 1, F.coalesce(F.get(runs, k + 1), F.size(s)) - first), lambda x, nth: F.struct(x["position"].alias("position"), said(x, nth).alias("title"), *[x[c].alias(c) for c in ("level", "body", "subsections")]))

            return F.array_sort(F.flatten(F.transform(runs, run)))

        return bound(F.array_compact(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1)["title"] != x["title"]), i))), of_runs)

    by_title = F.transform(sections, lambda x: F.struct(*[x[c].alias(c) for c in ("title", "position", "level", "body", "subsections")]))
    return bound(F.array_sort(by_title), numbered)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _token_slices(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([None if t is None else [c for c, *_ in chunking.boundary_segments(t, SLICE_TOKENS, 0)] for t in texts], dtype=object)


def with_sections(docs: DataFrame) -> DataFrame:
    """docs with an array `sections` (position, title, level, body, subsections); a document without headings, or with no text
    under any, is cut into slices of tokens. A null text is an empty one and has none."""
    body = F.coalesce("text", F.lit(""))
    titled = bound(F.split(body, "\n"), lambda lines: bound(_found(body, lines), lambda hs: F.when(F.size(hs) > 0, _folded(_carved(lines, hs)))))
    docs = docs.withColumn("__titled", titled)
    without = F.size(F.coalesce("__titled", F.array())) == 0
    docs = docs.withColumn("__slices", _token_slices(F.when(without, body)))
    slices = F.transform("__slices", lambda c, i: F.struct(i.alias("position"), _opening(F.split(c, "\n")).alias("title"), F.lit("preamble").alias("level"), c.alias("body"), F.array().cast("array<string>").alias("subsections")))
    return docs.withColumn("sections", unique_titles(F.when(without, slices).otherwise(F.col("__titled")))).drop("__titled", "__slices")


def sections(docs: DataFrame) -> DataFrame:
    """Sections of every document, a row each."""
    rows = with_sections(docs.select("source_key", "text")).select("source_key", F.explode_outer("sections").alias("s"))
    return rows.where("s is not null").select("source_key", "s.*")


def citable_titles(sections: DataFrame) -> DataFrame:
    return sections.where("level <> 'sub'").select("source_key", "position", "title")


def with_spans(docs: DataFrame) -> DataFrame:
    """docs with an array `spans` (position, title, start, end, found) of the bodies in the stripped text, searched forward;
    a body that is not there verbatim stands at the cursor."""
    rows = with_sections(docs)
    rows = rows.withColumn("__at", locate.places_in_turn(text.strip(F.coalesce("text", F.lit(""))), F.transform("sections", lambda s: s["body"])))
    span = lambda s, at: F.struct(s["position"].alias("position"), s["title"].alias("title"), at["start"].alias("start"), (at["start"] + F.length(s["body"])).alias("end"), at["found"].alias("found"))
    return rows.withColumn("spans", F.zip_with("sections", "__at", span)).drop("__at", "sections")


def section_spans(docs: DataFrame, found_only: bool = False) -> DataFrame:
    """source_key, position, title, start, end of the spans of with_spans, a row each; with found_only those that are there verbatim."""
    spans = with_spans(docs.select("source_key", "text")).select("source_key", F.explode_outer("spans").alias("s")).where("s is not null").select("source_key", "s.*")
    return spans.where("found").drop("found") if found_only else spans.drop("found")


def probes(chunks: DataFrame, width: int = 96, least: int = 16) -> DataFrame:
    """chunks with an array `probes`: their tail, middle and head of `width` characters, distinct, of some length."""
    c = text.strip("content")
    n = F.length(c)
    parts = F.array(F.right(c, F.lit(width)), F.substring(c, F.greatest(F.lit(1), F.floor((n - width) / 2).cast("int") + 1), F.lit(width)), F.substring(c, 1, width))
    return chunks.withColumn("probes", F.array_distinct(F.filter(F.transform(parts, text.strip), lambda p: F.length(p) >= least)))


def map_sections(chunks: DataFrame, docs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (source_key, chunk_index, further key columns `by`, position, title) of the sections in which a chunk's probes lie. A document's
    spans and the probes of all its chunks are one row, and one pass of its text finds them all."""
    spans = with_spans(docs.select("source_key", "text")).select("source_key", F.filter("spans", lambda s: s["found"]).alias("spans"), text.strip("text").alias("whole"))
    asked = probes(chunks).groupBy("source_key").agg(F.collect_list(F.struct("chunk_index", *by, "probes")).alias("asked"))
    row = asked.join(spans, "source_key")
    row = row.select("source_key", "spans", "asked", locate.places_of("whole", F.transform("asked", lambda c: c["probes"])).alias("at"))
    inside = lambda c, at: F.transform(F.filter("spans", lambda s: F.exists(at, lambda a: (a >= s["start"]) & (a < s["end"]))), lambda s: F.struct(*[c[x].alias(x) for x in ("chunk_index", *by)], s["position"].alias("position"), s["title"].alias("title")))
    hits = row.select("source_key", F.explode(F.flatten(F.zip_with("asked", "at", inside))).alias("h"))
    return hits.select("source_key", "h.*").distinct()


def stamp_pages(chunks: DataFrame, page_spans: DataFrame) -> DataFrame:
    """chunks (start_offset, end_offset) with page_start and page_end: least and greatest page whose span they touch.

    A document's spans follow each other in order of pages, as assemble_pages makes them. Both sides are merged by
    offset: the first page that ends after a chunk's start, and the last that begins before its end.
    """
    c = chunks.select("source_key", "chunk_index", F.col("start_offset").alias("s"), F.col("end_offset").alias("e"))
    p = page_spans.select("source_key", "page", "start", "end")
    none = F.lit(None).cast("int")
    key = ["source_key", "chunk_index"]
    # at one offset chunks come first: a span that ends at a start, or begins at an end, isn't touched
    ends = c.select(*key, F.col("s").alias("at"), none.alias("page")).unionByName(p.select("source_key", none.alias("chunk_index"), F.col("end").alias("at"), "page"))
    begins = c.select(*key, F.col("e").alias("at"), none.alias("page")).unionByName(p.select("source_key", none.alias("chunk_index"), F.col("start").alias("at"), "page"))
    upto = Window.partitionBy("source_key").rowsBetween(Window.unboundedPreceding, 0)
    first = ends.withColumn("page_start", F.min("page").over(upto.orderBy(F.col("at").desc(), F.col("page").isNotNull()))).where("chunk_index is not null").select(*key, "page_start")
    last = begins.withColumn("page_end", F.max("page").over(upto.orderBy("at", F.col("page").isNotNull()))).where("chunk_index is not null").select(*key, "page_end")
    pages = first.join(last, key).where("page_start <= page_end")
    return chunks.join(pages, key, "left")
