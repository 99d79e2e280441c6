"""Queries of search, prompts, golden sets, traces, verdicts, runs and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import golden, search, sections, traces
from ..registry import registered
from .scratch import stored
from .screening import binder
from .tables import chunks, sources, table, vectors, with_cte

# --- search


def asked(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20."""
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), "embedding")


def space(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("vector_id"), "embedding", F.concat(F.lit("s"), (F.col("vec_id") % 4).cast("string")).alias("space"), F.col("label").cast("string").alias("source"))


_SCORED = "s AS (SELECT q.vec_id AS question_id, v.vec_id AS vector_id, v.label, v.vec_id % 4 AS space, round(greatest(0.0, least(1.0, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]))), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)"
_TOP = _SCORED + ", t AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vector_id) AS rank FROM s QUALIFY rank <= 10)"


@registered("v2_search", f"WITH {_TOP} SELECT question_id, vector_id, score, rank::INT AS rank FROM t")
def v2(spark: SparkSession, d: str) -> DataFrame:
    return search.search(asked(spark, d), space(spark, d), 10)


@registered("v2_search_grid", f"WITH {_TOP} SELECT question_id, vector_id, score, rank::INT AS rank FROM t")
def v2_grid(spark: SparkSession, d: str) -> DataFrame:
    """The same without a broadcast, as if two kilobytes of questions were too many for one."""
    return search.search(asked(spark, d), space(spark, d), 10, question_bytes=1 << 11)


@registered("l1_top_k_in_space", f"WITH {_SCORED} SELECT question_id, vector_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vector_id)::INT AS rank FROM s WHERE space = 1 QUALIFY rank <= 5")
def l1(spark: SparkSession, d: str) -> DataFrame:
    return search.search(asked(spark, d), space(spark, d), 5, "s1")


@registered("w1_p5_rank_and_threshold", f"WITH {_TOP} SELECT question_id, vector_id, score < 0.5 AS dropped, (row_number() OVER (PARTITION BY question_id ORDER BY score < 0.5, score DESC, vector_id) - 1)::INT AS rank FROM t")
def w1(spark: SparkSession, d: str) -> DataFrame:
    return search.retrieve(asked(spark, d), space(spark, d), 10, 0.5).select("question_id", "vector_id", "dropped", "rank")


@registered("v3_retrieve_ungrounded", f"WITH {_TOP} SELECT question_id, count(*) AS n FROM t WHERE question_id % 3 <> 0 GROUP BY 1")
def v3(spark: SparkSession, d: str) -> DataFrame:
    q = asked(spark, d).withColumn("use_rag", F.col("question_id") % 3 != 0)
    return search.retrieve(q, space(spark, d), 10, 0.5).groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))


@registered("p9_same_model", f"WITH {_TOP} SELECT question_id, vector_id, 'm' AS embedding_model FROM t")
def p9(spark: SparkSession, d: str) -> DataFrame:
    m = search.search(asked(spark, d), space(spark, d), 10).withColumn("embedding_model", F.lit("m"))
    return search.assert_same_model(m, "m").select("question_id", "vector_id", "embedding_model")


@registered("p8_pick_field", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'k' || doc_id ELSE source END AS source FROM documents")
def p8(spark: SparkSession, d: str) -> DataFrame:
    key = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("k"), F.col("doc_id").cast("string"))).otherwise("")
    m = F.create_map(F.lit("source_key"), key, F.lit("source"), F.col("source"))
    return table(spark, d, "documents").select("doc_id", search.pick_field(m, ["source_key", "source", "url"]).alias("source"))




def _bow(name: str, i: str, body: str, t: str) -> str:
    return f"""{name}c AS (SELECT id, (('0x' || substr(md5(word), 1, 8))::BIGINT % 1024)::INT AS bucket, count(*) AS n FROM (SELECT {i} AS id, unnest([x for x in regexp_split_to_array(lower({body}), '[^\\p{{L}}\\p{{N}}]+') if x <> '']) AS word FROM {t}) GROUP BY ALL),
{name} AS (SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS weight FROM {name}c)"""


@registered("v1_bag_of_words", f"WITH {_bow('e', 'item_id', 'text', 'benchmark')} SELECT id AS item_id, bucket, round(weight, 9) AS weight FROM e")
def v1(spark: SparkSession, d: str) -> DataFrame:
    return search.bag_of_words(table(spark, d, "benchmark"), "item_id", "text").select("item_id", "bucket", F.round("weight", 9).alias("weight"))


@registered("v2_search_sparse", f"WITH {_bow('q', 'item_id', 'text', 'benchmark')}, {_bow('c', 'doc_id', 'text', 'documents')}, s AS (SELECT q.id AS question_id, c.id AS vector_id, round(greatest(0.0, least(1.0, sum(q.weight * c.weight))), 6) AS score FROM q JOIN c USING (bucket) GROUP BY ALL) SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vector_id)::INT AS rank, score FROM s QUALIFY rank <= 10")
def v2b(spark: SparkSession, d: str) -> DataFrame:
    q = search.bag_of_words(table(spark, d, "benchmark"), "item_id", "text").withColumnRenamed("item_id", "question_id")
    c = search.bag_of_words(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("doc_id", "vector_id")
    return search.search_sparse(q, c, 10).select("question_id", "rank", "score")


@registered("j20_compare_variants", f"WITH {_SCORED}, a AS (SELECT * FROM s WHERE space = 0 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vector_id) <= 5), b AS (SELECT * FROM s WHERE space = 1 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vector_id) <= 5), x AS (SELECT question_id, label, max(score) AS score_a FROM a GROUP BY ALL), y AS (SELECT question_id, label, max(score) AS score_b FROM b GROUP BY ALL) SELECT coalesce(x.question_id, y.question_id) AS question_id, coalesce(x.label, y.label)::VARCHAR AS source, score_a, score_b, CASE WHEN score_b IS NULL THEN 'a' WHEN score_a IS NULL THEN 'b' ELSE 'both' END AS side FROM x FULL JOIN y ON x.question_id = y.question_id AND x.label = y.label")
def j20(spark: SparkSession, d: str) -> DataFrame:
    label = space(spark, d).select("vector_id", "source")
    a, b = (search.search(asked(spark, d), space(spark, d), 5, s).join(label, "vector_id") for s in ("s0", "s1"))
    return search.compare_variants(a, b, ["question_id", "source"])


@registered("v6_context_block", f"WITH {_TOP}, r AS (SELECT *, score < 0.5 AS dropped FROM t) SELECT question_id, md5(string_agg('[Chunk ' || vector_id || ' | score=' || printf('%.3f', score) || ']' || chr(10) || 'label ' || label, chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM r WHERE NOT dropped GROUP BY 1")
def v6(spark: SparkSession, d: str) -> DataFrame:
    m = search.retrieve(asked(spark, d), space(spark, d), 10, 0.5).join(space(spark, d).select("vector_id", "source"), "vector_id")
    m = m.withColumn("content", F.concat(F.lit("label "), "source")).withColumn("document_id", F.lit(None).cast("string"))
    return search.context_block(m).select("question_id", F.md5("context").alias("context_md5"))


PROMPTS = {"system": "Answer from the context.", "context_block": "Context:\n{chunks}", "no_context": "Nothing was found for: {query}"}


@registered("v7_messages", "SELECT item_id AS question_id, md5(CASE WHEN item_id % 4 = 1 THEN '' ELSE 'system:Answer from the context.|' END || CASE WHEN item_id % 3 = 0 THEN 'system:Context:' || chr(10) || 'c' || item_id || '|' WHEN item_id % 2 = 0 THEN 'system:Nothing was found for: ' || text || '|' ELSE '' END || 'user:' || text) AS messages_md5 FROM benchmark")
def v7(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark")
    q = b.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), (F.col("item_id") % 2 == 0).alias("use_rag"), F.when(F.col("item_id") % 4 == 1, " ").alias("system_prompt"))
    m = search.messages(q, b.where("item_id % 3 = 0").select(F.col("item_id").alias("question_id"), F.concat(F.lit("c"), F.col("item_id").cast("string")).alias("context")), PROMPTS)
    return m.select("question_id", F.md5(F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")).alias("messages_md5"))


@registered("v9_splice_tables", """SELECT doc_id::VARCHAR AS document_id, CASE WHEN doc_id % 3 = 0 THEN 'table-001: not found in the document text; left as-is.' ELSE '' END AS warned, length(x)::INT AS n, md5(x) AS text_md5 FROM (SELECT doc_id, text || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '|a|b|' ELSE 'abc' || chr(10) || chr(10) || '[Table 001](table://' || doc_id || '/table-001)' END || chr(10) AS x FROM documents)""")
def v9(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.concat("text", F.lit("\n|a|b|\n")).alias("text"), F.array(F.struct(F.lit(1).alias("page"), F.lit(0).alias("start"), (F.length("text") + 7).alias("end"))).alias("spans"))
    t = docs.select("document_id", F.lit("table-001").alias("table_id"), F.when(F.col("document_id").cast("bigint") % 3 == 0, "|x|").otherwise("|a|b|").alias("markdown"), F.lit(None).cast("int").alias("page"), F.lit("").alias("caption"))
    out = search.splice_tables(docs, t, t.select("document_id", "table_id", F.lit("abc").alias("description")))
    return out.select("document_id", F.array_join("warnings", "; ").alias("warned"), F.col("spans")[0]["end"].alias("n"), F.md5("text").alias("text_md5"))


@registered("j17_active_prompts", "SELECT DISTINCT lang AS prompt_id, CASE WHEN lang = 'en' THEN 'own' ELSE 'default ' || lang END AS template, lang = 'en' AS overridden FROM documents")
def j17(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").select(F.col("lang").alias("prompt_id"), F.concat(F.lit("default "), "lang").alias("template")).distinct()
    return search.active_prompts(p, p.where("prompt_id = 'en'").select("prompt_id", F.lit("own").alias("template")))


# --- golden sets: a row per document, with a prediction


def gold(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    w = F.split("text", " ")
    return table(spark, d, "documents").select(
        n.alias("id"), F.when(n % 5 == 0, "unanswerable").when(n % 3 == 0, "arithmetic").otherwise("lookup").alias("type"), F.when(n % 2 == 0, "easy").otherwise("hard").alias("difficulty"),
        F.when((n % 3 == 0) & (n % 5 != 0), F.col("n_chars").cast("double")).alias("numeric_answer"), F.when(n % 2 == 0, 2.0).alias("numeric_tolerance"), F.when(n % 5 != 0, F.slice(w, 1, 2)).alias("answer_keys"),
        F.array(F.concat(F.lit("zz"), (n % 4).cast("string"))).alias("forbidden_keys"), (n % 5 == 0).alias("must_refuse"), F.when(n % 7 != 0, F.array("source", "lang")).alias("gold_sections"),
    )


def predictions(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    body = F.when(n % 4 == 0, F.lit("The report does  NOT state this.")).when(n % 4 == 1, F.concat(F.lit("It is "), F.format_number(F.col("n_chars") + n % 3, 0), F.lit(" in all."))).when(n % 4 == 2, F.col("text")).otherwise("zz3")
    return table(spark, d, "documents").where("doc_id % 11 <> 0").select(n.alias("id"), body.alias("answer"), F.when(n % 13 != 0, F.array(F.concat(F.lit(" "), F.upper("source")), F.lit("other"))).alias("retrieved_sections"))


_GOLD = r"""g AS (SELECT doc_id AS id, text, source, CASE WHEN doc_id % 5 = 0 THEN 'unanswerable' WHEN doc_id % 3 = 0 THEN 'arithmetic' ELSE 'lookup' END AS type, CASE WHEN doc_id % 2 = 0 THEN 'easy' ELSE 'hard' END AS difficulty, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0 THEN n_chars::DOUBLE END AS num, CASE WHEN doc_id % 2 = 0 THEN 2.0 ELSE 0.05 END AS tol, CASE WHEN doc_id % 5 <> 0 THEN string_split(text, ' ')[1:2] ELSE [] END AS keys, 'zz' || (doc_id % 4) AS forbidden, doc_id % 5 = 0 AS refuse, doc_id % 7 <> 0 AS cited FROM documents),
p AS (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'The report does  NOT state this.' WHEN 1 THEN 'It is ' || format('{:,}', n_chars + doc_id % 3) || ' in all.' WHEN 2 THEN text ELSE 'zz3' END AS answer, doc_id % 13 <> 0 AS reported FROM documents WHERE doc_id % 11 <> 0),
j AS (SELECT g.*, coalesce(p.answer, '') AS answer, p.reported, lower(trim(regexp_replace(coalesce(p.answer, ''), '\s+', ' ', 'g'))) AS low FROM g LEFT JOIN p USING (id)),
k AS (SELECT *, len([x for x in keys if NOT contains(low, lower(trim(regexp_replace(x, '\s+', ' ', 'g'))))]) AS missing, contains(low, forbidden) AS trapped, len([x for x in regexp_extract_all(answer, '-?\d[\d,]*(?:\.\d+)?') if abs(try_cast(replace(x, ',', '') AS DOUBLE) - num) <= tol]) > 0 AS near, regexp_matches(low, '\bdoes not (?:state|say|specify|disclose|provide|report|contain|include|break)\b') AS refused FROM j),
sc AS (SELECT id, type, difficulty, answer <> '' AS answered, NOT trapped AND CASE WHEN refuse THEN refused AND missing = 0 WHEN num IS NOT NULL THEN near ELSE missing = 0 END AS correct, CASE WHEN len(keys) > 0 THEN (len(keys) - missing) / len(keys) END AS support, CASE WHEN cited AND reported THEN 0.5 END AS recall, CASE WHEN cited AND reported THEN 0.5 END AS precision FROM k)"""


@registered("j5_g1_score_predictions", f"WITH {_GOLD} SELECT id, correct, round(support, 6) AS support, recall, precision FROM sc")
def g1(spark: SparkSession, d: str) -> DataFrame:
    return golden.score_predictions(gold(spark, d), predictions(spark, d)).select("id", "correct", F.round("support", 6).alias("support"), "recall", "precision")


@registered("j6_unknown_predictions", "SELECT doc_id AS id FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 2 = 1")
def j6(spark: SparkSession, d: str) -> DataFrame:
    return golden.unknown_predictions(gold(spark, d).where("id % 2 = 0"), predictions(spark, d)).select("id")


@registered("a8_eval_report", f"WITH {_GOLD} SELECT type, difficulty, count(*) AS total, count(*) FILTER (WHERE correct) AS correct, count(*) FILTER (WHERE answered) AS answered, round(avg(support), 6) AS support, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision FROM sc GROUP BY GROUPING SETS ((type), (difficulty), ())")
def a8(spark: SparkSession, d: str) -> DataFrame:
    return golden.eval_report(golden.score_predictions(gold(spark, d), predictions(spark, d)))


@registered("u1_section_metrics", "SELECT doc_id AS id, CASE WHEN cited THEN hits / 2 END AS recall, CASE WHEN cited THEN CASE WHEN n = 0 THEN 0.0 ELSE hits / n END END AS precision FROM (SELECT doc_id, doc_id % 13 <> 0 AND doc_id % 7 <> 0 AS cited, (n_chars % 2 = 0)::INT + (n_chars % 3 = 0)::INT AS hits, (n_chars % 2 = 0)::INT + (n_chars % 3 = 0)::INT + (n_chars % 5 = 0)::INT AS n FROM documents)")
def u1(spark: SparkSession, d: str) -> DataFrame:
    if_even = lambda k, title: F.when(F.col("n_chars") % k == 0, title)
    found = F.array_compact(F.array(if_even(2, F.concat(F.lit("  "), F.upper("source"))), if_even(3, F.initcap("lang")), if_even(5, F.lit("elsewhere")), if_even(2, F.col("source"))))
    g = gold(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 13 != 0, found).alias("found")), "id")
    recall, precision = golden.section_metrics(F.col("gold_sections"), F.col("found"))
    return g.select("id", recall.alias("recall"), precision.alias("precision"))


def variant_scores(spark: SparkSession, d: str) -> DataFrame:
    s = golden.score_predictions(gold(spark, d), predictions(spark, d))
    v = F.explode(F.array(*[F.struct(F.lit(name).alias("variant"), F.lit(k).alias("k")) for k, name in enumerate(("boundary-64-16", "fixed-64-16", "recursive-64-16"))]))
    s = s.select("id", "correct", "recall", "precision", v.alias("v")).select("id", "v.variant", "v.k", "correct", "recall", "precision")
    failed = (F.col("id") + F.col("k")) % 10 == 0
    return s.select("id", "variant", F.when(~failed & (F.col("k") != 2), F.col("correct")).alias("correct"), F.when(~failed, F.col("recall") * (F.col("k") + 1) / 3).alias("recall"), F.when(~failed, F.col("precision")).alias("precision"), failed.alias("failed"))


_VS = f"{_GOLD}, vs AS (SELECT id, variant, CASE WHEN (id + k) % 10 <> 0 AND k <> 2 THEN correct END AS correct, CASE WHEN (id + k) % 10 <> 0 THEN recall * (k + 1) / 3 END AS recall, CASE WHEN (id + k) % 10 <> 0 THEN precision END AS precision, (id + k) % 10 = 0 AS failed FROM sc, (VALUES ('boundary-64-16', 0), ('fixed-64-16', 1), ('recursive-64-16', 2)) v(variant, k))"
_VT = f"{_VS}, vt AS (SELECT variant, count(*) AS n, count(*) FILTER (WHERE correct) AS correct, round(coalesce(avg(recall), 0), 6) AS recall, round(coalesce(avg(precision), 0), 6) AS precision, count(*) FILTER (WHERE failed) AS failed FROM vs GROUP BY variant)"


@registered("a7_g8_variant_totals", f"WITH {_VT} SELECT * FROM vt")
def a7(spark: SparkSession, d: str) -> DataFrame:
    return golden.variant_totals(variant_scores(spark, d))


@registered("w7_g10_leaderboard", f"WITH {_VT} SELECT variant, row_number() OVER (ORDER BY recall DESC, correct DESC, variant)::INT AS place FROM vt")
def w7(spark: SparkSession, d: str) -> DataFrame:
    return golden.leaderboard(golden.variant_totals(variant_scores(spark, d))).select("variant", "place")


@registered("a16_miss_grid", f"WITH {_VS} SELECT id, round(max(recall) FILTER (WHERE variant = 'boundary-64-16'), 6) AS a, round(max(recall) FILTER (WHERE variant = 'fixed-64-16'), 6) AS b FROM vs GROUP BY id")
def a16(spark: SparkSession, d: str) -> DataFrame:
    g = golden.miss_grid(variant_scores(spark, d), ["boundary-64-16", "fixed-64-16"])
    return g.select("id", F.round(F.col("`boundary-64-16`"), 6).alias("a"), F.round(F.col("`fixed-64-16`"), 6).alias("b"))


@registered("g9_variants_for", "SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN 'fixed-64-16' ELSE 'recursive-64-16' END AS variant FROM documents")
def g9(spark: SparkSession, d: str) -> DataFrame:
    return golden.variants_for(table(spark, d, "documents").select(F.when(F.col("doc_id") % 2 == 0, "fixed-64-16").otherwise("recursive-64-16").alias("variant")))


def fact_sections(spark: SparkSession, d: str) -> DataFrame:
    """A section per document and a line of figures under it."""
    return sections.sections(binder(spark, d, F.concat(F.lit("## doc-"), F.col("doc_id").cast("string"), F.lit("\nIt has "), F.format_number("n_chars", 0), F.lit(" characters, no. "), F.col("doc_id").cast("string"), F.lit(" of 1,000.5 and 1,000.5"))))


_FACTS = r"""l AS (SELECT source || '/' || (doc_id // 1000) AS source_key, doc_id, unnest(string_split('It has ' || format('{:,}', n_chars) || ' characters, no. ' || doc_id || ' of 1,000.5 and 1,000.5' || chr(10) || text, chr(10))) AS line FROM documents),
f AS (SELECT DISTINCT source_key, 'doc-' || doc_id AS title, left(trim(regexp_replace(line, '\s+', ' ', 'g')), 110) AS context, unnest(regexp_extract_all(line, '-?\d[\d,]*(?:\.\d+)?')) AS token FROM l),
fv AS (SELECT *, try_cast(replace(token, ',', '') AS DOUBLE) AS value FROM f WHERE context <> '' AND try_cast(replace(token, ',', '') AS DOUBLE) IS NOT NULL)"""


@registered("g2_w8_facts", f"WITH {_FACTS} SELECT source_key, title, token, md5(context) AS context_md5, value FROM fv")
def g2(spark: SparkSession, d: str) -> DataFrame:
    return golden.facts(fact_sections(spark, d)).select("source_key", "title", "token", F.md5("context").alias("context_md5"), "value")


@registered("a12_fact_counts", f"WITH {_FACTS} SELECT source_key, count(DISTINCT value) AS figures, count(DISTINCT value) >= 12 AS allow_arithmetic FROM fv GROUP BY 1")
def a12(spark: SparkSession, d: str) -> DataFrame:
    return golden.fact_counts(golden.facts(fact_sections(spark, d)))


@registered("l6_render_digest", r"""WITH l AS (SELECT source || '/' || (doc_id // 1000) AS source_key, doc_id, string_split('It has ' || format('{:,}', n_chars) || ' characters, no. ' || doc_id || ' of 1,000.5 and 1,000.5' || chr(10) || text, chr(10)) AS lines FROM documents),
m AS (SELECT source_key, doc_id, i, lines[i] AS line, regexp_extract_all(lines[i], '-?\d[\d,]*(?:\.\d+)?') AS toks FROM l, unnest(range(1, len(lines) + 1)) u(i)),
f AS (SELECT source_key, doc_id, i, j, toks[j] AS token, left(trim(regexp_replace(line, '\s+', ' ', 'g')), 110) AS context FROM m, unnest(range(1, len(toks) + 1)) u(j)),
o AS (SELECT * FROM f WHERE context <> '' AND try_cast(replace(token, ',', '') AS DOUBLE) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_key, doc_id, token, context ORDER BY i, j) = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY doc_id, i, j) AS nth FROM o QUALIFY nth <= 120)
SELECT source_key, md5(string_agg('[doc-' || doc_id || '] ' || token || ' — ' || context, chr(10) ORDER BY nth)) AS digest_md5, count(*) AS n_lines FROM n GROUP BY 1""")
def l6(spark: SparkSession, d: str) -> DataFrame:
    return golden.render_digest(golden.facts(fact_sections(spark, d))).select("source_key", F.md5("digest").alias("digest_md5"), F.size(F.split("digest", "\n")).cast("bigint").alias("n_lines"))


@registered("g3_quota", r"""WITH s AS (SELECT source || '/' || (doc_id // 1000) AS source_key, length(regexp_replace('It has ' || format('{:,}', n_chars) || ' characters, no. ' || doc_id || ' of 1,000.5 and 1,000.5' || chr(10) || text, '\s+$', '')) AS n FROM documents)
SELECT source_key, sum(greatest(1, least(5, round_even(n / 500, 0)::INT)))::BIGINT AS questions, greatest(2, least(12, count(*)))::INT AS cross_section, greatest(2, least(8, round_even(count(*) * 0.45, 0)::INT))::INT AS unanswerable FROM s GROUP BY 1""")
def g3(spark: SparkSession, d: str) -> DataFrame:
    s = fact_sections(spark, d)
    q = golden.quota(s, golden.fact_counts(golden.facts(s)))
    return q.select("source_key", F.expr("aggregate(per_section, 0L, (a, x) -> a + x.n)").alias("questions"), "cross_section", "unanswerable")


def gold_rows(spark: SparkSession, d: str) -> DataFrame:
    """A golden row per document of a binder."""
    n = F.col("doc_id")
    # twelve words at most are used: what follows them isn't split
    w = F.filter(F.split("text", r"\s+", 14), lambda x: x != "")
    return table(spark, d, "documents").select(
        F.concat("source", F.lit("/"), F.floor(n / 1000).cast("string")).alias("source_key"), n.alias("row_id"), n.alias("position"), F.when(n % 5 == 0, "unanswerable").otherwise("lookup").alias("type"), F.lit("easy").alias("difficulty"),
        F.concat(F.lit("What does the document say of "), F.array_join(F.slice(w, 1, 8), " "), F.lit("?")).alias("question"), F.when(n % 5 == 0, F.lit("This is not stated.")).otherwise(F.array_join(F.slice(w, 1, 12), " ")).alias("answer"),
        F.when(n % 6 == 1, F.col("n_chars").cast("double")).when(n % 6 == 2, F.lit(-7.25)).alias("numeric_answer"), F.lit(None).cast("double").alias("numeric_tolerance"),
        F.when(n % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.array_join(F.slice(w, 1, 3), " "), F.when(n % 4 == 0, "qqq qqq").otherwise(F.array_join(F.slice(w, 2, 2), " ")))).alias("answer_keys"),
        F.array(F.lit("xyzzy")).alias("forbidden_keys"), (n % 10 == 0).alias("must_refuse"), F.array(F.concat(F.lit("doc-"), (n + F.when(n % 9 == 0, 100000).otherwise(0)).cast("string"))).alias("gold_sections"),
        F.when(n % 6 == 1, "sum").alias("operator"), F.when(n % 6 == 1, F.array(F.col("n_chars").cast("double"))).alias("operands"), F.lit("").alias("note"),
        F.when(n % 8 == 0, "dropped").when(n % 8 == 1, "accepted").otherwise("pending").alias("review"), F.lit(False).alias("edited"), F.lit("").alias("question_id"),
    )


def stored_sections(spark: SparkSession, d: str) -> DataFrame:
    """The same as a table in its store: they are read for their bodies and for their figures."""
    return stored(spark, d, "fact-sections", lambda: fact_sections(spark, d))


@registered("g4_g5_validate")
def g4(spark: SparkSession, d: str) -> DataFrame:
    s = stored_sections(spark, d)
    return golden.validate(gold_rows(spark, d), s, golden.facts(s)).select("source_key", "row_id", "status", F.array_join("issues", "; ").alias("issues"))


@registered("j13_duplicate_questions", r"""WITH q AS (SELECT source || '/' || (doc_id // 1000) AS source_key, doc_id, list_distinct([x for x in string_split(lower(trim(regexp_replace('What does the document say of ' || array_to_string([x for x in regexp_split_to_array(text, '\s+') if x <> ''][1:8], ' ') || '?', '\s+', ' ', 'g'))), ' ') if x <> '']) AS w FROM documents)
SELECT DISTINCT b.source_key, b.doc_id AS row_id FROM q a JOIN q b ON a.source_key = b.source_key AND a.doc_id < b.doc_id AND len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w)) >= 0.85""")
def j13(spark: SparkSession, d: str) -> DataFrame:
    return golden.duplicate_questions(gold_rows(spark, d))


_LINE = "SELECT doc_id AS row_id, 1 + count(*) FILTER (WHERE doc_id % 8 <> 0) OVER (PARTITION BY source, doc_id // 1000 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM documents"


@registered("w2_renumber", f"SELECT row_id, CASE WHEN row_id % 8 = 0 THEN '' ELSE 'Q' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INT, '0') END AS question_id FROM ({_LINE})")
def w2(spark: SparkSession, d: str) -> DataFrame:
    return golden.renumber(gold_rows(spark, d)).select("row_id", "question_id")


@registered("p6_io12_export_golden", f"""SELECT row_id, CASE WHEN row_id % 8 = 0 THEN '' ELSE 'Q' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INT, '0') END AS id, row_id % 6 IN (1, 2) AS has_number, CASE WHEN row_id % 6 IN (1, 2) THEN 0.05 END AS tolerance, row_id % 10 = 0 AS refuse FROM ({_LINE}) WHERE row_id % 8 <> 0""")
def io12(spark: SparkSession, d: str) -> DataFrame:
    lines = golden.export_golden(golden.renumber(gold_rows(spark, d)))
    j = lambda p: F.get_json_object("value", p)
    return lines.select("row_id", j("$.id").alias("id"), j("$.numeric_answer").isNotNull().alias("has_number"), j("$.numeric_tolerance").cast("double").alias("tolerance"), (F.coalesce(j("$.must_refuse"), F.lit("")) == "true").alias("refuse"))


@registered("g7_apply_row_updates", "SELECT doc_id AS row_id, CASE WHEN doc_id % 3 = 0 THEN 'new?' END AS asked, doc_id % 3 = 0 AS edited, CASE WHEN doc_id % 4 = 1 THEN 'dropped' WHEN doc_id % 8 = 0 THEN 'dropped' WHEN doc_id % 8 = 1 THEN 'accepted' ELSE 'pending' END AS review FROM documents")
def g7(spark: SparkSession, d: str) -> DataFrame:
    r = gold_rows(spark, d)
    u = r.where("row_id % 3 = 0 or row_id % 4 = 1").select("row_id", F.when(F.col("row_id") % 3 == 0, "new?").alias("question"), F.lit(None).cast("string").alias("answer"), F.when(F.col("row_id") % 4 == 1, "dropped").alias("review"))
    return golden.apply_row_updates(r, u).select("row_id", F.when(F.col("question") == "new?", "new?").alias("asked"), "edited", "review")


def revalidation(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Validated rows as stored, updates (in half of the sets every seventh row gets an answer that refuses), sections and figures."""
    s = stored_sections(spark, d)
    found, half = golden.facts(s), (F.crc32("source_key") % 2 == 0) & (F.col("row_id") % 7 == 0)
    rows = stored(spark, d, "validated", lambda: golden.validate(gold_rows(spark, d), s, found))
    none = F.lit(None).cast("string")
    u = gold_rows(spark, d).where(half).select("row_id", none.alias("question"), F.lit("The document does not say.").alias("answer"), none.alias("review"))
    return rows, u, s, found


@registered("g7_revalidated")
def g7_again(spark: SparkSession, d: str) -> DataFrame:
    """Edited answers are tested again with their sets; sets without an edit keep what they had."""
    rows, u, s, found = revalidation(spark, d)
    return golden.apply_row_updates(rows, u, s, found).select("source_key", "row_id", "edited", "status", F.array_join("issues", "; ").alias("issues"))


@registered("a9_g11_set_counts", "SELECT source AS set_id, source || '-report' AS slug, count(*) AS n_rows, count(*) FILTER (WHERE doc_id % 3 = 0) AS valid, count(*) FILTER (WHERE doc_id % 4 = 0) AS accepted FROM documents WHERE source <> 'src3' GROUP BY 1")
def a9(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    sets = golden.live(docs.select(F.col("source").alias("set_id"), (F.col("source") == "src3").alias("deleted")).distinct()).select("set_id", text.slug(F.concat(F.upper("set_id"), F.lit(" -- Report!"))).alias("slug"))
    rows = docs.select(F.col("source").alias("set_id"), F.when(F.col("doc_id") % 3 == 0, "valid").otherwise("flagged").alias("status"), F.when(F.col("doc_id") % 4 == 0, "accepted").otherwise("pending").alias("review"))
    return golden.set_counts(sets, rows)


@registered("g6_parse_drafts", "SELECT doc_id AS reply_id, CASE WHEN doc_id % 4 = 3 THEN 'no JSON object in the reply' END AS error, CASE WHEN doc_id % 4 <> 3 AND doc_id % 2 = 0 THEN 'temporal' ELSE 'lookup' END AS type, CASE WHEN doc_id % 4 <> 3 THEN n_chars::DOUBLE END AS numeric_answer FROM documents WHERE doc_id % 4 = 3 OR source <> ''")
def g6(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    row = F.struct(F.when(n % 2 == 0, "temporal").otherwise("nonsense").alias("type"), F.lit(" what? ").alias("question"), F.col("source").alias("answer"), F.col("n_chars").cast("string").alias("numeric_answer"))
    body = F.to_json(F.struct(F.array(row).alias("rows")))
    reply = F.when(n % 4 == 3, F.lit("I can't do that.")).when(n % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(n % 4 == 2, F.concat(F.lit("Here: "), body, F.lit(" Done."))).otherwise(body)
    return golden.parse_drafts(table(spark, d, "documents").select(n.alias("reply_id"), reply.alias("reply")), ("lookup", "temporal")).select("reply_id", "error", "type", "numeric_answer")


# --- traces: a user turn and the next assistant turn


def trace_table(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = c.withColumn("answer", F.lead(F.when(F.col("role") == "assistant", F.col("text"))).over(w)).where("role = 'user'")
    n = F.col("conv_id") * 100 + F.col("turn")
    return t.select(n.alias("trace_id"), F.timestamp_seconds(F.lit(1704067200) + n * 600).alias("created_at"), F.col("text").alias("question"), "answer", F.concat(F.lit("m"), (n % 3).cast("string")).alias("model"), F.when(n % 7 == 0, "failed").when(n % 11 == 0, "cancelled").otherwise("completed").alias("state"), (n / 1e7).alias("total_cost"))


def chunk_table(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("trace_id")
    return trace_table(spark, d).select("trace_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("rank")).select("trace_id", "rank", F.concat(F.lit("v"), (n % 50 + F.col("rank")).cast("string")).alias("vector_id"), (1.0 / (F.col("rank") + n % 4 + 1)).alias("score"), (F.col("rank") >= n % 4).alias("dropped"), F.concat(F.lit("src"), ((n + F.col("rank")) % 20).cast("string")).alias("source"))


def eval_table(spark: SparkSession, d: str) -> DataFrame:
    n, j = F.col("trace_id"), F.col("j")
    target = F.element_at(F.array(F.lit("retrieval"), F.lit("generation"), F.lit("overall")), j % 3 + 1)
    t = trace_table(spark, d).where("trace_id % 4 <> 0").select("trace_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j"))
    return t.select((n * 10 + j).alias("eval_id"), "trace_id", target.alias("target"), F.when((n + j) % 3 == 0, "bad").otherwise("good").alias("verdict"), F.concat(F.lit("a"), (n % 2).cast("string")).alias("author"), F.when(j == 0, F.array(F.lit("ranked_low"), F.lit("missing_chunk"), F.lit("ranked_low"))).when(j == 1, F.array(F.lit("ranked_low"), F.lit("verbose"), F.lit("nope"))).otherwise(F.array().cast("array<string>")).alias("tags"), ((n + j) % 5 == 0).alias("deleted"), (n * 10 + j).alias("created_at"))


_T = """tr AS (SELECT conv_id * 100 + turn AS trace_id, text AS question, nxt AS answer FROM (SELECT *, lead(CASE WHEN role = 'assistant' THEN text END) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE role = 'user'),
t AS (SELECT *, 1704067200 + trace_id * 600 AS created, 'm' || (trace_id % 3) AS model, CASE WHEN trace_id % 7 = 0 THEN 'failed' WHEN trace_id % 11 = 0 THEN 'cancelled' ELSE 'completed' END AS state FROM tr),
c AS (SELECT trace_id, k::INT AS rank, 'v' || (trace_id % 50 + k) AS vector_id, 1.0::DOUBLE / (k + trace_id % 4 + 1) AS score, k >= trace_id % 4 AS dropped, 'src' || ((trace_id + k) % 20) AS source FROM t, unnest(range(4)) u(k)),
e AS (SELECT trace_id * 10 + j AS eval_id, trace_id, j, (['retrieval', 'generation', 'overall'])[j % 3 + 1] AS target, CASE WHEN (trace_id + j) % 3 = 0 THEN 'bad' ELSE 'good' END AS verdict, 'a' || (trace_id % 2) AS author, CASE j WHEN 0 THEN ['ranked_low', 'missing_chunk', 'ranked_low'] WHEN 1 THEN ['ranked_low', 'verbose', 'nope'] ELSE [] END AS tags, (trace_id + j) % 5 = 0 AS deleted FROM t, unnest(range(5)) u(j) WHERE trace_id % 4 <> 0)"""


@registered("p1_j10_filter_traces", f"WITH {_T} SELECT trace_id FROM t WHERE model = 'm1' AND state = 'completed' AND contains(lower(question), 'a') AND trace_id IN (SELECT trace_id FROM c WHERE source = 'src5') AND trace_id IN (SELECT trace_id FROM e WHERE NOT deleted AND verdict = 'bad' AND target = 'retrieval') UNION ALL SELECT trace_id FROM t WHERE trace_id NOT IN (SELECT trace_id FROM e WHERE NOT deleted)")
def p1(spark: SparkSession, d: str) -> DataFrame:
    t, c, e = trace_table(spark, d), chunk_table(spark, d), eval_table(spark, d)
    a = traces.filter_traces(t, c, e, model="m1", state="completed", question="A", source="src5", verdict="bad", target="retrieval")
    return a.unionByName(traces.filter_traces(t, c, e, evaluated=False)).select("trace_id")


@registered("p2_p7_filter_evaluations", f"WITH {_T} SELECT eval_id FROM e WHERE NOT deleted AND target = 'retrieval' AND author = 'a1' AND list_contains(tags, 'ranked_low')")
def p2(spark: SparkSession, d: str) -> DataFrame:
    return traces.filter_evaluations(eval_table(spark, d), target="retrieval", author="a1", tag="ranked_low").select("eval_id")


@registered("a6_w6_verdict_rollup", f"WITH {_T}, l AS (SELECT trace_id, target, count(*) AS n, arg_max(verdict, eval_id) AS verdict FROM e WHERE NOT deleted GROUP BY ALL) SELECT trace_id, sum(n)::BIGINT AS n_live, string_agg(target || '=' || verdict, ',' ORDER BY target) AS verdicts FROM l GROUP BY 1")
def a6(spark: SparkSession, d: str) -> DataFrame:
    r = traces.verdict_rollup(eval_table(spark, d))
    return r.select("trace_id", "n_live", F.array_join(F.transform(F.array_sort(F.map_entries("verdicts")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("verdicts"))


@registered("a14_tag_counts", f"WITH {_T}, x AS (SELECT target, verdict, unnest(tags) AS tag FROM e WHERE NOT deleted) SELECT target, verdict, count(*) AS n FROM x GROUP BY CUBE (target, verdict)")
def a14(spark: SparkSession, d: str) -> DataFrame:
    return traces.tag_counts(eval_table(spark, d))


@registered("j11_u5_validate_tags", f"WITH {_T} SELECT eval_id, CASE WHEN j = 0 THEN 'missing_chunk,ranked_low' WHEN j = 1 THEN 'verbose' ELSE '' END AS kept, CASE WHEN j = 1 THEN 'nope' ELSE '' END AS unknown, CASE WHEN j = 1 THEN 'ranked_low' ELSE '' END AS misplaced FROM e")
def j11(spark: SparkSession, d: str) -> DataFrame:
    v = traces.validate_tags(eval_table(spark, d))
    return v.select("eval_id", *[F.array_join(c, ",").alias(c) for c in ("kept", "unknown", "misplaced")])


@registered("t3_apply_verdict_log", f"WITH {_T} SELECT eval_id, trace_id, trace_id % 3 = 1 AS deleted, CASE WHEN trace_id % 3 = 1 THEN 'first' END AS reason FROM e WHERE trace_id % 2 = 1")
def t3(spark: SparkSession, d: str) -> DataFrame:
    e = eval_table(spark, d)
    log = lambda df, op, seq, why: df.select(F.lit(seq).alias("seq"), F.lit(op).alias("op"), "eval_id", "trace_id", F.lit(why).cast("string").alias("reason"), F.col("created_at").alias("at"))
    out = e.where("trace_id % 3 <> 0")
    whole = log(e, "create", 0, None).unionByName(log(out, "withdraw", 1, "first")).unionByName(log(out, "withdraw", 2, "second")).unionByName(log(e.where("trace_id % 3 = 2"), "restore", 3, None))
    return traces.apply_verdict_log(whole, trace_table(spark, d).where("trace_id % 2 = 1")).select("eval_id", "trace_id", "deleted", "reason")


@registered("a13_trace_summary", f"WITH {_T} SELECT trace_id, count(*) FILTER (WHERE NOT dropped) AS chunk_count, round(coalesce(max(score) FILTER (WHERE NOT dropped), 0), 9) AS top_score FROM c GROUP BY 1")
def a13(spark: SparkSession, d: str) -> DataFrame:
    return traces.trace_summary(chunk_table(spark, d)).withColumn("top_score", F.round("top_score", 9))


@registered("l2_t4_list_traces", f"WITH {_T} SELECT trace_id, created FROM t ORDER BY created DESC, trace_id DESC LIMIT 50 OFFSET 20")
def l2(spark: SparkSession, d: str) -> DataFrame:
    return traces.list_traces(trace_table(spark, d), eval_table(spark, d), 50, 20).select("trace_id", F.unix_timestamp("created_at").alias("created"))


@registered("t4_trace_detail", f"WITH {_T} SELECT trace_id, (SELECT string_agg(rank || ':' || vector_id || ':' || dropped, ',' ORDER BY rank) FROM c WHERE c.trace_id = t.trace_id) AS chunks, (SELECT string_agg(eval_id || ':' || target || ':' || verdict || ':' || deleted, ',' ORDER BY eval_id) FROM e WHERE e.trace_id = t.trace_id) AS evals FROM t")
def t4(spark: SparkSession, d: str) -> DataFrame:
    x = traces.trace_detail(trace_table(spark, d), chunk_table(spark, d), eval_table(spark, d))
    shown = lambda c, names: F.when(F.col(c).isNotNull(), F.array_join(F.transform(c, lambda r: F.concat_ws(":", *[r[n].cast("string") for n in names])), ","))
    return x.select("trace_id", shown("chunks", ("rank", "vector_id", "dropped")).alias("chunks"), shown("evaluations", ("eval_id", "target", "verdict", "deleted")).alias("evals"))


@registered("io13_export_evaluations", f"WITH {_T}, v AS (SELECT trace_id, target, arg_max(verdict, eval_id) AS verdict, count(*) AS n FROM e WHERE NOT deleted GROUP BY ALL) SELECT trace_id, md5(question) AS question_md5, round(trace_id / 1e7, 8) AS cost, (SELECT string_agg(vector_id, ',' ORDER BY rank) FROM c WHERE c.trace_id = t.trace_id) AS chunks, (SELECT round(max(score), 6) FROM c WHERE c.trace_id = t.trace_id) AS top, (SELECT string_agg(target || ':' || verdict || ':' || n, ',' ORDER BY target) FROM v WHERE v.trace_id = t.trace_id) AS verdicts FROM t WHERE trace_id IN (SELECT trace_id FROM v)")
def io13(spark: SparkSession, d: str) -> DataFrame:
    x = traces.export_evaluations(trace_table(spark, d), chunk_table(spark, d), eval_table(spark, d))
    record = F.from_json("value", "question string, total_cost double, chunks array<struct<vector_id:string,score:double>>, evaluations map<string,array<struct<verdict:string>>>")
    x = x.select("trace_id", record.alias("r"))
    latest = F.transform(F.array_sort(F.map_keys("r.evaluations")), lambda k: F.concat_ws(":", k, F.element_at("r.evaluations", k)[0]["verdict"], F.size(F.element_at("r.evaluations", k)).cast("string")))
    return x.select("trace_id", F.md5("r.question").alias("question_md5"), F.col("r.total_cost").alias("cost"), F.array_join("r.chunks.vector_id", ",").alias("chunks"), F.col("r.chunks")[0]["score"].alias("top"), F.array_join(latest, ",").alias("verdicts"))


@registered("j14_prune_traces", f"WITH {_T}, m AS (SELECT max(created) AS now FROM t) SELECT trace_id, (SELECT count(*) FROM c WHERE c.trace_id = t.trace_id) AS n_chunks FROM t, m WHERE created >= now - 2592000 OR trace_id IN (SELECT trace_id FROM e)")
def j14(spark: SparkSession, d: str) -> DataFrame:
    t = trace_table(spark, d)
    now = F.lit(t.agg(F.max("created_at")).first()[0])
    kept, c = traces.prune_traces(t, chunk_table(spark, d), eval_table(spark, d), now)
    return kept.join(c.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_chunks")), "trace_id").select("trace_id", "n_chunks")


@registered("j18_delete_trace", f"WITH {_T} SELECT 'traces' AS tab, trace_id AS key FROM t WHERE trace_id % 2 = 1 UNION ALL SELECT 'chunks', trace_id * 10 + rank FROM c WHERE trace_id % 2 = 1 UNION ALL SELECT 'evals', eval_id FROM e WHERE trace_id % 2 = 1")
def j18(spark: SparkSession, d: str) -> DataFrame:
    t = trace_table(spark, d)
    left = traces.delete_traces(t.where("trace_id % 2 = 0"), t, chunk_table(spark, d), eval_table(spark, d))
    keys = F.col("trace_id"), F.col("trace_id") * 10 + F.col("rank"), F.col("eval_id")
    parts = [df.select(F.lit(name).alias("tab"), k.alias("key")) for name, df, k in zip(("traces", "chunks", "evals"), left, keys, strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@registered("a11_distinct_models", f"WITH {_T} SELECT DISTINCT model FROM t")
def a11(spark: SparkSession, d: str) -> DataFrame:
    return traces.distinct_models(trace_table(spark, d))


@registered("t2_drifted", with_cte("files", "sources", "allchunks", "chunks", "vectors", then="SELECT c.vector_id FROM chunks c JOIN vectors v ON c.vector_id = v.vector_id AND v.space = '' WHERE c.content <> v.content"))
def t2(spark: SparkSession, d: str) -> DataFrame:
    shown = traces.trace_chunks(chunks(spark, d).select("vector_id", "content"))
    return traces.drifted(shown, vectors(spark, d).where("space = ''")).select("vector_id")


def trace_events(spark: SparkSession, d: str) -> DataFrame:
    """Records of requests from events: four events in a row of a user are a request's."""
    e = table(spark, d, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    e = e.withColumn("n", n).withColumn("trace_id", F.col("user_id") * 100000 + F.floor(F.col("n") / 4))
    kind = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, "error:generation").otherwise("error:retrieval")).when(F.col("event_type") == "signup", "cancel").when(F.col("event_type") == "purchase", "usage").otherwise("token")
    return e.select("trace_id", F.col("event_id").alias("seq"), kind.alias("kind"), F.when(kind == "usage", F.floor("value").cast("string")).otherwise(F.concat(F.lit(" "), F.col("event_id").cast("string"))).alias("value"))


@registered("t1_build_traces", """WITH x AS (SELECT *, user_id * 100000 + (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 4 AS trace_id FROM events),
k AS (SELECT trace_id, event_id, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'generation' ELSE 'retrieval' END END AS err, event_type = 'signup' AS cancel, CASE WHEN event_type = 'purchase' THEN floor(value)::BIGINT END AS tok, event_type IN ('click', 'view') AS token FROM x)
SELECT trace_id, coalesce(string_agg(' ' || event_id, '' ORDER BY event_id) FILTER (WHERE token), '') AS answer, arg_max(err, event_id) FILTER (WHERE err IS NOT NULL) AS error_stage, coalesce(sum(tok), 0)::BIGINT AS tokens, CASE WHEN arg_max(err, event_id) FILTER (WHERE err IS NOT NULL) = 'generation' THEN 'failed' WHEN bool_or(cancel) THEN 'cancelled' ELSE 'completed' END AS state FROM k GROUP BY trace_id""")
def t1(spark: SparkSession, d: str) -> DataFrame:
    return traces.build_traces(trace_events(spark, d)).drop("question")


def stage_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    e = e.withColumn("n", n)
    return e.select(F.col("user_id").alias("trace_id"), F.floor(F.col("n") / 2).alias("sequence"), F.lit("stage").alias("name"), F.when(F.col("n") % 2 == 0, "started").when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))


@registered("t5_timeline", """WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events),
g AS (SELECT user_id AS trace_id, n // 2 AS sequence, min(floor(epoch(ts))::BIGINT) FILTER (WHERE n % 2 = 0) AS s, max(floor(epoch(ts))::BIGINT) FILTER (WHERE n % 2 = 1) AS f, max(CASE WHEN n % 2 = 1 THEN CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END END) AS status FROM x GROUP BY 1, 2)
SELECT trace_id, sequence, coalesce(status, 'open') AS status, CASE WHEN f IS NOT NULL THEN greatest(0, f - s) END AS duration FROM g""")
def t5(spark: SparkSession, d: str) -> DataFrame:
    t = traces.timeline(stage_events(spark, d))
    return t.select("trace_id", "sequence", "status", F.when(F.col("ended").isNotNull(), F.col("duration")).alias("duration"))


# --- runs and costs, from events and orders


def run_files(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    out = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "current").when(F.col("event_type") == "purchase", "blocked").otherwise("indexed")
    v = F.floor("value").cast("bigint")
    return e.select((F.col("user_id") % 40).alias("job_id"), "event_id", out.alias("outcome"), v.alias("chunks"), (v % 3).alias("reused"), (v % 2).alias("pruned"), F.col("ts").cast("timestamp").alias("at"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    return run_files(spark, d).groupBy("job_id").agg(F.min("at").alias("started_at"), F.when(F.first("job_id") % 4 == 0, "running").otherwise("done").alias("state"))


_RF = "rf AS (SELECT user_id % 40 AS job_id, event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'current' WHEN 'purchase' THEN 'blocked' ELSE 'indexed' END AS outcome, floor(value)::BIGINT AS chunks, ts FROM events), ru AS (SELECT job_id, min(ts) AS started FROM rf GROUP BY 1)"


@registered("a10_run_totals", f"WITH {_RF} SELECT job_id, count(*) FILTER (WHERE outcome = 'indexed') AS indexed, count(*) FILTER (WHERE outcome = 'current') AS skipped, count(*) FILTER (WHERE outcome IN ('failed', 'blocked')) AS failed, sum(chunks)::BIGINT AS chunks, sum(chunks % 3)::BIGINT AS reused, sum(chunks % 2)::BIGINT AS pruned FROM rf GROUP BY 1")
def a10(spark: SparkSession, d: str) -> DataFrame:
    return traces.run_totals(run_files(spark, d))


@registered("l4_t6_run_report", f"WITH {_RF} SELECT job_id, (SELECT count(*) FROM rf WHERE rf.job_id = ru.job_id AND outcome = 'indexed') AS indexed FROM ru ORDER BY started DESC, job_id LIMIT 10")
def l4(spark: SparkSession, d: str) -> DataFrame:
    return traces.run_report(runs(spark, d), run_files(spark, d), 10).select("job_id", F.coalesce(F.element_at("outcomes", "indexed"), F.lit(0)).alias("indexed"))


@registered("j15_prune_runs", f"WITH {_RF}, m AS (SELECT max(started) AS now FROM ru) SELECT ru.job_id, CASE WHEN ru.job_id % 4 = 0 THEN 'abandoned' ELSE 'done' END AS state, (SELECT count(*) FROM rf WHERE rf.job_id = ru.job_id) AS n FROM ru, m WHERE started >= now - INTERVAL 30 DAY")
def j15(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d)
    now = F.lit(r.agg(F.max("started_at")).first()[0])
    kept, f, _ = traces.prune_runs(r, run_files(spark, d), run_files(spark, d), now)
    return traces.close_abandoned(kept).join(f.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")), "job_id").select("job_id", "state", "n")


@registered("p10_r6_replay", "SELECT event_id AS cursor, event_type FROM events WHERE user_id = 7 AND event_id > 500")
def p10(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("cursor"), "event_type")
    return traces.replay(e, 7, 500).select("cursor", "event_type")


def usage(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("request_id"), F.concat(F.lit("m"), (k % 4).cast("string")).alias("model"), (k % 1000).alias("input_tokens"), (k % 300).alias("output_tokens"), F.when(k % 2 == 0, k % 50).alias("cache_read_tokens"), F.lit(0).cast("bigint").alias("cache_write_tokens"))


@registered("j12_cost", "SELECT o_orderkey AS request_id, round(CASE o_orderkey % 4 WHEN 3 THEN 0 ELSE (o_orderkey % 1000) / 1e6 * (o_orderkey % 4 + 1) + (o_orderkey % 300) / 1e6 * 10 + coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 50 END, 0) / 1e6 * 0.2 END, 9) AS total_cost FROM orders")
def j12(spark: SparkSession, d: str) -> DataFrame:
    prices = spark.createDataFrame([(f"m{i}", i + 1.0, 10.0, 0.2, 2.5) for i in range(3)], "model string, input_per_1m double, output_per_1m double, cache_read_per_1m double, cache_write_per_1m double")
    return traces.cost(usage(spark, d), prices).select("request_id", F.round("total_cost", 9).alias("total_cost"))


@registered("a15_spend", "SELECT 'm' || (o_orderkey % 4) AS model, sum(o_orderkey % 1000)::BIGINT AS input_tokens, sum(o_orderkey % 300)::BIGINT AS output_tokens, sum(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 50 END)::BIGINT AS cache_read_tokens, 0::BIGINT AS cache_write_tokens, sum(o_orderkey % 1000 + o_orderkey % 300)::BIGINT AS total_tokens FROM orders GROUP BY 1")
def a15(spark: SparkSession, d: str) -> DataFrame:
    return traces.spend(usage(spark, d))


@registered("fn_scalars", r"""SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) = '' AS blank, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS norm_md5, substr(sha256(text), 1, 16) AS content_hash, 'derived/' || substr(sha1(source), 1, 16) || '/extraction.json' AS derived FROM documents""")
def fn(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", (text.norm("text") == "").alias("blank"), F.md5(text.norm("text")).alias("norm_md5"), ids.content_hash("text").alias("content_hash"), ids.derived_key(ids.document_id("source"), "extraction.json").alias("derived"))
