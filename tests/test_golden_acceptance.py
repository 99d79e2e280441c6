"""The forty golden rows: right answers pass, six wrong ones fail; scoring of variants end to end."""

from pyspark.sql import functions as F

from loomspark.operators import chunking, golden, search, sections

from .golden_rows import ROWS

WRONG = {
    "Q016": "Total revenue was $2,833.0 million.", "Q020": "Marisol Reyes leads the Cold Chain segment.", "Q031": "The effective tax rate was about 31 percent.",
    "Q036": "Fiscal 2026 revenue was $3.10 billion.", "Q037": "The CFO's annual salary was $12.4 million.", "Q040": "Market capitalization was $1,489.3 million.",
}


def _gold(spark):
    rows = [(i, t, "easy", "?", a, n, tol, k, f, r, []) for i, t, a, n, tol, k, f, r in ROWS]
    return spark.createDataFrame(rows, "id string, type string, difficulty string, question string, answer string, numeric_answer double, numeric_tolerance double, answer_keys array<string>, forbidden_keys array<string>, must_refuse boolean, gold_sections array<string>")


def _failing(spark, answers):
    p = spark.createDataFrame([(k, a, None) for k, a in answers.items()], "id string, answer string, retrieved_sections array<string>")
    scores = golden.score_predictions(_gold(spark), p)
    total = golden.eval_report(scores).where("type is null and difficulty is null").first()
    return {r.id for r in scores.where("not correct").collect()}, (total.total, total.correct)


def test_forty_rows(spark):
    right = {r[0]: r[2] for r in ROWS}
    assert _failing(spark, right) == (set(), (40, 40))
    assert _failing(spark, right | WRONG) == (set(WRONG), (40, 34))


def test_variant_scores(spark):
    """A row that cites a section and one that can't be answered: the second measures nothing and leaves the means alone."""
    body = lambda w: " ".join(f"{w}{i}" for i in range(70))
    docs = spark.createDataFrame([("r.txt", f"## Section 4\n{body('a')}\n## Section 5\n{body('b')}")], "source_key string, text string")
    gold = spark.createDataFrame([("Q1", "lookup", "easy", ["Section 4"], ["a1"], False), ("Q2", "unanswerable", "easy", [], [], True)], "id string, type string, difficulty string, gold_sections array<string>, answer_keys array<string>, must_refuse boolean")
    chunks = chunking.chunk_all(docs, ["fixed-64-0"])
    matches = spark.createDataFrame([("fixed-64-0", k, "r.txt", 0, False) for k in ("Q1", "Q2")] + [("fixed-64-0", "Q1", "r.txt", 2, True)], "variant string, id string, source_key string, chunk_index int, dropped boolean")
    rows = {r.id: r for r in golden.score_variants(gold, matches, chunks, docs).collect()}
    assert len(rows) == 2 and (rows["Q1"].recall, rows["Q1"].precision, rows["Q1"].correct) == (1.0, 1.0, None) and rows["Q2"].recall is None
    total = golden.variant_totals(golden.score_variants(gold, matches, chunks, docs)).first()
    assert (total.n, total.recall, total.failed) == (2, 1.0, 0)
    answers = spark.createDataFrame([("fixed-64-0", "Q1", "it says a1", None), ("fixed-64-0", "Q2", None, "no reply")], "variant string, id string, answer string, error string")
    rows = {r.id: r for r in golden.score_variants(gold, matches, chunks, docs, answers).collect()}
    assert rows["Q1"].correct is True and rows["Q2"].failed and rows["Q2"].correct is None
    board = golden.compare_variants_run(gold, matches, chunks, docs, answers)
    assert [(r.variant, r.winner) for r in board.collect()] == [("fixed-64-0", True)]
    assert sections.map_sections(chunks, docs).count() >= 2


def test_where_answers_come_from(spark):
    v = spark.createDataFrame([("s", "d#00000", "one", "a.txt", [1.0, 0.0], "m"), ("s", "d#00001", "two", "a.txt", [0.0, 1.0], "m"), ("t", "d#00002", "three", "a.txt", [1.0, 0.0], "old")], "space string, vector_id string, content string, source_key string, embedding array<float>, embedding_model string")
    q = spark.createDataFrame([(1, [1.0, 0.0], True, None), (2, [1.0, 0.0], False, None), (3, [1.0, 0.0], True, [("own", "mine", "x")])], "question_id long, embedding array<float>, use_rag boolean, own_chunks array<struct<vector_id:string,content:string,source:string>>")
    at = lambda space, state: spark.createDataFrame([(space, state)], "space string, state string")
    got = {(r.question_id, r.vector_id): (r.content, r.dropped, r["rank"]) for r in search.answer_matches(q, v, at("s", "ready"), 5, 0.5, "m").collect()}
    assert got == {(1, "d#00000"): ("one", False, 0), (1, "d#00001"): ("two", True, 1), (3, "own"): ("mine", False, 0)}
    import pytest

    with pytest.raises(ValueError, match="no vectors"):
        search.answer_matches(q, v, at("s", "missing"), 5, 0.5, "m")
    with pytest.raises(Exception, match="embedded with old"):
        search.answer_matches(q, v, at("t", "ready"), 5, 0.5, "m").collect()


def validated_by_hand(rows, sections, figures):
    """{row_id: issues} by the rules, with plain strings."""
    import re

    n = lambda t: re.sub(r"\s+", " ", t or "").strip().lower()
    out, seen = {}, {}
    for r in sorted(rows, key=lambda r: r.position):
        secs = [(t, n(f"{t}\n{b}")) for t, b in sections[r.source_key]]
        doc, issues = " ".join(b for _, b in secs), []
        issues += [f"sections_exist: {t}" for t in r.gold_sections or [] if t not in dict(secs)]
        issues += [f"keys_verbatim: {k}" for k in r.answer_keys or [] if n(k) not in doc]
        issues += [f"keys_in_section: {k}" for k in r.answer_keys or [] if n(k) in doc and r.gold_sections and not any(n(k) in b for t, b in secs if t in r.gold_sections)]
        stated = lambda x: any(abs(x - f) < 1e-9 for f in figures.get(r.source_key, ()))  # noqa: B023, E731
        if r.numeric_answer is not None and not stated(r.numeric_answer):
            issues.append("numeric_grounded: " + ("not stated, no derivation" if not r.operands else "derivation uses figures that are not stated"))
        issues += [f"forbidden_grounded: {k}" for k in r.forbidden_keys or [] if n(k) not in doc]
        issues += [f"forbidden_grounded: {k}" for k in r.forbidden_keys or [] if n(k) and n(k) in n(r.answer)]
        if (r.type == "unanswerable") != bool(r.must_refuse):
            issues.append("refusal_shape: " + ("typed unanswerable without must_refuse" if r.type == "unanswerable" else "must_refuse on another type"))
        out[r.row_id] = issues
        seen.setdefault(r.source_key, []).append(r)
    return out


def test_validation_equals_rules(spark, data):
    from loomspark.plans import answers

    s = answers.fact_sections(spark, data)
    rows, found = answers.gold_rows(spark, data).collect(), golden.facts(s).collect()
    secs, figures = {}, {}
    for r in sorted(s.where("level <> 'sub'").collect(), key=lambda r: r.position):
        secs.setdefault(r.source_key, []).append((r.title, r.body))
    for r in found:
        figures.setdefault(r.source_key, set()).add(r.value)
    want = validated_by_hand(rows, secs, figures)
    got = {r.row_id: r.issues for r in golden.validate(answers.gold_rows(spark, data), s, golden.facts(s)).collect()}
    own = lambda issues: sorted(i for i in issues if not i.startswith(("self_check", "no_duplicates")))
    assert {k: own(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_a_callers_check_shows_up(spark, data):
    from loomspark.plans import answers

    s, rows = answers.fact_sections(spark, data), answers.gold_rows(spark, data)
    mine = ("short_answer", lambda g: F.when(F.length("answer") < 40, F.array(F.lit("under 40 characters"))))
    found = golden.facts(s)
    usual = {r.row_id: list(r.issues) for r in golden.validate(rows, s, found).collect()}
    got = {r.row_id: r for r in golden.validate(rows, s, found, [*golden.CHECKS, mine]).collect()}
    added = {k: [i for i in r.issues if i not in usual[k]] for k, r in got.items()}
    assert set(map(tuple, added.values())) == {(), ("short_answer: under 40 characters",)}
    assert all((len(r.answer or "x" * 40) < 40) == bool(added[k]) and (r.status == "flagged") == bool(r.issues) for k, r in got.items())
    assert all(i.startswith(("self_check", "no_duplicates")) for r in golden.validate(rows, s, found, []).collect() for i in r.issues)


def test_edited_sets_are_validated_again(spark, data):
    """Issues and status after an edit are those of a validation of the edited rows; sets without an edit keep what they had."""
    from loomspark.plans import answers

    rows, u, s, found = answers.revalidation(spark, data)
    edited = {r.row_id for r in u.collect()}
    answer = F.when(F.col("row_id").isin(*edited), "The document does not say.").otherwise(F.col("answer"))
    want = {r.row_id: r for r in golden.validate(answers.gold_rows(spark, data).withColumn("answer", answer), s, found).collect()}
    before = {r.row_id: r for r in rows.collect()}
    touched = {want[i].source_key for i in edited}
    # what untouched sets hold is marked, so that it can be told from what a validation says
    marked = rows.withColumn("issues", F.when(F.col("source_key").isin(*touched), F.col("issues")).otherwise(F.array(F.lit("old"))))
    got = golden.apply_row_updates(marked, u, s, found).collect()
    assert len(got) == len(want) and touched and touched != {r.source_key for r in got}
    for r in got:
        assert r.edited == (r.row_id in edited)
        assert list(r.issues) == (list(want[r.row_id].issues) if r.source_key in touched else ["old"])
        assert r.status == (want if r.source_key in touched else before)[r.row_id].status
    assert any(list(want[i].issues) != list(before[i].issues) for i in edited)


def test_stated_numbers_are_those_of_a_plain_search():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (0, 1, 40):
        figures = np.sort(rng.integers(0, 30, n) + rng.choice([0.0, 5e-10, 2e-9], n))
        asked = np.array([*rng.integers(-2, 32, 50).tolist(), np.inf, -np.inf, np.nan])
        assert golden._stated(figures, asked).tolist() == [x for x in asked.tolist() if any(abs(x - f) < 1e-9 for f in figures)]


def test_rows_of_the_same_words_meet_others_once(spark):
    """Many copies of a question, in any order of words, and rows near to them: those behind another one are found, as by all pairs, and copies aren't
    paired with each other."""
    words = [f"w{i}" for i in range(20)]
    asked = [words, words[::-1], words[:19] + ["x"], words[:12] + ["y"] * 3, words[:17] + ["a", "b", "c"], words[:18] + ["a", "b"]]
    rows = [("s" if i % 7 else "t", i, (i * 37) % 101, " ".join(asked[i % len(asked)])) for i in range(300)]
    df = spark.createDataFrame(rows, "source_key string, row_id long, position long, question string")
    alike = lambda a, b: len(set(a) & set(b)) / max(len(set(a)), len(set(b))) >= golden.SIMILAR
    want = {(s, i) for s, i, p, q in rows if any(s == s2 and p2 < p and alike(q.split(), q2.split()) for s2, _, p2, q2 in rows)}
    found = golden.duplicate_questions(df)
    assert {tuple(r) for r in found.collect()} == want
    assert "array_intersect" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "min(position" in plan


def test_matches_with_content_need_no_chunks(spark):
    """Variants scored by the content of their matches, with chunks that can't be read, are scored as with a look-up in chunks."""
    body = lambda w: " ".join(f"{w}{i}" for i in range(70))
    docs = spark.createDataFrame([("r.txt", f"## Section 4\n{body('a')}\n## Section 5\n{body('b')}")], "source_key string, text string")
    gold = spark.createDataFrame([("Q1", "lookup", "easy", ["Section 4", "Section 5"])], "id string, type string, difficulty string, gold_sections array<string>")
    chunks = chunking.chunk_all(docs, ["fixed-64-0", "fixed-128-0"])
    matches = chunks.where("chunk_index < 2").select("variant", F.lit("Q1").alias("id"), "source_key", "chunk_index", (F.col("chunk_index") == 1).alias("dropped"))
    want = sorted(map(tuple, golden.score_variants(gold, matches, chunks, docs).collect()))
    held = matches.join(chunks.select("variant", "source_key", "chunk_index", "content"), ["variant", "source_key", "chunk_index"])
    unread = chunks.withColumn("content", F.raise_error(F.lit("read")).cast("string")).withColumn("variant", F.raise_error(F.lit("read")).cast("string"))
    assert sorted(map(tuple, golden.score_variants(gold, held, unread, docs, None, ["fixed-64-0", "fixed-128-0"]).collect())) == want and len(want) == 2
