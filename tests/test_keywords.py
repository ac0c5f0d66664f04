"""Keyword hits against a plain search, in one automaton and in chunks, and plans without nested loops."""

import random

import pytest
from pyspark.sql import functions as F

from lodeline import catalog
from lodeline.operators import keywords, reports, retrieval


def plain(text, words):
    return None if text is None else sorted(w for w in words if w in text)


@pytest.mark.parametrize("most", [1 << 22, 60])
def test_hits_are_those_of_a_plain_search(spark, monkeypatch, most):
    monkeypatch.setattr(keywords, "MOST_BYTES", most)
    monkeypatch.setattr(keywords, "TEXTS", 30)
    rng = random.Random(2)
    letters = "abé한"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    words = list({word(rng.randint(1, 5)) for _ in range(40)}) + [""]
    texts = [(i % 90, word(rng.randint(0, 40))) for i in range(120)] + [(7, None), (8, ""), (8, "")]
    rows = spark.createDataFrame(texts, "id int, t string")
    table = spark.createDataFrame([(w,) for w in words * 2] + [(None,)], "k string")
    found = keywords.with_hits(rows, "t", table)
    got = sorted(((r.id, r.t, None if r.hits is None else sorted(r.hits)) for r in found.collect()), key=repr)
    assert got == sorted(((i, t, plain(t, words)) for i, t in texts), key=repr)
    assert keywords.with_hits(rows.limit(0), "t", table).count() == 0
    assert {tuple(r.hits) if r.hits is not None else None for r in keywords.with_hits(rows, "t", table.limit(0)).collect()} == {(), None}


def test_title_hits_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    terms = [f"t{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(terms, k=rng.randint(0, 9))), "xy"[i % 2]) for i in range(150)] + [(900, None, "x"), (901, "t1 t2 t3", None)]
    queries = [(i, " ".join(rng.choices(terms, weights=range(1, 31), k=rng.randint(0, 12))), "xy"[i % 2]) for i in range(60)]
    d, q = spark.createDataFrame(docs, "id int, title string, kind string"), spark.createDataFrame(queries, "qid int, text string, cat string")
    for least in (1, 2, 4):
        found = sorted(map(tuple, retrieval.title_hits(d, q, "id", "title", "qid", "text", least, category=("kind", "cat")).collect()))
        expected = [(qid, i, sum(t in title for t in text.split())) for qid, text, cat in queries for i, title, kind in docs if title is not None and kind == cat]
        assert found == sorted(r for r in expected if r[2] >= least)
    everywhere = retrieval.title_hits(d, q, "id", "title", "qid", "text", 5).collect()
    assert len(everywhere) == sum(sum(t in title for t in text.split()) >= 5 for _, text, _ in queries for _, title, _ in docs if title)


def test_topics_of_text_ids(spark):
    notices = spark.createDataFrame([("b", "x y", "x"), ("a", "x", "x y"), ("c", None, None)], "id string, title string, content string")
    questions = spark.createDataFrame([(1, ["x"]), (2, ["y", "y"]), (3, []), (4, ["z"])], "q int, words array<string>")
    best = reports.topic_best(reports.topic_scores(questions, notices, "q", "words", "id", "title", "content"), "q", "id").collect()
    assert sorted(map(tuple, best)) == [(1, "a", 3), (2, "b", 4)]


@pytest.mark.parametrize("name", ["lexicon_score", "route_first_match", "substring_bidirectional_match", "title_and_priority_boosts", "topic_search_best", "department_match", "page_category_score"])
def test_no_query_pairs_texts_with_rules(spark, sf_dir, name):
    frame = catalog.QUERIES[name](spark, sf_dir)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    loops = [line for line in plan.splitlines() if "Join" in line and "=" not in line and "LeftSemi" not in line]
    # what is left without a key is one broadcast row
    assert "CartesianProduct" not in frame._jdf.queryExecution().executedPlan().toString() and len(loops) <= 1, plan
    assert frame.select(F.count(F.lit(1))).first()[0] > 0


def test_texts_that_no_curated_question_can_hold_are_not_looked_for(spark, monkeypatch):
    from lodeline.functions import rules

    looked = []
    real = rules.with_hits
    monkeypatch.setattr(rules, "with_hits", lambda t, c, k, a: (looked.append(k), real(t, c, k, a))[1])
    answers = spark.createDataFrame([(0, "what is the name of it", "a"), (1, "x", "b"), (2, "", "c"), (3, None, "d")], "ord int, question string, answer string")
    texts = ["is the name", "name of us", "the", "it", "", None, "x" * 40, "thename of", "zzz", "is the nape", "what is the name of it"]
    asked = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = {r.i: r.ord for r in rules.either_contains(asked, answers, "i", "t").collect()}
    held = [(o, q) for o, q in ((0, "what is the name of it"), (1, "x"), (2, "")) ]
    assert found == {i: min(o for o, q in held if q in t or t in q) for i, t in enumerate(texts) if t is not None}
    assert sorted(r[0] for r in looked[1].distinct().collect()) == ["", "is the name", "is the nape", "it", "name of us", "the", "what is the name of it"]


def test_documents_are_scored_in_their_tasks_as_by_joins(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randint(0, 12))) if i % 9 else None, rng.choice(["a", "b", None])) for i in range(400)], "i int, t string, c string").repartition(5)
    asked = spark.createDataFrame([(q, " ".join(rng.choices(words, k=4)), rng.choice(["a", "b", None, "z"])) for q in range(20)], "q int, t string, c string")
    found = retrieval.index(docs, "i", "t", "c")

    def told(category):
        rows = retrieval.bm25(found, asked, "q", "t", 3, category=category)
        return sorted((r.query_id, r.category, r.id, round(r.score, 5), r["rank"]) for r in rows.collect())

    monkeypatch.setattr(retrieval, "DOCUMENTS", 7)
    here = told(None), told("c")
    plan = retrieval.bm25(found, asked, "q", "t", 3, category="c")._jdf.queryExecution().toString()
    monkeypatch.setattr(retrieval, "WEIGHTS", 0)
    assert here == (told(None), told("c")) and here[1] and "MapInArrow" in plan
    category = {r.q: r.c for r in asked.collect()}
    assert here[1] == [r for r in here[0] if r[1] == category[r[0]]]


def test_scores_that_are_no_longer_among_the_best_go():
    import numpy as np

    top = retrieval.Top(1, 2)
    for i in range(100_000 // 1000):
        top.see(np.full((1000, 1), float(i % 7)), list(range(1000 * i, 1000 * i + 1000)))
    query, at, score = top.prune()
    assert set(score.tolist()) == {6.0} and len(at) == len(top.ids) == 14_000


def test_texts_meet_python_in_bounded_batches(spark, monkeypatch):
    from lodeline import session
    from lodeline.operators import pagetree

    words, texts = spark.createDataFrame([("a",)], "k string"), spark.createDataFrame([("a",)], "t string")
    for make in (lambda: keywords.with_hits(texts, "t", words), lambda: pagetree.with_tree(texts, "t")):
        for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"):
            spark.conf.unset(key)
        make()
        sizes = spark.range(0, 3000, 1, 1).mapInArrow(lambda batches: (b.slice(0, 0) if b.num_rows <= session.BATCH_ROWS else b for b in batches), "id long")
        assert sizes.count() == 0


def test_titles_are_counted_in_their_tasks_as_by_joins(spark, monkeypatch):
    rng = random.Random(6)
    terms = [f"t{i}" for i in range(12)]
    docs = spark.createDataFrame([(i % 180, " ".join(rng.choices(terms, k=rng.randint(0, 9))) if i % 7 else None, rng.choice(["x", "y", None])) for i in range(200)], "id int, title string, kind string").repartition(3)
    asked = spark.createDataFrame([(i, " ".join(rng.choices(terms, k=rng.randint(0, 12))), rng.choice(["x", "y", None, "z"])) for i in range(40)], "qid int, text string, cat string")
    of = lambda least: retrieval.title_hits(docs, asked, "id", "title", "qid", "text", least, category=("kind", "cat"))
    told = lambda: [sorted(map(tuple, of(least).collect())) for least in (1, 2, 3)]
    monkeypatch.setattr(keywords, "CELLS", 40)
    here = told()
    # no title meets a candidate query in a row of its own
    assert "Join" not in of(3)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(keywords, "TIMES", 0)
    assert here == told() and here[2]
    assert retrieval.title_hits(docs, asked.limit(0), "id", "title", "qid", "text").count() == 0


def test_topics_are_scored_in_their_tasks_as_by_joins(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(15)]
    said = lambda: rng.choice([None, " ".join(rng.choices(words, k=rng.randint(0, 6)))])
    notices = spark.createDataFrame([(rng.choice("ab") + str(i), said(), said()) for i in range(150)] + [(None, "w1", "w1")], "id string, title string, content string").repartition(4)
    questions = spark.createDataFrame([(q, rng.choices(words, k=rng.randint(0, 5))) for q in range(30)] + [(99, ["none"]), (98, None)], "q int, words array<string>")
    args = (questions, notices, "q", "words", "id", "title", "content")
    monkeypatch.setattr(keywords, "CELLS", 60)
    frame = reports.topic_search(*args)
    # a task hands on the best of each question: words held meet no question in rows
    assert "Generate" not in frame._jdf.queryExecution().executedPlan().toString()
    here = sorted(map(tuple, frame.collect()), key=repr)
    assert here == sorted(map(tuple, reports.topic_best(reports.topic_scores(*args), "q", "id").collect()), key=repr) and here
    monkeypatch.setattr(keywords, "TIMES", 0)
    assert here == sorted(map(tuple, reports.topic_search(*args).collect()), key=repr)
    monkeypatch.undo()
    assert reports.topic_search(questions.limit(0), *args[1:]).count() == 0 == reports.topic_search(questions, notices.limit(0), *args[2:]).count()
