"""Language scores against a plain forward pass over every segmentation."""

import math
import time

import numpy as np
import pytest

from lodeline.llm import langid
from lodeline.llm.queries import op5_language


def plain_words(text):
    import unicodedata

    out, run = [], ""
    for c in (text or "").lower() + " ":
        if unicodedata.category(c).startswith("L"):
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


def plain_log(word, table, pieces, unknown):
    """Log of the sum over all cuts of the marked word, with numbers of any size kept as (mantissa, exponent)."""
    letters = langid.MARK + word
    alpha = [(1.0, 0)] + [(0.0, 0)] * len(letters)

    def add(x, y):
        if not x[0] or not y[0]:
            return x if x[0] else y
        top = max(x[1], y[1])
        m = math.ldexp(x[0], max(x[1] - top, -2000)) + math.ldexp(y[0], max(y[1] - top, -2000))
        f, e = math.frexp(m)
        return f, top + e

    longest = max(map(len, pieces))
    for i in range(len(letters)):
        for j in range(i + 1, min(len(letters), i + longest) + 1):
            p = pieces.get(letters[i:j])
            if p is None and j > i + 1:
                continue
            f, e = math.frexp(alpha[i][0] * (table[p] if p is not None else unknown))
            alpha[j] = add(alpha[j], (f, e + alpha[i][1]))
    return math.log(alpha[-1][0]) + alpha[-1][1] * math.log(2)


def test_letters_are_unicode_letters():
    assert langid.words_of("½ ② Ⅷ ² 12 _ ,") == []
    assert langid.words_of("a½b Ⅷc x²") == ["a", "b", "c", "x"]
    assert langid.words_of("Größe東京ªʰ") == plain_words("Größe東京ªʰ") == ["größe東京ªʰ"]


def test_long_runs_are_summed_whole():
    r = np.random.default_rng(1)
    pieces = [langid.MARK, *"abcd", "ab", "bcd", "dab", langid.MARK + "a", "cdabc"]
    table = r.dirichlet(np.ones(len(pieces) + 1), 2).T
    model = langid.Model(["x", "y"], pieces, table)
    places = {p: i for i, p in enumerate(pieces)}
    words = ["".join(r.choice(list("abcdz"), n)) for n in (1, 5, 40, 41, 300, 3000)]
    truth = [[plain_log(w, table[:, k], places, table[-1, k]) for k in (0, 1)] for w in words]
    assert model.score(words) == pytest.approx(np.array(truth))
    assert model.score_long(words[1]) == pytest.approx(np.array(truth[1]))


def test_runs_in_step_are_those_one_by_one():
    r = np.random.default_rng(2)
    letters = list("abcdefghijklmnopqrstuvwxyzäéñ漢字")
    pieces = sorted({"".join(r.choice(letters[:-1], n)) for n in (1, 1, 2, 2, 3, 5, 9, 16) for _ in range(200)} | {langid.MARK, "wordsofa", "words"})
    model = langid.Model(["x", "y", "z"], pieces, r.dirichlet(np.ones(len(pieces) + 1), 3).T)
    words = ["".join(r.choice(letters, n)) for n in (41, 42, 57, 64, 100, 101, 333, 1000, 4096, 4097)] + ["wordsofaword" * 30]
    one_by_one = np.array([model.score_long(w) for w in words])
    assert np.allclose(model.score_far(words), one_by_one, rtol=1e-9) and np.allclose(model.score(words), one_by_one, rtol=1e-9)
    many = ["".join(r.choice(letters, 200)) for _ in range(500)]
    start = time.process_time()
    model.score_far(many)
    # a hundred thousand letters; one by one they take some two seconds
    assert time.process_time() - start < 1


def test_every_score_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs)
    places = {p: i for i, p in enumerate(model.pieces)}
    known = {}
    found = {r.doc_id: r for r in op5_language(spark, sf_dir).collect()}
    rows = docs.collect()
    assert len(found) == len(rows)
    for row in rows:
        words = plain_words(row.text)
        if not words:
            assert (found[row.doc_id].lang_pred, found[row.doc_id].score) == ("und", 0.0)
            continue
        total = [0.0] * len(model.languages)
        for w in words:
            if w not in known:
                known[w] = [plain_log(w, model.table[:, k], places, model.table[-1, k]) for k in range(len(model.languages))]
            total = [a + b for a, b in zip(total, known[w], strict=True)]
        best = max(range(len(total)), key=lambda k: (total[k], -k))
        assert found[row.doc_id].lang_pred == model.languages[best]
        assert found[row.doc_id].score == pytest.approx(1 / sum(math.exp(max(t - total[best], -700)) for t in total), abs=1e-9)


def test_und_rows_and_empty_tables(spark):
    model = langid.Model(["x", "y"], ["a"], np.array([[0.5, 0.1], [0.1, 0.1]]))
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "½ ② Ⅷ"), (None, "a"), (5, "a"), (5, "a")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.lang_pred) for r in langid.predict(docs, model).collect()) == [(0, "x"), (1, "und"), (2, "und"), (3, "und"), (5, "x"), (5, "x")]
    assert langid.predict(docs.limit(0), model).count() == 0
    assert sorted(r.doc_id or 0 for r in langid.keep_known(docs, model).collect()) == [0, 5, 5]
