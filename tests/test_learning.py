"""Grams and weights against plain ones, the fit against Newton's method, ordinals against a sort."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeline.operators import classify, dedup, ordinals


def plain_grams(text):
    out = []
    for word in text.lower().split():
        padded = f" {word} "
        out += [padded[i : i + n] for n in range(2, 6) for i in range(len(padded) - n + 1)]
    return out


TEXTS = ["학식 메뉴 뭐야", "셔틀 버스 시간", "a  Bb\tccc", "", None, "졸업 요건 알려줘 졸업", "x", "긴단어가여기에있습니다 끝"]


def plain_weights(texts):
    counts = [Counter(plain_grams(t or "")) for t in texts]
    df = Counter(g for c in counts for g in c)
    idf = {g: math.log((1 + len(texts)) / (1 + n)) + 1 for g, n in df.items()}
    out = []
    for c in counts:
        raw = {g: (1 + math.log(n)) * idf[g] for g, n in c.items()}
        size = math.sqrt(sum(v * v for v in raw.values()))
        out.append({g: v / size for g, v in raw.items()})
    return out


def test_weights_of_bounded_grams(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    got = docs.select("id", classify.bounded_grams(F.col("t")).alias("g")).collect()
    assert all(Counter(r.g or []) == Counter(plain_grams(TEXTS[r.id] or "")) for r in got)
    counts = classify.bounded_counts(docs, "id", "t")
    found = classify.gram_weights(counts, classify.inverse_frequencies(counts, len(TEXTS)), "id").collect()
    expected = plain_weights(TEXTS)
    assert len(found) == sum(map(len, expected))
    assert all(r.weight == pytest.approx(expected[r.id][r.gram], abs=1e-12) for r in found)


def newton(x, y, weight, c):
    """Coefficients and intercept of the penalised regression, to convergence."""
    z, n = np.hstack([x, np.ones((len(x), 1))]), x.shape[1]
    beta, ridge = np.zeros(n + 1), np.append(np.full(n, 1 / c), 0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        gradient = z.T @ (weight * (p - y)) + ridge * beta
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        beta -= np.linalg.solve(hessian, gradient)
    return beta[:-1], beta[-1]


def questions(rng, n):
    words = {0.0: ["학식", "메뉴", "식당", "점심", "저녁"], 1.0: ["셔틀", "버스", "정류장", "시간표", "노선"]}
    out = []
    for i in range(n):
        label = float(rng.random() < 0.25)
        out.append((i, " ".join([*rng.choices(words[label], k=2), *rng.choices(words[0.0] + words[1.0], k=1), rng.choice(["뭐야", "알려줘"])]), label))
    return out


def test_fit_is_the_plain_optimum(spark):
    rows = questions(random.Random(3), 60)
    docs = spark.createDataFrame(rows, "id int, t string, label double")
    model = classify.text_pipeline(docs, "label", "id", "t")
    weights = plain_weights([t for _, t, _ in rows])
    grams = sorted({g for w in weights for g in w})
    held = {r.gram: r.i for r in model.vocabulary.collect()}
    assert sorted(held) == grams and sorted(held.values()) == list(range(len(grams)))
    x = np.zeros((len(rows), len(grams)))
    for k, w in enumerate(weights):
        for g, v in w.items():
            x[k, held[g]] = v
    y = np.array([label for *_, label in rows])
    size = np.where(y == 1, (y == 1).sum(), (y == 0).sum())
    beta, intercept = newton(x, y, len(y) / (2 * size), 4.0)
    assert np.abs(model.regression.coefficients.toArray() - beta).max() < 2e-3 and abs(model.regression.intercept - intercept) < 2e-3
    # questions it hasn't seen, against the same model by hand; unknown grams are left out
    fresh = questions(random.Random(4), 40) + [(99, "zzz", 0.0), (98, None, 1.0)]
    said = {r.id: r for r in classify.text_predict(model, spark.createDataFrame(fresh, "id int, t string, label double"), "id", "t").collect()}
    assert len(said) == len(fresh) and sum(said[i].prediction == label for i, _, label in fresh[:40]) >= 36
    assert said[99].probability[1] == pytest.approx(1 / (1 + math.exp(-intercept)), abs=1e-3) == said[98].probability[1]


def test_a_bounded_vocabulary_keeps_the_commonest(spark):
    docs = spark.createDataFrame(questions(random.Random(5), 30), "id int, t string, label double")
    model = classify.text_pipeline(docs, "label", "id", "t", rounds=5, vocabulary=20)
    df = Counter(g for _, t, _ in questions(random.Random(5), 30) for g in set(plain_grams(t)))
    assert {r.gram for r in model.vocabulary.collect()} == {g for g, _ in sorted(df.items(), key=lambda x: (-x[1], x[0]))[:20]}


def test_classes_grow_to_exactly_the_largest(spark):
    rows = [(i, "a b c", "big") for i in range(37)] + [(100 + i, "d e", "mid") for i in range(11)] + [(200, "f", "one"), (201, "g h", None)]
    docs = spark.createDataFrame(rows, "id int, t string, label string")
    grown = classify.augment(docs, "label", "id", "t").collect()
    assert Counter(r.label for r in grown) == {"big": 37, "mid": 37, "one": 37, None: 37}
    assert Counter(r.id for r in grown if r.label == "mid" and r.copy == 0) == {100 + i: 1 for i in range(11)}
    again = classify.augment(docs.repartition(5), "label", "id", "t").collect()
    assert sorted(map(str, grown)) == sorted(map(str, again))


def test_ordinals_of_a_crowded_key(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), i) for i in rng.sample(range(5000), 2000)]
    df = spark.createDataFrame(rows, "k string, o int").repartition(7)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [tuple(r) for r in ordinals.numbered(df, ["k", "o"], "n", 100).orderBy("n").collect()] == [(*r, 100 + i) for i, r in enumerate(order)]
    seen, expected = Counter(), {}
    for r in order:
        expected[r] = seen[r[0]]
        seen[r[0]] += 1
    assert {(r.k, r.o): r.n for r in ordinals.within_key(df, "k", ["o"]).collect()} == expected
    again = {(r.k, r.o): r.again for r in dedup.repeats(df, "k", "o", "again").collect()}
    assert again == {r: n > 0 for r, n in expected.items()}
    plan = dedup.repeats(df, "k", "o")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    ids = ordinals.sequential_ids(df.limit(0), ["o"], 5, "x")
    assert ids.count() == 0 and ids.columns == ["k", "o", "id"]


def test_grams_of_blocks_of_texts(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcé가😀", k=n)) for n in (0, 1, 2, 3, 4, 50)]
    wide = ["".join(map(chr, range(0x4E00, 0x4E00 + 20_000))) + "".join(map(chr, range(0xAC00, 0xAC00 + 11_000))) + "".join(map(chr, range(0x20000, 0x20000 + 10_000)))]
    for held in (texts, wide):
        found = {}
        for grams, counts in classify.gram_totals(held):
            assert len(set(grams)) == len(grams)
            found |= dict(zip(grams, counts.tolist(), strict=True))
        assert found == Counter(t[i : i + n] for t in held for n in (2, 3, 4) for i in range(len(t) - n + 1))
    rows = spark.createDataFrame([("x", 1, "Ab ab"), (None, 2, "ab"), ("x", 3, None), ("x", 4, "  ")], "label string, id int, t string")
    found = {(r.label, r.gram): r.weight for r in classify.profiles(rows, "label", "id", "t").collect()}
    assert found == {("x", "ab"): 6.0, ("x", "ba"): 1.0, ("x", "aba"): 1.0, ("x", "bab"): 1.0, ("x", "abab"): 1.0, (None, "ab"): 3.0}


def test_weights_in_one_pass_and_by_joins_agree(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "ab  AB cde"), (2, "cde 가나"), (3, ""), (4, None), (5, "😀x x")], "id int, t string")
    told = lambda: {(r.id, r.gram): round(r.weight, 9) for r in classify.text_weights(rows, "id", "t", idf).collect()}
    idf = classify.inverse_frequencies(classify.document_frequencies(rows, "id", "t"), 5)
    plan = classify.text_weights(rows, "id", "t", idf)._jdf.queryExecution().toString()
    held = told()
    monkeypatch.setattr(classify, "HELD", 0)
    assert held and held == told() and "Exchange" not in plan
    counts = rows.select("id", F.explode(classify.bounded_grams(F.col("t"))).alias("gram")).groupBy("id", "gram").count()
    assert sorted(map(tuple, classify.bounded_counts(rows, "id", "t").collect())) == sorted(map(tuple, counts.collect()))


WORDY = ["ab  AB cde", "cde 가나 ab", "", "x", "😀x x 😀", "a\0b \0", "nicht " * 30 + "q" * 200, " ".join(f"w{i}" for i in range(300))]


def wide_texts():
    """More letters than one number a gram and text has room for, and than one number a gram has."""
    return [[chr(0x4E00 + (i * k + i) % m) * 2 + chr(0x4E00 + i) + (" " if i % 3 else "") for i in range(m)] for m in (3000, 6000) for k in (1, 7)]


def test_frequencies_of_blocks_of_texts(monkeypatch):
    normal = [" ".join(t.lower().split()) for t in WORDY]
    wide = ["".join(t) for t in wide_texts()]
    for texts in (normal, wide[:2] * 3, wide[2:], ["", ""]):
        found = {}
        for grams, counts in classify.text_frequencies(texts):
            assert not found.keys() & set(grams)
            found |= dict(zip(grams, counts.tolist(), strict=True))
        assert found == Counter(g for t in texts for g in set(plain_grams(t)))
    monkeypatch.setattr(classify, "SORTED", 10)
    blocks = list(classify._blocks(iter(normal)))
    assert len(blocks) > 2 and sum(blocks, []) == normal and all(blocks)


@pytest.mark.parametrize("places", [1 << 22, 1 << 12, 0])
def test_grams_of_a_vocabulary_are_looked_up_at_once(monkeypatch, places):
    monkeypatch.setattr(classify, "PLACES", places)
    texts = [" ".join(t.lower().split()) for t in WORDY] + ["".join(t) for t in wide_texts()]
    every = sorted({g for t in texts for g in plain_grams(t)})
    for chosen in (every, every[::7], [" a", "ab ", "nicht", "cht "], []):
        numbers = {g: i for i, g in enumerate(chosen)}
        ends, grams, n = classify.GramTable.of(numbers).counter(max(len(numbers), 1))([*texts, "zzz ßß"])
        for k, text in enumerate([*texts, "zzz ßß"]):
            expected = Counter(numbers[g] for g in plain_grams(text) if g in numbers)
            assert list(zip(grams[ends[k] : ends[k + 1]].tolist(), n[ends[k] : ends[k + 1]].tolist())) == sorted(expected.items())


def test_vectors_are_made_in_columns(spark):
    docs = spark.createDataFrame(list(enumerate([*WORDY, None])), "id int, t string")
    idf = classify.inverse_frequencies(classify.document_frequencies(docs, "id", "t"), len(WORDY) + 1)
    known = {r.gram: (i, r.idf) for i, r in enumerate(idf.orderBy("gram").collect())}
    vocabulary = spark.createDataFrame([(g, i, w) for g, (i, w) in known.items()], "gram string, i int, idf double")
    made = classify._vectors(docs, "t", vocabulary, len(known))
    # a Python object for every gram took nine tenths of the time
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "BatchEvalPython" not in plan
    for r, expected in zip(made.orderBy("id").collect(), plain_weights([*WORDY, None]), strict=True):
        assert r.x.size == len(known) and r.x.indices.tolist() == sorted(known[g][0] for g in expected)
        assert dict(zip(r.x.indices.tolist(), r.x.values.tolist())) == pytest.approx({known[g][0]: w for g, w in expected.items()}, abs=1e-12)
