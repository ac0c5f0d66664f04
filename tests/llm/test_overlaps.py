"""Overlaps of short items, repeated tokens and random edits against all alignments."""

import numpy as np

from lodeline.llm import decontam


def plain(doc, item):
    """Whether any alignment counts, tried one by one."""
    if not doc or not item:
        return False
    a, b = (np.array([hash(x) for x in t.split()]) for t in (doc, item))
    return any(decontam.counts_as(a, b, d) for d in range(-len(b) + 1, len(a)))


def test_edited_items_of_every_length(spark):
    r = np.random.default_rng(8)
    word = lambda: "".join(r.choice(list("abcdefgh"), 6))
    items = {n: " ".join(word() for _ in range(n)) for n in (1, 2, 4, 7, 8, 9, 12, 13, 14, 15, 20, 40)}
    docs = []
    for n, text in items.items():
        for edits in (0, 1, 1, 2, 3):
            words = text.split()
            for at in r.choice(n, min(edits, n), replace=False):
                words[at] = word()
            docs.append(" ".join([word() for _ in range(int(r.integers(0, 9)))] + words + [word()]))
    docs += [None, "", docs[0], " ".join(word() for _ in range(3000)) + " " + items[40]]
    truth = {(i, n) for i, d in enumerate(docs) for n, t in items.items() if plain(d, t)}
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame([*items.items(), (99, None), (98, " ")], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontam.overlaps(table, bench).collect()} == truth
    assert len({n for _, n in truth}) == len(items)
    bad = {i for i, _ in truth}
    assert {x.doc_id for x in decontam.clean(table.withColumn("node", table.doc_id), bench).collect()} == set(range(len(docs))) - bad


def test_repeated_tokens_stay_linear(spark):
    docs = spark.createDataFrame([(1, "buffalo " * 40_000), (2, "a b " * 3000), (3, "x " + "buffalo " * 30 + "y")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "buffalo " * 2000), (2, "a b " * 40), (3, "x " + "buffalo " * 30 + "y")], "item_id long, text string")
    found = {(x.doc_id, x.item_id): (x.first_token, x.n_tokens, x.n_matched) for x in decontam.overlaps(docs, bench).collect()}
    assert found == {(1, 1): (0, 2000, 2000), (1, 3): (0, 30, 30), (2, 2): (0, 80, 80), (3, 1): (1, 30, 30), (3, 3): (0, 32, 32)}
    for period in (1, 2, 5, 16):
        text = " ".join(f"w{i}" for i in range(period)) + " "
        h, _ = decontam.item_windows((text * 400).encode())
        assert len(h) == 2 * period * len(decontam.MASKS)


def test_periodic_texts_match_like_any_alignment(spark):
    r = np.random.default_rng(9)
    tail = lambda n: " ".join("".join(r.choice(list("abcdefgh"), 5)) for _ in range(n))
    runs = {q: " ".join(f"q{q}w{i}" for i in range(q)) for q in (1, 2, 3, 7, 16, 17)}
    docs, items = [], []
    for q, once in runs.items():
        a, b = tail(9), tail(9)
        docs += [f"{a} {' '.join([once] * (60 // q + 4))} {b}", f"{once} " * 300, f"{b} {' '.join([once] * 3)} {tail(5)}"]
        items += [f"{a} {' '.join([once] * 3)}", f"{' '.join([once] * (40 // q + 3))} {b}", " ".join((f"{once} " * 20).split()[:9]), tail(3) + " " + " ".join((f"{once} " * 20).split()[1:25])]
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    truth = {(i, j) for i, d in enumerate(docs) for j, t in enumerate(items) if plain(d, t)}
    found = decontam.overlaps(table, bench).collect()
    assert {(x.doc_id, x.item_id) for x in found} == truth and len(truth) > 20
    most = {(i, j): max(m[2] for e in range(-len(t.split()) + 1, len(d.split())) if (m := decontam.counts_as(*(np.array([hash(w) for w in y.split()]) for y in (d, t)), e))) for i, d in enumerate(docs) for j, t in enumerate(items) if (i, j) in truth}
    assert {(x.doc_id, x.item_id): x.n_matched for x in found} == most


def test_rows_that_repeat(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, text), (5, text), (None, text)], "item_id long, text string")
    assert decontam.overlaps(docs, bench).count() == 9 and decontam.clean(docs, bench).count() == 0
    assert decontam.overlaps(docs.limit(0), bench).count() == 0 and decontam.clean(docs, bench.limit(0)).count() == 3
