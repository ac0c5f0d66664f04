"""Components against all pairs of sets, on tables and on groups made to be crowded."""

import random
import re

import numpy as np
import pytest

from lodeline.llm import bottomk, queries


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 4]) for i in range(max(len(words) - 3, 1)))


def plain_groups(rows):
    """(id, set size, smallest id reachable, kept) by comparing all pairs of distinct sets."""
    held = [plain_set(t) for _, t in rows]
    kinds = list({s for s in held if s})
    number = {}
    arrays = [np.sort(np.array([number.setdefault(g, len(number)) for g in s])) for s in kinds]
    up = list(range(len(kinds)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, a in enumerate(arrays):
        for j in range(i):
            b = arrays[j]
            if 5 * len(a) >= 4 * len(b) and 5 * len(b) >= 4 * len(a) and root(i) != root(j):
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    up[root(i)] = root(j)
    at = {s: i for i, s in enumerate(kinds)}
    least = {}
    for (i, _), s in zip(rows, held, strict=True):
        if s and i is not None:
            least[root(at[s])] = min(i, least.get(root(at[s]), i))
    out = [(i, len(s), least.get(root(at[s])) if s else i) for (i, _), s in zip(rows, held, strict=True)]
    return sorted(((*r, r[0] == r[2]) for r in out), key=repr)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def crowded(rng, families=6, size=60):
    """Families of texts that differ more and more from an original, with a passage that all of them share, short texts and copies."""
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for f in range(families):
        first = [f"f{f}w{rng.randrange(400)}" for _ in range(rng.choice([5, 14, 60, 61, 120, 300]))]
        for k in range(size):
            words = list(first)
            for _ in range(rng.randint(0, max(1, len(words) // 18))):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            if k % 3 == 0 and f % 2:
                words[3:3] = passage
            if k % 7 == 0:
                words = words[: rng.randint(1, len(words))]
            rows.append(" ".join(words))
    rows += [r.upper() for r in rng.sample(rows, 20)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_crowded_groups(spark, seed):
    rows = crowded(random.Random(seed))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = plain_groups(rows)
    assert len({r[2] for r in expected}) < len(rows) - 50
    assert found(bottomk.groups(docs)) == expected


def test_lists_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(bottomk, "ROWS", 7)
    monkeypatch.setattr(bottomk, "WEIGHT", 500)
    rows = crowded(random.Random(3), 3, 90)
    assert found(bottomk.groups(spark.createDataFrame(rows, "doc_id long, text string"))) == plain_groups(rows)


def test_rows_of_every_kind(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    texts = [(5, "A b c d e"), (3, "a  B\tc\nd e"), (7, None), (8, ""), (9, " \n"), (1, "x y"), (2, "X y"), (2, "X y"), (None, "x Y"), (None, "lone words here now"), (11, "x y z"), (20, long), (21, long + " end"), (22, long[:-6] + "É"), (23, "x y")]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in texts], "doc_id long, text string, set string, n int")
    rows = found(bottomk.groups(docs))
    assert rows == sorted(((*r[:3], r[0] == r[2]) for r in plain_groups(texts)), key=repr)
    by_id = {r[0]: r for r in rows}
    assert by_id[5] == (5, 2, 3, False) and by_id[7] == (7, 0, 7, True) and by_id[2][2] == 1 and by_id[21] == (21, 2998, 20, False) and by_id[11] == (11, 1, 11, True)
    assert bottomk.groups(docs.limit(0)).count() == 0
    words = docs.select(docs.doc_id.cast("string").alias("doc_id"), "text")
    assert {r.doc_id: r.component_id for r in bottomk.groups(words).collect() if r.doc_id in ("5", "21")} == {"5": "3", "21": "20"}


def test_query_against_all_pairs(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.op11_bottom_k(spark, sf_dir)) == plain_groups(rows)


def test_overlaps_and_sketches(monkeypatch):
    rng = np.random.default_rng(4)
    lists = [np.unique(rng.integers(0, 90, rng.integers(0, 60))) for _ in range(40)]
    expected = [[len(np.intersect1d(a, b)) for b in lists] for a in lists]
    for width in (4096, 7):
        monkeypatch.setattr(bottomk, "COLUMNS", width)
        got = bottomk.overlaps(lists)
        assert all(got[i, j] == expected[i][j] for i in range(40) for j in range(40) if i != j)
    # pairs just at the least similarity are never ruled out
    for n in (3, 20, 51, 52, 64, 65, 80, 200, 5000):
        for _ in range(20):
            values = np.unique(rng.integers(-(2**63), 2**63, 2 * n + 50))
            rng.shuffle(values)
            own = n - -(-8 * n // 9)
            a, b = np.sort(values[:n]), np.sort(values[own : own + n])
            both = n - own
            if both * 5 >= (2 * n - both) * 4:
                assert bottomk.possible(a[:64], b[:64])
