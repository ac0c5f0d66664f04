"""Runs against all periods at all places, and the query against a plain recomputation."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeline.llm import periodic, queries


def plain_runs(s, times=4, least=6):
    """Every maximal stretch of every period, those with a smaller period left out."""
    out, n = [], len(s)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, times * q) and not any(all(s[k] == s[k + r] for k in range(i, i + length - r)) for r in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequence(rng):
    letters = rng.choice([1, 2, 2, 3, 5])
    s = [rng.randrange(letters) for _ in range(rng.randint(0, 70))]
    for _ in range(rng.randint(0, 3)):
        once = [rng.randrange(letters) for _ in range(rng.randint(1, 7))]
        at = rng.randint(0, len(s))
        s[at:at] = (once * 20)[: rng.randint(4, 40)]
    return s


def test_runs_are_those_of_all_periods():
    rng = random.Random(5)
    for _ in range(1500):
        s = sequence(rng)
        assert periodic.runs_of(np.array(s, np.int64)) == plain_runs(s)
        words = b"\t ".join(b"w%d" % c for c in s)
        held, found = periodic.runs_of_texts([None, words, b"  \n", words])
        assert found == [[], plain_runs(s), [], plain_runs(s)] and [len(w) for w in held] == [0, len(s), 0, len(s)]


def test_squares_need_two_periods():
    rng = random.Random(6)
    for _ in range(300):
        s = sequence(rng)
        assert periodic.runs_of(np.array(s, np.int64), 2, 2) == plain_runs(s, 2, 2)


def test_long_sequences_in_bounded_time():
    for s, expected in (([7] * 60_000, (0, 60_000, 1)), (list(range(300)) * 200, (0, 60_000, 300))):
        assert periodic.runs_of(np.array(s)) == [expected]
    assert periodic.stretches(np.arange(50_000, dtype=np.uint64), np.zeros(50_000, np.int64)) == []


def test_rows_of_every_kind(spark):
    loop = "a b " * 5 + "x"
    docs = spark.createDataFrame([(1, loop, 9), (1, loop, 8), (2, None, 7), (3, "", 6), (None, "c " * 6 + "d d d d d", 5), (4, "é\x0bé é\té é é", 4)], "doc_id long, text string, runs int")
    rows = sorted((tuple(r) for r in periodic.find(docs).collect()), key=repr)
    expected = [(1, 11, [(0, 10, 2)], "a b x"), (1, 11, [(0, 10, 2)], "a b x"), (2, 0, [], ""), (3, 0, [], ""), (None, 11, [(0, 6, 1)], "c d d d d d"), (4, 6, [(0, 6, 1)], "é")]
    assert [(a, b, [tuple(r) for r in c], d) for a, b, c, d in rows] == sorted(expected, key=repr)
    assert periodic.find(docs.limit(0)).count() == 0


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs_fast(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    short = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    milli = best[1] * 1000 // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(short).hexdigest())


def plain_runs_fast(words):
    """plain_runs, with the comparison at each period by numpy."""
    number = {}
    s = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    out = []
    for q in range(1, len(s) // 4 + 1):
        same = np.concatenate(([False], s[q:] == s[:-q], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1])
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            length = j - i + q
            if length >= max(6, 4 * q) and not any((s[i : i + length - r] == s[i + r : i + length]).all() for r in range(1, q)):
                out.append((i, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("name", ["op13_periodic_runs"])
def test_query_against_all_periods(spark, sf_dir, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = sorted(tuple(r) for r in queries.QUERIES[name](spark, sf_dir).collect())
    assert found == sorted(plain_row(r.doc_id, r.text) for r in docs)
    assert sum(r[1] > 0 for r in found) > len(found) / 20


def test_repeated_tails(spark):
    rows = spark.createDataFrame([("a b c d e", 20), ("a b c d e", 21), (None, 20), (" \n", 20), ("a b", None)], "t string, h long")
    # g = 2, a = 2 % 5, p = 1 + 3 // 5
    assert [r[0] for r in rows.select(periodic.repeated(F.col("t"), F.col("h"))).collect()] == ["a b c c c", "a b c d e", None, " \n", "a b"]
