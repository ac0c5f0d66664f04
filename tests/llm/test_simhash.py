"""SimHash: fingerprints and components against brute force."""

import numpy as np

import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from lodeline.llm import components, golay, simhash
from lodeline.llm.components import settled, smallest_reachable


def plain_fingerprint(text, n=3):
    words = []
    now = ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            words, now = words + [now] if now else words, ""
        else:
            now += c.lower() if "A" <= c <= "Z" else c
    words = words + [now] if now else words
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs):
    ids = list(pairs)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and bin(pairs[i] ^ pairs[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB é\n\t x", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=2))
def test_fingerprints_at_two_bits_share_a_key(fp, flips):
    other = fp
    for f in flips:
        other ^= 1 << f
    a, b = (set(np.concatenate(simhash.keys_of(np.array([x], np.uint64).view(np.int64)), axis=1)[0].tolist()) for x in (fp, other))
    assert a & b


def test_golay_is_perfect():
    words = np.arange(1 << 23, dtype=np.int64)[:: 997]
    near = golay.nearby(words)
    assert {len(set(r)) for r in near.tolist()} <= {1, 6}
    assert np.bincount(golay.decode(np.arange(1 << 16) << 7), minlength=4096).max() <= 2048


def test_links_between_crowded_and_lonely_fingerprints(spark):
    r = np.random.default_rng(1)
    base = [int(x) for x in r.integers(0, 2**62, 30)]
    fps = set(base)
    for b in base[:3]:  # crowds of near fingerprints, more than are joined pair by pair
        for _ in range(60):
            x = b
            for bit in r.choice(64, 3, replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    for b in base[3:12]:
        fps |= {b ^ 1, b ^ (1 << 40), b ^ (1 << 63) ^ (1 << 5), b ^ 7}
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in sorted(fps)]
    found = smallest_reachable(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")))
    mine = {a: b for a, b in found.collect()}
    truth = plain_components({f: f & (2**64 - 1) for f in signed})
    groups = lambda d: sorted(sorted(i for i in d if d[i] == k) for k in set(d.values()))
    assert groups({f: mine.get(f, f) for f in signed}) == groups(truth)


def test_components_of_documents(spark):
    long = " ".join(f"w{i}" for i in range(400))
    texts = [(5, long), (2, long), (9, long + " tail"), (7, None), (8, ""), (3, " \n"), (1, "one two"), (4, "One TWO"), (4, "One TWO"), (6, "x" * 100_000)]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in texts], "doc_id long, text string, fp string, key string")
    found = simhash.components(docs).collect()
    assert len(found) == len(texts)
    truth = {i: plain_fingerprint(t) for i, t in texts}
    parts = plain_components(truth)
    for row in found:
        assert row.fingerprint == f"{truth[row.doc_id]:016x}" and row.component_id == parts[row.doc_id]
    kept = simhash.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 3, 6] and kept[0].fp == "clash"
    assert simhash.components(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (None, "alone here now then")], "doc_id long, text string")
    found = sorted((r.doc_id is None, r.component_id) for r in simhash.components(docs).collect() if r.component_id is not None)
    assert found == [(False, 1), (True, 1)]
    assert simhash.keep_one(docs).where("doc_id = 1").count() == 1


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_components_of_a_long_chain(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.b for r in smallest_reachable(edges).collect()} == {0}
    assert smallest_reachable(edges.limit(0)).count() == 0


def test_whole_table_against_brute_force(spark, sf_dir):
    from lodeline.llm.queries import op1_simhash

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    truth = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    parts = plain_components(truth)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in op1_simhash(spark, sf_dir).collect()} == {i: (f"{truth[i]:016x}", parts[i]) for i in truth}


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_edges_settle_only_as_stars(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    edges = lambda *rows: spark.createDataFrame(rows, "a long, b long")
    assert settled(edges((5, 1), (6, 1), (9, 2)))
    assert not settled(edges((5, 1), (6, 5)))
    assert not settled(edges((5, 1), (5, 2)))
    # edges whose hashes have one sum modulo a million are told apart all the same
    assert {tuple(r) for r in smallest_reachable(edges(*[(i + 1, i) for i in range(0, 90)], *[(1000 - i, 999 - i) for i in range(90)])).collect()} == {(i, 0) for i in range(1, 91)} | {(i, 910) for i in range(911, 1001)}
