"""Near-copies against brute force over all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from lodeline.llm import alike, simhash


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def plain_groups(texts):
    sets = {i: plain_set(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        for j in sorted(sets):
            both = len(sets[i] & sets[j])
            if i < j and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def crowd(seed, templates=60):
    """Texts that share a long passage, each with near copies: many families in the keys of one passage."""
    r = np.random.default_rng(seed)
    word = lambda: "".join(r.choice(list("abcdefghij"), 5))
    passage = [word() for _ in range(80)]
    texts = []
    for _ in range(templates):
        own = [word() for _ in range(30)]
        for _ in range(3):
            copy = passage + own
            for at in r.choice(len(copy), int(r.integers(0, 4)), replace=False):
                copy[at] = word()
            texts.append(" ".join(copy))
    r.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize(("block", "leaders", "common"), [(1 << 21, 32, 4), (12_000, 1, 4), (12_000, 32, 1 << 30), (1 << 21, 0, 1 << 30)])
def test_all_pairs_of_crowded_keys_are_met(spark, monkeypatch, block, leaders, common):
    """Whatever the early steps leave apart, and in however many blocks a key is dealt, the last step meets all pairs."""
    monkeypatch.setattr(alike, "BLOCK", block)
    monkeypatch.setattr(alike, "LEADERS", leaders)
    monkeypatch.setattr(alike, "COMMON", common)
    texts = crowd(3)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    truth = plain_groups(texts)
    assert 20 < len(set(truth.values())) < len(texts)
    assert {r.doc_id: r.component_id for r in alike.groups(docs, simhash.emit_keys).collect()} == truth


def test_bounds_lose_no_alike_pair():
    r = np.random.default_rng(11)
    seen = 0
    for n in (1, 2, 7, 60, 400, 3000, 30_000):
        for _ in range(40):
            a = r.integers(-(2**63), 2**63 - 1, n)
            b = np.concatenate((a[: n - int(n * r.uniform(0, 0.25))], r.integers(-(2**63), 2**63 - 1, int(n * r.uniform(0, 0.25)))))
            a, b = np.unique(a), np.unique(b)
            truth = 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
            assert alike.alike(a, b) == truth
            seen += truth
            if not truth or not len(b):
                continue
            maps = alike.Maps([alike.parity(a).tobytes(), alike.parity(b).tobytes()])
            assert alike.near_size(len(a), len(b)) and alike.few_odd(len(a), len(b), maps.differ(np.array([0]), np.array([1]))[0])
            own, other = (alike.keys(x, (np.zeros(0, np.int64), np.zeros(0, np.int64))).tolist() for x in (a, b))
            first = next(k for k in own if k in set(other))
            assert alike.possible(len(a), own.index(first), len(b), other.index(first))
    assert seen > 50


def test_a_large_group_returns_no_more_rows_than_it_has(spark):
    """600 near-copies of one text and 40 strangers that share half of it."""
    r = np.random.default_rng(2)
    base = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(640):
        copy = list(base) if i < 600 else base[:100] + [f"s{i}x{k}" for k in range(100)]
        copy[int(r.integers(0, len(copy)))] = f"e{i}"
        texts[i] = " ".join(copy)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {x.doc_id: x.component_id for x in alike.groups(docs, simhash.emit_keys).collect()}
    assert found == {i: 0 if i < 600 else i for i in texts}
    sets = [alike.shingles(texts[i].encode()) for i in range(600)]
    rows = pa.RecordBatch.from_arrays([pa.array([7] * 600), pa.array([True] * 600), pa.array(list(range(600))), pa.array([len(x) for x in sets], pa.int32()), pa.array([alike.parity(x).tobytes() for x in sets])], ["part", "follows", "node", "n", "map"])
    for size in (1, 7, 600):
        batches = [rows.slice(i, size) for i in range(0, 600, size)]
        assert sum(b.num_rows for b in alike._sketched(iter(batches))) == 599


@pytest.mark.parametrize("small", [1, 3, 32])
def test_pairs_of_parts(monkeypatch, small):
    """Small and large parts, whole or cut into batches, give all pairs that a plain loop gives."""
    monkeypatch.setattr(alike, "SMALL", small)
    r = np.random.default_rng(6)
    part = np.sort(r.integers(0, 40, 200))
    sets = [np.unique(r.choice(60, int(r.integers(20, 60)), replace=False).astype(np.int64) << 20) for _ in part]
    side, comp, place = r.integers(0, 2, 200) * (part % 2), r.integers(0, 6, 200), r.integers(0, 5, 200)
    n = np.array([len(x) for x in sets])
    rows = pa.RecordBatch.from_arrays([pa.array(part), pa.array(side), pa.array(comp), pa.array(np.arange(200)), pa.array(n), pa.array(place), pa.array([alike.parity(x).tobytes() for x in sets]), pa.array(part)], ["part", *alike.ROW])
    truth = set()
    for i in range(200):
        for j in range(i):
            own = part == part[i]
            if part[i] == part[j] and comp[i] != comp[j] and alike.possible(n[i], place[i], n[j], place[j]) and (side[i] != side[j] or len(set(side[own])) == 1):
                if 9 * np.bitwise_count(alike.parity(sets[i]) ^ alike.parity(sets[j])).sum() <= n[i] + n[j]:
                    truth.add((i, j))
    for size in (1, 13, 200):
        found = set()
        for batch in alike._parts((rows.slice(i, size) for i in range(0, 200, size)), 5):
            node = batch.column(3).to_pylist()
            for i, j in alike._pairs(batch.column(0).to_numpy(), batch.columns[1:]):
                found |= {(node[a], node[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
        assert found == truth and truth


def test_five_words_at_the_threshold(spark):
    words = [f"w{i}" for i in range(94)]  # 90 shingles; one word in the middle changes five, one at an end fewer
    edited = lambda *at: " ".join("x" + w if i in at else w for i, w in enumerate(words))
    texts = {1: edited(), 2: edited(20, 40), 3: edited(10, 30, 50, 70, 80), 4: " ".join(words[:76]), 5: " ".join(words[18:40]), 6: None, 7: " ", 8: "a B", 9: "A b"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    truth = plain_groups(texts) | {6: 6, 7: 6}
    assert truth[2] == 1 and truth[3] == 3 and truth[4] == 1 and truth[5] == 5
    assert {r.doc_id: r.component_id for r in alike.groups(docs, simhash.emit_keys).collect()} == truth
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 3, 5, 6, 8]
    assert alike.groups(docs.limit(0), simhash.emit_keys).count() == 0


def test_groups_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    truth = plain_groups(texts)
    blank = [i for i, t in texts.items() if not plain_set(t)]
    assert {r.doc_id: r.component_id for r in alike.groups(docs, simhash.emit_keys).collect()} == truth | {i: min(blank) for i in blank}
