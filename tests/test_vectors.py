"""Nearest vectors against all pairs, and the recall of the index."""

import numpy as np
import pytest

from lodeline import catalog
from lodeline.operators import vectors

SHAPE = "id long, v array<float>, kind string"


def plain(rows, queries, most):
    """Exact hits by comparing every query with every vector of its kind."""
    out = []
    for qid, q, kind in queries:
        if q is None or kind is None or not np.isfinite(q).all() or not np.any(q):
            continue
        scored = []
        for i, v, other in rows:
            if v is not None and other == kind and len(v) == len(q) and np.isfinite(v).all() and np.any(v):
                a, b = np.array(q, np.float64), np.array(v, np.float64)
                scored.append((-round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), 6), i))
        out += [(qid, kind, i, -s, r) for r, (s, i) in enumerate(sorted(scored)[:most])]
    return sorted(out)


def clustered(rng, n, d=16, centres=12):
    middle = rng.normal(size=(centres, d)) * 4
    x = middle[rng.integers(0, centres, n)] + rng.normal(size=(n, d))
    return [(i, [float(c) for c in v.astype(np.float32)], "ab"[i % 3 % 2]) for i, v in enumerate(x)]


def close(found, expected):
    found = sorted(map(tuple, found))
    assert [f[:3] + f[4:] for f in found] == [e[:3] + e[4:] for e in expected]
    assert np.allclose([f[3] for f in found], [e[3] for e in expected], atol=1e-6)


@pytest.mark.parametrize("rows_met", [2048, 37])
def test_exact_hits_with_ties_and_blocks(spark, monkeypatch, rows_met):
    monkeypatch.setattr(vectors, "ROWS", rows_met)
    rng = np.random.default_rng(1)
    rows = clustered(rng, 300)
    # a third of the rows are one vector: equals come in the order of ids
    rows += [(1000 + i, rows[0][1], "a") for i in range(150)]
    rows += [(2000, None, "a"), (2001, [0.0] * 16, "a"), (2002, [1.0] * 3, "a"), (2003, [float("nan")] * 16, "a"), (2004, rows[1][1], None)]
    docs = spark.createDataFrame(rows, SHAPE).repartition(4)
    queries = [r for r in rows if r[0] % 20 == 0]
    close(vectors.nearest(docs, docs.where("id % 20 = 0"), "id", "v", "kind", "id", "v", 7).collect(), plain(rows, queries, 7))


def test_index_is_exact_with_all_cells_and_prunes_with_few(spark, tmp_path):
    rows = clustered(np.random.default_rng(2), 1200)
    docs = spark.createDataFrame(rows, SHAPE)
    queries = docs.where("id % 20 = 0")
    index = vectors.build(docs, "id", "v", "kind", str(tmp_path / "index"))
    assert len(index.centroids) == 34 and index.rows.count() == len(rows)
    exact = plain(rows, [r for r in rows if r[0] % 20 == 0], 15)
    close(vectors.search(index, queries, "kind", "id", "v", 15, 34).collect(), exact)
    probes = vectors.probes_for(index, queries, "kind", "id", "v")
    assert 1 <= probes <= 12
    found = {(r.query_id, r.id) for r in vectors.search(vectors.open_index(spark, str(tmp_path / "index")), queries, "kind", "id", "v", 15, probes).collect()}
    assert len(found & {(q, i) for q, _, i, *_ in exact}) >= 0.9 * len(exact)


def test_rows_of_every_kind(spark, tmp_path):
    rows = [(1, None, "a"), (2, [0.0, 0.0], "a"), (3, [1.0, 2.0], "a"), (4, [2.0, 4.0], "a"), (5, [1.0], "a"), (6, [1.0, float("inf")], "a"), (7, [-1.0, 0.0], None)]
    docs = spark.createDataFrame(rows, SHAPE)
    index = vectors.build(docs, "id", "v", "kind", str(tmp_path / "few"))
    assert index.rows.count() == 7 and len(index.centroids) == 2
    assert sorted((r.query_id, r.id) for r in vectors.search(index, docs, "kind", "id", "v").collect()) == [(3, 3), (3, 4), (4, 3), (4, 4)]
    empty = vectors.build(docs.limit(0), "id", "v", "kind", str(tmp_path / "none"))
    assert vectors.search(empty, docs, "kind", "id", "v").count() == 0
    assert vectors.nearest(docs.limit(0), docs, "id", "v", "kind", "id", "v").count() == 0
    words = docs.selectExpr("concat('n', id) AS id", "v")
    assert sorted((r.query_id, r.id) for r in vectors.nearest(words, words, "id", "v", None, "id", "v", 1).where("query_id in ('n3', 'n4')").collect()) == [("n3", "n3"), ("n4", "n3")]


def test_recall_of_the_query(spark, sf_dir):
    exact = {(r.query_id, r.id) for r in catalog.QUERIES["dense_knn_top15"](spark, sf_dir).collect()}
    found = catalog.QUERIES["indexed_knn_top15"](spark, sf_dir).collect()
    assert len({(r.query_id, r.id) for r in found} & exact) >= 0.9 * len(exact)
