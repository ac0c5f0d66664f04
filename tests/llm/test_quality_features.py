"""The classifier's features by code point, and the query's probabilities, against plain versions."""

import math

import numpy as np
import pytest

from lodeline.llm import kernels, quality
from lodeline.llm.queries import op6_quality


def plain_kinds(text):
    """Buckets of words, word pairs and character n-grams of one text."""
    data = (text or "").encode()
    words = [np.frombuffer(w, np.uint8) for w in data.split()]
    one = [kernels.hash_runs(w, np.array([0]), np.array([len(w)])) for w in words]
    two = [kernels.combine([a, b]) for a, b in zip(one, one[1:], strict=False)]
    out = [[int(h[0]) >> (64 - quality.BITS) for h in held] for held in (one, two)]
    for n in quality.GRAMS:
        factors = [int(f) for f in quality._GRAM[n]]
        out.append([(sum(ord(c) * f for c, f in zip((text or "")[i : i + n], factors, strict=True)) % 2**64) >> (64 - quality.BITS) for i in range(len(text or "") - n + 1)])
    return out


@pytest.mark.parametrize("texts", [["é東京 a", "", None, "ab", "abc d", "x\ny"], ["a b"], [""], ["ab"], ["ß" * 5, "ñandú über"]])
def test_features_by_code_point(texts):
    block, _, _, hashes, owner = quality.read([None if t is None else t.encode() for t in texts])
    found = quality.features(block, hashes, owner)
    assert len(found) == quality.KINDS
    for i, t in enumerate(texts):
        for (bucket, text), plain in zip(found, plain_kinds(t), strict=True):
            assert sorted(bucket[text == i].tolist()) == sorted(plain)


def test_every_probability_of_the_table(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    found = {r.doc_id: r for r in op6_quality(spark, sf_dir).collect()}
    for row in docs.collect():
        z = model.bias + sum(float(np.mean(model.weights[k][held])) for k, held in enumerate(plain_kinds(row.text)) if held)
        p = 1 / (1 + math.exp(-min(max(model.slope * z + model.shift, -40), 40)))
        assert found[row.doc_id].probability == pytest.approx(p, abs=1e-9)
        assert found[row.doc_id].kept == (not found[row.doc_id].base_failed and p >= quality.KEEP)
