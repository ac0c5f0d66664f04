"""The toxicity query against plain counts and a plain noisy-or over the whole table."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeline.llm import kernels, toxicity
from lodeline.llm.queries import op9_toxicity


def plain_sentences(text):
    """The buckets of the tokens of each sentence that has one."""
    def bucket(token, times=1):
        data = np.frombuffer(token, np.uint8)
        h = kernels.hash_runs(data, np.array([0]), np.array([len(data)]))
        with np.errstate(over="ignore"):
            return int((h * np.uint64(times))[0] >> np.uint64(64 - toxicity.BITS))

    out = []
    for part in re.split(rb"[.!?\n]", (text or "").encode()):
        tokens = [kernels.fold(np.frombuffer(t, np.uint8)).tobytes() for t in re.findall(rb"[0-9A-Za-z\x80-\xff]+", part)]
        if tokens:
            out.append([b for t in tokens for b in [bucket(t)] + [bucket(t[:n], 2 * row + 1) for row, n in enumerate(toxicity.PREFIXES, 1) if len(t) > n]])
    return out


def test_every_score_of_the_table(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    found = {r.doc_id: r for r in op9_toxicity(spark, sf_dir).collect()}
    rows = docs.collect()
    assert len(found) == len(rows)
    for row in rows:
        clean = 1.0
        parts = plain_sentences(row.text)
        for part in parts:
            clean *= 1 - 1 / (1 + math.exp(-max(model.bias + sum(model.weights[b] for b in part), -700)))
        assert found[row.doc_id].score == pytest.approx(1 - clean, abs=1e-9)
        assert found[row.doc_id].n_sentences == len(parts) and found[row.doc_id].predicted == int(1 - clean >= 0.5)


def test_features_are_those_of_plain_counts(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels.where("toxic is not null"), "doc_id").select(F.col("toxic").alias("y"), F.col("text").alias("t"))
    have, total = {}, [0, 0]
    for r in rows.collect():
        parts = plain_sentences(r.t)
        if parts:
            total[r.y] += 1
            for b in set().union(*map(set, parts)):
                have.setdefault(b, [0, 0])[r.y] += 1
    odds = lambda n, k: (n + 0.5) / (total[k] - n + 0.5)
    truth = sorted(b for b, n in have.items() if n[1] >= toxicity.SEEN and odds(n[1], 1) >= toxicity.ENRICHED * odds(n[0], 0))
    assert truth and toxicity.enriched(rows).tolist() == truth
