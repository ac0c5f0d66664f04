"""Surrogates, resampling, mixing and the pipeline against plain versions."""

import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodeline.llm import importance, kernels, mixing, queries, secret_scan, surrogates

# surrogates

TEXT = "Mail und.34@mail7.example.com and UND.34@MAIL7.EXAMPLE.COM from 97.51.17.173, card 9807915762804490 or 9807 9157 6280 4490, tel +1 (017) 555-7713 or +10175557713. Mrs Anna Miller met Mr Bob Stone; Mrs Anna Miller left. 123-45-6789"


def test_forms_and_coreference(spark):
    docs = spark.createDataFrame([(1, TEXT, "k"), (2, "г-жа Мария Иванова ok", "k"), (3, None, "k"), (4, "", "k"), (5, "version 1.2 of 2024, nothing else", "k")], "doc_id long, text string, n_replaced string")
    rows = {r.doc_id: r for r in surrogates.pseudonymise(docs, "key").collect()}
    out = rows[1].text
    mails = re.findall(r"\S+@\S+", out)
    assert mails[0].upper() == mails[1] and "und" not in mails[0] and re.fullmatch(r"[a-z]{3}\.\d\d@mail\d+\.example\.(com|net|org)", mails[0])
    cards = re.findall(r"\d{16}|\d{4} \d{4} \d{4} \d{4}", out)
    assert cards[0] == cards[1].replace(" ", "") and cards[0][0] == "9"
    phones = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}|\+1\d{10}", out)
    assert re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1])
    women, men = re.findall(r"Mrs (\S+ \S+?)(?= met| left)", out), re.findall(r"Mr (\S+) \S+;", out)
    assert women[0] == women[1] and women[0].split()[0] in surrogates.NAMES["f", "latin"].split() and men[0] in surrogates.NAMES["m", "latin"].split()
    assert not any(x in out for x in ("97.51.17.173", "9807", "555-7713", "Miller", "Stone", "123-45-6789"))
    assert len(out.split()) == len(TEXT.split()) and rows[1].n_replaced == 11
    assert re.fullmatch(r"г-жа [А-я]+ [А-я]+ ok", rows[2].text) and "Мария" not in rows[2].text
    assert (rows[3].text, rows[3].n_replaced, rows[4].text) == (None, 0, "") and rows[5].text == "version 1.2 of 2024, nothing else"
    assert surrogates.pseudonymise(docs.limit(0), "key").count() == 0


def luhn(digits):
    return sum(sum(divmod(int(c) * (2 if i % 2 == 0 else 1), 10)) for i, c in enumerate(digits)) % 10


def test_check_digits_keep_their_validity(spark):
    cards = [("4539148803436467",), ("4539148803436468",), ("1234567812345670",)]
    rows = spark.createDataFrame(cards, "c string").select("c", surrogates.surrogate(F.lit("card"), F.col("c"), F.lit(0), "key").alias("s")).collect()
    assert all((luhn(r.c) == 0) == (luhn(r.s) == 0) and r.s != r.c for r in rows)


def test_collisions_are_resolved(spark):
    # persons have few names, so first surrogates collide; a thousand women have to stay apart
    names = [(f"Mrs {a}{b} {c}{d}",) for a in "ABCDEFGHIJ" for b in "abcde" for c in "KLMNO" for d in "fghi"]
    docs = spark.createDataFrame(names, "text string").withColumn("doc_id", F.monotonically_increasing_id())
    out = surrogates.pseudonymise(docs, "key").collect()
    assert len({r.text for r in out}) == len(names)
    assert not {r.text for r in out} & {n for (n,) in names}
    again = surrogates.pseudonymise(docs, "key").collect()
    assert sorted(r.text for r in again) == sorted(r.text for r in out)


def test_no_planted_value_survives(spark):
    path = "/root/testdata/sf0.01"
    found = re.compile(r"[\w.%+-]+@[\w-]+\.[\w.]*[a-z]|(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w)|\+1 \(\d{3}\) \d{3}-\d{4}|(?<!\w)\d{16}(?!\w)")
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    for r in queries.op3_pii_surrogates(spark, path).collect():
        held = found.findall(before[r.doc_id])
        assert not [h for h in held if h in r.text] and r.n_replaced == len(held)
        if not held:
            assert r.text == before[r.doc_id]


# resampling


def test_threshold_is_exact(spark):
    r = np.random.default_rng(3)
    keys = np.concatenate((r.normal(0, 100, 500), np.full(40, 3.0), [1e9, -1e9]))
    frame = spark.createDataFrame([(int(i), float(k)) for i, k in enumerate(keys)], "doc_id long, key double")
    for k in (1, 7, 250, 280, 300, 541, 542, 900, 0):
        kept = importance.resample(frame, k).where("kept").collect()
        assert sorted(x.key for x in kept) == sorted(keys.tolist())[max(len(keys) - k, 0) :] and len({x.doc_id for x in kept}) == len(kept)
    alike = spark.createDataFrame([(None, 1.0, i) for i in range(300)] + [(7, 1.0, i) for i in range(300)], "doc_id long, key double, row int")
    for k in (1, 299, 300, 301, 599):
        kept = importance.resample(alike, k).collect()
        assert len(kept) == 600 and sum(x.kept for x in kept) == k
        taken = {x.doc_id for x in kept if x.kept}
        assert len(taken) == (1 if k <= 300 else 2)


def test_weights_against_plain_counts(spark):
    texts = [(1, "good clean words here"), (2, "good words"), (3, "bad bad ###"), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, 7) for i, t in texts], "doc_id long, text string, key int")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in importance.select(docs, labels).collect()}
    grams = {i: [importance.buckets([t.encode()])[0]] for i, t in texts if t}
    size = 1 << importance.BITS
    raw = sum(np.bincount(g[0], minlength=size) for g in grams.values()) + 1.0
    target = sum(np.bincount(grams[i][0], minlength=size) for i in (1, 2)) + 1.0
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    for i, g in grams.items():
        assert rows[i].log_weight == pytest.approx(ratio[g[0]].sum()) and rows[i].n_grams == len(g[0])
    assert rows[4].log_weight == rows[5].log_weight == 0 and sum(r.kept for r in rows.values()) == math.ceil(5 * 2 / 3)


def test_draw_of_the_whole_table(spark, sf_dir):
    """Every weight, key and choice of op4_importance, counted and drawn anew."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.quality is not None}

    def grams(text):
        data = [np.frombuffer(kernels.fold(np.frombuffer(w, np.uint8)).tobytes(), np.uint8) for w in re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())]
        one = [kernels.hash_runs(w, np.array([0]), np.array([len(w)])) for w in data]
        two = [kernels.combine([a, b]) for a, b in zip(one, one[1:], strict=False)]
        return [int(h[0]) >> (64 - importance.BITS) for h in one + two]

    held = {i: grams(t) for i, t in docs.items()}
    size = 1 << importance.BITS
    raw, target = (np.bincount([g for i in ids for g in held[i]], minlength=size) + importance.SMOOTH for ids in (held, [i for i in held if quality.get(i) == 1]))
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    found = {r.doc_id: r for r in queries.op4_importance(spark, sf_dir).collect()}
    noise = {r.doc_id: r.h for r in spark.sql("SELECT * FROM parquet.`" + f"{sf_dir}/documents.parquet" + "`").selectExpr("doc_id", f"xxhash64({importance.SEED}, doc_id) AS h").collect()}
    keys = {}
    for i, g in held.items():
        u = ((noise[i] % 2**64) >> 11) * 2.0**-53 + 2.0**-54
        keys[i] = sum(ratio[b] for b in g) - math.log(-math.log(u))
        assert found[i].n_grams == len(g) and found[i].key == pytest.approx(keys[i])
    k = math.ceil(sum(quality.values()) / len(quality) * len(docs))
    assert {i for i, r in found.items() if r.kept} == set(sorted(keys, key=keys.get)[-k:])


def test_draw_follows_the_weights(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, math.log(3)).otherwise(0.0).alias("w"))
    kept = importance.resample(rows.withColumn("key", F.col("w") + importance.gumbel("doc_id")), 100).where("kept")
    assert 0.62 < kept.where("doc_id % 2 = 0").count() / 100 < 0.88


def test_resampling_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert importance.select(empty, labels).count() == 0
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    assert [r.kept for r in importance.select(docs, labels).collect()] == [True] * 3


def test_resampling_keeps_good_rows(spark):
    path = "/root/testdata/sf0.1"
    rows = queries.op4_importance(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.kept for r in rows if r.quality]) > 0.95 and np.mean([r.kept for r in rows if not r.quality]) < 0.2


# mixing


def test_mixing_equals_its_sql(spark):
    rows = [(i, f"t{i}", "en", ("big", "small", None)[0 if i % 10 < 7 else 1 if i % 10 < 9 else 2], i) for i in range(400)] + [(7, "again", None, "small", None), (None, None, "x", "small", 0), (500, "", "y", "tiny", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    truth = con.execute(mixing.oracle()).fetchall()
    assert sorted(map(repr, truth)) == sorted(repr(tuple(r)) for r in mixing.mix(docs).collect())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_target_weights(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 30 == 1, "b").otherwise("c").alias("source"), F.lit(1).alias("copy"))
    out = mixing.mix(docs, weights={"a": 1, "b": 2, "c": 1}, size=1.0)
    share = {r.source: r["count"] / 6000 for r in out.groupBy("source").count().collect()}
    assert share["a"] == pytest.approx(0.25, abs=0.03) and share["b"] == pytest.approx(0.5, abs=0.04) and share["c"] == pytest.approx(0.25, abs=0.03)
    order = [r.source for r in out.select("source").collect()]
    changes = sum(a != b for a, b in zip(order, order[1:], strict=False))
    assert changes > 0.4 * len(order)


def test_large_rates(spark):
    docs = spark.createDataFrame([(i, "s") for i in range(5)], "doc_id long, source string")
    n = mixing.mix(docs, size=900.0).count()
    assert abs(n - 4500) < 6 * math.sqrt(4500)


# pipeline


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        assert out.count() <= docs.count()
        docs = out


def test_pipeline_against_plain_versions(spark, sf_dir):
    """Language and secrets by their own operators, near-copies and passages by brute force, then the SQL of mixing."""
    from test_alike import plain_groups
    from test_text_operators import plain_tokens

    docs = {r.doc_id: r for r in corpus_pipeline.language(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).collect()}
    parts = plain_groups({i: r.text for i, r in docs.items()})
    docs = {i: r for i, r in docs.items() if parts[i] == i}
    items = [" ".join(plain_tokens(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {i: r for i, r in docs.items() if not any(f" {x} " in f" {' '.join(plain_tokens(r.text))} " for x in items)}
    left = spark.createDataFrame(list(clean.values()), spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    out = corpus_pipeline.run(spark, sf_dir)
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    con = duckdb.connect()
    con.register("documents", left.toArrow())
    truth = {r[0] for r in con.execute(mixing.oracle()).fetchall()}
    assert ids == truth
    for r in out.collect():
        assert r.n_chars == len(r.text) and not [k for k, *_ in secret_scan.base(r.text.encode()) if k == "assign"]


def test_pipeline_edges(spark, tmp_path, sf_dir):
    rows = [(1, None, None, "s", 0), (2, "", "en", None, 0), (3, "12345 !!", "en", "s", 8)]
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    for k, held in enumerate((rows, [])):
        folder = tmp_path / str(k)
        spark.createDataFrame(held, schema).withColumn("fp", F.lit(1)).write.parquet(str(folder / "documents.parquet"))
        spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(str(folder / "benchmark.parquet"))
        assert corpus_pipeline.run(spark, str(folder)).count() == 0
