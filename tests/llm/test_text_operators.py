"""Pages, language, quality, secrets, overlaps and toxicity against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lodeline.llm import decontam, html_text, langid, quality, queries, secret_scan, toxicity

EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "plain words only here"), (4, "plain words only here"), (None, "no id"), (6, "long " * 60_000)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "x", 0.5, True) for i, t in EDGE], "doc_id long, text string, probability string, score double, kept boolean")


# pages


def test_layout():
    page = "<title>no</title><h1>A &amp; B</h1><p>one<p>two <b>bold</b>   x<br>y<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul><div style='display: none'>no</div><p hidden>no</p><script>no()</script>end"
    assert html_text.extract(page) == "A & B\n\none\n\ntwo bold x\ny\n\n* a\n* b\n  3. x\n  4. y\n\nend"


def test_tables_align():
    page = "<table><tr><th>Name<th>Qty<tr><td>Apple<td>3<tr><td colspan=2>All of them<tr><td rowspan=2>Pear</td><td>12</td><tr><td>7</table>"
    assert html_text.extract(page) == "Name   Qty\nApple  3\nAll of them\nPear   12\n       7"


def test_pages_that_are_hardly_html():
    assert html_text.extract("a < b and <3 </nope> <!-- x") == "a < b and <3"
    assert html_text.extract("") == html_text.extract("<p><div></p></div>") == ""
    assert html_text.extract("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert html_text.extract("<pre> a\n  b</pre>") == " a\n  b"
    assert html_text.extract('<a title="x > y">t</a><img alt="pic">') == "tpic"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<li>", "<ul>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<br>", "word", " ", "<b>", "</b>", "<pre>", "\n", "&lt;", "<div hidden>", "</div>"]), max_size=30))
def test_any_markup_renders(parts):
    html_text.extract("".join(parts))


def test_visible_words_survive(spark, sf_dir):
    rows = queries.op2_html_text(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id").collect()
    for r in rows:
        body = re.sub(r"(?is)<(script|style|head)\b.*?</\1>|<!--.*?-->", " ", r.html)
        plain = re.sub(r"<[^>]*>", " ", body)
        for a, b in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
            plain = plain.replace(a, b)
        assert [w for w in r.text.split() if w != "*"] == [w for w in plain.split() if w != "*"]


def test_null_pages(spark):
    pages = spark.createDataFrame([(1, None, 3), (2, "", 4), (3, "<p>x", 5)], "page_id long, html string, n_lines int")
    assert sorted((r.page_id, r.text, r.n_lines) for r in html_text.extracted(pages).collect()) == [(1, None, 0), (2, "", 0), (3, "x", 1)]


# language


def test_forward_sums_all_segmentations():
    model = langid.learn({"a": Counter({"banana": 3, "bandana": 1}), "b": Counter({"nabana": 2})}, ["▁", "▁ba", "ban", "an", "ana", "na", "a", "n", "b", "▁ban", "d"])
    place = {p: i for i, p in enumerate(model.pieces)}

    def brute(word):
        marked = langid.MARK + word
        total = np.zeros((len(marked) + 1, 2))
        total[0] = 1
        for i in range(len(marked)):
            for j in range(i + 1, len(marked) + 1):
                if marked[i:j] in place:
                    total[j] += total[i] * model.table[place[marked[i:j]]]
            if marked[i] not in place:
                total[i + 1] += total[i] * model.table[-1]
        return np.log(total[-1])

    for word in ("banana", "b", "nab", "xan", "bandanabanana"):
        assert model.score([word, "a"])[0] == pytest.approx(brute(word))
    assert model.table[:-1].sum(axis=0) == pytest.approx([1, 1])


def test_language_edges(spark, edge):
    model = langid.learn({"en": Counter({"plain": 2, "words": 2, "here": 1})}, langid.read_pieces())
    found = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(edge, model).collect()]
    assert [f[1:] for f in found[:3]] == [("und", 0.0)] * 3 and {f[1] for f in found[3:]} == {"en"} and len(found) == len(EDGE)
    assert sorted(str(r.doc_id) for r in langid.keep_known(edge, model).collect()) == ["4", "4", "6", "None"]
    none = langid.predict(edge, langid.Model([], [], np.zeros((1, 0)))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert langid.predict(edge.limit(0), model).count() == 0


def test_language_held_out_accuracy(spark):
    found = queries.op5_language(spark, "/root/testdata/sf0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = found.collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [truth[r.doc_id] == r.lang_pred for r in rows if r.held_out]
    assert sum(held) / len(held) > 0.98


def test_training_ignores_held_out_and_null(spark):
    docs = spark.createDataFrame([(i, "aa bb", None if i % 2 else "en") for i in range(40)], "doc_id long, text string, lang string")
    assert langid.train(docs).languages == ["en"]
    assert langid.train(docs.where("lang is null")).languages == []


# quality


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n#\x0b 𝄞", max_size=80)), min_size=1, max_size=5))
def test_base_counts(texts):
    block, starts, ends, hashes, owner = quality.read([None if t is None else t.encode() for t in texts])
    c = quality.base(block, starts, ends, hashes, owner)
    found = list(zip(c.n_words.tolist(), c.word_chars.tolist(), c.n_symbols.tolist(), c.n_dup_lines.tolist(), c.n_repeat_words.tolist(), strict=True))
    assert found == [plain_counts(t) for t in texts]


def test_quality_whole_table(spark):
    rows = {r.doc_id: r for r in queries.op6_quality(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    for d in docs:
        r = rows[d.doc_id]
        n, chars, symbols, dup, rep = plain_counts(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n) and not (r.base_failed and r.kept)
    good = [rows[i].kept for i, q in labels.items() if q == 1]
    bad = [rows[i].kept for i, q in labels.items() if q == 0]
    assert np.mean(good) > 0.93 and np.mean(bad) < 0.1


def test_quality_edges(spark, edge):
    untrained = quality.fit([], np.zeros(0))
    found = quality.judge(edge, untrained).collect()
    assert len(found) == len(EDGE) and all(r.base_failed for r in found) and not any(r.kept for r in found)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judge(edge, quality.train(edge, labels)).count() == len(EDGE)
    assert quality.judge(edge.limit(0), untrained).count() == 0


# secrets


def plain_base(text):
    t = text or ""
    found = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?a:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.ASCII) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(found, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["token", "Secret", "api_key", " = ", ": ", '"', "password=", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", " ", "x", "\n", "ſecret"]), max_size=14))
def test_base_spans(parts):
    text = "".join(parts)
    raw = text.encode()
    found = [(k, len(raw[:a].decode()), len(raw[:b].decode())) for k, a, b, _, _ in secret_scan.base(raw)]
    assert found == plain_base(text)


@pytest.fixture(scope="module")
def field():
    return secret_scan.fit([w for line, spans in secret_scan.made_up(300) for w in secret_scan.windows(line, spans)], rounds=60)


def test_viterbi_by_parts_is_viterbi(field):
    lines = [line for line, _ in secret_scan.made_up(120, 3)] + [b"", b"word " * 50, b"ghp_0123456789abcdefABCDEF0123456789abcd " * 5]
    tokens = secret_scan.read(secret_scan.Block(lines))
    found = {(int(tokens.owner[a]), a, b) for a, b in field.decode(tokens)}
    truth = set()
    e = field.weights[tokens.features].sum(axis=0)
    for i in range(len(lines)):
        own = np.flatnonzero(tokens.owner == i)
        score, back = np.array([0.0, secret_scan._NEVER, secret_scan._NEVER]), []
        for t in own:
            options = score[:, None] + field.moves
            back.append(options.argmax(axis=0))
            score = options.max(axis=0) + e[t]
        now, tags = int((score + field.moves[:, 0]).argmax()), []
        for b in reversed(back):
            tags.append(now)
            now = int(b[now])
        tags.reverse()
        for k, t in enumerate(tags):
            if t == secret_scan.BEGIN:
                end = k + 1
                while end < len(tags) and tags[end] == secret_scan.IN:
                    end += 1
                truth.add((i, int(own[k]), int(own[k]) + end - k))
    assert found == truth


def test_field_finds_other_formats(field):
    hits = [bool(secret_scan.find([line], field)[0]) for line, spans in secret_scan.made_up(200, 77) if spans]
    false = [f for line, spans in secret_scan.made_up(200, 77) if not spans for f in secret_scan.find([line], field)[0] if f[0] == "crf"]
    assert np.mean(hits) > 0.9 and len(false) <= 3


def test_secrets_whole_table(spark):
    rows = {r.doc_id: r for r in queries.op7_secrets(spark, "/root/testdata/sf0.01").collect()}
    for d in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        truth = plain_base(d.text)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in truth)
        r = rows[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in truth) for kind in ("assign", "access", "hex"))
        assert [s for s in r.spans.split(",") if s and not s.startswith("crf")] == [s for s in said.split(",") if s]


def test_secrets_edges(spark, edge, field):
    found = secret_scan.scan(edge, field).collect()
    assert len(found) == len(EDGE) and {r.spans for r in found} == {""}
    docs = spark.createDataFrame([(1, 'é token = "abcdefghijklmnop" x', "a"), (2, None, "b")], "doc_id long, text string, spans string")
    assert [r.text for r in secret_scan.redact(docs, field).orderBy("doc_id").collect()] == ['é token = "[SECRET]" x', None]
    assert secret_scan.scan(edge.limit(0), field).count() == 0
    assert secret_scan.train(edge.limit(0)).weights.shape == field.weights.shape


# overlaps


def plain_tokens(text):
    return re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", (text or "").lower())


def test_overlaps_with_substitutions(spark):
    r = np.random.default_rng(0)
    word = lambda: "".join(r.choice(list("abcdefgh"), 6))
    items = [" ".join(word() for _ in range(n)) for n in (40, 30, 10, 5, 25)]
    changed = items[1].split()
    for i in (4, 11, 18, 25):
        changed[i] = "other"
    texts = ["x y " + items[0] + " z", "a b c " + " ".join(changed), "q " + items[2].upper() + " r", items[3], " ".join(items[4].split()[:9]), None, "", items[0] + " " + items[0]]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, t, "z") for i, t in enumerate(items)] + [(9, None, "z"), (10, "", "z")], "item_id long, text string, doc_id string")
    found = {(r.doc_id, r.item_id): (r.first_token, r.n_tokens, r.n_matched) for r in decontam.overlaps(docs, bench).collect()}
    assert found == {(0, 0): (2, 40, 40), (1, 1): (3, 30, 26), (2, 2): (1, 10, 10), (3, 3): (0, 5, 5), (7, 0): (0, 40, 40)}
    kept = [r.doc_id for r in decontam.clean(docs, bench).orderBy("doc_id").collect()]
    assert kept == [4, 5, 6]
    assert [r.doc_id for r in decontam.clean(docs, bench, least_tokens=6).orderBy("doc_id").collect()] == [3, 4, 5, 6]
    assert decontam.overlaps(docs.limit(0), bench).count() == 0 and decontam.overlaps(docs, bench.limit(0)).count() == 0


def test_overlaps_whole_table_against_alignment(spark, sf_dir):
    bench = [(r.item_id, plain_tokens(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = {(r.doc_id, r.item_id) for r in queries.op8_decontamination(spark, sf_dir).collect()}
    truth = set()
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        own = plain_tokens(d.text)
        places = {}
        for i, t in enumerate(own):
            places.setdefault(t, []).append(i)
        for item, words in bench:
            # an overlap begins with a match and keeps four matches a substitution, so eight in a row or a mask must hit
            diagonals = Counter(i - j for j, t in enumerate(words) for i in places.get(t, ()))
            for diagonal, n in diagonals.items():
                if n >= decontam.MATCHED:
                    a = np.array([hash(x) for x in own])
                    b = np.array([hash(x) for x in words])
                    if decontam.overlap(a, b, diagonal)[2] >= min(decontam.MATCHED, len(words)):
                        truth.add((d.doc_id, item))
    assert found == truth


# toxicity


def test_noisy_or(spark):
    weights = np.zeros((1 << toxicity.BITS) + 1)
    _, bucket, _, _, _, _ = toxicity.instances([b"idiot"])
    weights[bucket[0, 0]] = 6.0
    model = toxicity.Model(weights, -4.0)
    text = "Fine day. You idiot! Fine é day.\nidiot again"
    score, n, spans = model.score([text.encode(), b"", None, b"nothing here"])
    p = [1 / (1 + np.exp(-z)) for z in (-4.0, 2.0, -4.0, 2.0)]
    assert score[0] == pytest.approx(1 - np.prod([1 - x for x in p])) and n.tolist() == [4, 0, 0, 1]
    assert score[1] == score[2] == 0 and [text[int(a) : int(b)] for a, b in (s.split(":") for s in spans[0].split(","))] == ["You idiot", "idiot again"]


def test_toxicity_held_out(spark):
    path = "/root/testdata/sf0.1"
    rows = queries.op9_toxicity(spark, path).where("held_out")
    found = rows.join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").select("toxic", "predicted", "score").collect()
    right = np.mean([r.toxic == r.predicted for r in found])
    caught = np.mean([r.predicted for r in found if r.toxic])
    assert right > 0.95 and caught > 0.75 and all(0 <= r.score <= 1 for r in found)


def test_toxicity_edges(spark, edge):
    nothing = toxicity.fit(toxicity.Bags(np.zeros(0, int), np.zeros(0, int), [], []), np.zeros(0, int))
    found = toxicity.predict(edge, nothing).collect()
    assert len(found) == len(EDGE) and all(r.predicted == 0 and 0 <= r.score <= 1 for r in found)
    assert toxicity.predict(edge.limit(0), nothing).count() == 0
    labels = spark.createDataFrame([(4, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.predict(edge, toxicity.train(edge, labels)).count() == len(EDGE)
