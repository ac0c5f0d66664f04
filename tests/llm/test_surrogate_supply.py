"""Surrogates don't run out."""

import re

from lodeline.llm import surrogates


def test_more_names_and_addresses_than_short_surrogates(spark, monkeypatch):
    monkeypatch.setitem(surrogates.NAMES, ("n", "latin"), "Abel Bauer")  # two names, pairs and triples: fourteen forms
    rows = [("family", f"person{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(60)]
    rows += [("email", f"_@h{i}.com") for i in range(3100)]  # no letter to replace: three thousand hosts
    found = spark.createDataFrame(rows, "kind string, canon string")
    moved = {(r.kind, r.canon): r.attempt for r in surrogates.attempts(found, "key").collect()}
    made = spark.createDataFrame([(k, c, moved.get((k, c), 0)) for k, c in rows], "kind string, canon string, attempt int")
    values = [r.s for r in made.select(surrogates.surrogate(*map(surrogates.F.col, ("kind", "canon", "attempt")), "key").alias("s")).collect()]
    assert len(set(values)) == len(rows) and not set(values) & {c for _, c in rows}


def test_three_thousand_cyrillic_names(spark):
    letters = "бвгджзклмнпрст"
    names = [f"г-н {a.upper()}о{b}а{c}ов" for a in letters for b in letters for c in letters + "фхц"][:3000]
    docs = spark.createDataFrame([(i, n) for i, n in enumerate([*names, *names])], "doc_id long, text string")
    out = {}
    for r in surrogates.pseudonymise(docs, "key").collect():
        out.setdefault(names[r.doc_id % 3000], set()).add(r.text)
    assert all(len(x) == 1 for x in out.values()) and len(set().union(*out.values())) == 3000
    assert not set().union(*out.values()) & set(names)


def test_full_names_and_family_names_go_together(spark):
    texts = ["Mr John Smith came. Mr Smith left, Mrs Smith stayed.", "Mr JOHN SMITH and Mr Paul Smith", "Mrs Ida Stone", "Mr Smith, " * 5000]
    docs = spark.createDataFrame([(i, t, 1, "a", "b", "c") for i, t in enumerate(texts)] + [(3, texts[3], 1, "a", "b", "c")], "doc_id long, text string, found int, hash string, moved string, n_replaced string")
    rows = surrogates.pseudonymise(docs, "key").orderBy("doc_id").collect()
    assert rows[0].found == 1 and rows[0].hash == "a" and rows[3].text == rows[4].text and rows[3].n_replaced == 5000
    given, family = re.match(r"Mr (\S+) (\S+) came", rows[0].text).groups()
    assert rows[0].text == f"Mr {given} {family} came. Mr {family} left, Mrs {family} stayed." and family.lower() != "smith"
    other = re.match(r"Mr (\S+ \S+) and Mr (\S+) (\S+)", rows[1].text).groups()
    assert other[0] == f"{given} {family}".upper() and other[1] != given and other[2] == family
    assert family not in rows[2].text and set(rows[3].text.split()) == {"Mr", f"{family},"}


def test_a_key_is_needed(spark):
    import pytest

    with pytest.raises(ValueError):
        surrogates.pseudonymise(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "")


def test_gender_script_and_case_are_kept(spark):
    texts = [
        "г-жа Иванова и г-н Иванов, г-жа Достоевская",
        "г-жа Анна Иванова-Петрова",
        "Mr Παπαδόπουλος met Mrs Ελένη Παπαδοπούλου",
        "John.Smith@Example.com and john.smith@example.com and JOHN.SMITH@EXAMPLE.COM",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [r.text for r in surrogates.pseudonymise(docs, "key").orderBy("doc_id").collect()]
    her, him, other = re.fullmatch(r"г-жа ([А-Яа-я-]+) и г-н ([А-Яа-я-]+), г-жа ([А-Яа-я-]+)", out[0]).groups()
    assert her == him + "а" and her.endswith("а") and not him.endswith("а") and other.endswith("а") and other != her
    first, family = re.fullmatch(r"г-жа (\S+) (\S+)", out[1]).groups()
    assert first in surrogates.NAMES["f", "cyrillic"].split() and all(p.endswith("а") and p[0].isupper() for p in family.split("-"))
    man, given, woman = re.fullmatch(r"Mr (\S+) met Mrs (\S+) (\S+)", out[2]).groups()
    assert {man, woman} <= set(surrogates.NAMES["n", "greek"].split()) and given in surrogates.NAMES["f", "greek"].split()
    a, b, c = out[3].split(" and ")
    assert a.lower() == b and c == b.upper() and [x.isupper() for x in a.split("@")[0]] == [x.isupper() for x in "John.Smith"] and a != b
