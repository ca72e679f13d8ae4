"""License scans against a plain search, and spans of changed notices."""

import re

import pytest

from pointgrid.llm import licenses
from pointgrid.llm.queries import SQL, op12_licenses

MIT = next(t for t, label in licenses.NOTICES.items() if label == "mit")


def words_of(text):
    return re.findall(licenses.WORD, "".join(c.lower() if c.isascii() else c for c in text or ""))


def base(text):
    w = words_of(text)
    at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


TEXTS = [
    "Released under the MIT License.", "UNDER---the\nmit\tlicense", "under the mit licenses", "under the mit license", "under the mit license" * 3, "under the mit license " * 700,
    "Apache License, Version 2.0; under the MIT license (CC BY-NC)", "cc by nc cc by nc", "cc by nc by nc", "K under the mıt license", "cc by", "x", "...", "▁é", " ".join(["w"] * 40_000) + " cc-by-nc",
]


def test_base_places(spark, hard_rows, hard):
    rows = hard_rows + [(2000 + i, t) for i, t in enumerate(TEXTS)] + [(2000, TEXTS[0]), (2000, TEXTS[0]), (2001, TEXTS[2]), (None, TEXTS[0]), (None, TEXTS[0])]
    docs = hard.select("doc_id", "text", "key", "id", "size", "rank").unionByName(
        spark.createDataFrame(rows[len(hard_rows):], "doc_id long, text string"), allowMissingColumns=True
    ).selectExpr("*", "1 AS template", "2 AS place", "3 AS label", "4 AS copies")
    got = licenses.scanned(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(((d, *base(t)) for d, t in rows), key=str)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert all((r.score == 1.0) if r.n_base else (0 <= r.score <= 1) for r in got)
    assert licenses.scanned(docs.where("false")).count() == 0


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Copyright X. Permission is hereby granted, free of charge, " + MIT.split("free of charge ")[1], "mit"),
        (MIT.replace("obtaining a copy", "who is obtaining one copy"), "mit"),  # changed and moved words: neighbouring diagonals
        (MIT.replace("of this software and", "of and"), "mit"),
        (" ".join(MIT.split()[:12]), ""),  # less than half of it
        (" lorem ".join(MIT.split()), ""),  # no three words in a row
        ("All rights reserved.", "all-rights-reserved"), ("under the terms of the GNU General Public License, version 2", "gpl"), ("nothing here", ""), ("", ""), (None, ""),
    ],
)
def test_labels_of_notices(spark, text, label):
    docs = spark.createDataFrame([(1, text), (2, "some " * 50 + (text or "")), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scanned(docs).collect()}
    assert [got[i].labels for i in (1, 2, 3)] == [label, label, ""]
    assert got[3].score == 0


def test_templates_are_checked(spark):
    with pytest.raises(ValueError, match="3 to 63"):
        licenses.template_grams(spark, {"too short": "x"}, {})


def test_no_python_in_the_plan(spark, sf_dir):
    assert "op12_licenses" in SQL
    plan = op12_licenses(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Arrow|Pandas|Python", plan)
