"""Scan results on whole texts: siblings among the templates don't label each other's blocks."""

from tidemill.llm import licenses

TEXTS = [
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc", "cc-by", 1.0),
    ("Licensed under CC BY 4.0.", "cc-by", "cc-by", 1.0),
    ("Licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0", "gpl", 1.0),
    ("licensed under the GNU General Public License version", "gpl", "gpl", 1.0),
    ("Licensed under the GNU Lesser General Public License.", "gpl,lgpl", "gpl", 1.0),
    ("under the GNU Lesser General Public License.", "gpl,lgpl", "gpl", 1.0),
    ("some words\nReleased under the MIT License", "mit", "", 1.0),
    ("licensed CC 4.0 SA by them", "cc-by-sa", "", 6 / 7),
    ("licensed under by 4.0 SA CC", "cc-by-sa", "", 1.0),
    (None, "", "", 0.0),
    ("Licensed under CC BY 4.0.\n\nLicensed under CC BY-ND 4.0.", "cc-by,cc-by-nd", "cc-by", 1.0),
]


def test_siblings_are_told_apart(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(TEXTS)], "doc_id long, text string")
    found = {r["doc_id"]: (r["labels"], r["base_labels"], r["score"]) for r in licenses.scan(df).collect()}
    assert found == {i: tuple(x) for i, (_, *x) in enumerate(TEXTS)}


def test_every_template_still_labels_itself():
    index = licenses.Index()
    for label, text in licenses.TEMPLATES:
        assert {x for x, _ in index.told_apart(frozenset(text.encode().split()))} == {label}
