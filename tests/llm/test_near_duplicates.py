"""Links of rows without doc_id, and the near-duplicate stage on doc_ids that stand on several rows."""

import random

import corpus_pipeline
from tidemill.llm import jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n=100):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


def edited(w, *places):
    return [f"edited{i}" if i in places else x for i, x in enumerate(w)]


def frame(spark, *rows):
    return spark.createDataFrame([(d, " ".join(w), "en", "s0", None) for d, w in rows], SCHEMA)


def test_a_null_id_near_copy_bridges_two_documents(spark):
    # 100 words; an edit changes 5 shingles of 96: one edit 91/101 = 0.90, two far apart 86/106 = 0.81, three 0.73.
    base, lone = words(1), words(2)
    docs = frame(spark, (1, edited(base, 20)), (None, edited(base, 50)), (2, edited(base, 50, 80, 35)), (3, lone), (None, edited(lone, 5)), (None, words(3)))
    found = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.linked(docs).collect()), key=repr)
    assert found == sorted([(1, 1), (None, 1), (2, 1), (3, 3), (None, 3), (None, None)], key=repr)


def test_only_the_near_copy_of_a_repeated_doc_id_goes(spark):
    base, clean = words(4), words(5)
    rows = [(1, base), (5, edited(base, 50)), (5, clean), (5, clean), (6, words(6)), (None, base)]
    kept = corpus_pipeline.near_duplicates(spark, frame(spark, *rows), "").collect()
    expected = [(1, base), (5, clean), (6, words(6)), (None, base)]
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted(((d, " ".join(w)) for d, w in expected), key=repr)


def test_pairs_are_all_links_of_a_group(spark):
    base = words(7)
    texts = [base, *[edited(base, i) for i in range(10, 90, 6)], words(8), edited(words(8), 9), words(9), base, []]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in texts]
    links, members = jaccard.pairs(frame(spark, *enumerate(texts)))
    of = {r["doc_id"]: (r["key"], r["n_shingles"]) for r in members.collect()}
    assert {i: n for i, (_, n) in of.items()} == {i: len(x) for i, x in enumerate(sets)} and of[len(texts) - 1][0] is None
    expected = {tuple(sorted((of[i][0], of[j][0]))) for i, x in enumerate(sets) for j, y in enumerate(sets) if x and y and x != y and 100 * len(x & y) >= 80 * len(x | y)}
    found = [(r["a"], r["b"]) for r in links.collect()]
    assert len(expected) > 90 and len(found) == len(set(found)) and set(found) == expected
