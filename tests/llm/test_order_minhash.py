"""Fingerprints and likeness against a plain Order MinHash, on texts of 1 to 200 words."""

import random
import re
import struct
from collections import Counter

import pytest
import xxhash

from tidemill.llm import order_minhash

CLEAR, FULL = ~((1 << 24) - 1) & ((1 << 64) - 1), (1 << 64) - 1


def h(*values):
    """Spark's xxhash64 of strings, longs (an int of 64 bits) and ints (a tuple)."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<Q", v)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


def plain_kmers(text):
    """(hash, place) of each k-mer, numbered by occurrence."""
    w = [r for x in re.findall(r"[^\x20\x09-\x0D]+", text) for r in ([x] if len(x) <= 16 else [x[i : i + 8] for i in range(len(x) - 7)])]
    grams = [h(a, b) & CLEAR for a, b in zip(w, w[1:])] if len(w) >= 2 else [h(" ".join(w)) & CLEAR] if w else []
    seen, out = Counter(), []
    for place, x in enumerate(grams, 1):
        out.append((h(x, (seen[x],)) & CLEAR if seen[x] else x, place))
        seen[x] += 1
    return out


def plain_fingerprint(kmers):
    """The two least of ALL k-mers in each of 64 orders, in text order."""
    cells = []
    for c in range(64):
        def key(k):
            own = ((k[0] >> 58) ^ 32) == c
            mixed = h(k[0], (c,)) & CLEAR
            return (0, k[0]) if own else (1, mixed ^ (1 << 63))
        least = sorted(kmers, key=key)[:2]
        owned = sum(((x >> 58) ^ 32) == c for x, _ in kmers)
        ids = [(place, x if owned >= 2 else h(x, (c,)) & CLEAR) for x, place in least]
        cells.append(h(*(x for _, x in sorted(ids))) if ids else None)
    return "".join("-" * 8 if x is None else f"{x:016X}"[:8] for x in cells)


def independent_likeness(a, b):
    """Order MinHash with 64 hashes that have nothing in common with the operator's."""
    def pairs(kmers):
        return [tuple(x for x, _ in sorted(sorted(kmers, key=lambda k: xxhash.xxh64_intdigest(struct.pack("<Q", k[0]), 1000 + c))[:2], key=lambda k: k[1])) for c in range(64)]
    return (sum(x == y for x, y in zip(pairs(a), pairs(b), strict=True)) / 64) ** 0.5


@pytest.fixture(scope="module")
def texts():
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)]
    return [" ".join(r.choices(words, k=n)) for n in (1, 2, 3, 5, 10, 20, 40, 80, 130, 200) for _ in range(12)] + ["", "a b a b a b a b", "x x x x", "é" * 16 + " " + "日本語" * 6, "\U0001f600" * 40, "one " + "abcdefghij" * 3 + "\u2028\u0085z two"]


def found_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, a string, b string")
    df = order_minhash.fingerprint(order_minhash.fingerprint(df, "a", "x"), "b", "y")
    return {r["doc_id"]: r for r in df.select("doc_id", order_minhash.as_text("x").alias("x"), order_minhash.likeness("x", "y").alias("near")).collect()}


def test_fingerprints_take_the_two_least_of_all_kmers(spark, texts):
    found = found_of(spark, [(i, t, t) for i, t in enumerate(texts)])
    for i, t in enumerate(texts):
        assert found[i]["x"] == plain_fingerprint(plain_kmers(t)), t
        assert found[i]["near"] == 1


def test_swapped_halves_are_as_unlike_as_with_independent_hashes(spark, texts):
    rows = []
    for i, t in enumerate(texts):
        w = t.split()
        rows.append((i, t, " ".join(w[len(w) // 2 :] + w[: len(w) // 2])))
    found = found_of(spark, rows)
    for n in (5, 10, 20, 40, 80, 130, 200):
        of = [(found[i]["near"], independent_likeness(plain_kmers(a), plain_kmers(b))) for i, a, b in rows if len(a.split()) == n]
        assert len(of) == 12 and abs(sum(x - y for x, y in of) / 12) < 0.08, (n, of)
        print(n, [round(sum(x) / 12, 2) for x in zip(*of, strict=True)])


def test_an_insertion_in_text_without_white_space_changes_only_what_is_near(spark):
    r = random.Random(3)
    t = ["".join(r.choice("日本語中文字漢仮名交文章") for _ in range(600)) for _ in range(12)]
    found = found_of(spark, [(i, x, x[:30] + "新" + x[30:]) for i, x in enumerate(t)])
    assert sum(x["near"] for x in found.values()) / 12 > 0.9
