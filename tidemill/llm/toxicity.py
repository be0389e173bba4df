"""Toxicity: gradient-boosted trees over dense features of the text, with isotonic calibration.

Features are densities: words of a fixed lexicon and of one learned from the training rows, second-person words near
such words, capitals, punctuation and obfuscation. The trees are grown on histograms of binned features, the
calibration on out-of-fold margins.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, mapped, stored, text_or_empty

# Words of abuse in common use.
LEXICON = frozenset("idiot idiots moron morons stupid dumb fool loser losers pathetic worthless scum trash garbage filth filthy disgusting clown jerk creep coward liar freak pig rat vermin parasite imbecile cretin dimwit halfwit bastard bitch whore slut asshole shit shitty fuck fucking crap damn hate kill die ugly disgrace".split())
# Second-person words.
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur tu toi vous votre vos usted ustedes tus du dich dir dein deine ihr euch".split())
# Characters that stand for letters in disguised words.
DISGUISE = str.maketrans("0134578@$!", "oieastbasi")

WORD = re.compile(r"[^\W_]+(?:[@$!*][^\W_]+)*[@$!*]?|[^\W_]*[@$*][^\W_]+")
FEATURES = ("lexicon", "lexicon_count", "learned", "learned_count", "learned_most", "person", "person_near", "capitals", "shouted", "punctuation", "exclamation", "obfuscated", "mean_length", "length")
#: Labelled rows that are fitted on at most: those of least crc32(doc_id as text), so a choice that needs no order.
FIT_ROWS = 6_000
#: Bytes of text that these rows have at most.
FIT_BYTES = 64 << 20
#: Words that the learned lexicon holds at most, and labelled rows that a word must stand in.
LEARNED_WORDS, LEAST_ROWS = 2_000, 5
NEAR = 5
THRESHOLD = 0.7


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def plain_words(text: str) -> tuple[list[str], list[str]]:
    """Words as written, and lower-cased with disguised letters put back."""
    raw = WORD.findall(text)
    return raw, [w if w.isalpha() else w if w.isdigit() else w.translate(DISGUISE).replace("*", "") for w in (x.lower() for x in raw)]


def features(text: str, learned: dict[str, float]) -> list[float]:
    """FEATURES of one text; an empty text has zeros."""
    raw, words = plain_words(text)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    person = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    fixed = [i for i, w in enumerate(words) if w in LEXICON]
    scores = [(i, learned[w]) for i, w in enumerate(words) if w in learned]
    bad = sorted({*fixed, *(i for i, s in scores if s > 0)})
    near = 0
    for p in person:
        k = np.searchsorted(bad, p)
        near += any(abs(bad[j] - p) <= NEAR for j in (k - 1, k) if 0 <= j < len(bad))
    letters = sum(map(len, raw))
    hidden = sum(1 for r, w in zip(raw, words, strict=True) if not r.isalpha() and not r.isdigit() and w.isalpha() and w in LEXICON)
    upper = sum(map(str.isupper, text))
    marks = sum(text.count(c) for c in ".,;:!?")
    positive = [s for _, s in scores]
    return [
        math.sqrt(len(fixed) / n), math.log1p(len(fixed)), math.sqrt(max(0.0, sum(positive)) / n), math.log1p(len(positive)), max(positive, default=0.0),
        len(person) / n, near / n, upper / letters, sum(1 for r in raw if len(r) > 2 and r.isupper()) / n, marks / n, text.count("!") / n, hidden / n, letters / n, math.log1p(n),
    ]


class Trees:
    """Boosted regression trees for the logistic loss, grown on at most 64 bins a feature."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, least: float = 4.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.least, self.ridge = rounds, depth, rate, least, ridge

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 64)[1:-1])) for j in range(x.shape[1])]
        b, bins = self._bin(x), 64
        share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
        self.base = math.log(share / (1 - share))
        margin, self.trees = np.full(len(y), self.base), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            node, tree = np.zeros(len(y), dtype=np.int64), {}
            for level in range(self.depth):
                first, n = (1 << level) - 1, 1 << level
                at = node - first
                split = False
                sums = [(np.bincount(at * bins + b[:, j], g, n * bins).reshape(n, bins), np.bincount(at * bins + b[:, j], h, n * bins).reshape(n, bins)) for j in range(b.shape[1])]
                for k in range(n):
                    best = (1e-6, -1, 0)
                    for j, (sg, sh) in enumerate(sums):
                        lg, lh = np.cumsum(sg[k])[:-1], np.cumsum(sh[k])[:-1]
                        tg, th = sg[k].sum(), sh[k].sum()
                        ok = (lh >= self.least / 4) & (th - lh >= self.least / 4)
                        gain = np.where(ok, lg**2 / (lh + self.ridge) + (tg - lg) ** 2 / (th - lh + self.ridge) - tg**2 / (th + self.ridge), -1)
                        if len(gain) and gain.max() > best[0]:
                            best = (float(gain.max()), j, int(gain.argmax()))
                    tree[first + k] = best[1:]
                    split |= best[1] >= 0
                feature = np.array([tree[first + k][0] for k in range(n)])[at]
                cut = np.array([tree[first + k][1] for k in range(n)])[at]
                right = (feature >= 0) & (b[np.arange(len(b)), np.maximum(feature, 0)] > cut)
                node = 2 * node + 1 + right
                if not split and level == 0:
                    break
            leaves = 1 << self.depth
            at = np.minimum(node - (leaves - 1), leaves - 1) if len(tree) == leaves - 1 else np.zeros(len(y), dtype=np.int64)
            if len(tree) != leaves - 1:
                break
            value = -self.rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + self.ridge)
            self.trees.append((np.array([tree[i] for i in range(leaves - 1)]), value))
            margin += value[at]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out = self._bin(x), np.full(len(x), self.base)
        for nodes, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                feature, cut = nodes[node, 0], nodes[node, 1]
                node = 2 * node + 1 + ((feature >= 0) & (b[np.arange(len(b)), np.maximum(feature, 0)] > cut))
            out += value[node - len(nodes)]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on x, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for xi, yi in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([yi, 1.0, xi, xi])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            last = blocks.pop()
            into = blocks[-1]
            n = into[1] + last[1]
            blocks[-1] = [(into[0] * into[1] + last[0] * last[1]) / n, n, into[2], last[3]]
    return np.array([v for b in blocks for v in (b[2], b[3])]), np.array([b[0] for b in blocks for _ in range(2)])


class Model:
    """Learned lexicon, trees and calibration."""

    def __init__(self, texts: Sequence[str], labels: Sequence[int], folds: int = 3):
        y = np.array(labels, dtype=float)
        self.known = len(y) > 0 and 0 < y.sum() < len(y)
        if not self.known:
            self.prior = float(y.mean()) if len(y) else 0.0
            self.learned = {}
            return
        fold = np.array([zlib.crc32(t.encode("utf-8", "replace")) % folds for t in texts])
        words = [set(plain_words(t)[1]) for t in texts]
        margins = np.zeros(len(y))
        for k in range(folds):
            inside, outside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if len(outside) and 0 < y[inside].sum() < len(inside):
                learned = self.lexicon([words[i] for i in inside], y[inside])
                x = np.array([features(t, learned) for t in texts])
                margins[outside] = Trees().fit(x[inside], y[inside]).margin(x[outside])
        self.learned = self.lexicon(words, y)
        self.trees = Trees().fit(np.array([features(t, self.learned) for t in texts]), y)
        self.x, self.y = isotonic(margins, y)

    @staticmethod
    def lexicon(words: list[set[str]], y: np.ndarray) -> dict[str, float]:
        """Words that stand far more often in rows of label 1, with their log odds."""
        bad: dict[str, int] = {}
        every: dict[str, int] = {}
        for found, label in zip(words, y.tolist(), strict=True):
            for w in found:
                every[w] = every.get(w, 0) + 1
                if label:
                    bad[w] = bad.get(w, 0) + 1
        ones, zeros = float(y.sum()), float(len(y) - y.sum())
        scored = {w: math.log((b + 0.5) / (ones + 1)) - math.log((every[w] - b + 0.5) / (zeros + 1)) for w, b in bad.items() if every[w] >= LEAST_ROWS}
        strong = sorted((w for w, s in scored.items() if s > 2.5), key=lambda w: (-scored[w] * math.sqrt(bad[w]), w))
        return {w: round(scored[w], 6) for w in strong[:LEARNED_WORDS]}

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        if not self.known:
            return np.full(len(texts), self.prior)
        margin = self.trees.margin(np.array([features(t, self.learned) for t in texts]).reshape(-1, len(FEATURES)))
        return np.clip(np.interp(margin, self.x, self.y), 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, most_bytes: int = FIT_BYTES) -> Model:
    """Fits on labelled rows that aren't held out: at most `rows` doc_ids, those of least crc32 of doc_id (then doc_id),
    as far as their whole texts have `most_bytes` together. Of a doc_id's repeated rows the least text counts, of its
    labels the greatest."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = known.orderBy(order, "doc_id").limit(rows).withColumn("crc", order)
    side = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    found = stored(side.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "crc", "toxic").agg(F.min("text").alias("text")), "fit-rows")
    before = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy("crc", "doc_id"))  # `rows` rows at most
    taken = found.select("doc_id", before.alias("upto")).where(F.col("upto") <= most_bytes)
    own = found.join(F.broadcast(taken), "doc_id").select("doc_id", "text", "toxic").collect()
    discard(found)
    own.sort()
    return Model([r["text"] for r in own], [r["toxic"] for r in own])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text (null: empty). Repeated rows get a row each; an empty
    table gives none; without both labels every score is the labels' mean."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_or_empty().alias("text"))

    def work(part: pa.RecordBatch) -> dict:
        score = sent.value.scores(part["text"].to_pylist())
        return {"doc_id": part["doc_id"], "held_out": part["held_out"], "score": pa.array(score), "predicted": pa.array((score >= THRESHOLD).astype(np.int32))}

    return mapped(rows, work, "doc_id long, held_out boolean, score double, predicted int")
