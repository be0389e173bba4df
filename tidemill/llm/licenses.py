"""License scans: an exact set-similarity join of license templates with text blocks.

A block is a line, or a paragraph (lines up to a blank one). A template is found in a block that holds at least
`threshold` of its distinct words. Words of templates are ordered by the number of blocks of the whole table that hold
them, rarest first. A block that reaches the threshold must hold one of the first |T| - ceil(t|T|) + 1 words (prefix),
have ceil(t|T|) words (length), and, from its first match at place i, no more than |T| - i words can be shared
(position). Only then is the overlap counted.

Templates of different labels that share so much of the shorter one are siblings. A block that may lack some words must
still hold those that a template has and its sibling lacks, and a template inside a longer sibling gives way to it where
the block holds the sibling's other words.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, text_or_empty

# Phrases that count wherever they stand, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Usual wordings of public licenses and notices, and the labels given to blocks that hold them.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("reserved", "copyright all rights reserved no part of this publication may be reproduced without prior written permission"),
)
#: Share of a template's distinct words that a block must hold.
THRESHOLD = 0.85

#: A-Z to a-z; every byte that is not a word's becomes a space, a line end stays.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
FOLD_LINES = FOLD[:10] + b"\n" + FOLD[11:]


def places(words: list[bytes], phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """(start, label) of each place where a phrase's words stand one after another."""
    joined = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in phrases.items():
        key = b" " + phrase.encode() + b" "
        at = joined.find(key)
        while at >= 0:
            found.append((joined.count(b" ", 0, at), label))
            at = joined.find(key, at + 1)
    return found


def blocks(folded: bytes) -> list[frozenset[bytes]]:
    """Distinct words of each line and of each paragraph of two lines or more."""
    out, paragraph = [], []
    for line in [*folded.split(b"\n"), b""]:
        words = line.split()
        if words:
            paragraph.append(words)
            out.append(frozenset(words))
            continue
        if len(paragraph) > 1:
            out.append(frozenset(w for x in paragraph for w in x))
        paragraph = []
    return out


class Index:
    """Templates with their words in the order of the blocks' frequencies."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD, frequency: dict[bytes, int] | None = None):
        frequency = frequency or {}
        self.templates = []
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for number, (label, text) in enumerate(templates):
            words = sorted(set(text.encode().split()), key=lambda w: (frequency.get(w, 0), w))
            need = math.ceil(threshold * len(words) - 1e-9)
            self.templates.append((label, words, need))
            for place, word in enumerate(words[: len(words) - need + 1]):
                self.prefix.setdefault(word, []).append((number, place))
        self.required: list[set[bytes]] = [set() for _ in self.templates]
        self.wider: list[list[set[bytes]]] = [[] for _ in self.templates]
        for number, (label, words, _) in enumerate(self.templates):
            for other, others, _ in self.templates:
                own, rest = set(words) - set(others), set(others) - set(words)
                if other != label and len(words) - len(own) >= threshold * min(len(words), len(others)) - 1e-9:
                    self.required[number] |= own
                    if not own and rest:
                        self.wider[number].append(rest)

    def find(self, block: frozenset[bytes]) -> list[tuple[str, float]]:
        """(label, containment) of every template that the block holds."""
        return [(self.templates[number][0], share) for number, share in self._find(block)]

    def told_apart(self, block: frozenset[bytes]) -> list[tuple[str, float]]:
        """(label, containment) of the templates that the block holds, without those that it tells from a sibling."""
        return [(self.templates[number][0], share) for number, share in self._find(block) if self.required[number] <= block and not any(rest <= block for rest in self.wider[number])]

    def _find(self, block: frozenset[bytes]) -> list[tuple[int, float]]:
        seen: dict[int, int] = {}
        for word in block & self.prefix.keys():
            for number, place in self.prefix[word]:
                seen[number] = min(place, seen.get(number, place))
        found = []
        for number, place in seen.items():
            _, words, need = self.templates[number]
            if len(block) >= need and len(words) - place >= need:
                shared = sum(w in block for w in words[place:])
                if shared >= need:
                    found.append((number, shared / len(words)))
        return found


def frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """How many blocks of all documents hold each word of the templates (the result is bounded by the templates)."""
    vocabulary = {w for _, text in templates for w in text.encode().split()}

    def count(part: pa.RecordBatch) -> dict:
        found: Counter = Counter()
        for text in part["text"].to_pylist():
            folded = text.encode("utf-8", "replace").translate(FOLD_LINES)
            if not vocabulary.isdisjoint(folded.split()):
                for block in blocks(folded):
                    found.update(block & vocabulary)
        return {"word": [w.decode() for w in found], "n": list(found.values())}

    counted = mapped(docs.select(text_or_empty().alias("text")), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"].encode(): r["n"] for r in counted.collect()}


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.

    Null texts are empty: no words, no labels, score 0. Repeated rows get a row each, an empty table gives none. score
    is 1 where a phrase stands, else the largest containment of a template found.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    index = Index(templates, threshold, frequencies(docs, templates))
    starts = {p.encode().split()[0] for p in PHRASES}
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    names = [x.split()[0] for x in schema.split(", ")]

    def work(part: pa.RecordBatch) -> dict:
        rows = []
        for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
            folded = text.encode("utf-8", "replace").translate(FOLD_LINES)
            words = folded.split()
            distinct = frozenset(words)
            at = places(words) if not starts.isdisjoint(distinct) else []
            found = [x for block in blocks(folded) for x in index.told_apart(block)] if not distinct.isdisjoint(index.prefix) else []
            base = {label for _, label in at}
            score = 1.0 if at else max((s for _, s in found), default=0.0)
            rows.append((doc_id, len(words), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted(base)), ",".join(sorted(base | {x for x, _ in found})), score))
        return dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

    return mapped(docs, work, schema)
