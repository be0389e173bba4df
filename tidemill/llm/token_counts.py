"""Token counts by greedy longest match in linear time.

The vocabulary is a trie. Where a node has no child for the next character, its failure link leads to the node of the
rest that remains after taking the longest tokens off the front, and the number of those tokens is stored with the
link; so a word's piece count comes from one pass over its characters, and no piece is ever built. Tokens that continue
a word start with a mark in the vocabulary ("##").
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, text_or_empty

MARK = "##"
#: Words whose counts a worker remembers.
REMEMBERED = 200_000


class Automaton:
    """Piece counts of words under a vocabulary; a word that can't be matched to its end counts as one unknown token."""

    def __init__(self, vocabulary: Iterable[str], mark: str = MARK):
        self.children: list[dict[str, int]] = [{}, {}]
        self.token = [False, False]
        self.depth = [0, 0]
        for entry in sorted(set(vocabulary)):
            inner = entry.startswith(mark) and len(entry) > len(mark)
            node = int(inner)
            for c in entry[len(mark) :] if inner else entry:
                after = self.children[node].get(c)
                if after is None:
                    after = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.token.append(False)
                    self.depth.append(self.depth[node] + 1)
                node = after
            if entry and entry != mark:
                self.token[node] = True
        self._link()

    def _link(self) -> None:
        """Failure links and how many tokens each takes, breadth first; -1 where nothing can be taken."""
        n = len(self.children)
        self.link, self.popped = [-1] * n, [0] * n
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for c, child in self.children[node].items():
                if self.token[child]:
                    self.link[child], self.popped[child] = 1, 1
                else:
                    at, taken = self.link[node], self.popped[node]
                    while at >= 0 and c not in self.children[at]:
                        taken += self.popped[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[child], self.popped[child] = self.children[at][c], taken
                queue.append(child)

    def count(self, word: str) -> int:
        """Number of pieces, or 0 if the word can't be matched to its end."""
        children, link, popped = self.children, self.link, self.popped
        node = total = 0
        for c in word:
            after = children[node].get(c)
            while after is None:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return 0
                after = children[node].get(c)
            node = after
        while self.depth[node]:
            if link[node] < 0:
                return 0
            total += popped[node]
            node = link[node]
        return total


def vocabulary_of(tokenizer: str) -> list[str]:
    """Word-piece entries from a tokenizers file whose tokens mark word ends: a token may begin or continue a word."""
    from tokenizers import Tokenizer

    plain = {t.removesuffix("</w>") for t in Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=False)}
    shown = _byte_alphabet()
    words = set()
    for t in plain:
        try:
            words.add(bytes(shown[c] for c in t).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    return sorted(words | {MARK + w for w in words})


def _byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


_BUILT: dict[tuple[str, ...], Automaton] = {}


def counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_words, n_tokens (pieces, an unknown word being one), n_unknown of every whole text, lower-cased.

    Words are runs of anything but ASCII white space. Null and empty texts have none; repeated rows get a row each; an
    empty table gives none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    known: dict[bytes, int] = {}

    def work(part: pa.RecordBatch) -> dict:
        if (tokenizer,) not in _BUILT:
            _BUILT[(tokenizer,)] = Automaton(vocabulary_of(tokenizer))
        automaton = _BUILT[(tokenizer,)]
        split = [t.lower().encode("utf-8", "replace").split() for t in part["text"].to_pylist()]
        if len(known) > REMEMBERED:
            known.clear()
        for word in set().union(*split) - known.keys():
            known[word] = automaton.count(word.decode())
        tokens, unknown = [], []
        for words in split:
            found = [known[w] for w in words]
            none = found.count(0)
            tokens.append(sum(found) + none)
            unknown.append(none)
        return {"doc_id": part["doc_id"], "n_words": [len(w) for w in split], "n_tokens": tokens, "n_unknown": unknown}

    return mapped(docs, work, "doc_id long, n_words long, n_tokens long, n_unknown long")
