"""Token ids of whole texts from a public word-level BPE file, through the tokenizers library.

The file's pre-tokenizer never joins characters over white space, so a text's ids are those of its
white-space words one after another, and trailing punctuation of a word is a piece of its own. Each
worker keeps the ids of pieces it has met in two generations of bounded size. A piece of plain letters or plain
punctuation is one word to the pre-tokenizer and goes to the library's BPE model directly; any other
goes through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

#: Pieces of a generation whose ids are kept; a worker holds two generations.
CACHE_PIECES = 200_000
#: Bytes of a text whose words are listed at once.
PART_BYTES = 1 << 20
#: ASCII punctuation that ends a word and follows a letter or digit (ASCII, or a Latin-1 letter): a piece of its own.
TAIL = re.compile(rb"(?s)([!-&(-/:-@\[-`{-~](?:(?<=[a-z0-9].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))[!-&(-/:-@\[-`{-~]*)(?=[\t-\r ]|$)")
#: Bytes that begin a special token; texts with them are encoded whole.
SPECIAL = b"<|"
#: Pieces that the pre-tokenizer leaves in one and that normalization only lower-cases.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[!-/:-@\[-`{-~]+")
SPACE = re.compile(rb"[\t-\r ]")
#: Bytes 128 to 255 (as Latin-1 characters) to the printable characters by which the vocabulary writes them.
SHOWN = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in range(33, 127) and b not in range(161, 173) and b not in range(174, 256)) if b >= 128}


class Pieces(dict):
    """Ids of pieces as bytes; a missing one is taken from the generation before or encoded when it is asked for."""

    def __init__(self, tokenizer, old: dict[bytes, bytes]):
        self.encode, self.tokenize, self.old = tokenizer.encode, tokenizer.model.tokenize, old
        self.raw = [i.to_bytes(4, "little") for i in range(vocabulary_size(tokenizer))] if not isinstance(old, Pieces) else old.raw
        self.old_get = old.get

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.old_get(piece)
        if ids is None:
            raw = self.raw
            if PLAIN.fullmatch(piece):
                word = piece.decode() if piece.isascii() else piece.decode().lower().encode().decode("latin-1").translate(SHOWN)
                ids = b"".join([raw[t.id] for t in self.tokenize(word)])
            else:
                ids = b"".join([raw[i] for i in self.encode(piece.decode(), add_special_tokens=False).ids])
        self[piece] = ids
        return ids

    def next_generation(self, tokenizer) -> Pieces:
        self.old, self.old_get = {}, {}.get
        return Pieces(tokenizer, self)


def vocabulary_size(tokenizer) -> int:
    return max(tokenizer.get_vocab(with_added_tokens=True).values()) + 1


class WordIds:
    """Ids as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = vocabulary_size(self.tokenizer)
        self.known = Pieces(self.tokenizer, {})

    def parts(self, text: str | None) -> Iterator[bytes]:
        """The ids of a text, a part at a time; null and empty texts have none."""
        raw = (text or "").encode("utf-8", "replace")
        if SPECIAL in raw:
            yield np.array(self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
            return
        start = 0
        while start < len(raw):
            cut = SPACE.search(raw, start + PART_BYTES)
            end = cut.start() if cut else len(raw)
            words = TAIL.sub(rb" \1", raw[start:end].lower()).split()  # bytes.lower() is ASCII only, as the tokenizer's own lower case covers the rest
            yield b"".join(map(self.known.__getitem__, words))
            if len(self.known) > CACHE_PIECES:
                self.known = self.known.next_generation(self.tokenizer)
            start = end

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text."""
        return [b"".join(self.parts(text)) for text in texts]


_WORKER: dict[str, WordIds] = {}


def worker(path: str) -> WordIds:
    """One encoder per Python worker."""
    if path not in _WORKER:
        _WORKER[path] = WordIds(path)
    return _WORKER[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
