"""Token ids of whole texts by a vocabulary file of the tokenizers library.

A worker keeps bounded caches from whitespace-delimited chunks, and from their words and punctuation, to ids.  Normaliser and pre-tokeniser of such word
vocabularies never look across white space, so the ids of a text are those of its chunks in order; only words that
the caches lack reach the library.  Texts with characters outside printable ASCII, Latin-1 letters and plain
white space go to the library whole, and so does every text of a tokenizer whose pre-tokeniser keeps white space.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Text in which Python's and the library's ideas of white space and lower case agree.
PLAIN = re.compile(r"[\t\n\r -~¡-¬®-ÿ]*")
#: A word and the punctuation behind it, which word vocabularies treat apart.
WORD_TAIL = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: Bounds of the two caches and of what the library gets at once.
CACHE_CHUNKS, CACHE_PIECES, AT_ONCE, TEXTS_AT_ONCE = 250_000, 300_000, 20_000, 256


class Encoder:
    """``encoder(texts)`` yields the ids (uint32) of each text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        ids = lambda x: self.library.encode(x, add_special_tokens=False).ids
        self.by_chunk = ids("ab cd, ef") == ids("ab  cd,\nef ") == ids("ab") + ids("cd,") + ids("ef")
        self.by_piece = self.by_chunk and ids("CDÉ,.") == ids("cdé,.") == ids("cdé") + ids(",.")
        # A word alone is one unit of the pre-tokeniser; its model takes it in the pre-tokeniser's own letters.
        letters = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
        own = {c: self.library.pre_tokenizer.pre_tokenize_str(c) for c in letters} if self.by_piece else {}
        self.letters = str.maketrans({c: x[0][0] for c, x in own.items() if len(x) == 1})
        self.by_model = len(self.letters) == len(letters) and all(self._word(w) == ids(w) for w in ("a", "the", "cdé", "übergrößen", letters))
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            split = [t.split() if self.by_chunk and PLAIN.fullmatch(t) else None for t in texts[at : at + TEXTS_AT_ONCE]]
            # Not ``- keys()``, which would go through the whole cache.
            self._learn_chunks(set().union(*(s for s in split if s)).difference(self.chunks))
            for text, chunks in zip(texts[at : at + TEXTS_AT_ONCE], split, strict=True):
                if chunks is None:
                    yield np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
                else:
                    yield np.frombuffer(b"".join([self.chunks[c] for c in chunks]), np.uint32)
            if len(self.chunks) > CACHE_CHUNKS:
                self.chunks = {}

    def _word(self, word: str) -> list[int]:
        return [t.id for t in self.library.model.tokenize(word.translate(self.letters))]

    def _learn_chunks(self, new: set[str]) -> None:
        if len(self.pieces) > CACHE_PIECES:
            self.pieces = {}
        pieces, chunks, matched = self.pieces, self.chunks, WORD_TAIL.fullmatch
        later: list[tuple[str, str, str]] = []  # chunks with a piece that only the library's plain call can encode
        for chunk in new:
            if not (self.by_piece and (m := matched(chunk))):
                later.append((chunk, chunk, ""))
                continue
            word, tail = m[1].lower(), m[2]
            ids = pieces.get(word)
            if ids is None and self.by_model:  # in lower case it has only the letters that __init__ tries
                ids = pieces[word] = array("I", self._word(word)).tobytes()
            if ids is None or tail and tail not in pieces:
                later.append((chunk, word, tail))
            else:
                chunks[chunk] = ids + pieces[tail] if tail else ids
        want = [*{x for _, *p in later for x in p if x and x not in pieces}]
        for at in range(0, len(want), AT_ONCE):
            some = want[at : at + AT_ONCE]
            for piece, got in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False), strict=True):
                pieces[piece] = array("I", got.ids).tobytes()
        for chunk, word, tail in later:
            chunks[chunk] = pieces[word] + (pieces[tail] if tail else b"")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    return Encoder(path)
