"""Token ids by the tokenizers library, each different pretoken encoded once.

Both vocabularies split a text into pretokens by a pattern and encode each alone. For texts of plain scripts (visible
ASCII and Latin letters, spaces and line ends) the same pattern is run here, and each pretoken's ids come from a bounded
table of the process; new pretokens go to the library many at a time. All other texts go to the library whole.
Tests hold the ids against the library on whole texts.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

#: Entries of each of the two generations of the table.
PIECES = 450_000
_LETTER = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
#: Characters that the patterns below do not cover.
_ODD = re.compile(f"[^!-~×÷\\n {_LETTER}]")
#: The pretoken patterns of the two vocabularies over plain texts.
_BYTE = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[0-9]+| ?[^\\s0-9{_LETTER}]+|\n")
_WORD = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[0-9]|[^\\s0-9{_LETTER}]+")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder of a vocabulary: its table serves all tasks that the process runs."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    """Ids of texts as little-endian 32-bit integers in bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.words = "Lowercase" in str(self.tokenizer.normalizer)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, pieces: set[str]) -> None:
        """Puts the pieces that the table lacks into it."""
        older, known = self.older, self.known
        new = []
        for p in pieces:
            ids = older.get(p)
            if ids is None:
                new.append(p)
            else:
                known[p] = ids
        joined = [p for p in new if self.words or p[0] == " "]
        single = [] if self.words else [p for p in new if p[0] != " "]
        groups = [joined[i : i + 512] for i in range(0, len(joined), 512)]
        texts = [(" " if self.words else "").join(g) for g in groups]
        for group, e in zip(groups, self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            ids, of = np.array(e.ids, "<u4"), np.array(e.word_ids)
            cuts = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]])
            if len(cuts) != len(group) + 1:  # never seen; the pieces one by one are right in any case
                single += group
                continue
            raw, cuts = ids.tobytes(), (4 * cuts).tolist()
            known.update(zip(group, map(raw.__getitem__, map(slice, cuts[:-1], cuts[1:])), strict=True))
        for p, e in zip(single, self.tokenizer.encode_batch(single, add_special_tokens=False), strict=True):
            known[p] = array("I", e.ids).tobytes()

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out: list[bytes] = []
        for i in range(0, len(texts), 128):
            out += self._some(texts[i : i + 128])
        return out

    def _plain(self, text: str) -> bool:
        """Do the patterns split `text` as the library does? Byte pretokens also depend on runs of white space."""
        if not (text.isascii() and text.replace("\n", "").isprintable()) and _ODD.search(text):
            return False
        return self.words or not (text[:1] == " " or text[-1:] in (" ", "\n") or any(x in text for x in ("  ", "\n\n", " \n", "\n ")))

    def _some(self, texts: list[str]) -> list[bytes]:
        split = [None if not self._plain(t) else (_WORD.findall(t.lower()) if self.words else _BYTE.findall(t)) for t in texts]
        new = set().union(*(pieces for pieces in split if pieces)).difference(self.known)
        if new:
            self._learn(new)
        get = self.known.__getitem__
        out = [self.whole(text) if pieces is None else b"".join(map(get, pieces)) for text, pieces in zip(texts, split, strict=True)]
        if len(self.known) > PIECES:
            self.known, self.older = {}, self.known
        return out
