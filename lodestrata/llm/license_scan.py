"""Short license notices, exact and with bounded edits (operator 11).

1. a text's words (`WORD` bytes, A-Z lower-cased) are joined by single spaces, with one before and after: the scanned form,
2. base phrases are found where their words stand consecutively; all places count, overlapping ones too,
3. a notice is a run of parts. A fuzzy part of length m bears m // `LETTERS_AN_EDIT` edits (a character inserted, lost or
   exchanged), `MOST_EDITS` at most; words marked by `=` must stand unchanged, for one edit in `mit`, `2` or `nc` names another license. Cut into
   one piece more than its edits, a part leaves one piece whole in every match (pigeonhole), so the pieces of one part are
   exact seeds: of the part whose shortest piece is longest,
4. one automaton finds all seeds of all notices; each gives the span in which a match can lie, and the regex library's
   bounded-error matching finds the best one there, which starts and ends at words. Of overlapping spans of one notice the one
   with the fewest edits stays, then the first.

`labels` are those of base phrases and notices, `score` is 1 less the edits' share of the notice's letters for the best
match; 1 with a base phrase, 0 without any match. Each span tells label, first word and number of words, edits, and its
characters [start, end) in the text as given.

Null and empty texts have no words and no labels. Rows with equal or null ids get a row each. Very long texts are scanned
whole; the work grows with the seeds that they hold. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, table, text_slices

LETTERS_AN_EDIT = 7
MOST_EDITS = 4
#: What is no letter, digit or byte over 127 reads as a space.
WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: The phrases of the registered query.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Notices with edits: wording that the licenses' texts and headers use.
NOTICES = (
    ("under the =mit license", "mit"),
    ("permission is hereby granted free of charge", "mit"),
    ("apache license version =2", "apache-2"),
    ("=cc =by =nc", "cc-by-nc"),
    ("=cc =by =sa", "cc-by-sa"),
    ("creative commons =attribution =noncommercial", "cc-by-nc"),
    ("creative commons =attribution =sharealike", "cc-by-sa"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("permission to use copy modify and or distribute", "isc"),
    ("this is free and unencumbered software", "unlicense"),
)


@dataclass(frozen=True)
class Notice:
    """A notice's parts (text, edits), its label and its seeds (piece, place in the notice)."""

    label: str
    parts: tuple[tuple[str, int], ...]
    seeds: tuple[tuple[str, int], ...]

    @property
    def text(self) -> str:
        return " ".join(p for p, _ in self.parts)

    @property
    def edits(self) -> int:
        return sum(e for _, e in self.parts)

    @property
    def pattern(self) -> str:
        inner = r"\ ".join(f"(?:{regex.escape(p)}){{e<={e}}}" if e else regex.escape(p) for p, e in self.parts)
        return rf"(?b)(?<=\ )(?:{inner})(?=\ )"


def notice(marked: str, label: str) -> Notice:
    """`marked`: words, those with `=` before them exact."""
    parts: list[tuple[str, int]] = []
    fuzzy: list[str] = []
    for word in [*marked.split(), "="]:
        if not word.startswith("="):
            fuzzy.append(word)
            continue
        if fuzzy:
            parts.append((" ".join(fuzzy), min(MOST_EDITS, len(" ".join(fuzzy)) // LETTERS_AN_EDIT)))
            fuzzy = []
        if word != "=":
            parts.append((word[1:], 0))
    options, at = [], 0
    for text, edits in parts:
        if edits:
            cuts = [len(text) * i // (edits + 1) for i in range(edits + 2)]
            options.append([(text[a:b], at + a) for a, b in zip(cuts, cuts[1:], strict=False)])
        else:
            options.append([(f" {text} ", at - 1)])
        at += len(text) + 1
    return Notice(label, tuple(parts), tuple(max(options, key=lambda seeds: min(len(s) for s, _ in seeds))))


class Scanner:
    """Finds phrases and notices in scanned forms."""

    def __init__(self, phrases: tuple[tuple[str, str], ...], notices: tuple[tuple[str, str], ...]):
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases]
        self.notices = [notice(*n) for n in notices]
        self.patterns = [regex.compile(n.pattern) for n in self.notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, n in enumerate(self.notices):
            for piece, at in n.seeds:
                seeds.setdefault(piece, []).append((k, at))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.seeds.add_word(piece, (len(piece), uses))
        if seeds:
            self.seeds.make_automaton()
        self.best = lru_cache(1 << 14)(self._best)

    def places(self, scanned: bytes) -> list[tuple[str, int]]:
        """(label, first word) of each place of a phrase."""
        out = []
        for phrase, label in self.phrases:
            word = last = 0
            at = scanned.find(phrase)
            while at >= 0:
                word += scanned.count(b" ", last, at)
                out.append((label, word))
                last, at = at, scanned.find(phrase, at + 1)
        return out

    def _best(self, k: int, piece: str) -> tuple[int, int, int] | None:
        found = self.patterns[k].search(piece)
        return (*found.span(), sum(found.fuzzy_counts)) if found else None

    def matches(self, scanned: str) -> list[tuple[int, int, int, int]]:
        """(edits, start, end, notice) of the notices' matches, at characters of the scanned form."""
        if not len(self.seeds):
            return []
        windows = set()
        for last, (size, uses) in self.seeds.iter(scanned):
            for k, at in uses:
                n = self.notices[k]
                begin = last + 1 - size - at
                windows.add((k, max(0, begin - n.edits - 1), begin + len(n.text) + n.edits + 1))
        found = set()
        for k, a, b in windows:
            if hit := self.best(k, scanned[a:b]):
                found.add((k, hit[2], a + hit[0], a + hit[1]))
        kept: list[tuple[int, int, int, int]] = []
        taken: dict[int, np.ndarray] = {}
        for k, edits, a, b in sorted(found):
            cells = taken.setdefault(k, np.zeros(len(scanned), bool))
            if not cells[a:b].any():
                cells[a:b] = True
                kept.append((edits, a, b, k))
        return sorted(kept, key=lambda m: (m[1], m[2], m[3]))


def scan(scanner: Scanner, raw: bytes) -> dict:
    """What one text holds."""
    words = raw.translate(WORD).split()
    form = b" ".join((b"", *words, b"")) if words else b" "
    places = scanner.places(form)
    text = form.decode()
    spans, score = [], 1.0 if places else 0.0
    if matches := scanner.matches(text):
        ends = [m.span() for m in regex.finditer(rb"[^ ]+", raw.translate(WORD))]
        chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        spaces = np.concatenate([[0], np.cumsum(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)])
        for edits, a, b, k in matches:
            n = scanner.notices[k]
            first, count = int(spaces[a]) - 1, int(spaces[b] - spaces[a]) + 1
            spans.append({"label": n.label, "first_word": first, "n_words": count, "edits": edits, "start": int(chars[ends[first][0]]), "end": int(chars[ends[first + count - 1][1]])})
            score = max(score, 1 - edits / len(n.text))
    base = {label for label, _ in places}
    return {
        "n_words": len(words),
        "n_base": len(places),
        "first_word": min((w for _, w in places), default=None),
        "last_word": max((w for _, w in places), default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | {s["label"] for s in spans})),
        "score": score,
        "spans": spans,
    }


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first_word: long, n_words: long, edits: int, start: long, end: long>>"
_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_KINDS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(_SPAN)}


def scan_notices(docs: DataFrame, phrases: tuple = PHRASES, notices: tuple = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: its id and `FIELDS`."""
    prepare(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices)
        for batch, data, offsets in text_slices(batches):
            whole = data.tobytes()
            rows = [scan(scanner, whole[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([r[c] for r in rows], kind) for c, kind in _KINDS.items())], names=["id", *_KINDS])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(task, f"id {rows.schema['id'].dataType.simpleString()}, {FIELDS}").withColumnRenamed("id", id_col)


def op11_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_notices(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.to_json("spans").alias("spans"))
