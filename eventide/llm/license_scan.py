"""License scans: short notices found with a bounded number of errors.

A text is read as its words in lower case with one space between them, so line ends, comment marks and punctuation don't matter. A notice of n
characters may have n // 10 errors (inserted, deleted or replaced characters), 6 at most. It is cut into one piece more than that: whatever the errors hit,
one piece stands unharmed (the pigeonhole principle). All pieces of all notices are found in one pass over the text by an Aho-Corasick
automaton; each hit gives a window in which the regex library looks for the best match within the bound, between word borders. What is
reported of a finding is its label, its span in the text as given, its first word, and its errors. Of overlapping matches of a notice the best stays.
Beside this, the exact phrases of PHRASES are counted at every place.

Each text is scanned whole, by itself, in one pass: nothing is shuffled or broadcast but the notices.

Defined cases: a null text is empty. Letters outside A-Z keep their case, and all characters beyond ASCII are parts of words. A repeated row is scanned
again; ids aren't read. Equal windows of a text are verified once, so a text that repeats a piece a million times takes little longer. An empty table gives
an empty result. Input columns besides text pass through unless they clash with an output column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import as_array, bound_batches, text_slices

#: The exact phrases and their labels.
PHRASES = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))
#: The notices searched with errors: what licenses are called, and how their texts begin.
NOTICES = (
    ("gpl", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("apache", "apache license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "bsd 3 clause license"),
    ("mpl", "mozilla public license"),
    ("epl", "eclipse public license"),
    ("boost", "boost software license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "creative commons attribution"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by-sa", "cc by sa"),
    ("cc0", "cc0 1 0 universal"),
)
MOST_ERRORS, CHARS_PER_ERROR = 6, 10
#: Every byte that is no part of a word reads as a space; A-Z in lower case.
READ = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FINDING = pa.struct([("label", pa.string()), ("notice", pa.string()), ("word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("errors", pa.int64()), ("found", pa.string())])
OUT = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, findings array<struct<label: string, notice: string, word: long, start: long, end: long, errors: long, found: string>>"


def errors_of(notice: str) -> int:
    return min(MOST_ERRORS, len(notice) // CHARS_PER_ERROR)


def pieces(notice: str) -> list[tuple[int, str]]:
    """(offset, piece): one more than the notice may have errors."""
    k = errors_of(notice) + 1
    cuts = [len(notice) * i // k for i in range(k + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Match(NamedTuple):
    errors: int
    start: int
    end: int


class Scanner:
    """Finds notices in texts that are read as words."""

    def __init__(self, notices=NOTICES, phrases=PHRASES):
        import ahocorasick
        import regex

        self.notices, self.phrases = list(notices), [(label, f" {p} ") for label, p in phrases]
        self.patterns = [regex.compile(rf"(?b)(?<= )(?:{regex.escape(n, special_only=True, literal_spaces=True)}){{e<={errors_of(n)}}}(?= )") for _, n in self.notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for at, (_, n) in enumerate(self.notices):
            for offset, piece in pieces(n):
                seeds.setdefault(piece, []).append((at, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in seeds.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def matches(self, words: str) -> Iterator[tuple[int, Match]]:
        """(number of a notice, match) in words with a space before, between and after them."""
        found: dict[int, set[Match]] = {}
        verified: dict[tuple[int, str], Match | None] = {}
        for end, (size, places) in self.automaton.iter(words):
            for at, offset in places:
                notice = self.notices[at][1]
                k = errors_of(notice)
                begin = max(0, end + 1 - size - offset - k - 1)
                window = words[begin : end + 1 - size - offset + len(notice) + k + 1]
                if (at, window) not in verified:
                    m = self.patterns[at].search(window)
                    verified[at, window] = None if m is None else Match(sum(m.fuzzy_counts), m.start(), m.end())
                best = verified[at, window]
                if best is not None:
                    found.setdefault(at, set()).add(Match(best.errors, begin + best.start, begin + best.end))
        for at, some in found.items():
            free = Free()
            for m in sorted(some):
                if free.take(m.start, m.end):
                    yield at, m

    def scan(self, text: bytes) -> tuple:
        """The columns of OUT for one text."""
        words = text.translate(READ).split()
        if not words:
            return 0, 0, None, None, [], []
        read = f" {b' '.join(words).decode('utf-8', 'replace')} "
        n_base, first, last, labels = 0, None, None, set()
        for label, phrase in self.phrases:
            at = read.find(phrase)
            if at < 0:
                continue
            labels.add(label)
            first = at if first is None else min(first, at)
            while at >= 0:
                n_base, end = n_base + 1, at
                at = read.find(phrase, at + 1)
            last = end if last is None else max(last, end)
        findings, matches = [], sorted(self.matches(read), key=lambda m: (m[1].start, m[0]))
        if matches:
            # places in the text as given are counted in code points
            spans = [m.span() for m in WORD.finditer(text)]
            word, at, chars, bytes_ = 0, 0, 0, 0
            for notice, m in matches:
                word, at = word + read.count(" ", at, m.start - 1), m.start - 1
                final = word + read.count(" ", m.start, m.end)
                a, b = spans[word][0], spans[final][1]
                chars, bytes_ = chars + len(text[bytes_:a].decode("utf-8", "replace")), a
                found = text[a:b].decode("utf-8", "replace")
                label, phrase = self.notices[notice]
                findings.append({"label": label, "notice": phrase, "word": word, "start": chars, "end": chars + len(found), "errors": m.errors, "found": found})
        place = lambda at: None if at is None else read.count(" ", 0, at)
        return len(words), n_base, place(first), place(last), sorted(labels), findings


class Free:
    """Which stretches of a text are taken."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def take(self, start: int, end: int) -> bool:
        from bisect import bisect_left

        i = bisect_left(self.starts, end)
        if i and self.ends[i - 1] > start:
            return False
        self.starts.insert(i, start)
        self.ends.insert(i, end)
        return True


def license_scan(docs: DataFrame, *, notices=NOTICES, phrases=PHRASES) -> DataFrame:
    """Adds to each document n_words, n_base (places of phrases), first_word and last_word (of these), base_labels and findings (of notices)."""
    bound_batches(docs.sparkSession)
    out = {part.split(" ", 1)[0] for part in OUT.replace("struct<", "").split(", ")}
    kept = [c for c in docs.columns if c not in out and c != "text"]
    fixed = tuple(notices), tuple(phrases)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*fixed)
        for batch in batches:
            for at, n in text_slices(as_array(batch.column(len(kept)))):
                part = batch.slice(at, n)
                rows = [scanner.scan(t or b"") for t in part.column(len(kept)).to_pylist()]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(),) * 4 + (pa.list_(pa.string()), pa.list_(FINDING)))]
                names = [*kept, "n_words", "n_base", "first_word", "last_word", "base_labels", "findings"]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *cols], names=names)

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), OUT])
    return docs.select(*kept, F.col("text").cast("binary").alias("_text")).mapInArrow(scan, schema)


def findings(scanned: DataFrame) -> DataFrame:
    """A row for each finding of a notice: the other columns and label, notice, word, start, end, errors, found."""
    own = ("n_words", "n_base", "first_word", "last_word", "base_labels", "findings")
    return scanned.select(*(c for c in scanned.columns if c not in own), F.inline("findings"))


def summary(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score): labels of both kinds, and how much of the best finding is unharmed (a phrase: 1)."""
    labels = F.array_sort(F.array_union("base_labels", F.transform("findings", lambda f: f.label)))
    best = F.array_max(F.transform("findings", lambda f: F.lit(1.0) - f.errors / F.char_length(f.notice)))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0)))
    return scanned.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_labels").alias("base_labels"), F.concat_ws(",", labels).alias("labels"), score.alias("score")
    )
