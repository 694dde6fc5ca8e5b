"""Licence scan over a positional index of rare template words.

Document frequencies are counted over the whole table. Each template is indexed by its rarest words with their positions;
all of these words that a file holds are looked up there, postings are intersected by relative
position (file position minus template position, give or take ``slack`` words), and a placement counts once one of the template's mandatory
key phrases stands where the template has it.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Public licence notices as they are commonly quoted, and the phrases that must be present.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["except in compliance with the license"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "general public license version"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0", "cc by"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]
BASE_PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Lower-case letters, digits and every non-ASCII byte form words; all other ASCII bytes separate them.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class Template(NamedTuple):
    label: str
    words: list[bytes]
    phrases: list[tuple[int, list[bytes]]]  # place in the template, words


def parsed(templates: list[tuple[str, str, list[str]]]) -> list[Template]:
    out = []
    for label, text, keys in templates:
        words = words_of(text)
        phrases = []
        for key in map(words_of, keys):
            at = next((i for i in range(len(words)) if words[i : i + len(key)] == key), None)
            if at is None:
                raise ValueError(f"template {label!r} lacks its key phrase {key}")
            phrases.append((at, key))
        out.append(Template(label, words, phrases))
    return out


def document_frequencies(docs: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """Rows, and for each vocabulary word the rows that hold it. The result has a row per vocabulary word at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen[b""] += 1
                for w in vocabulary.intersection(words_of(text)):
                    seen[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word binary, n long")
    found = {bytes(r["word"]): r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found.pop(b"", 0), found


def places(words: list[bytes], where: dict[bytes, list[int]], phrase: list[bytes]) -> list[int]:
    k = len(phrase)
    return [i for i in where.get(phrase[0], ()) if words[i : i + k] == phrase]


class Scanner:
    """Index of the templates, and the scan of one text."""

    def __init__(self, templates: list[Template], idf: dict[bytes, float], base: list[tuple[list[bytes], str]], rare: int, slack: int, least: float):
        self.templates, self.idf, self.base, self.slack, self.least = templates, idf, base, slack, least
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.full: list[float] = []
        for t, template in enumerate(templates):
            chosen = sorted(set(template.words), key=lambda w: (-idf[w], w))[:rare]
            kept = [(i, w) for i, w in enumerate(template.words) if w in chosen]
            self.full.append(sum(idf[w] for _, w in kept))
            for i, w in kept:
                self.postings[w].append((t, i))
        self.watched = set(self.postings) | {p[0] for p, _ in base} | {key[0] for t in templates for _, key in t.phrases}

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], dict[str, float]]:
        """Words, base places with their labels, and each label's best covered share."""
        words, where = words_of(text), defaultdict(list)
        for i, w in enumerate(words):
            if w in self.watched:
                where[w].append(i)
        hits = [(i, label) for phrase, label in self.base for i in places(words, where, phrase)]
        offsets: dict[int, list[tuple[int, int, float]]] = defaultdict(list)
        for w in self.postings.keys() & where.keys():  # all of them: a budget for the file would let one licence hide another
            for t, at in self.postings[w]:
                offsets[t] += [(i - at, at, self.idf[w]) for i in where[w]]
        best: dict[str, float] = {}
        for t, found in offsets.items():
            share = self.placed(words, where, t, sorted(found))
            if share >= self.least:
                label = self.templates[t].label
                best[label] = max(best.get(label, 0.0), share)
        return len(words), hits, best

    def placed(self, words: list[bytes], where: dict[bytes, list[int]], t: int, found: list[tuple[int, int, float]]) -> float:
        """The largest share of the template's rare-word weight at one relative position where a key phrase stands."""
        keys = sorted(i - at for at, key in self.templates[t].phrases for i in places(words, where, key))
        if not keys:
            return 0.0
        best, low, near = 0.0, 0, 0
        held: dict[int, int] = defaultdict(int)
        weight = 0.0
        for offset, at, idf in found:
            held[at] += 1
            weight += idf if held[at] == 1 else 0.0
            while offset - found[low][0] > self.slack:
                _, gone, lost = found[low]
                held[gone] -= 1
                weight -= lost if held[gone] == 0 else 0.0
                low += 1
            while near < len(keys) and keys[near] < offset - self.slack:
                near += 1
            if weight > best and near < len(keys) and keys[near] <= offset + self.slack:
                best = weight
        return min(1.0, best / self.full[t]) if self.full[t] else 0.0


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: list[tuple[str, str, list[str]]] = TEMPLATES,
    base_phrases: list[tuple[str, str]] = BASE_PHRASES,
    rare: int = 12,
    slack: int = 3,
    least: float = 0.6,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``rare`` words index each template; all of them that a file holds are looked up; ``least`` is the share of a
    template's rare-word weight that must stand in place. Null and empty texts have no words and no
    labels, with score 0. Null ids and repeated rows are passed through. Ties in IDF go by the word's bytes.
    """
    ready = parsed(templates)
    base = [(words_of(p), label) for p, label in base_phrases]
    vocabulary = {w for t in ready for w in t.words}
    n, seen = document_frequencies(docs, vocabulary, text_col)
    idf = {w: math.log((n + 1) / (seen.get(w, 0) + 1)) + 1e-6 for w in vocabulary}
    scanner = Scanner(ready, idf, base, rare, slack, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(1).to_pylist():
                n_words, hits, best = scanner.scan(text)
                own = {label for _, label in hits}
                out.append((
                    n_words, len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None),
                    ",".join(sorted(own)), ",".join(sorted(own | set(best))), max(best.values(), default=0.0),
                ))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        .mapInArrow(run, "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
        .withColumnRenamed("id", id_col)
    )
