"""License scans: an exact set-similarity join of text blocks with notice templates.

A text is lower-cased (A-Z) and cut into words of letters, digits and non-ASCII
characters. The blocks that a template is held against are all windows of as many
consecutive words as the template has, across line ends (a shorter text is one block), so a
template of any length fits. A block meets a template when it contains at least
``THRESHOLD`` of the template's distinct words.

The join is exact and filtered three ways. Template words are ordered by their document
frequency over the whole corpus, rarest first (ties by the word). *Prefix*: a template of
n words that needs m of them must share one of its n - m + 1 rarest with the block, so only
blocks around such words are looked at. *Length*: the text needs m distinct words of it.
*Position*: a first match at place i leaves at most n - i matches. Survivors are verified by
intersection. Every template met gives its label, save one: the words that a block has of a
template may all belong to another template, met by an overlapping block with a larger share
(then more words, then the larger label); then the other one stands there. So a GPL 3 notice
isn't a GPL 2 notice too, and two notices on one line give two labels.

Besides, ``PHRASES`` are found wherever their words stand consecutively, across lines.

Null and empty texts have no words, no labels and score 0. Very long texts are scanned
whole; the work is by their prefix words. Repeated rows and rows that share a doc_id or
have none are scanned each on its own; an empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
THRESHOLD = 0.9

#: Phrases of words and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices of public licenses and their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl-3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("lgpl-3", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("agpl-3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("agpl-3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("bsl-1", "Distributed under the Boost Software License, Version 1.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "Copyright. All rights reserved. No part may be reproduced without permission."),
)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def templates(source: tuple[tuple[str, str], ...] = TEMPLATES) -> list[tuple[str, frozenset[str], int]]:
    """Label, distinct words and length in words of each template."""
    return [(label, frozenset(words), len(words)) for label, text in source for words in [words_of(text)]]


def needed(size: int, threshold: float = THRESHOLD) -> int:
    """Words of a template of this size that a block must contain."""
    return max(1, -int(-size * threshold // 1))


def document_frequency(docs: DataFrame, words: frozenset[str]) -> dict[str, int]:
    """In how many of all documents each of these words stands; the result is as small as ``words``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for value in batch.column(0):
                total.update(words.intersection(WORD.findall((value.as_py() or "").translate(LOWER))))
        yield pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    counted = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r[0]: r[1] for r in counted.collect()}


class Index:
    """Templates indexed by the words of their prefixes."""

    def __init__(self, sets: list[tuple[str, frozenset[str], int]], frequency: dict[str, int], threshold: float = THRESHOLD):
        self.sets = sets
        self.need = [needed(len(words), threshold) for _, words, _ in sets]
        self.longest = max((n for _, _, n in sets), default=0)
        self.by_word: dict[str, list[tuple[int, int]]] = {}
        for t, (_, words, _) in enumerate(sets):
            ordered = sorted(words, key=lambda w: (frequency.get(w, 0), w))
            for place, word in enumerate(ordered[: len(words) - self.need[t] + 1]):
                self.by_word.setdefault(word, []).append((t, place))
        self.prefixes = frozenset(self.by_word)

    def candidates(self, distinct: set[str]) -> dict[int, list[str]]:
        """Templates that a text of these words may meet, each with the prefix words that the text has."""
        found: dict[int, list[str]] = {}
        first: dict[int, int] = {}
        for word in self.prefixes & distinct:
            for t, place in self.by_word[word]:
                found.setdefault(t, []).append(word)
                first[t] = min(place, first.get(t, place))
        return {t: words for t, words in found.items() if len(self.sets[t][1]) - first[t] >= self.need[t] <= len(self.sets[t][1] & distinct)}

    def matches(self, words: list[str], distinct: set[str]) -> list[tuple[int, int, frozenset[str]]]:
        """(start, template, its words there) of every block that meets a template, by start."""
        places: dict[str, list[int]] = {}
        found = self.candidates(distinct)
        wanted = {w for prefix in found.values() for w in prefix}
        if wanted:
            for at, word in enumerate(words):
                if word in wanted:
                    places.setdefault(word, []).append(at)
        out = []
        for t, prefix in found.items():
            _, own, size = self.sets[t]
            last = max(0, len(words) - size)
            for start in sorted({i for word in prefix for at in places[word] for i in range(max(0, at - size + 1), min(at, last) + 1)}):
                if len(met := own.intersection(words[start : start + size])) >= self.need[t]:
                    out.append((start, t, met))
        return sorted(out, key=lambda m: m[:2])

    def standing(self, found: list[tuple[int, int, frozenset[str]]]) -> dict[int, float]:
        """The templates that stand, with their largest share, of matches by start."""
        rank = lambda t, met: (len(met) / len(self.sets[t][1]), len(self.sets[t][1]), self.sets[t][0])
        starts, out = [m[0] for m in found], {}
        for start, t, met in found:
            share = rank(t, met)
            for other, u, theirs in found[bisect_left(starts, start - self.longest + 1) :]:
                if other >= start + self.sets[t][2]:
                    out[t] = max(share[0], out.get(t, 0.0))
                    break
                if other + self.sets[u][2] > start and rank(u, theirs) > share and met <= self.sets[u][1]:
                    break
            else:
                out[t] = max(share[0], out.get(t, 0.0))
        return out


def scan_text(text: str | None, index: Index, phrases: dict[str, str] = PHRASES) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    words = words_of(text)
    distinct = set(words)
    base, starts = set(), []
    for phrase, label in phrases.items():
        parts = phrase.split(" ")
        if distinct.issuperset(parts):
            at = -1
            while True:
                try:
                    at = words.index(parts[0], at + 1)
                except ValueError:
                    break
                if words[at : at + len(parts)] == parts:
                    starts.append(at)
                    base.add(label)
    labels, score = set(base), 1.0 if base else 0.0
    for t, share in index.standing(index.matches(words, distinct)).items():
        labels.add(index.sets[t][0])
        score = max(score, share)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def scan(docs: DataFrame, source: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of docs(doc_id, text) with its license places, labels and score."""
    sets = templates(source)
    frequency = document_frequency(docs, frozenset().union(*(words for _, words, _ in sets)))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(sets, frequency, threshold)
        for batch in batches:
            found = [scan_text(value.as_py(), index) for value in batch.column(1)]
            columns = list(zip(*found, strict=True)) or [[]] * 7
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=True))], names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    listed = lambda words: "[" + ", ".join(map(quoted, words)) + "]"
    word = f"'{WORD.pattern}'"
    phrases = ", ".join(f"({quoted(label)}, {listed(phrase.split(' '))})" for phrase, label in PHRASES.items())
    temps = ", ".join(f"({quoted(label)}, {listed(sorted(words))}, {size}, {needed(len(words))})" for label, words, size in templates())
    return rf"""
WITH worded AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), {word}) AS words FROM documents
), places AS (
  SELECT d.row, p.label, i FROM worded AS d, (VALUES {phrases}) AS p(label, phrase), unnest(range(1, len(d.words) - len(p.phrase) + 2)) AS u(i)
  WHERE d.words[i] = p.phrase[1] AND d.words[i:i + len(p.phrase) - 1] = p.phrase
), base AS (
  SELECT row, count(*) AS n, min(i) - 1 AS first_word, max(i) - 1 AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY row
), templates AS (
  SELECT label, template, size, need, row_number() OVER () AS t FROM (VALUES {temps}) AS v(label, template, size, need)
), open AS (
  SELECT d.row, d.words, t.* FROM (SELECT row, words, list_distinct(words) AS own FROM worded) AS d, templates AS t WHERE len(list_intersect(d.own, t.template)) >= t.need
), windows AS (
  SELECT row, t, label, template, size, need, i, list_intersect(words[i:i + size - 1], template) AS have
  FROM (SELECT *, unnest(range(1, greatest(1, len(words) - size + 1) + 1)) AS i FROM open) AS o
), met AS (
  SELECT row, t, label, template, size, i, have, len(have) / len(template) AS part FROM windows WHERE len(have) >= need
), standing AS (
  SELECT row, label, part FROM met AS m WHERE NOT EXISTS (
    SELECT 1 FROM met AS o WHERE o.row = m.row AND o.i < m.i + m.size AND m.i < o.i + o.size
      AND (o.part > m.part OR o.part = m.part AND (len(o.template) > len(m.template) OR len(o.template) = len(m.template) AND o.label > m.label)) AND list_has_all(o.template, m.have))
), every AS (
  SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(part) AS score FROM (
    SELECT row, label, 1.0 AS part FROM places UNION ALL SELECT row, label, part FROM standing) AS z GROUP BY row
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.first_word AS BIGINT) AS first_word, CAST(b.last_word AS BIGINT) AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(e.labels, '') AS labels, CAST(coalesce(e.score, 0) AS DOUBLE) AS score
FROM worded AS d LEFT JOIN base AS b ON b.row = d.row LEFT JOIN every AS e ON e.row = d.row
"""


OP4_SQL = _oracle_sql()
