"""License scans: phrases that stand word by word, and an exact set-similarity join of text blocks with license templates.

Method. A template is a set of words; a block is as many consecutive words of a document as the template has, a quarter more allowed, at any
place. Every block that holds at least `THRESHOLD` of a template's different words is found:
- words of all templates are put in one order by their frequency in all documents, rarest first (ties by the word);
- prefix filter: a block that holds `need` of a template's t words holds one of its t - need + 1 rarest. These prefixes are one index from word to
  templates, which the words of a document are joined with: a template without a hit costs nothing;
- length filter: a document, then each stretch of blocks around its hits, must hold `need` different words of the template at all;
- positional filter: with the rarest word that a stretch holds at position p of the template, t - p of its words are all that can be there;
- blocks of the stretches that are left are counted exactly, all places at once.

Templates that nearly hold each other are told apart by the words that differ: a block must hold a word of the template that is not in the other if
the other's text would do for it, and no word by which a larger template goes beyond it.

Scale. The join's inner side is the templates' index, a parameter: its words are sent to all tasks (`WORDS` of them at most, else an error), the documents are read
where they are. Only the words' counts are collected.

Defined results: a null text is an empty one, without words; first and last places are null where no phrase stands; a document shorter than
a block is one block; repeated rows and null ids are rows like others; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.llm import common

#: Phrases and their labels (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Characteristic sentences of public licenses, by label (fixed values).
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2": "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd-3": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-nc-sa": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
}
THRESHOLD = 0.8
#: Words of a block for each word of the template.
STRETCH = 1.25
#: Words of all templates together, at most.
WORDS = 1_000_000
#: Lower case for A-Z; all that isn't a word's byte is a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_line(text: str | None) -> bytes:
    """The words, a space before, between and after."""
    parts = [b" ".join(w) for w in common.word_chunks((text or "").encode().translate(_TABLE))]
    return b" " + b" ".join(p for p in parts if p) + b" " if any(parts) else b" "


def places(line: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase stands, overlaps included."""
    found, at, number, seen = [], -1, 0, 0
    needle = b" " + phrase + b" "
    while (at := line.find(needle, at + 1)) >= 0:
        number += line.count(b" ", seen, at)
        seen = at
        found.append(number)
    return found


class Template:
    """One template: its words in the global order, and the sizes and words that blocks must have."""

    def __init__(self, label: str, text: str, order: Mapping[bytes, int], threshold: float):
        words = words_line(text).split()
        self.label, self.words = label, sorted(set(words), key=order.__getitem__)
        self.need = max(1, math.ceil(threshold * len(self.words) - 1e-9))
        self.block = math.ceil(STRETCH * len(words))
        #: sets of words of which a block must hold one, and words that it must not hold
        self.own: list[set[bytes]] = []
        self.foreign: set[bytes] = set()

    def told_apart(self, others: list[Template]) -> None:
        mine = set(self.words)
        for other in others:
            theirs = set(other.words)
            if other is not self and mine != theirs and len(mine & theirs) >= self.need:
                if mine < theirs:
                    self.foreign |= theirs - mine
                elif mine - theirs:
                    self.own.append(mine - theirs)

    def best(self, at: np.ndarray, kind: np.ndarray, foreign: np.ndarray, n: int) -> float:
        """Greatest share of the words that a block holds, 0 if under the threshold.

        at: places of the template's words among the n of a document; kind: their positions in the order; foreign: places of foreign words."""
        size, most = min(self.block, n), 0
        hits = at[kind <= len(self.words) - self.need]
        if not len(hits) or len(np.unique(kind)) < self.need:
            return 0.0
        # stretches of blocks that hold a hit: from size - 1 words before to as many after
        parts = np.split(hits, np.flatnonzero(np.diff(hits) >= 2 * size) + 1)
        for part in parts:
            lo, hi = max(0, part[0] - size + 1), min(n, part[-1] + size)
            inside = slice(*np.searchsorted(at, (lo, hi)))
            kinds = np.unique(kind[inside])
            # of the words from the rarest one on, as many as there are can be held
            if len(kinds) < self.need or len(self.words) - kinds[0] < self.need:
                continue
            starts = np.arange(lo, max(lo, hi - size) + 1)
            ok, held = np.ones(len(starts), bool), self._covered(at[inside], kind[inside], kinds, lo, size, len(starts)).sum(0)
            for own in self.own:
                which = [k for k, w in enumerate(self.words) if w in own]
                ok &= self._covered(at[inside], kind[inside], which, lo, size, len(starts)).any(0)
            for place in foreign[slice(*np.searchsorted(foreign, (lo, hi)))].tolist():
                ok[max(0, place - size + 1 - lo) : place - lo + 1] = False
            most = max(most, int(held[ok].max(initial=0)))
        return most / len(self.words) if most >= self.need else 0.0

    @staticmethod
    def _covered(at: np.ndarray, kind: np.ndarray, kinds, lo: int, size: int, n: int) -> np.ndarray:
        """For each of the kinds and each of n blocks from lo on, whether the block holds it."""
        steps = np.zeros((len(kinds), n + 1), np.int32)
        for row, k in zip(steps, kinds):
            own = at[kind == k] - lo
            np.add.at(row, np.clip(own - size + 1, 0, n), 1)
            np.add.at(row, np.clip(own + 1, 0, n), -1)
        return np.cumsum(steps, 1)[:, :n] > 0


class Index:
    """All templates: which words of a document they know, and which templates a word of their prefixes leads to."""

    def __init__(self, templates: Mapping[str, str], order: Mapping[bytes, int], threshold: float):
        self.templates = [Template(label, text, order, threshold) for label, text in templates.items()]
        for t in self.templates:
            t.told_apart(self.templates)
        self.ids = {w: k for k, w in enumerate(sorted({w for t in self.templates for w in t.words}))}
        self.leads: dict[int, list[int]] = {}
        self.position = np.full((len(self.templates), len(self.ids)), -1, np.int32)
        self.foreign = np.zeros((len(self.templates), len(self.ids)), bool)
        for number, t in enumerate(self.templates):
            for k, w in enumerate(t.words):
                self.position[number, self.ids[w]] = k
                if k <= len(t.words) - t.need:
                    self.leads.setdefault(self.ids[w], []).append(number)
            self.foreign[number, [self.ids[w] for w in t.foreign]] = True

    def matches(self, words: list[bytes]) -> list[tuple[str, float]]:
        """Label and share of each template that a block of the words holds."""
        get = self.ids.get
        known = [(k, i) for k, w in enumerate(words) if (i := get(w)) is not None]
        if not known:
            return []
        at, ids = np.array(known).T
        out = []
        for number in sorted({n for i in set(ids.tolist()) for n in self.leads.get(i, ())}):
            t, place = self.templates[number], self.position[number][ids]
            held = place >= 0
            if held.sum() >= t.need and (share := t.best(at[held], place[held], at[self.foreign[number][ids]], len(words))):
                out.append((t.label, share))
        return out


def word_order(docs: DataFrame, templates: Mapping[str, str], text: str = "text") -> dict[bytes, int]:
    """Place of each template word by its frequency in all documents."""
    known = sorted({w for t in templates.values() for w in words_line(t).split()})
    if len(known) > WORDS:
        raise ValueError(f"templates have {len(known)} words, {WORDS} are the most that are sent to all tasks")

    def run(batches):
        import pyarrow as pa

        counts = dict.fromkeys(known, 0)
        for batch in batches:
            for t in batch.column("text").to_pylist():
                for w in words_line(t).split():
                    if w in counts:
                        counts[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(known)), pa.int32()), pa.array(counts.values(), pa.int64())], names=["k", "n"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    counts = {known[r["k"]]: r["n"] for r in found}
    return {w: k for k, w in enumerate(sorted(known, key=lambda w: (counts.get(w, 0), w)))}


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row.

    score is 1 where a phrase stands, else the greatest share of a template's words that a block holds, 0 under the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates, word_order(docs, templates, text), threshold))
    needles = [(p.encode(), label) for p, label in phrases.items()]

    def make():
        index = shared.value

        def rows(texts):
            out = []
            for t in texts:
                line, at, base = words_line(t), [], set()
                for phrase, label in needles:
                    if found := places(line, phrase):
                        at += found
                        base.add(label)
                found = index.matches(line.split())
                score = max([float(bool(base)), *(share for _, share in found)])
                labels = base | {label for label, _ in found}
                out.append((line.count(b" ") - 1, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
            return zip(*out)

        return rows

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return common.mapped(slim, make, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
