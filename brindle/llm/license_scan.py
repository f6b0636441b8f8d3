"""Licence scans: matching statistics against a generalised suffix automaton of licence words, chained into spans."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._staging import bound_batches
from ._words import rows

#: The phrases that every scan counts, and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: The opening passages and usual notices of public licences, by SPDX-like label.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "Licensed under the GNU General Public License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3.0", "You should have received a copy of the GNU Affero General Public License along with this program"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
)

#: A-Z to a-z; bytes that belong to no word to a blank.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 48 or 58 <= b <= 96 or 123 <= b <= 127 else b for b in range(256))


def licence_words(text: str | None) -> list[bytes]:
    """Runs of 0-9, a-z (A-Z lower-cased) and characters beyond ASCII."""
    return text.encode().translate(_CLEAN).split() if text else []


@dataclass
class Automaton:
    """Suffix automaton of several word sequences; a state stands for all factors with the same end places."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.step) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, sequence: list[int], name: int) -> None:
        last = 0
        for at, c in enumerate(sequence):
            if c in self.step[last]:  # a prefix that another sequence has already
                q = self.step[last][c]
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
            else:
                new = self._state(self.length[last] + 1, {}, 0)
                p = last
                while p >= 0 and c not in self.step[p]:
                    self.step[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.step[p][c]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
                last = new
            self.ends[last].append((name, at))

    def close(self) -> None:
        """Hands end places up the suffix links, longest states first."""
        for s in sorted(range(1, len(self.step)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.ends[self.link[s]] = sorted({*self.ends[self.link[s]], *self.ends[s]})


class Scanner:
    """Phrases and templates as one automaton; scan() gives a text's phrase places and template spans."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES, least: int = 4, gap: int = 6, cover: float = 0.8):
        self.phrases = [(licence_words(t), label) for t, label in phrases]
        self.templates = [(licence_words(t), label) for label, t in templates]
        self.least, self.gap, self.cover = least, gap, cover
        self.ids: dict[bytes, int] = {}
        machine = Automaton()
        for k, (words, _) in enumerate([*self.phrases, *self.templates]):
            machine.add([self.ids.setdefault(w, len(self.ids)) for w in words], k)
        machine.close()
        self.machine = machine
        #: for each state, the phrases that its longest factor ends with: (phrase, words of the phrase)
        self.ending: list[list[tuple[int, int]]] = [[] for _ in machine.step]
        for k, (words, _) in enumerate(self.phrases):
            state = 0
            for w in words:
                state = machine.step[state][self.ids[w]]
            self.ending[state].append((k, len(words)))
        for state in sorted(range(1, len(machine.step)), key=machine.length.__getitem__):
            self.ending[state] = self.ending[state] + self.ending[machine.link[state]]

    def _statistics(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place, state, length of the longest factor that ends there) where at least two known words stand together."""
        step, link, longest = self.machine.step, self.machine.link, self.machine.length
        known = ids >= 0
        pair = known[:-1] & known[1:]
        busy = np.flatnonzero(np.concatenate((pair, [False])) | np.concatenate(([False], pair)))
        before, state, length = -2, 0, 0
        for at, c in zip(busy.tolist(), ids[busy].tolist(), strict=True):
            if at != before + 1:
                state, length = 0, 0
            while state and c not in step[state]:
                state = link[state]
                length = longest[state]
            if c in step[state]:
                state, length = step[state][c], length + 1
            before = at
            yield at, state, length

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, float]]]:
        """Words of the text, places of phrases (start, label), spans of templates (start, end, label, share covered)."""
        words = licence_words(text)
        if len(words) < 2:
            return len(words), [], []
        get = self.ids.get
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int32, count=len(words))
        base, matches = [], {}
        held = None  # the last place's match, until it's known whether the next one extends it
        for at, state, length in self._statistics(ids):
            for k, size in self.ending[state]:
                if length >= size:
                    base.append((at - size + 1, self.phrases[k][1]))
            if held and not (at == held[0] + 1 and length == held[2] + 1):
                self._note(matches, *held)
            held = (at, state, length)
        if held:
            self._note(matches, *held)
        return len(words), base, sorted(s for k, found in matches.items() for s in self._chains(k, found))

    def _note(self, matches: dict, at: int, state: int, length: int) -> None:
        for k, end in self.machine.ends[state]:
            whole = len(self.templates[k - len(self.phrases)][0]) if k >= len(self.phrases) else 0
            if whole and length >= min(self.least, whole):
                matches.setdefault(k, []).append((at - length + 1, end - length + 1, length))

    def _chains(self, k: int, found: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
        """Runs of matches that go forward in text and template with gaps of at most `gap` words, best first, each of
        the matches outside those before it, as long as they cover `cover` of the template."""
        words, label = self.templates[k - len(self.phrases)]
        found.sort()
        out, parts = [], [found]
        while parts:
            part = parts.pop()
            score, start, end = self._chain(len(words), part)
            share = min(1.0, score / len(words))
            if share >= self.cover:
                out.append((start, end, label, share))
                parts += [p for p in ([m for m in part if m[0] + m[2] <= start], [m for m in part if m[0] >= end]) if p]
        return out

    def _chain(self, whole: int, found: list[tuple[int, int, int]]) -> tuple[int, int, int]:
        """Words covered, start and end in the text of the best run of sorted matches."""
        best: list[tuple[int, int]] = []  # words covered, start in the text
        # a match further back than a gap and the longest match can't reach this one
        reach = self.gap + whole // 8 + max(n for _, _, n in found)
        for i, (x, y, n) in enumerate(found):
            here = (n, x)
            for j in range(i - 1, -1, -1):
                px, py, pn = found[j]
                if x - px > reach:
                    break
                dx, dy = x - (px + pn), y - (py + pn)
                over = max(0, -dx, -dy)
                if x > px and y > py and over < n and max(dx, dy) <= self.gap + whole // 8:
                    here = max(here, (best[j][0] + n - over, best[j][1]), key=lambda v: v[0])
            best.append(here)
        most = max(n for n, _ in best)
        ties = [i for i, (n, _) in enumerate(best) if n == most]
        # of equal ones the middle one, so that many copies are halved and not taken off one by one; of overlapping ones the first
        t = len(ties) // 2
        while t and found[ties[t - 1]][0] + found[ties[t - 1]][2] > best[ties[t]][1]:
            t -= 1
        i = ties[t]
        return best[i][0], best[i][1], found[i][0] + found[i][2]


SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def scan_licenses(docs: DataFrame, least: int = 4, gap: int = 6, cover: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    A text's words stream through the automaton once. Each place gives the longest licence factor that ends there;
    where it ends a phrase, the phrase counts. Maximal factors of `least` words (or whole shorter templates) are
    chained per template, forward in both, and every chain outside better ones that covers `cover` of the template is a span (start and end
    word, label). score is 1 for a text with a phrase, else the greatest share of a template that a span covers, else 0.

    Null and empty texts have no words. Rows are scanned one by one, so repeated rows, clashing extra columns and
    texts of any length need nothing shared, and there is no shuffle. An empty table gives no rows.
    """

    bound_batches(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(least=least, gap=gap, cover=cover)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
        names = [c.split()[0] for c in SCANNED.split(", ")]
        for part in rows(batches, "doc_id", "text"):
            out = []
            for doc_id, text in part:
                n, base, spans = scanner.scan(text)
                starts, own = [s for s, _ in base], sorted({x for _, x in base})
                every = sorted({*own, *(s[2] for s in spans)})
                score = 1.0 if base else max((s[3] for s in spans), default=0.0)
                out.append((doc_id, n, len(base), min(starts, default=None), max(starts, default=None), ",".join(own), ",".join(every), score, ",".join(f"{label}:{a}:{b}" for a, b, label, _ in spans)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCANNED).withColumnRenamed("doc_id", id_col)
