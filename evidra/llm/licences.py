"""Licence scan: a generalised suffix automaton of licence tokens gives each text's matching statistics; long matches
are chained into spans that cover a licence's template.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of all characters from U+0080. Null and empty texts
have no words, no labels and score 0. Rows are judged one by one: repeated rows have equal results, an empty table
gives an empty result and extra columns don't matter. A text of any length is read once, word by word."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evidra.llm.common import id_text, map_batches, session

#: Matches of fewer words don't count.
MIN_MATCH = 4
#: Matches of one template that lie further apart than this many words of the text aren't chained.
MAX_GAP = 40
#: Share of a template's words that a chain covers, for its label.
MIN_COVER = 0.7

#: Phrases whose words stand consecutively, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Wording of common licence notices, by label.
TEMPLATES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "released under the mit license",
        "licensed under the mit license",
    ],
    "apache": [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "licensed under the apache license version 2 0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "this work is licensed under the gnu general public license version 3",
        "you should have received a copy of the gnu general public license along with this program",
    ],
    "lgpl": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"],
    "cc-by": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences. Each state stands for the sequences' parts that end at the same
    places; ends[state] has one such place for each sequence (as its index after the last word)."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [{}]
        for words in sequences:
            last = 0
            for w in words:
                last = self._extend(last, w)
        for k, words in enumerate(sequences):  # each sequence's prefixes reach the states that occur in it
            state = 0
            for end, w in enumerate(words, 1):
                state = at = self.next[state][w]
                while at > 0 and k not in self.ends[at]:
                    self.ends[at][k] = end
                    at = self.link[at]

    def _state(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt), self.link.append(link), self.length.append(length), self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:  # an earlier sequence has it
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def matches(self, words: list[int], least: int) -> list[tuple[int, int, int]]:
        """(end, length, state) of each longest match that the next word doesn't extend, of `least` words or more."""
        out, state, n, nxt, link, length = [], 0, 0, self.next, self.link, self.length
        for i, w in enumerate(words):
            if w not in nxt[state]:
                if n >= least:
                    out.append((i, n, state))
                while state > 0 and w not in nxt[state]:
                    state = link[state]
                    n = length[state]
                if w not in nxt[state]:
                    n = 0
                    continue
            state = nxt[state][w]
            n += 1
        if n >= least:
            out.append((len(words), n, state))
        return out

    def reached(self, state: int, n: int) -> int:
        """The state of the match's last n words."""
        while state > 0 and self.length[self.link[state]] >= n:
            state = self.link[state]
        return state


@cache
def index() -> tuple[dict[bytes, int], Automaton, list[tuple[str, int]]]:
    """Word numbers from 1, the automaton, and each template's label and length."""
    vocabulary: dict[bytes, int] = {}
    sequences, templates = [], []
    for label, texts in TEMPLATES.items():
        for t in texts:
            words = t.encode().split()
            sequences.append([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words])
            templates.append((label, len(words)))
    return vocabulary, Automaton(sequences), templates


def spans(words: list[bytes]) -> list[tuple[int, int, int, float]]:
    """(template, first word, end word, share of the template covered) of each chain of matches."""
    vocabulary, automaton, templates = index()
    get = vocabulary.get
    ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
    edge = np.diff(np.concatenate(([0], ids > 0, [0])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= MIN_MATCH  # no match goes across an unknown word
    if not long.any():
        return []
    open_: dict[int, list[int]] = {}  # template: first word, end word, end in the template, words covered
    out = []

    def close(k: int) -> None:
        first, end, _, covered = open_.pop(k)
        out.append((k, first, end, covered / templates[k][1]))

    for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        for end, n, state in automaton.matches(ids[a:b].tolist(), MIN_MATCH):
            for k, at in automaton.ends[state].items():
                last = a + end
                if k in open_:
                    _, end_before, at_before, _ = open_[k]
                    fresh = min(n, at - at_before, last - end_before)  # overlapping words count once
                    if fresh > 0 and last - n - end_before <= MAX_GAP:
                        open_[k][1:] = [last, at, open_[k][3] + fresh]
                        continue
                    close(k)
                open_[k] = [last - n, last, at, n]
    for k in list(open_):
        close(k)
    return out


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of each place of a fixed phrase."""
    out = []
    for phrase, label in PHRASES.items():
        parts = phrase.encode().split()
        n, at = len(parts), -1
        while True:
            try:
                at = words.index(parts[0], at + 1)
            except ValueError:
                break
            if words[at : at + n] == parts:
                out.append((at, label))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (largest share of a template that one
    chain covers) and template_spans, "label:first word:end word" of the chains that give labels."""
    session(docs.sparkSession)

    def scanned(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        templates = index()[2]
        for text in batch.column(1).to_pylist():
            words = words_of(text)
            base = base_places(words)
            found = spans(words)
            good = sorted({(first, end, templates[k][0]) for k, first, end, share in found if share >= MIN_COVER})
            base_labels = {x for _, x in base}
            rows.append((len(words), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None), ",".join(sorted(base_labels)), ",".join(sorted(base_labels | {x for *_, x in good})), min(1.0, max((s for *_, s in found), default=0.0)), ",".join(f"{x}:{a}:{b}" for a, b, x in good)))
        kinds = (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.float64(), pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "template_spans"])

    return map_batches(id_text(docs), scanned, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, template_spans string")
