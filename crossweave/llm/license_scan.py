"""Licence scans: matching statistics against a generalised suffix automaton of licence words, chained into covered template spans.

The automaton holds every run of words of every template. A text is streamed through it; at each word it tells the length of the longest run that
ends there and occurs in some template. Base phrases are counted at the states whose run ends with the phrase. Long matches that can't be extended
are chained where they follow each other in text and template; a template of which a chain covers enough words gives its label.

Licences are told apart by their names: the words of short templates that few families of licences share. A chain must cover a template's names and
numbers, all words of a short template, and no gap in it may hold a name that the template lacks. Of spans that overlap, the better covered one, then the
longer one, gives its label; equally good ones all do.

Null and empty texts have no words and score 0. Equal rows give equal rows; ties between chains go to the earlier one. An empty table gives
an empty result; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.llm.common import binary_text, words

#: Fixed by the contract: phrase and label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Notices and names of public licences.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www.apache.org licenses license-2.0"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3"),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3"),
    ("gpl-or-later", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc0-1.0", "dedicated to the public domain under the cc0 1.0 universal public domain dedication"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("apache-2.0", "apache license version 2.0"),
    ("apache-2.0", "apache license 2.0"),
    ("apache-1.1", "apache license version 1.1"),
    ("mit", "under the terms of the mit license"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("gpl-3.0", "gnu general public license version 3"),
    ("gpl-2.0", "gnu general public license version 2"),
    ("gpl-3.0", "gnu gpl version 3"),
    ("gpl-2.0", "gnu gpl version 2"),
    ("lgpl-3.0", "gnu lesser general public license version 3"),
    ("lgpl-2.1", "gnu lesser general public license version 2.1"),
    ("lgpl-2.0", "gnu library general public license version 2"),
    ("agpl-3.0", "gnu affero general public license version 3"),
    ("gfdl-1.3", "gnu free documentation license version 1.3"),
    ("gpl-or-later", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl-or-later", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-or-later", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version"),
    ("agpl-or-later", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("mpl-2.0", "mozilla public license version 2.0"),
    ("mpl-2.0", "mozilla public license v 2.0"),
    ("epl-2.0", "eclipse public license version 2.0"),
    ("epl-2.0", "eclipse public license v 2.0"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clause", "bsd 3 clause license"),
    ("bsd-2-clause", "bsd 2 clause license"),
    ("cc0-1.0", "creative commons zero 1.0 universal"),
)
#: Identifiers that stand behind "SPDX-License-Identifier:", and their labels.
SPDX = (
    ("apache-2.0", "apache-2.0"), ("mit", "mit"), ("isc", "isc"), ("unlicense", "unlicense"), ("bsd-2-clause", "bsd-2-clause"), ("bsd-3-clause", "bsd-3-clause"),
    ("mpl-2.0", "mpl-2.0"), ("epl-2.0", "epl-2.0"), ("cc0-1.0", "cc0-1.0"),
    ("gpl-2.0", "gpl-2.0"), ("gpl-2.0", "gpl-2.0-only"), ("gpl-or-later", "gpl-2.0-or-later"), ("gpl-3.0", "gpl-3.0"), ("gpl-3.0", "gpl-3.0-only"), ("gpl-or-later", "gpl-3.0-or-later"),
    ("lgpl-2.1", "lgpl-2.1-only"), ("lgpl-or-later", "lgpl-2.1-or-later"), ("lgpl-3.0", "lgpl-3.0-only"), ("lgpl-or-later", "lgpl-3.0-or-later"),
    ("agpl-3.0", "agpl-3.0-only"), ("agpl-or-later", "agpl-3.0-or-later"),
)
#: The elements of Creative Commons licences, and their names in one word and in two.
ELEMENTS = {"by": ("attribution", "attribution"), "nc": ("noncommercial", "non commercial"), "nd": ("noderivatives", "no derivatives"), "sa": ("sharealike", "share alike")}


def _creative_commons() -> list[tuple[str, str]]:
    """All six licences in two versions, by code and by name."""
    out = []
    for code in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"):
        for version in ("4.0", "3.0"):
            names = [" ".join(ELEMENTS[e][i] for e in code.split("-")) for i in (0, 1)]
            forms = [f"licensed under cc {code} {version}", f"cc {code} {version}", *(f"creative commons {n} {version}" for n in dict.fromkeys(names))]
            out += [(f"cc-{code}-{version}", f) for f in forms]
    return out


TEMPLATES = (*NOTICES, *((label, f"spdx license identifier {name}") for label, name in SPDX), *_creative_commons())
SHORT, FAMILIES = 12, 3  # words of a short template; families that share a name at most
LEAST_MATCH, LARGEST_GAP, COVER = 2, 4, 0.75


class Automaton:
    """Generalised suffix automaton of word sequences, with the ends of each state's runs and the base phrases that end there."""

    def __init__(self, base=BASE, templates=TEMPLATES):
        self.labels = [label for _, label in base]
        self.templates = [(label, words(text.encode())) for label, text in templates]
        self._tell_apart()
        self.alphabet: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        phrases = [words(p.encode()) for p, _ in base]
        for t, ws in enumerate([ws for _, ws in self.templates] + phrases):
            last = 0
            for i, w in enumerate(ws):
                last = self._extend(last, self.alphabet.setdefault(w, len(self.alphabet) + 1))
                ends += [set()] * (len(self.next) - len(ends))
                ends[last] = ends[last] | ({(t, i)} if t < len(self.templates) else set())
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            ends[self.link[s]] = ends[self.link[s]] | ends[s]
        self.ends = [sorted(e) for e in ends]
        self.phrases = self._ending(phrases)
        self.whole = self._ending([ws for _, ws in self.templates])

    def _ending(self, phrases: list[list[bytes]]) -> list[list[tuple[int, int]]]:
        """For each state the phrases that its longest run ends with, and their lengths."""
        out: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for k, ws in enumerate(phrases):
            at = 0
            for w in ws:
                at = self.next[at][self.alphabet[w]]
            out[at].append((k, len(ws)))
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            out[s] = out[s] + [p for p in out[self.link[s]] if p not in out[s]]
        return out

    def _tell_apart(self) -> None:
        """The names of licences, and for each template the running number of words that must be covered."""
        families: dict[bytes, set[str]] = {}
        for label, ws in self.templates:
            for w in ws:
                families.setdefault(w, set()).add(label.partition("-")[0])
        short = {w for _, ws in self.templates if len(ws) <= SHORT for w in ws}
        self.names = {w for w in short if len(families[w]) <= FAMILIES and not w.isdigit()}
        self.own = [self.names.intersection(ws) for _, ws in self.templates]
        self.must = [[0, *accumulate(int(len(ws) <= SHORT or w in self.names or w.isdigit()) for w in ws)] for _, ws in self.templates]

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of p's longest run and c: that by c, or a copy of it with shorter runs."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def stream(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length of the longest match that ends there) for each symbol."""
        s, n = 0, 0
        following, link, length = self.next, self.link, self.length
        for c in ids:
            while s and c not in following[s]:
                s = link[s]
                n = length[s]
            s = following[s].get(c, 0)
            n = n + 1 if s else 0
            yield s, n


def chains(matches: list[tuple[int, int, int]], auto: Automaton, ws: list[bytes]) -> dict[int, list[tuple[int, int, int]]]:
    """matches (start, words, state) in words ws, by start -> for each template its chains (first word, last word + 1, template words covered).

    A match goes on from the chain that was changed last of those it follows within LARGEST_GAP words, in text and template, if the gap tells of no other
    licence; words that it shares with the chain, in either, are trimmed off it. A chain that no later match can reach is closed, so that the time is linear
    in the text; one that lacks words that must be covered is dropped then.
    """
    opened: dict[int, list[list[int]]] = {}
    closed: dict[int, list[tuple[int, int, int]]] = {}

    def close(t: int, gone: list[list[int]]) -> None:
        must = auto.must[t]
        closed.setdefault(t, []).extend((a, b, k) for a, b, k, last, first in gone if must[first] == 0 and must[last + 1] == must[-1])

    for start, n, state in matches:
        for t, end in auto.ends[state]:
            mine, must, own = opened.setdefault(t, []), auto.must[t], auto.own[t]
            if mine and start - mine[0][1] > LARGEST_GAP:
                close(t, [c for c in mine if start - c[1] > LARGEST_GAP])
                mine[:] = [c for c in mine if start - c[1] <= LARGEST_GAP]
            first = end - n + 1
            for i in range(len(mine) - 1, -1, -1):
                _, stop, _, last, _ = mine[i]
                trim = max(0, stop - start, last + 1 - first)
                if trim < n and start + trim - stop <= LARGEST_GAP and first + trim - last - 1 <= LARGEST_GAP:
                    if must[first + trim] > must[last + 1] or any(w in auto.names and w not in own for w in ws[stop : start + trim]):
                        continue
                    c = mine.pop(i)
                    c[1], c[2], c[3] = start + n, c[2] + n - trim, end
                    mine.append(c)  # in order of their last words
                    break
            else:
                mine.append([start, start + n, n, end, first])
    for t, mine in opened.items():
        close(t, mine)
    return closed


def best_spans(spans: set[tuple[str, int, int, float, int]]) -> list[tuple[str, int, int, float]]:
    """Of spans (label, first, stop, share, words covered) those that no better one of another label overlaps, by share, then words; by label and place."""
    width = max((b - a for _, a, b, _, _ in spans), default=1)
    near: dict[int, list[tuple[str, int, int, float, int]]] = {}  # kept spans by first word // width, so that only near ones are compared
    for s in sorted(spans, key=lambda s: (-s[3], -s[4], s)):
        others = (o for k in range(s[1] // width - 1, s[2] // width + 1) for o in near.get(k, ()))
        if not any(o[0] != s[0] and o[1] < s[2] and s[1] < o[2] and o[3:] > s[3:] for o in others):
            near.setdefault(s[1] // width, []).append(s)
    return sorted(s[:4] for kept in near.values() for s in kept)


def scan(text: bytes, auto: Automaton) -> dict:
    """n_words, base phrase places (start, phrase), spans (label, first, stop, share of the template)."""
    ws = words(text)
    ids = np.fromiter(map(auto.alphabet.get, ws, repeat(0)), np.int64, len(ws))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).view(np.int8), [0]])))
    places, matches, spans = [], [], set()
    long = edge[1::2] - edge[::2] >= LEAST_MATCH
    for a, b in zip(edge[::2][long].tolist(), edge[1::2][long].tolist(), strict=True):
        was = (0, 0)
        for i, (s, n) in enumerate(auto.stream(ids[a:b].tolist()), a):
            if auto.phrases[s]:
                places += [(i - k + 1, p) for p, k in auto.phrases[s] if k <= n]
            if auto.whole[s]:  # also where a longer run hides it from the chains
                spans.update((auto.templates[t][0], i - k + 1, i + 1, 1.0, k) for t, k in auto.whole[s] if k <= n)
            if n <= was[1] and was[1] >= LEAST_MATCH:
                matches.append((i - was[1], was[1], was[0]))
            was = (s, n)
        if was[1] >= LEAST_MATCH:
            matches.append((b - was[1], was[1], was[0]))
    for t, found in chains(matches, auto, ws).items():
        label, template = auto.templates[t]
        spans.update((label, a, b, k / len(template), k) for a, b, k in found if k >= COVER * len(template))
    return {"n_words": len(ws), "places": sorted(places), "spans": best_spans(spans)}


OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,stop:long,covered:double>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, templates=TEMPLATES) -> DataFrame:
    auto = Automaton(base, templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("covered", pa.float64())]))
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for text in batch.column("body"):
                r = scan(text.as_py(), auto)
                named = sorted({auto.labels[p] for _, p in r["places"]})
                labels = sorted({*named, *(s[0] for s in r["spans"])})
                best = 1.0 if named else max((min(1.0, s[3]) for s in r["spans"]), default=0.0)
                first, last = (r["places"][0][0], r["places"][-1][0]) if r["places"] else (None, None)
                spans = [{"label": a, "start": b, "stop": c, "covered": d} for a, b, c, d in r["spans"]]
                for col, x in zip(cols, (r["n_words"], len(r["places"]), first, last, ",".join(named), ",".join(labels), best, spans), strict=True):
                    col.append(x)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), kind]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [f.split()[0] for f in OUT.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), binary_text(text_col).alias("body")).mapInArrow(run, OUT)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_license_scan": op3_license_scan}
ORACLE_SQL: dict[str, str] = {}
