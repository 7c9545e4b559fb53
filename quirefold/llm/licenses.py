"""License scan: a generalised suffix automaton of license words gives matching statistics; long matches are chained."""
import pkgutil
import re

import pandas as pd
from pyspark.sql import DataFrame

from .common import small_batches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
# Base phrases with their labels.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
# Licenses with a file of their whole text in license_texts, by label.
TEXTS = {"mit": ["mit"], "apache": ["apache"], "gpl": ["gpl-2", "gpl-3"], "lgpl": ["lgpl-2.1", "lgpl-3"], "mpl": ["mpl"], "bsd": ["bsd"], "isc": ["isc"], "cc0": ["cc0"]}
# Parts of the names of the Creative Commons licenses.
CC = {"cc-by": "", "cc-by-sa": "sharealike", "cc-by-nd": "noderivatives", "cc-by-nc": "noncommercial", "cc-by-nc-sa": "noncommercial sharealike", "cc-by-nc-nd": "noncommercial noderivatives"}
# Names that short notices use; where one name holds another, the longer one counts.
NAMES = {"isc": ["isc license"], "bsd": ["bsd license", "bsd 2 clause", "bsd 3 clause"], "mpl": ["mozilla public license", "mpl 1 1", "mpl 2 0"], "apache": ["apache 2 0", "apache license"], "mit": ["mit license"],
         "gpl": ["general public license", "gplv2", "gplv3", "gpl 2 0", "gpl 3 0"], "lgpl": ["lesser general public license", "library general public license", "lgplv2", "lgplv2 1", "lgplv3", "lgpl 2 1", "lgpl 3 0"], "cc0": ["cc0", "creative commons zero", "cc0 1 0"]}
SPELLED = {"": [""], "sharealike": ["sharealike", "share alike"], "noderivatives": ["noderivatives", "no derivatives", "noderivs"], "noncommercial": ["noncommercial", "non commercial"]}
for _label, _parts in CC.items():
    _first, _second = [SPELLED[x] for x in (_parts.split() + ["", ""])[:2]]
    NAMES[_label] = [" ".join(f"creative commons attribution {x} {y}".split()) for x in _first for y in _second] + ["creative commons " + _label[3:].replace("-", " ")]
    # The bare letters 'cc by' also begin notes on copies of letters.
    NAMES[_label] += [_label.replace("-", " ")] if _parts else [f"cc by {v}" for v in ("1 0", "2 0", "2 5", "3 0", "4 0", "license")]
NOTICES = {tuple(x.split()): k for k, names in NAMES.items() for x in names}


def passages(text: str, least: int = 12) -> list[str]:
    """Words of each paragraph of a text; shorter ones, as headings, go with the next."""
    out, held = [], []
    for paragraph in re.split(r"\n\s*\n", text):
        held += WORD.findall(paragraph.translate(UPPER))
        if len(held) >= least:
            out.append(" ".join(held))
            held = []
    if held:
        out[-1:] = [" ".join([*out[-1:], *held])]
    return out


# Opening sentences that notices use, then every passage of the whole texts, as label/number.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "apache": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    **{k: " ".join(f"this work is licensed under a creative commons attribution {v} 4 0 international license".split()) for k, v in CC.items()},
}
for _label, _files in TEXTS.items():
    _all = [p for f in _files for p in passages(pkgutil.get_data(__package__, f"license_texts/{f}.txt").decode())]
    TEMPLATES |= {f"{_label}/{i}": p for i, p in enumerate(dict.fromkeys(_all))}


class SuffixAutomaton:
    """All factors of several word sequences; matching statistics come from one walk over a text."""

    def __init__(self, sequences):
        self.next, self.link, self.length = [{}], [-1], [0]
        for words in sequences:
            last = 0
            for w in words:
                last = self._extend(last, w)

    def _state(self, length, link, following):
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p, q, w):
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last, w):
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def maximal(self, words, least=2):
        """(start, end) of matches of at least that many words that can't be extended to the right."""
        state = size = 0
        follow, link, length = self.next, self.link, self.length
        known = set(follow[0])
        for i, w in enumerate(words):
            if size == 0 and w not in known:
                continue
            if w not in follow[state]:
                if size >= least:
                    yield i - size, i
                while state and w not in follow[state]:
                    state = link[state]
                    size = length[state]
                if w not in follow[state]:
                    size = 0
                    continue
            state, size = follow[state][w], size + 1
        if size >= least:
            yield len(words) - size, len(words)


def seeds(templates: dict[str, list[str]], size: int) -> dict[tuple, list]:
    """By ``size`` words in a row, the (template, place) pairs where they stand."""
    out = {}
    for label, words in templates.items():
        for p in range(len(words) - size + 1):
            out.setdefault(tuple(words[p:p + size]), []).append((label, p))
    return out


def aligned(words, long, index, size) -> dict[str, list]:
    """By template the (text from, text to, template from) of equal runs inside the long matches, in order of the text."""
    out, open_runs = {}, {}
    for a, b in long:
        for i in range(a, b - size + 1):
            for label, p in index.get(tuple(words[i:i + size]), ()):
                run = open_runs.get((label, p - i))
                if run is not None and run[1] >= i:
                    run[1] = max(run[1], i + size)
                else:
                    open_runs[label, p - i] = run = [i, i + size, p]
                    out.setdefault(label, []).append(run)
    return {label: sorted(runs) for label, runs in out.items()}


def chained(runs: list, gap: int) -> int:
    """Most template words that one chain of runs covers: text and template both go on, with at most ``gap`` words of text between."""
    best, tail = 0, []
    for a, b, p in runs:
        tail = [t for t in tail if a - t[0] <= gap]
        covered = max([b - a, *(n + min(b - a, b - end, p + b - a - place) for end, place, n in tail if b > end and p + b - a > place)])
        tail.append((b, p + b - a, covered))
        best = max(best, covered)
    return best


def scan(words, automaton, templates, phrases=PHRASES, long_match=5, gap=3, covered=0.6, notices=NOTICES, index=None):
    """Phrases, labels and score; matches of long_match words on are chained in order of the template, a short notice counts as a whole."""
    base, long, found = set(), [], set()
    first = {p[0] for known in (phrases, notices) for p in known}
    for a, b in automaton.maximal(words, 1):
        for i in range(a, b):
            if words[i] in first:
                base |= {(i, label) for p, label in phrases.items() if i + len(p) <= b and tuple(words[i:i + len(p)]) == p}
                found |= {(i, -len(p), label) for p, label in notices.items() if i + len(p) <= b and tuple(words[i:i + len(p)]) == p}
        if b - a >= long_match:
            long.append((a, b))
    base, named, end = sorted(base), set(), 0
    for i, n, label in sorted(found):
        if i - n > end:
            named.add(label)
            end = i - n
    index = seeds(templates, long_match) if index is None else index
    best = {label: chained(runs, gap) / len(templates[label]) for label, runs in aligned(words, long, index, long_match).items()} if long else {}
    # The sentences of Creative Commons differ in the name alone, so the name decides.
    labels = {x for _, x in base} | named | {x.split("/")[0] for x, s in best.items() if s >= covered and x not in CC}
    return base, labels, 1.0 if base or named else min(1.0, max(best.values(), default=0.0))


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """License phrases and covered template spans of each whole text (null: empty).

    Every row gives one row; texts without words have zero counts and null places; repeated rows stay; an empty table
    gives an empty result; other columns are ignored. A task holds one text's words at a time.
    """
    def run(batches):
        split = {k: v.split() for k, v in templates.items()}
        automaton, index = SuffixAutomaton([*PHRASES, *NOTICES, *split.values()]), seeds(split, 5)
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                words = WORD.findall((text or "").translate(UPPER))
                base, labels, score = scan(words, automaton, split, index=index)
                rows.append((doc_id, len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None,
                             ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), float(score)))
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "first_word": "Int64", "last_word": "Int64"})
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    names = [x.split()[0] for x in schema.split(", ")]
    return small_batches(docs.select("doc_id", "text")).mapInPandas(run, schema)
