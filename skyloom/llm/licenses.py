"""Licence scans: an Aho-Corasick pass finds notice phrases and identifier tags, a shunting-yard parser the expressions.

A text becomes its words (letters and digits of ASCII, all other characters beyond it) with single spaces between, as
bytes read as Latin-1; phrases and tags are looked up there with a space at both ends, so a hit is a run of whole words.
Behind a tag such as ``SPDX-License-Identifier:`` the rest of the line is read as an expression of identifiers with
``and``, ``or``, ``with`` and parentheses.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skyloom.llm.common import loaded, map_scored

#: Phrases whose places are counted, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further phrases of licence texts and notices.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "isc license": "isc",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "boost software license": "bsl",
    "the unlicense": "unlicense",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "dedicated to the public domain": "public-domain",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons zero": "cc0",
    "all rights reserved": "reserved",
    "proprietary and confidential": "reserved",
}
#: How free a use each label leaves, from 0 (none) to 1 (any).
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "bsl": 1.0, "zlib": 1.0, "unlicense": 1.0, "cc0": 1.0, "public-domain": 1.0, "cc-by": 0.9,
    "mpl": 0.6, "epl": 0.6, "lgpl": 0.6, "cc-by-sa": 0.4, "gpl": 0.3, "agpl": 0.2, "reserved": 0.1, "other": 0.1,
}
#: A GPL with an exception (for linking) binds no more than its lesser form.
EXCEPTED = 0.6
#: Tags that an expression follows, as words; the third only if the expression names known licences alone.
TAGS = {"spdx license identifier": True, "license expression": True, "license": False}
#: Starts of identifiers, the longest first.
FAMILIES = sorted(["mit", "apache", "bsd", "isc", "bsl", "zlib", "unlicense", "cc0", "cc-by", "cc-by-sa", "mpl", "epl", "lgpl", "gpl", "agpl"], key=len, reverse=True)

#: Upper case to lower case, and all that is no word to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_TOKEN = re.compile(r"[()]|[0-9A-Za-z.:+-]+")
_LINE = re.compile(rb"""["']?[ \t]*[:=][ \t]*["']?([^\r\n"'*,;#<>]*)""")
_BINDS = {"or": 1, "and": 2, "with": 3}


def label_of(identifier: str) -> str:
    """The label of an identifier: its family (``GPL-3.0-or-later``: gpl), else other."""
    name = identifier.lower()
    return next((f for f in FAMILIES if name == f or name.startswith((f + "-", f + "+"))), "other")


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard: the tokens in postfix order, operators in lower case; None if it is no expression.

    ``with`` binds closest, then ``and``, then ``or``; equals group to the left. Time and stack grow with its length.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = True  # whether an operand must come next
    if _TOKEN.sub("", expression).strip():
        return None
    for t in _TOKEN.findall(expression):
        op = t.lower()
        if (op in _BINDS or t == ")") == operand:
            return None
        if t == "(":
            stack.append(t)
        elif t == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif op in _BINDS:
            while stack and _BINDS.get(stack[-1], 0) >= _BINDS[op]:
                out.append(stack.pop())
            stack.append(op)
            operand = True
        else:
            out.append(t)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(expression: str) -> tuple[frozenset[str], float] | None:
    """Labels named by an expression and the freedom it leaves: the most of alternatives, the least of conjunctions.

    ``x with y`` keeps the labels of x alone; both must be one identifier. None if it is no expression.
    """
    tokens = postfix(expression)
    if tokens is None:
        return None
    stack: list[tuple[set[str], float, bool]] = []  # labels, freedom, whether it is one identifier
    for t in tokens:
        if t not in _BINDS:
            stack.append(({label_of(t)}, FREEDOM[label_of(t)], True))
            continue
        b, a = stack.pop(), stack.pop()
        if t == "with":
            if not (a[2] and b[2]):
                return None
            stack.append((a[0], max(a[1], EXCEPTED) if a[0] <= {"gpl", "agpl", "lgpl"} else a[1], False))
        else:
            small, large = sorted((a[0], b[0]), key=len)
            large |= small
            stack.append((large, (min if t == "and" else max)(a[1], b[1]), False))
    return frozenset(stack[0][0]), stack[0][1]


class Scanner:
    """The automaton of all phrases and tags."""

    def __init__(self) -> None:
        found: dict[str, list] = {}
        for phrase in {*BASE, *NOTICES, *TAGS}:
            found[phrase] = [BASE.get(phrase), NOTICES.get(phrase, BASE.get(phrase)), TAGS.get(phrase)]
        self.automaton = ahocorasick.Automaton()
        for phrase, (base, label, strict) in found.items():
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, phrase.count(" ") + 1, base, label, strict))
        self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
        """n_words, n_base, first_word, last_word, base_labels, labels and score of a whole text."""
        words = text.translate(_FOLD).split()
        line = f" {b' '.join(words).decode('latin-1')} "
        hits = [(end + 1 - size, count, base, label, strict) for end, (size, count, base, label, strict) in self.automaton.iter(line)] if words else []
        if not hits:
            return len(words), 0, None, None, "", "", 0.0
        gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        at = np.searchsorted(gaps, [h[0] for h in hits]).tolist()
        places = [i for i, h in zip(at, hits, strict=True) if h[2]]
        base = {h[2] for h in hits if h[2]}
        labels = {h[3] for h in hits if h[3]}
        score = max((FREEDOM[x] for x in labels), default=0.0)
        tags = {i + h[1] - 1: h[4] for i, h in zip(at, hits, strict=True) if h[4] is not None}
        said = [x for x in self.expressions(text, tags) if x]
        if said:  # a stated expression counts before phrases, and all of them hold
            score = min(x[1] for x in said)
            labels = labels.union(*(x[0] for x in said))
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score

    def expressions(self, text: bytes, tags: dict[int, bool]) -> list[tuple[frozenset[str], float] | None]:
        """What stands behind the tags whose last words are given, with whether unknown names may occur in it."""
        out = []
        if tags:
            for i, word in enumerate(_WORD.finditer(text)):
                if i in tags and (m := _LINE.match(text, word.end())):
                    value = evaluate(m[1].decode("latin-1").strip(" \t-./"))
                    if value and (tags[i] or "other" not in value[0]):
                        out.append(value)
        return out


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """Licence findings of every row of ``docs`` over its whole text, in one pass without a shuffle.

    ``n_base`` counts all places of the phrases of ``BASE``, overlaps too; first_word and last_word are the smallest and
    largest first words of such places, null without any. ``labels`` adds those of further notices and of expressions.
    ``score`` is the freedom of use that is stated: of the expressions behind tags, the least; without any, the most
    that a phrase grants; 0 if nothing is found. A malformed expression says nothing.

    Null and empty texts have no words; a null key is kept; repeated rows come out once each; very long texts are
    scanned whole. With ``carry`` each row of ``docs`` comes along as a struct named row, else no other column is read.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        scanner = loaded("licences", Scanner)
        found = [scanner.scan(t) for t in b.column(1).to_pylist()]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0), *columns], names=[key, *(c.split()[0] for c in SCHEMA.split(", "))])

    return map_scored(docs, key, text, carry, f"{key} {docs.schema[key].dataType.simpleString()}, {SCHEMA}", run)
