"""License scans: an Aho-Corasick automaton finds identifier tags and notice phrases, a shunting-yard
parser reads the expressions behind the tags and evaluates and/or/with.

Texts are lower-cased (A-Z alone); words are runs of digits, a-z and characters above U+007F. A phrase
is found where its words stand consecutively, so places may overlap. Null text is empty text: no words,
no places, empty labels, score 0. Repeated rows give equal values, a table without rows gives none, and
other columns are ignored. A very long text is scanned in one go, in time that follows its length. A tag is
found by its words and followed by : or = and an expression on the same line, of which the longest part that
can be read counts; one that cannot be read at all gives the label `spdx-invalid`.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, renamed

#: Phrases and labels of the base contract, fixed values.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notice phrases of the scan itself, fixed values: words and label.
NOTICES = {
    "released under the mit license": "notice-mit",
    "permission is hereby granted free of charge": "notice-mit",
    "licensed under the apache license": "notice-apache",
    "gnu general public license version 2": "notice-gpl-2",
    "gnu general public license version 3": "notice-gpl-3",
    "gnu lesser general public license": "notice-lgpl",
    "gnu affero general public license": "notice-agpl",
    "mozilla public license": "notice-mpl",
    "eclipse public license": "notice-epl",
    "redistribution and use in source and binary forms": "notice-bsd",
    "licensed under cc by": "notice-cc",
    "creative commons attribution": "notice-cc",
    "creative commons zero": "notice-cc0",
    "this is free and unencumbered software": "notice-unlicense",
    "all rights reserved": "notice-reserved",
}
#: Words of the tags that an expression follows, fixed values.
TAGS = ("spdx license identifier", "license expression")
#: How free the use of a work under a licence is, 0 to 1, by family (the start of an identifier), fixed values.
FREEDOM = {
    "0bsd": 1.0, "afl": 1.0, "agpl": 0.1, "apache": 1.0, "artistic": 0.6, "bsd": 1.0, "bsl": 1.0, "cc-by-nc": 0.1, "cc-by-nd": 0.1, "cc-by-sa": 0.4, "cc-by": 0.9, "cc0": 1.0,
    "cddl": 0.6, "epl": 0.6, "eupl": 0.6, "gpl": 0.2, "isc": 1.0, "lgpl": 0.5, "mit": 1.0, "mpl": 0.6, "ncsa": 1.0, "ofl": 0.9, "postgresql": 1.0, "psf": 1.0, "unlicense": 1.0, "wtfpl": 1.0, "zlib": 1.0,
}
#: What an exception behind `with` adds, at most 1.
EXCEPTION = 0.3
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
SEPARATORS = bytes.maketrans(bytes(range(256)), bytes(0x20 if c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
TOKEN = re.compile(rb"[ \t\x0b\x0c]*(\(|\)|[a-z0-9][a-z0-9.\-]*\+?)", re.I)
#: What stands between a tag and its expression.
ASSIGNED = re.compile(rb"[ \t]*[:=]")


class ExpressionError(ValueError):
    pass


def longest(tokens: Iterable[str]) -> tuple[list[str], bool]:
    """Postfix form of the longest expression that the tokens begin with, and whether it is all of them.

    Shunting yard: operands go out at once, operators wait on a stack by precedence. Where no bracket
    is open the stack holds one operator of each precedence at most, so the last complete state is kept.
    """
    out: list[str] = []
    stack: list[str] = []
    depth, operand, plain, kept, whole = 0, False, False, (0, []), False
    for t in tokens:
        low, whole = t.lower(), False
        if t == "(":
            if operand or stack[-1:] == ["with"]:
                break
            stack.append(t)
            depth += 1
        elif t == ")":
            if not operand or not depth:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth, plain = depth - 1, False
        elif low in PRECEDENCE:
            if not operand or low == "with" and not plain:
                break
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = False
        else:
            if operand:
                break
            out.append(low)
            operand, plain = True, stack[-1:] != ["with"]
        if operand and not depth:
            kept, whole = (len(out), stack[::-1]), True
    return out[: kept[0]] + kept[1], whole


def to_postfix(tokens: list[str]) -> list[str]:
    """Postfix form of an expression; fails unless the tokens are one."""
    out, whole = longest(tokens)
    if not whole:
        raise ExpressionError("no expression")
    return out


def freedom(identifier: str) -> float:
    """By the longest family that the identifier begins with; 0 for an unknown licence."""
    return max(((len(f), v) for f, v in FREEDOM.items() if identifier.startswith(f)), default=(0, 0.0))[1]


def evaluate(postfix: list[str]) -> tuple[float, list[str]]:
    """Freedom of an expression and its licences: or gives the choice, and binds to both, with eases."""
    stack: list[tuple[float, int]] = []  # value, place of the operand if it is one
    licences: dict[int, str] = {}
    for i, t in enumerate(postfix):
        if t not in PRECEDENCE:
            licences[i] = t
            stack.append((freedom(t.rstrip("+")), i))
            continue
        (b, exception), (a, licence) = stack.pop(), stack.pop()
        if t == "with":
            if exception < 0 or licence < 0:
                raise ExpressionError("with stands between a licence and an exception")
            del licences[exception]
        stack.append((min(1.0, a + EXCEPTION) if t == "with" else max(a, b) if t == "or" else min(a, b), -1))
    return stack[0][0], list(dict.fromkeys(licences.values()))


def tokens_at(text: bytes, at: int) -> Iterator[str]:
    while m := TOKEN.match(text, at):
        yield m[1].decode("ascii") if m[1] in b"()" else m[1].decode("ascii").rstrip(".")
        at = m.end()


def read_expression(text: bytes, at: int = 0) -> tuple[float, list[str], str] | None:
    """Freedom, licences and postfix form of the longest expression that begins at a place of its line, or None."""
    postfix, _ = longest(tokens_at(text, at))
    return (*evaluate(postfix), " ".join(postfix)) if postfix else None


class Scanner:
    def __init__(self) -> None:
        import ahocorasick

        self.found = ahocorasick.Automaton()
        both: dict[str, list[tuple[str, str]]] = {}
        for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", dict.fromkeys(TAGS, ""))):
            for words, label in phrases.items():
                both.setdefault(f" {words} ", []).append((kind, label))
        for words, what in both.items():
            self.found.add_word(words, (words.count(" ") - 1, what))
        self.found.make_automaton()

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, str, str, float, float | None, str]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, freedom of the expressions, their postfix forms."""
        raw = (text or "").encode()
        words = raw.translate(SEPARATORS).split()
        line = f" {b' '.join(words).decode('latin-1')} "  # a character a byte: what counts is the blanks
        places, tags, base, labels, weight = [], [], set(), set(), 1.0
        counted, blanks = 0, 0  # places come by their ends, so blanks are counted once
        for end, (length, what) in self.found.iter(line):
            for kind, label in what:
                if kind == "notice":
                    labels.add(label)
                    continue
                blanks, counted = blanks + line.count(" ", counted, end), end
                if kind == "base":
                    places.append(blanks - length)
                    base.add(label)
                else:
                    tags.append(blanks - 1)  # the last word of the tag
        free, forms = None, []
        if tags:
            wanted = iter(sorted(set(tags)))
            tag = next(wanted)
            for i, m in enumerate(WORD.finditer(raw)):
                if i < tag:
                    continue
                if given := ASSIGNED.match(raw, m.end()):
                    if read := read_expression(raw, given.end()):
                        free = read[0] if free is None else min(free, read[0])
                        labels |= {f"spdx-{x}" for x in read[1]}
                        forms.append(read[2])
                    else:
                        labels.add("spdx-invalid")
                if (tag := next(wanted, -1)) < 0:
                    break
        for label in base | labels:
            weight *= 0.05 if label.startswith("spdx-") and label != "spdx-invalid" else 0.9 if label in ("notice-reserved", "spdx-invalid") else 0.4
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 - weight, free, ",".join(forms)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document. score: how sure it is that a licence is stated, 0 to 1; freedom: the least of the tagged expressions, or null; postfix: their forms in order."""

    def make():
        scanner = Scanner()
        return lambda d, t: (d, *scanner.scan(t))

    return map_rows(
        renamed(docs, {"doc_id": doc_id, "text": text}), ["doc_id", "text"], make,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, freedom double, postfix string",
        pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("freedom", pa.float64()), ("postfix", pa.string())]),
    )
