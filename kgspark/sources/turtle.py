"""Turtle: documents are read one a row, so a task holds one document, whose triples it yields as it reads them.

Graphs too large for one document belong into N-Triples, which are read line by line. Blank nodes carry
the document's number, so those of two documents stay apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.terms import BOOLEAN, DECIMAL, DOUBLE, INTEGER, LANG_STRING, RDF, STRING, TYPE, as_quads

NAMES = ("s", "p", "o", "o_kind", "o_dt", "o_lang")
NAME = r"(?:[\w\-.%:]|[^\x00-\x7F]|\\[_~.\-!$&'()*+,;=/?#@%])*"
TOKEN = re.compile(
    rf"""(?:\s|\#[^\r\n]*)*(?:
    (?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''') |
    (?P<short>"(?:[^"\\\r\n]|\\.)*"|'(?:[^'\\\r\n]|\\.)*') |
    (?P<iri><[^<>"{{}}|^`\s]*>) |
    (?P<directive>@(?:prefix|base)\b|(?i:PREFIX|BASE)(?=\s)) |
    (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*) |
    (?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+)) |
    (?P<blank>_:[\w](?:[\w\-.]*[\w\-])?) |
    (?P<word>(?:true|false|a)(?=[\s;,.\[\]()<"'\#]|$)) |
    (?P<name>(?:[^\W\d_](?:[\w\-.]*[\w\-])?)?:{NAME}) |
    (?P<mark>\^\^|[.;,\[\]()])
    )""",
    re.X | re.S,
)
SPACE = re.compile(r"(?:\s|#[^\r\n]*)*")
ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
ESCAPED = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


class TurtleError(ValueError):
    pass


def unescaped(text: str) -> str:
    return ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else ESCAPED.get(m[3], m[3]), text)


class Document:
    """A parser of one document. Terms are (text, kind, datatype, language)."""

    def __init__(self, text: str, number: int = 0, base: str = "") -> None:
        self.text, self.at, self.base, self.prefixes = text, 0, base, {}
        self.label, self.made = f"_:d{number}", 0
        self.next()

    def next(self) -> tuple[str, str]:
        """The token at hand; the one behind it is read."""
        now = (getattr(self, "kind", ""), getattr(self, "token", ""))
        if m := TOKEN.match(self.text, self.at):
            self.kind, self.token, self.at = m.lastgroup or "", m[m.lastgroup], m.end()
            if self.kind in ("name", "number") and self.token.endswith("."):  # the end of the statement, not of the name
                self.at -= 1
                self.token = self.token[:-1]
        elif SPACE.match(self.text, self.at).end() == len(self.text):
            self.kind, self.token = "end", ""
        else:
            raise TurtleError(f"no Turtle at {self.text[self.at : self.at + 40]!r}")
        return now

    def expect(self, token: str) -> None:
        if self.next()[1] != token:
            raise TurtleError(f"{token!r} is missing before {self.text[self.at : self.at + 40]!r}")

    def fresh(self) -> tuple[str, str, str, str]:
        self.made += 1
        return f"{self.label}g{self.made}", "bnode", "", ""

    def resolved(self, token: str) -> str:
        iri = unescaped(token[1:-1])
        return urljoin(self.base, iri) if self.base else iri

    def triples(self) -> Iterator[tuple]:
        while self.kind != "end":
            if self.kind == "directive":
                yield from self.directive()
                continue
            if self.token == "[":
                subject = yield from self.properties()
                if self.token != ".":
                    yield from self.predicates(subject)
            else:
                subject = yield from self.term()
                yield from self.predicates(subject)
            self.expect(".")

    def directive(self) -> Iterator[tuple]:
        word = self.next()[1]
        if word.lower().endswith("prefix"):
            kind, name = self.next()
            if kind != "name" or not name.endswith(":"):
                raise TurtleError(f"{name!r} is no prefix")
            self.prefixes[name[:-1]] = self.resolved(self.next()[1])
        else:
            self.base = self.resolved(self.next()[1])
        if word.startswith("@"):
            self.expect(".")
        yield from ()

    def predicates(self, subject: tuple) -> Iterator[tuple]:
        while True:
            if (self.kind, self.token) == ("word", "a"):
                self.next()
                predicate = TYPE
            else:
                predicate, kind, *_ = yield from self.term()
                if kind != "iri":
                    raise TurtleError(f"{predicate!r} is no predicate")
            while True:
                o = yield from self.term()
                if subject[1] == "literal":
                    raise TurtleError("a literal is no subject")
                yield subject[0], predicate, *o
                if self.token != ",":
                    break
                self.next()
            if self.token != ";":
                return
            while self.token == ";":
                self.next()
            if self.token in (".", "]"):
                return

    def properties(self):
        """A blank node with its properties, [ ... ]."""
        self.expect("[")
        node = self.fresh()
        if self.token != "]":
            yield from self.predicates(node)
        self.expect("]")
        return node

    def collection(self):
        self.expect("(")
        head = last = None
        while self.token != ")":
            item = yield from self.term()
            cell = self.fresh()
            if last:
                yield last[0], RDF + "rest", *cell
            head, last = head or cell, cell
            yield cell[0], RDF + "first", *item
        self.expect(")")
        nil = (RDF + "nil", "iri", "", "")
        if last:
            yield last[0], RDF + "rest", *nil
        return head or nil

    def term(self):
        if self.token == "[":
            return (yield from self.properties())
        if self.token == "(":
            return (yield from self.collection())
        kind, token = self.next()
        match kind:
            case "iri":
                return self.resolved(token), "iri", "", ""
            case "name":
                prefix, local = token.split(":", 1)
                if prefix not in self.prefixes:
                    raise TurtleError(f"the prefix {prefix!r} is not declared")
                return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local), "iri", "", ""
            case "blank":
                return f"{self.label}{token[2:]}", "bnode", "", ""
            case "number":
                return token, "literal", DOUBLE if "e" in token.lower() else DECIMAL if "." in token else INTEGER, ""
            case "word" if token != "a":
                return token, "literal", BOOLEAN, ""
            case "long" | "short":
                text = unescaped(token[3:-3] if kind == "long" else token[1:-1])
                if self.kind == "lang":
                    return text, "literal", LANG_STRING, self.next()[1][1:].lower()
                if self.token == "^^":
                    self.next()
                    datatype = yield from self.term()
                    return text, "literal", datatype[0], ""
                return text, "literal", STRING, ""
        raise TurtleError(f"{token!r} is no term")


def parse_turtle(documents: DataFrame, column: str = "value", base: str = "") -> DataFrame:
    """Quads of Turtle documents, one a row; null and empty ones give none, a malformed one fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for row in Document(text or "", number, base).triples():
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=list(NAMES))
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=list(NAMES))

    own = documents.select(F.monotonically_increasing_id().alias("number"), F.col(f"`{column}`").alias("text"))
    return as_quads(own.mapInArrow(run, ", ".join(f"{n} string" for n in NAMES)))


def read_turtle(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """Quads of all Turtle files of a path, a task for each file."""
    return parse_turtle(spark.read.text(path, wholetext=True), base=base)
