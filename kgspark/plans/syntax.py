"""Query text to a tree: a lexer and a recursive-descent parser for the SPARQL 1.1 query grammar."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from kgspark.sources.mapping import Literal
from kgspark.terms import BOOLEAN, DECIMAL, DOUBLE, INTEGER, LANG_STRING, PREFIXES, STRING, TYPE


class QueryError(ValueError):
    """The text is no query, or uses what is not supported."""


@dataclass(frozen=True)
class Var:
    name: str


Term = str | Literal | Var


# Paths. An IRI as text is the path of that predicate.
@dataclass(frozen=True)
class Inverse:
    path: "Path"


@dataclass(frozen=True)
class Sequence:
    first: "Path"
    then: "Path"


@dataclass(frozen=True)
class Alternative:
    one: "Path"
    other: "Path"


@dataclass(frozen=True)
class Repeat:
    path: "Path"
    least: int
    many: bool


@dataclass(frozen=True)
class NegatedSet:
    forward: tuple[str, ...]
    backward: tuple[str, ...]


Path = str | Inverse | Sequence | Alternative | Repeat | NegatedSet


@dataclass(frozen=True)
class Pattern:
    s: Term
    p: Term | Path
    o: Term


# Expressions.
@dataclass(frozen=True)
class Call:
    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Exists:
    group: "Group"
    negated: bool = False


@dataclass(frozen=True)
class Aggregate:
    name: str
    arg: object  # None for *
    distinct: bool = False
    separator: str = " "


# Elements of a group.
@dataclass
class Triples:
    patterns: list[Pattern]


@dataclass
class Optional:
    group: "Group"


@dataclass
class Union:
    groups: list["Group"]


@dataclass
class Minus:
    group: "Group"


@dataclass
class GraphScope:
    name: Term
    group: "Group"


@dataclass
class Service:
    name: Term
    group: "Group"
    silent: bool


@dataclass
class Filter:
    condition: object


@dataclass
class Bind:
    expression: object
    name: str


@dataclass
class Values:
    names: list[str]
    rows: list[tuple]


@dataclass
class Group:
    elements: list = field(default_factory=list)


@dataclass
class Query:
    form: str = "select"
    star: bool = False
    distinct: bool = False
    select: list[tuple[str, object]] = field(default_factory=list)  # (name, expression or None)
    template: list[Pattern] = field(default_factory=list)
    describe: list[Term] = field(default_factory=list)
    where: Group = field(default_factory=Group)
    group_by: list[tuple[str | None, object]] = field(default_factory=list)
    having: list = field(default_factory=list)
    order_by: list[tuple[object, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    from_default: list[str] = field(default_factory=list)
    from_named: list[str] = field(default_factory=list)


TOKENS = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)
  | (?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
  | (?P<var>[?$]\w+)
  | (?P<text>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  | (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)|\d*\.\d+|\d+)
  | (?P<bnode>_:\w[\w.\-]*)
  | (?P<pname>(?:[A-Za-z][\w\-]*)?:(?:[\w:%][\w\-:%]*(?:\.+[\w\-:%]+)*)?)
  | (?P<word>[A-Za-z_]\w*)
  | (?P<sign>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].,;*/|^+?!=<>\-])""",
    re.X,
)
ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}


def unescaped(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else ESCAPES.get(m[1], m[1]), text, flags=re.S)


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None) -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKENS.match(text, at)
            if not m:
                raise QueryError(f"no token at {text[at : at + 20]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.prefixes, self.base, self.fresh = 0, {**PREFIXES, **(prefixes or {})}, "", 0

    # What stands at the front.
    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def is_word(self, *words: str) -> bool:
        kind, text = self.peek()
        return kind == "word" and text.upper() in words

    def is_sign(self, *signs: str) -> bool:
        kind, text = self.peek()
        return kind == "sign" and text in signs

    def next(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def word(self, *words: str) -> str | None:
        return self.next()[1].upper() if self.is_word(*words) else None

    def sign(self, *signs: str) -> str | None:
        return self.next()[1] if self.is_sign(*signs) else None

    def need(self, sign: str) -> None:
        if not self.sign(sign):
            raise QueryError(f"{sign!r} wanted, found {self.peek()[1]!r}")

    def need_word(self, word: str) -> None:
        if not self.word(word):
            raise QueryError(f"{word} wanted, found {self.peek()[1]!r}")

    # Terms.
    def iri(self) -> str:
        kind, text = self.next()
        if kind == "iri":
            return text[1:-1] if ":" in text else self.base + text[1:-1]
        if kind == "pname":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise QueryError(f"prefix {prefix}: is not declared")
            return self.prefixes[prefix] + local
        raise QueryError(f"IRI wanted, found {text!r}")

    def literal(self) -> Literal:
        kind, text = self.next()
        if kind == "text":
            size = 3 if text[:3] in ('"""', "'''") else 1
            value = unescaped(text[size:-size])
            if self.peek()[0] == "lang":
                return Literal(value, LANG_STRING, self.next()[1][1:].lower())
            return Literal(value, self.iri() if self.sign("^^") else STRING)
        if kind == "number":
            return Literal(text, DOUBLE if "e" in text.lower() else DECIMAL if "." in text else INTEGER)
        if kind == "word" and text.lower() in ("true", "false"):
            return Literal(text.lower(), BOOLEAN)
        raise QueryError(f"literal wanted, found {text!r}")

    def term(self) -> Term:
        kind, text = self.peek()
        if kind == "var":
            return Var(self.next()[1][1:])
        if kind == "bnode":
            return Var("_:" + self.next()[1][2:])
        if kind in ("iri", "pname"):
            return self.iri()
        if kind == "sign" and text in "+-" and self.peek(1)[0] == "number":
            self.next()
            number = self.literal()
            return Literal(("-" if text == "-" else "") + number.value, number.datatype)
        return self.literal()

    def anonymous(self) -> Var:
        self.fresh += 1
        return Var(f"_:.{self.fresh}")

    # Queries.
    def query(self) -> Query:
        while word := self.word("PREFIX", "BASE"):
            if word == "PREFIX":
                name = self.next()[1]
                kind, iri = self.next()
                if not name.endswith(":") or kind != "iri":
                    raise QueryError("PREFIX name: <iri> wanted")
                self.prefixes[name[:-1]] = iri[1:-1] if ":" in iri else self.base + iri[1:-1]
            else:
                self.base = self.next()[1][1:-1]
        q = self.one_query()
        if self.is_word("VALUES"):
            self.next()
            q.where.elements.append(self.values())
        if self.peek()[0] != "end":
            raise QueryError(f"unexpected {self.peek()[1]!r}")
        return q

    def one_query(self) -> Query:
        q = Query()
        form = self.word("SELECT", "ASK", "CONSTRUCT", "DESCRIBE")
        if not form:
            raise QueryError(f"SELECT, ASK, CONSTRUCT or DESCRIBE wanted, found {self.peek()[1]!r}")
        q.form = form.lower()
        if form == "SELECT":
            q.distinct = bool(self.word("DISTINCT", "REDUCED"))
            if self.sign("*"):
                q.star = True
            else:
                while self.peek()[0] == "var" or self.is_sign("("):
                    if self.sign("("):
                        e = self.expression()
                        self.need_word("AS")
                        q.select.append((self.next()[1][1:], e))
                        self.need(")")
                    else:
                        q.select.append((self.next()[1][1:], None))
                if not q.select:
                    raise QueryError("SELECT names nothing")
        elif form == "CONSTRUCT" and self.sign("{"):
            q.template = self.triples_until("}")
        elif form == "DESCRIBE" and not self.sign("*"):
            while self.peek()[0] in ("var", "iri", "pname"):
                q.describe.append(self.term())
        while self.word("FROM"):
            (q.from_named if self.word("NAMED") else q.from_default).append(self.iri())
        has_where = self.word("WHERE") or self.is_sign("{")
        if has_where:
            q.where = self.group()
        elif form != "DESCRIBE":
            raise QueryError("WHERE wanted")
        if form == "CONSTRUCT" and not q.template:
            q.template = [p for e in q.where.elements if isinstance(e, Triples) for p in e.patterns]
        if form == "DESCRIBE" and not q.describe:
            q.star = True
        self.modifiers(q)
        return q

    def modifiers(self, q: Query) -> None:
        if self.word("GROUP"):
            self.need_word("BY")
            while self.peek()[0] in ("var", "iri", "pname") or self.is_sign("(") or (self.peek()[0] == "word" and not self.is_word("HAVING", "ORDER", "LIMIT", "OFFSET", "VALUES")):
                if self.sign("("):
                    e = self.expression()
                    name = self.next()[1][1:] if self.word("AS") else None
                    self.need(")")
                else:
                    e = self.primary()
                    name = e.name if isinstance(e, Var) else None
                q.group_by.append((name, e))
        if self.word("HAVING"):
            while self.is_sign("(") or (self.peek()[0] == "word" and not self.is_word("ORDER", "LIMIT", "OFFSET", "VALUES")):
                q.having.append(self.primary())
        if self.word("ORDER"):
            self.need_word("BY")
            while self.peek()[0] in ("var", "word") or self.is_sign("("):
                if self.is_word("LIMIT", "OFFSET", "VALUES"):
                    break
                down = self.word("ASC", "DESC") == "DESC"
                q.order_by.append((self.primary(), down))
        while word := self.word("LIMIT", "OFFSET"):
            kind, n = self.next()
            if kind != "number" or not n.isdigit():
                raise QueryError(f"{word} wants a number")
            if word == "LIMIT":
                q.limit = int(n)
            else:
                q.offset = int(n)

    # Groups.
    def group(self) -> Group:
        self.need("{")
        g = Group()
        if self.is_word("SELECT"):
            g.elements.append(self.one_query())
            if self.word("VALUES"):
                g.elements.append(self.values())
            self.need("}")
            return g
        while not self.sign("}"):
            if self.sign("."):
                continue
            if self.is_sign("{"):
                groups = [self.group()]
                while self.word("UNION"):
                    groups.append(self.group())
                g.elements.append(Union(groups) if len(groups) > 1 else groups[0])
            elif word := self.word("OPTIONAL", "MINUS", "GRAPH", "SERVICE", "FILTER", "BIND", "VALUES"):
                if word == "OPTIONAL":
                    g.elements.append(Optional(self.group()))
                elif word == "MINUS":
                    g.elements.append(Minus(self.group()))
                elif word == "GRAPH":
                    name = self.term()
                    g.elements.append(GraphScope(name, self.group()))
                elif word == "SERVICE":
                    silent = bool(self.word("SILENT"))
                    name = self.term()
                    g.elements.append(Service(name, self.group(), silent))
                elif word == "FILTER":
                    g.elements.append(Filter(self.primary()))
                elif word == "BIND":
                    self.need("(")
                    e = self.expression()
                    self.need_word("AS")
                    g.elements.append(Bind(e, self.next()[1][1:]))
                    self.need(")")
                else:
                    g.elements.append(self.values())
            elif self.peek()[0] == "end":
                raise QueryError("'}' wanted")
            else:
                patterns = self.same_subject()
                if g.elements and isinstance(g.elements[-1], Triples):
                    g.elements[-1].patterns += patterns
                else:
                    g.elements.append(Triples(patterns))
        return g

    def triples_until(self, end: str) -> list[Pattern]:
        out = []
        while not self.sign(end):
            if not self.sign("."):
                out += self.same_subject()
        return out

    def values(self) -> Values:
        if self.peek()[0] == "var":
            names = [self.next()[1][1:]]
            single = True
        else:
            self.need("(")
            names, single = [], False
            while self.peek()[0] == "var":
                names.append(self.next()[1][1:])
            self.need(")")
        self.need("{")
        rows = []
        value = lambda: None if self.word("UNDEF") else self.term()
        while not self.sign("}"):
            if single:
                rows.append((value(),))
            else:
                self.need("(")
                row = []
                while not self.sign(")"):
                    row.append(value())
                rows.append(tuple(row))
                if len(row) != len(names):
                    raise QueryError("VALUES: a row has another length than the names")
        return Values(names, rows)

    def node(self, out: list[Pattern]) -> Term:
        if self.sign("["):
            subject = self.anonymous()
            if not self.sign("]"):
                self.properties(subject, out)
                self.need("]")
            return subject
        if self.sign("("):
            from kgspark.terms import RDF

            items = []
            while not self.sign(")"):
                items.append(self.node(out))
            head: Term = RDF + "nil"
            for item in reversed(items):
                cell = self.anonymous()
                out += [Pattern(cell, RDF + "first", item), Pattern(cell, RDF + "rest", head)]
                head = cell
            return head
        return self.term()

    def same_subject(self) -> list[Pattern]:
        out: list[Pattern] = []
        open_ = self.is_sign("[")
        subject = self.node(out)
        if not (open_ and (self.is_sign(".", "}") or self.is_word("OPTIONAL", "FILTER", "UNION"))):
            self.properties(subject, out)
        return out

    def properties(self, subject: Term, out: list[Pattern]) -> None:
        while True:
            verb: Term | Path = Var(self.next()[1][1:]) if self.peek()[0] == "var" else self.path()
            while True:
                out.append(Pattern(subject, verb, self.node(out)))
                if not self.sign(","):
                    break
            more = False
            while self.sign(";"):
                more = True
            if not more or self.is_sign(".", "}", "]") or self.peek()[0] == "end":
                return

    # Paths.
    def path(self) -> Path:
        out = self.path_sequence()
        while self.sign("|"):
            out = Alternative(out, self.path_sequence())
        return out

    def path_sequence(self) -> Path:
        out = self.path_step()
        while self.sign("/"):
            out = Sequence(out, self.path_step())
        return out

    def path_step(self) -> Path:
        if self.sign("^"):
            return Inverse(self.path_step())
        if self.sign("!"):
            forward, backward = [], []
            many = self.sign("(")
            while True:
                (backward if self.sign("^") else forward).append(TYPE if self.peek() == ("word", "a") and self.next() else self.iri())
                if not (many and self.sign("|")):
                    break
            if many:
                self.need(")")
            out: Path = NegatedSet(tuple(forward), tuple(backward))
        elif self.sign("("):
            out = self.path()
            self.need(")")
        elif self.peek() == ("word", "a"):
            self.next()
            out = TYPE
        else:
            out = self.iri()
        while mark := self.sign("*", "+", "?"):
            out = Repeat(out, 1 if mark == "+" else 0, mark != "?")
        return out

    # Expressions.
    def expression(self):
        out = self.conjunction()
        while self.sign("||"):
            out = Call("||", (out, self.conjunction()))
        return out

    def conjunction(self):
        out = self.comparison()
        while self.sign("&&"):
            out = Call("&&", (out, self.comparison()))
        return out

    def comparison(self):
        out = self.sum()
        if op := self.sign("=", "!=", "<", "<=", ">", ">="):
            return Call(op, (out, self.sum()))
        negated = bool(self.is_word("NOT") and self.peek(1)[1].upper() == "IN" and self.next())
        if self.word("IN"):
            self.need("(")
            items = []
            while not self.sign(")"):
                items.append(self.expression())
                self.sign(",")
            out = Call("IN", (out, *items))
            return Call("!", (out,)) if negated else out
        return out

    def sum(self):
        out = self.product()
        while op := self.sign("+", "-"):
            out = Call(op, (out, self.product()))
        return out

    def product(self):
        out = self.unary()
        while op := self.sign("*", "/"):
            out = Call(op, (out, self.unary()))
        return out

    def unary(self):
        if self.sign("!"):
            return Call("!", (self.unary(),))
        if self.sign("-"):
            return Call("NEG", (self.unary(),))
        self.sign("+")
        return self.primary()

    def primary(self):
        if self.sign("("):
            out = self.expression()
            self.need(")")
            return out
        kind, text = self.peek()
        if kind == "var":
            return Var(self.next()[1][1:])
        if kind == "word" and text.lower() not in ("true", "false"):
            name = self.next()[1].upper()
            if name == "NOT":
                self.need_word("EXISTS")
                return Exists(self.group(), True)
            if name == "EXISTS":
                return Exists(self.group())
            self.need("(")
            if name in AGGREGATES:
                distinct = bool(self.word("DISTINCT"))
                arg = None if self.sign("*") else self.expression()
                separator = " "
                if self.sign(";"):
                    self.need_word("SEPARATOR")
                    self.need("=")
                    separator = self.literal().value
                self.need(")")
                return Aggregate(name, arg, distinct, separator)
            args = []
            while not self.sign(")"):
                args.append(self.expression())
                self.sign(",")
            return Call(name, tuple(args))
        if kind in ("iri", "pname"):
            iri = self.iri()
            if self.sign("("):
                args = []
                while not self.sign(")"):
                    args.append(self.expression())
                    self.sign(",")
                return Call(iri, tuple(args))
            return iri
        return self.literal()


def parse(text: str, prefixes: dict[str, str] | None = None) -> Query:
    return Parser(text, prefixes).query()
