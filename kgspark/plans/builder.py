"""Patterns built in Python: conjunctions of triples whose shared variables join, with bag semantics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from kgspark.plans.compiler import Compiler
from kgspark.plans.syntax import Pattern, Term, Var
from kgspark.sources.mapping import Graph, Literal


def var(name: str) -> Var:
    return Var(name.lstrip("?"))


def const(value: str) -> str:
    return value


def literal(value: object, datatype: str | None = None, language: str = "") -> Literal:
    from kgspark.terms import LANG_STRING, STRING

    return Literal(str(value), datatype or (LANG_STRING if language else STRING), language)


@dataclass
class GraphQuery:
    graph: Graph
    patterns: list[Pattern] = field(default_factory=list)

    def where(self, s: Term, p: Term, o: Term) -> GraphQuery:
        return GraphQuery(self.graph, [*self.patterns, Pattern(s, p, o)])

    def execute(self) -> DataFrame:
        """A column of text for each variable; without patterns, one row without columns."""
        compiler = Compiler(self.graph)
        rel = compiler.triples(self.patterns)
        return rel.df.select(*(compiler.flat(rel, n, None) for n in sorted(rel.names))) if rel.names else rel.df
