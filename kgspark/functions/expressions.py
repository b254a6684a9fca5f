"""Query expressions as columns. SPARQL's three-valued logic is SQL's: an error is null."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kgspark.plans.syntax import Aggregate, Call, Exists, QueryError, Var
from kgspark.sources.mapping import Literal
from kgspark.terms import BOOLEAN, DATETIME, DECIMAL, DOUBLE, INTEGER, LANG_STRING, NUMERIC, STRING, XSD, node_kind, number_of


@dataclass
class Value:
    """A term as columns: text, kind, datatype, language, number; null text is unbound or an error.

    flag is there for what is a boolean by construction, constant for what is known while planning.
    """

    v: Column
    k: Column
    d: Column
    l: Column  # noqa: E741
    n: Column
    flag: Column | None = None
    constant: str | Literal | None = None
    node: bool = False


Scope = Callable[[object], Value]  # of a Var, an Aggregate or an Exists


def constant(term: str | Literal) -> Value:
    if isinstance(term, Literal):
        number = None
        if term.datatype in NUMERIC:
            try:
                number = float(term.value)
            except ValueError:
                pass
        return Value(F.lit(term.value), F.lit("literal"), F.lit(term.datatype), F.lit(term.language), F.lit(number).cast("double"), constant=term)
    return Value(F.lit(term), F.lit("bnode" if term.startswith("_:") else "iri"), F.lit(""), F.lit(""), F.lit(None).cast("double"), constant=term, node=True)


def number(n: Column, datatype: str = DOUBLE) -> Value:
    text = n.cast("long").cast("string") if datatype == INTEGER else n.cast("string")
    return Value(text, kind_if(n.isNotNull(), "literal"), F.lit(datatype), F.lit(""), n.cast("double"))


def kind_if(there: Column, kind: str) -> Column:
    return F.when(there, F.lit(kind))


def text(v: Column, datatype: Column | str = STRING, language: Column | str = "") -> Value:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return Value(v, kind_if(v.isNotNull(), "literal"), as_column(datatype), as_column(language), F.lit(None).cast("double"))


def boolean(flag: Column) -> Value:
    return Value(flag.cast("string"), kind_if(flag.isNotNull(), "literal"), F.lit(BOOLEAN), F.lit(""), F.lit(None).cast("double"), flag=flag)


def truth(x: Value) -> Column:
    """Effective boolean value."""
    if x.flag is not None:
        return x.flag
    return (
        F.when(x.k != "literal", F.lit(None).cast("boolean"))
        .when(x.d == BOOLEAN, F.lower(x.v).isin("true", "1"))
        .when(x.d.isin(NUMERIC), F.coalesce((x.n != 0) & ~F.isnan(x.n), F.lit(False)))
        .when(x.d.isin(STRING, LANG_STRING, ""), F.length(x.v) > 0)
    )


def same_term(a: Value, b: Value) -> Column:
    if a.node or b.node:
        return (a.v == b.v) & (a.k != "literal") & (b.k != "literal")
    return (a.v == b.v) & ((a.k == "literal") == (b.k == "literal")) & (a.d == b.d) & (a.l == b.l)


def is_number(x: Value) -> bool:
    return isinstance(x.constant, Literal) and x.constant.datatype in NUMERIC


def equal(a: Value, b: Value) -> Column:
    if a.flag is not None and b.flag is not None:
        return a.flag == b.flag
    if is_number(a) or is_number(b):
        return a.n == b.n
    if a.constant is not None or b.constant is not None or a.node or b.node:
        return same_term(a, b)
    return F.when(a.n.isNotNull() & b.n.isNotNull(), a.n == b.n).otherwise(same_term(a, b))


def ordered(op: str, a: Value, b: Value) -> Column:
    compare = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    if is_number(a) or is_number(b):
        return compare(a.n, b.n)
    known = next((x.constant for x in (a, b) if isinstance(x.constant, Literal)), None)
    plain = [STRING, LANG_STRING]
    by_text = F.when((a.k == "literal") & (b.k == "literal") & a.d.isin(plain) & b.d.isin(plain), compare(a.v, b.v))
    if known is not None and known.datatype in plain:
        return by_text
    time = lambda x: F.when(x.d.isin(DATETIME, XSD + "date"), x.v.try_cast("timestamp"))
    if known is not None and known.datatype in (DATETIME, XSD + "date"):
        return compare(time(a), time(b))
    return F.coalesce(compare(a.n, b.n), by_text, compare(time(a), time(b)))


def sort_keys(x: Value, down: bool) -> list[Column]:
    """Unbound, blank nodes, IRIs, literals; numbers by value, the rest by text."""
    rank = F.when(x.v.isNull(), 0).when(x.k == "bnode", 1).when(x.k == "iri", 2).otherwise(3)
    return [c.desc_nulls_last() if down else c.asc_nulls_first() for c in (rank, x.n, x.v)]


def pattern_of(x: Value, flags: Value | None) -> str:
    if not isinstance(x.constant, Literal) or (flags is not None and not isinstance(flags.constant, Literal)):
        raise QueryError("a pattern and its flags are constants")
    import re

    marks = "".join(c for c in (flags.constant.value if flags else "") if c in "imsx")
    try:
        re.compile(x.constant.value)
    except re.error as e:
        raise QueryError(f"pattern {x.constant.value!r}: {e}") from e
    return f"(?{marks})" * bool(marks) + x.constant.value


def literal_text(x: Value) -> Column:
    """The text of a string literal, null for other terms."""
    return F.when((x.k == "literal") & x.d.isin(STRING, LANG_STRING), x.v)


def compile_expression(e: object, scope: Scope) -> Value:
    if isinstance(e, (Var, Aggregate, Exists)):
        return scope(e)
    if isinstance(e, (str, Literal)):
        return constant(e)
    if not isinstance(e, Call):
        raise QueryError(f"no expression: {e!r}")
    name, raw = e.name, e.args
    if name == "BOUND":
        return boolean(scope(raw[0]).v.isNotNull())
    args = [compile_expression(a, scope) for a in raw]
    need = {"REGEX": (2, 3), "IF": (3, 3), "SUBSTR": (2, 3), "REPLACE": (3, 4), "SAMETERM": (2, 2), "LANGMATCHES": (2, 2)}.get(name)
    if need and not need[0] <= len(args) <= need[1]:
        raise QueryError(f"{name} takes {need[0]} to {need[1]} arguments")
    if not args and name not in ("BNODE", "CONCAT", "COALESCE"):
        raise QueryError(f"{name} takes an argument")
    a = args[0] if args else None
    b = args[1] if len(args) > 1 else None
    both_int = len(args) == 2 and all(isinstance(x.constant, Literal) and x.constant.datatype == INTEGER for x in args)
    match name:
        case "||":
            return boolean(truth(a) | truth(b))
        case "&&":
            return boolean(truth(a) & truth(b))
        case "!":
            return boolean(~truth(a))
        case "=":
            return boolean(equal(a, b))
        case "!=":
            return boolean(~equal(a, b))
        case "<" | "<=" | ">" | ">=":
            return boolean(ordered(name, a, b))
        case "IN":
            return boolean(reduce(lambda x, y: x | y, (equal(a, x) for x in args[1:]), F.lit(False)))
        case "+":
            return number(a.n + b.n, INTEGER if both_int else DOUBLE)
        case "-":
            return number(a.n - b.n, INTEGER if both_int else DOUBLE)
        case "*":
            return number(a.n * b.n, INTEGER if both_int else DOUBLE)
        case "/":
            return number(F.try_divide(a.n, b.n))
        case "NEG":
            return number(-a.n)
        case "ISIRI" | "ISURI":
            return boolean(a.k == "iri")
        case "ISLITERAL":
            return boolean(a.k == "literal")
        case "ISBLANK":
            return boolean(a.k == "bnode")
        case "ISNUMERIC":
            return boolean(F.when(a.v.isNotNull(), a.n.isNotNull()))
        case "STR":
            return text(a.v)
        case "LANG":
            return text(F.when(a.k == "literal", a.l))
        case "DATATYPE":
            iri = F.when(a.k == "literal", a.d)
            return Value(iri, kind_if(iri.isNotNull(), "iri"), F.lit(""), F.lit(""), F.lit(None).cast("double"), node=True)
        case "IRI" | "URI":
            return Value(a.v, kind_if(a.v.isNotNull(), "iri"), F.lit(""), F.lit(""), F.lit(None).cast("double"), node=True)
        case "BNODE":
            v = F.concat(F.lit("_:"), a.v if a else F.uuid())
            return Value(v, kind_if(v.isNotNull(), "bnode"), F.lit(""), F.lit(""), F.lit(None).cast("double"), node=True)
        case "STRDT":
            return Value(a.v, a.k, b.v, F.lit(""), number_of(a.v, a.k, b.v))
        case "STRLANG":
            return text(a.v, LANG_STRING, F.lower(b.v))
        case "SAMETERM":
            return boolean(same_term(a, b))
        case "REGEX":
            return boolean(literal_text(a).rlike(pattern_of(b, args[2] if len(args) > 2 else None)))
        case "REPLACE":
            return text(F.regexp_replace(literal_text(a), F.lit(pattern_of(b, args[3] if len(args) > 3 else None)), args[2].v), a.d, a.l)
        case "LANGMATCHES":
            return boolean(F.when(b.v == "*", a.v != "").otherwise((F.lower(a.v) == F.lower(b.v)) | F.startswith(F.lower(a.v), F.concat(F.lower(b.v), F.lit("-")))))
        case "CONTAINS":
            return boolean(F.contains(literal_text(a), literal_text(b)))
        case "STRSTARTS":
            return boolean(F.startswith(literal_text(a), literal_text(b)))
        case "STRENDS":
            return boolean(F.endswith(literal_text(a), literal_text(b)))
        case "STRBEFORE":
            return text(F.substring_index(literal_text(a), b.constant.value, 1) if isinstance(b.constant, Literal) else F.split_part(literal_text(a), literal_text(b), F.lit(1)))
        case "STRLEN":
            return number(F.length(literal_text(a)), INTEGER)
        case "UCASE":
            return text(F.upper(literal_text(a)), a.d, a.l)
        case "LCASE":
            return text(F.lower(literal_text(a)), a.d, a.l)
        case "SUBSTR":
            start = b.n.cast("int")
            return text(F.substr(literal_text(a), start, args[2].n.cast("int")) if len(args) > 2 else F.substr(literal_text(a), start), a.d, a.l)
        case "CONCAT":
            return text(F.concat(*(literal_text(x) for x in args)) if args else F.lit(""))
        case "ABS":
            return number(F.abs(a.n))
        case "ROUND":
            return number(F.floor(a.n + 0.5).cast("double"))
        case "CEIL":
            return number(F.ceil(a.n).cast("double"))
        case "FLOOR":
            return number(F.floor(a.n).cast("double"))
        case "COALESCE":
            pick = lambda part: F.coalesce(*(F.when(x.v.isNotNull(), getattr(x, part)) for x in args)) if args else F.lit(None).cast("string")
            return Value(*(pick(p) for p in "vkdln"))
        case "IF":
            test, c = truth(a), args[2]
            pick = lambda part: F.when(test, getattr(b, part)).when(~test, getattr(c, part))
            return Value(*(pick(p) for p in "vkdln"))
        case "YEAR" | "MONTH" | "DAY" | "HOURS" | "MINUTES" | "SECONDS":
            part = {"HOURS": "hour", "MINUTES": "minute", "SECONDS": "second"}.get(name, name.lower())
            return number(getattr(F, part)(F.when(a.d == DATETIME, a.v.try_cast("timestamp"))), INTEGER)
    if name.startswith(XSD):
        kind = name.removeprefix(XSD)
        if kind == "string":
            return text(a.v)
        if kind == "boolean":
            return boolean(F.when(F.lower(a.v).isin("true", "1"), True).when(F.lower(a.v).isin("false", "0"), False))
        if name in NUMERIC:
            n = F.coalesce(a.n, F.trim(a.v).try_cast("double"))
            return number(F.when(n.isNotNull(), n.try_cast("long")), INTEGER) if kind in ("integer", "int", "long") else number(n, DECIMAL if kind == "decimal" else DOUBLE)
        if name == DATETIME:
            return Value(F.when(a.v.try_cast("timestamp").isNotNull(), a.v), a.k, F.lit(DATETIME), F.lit(""), F.lit(None).cast("double"))
    raise QueryError(f"unknown function {name}")


def bound_iri(v: Column) -> Value:
    return Value(v, F.when(v.isNotNull(), node_kind(v)), F.lit(""), F.lit(""), F.lit(None).cast("double"), node=True)
