"""SHACL: shapes are read to the driver, each constraint becomes one table of violations, all are united.

Shapes within shapes (node, property, and, or, not, xone, qualifiedValueShape) are evaluated on the values of
the outer one, literals included, and give one violation a value. Shapes that contain themselves raise, and
so does a predicate of the vocabulary on a shape that is not evaluated here.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.plans import syntax as S
from kgspark.plans.compiler import Compiler, query
from kgspark.sources.mapping import Graph, QuadGraph
from kgspark.terms import BOOLEAN, DATETIME, INTEGER, NUMERIC, RDF, SH, STRING, TYPE, XSD, as_quads

REPORT = "shape string, focus_node string, result_path string, value string, component string, message string, severity string"


@dataclass(frozen=True)
class Term:
    """A value of sh:hasValue or sh:in. A plain text in its place stands for any term with that text."""

    value: str
    kind: str = "iri"
    datatype: str = ""
    language: str = ""

    def __str__(self) -> str:
        return self.value

    def is_that(self) -> Column:
        """Whether the value at hand is this term; a plain literal is one of xsd:string."""
        plain = lambda d: F.when(d == STRING, F.lit("")).otherwise(F.coalesce(d, F.lit("")))
        same = (F.col("v") == self.value) & (F.col("k") == self.kind)
        return same & (plain(F.col("d")) == plain(F.lit(self.datatype))) & (F.coalesce("l", F.lit("")) == self.language.lower()) if self.kind == "literal" else same


def is_one_of(values: list) -> Column:
    return reduce(lambda a, b: a | b, (x.is_that() if isinstance(x, Term) else F.col("v") == x for x in values), F.lit(False))


@dataclass
class Constraint:
    component: str
    value: object = None
    flags: str = ""


@dataclass
class PropertyShape:
    path: S.Path
    constraints: list[Constraint] = field(default_factory=list)
    severity: str = "violation"
    message: str | None = None


@dataclass
class NodeShape:
    id: str
    targets: list[tuple[str, str]] = field(default_factory=list)  # (class | node | subjectsOf | objectsOf, IRI)
    constraints: list[Constraint] = field(default_factory=list)
    properties: list[PropertyShape] = field(default_factory=list)
    severity: str = "violation"


#: Constraint predicates and the form of their value: text, a list, a number, a term, terms or a shape; fixed values of the vocabulary.
PARAMETERS = {
    "class": "text", "datatype": "text", "nodeKind": "text", "minCount": "number", "maxCount": "number", "minLength": "number", "maxLength": "number", "pattern": "text", "hasValue": "term", "in": "terms",
    "languageIn": "list", "uniqueLang": "text", "equals": "text", "disjoint": "text", "lessThan": "text", "lessThanOrEquals": "text", "minInclusive": "text", "maxInclusive": "text", "minExclusive": "text", "maxExclusive": "text",
    "node": "shape", "not": "shape", "and": "shapes", "or": "shapes", "xone": "shapes", "qualifiedValueShape": "shape",
}

#: What else a shape may have: read beside the constraints, or without a say in whether a graph conforms.
BESIDE = set(
    "path property targetClass targetNode targetSubjectsOf targetObjectsOf severity message name description order group defaultValue deactivated flags "
    "qualifiedMinCount qualifiedMaxCount qualifiedValueShapesDisjoint closed ignoredProperties sparql".split()
)


def path_text(path: S.Path) -> str:
    match path:
        case str():
            return path
        case S.Inverse():
            return "^" + path_text(path.path)
        case S.Sequence():
            return f"{path_text(path.first)}/{path_text(path.then)}"
        case S.Alternative():
            return f"{path_text(path.one)}|{path_text(path.other)}"
        case S.Repeat():
            return f"({path_text(path.path)}){'+' if path.least else '*' if path.many else '?'}"
    return str(path)


def load_shapes(quads: DataFrame, limit: int = 100_000) -> list[NodeShape]:
    """Node shapes, ordered by id, from quads that hold at most `limit` shape triples."""
    own = as_quads(quads).where(F.col("p").startswith(SH) | F.col("p").isin(RDF + "first", RDF + "rest") | ((F.col("p") == TYPE) & F.col("o").startswith(SH)))
    rows = own.select("s", "p", "o", "o_kind", "o_dt", "o_lang").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"the shapes graph has more than {limit} triples")
    by: dict[str, dict[str, list[str]]] = {}
    terms: dict[tuple[str, str], list[Term]] = {}
    for r in sorted(rows, key=lambda r: tuple(x or "" for x in r)):
        key = r["p"].removeprefix(SH).removeprefix(RDF)
        by.setdefault(r["s"], {}).setdefault(key, []).append(r["o"])
        terms.setdefault((r["s"], key), []).append(Term(r["o"], r["o_kind"], r["o_dt"] or "", r["o_lang"] or ""))

    def listed(head: str) -> list[Term]:
        out, seen = [], set()
        while head in by and "first" in by[head] and head not in seen:
            seen.add(head)
            out.append(terms[head, "first"][0])
            head = by[head].get("rest", [""])[0]
        return out

    def items(head: str) -> list[str]:
        return [x.value for x in listed(head)]

    def read_path(node: str) -> S.Path:
        own = by.get(node, {})
        if "first" in own:
            return reduce(S.Sequence, [read_path(x) for x in items(node)])
        if "inversePath" in own:
            return S.Inverse(read_path(own["inversePath"][0]))
        if "alternativePath" in own:
            return reduce(S.Alternative, [read_path(x) for x in items(own["alternativePath"][0])])
        for key, least, many in (("zeroOrMorePath", 0, True), ("oneOrMorePath", 1, True), ("zeroOrOnePath", 0, False)):
            if key in own:
                return S.Repeat(read_path(own[key][0]), least, many)
        return node

    true = lambda own, key: own.get(key, [""])[0] in ("true", "1")
    open_shapes: list[str] = []

    def inner(node: str) -> NodeShape:
        """The shape as one to evaluate on the values of another; a property shape becomes its only property."""
        own = by.get(node, {})
        if node in open_shapes:
            raise ValueError(f"the shape {node} contains itself")
        if true(own, "deactivated"):
            return NodeShape(node)
        if "path" in own:
            return NodeShape(node, properties=[read_property(node)])
        open_shapes.append(node)
        out = NodeShape(node, constraints=constraints(node), properties=properties(own))
        open_shapes.pop()
        return out

    def read_property(node: str) -> PropertyShape:
        own = by.get(node, {})
        if "path" not in own:
            raise ValueError(f"the property shape {node} has no sh:path")
        if node in open_shapes:
            raise ValueError(f"the shape {node} contains itself")
        open_shapes.append(node)
        nested = [Constraint("property", [NodeShape(node, properties=[x])]) for x in properties(own)]
        out = PropertyShape(read_path(own["path"][0]), constraints(node) + nested, severity(own), own.get("message", [None])[0])
        open_shapes.pop()
        return out

    def properties(own: dict[str, list[str]]) -> list[PropertyShape]:
        return [read_property(p) for p in own.get("property", []) if not true(by.get(p, {}), "deactivated")]

    def siblings(node: str, value: str) -> list[NodeShape]:
        """The other qualified shapes beside the property shape, in all shapes that have it."""
        beside = {x for own in by.values() if node in own.get("property", []) for p in own["property"] for x in by.get(p, {}).get("qualifiedValueShape", [])}
        return [inner(x) for x in sorted(beside - {value})]

    def constraints(node: str) -> list[Constraint]:
        own, out = by.get(node, {}), []
        if unknown := sorted(set(own) - set(PARAMETERS) - BESIDE - {"type", "first", "rest"}):
            raise ValueError(f"the shape {node} has sh:{unknown[0]}, which is not evaluated")
        for name, form in PARAMETERS.items():
            for value, exact in zip(own.get(name, []), terms.get((node, name), []), strict=True):
                if form == "list":
                    out.append(Constraint(name, items(value)))
                elif form == "term":
                    out.append(Constraint(name, exact))
                elif form == "terms":
                    out.append(Constraint(name, listed(value)))
                elif form == "number":
                    out.append(Constraint(name, int(value)))
                elif name == "pattern":
                    out.append(Constraint(name, value, own.get("flags", [""])[0]))
                elif name == "qualifiedValueShape":
                    number = lambda k: int(own[k][0]) if k in own else None
                    others = siblings(node, value) if true(own, "qualifiedValueShapesDisjoint") else []
                    out.append(Constraint(name, (inner(value), number("qualifiedMinCount"), number("qualifiedMaxCount"), others)))
                elif form == "shape":
                    out.append(Constraint(name, [inner(value)]))
                elif form == "shapes":
                    out.append(Constraint(name, [inner(x) for x in items(value)]))
                else:
                    out.append(Constraint(name, value))
        if true(own, "closed"):
            allowed = [by[p]["path"][0] for p in own.get("property", []) if p in by and "path" in by[p]]
            out.append(Constraint("closed", (allowed, items(own["ignoredProperties"][0]) if "ignoredProperties" in own else [])))
        for x in own.get("sparql", []):
            if "select" not in by.get(x, {}):
                raise ValueError(f"the constraint {x} of {node} has no sh:select")
            if not true(by[x], "deactivated"):
                out.append(Constraint("sparql", by[x]["select"][0]))
        return out

    severity = lambda own: own.get("severity", [SH + "Violation"])[0].removeprefix(SH).lower()
    shapes = []
    for node, own in sorted(by.items()):
        targets = [(kind, x) for kind, key in (("class", "targetClass"), ("node", "targetNode"), ("subjectsOf", "targetSubjectsOf"), ("objectsOf", "targetObjectsOf")) for x in own.get(key, [])]
        if not targets and SH + "NodeShape" not in own.get("type", []):
            continue
        if not true(own, "deactivated"):
            found = inner(node)
            shapes.append(NodeShape(node, targets, found.constraints, found.properties, severity(own)))
    return shapes


def well_formed(value: Column, datatype: str) -> Column:
    """Whether a text is a lexical form of the datatype; unknown datatypes have none."""
    if datatype in (STRING, RDF + "langString"):
        return F.lit(True)
    if datatype == INTEGER or datatype in (XSD + x for x in ("int", "long", "short", "byte")):
        return value.rlike("^[+-]?[0-9]+$") & value.try_cast("bigint").isNotNull()
    if datatype == BOOLEAN:
        return F.lower(value).isin("true", "false", "1", "0")
    if datatype in NUMERIC:
        return value.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    if datatype in (DATETIME, XSD + "date"):
        return value.try_cast("timestamp").isNotNull()
    return F.lit(False)


class Validator:
    """Violations of shapes in a graph. Values of a focus node are counted and compared node by node."""

    def __init__(self, graph: Graph, byte_length: bool = False) -> None:
        self.graph, self.byte_length = graph, byte_length

    def types(self, iri: str) -> DataFrame:
        return self.graph.scan(p=TYPE, o=iri).select("s").distinct()

    def focus(self, shape: NodeShape) -> DataFrame:
        found = []
        for kind, x in shape.targets:
            if kind == "class":
                found.append(self.types(x).select(F.col("s").alias("focus")))
            elif kind == "node":
                found.append(self.graph.spark.range(1).select(F.lit(x).alias("focus")))
            elif kind == "subjectsOf":
                found.append(self.graph.scan(p=x).select(F.col("s").alias("focus")))
            else:
                found.append(self.graph.scan(p=x).where("o_kind <> 'literal'").select(F.col("o").alias("focus")))
        return reduce(DataFrame.union, found).distinct() if found else self.graph.spark.createDataFrame([], "focus string")

    def values(self, focus: DataFrame, path: S.Path) -> DataFrame:
        """(focus, v, k, d, l, n): the distinct values at the end of the path."""
        a, b = S.Var("f"), S.Var("x")
        if isinstance(path, str):
            scan = self.graph.scan(p=path)
            pairs = scan.select(F.col("s").alias("focus"), F.col("o").alias("v"), F.col("o_kind").alias("k"), F.col("o_dt").alias("d"), F.col("o_lang").alias("l"), F.col("o_num").alias("n"))
        else:
            rel = Compiler(self.graph).triples([S.Pattern(a, path, b)])
            x = rel.value("x")
            pairs = rel.df.select(rel.value("f").v.alias("focus"), x.v.alias("v"), x.k.alias("k"), x.d.alias("d"), x.l.alias("l"), x.n.alias("n"))
        return pairs.join(focus, "focus", "left_semi").distinct()

    def row(self, shape: NodeShape, component: str, path: S.Path | None, severity: str, message: str | None) -> Callable[[DataFrame], DataFrame]:
        where = F.lit(path_text(path) if path is not None else None).cast("string")

        def made(df: DataFrame) -> DataFrame:
            value = F.col("v").cast("string") if "v" in df.columns else F.lit(None).cast("string")
            said = F.lit(message) if message else F.concat(F.lit(f"{component} does not hold for "), F.col("focus"))
            return df.select(F.lit(shape.id).alias("shape"), F.col("focus").alias("focus_node"), where.alias("result_path"), value.alias("value"), F.lit(component).alias("component"), said.alias("message"), F.lit(severity).alias("severity"))

        return made

    def other(self, focus: DataFrame, iri: str) -> DataFrame:
        return self.values(focus, iri).select("focus", *(F.col(c).alias("o" + c) for c in "vkdln"))

    def failing(self, c: Constraint, values: DataFrame, focus: DataFrame) -> DataFrame:
        """Rows of values (or of focus nodes) that break a constraint."""
        v, k, d, n = (F.col(x) for x in "vkdn")
        length = F.octet_length(v) if self.byte_length else F.length(v)
        match c.component:
            case "class":
                return values.join(self.types(c.value).withColumnRenamed("s", "v"), "v", "left_anti")
            case "datatype":
                return values.where((k != "literal") | ((d != c.value) & ~((d.isin("", STRING)) & (c.value != STRING) & well_formed(v, c.value))) | ~well_formed(v, c.value))
            case "nodeKind":
                kinds = {"IRI": ["iri"], "BlankNode": ["bnode"], "Literal": ["literal"], "BlankNodeOrIRI": ["bnode", "iri"], "BlankNodeOrLiteral": ["bnode", "literal"], "IRIOrLiteral": ["iri", "literal"]}
                return values.where(~k.isin(kinds[str(c.value).removeprefix(SH)]))
            case "minCount" | "maxCount":
                counted = values.groupBy("focus").agg(F.count("*").alias("m"))
                if c.component == "maxCount":
                    return counted.where(F.col("m") > c.value).select("focus")
                return focus.join(counted, "focus", "left").where(F.coalesce("m", F.lit(0)) < c.value).select("focus")
            case "minLength":
                return values.where((k == "bnode") | (length < c.value))
            case "maxLength":
                return values.where((k == "bnode") | (length > c.value))
            case "pattern":
                marks = "".join(x for x in c.flags if x in "imsx")
                re.compile(c.value)
                return values.where((k == "bnode") | ~v.rlike((f"(?{marks})" if marks else "") + c.value))
            case "hasValue":
                return focus.join(values.where(is_one_of([c.value])).select("focus"), "focus", "left_anti")
            case "in":
                return values.where(~is_one_of(c.value))
            case "languageIn":
                fits = reduce(lambda a, b: a | b, ((F.col("l") == x.lower()) | F.startswith(F.col("l"), F.lit(x.lower() + "-")) for x in c.value), F.lit(False))
                return values.where((k != "literal") | ~fits)
            case "uniqueLang":
                if c.value not in ("true", "1"):
                    return values.limit(0)
                return values.where("l <> ''").groupBy("focus", "l").agg(F.count("*").alias("m")).where("m > 1").select("focus", F.col("l").alias("v"))
            case "equals" | "disjoint":
                theirs = self.other(focus, c.value)
                same = [F.col(x) == F.col("o" + x) for x in "vkdl"]
                mine = values.alias("a").join(theirs.alias("b"), [F.col("a.focus") == F.col("b.focus"), *same], "left_semi" if c.component == "disjoint" else "left_anti")
                if c.component == "disjoint":
                    return mine
                back = theirs.alias("b").join(values.alias("a"), [F.col("a.focus") == F.col("b.focus"), *same], "left_anti").select("focus", F.col("ov").alias("v"))
                return mine.select("focus", "v").unionByName(back)
            case "lessThan" | "lessThanOrEquals":
                theirs = self.other(focus, c.value)
                time = lambda a, b: F.when(a.isin(DATETIME, XSD + "date"), b.try_cast("timestamp"))
                mine, other = (n, time(d, v), F.when(d == STRING, v)), (F.col("on"), time(F.col("od"), F.col("ov")), F.when(F.col("od") == STRING, F.col("ov")))
                less = F.coalesce(*((a < b if c.component == "lessThan" else a <= b) for a, b in zip(mine, other, strict=True)), F.lit(False))
                return values.join(theirs, "focus").where(~less).select("focus", "v").distinct()
            case "minInclusive" | "maxInclusive" | "minExclusive" | "maxExclusive":
                bound = float(c.value)
                ok = {"minInclusive": n >= bound, "maxInclusive": n <= bound, "minExclusive": n > bound, "maxExclusive": n < bound}[c.component]
                return values.where(~F.coalesce(ok, F.lit(False)))
            case "node" | "property" | "and" | "or" | "not" | "xone":
                inner = self.inner(c.value)
                keyed, bad = self.breaking(values, inner)
                n = F.coalesce("n_bad", F.lit(0))
                broken = {"or": n == len(inner), "not": n == 0, "xone": n != len(inner) - 1}.get(c.component, n > 0)
                return keyed.join(bad, "id", "left").where(broken).select(values.columns)
            case "qualifiedValueShape":
                inner, least, most, *others = c.value
                keyed, bad = self.breaking(values, self.inner(inner))
                good = keyed.join(bad, "id", "left_anti")
                for other in others[0] if others else []:
                    good = good.join(self.breaking(values, [other])[1], "id", "left_semi")
                counted = focus.join(good.groupBy("focus").agg(F.count("*").alias("m")), "focus", "left").select("focus", F.coalesce("m", F.lit(0)).alias("m"))
                return counted.where((F.col("m") < (least or 0)) | (F.col("m") > most if most is not None else F.lit(False))).select("focus")
            case "closed":
                allowed, ignored = c.value
                every = self.graph.scan().where(~F.col("p").isin([*allowed, *ignored]))
                return every.join(focus.withColumnRenamed("focus", "s"), "s", "left_semi").select(F.col("s").alias("focus"), F.col("p").alias("v"))
            case "sparql":
                found = query(self.graph, c.value)
                named = found.select(F.col("this").alias("focus"), *([F.col("value").alias("v")] if "value" in found.columns else []))
                return named.join(focus, "focus", "left_semi")
        raise ValueError(f"unknown constraint {c.component}")

    def inner(self, value: NodeShape | list) -> list[NodeShape]:
        """The shapes of a constraint's value: shapes, a shape, or the bare constraints of one."""
        if isinstance(value, NodeShape):
            return [value]
        return list(value) if value and isinstance(value[0], NodeShape) else [NodeShape("", constraints=list(value))]

    def breaking(self, values: DataFrame, shapes: list[NodeShape]) -> tuple[DataFrame, DataFrame]:
        """The values with an id by term, and (id, n_bad): how many of the shapes a value does not conform to, if any."""
        text = F.concat(F.lit('"'), F.col("v"), F.lit('"^^'), F.coalesce("d", F.lit("")), F.lit("@"), F.coalesce("l", F.lit("")))
        keyed = values.withColumn("id", F.when(F.col("k") == "literal", text).otherwise(F.col("v")))
        nodes = keyed.select(F.col("id").alias("focus"), *"vkdln").dropDuplicates(["focus"])
        focus = nodes.select("focus")
        bad = []
        for shape in shapes:
            found = [self.failing(c, nodes, focus).select("focus") for c in shape.constraints]
            for p in shape.properties:
                reached = self.values(focus, p.path)
                found += [self.failing(c, reached, focus).select("focus") for c in p.constraints]
            bad += [reduce(DataFrame.union, found).distinct()] if found else []
        none = focus.limit(0)
        return keyed, reduce(DataFrame.union, bad, none).groupBy(F.col("focus").alias("id")).agg(F.count("*").alias("n_bad"))

    def as_nodes(self, focus: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Focus nodes as their own values."""
        kind = F.when(F.col("focus").startswith("_:"), "bnode").otherwise("iri")
        return focus.select("focus", F.col("focus").alias("v"), kind.alias("k"), F.lit("").alias("d"), F.lit("").alias("l"), F.lit(None).cast("double").alias("n")), focus

    def violations(self, shape: NodeShape) -> DataFrame:
        focus = self.focus(shape)
        found = [self.row(shape, c.component, None, shape.severity, None)(self.failing(c, *self.as_nodes(focus))) for c in shape.constraints]
        for p in shape.properties:
            values = self.values(focus, p.path)
            found += [self.row(shape, c.component, p.path, p.severity, p.message)(self.failing(c, values, focus)) for c in p.constraints]
        return reduce(DataFrame.unionByName, found) if found else self.graph.spark.createDataFrame([], REPORT)


def validate(graph: Graph | DataFrame, shapes: list[NodeShape], mode: str = "report", byte_length: bool = False) -> DataFrame:
    """The report as a table, empty if the graph conforms. Modes: report, warn (the same table), skip (none),
    fail_fast (the violations of the first shape, by id, that has any)."""
    own = graph if isinstance(graph, Graph) else QuadGraph(graph)
    validator = Validator(own, byte_length)
    none = own.spark.createDataFrame([], REPORT)
    if mode == "skip" or not shapes:
        return none
    ordered = sorted(shapes, key=lambda s: s.id)
    if mode == "fail_fast":
        for s in ordered:
            found = validator.violations(s)
            if not found.isEmpty():
                return found
        return none
    return reduce(DataFrame.unionByName, [validator.violations(s) for s in ordered])


def conforms(report: DataFrame, mode: str = "report") -> bool:
    return mode in ("warn", "skip") or report.where("severity = 'violation'").isEmpty()


def counts_by_severity(report: DataFrame) -> DataFrame:
    return report.groupBy("severity").agg(F.count("*").alias("n"))


def report_json(report: DataFrame) -> DataFrame:
    return report.select(F.to_json(F.struct(*report.columns)).alias("value"))


def report_text(report: DataFrame) -> DataFrame:
    at = F.coalesce(F.concat(F.lit(" at "), F.col("result_path")), F.lit(""))
    return report.select(F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("focus_node"), at, F.lit(": "), F.col("message")).alias("value"))


def report_turtle(report: DataFrame) -> DataFrame:
    """One validation result a row, as Turtle."""
    name = F.initcap("severity")
    text = lambda c: F.to_json(F.array(F.col(c)))
    quoted = lambda c: F.regexp_replace(text(c), r"^\[|\]$", "")
    value = F.when(F.col("value").isNotNull(), F.concat(F.lit(" ; <" + SH + "value> "), quoted("value"))).otherwise(F.lit(""))
    return report.select(F.concat(F.lit("[] a <" + SH + "ValidationResult> ; <" + SH + "focusNode> <"), F.col("focus_node"), F.lit("> ; <" + SH + "resultSeverity> <" + SH), name, F.lit("> ; <" + SH + "sourceShape> <"), F.col("shape"), F.lit("> ; <" + SH + "resultMessage> "), quoted("message"), value, F.lit(" .")).alias("value"))
