"""Query trees to DataFrame plans.

A solution table (Rel) has five columns for each variable: text, kind, datatype, language and number.
The compiler keeps, for each variable, whether it is certainly bound; certain variables join on plain
equal keys, the others on equal-or-unbound. Patterns of a basic graph pattern are ordered greedily:
few expected rows first, and always one that shares a variable with what is joined already.
Join strategies, push-down, pruning and partial aggregation are the optimizer's.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.expressions import Value, boolean, bound_iri, compile_expression, constant, same_term, sort_keys, truth
from kgspark.operators.closure import reachable, transitive_closure
from kgspark.plans import syntax as S
from kgspark.plans.syntax import QueryError, Var
from kgspark.sources.mapping import Graph, Literal
from kgspark.terms import INTEGER, SCAN_COLUMNS, node_kind, number_of

#: A colon stands in no variable name, so no column of one variable is that of another.
PARTS = ("", ":k", ":d", ":l", ":n")


def column_of(name: str) -> str:
    return "v:" + name.replace(".", "!")


@dataclass
class Rel:
    df: DataFrame
    certain: set[str] = field(default_factory=set)
    maybe: set[str] = field(default_factory=set)
    nodes: set[str] = field(default_factory=set)

    @property
    def names(self) -> set[str]:
        return self.certain | self.maybe

    def value(self, name: str, prefix: str = "") -> Value:
        c = prefix + column_of(name)
        return Value(*(F.col(f"`{c}{p}`") for p in PARTS), node=name in self.nodes)

    def columns(self) -> list[str]:
        return [column_of(n) + p for n in sorted(self.names) for p in PARTS]

    def renamed(self, prefix: str) -> DataFrame:
        return self.df.select(*(F.col(f"`{c}`").alias(prefix + c) for c in self.columns()))


def parts(name: str, x: Value) -> list[Column]:
    return [c.alias(column_of(name) + p) for c, p in zip((x.v, x.k, x.d, x.l, x.n), PARTS, strict=True)]


#: Variables that may be unbound on both sides of a join up to which their combinations are joined one by one.
SPLIT = 3


class Compiler:
    def __init__(self, graph: Graph, scope: tuple[str, object] = ("all", None), named: list[str] | None = None) -> None:
        self.graph, self.scope, self.named, self.fresh = graph, scope, named, 0

    # Scans.
    def inside(self, scope: tuple[str, object]) -> Compiler:
        out = Compiler(self.graph, scope, self.named)
        out.fresh = self.fresh + 1000
        return out

    def scan(self, s=None, p=None, o=None) -> DataFrame:
        out = self.graph.scan(s, p, o)
        kind, name = self.scope
        if kind == "dataset":
            return out.where(F.col("graph_name").isin(name))
        if kind == "named":
            return out.where(F.col("graph_name") == name)
        if kind == "var":
            out = out.where(F.col("graph_name").isNotNull())
            return out.where(F.col("graph_name").isin(self.named)) if self.named else out
        return out

    def unit(self) -> Rel:
        return Rel(self.graph.spark.range(1).select(F.lit(True).alias("__unit")))

    def pattern(self, t: S.Pattern) -> Rel:
        """Solutions of one pattern whose predicate is an IRI or a variable."""
        slots = {"s": t.s, "p": t.p, "o": t.o}
        fixed = {k: None if isinstance(x, Var) else x for k, x in slots.items()}
        df = self.scan(**fixed)
        null = F.lit(None).cast("double")
        where = {
            "s": Value(F.col("s"), node_kind(F.col("s")), F.lit(""), F.lit(""), null, node=True),
            "p": Value(F.col("p"), F.lit("iri"), F.lit(""), F.lit(""), null, node=True),
            "o": Value(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang"), F.col("o_num")),
        }
        if self.scope[0] == "var":
            slots["g"], where["g"] = Var(self.scope[1]), Value(F.col("graph_name"), F.lit("iri"), F.lit(""), F.lit(""), null, node=True)
        got: dict[str, Value] = {}
        for k, x in slots.items():
            if isinstance(x, Var):
                if x.name in got:
                    df = df.where(same_term(got[x.name], where[k]))
                else:
                    got[x.name] = where[k]
        nodes = {x.name for k, x in slots.items() if isinstance(x, Var) and k != "o"}
        if not got:
            return Rel(df.select(F.lit(True).alias("__unit")))
        return Rel(df.select(*(c for n, v in got.items() for c in parts(n, v))), set(got), set(), nodes)

    # Paths.
    def new_var(self) -> Var:
        self.fresh += 1
        return Var(f"_:.p{self.fresh}")

    def triple(self, t: S.Pattern) -> list[S.Pattern | Rel]:
        """Plain patterns, or tables for what is no plain pattern."""
        p = t.p
        match p:
            case S.Inverse(path=str() as iri):
                return [S.Pattern(t.o, iri, t.s)]
            case S.Inverse(path=inner):
                turned = {
                    S.Inverse: lambda: inner.path, S.Sequence: lambda: S.Sequence(S.Inverse(inner.then), S.Inverse(inner.first)), S.Alternative: lambda: S.Alternative(S.Inverse(inner.one), S.Inverse(inner.other)),
                    S.Repeat: lambda: S.Repeat(S.Inverse(inner.path), inner.least, inner.many), S.NegatedSet: lambda: S.NegatedSet(inner.backward, inner.forward),
                }[type(inner)]()
                return self.triple(S.Pattern(t.s, turned, t.o))
            case S.Sequence():
                middle = self.new_var()
                return [*self.triple(S.Pattern(t.s, p.first, middle)), *self.triple(S.Pattern(middle, p.then, t.o))]
            case S.Alternative():
                return [self.union(self.triples([S.Pattern(t.s, p.one, t.o)]), self.triples([S.Pattern(t.s, p.other, t.o)]))]
            case S.NegatedSet():
                out = []
                for listed, s, o in ((p.forward, t.s, t.o), (p.backward, t.o, t.s)):
                    if listed or (s is t.s and not p.backward):
                        v = self.new_var()
                        rel = self.pattern(S.Pattern(s, v, o))
                        rel.df = rel.df.where(~F.col(column_of(v.name)).isin(list(listed)))
                        out.append(self.dropped(rel, {v.name}))
                return [reduce(self.union, out)]
            case S.Repeat():
                return [self.repeat(t, p)]
        return [t]

    def dropped(self, rel: Rel, names: set[str]) -> Rel:
        keep = Rel(rel.df, rel.certain - names, rel.maybe - names, rel.nodes - names)
        keep.df = rel.df.select(*keep.columns()) if keep.names else rel.df.select(F.lit(True).alias("__unit"))
        return keep

    @staticmethod
    def encoded(x: Value) -> Column:
        """A term as one text: nodes as they are, literals quoted with datatype and language."""
        return F.when(x.k != "literal", x.v).otherwise(F.concat(F.lit('"'), x.v, F.lit('"'), x.d, F.lit("@"), x.l))

    @staticmethod
    def decoded(c: Column) -> Value:
        literal = c.startswith('"')
        part = lambda i: F.regexp_extract(c, r'(?s)^"(.*)"([^"]*)@([^@"]*)$', i)
        v, k, d = F.when(literal, part(1)).otherwise(c), F.when(literal, F.lit("literal")).otherwise(node_kind(c)), F.when(literal, part(2)).otherwise(F.lit(""))
        return Value(v, k, d, F.when(literal, part(3)).otherwise(F.lit("")), number_of(v, k, d))

    def repeat(self, t: S.Pattern, p: S.Repeat) -> Rel:
        a, b = Var("_:.from"), Var("_:.to")
        inner = self.triples([S.Pattern(a, p.path, b)])
        edges = inner.df.select(self.encoded(inner.value(a.name)).alias("a"), self.encoded(inner.value(b.name)).alias("b")).distinct()
        start, end = (None if isinstance(x, Var) else constant(x) for x in (t.s, t.o))
        seed = lambda x: self.graph.spark.range(1).select(self.encoded(x).alias("a"))
        if not p.many:
            pairs = edges
        elif start is not None:
            pairs = reachable(edges, seed(start))
        elif end is not None:
            pairs = reachable(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), seed(end)).select(F.col("b").alias("a"), F.col("a").alias("b"))
        else:
            pairs = transitive_closure(edges)
        if p.least == 0:
            if start is not None or end is not None:
                same = seed(start if start is not None else end)
            else:
                nodes = self.scan()
                object_ = Value(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang"), F.col("o_num"))
                same = nodes.select(F.col("s").alias("a")).union(nodes.select(self.encoded(object_).alias("a")))
            pairs = pairs.unionByName(same.select("a", F.col("a").alias("b"))).distinct()
        if start is not None:
            pairs = pairs.where(F.col("a") == self.encoded(start))
        if end is not None:
            pairs = pairs.where(F.col("b") == self.encoded(end))
        got = {x.name: self.decoded(F.col(c)) for x, c in ((t.s, "a"), (t.o, "b")) if isinstance(x, Var)}
        if isinstance(t.s, Var) and t.s == t.o:
            pairs = pairs.where("a = b")
        if not got:
            return Rel(pairs.select(F.lit(True).alias("__unit")))
        return Rel(pairs.select(*(c for n, v in got.items() for c in parts(n, v))), set(got))

    def star(self, group: list[S.Pattern]) -> Rel | None:
        """Solutions of patterns that share a subject variable, if the graph finds them by one scan of a table."""
        find = getattr(self.graph, "star", None)
        if find is None or self.scope[0] != "all":
            return None
        df = find([(t.p, None if isinstance(t.o, Var) else t.o) for t in group])
        if df is None:
            return None
        subject = group[0].s.name
        got = {subject: Value(F.col("s"), node_kind(F.col("s")), F.lit(""), F.lit(""), F.lit(None).cast("double"), node=True)}
        got |= {t.o.name: Value(*(F.col(f"o{i}{n}") for n in ("", "_kind", "_dt", "_lang", "_num"))) for i, t in enumerate(group) if isinstance(t.o, Var)}
        return Rel(df.select(*(c for n, v in got.items() for c in parts(n, v))), set(got), set(), {subject})

    def fused(self, patterns: list[S.Pattern | Rel]) -> list[tuple[float, S.Pattern | Rel]]:
        """Patterns and tables with a guess of their rows; stars that one scan answers are tables."""
        rows = lambda x: self.graph.size_hint(x.p if isinstance(x.p, str) else None) * (0.001 if not isinstance(x.s, Var) else 1) * (0.1 if not isinstance(x.o, Var) else 1)
        stars: dict[str, list[S.Pattern]] = {}
        for x in patterns:
            if not isinstance(x, Rel) and isinstance(x.s, Var) and isinstance(x.p, str):
                stars.setdefault(x.s.name, []).append(x)
        out, done = [], []
        for name, group in stars.items():
            objects = [x.o.name for x in group if isinstance(x.o, Var)]
            if len(group) > 1 and name not in objects and len(set(objects)) == len(objects) and (rel := self.star(group)):
                out.append((min(map(rows, group)), rel))
                done += map(id, group)
        return out + [(1.0 if isinstance(x, Rel) else rows(x), x) for x in patterns if id(x) not in done]

    def triples(self, patterns: list[S.Pattern]) -> Rel:
        todo: list[tuple[float, set[str], S.Pattern | Rel]] = []
        for rows, x in self.fused([x for t in patterns for x in self.triple(t)]):
            todo.append((rows, x.names if isinstance(x, Rel) else {y.name for y in (x.s, x.p, x.o) if isinstance(y, Var)}, x))
        out: Rel | None = None
        while todo:
            near = [x for x in todo if out is not None and x[1] & out.names] or todo
            pick = min(near, key=lambda x: x[0])
            todo = [x for x in todo if x is not pick]
            rel = pick[2] if isinstance(pick[2], Rel) else self.pattern(pick[2])
            out = rel if out is None else self.join(out, rel)
        return out or self.unit()

    # Joins.
    def keys(self, left: Rel, right: Rel, name: str) -> list[Column]:
        a, b = left.value(name), right.value(name, "r:")
        if name in left.nodes and name in right.nodes:
            return [a.v == b.v]
        if name in left.nodes:
            return [a.v == b.v, b.k != "literal"]
        if name in right.nodes:
            return [a.v == b.v, a.k != "literal"]
        return [a.v == b.v, (a.k == "literal") == (b.k == "literal"), a.d == b.d, a.l == b.l]

    def compatible(self, left: Rel, right: Rel) -> tuple[Column | None, set[str]]:
        shared = sorted(left.names & right.names)
        sure = [n for n in shared if n in left.certain and n in right.certain]
        conditions = [c for n in sure for c in self.keys(left, right, n)]
        for n in shared:
            if n not in sure:
                both = reduce(lambda x, y: x & y, self.keys(left, right, n))
                unbound = [x.value(n, f).v.isNull() for x, f in ((left, ""), (right, "r:")) if n not in x.certain]
                conditions.append(reduce(lambda x, y: x | y, [*unbound, both]))
        if shared and not sure:
            warnings.warn(f"join on {', '.join(shared)}, which may all be unbound: a nested loop", stacklevel=4)
        return (reduce(lambda x, y: x & y, conditions) if conditions else None), set(shared)

    def merged(self, df: DataFrame, left: Rel, right: Rel, optional: bool = False) -> Rel:
        out = Rel(df, left.certain | (set() if optional else right.certain), set(), (left.nodes | right.nodes) - ((left.names & right.names) - (left.nodes & right.nodes)))
        for n in left.names & right.names:
            if n in left.certain and n in left.nodes:
                out.nodes.add(n)
        out.maybe = (left.names | right.names) - out.certain
        exprs = []
        for n in sorted(out.names):
            for p in PARTS:
                c = column_of(n) + p
                if n in left.certain or n not in right.names:
                    exprs.append(F.col(f"`{c}`"))
                elif n not in left.names:
                    exprs.append(F.col(f"`r:{c}`").alias(c))
                else:
                    mine = F.col(f"`{column_of(n)}`")
                    exprs.append(F.when(mine.isNotNull(), F.col(f"`{c}`")).otherwise(F.col(f"`r:{c}`")).alias(c))
        out.df = df.select(*exprs) if exprs else df.select(F.lit(True).alias("__unit"))
        return out

    def join(self, left: Rel, right: Rel) -> Rel:
        other = right.renamed("r:") if right.names else right.df.select(F.lit(True).alias("r:unit"))
        shared = sorted(left.names & right.names)
        if shared and len(shared) <= SPLIT and not any(n in left.certain and n in right.certain for n in shared):
            return self.merged(self.split_join(left, right, other, shared), left, right)
        on, _ = self.compatible(left, right)
        return self.merged(left.df.crossJoin(other) if on is None else left.df.join(other, on), left, right)

    def split_join(self, left: Rel, right: Rel, other: DataFrame, shared: list[str]) -> DataFrame:
        """A join on variables that may all be unbound: the rows of each side are told apart by which of them
        are bound, and each pair of kinds is joined on those bound in both. Kinds that share none meet in full,
        as the standard has it."""

        def kinds(rel: Rel, prefix: str, df: DataFrame) -> list[tuple[frozenset[str], DataFrame]]:
            out = [(frozenset(), df)]
            for n in shared:
                bound = rel.value(n, prefix).v.isNotNull()
                out = [(k | {n} if yes else k, d if n in rel.certain else d.where(bound if yes else ~bound)) for k, d in out for yes in ((True,) if n in rel.certain else (True, False))]
            return out

        found = []
        for a, mine in kinds(left, "", left.df):
            for b, theirs in kinds(right, "r:", other):
                on = [c for n in sorted(a & b) for c in self.keys(left, right, n)]
                found.append(mine.join(theirs, reduce(lambda x, y: x & y, on)) if on else mine.crossJoin(theirs))
        return reduce(DataFrame.unionAll, found)

    def left_join(self, left: Rel, group: S.Group) -> Rel:
        filters = [e.condition for e in group.elements if isinstance(e, S.Filter)]
        right = self.group(S.Group([e for e in group.elements if not isinstance(e, S.Filter)]))
        inner = [f for f in filters if has_exists(f)]
        for f in inner:
            right = self.filtered(right, f)
        on, _ = self.compatible(left, right)

        scope = self.scope_of_both(left, right)
        for f in filters:
            if f not in inner:
                c = F.coalesce(truth(compile_expression(f, scope)), F.lit(False))
                on = c if on is None else on & c
        other = right.renamed("r:") if right.names else right.df.select(F.lit(True).alias("r:unit"))
        return self.merged(left.df.join(other, F.lit(True) if on is None else on, "left"), left, right, optional=True)

    def union(self, left: Rel, right: Rel) -> Rel:
        names = sorted(left.names | right.names)

        def padded(rel: Rel) -> DataFrame:
            null = Value(*(F.lit(None).cast("string"),) * 4, F.lit(None).cast("double"))
            exprs = [c for n in names for c in parts(n, rel.value(n) if n in rel.names else null)]
            return rel.df.select(*exprs) if exprs else rel.df.select(F.lit(True).alias("__unit"))

        nodes = {n for n in names if all(n in r.nodes or n not in r.names for r in (left, right))}
        certain = left.certain & right.certain
        return Rel(padded(left).unionByName(padded(right)), certain, set(names) - certain, nodes)

    def minus(self, left: Rel, right: Rel) -> Rel:
        on, shared = self.compatible(left, right)
        if not shared:
            return left
        if not any(n in left.certain and n in right.certain for n in shared):
            met = [left.value(n).v.isNotNull() & right.value(n, "r:").v.isNotNull() for n in sorted(shared)]
            on = on & reduce(lambda x, y: x | y, met)
        return Rel(left.df.join(right.renamed("r:"), on, "left_anti"), left.certain, left.maybe, left.nodes)

    def semi(self, left: Rel, e: S.Exists) -> Rel:
        """Rows with (or without) a solution of the group; its filters may name variables of the row."""
        right, outer = self.inner(left, e.group)
        on, _ = self.compatible(left, right)
        scope = self.scope_of_both(left, right)
        for f in outer:
            c = F.coalesce(truth(compile_expression(f, scope)), F.lit(False))
            on = c if on is None else on & c
        other = right.renamed("r:") if right.names else right.df.select(F.lit(True).alias("r:unit"))
        how = "left_anti" if e.negated else "left_semi"
        return Rel(left.df.join(other, F.lit(True) if on is None else on, how), left.certain, left.maybe, left.nodes)

    def inner(self, left: Rel, group: S.Group) -> tuple[Rel, list]:
        """A group's table without the filters that name variables of left alone, and those filters."""
        filters = [x.condition for x in group.elements if isinstance(x, S.Filter)]
        right = self.group(S.Group([x for x in group.elements if not isinstance(x, S.Filter)]))
        outer = [f for f in filters if (variables(f) & left.names) - right.names]
        for f in filters:
            if f not in outer:
                right = self.filtered(right, f)
            elif has_exists(f):
                raise QueryError("EXISTS within EXISTS names variables of the outer row")
        return right, outer

    def scope_of_both(self, left: Rel, right: Rel):
        """Variables of a join's condition: of left if it surely has them, else of right."""

        def scope(e: object) -> Value:
            if isinstance(e, Var):
                if e.name in left.names and (e.name in left.certain or e.name not in right.names):
                    return left.value(e.name)
                if e.name in right.names:
                    return right.value(e.name, "r:")
                return unbound()
            raise QueryError("no aggregate in a filter")

        return scope

    # Filters and expressions.
    def scope_of(self, rel: Rel, more: dict[object, Value] | None = None):
        def scope(e: object) -> Value:
            if more and e in more:
                return more[e]
            if isinstance(e, Var):
                return rel.value(e.name) if e.name in rel.names else unbound()
            if isinstance(e, S.Aggregate):
                raise QueryError("an aggregate stands outside SELECT, HAVING and ORDER BY")
            raise QueryError("EXISTS stands in an expression that is no filter")

        return scope

    def filtered(self, rel: Rel, condition: object) -> Rel:
        if isinstance(condition, S.Call) and condition.name == "&&":
            return self.filtered(self.filtered(rel, condition.args[0]), condition.args[1])
        if isinstance(condition, S.Exists):
            return self.semi(rel, condition)
        if isinstance(condition, S.Call) and condition.name == "!" and isinstance(condition.args[0], S.Exists):
            e = condition.args[0]
            return self.semi(rel, S.Exists(e.group, not e.negated))
        more: dict[object, Value] = {}
        df = rel.df
        for i, e in enumerate(find_exists(condition)):
            right, outer = self.inner(rel, e.group)
            if outer:
                raise QueryError("EXISTS inside || or ! names variables of the outer row in a filter")
            shared = sorted(rel.names & right.names)
            if any(n not in rel.certain or n not in right.certain for n in shared):
                raise QueryError("EXISTS inside || or ! wants variables that are certainly bound")
            if shared:
                cut = Rel(right.df.select(*(column_of(n) + p for n in shared for p in PARTS)).dropDuplicates([column_of(n) + p for n in shared for p in PARTS[:4]]), set(shared), set(), right.nodes)
                on = reduce(lambda x, y: x & y, [c for n in shared for c in self.keys(rel, cut, n)])
                df = df.join(cut.renamed("r:").withColumn(f"__e{i}", F.lit(True)), on, "left").drop(*("r:" + c for c in cut.columns()))
            else:
                df = df.crossJoin(right.df.limit(1).agg((F.count("*") > 0).alias(f"__e{i}")))
            flag = F.coalesce(F.col(f"__e{i}"), F.lit(False))
            more[id(e)] = boolean(~flag if e.negated else flag)
        base = self.scope_of(rel)
        scope = lambda e: more[id(e)] if isinstance(e, S.Exists) else base(e)
        df = df.where(truth(compile_expression(condition, scope)))
        return Rel(df.select(*(F.col(f"`{c}`") for c in rel.columns())) if more and rel.names else df, rel.certain, rel.maybe, rel.nodes)

    def extended(self, rel: Rel, name: str, x: Value, certain: bool = False) -> Rel:
        if name in rel.names:
            raise QueryError(f"?{name} is bound already")
        df = rel.df.select(*(F.col(f"`{c}`") for c in rel.columns()), *parts(name, x))
        out = Rel(df, rel.certain | ({name} if certain else set()), rel.maybe | (set() if certain else {name}), rel.nodes | ({name} if x.node else set()))
        return out

    # Groups.
    def group(self, g: S.Group) -> Rel:
        out: Rel | None = None
        filters = []
        add = lambda x: x if out is None else self.join(out, x)
        for e in g.elements:
            match e:
                case S.Triples():
                    out = add(self.triples(e.patterns))
                case S.Optional():
                    out = self.left_join(out or self.unit(), e.group)
                case S.Union():
                    out = add(reduce(self.union, [self.group(x) for x in e.groups]))
                case S.Minus():
                    out = self.minus(out or self.unit(), self.group(e.group))
                case S.GraphScope():
                    scope = ("var", e.name.name) if isinstance(e.name, Var) else ("named", e.name)
                    out = add(self.inside(scope).group(e.group))
                case S.Service():
                    if not e.silent:
                        raise QueryError("SERVICE: no network here; SILENT gives the empty solution")
                case S.Filter():
                    filters.append(e.condition)
                case S.Bind():
                    out = out or self.unit()
                    x = compile_expression(e.expression, self.scope_of(out))
                    out = self.extended(out, e.name, x, certain=x.constant is not None)
                case S.Values():
                    out = add(self.values(e))
                case S.Group():
                    out = add(self.group(e))
                case S.Query():
                    out = add(self.select(e))
        out = out or self.unit()
        for f in filters:
            out = self.filtered(out, f)
        return out

    def values(self, e: S.Values) -> Rel:
        rows = []
        for row in e.rows:
            flat: list = []
            for x in row:
                if x is None:
                    flat += [None] * 5
                elif isinstance(x, Literal):
                    try:
                        n = float(x.value) if x.datatype in NUMERICS else None
                    except ValueError:
                        n = None
                    flat += [x.value, "literal", x.datatype, x.language, n]
                else:
                    flat += [x, "bnode" if x.startswith("_:") else "iri", "", "", None]
            rows.append(tuple(flat))
        schema = ", ".join(f"`{column_of(n)}{p}` {'double' if p == ':n' else 'string'}" for n in e.names for p in PARTS)
        certain = {n for i, n in enumerate(e.names) if all(r[i] is not None for r in e.rows)}
        nodes = {n for i, n in enumerate(e.names) if all(not isinstance(r[i], Literal) for r in e.rows)}
        return Rel(self.graph.spark.createDataFrame(rows, schema), certain, set(e.names) - certain, nodes)

    # Query forms.
    def select(self, q: S.Query) -> Rel:
        """Group, having, extend, order, project, distinct, slice: in this order."""
        rel = self.group(q.where)
        found = [a for _, e in q.select for a in find_aggregates(e)] + [a for e in q.having for a in find_aggregates(e)] + [a for e, _ in q.order_by for a in find_aggregates(e)]
        more: dict[object, Value] = {}
        if found or q.group_by:
            rel, more = self.grouped(rel, q, list(dict.fromkeys(found)))
        for e in q.having:
            rel = Rel(rel.df.where(truth(compile_expression(e, self.scope_of(rel, more)))), rel.certain, rel.maybe, rel.nodes)
        names = [n for n, _ in q.select] if not q.star else sorted(n for n in rel.names if not n.startswith("_:"))
        hidden = sorted({c for x in more.values() for c in [x.tag]}) if more else []
        for name, e in q.select:
            if e is not None:
                x = compile_expression(e, self.scope_of(rel, more))
                kept = [F.col(f"`{c}`") for c in (*rel.columns(), *hidden)]
                rel = Rel(rel.df.select(*kept, *parts(name, x)), rel.certain, rel.maybe | {name}, rel.nodes | ({name} if x.node else set()))
        order = [k for e, down in q.order_by for k in sort_keys(compile_expression(e, self.scope_of(rel, more)), down)]
        if order and not q.distinct:
            rel.df = rel.df.orderBy(*order)
        shown = set(names)
        out = Rel(rel.df, rel.certain & shown, (rel.maybe & shown) | (shown - rel.names), rel.nodes & shown)
        missing = shown - rel.names
        exprs = [c for n in sorted(shown) for c in parts(n, unbound() if n in missing else rel.value(n))]
        out.df = out.df.select(*exprs) if exprs else out.df.select(F.lit(True).alias("__unit"))
        if q.distinct:
            out.df = out.df.dropDuplicates([column_of(n) + p for n in sorted(shown) for p in PARTS[:4]])
            if order:
                out.df = out.df.orderBy(*(k for e, down in q.order_by for k in sort_keys(compile_expression(e, self.scope_of(out, more)), down)))
        if q.offset:
            out.df = out.df.offset(q.offset)
        if q.limit is not None:
            out.df = out.df.limit(q.limit)
        return out

    def grouped(self, rel: Rel, q: S.Query, found: list[S.Aggregate]) -> tuple[Rel, dict[object, Value]]:
        keys = []
        for i, (name, e) in enumerate(q.group_by):
            keys.append((name or f"_:.g{i}", compile_expression(e, self.scope_of(rel)), e))
        df = rel.df.select("*", *(c for i, (_, x, _) in enumerate(keys) for c in (y.alias(f"__g{i}{p}") for y, p in zip((x.v, x.k, x.d, x.l, x.n), PARTS, strict=True))))
        by = [f"__g{i}{p}" for i in range(len(keys)) for p in PARTS[:4]]
        aggs, after = [], []
        for i, a in enumerate(found):
            x = compile_expression(a.arg, self.scope_of(rel)) if a.arg is not None else None
            row = F.struct(*(F.col(f"`{c}`") for c in rel.columns() if not c.endswith(":n"))) if rel.names else F.lit(1)
            term = row if x is None else x.v if x.node else F.when(x.v.isNotNull(), F.struct(x.v, F.coalesce(x.k == "literal", F.lit(False)), x.d, x.l))
            tag = f"__a{i}"
            if a.name == "COUNT":
                made = F.count("*") if x is None and not a.distinct else F.count_distinct(term) if a.distinct else F.count(x.v)
                aggs.append(made.alias(tag))
                after.append((a, tag, lambda c: Value(c.cast("string"), F.lit("literal"), F.lit(INTEGER), F.lit(""), c.cast("double"))))
            elif a.name in ("SUM", "AVG"):
                made = {("SUM", False): F.sum, ("SUM", True): F.sum_distinct, ("AVG", False): F.avg, ("AVG", True): lambda n: F.try_divide(F.sum_distinct(n), F.count_distinct(n))}[a.name, a.distinct](x.n)
                aggs.append(F.coalesce(made, F.lit(0.0)).alias(tag))
                after.append((a, tag, numeric))
            elif a.name in ("MIN", "MAX"):
                pick = F.min if a.name == "MIN" else F.max
                full = F.when(x.v.isNotNull() & x.n.isNull(), F.struct(x.v.alias("v"), x.k.alias("k"), x.d.alias("d"), x.l.alias("l")))
                aggs += [F.struct(pick(x.n).alias("n"), pick(full).alias("t")).alias(tag)]
                after.append((a, tag, lambda c: Value(F.coalesce(c["n"].cast("string"), c["t"]["v"]), F.when(c["n"].isNotNull(), F.lit("literal")).otherwise(c["t"]["k"]), F.when(c["n"].isNotNull(), F.lit(DOUBLES)).otherwise(c["t"]["d"]), F.when(c["n"].isNotNull(), F.lit("")).otherwise(c["t"]["l"]), c["n"])))
            elif a.name == "GROUP_CONCAT":
                gathered = F.collect_set(x.v) if a.distinct else F.collect_list(x.v)
                aggs.append(F.array_join(F.sort_array(gathered), a.separator).alias(tag))
                after.append((a, tag, lambda c: Value(c, F.lit("literal"), F.lit(STRINGS), F.lit(""), F.lit(None).cast("double"))))
            else:  # SAMPLE: the smallest, so that runs agree
                aggs.append(F.min(F.when(x.v.isNotNull(), F.struct(x.v.alias("v"), x.k.alias("k"), x.d.alias("d"), x.l.alias("l"), x.n.alias("n")))).alias(tag))
                after.append((a, tag, lambda c: Value(c["v"], c["k"], c["d"], c["l"], c["n"])))
        first = [F.first(f"__g{i}:n").alias(f"__g{i}:n") for i in range(len(keys))]
        out = df.groupBy(*by).agg(*aggs, *first) if aggs or first else df.select(*by).distinct()
        named = [F.col(f"__g{i}{p}").alias(column_of(n) + p) for i, (n, _, _) in enumerate(keys) for p in PARTS]
        out = out.select(*named, *(t for _, t, _ in after))
        certain = {n for n, x, e in keys if x.constant is not None or (isinstance(e, Var) and e.name in rel.certain)}
        grouped = Rel(out, certain, {n for n, _, _ in keys} - certain, {n for n, x, _ in keys if x.node})
        more: dict[object, Value] = {}
        for a, tag, make in after:
            more[a] = make(F.col(tag))
            more[a].tag = tag
        for n, _, e in keys:
            if not isinstance(e, Var):
                more[e] = grouped.value(n)
                more[e].tag = column_of(n)
        return grouped, more

    def run(self, q: S.Query, types: dict[str, str] | None = None) -> DataFrame:
        if q.from_default or q.from_named:
            self.scope, self.named = ("dataset", q.from_default) if q.from_default else self.scope, q.from_named or None
        if q.form == "ask":
            return self.group(q.where).df.select(F.lit(1).alias("x")).limit(1).agg((F.count("*") > 0).alias("ask"))
        if q.form == "construct":
            return self.construct(q)
        if q.form == "describe":
            return self.describe(q)
        rel = self.select(q)
        names = [n for n, _ in q.select] if not q.star else sorted(rel.names)
        return rel.df.select(*(self.flat(rel, n, (types or {}).get(n)) for n in names)) if names else rel.df

    def flat(self, rel: Rel, name: str, kind: str | None) -> Column:
        x = rel.value(name)
        if kind in ("double", "float", "decimal", "bigint", "int", "long"):
            return x.n.cast(kind).alias(name)
        return (x.v.try_cast(kind) if kind else x.v).alias(name)

    def construct(self, q: S.Query) -> DataFrame:
        solutions = S.Query(star=True, where=q.where, order_by=q.order_by, limit=q.limit, offset=q.offset)
        rel = self.select(solutions)
        mark = F.xxhash64(*(F.coalesce(F.col(f"`{column_of(n)}`"), F.lit("")) for n in sorted(rel.names))) if rel.names else F.lit(0)

        def slot(x: object) -> Value:
            if isinstance(x, Var):
                if x.name in rel.names:
                    return rel.value(x.name)
                if x.name.startswith("_:"):
                    return bound_iri(F.concat(F.lit(x.name + "-"), F.hex(mark)))
                return unbound()
            return constant(x)

        rows = []
        for t in q.template:
            s, p, o = slot(t.s), slot(t.p), slot(t.o)
            legal = (s.k != "literal") & (p.k == "iri") & o.v.isNotNull()
            rows.append(F.when(legal, F.struct(s.v.alias("s"), p.v.alias("p"), o.v.alias("o"), o.k.alias("o_kind"), o.d.alias("o_dt"), o.l.alias("o_lang"))))
        return rel.df.select(F.explode(F.array_compact(F.array(*rows))).alias("t")).select("t.*").distinct()

    def describe(self, q: S.Query) -> DataFrame:
        """The triples whose subject is one of the resources."""
        fixed = [x for x in q.describe if isinstance(x, str)]
        names = [x.name for x in q.describe if isinstance(x, Var)]
        parts_ = [self.scan(s=x) for x in fixed]
        if q.star or names:
            rel = self.select(S.Query(star=True, where=q.where, order_by=q.order_by, limit=q.limit, offset=q.offset))
            for n in names or sorted(rel.names):
                wanted = rel.df.where(F.col(f"`{column_of(n)}:k`") != "literal").select(F.col(f"`{column_of(n)}`").alias("r:s")).distinct()
                parts_.append(self.scan().join(wanted, F.col("s") == F.col("r:s"), "left_semi"))
        cols = [c for c in SCAN_COLUMNS[:6]]
        return reduce(DataFrame.unionByName, [x.select(*cols) for x in parts_]).distinct() if parts_ else self.scan().select(*cols).limit(0)


from kgspark.terms import DOUBLE as DOUBLES  # noqa: E402
from kgspark.terms import NUMERIC as NUMERICS  # noqa: E402
from kgspark.terms import STRING as STRINGS  # noqa: E402


def numeric(c: Column) -> Value:
    return Value(c.cast("string"), F.lit("literal"), F.lit(DOUBLES), F.lit(""), c.cast("double"))


def unbound() -> Value:
    return Value(*(F.lit(None).cast("string"),) * 4, F.lit(None).cast("double"))


def children(e: object) -> tuple:
    return e.args if isinstance(e, S.Call) else ()


def find_aggregates(e: object) -> list[S.Aggregate]:
    return [e] if isinstance(e, S.Aggregate) else [a for x in children(e) for a in find_aggregates(x)]


def find_exists(e: object) -> list[S.Exists]:
    return [e] if isinstance(e, S.Exists) else [a for x in children(e) for a in find_exists(x)]


def has_exists(e: object) -> bool:
    return bool(find_exists(e))


def variables(e: object) -> set[str]:
    return {e.name} if isinstance(e, Var) else {n for x in children(e) for n in variables(x)}


def query(graph: Graph, text: str, types: dict[str, str] | None = None, prefixes: dict[str, str] | None = None) -> DataFrame:
    """The result of a query: a table of texts (or of the types asked for) with a column for each variable,
    triples for CONSTRUCT and DESCRIBE, one row `ask` for ASK."""
    return Compiler(graph).run(S.parse(text, prefixes), types)
