"""OWL: the Lite hierarchy and consistency, and DL instance checks over class expressions.

Class expressions are small trees on the driver; instances() turns one into a plan of semi- and
anti-joins over the quads. Complement is closed-world. Cardinalities count distinct fillers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.operators.closure import components, transitive_closure
from kgspark.operators.rdfs import edges, lifted_types, node_triples
from kgspark.terms import OWL, RDF, RDFS, SUBCLASS, TYPE, as_quads

THING, NOTHING = OWL + "Thing", OWL + "Nothing"
#: Namespaces whose terms are vocabulary and no individuals or properties of a user.
VOCABULARY = (RDF, RDFS, OWL)


# Class expressions. A named class is its IRI as text.
@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class OneOf:
    individuals: tuple[str, ...]


@dataclass(frozen=True)
class Some:
    property: object
    filler: object


@dataclass(frozen=True)
class All:
    property: object
    filler: object


@dataclass(frozen=True)
class HasValue:
    property: object
    value: str


@dataclass(frozen=True)
class Cardinality:
    property: object
    least: int = 0
    most: int | None = None
    filler: object = THING


@dataclass(frozen=True)
class InverseOf:
    property: str


class Ontology:
    """Views of the quads; hierarchy and types are worked out once."""

    def __init__(self, quads: DataFrame) -> None:
        self.quads = as_quads(quads)
        self._below: DataFrame | None = None
        self._inverses: list[tuple[str, str]] | None = None

    def declared(self, kind: str) -> DataFrame:
        """Things declared as Class, ObjectProperty, NamedIndividual and so on."""
        return self.quads.where((F.col("p") == TYPE) & (F.col("o") == OWL + kind)).select("s").distinct()

    @property
    def below(self) -> DataFrame:
        """(a, b): class a is below b, equivalence counting both ways, without self loops."""
        if self._below is None:
            same = edges(self.quads, OWL + "equivalentClass")
            every = edges(self.quads, SUBCLASS).union(edges(self.quads, OWL + "subClassOf")).union(same).union(same.select(F.col("b"), F.col("a")))
            self._below = transitive_closure(every).where("a <> b")
        return self._below

    def asserted_types(self) -> DataFrame:
        own = edges(self.quads, TYPE)
        return own.where(~F.col("b").startswith(OWL) | F.col("b").isin(NOTHING, THING))

    def types(self) -> DataFrame:
        """(a, b): individual a is in class b, by assertion or hierarchy."""
        own = self.asserted_types()
        return own.unionByName(lifted_types(own, self.below)).distinct()

    def superclasses(self, iri: str) -> DataFrame:
        return self._with_itself(self.below.where(F.col("a") == iri).select(F.col("b").alias("class")), iri)

    def subclasses(self, iri: str) -> DataFrame:
        return self._with_itself(self.below.where(F.col("b") == iri).select(F.col("a").alias("class")), iri)

    def _with_itself(self, classes: DataFrame, iri: str) -> DataFrame:
        return classes.union(self.quads.sparkSession.range(1).select(F.lit(iri).alias("class"))).distinct()

    def is_subsumed_by(self, low: str, high: str) -> bool:
        return low == high or high == THING or not self.below.where((F.col("a") == low) & (F.col("b") == high)).isEmpty()

    def is_instance_of(self, individual: str, iri: str) -> bool:
        return not self.types().where((F.col("a") == individual) & (F.col("b") == iri)).isEmpty()

    def realized(self) -> DataFrame:
        """(individual, class): the lowest classes of each individual."""
        types = self.types()
        same = self.below.select("a", "b").intersect(self.below.select(F.col("b").alias("a"), F.col("a").alias("b")))
        strict = types.join(self.below.subtract(same).select(F.col("a").alias("low"), F.col("b").alias("class")), types["b"] == F.col("low")).select("a", F.col("class").alias("b")).distinct()
        return types.join(strict, ["a", "b"], "left_anti").select(F.col("a").alias("individual"), F.col("b").alias("class"))

    def inferred_axioms(self) -> DataFrame:
        """Sub-class and type triples that follow."""
        return node_triples(self.below, SUBCLASS).unionByName(node_triples(self.types(), TYPE))

    def lite_axioms(self) -> DataFrame:
        """The axioms between names alone: class, property, individual and type axioms without expressions."""
        predicates = [SUBCLASS, OWL + "equivalentClass", OWL + "disjointWith", RDFS + "subPropertyOf", RDFS + "domain", RDFS + "range", OWL + "equivalentProperty", OWL + "inverseOf", OWL + "sameAs", OWL + "differentFrom", TYPE]
        user = ~reduce(lambda a, b: a | b, (F.col("p").startswith(v) for v in VOCABULARY))
        named = ~F.col("s").startswith("_:") & (~F.col("o").startswith("_:") | (F.col("o_kind") == "literal"))
        return self.quads.where((F.col("p").isin(predicates) | user) & named)

    # Properties.
    def links(self, prop: object) -> DataFrame:
        """(x, y, literal) over a property or its inverse, declared inverses followed."""
        if isinstance(prop, InverseOf):
            return self.links(prop.property).where("not literal").select(F.col("y").alias("x"), F.col("x").alias("y"), "literal")
        literal = F.col("o_kind") == "literal"
        own = self.quads.where(F.col("p") == prop).select(F.col("s").alias("x"), F.col("o").alias("y"), literal.alias("literal"))
        others = {b for a, b in self.inverses() if a == prop} | {a for a, b in self.inverses() if b == prop}
        if not others:
            return own.distinct()
        back = self.quads.where(F.col("p").isin(sorted(others)) & ~literal).select(F.col("o").alias("x"), F.col("s").alias("y"), F.lit(False).alias("literal"))
        return own.unionByName(back).distinct()

    def inverses(self, limit: int = 100_000) -> list[tuple[str, str]]:
        """The declared inverses, which must be at most `limit`; read once."""
        if self._inverses is None:
            rows = edges(self.quads, OWL + "inverseOf").limit(limit + 1).collect()
            if len(rows) > limit:
                raise ValueError(f"more than {limit} inverse properties are declared")
            self._inverses = [tuple(r) for r in rows]
        return self._inverses

    def property_closure(self) -> DataFrame:
        """Triples that symmetric, transitive and inverse declarations add."""
        kinds = lambda k: self.declared(k).select(F.col("s").alias("q"))
        node = self.quads.where("o_kind <> 'literal'").select("s", "p", "o")
        mirrored = node.join(kinds("SymmetricProperty"), F.col("p") == F.col("q"), "left_semi").select(F.col("o").alias("s"), "p", F.col("s").alias("o"))
        every = node.unionByName(mirrored).distinct()
        keyed = every.join(kinds("TransitiveProperty"), F.col("p") == F.col("q"), "left_semi")
        mark = "\x01"
        pairs = transitive_closure(keyed.select(F.concat_ws(mark, "p", "s").alias("a"), F.concat_ws(mark, "p", "o").alias("b")))
        far = pairs.select(F.split("a", mark)[1].alias("s"), F.split("a", mark)[0].alias("p"), F.split("b", mark)[1].alias("o"))
        return mirrored.unionByName(far).distinct()

    def functional_violations(self) -> DataFrame:
        """(property, node, n): more than one value of a functional, or subject of an inverse functional property."""

        def over(kind: str, key: str, other: str) -> DataFrame:
            props = self.declared(kind).select(F.col("s").alias("q"))
            return self.quads.join(props, F.col("p") == F.col("q"), "left_semi").groupBy("p", key).agg(F.count_distinct(other, "o_kind", "o_dt", "o_lang").alias("n")).where("n > 1").select(F.col("p").alias("property"), F.col(key).alias("node"), "n")

        return over("FunctionalProperty", "s", "o").unionByName(over("InverseFunctionalProperty", "o", "s"))

    def property_violations(self) -> DataFrame:
        """(kind, s, p, o): links against asymmetric, irreflexive and disjoint property declarations."""
        node = self.quads.where("o_kind <> 'literal'").select("s", "p", "o")
        of = lambda k: node.join(self.declared(k).select(F.col("s").alias("q")), F.col("p") == F.col("q"), "left_semi")
        asymmetric = of("AsymmetricProperty")
        back = asymmetric.select(F.col("s").alias("o"), "p", F.col("o").alias("s"))
        found = asymmetric.join(back, ["s", "p", "o"], "left_semi").select(F.lit("asymmetric").alias("kind"), "s", "p", "o")
        found = found.unionByName(of("IrreflexiveProperty").where("s = o").select(F.lit("irreflexive").alias("kind"), "s", "p", "o"))
        apart = edges(self.quads, OWL + "propertyDisjointWith")
        other = node.select("s", F.col("p").alias("b"), "o")
        both = node.join(apart, node["p"] == apart["a"]).select("s", "p", "o", "b").join(other, ["s", "b", "o"], "left_semi")
        return found.unionByName(both.select(F.lit("disjoint").alias("kind"), "s", "p", "o"))

    # Same and different individuals.
    def same_individuals(self) -> DataFrame:
        """(node, component) over owl:sameAs."""
        return components(edges(self.quads, OWL + "sameAs"))

    # Instance checks.
    def individuals(self) -> DataFrame:
        """Subjects and objects of user triples, and of type assertions to user classes."""
        user = ~reduce(lambda a, b: a | b, (F.col("p").startswith(v) for v in VOCABULARY))
        typed = (F.col("p") == TYPE) & ~F.col("o").startswith(OWL) & ~F.col("o").startswith(RDFS)
        same = F.col("p").isin(OWL + "sameAs", OWL + "differentFrom")
        subjects = self.quads.where(user | typed | same).select(F.col("s").alias("x"))
        objects = self.quads.where((user | same) & (F.col("o_kind") != "literal")).select(F.col("o").alias("x"))
        named = self.quads.where((F.col("p") == TYPE) & F.col("o").isin(OWL + "NamedIndividual", THING, NOTHING)).select(F.col("s").alias("x"))
        return subjects.union(objects).union(named).distinct()

    def instances(self, e: object) -> DataFrame:
        """x: the individuals of a class expression."""
        match e:
            case str():
                if e == THING:
                    return self.individuals()
                if e == NOTHING:
                    return self.asserted_types().where(F.col("b") == NOTHING).select(F.col("a").alias("x")).distinct()
                low = self.subclasses(e).select(F.col("class").alias("b"))
                return self.asserted_types().join(low, "b", "left_semi").select(F.col("a").alias("x")).distinct()
            case And():
                return reduce(lambda a, b: a.join(b, "x", "left_semi"), (self.instances(p) for p in e.parts))
            case Or():
                return reduce(DataFrame.union, (self.instances(p) for p in e.parts)).distinct()
            case Not():
                return self.individuals().join(self.instances(e.part), "x", "left_anti")
            case OneOf():
                return self.individuals().where(F.col("x").isin(list(e.individuals)))
            case Some():
                return self._with_filler(e.property, e.filler).select("x").distinct()
            case All():
                links = self.links(e.property)
                bad = links.join(self.instances(e.filler).select(F.col("x").alias("y")), "y", "left_anti")
                return self.individuals().join(bad.select("x"), "x", "left_anti")
            case HasValue():
                return self.links(e.property).where(F.col("y") == e.value).select("x").distinct()
            case Cardinality():
                counted = self._with_filler(e.property, e.filler).groupBy("x").agg(F.count_distinct("y", "literal").alias("n"))
                bound = (F.col("n") >= e.least) & (F.col("n") <= e.most if e.most is not None else F.lit(True))
                if e.least > 0:
                    return counted.where(bound).select("x")
                return self.individuals().join(counted, "x", "left").where(bound | F.col("n").isNull()).select("x")
        raise ValueError(f"no class expression: {e!r}")

    def _with_filler(self, prop: object, filler: object) -> DataFrame:
        links = self.links(prop)
        return links if filler == THING else links.where("not literal").join(self.instances(filler).select(F.col("x").alias("y")), "y", "left_semi")

    # The TBox on the driver.
    def expressions(self, limit: int = 100_000) -> dict[str, object]:
        """Class expressions by the node that carries them. The TBox must have at most `limit` triples."""
        names = ["intersectionOf", "unionOf", "complementOf", "oneOf", "onProperty", "someValuesFrom", "allValuesFrom", "hasValue", "minCardinality", "maxCardinality", "cardinality", "minQualifiedCardinality", "maxQualifiedCardinality", "qualifiedCardinality", "onClass", "inverseOf"]
        wanted = [OWL + n for n in names] + [RDF + "first", RDF + "rest"]
        rows = self.quads.where(F.col("p").isin(wanted)).select("s", "p", "o").limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"the TBox has more than {limit} triples")
        by: dict[str, dict[str, str]] = {}
        for r in rows:
            by.setdefault(r["s"], {})[r["p"].removeprefix(OWL).removeprefix(RDF)] = r["o"]

        def items(head: str) -> list[str]:
            out, seen = [], set()
            while head in by and "first" in by[head]:
                if head in seen:
                    raise ValueError(f"the list at {head} is cyclic")
                seen.add(head)
                out.append(by[head]["first"])
                head = by[head].get("rest", "")
            return out

        def prop(node: str) -> object:
            own = by.get(node, {})
            return InverseOf(own["inverseOf"]) if node.startswith("_:") and "inverseOf" in own else node

        def read(node: str, path: tuple = ()) -> object:
            own = by.get(node, {})
            if node in path:
                raise ValueError(f"the expression at {node} contains itself")
            deeper = (*path, node)
            if "intersectionOf" in own:
                return And(tuple(read(x, deeper) for x in items(own["intersectionOf"])))
            if "unionOf" in own:
                return Or(tuple(read(x, deeper) for x in items(own["unionOf"])))
            if "complementOf" in own:
                return Not(read(own["complementOf"], deeper))
            if "oneOf" in own:
                return OneOf(tuple(items(own["oneOf"])))
            restrictions = set(own) & {"someValuesFrom", "allValuesFrom", "hasValue"} | {k for k in own if k.lower().endswith("cardinality")}
            if not restrictions:
                return node
            if "onProperty" not in own:
                raise ValueError(f"the restriction {node} has no owl:onProperty")
            p, kind = prop(own["onProperty"]), sorted(restrictions)[0]
            if kind == "someValuesFrom":
                return Some(p, read(own[kind], deeper))
            if kind == "allValuesFrom":
                return All(p, read(own[kind], deeper))
            if kind == "hasValue":
                return HasValue(p, own[kind])
            n, filler = int(own[kind]), read(own["onClass"], deeper) if "onClass" in own else THING
            low = kind.lower()
            return Cardinality(p, n if not low.startswith("max") else 0, n if not low.startswith("min") else None, filler)

        return {node: read(node) for node, own in by.items() if set(own) - {"first", "rest", "onClass", "inverseOf"}}

    def defined_instances(self) -> DataFrame:
        """(x, class): members of classes that are equivalent to an expression."""
        known = self.expressions()
        pairs = [(r["a"], r["b"]) for r in edges(self.quads, OWL + "equivalentClass").where(F.col("b").isin(list(known))).collect()] if known else []
        pairs += [(n, n) for n in known if not n.startswith("_:")]
        found = [self.instances(known[b]).select("x", F.lit(a).alias("class")) for a, b in pairs]
        return reduce(DataFrame.union, found).distinct() if found else self.quads.sparkSession.createDataFrame([], "x string, class string")

    # Consistency.
    def clashes(self) -> DataFrame:
        """(kind, x, detail): what makes the ontology inconsistent. Disjunctions are not branched on."""
        rep = self.same_individuals()
        moved = lambda df, c: df.join(rep, df[c] == rep["node"], "left").withColumn(c, F.coalesce("component", c)).drop("node", "component")
        types = moved(self.types(), "a").distinct()
        out = types.where(F.col("b") == NOTHING).select(F.lit("nothing").alias("kind"), F.col("a").alias("x"), F.col("b").alias("detail"))
        apart = edges(self.quads, OWL + "disjointWith")
        pairs = apart.union(apart.select("b", "a")).select(F.col("a").alias("left"), F.col("b").alias("right")).distinct()
        met = types.join(pairs, types["b"] == pairs["left"]).select("a", F.col("right").alias("b"), F.col("left").alias("one"))
        both = met.join(types, ["a", "b"], "left_semi").where("one < b or one = b")
        out = out.unionByName(both.select(F.lit("disjoint").alias("kind"), F.col("a").alias("x"), F.concat_ws(" ", "one", "b").alias("detail")))
        not_of = edges(self.quads, OWL + "complementOf").select(F.col("a").alias("left"), F.col("b").alias("right"))
        contrary = types.join(not_of, types["b"] == not_of["left"]).select("a", F.col("right").alias("b")).join(types, ["a", "b"], "left_semi")
        out = out.unionByName(contrary.select(F.lit("complement").alias("kind"), F.col("a").alias("x"), F.col("b").alias("detail")))
        different = moved(moved(edges(self.quads, OWL + "differentFrom"), "a"), "b")
        out = out.unionByName(different.where("a = b").select(F.lit("same_and_different").alias("kind"), F.col("a").alias("x"), F.col("b").alias("detail")))
        for node, e in self.expressions().items():
            if isinstance(e, Cardinality) and e.most is not None:
                over = self._distinct_fillers(e, moved)
                members = types.where(F.col("b") == node).select(F.col("a").alias("x")).distinct()
                out = out.unionByName(over.join(members, "x", "left_semi").select(F.lit("max_cardinality").alias("kind"), "x", F.lit(node).alias("detail")))
        return out.distinct()

    def _distinct_fillers(self, e: Cardinality, moved: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
        """x with more fillers than e allows that are all declared different from one another.

        moved puts the representative of owl:sameAs in the place of a column. Sets of such fillers grow one by
        one, in order, each with those that may still join it, so only sets that can reach the size are kept.
        """
        links = moved(moved(self._with_filler(e.property, e.filler).select("x", "y"), "x"), "y").distinct()
        if e.most == 0:
            return links.select("x").distinct()
        different = moved(moved(edges(self.quads, OWL + "differentFrom"), "a"), "b")
        known = different.union(different.select("b", "a")).where("a < b").distinct()
        pairs = links.select("x", F.col("y").alias("a")).join(known, "a").join(links.select("x", F.col("y").alias("b")), ["x", "b"])
        after = pairs.groupBy("x", "a").agg(F.collect_set("b").alias("after"))
        sets = after.select("x", F.col("after").alias("left"))
        for size in range(2, e.most + 1):
            sets = sets.where(F.size("left") > e.most + 1 - size).select("x", "left", F.explode("left").alias("a"))
            sets = sets.join(after, ["x", "a"]).select("x", F.array_intersect("left", "after").alias("left"))
        return sets.where(F.size("left") > 0).select("x").distinct()

    def is_consistent(self) -> bool:
        return self.clashes().isEmpty()
