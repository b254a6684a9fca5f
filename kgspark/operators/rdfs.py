"""RDFS entailment: rules 2, 3, 5, 7, 9 and 11, to their fixpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.checkpoints import small
from kgspark.operators.closure import transitive_closure
from kgspark.terms import DOMAIN, RANGE, SUBCLASS, SUBPROPERTY, TYPE, as_quads

COLUMNS = ("s", "p", "o", "o_kind", "o_dt", "o_lang")


def edges(quads: DataFrame, predicate: str) -> DataFrame:
    return quads.where((F.col("p") == predicate) & (F.col("o_kind") != "literal")).select(F.col("s").alias("a"), F.col("o").alias("b"))


def node_triples(pairs: DataFrame, predicate: str) -> DataFrame:
    """(a, b) as triples with a node object."""
    kind = F.when(F.col("b").startswith("_:"), "bnode").otherwise("iri")
    return pairs.select(F.col("a").alias("s"), F.lit(predicate).alias("p"), F.col("b").alias("o"), kind.alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang"))


def hierarchy(quads: DataFrame, predicate: str = SUBCLASS, compat: bool = False) -> DataFrame:
    """(a, b): a is below b, without self loops; compat stops at two hops."""
    return transitive_closure(edges(as_quads(quads), predicate), two_hop=compat).where("a <> b")


def inherited(quads: DataFrame, below: DataFrame) -> DataFrame:
    """rdfs7: triples of a property hold for the properties above it."""
    return quads.join(below, quads["p"] == below["a"]).select("s", F.col("b").alias("p"), "o", "o_kind", "o_dt", "o_lang")


def domain_types(quads: DataFrame) -> DataFrame:
    """rdfs2, all domains of a property."""
    rule = edges(quads, DOMAIN)
    return quads.join(rule, quads["p"] == rule["a"]).select(F.col("s").alias("a"), "b").distinct()


def range_types(quads: DataFrame) -> DataFrame:
    """rdfs3, all ranges of a property; literals are no subjects."""
    rule = edges(quads, RANGE)
    return quads.where("o_kind <> 'literal'").join(rule, quads["p"] == rule["a"]).select(F.col("o").alias("a"), "b").distinct()


def lifted_types(types: DataFrame, below: DataFrame) -> DataFrame:
    """rdfs9: (a, b) for each (a, c) of types with c below b."""
    up = below.select(F.col("a").alias("class"), F.col("b").alias("above"))
    return types.join(up, types["b"] == up["class"]).select("a", F.col("above").alias("b"))


def inferred_types(quads: DataFrame) -> DataFrame:
    """(a, b): asserted types and, by rdfs9, those that follow from the class hierarchy."""
    own = edges(as_quads(quads), TYPE)
    return own.unionByName(lifted_types(own, hierarchy(quads))).distinct()


def property_schema(every: DataFrame, limit: int = 100_000) -> tuple[set[tuple[str, str]], dict[str, set[str]], dict[str, set[str]]]:
    """The pairs of properties one below the other, and the domains and ranges by property, all that follows included.

    Properties may themselves be declared below rdfs:subPropertyOf, rdfs:domain and rdfs:range; reading is repeated
    until no such property is new. The driver holds the schema, which must have at most `limit` of these triples.
    """
    kinds = (SUBPROPERTY, DOMAIN, RANGE)
    wanted = set(kinds)
    while True:
        rows = every.where(F.col("p").isin(sorted(wanted)) & (F.col("o_kind") != "literal")).select("s", "p", "o").distinct().limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"the schema of properties has more than {limit} triples")
        above: dict[str, set[str]] = {}
        grown = True
        while grown:
            grown = False
            for s, p, o in rows:
                if p == SUBPROPERTY or SUBPROPERTY in above.get(p, ()):
                    grown |= o not in above.setdefault(s, set())
                    above[s].add(o)
            for own in above.values():
                far = set().union(*(above.get(q, ()) for q in own)) - own
                grown |= bool(far)
                own |= far
        more = {p for p, own in above.items() if own & set(kinds)} - wanted
        if not more:
            break
        wanted |= more
    stands_for = lambda p, kind: p == kind or kind in above.get(p, ())
    of: dict[str, dict[str, set[str]]] = {DOMAIN: {}, RANGE: {}}
    for s, p, o in rows:
        for kind, own in of.items():
            if stands_for(p, kind):
                own.setdefault(s, set()).add(o)
    return {(a, b) for a, own in above.items() for b in own if a != b}, of[DOMAIN], of[RANGE]


def entailed(quads: DataFrame, compat: bool = False, limit: int = 100_000, asserted: bool = True) -> DataFrame:
    """All triples that follow, asserted ones of the rules' predicates included, without repeats.

    The schema of properties is read to the driver under a bound; classes stay tables. Then one look at each
    triple of a property that has a say gives what it entails by itself, and types are lifted once.
    compat keeps to hierarchies of two hops and rules that do not see one another's triples. Without asserted,
    types in quads are not repeated unless they follow from something else, too.
    """
    every = as_quads(quads).select(*COLUMNS)
    if compat:
        below, classes = hierarchy(every, SUBPROPERTY, True), hierarchy(every, SUBCLASS, True)
        found = edges(every, TYPE).unionByName(domain_types(every)).unionByName(range_types(every)).distinct()
        typed = found.unionByName(lifted_types(edges(every, TYPE), classes)).distinct()
        return node_triples(classes, SUBCLASS).unionByName(node_triples(below, SUBPROPERTY)).unionByName(node_triples(typed, TYPE)).distinct()
    below, domains, ranges = property_schema(every, limit)
    above: dict[str, list[str]] = {}
    for a, b in sorted(below):
        above.setdefault(a, []).append(b)
    union = lambda p, by: sorted(set().union(*(by.get(q, ()) for q in [p, *above.get(p, [])])))
    effects = [(p, above.get(p, []), union(p, domains), union(p, ranges)) for p in sorted({*above, *domains, *ranges})]
    spark = quads.sparkSession
    rules = spark.createDataFrame(effects, "p string, above array<string>, s_types array<string>, o_types array<string>")
    triple = lambda s, p, o, *kind: F.struct(*(x.alias(n) for x, n in zip((s, p, o, *kind), COLUMNS, strict=True)))
    typing = lambda who: lambda c: triple(F.col(who), F.lit(TYPE), c, F.when(F.startswith(c, F.lit("_:")), "bnode").otherwise("iri"), F.lit(""), F.lit(""))
    node = F.col("o_kind") != "literal"
    own = (F.col("p") == TYPE) & node if asserted else (F.col("p") == TYPE) & node & (F.concat("o_dt", "o_lang") != "")
    parts = [
        F.transform("above", lambda q: triple(F.col("s"), q, *(F.col(c) for c in COLUMNS[2:]))),
        F.transform("s_types", typing("s")),
        F.when(node, F.transform("o_types", typing("o"))),
        F.when(own, F.array(triple(*(F.col(c) for c in COLUMNS[:4]), F.lit(""), F.lit("")))),
    ]
    told = every.where(F.col("p").isin([TYPE, *(e[0] for e in effects)])) if len(effects) < 1000 else every
    rows = told.join(F.broadcast(rules), "p", "left").select(F.explode(F.flatten(F.array_compact(F.array(*parts)))).alias("t")).select("t.*").distinct()
    class_edges = [SUBCLASS, *(a for a, b in below if b == SUBCLASS)]
    classes = small(transitive_closure(every.where(F.col("p").isin(class_edges) & node).select(F.col("s").alias("a"), F.col("o").alias("b")))).where("a <> b")
    types = edges(rows, TYPE) if asserted else edges(rows, TYPE).unionByName(edges(every, TYPE))
    lifted = node_triples(lifted_types(types, classes), TYPE)
    schema = spark.createDataFrame([(a, SUBPROPERTY, b, "bnode" if b.startswith("_:") else "iri", "", "") for a, b in sorted(below)], "s string, p string, o string, o_kind string, o_dt string, o_lang string")
    return rows.unionByName(lifted).unionByName(node_triples(classes, SUBCLASS)).unionByName(schema).distinct()
