import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from kgspark.checkpoints import saved, small
from kgspark.operators import owl, rdfs, shacl
from kgspark.operators.closure import FixpointError, components, reachable, transitive_closure
from kgspark.plans.syntax import Inverse
from kgspark.sources.mapping import QuadGraph
from kgspark.terms import BOOLEAN, DOMAIN, EX, INTEGER, OWL, RANGE, RDF, SH, STRING, SUBCLASS, SUBPROPERTY, TYPE, quads_of

e = lambda *names: [EX + n for n in names]


def pairs(df, a="a", b="b"):
    return {(r[a].replace(EX, ""), r[b].replace(EX, "")) for r in df.collect()}


def closed(edges):
    out = set(edges)
    while True:
        more = {(a, d) for a, b in out for c, d in out if b == c} - out
        if not more:
            return out
        out |= more


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=12))
def test_closure_equals_a_plain_one(spark, edges):
    df = spark.createDataFrame([*edges], "a long, b long")
    got = {tuple(r) for r in transitive_closure(df).collect()}
    assert got == closed(edges)
    from_zero = {tuple(r) for r in reachable(df, spark.createDataFrame([(0,)], "a long")).collect()}
    assert from_zero == {x for x in got if x[0] == 0}


def test_closure_bounds(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert transitive_closure(chain).count() == 40 * 41 // 2
    with pytest.raises(FixpointError):
        transitive_closure(chain, rounds=2)
    got = {r["node"]: r["component"] for r in components(chain.where("a <> 20")).collect()}
    assert set(got.values()) == {0, 21} and got[20] == 0 and got[40] == 21


def test_components_of_long_chains(spark):
    """Names in the order of text, so a chain has a local minimum every few nodes; a star, loops and null ends beside it."""
    chains = spark.range(3, 1500).selectExpr("concat('urn:n:', id) AS a", "concat('urn:n:', id - 3) AS b")
    more = spark.createDataFrame([*(("hub", f"leaf{i}") for i in range(300)), ("own", "own"), ("x", None), (None, "y")], "a string, b string")
    got = {r["node"]: r["component"] for r in components(chains.union(more)).collect()}
    least = [min(f"urn:n:{i}" for i in range(k, 1500, 3)) for k in range(3)]
    assert got == {f"urn:n:{i}": least[i % 3] for i in range(1500)} | {f"leaf{i}": "hub" for i in range(300)} | {"hub": "hub", "own": "own"}
    with pytest.raises(FixpointError):
        components(chains, rounds=2)


def test_large_saved_tables_are_not_broadcast(spark):
    """Their files are small, as they are compressed; only counted rows say whether a table is."""
    numbers = saved(spark.range(60_000), "numbers")
    for rows, join in ((50_000, "SortMergeJoin"), (60_000, "BroadcastHashJoin")):
        plan = spark.range(90_000).join(small(numbers, rows), "id")._jdf.queryExecution().executedPlan().toString()
        assert join in plan


def test_rdfs(spark):
    dog, mammal, animal, thing, life, rex = e("Dog", "Mammal", "Animal", "Thing", "Life", "rex")
    reads, consumes, person, reader, book, work, john, hobbit = e("reads", "consumes", "Person", "Reader", "Book", "Work", "john", "hobbit")
    q = quads_of(spark, [(dog, SUBCLASS, mammal), (mammal, SUBCLASS, animal), (animal, SUBCLASS, thing), (thing, SUBCLASS, life), (rex, TYPE, dog), (reads, DOMAIN, person), (reads, DOMAIN, reader), (reads, RANGE, book), (book, SUBCLASS, work), (reads, SUBPROPERTY, consumes), (john, reads, hobbit), (john, reads, ("a text",))])
    assert ("Dog", "Life") in pairs(rdfs.hierarchy(q)) and ("Dog", "Life") not in pairs(rdfs.hierarchy(q, compat=True))
    got = {(r["s"].replace(EX, ""), r["p"], r["o"].replace(EX, "")) for r in rdfs.entailed(q).collect()}
    for s, o in (("rex", "Life"), ("john", "Person"), ("john", "Reader"), ("hobbit", "Book"), ("hobbit", "Work")):
        assert (s, TYPE, o) in got
    assert ("john", consumes, "hobbit") in got and ("john", consumes, "a text") in got
    assert not any(s == "a text" for s, _, _ in got)
    again = {tuple(r) for r in rdfs.entailed(q.select("s", "p", "o", "o_kind", "o_dt", "o_lang").unionByName(rdfs.entailed(q)).distinct()).select("s", "p", "o").collect()}
    assert {(s.replace(EX, ""), p, o.replace(EX, "")) for s, p, o in again} >= got
    assert rdfs.entailed(quads_of(spark, [])).count() == 0


def test_properties_below_schema_properties(spark):
    a, b, c, below = e("A", "B", "C", "below")
    q = quads_of(spark, [(below, SUBPROPERTY, SUBCLASS), (a, below, b), (b, SUBCLASS, c)])
    assert (EX + "A", SUBCLASS, EX + "C") in {tuple(r) for r in rdfs.entailed(q).select("s", "p", "o").collect()}


@pytest.fixture(scope="module")
def family(spark):
    person, parent, male, child, alice, bob, carl, dora = e("Person", "Parent", "Male", "hasChild", "alice", "bob", "carl", "dora")
    rows = [(parent, SUBCLASS, person), (alice, TYPE, parent), (bob, TYPE, person), (bob, TYPE, male), (carl, TYPE, male), (dora, TYPE, person), (alice, child, bob), (alice, child, carl), (bob, child, dora), (EX + "Adult", OWL + "equivalentClass", parent)]
    rows += [("_:r", OWL + "onProperty", child), ("_:r", OWL + "someValuesFrom", male), (EX + "MaleParent", OWL + "equivalentClass", "_:r"), (EX + "hasParent", OWL + "inverseOf", child)]
    rows += [("_:i", OWL + "intersectionOf", "_:l1"), ("_:l1", RDF + "first", person), ("_:l1", RDF + "rest", "_:l2"), ("_:l2", RDF + "first", male), ("_:l2", RDF + "rest", RDF + "nil"), (EX + "Man", OWL + "equivalentClass", "_:i")]
    rows += [("_:m", OWL + "onProperty", child), ("_:m", OWL + "maxCardinality", ("1", INTEGER)), (EX + "Small", OWL + "equivalentClass", "_:m")]
    return owl.Ontology(quads_of(spark, rows).cache())


def names(df):
    return sorted(r["x"].replace(EX, "") for r in df.collect())


def test_class_expressions(family):
    person, male, child, alice = e("Person", "Male", "hasChild", "alice")
    assert names(family.instances(person)) == ["alice", "bob", "dora"]
    assert names(family.instances(owl.And((person, male)))) == ["bob"]
    assert names(family.instances(owl.Or((person, male)))) == ["alice", "bob", "carl", "dora"]
    assert names(family.instances(owl.Not(male))) == ["alice", "dora"]
    assert names(family.instances(owl.Some(child, male))) == ["alice"]
    assert names(family.instances(owl.All(child, male))) == ["alice", "carl", "dora"]
    assert names(family.instances(owl.HasValue(child, EX + "dora"))) == ["bob"]
    assert names(family.instances(owl.OneOf((alice, EX + "nobody")))) == ["alice"]
    assert names(family.instances(owl.Cardinality(child, 2))) == ["alice"]
    assert names(family.instances(owl.Cardinality(child, 0, 1))) == ["bob", "carl", "dora"]
    assert names(family.instances(owl.Cardinality(child, 1, 1, person))) == ["alice", "bob"]
    assert names(family.instances(owl.Some(owl.InverseOf(child), person))) == ["bob", "carl", "dora"]
    assert names(family.instances(owl.Some(EX + "hasParent", male))) == ["dora"]
    assert names(family.instances(owl.THING)) == ["alice", "bob", "carl", "dora"] and names(family.instances(owl.NOTHING)) == []
    found = {(r["x"].replace(EX, ""), r["class"].replace(EX, "")) for r in family.defined_instances().collect()}
    assert ("alice", "MaleParent") in found and ("bob", "Man") in found and ("dora", "Small") in found and ("alice", "Small") not in found


def test_lite(family):
    assert family.is_subsumed_by(EX + "Adult", EX + "Person") and not family.is_subsumed_by(EX + "Person", EX + "Parent")
    assert family.is_instance_of(EX + "alice", EX + "Adult")
    assert {r["class"].replace(EX, "") for r in family.subclasses(EX + "Person").collect()} == {"Person", "Parent", "Adult"}
    low = {(r["individual"].replace(EX, ""), r["class"].replace(EX, "")) for r in family.realized().collect()}
    assert ("alice", "Parent") in low and ("alice", "Person") not in low and ("bob", "Person") in low
    assert family.lite_axioms().where("s like '\\_:%' or o like '\\_:%'").count() == 0 and family.lite_axioms().count() > 5
    assert family.is_consistent() and family.inferred_axioms().count() > 0


def test_clashes(spark):
    a, b, x, y, z, p = e("A", "B", "x", "y", "z", "p")
    kinds = lambda rows: {r["kind"] for r in owl.Ontology(quads_of(spark, rows)).clashes().collect()}
    assert kinds([(a, OWL + "disjointWith", b), (x, TYPE, a), (x, TYPE, b)]) == {"disjoint"}
    assert kinds([(a, OWL + "disjointWith", b), (x, TYPE, a), (y, TYPE, b), (x, OWL + "sameAs", y)]) == {"disjoint"}
    assert kinds([(x, TYPE, owl.NOTHING)]) == {"nothing"}
    assert kinds([(x, OWL + "sameAs", y), (y, OWL + "sameAs", z), (x, OWL + "differentFrom", z)]) == {"same_and_different"}
    cap = [(a, OWL + "onProperty", p), (a, OWL + "maxCardinality", ("1", INTEGER)), (x, TYPE, a), (x, p, y), (x, p, z)]
    assert kinds(cap) == set() and kinds([*cap, (y, OWL + "differentFrom", z)]) == {"max_cardinality"}
    assert kinds([]) == set()


def test_only_fillers_that_all_differ_break_a_maximum(spark):
    a, p, x = e("A", "p", "x")
    ys = [f"{EX}y{i}" for i in range(5)]
    ring = [(ys[i], OWL + "differentFrom", ys[(i + 1) % 5]) for i in range(5)]

    def clash(most, *more):
        rows = [(a, OWL + "onProperty", p), (a, OWL + "maxCardinality", (str(most), INTEGER)), (x, TYPE, a), *((x, p, y) for y in ys), *more]
        return {r["kind"] for r in owl.Ontology(quads_of(spark, rows)).clashes().collect()} == {"max_cardinality"}

    assert not clash(2, *ring) and clash(1, *ring)
    assert clash(2, *ring, (ys[0], OWL + "differentFrom", ys[2]))
    other = EX + "z"  # the same as y2
    assert clash(2, *ring, (ys[0], OWL + "differentFrom", other), (other, OWL + "sameAs", ys[2]))
    every = [(u, OWL + "differentFrom", v) for i, u in enumerate(ys) for v in ys[:i]]
    assert clash(4, *every) and not clash(5, *every) and not clash(4, *every[1:])
    assert clash(0)


def test_property_characteristics(spark):
    near, part, one, x, y, z = e("near", "partOf", "one", "x", "y", "z")
    o = owl.Ontology(quads_of(spark, [(near, TYPE, OWL + "SymmetricProperty"), (part, TYPE, OWL + "TransitiveProperty"), (one, TYPE, OWL + "FunctionalProperty"), (near, TYPE, OWL + "AsymmetricProperty"), (x, near, y), (y, near, x), (x, part, y), (y, part, z), (x, one, y), (x, one, z)]))
    added = {(r["s"], r["p"], r["o"]) for r in o.property_closure().collect()}
    assert (y, near, x) in added and (x, part, z) in added
    assert [(r["node"], r["n"]) for r in o.functional_violations().collect()] == [(x, 2)]
    assert {r["kind"] for r in o.property_violations().collect()} == {"asymmetric"}
    cyclic = owl.Ontology(quads_of(spark, [("_:c", OWL + "unionOf", "_:l"), ("_:l", RDF + "first", x), ("_:l", RDF + "rest", "_:l")]))
    with pytest.raises(ValueError, match="cyclic"):
        cyclic.expressions()


@pytest.fixture(scope="module")
def data(spark):
    john, jane, bob, name, age, boss, person = e("john", "jane", "bob", "name", "age", "boss", "Person")
    return QuadGraph(quads_of(spark, [(john, TYPE, person), (jane, TYPE, person), (bob, TYPE, person), (john, age, ("thirty", STRING)), (bob, age, ("7", INTEGER)), (john, name, ("John",)), (bob, name, ("Bob",)), (bob, name, ("Bobby", "", "en")), (bob, name, ("Bobbie", "", "en")), (john, boss, EX + "rock"), (bob, boss, john), (bob, EX + "max", ("9", INTEGER))]))


CASES = [
    ("datatype", INTEGER, "age", {"john"}), ("minCount", 1, "name", {"jane"}), ("maxCount", 1, "name", {"bob"}), ("class", EX + "Person", "boss", {"john"}), ("hasValue", "John", "name", {"jane", "bob"}),
    ("minLength", 4, "name", {"bob"}), ("maxLength", 4, "name", {"bob"}), ("pattern", "^[BJ]o", "name", set()), ("in", ["John", "Bob"], "name", {"bob"}), ("nodeKind", SH + "IRI", "name", {"john", "bob"}),
    ("languageIn", ["en"], "name", {"john", "bob"}), ("uniqueLang", "true", "name", {"bob"}), ("minInclusive", "5", "age", {"john"}), ("maxExclusive", "7", "age", {"john", "bob"}), ("lessThan", EX + "max", "age", set()),
    ("equals", EX + "max", "age", {"john", "bob"}), ("disjoint", EX + "max", "age", set()), ("node", [shacl.Constraint("class", EX + "Person")], "boss", {"john"}), ("qualifiedValueShape", ([shacl.Constraint("class", EX + "Person")], 1, 1), "boss", {"john", "jane"}),
]


@pytest.mark.parametrize("kind,value,path,bad", CASES, ids=[c[0] for c in CASES])
def test_property_constraints(data, kind, value, path, bad):
    shape = shacl.NodeShape(EX + "S", [("class", EX + "Person")], properties=[shacl.PropertyShape(EX + path, [shacl.Constraint(kind, value)])])
    report = shacl.validate(data, [shape]).collect()
    assert {r["focus_node"].replace(EX, "") for r in report} == bad
    assert all(r["component"] == kind and r["result_path"] == EX + path for r in report)


def test_node_constraints_targets_and_paths(data):
    focus = lambda targets, constraints: {r["focus_node"].replace(EX, "") for r in shacl.validate(data, [shacl.NodeShape("s", targets, constraints)]).collect()}
    assert focus([("objectsOf", EX + "boss")], [shacl.Constraint("class", EX + "Person")]) == {"rock"}
    assert focus([("subjectsOf", EX + "boss")], [shacl.Constraint("in", [EX + "bob"])]) == {"john"}
    assert focus([("node", EX + "jane")], [shacl.Constraint("closed", ([EX + "name"], []))]) == {"jane"}
    inverse = shacl.NodeShape("s", [("class", EX + "Person")], properties=[shacl.PropertyShape(Inverse(EX + "boss"), [shacl.Constraint("minCount", 1)])])
    assert {r["focus_node"].replace(EX, "") for r in shacl.validate(data, [inverse]).collect()} == {"jane", "bob"}


def test_shapes_graph_and_modes(spark, data):
    q = quads_of(spark, [("_:s", TYPE, SH + "NodeShape"), ("_:s", SH + "targetClass", EX + "Person"), ("_:s", SH + "property", "_:p"), ("_:p", SH + "path", EX + "name"), ("_:p", SH + "minCount", ("1", INTEGER)), ("_:p", SH + "pattern", ("^j",)), ("_:p", SH + "flags", ("i",)), ("_:p", SH + "in", "_:l"), ("_:l", RDF + "first", ("John",)), ("_:l", RDF + "rest", RDF + "nil")])
    shapes = shacl.load_shapes(q)
    assert [c.component for c in shapes[0].properties[0].constraints] == ["minCount", "pattern", "in"]
    report = shacl.validate(data, shapes)
    assert {(r["focus_node"].replace(EX, ""), r["component"]) for r in report.collect()} >= {("jane", "minCount"), ("bob", "pattern"), ("bob", "in")}
    assert not shacl.conforms(report) and shacl.conforms(report, "warn")
    assert shacl.validate(data, shapes, "skip").count() == 0 and shacl.validate(data, shapes, "fail_fast").count() > 0
    assert shacl.report_text(report).count() == shacl.report_turtle(report).count() == shacl.report_json(report).count() == report.count()
    assert shacl.counts_by_severity(report).first()["severity"] == "violation"
    with pytest.raises(ValueError, match="path"):
        shacl.load_shapes(quads_of(spark, [("_:s", SH + "targetClass", EX + "P"), ("_:s", SH + "property", "_:p")]))


def shapes_of(spark, *rows):
    """A node shape on hands, and rows (s, p, o) where p is of the vocabulary and a list o becomes an RDF list."""
    out = [("_:s", SH + "targetClass", EX + "Hand")]
    for i, (s, p, o) in enumerate(rows):
        if isinstance(o, list):
            for j, x in enumerate(o):
                out += [(f"_:l{i}-{j}", RDF + "first", x), (f"_:l{i}-{j}", RDF + "rest", f"_:l{i}-{j + 1}" if j + 1 < len(o) else RDF + "nil")]
            o = f"_:l{i}-0"
        out.append((s, SH + p, o))
    return shacl.load_shapes(quads_of(spark, out))


HAS = lambda name, path, n: [(name, "path", EX + path), (name, "minCount", (str(n), INTEGER))]
HAND = [("_:s", "property", "_:p"), ("_:p", "path", EX + "digit")]
QUALIFIED = lambda p, shape, least, most: [("_:s", "property", p), (p, "path", EX + "digit"), (p, "qualifiedValueShape", shape), (p, "qualifiedMinCount", (str(least), INTEGER)), (p, "qualifiedMaxCount", (str(most), INTEGER))]
THUMB, FINGER = [("_:thumb", "class", EX + "Thumb")], [("_:finger", "class", EX + "Finger")]
DISJOINT = [("_:p", "qualifiedValueShapesDisjoint", ("true", BOOLEAN)), ("_:q", "qualifiedValueShapesDisjoint", ("true", BOOLEAN))]
NESTED = [
    ("and", [*HAS("_:a", "left", 1), *HAS("_:b", "right", 1), ("_:s", "and", ["_:a", "_:b"])], {"h1", "h2", "h4"}),
    ("or", [*HAS("_:a", "left", 1), *HAS("_:b", "right", 1), ("_:s", "or", ["_:a", "_:b"])], {"h4"}),
    ("xone", [*HAS("_:a", "left", 1), *HAS("_:b", "right", 1), ("_:s", "xone", ["_:a", "_:b"])], {"h3", "h4"}),
    ("not", [*HAS("_:a", "left", 1), ("_:s", "not", "_:a")], {"h1", "h3"}),
    ("not of or", [*HAS("_:a", "left", 1), *HAS("_:b", "right", 1), ("_:s", "not", "_:o"), ("_:o", "or", ["_:a", "_:b"])], {"h1", "h2", "h3"}),
    ("or of literals", [("_:s", "property", "_:p"), ("_:p", "path", EX + "left"), ("_:p", "or", ["_:i", "_:t"]), ("_:i", "datatype", INTEGER), ("_:t", "in", [("x",)])], {"h3"}),
    ("node with a property", [*HAND, ("_:p", "node", "_:n"), ("_:n", "property", "_:m"), *HAS("_:m", "nail", 1)], {"h2"}),
    ("property in a property", [*HAND, ("_:p", "property", "_:m"), *HAS("_:m", "nail", 1)], {"h2"}),
    ("qualified with a property", [*QUALIFIED("_:p", "_:n", 2, 9), ("_:n", "property", "_:m"), *HAS("_:m", "nail", 1)], {"h2", "h3", "h4"}),
    ("qualified", [*QUALIFIED("_:p", "_:thumb", 1, 1), *QUALIFIED("_:q", "_:finger", 1, 4), *THUMB, *FINGER], {"h3", "h4"}),
    ("qualified, disjoint", [*QUALIFIED("_:p", "_:thumb", 1, 1), *QUALIFIED("_:q", "_:finger", 1, 4), *THUMB, *FINGER, *DISJOINT], {"h2", "h3", "h4"}),
    ("deactivated", [*HAND, ("_:p", "minCount", ("9", INTEGER)), ("_:p", "deactivated", ("true", BOOLEAN))], set()),
]


@pytest.mark.parametrize("rows,bad", [c[1:] for c in NESTED], ids=[c[0] for c in NESTED])
def test_shapes_within_shapes(spark, rows, bad):
    triples = [(EX + f"h{i}", TYPE, EX + "Hand") for i in range(1, 5)]
    triples += [(EX + "h1", EX + "left", ("1", INTEGER)), (EX + "h2", EX + "right", ("1", INTEGER)), (EX + "h3", EX + "left", ("y",)), (EX + "h3", EX + "right", ("x",))]
    triples += [(EX + h, EX + "digit", EX + d) for h, d in (("h1", "t1"), ("h1", "f1"), ("h2", "both"), ("h2", "f1"), ("h3", "f1"))]
    triples += [(EX + d, TYPE, EX + t) for d, t in (("t1", "Thumb"), ("f1", "Finger"), ("both", "Thumb"), ("both", "Finger"))]
    triples += [(EX + d, EX + "nail", (d,)) for d in ("t1", "f1")]
    report = shacl.validate(quads_of(spark, triples), shapes_of(spark, *rows)).collect()
    assert {r["focus_node"].replace(EX, "") for r in report} == bad


def test_shapes_that_are_not_evaluated_raise(spark):
    for rows, what in (
        ([("_:s", "expression", "_:e")], "sh:expression"), ([*HAND, ("_:p", "node", "_:n"), ("_:n", "js", "_:j")], "sh:js"), ([("_:s", "sparql", "_:q"), ("_:q", "ask", ("ASK {}",))], "sh:select"),
        ([("_:s", "node", "_:n"), ("_:n", "property", "_:m"), ("_:m", "path", EX + "x"), ("_:m", "node", "_:n")], "itself"),
    ):
        with pytest.raises(ValueError, match=what):
            shapes_of(spark, *rows)
    own = shapes_of(spark, ("_:s", "path", EX + "digit"), ("_:s", "minCount", ("1", INTEGER)))
    assert [c.component for c in own[0].properties[0].constraints] == ["minCount"] and not own[0].constraints


def test_values_of_shapes_are_terms(spark):
    shape = [("_:s", TYPE, SH + "NodeShape"), ("_:s", SH + "targetSubjectsOf", EX + "has"), ("_:s", SH + "property", "_:p"), ("_:p", SH + "path", EX + "has")]
    data = quads_of(spark, [(EX + "iri", EX + "has", "http://z/1"), (EX + "text", EX + "has", ("http://z/1",)), (EX + "number", EX + "has", ("1", INTEGER)), (EX + "word", EX + "has", ("1",)), (EX + "said", EX + "has", ("1", "", "en"))])

    def broken(*rows):
        found = shacl.validate(data, shacl.load_shapes(quads_of(spark, [*shape, *rows])))
        return {r["focus_node"].replace(EX, "") for r in found.collect()}

    every = {"iri", "text", "number", "word", "said"}
    assert broken(("_:p", SH + "hasValue", "http://z/1")) == every - {"iri"}
    assert broken(("_:p", SH + "hasValue", ("http://z/1",))) == every - {"text"}
    assert broken(("_:p", SH + "hasValue", ("1", INTEGER))) == every - {"number"}
    listed = [("_:p", SH + "in", "_:l"), ("_:l", RDF + "first", "http://z/1"), ("_:l", RDF + "rest", "_:m"), ("_:m", RDF + "first", ("1",)), ("_:m", RDF + "rest", RDF + "nil")]
    assert broken(*listed) == {"text", "number", "said"}
