"""The queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.checkpoints import shared_dir
from kgspark.operators import detect, owl, rdfs, rules, shacl, timeseries
from kgspark.operators.closure import components
from kgspark.plans.compiler import query
from kgspark.plans.syntax import Inverse
from kgspark.sources import formats, siem
from kgspark.sources.events import cyber_events, event_jsonld, event_triples
from kgspark.sources.mapping import Branch, Graph, QuadGraph, VirtualGraph, tpch_graph
from kgspark.sources.store import QuadStore, sensor, statistics
from kgspark.streaming import pipeline as streams
from kgspark.terms import DOMAIN, EX, OWL, RANGE, STRING, SUBCLASS, SUBPROPERTY, TYPE, as_quads, quads_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
RDF_TYPE = TYPE


def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def sparql(name: str, text: str, sql: str, graph: Callable[[SparkSession, str], Graph] = tpch_graph, **types: str) -> None:
    add(name, sql)(lambda spark, sf: query(graph(spark, sf), text, types))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Scans. Numbers are compared as numbers, never as text.
def scanned(df: DataFrame) -> DataFrame:
    return df.select("s", "p", F.when(F.col("o_num").isNull(), F.col("o")).alias("o"), F.col("o_num").alias("n"))


CUSTOMER_TRIPLES = f"""
  SELECT c_custkey AS k, '{RDF_TYPE}' AS p, 'tp:Customer' AS o, CAST(NULL AS DOUBLE) AS n FROM customer UNION ALL
  SELECT c_custkey, 'tp:c_custkey', NULL, CAST(c_custkey AS DOUBLE) FROM customer UNION ALL
  SELECT c_custkey, 'tp:c_name', c_name, NULL FROM customer UNION ALL
  SELECT c_custkey, 'tp:nation', 'urn:nation:' || c_nationkey, NULL FROM customer UNION ALL
  SELECT c_custkey, 'tp:c_acctbal', NULL, c_acctbal FROM customer UNION ALL
  SELECT c_custkey, 'tp:c_mktsegment', c_mktsegment, NULL FROM customer"""
SUBJECT = "'urn:customer:' || k AS s, p, o, n"
add("tp_scan_s", f"SELECT {SUBJECT} FROM ({CUSTOMER_TRIPLES}) WHERE k = 5")(lambda spark, sf: scanned(tpch_graph(spark, sf).scan(s="urn:customer:5")))
add("tp_scan_p", "SELECT 'urn:customer:' || c_custkey AS s, 'tp:c_mktsegment' AS p, c_mktsegment AS o, CAST(NULL AS DOUBLE) AS n FROM customer")(lambda spark, sf: scanned(tpch_graph(spark, sf).scan(p="tp:c_mktsegment")))
add("tp_scan_o", "SELECT 'urn:customer:' || c_custkey AS s, 'tp:nation' AS p, 'urn:nation:3' AS o, CAST(NULL AS DOUBLE) AS n FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'urn:supplier:' || s_suppkey, 'tp:nation', 'urn:nation:3', NULL FROM supplier WHERE s_nationkey = 3")(lambda spark, sf: scanned(tpch_graph(spark, sf).scan(o="urn:nation:3")))
add("tp_scan_sp", f"SELECT {SUBJECT} FROM ({CUSTOMER_TRIPLES}) WHERE k = 5 AND p = 'tp:c_acctbal'")(lambda spark, sf: scanned(tpch_graph(spark, sf).scan(s="urn:customer:5", p="tp:c_acctbal")))
OPEN = [("region", 2, 3), ("nation", 3, 4), ("customer", 5, 6), ("supplier", 4, 5), ("part", 6, 7), ("orders", 6, 7), ("lineitem", 11, 12)]
add("tp_scan_open", "SELECT CAST(sum(n) AS BIGINT) AS triples FROM (" + " UNION ALL ".join(f"SELECT count(*) * {n} AS n FROM {t}" for t, _, n in OPEN) + ")")(lambda spark, sf: tpch_graph(spark, sf).scan().agg(F.count("*").alias("triples")))

# Basic graph patterns.
sparql(
    "bgp_join", "SELECT ?c ?name ?n WHERE { ?c tp:c_name ?name . ?c tp:nation ?na . ?na tp:n_name ?n }",
    "SELECT 'urn:customer:' || c_custkey AS c, c_name AS name, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
sparql(
    "bgp_star", "SELECT ?c ?name ?seg ?bal WHERE { ?c a tp:Customer ; tp:c_name ?name ; tp:c_mktsegment ?seg ; tp:c_acctbal ?bal }",
    "SELECT 'urn:customer:' || c_custkey AS c, c_name AS name, c_mktsegment AS seg, c_acctbal AS bal FROM customer", bal="double",
)
CHAIN3 = "SELECT ?r (COUNT(?c) AS ?n) WHERE { ?c a tp:Customer ; tp:nation ?na . ?na tp:region ?rg . ?rg tp:r_name ?r } GROUP BY ?r"
sparql("bgp_chain3", CHAIN3, "SELECT r_name AS r, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", n="bigint")
sparql("bgp_cross", "SELECT ?a ?b WHERE { ?x tp:r_name ?a . ?y tp:n_name ?b }", "SELECT r_name AS a, n_name AS b FROM region, nation")
sparql(
    "bgp_repeat_var", "SELECT ?x WHERE { ?x tp:same ?x }", "SELECT 'urn:customer:' || c_custkey AS x FROM customer WHERE c_custkey = c_nationkey",
    lambda spark, sf: VirtualGraph(spark, [Branch(table(spark, sf, "customer"), "urn:customer:", F.col("c_custkey"), "tp:same", F.col("c_nationkey"), kind="iri", value_prefix="urn:customer:", value_type="int")]),
)

# Filters and expressions.
CUSTOMER = "SELECT 'urn:customer:' || c_custkey AS c FROM customer WHERE "
sparql("sparql_filter_num", "SELECT ?c ?b WHERE { ?c tp:c_acctbal ?b FILTER(?b > 5000 && ?b <= 7500.5) }", "SELECT 'urn:customer:' || c_custkey AS c, c_acctbal AS b FROM customer WHERE c_acctbal > 5000 AND c_acctbal <= 7500.5", b="double")
sparql("sparql_filter_logic", "SELECT ?c WHERE { ?c tp:c_acctbal ?b ; tp:c_mktsegment ?s FILTER((?s = 'BUILDING' || ?s = 'MACHINERY') && !(?b < 0)) }", CUSTOMER + "c_mktsegment IN ('BUILDING', 'MACHINERY') AND NOT c_acctbal < 0")
sparql("sparql_filter_regex", "SELECT ?c WHERE { ?c tp:c_name ?n FILTER REGEX(?n, '^customer#0+1', 'i') }", CUSTOMER + "regexp_matches(c_name, '(?i)^customer#0+1')")
sparql("sparql_filter_bound", "SELECT ?c WHERE { ?c a tp:Customer OPTIONAL { ?o tp:customer ?c ; tp:o_orderpriority '1-URGENT' } FILTER(!BOUND(?o)) }", CUSTOMER + "NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
sparql("sparql_filter_eq_vars", "SELECT ?c ?s WHERE { ?c a tp:Customer ; tp:nation ?a . ?s a tp:Supplier ; tp:nation ?b FILTER(?a = ?b) }", "SELECT 'urn:customer:' || c_custkey AS c, 'urn:supplier:' || s_suppkey AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey")
sparql("sparql_filter_in_arith", "SELECT ?p ?x WHERE { ?p tp:p_size ?s ; tp:p_retailprice ?r FILTER(?s IN (1, 5, 7) && ?r / 2 + 1 > 500) BIND(?r * 2 - ?s AS ?x) }", "SELECT 'urn:part:' || p_partkey AS p, round(p_retailprice * 2 - p_size, 6) AS x FROM part WHERE p_size IN (1, 5, 7) AND p_retailprice / 2 + 1 > 500", x="double")
QUERIES["sparql_filter_in_arith"] = (lambda f: lambda spark, sf: f(spark, sf).withColumn("x", F.round("x", 6)))(QUERIES["sparql_filter_in_arith"])
sparql("sparql_term_tests", "SELECT ?k (COUNT(*) AS ?n) WHERE { ?c a tp:Customer ; ?p ?v BIND(IF(isIRI(?v), 'iri', IF(isNumeric(?v), 'number', 'text')) AS ?k) } GROUP BY ?k", "SELECT k, count(*) * m AS n FROM customer, (VALUES ('iri', 2), ('number', 2), ('text', 2)) t(k, m) GROUP BY k, m", n="bigint")
sparql("sparql_strings", "SELECT ?n ?u ?l ?x WHERE { ?r tp:n_name ?n FILTER(CONTAINS(?n, 'A') && STRSTARTS(?n, 'I')) BIND(LCASE(?n) AS ?u) BIND(STRLEN(?n) AS ?l) BIND(CONCAT(SUBSTR(?n, 1, 2), '-', STR(?r)) AS ?x) }", "SELECT n_name AS n, lower(n_name) AS u, length(n_name) AS l, substr(n_name, 1, 2) || '-urn:nation:' || n_nationkey AS x FROM nation WHERE contains(n_name, 'A') AND starts_with(n_name, 'I')", l="bigint")

# Optional, union, minus, exists.
sparql("sparql_optional", "SELECT ?c ?o WHERE { ?c a tp:Customer OPTIONAL { ?o tp:customer ?c } }", "SELECT 'urn:customer:' || c_custkey AS c, 'urn:orders:' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
sparql("sparql_optional_filter", "SELECT ?c ?o WHERE { ?c tp:c_acctbal ?b OPTIONAL { ?o tp:customer ?c ; tp:o_totalprice ?p FILTER(?p > 200000 && ?b > 100) } }", "SELECT 'urn:customer:' || c_custkey AS c, 'urn:orders:' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 AND c_acctbal > 100")
sparql(
    "sparql_optional_nested", "SELECT ?c ?o ?l WHERE { ?c a tp:Customer OPTIONAL { ?o tp:customer ?c ; tp:o_orderpriority '1-URGENT' OPTIONAL { ?l tp:orders ?o ; tp:l_linenumber ?k FILTER(?k = 7) } } }",
    "SELECT 'urn:customer:' || c_custkey AS c, 'urn:orders:' || o_orderkey AS o, 'urn:lineitem:' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS l FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 7",
)
sparql("sparql_union", "SELECT ?x ?n WHERE { { ?x tp:c_name ?n } UNION { ?x tp:s_name ?n } UNION { ?x tp:r_name ?n } }", "SELECT 'urn:customer:' || c_custkey AS x, c_name AS n FROM customer UNION ALL SELECT 'urn:supplier:' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'urn:region:' || r_regionkey, r_name FROM region")
sparql("sparql_union_unbound", "SELECT ?c ?s ?n WHERE { { ?c tp:nation ?n ; a tp:Customer } UNION { ?s tp:nation ?n ; a tp:Supplier } . ?n tp:n_name 'CHINA' }", "SELECT 'urn:customer:' || c_custkey AS c, NULL AS s, 'urn:nation:' || n_nationkey AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'CHINA' UNION ALL SELECT NULL, 'urn:supplier:' || s_suppkey, 'urn:nation:' || n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'CHINA'")
URGENT = "?o tp:customer ?c ; tp:o_orderpriority '1-URGENT'"
NO_URGENT = CUSTOMER + "NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"
sparql("sparql_minus", f"SELECT ?c WHERE {{ ?c a tp:Customer MINUS {{ {URGENT} }} }}", NO_URGENT)
sparql("sparql_not_exists", f"SELECT ?c WHERE {{ ?c a tp:Customer FILTER NOT EXISTS {{ {URGENT} }} }}", NO_URGENT)
sparql("sparql_exists", f"SELECT ?c WHERE {{ ?c a tp:Customer FILTER EXISTS {{ {URGENT} }} }}", NO_URGENT.replace("NOT EXISTS", "EXISTS"))
sparql("sparql_exists_or", f"SELECT ?c WHERE {{ ?c tp:c_acctbal ?b FILTER(?b > 9000 || EXISTS {{ {URGENT} }}) }}", NO_URGENT.replace("NOT EXISTS", "c_acctbal > 9000 OR EXISTS"))

# Extend, values, graphs, sub-queries.
sparql("sparql_bind", "SELECT ?c ?y ?z WHERE { ?c tp:c_acctbal ?b BIND(ROUND(?b * 1.1) AS ?y) BIND(COALESCE(?nothing, 'none') AS ?z) }", "SELECT 'urn:customer:' || c_custkey AS c, floor(c_acctbal * 1.1 + 0.5) AS y, 'none' AS z FROM customer", y="double")
sparql("sparql_values", "SELECT ?n ?k WHERE { VALUES (?n ?k) { ('CHINA' 'east') ('FRANCE' 'west') ('NOWHERE' 'none') } ?x tp:n_name ?n }", "SELECT n_name AS n, k FROM nation JOIN (VALUES ('CHINA', 'east'), ('FRANCE', 'west'), ('NOWHERE', 'none')) v(nn, k) ON n_name = nn")


def named_graph(spark: SparkSession, sf: str) -> Graph:
    """Customers of each market segment in a named graph of their own."""
    c = table(spark, sf, "customer")
    name = F.concat(F.lit("urn:graph:"), "c_mktsegment")
    own = c.select(F.concat(F.lit("urn:customer:"), "c_custkey").alias("s"), F.lit("tp:c_name").alias("p"), F.col("c_name").alias("o"), F.lit("literal").alias("o_kind"), F.lit(STRING).alias("o_dt"), F.lit("named").alias("graph_kind"), name.alias("graph_name"))
    return QuadGraph(own)


sparql("sparql_graph", "SELECT ?g (COUNT(?c) AS ?n) WHERE { GRAPH ?g { ?c tp:c_name ?x } } GROUP BY ?g", "SELECT 'urn:graph:' || c_mktsegment AS g, count(*) AS n FROM customer GROUP BY c_mktsegment", named_graph, n="bigint")
sparql("sparql_graph_fixed", "SELECT ?c ?x WHERE { GRAPH <urn:graph:BUILDING> { ?c tp:c_name ?x } }", "SELECT 'urn:customer:' || c_custkey AS c, c_name AS x FROM customer WHERE c_mktsegment = 'BUILDING'", named_graph)
sparql("sparql_from", "SELECT (COUNT(*) AS ?n) FROM <urn:graph:BUILDING> FROM <urn:graph:MACHINERY> WHERE { ?c tp:c_name ?x }", "SELECT count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", named_graph, n="bigint")
sparql("sparql_subquery", "SELECT ?c ?m WHERE { ?c tp:c_acctbal ?m { SELECT (MAX(?b) AS ?m) WHERE { ?x tp:c_acctbal ?b } } }", "SELECT 'urn:customer:' || c_custkey AS c, c_acctbal AS m FROM customer WHERE c_acctbal = (SELECT max(c_acctbal) FROM customer)", m="double")

# Distinct, order, slice.
sparql("sparql_distinct", "SELECT DISTINCT ?s WHERE { ?c tp:c_mktsegment ?s }", "SELECT DISTINCT c_mktsegment AS s FROM customer")
sparql("sparql_reduced", "SELECT REDUCED ?s ?n WHERE { ?c tp:c_mktsegment ?s ; tp:nation ?n }", "SELECT DISTINCT c_mktsegment AS s, 'urn:nation:' || c_nationkey AS n FROM customer")
sparql("sparql_order_limit", "SELECT ?c ?b WHERE { ?c tp:c_acctbal ?b ; tp:c_custkey ?k } ORDER BY DESC(?b) ?k LIMIT 10", "SELECT 'urn:customer:' || c_custkey AS c, c_acctbal AS b FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10", b="double")
sparql("sparql_offset", "SELECT ?k WHERE { ?c tp:c_custkey ?k } ORDER BY ?k LIMIT 7 OFFSET 20", "SELECT c_custkey AS k FROM customer ORDER BY c_custkey LIMIT 7 OFFSET 20", k="bigint")

# Groups.
sparql("sparql_group_count", "SELECT ?s (COUNT(*) AS ?n) WHERE { ?c tp:c_mktsegment ?s } GROUP BY ?s", "SELECT c_mktsegment AS s, count(*) AS n FROM customer GROUP BY c_mktsegment", n="bigint")


def rounded(name: str, *columns: str) -> None:
    f = QUERIES[name]
    QUERIES[name] = lambda spark, sf: f(spark, sf).withColumns({c: F.round(c, 6) for c in columns})


sparql("sparql_group_sum_avg", "SELECT ?s (SUM(?b) AS ?t) (AVG(?b) AS ?a) WHERE { ?c tp:c_mktsegment ?s ; tp:c_acctbal ?b } GROUP BY ?s", "SELECT c_mktsegment AS s, round(sum(c_acctbal), 6) AS t, round(avg(c_acctbal), 6) AS a FROM customer GROUP BY c_mktsegment", t="double", a="double")
rounded("sparql_group_sum_avg", "t", "a")
sparql("sparql_group_minmax", "SELECT ?s (MIN(?b) AS ?lo) (MAX(?b) AS ?hi) (MIN(?n) AS ?first) WHERE { ?c tp:c_mktsegment ?s ; tp:c_acctbal ?b ; tp:c_name ?n } GROUP BY ?s", "SELECT c_mktsegment AS s, min(c_acctbal) AS lo, max(c_acctbal) AS hi, min(c_name) AS first FROM customer GROUP BY c_mktsegment", lo="double", hi="double")
sparql("sparql_group_count_distinct", "SELECT ?s (COUNT(DISTINCT ?n) AS ?k) WHERE { ?c tp:c_mktsegment ?s ; tp:nation ?n } GROUP BY ?s", "SELECT c_mktsegment AS s, count(DISTINCT c_nationkey) AS k FROM customer GROUP BY c_mktsegment", k="bigint")
sparql("sparql_having", "SELECT ?n (COUNT(*) AS ?k) WHERE { ?c a tp:Customer ; tp:nation ?n } GROUP BY ?n HAVING(COUNT(*) > 60)", "SELECT 'urn:nation:' || c_nationkey AS n, count(*) AS k FROM customer GROUP BY c_nationkey HAVING count(*) > 60", k="bigint")
sparql("sparql_group_concat", "SELECT ?r (GROUP_CONCAT(?n; SEPARATOR='|') AS ?l) WHERE { ?x tp:region ?r ; tp:n_name ?n } GROUP BY ?r", "SELECT 'urn:region:' || n_regionkey AS r, string_agg(n_name, '|' ORDER BY n_name) AS l FROM nation GROUP BY n_regionkey")
sparql("sparql_sample", "SELECT ?r (SAMPLE(?n) AS ?l) WHERE { ?x tp:region ?r ; tp:n_name ?n } GROUP BY ?r", "SELECT 'urn:region:' || n_regionkey AS r, min(n_name) AS l FROM nation GROUP BY n_regionkey")
sparql("sparql_group_expression", "SELECT ?d (COUNT(*) AS ?n) ((SUM(?q) / COUNT(*)) AS ?a) WHERE { ?l tp:l_discount ?x ; tp:l_quantity ?q } GROUP BY (FLOOR(?x * 100) AS ?d)", "SELECT floor(l_discount * 100) AS d, count(*) AS n, round(sum(l_quantity) / count(*), 6) AS a FROM lineitem GROUP BY floor(l_discount * 100)", d="double", n="bigint", a="double")
rounded("sparql_group_expression", "a")

# Query forms.
sparql("sparql_ask", "ASK { ?c tp:c_mktsegment 'BUILDING' ; tp:c_acctbal ?b FILTER(?b > 100000) }", "SELECT EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 100000) AS ask")
add("sparql_construct", f"SELECT 'urn:customer:' || c_custkey AS s, '{EX}in' AS p, 'urn:region:' || n_regionkey AS o FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'urn:customer:' || c_custkey, '{EX}name', c_name FROM customer")(
    lambda spark, sf: query(tpch_graph(spark, sf), "CONSTRUCT { ?c ex:in ?r . ?c ex:name ?n } WHERE { ?c a tp:Customer ; tp:nation/tp:region ?r ; tp:c_name ?n }").select("s", "p", "o")
)
add("sparql_describe", "SELECT 'urn:nation:' || n_nationkey AS s, p, CASE p WHEN 'tp:n_name' THEN n_name WHEN 'tp:n_nationkey' THEN CAST(n_nationkey AS VARCHAR) WHEN 'tp:region' THEN 'urn:region:' || n_regionkey ELSE 'tp:Nation' END AS o FROM nation, (VALUES ('" + RDF_TYPE + "'), ('tp:n_name'), ('tp:n_nationkey'), ('tp:region')) t(p) WHERE n_name = 'CHINA'")(
    lambda spark, sf: query(tpch_graph(spark, sf), "DESCRIBE ?n WHERE { ?n tp:n_name 'CHINA' }").select("s", "p", "o")
)


# Paths, over a chain in which customer k reports to customer k / 2.
def chain_graph(spark: SparkSession, sf: str) -> Graph:
    c = table(spark, sf, "customer").where("c_custkey >= 1").withColumn("boss", F.floor(F.col("c_custkey") / 2))
    return VirtualGraph(spark, [Branch(c, "urn:customer:", F.col("c_custkey"), "tp:reportsTo", F.col("boss"), kind="iri", value_prefix="urn:customer:", value_type="bigint")])


UP = "RECURSIVE up(a, b) AS (SELECT c_custkey, c_custkey // 2 FROM customer WHERE c_custkey >= 1 UNION SELECT a, b // 2 FROM up WHERE b >= 1)"
PAIR = "'urn:customer:' || a AS a, 'urn:customer:' || b AS b"
sparql("path_seq", "SELECT ?a ?b WHERE { ?a tp:nation/tp:region/tp:r_name ?b ; a tp:Supplier }", "SELECT 'urn:supplier:' || s_suppkey AS a, r_name AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
sparql("path_alt", "SELECT ?x ?n WHERE { ?x tp:n_name|tp:r_name ?n }", "SELECT 'urn:nation:' || n_nationkey AS x, n_name AS n FROM nation UNION ALL SELECT 'urn:region:' || r_regionkey, r_name FROM region")
sparql("path_inv", "SELECT ?r ?n WHERE { ?r ^tp:region ?n }", "SELECT 'urn:region:' || n_regionkey AS r, 'urn:nation:' || n_nationkey AS n FROM nation")
sparql("path_plus", "SELECT ?a ?b WHERE { ?a tp:reportsTo+ ?b }", f"WITH {UP} SELECT {PAIR} FROM up", chain_graph)
sparql("path_star", "SELECT ?b WHERE { <urn:customer:100> tp:reportsTo* ?b }", f"WITH {UP} SELECT 'urn:customer:' || b AS b FROM up WHERE a = 100 UNION ALL SELECT 'urn:customer:100'", chain_graph)
sparql("path_star_open", "SELECT ?a ?b WHERE { ?a tp:reportsTo* ?b }", f"WITH {UP} SELECT {PAIR} FROM (SELECT a, b FROM up UNION SELECT c_custkey, c_custkey FROM customer)", chain_graph)
sparql("path_opt", "SELECT ?a ?b WHERE { ?a tp:reportsTo? ?b }", f"SELECT {PAIR} FROM (SELECT c_custkey AS a, c_custkey // 2 AS b FROM customer WHERE c_custkey >= 1 UNION SELECT c_custkey, c_custkey FROM customer)", chain_graph)
sparql("path_to", "SELECT ?a WHERE { ?a tp:reportsTo+ <urn:customer:7> }", f"WITH {UP} SELECT 'urn:customer:' || a AS a FROM up WHERE b = 7", chain_graph)


# RDFS: part types below brands below Part below Product below Thing.
def class_tree(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    kind, brand = F.concat(F.lit("urn:type:"), "p_type"), F.concat(F.lit("urn:brand:"), "p_brand")
    low = part.select(kind.alias("s"), F.lit(SUBCLASS).alias("p"), brand.alias("o")).distinct()
    mid = part.select(brand.alias("s"), F.lit(SUBCLASS).alias("p"), F.lit("tp:Part").alias("o")).distinct()
    top = spark.createDataFrame([("tp:Part", SUBCLASS, "tp:Product"), ("tp:Product", SUBCLASS, "tp:Thing")], "s string, p string, o string")
    typed = part.select(F.concat(F.lit("urn:part:"), "p_partkey").alias("s"), F.lit(TYPE).alias("p"), kind.alias("o"))
    return as_quads(reduce(DataFrame.unionByName, [low, mid, top, typed]))


TREE = "t0(a, b) AS (SELECT DISTINCT 'urn:type:' || p_type, 'urn:brand:' || p_brand FROM part UNION SELECT DISTINCT 'urn:brand:' || p_brand, 'tp:Part' FROM part UNION SELECT 'tp:Part', 'tp:Product' UNION SELECT 'tp:Product', 'tp:Thing'), tc(a, b) AS (SELECT a, b FROM t0 UNION SELECT tc.a, t0.b FROM tc JOIN t0 ON tc.b = t0.a)"
TYPED = "SELECT 'urn:part:' || p_partkey AS a, 'urn:type:' || p_type AS b FROM part"
add("rdfs_subclass_closure", f"WITH RECURSIVE {TREE} SELECT a, b FROM tc")(lambda spark, sf: rdfs.hierarchy(class_tree(spark, sf)))
add("rdfs_types", f"WITH RECURSIVE {TREE}, t AS ({TYPED}) SELECT t.a, tc.b FROM t JOIN tc ON t.b = tc.a UNION SELECT a, b FROM t")(
    lambda spark, sf: rdfs.inferred_types(class_tree(spark, sf))
)


def located(spark: SparkSession, sf: str) -> DataFrame:
    schema = quads_of(spark, [("tp:nation", DOMAIN, "tp:Located"), ("tp:nation", DOMAIN, "tp:Party"), ("tp:nation", RANGE, "tp:Place"), ("tp:nation", SUBPROPERTY, "tp:within"), ("tp:within", RANGE, "tp:Area"), ("tp:Place", SUBCLASS, "tp:Thing")])
    graph = tpch_graph(spark, sf)
    return schema.unionByName(as_quads(graph.scan(p="tp:nation").drop("o_num")))


WHO = "who(s, o) AS (SELECT 'urn:customer:' || c_custkey, 'urn:nation:' || c_nationkey FROM customer UNION ALL SELECT 'urn:supplier:' || s_suppkey, 'urn:nation:' || s_nationkey FROM supplier)"
add("rdfs_domain", f"WITH {WHO} SELECT s AS a, b FROM who, (VALUES ('tp:Located'), ('tp:Party')) t(b)")(lambda spark, sf: rdfs.domain_types(located(spark, sf)))
add("rdfs_range", f"WITH {WHO} SELECT DISTINCT o AS a, 'tp:Place' AS b FROM who")(lambda spark, sf: rdfs.range_types(located(spark, sf)))
add(
    "rdfs_full",
    f"WITH {WHO} SELECT s, 'tp:within' AS p, o FROM who UNION SELECT s, '{TYPE}', b FROM who, (VALUES ('tp:Located'), ('tp:Party')) t(b) UNION SELECT o, '{TYPE}', b FROM who, (VALUES ('tp:Place'), ('tp:Area'), ('tp:Thing')) t(b) UNION SELECT 'tp:nation', '{SUBPROPERTY}', 'tp:within' UNION SELECT 'tp:Place', '{SUBCLASS}', 'tp:Thing'",
)(lambda spark, sf: rdfs.entailed(located(spark, sf)).select("s", "p", "o"))


# OWL.
def market(spark: SparkSession, sf: str) -> DataFrame:
    """Types, tp:customer and tp:nation links as quads, with one pair of disjoint classes."""
    graph = tpch_graph(spark, sf)
    c = table(spark, sf, "customer")
    me = F.concat(F.lit("urn:customer:"), "c_custkey")
    rich = c.where("c_acctbal > 9000").select(me.alias("s"), F.lit(TYPE).alias("p"), F.lit("tp:Rich").alias("o"))
    poor = c.where("c_mktsegment = 'BUILDING'").select(me.alias("s"), F.lit(TYPE).alias("p"), F.lit("tp:Builder").alias("o"))
    schema = quads_of(spark, [("tp:Rich", OWL + "disjointWith", "tp:Builder"), ("tp:Rich", SUBCLASS, "tp:Customer"), ("tp:Client", OWL + "equivalentClass", "tp:Customer")])
    scans = [graph.scan(p=TYPE, o="tp:Customer"), graph.scan(p=TYPE, o="tp:Orders"), graph.scan(p="tp:customer"), graph.scan(p="tp:nation")]
    return reduce(DataFrame.unionByName, [*(as_quads(x.drop("o_num")) for x in scans), as_quads(rich), as_quads(poor), schema])


def instances(name: str, e: object, sql: str) -> None:
    add(name, f"SELECT x FROM ({sql})")(lambda spark, sf: owl.Ontology(market(spark, sf)).instances(e))


CX = "SELECT 'urn:customer:' || c_custkey AS x FROM customer "
ORDERS_OF = owl.InverseOf("tp:customer")
N_ORDERS = "(SELECT count(*) FROM orders WHERE o_custkey = c_custkey)"
add("owl_lite_hierarchy", "SELECT a, b FROM (VALUES ('tp:Rich', 'tp:Customer'), ('tp:Rich', 'tp:Client'), ('tp:Client', 'tp:Customer'), ('tp:Customer', 'tp:Client')) t(a, b)")(lambda spark, sf: owl.Ontology(market(spark, sf)).below)
add("owl_lite_disjoint", "SELECT 'disjoint' AS kind, 'urn:customer:' || c_custkey AS x, 'tp:Builder tp:Rich' AS detail FROM customer WHERE c_acctbal > 9000 AND c_mktsegment = 'BUILDING'")(lambda spark, sf: owl.Ontology(market(spark, sf)).clashes())
instances("owl_dl_named", "tp:Client", CX)
instances("owl_dl_some", owl.Some(ORDERS_OF, "tp:Orders"), CX + f"WHERE {N_ORDERS} > 0")
instances("owl_dl_all", owl.And(("tp:Customer", owl.All("tp:nation", owl.OneOf(tuple(f"urn:nation:{i}" for i in range(5)))))), CX + "WHERE c_nationkey < 5")
instances("owl_dl_hasvalue", owl.And(("tp:Customer", owl.HasValue("tp:nation", "urn:nation:3"))), CX + "WHERE c_nationkey = 3")
instances("owl_dl_mincard", owl.Cardinality(ORDERS_OF, 12), CX + f"WHERE {N_ORDERS} >= 12")
instances("owl_dl_maxcard", owl.And(("tp:Customer", owl.Cardinality(ORDERS_OF, 0, 6))), CX + f"WHERE {N_ORDERS} <= 6")
instances("owl_dl_exactcard", owl.And(("tp:Customer", owl.Cardinality(ORDERS_OF, 10, 10, "tp:Orders"))), CX + f"WHERE {N_ORDERS} = 10")
instances("owl_dl_complement", owl.And(("tp:Customer", owl.Not("tp:Builder"))), CX + "WHERE c_mktsegment <> 'BUILDING'")
instances("owl_dl_union", owl.Or(("tp:Rich", "tp:Builder")), CX + "WHERE c_acctbal > 9000 OR c_mktsegment = 'BUILDING'")
instances("owl_dl_intersection", owl.And(("tp:Rich", "tp:Builder")), CX + "WHERE c_acctbal > 9000 AND c_mktsegment = 'BUILDING'")
instances("owl_dl_oneof", owl.OneOf(("urn:customer:1", "urn:customer:2", "urn:nobody")), CX + "WHERE c_custkey IN (1, 2)")


def same_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer is the same as the one seven keys before."""
    c = table(spark, sf, "customer").where("c_custkey >= 7")
    name = lambda k: F.concat(F.lit("urn:customer:"), k)
    return as_quads(c.select(name(F.col("c_custkey")).alias("s"), F.lit(OWL + "sameAs").alias("p"), name(F.col("c_custkey") - 7).alias("o")))


add("owl_sameas_components", "WITH n AS (SELECT c_custkey AS k FROM customer WHERE c_custkey >= 7 UNION SELECT c_custkey - 7 FROM customer WHERE c_custkey >= 7) SELECT 'urn:customer:' || k AS node, min('urn:customer:' || k) OVER (PARTITION BY k % 7) AS component FROM n")(
    lambda spark, sf: owl.Ontology(same_customers(spark, sf)).same_individuals()
)
add("owl_lite_superclasses", "SELECT class FROM (VALUES ('tp:Rich'), ('tp:Customer'), ('tp:Client')) t(class)")(lambda spark, sf: owl.Ontology(market(spark, sf)).superclasses("tp:Rich"))
add("owl_lite_subclasses", "SELECT class FROM (VALUES ('tp:Rich'), ('tp:Customer'), ('tp:Client')) t(class)")(lambda spark, sf: owl.Ontology(market(spark, sf)).subclasses("tp:Client"))
add(
    "owl_lite_realized",
    "SELECT 'urn:customer:' || c_custkey AS individual, class FROM customer, (VALUES ('tp:Customer'), ('tp:Client')) t(class) WHERE c_acctbal <= 9000 UNION ALL SELECT 'urn:customer:' || c_custkey, 'tp:Rich' FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT 'urn:customer:' || c_custkey, 'tp:Builder' FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'urn:orders:' || o_orderkey, 'tp:Orders' FROM orders",
)(lambda spark, sf: owl.Ontology(market(spark, sf)).realized())


# SHACL.
def shape(name: str, sql: str, *constraints: shacl.Constraint, path: object = None, target: tuple[str, str] = ("class", "tp:Customer"), graph: Callable[[SparkSession, str], Graph] = tpch_graph) -> None:
    own = shacl.NodeShape("urn:shape", [target], properties=[shacl.PropertyShape(path, [*constraints])]) if path is not None else shacl.NodeShape("urn:shape", [target], constraints=[*constraints])
    add(name, sql)(lambda spark, sf: shacl.validate(graph(spark, sf), [own]).select("focus_node", "component", "value"))


C = shacl.Constraint
FOCUS = lambda component, value, where, pre="'urn:customer:' || c_custkey", source="customer": f"SELECT {pre} AS focus_node, '{component}' AS component, {value} AS value FROM {source} WHERE {where}"
NONE = "CAST(NULL AS VARCHAR)"
shape("shacl_class", FOCUS("class", "'urn:nation:' || c_nationkey", "true"), C("class", "tp:Region"), path="tp:nation")
shape("shacl_datatype", FOCUS("datatype", "c_mktsegment", "true"), C("datatype", "http://www.w3.org/2001/XMLSchema#integer"), path="tp:c_mktsegment")
shape("shacl_mincount", FOCUS("minCount", NONE, f"{N_ORDERS} < 8"), C("minCount", 8), path=Inverse("tp:customer"))
shape("shacl_maxcount", FOCUS("maxCount", NONE, f"{N_ORDERS} > 12"), C("maxCount", 12), path=Inverse("tp:customer"))
shape("shacl_length", FOCUS("minLength", "c_mktsegment", "length(c_mktsegment) < 9") + " UNION ALL " + FOCUS("maxLength", "c_mktsegment", "length(c_mktsegment) > 9"), C("minLength", 9), C("maxLength", 9), path="tp:c_mktsegment")
shape("shacl_pattern", FOCUS("pattern", "c_mktsegment", "NOT regexp_matches(c_mktsegment, '(?i)^[a-m]')"), C("pattern", "^[a-m]", "i"), path="tp:c_mktsegment")
shape("shacl_in", FOCUS("in", "c_mktsegment", "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"), C("in", ["BUILDING", "MACHINERY"]), path="tp:c_mktsegment")
RANGE_SQL = " UNION ALL ".join(FOCUS(k, "CAST(c_acctbal AS VARCHAR)", w) for k, w in (("minInclusive", "c_acctbal < 0"), ("maxExclusive", "c_acctbal >= 9500")))
shape("shacl_range", RANGE_SQL, C("minInclusive", "0"), C("maxExclusive", "9500"), path="tp:c_acctbal")
BOUNDS_SQL = " UNION ALL ".join(FOCUS(k, "CAST(c_acctbal AS VARCHAR)", w) for k, w in (("minExclusive", "c_acctbal <= 500.5"), ("maxInclusive", "c_acctbal > 9000")))
shape("shacl_bounds", BOUNDS_SQL, C("minExclusive", "500.5"), C("maxInclusive", "9000"), path="tp:c_acctbal")
shape("shacl_lessthan", FOCUS("lessThan", "CAST(l_linenumber AS VARCHAR)", "NOT l_linenumber < l_quantity", "'urn:lineitem:' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey", "lineitem"), C("lessThan", "tp:l_quantity"), path="tp:l_linenumber", target=("class", "tp:Lineitem"))
shape("shacl_lessthanorequals", FOCUS("lessThanOrEquals", "CAST(c_custkey AS VARCHAR)", "NOT c_custkey <= c_acctbal"), C("lessThanOrEquals", "tp:c_acctbal"), path="tp:c_custkey")
shape("shacl_disjoint", FOCUS("disjoint", "n_name", "true", "'urn:nation:' || n_nationkey", "nation"), C("disjoint", "tp:n_name"), path="tp:n_name", target=("class", "tp:Nation"))
shape("shacl_node", FOCUS("node", "'urn:nation:' || c_nationkey", "c_nationkey >= 5"), C("node", [C("in", [f"urn:nation:{i}" for i in range(5)])]), path="tp:nation")
shape("shacl_not", FOCUS("not", "'urn:nation:' || c_nationkey", "c_nationkey < 5"), C("not", [C("in", [f"urn:nation:{i}" for i in range(5)])]), path="tp:nation")
shape("shacl_hasvalue_term", FOCUS("hasValue", NONE, "c_mktsegment <> 'BUILDING'") + " UNION ALL " + FOCUS("hasValue", NONE, "true"), C("hasValue", shacl.Term("BUILDING", "literal")), C("hasValue", shacl.Term("BUILDING")), path="tp:c_mktsegment")
shape("shacl_closed", " UNION ALL ".join(FOCUS("closed", f"'{p}'", "true", "'urn:nation:' || n_nationkey", "nation") for p in ("tp:n_nationkey", "tp:region")), C("closed", (["tp:n_name"], [TYPE])), target=("class", "tp:Nation"))
shape("shacl_nodekind", FOCUS("nodeKind", "'urn:nation:' || c_nationkey", "true"), C("nodeKind", shacl.SH + "Literal"), path="tp:nation")
shape("shacl_hasvalue", FOCUS("hasValue", NONE, "c_mktsegment <> 'BUILDING'"), C("hasValue", "BUILDING"), path="tp:c_mktsegment")
shape("shacl_qualified", FOCUS("qualifiedValueShape", NONE, "(SELECT count(*) FROM orders WHERE o_custkey = c_custkey) < 5"), C("qualifiedValueShape", ([C("class", "tp:Orders")], 5, None)), path=Inverse("tp:customer"))
shape("shacl_equals", FOCUS("equals", "x", "true", "'urn:customer:' || k", "(SELECT c_custkey AS k, c_name AS x FROM customer UNION ALL SELECT c_custkey, c_mktsegment FROM customer)"), C("equals", "tp:c_mktsegment"), path="tp:c_name")
shape("shacl_sparql", FOCUS("sparql", NONE, "c_acctbal < -900"), C("sparql", "SELECT ?this WHERE { ?this tp:c_acctbal ?b FILTER(?b < -900) }"))
SHORT = FOCUS("minLength", "n_name", "length(n_name) < 6", "'urn:nation:' || n_nationkey", "nation")
shape("shacl_targets_class", SHORT, C("minLength", 6), path="tp:n_name", target=("class", "tp:Nation"))
shape("shacl_targets_node", SHORT + " AND n_nationkey = 18", C("minLength", 6), path="tp:n_name", target=("node", "urn:nation:18"))
shape("shacl_targets_subjects", SHORT, C("minLength", 6), path="tp:n_name", target=("subjectsOf", "tp:region"))
shape("shacl_targets_objects", SHORT + " AND n_nationkey IN (SELECT s_nationkey FROM supplier UNION SELECT c_nationkey FROM customer)", C("minLength", 6), path="tp:n_name", target=("objectsOf", "tp:nation"))

# Detection.
IS_LOGIN, IS_NET, IS_PROCESS = "event_type IN ('click', 'signup')", "event_type IN ('view', 'purchase')", "event_type = 'error'"
DEST = "CASE event_id % 3 WHEN 0 THEN '10.0.0.' WHEN 1 THEN '192.168.1.' ELSE '172.16.0.' END || (event_id % 100)"
COMMAND = "CASE event_id % 5 WHEN 0 THEN 'sudo ls' WHEN 1 THEN 'encrypt.exe --bitcoin' WHEN 2 THEN 'nmap host' ELSE 'ls -l' END"
SECONDS = "CAST(floor(epoch(ts)) AS BIGINT)"


def cyber(spark: SparkSession, sf: str) -> DataFrame:
    return cyber_events(table(spark, sf, "events"))


add("det_malicious_ip", f"SELECT 'event:' || event_id AS subject, {DEST} AS ip FROM events WHERE {IS_NET} AND (regexp_matches({DEST}, '^192\\.168\\.1\\.\\d+$') OR regexp_matches({DEST}, '^10\\.0\\.0\\.\\d+$'))")(lambda spark, sf: detect.malicious_ip_alerts(QuadGraph(event_triples(cyber(spark, sf)))))
add(
    "det_lateral",
    f"""WITH l AS (SELECT 'u' || user_id AS u, {SECONDS} AS t, CAST(event_id AS VARCHAR) AS e, '10.0.' || (user_id % 2) || '.' || (event_id % 7) AS ip FROM events WHERE {IS_LOGIN} AND value >= 20),
w AS (SELECT u, t, e, ip, t - lag(t, 2) OVER o AS span, lag(ip, 1) OVER o AS i1, lag(ip, 2) OVER o AS i2, count(*) OVER (PARTITION BY u) AS n FROM l WINDOW o AS (PARTITION BY u ORDER BY t, e)),
h AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY t, e) AS k FROM w WHERE span <= 86400 AND ip <> i1 AND ip <> i2 AND i1 <> i2)
SELECT u AS user, n AS session_count, span AS time_span_seconds, CAST(3 AS BIGINT) AS unique_ips FROM h WHERE k = 1""",
)(lambda spark, sf: detect.lateral_movement(cyber(spark, sf), 86_400))
add("det_danger_cmd", f"SELECT CAST(event_id AS VARCHAR) AS event_id, {COMMAND} AS command_line FROM events WHERE {IS_PROCESS} AND event_id % 5 IN (0, 2)")(lambda spark, sf: detect.dangerous_commands(cyber(spark, sf)).select("event_id", "command_line"))
add("det_patterns", f"SELECT 'ransomware_execution' AS name, 'critical' AS severity, count(*) AS hits FROM events WHERE {IS_PROCESS} AND event_id % 5 = 1 HAVING count(*) > 0")(lambda spark, sf: detect.fired_patterns(cyber(spark, sf)))
add("det_pattern_actions", "SELECT * FROM (VALUES ('isolate_host', 'Ransomware execution detected', NULL), ('terminate_process', 'Ransomware process termination', NULL), ('alert', NULL, 'Ransomware attack detected')) t(action_type, reason, message)")(lambda spark, sf: detect.pattern_actions(cyber(spark, sf)).select("action_type", "reason", "message"))
add("det_baseline_dev", "SELECT event_id, value FROM (SELECT event_id, value, avg(value) OVER (PARTITION BY event_type) AS b FROM events) WHERE abs(value - b) / b > 2.0")(
    lambda spark, sf: (lambda e: e.join(e.groupBy("event_type").agg(F.avg("value").alias("b")), "event_type").where(detect.baseline_deviation(F.col("value"), F.col("b"), 2.0)).select("event_id", "value"))(table(spark, sf, "events"))
)
add("intel_lookup", f"SELECT CAST(event_id AS VARCHAR) AS event_id, {DEST} AS dest_ip, CASE {DEST} WHEN '10.0.0.50' THEN 'Threat detected: phishing (medium)' ELSE 'Threat detected: malware_c2 (high)' END AS threat FROM events WHERE {IS_NET} AND {DEST} IN ('10.0.0.50', '192.168.1.100')")(
    lambda spark, sf: detect.threats(cyber(spark, sf).select("event_id", "dest_ip"), detect.sample_feed(spark), "dest_ip", "IpAddress").select("event_id", "dest_ip", "threat")
)
add("intel_stats", "SELECT CAST(3 AS BIGINT) AS total_indicators, CAST(2 AS BIGINT) AS ip_indicators, CAST(1 AS BIGINT) AS domain_indicators, CAST(1 AS BIGINT) AS sources")(lambda spark, sf: detect.feed_statistics(detect.sample_feed(spark), detect.sample_sources(spark)))
add("siem_events", f"SELECT 'Connection to malicious IP detected: ' || {DEST} AS message, 'high' AS severity, 'security_alert' AS event_type FROM events WHERE {IS_NET} AND event_id % 3 < 2")(
    lambda spark, sf: siem.from_actions(detect.malicious_ip_actions(QuadGraph(event_triples(cyber(spark, sf)))), "host").select("message", "severity", "event_type")
)


# Time series.
def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_type").alias("label"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("event_id").alias("tie"), "value")


def scored(df: DataFrame) -> DataFrame:
    return df.select("label", "tie", F.round("score", 6).alias("score"), F.round("threshold", 6).alias("threshold"), "is_anomaly", "method")


PTS = f"p AS (SELECT event_type AS label, {SECONDS} AS t, event_id AS tie, value AS x FROM events)"
Z_SQL = "z AS (SELECT label, tie, x, avg(x) OVER w AS m, stddev_pop(x) OVER w AS d, count(x) OVER w AS n FROM p WINDOW w AS (PARTITION BY label ORDER BY t, tie ROWS 99 PRECEDING)), zr AS (SELECT label, tie, abs(x - m) / d AS score, m + 3 * d AS threshold, abs(x - m) / d > 3 AS is_anomaly, 'z_score' AS method FROM z WHERE n >= 10 AND d > 0)"
Q_SQL = "q AS (SELECT label, tie, x, list_sort(list(x) OVER (PARTITION BY label ORDER BY t, tie ROWS 99 PRECEDING)) AS l FROM p), q2 AS (SELECT label, tie, x, l[CAST(floor(len(l) * 0.25) AS INT) + 1] AS a, l[CAST(floor(len(l) * 0.75) AS INT) + 1] AS b FROM q WHERE len(l) >= 10), qr AS (SELECT label, tie, abs(x - (a + b) / 2) / (b - a) AS score, CASE WHEN x > b THEN b + 1.5 * (b - a) ELSE a - 1.5 * (b - a) END AS threshold, x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a) AS is_anomaly, 'iqr' AS method FROM q2)"
E_SQL = "e AS (SELECT label, tie, list_reduce(list(x) OVER (PARTITION BY label ORDER BY t, tie ROWS UNBOUNDED PRECEDING), lambda a, y: 0.1 * y + 0.9 * a) AS ema, avg(x) OVER (PARTITION BY label ORDER BY t, tie ROWS 49 PRECEDING) AS m FROM p), er AS (SELECT label, tie, abs(m - ema) / greatest(abs(ema), 1) AS score, 0.3 AS threshold, abs(m - ema) / greatest(abs(ema), 1) > 0.3 AS is_anomaly, 'trend' AS method FROM e)"
OUT = "label, tie, round(score, 6) AS score, round(CAST(threshold AS DOUBLE), 6) AS threshold, is_anomaly, method"
add("ts_zscore", f"WITH {PTS}, {Z_SQL} SELECT {OUT} FROM zr")(lambda spark, sf: scored(timeseries.z_scores(points(spark, sf), tie="tie")))
add("ts_iqr", f"WITH {PTS}, {Q_SQL} SELECT {OUT} FROM qr")(lambda spark, sf: scored(timeseries.quartile_ranges(points(spark, sf), tie="tie")))
add("ts_trend", f"WITH {PTS}, {E_SQL} SELECT {OUT} FROM er")(lambda spark, sf: scored(timeseries.trends(points(spark, sf), tie="tie")))
add(
    "ts_ensemble",
    f"WITH {PTS}, {Z_SQL}, {Q_SQL}, {E_SQL}, u AS (SELECT * FROM zr UNION ALL SELECT * FROM qr UNION ALL SELECT * FROM er), v AS (SELECT *, sum(CAST(is_anomaly AS INT)) OVER (PARTITION BY label, tie) >= 0.6 * 3 AS agreed FROM u) SELECT label, tie, round(score, 6) AS score, round(CAST(threshold AS DOUBLE), 6) AS threshold, is_anomaly OR agreed AS is_anomaly, CASE WHEN agreed THEN 'ensemble_' ELSE '' END || method AS method FROM v",
)(lambda spark, sf: scored(timeseries.security_preset(points(spark, sf), tie="tie", key=("label", "tie"))))
add("ts_last_counts", f"WITH {PTS} SELECT label, x AS value FROM p QUALIFY row_number() OVER (PARTITION BY label ORDER BY t DESC, tie DESC) = 1")(lambda spark, sf: timeseries.last_counts(points(spark, sf), tie="tie"))

# Rules.
POLICY = '{"name": "logins", "priority": 10, "rules": [{"id": "r1", "name": "bad ip", "conditions": [{"type": "TripleExists", "config": {"subject": "?e", "predicate": "http://example.org/destIP", "object": "10.0.0.50"}}, {"type": "NumericComparison", "config": {"left": {"type": "Variable", "value": "limit"}, "operator": "GreaterThan", "right": {"type": "Constant", "value": 5}}}], "actions": [{"type": "SecurityAction", "config": {"action_type": "Block", "message": "stop it", "details": {}}}, {"type": "AddTriple", "config": {"subject": "urn:net", "predicate": "urn:state", "object": "urn:alarm"}}], "severity": "High"}]}'
add("rule_policy_exists", f"SELECT 'alert' AS action_type, 'high' AS severity, 'Block action required: stop it' AS message FROM (SELECT count(*) AS n FROM events WHERE {IS_NET} AND {DEST} = '10.0.0.50') WHERE n > 0")(
    lambda spark, sf: rules.Policy.load(POLICY, limit=10).apply(event_triples(cyber(spark, sf))).actions.select("action_type", "severity", "message")
)
RULES = [rules.InferenceRule("up", [("?a", "tp:reportsTo", "?b")], [("?a", "tp:above", "?b")]), rules.InferenceRule("more", [("?a", "tp:above", "?b"), ("?b", "tp:reportsTo", "?c")], [("?a", "tp:above", "?c")])]
add("rule_datalog_fixpoint", f"WITH {UP} SELECT 'urn:customer:' || a AS s, 'tp:above' AS p, 'urn:customer:' || b AS o FROM up")(lambda spark, sf: rules.fixpoint(chain_graph(spark, sf).scan().drop("o_num"), RULES).select("s", "p", "o"))
add("engine_process", f"WITH {WHO} SELECT count(*) AS inferred, CAST(0 AS BIGINT) AS actions, CAST(0 AS BIGINT) AS violations FROM (SELECT s, 'w' AS p, o FROM who UNION SELECT s, 't', b FROM who, (VALUES ('tp:Located'), ('tp:Party')) t(b) UNION SELECT o, 't', b FROM who, (VALUES ('tp:Place'), ('tp:Area'), ('tp:Thing')) t(b))")(
    lambda spark, sf: rules.process(located(spark, sf), rules.Registry().register(rules.MaliciousIpRule())).statistics()
)
add("engine_actions", f"SELECT 'alert' AS action_type, 'high' AS severity, 'Connection to malicious IP detected: ' || {DEST} AS message FROM events WHERE {IS_NET} AND event_id % 3 < 2")(
    lambda spark, sf: rules.process(event_triples(cyber(spark, sf)), rules.Registry().register(rules.MaliciousIpRule())).actions.select("action_type", "severity", "message")
)

# Sources and sinks.
add(
    "event_triples",
    f"WITH e AS (SELECT 'event:' || event_id AS s, * FROM events) SELECT s, '{TYPE}' AS p, '{EX}CyberEvent' AS o FROM e UNION ALL SELECT s, '{EX}timestamp', CAST({SECONDS} AS VARCHAR) FROM e UNION ALL SELECT s, '{EX}user', 'u' || user_id FROM e WHERE {IS_LOGIN} OR {IS_PROCESS} UNION ALL SELECT s, '{EX}sourceIP', '10.0.' || (user_id % 2) || '.' || (event_id % 7) FROM e WHERE {IS_LOGIN} OR {IS_NET} UNION ALL SELECT s, '{EX}destIP', {DEST} FROM e WHERE {IS_NET} UNION ALL SELECT s, '{EX}port', '443' FROM e WHERE {IS_NET} UNION ALL SELECT s, '{EX}protocol', 'tcp' FROM e WHERE {IS_NET} UNION ALL SELECT s, '{EX}processId', CAST(event_id AS VARCHAR) FROM e WHERE {IS_PROCESS} UNION ALL SELECT s, '{EX}commandLine', {COMMAND} FROM e WHERE {IS_PROCESS} UNION ALL SELECT s, '{EX}success', CASE WHEN value >= 20 THEN 'true' ELSE 'false' END FROM e WHERE {IS_LOGIN}",
)(lambda spark, sf: event_triples(cyber(spark, sf)).select("s", "p", "o"))
NATIONS = "SELECT 'urn:nation:' || n_nationkey AS s, p, CASE p WHEN 'tp:n_name' THEN n_name WHEN 'tp:n_nationkey' THEN CAST(n_nationkey AS VARCHAR) WHEN 'tp:region' THEN 'urn:region:' || n_regionkey ELSE 'tp:Nation' END AS o FROM nation, (VALUES ('" + RDF_TYPE + "'), ('tp:n_name'), ('tp:n_nationkey'), ('tp:region')) t(p)"


def nation_quads(spark: SparkSession, sf: str) -> DataFrame:
    return VirtualGraph(spark, [b for b in tpch_graph(spark, sf).branches if b.prefix == "urn:nation:"]).scan().drop("o_num")


add("ntriples_roundtrip", NATIONS)(lambda spark, sf: formats.parse_ntriples(formats.to_ntriples(nation_quads(spark, sf))).select("s", "p", "o"))
add("jsonld_roundtrip", NATIONS)(lambda spark, sf: formats.parse_jsonld(formats.to_jsonld(nation_quads(spark, sf)).select(F.col("node").alias("value"))).select("s", "p", "o"))
add("event_jsonld", "SELECT '_:event_' || event_id AS id, CASE WHEN event_type IN ('click', 'signup') THEN 'UserLogin' WHEN event_type IN ('view', 'purchase') THEN 'NetworkConnection' ELSE 'ProcessExecution' END AS type FROM events")(
    lambda spark, sf: event_jsonld(cyber(spark, sf)).select(F.get_json_object("jsonld", "$.@graph[0].@id").alias("id"), F.get_json_object("jsonld", "$.@graph[0].@type").alias("type"))
)
add("store_stats", "SELECT count(*) * 4 AS triples, CAST(1 AS BIGINT) AS graphs, count(*) AS subjects, CAST(4 AS BIGINT) AS predicates, (SELECT count(DISTINCT o) FROM (" + NATIONS + ")) AS objects FROM nation")(lambda spark, sf: statistics(as_quads(nation_quads(spark, sf))))


@add("store_find", "SELECT 'urn:nation:' || n_nationkey AS s, n_name AS o, 'sensor' AS kind FROM nation")
def store_find(spark: SparkSession, sf: str) -> DataFrame:
    store = QuadStore(spark, f"{shared_dir(spark)}/kgspark-store-{uuid.uuid4().hex}")
    store.append(nation_quads(spark, sf).select("s", "p", "o", "o_kind", "o_dt", "o_lang"), "named", "nations", sensor("table", 1.0))
    return store.find(p="tp:n_name").select("s", "o", F.col("prov.kind").alias("kind"))


@add("audit_tail", "SELECT * FROM (VALUES ('insert', 'named:b'), ('clear', 'named:a')) t(operation, graph)")
def audit_tail(spark: SparkSession, sf: str) -> DataFrame:
    store = QuadStore(spark, f"{shared_dir(spark)}/kgspark-store-{uuid.uuid4().hex}")
    own = nation_quads(spark, sf).select("s", "p", "o", "o_kind", "o_dt", "o_lang")
    store.append(own, "named", "a")
    store.append(own, "named", "b")
    store.clear("named", "a")
    return store.audit(last=2).select("operation", "graph")


@add("store_clear", "SELECT 'b' AS graph_name, s, p, o FROM (" + NATIONS + ")")
def store_clear(spark: SparkSession, sf: str) -> DataFrame:
    """What clearing one of two graphs leaves."""
    store = QuadStore(spark, f"{shared_dir(spark)}/kgspark-store-{uuid.uuid4().hex}")
    own = nation_quads(spark, sf).select("s", "p", "o", "o_kind", "o_dt", "o_lang")
    store.append(own, "named", "a")
    store.append(own, "named", "b")
    store.clear("named", "a")
    return store.quads().select("graph_name", "s", "p", "o")


@add("store_graphs", "SELECT 'default' AS graph_kind, NULL AS graph_name, count(*) * 4 AS n FROM nation UNION ALL SELECT 'named', 'a', count(*) * 4 FROM nation")
def store_graphs(spark: SparkSession, sf: str) -> DataFrame:
    store = QuadStore(spark, f"{shared_dir(spark)}/kgspark-store-{uuid.uuid4().hex}")
    own = nation_quads(spark, sf).select("s", "p", "o", "o_kind", "o_dt", "o_lang")
    store.append(own)
    store.append(own, "named", "a")
    counts = [store.graph(k, n).groupBy("graph_kind", "graph_name").agg(F.count("*").alias("n")) for k, n in (("default", None), ("named", "a"))]
    return counts[0].unionByName(counts[1])


# Streams, run to the end of what is there.
def streamed(spark: SparkSession, sf: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    path = f"{shared_dir(spark)}/kgspark-stream-{uuid.uuid4().hex}"
    source = f"{sf}/events.parquet"
    own = streams.read_stream(spark, source + "*", spark.read.parquet(source).schema)  # a pattern, as a file by itself is no source
    out = work(own)
    streams.to_table(out, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


@add("stream_micro_batch", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_micro_batch(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_dir(spark)}/kgspark-stream-{uuid.uuid4().hex}"
    source = f"{sf}/events.parquet"
    own = streams.read_stream(spark, source + "*", spark.read.parquet(source).schema)  # a pattern, as a file by itself is no source
    count = lambda batch, epoch: batch.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")
    streams.micro_batches(own, count, f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("event_type").agg(F.sum("n").alias("n"))


CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
add("stream_tumbling", f"SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY ALL HAVING time_bucket(INTERVAL 1 HOUR, any_value(ts)) + INTERVAL 1 HOUR <= {CLOSED}")(
    lambda spark, sf: streamed(spark, sf, streams.tumbling_counts).select(F.unix_seconds("start").alias("start"), "event_type", "n")
)
add("stream_sliding", f"SELECT CAST(epoch(s) AS BIGINT) AS start, event_type, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * i) AS s FROM events, range(4) r(i)) GROUP BY s, event_type HAVING s + INTERVAL 1 HOUR <= {CLOSED}")(lambda spark, sf: streamed(spark, sf, streams.sliding_counts).select(F.unix_seconds("start").alias("start"), "event_type", "n"))
add(
    "stream_session",
    f"WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= {CLOSED}",
)(lambda spark, sf: streamed(spark, sf, streams.session_counts).select("user_id", "n"))
add("stream_stateful", f"WITH {PTS}, {Z_SQL} SELECT {OUT} FROM zr")(
    lambda spark, sf: scored(streamed(spark, sf, lambda df: streams.rolling_z_scores(df.select(F.col("event_type").alias("label"), F.unix_seconds("ts").alias("timestamp"), F.col("event_id").alias("tie"), "value"))))
)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of each region, by a chain of three patterns."""
    return query(tpch_graph(spark, sf), CHAIN3, {"n": "bigint"})

