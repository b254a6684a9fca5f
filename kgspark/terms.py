"""Quads as rows: the schema, vocabulary and small column helpers.

A quad is (s, p, o, o_kind, o_dt, o_lang, graph_kind, graph_name, asserted_at, prov). Blank nodes carry
the prefix `_:` in s and o, so a node is told by its text alone; o_kind is `iri`, `bnode` or `literal`;
o_dt and o_lang are empty strings where there is none, never null, so equality needs no null rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROV = "struct<kind:string,source:string,confidence:double,rule:string,reasoning_level:string,evidence:array<string>,source_uri:string,imported_at:bigint>"
QUAD_DDL = f"s string, p string, o string, o_kind string, o_dt string, o_lang string, graph_kind string, graph_name string, asserted_at timestamp, prov {PROV}"
TERM_COLUMNS = ("s", "p", "o", "o_kind", "o_dt", "o_lang", "graph_kind", "graph_name")
#: What a scan gives: o_num is the number that a numeric literal stands for, else null.
SCAN_COLUMNS = (*TERM_COLUMNS, "o_num")

# Vocabulary IRIs, fixed values.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SH = "http://www.w3.org/ns/shacl#"
EX = "http://example.org/"
TP = "tp:"
TYPE = RDF + "type"
SUBCLASS, SUBPROPERTY, DOMAIN, RANGE = (RDFS + x for x in ("subClassOf", "subPropertyOf", "domain", "range"))
STRING, INTEGER, DECIMAL, DOUBLE, BOOLEAN, DATETIME = (XSD + x for x in ("string", "integer", "decimal", "double", "boolean", "dateTime"))
LANG_STRING = RDF + "langString"
NUMERIC = [XSD + x for x in ("integer", "decimal", "double", "float", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger", "unsignedInt", "unsignedLong", "negativeInteger", "nonPositiveInteger")]
PREFIXES = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD, "sh": SH, "ex": EX, "foaf": "http://xmlns.com/foaf/0.1/", "tp": TP}


def node_kind(value: Column) -> Column:
    return F.when(value.startswith("_:"), F.lit("bnode")).otherwise(F.lit("iri"))


def number_of(value: Column, kind: Column, datatype: Column) -> Column:
    return F.when((kind == "literal") & datatype.isin(NUMERIC), value.try_cast("double"))


def as_quads(df: DataFrame) -> DataFrame:
    """df with any missing quad column filled: plain triples become IRIs or blank nodes of the default graph."""
    have = set(df.columns)
    fill = {
        "o_kind": node_kind(F.col("o")), "o_dt": F.lit(""), "o_lang": F.lit(""), "graph_kind": F.lit("default"), "graph_name": F.lit(None).cast("string"),
        "asserted_at": F.lit(None).cast("timestamp"), "prov": F.lit(None).cast(PROV),
    }
    text = {"o_dt", "o_lang"}
    return df.select("s", "p", "o", *((F.coalesce(F.col(c), F.lit("")).alias(c) if c in text else F.col(c)) if c in have else v.alias(c) for c, v in fill.items()))


def quads_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Quads from Python terms (s, p, o): o is an IRI or `_:x` as text, or a literal as (value, datatype, language)."""
    out = []
    for s, p, o in rows:
        if isinstance(o, tuple):
            value, dt, lang = (*o, "", "")[:3]
            out.append((s, p, value, "literal", LANG_STRING if lang and not dt else dt or STRING, lang))
        else:
            out.append((s, p, o, "bnode" if o.startswith("_:") else "iri", "", ""))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("s", "p", "o", "o_kind", "o_dt", "o_lang")])
    return as_quads(spark.createDataFrame(out, schema))
